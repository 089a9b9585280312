"""Strict getters of VARIANT values: each gives null for a value of another kind, so that a reader can say what is wrong.

A boolean is no number and a number is no string. Paths that do not exist give null, like a JSON null; ``absent`` tells
whether there is anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def at(value: Column, name: str) -> Column:
    """Member ``name`` of an object, as a variant."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def absent(value: Column) -> Column:
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(True))


def members(value: Column) -> Column:
    """An object as a map from names to variants."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def items(value: Column) -> Column:
    """An array of variants."""
    return F.try_variant_get(value, "$", "array<variant>")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def string(value: Column) -> Column:
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def number(value: Column) -> Column:
    """A finite number."""
    x = F.try_variant_get(value, "$", "double")
    return F.when(_kind(value).rlike(NUMBER) & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def integer(value: Column) -> Column:
    return F.when(_kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def loose_integer(value: Column) -> Column:
    """What a lenient conversion makes of it: numbers lose their fraction, booleans are 0 and 1, strings of digits are read."""
    kind = _kind(value)
    digits = F.when(F.try_variant_get(value, "$", "string").rlike(r"^\s*[+-]?\d+\s*$"), F.trim(F.try_variant_get(value, "$", "string")).try_cast("bigint"))
    return F.when(kind == "STRING", digits).when(kind.rlike(NUMBER) | (kind == "BOOLEAN"), F.try_variant_get(value, "$", "bigint"))


def first_code(*cases: tuple[Column, str]) -> Column:
    """The code of the first case that holds; a null counts as false."""
    out = F
    for condition, code in cases:
        out = out.when(F.coalesce(condition, F.lit(False)), code)
    return out


def computed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with more columns, each computed once a row: the optimizer copies no expression through a generator, as it
    does into every later filter and use of a projection."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_one")
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, one).select(*kept, *[F.col(f"_one.{n}").alias(n) for n in columns])
