"""Merkle manifest of a data set: a digest for every row, a tree of digests for every group of rows, and one over the groups.

H is the lowercase hex SHA-256 of its inputs put together, digests as hex text. Rows of a group ascend by id; every
``fan_out`` consecutive nodes become their H until one remains, which is the group's subroot (a lone leaf is its own). The
subroots, ordered by group (null first, bytewise), give the root in the same way. A row's proof is what stands to the left
and right of its node in each run on the way to the root; folding a leaf over it gives the root again.

Spark digests the rows, ranks them within their groups and deals them into buckets of ``fan_out ** block_levels`` consecutive
ranks. Buckets are whole subtrees, so each is worked off on its own by level queries of an in-process DuckDB on an executor. The
buckets' roots are the leaves of the next round, and proofs are joined from the outside in; a join key never has more rows
than a bucket.

Defined results: ids that repeat (null ids come first) are ordered by their digest; rows that are equal in all digested columns take
neighbouring places, each with its own proof. Null fields count as ``-``, empty ones as ``0:``. A null group is a group of
its own. An empty table gives an empty result. Columns that are not named are neither digested nor looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import materialize

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
_connections: list = []


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the digests beside its way lead to."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """H of all siblings, from the leaf's run to the root's."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: F.array(s["left"], s["right"]))), ""), 256)


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0) and ``n`` of their group, by range sort and prefix sums of counts per partition: no task
    sees more than a range of rows, however large a group or however many rows are equal."""
    # equal rows are told apart by where they were read, so that they spread over ranges
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_tie")
    sorted_rows = materialize(spread.sortWithinPartitions(group, *order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = sorted_rows.groupBy(group, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(group).orderBy("_part")
    every = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(group, "_part", (F.sum("_c").over(before) - F.col("_c") - F.col("_first")).alias("_shift"), F.sum("_c").over(every).alias("n"))
    return sorted_rows.withColumn("_part", part).join(starts, [group, "_part"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _connection():
    """This worker's DuckDB, opened once."""
    if not _connections:
        import duckdb

        con = duckdb.connect()
        con.execute("SET threads = 1")
        con.execute("SET memory_limit = '256MB'")
        _connections.append(con)
    return _connections[0]


def bucket_tree(table: pa.Table, fan_out: int, block_levels: int) -> pa.Table:
    """Rows of one bucket (rank, h, n and others) in order, with their ``path`` inside the bucket and its ``root``.

    One query a level digests the runs of the level below; a bucket has ``block_levels`` levels, fewer if its whole group has fewer.
    """
    con, table, levels, width = _connection(), table.sort_by("rank"), 0, table["n"][0].as_py()
    while width > 1 and levels < block_levels:
        width, levels = -(-width // fan_out), levels + 1
    con.register("leaves", table.select(["rank", "h"]))
    con.execute("CREATE OR REPLACE TEMP TABLE nodes AS SELECT 0 AS level, rank AS place, h FROM leaves")
    for level in range(levels):
        con.execute(
            "INSERT INTO nodes SELECT ? + 1, place // ?, sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE level = ? GROUP BY 2",
            [level, fan_out, level],
        )
    found = con.sql(
        """WITH beside AS (
             SELECT level, place, coalesce(string_agg(h, '') OVER prior, '') AS "left", coalesce(string_agg(h, '') OVER later, '') AS "right" FROM nodes
             WINDOW prior AS (PARTITION BY level, place // $f ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    later AS (PARTITION BY level, place // $f ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
           ), ways AS (
             SELECT rank, l AS level, rank // CAST(power($f, l) AS BIGINT) AS place FROM leaves, range($n) AS t(l)
           )
           SELECT list({'left': "left", 'right': "right"} ORDER BY level) AS path FROM ways JOIN beside USING (level, place) GROUP BY rank ORDER BY rank""",
        params={"f": fan_out, "n": levels},
    ).to_arrow_table()
    root = con.sql("SELECT h FROM nodes WHERE level = $n", params={"n": levels}).to_arrow_table()["h"][0].as_py()
    con.unregister("leaves")
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    path = found["path"].cast(kind) if levels else pa.array([[]] * len(table), kind)
    return table.append_column("path", path).append_column("root", pa.array([root] * len(table), pa.string()))


def paths(nodes: DataFrame, fan_out: int, block_levels: int) -> list[DataFrame]:
    """Rounds of buckets over ``nodes`` (grp, rank, n, h and others), from the leaves up, each with ``path`` and ``root``; in
    the last one a bucket is a whole group."""
    size, rounds = fan_out**block_levels, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        rows = nodes.withColumn("bucket", F.floor(F.col("rank") / size).cast("long")).withColumn("rank", F.col("rank").cast("long"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", path {PATH}, root string"
        done = rows.groupBy("grp", "bucket").applyInArrow(lambda t: bucket_tree(t, fan_out, block_levels), schema)
        rounds.append(materialize(done))
        if most <= size:
            return rounds
        most = -(-most // size)
        nodes = rounds[-1].where(F.col("rank") % size == 0).select("grp", F.col("bucket").alias("rank"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("root").alias("h"))


def _downwards(rounds: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """The leaves' rows with paths through all rounds and their group's root; with ``above`` (grp, path, root: what is over a
    whole group) the paths go on there, and the group's root is ``subroot``."""
    *lower, rows = rounds
    held = ["root"]
    if above is not None:
        rows, held = rows.withColumnRenamed("root", "subroot"), ["subroot", "root"]
        rows = rows.join(above.select("grp", F.col("path").alias("_more"), "root"), "grp").withColumn("path", F.concat("path", "_more")).drop("_more")
    for below in reversed(lower):
        up = rows.select("grp", F.col("rank").alias("bucket"), F.col("path").alias("_more"), *held)
        rows = below.drop("root").join(up, ["grp", "bucket"]).withColumn("path", F.concat("path", "_more")).drop("_more")
    return rows


def manifest(
    docs: DataFrame,
    *,
    columns: Sequence[str] = COLUMNS,
    group_col: str = "lang",
    id_col: str = "doc_id",
    fan_out: int = 2,
    block_levels: int = 12,
    carry: Sequence[Column] = (),
) -> DataFrame:
    """doc_id, leaf, subroot, root and path (array of left and right siblings' digests), and the columns ``carry``, which
    are computed from a row of ``docs`` as it is read."""
    if fan_out < 2 or block_levels < 1:
        raise ValueError("runs have two nodes or more, and buckets a level or more")
    carried = [c.alias(f"_carry_{k}") for k, c in enumerate(carry)]
    names = docs.select(*carry).columns
    group = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("n")).alias("grp")
    leaves = materialize(docs.select(group, F.col(id_col).alias("doc_id"), leaf([F.col(c) for c in columns]).alias("h"), *carried))
    inner = paths(ranked(leaves, "grp", ["doc_id", "h"]), fan_out, block_levels)
    subroots = inner[-1].where("rank = 0").select(F.lit("all").alias("grp"), F.col("grp").alias("key"), F.col("root").alias("h"))
    outer = _downwards(paths(ranked(subroots, "grp", ["key"]), fan_out, block_levels))
    above = outer.select(F.col("key").alias("grp"), "path", "root")
    whole = _downwards(inner, above)
    return whole.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", "path", *[F.col(f"_carry_{k}").alias(c) for k, c in enumerate(names)])
