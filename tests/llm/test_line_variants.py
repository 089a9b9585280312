"""Lines with the same words and other white space are within the edit bound of line dedup."""

from cinderloom.llm import line_dedup

LINE = "one two three four five six seven eight nine ten eleven twelve"


def test_white_space(spark):
    respaced = [LINE.replace(" ", "  "), "\t" + LINE, LINE + " ", LINE + "\r", LINE.replace("three four", "three\tfour")]
    other = LINE.replace("six", "sixth")
    rows = [(1, LINE), *[(2 + k, x) for k, x in enumerate(respaced)], (20, "short  line here"), (21, "short line here")]
    # a re-spaced line that comes first does not hide the line one word away
    rows += [(30, "x " + other.replace("nine", "9") + " \ny"), (31, "x " + other.replace("nine", "9"))]
    rows += [(40, f"{LINE} last  word"), (41, f"{LINE} last other"), (42, f"{LINE} last word")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["kept_text"], r["n_near"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == (LINE, 0) and all(got[2 + k] == ("", 1) for k in range(len(respaced)))
    assert [got[k][1] for k in (20, 21, 30, 31, 40, 41, 42)] == [0, 0, 0, 1, 0, 1, 1]


def test_variants_that_no_other_equals_are_left_behind(spark, monkeypatch):
    sizes, write = [], line_dedup.materialize

    def counted(df):
        made = write(df)
        if "v" in made.columns:
            sizes.append(made.count())
        return made

    monkeypatch.setattr(line_dedup, "materialize", counted)
    common = "a b c d e f g h"
    texts = [f"{common} i j k l", f"{common}\ti  j\x0bk\x0c m \r", f"{common} 1 2 3 4", f"{common} 5 6 7 8", "\t\r", None]
    rows = {r["doc_id"]: (r["kept_text"], r["n_near"]) for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows == {k: (x, 0) if k != 1 else ("", 1) for k, x in enumerate(texts)}
    assert sizes == [4 * 13, 2]
