"""Training-data operators against brute force on small tables with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderloom.llm import bpe, chat, components, knn, licenses, line_dedup, lm, mixing, quality, simhash, suffix_dedup

SF = "/root/testdata/sf0.001"
WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
ODD = [
    (9001, None, None, None), (9002, "", "en", "src1"), (9003, "   \n ", None, "src1"), (None, "a lonely text", "en", None),
    (9004, " ".join(WORDS), "en", "src2"), (9004, " ".join(WORDS), "en", "src2"), (9005, " ".join(WORDS[:-1]), "en", "src2"),
    (9006, "x" * 700 + " é　 ok  \n\n", "fr", "src3"), (9007, "Released under the MIT License.\nmit-license MIT license", "en", "src3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    both = base.unionByName(odd).withColumn("n_chars", F.length("text").cast("long"))
    return both.withColumn("size", F.lit("extra")).withColumn("kept", F.lit(1)).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("false")


def test_mixing(docs, none):
    rows = mixing.plan_mix(docs).collect()
    assert len(rows) == docs.count() and sum(r["target"] for r in {(r["source_size"], r["target"]): r for r in rows}.values()) > 0
    word = lambda t: len((t or "").encode().split())
    assert sorted(r["size"] for r in rows) == sorted(word(r["text"]) for r in docs.collect())
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 and len(r["positions"]) == r["copies"] for r in rows)
    assert all(0 <= p <= 1 for r in rows for p in r["positions"])
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - total) < 0.1 * total
    assert mixing.plan_mix(none).count() == 0


def test_schedule_inverse(spark):
    schedule = ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))
    got = [r[0] for r in spark.range(11).select(mixing.position(F.col("id") / 10, schedule)).collect()]
    pieces = mixing.cumulative(schedule)

    def area(t):
        return max(a + w * (t - s) + m * (t - s) ** 2 / 2 for a, s, width, w, m in pieces if t >= s - 1e-12)

    assert all(abs(area(t) - k / 10) < 1e-9 for k, t in enumerate(got))


def test_quality(docs, none):
    for r in quality.quality_rules(docs, keep=["text"]).collect():
        w = [x for x in (r["_keep_text"] or "").encode().split()]
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (r["_keep_text"] or "").split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in r["_keep_text"] or ""), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(none).count() == 0


@pytest.mark.parametrize(("wide", "piece"), [(1000, 1_000_000), (2, 1_000_000), (1000, 30)])
def test_suffix_dedup(spark, docs, none, wide, piece):
    text = "".join(f"{k:04d}" for k in range(60))
    more = [(8000 + k, f"{k}-{k * 7919}" + text + f"tail {k}", "en", "s") for k in range(12)] + [(8100, "ab" * 300, "en", "s"), (8100, "other " * 40, "en", "s")]
    more += [(None, text + f"end {k}", "en", "s") for k in range(5)] + [(None, f"{k} alone " + "".join(f"{k * j:05d}" for j in range(80)), "en", "s") for k in range(3, 8)]
    d = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    rows = d.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("t")).collect()
    seen, want = set(), {}
    for i, _, t in sorted({(1 << 62 if r["doc_id"] is None else r["doc_id"], r["h"], r["t"]) for r in rows}):
        raw = t.encode()
        flag = np.zeros(len(raw) + 1, int)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                flag[k : k + 100] = 1
            seen.add(raw[k : k + 100])
        kept = bytes(c for c, f in zip(raw, flag, strict=False) if not f)
        want[i, t] = (len(raw), int(flag.sum()), int((np.diff(flag, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = sorted((1 << 62 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(d, wide_group=wide, piece_rows=piece).collect())
    exp = sorted((i, *want[i, r["t"]]) for r in rows for i in [1 << 62 if r["doc_id"] is None else r["doc_id"]])
    assert got == exp and sum(e[2] for e in exp) > 2000
    assert wide > 2 or suffix_dedup.remove_repeats(none).count() == 0


def test_long_text_is_read_in_windows(spark):
    rng = np.random.default_rng(3)
    long = "".join(map(chr, rng.integers(97, 123, suffix_dedup.BATCH_BYTES + 5000).tolist()))
    edge = suffix_dedup.BATCH_BYTES
    rows = [(1, long), (2, long[edge - 300 : edge + 300]), (3, long[edge + 4000 :] + long[:400])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (len(long), 0, 0), 2: (600, 600, 1), 3: (1400, 1400, 1)}


def test_previous_factors():
    s = b"abracadabra abracadabra"
    suffixes = [s[i:] for i in range(len(s))]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    want = [max((common(suffixes[j], suffixes[i]) for j in range(i)), default=0) for i in range(len(s))]
    assert suffix_dedup.previous_factors(*suffix_dedup.suffix_array(suffixes)) == want


def test_chat(spark):
    odd = [(1, 0, "system", "be <|im_end|>\n\\ brief"), (1, 1, "user", None), (1, 1, "user", None), (1, 2, "assistant", "w " * 900), (1, 3, "assistant", "\\<|im_start|>"), (1, 4, "us\\ner\n", "hm"), (None, 0, "assistant", "a\n")]
    odd += [(2, k, ("user", "assistant")[k % 2], "many words here " * 30) for k in range(40)]
    table = spark.read.parquet(f"{SF}/conversations.parquet").union(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    every = chat.with_probe(table)
    turns = collections.defaultdict(list)
    for r in every.collect():
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    made = chat.windows(every)
    got = chat.read_back(made).collect()
    assert len(got) == len(turns)
    for r in got:
        t = sorted(turns[r["conv_id"]])
        said, learned = "".join(f"{a}\n{b}\n" for _, a, b in t), "".join(b for _, a, b in t if a == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(t), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert made.where("window > 0 AND n_context > 0").count() > 5
    assert chat.read_back(chat.windows(table.where("false"))).count() == 0


def test_simhash(spark, docs, none):
    near = [(7000 + k, " ".join(WORDS * 20 + [f"w{k}"]), "en", "s", 0, "x", 1) for k in range(30)]
    d = docs.unionByName(spark.createDataFrame(near, docs.select("doc_id", "text", "lang", "source", F.col("n_chars"), "size", "kept").schema))
    for rows_limit in (1000, 3):
        rows = simhash.near_duplicates(d, shard_rows=rows_limit).collect()
        fps = sorted({r["fp"] for r in rows})
        parent = {f: f for f in fps}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(fps):
            for b in fps[:i]:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                    parent[top(a)] = top(b)
        least = {}
        for r in rows:
            if r["doc_id"] is not None:
                least[top(r["fp"])] = min(least.get(top(r["fp"]), 1 << 62), r["doc_id"])
        assert len(rows) == d.count() and all(r["component_id"] == least.get(top(r["fp"])) for r in rows)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(d).columns == d.columns


def similar_groups(texts, width=5, least=0.8):
    """Places of the texts by group: links between all pairs of shingle sets, compared one by one."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b):
                parent[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i in range(len(texts)):
        groups[top(i)].append(i)
    return groups


def test_one_of_each(spark, docs, none):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        first = [f"g{g}w{x}" for x in rng.integers(0, 500, 300)]
        for k in range(8):
            w = list(first)
            for at in rng.integers(0, len(w), 3 * k):
                w[at] = f"edit{rng.integers(0, 10**6)}"
            rows.append((8000 + 10 * g + k, " ".join(w), "en", "s", 0, "x", 1))
    d = docs.unionByName(spark.createDataFrame(rows, docs.select("doc_id", "text", "lang", "source", "n_chars", "size", "kept").schema))
    listed = [(r["doc_id"] if r["doc_id"] is not None else 2**63 - 1, r["text"]) for r in d.select("doc_id", "text").collect()]
    want = sorted(min(listed[i][0] for i in g) for g in similar_groups([t for _, t in listed]).values())
    for rows_limit in (1000, 5):
        got = sorted(r["doc_id"] if r["doc_id"] is not None else 2**63 - 1 for r in simhash.one_of_each(d, shard_rows=rows_limit).collect())
        assert got == want
    assert len(want) < len(listed) - 30
    assert simhash.one_of_each(none).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 200)] + [(500 + k, 500) for k in range(1, 50)] + [(1000, 999)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 201)} | {500 + k: 500 for k in range(50)} | {999: 999, 1000: 999}


def test_chat_budget(spark):
    """No window of several own turns exceeds the budget, system turn and history counted."""
    rng = np.random.default_rng(1)
    rows = []
    for c in range(40):
        first = int(rng.integers(0, 3))
        sizes = [int(rng.choice([3, 30, 200, 400, 700])) for _ in range(25)]
        rows += [(c, t, "system" if t == 0 and first else ("user", "assistant")[t % 2], " ".join(["w"] * n)) for t, n in enumerate(sizes)]
    out = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=512).collect()
    for w in out:
        turns = w["formatted"].split("<|im_start|>")[1:]
        tokens = [len(t.split("\n", 1)[1].rsplit("<|im_end|>", 1)[0].split()) + chat.TURN_COST for t in turns]
        assert sum(tokens) <= 512 or (w["n_turns"] == 1 and tokens[-1] > 100 and w["n_context"] <= 1)
    own = sorted((w["conv_id"], w["window"], w["n_turns"]) for w in out)
    assert sum(n for _, _, n in own) == len(rows) and any(w["n_context"] > 1 for w in out)


def test_top_k_bounds(spark):
    """On clustered vectors few rows are sent to a second group."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    v = (centres[np.arange(3000) % 30] + 0.02 * rng.normal(size=(3000, 16))).astype(float)
    v /= np.sqrt((v**2).sum(1))[:, None]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    placed, need, local = knn._plan(table, 10, 7, 1024.0, 60, 20, 4096, "vec_id", "embedding", None)
    sent = placed.join(need, "cell").where("dist BETWEEN lo AND hi").count()
    assert sent < 3 * 3000  # there are some twenty groups
    got = {tuple(r) for r in knn.top_k_search(table, query_modulus=7, pivots=60, group_queries=20).collect()}
    w = np.floor(1024 * v).astype(int)
    s = w @ w.T
    want = {(i, a + 1, int(j), int(s[i, j])) for i in range(0, 3000, 7) for a, j in enumerate([j for j in np.lexsort((np.arange(3000), -s[i])) if j != i][:10])}
    assert got == want


def test_bpe(docs, none):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tok = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()): r["text"] or "" for r in docs.collect()}
    for size in (4_000_000, 300):
        rows = bpe.encode_documents(docs, path, public_tokenizers.PATTERN, table_words=size).collect()
        assert len(rows) == docs.count()
        for r in rows:
            ids = np.array(tok.encode_ordinary(texts[r["doc_id"], r["decoded_sha256"]]), dtype="<u4").tobytes()
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
    assert bpe.encode_documents(none, path, public_tokenizers.PATTERN).count() == 0


def test_lm(docs, none):
    rows = docs.select("doc_id", "text").collect()
    tokens = lambda t: [*lm.tokens(t), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for r in rows if not held(r["doc_id"]) for w in tokens(r["text"]))
    n, scale = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    want = sorted((str(r["doc_id"]), held(r["doc_id"]), len(tokens(r["text"])), sum(c[w] > 0 for w in tokens(r["text"])), round(sum(math.log10((c[w] + 0.5) / scale) for w in tokens(r["text"])), 6)) for r in rows)
    first = None
    for size, most in ((4_000_000, lm.BROADCAST_BYTES), (200, lm.BROADCAST_BYTES), (200, 0)):
        got = lm.score_documents(docs, table_words=size, broadcast_bytes=most).collect()
        scores = sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got)
        first = first or scores
        assert scores == first  # the filter that is broadcast and the one that is joined say the same
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
        assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    assert lm.score_documents(none).count() == 0


def test_lm_with_a_large_filter_shuffles_little(spark, docs, monkeypatch):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = big.agg(F.sum(F.octet_length("text"))).first()[0]
    written = lambda: time.sleep(2) or spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = {r["doc_id"]: r for r in lm.score_documents(big, broadcast_bytes=0).collect()}
    assert written() - before < 4 * text
    rounded = lambda r: (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6))
    assert {k: rounded(r) for k, r in got.items()} == {r["doc_id"]: rounded(r) for r in lm.score_documents(big).collect()}
    few = sorted((str(r["doc_id"]), rounded(r)) for r in lm.score_documents(docs, broadcast_bytes=0).collect())
    monkeypatch.setattr(lm, "CHUNK_BYTES", 10_000)  # many chunks, and texts longer than one
    assert sorted((str(r["doc_id"]), rounded(r)) for r in lm.score_documents(docs, broadcast_bytes=0).collect()) == few


def test_lm_with_a_large_filter_exchanges_texts_once(spark):
    """Texts are packed where they are read: besides the requests only packed ones are exchanged."""
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = big.agg(F.sum(F.octet_length("text"))).first()[0]
    keyed = big.select("doc_id", "text", F.lit(False).alias("held_out"))
    chunks = lm.packed(keyed)
    plan = lm.requests(chunks, 61)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and chunks.agg(F.sum(F.length("docs"))).first()[0] < text / 2
    read = [r for row in chunks.collect() for r in pa.ipc.open_stream(row["docs"]).read_all().to_pylist()]
    assert sorted((r["doc_id"], r["text"]) for r in read) == sorted((r["doc_id"], r["text"]) for r in big.collect())


def test_top_k(spark):
    base = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    base += [(1000 + k, base[0][1]) for k in range(40)]
    odd = [(2000, None), (2100, [float("nan")] * 64), (2200, [None] * 64), (None, base[1][1]), (2300, [1.0])]
    table = spark.createDataFrame(base + odd, "vec_id long, embedding array<float>").repartition(4)
    got = {tuple(r) for r in knn.top_k_search(table).collect()}
    assert got == {tuple(r) for r in knn.top_k_search(table, group_queries=2, pivots=20).collect()}
    ids = np.array([i for i, _ in base])
    v = np.floor(1024 * np.array([np.float32(x) for _, x in base], dtype=float)).astype(int)
    s = v @ v.T
    want = {(int(ids[i]), a + 1, int(ids[j]), int(s[i, j])) for i in np.flatnonzero(ids % 100 == 0) for a, j in enumerate([j for j in np.lexsort((ids, -s[i])) if j != i][:10])}
    assert got == want
    assert knn.top_k_search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_line_dedup(docs, none):
    rows = line_dedup.dedup_lines(docs).collect()
    source = {}
    for r in docs.select(*line_dedup.document_key(docs), "doc_id", "text").collect():
        source[r["_doc"], r["_th"]] = (r["doc_id"], r["text"])
    lines, first = [], {}
    for (doc, th), (_, text) in sorted(source.items()):
        for no, line in enumerate(text.split("\n") if text is not None else []):
            lines.append(((doc, th), no, line))
            if len(line.encode().split()) >= 3:
                first.setdefault(line, len(lines))

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        return a[k + 1 :] == b[k + len(b) - len(a) + 1 :]

    order = sorted(first, key=first.get)
    split = {x: x.encode().split() for x in order}
    long = [x for x in order if len(split[x]) >= 10]
    gone = {x for i, x in enumerate(long) if any(near(split[x], split[y]) for y in long[:i])}
    kept = collections.defaultdict(list)
    for at, (key, _, line) in enumerate(lines, 1):
        if line not in first or (line not in gone and first[line] == at):
            kept[key].append(line)
    want = sorted((str(i), t if t is None else "\n".join(kept[k])) for k, (i, t) in source.items())
    assert sorted({(str(r["doc_id"]), r["kept_text"]) for r in rows}, key=repr) == sorted(set(want), key=repr)
    assert line_dedup.dedup_lines(none).count() == 0


def test_licenses(docs, none):
    import re

    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for r in licenses.scan_licenses(docs).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text[r["doc_id"]].encode().lower().decode())
        places = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({k for _, k in places})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    assert licenses.scan_licenses(none).count() == 0


def spans_of(turns, budget, history_turns):
    """(own turns, repeated turns) of each window, filled greedily; turns: (role, text)."""
    tokens = [len(t.split()) + chat.TURN_COST for _, t in turns]
    head = turns[0][0] == "system" and 2 * tokens[0] <= budget
    room, out, k = budget - (tokens[0] if head else 0), [], int(head)
    own, used, history = [], 0, 0
    for i in range(k, len(turns)):
        if own and used + tokens[i] > room:
            out.append((len(own), history))
            last, own = own, []
            fits = [m for m in range(min(history_turns, len(last)) + 1) if m == 0 or (sum(tokens[j] for j in last[len(last) - m :]) <= room // 3 and sum(tokens[j] for j in last[len(last) - m :]) + tokens[i] <= room)]
            history = max(fits)
            used = sum(tokens[j] for j in last[len(last) - history :])
        own.append(i)
        used += tokens[i]
    if own or not out:
        out.append((len(own), history))
    if head and len(tokens) > 1 and tokens[1] > room:
        out.insert(0, (0, 0))
    return [(n + (head and j == 0), h + (head and j > 0)) for j, (n, h) in enumerate(out)]


@pytest.mark.parametrize(("budget", "history"), [(40, 2), (40, 0), (64, 3), (512, 2)])
def test_chat_fills_its_budget(spark, budget, history):
    rng, rows, turns = random.Random(budget), [], {}
    for c in range(40):
        turns[c] = [("system" if i == 0 and c % 2 else "user" if i % 2 else "assistant", " ".join(["word"] * rng.choice([0, 1, 3, 8, 20, 50]))) for i in range(rng.randrange(1, 30))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns[c])]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash")).withColumn("segment", F.lit("clash"))
    got = collections.defaultdict(list)
    for w in chat.windows(table, budget=budget, history_turns=history).orderBy("conv_id", "window").collect():
        got[w["conv_id"]].append((w["n_turns"], w["n_context"]))
    assert got == {c: spans_of(t, budget, history) for c, t in turns.items()}
    if budget == 512:
        small = [c for c, t in turns.items() if sum(len(x.split()) + chat.TURN_COST for _, x in t) <= budget]
        assert small and all(len(got[c]) == 1 for c in small)


def test_chat_in_segments(spark):
    """A conversation over many segments says the same, and each keeps its system turn."""
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "x " * (i % 7)) for i in range(1, 500)] + [(2, None, None, None), (None, 1, "user", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, cut = chat.windows(table, budget=60), chat.windows(table, budget=60, segment=16)
    same = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
    read = lambda w: sorted(map(repr, (tuple(r) for r in chat.read_back(w).select(*same).collect())))
    assert read(whole) == read(cut)
    assert all(w["n_context"] >= 1 and w["formatted"].startswith("<|im_start|>system\nbe kind<|im_end|>\n") for w in cut.where("conv_id = 1 AND window > 0").collect())
    long = spark.createDataFrame([(5, 0, "user", "w " * 300_000), (5, 1, "assistant", "é<|" * 200_000)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.windows(long)).first()
    assert (r["n_turns"], r["loss_chars"], r["n_windows"]) == (2, 600_000, 2)


def test_top_k_prunes_by_default(spark):
    """On 50,000 clustered vectors, with the registered parameters, rows are sent between groups, and fewer than half of all
    pairs are compared."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(200, 16))
    v = centres[np.arange(50_000) % 200] + 0.05 * rng.normal(size=(50_000, 16))
    v /= np.sqrt((v**2).sum(1))[:, None]
    order = rng.permutation(50_000)
    table = spark.createDataFrame(list(zip(range(50_000), v[order].tolist(), strict=True)), "vec_id long, embedding array<double>").repartition(8)
    placed, need, _ = knn._plan(table, 10, 100, 1024.0, None, knn.PART_QUERIES, 4096, "vec_id", "embedding", None)
    sent = placed.join(need, "cell").where("dist BETWEEN lo AND hi").groupBy("grp").count().collect()
    groups = {r["grp"]: r["count"] for r in sent}
    asking = 500 / len(set(groups) | {0})  # queries a group, about
    assert 0 < sum(groups.values()) * asking < 0.5 * 500 * 50_000 and len(groups) > 10
    got = {tuple(r) for r in knn.top_k_search(table).collect()}
    w = np.floor(1024 * v[order]).astype(int)
    for q in range(0, 50_000, 5_000):
        s = w @ w[q]
        s[q] = -(2**62)
        best = np.lexsort((np.arange(50_000), -s))[:10]
        assert all((q, rank + 1, int(j), int(s[j])) in got for rank, j in enumerate(best))
