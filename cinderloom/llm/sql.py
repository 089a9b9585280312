"""DuckDB SQL for the queries that SQL can express on whole tables. Parameters come from the operators, rules do not."""

from . import quality

OP1_MIXING = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM src
), weighted AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap FROM ranked
), levels AS (
  SELECT a.*, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM weighted)
    - coalesce((SELECT sum(b.cap) FROM weighted b WHERE (b.cap / b.weight, b.rank) < (a.cap / a.weight, a.rank)), 0))
    / (SELECT sum(b.weight) FROM weighted b WHERE (b.cap / b.weight, b.rank) >= (a.cap / a.weight, a.rank)) AS level
  FROM weighted a
)
SELECT source, rank, source_size, least(cap, (SELECT max(level) FROM levels) * weight) AS target FROM levels
"""

OP2_QUALITY = r"""
WITH docs AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 4], chr(1))) AS h FROM (SELECT *, unnest(range(1, len(w) - 3)) AS p FROM docs WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id
), counts AS (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(t) AS BIGINT) AS chars, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '\p{N}', '', 'g')) AS digit,
    length(t) - length(regexp_replace(t, '[.,;:!?''"()\-]', '', 'g')) AS punct, lower(' ' || array_to_string(w, '  ') || ' ') AS padded
  FROM docs LEFT JOIN repeats r USING (doc_id)
), common AS (
  SELECT * FROM (VALUES {common}) AS t(lang, k, word)
), listed AS (
  SELECT c.doc_id, c.lang, m.k, CAST((strlen(padded) - strlen(replace(padded, ' ' || m.word || ' ', ''))) / (strlen(m.word) + 2) AS DOUBLE) AS n FROM counts c JOIN common m ON m.lang = c.lang
), bins AS (
  SELECT doc_id, lang, 'c' AS kind, unnest([0, 1, 2, 3, 4, 5]) AS k,
    unnest([upper, digit, punct, n_symbols, chars - word_chars, greatest(word_chars - upper - digit - punct - n_symbols, 0)])::DOUBLE AS n FROM counts
  UNION ALL SELECT doc_id, lang, 'w', k, n FROM listed
  UNION ALL SELECT c.doc_id, any_value(c.lang), 'w', 99, any_value(c.n_words) - sum(n) FROM counts c JOIN listed USING (doc_id) GROUP BY c.doc_id
), sizes AS (
  SELECT lang, count(*) AS docs FROM counts GROUP BY lang
), ref AS (
  SELECT lang, kind, k, sum(n) AS n FROM bins GROUP BY ALL
), pooled AS (
  SELECT kind, k, sum(n) AS n FROM bins WHERE kind = 'c' GROUP BY ALL
), held AS (
  SELECT b.doc_id, b.kind, b.k, b.n AS p, CASE WHEN s.docs >= {least} THEN r.n WHEN b.kind = 'c' THEN o.n END AS q
  FROM bins b JOIN sizes s ON s.lang IS NOT DISTINCT FROM b.lang JOIN ref r ON r.lang IS NOT DISTINCT FROM b.lang AND r.kind = b.kind AND r.k = b.k LEFT JOIN pooled o ON o.kind = b.kind AND o.k = b.k
), shares AS (
  SELECT doc_id, kind, p / nullif(sum(p) OVER g, 0) AS p, q / nullif(sum(q) OVER g, 0) AS q FROM held WINDOW g AS (PARTITION BY doc_id, kind)
), distances AS (
  SELECT doc_id, kind, CASE WHEN count(p) > 0 AND count(q) > 0 THEN sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) END AS d
  FROM shares GROUP BY doc_id, kind
), judged AS (
  SELECT c.*, x.d AS dc, y.d AS dw, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM counts c LEFT JOIN distances x ON x.doc_id = c.doc_id AND x.kind = 'c' LEFT JOIN distances y ON y.doc_id = c.doc_id AND y.kind = 'w'
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {short} AND coalesce(dc, 0) > {far}) AND NOT (n_words >= {shorter} AND coalesce(dw, 0) > {further}) AS kept, round(dc, 6) AS class_distance, round(dw, 6) AS word_distance
FROM judged
"""

OP3_SUFFIX_DEDUP = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
), parts AS (
  SELECT doc_id, b, substr(x, 4000 * b + 1, 4198) AS x, n - 2000 * b AS n FROM (SELECT *, unnest(range(0, greatest(1, (n + 1999) // 2000))) AS b FROM docs)
), places AS (
  SELECT doc_id, 2000 * b + p AS p, md5(substr(x, 2 * p + 1, 200)) AS h FROM (SELECT *, unnest(range(0, least(2000, n - 99))) AS p FROM parts WHERE n >= 100)
), again AS (
  SELECT doc_id, p FROM places QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1
), runs AS (
  SELECT doc_id, run, min(p) AS a, max(p) + 100 AS z
  FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, CAST(p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) + 100 AS INTEGER) AS new FROM again))
  GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, a AS z, coalesce(lag(z) OVER w, 0) AS a FROM (SELECT doc_id, a, z FROM runs UNION ALL SELECT doc_id, n, n FROM docs) WINDOW w AS (PARTITION BY doc_id ORDER BY a, z)
), rest AS (
  SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS x FROM kept JOIN docs USING (doc_id) GROUP BY doc_id
), counts AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(rest.x)) AS kept_sha256
FROM docs JOIN rest USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

OP9_LINE_DEDUP = r"""
WITH docs AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), placed AS (
  SELECT doc_id, no, lines[no] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS no FROM docs WHERE text IS NOT NULL)
), worded AS (
  SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM placed
), firsts AS (
  SELECT line, any_value(w) AS w, min((doc_id, no)) AS place FROM worded WHERE len(w) >= 3 GROUP BY line
), variants AS (
  SELECT line, place, len(w) AS n, i, md5(array_to_string(w[1:i - 1] || w[i + 1:], chr(1))) AS h FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM firsts WHERE len(w) >= 10)
  UNION ALL SELECT line, place, len(w), 0, md5(array_to_string(w, chr(1))) FROM firsts WHERE len(w) >= 10
), near AS (
  SELECT DISTINCT a.line FROM variants a JOIN variants b ON a.h = b.h AND b.place < a.place AND a.line <> b.line AND (a.i = b.i OR a.i = 0 OR b.i = 0)
), gone AS (
  SELECT o.doc_id, o.no, f.place = (o.doc_id, o.no) AS first FROM worded o JOIN firsts f USING (line) WHERE f.place <> (o.doc_id, o.no) OR o.line IN (SELECT line FROM near)
), counts AS (
  SELECT doc_id, count_if(NOT first) AS n_exact, count_if(first) AS n_near FROM gone GROUP BY doc_id
), kept AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.no) AS text FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.no = p.no WHERE g.no IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN counts USING (doc_id) LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP8_TOP_K = """
WITH fine AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.id AS query_id, s.id AS vec_id, CAST(list_inner_product(q.v, s.v) AS BIGINT) AS score FROM fine q, fine s WHERE q.id % 100 = 0 AND q.id <> s.id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP11_FIM = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents
), numbers AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM docs
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

#: CRC-32 of a text, bit by bit.
CRC32 = """xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT),
  lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

_TREE = """
  SELECT grp, 0 AS level, row_number() OVER (PARTITION BY grp ORDER BY {order}) - 1 AS place, count(*) OVER (PARTITION BY grp) AS width, {h} AS h FROM {rows}
  UNION ALL
  SELECT grp, level + 1, place // 2, (width + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM {name} WHERE width > 1 GROUP BY grp, level, place // 2, width
"""

OP12_MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT *, sha256(list_aggregate(fields, 'string_agg', '')) AS leaf,
    CASE WHEN {CRC32.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN sha256(list_aggregate(changed, 'string_agg', '')) END AS tampered
  FROM (
    SELECT doc_id, lang AS grp,
      list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS fields,
      list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars + 1 AS VARCHAR), text], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS changed
    FROM documents
  )
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM leaves
), tree AS ({_TREE.format(order="doc_id NULLS FIRST, leaf", h="leaf", rows="leaves", name="tree")}
), tops AS (
  SELECT 1 AS grp, grp AS lang, h, row_number() OVER (ORDER BY grp IS NOT NULL, grp) - 1 AS rank FROM tree WHERE width = 1
), crown AS ({_TREE.format(order="rank", h="h", rows="tops", name="crown")}
), ways AS (
  SELECT p.grp, p.rank, own.level, CASE WHEN own.place % 2 = 1 THEN [coalesce(s.h, ''), ''] ELSE ['', coalesce(s.h, '')] END AS beside
  FROM placed p JOIN tree own ON own.grp IS NOT DISTINCT FROM p.grp AND own.width > 1 AND own.place = p.rank // CAST(power(2, own.level) AS BIGINT)
  LEFT JOIN tree s ON s.grp IS NOT DISTINCT FROM own.grp AND s.level = own.level AND s.place = xor(own.place, 1)
  UNION ALL
  SELECT p.grp, p.rank, 1000 + own.level, CASE WHEN own.place % 2 = 1 THEN [coalesce(s.h, ''), ''] ELSE ['', coalesce(s.h, '')] END
  FROM placed p JOIN tops ON tops.lang IS NOT DISTINCT FROM p.grp JOIN crown own ON own.width > 1 AND own.place = tops.rank // CAST(power(2, own.level) AS BIGINT)
  LEFT JOIN crown s ON s.level = own.level AND s.place = xor(own.place, 1)
), proofs AS (
  SELECT grp, rank, list(beside ORDER BY level) AS path FROM ways GROUP BY grp, rank
), joined AS (
  SELECT p.doc_id, p.leaf, tops.h AS subroot, (SELECT h FROM crown WHERE width = 1) AS root, coalesce(w.path, []) AS path, coalesce(p.tampered, p.leaf) AS start
  FROM placed p JOIN tops ON tops.lang IS NOT DISTINCT FROM p.grp LEFT JOIN proofs w ON w.grp IS NOT DISTINCT FROM p.grp AND w.rank = p.rank
), folded AS (
  SELECT *, list_reduce([[start]] || path, lambda a, s: [sha256(s[1] || a[1] || s[2])])[1] AS folded_root FROM joined
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(flatten(path), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

_COMMON = ", ".join(f"('{lang}', {k}, '{word}')" for lang, words in quality.COMMON_WORDS.items() for k, word in enumerate(words))
for _name, _value in (
    ("common", _COMMON), ("least", quality.MIN_REFERENCE), ("short", quality.MIN_WORDS), ("shorter", quality.MIN_WORDS_FOR_WORDS), ("far", quality.MAX_CLASS_DISTANCE), ("further", quality.MAX_WORD_DISTANCE),
):
    OP2_QUALITY = OP2_QUALITY.replace(f"{{{_name}}}", str(_value))

#: The mix itself follows hash order, which SQL elsewhere does not share; its targets are held against OP1_MIXING in tests.
ORACLES = {"op2_quality": OP2_QUALITY, "op3_suffix_dedup": OP3_SUFFIX_DEDUP, "op8_top_k": OP8_TOP_K, "op9_line_dedup": OP9_LINE_DEDUP, "op11_fim": OP11_FIM, "op12_merkle": OP12_MERKLE}
