"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

from ..functions import text

FINE = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
KEYFRAMES = """SELECT user_id AS video_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
  (epoch_us(ts) - 1704067200000000) / 1e6 AS pts, event_type AS label, value AS score,
  CAST(floor((epoch_us(ts) - 1704067200000000) / 1e6 * 25) AS BIGINT) AS frame_idx FROM events"""
def _text_hits(asked: str, k: int) -> str:
    """CTEs up to text_hits (query_id, candidate_id, score, r): documents nearest to the texts of ``asked`` (id, text)."""
    tokens = "SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM"
    bucket = "CAST('0x' || md5(t)[1:8] AS BIGINT) % 256 AS b, sum(CASE WHEN CAST('0x' || md5(t)[9:9] AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END) AS x"
    return f"""asked AS ({asked}), held AS (SELECT doc_id AS id, text FROM documents),
qv AS (SELECT id, {bucket} FROM ({tokens} asked) GROUP BY ALL), dv AS (SELECT id, {bucket} FROM ({tokens} held) GROUP BY ALL),
qn AS (SELECT id, sqrt(sum(x * x)) AS n FROM qv GROUP BY id), dn AS (SELECT id, sqrt(sum(x * x)) AS n FROM dv GROUP BY id),
dots AS (SELECT q.id AS qid, d.id AS did, sum(q.x * d.x)::DOUBLE AS dot FROM qv q JOIN dv d USING (b) GROUP BY ALL),
text_scores AS (SELECT a.id AS query_id, h.id AS candidate_id, coalesce(round(dot / nullif(qn.n * dn.n, 0), 9), 0) AS score FROM asked a CROSS JOIN held h
  LEFT JOIN dots ON qid = a.id AND did = h.id LEFT JOIN qn ON qn.id = a.id LEFT JOIN dn ON dn.id = h.id),
text_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS r FROM text_scores) WHERE r <= {k})"""


ITEMS = "SELECT item_id AS id, text FROM benchmark"
HITS = f"""visual AS (
  SELECT * FROM (SELECT q.vec_id AS query_id, 'visual' AS source, s.vec_id AS candidate_id, round(list_inner_product(q.v, s.v), 9) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v, s.v), 9) DESC, s.vec_id) AS r FROM ({FINE}) q, ({FINE}) s WHERE q.vec_id IN (SELECT item_id FROM benchmark)) WHERE r <= 500
), {_text_hits(ITEMS, 500)}, hits AS (SELECT * FROM visual UNION ALL SELECT query_id, 'asr', candidate_id, score, r FROM text_hits), weighed AS (SELECT *, CASE source WHEN 'asr' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS w FROM hits)"""
RRF = f"WITH {HITS}, fused AS (SELECT query_id, candidate_id, sum(w / (60 + r)) AS score, count(*) AS n_sources FROM weighed GROUP BY ALL)"
TRANSCRIPT = """SELECT conv_id AS video_id, turn AS segment, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 15.0::DOUBLE AS s,
  length(text) / 15.0::DOUBLE AS len FROM conversations"""


def _knn(score: str) -> str:
    return f"WITH f AS ({FINE}) SELECT s.vec_id, round({score}, 6) AS score FROM f q, f s WHERE q.vec_id = 0 ORDER BY {score} DESC, s.vec_id LIMIT 20"


def _align(gap: str, cost: str) -> str:
    return f"""WITH k AS ({KEYFRAMES}), names AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS e FROM (SELECT DISTINCT label FROM k) LIMIT 3),
c AS (SELECT * FROM (SELECT k.*, e, row_number() OVER (PARTITION BY video_id, e ORDER BY score DESC, pts, frame_idx) AS r FROM k JOIN names USING (label)) WHERE r <= 30)
SELECT a.video_id, round(max(a.score + b.score + c.score{cost}), 6) AS score FROM c a JOIN c b ON a.video_id = b.video_id AND b.pts > a.pts JOIN c ON c.video_id = b.video_id AND c.pts > b.pts
WHERE a.e = 0 AND b.e = 1 AND c.e = 2 {gap} GROUP BY a.video_id"""


PREDICTIONS = """ranked AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
pred AS (SELECT source AS query_id, rank, coalesce(quality, 0)::DOUBLE AS score FROM ranked LEFT JOIN labels USING (doc_id) WHERE rank <= 100),
recall AS (SELECT query_id, max(CASE WHEN rank <= 1 THEN score END) AS r1, max(CASE WHEN rank <= 5 THEN score END) AS r5, max(CASE WHEN rank <= 20 THEN score END) AS r20,
  max(CASE WHEN rank <= 50 THEN score END) AS r50, max(score) AS r100 FROM pred GROUP BY query_id)"""

RANKED = f"{RRF}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM fused)"
REQUESTS = f"""{RANKED}, top AS (SELECT query_id, candidate_id, rank, round(score, 9) AS score, (rank - 1) // 4 AS batch FROM ranked WHERE rank <= 12),
req AS (SELECT *, printf('C%02d', rank - batch * 4) AS label, coalesce((score - min(score) OVER p) / nullif(max(score) OVER p - min(score) OVER p, 0), 1) AS norm FROM top WINDOW p AS (PARTITION BY query_id))"""


def _contains(column: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


EVENTS = f"""parted AS (SELECT id, text, CASE WHEN len(regexp_extract_all(chr(10) || text, '{text.MARKER}')) >= 2 THEN regexp_split_to_array(chr(10) || text, '{text.MARKER}')[2:] ELSE regexp_split_to_array(text, '{text.SEPARATOR}') END AS raw FROM ({ITEMS})),
evented AS (SELECT id, text, list_filter(list_transform(raw, lambda x: trim(x, ' ,.;:' || chr(10))), lambda x: x <> '') AS events FROM parted)"""
ASKS = " OR ".join(_contains("lower(text)", parts) for _, parts in text.ANSWER_TYPES)
VARIANTS = f"""WITH {EVENTS}, listed AS (SELECT id, list_concat([{{'t': text, 'w': 1.0::DOUBLE}}, {{'t': regexp_replace(text, '^\\s*\\S+\\s+', ''), 'w': 0.8::DOUBLE}}],
  CASE WHEN len(events) >= 2 THEN list_transform(events, lambda e: {{'t': e, 'w': 0.85::DOUBLE}}) ELSE [] END) AS vs FROM evented),
spread AS (SELECT id AS query_id, unnest(vs) AS v, generate_subscripts(vs, 1) - 1 AS i FROM listed), keyed AS (SELECT query_id, i, v.t AS t, v.w AS w, trim(lower(regexp_replace(v.t, '\\s+', ' ', 'g'))) AS key FROM spread),
variants AS (SELECT * FROM keyed WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY i) = 1)"""
BEST_OF = "greatest(0, 1 - abs(c.ts - o.ts) / 86400)"
LINES = "SELECT frame, label, pos, score, x AS x0, y AS y0, x + 0.25::DOUBLE + tax AS x1, y + 0.3::DOUBLE AS y1 FROM (SELECT l_orderkey AS frame, l_returnflag AS label, l_linenumber AS pos, l_quantity / 50 AS score, l_discount * 5 AS x, (l_extendedprice % 1000) / 2000 AS y, l_tax AS tax FROM lineitem)"
ISSUES = """WITH ids AS (SELECT o_orderkey AS id, 'orders' AS c FROM orders UNION ALL SELECT l_orderkey, 'lineitem' FROM lineitem UNION ALL SELECT event_id, 'events' FROM events),
m AS (SELECT id, count(*) FILTER (c = 'orders') AS o, count(*) FILTER (c = 'lineitem') AS l, count(*) FILTER (c = 'events') AS e FROM ids GROUP BY id),
issues AS (SELECT id, 'error' AS severity, 'missing_component' AS code, 'orders' AS detail FROM m WHERE o = 0 UNION ALL SELECT id, 'warning', 'missing_component', 'lineitem' FROM m WHERE l = 0
  UNION ALL SELECT id, 'warning', 'missing_component', 'events' FROM m WHERE e = 0 UNION ALL SELECT id, 'error', 'component_count_mismatch', 'orders/lineitem' FROM m WHERE o > 0 AND l > 0 AND o <> l)"""
SHARED = "greatest(0, least(k.x1, d.x1) - greatest(k.x0, d.x0)) * greatest(0, least(k.y1, d.y1) - greatest(k.y0, d.y0))"

ORACLES = {
    "hash_embed_search": f"WITH {_text_hits(ITEMS, 10)} SELECT query_id, r AS rank, candidate_id, round(score, 6) AS score FROM text_hits",
    "variant_max_merge": f"""{VARIANTS}, {_text_hits('SELECT query_id * 1024 + i AS id, t AS text FROM variants', 20)}
SELECT v.query_id, candidate_id, round(max(score * w), 6) AS score FROM text_hits h JOIN variants v ON h.query_id = v.query_id * 1024 + v.i GROUP BY ALL""",
    "parse_queries": f"""WITH {EVENTS} SELECT id AS item_id, CASE WHEN {_contains("lower(text)", text.VI_MARKERS)} OR regexp_matches(lower(text), '[âầấẩẫậêềếểễệôồốổỗộîûĉĝĥĵŝŵŷăằắẳẵặĕğĭŏŭơờớởỡợưừứửữựđ]') THEN 'vi' WHEN regexp_matches(lower(text), '[a-z]') THEN 'en' ELSE 'unknown' END AS language,
  CASE WHEN len(events) >= 2 THEN 'TRAKE' WHEN {ASKS} OR contains(text, '?') THEN 'QA' ELSE 'KIS' END AS task, CASE WHEN len(events) >= 2 THEN len(events) ELSE 0 END AS n_events FROM evented""",
    "kis_topk": f"""{RANKED}, pool AS (SELECT query_id, candidate_id, label::BIGINT AS video_id, round(score, 9) AS score FROM ranked JOIN embeddings ON vec_id = candidate_id WHERE rank <= 1000),
u AS (SELECT *, coalesce((score - min(score) OVER p) / nullif(max(score) OVER p - min(score) OVER p, 0), 1) AS rel, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, candidate_id DESC) - 1 AS before FROM pool WINDOW p AS (PARTITION BY query_id)),
o AS (SELECT query_id, candidate_id, video_id, row_number() OVER (PARTITION BY query_id ORDER BY rel - 0.05::DOUBLE * before DESC, score DESC, candidate_id DESC) AS rank FROM u) SELECT query_id, rank, candidate_id, video_id FROM o WHERE rank <= 20""",
    "diversify": f"""WITH RECURSIVE pool AS (SELECT video_id, event_id AS id, pts AS ts, score FROM ({KEYFRAMES})),
rel AS (SELECT *, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS rel FROM pool),
g AS (SELECT video_id, list({{'u': 0.0::DOUBLE, 'score': score, 'id': id, 'ts': ts, 'rel': rel}}) AS rest, list({{'u': 0.0::DOUBLE, 'score': score, 'id': id, 'ts': ts, 'rel': rel}})[1:0] AS chosen FROM rel GROUP BY video_id
  UNION ALL SELECT video_id, list_filter(rest, lambda x: x.id <> b.id), list_append(chosen, b) FROM (SELECT *, list_sort(list_transform(rest, lambda c: {{'u': c.rel - 0.08::DOUBLE * len(chosen) - 0.35::DOUBLE * coalesce(list_max(list_transform(chosen, lambda o: {BEST_OF})), 0),
    'score': c.score, 'id': c.id, 'ts': c.ts, 'rel': c.rel}}), 'DESC')[1] AS b FROM g WHERE len(rest) > 0 AND len(chosen) < 50)),
c AS (SELECT video_id, unnest(chosen) AS b FROM g WHERE len(rest) = 0 OR len(chosen) = 50), o AS (SELECT row_number() OVER (ORDER BY b.u DESC, b.score DESC, b.id DESC) AS rank, b.id AS candidate_id, video_id, round(b.u, 6) AS utility FROM c)
SELECT * FROM o WHERE rank <= 50""",
    "nms_classwise": f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY frame, label ORDER BY score DESC, pos, x0, y0, x1, y1) AS rn FROM ({LINES}) WHERE score >= 0.2),
r AS (SELECT frame, label, 1::BIGINT AS rn, [{{'pos': pos, 'score': score, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS kept FROM d WHERE rn = 1
  UNION ALL SELECT d.frame, d.label, d.rn, CASE WHEN len(list_filter(kept, lambda k: {SHARED} / ((k.x1 - k.x0) * (k.y1 - k.y0) + (d.x1 - d.x0) * (d.y1 - d.y0) - {SHARED}) > 0.5)) > 0 THEN kept
    ELSE list_append(kept, {{'pos': d.pos, 'score': d.score, 'x0': d.x0, 'y0': d.y0, 'x1': d.x1, 'y1': d.y1}}) END FROM r JOIN d ON d.frame = r.frame AND d.label = r.label AND d.rn = r.rn + 1),
o AS (SELECT frame, label, unnest(arg_max(kept, rn)) AS k FROM r GROUP BY frame, label) SELECT frame, label, k.pos::BIGINT AS pos, round(k.score, 6) AS score FROM o""",
    "trake_topk": f"""WITH k AS ({KEYFRAMES}), names AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS e FROM (SELECT DISTINCT label FROM k) LIMIT 3),
c AS (SELECT * FROM (SELECT k.*, e, row_number() OVER (PARTITION BY video_id, e ORDER BY score DESC, pts, frame_idx) AS r FROM k JOIN names USING (label)) WHERE r <= 30),
r3 AS (SELECT video_id, label, score, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, event_id) AS r FROM k),
whole AS (SELECT video_id, 0.65 * max(score) + 0.35 * avg(score) + 0.05 * count(DISTINCT label) / (SELECT count(DISTINCT label) FROM k) AS whole FROM r3 WHERE r <= 3 GROUP BY video_id),
placed AS (SELECT *, row_number() OVER (ORDER BY whole DESC, video_id) AS place FROM whole),
able AS (SELECT video_id, whole, coalesce(place <= 100, false) AS top FROM (SELECT video_id FROM c GROUP BY video_id HAVING count(DISTINCT e) = 3) JOIN placed USING (video_id)),
chosen AS (SELECT * FROM able WHERE top OR NOT (SELECT bool_or(top) FROM able)),
al AS (SELECT a.video_id, arg_max(a.frame_idx || ',' || b.frame_idx || ',' || c.frame_idx, a.score + b.score + c.score) AS frames, max(a.score + b.score + c.score) AS s FROM c a JOIN c b ON a.video_id = b.video_id AND b.pts > a.pts JOIN c ON c.video_id = b.video_id AND c.pts > b.pts
  WHERE a.e = 0 AND b.e = 1 AND c.e = 2 GROUP BY a.video_id),
o AS (SELECT video_id, frames, s / 3 + 0.2 * coalesce(whole, 0) AS score FROM al JOIN chosen USING (video_id)), z AS (SELECT row_number() OVER (ORDER BY score DESC, video_id) AS rank, video_id, round(score, 6) AS score, frames FROM o)
SELECT * FROM z WHERE rank <= 100""",
    "ordered_viterbi": f"""WITH k AS (SELECT *, score AS s0, CASE WHEN label = 'click' THEN score * 2 ELSE score / 2 END AS s1, score + n / 100 AS s2, CAST(round(pts * 1000000) AS BIGINT) AS us FROM ({KEYFRAMES}))
SELECT a.video_id, round(max(a.s0 + b.s1 + c.s2), 6) AS score FROM k a JOIN k b ON a.video_id = b.video_id AND b.us > a.us AND b.us - a.us <= 432000000000 JOIN k c ON c.video_id = b.video_id AND c.us > b.us AND c.us - b.us <= 432000000000 GROUP BY a.video_id""",
    "ordered_viterbi_penalty": f"""WITH k AS (SELECT *, score AS s0, CASE WHEN label = 'click' THEN score * 2 ELSE score / 2 END AS s1, score + n / 100 AS s2 FROM ({KEYFRAMES})),
one AS (SELECT b.video_id, b.pts, max(a.s0 - 4 * ln(1 + b.pts - a.pts)) + any_value(b.s1) AS total FROM k a JOIN k b ON a.video_id = b.video_id AND b.pts - a.pts >= 60 GROUP BY b.video_id, b.event_id, b.pts),
two AS (SELECT b.video_id, max(a.total - 4 * ln(1 + b.pts - a.pts)) + any_value(b.s2) AS total FROM one a JOIN k b ON a.video_id = b.video_id AND b.pts - a.pts >= 60 GROUP BY b.video_id, b.event_id)
SELECT video_id, round(max(total), 6) AS score FROM two GROUP BY video_id""",
    "dense_refine": f"""WITH k AS ({KEYFRAMES}), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, event_id) AS r FROM k) WHERE r <= 3),
f AS (SELECT * FROM (SELECT c.video_id, c.event_id, c.score AS coarse, k.frame_idx, k.n % 7 / 7.0::DOUBLE AS m, row_number() OVER (PARTITION BY c.event_id ORDER BY k.n % 7 DESC, k.frame_idx) AS fr FROM c JOIN k ON k.video_id = c.video_id AND abs(k.pts - c.pts) <= 43200) WHERE fr <= 5)
SELECT video_id, frame_idx AS frame, round(max(0.2 * coarse + 0.8 * m), 6) AS score, true AS refined FROM f GROUP BY video_id, frame_idx""",
    "window_word_midpoint": rf"""WITH t AS ({TRANSCRIPT}), w AS (SELECT video_id, segment, s, s + len AS e, unnest(regexp_split_to_array(text, '\s+')) AS word, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) AS i FROM t),
b AS (SELECT *, coalesce(sum(length(word)) OVER (PARTITION BY video_id, segment ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length(word)) OVER (PARTITION BY video_id, segment) AS chars FROM w),
m AS (SELECT *, ((s + before::DOUBLE * ((e - s) / chars::DOUBLE)) + (s + (before + length(word))::DOUBLE * ((e - s) / chars::DOUBLE))) / 2 AS mid FROM b WHERE word <> ''),
d AS (SELECT video_id, max(s + len) AS duration FROM t GROUP BY video_id), g AS (SELECT video_id, i AS k, i * 5.0::DOUBLE AS a, least(i * 5.0::DOUBLE + 10, duration) AS z FROM d, unnest(range(CAST(ceil(duration / 5) AS BIGINT))) AS u(i))
SELECT g.video_id, g.k, md5(string_agg(word, ' ' ORDER BY segment, i)) AS text_md5, count(*) AS n_words FROM g JOIN m ON m.video_id = g.video_id AND mid >= a AND mid < z GROUP BY g.video_id, g.k""",
    "window_texts": f"""WITH k AS ({KEYFRAMES}), d AS (SELECT video_id, max(pts) + 0.04 AS duration FROM k GROUP BY video_id),
w AS (SELECT video_id, i AS k, i * 43200.0::DOUBLE AS s, least(i * 43200.0::DOUBLE + 86400, duration) AS e FROM d, unnest(range(CAST(ceil(duration / 43200) AS BIGINT))) AS u(i)),
l AS (SELECT w.video_id, w.k, label, min(n) AS n FROM w JOIN k ON k.video_id = w.video_id AND pts >= w.s AND pts < w.e GROUP BY ALL) SELECT video_id, k, string_agg(label, ',' ORDER BY n) AS text FROM l GROUP BY video_id, k""",
    "nearest_frame_fallback": f"""WITH k AS ({KEYFRAMES}), m AS (SELECT a.event_id AS ask_id, a.n, arg_min(b.n, (abs(b.frame_idx - (a.frame_idx + 40)), b.frame_idx)) AS nf, arg_min(b.n, (abs(b.pts - (a.pts + 100)), b.pts)) AS nt FROM k a JOIN k b USING (video_id) GROUP BY a.event_id, a.n)
SELECT ask_id, CASE WHEN n % 3 = 0 THEN n WHEN n % 3 = 1 THEN nf WHEN n % 4 > 0 THEN nt END AS n, CASE WHEN n % 3 = 0 THEN 'uid' WHEN n % 3 = 1 THEN 'frame' WHEN n % 4 > 0 THEN 'time' ELSE 'missing' END AS how FROM m""",
    "gallery_rows": f"""WITH k AS ({KEYFRAMES}) SELECT label AS query_id, dense_rank() OVER (PARTITION BY label ORDER BY video_id::VARCHAR) AS rank, row_number() OVER (PARTITION BY label, video_id ORDER BY n) - 1 AS event, video_id::VARCHAR AS video_id, frame_idx AS frame FROM k""",
    "map_summary": f"SELECT video_id, count(*) AS n_keyframes, arg_min(pts, n) AS first_pts, arg_max(pts, n) AS last_pts FROM ({KEYFRAMES}) GROUP BY video_id",
    "transcript_problems": f"""WITH t AS (SELECT video_id, segment, text, CASE WHEN segment % 3 = 0 THEN s - 60 ELSE s END AS a, CASE WHEN segment % 5 = 0 THEN s - 1 ELSE s + len END AS b FROM ({TRANSCRIPT})), l AS (SELECT *, lag(a) OVER (PARTITION BY video_id ORDER BY segment) AS p FROM t)
SELECT video_id, segment, 'negative_length' AS code FROM l WHERE b < a UNION ALL SELECT video_id, segment, 'out_of_order' FROM l WHERE p > a + 0.05::DOUBLE UNION ALL SELECT video_id, segment, 'blank_text' FROM l WHERE coalesce(trim(text), '') = ''""",
    "submission_violations": """WITH r AS (SELECT conv_id AS q, conv_id % 3 AS t, turn % 2 + 1 AS f, coalesce(trim(CASE WHEN role = 'assistant' THEN text END), '') <> '' AS a FROM conversations)
SELECT q AS query_id, 'one_frame' AS code FROM r WHERE t < 2 GROUP BY q HAVING bool_or(f <> 1) UNION ALL SELECT q, 'answer_missing' FROM r WHERE t = 1 GROUP BY q HAVING bool_or(NOT a) UNION ALL SELECT q, 'answer_unexpected' FROM r WHERE t <> 1 GROUP BY q HAVING bool_or(a)
UNION ALL SELECT q, 'event_count' FROM r WHERE t = 2 GROUP BY q HAVING count(DISTINCT f) > 1 UNION ALL SELECT q, 'too_many_rows' FROM r GROUP BY q HAVING count(*) > 100""",
    "record_hashes": "SELECT conv_id, count(*) AS n, sha256(string_agg(v || chr(10), '' ORDER BY turn, v)) AS sha FROM (SELECT conv_id, turn, coalesce(role, '') || '|' || coalesce(text, '') AS v FROM conversations) GROUP BY conv_id",
    "normalize_ocr": r"SELECT doc_id, md5(lower(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')))) AS normal_md5 FROM documents",
    "eval_interval_hits": f"""WITH k AS ({KEYFRAMES}), t AS (SELECT video_id, n > 6 AS late, min(frame_idx) AS a, max(frame_idx) AS b FROM k WHERE n IN (3, 6, 10, 12) GROUP BY ALL)
SELECT video_id AS query_id, n AS rank, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.video_id = k.video_id AND k.frame_idx BETWEEN a AND b) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM k""",
    "eval_trake_partial": f"""WITH k AS (SELECT *, (n - 1) // 10 AS e, (n - 1) % 10 + 1 AS rank FROM ({KEYFRAMES}) WHERE n <= 30), t AS (SELECT video_id, e, min(frame_idx) AS a, max(frame_idx) AS b FROM k WHERE rank <= e + 1 GROUP BY ALL), m AS (SELECT video_id, max(e) + 1 AS n_events FROM t GROUP BY video_id)
SELECT k.video_id AS query_id, k.rank, round(count(*) FILTER (frame_idx BETWEEN a AND b) / any_value(n_events)::DOUBLE, 6) AS score FROM k JOIN m USING (video_id) LEFT JOIN t ON t.video_id = k.video_id AND t.e = k.e WHERE k.rank <= 5 GROUP BY k.video_id, k.rank""",
    "reviewed_override": """WITH d AS (SELECT source AS query_id, doc_id AS frame, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS reviewed FROM documents),
n AS (SELECT *, count(*) FILTER (reviewed) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, reviewed ORDER BY frame) - 1 AS at_r FROM d),
o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY NOT reviewed, CASE WHEN reviewed THEN frame ELSE place END) AS rank, frame, round(CASE WHEN reviewed THEN 1 + (n - at_r) * 0.000001::DOUBLE ELSE 1 / place::DOUBLE END, 9) AS score, reviewed FROM n) SELECT * FROM o WHERE rank <= 100""",
    "qa_batches": f"{REQUESTS} SELECT query_id, candidate_id, batch, label, round(norm, 6) AS norm FROM req",
    "qa_blend": f"""{REQUESTS}, hit AS (SELECT query_id, candidate_id, 0.55::DOUBLE * ((query_id * 7 + batch * 3) % 10 / 10.0::DOUBLE) + 0.45::DOUBLE * norm AS blend FROM req WHERE (query_id + batch) % 4 <> 0 AND label = printf('C%02d', (query_id + batch) % 5 + 1))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, candidate_id) AS rank, candidate_id, round(blend, 6) AS score FROM hit""",
    "cache_misses": """SELECT DISTINCT sha256('{"p0":"' || role || '","p1":' || turn || '}') AS key FROM conversations WHERE (role, turn) NOT IN (SELECT (role, turn) FROM conversations WHERE role = 'assistant')""",
    "dedup_query_reuse": "SELECT q AS query_id, min(q) OVER (PARTITION BY text) AS leader, q <> min(q) OVER (PARTITION BY text) AS reused FROM (SELECT conv_id * 1000 + turn AS q, text FROM conversations WHERE role = 'user')",
    "stream_windows": """SELECT start_s, event_type, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT event_type, value, (epoch_us(ts) // 43200000000 - back) * 43200 AS start_s FROM events, (SELECT unnest([0, 1]) AS back)) GROUP BY ALL""",
    "manifest_issues": ISSUES + " SELECT * FROM issues",
    "issue_summary": ISSUES + " SELECT severity, code, count(*) AS n FROM issues GROUP BY severity, code",
    "artifact_problems": """WITH a AS (SELECT 'transcripts' AS artifact, s_nationkey AS id FROM supplier UNION SELECT 'windows', c_nationkey FROM customer UNION SELECT 'ocr', r_regionkey FROM region), names AS (SELECT DISTINCT artifact FROM a)
SELECT artifact, n_nationkey::BIGINT AS video_id, 'missing' AS code, CASE artifact WHEN 'ocr' THEN 'warning' ELSE 'error' END AS severity FROM names, nation WHERE (artifact, n_nationkey) NOT IN (SELECT (artifact, id) FROM a)
UNION ALL SELECT artifact, id::BIGINT, 'outside_scope', 'error' FROM a WHERE id NOT IN (SELECT n_nationkey FROM nation)""",
    "index_problems": """SELECT coalesce(vec_id, doc_id) AS vec_id, CASE WHEN doc_id IS NULL THEN 'metadata_missing' WHEN vec_id IS NULL THEN 'vector_missing' ELSE 'dimension' END AS code
FROM embeddings FULL JOIN (SELECT DISTINCT doc_id FROM documents) ON vec_id = doc_id WHERE vec_id IS NULL OR doc_id IS NULL OR len(embedding) <> 64""",
    "knn_cosine": _knn("list_cosine_similarity(q.v, s.v)"),
    "knn_inner_product": _knn("list_inner_product(q.v, s.v)"),
    "knn_l2": _knn("-(list_distance(q.v, s.v) ** 2)"),
    "knn_batch_topk_per_query": f"""WITH f AS ({FINE}), r AS (SELECT q.vec_id AS query_id, s.vec_id, list_inner_product(q.v, s.v) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, s.v) DESC, s.vec_id) AS rank FROM f q, f s WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "rrf_fusion": f"""{RRF}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM fused)
SELECT query_id, rank, candidate_id, round(score, 10) AS score, n_sources FROM r WHERE rank <= 50""",
    "weighted_fusion_minmax": f"""WITH {HITS}, n AS (SELECT *, (score - min(score) OVER p) / nullif(max(score) OVER p - min(score) OVER p, 0) AS x FROM weighed WINDOW p AS (PARTITION BY query_id, source))
SELECT query_id, candidate_id, round(sum(coalesce(x, 1) * w), 6) AS score, count(*) AS n_sources FROM n GROUP BY ALL""",
    "weighted_fusion_rank": f"WITH {HITS} SELECT query_id, candidate_id, round(sum(w / r), 6) AS score, count(*) AS n_sources FROM weighed GROUP BY ALL",
    "video_aggregate": """WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events)
SELECT user_id AS video_id, round(0.65 * max(value) + 0.35 * avg(value) + 0.05 * count(DISTINCT event_type) / (SELECT count(DISTINCT event_type) FROM events), 6) AS score FROM r WHERE r <= 3 GROUP BY user_id""",
    "sliding_windows": f"""WITH k AS ({KEYFRAMES}), d AS (SELECT video_id, max(pts) + 0.04 AS duration FROM k GROUP BY video_id),
w AS (SELECT video_id, i AS k, i * 43200.0::DOUBLE AS s, least(i * 43200.0::DOUBLE + 86400, duration) AS e FROM d, unnest(range(CAST(ceil(duration / 43200) AS BIGINT))) AS u(i))
SELECT w.video_id, w.k, w.s AS start, round(w.e, 6) AS "end", count(*) AS n_keyframes, arg_min(n, (abs(pts - (w.s + w.e) / 2), n)) AS representative,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, CAST(floor(w.s * 25) AS BIGINT) AS start_frame, CAST(ceil(w.e * 25) AS BIGINT) - 1 AS end_frame
FROM w JOIN k ON k.video_id = w.video_id AND pts >= w.s AND pts < w.e GROUP BY w.video_id, w.k, w.s, w.e""",
    "window_transcript_overlap": f"""WITH t AS ({TRANSCRIPT}), d AS (SELECT video_id, max(s + len) AS duration FROM t GROUP BY video_id),
w AS (SELECT video_id, i AS k, i * 5.0::DOUBLE AS a, least(i * 5.0::DOUBLE + 10, duration) AS b FROM d, unnest(range(CAST(ceil(duration / 5) AS BIGINT))) AS u(i))
SELECT w.video_id, w.k, md5(string_agg(text, ' ' ORDER BY segment)) AS text_md5, count(*) AS n_segments FROM w JOIN t ON t.video_id = w.video_id
  AND least(b, s + len) - greatest(a, s) > 0 AND (least(b, s + len) - greatest(a, s)) / greatest(1e-9, (s + len) - s) >= 0.2 GROUP BY w.video_id, w.k""",
    "window_mean_pool": f"""WITH x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM ({FINE})), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i)
SELECT label, CAST(i AS BIGINT) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""",
    "nearest_keyframe": f"""WITH k AS ({KEYFRAMES}), asked AS (SELECT DISTINCT video_id, d * 86400.0::DOUBLE AS at_s FROM k, range(30) AS u(d))
SELECT a.video_id, a.at_s AS "at", arg_min(k.n, (abs(k.pts - a.at_s), k.pts, k.n)) AS n FROM asked a JOIN k USING (video_id) GROUP BY a.video_id, a.at_s""",
    "timeline_violations": f"""WITH k AS (SELECT *, frame_idx + CASE WHEN n % 10 = 0 THEN 100 ELSE 0 END AS f FROM ({KEYFRAMES})), l AS (SELECT *, lag(f) OVER (PARTITION BY video_id ORDER BY n) AS bf FROM k)
SELECT video_id, n, CASE WHEN bf > f THEN 'order' ELSE 'drift' END AS code FROM l WHERE bf > f OR abs(pts * 25 - f) > 2.5""",
    "ordered_alignment": _align("", ""),
    "ordered_alignment_gap": _align("AND b.pts - a.pts <= 432000 AND c.pts - b.pts <= 432000", ""),
    "ordered_alignment_penalty": _align("", " - 0.5 * ln(1 + b.pts - a.pts) - 0.5 * ln(1 + c.pts - b.pts)"),
    "object_counts": """WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey AS frame, string_agg(n || ' ' || l_returnflag, ', ' ORDER BY l_returnflag) AS phrase, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY l_orderkey""",
    "manifest_outer_join": """WITH ids AS (SELECT c_custkey AS id, 'customer' AS c FROM customer UNION ALL SELECT o_custkey, 'orders' FROM orders UNION ALL SELECT s_suppkey, 'supplier' FROM supplier
  UNION ALL SELECT p_partkey, 'part' FROM part UNION ALL SELECT n_nationkey, 'nation' FROM nation UNION ALL SELECT r_regionkey, 'region' FROM region)
SELECT id, coalesce(list_aggregate(list_sort(list_filter(['customer', 'nation', 'orders', 'part', 'region', 'supplier'], lambda x: NOT list_contains(list(DISTINCT c), x))), 'string_agg', ','), '') AS missing,
  count(*) FILTER (c = 'orders') AS n_orders FROM ids GROUP BY id""",
    "scope_hash": "SELECT sha256(string_agg(x, chr(10) ORDER BY x) || chr(10)) AS scope_hash FROM (SELECT DISTINCT upper(trim(n_name)) AS x FROM nation)",
    "scope_diff": "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'present' ELSE 'missing' END AS state FROM nation",
    "normalize_answer": r"""SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\p{P}\p{Z}]', ' ', 'g'), '\s+', ' ', 'g'))) AS normal_md5,
  len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n_tokens FROM conversations""",
    "eval_recall_at_k": f"WITH {PREDICTIONS} SELECT *, round((r1 + r5 + r20 + r50 + r100) / 5, 6) AS final FROM recall",
    "eval_macro": f"""WITH {PREDICTIONS}, t AS (SELECT CASE WHEN length(query_id) = 4 THEN 'KIS' ELSE 'QA' END AS task, (r1 + r5 + r20 + r50 + r100) / 5 AS final FROM recall)
SELECT coalesce(task, 'all') AS task, round(avg(final), 6) AS final, count(*) AS n FROM t GROUP BY GROUPING SETS ((task), ())""",
    "submission_rows": r"""WITH a AS (SELECT conv_id, turn, text AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations WHERE role = 'assistant')
SELECT conv_id AS query_id, rank, conv_id || ',' || turn || ',' || CASE WHEN regexp_matches(answer, '[",\n\r]') THEN '"' || replace(answer, '"', '""') || '"' ELSE answer END AS line FROM a""",
    "json_props": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  (CASE WHEN ms >= 3600000 THEN printf('%02d:', ms // 3600000) ELSE '' END) || printf('%02d:%02d.%03d', ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock
FROM (SELECT *, (event_id % 100000) * 125 AS ms FROM events)""",
}
