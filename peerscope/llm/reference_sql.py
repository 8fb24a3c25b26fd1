"""Reference SQL, written from the contracts, of the corpus queries that DuckDB can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
  d AS (SELECT page_id, octet_length(raw) AS payload_bytes, list_aggregate([list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || hex[1 + 5 * g : 5 + 5 * g] AS BIGINT) >> (15 - 5 * k)) & 31), 1) FOR k IN range(4)], 'string_agg', '') FOR g IN range(8)], 'string_agg', '') AS payload_digest FROM p),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS k FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
  edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
  c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(c.low, w.doc_id)) AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""

OP8 = f"""
WITH t AS (SELECT doc_id, {_WORDS} AS ws FROM documents), w AS (SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM t, unnest(range(1, len(ws) + 1)) r(i)),
  u AS (SELECT w, count(*) AS c FROM w GROUP BY w), b AS (SELECT v, w, count(*) AS c FROM w WHERE v IS NOT NULL GROUP BY v, w), n AS (SELECT count(*) AS n FROM w),
  s AS (SELECT w.doc_id, sum(ln(CASE WHEN w.v IS NULL THEN uw.c / n ELSE CASE WHEN b.c >= 2 THEN b.c / uv.c ELSE 0.4 * uw.c / n END END)) AS log_score, count(*) AS n_words
    FROM w CROSS JOIN n JOIN u uw ON uw.w = w.w LEFT JOIN u uv ON uv.w = w.v LEFT JOIN b ON b.v = w.v AND b.w = w.w GROUP BY w.doc_id)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(log_score, 0), 3) AS log_score, round(log_score / n_words, 6) AS mean_log_score FROM t LEFT JOIN s USING (doc_id)
"""

_TERMS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_TERMS}) AS ws FROM documents),
  i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, {_TERMS}) AS ws FROM benchmark),
  win AS (SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[p : p + 9], ' ') AS k FROM i, unnest(range(1, greatest(len(ws) - 8, 2))) t(p) WHERE len(ws) > 0),
  sizes AS (SELECT DISTINCT size FROM win),
  spots AS (SELECT doc_id, size, p, array_to_string(ws[p : p + size - 1], ' ') AS k FROM d CROSS JOIN sizes, unnest(range(1, len(ws) - size + 2)) t(p)),
  hits AS (SELECT doc_id, item, p, win.size FROM spots JOIN win ON spots.k = win.k AND spots.size = win.size),
  c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + size)) t(q) GROUP BY doc_id),
  m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

#: The production parameters: blocks of one word, three repeats, seed mix-1, shards of about 4096 documents. Quotients up to
#: QUOTIENTS / 2 seats from a row's exact share are ranked, so it holds for up to QUOTIENTS sources and shards a source.
QUOTIENTS = 80


def _seats(rows: str, within: str, share: str, seats: str, order: str, out: str) -> str:
    """Sainte-Lague by listing the quotients near the last seat; all rows of `rows` with the seats they get."""
    part = f"PARTITION BY {within}" if within else ""
    low = f"greatest(CAST(floor({share} / tot * {seats} - {QUOTIENTS // 2}) AS BIGINT), 0)"
    same = f"{within}, {order}" if within else order
    return f"""
    (WITH x AS (SELECT *, sum({share}) OVER ({part}) AS tot FROM {rows}), y AS (SELECT *, CASE WHEN {share} > 0 THEN {low} ELSE 0 END AS low FROM x),
      z AS (SELECT *, sum(low) OVER ({part}) AS given FROM y),
      won AS (SELECT {same}, count(*) AS more FROM (SELECT {same} FROM z, unnest(range(low, low + {QUOTIENTS} + 2)) t(j) WHERE {share} > 0
        QUALIFY row_number() OVER ({part} ORDER BY {share} / (2 * j + 1) DESC, {order}, j) <= {seats} - given) GROUP BY ALL)
    SELECT z.*, low + coalesce(more, 0) AS {out} FROM z LEFT JOIN won USING ({same}))"""


OP6 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, greatest(CAST(ceil(count(*) / 4096) AS BIGINT), 1) AS shards FROM d GROUP BY source),
  ranked AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rk, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM src),
  weighed AS (SELECT *, CAST([5, 2, 1][(rk - 1) % 3 + 1] AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM ranked),
  opened AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM weighed),
  level AS (SELECT min_by(open, struct_pack(l := cap / w, r := rk)) FILTER (cap / w > open) AS water FROM opened),
  target AS (SELECT o.*, CASE WHEN cap / w <= open OR water IS NULL THEN cap ELSE water * w END AS target FROM opened o CROSS JOIN level),
  quota AS (SELECT * FROM {_seats("target", "", "target", "total", "rk", "quota")}),
  placed AS (SELECT d.doc_id, d.size, d.h, q.rk, q.target, q.source_size, least(quota, 3 * q.source_size) AS words, CAST('0x' || h[1:8] AS BIGINT) % shards AS shard FROM d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source),
  shard AS (SELECT rk, shard, CAST(sum(size) AS BIGINT) AS length, any_value(words) AS words FROM placed GROUP BY rk, shard),
  shares AS (SELECT * FROM {_seats("shard", "rk", "length", "words", "shard", "take")}),
  ring AS (SELECT *, CAST(sum(size) OVER (PARTITION BY rk, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM placed)
SELECT doc_id, size, source_size, target, CAST((take // greatest(length, 1)) * size + greatest(least(upto, take % greatest(length, 1)) - (upto - size), 0) AS BIGINT) AS taken FROM ring JOIN (SELECT rk, shard, length, take FROM shares) USING (rk, shard)
"""

OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
  p AS (SELECT a, c AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5)
SELECT p.a AS anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.a, positive_id ORDER BY score DESC, c) AS INTEGER) AS rank, c AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""

#: `<turn>`, role, a line feed, text, `</turn>` and a line feed; each backslash and `<` inside takes one character more.
OP13 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
  m AS (SELECT *, 15 + length(replace(replace(role, '\', '\b'), '<', '\l')) + length(role) - length(replace(role, chr(10), '')) + length(replace(replace(text, '\', '\b'), '<', '\l')) AS chars FROM t),
  c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role) AS listed, coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '') AS learned, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(listed) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM c
"""

SQL = {"op11_hard_negatives": OP11, "op13_chat_formatting": OP13, "op2_warc": OP2, "op4_near_dedup": OP4, "op8_lm_scoring": OP8, "op9_decontamination": OP9, "op6_mixing": OP6}
