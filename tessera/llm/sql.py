"""DuckDB SQL of the queries whose rows SQL can say, in ways that differ from the operators' own."""

#: crc32 by the usual table of 256 values, which is made from its polynomial.
CRC = """bits AS (
  SELECT list(x ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS x
    FROM range(256) r(n)))"""


def crc(text: str) -> str:
    """crc32 of an ASCII text; the row must be joined with `bits`."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    step = "xor(c // 256, t[xor(c % 256, b) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}))"


#: The sessions after each batch are made from all events up to it; a version's end is the first later one around it.
SESSIONS = f"""
WITH {CRC},
hashed AS (
  SELECT conv_id AS v, turn AS t, {crc("conv_id::VARCHAR")} AS c, {crc("concat(conv_id, ':', turn)")} AS h
  FROM conversations, bits WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
timed AS (
  SELECT 2 * (v // 8) + c % 2 AS usr, (c // 2) % 7200 + 300 * t + h % 600 AS s, h // 600 AS g, h FROM hashed),
ev AS (
  SELECT usr, s, h, s // 1800 + CASE WHEN g % 5 = 0 THEN g % 4 ELSE 0 END AS batch FROM timed),
cuts AS (SELECT DISTINCT usr, batch FROM ev),
seen AS (
  SELECT c.usr, c.batch AS b, e.s, e.h, e.batch,
    CASE WHEN e.s - lag(e.s) OVER (PARTITION BY c.usr, c.batch ORDER BY e.s) <= 240 THEN 0 ELSE 1 END AS head
  FROM cuts c JOIN ev e ON e.usr = c.usr AND e.batch <= c.batch),
islands AS (SELECT *, sum(head) OVER (PARTITION BY usr, b ORDER BY s) AS island FROM seen),
ver AS (
  SELECT usr, b AS batch, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events,
    count(*) FILTER (WHERE batch = b) AS n_new, sum(h)::BIGINT AS h_sum
  FROM islands GROUP BY usr, b, island HAVING count(*) FILTER (WHERE batch = b) > 0),
ends AS (
  SELECT r.usr, r.batch, r.start_s, min(v.batch) AS retracted_batch, arg_min(v.start_s, v.batch) AS retracted_start_s
  FROM ver r JOIN ver v ON v.usr = r.usr AND v.batch > r.batch AND r.start_s BETWEEN v.start_s AND v.end_s
  GROUP BY r.usr, r.batch, r.start_s),
inside AS (
  SELECT usr, retracted_batch AS batch, retracted_start_s AS start_s, count(*) AS n FROM ends GROUP BY ALL)
SELECT ver.usr AS "user", ver.batch, ver.start_s, end_s, n_events, n_new, coalesce(inside.n, 0) AS n_retracted, h_sum,
  retracted_batch, retracted_start_s
FROM ver
LEFT JOIN ends ON ends.usr = ver.usr AND ends.batch = ver.batch AND ends.start_s = ver.start_s
LEFT JOIN inside ON inside.usr = ver.usr AND inside.batch = ver.batch AND inside.start_s = ver.start_s"""

#: Terms by DuckDB's own regular expression, a row for each document and term.
RANKED = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (r), total GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10"""

#: Every query against every row, in whole numbers.
TOP = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, a.r, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM ranked WHERE n <= 5"""
