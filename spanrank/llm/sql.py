"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM {documents}
), c AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 13 AS long, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), r AS (
  SELECT a.doc_id, a.i AS i1, b.i AS i2, c.i AS i3, a.line || chr(10) || b.line || chr(10) || c.line AS run
  FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.j = a.j + 1 JOIN c ON c.doc_id = a.doc_id AND c.j = a.j + 2
  UNION ALL
  SELECT a.doc_id, a.i, b.i, b.i, a.line || chr(10) || b.line FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.j = a.j + 1 WHERE a.long OR b.long
  UNION ALL
  SELECT doc_id, i, i, i, line FROM c WHERE long
), later AS (
  SELECT doc_id, i1, i2, i3 FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i1) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest([i1, i2, i3]) AS i FROM later
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text,
         count(*) FILTER (WHERE regexp_matches(l.line, '[^\x20\x09-\x0D]')) AS n_lines, count(g.i) AS n_removed
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)"""

#: Bytes under a 100-byte string that starts earlier; spans are runs of such windows.
BYTES = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, substring(hex(b), (2 * i + 1)::BIGINT, 200) AS s FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS i FROM d)),
later AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM
  (SELECT doc_id, i, sum(apart) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM
    (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS apart FROM later)) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM runs),
kept AS (SELECT g.doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(substring(hex(b), (2 * since + 1)::BIGINT, (2 * (lo - since))::BIGINT), '' ORDER BY lo) || substring(any_value(hex(b)), (2 * max(hi) + 1)::BIGINT) AS h
  FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256 FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

PASSAGES = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM w JOIN f USING (s) WHERE doc_id > first),
l AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT l.doc_id, string_agg(word, ' ' ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS t, count(g.i) AS n_removed FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

#: Classes of documents whose five-word shingle sets have a Jaccard of 0.8 or more.
NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n o ON o.doc_id = y WHERE 5 * c >= 4 * (m.n + o.n - c)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, u.y FROM r JOIN u ON u.x = r.b)
SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a"""

#: Counts of every whole text, and the base rules.
BASE_COUNTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
t AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
r AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS w FROM t) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c"""

#: Host, path and the longest fitting rule of every url.
URL_RULES = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
f AS (SELECT page_id, rule, verdict FROM u, (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')) r(verdict, rule, name, head)
  WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, head) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT u.page_id, host, path, rule, verdict FROM u LEFT JOIN f ON f.page_id = u.page_id"""

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast('0' || right(x, 3) AS INT), 0) <= 255))"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j: CASE WHEN (length(d) - j) % 2 = 0 THEN d[j]::INT ELSE (2 * d[j]::INT) // 10 + (2 * d[j]::INT) % 10 END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15"),
)

#: Base spans of the four kinds, by place.
BASE_SPANS = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
    + ", ".join(
        f"m_{kind} AS (SELECT doc_id, {k} AS k, i, ms[i] AS m, regexp_replace(ms[i], '[^0-9]', '', 'g') AS d, (list_sum(list_transform(range(1, i + 1), lambda j: length(bs[j]))) + coalesce(list_sum(list_transform(range(1, i), lambda j: length(ms[j]))), 0))::BIGINT AS s "
        f"FROM (SELECT doc_id, ms, bs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_split_to_array(t, '{pattern}') AS bs FROM t))), "
        f"s_{kind} AS (SELECT doc_id, k, s, '{kind}:' || s || ':' || (s + length(m)) AS said FROM m_{kind} WHERE {test})"
        for k, (kind, pattern, test) in enumerate(PATTERNS)
    )
    + ", a AS ("
    + " UNION ALL ".join(f"SELECT * FROM s_{kind}" for kind, _, _ in PATTERNS)
    + ") SELECT t.doc_id, "
    + ", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, (kind, _, _) in enumerate(PATTERNS))
    + ", sha256(coalesce(string_agg(said, ',' ORDER BY k, s), '')) AS base_sha256 FROM t LEFT JOIN a ON a.doc_id = t.doc_id GROUP BY t.doc_id"
)

ORACLES: dict[str, str] = {
    "quality_base_counts": BASE_COUNTS,
    "url_rules": URL_RULES,
    "pii_base_spans": BASE_SPANS,
    "op4_suffix_array_dedup": BYTES,
    "op5_minhash_near_dedup": NEAR,
    "op9_substring_dedup": PASSAGES,
    "op1_line_dedup": LINE_DEDUP.replace("{documents}", "documents")
    + " SELECT doc_id, n_lines, n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM kept",
    "op7_compaction": "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
}
