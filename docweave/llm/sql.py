"""DuckDB twins of the operators that SQL can express."""

#: Marks matches as the operator does: pieces at even places (from 1) of the split text are the matches.
_KINDS = {
    "assign": """((?i:password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{16,}",
    "id": """(?i:access_?key_?id|client_?id|account_?id|user_?name)["']?\\x20*[:=]\\x20*["']?[A-Za-z0-9_.@-]{4,}|(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}""",
    "key": "[A-Za-z0-9+/_-]{20,}={0,2}",
    "endpoint": "(?:https?|postgres|mysql|redis|amqp|mongodb|s3)://[A-Za-z0-9._:@-]+",
}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CUTS = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, {i} AS number, string_split(regexp_replace(t, {_quoted(p)}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM d"
    for i, (k, p) in enumerate(_KINDS.items())
)

OP2 = rf"""
WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
c AS ({_CUTS}),
e AS (SELECT doc_id, kind, number, p, unnest(range(1, len(p) + 1)) AS i FROM c WHERE len(p) > 1),
f AS (
  SELECT doc_id, kind, number, i, p[i] AS match, length(p[i]) AS n, i > 1 AND right(p[i - 1], 1) = '.' AS glued,
    sum(length(p[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
  FROM e
),
s AS (
  SELECT doc_id, kind, number, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM f
  WHERE i % 2 = 0 AND CASE kind
    WHEN 'assign' THEN length(regexp_extract(match, {_quoted(_KINDS["assign"])}, 2)) >= 12
    WHEN 'access' THEN length(match) >= 18
    WHEN 'key' THEN regexp_matches(match, '[0-9]') AND regexp_matches(match, '[a-z]') AND regexp_matches(match, '[A-Z]') AND NOT glued
    ELSE true END
),
weak AS (
  SELECT * FROM s w WHERE w.number >= 3 AND NOT EXISTS (
    SELECT 1 FROM s b WHERE b.doc_id = w.doc_id AND b.start < w.stop AND b.stop > w.start
      AND (b.number < 3 OR w.kind <> 'endpoint' AND b.kind = 'endpoint' OR w.kind = 'key' AND b.kind = 'id'))
),
part AS (SELECT * FROM s WHERE number < 3 UNION ALL SELECT * FROM weak),
near AS (
  SELECT w.doc_id, w.kind, w.number, w.start, w.stop FROM weak w WHERE true
    AND (w.kind = 'key' OR EXISTS (SELECT 1 FROM part b WHERE b.doc_id = w.doc_id AND b.kind IN ('assign', 'hex', 'key') AND b.start - w.stop <= 200 AND w.start - b.stop <= 200))
    AND (w.kind <> 'key' OR EXISTS (SELECT 1 FROM part b WHERE b.doc_id = w.doc_id AND b.kind IN ('access', 'id', 'endpoint') AND b.start - w.stop <= 200 AND w.start - b.stop <= 200))
    AND (w.kind <> 'endpoint' OR EXISTS (SELECT 1 FROM part b WHERE b.doc_id = w.doc_id AND b.kind IN ('access', 'id') AND b.start - w.stop <= 200 AND w.start - b.stop <= 200))
),
a AS (SELECT * FROM s WHERE number < 3 UNION ALL SELECT * FROM near),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(CASE WHEN number < 3 THEN concat_ws(':', kind, start, stop) END, ',' ORDER BY start, number) AS base,
    string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, number) AS spans
  FROM a GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""

OP4 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (((('0x' || substr(hex, 1 + (5 * i) // 4, 2))::BIGINT >> (8 - (5 * i) % 4 - 5)) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""

OP5 = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
), m AS (
  SELECT *, length(line) AS n FROM l WHERE trim(line, ' ') <> ''
), u AS (
  SELECT line, n, min({'d': doc_id, 'i': line_no}) AS first FROM m GROUP BY line, n
), k AS (
  SELECT first, line, n, unnest(list_distinct([
    '0:' || (n - 1) // 2 || ':' || left(line, (n - 1) // 2), '0:' || n // 2 || ':' || left(line, n // 2),
    '1:' || n - (n - 1) // 2 - 1 || ':' || right(line, n - (n - 1) // 2 - 1), '1:' || n - (n - 1) // 2 || ':' || right(line, n - (n - 1) // 2),
    '1:' || n - n // 2 || ':' || right(line, n - n // 2)])) AS key
  FROM u WHERE n >= 20
), near AS (
  SELECT a.line, min(b.first) AS near
  FROM k a JOIN k b ON a.key = b.key AND b.first < a.first AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) <= 1
  GROUP BY a.line
), e AS (
  SELECT m.doc_id, m.line_no, u.first, CASE WHEN near < u.first THEN near ELSE u.first END AS keep
  FROM m JOIN u USING (line) LEFT JOIN near USING (line)
)
SELECT doc_id, line_no::BIGINT AS line_no, keep.d AS first_doc_id, keep.i::BIGINT AS first_line_no,
  CASE WHEN keep = first THEN 0 ELSE 1 END AS distance
FROM e WHERE keep < {'d': doc_id, 'i': line_no}
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), k AS (
  SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""

OP10 = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 9))::BIGINT AS hash
  FROM documents
), sizes AS (
  SELECT key, max(source) AS source, sum(size)::DOUBLE AS source_size FROM rows GROUP BY key
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
    source_size * 2 AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM sizes
), s AS (
  SELECT *,
    (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), f AS (
  SELECT min(cap / weight) AS stop FROM s WHERE level <= cap / weight
), c AS (
  SELECT max(level) AS common FROM s, f WHERE cap / weight = stop AND level <= cap / weight
), t AS (
  SELECT key, source_size, coalesce(least(common * weight, cap), cap) AS target FROM s, c
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t
), cells AS (
  SELECT key, hash, sum(size) AS words FROM rows GROUP BY key, hash
), upto AS (
  SELECT key, hash, sum(words) OVER (PARTITION BY key ORDER BY hash) AS upto FROM cells
)
SELECT r.doc_id, r.size, u.source_size::BIGINT AS source_size, u.target,
  (r.size * (u.copies + CASE WHEN p.upto <= u.target - u.copies * u.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows r JOIN u USING (key) JOIN upto p ON p.key = r.key AND p.hash = r.hash
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS p FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(p[i : i + 2], ' ') AS shingle
  FROM (SELECT doc_id, p, unnest(range(1, CASE WHEN len(p) = 0 THEN 1 ELSE greatest(len(p) - 1, 2) END)) AS i FROM w)
), z AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM met JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * k >= 90 * (zx.n + zy.n - k)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y
)
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN z USING (doc_id)
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', doc_id)) AS h FROM documents),
l AS (SELECT doc_id, t, h, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[^\n]*\n|[^\n]+') END AS p FROM d),
c AS (
  SELECT doc_id, t, p, len(p) AS n, ('0x' || h[1:8])::BIGINT % (len(p) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(p) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l
),
q AS (
  SELECT doc_id, t, n, form, array_to_string(p[1:least(x, y)], '') AS prefix, array_to_string(p[least(x, y) + 1:greatest(x, y)], '') AS middle,
    array_to_string(p[greatest(x, y) + 1:], '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM q
"""

OP13 = r"""
WITH g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT part, doc_id, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (min(doc_id) OVER (PARTITION BY t) < doc_id)::INT AS mask FROM w
),
k AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS bad FROM m LEFT JOIN g USING (doc_id) GROUP BY part, mask
),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, (1 << (ascii(substr(filter_order, step, 1)) - 65)) AS own,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i::INT, 1)) - 65))), 0)::INT AS before
  FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o)
),
r AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN mask & own = 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM k, s GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
