"""SQL equivalents of the registered queries, for DuckDB over the same tables."""

URLS = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (
  SELECT host, bad FROM (SELECT host, CAST(nullif(regexp_extract(path, '/([0-9]{1,18})(?:[^0-9]|$)', 1), '') AS BIGINT) AS doc_id FROM u) p
  JOIN (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id) l USING (doc_id)),
names AS (
  SELECT host, regexp_extract(host, '([^.]+\.[^.]*)$', 1) AS two, regexp_extract(host, '([^.]+\.[^.]+\.[^.]*)$', 1) AS three,
    regexp_extract(host, '([^.]*)$', 1) AS one, regexp_matches(host, '^[0-9.]*$|:') AS bare FROM (SELECT DISTINCT host FROM u)),
h AS (
  SELECT n.host, CASE WHEN bare THEN n.host WHEN two IN (%(wide)s) THEN CASE WHEN three = '' THEN n.host ELSE three END WHEN two = '' THEN n.host ELSE two END AS domain,
    CASE WHEN bare THEN '' WHEN two IN (%(wide)s) THEN two ELSE one END AS suffix, coalesce(c.n, 0) AS n, coalesce(c.y, 0) AS y
  FROM names n LEFT JOIN (SELECT host, count(*) AS n, sum(bad) AS y FROM o WHERE bad IS NOT NULL GROUP BY host) c ON n.host = c.host),
s0 AS (SELECT suffix, sum(n) AS n, sum(y) AS y, (SELECT coalesce(sum(n), 0) FROM h) AS pn, (SELECT coalesce(sum(y), 0) FROM h) AS py, 0.1e0 AS pm, 5e0 AS pk FROM h GROUP BY suffix),
s1 AS (SELECT *, (py - y + pk * pm) / (pn - n + pk) AS m FROM s0),
sk AS (SELECT 1 / greatest(0.001e0, least(0.9e0, coalesce((sum(n * pow(y * 1e0 / n - m, 2) / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0), 0.05e0))) - 1 AS lk FROM s1 WHERE n > 0),
s AS (SELECT suffix, n, y, m, least(lk, pn - n + pk) AS k FROM s1, sk),
d1 AS (SELECT g.domain, g.suffix, g.n, g.y, s.n AS pn, s.k AS pk, (s.y - g.y + s.k * s.m) / (s.n - g.n + s.k) AS m FROM (SELECT domain, suffix, sum(n) AS n, sum(y) AS y FROM h GROUP BY domain, suffix) g JOIN s USING (suffix)),
dk AS (SELECT 1 / greatest(0.001e0, least(0.9e0, coalesce((sum(n * pow(y * 1e0 / n - m, 2) / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0), 0.05e0))) - 1 AS lk FROM d1 WHERE n > 0),
d AS (SELECT domain, n, y, m, least(lk, pn - n + pk) AS k FROM d1, dk),
l1 AS (SELECT h.host, h.n, h.y, d.n AS pn, d.k AS pk, (d.y - h.y + d.k * d.m) / (d.n - h.n + d.k) AS m FROM h JOIN d USING (domain)),
lk AS (SELECT 1 / greatest(0.001e0, least(0.9e0, coalesce((sum(n * pow(y * 1e0 / n - m, 2) / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0), 0.05e0))) - 1 AS lk FROM l1 WHERE n > 0),
l AS (SELECT *, least(lk, pn - n + pk) AS k FROM l1, lk),
r AS (SELECT host, n, y, y + k * m AS a, n - y + k * (1 - m) AS b FROM l),
v AS (SELECT *, a / (a + b) - 1.645e0 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > 0.25e0 AS bad_host FROM r),
f AS (
  SELECT u.page_id, u.host, u.path, v.n, v.y, v.bad_host,
    CASE WHEN (u.host = 'example.net' OR ends_with(u.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (u.host = 'example.com' OR ends_with(u.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (u.host = 'org' OR ends_with(u.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (u.host = 'net' OR ends_with(u.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u JOIN v USING (host))
SELECT page_id, host, path, rule,
  CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'
    ELSE CASE WHEN bad_host THEN 'block' ELSE 'allow' END END AS verdict,
  CAST(n AS BIGINT) AS n_outcomes, CAST(y AS BIGINT) AS n_bad FROM f"""

EXACT = r"""
WITH n AS (
  SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS c, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER g AS keep_id, first_value(c) OVER g AS best, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n WINDOW g AS (PARTITION BY text_sha256 ORDER BY c DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND c = best AS kept, text_sha256 FROM r"""

SECRET_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def secrets(rules) -> str:
    """One branch for each rule: pieces between matches give the positions."""
    parts = []
    for order, (kind, pattern, least, group) in enumerate(rules):
        parts.append(rf"""
SELECT id, {order} AS ord, '{kind}' AS kind, gap_end AS s, gap_end + length(hit) AS e FROM (
  SELECT id, hit, measured, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER b, 0) AS gap_end FROM (
    SELECT id, unnest(hits) AS hit, unnest(measured) AS measured, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS n FROM (
      SELECT id, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS measured, regexp_split_to_array(text, '{pattern}') AS gaps FROM t))
  WINDOW w AS (PARTITION BY id ORDER BY n), b AS (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE length(measured) >= {least}""")
    return rf"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
g AS (
  SELECT id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans
  FROM m GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (id)"""


SHARDS = r"""
WITH d AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h,
    CAST(strlen(coalesce(text, '')) AS BIGINT) AS doc_bytes FROM documents),
p AS (SELECT *, unnest(range(0, 61)) AS depth FROM d),
q AS (SELECT *, h >> CAST(60 - depth AS BIGINT) AS prefix FROM p),
b AS (SELECT depth, prefix, CAST(sum(doc_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs, min(h) = max(h) AS one FROM q GROUP BY depth, prefix),
f AS (
  SELECT q.doc_id, q.doc_bytes, q.depth, q.h, b.shard_bytes, b.shard_docs, b.shard_bytes <= %(limit)d AS fits,
    row_number() OVER (PARTITION BY q.h, q.doc_id ORDER BY q.depth) AS turn
  FROM q JOIN b USING (depth, prefix) WHERE b.shard_bytes <= %(limit)d OR b.one OR q.depth = 60)
SELECT doc_id, substr(lpad(bin(h), 60, '0'), 1, CAST(depth AS INTEGER)) AS shard, CAST(depth AS INTEGER) AS shard_depth, doc_bytes, shard_bytes, shard_docs, fits
FROM f WHERE turn = 1"""

DECONTAMINATE = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, w[s:s + %(n)d - 1] AS gram FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - %(n)d + 1))) AS s FROM iw WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
lens AS (SELECT DISTINCT len(gram) AS k FROM g),
win AS (SELECT id, k, s, w[s:s + k - 1] AS gram FROM (SELECT id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, lens WHERE len(w) >= k)),
hit AS (SELECT id, s, k, item_id FROM win JOIN g USING (gram)),
c AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(generate_series(s, s + k - 1)) AS p FROM hit) GROUP BY id),
i AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (id) LEFT JOIN i USING (id)"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
z AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, [3e0, 1e0, 2e0][(r - 1) %% 3 + 1] AS weight, 2e0 * n AS cap FROM z),
l AS (
  SELECT *, (1.5e0 * sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, n, CASE WHEN cap / weight <= level THEN cap ELSE weight * (SELECT level FROM l WHERE cap / weight > level ORDER BY cap / weight, r LIMIT 1) END AS target FROM l),
p AS (
  SELECT d.*, t.n, t.target, CASE WHEN t.n > 0 THEN CAST(floor(t.target / t.n) AS BIGINT) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id NULLS LAST, size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * CAST(n AS BIGINT) - before)) AS BIGINT) AS taken FROM p""".replace("%%", "%")

SUBSTRINGS = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT id, s, md5(array_to_string(w[s:s + %(n)d - 1], ' ')) AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - %(n)d + 1)) AS s FROM d WHERE len(w) >= %(n)d)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT id, unnest(generate_series(s, s + %(n)d - 1)) AS p FROM win JOIN twice USING (g)),
word AS (SELECT id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT id, string_agg(t, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN gone USING (id, p) GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (id)"""

NEAR = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, b.y FROM reach r JOIN ways b ON b.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id, d.doc_id = c.low AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x) c USING (doc_id)"""


def pivot_clusters(k: int, rounds: int) -> str:
    """One pair of tables for each round: the assignment, then the centroids after it."""
    near = """
a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT v.r, c{i}.c, list_sum(list_transform(list_zip(v.e, c{i}.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i}) GROUP BY r)"""
    move = """
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n) ORDER BY p) AS e FROM (
  SELECT a.c, p, sum(x)::BIGINT AS s, count(*) AS n FROM a{i} a JOIN (SELECT r, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM v) USING (r) GROUP BY a.c, p) GROUP BY c),
c{j} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} USING (c))"""
    steps = ",".join(near.format(i=i) + ("," + move.format(i=i, j=i + 1) if i < rounds else "") for i in range(rounds + 1))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND abs(CAST(x AS DOUBLE)) < 524288)) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT e, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v ORDER BY h, e LIMIT {k})),{steps}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(z.e, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} z ON z.c = a.c"""


TRIE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
  xor(list_reduce([4294967295::BIGINT] || flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
b AS (
  SELECT n.conv_id, 0 AS half, t.pos, t.role, t.text FROM n JOIN t ON t.conv_id = n.base WHERE t.pos <= n.h
  UNION ALL SELECT n.conv_id, 1, t.pos, t.role, t.text FROM n JOIN t ON t.conv_id = n.conv_id WHERE t.pos > n.h),
c AS (SELECT n.conv_id, coalesce(list(md5(length(role) || ':' || role || text) ORDER BY half, pos) FILTER (b.pos IS NOT NULL), []) AS marks,
    coalesce(list(length(text) ORDER BY half, pos) FILTER (b.pos IS NOT NULL), []) AS chars FROM n LEFT JOIN b USING (conv_id) GROUP BY n.conv_id),
p AS (SELECT conv_id, d, array_to_string(marks[:d], ',') AS k, CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS chars, array_to_string(marks[:d - 1], ',') AS up, len(marks) = d AS ends
  FROM (SELECT *, unnest(generate_series(0, len(marks))) AS d FROM c)),
g AS (SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends) AS ends,
  bool_and(ends) AS leaf FROM p GROUP BY d, k),
a AS (SELECT DISTINCT p.d, p.k, q.d AS below_d, q.k AS below FROM p JOIN p q ON q.conv_id = p.conv_id AND q.d >= p.d),
s AS (SELECT a.d, a.k, sum(CAST(g.leaf AS BIGINT)) AS n_leaves, sum((g.n_convs - 1) * g.chars) AS saved FROM a JOIN g ON g.d = a.below_d AND g.k = a.below GROUP BY a.d, a.k)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, CASE WHEN g.d > 0 THEN u.conv_id END AS parent_conv_id, g.n_convs,
  (SELECT count(*) FROM g x WHERE x.d = g.d + 1 AND x.up = g.k) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(g.ends, '')) AS ends_sha256
FROM g JOIN s ON s.d = g.d AND s.k = g.k LEFT JOIN g u ON u.d = g.d - 1 AND u.k = g.up"""

HOST_RULES = r"""
WITH t AS (
  SELECT row_number() OVER () AS id, doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
r AS (SELECT id, s, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - 4)) AS s FROM t WHERE len(w) >= 5)),
k AS (SELECT id, s FROM r JOIN (SELECT id, g FROM r GROUP BY id, g HAVING count(*) > 1) USING (id, g)),
c AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(generate_series(s, s + 4)) AS p FROM k) GROUP BY id),
m AS (
  SELECT t.id, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    regexp_extract(host, '([^.]+\.[^.]*)$', 1) AS two, regexp_extract(host, '([^.]+\.[^.]+\.[^.]*)$', 1) AS three, regexp_matches(host, '^[0-9.]*$|:') AS bare
  FROM t LEFT JOIN c ON c.id = t.id),
f AS (
  SELECT *, CASE WHEN bare OR (CASE WHEN two IN (%(wide)s) THEN three ELSE two END) = '' THEN host WHEN two IN (%(wide)s) THEN three ELSE two END AS domain,
    n_words < 10 AS few, 100 * n_repeat_words > 20 * n_words AS again, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS lines,
    word_chars < 3 * n_words OR word_chars > 10 * n_words AS length FROM m),
l AS (SELECT domain, rule, CAST(bad AS BIGINT) AS bad FROM (UNPIVOT (SELECT domain, few, again, symbols, lines, length FROM f) ON few, again, symbols, lines, length INTO NAME rule VALUE bad)),
h AS (SELECT domain, rule, count(*) * 1e0 AS n, sum(bad) * 1e0 AS y FROM l GROUP BY domain, rule),
q AS (SELECT rule, sum(y) / sum(n) AS m FROM h GROUP BY rule HAVING sum(y) > 0 AND sum(y) < sum(n)),
o AS (SELECT rule, any_value(m) AS m, 1 / greatest(0.001e0, least(0.9e0, coalesce((sum(n * pow(y / n - m, 2) / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0), 0.05e0))) - 1 AS k FROM h JOIN q USING (rule) GROUP BY rule),
b AS (SELECT domain, m, y + k * m AS a, n - y + k * (1 - m) AS b FROM h JOIN o USING (rule)),
v AS (SELECT domain, bool_or(a / (a + b) - 1.645e0 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > greatest(0.1e0, 2e0 * m)) AS bad FROM b GROUP BY domain)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR again AS base_failed, NOT (few OR again) AND NOT coalesce(v.bad, false) AS kept,
  f.domain, coalesce(v.bad, false) AS host_failed FROM f LEFT JOIN v ON f.domain IS NOT DISTINCT FROM v.domain"""
