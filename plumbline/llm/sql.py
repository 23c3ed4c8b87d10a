"""DuckDB SQL for the results of the queries that SQL can express."""

OP3 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), l AS (
  SELECT *, row_number() OVER o AS nth,
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY source_size / weight, weight, source NULLS LAST)
), f AS (SELECT arg_min(level, nth) AS level FROM l WHERE level * weight <= 3 * source_size),
p AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), f.level * weight) AS target FROM l, f
), r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

NUMBER = "CAST(('0x' || substr(md5('{tag}:' || {text}), 1, 8))::BIGINT % {n} AS INTEGER)"

OP9 = rf"""
WITH c AS (
  SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[]+)', 1)), '.'), '') AS host,
    {NUMBER.format(tag="day", text="CAST(page_id AS VARCHAR)", n=730)} AS day
  FROM pages
), h AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM c WHERE host IS NOT NULL),
x AS (SELECT host, p, unnest(range(1, CASE WHEN regexp_matches(host, '^(\[.*\]|\d+\.\d+\.\d+\.\d+)$') THEN 2 ELSE greatest(len(p) - 1, 1) + 1 END)) AS i FROM h),
s AS (SELECT host, array_to_string(p[i:], '.') AS domain FROM x),
n AS (SELECT DISTINCT domain FROM s),
l AS (
  SELECT domain, {NUMBER.format(tag="add", text="domain", n=730)} AS a, {NUMBER.format(tag="off", text="domain", n=200)} + 1 AS g, {NUMBER.format(tag="back", text="domain", n=200)} + 1 AS b
  FROM n WHERE {NUMBER.format(tag="list", text="domain", n=3)} = 0
), e AS (
  SELECT domain, a AS day, TRUE AS listed FROM l UNION ALL SELECT domain, a + g, FALSE FROM l UNION ALL SELECT domain, a + g + b, b % 2 = 0 FROM l
), v AS (
  SELECT domain, day AS since, lead(day) OVER (PARTITION BY domain ORDER BY day) AS until, listed FROM e
), m AS (
  SELECT c.host, c.day, v.domain, v.since, row_number() OVER (PARTITION BY c.host, c.day ORDER BY length(v.domain) DESC, v.domain DESC, v.since DESC) AS r
  FROM (SELECT DISTINCT host, day FROM c) c JOIN s ON s.host = c.host JOIN v ON v.domain = s.domain AND v.listed AND v.since <= c.day AND (v.until IS NULL OR c.day < v.until)
)
SELECT c.page_id, c.host, c.day, m.domain IS NOT NULL AS listed, m.domain, m.since
FROM c LEFT JOIN m ON m.host = c.host AND m.day = c.day AND m.r = 1
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY lang),
gs AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
ls AS (SELECT lang, sum(total) AS total FROM gs GROUP BY ALL),
p AS (
  SELECT gs.lang, gs.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2) // (gs.total + 2 * v.v) AS HUGEINT) AS p
  FROM gs JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gs.lang AND c.source = gs.source AND c.term = k.term
), q AS (
  SELECT c.lang, c.term, CAST(1 + 1000000000 * (sum(n) + 2) // (any_value(ls.total) + 2 * any_value(v.v)) AS HUGEINT) AS q FROM c JOIN ls USING (lang) JOIN v USING (lang) GROUP BY c.lang, c.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), o AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), x AS (
  SELECT p.lang, p.source, p.term AS item, CAST((p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER w AS INTEGER) AS rank FROM o WINDOW w AS (PARTITION BY lang, source ORDER BY value DESC, item)
UNION ALL
SELECT lang, source, 'term', item, value, CAST(row_number() OVER w AS INTEGER) FROM x WINDOW w AS (PARTITION BY lang, source ORDER BY value DESC, item) QUALIFY row_number() OVER w <= 10
"""

OP11 = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id AS other, a.label = e.label AS same, CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score
  FROM e a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) QUALIFY row_number() OVER w <= 5
"""

ORACLE = {"op3_mixing": OP3, "op9_url_filter": OP9, "op11_hard_negatives": OP11, "op13_divergence": OP13}
