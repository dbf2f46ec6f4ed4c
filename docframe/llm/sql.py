"""SQL counterparts for DuckDB."""

# Host reputation and rules over pages and labels, level by level.
URL_REPUTATION = r"""
WITH parsed AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1) AS raw,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
p AS (
  SELECT page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts),
named AS (
  SELECT *, string_split(host, '.') AS l FROM p),
lv AS (
  SELECT page_id, host, path, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three, l[-1] AS one FROM named),
lev AS (
  SELECT page_id, host, path,
    CASE WHEN two IN ('ac.uk','co.jp','co.nz','co.uk','com.au','com.br','gov.uk','org.uk') THEN two ELSE one END AS suffix,
    CASE WHEN two IN ('ac.uk','co.jp','co.nz','co.uk','com.au','com.br','gov.uk','org.uk') THEN three ELSE two END AS domain
  FROM lv),
hosts AS (
  SELECT host, suffix, domain, count(*)::DOUBLE AS n, sum(1 - quality)::DOUBLE AS bad
  FROM lev JOIN labels ON labels.doc_id = lev.page_id WHERE quality IS NOT NULL GROUP BY ALL),
overall AS (SELECT coalesce(sum(bad) / sum(n), 0.0) AS share FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(share) AS prior FROM hosts, overall GROUP BY suffix),
s1 AS (SELECT sum((bad - n * prior) ** 2 - n * prior * (1 - prior)) AS spread, sum(n * (n - 1) * prior * (1 - prior)) AS room FROM s0),
s2 AS (SELECT coalesce(greatest(1.0, least(1000.0, CASE WHEN room > 0 AND spread / room > 0 THEN 1 / (spread / room) - 1 ELSE 1000.0 END)), 1000.0) AS s FROM s1),
s AS (SELECT suffix, s * prior + bad AS a, s * (1 - prior) + n - bad AS b FROM s0, s2),
d0 AS (SELECT h.domain, sum(n) AS n, sum(bad) AS bad, any_value(a / (a + b)) AS prior FROM hosts h JOIN s USING (suffix) GROUP BY h.domain, h.suffix),
d1 AS (SELECT sum((bad - n * prior) ** 2 - n * prior * (1 - prior)) AS spread, sum(n * (n - 1) * prior * (1 - prior)) AS room FROM d0),
d2 AS (SELECT coalesce(greatest(1.0, least(1000.0, CASE WHEN room > 0 AND spread / room > 0 THEN 1 / (spread / room) - 1 ELSE 1000.0 END)), 1000.0) AS s FROM d1),
d AS (SELECT domain, s * prior + bad AS a, s * (1 - prior) + n - bad AS b FROM d0, d2),
h0 AS (SELECT h.host, n, bad, a / (a + b) AS prior FROM hosts h JOIN d USING (domain)),
h1 AS (SELECT sum((bad - n * prior) ** 2 - n * prior * (1 - prior)) AS spread, sum(n * (n - 1) * prior * (1 - prior)) AS room FROM h0),
h2 AS (SELECT coalesce(greatest(1.0, least(1000.0, CASE WHEN room > 0 AND spread / room > 0 THEN 1 / (spread / room) - 1 ELSE 1000.0 END)), 1000.0) AS s FROM h1),
h AS (SELECT host, s * prior + bad AS a, s * (1 - prior) + n - bad AS b FROM h0, h2),
k AS (
  SELECT page_id, lev.host, path, coalesce(h.a, d.a, s.a) AS a, coalesce(h.b, d.b, s.b) AS b, share
  FROM lev LEFT JOIN h ON h.host = lev.host LEFT JOIN d ON d.domain = lev.domain LEFT JOIN s ON s.suffix = lev.suffix, overall),
j AS (
  SELECT page_id, host, path, round(coalesce(a / (a + b), share), 9) AS bad_share,
    round(coalesce(a / (a + b), share) - coalesce(sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0.0), 9) AS bad_bound FROM k),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM j)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'example.org/en/1', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN bad_bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict, bad_share, bad_bound
FROM r
"""
