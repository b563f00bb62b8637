"""DuckDB SQL for the queries that SQL can express."""

CURRICULUM = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS z,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
levels AS (
  SELECT *,
    CAST(sum(z) OVER () - 3 * coalesce(sum(z) OVER before, 0) AS DOUBLE)
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level,
    row_number() OVER (ORDER BY CAST(3 * z AS DOUBLE) / weight, place) AS turn
  FROM weighed
  WINDOW before AS (ORDER BY CAST(3 * z AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (
  SELECT level AS water FROM levels WHERE NOT (level * weight > 3 * z) ORDER BY turn LIMIT 1),
targets AS (
  SELECT source, place, z, CASE WHEN level * weight > 3 * z THEN CAST(3 * z AS DOUBLE) ELSE (SELECT water FROM stop) * weight END AS target FROM levels),
starts AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM sized),
copied AS (
  SELECT doc_id, size, z, target, place, begun, CAST(floor(target) AS BIGINT) AS demand,
         CAST(CASE WHEN size > 0 AND floor(target) > begun THEN (CAST(floor(target) AS BIGINT) - begun - 1) // z + 1 ELSE 0 END AS BIGINT) AS copies
  FROM starts JOIN targets ON starts.source IS NOT DISTINCT FROM targets.source),
done AS (
  SELECT *, (copies - 1) * z + begun AS last, least(CAST(begun AS DOUBLE), target) / target AS y, CAST((copies - 1) * z + begun AS DOUBLE) / target AS y2 FROM copied),
-- a source's weight over training runs 1.5, 1, 0.5 or 0.75, 1.25, 0.75 or 0.5, 1, 1.5 in turn, straight between these at 0, 1/2 and 1;
-- the share of its demand that is met at position u is the integral up to u, which is inverted here on each half
schedules(turn, half, a, slope, before) AS (
  VALUES (0, 0, 1.5e0, -1e0, 0e0), (0, 1, 1e0, -1e0, 0.625e0), (1, 0, 0.75e0, 1e0, 0e0), (1, 1, 1.25e0, -1e0, 0.5e0), (2, 0, 0.5e0, 1e0, 0e0), (2, 1, 1e0, 1e0, 0.375e0))
SELECT doc_id, size, z AS source_size, target,
       CAST(CASE WHEN copies > 0 THEN (copies - 1) * size + least(size, demand - last) ELSE 0 END AS BIGINT) AS taken, copies,
       CASE WHEN copies > 0 OR size = 0 AND target > 0 THEN CASE WHEN y <= q.before THEN 0e0 + (sqrt(greatest(p.a * p.a + 2 * p.slope * (y - p.before), 0e0)) - p.a) / p.slope
         ELSE 0.5e0 + (sqrt(greatest(q.a * q.a + 2 * q.slope * (y - q.before), 0e0)) - q.a) / q.slope END END AS position,
       CASE WHEN copies > 0 THEN CASE WHEN y2 <= q.before THEN 0e0 + (sqrt(greatest(p.a * p.a + 2 * p.slope * (y2 - p.before), 0e0)) - p.a) / p.slope
         ELSE 0.5e0 + (sqrt(greatest(q.a * q.a + 2 * q.slope * (y2 - q.before), 0e0)) - q.a) / q.slope END END AS last_position
FROM done JOIN schedules p ON p.turn = place % 3 AND p.half = 0 JOIN schedules q ON q.turn = place % 3 AND q.half = 1
"""

URL_REPUTATION = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
whole AS (SELECT page_id, split_part(split_part(r, '?', 1), '#', 1) AS p FROM rest),
cut AS (
  SELECT page_id, translate(split_part(p, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(p, '/') > 0 THEN substr(p, strpos(p, '/')) ELSE '' END AS path
  FROM whole),
marks AS (
  SELECT doc_id AS ref, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
numbered AS (
  SELECT host, TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})([.]html)?/?$', 1), '') AS BIGINT) AS ref FROM cut),
counted AS (
  SELECT host, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS x FROM numbered LEFT JOIN marks USING (ref) GROUP BY host),
plain AS (SELECT *, split_part(host, '@', -1) AS bare FROM counted),
named AS (
  SELECT *, CASE WHEN starts_with(bare, '[') THEN split_part(bare, ']', 1) || ']' ELSE split_part(bare, ':', 1) END AS name FROM plain),
labelled AS (
  SELECT *, string_split(name, '.') AS labels, starts_with(bare, '[') OR regexp_full_match(name, '[0-9]+([.][0-9]+){3}') AS number,
         array_to_string(string_split(name, '.')[-2:], '.') IN ('ac.jp', 'ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx',
           'com.tr', 'com.tw', 'go.jp', 'gov.au', 'gov.uk', 'ne.jp', 'net.au', 'or.jp', 'org.au', 'org.uk') AS double FROM named),
hosts AS (
  SELECT host, n, x, CASE WHEN number THEN name WHEN double THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain,
         CASE WHEN number THEN name WHEN double THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS suffix FROM labelled),
domains AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS dn, CAST(sum(x) AS BIGINT) AS dx FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, CAST(sum(dn) AS BIGINT) AS sn, CAST(sum(dx) AS BIGINT) AS sx FROM domains GROUP BY suffix),
total AS (
  SELECT n_all, CASE WHEN n_all > 0 THEN CAST(x_all AS DOUBLE) / CAST(n_all AS DOUBLE) ELSE 0.0 END AS p
  FROM (SELECT coalesce(sum(sn), 0) AS n_all, coalesce(sum(sx), 0) AS x_all FROM suffixes)),
sums AS (
  SELECT 'suffix' AS level, sum(sx * sx) AS xx, sum(sx * sn) AS xn, sum(sn * sn) AS nn FROM suffixes
  UNION ALL SELECT 'domain', sum(dx * dx), sum(dx * dn), sum(dn * dn) FROM domains
  UNION ALL SELECT 'host', sum(x * x), sum(x * n), sum(n * n) FROM hosts),
rhos AS (
  SELECT level, CASE WHEN p > 0 AND p < 1 AND CAST(nn AS DOUBLE) > CAST(n_all AS DOUBLE)
    THEN ((CAST(xx AS DOUBLE) - 2 * p * CAST(xn AS DOUBLE) + p * p * CAST(nn AS DOUBLE)) / (p * (1 - p)) - CAST(n_all AS DOUBLE)) / (CAST(nn AS DOUBLE) - CAST(n_all AS DOUBLE))
    ELSE CAST(0.001 AS DOUBLE) END AS rho
  FROM sums, total),
strengths AS (SELECT level, 1 / least(greatest(rho, CAST(0.001 AS DOUBLE)), CAST(0.5 AS DOUBLE)) - 1 AS k FROM rhos),
k AS (
  SELECT max(k) FILTER (level = 'suffix') AS ks, max(k) FILTER (level = 'domain') AS kd, max(k) FILTER (level = 'host') AS kh FROM strengths),
shrunk AS (
  SELECT host, n, x, kh, (dx + kd * ((sx + ks * p) / (sn + ks))) / (dn + kd) AS m
  FROM hosts JOIN domains USING (domain, suffix) JOIN suffixes USING (suffix), total, k),
posterior AS (SELECT host, x + kh * m AS a, n - x + kh * (1 - m) AS b FROM shrunk),
judged AS (
  SELECT host, a / (a + b) - CAST(1.645 AS DOUBLE) * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > CAST(0.2 AS DOUBLE) AS blocked FROM posterior),
rules(rhost, rpath, rverdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
ruled AS (
  SELECT page_id, host, path,
    (SELECT max_by({'rule': rhost || rpath, 'verdict': rverdict}, len(rhost || rpath)) FROM rules
     WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS hit
  FROM cut)
SELECT page_id, ruled.host AS host, path, hit.rule AS rule,
       coalesce(hit.verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN judged USING (host)
"""

SUBSTRING_DEDUP = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM docs WHERE len(words) >= 20),
windows AS (
  SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS run FROM starts),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS turn FROM windows) WHERE turn > 1),
covered AS (
  SELECT DISTINCT doc_id, s + i AS p FROM later, range(0, 20) AS steps(i)),
each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM docs WHERE len(words) > 0),
kept AS (
  SELECT each.doc_id AS doc_id, count(covered.p) AS n_removed, string_agg(word, ' ' ORDER BY each.p) FILTER (covered.p IS NULL) AS text
  FROM each LEFT JOIN covered ON each.doc_id = covered.doc_id AND each.p = covered.p GROUP BY each.doc_id)
SELECT docs.doc_id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON docs.doc_id = kept.doc_id
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS n FROM documents),
sets AS (
  SELECT doc_id, n, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS tokens FROM lines),
classes AS (
  SELECT tokens, len(tokens) AS size, min(struct_pack(d := doc_id, l := n)) AS first, row_number() OVER (ORDER BY min(struct_pack(d := doc_id, l := n))) AS c
  FROM sets WHERE len(tokens) > 0 GROUP BY tokens),
each AS (SELECT c, size, unnest(tokens) AS token FROM classes),
counts AS (SELECT token, count(*) AS f FROM each GROUP BY token),
prefixes AS (
  SELECT c, size, token FROM (
    SELECT c, size, token, row_number() OVER (PARTITION BY c ORDER BY f, token) AS place FROM each JOIN counts USING (token))
  WHERE place <= size - CAST(ceil(size * 4 / 5) AS BIGINT) + 1),
pairs AS (
  SELECT DISTINCT x.c AS a, y.c AS b FROM prefixes x JOIN prefixes y ON x.token = y.token AND x.c < y.c AND 5 * x.size >= 4 * y.size AND 5 * y.size >= 4 * x.size),
matched AS (
  SELECT DISTINCT y.c AS c FROM pairs JOIN classes x ON x.c = a JOIN classes y ON y.c = b
  WHERE 9 * len(list_intersect(x.tokens, y.tokens)) >= 4 * (x.size + y.size)),
gone AS (
  SELECT doc_id, n FROM sets JOIN classes USING (tokens)
  WHERE struct_pack(d := doc_id, l := n) <> first OR c IN (SELECT c FROM matched))
SELECT lines.doc_id AS doc_id, count(*) AS n_lines, count(gone.n) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY lines.n) FILTER (gone.n IS NULL), '') AS text
FROM lines LEFT JOIN gone ON lines.doc_id = gone.doc_id AND lines.n = gone.n GROUP BY lines.doc_id
"""
