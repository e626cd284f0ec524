"""DuckDB SQL that the queries over texts must agree with, where SQL can say it."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

NGRAM_COMPONENTS = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g
  FROM w
),
g AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT s.doc_id, len(s.g) AS n_shingles, min(reach.b) AS component_id
FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, len(s.g)
"""

REPEATED_LINES = f"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
),
k AS (SELECT doc_id, pos, line, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
m AS (SELECT k.doc_id, pos, line, r.key IS NOT NULL AND r.last <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_WORDS = "regexp_extract_all(" + _LOWER + ", '[a-z0-9\\x{80}-\\x{10FFFF}]+')"

CONTAMINATION = f"""
WITH i AS (SELECT DISTINCT item_id, {_WORDS} AS ws FROM benchmark),
wi AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size,
    unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda p: array_to_string(ws[p : p + least(len(ws), 10) - 1], ' '))) AS win
  FROM i WHERE len(ws) > 0
),
sizes AS (SELECT DISTINCT size FROM wi),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
wd AS (
  SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS p,
    unnest(list_transform(range(1, len(ws) - size + 2), lambda q: array_to_string(ws[q : q + size - 1], ' '))) AS win
  FROM d, sizes WHERE len(ws) >= size
),
h AS (SELECT wd.doc_id, wd.p, wd.size, wi.item_id FROM wd JOIN wi ON wd.win = wi.win AND wd.size = wi.size),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM h) GROUP BY 1),
it AS (
  SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM h) GROUP BY 1
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(it.names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

FILL_IN_MIDDLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
),
d AS (
  SELECT doc_id, text, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS r,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS bare
  FROM t
),
c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN bare OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d
),
p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf
  FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

NEAREST_VECTORS = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d)
SELECT * FROM r WHERE rank <= 10
"""

URL_VERDICTS = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
o AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS good
  FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id
),
h AS (
  SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good,
    array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix
  FROM p LEFT JOIN o ON p.page_id = o.doc_id GROUP BY host
),
root AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS rate FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT rate FROM root) AS p FROM h GROUP BY suffix),
sm AS (
  SELECT CASE WHEN v > 0 THEN least(greatest(c / v - 1, 2), 1000) ELSE 1000 END AS m
  FROM (SELECT sum(n * p * (1 - p)) AS c, sum((good - n * p) ^ 2 / n - p * (1 - p)) AS v FROM s WHERE n > 0)
),
sr AS (SELECT suffix, (good + m * p) / (n + m) AS rate FROM s, sm),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, any_value(rate) AS p FROM h JOIN sr USING (suffix) GROUP BY domain, suffix),
dm AS (
  SELECT CASE WHEN v > 0 THEN least(greatest(c / v - 1, 2), 1000) ELSE 1000 END AS m
  FROM (SELECT sum(n * p * (1 - p)) AS c, sum((good - n * p) ^ 2 / n - p * (1 - p)) AS v FROM d WHERE n > 0)
),
dr AS (SELECT domain, (good + m * p) / (n + m) AS rate FROM d, dm),
hh AS (SELECT host, n, good, rate AS p FROM h JOIN dr USING (domain)),
hm AS (
  SELECT CASE WHEN v > 0 THEN least(greatest(c / v - 1, 2), 1000) ELSE 1000 END AS m
  FROM (SELECT sum(n * p * (1 - p)) AS c, sum((good - n * p) ^ 2 / n - p * (1 - p)) AS v FROM hh WHERE n > 0)
),
hr AS (SELECT host, (good + m * p) / (n + m) AS rate, n + m AS weight FROM hh, hm),
v AS (SELECT host, CASE WHEN rate + 2 * sqrt(rate * (1 - rate) / (weight + 1)) < 0.6 THEN 'block' ELSE 'allow' END AS by_host FROM hr),
r AS (
  SELECT p.*, CASE
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p
)
SELECT page_id, r.host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE by_host END AS verdict
FROM r JOIN v ON r.host = v.host
"""


def license_sql(templates, classes, containment) -> str:
    """Exact containment of the templates' shingles in every window, without MinHash."""
    words = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
    grams = "list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])"
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates)
    case = " ".join(f"WHEN len(g) <= {c} THEN {c}" for c in classes)
    return f"""
    WITH t AS (SELECT license, list_distinct({grams}) AS g FROM (SELECT license, {words.format('notice')} AS ws FROM (VALUES {rows}) AS x(license, notice))),
    tg AS (SELECT license, len(g) AS size, CASE {case} END AS class, unnest(g) AS gram FROM t),
    d AS (SELECT doc_id, {words.format('text')} AS ws FROM documents),
    dg AS (SELECT doc_id, unnest(range(0, len(ws) - 2)) AS pos, unnest({grams}) AS gram FROM d WHERE len(ws) >= 3),
    hit AS (SELECT doc_id, license, size, class, tg.gram, pos // class AS w FROM dg JOIN tg ON dg.gram = tg.gram),
    win AS (SELECT * FROM hit UNION ALL SELECT doc_id, license, size, class, gram, w - 1 FROM hit WHERE w > 0),
    found AS (
      SELECT doc_id, license, max(share) AS share
      FROM (SELECT doc_id, license, w, count(DISTINCT gram) / any_value(size) AS share FROM win GROUP BY ALL)
      WHERE share >= {containment} GROUP BY ALL
    ),
    per AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names, max(share) AS share FROM found GROUP BY 1)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses, coalesce(share, 0.0)::DOUBLE AS containment
    FROM documents AS d LEFT JOIN per ON d.doc_id = per.doc_id
    """
