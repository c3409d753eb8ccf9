"""DuckDB SQL for the queries that it can express."""

from textloom.llm import line_dedup

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH p AS (SELECT page_id, coalesce({LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
g AS (SELECT doc_id AS page_id, min((quality = 1)::INTEGER) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(*) AS n, sum(good)::DOUBLE AS k FROM p JOIN g USING (page_id) GROUP BY host),
hs AS (SELECT *, string_split(host, '.') AS s FROM h), hd AS (SELECT host, n, k, array_to_string(s[greatest(len(s) - 1, 1):], '.') AS domain, s[len(s)] AS suffix FROM hs),
base AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 0.5::DOUBLE) / (sum(n) + 1) ELSE 0.5::DOUBLE END AS b FROM hd),
s0 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(k) AS k, any_value(b) AS prior FROM hd, base GROUP BY suffix),
sc AS (SELECT {{rho}} AS rho FROM s0), s1 AS (SELECT suffix, (k + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) AS mean FROM s0, sc),
d0 AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(k) AS k, any_value(mean) AS prior FROM hd JOIN s1 USING (suffix) GROUP BY domain, suffix),
dc AS (SELECT {{rho}} AS rho FROM d0), d1 AS (SELECT domain, (k + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) AS mean FROM d0, dc),
h0 AS (SELECT host, n::DOUBLE AS n, k, mean AS prior FROM hd JOIN d1 USING (domain)),
hc AS (SELECT {{rho}} AS rho FROM h0), h1 AS (SELECT host, n, (1 - rho) / rho AS c, (k + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) AS mean FROM h0, hc),
rep AS (SELECT host, mean + 1.645::DOUBLE * sqrt(mean * (1 - mean) / (n + c + 1)) AS upper FROM h1),
r(action, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT DISTINCT page_id, host, path, first_value(rh || rp) OVER w AS rule, first_value(action) OVER w AS action FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) WINDOW w AS (PARTITION BY page_id ORDER BY length(rh || rp) DESC))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(upper, 6) AS reputation FROM (
SELECT p.page_id, p.host, p.path, m.rule, m.action, coalesce(rep.upper, CASE WHEN p.host <> '' THEN coalesce(d1.mean + 1.645::DOUBLE * sqrt(d1.mean * (1 - d1.mean) * hc.rho), s1.mean + 1.645::DOUBLE * sqrt(s1.mean * (1 - s1.mean) * (1 - (1 - hc.rho) * (1 - dc.rho))), b + 1.645::DOUBLE * sqrt(b * (1 - b) * (1 - (1 - hc.rho) * (1 - dc.rho) * (1 - sc.rho)))) END) AS upper
FROM (SELECT *, string_split(host, '.') AS s FROM p) p CROSS JOIN base CROSS JOIN hc CROSS JOIN dc CROSS JOIN sc LEFT JOIN m ON m.page_id = p.page_id LEFT JOIN rep ON rep.host = p.host LEFT JOIN d1 ON d1.domain = array_to_string(p.s[greatest(len(p.s) - 1, 1):], '.') LEFT JOIN s1 ON s1.suffix = p.s[len(p.s)])
""".replace("{rho}", "CASE WHEN coalesce(sum(n * (n - 1) * prior * (1 - prior)), 0) = 0 THEN 1.0::DOUBLE / 3 ELSE least(0.5, greatest(0.0001, (sum((k - n * prior) ** 2) - sum(n * prior * (1 - prior))) / sum(n * (n - 1) * prior * (1 - prior)))) END")

OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT node, y FROM r JOIN both_ ON seen = x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS m FROM r GROUP BY node) USING (doc_id)
"""

OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
"""

OP11 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p), t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM w, range(1, 4) r(n)),
f AS MATERIALIZED (SELECT lang, g, n, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10), c AS MATERIALIZED (SELECT lang, g, n, f AS a, string_split(g, ' ') AS w FROM f WHERE n > 1),
u AS (SELECT lang, g, n, a, w, unnest(range(1, n)) AS k FROM c), v AS MATERIALIZED (SELECT lang, g, n, a, k, array_to_string(w[:k], ' ') AS gl, array_to_string(w[k + 1:], ' ') AS gr FROM u),
x AS (SELECT v.lang, v.g, v.n, a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score FROM v JOIN f l ON l.lang = v.lang AND l.g = gl JOIN f r ON r.lang = v.lang AND r.g = gr),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM x) WHERE o = 1),
i AS (SELECT lang, a, unnest([array_to_string(w[:n - 1], ' '), array_to_string(w[2:], ' ')]) AS g FROM c WHERE n > 2), m AS (SELECT lang, g, max(a) AS longer FROM i GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN m USING (lang, g) WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT lang, rank, g AS phrase, a, l, r, t.n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g)::INTEGER AS rank FROM z) z JOIN t USING (lang) WHERE rank <= 2000
"""



def _op13(rounds: int = 3) -> str:
    parts = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT * FROM (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INTEGER AS c, v FROM v) WHERE c < 16)"""]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT i, c, (list_inner_product(v.v, v.v) + list_inner_product(m.v, m.v) - 2 * list_inner_product(v.v, m.v))::BIGINT AS d FROM v CROSS JOIN c{r} m), a{r} AS MATERIALIZED (SELECT i, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{r} GROUP BY i)")
        if r < rounds:
            parts.append(f"""u{r} AS (SELECT c, unnest(range(64)) AS j, unnest(v)::HUGEINT AS x FROM a{r} JOIN v USING (i)), s{r} AS (SELECT c, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM u{r} GROUP BY ALL),
n{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY j) AS v FROM s{r} GROUP BY c), c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN n{r} n USING (c))""")
    return f"""WITH {", ".join(parts)}, t AS (SELECT c, sum(d)::BIGINT AS s FROM a{rounds} GROUP BY c)
SELECT vec_id, c AS cluster, d AS distance, s AS cluster_inertia, (SELECT sum(s)::BIGINT FROM t) AS inertia, sha256(array_to_string(list_transform(m.v, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (i) JOIN t USING (c) JOIN c{rounds} m USING (c)"""


SQL = {"op1_line_dedup": line_dedup.SQL, "op3_url_filter": OP3, "op8_ngram_join": OP8, "op9_top_k": OP9, "op11_collocations": OP11, "op13_centroids": _op13()}
