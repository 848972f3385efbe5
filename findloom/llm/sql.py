"""DuckDB SQL for the corpus queries that SQL can express, written apart from their Spark plans."""

from __future__ import annotations

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_filter_sql(alphabet: str, order: int = 5) -> str:
    """Rules and models of addresses: contexts as numbers in base 64, probabilities level by level."""
    quoted = alphabet.replace("'", "''")
    contexts = "".join(f", {' + '.join([f'codes[i + {order} + 1 - {b}] * {64 ** (b - 1)}' for b in range(1, k + 1)]) or '0'} AS c{k}" for k in range(order + 1))
    levels = ""
    for k in range(order + 1):
        keep = "" if k == 0 else "HAVING sum(a + b) >= greatest(3, 0.0001::DOUBLE * (SELECT count(*) FROM trained))"
        levels += f"""
n{k} AS (SELECT c{k} AS c, s, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM trained GROUP BY ALL),
k{k} AS (SELECT c, sum(a) AS sa, sum(b) AS sb, count(*) FILTER (a > 0) AS ka, count(*) FILTER (b > 0) AS kb FROM n{k} GROUP BY c {keep}),"""
        if k == 0:
            levels += """
p0 AS (SELECT 0 AS c, g.s, (coalesce(a, 0) + 1) / (sa + 61)::DOUBLE AS p, (coalesce(b, 0) + 1) / (sb + 61)::DOUBLE AS q FROM k0, symbols g LEFT JOIN n0 ON n0.s = g.s),"""
        else:
            levels += f"""
p{k} AS (SELECT k.c, l.s, CASE WHEN sa = 0 THEN l.p ELSE (coalesce(a, 0) + ka * l.p) / (sa + ka)::DOUBLE END AS p, CASE WHEN sb = 0 THEN l.q ELSE (coalesce(b, 0) + kb * l.q) / (sb + kb)::DOUBLE END AS q
  FROM k{k} k JOIN p{k - 1} l ON l.c = k.c % {64 ** (k - 1)} LEFT JOIN n{k} n ON n.c = k.c AND n.s = l.s),"""
    joins = " ".join(f"LEFT JOIN p{k} ON p{k}.c = x.c{k} AND p{k}.s = x.s" for k in range(order + 1))
    ratio = lambda k: f"floor((log2(p{k}.p) - log2(p{k}.q)) * 65536 + 0.5)"
    pads = ", ".join("0" for _ in range(order))
    return f"""
WITH cut AS (SELECT page_id, coalesce(url, '') AS u, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/]*'), '{_UPPER}', '{_LOWER}') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM cut),
judged AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM hosts),
ruled AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled FROM judged),
texts AS (SELECT DISTINCT u, ruled, substr(md5(u), 1, 1) < '4' AS held, list_filter(string_split(translate(u, '{_UPPER}', '{_LOWER}'), ''), lambda c: c <> '') AS chars FROM ruled),
coded AS (SELECT u, ruled, held, len(chars) AS size, [{pads}]::BIGINT[] || list_transform(chars, lambda c: CASE WHEN instr('{quoted}', c) > 0 THEN instr('{quoted}', c) ELSE 60 END) || [61]::BIGINT[] AS codes FROM texts),
x AS (SELECT u, ruled, held, codes[i + {order} + 1] AS s{contexts} FROM (SELECT *, unnest(range(0, size + 1)) AS i FROM coded)),
trained AS (SELECT * FROM x WHERE ruled IS NOT NULL AND NOT held),
symbols AS (SELECT unnest(range(1, 62)) AS s),{levels}
means AS (SELECT x.u, x.ruled, x.held, CAST(floor(sum(coalesce({", ".join(ratio(k) for k in range(order, -1, -1))}))::DOUBLE / (count(*) * 256)) AS BIGINT) AS mean FROM x {joins} GROUP BY ALL),
bins AS (SELECT mean, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM means WHERE ruled IS NOT NULL AND held GROUP BY mean),
errors AS (SELECT coalesce(lag(mean) OVER (ORDER BY mean) + (mean - lag(mean) OVER (ORDER BY mean) + 1) // 2, mean) AS mean, coalesce((SELECT sum(a) FROM bins y WHERE y.mean < z.mean), 0) * (SELECT sum(b) FROM bins) + (SELECT sum(b) FROM bins y WHERE y.mean >= z.mean) * (SELECT sum(a) FROM bins) AS e FROM bins z),
cutoff AS (SELECT CASE WHEN (SELECT sum(a) FROM bins) > 0 AND (SELECT sum(b) FROM bins) > 0 THEN (SELECT mean FROM errors ORDER BY e, abs(mean), mean LIMIT 1) ELSE 0 END AS t)
SELECT page_id, host, path, rule, coalesce(r.ruled, CASE WHEN m.mean >= t THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN r.ruled IS NULL THEN m.mean END AS mean
FROM ruled r JOIN means m ON m.u = r.u, cutoff
"""


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
word AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{_UPPER}', '{_LOWER}') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY ALL HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT lang, source, term, count(w.term) AS n FROM groups JOIN kept USING (lang) LEFT JOIN (SELECT lang, source, term FROM word) w USING (lang, source, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM cell GROUP BY ALL),
p AS (SELECT lang, source, term, c.n, 1 + 1000000000 * (c.n + 5)::HUGEINT // (t.total + 5 * v)::HUGEINT AS p, 1 + 1000000000 * (k.n + 5)::HUGEINT // (l.total + 5 * v)::HUGEINT AS q
  FROM cell c JOIN totals t USING (lang, source) JOIN langs l USING (lang) JOIN kept k USING (lang, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
ranking AS (
  SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM ranking)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry, in each round."""
    apart = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    steps = ""
    for k in range(rounds + 1):
        steps += f"""
a{k} AS (SELECT r, p, any_value(x) AS x, min({apart} * {entries} + j) AS best FROM part JOIN c{k} USING (p) GROUP BY r, p),"""
        if k < rounds:
            steps += f"""
u{k} AS (SELECT p, best % {entries} AS j, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL),
v{k} AS (SELECT p, j, list(m ORDER BY i) AS c FROM u{k} GROUP BY ALL),
c{k + 1} AS (SELECT p, j, coalesce(v{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN v{k} USING (p, j)),"""
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM (SELECT *, unnest(range(0, {parts})) AS p FROM kept)),
c0 AS (SELECT p, r - 1 AS j, x AS c FROM part WHERE r <= {entries}),{steps}
books AS (SELECT sha256(string_agg(n::VARCHAR, ',' ORDER BY p, j, i)) AS codebooks_sha256 FROM (SELECT p, j, unnest(c) AS n, unnest(range(0, len(c))) AS i FROM c{rounds})),
coded AS (SELECT r, string_agg(lpad(lower(to_hex(best % {entries})), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), books
"""
