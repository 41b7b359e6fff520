"""SQL that gives the same rows where SQL can express the operator on whole tables."""

_PAIRS = """
WITH h AS (SELECT DISTINCT entry_id, rule_id FROM rule_hits WHERE rule_id IS NOT NULL AND entry_id IS NOT NULL),
n AS (SELECT count(DISTINCT entry_id) AS n FROM h),
m AS (SELECT rule_id, count(*) AS c FROM h GROUP BY rule_id),
p AS (SELECT a.rule_id AS rule_id_a, b.rule_id AS rule_id_b, count(*) AS n_ab
      FROM h a JOIN h b ON a.entry_id = b.entry_id AND a.rule_id < b.rule_id GROUP BY 1, 2)
"""

ORACLES: dict[str, str] = {
    "p3_found": _PAIRS
    + """SELECT rule_id_a, rule_id_b FROM p, n, m ma, m mb
WHERE ma.rule_id = rule_id_a AND mb.rule_id = rule_id_b
  AND n_ab >= 4 AND n_ab * 2000 >= n AND n_ab * n >= 4 * ma.c * mb.c""",
    "p3_pairs": _PAIRS
    + """SELECT rule_id_a, rule_id_b, n_ab, ma.c AS n_a, mb.c AS n_b, n,
  round(n_ab::DOUBLE * n / (ma.c::DOUBLE * mb.c), 6) AS lift, round(log2(n_ab::DOUBLE * n / (ma.c::DOUBLE * mb.c)), 6) AS pmi
FROM p, n, m ma, m mb WHERE ma.rule_id = rule_id_a AND mb.rule_id = rule_id_b AND n_ab >= 4""",
    "p4_found": r"""
WITH c AS (SELECT DISTINCT id, unnest(rules) AS name FROM rule_clusters),
r AS (SELECT c.id, r.name, r.rule_id, r.priority, r.updated_at,
        lower(regexp_replace(r.severity, '^\s+|\s+$', '', 'g')) AS sev, r.source AS src
      FROM c JOIN rules r ON r.name = c.name),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority DESC NULLS LAST, updated_at DESC NULLS LAST, rule_id) AS k FROM r),
g AS (SELECT id, arg_min(name, k) AS keep,
        arg_min(sev, k) FILTER (WHERE sev NOT IN ('', 'none', 'unknown', 'n/a')) AS severity,
        arg_min(src, k) FILTER (WHERE lower(trim(src)) NOT IN ('', 'none', 'unknown', 'n/a')) AS source
      FROM o GROUP BY id)
SELECT DISTINCT q.id, g.keep, coalesce(g.severity, '') AS severity, coalesce(g.source, '') AS source
FROM rule_clusters q LEFT JOIN g ON g.id = q.id""",
    "p8_roundtrip": "SELECT lang, count(*) AS documents, 0::BIGINT AS changed FROM documents GROUP BY lang",
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM test_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[s:s + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
iw AS (SELECT item_id, array_to_string(w[s:s + 12], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS s FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (k)""",
    "p3_counts": _PAIRS
    + """SELECT rule_id_a, rule_id_b, n_ab, ma.c AS n_a, mb.c AS n_b, n,
  round(n_ab::DOUBLE * n / (ma.c::DOUBLE * mb.c), 6) AS lift, round(log2(n_ab::DOUBLE * n / (ma.c::DOUBLE * mb.c)), 6) AS pmi
FROM p, n, m ma, m mb WHERE ma.rule_id = rule_id_a AND mb.rule_id = rule_id_b""",
    # groups by transitive closure
    "p7_found": r"""
WITH RECURSIVE o AS (SELECT regexp_replace(rule_a, '^[\s\pZ\x{1c}-\x{1f}\x{85}]+|[\s\pZ\x{1c}-\x{1f}\x{85}]+$', '', 'g') AS u, regexp_replace(rule_b, '^[\s\pZ\x{1c}-\x{1f}\x{85}]+|[\s\pZ\x{1c}-\x{1f}\x{85}]+$', '', 'g') AS v FROM overlap_pairs WHERE jaccard >= 0.6),
l AS (SELECT id, trim(unnest(rules)) AS name FROM rule_clusters),
s AS (SELECT a.name AS u, b.name AS v FROM (SELECT id, min(name) AS name FROM l WHERE name <> '' GROUP BY id) a JOIN l b ON b.id = a.id AND b.name <> '' AND b.name <> a.name),
e AS (SELECT u, v FROM o WHERE u <> '' AND v <> '' AND u <> v UNION SELECT u, v FROM s),
g AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
t AS (SELECT u, u AS w FROM g UNION SELECT t.u, g.v FROM t JOIN g ON g.u = t.w)
SELECT u AS rule_name, min(w) AS group_name FROM t GROUP BY u""",
    # edit distance at most one: what is common at both ends leaves at most one word
    "p9_edited": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM test_items WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, w[s:s + 12] AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS s FROM i)),
dw AS (SELECT DISTINCT doc_id, w[s:s + n - 1] AS y FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (VALUES (12), (13), (14)) k(n))),
c AS (SELECT doc_id, item_id, x, y FROM dw JOIN iw ON y[1:6] = x[1:6] UNION SELECT doc_id, item_id, x, y FROM dw JOIN iw ON y[-7:] = x[-7:]),
m AS (SELECT doc_id, item_id, x, y,
    coalesce(list_position(list_transform(range(1, 16), lambda k: x[k] IS DISTINCT FROM y[k] OR x[k] IS NULL), true), 16) - 1 AS p,
    coalesce(list_position(list_transform(range(1, 16), lambda k: x[-k] IS DISTINCT FROM y[-k] OR x[-k] IS NULL), true), 16) - 1 AS q FROM c)
SELECT DISTINCT doc_id, item_id FROM m WHERE p + q >= greatest(len(x), len(y)) - 1""",
    # every window of 300 characters
    "p10_found": """
WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300),
w AS (SELECT doc_id, s, md5(substring(text, s, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS s FROM t)),
k AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
o AS (SELECT DISTINCT doc_id, s FROM w WHERE h IN (SELECT h FROM k)),
n AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS after FROM o)
SELECT doc_id, sum(least(300, coalesce(after - s, 300)))::BIGINT AS shared_chars FROM n GROUP BY doc_id""",
}
