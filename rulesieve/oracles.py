"""SQL that gives the same rows as the core queries, for DuckDB over the same tables."""

import random

from rulesieve.operators import generate, quality

#: (name, pattern, priority) of the rules of ``literal_scan``: equal, narrower, wider and unrelated languages.
SCAN_RULES = (
    ("hex_lower", "[0-9a-f]{32}", 10), ("hex_same", "[a-f0-9]{32}", 20), ("hex_any", "[0-9a-fA-F]{16,40}", 10), ("alnum", "[a-zA-Z0-9]{12,64}", 30),
    ("aws_like", "AKIA[A-Z0-9]{16}", 10), ("digits", "[0-9]{6,12}", 10), ("year", "(?:19|20)[0-9]{2}", 10), ("mail", "[a-z]{3,8}@[a-z]{3,8}[.]example", 10),
)
SCAN_SAMPLES = 20


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _scan_rows() -> tuple[str, str]:
    """The rules and their strings as SQL literals."""
    rules = ", ".join(f"({i}, {_text(n)}, {_text(p)}, {q})" for i, (n, p, q) in enumerate(SCAN_RULES))
    settings = generate.Settings(samples=SCAN_SAMPLES)
    made = [(i, t) for i, (n, p, _) in enumerate(SCAN_RULES) for t in generate.positives(p, random.Random(generate.seed_of(n, settings.seed)), settings)]
    return rules, ", ".join(f"({k}, {i}, {_text(t)})" for k, (i, t) in enumerate(made))


_RULE_ROWS, _STRING_ROWS = _scan_rows()
_RANDOM = ", ".join(f"({i}, {_text(t)})" for i, t in quality.random_rows())

_E = "e AS (SELECT entry_id, arg_max(struct_pack(text := text, label := label, source := source), ingested_at) AS r FROM entries GROUP BY entry_id)"
_H = "h AS (SELECT DISTINCT entry_id, rule_id FROM rule_hits WHERE entry_id IS NOT NULL AND rule_id IS NOT NULL)"
_M = f"{_H}, m AS (SELECT a.rule_id, b.rule_id AS source_rule_id, count(*) AS cnt FROM h a JOIN h b USING (entry_id) GROUP BY ALL), s AS (SELECT rule_id, count(*) AS n FROM h GROUP BY rule_id)"
_R = f"""{_M}, r AS (SELECT a.rule_id AS rule_a, a.source_rule_id AS rule_b, a.cnt AS ab, a.cnt AS ba, sa.n AS size_a, sb.n AS size_b, a.cnt / sb.n AS a2b, a.cnt / sa.n AS b2a, a.cnt / (sa.n + sb.n - a.cnt) AS jaccard
  FROM m a JOIN s sa ON sa.rule_id = a.rule_id JOIN s sb ON sb.rule_id = a.source_rule_id WHERE a.rule_id < a.source_rule_id)"""
_P = f"""{_R}, w AS (SELECT rule_id, count(*) AS n FROM m WHERE rule_id <> source_rule_id GROUP BY 1),
k AS (SELECT b.rule_id, b.name, b.source, coalesce(b.priority, 0) AS pri,
    coalesce(CASE WHEN json_type(b.metadata, '$.catch_all') = 'BOOLEAN' THEN json_extract_string(b.metadata, '$.catch_all') = 'true' END, coalesce(w.n, 0) > 30) AS wide FROM base_rules b LEFT JOIN w USING (rule_id)),
c AS (SELECT r.*, a.name AS na, b.name AS nb, a.source AS sa, b.source AS sb, a.pri AS pa, b.pri AS pb, a.wide AS wa, b.wide AS wb,
    CASE WHEN a2b >= 0.4 AND b2a >= 0.4 THEN 'duplicate' WHEN a2b >= 0.4 THEN 'subset' WHEN b2a >= 0.4 THEN 'superset' WHEN a2b >= 0.1 OR b2a >= 0.1 THEN 'overlap' END AS relationship
  FROM r JOIN k a ON a.rule_id = rule_a JOIN k b ON b.rule_id = rule_b),
p AS (SELECT *, CASE relationship WHEN 'duplicate' THEN CASE WHEN pa > pb THEN 'keep_a' WHEN pb > pa THEN 'keep_b' ELSE 'review' END
    WHEN 'subset' THEN CASE WHEN pb > pa OR wa THEN 'keep_both' ELSE 'keep_a' END WHEN 'superset' THEN CASE WHEN pa > pb OR wb THEN 'keep_both' ELSE 'keep_b' END ELSE 'review' END AS recommendation
  FROM c WHERE relationship IS NOT NULL)"""
_COUNTS = f"""WITH {_E}, c AS (SELECT b.rule_id, count(*) AS n FROM e, base_rules b WHERE regexp_matches(e.r.text, b.pattern) GROUP BY 1)
SELECT b.rule_id, b.name, coalesce(c.n, 0) AS matched_count FROM base_rules b LEFT JOIN c USING (rule_id)"""
_LABELLED = f"""WITH {_E}, {_H}, l AS (SELECT entry_id, e.r.label AS label FROM e WHERE e.r.label <> ''),
q AS (SELECT DISTINCT l.entry_id, b.rule_id FROM l JOIN (SELECT rule_id, name AS label FROM base_rules UNION SELECT rule_id, unnest(tags) FROM base_rules) b ON b.label = l.label),
f AS (SELECT h.entry_id, h.rule_id FROM h JOIN l USING (entry_id)),
j AS (SELECT coalesce(f.rule_id, q.rule_id) AS rule_id, f.rule_id IS NOT NULL AS fired, q.rule_id IS NOT NULL AS wanted FROM f FULL JOIN q ON f.entry_id = q.entry_id AND f.rule_id = q.rule_id),
c AS (SELECT rule_id, count(*) FILTER (fired AND wanted) AS tp, count(*) FILTER (fired AND NOT wanted) AS fp, count(*) FILTER (NOT fired) AS fn FROM j GROUP BY 1),
n AS (SELECT rule_id, count(*) AS n FROM h GROUP BY 1),
z AS (SELECT b.rule_id, b.name, coalesce(n.n, 0) AS matched_count, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM base_rules b LEFT JOIN c USING (rule_id) LEFT JOIN n USING (rule_id)),
y AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS r FROM z),
m AS (SELECT rule_id, name, matched_count, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END, 4) AS f1 FROM y) """
_PAIRED = f"WITH {_H}, n AS (SELECT DISTINCT entry_id, name FROM h JOIN base_rules USING (rule_id)) SELECT a.name AS rule_a, b.name AS rule_b, count(*) AS count FROM n a JOIN n b ON a.entry_id = b.entry_id AND a.name < b.name GROUP BY ALL"

_Q = f"""{_M}, t(i, text) AS (VALUES {_RANDOM}),
y AS (SELECT b.rule_id, count(*) AS n FROM base_rules b JOIN t ON regexp_matches(t.text, b.pattern) GROUP BY 1),
f AS (SELECT rule_id, sum(cnt)::BIGINT AS fp, count(*) AS others FROM m WHERE rule_id <> source_rule_id AND source_rule_id IN (SELECT rule_id FROM base_rules) GROUP BY 1),
g AS (SELECT source_rule_id AS rule_id, max(cnt) AS most FROM m WHERE rule_id <> source_rule_id GROUP BY 1),
u AS (SELECT b.rule_id, b.name, b.source, round(1 - coalesce(y.n, 0) / 200, 4) AS specificity, coalesce(fp, 0) AS fp_potential, greatest(0, coalesce(s.n, 0) - coalesce(most, 0)) AS unique_coverage, coalesce(others, 0) AS overlap_count, coalesce(s.n, 0) AS size
  FROM base_rules b LEFT JOIN y USING (rule_id) LEFT JOIN f USING (rule_id) LEFT JOIN g USING (rule_id) LEFT JOIN s USING (rule_id)),
q AS (SELECT *, overlap_count > 5 AS is_broad, specificity < 0.1 AS is_low_specificity, unique_coverage = 0 AND size > 0 AS is_redundant FROM u)"""

# records by regular expression; a pattern is held to compile in Python if RE2 takes it, or if it has what RE2 lacks
_WHITE = r"[\s\pZ\x{85}\x{1c}-\x{1f}]"
_FIELD = r'''"(?:[^"]|"")*"|[^",\r\n][^,\r\n]*|'''
_LINE = rf"(?:{_FIELD})(?:,(?:{_FIELD}))*"
_RAW = rf"""r AS (SELECT DISTINCT row_id, layout, raw_text AS t FROM raw_rows WHERE NOT regexp_full_match(raw_text, '(?s){_WHITE}*') AND (layout = 'entries_jsonl' OR line_no IS DISTINCT FROM 1)),
c AS (SELECT row_id, layout, t, regexp_full_match(t, '{_LINE}(?:(?:\r\n|\n|\r){_LINE})*') AS ok, regexp_full_match(t, '{_LINE}') AS one,
    list_transform(regexp_extract_all(',' || t, ',("(?:[^"]|"")*"|[^",][^,]*|)', 1), lambda f: CASE WHEN f[1:1] = '"' THEN replace(f[2:-2], '""', '"') ELSE f END) AS f FROM r WHERE layout <> 'entries_jsonl'),
v AS (SELECT row_id, layout, ok, one, len(f) AS n, f, list_transform(f, lambda x: regexp_replace(x, '(?s)^{_WHITE}+|{_WHITE}+$', '', 'g')) AS s FROM c),
j AS (SELECT row_id, t, json_valid(t) AS ok, CASE WHEN json_valid(t) THEN json_type(t) END AS kind, CASE WHEN json_valid(t) THEN json_type(t, '$.text') END AS text_kind, CASE WHEN json_valid(t) THEN json_extract_string(t, '$.text') END AS text FROM r WHERE layout = 'entries_jsonl'),
a AS (
  SELECT row_id, CASE WHEN NOT ok THEN 'syntax' WHEN NOT one OR n <> (CASE layout WHEN 'rules_csv' THEN 6 ELSE 4 END) THEN 'columns'
    WHEN layout = 'rules_csv' AND (s[1] = '' OR s[2] = '' OR lower(s[5]) NOT IN ('critical', 'high', 'medium', 'low', '') OR NOT regexp_full_match(s[6], '[+-]?[0-9]+|') OR (s[6] <> '' AND TRY_CAST(s[6] AS BIGINT) IS NULL)
      OR (TRY(regexp_matches('', f[2])) IS NULL AND (NOT regexp_matches(f[2], '\(\?[=!<>]|\(\?P=|\\[1-9]') OR regexp_matches(f[2], '\(\?<[=!][^)]*[+*?{{]')))) THEN 'values'
    WHEN layout = 'entries_csv' AND (s[1] = '' OR NOT regexp_full_match(s[4], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR TRY_CAST(s[4] AS DATE) IS NULL) THEN 'values' END AS reason FROM v
  UNION ALL
  SELECT row_id, CASE WHEN NOT ok THEN 'syntax' WHEN kind <> 'OBJECT' OR text_kind IS NULL THEN 'columns' WHEN text_kind <> 'VARCHAR' OR regexp_full_match(text, '(?s){_WHITE}*') THEN 'values' END FROM j)"""

ORACLES: dict[str, str] = {
    "rule_match_counts": _COUNTS,
    "rule_match_counts_native": _COUNTS,
    "partitioned_match_counts": f"""WITH {_E}, c AS (SELECT b.rule_id, count(*) AS n FROM e, base_rules b
  WHERE coalesce(nullif(e.r.label, ''), '_default') = b.detector AND regexp_matches(e.r.text, b.pattern) GROUP BY 1)
SELECT b.rule_id, b.name, coalesce(c.n, 0) AS matched_count FROM base_rules b LEFT JOIN c USING (rule_id)""",
    "never_firing_rules": "SELECT rule_id, name FROM base_rules b WHERE NOT EXISTS (SELECT 1 FROM rule_hits h WHERE h.rule_id = b.rule_id AND n_matches > 1)",
    "match_matrix": f"WITH {_M} SELECT * FROM m",
    "corpus_sizes": f"WITH {_M} SELECT * FROM s",
    "overlap_counts": f"WITH {_M} SELECT b.rule_id, count(m.cnt) AS overlap_count FROM base_rules b LEFT JOIN m ON m.rule_id = b.rule_id AND m.source_rule_id <> b.rule_id AND m.source_rule_id IN (SELECT rule_id FROM base_rules) GROUP BY 1",
    "fp_potential": f"WITH {_M} SELECT b.rule_id, coalesce(sum(m.cnt), 0)::BIGINT AS fp_potential FROM base_rules b LEFT JOIN m ON m.rule_id = b.rule_id AND m.source_rule_id <> b.rule_id GROUP BY 1",
    "unique_coverage": f"""WITH {_M}, x AS (SELECT source_rule_id AS rule_id, max(cnt) AS most FROM m WHERE rule_id <> source_rule_id GROUP BY 1)
SELECT b.rule_id, coalesce(s.n, 0) AS n, greatest(0, coalesce(s.n, 0) - coalesce(x.most, 0)) AS unique_coverage FROM base_rules b LEFT JOIN s USING (rule_id) LEFT JOIN x USING (rule_id)""",
    "exact_unique": f"""WITH {_H}, o AS (SELECT entry_id, min(rule_id) AS rule_id FROM h GROUP BY 1 HAVING count(*) = 1), c AS (SELECT rule_id, count(*) AS n FROM o GROUP BY 1)
SELECT b.rule_id, coalesce(c.n, 0) AS only_here FROM base_rules b LEFT JOIN c USING (rule_id)""",
    "pair_overlap": f"WITH {_R} SELECT rule_a, rule_b, ab, ba, round(a2b, 4) AS a2b, round(b2a, 4) AS b2a, round(jaccard, 4) AS jaccard FROM r",
    "pair_classification": f"""WITH {_P} SELECT rule_a AS rule_id_a, rule_b AS rule_id_b, na AS rule_a, nb AS rule_b, round(a2b, 4) AS overlap_a_to_b, round(b2a, 4) AS overlap_b_to_a, round(jaccard, 4) AS jaccard, relationship, recommendation,
  CASE relationship
    WHEN 'duplicate' THEN CASE WHEN pa = pb THEN 'Equal priority — review manually' ELSE 'Higher priority source' || CASE WHEN length(CASE WHEN pa > pb THEN sa ELSE sb END) > 0 THEN ' (' || CASE WHEN pa > pb THEN sa ELSE sb END || ')' ELSE '' END END
    WHEN 'subset' THEN CASE WHEN pb > pa THEN concat('''', nb, ''' has higher priority but is a subset') WHEN wa THEN concat('''', na, ''' is a catch-all — dropping ''', nb, ''' would lose its label') ELSE concat('''', na, ''' is more comprehensive (superset)') END
    WHEN 'superset' THEN CASE WHEN pa > pb THEN concat('''', na, ''' has higher priority but is a subset') WHEN wb THEN concat('''', nb, ''' is a catch-all — dropping ''', na, ''' would lose its label') ELSE concat('''', nb, ''' is more comprehensive (superset)') END
    ELSE 'Partial overlap — review manually' END AS reason,
  (relationship = 'subset' AND recommendation = 'keep_a') OR (relationship = 'superset' AND recommendation = 'keep_b') AS downstream_label_loss FROM p""",
    "pair_totals": f"""WITH {_P} SELECT count(*) FILTER (relationship = 'duplicate') AS duplicate_pairs, count(*) FILTER (relationship IN ('subset', 'superset')) AS subset_pairs, count(*) FILTER (relationship = 'overlap') AS overlap_pairs,
  count(*) FILTER (recommendation IN ('keep_a', 'keep_b')) AS rules_recommended_drop, count(*) FILTER (recommendation = 'review') AS rules_recommended_review FROM p""",
    "wilson_ci": f"""WITH {_R}, w AS (SELECT rule_a, rule_b, ab::DOUBLE / size_b AS p, size_b::DOUBLE AS n, 1.96::DOUBLE AS z FROM r),
x AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS reach FROM w),
y AS (SELECT *, round(greatest(0.0::DOUBLE, mid - reach), 4) AS lo, round(least(1.0::DOUBLE, mid + reach), 4) AS hi FROM x)
SELECT rule_a, rule_b, lo, hi, round(hi - lo, 4) AS width, lo >= 0.1 AS confident,
  CASE WHEN p * (1 - p) = 0 THEN greatest(10, n::BIGINT) ELSE greatest(10, ceil(4 * pow(1.96::DOUBLE / 0.1::DOUBLE, 2) * (p * (1 - p)))::BIGINT) END AS samples FROM y""",
    "clusters": f"""WITH RECURSIVE {_P}, g AS (SELECT rule_a AS u, rule_b AS v FROM p WHERE round(jaccard, 4) >= 0.25 UNION SELECT rule_b, rule_a FROM p WHERE round(jaccard, 4) >= 0.25),
t AS (SELECT u, u AS w FROM g UNION SELECT t.u, g.v FROM t JOIN g ON g.u = t.w),
l AS (SELECT u AS rule_id, min(w) AS label FROM t GROUP BY u),
b AS (SELECT l.label, l.rule_id, k.name, k.source, row_number() OVER (PARTITION BY label ORDER BY pri DESC, l.rule_id) AS place FROM l JOIN k USING (rule_id))
SELECT dense_rank() OVER (ORDER BY b.label) AS id, b.name AS rule, f.name AS keep, concat('Highest priority in cluster', CASE WHEN length(f.source) > 0 THEN concat(' (from ', f.source, ')') ELSE '' END) AS reason
FROM b JOIN b f ON f.label = b.label AND f.place = 1""",
    "co_firing": _PAIRED,
    "co_firing_top": f"{_PAIRED} ORDER BY count DESC, rule_a, rule_b LIMIT 100",
    "labeled_metrics": f"{_LABELLED}SELECT * FROM m",
    "labeled_summary": f"""{_LABELLED}SELECT count(*) FILTER (matched_count > 0) AS rules_firing, count(*) FILTER (matched_count = 0) AS rules_never_firing, count(*) FILTER (tp + fn > 0) AS rules_judged,
  round(coalesce(avg(precision) FILTER (tp + fn > 0), 0.0), 4) AS avg_precision, round(coalesce(avg(recall) FILTER (tp + fn > 0), 0.0), 4) AS avg_recall FROM m""",
    "coverage_drift": f"""WITH {_E}, {_H}, d AS (SELECT entry_id, CASE WHEN e.r.source = 'monolith-audit' THEN 'a' ELSE 'b' END AS side FROM e),
n AS (SELECT (count(*) FILTER (side = 'a'))::DOUBLE AS na, (count(*) FILTER (side = 'b'))::DOUBLE AS nb FROM d),
c AS (SELECT rule_id, count(*) FILTER (side = 'a') AS matches_a, count(*) FILTER (side = 'b') AS matches_b FROM h JOIN d USING (entry_id) GROUP BY 1)
SELECT rule_id, b.name AS rule, matches_a, matches_b, round(matches_a / na, 4) AS rate_a, round(matches_b / nb, 4) AS rate_b, round(abs(matches_a / na - matches_b / nb), 4) AS drift, abs(matches_a / na - matches_b / nb) > 0.005 AS significant
FROM c JOIN base_rules b USING (rule_id), n""",
    "report_totals": f"WITH {_M}, c AS (SELECT rule_id, sum(cnt) AS cnt FROM m GROUP BY 1) SELECT source, count(*) AS rules, coalesce(sum(cnt), 0)::BIGINT AS positive_matches FROM base_rules LEFT JOIN c USING (rule_id) GROUP BY source",
    "matrix_rollup": f"WITH {_H} SELECT detector, name, count(*) AS matches FROM h JOIN base_rules USING (rule_id) GROUP BY ROLLUP (detector, name)",
    "diversity_ratio": """WITH t AS (SELECT source, substring(text, greatest(1, floor((length(text) - 50) / 2.0)::INT + 1), 50) AS mid FROM documents WHERE text IS NOT NULL)
SELECT source, count(*) AS samples, count(DISTINCT mid) AS unique_middles, round(count(DISTINCT mid) / count(*), 4) AS ratio, count(*) >= 10 AND count(DISTINCT mid) / count(*) < 0.4 AS is_low FROM t GROUP BY source""",
    "first_seen_lines": """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM s),
o AS (SELECT line, doc_id, line_no, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS k FROM l WHERE line <> '')
SELECT md5(line) AS line_md5, doc_id, line_no FROM o WHERE k = 1""",
    "event_rules": r"""WITH r(name, pattern) AS (VALUES ('even', '[02468]\}'), ('small', ': \d\}'), ('key', '^\{"k"'), ('never', 'absent')),
c AS (SELECT name, count(*) AS n FROM events, r WHERE regexp_matches(props, pattern) GROUP BY name)
SELECT name, coalesce(n, 0) AS matched FROM r LEFT JOIN c USING (name)""",
    "hits_by_window": """WITH e AS (SELECT entry_id, arg_max(text, ingested_at) AS text, any_value(seen_at) AS seen_at FROM entries WHERE seen_at IS NOT NULL GROUP BY 1)
SELECT date_trunc('day', seen_at) AS window_start, rule_id, count(*) AS hits FROM e, base_rules b WHERE regexp_matches(e.text, b.pattern) GROUP BY 1, 2""",
    "p6_found": r"""
WITH r AS (SELECT feed, file_no, record_no, arg_max(body, (loaded_at, body)) AS body FROM rule_file_records GROUP BY ALL),
f AS (SELECT feed, file_no, row_number() OVER (PARTITION BY feed ORDER BY file_no) AS i FROM (SELECT DISTINCT feed, file_no FROM r)),
k AS (SELECT feed, file_no, record_no, body, unnest(json_keys(body)) AS field FROM r),
e AS (SELECT k.feed, f.i, record_no, field, json_extract_string(body, '$."' || field || '"') AS value,
        CASE json_type(body, '$."' || field || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
          WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind
      FROM k JOIN f ON f.feed = k.feed AND f.file_no = k.file_no),
v AS (SELECT * FROM e WHERE kind IS NOT NULL),
t AS (SELECT feed, i, field, arg_min(kind, (-n, kind)) AS kind FROM (SELECT feed, i, field, kind, count(*) AS n FROM v GROUP BY ALL) GROUP BY ALL),
last AS (SELECT feed, max(i) AS i FROM f GROUP BY feed),
a AS (SELECT t.feed, t.i, t.field, t.kind, p.kind AS old FROM t LEFT JOIN t p ON p.feed = t.feed AND p.i = t.i - 1 AND p.field = t.field WHERE t.i > 1),
g AS (SELECT t.feed, t.i + 1 AS i, t.field, t.kind FROM t JOIN last ON last.feed = t.feed AND t.i < last.i
      WHERE NOT EXISTS (SELECT 1 FROM t n WHERE n.feed = t.feed AND n.i = t.i + 1 AND n.field = t.field)),
w AS (SELECT feed, i, record_no, min(value) AS rule FROM v WHERE field IN ('name', 'Name', 'rule_name', 'ruleName', 'rule_id', 'id') GROUP BY ALL),
b AS (SELECT DISTINCT g.feed, g.i, g.field, g.kind, w.rule, v.value FROM g JOIN v ON v.feed = g.feed AND v.i = g.i - 1 AND v.field = g.field
      JOIN w ON w.feed = v.feed AND w.i = v.i AND w.record_no = v.record_no),
c AS (SELECT DISTINCT a.feed, a.i, a.field, a.kind, w.rule, v.value FROM a JOIN v ON v.feed = a.feed AND v.i = a.i AND v.field = a.field
      JOIN w ON w.feed = v.feed AND w.i = v.i AND w.record_no = v.record_no WHERE a.old IS NULL),
m AS (SELECT b.feed, b.i, b.field AS gone, c.field AS come, count(*) FILTER (WHERE b.value = c.value) AS same, count(*) AS n
      FROM b JOIN c USING (feed, i, kind, rule) GROUP BY ALL HAVING 2 * count(*) FILTER (WHERE b.value = c.value) > count(*)),
q AS (SELECT *, row_number() OVER (PARTITION BY feed, i, gone ORDER BY same DESC, gone, come) AS r1,
        row_number() OVER (PARTITION BY feed, i, come ORDER BY same DESC, gone, come) AS r2 FROM m),
x AS (SELECT feed, i, field AS field_name, 'type_changed' AS drift_kind FROM a WHERE old <> kind
  UNION ALL SELECT feed, i, come, 'renamed' FROM q WHERE r1 = 1 AND r2 = 1
  UNION ALL SELECT feed, i, field, 'added' FROM a WHERE old IS NULL AND NOT EXISTS (SELECT 1 FROM q WHERE r1 = 1 AND r2 = 1 AND q.feed = a.feed AND q.i = a.i AND come = field)
  UNION ALL SELECT feed, i, field, 'removed' FROM g WHERE NOT EXISTS (SELECT 1 FROM q WHERE r1 = 1 AND r2 = 1 AND q.feed = g.feed AND q.i = g.i AND gone = field))
SELECT x.feed, f.file_no::BIGINT AS file_no, field_name, drift_kind FROM x JOIN f ON f.feed = x.feed AND f.i = x.i""",
    "rule_quality": f"""WITH {_Q} SELECT rule_id, name, source, specificity, fp_potential, unique_coverage, overlap_count, is_broad, is_low_specificity, is_redundant FROM q""",
    "quality_summary": f"""WITH {_Q} SELECT count(*) AS rules, count(*) FILTER (is_broad) AS broad_patterns, count(*) FILTER (is_low_specificity) AS low_specificity, count(*) FILTER (is_redundant) AS fully_redundant,
  round(coalesce(avg(specificity), 0.0), 3) AS avg_specificity FROM q""",
    "literal_scan": f"""WITH r(rule_id, name, pattern, pri) AS (VALUES {_RULE_ROWS}), s(k, src, text) AS (VALUES {_STRING_ROWS}),
m AS (SELECT r.rule_id, s.src, count(*) AS cnt FROM r JOIN s ON regexp_matches(s.text, r.pattern) GROUP BY ALL),
z AS (SELECT src AS rule_id, count(*) AS n FROM s GROUP BY 1),
w AS (SELECT rule_id, count(*) AS n FROM m WHERE rule_id <> src GROUP BY 1),
p AS (SELECT a.name AS rule_a, b.name AS rule_b, coalesce(ab.cnt, 0) AS ab, coalesce(ba.cnt, 0) AS ba, za.n AS na, zb.n AS nb, a.pri AS pa, b.pri AS pb, coalesce(wa.n, 0) > 5 AS wide_a, coalesce(wb.n, 0) > 5 AS wide_b
  FROM r a JOIN r b ON a.rule_id < b.rule_id JOIN z za ON za.rule_id = a.rule_id JOIN z zb ON zb.rule_id = b.rule_id
  LEFT JOIN m ab ON ab.rule_id = a.rule_id AND ab.src = b.rule_id LEFT JOIN m ba ON ba.rule_id = b.rule_id AND ba.src = a.rule_id
  LEFT JOIN w wa ON wa.rule_id = a.rule_id LEFT JOIN w wb ON wb.rule_id = b.rule_id),
c AS (SELECT *, ab / nb AS x, ba / na AS y, least(ab, ba) / (na + nb - least(ab, ba)) AS j FROM p),
d AS (SELECT *, CASE WHEN x >= 0.8 AND y >= 0.8 THEN 'duplicate' WHEN x >= 0.8 THEN 'subset' WHEN y >= 0.8 THEN 'superset' WHEN x >= 0.2 OR y >= 0.2 THEN 'overlap' END AS relationship FROM c),
e AS (SELECT *, CASE relationship WHEN 'duplicate' THEN CASE WHEN pa > pb THEN 'keep_a' WHEN pb > pa THEN 'keep_b' ELSE 'review' END
  WHEN 'subset' THEN CASE WHEN pb > pa OR wide_a THEN 'keep_both' ELSE 'keep_a' END WHEN 'superset' THEN CASE WHEN pa > pb OR wide_b THEN 'keep_both' ELSE 'keep_b' END ELSE 'review' END AS recommendation FROM d WHERE relationship IS NOT NULL)
SELECT rule_a, rule_b, ab AS a_matches_b_corpus, ba AS b_matches_a_corpus, na AS a_corpus_size, nb AS b_corpus_size, round(x, 4) AS overlap_a_to_b, round(y, 4) AS overlap_b_to_a, round(j, 4) AS jaccard, relationship, recommendation,
  (relationship = 'subset' AND recommendation = 'keep_a') OR (relationship = 'superset' AND recommendation = 'keep_b') AS downstream_label_loss FROM e""",
    "p2_found": f"WITH {_RAW} SELECT DISTINCT row_id, reason FROM a WHERE reason IS NOT NULL",
    "p2_loaded": f"""WITH {_RAW}, good AS (SELECT row_id FROM a WHERE reason IS NULL)
SELECT DISTINCT row_id, f[1] AS name, f[2] AS pattern, f[3] AS source, f[4] AS detector, nullif(lower(s[5]), '') AS severity, TRY_CAST(nullif(s[6], '') AS BIGINT)::VARCHAR AS priority, NULL::VARCHAR AS text, NULL::VARCHAR AS label, NULL::VARCHAR AS seen_on
  FROM v WHERE layout = 'rules_csv' AND row_id IN (FROM good)
UNION ALL SELECT DISTINCT row_id, NULL, NULL, f[3], NULL, NULL, NULL, f[1], f[2], s[4]::DATE::VARCHAR FROM v WHERE layout = 'entries_csv' AND row_id IN (FROM good)
UNION ALL SELECT DISTINCT row_id, NULL, NULL, json_extract_string(t, '$.source'), NULL, NULL, NULL, text, json_extract_string(t, '$.label'), NULL FROM j WHERE row_id IN (FROM good)""",
}
