"""DuckDB SQL for the registered queries, written from the operators' semantics."""

from __future__ import annotations

from ..functions import risk
from ..functions.regex_dialect import ignore_to_regex
from ..operators.suppress import DEFAULT_EXCLUDES
from . import bindings as b

ORACLES: dict[str, str] = {}
F, D, E = b.FINDINGS_SQL, b.DOCUMENTS_SQL, b.EDGES_SQL


def case(column: str, pairs: dict, otherwise: object) -> str:
    q = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in pairs.items()) + f" ELSE {q(otherwise)} END"


def rules(names: list[str]) -> str:
    rows = [f"('{r}', '{p.replace(chr(39), chr(39) * 2)}', '{s}')" for r, p, s in b.DOCUMENT_RULES if r in names]
    return "rules(rule_id, pattern, severity) AS (VALUES " + ", ".join(rows) + ")"


ALL_RULES = [r for r, _, _ in b.DOCUMENT_RULES]
#: All matches of the rules: the byte column sums up the pieces between and the matches before.
MATCHES = """
p AS (
  SELECT path, language, line_number, line, lines, rule_id, severity, regexp_extract_all(line, pattern) AS m, string_split_regex(line, pattern) AS s
  FROM l JOIN rules ON regexp_matches(line, pattern)),
m AS (
  SELECT path, language, line_number, line, lines, rule_id, severity, i - 1 AS match_ordinal,
         list_sum(list_transform(s[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0) + 1 AS col
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM p))"""

ORACLES["severity_inventory"] = f"""
WITH {D}, {rules(ALL_RULES)}
SELECT language, rule_id, severity, CAST(sum(len(regexp_extract_all(line, pattern))) AS BIGINT) AS n_matches, count(DISTINCT path) AS n_files
FROM l JOIN rules ON regexp_matches(line, pattern) GROUP BY ALL"""

ORACLES["match_positions"] = f"""
WITH {D}, {rules([r for r in ALL_RULES if r not in ("DOC_JUNK", "DOC_EN")])}, {MATCHES}
SELECT path, CAST(line_number AS INTEGER) AS line_number, rule_id, CAST(match_ordinal AS INTEGER) AS match_ordinal, CAST(col AS INTEGER) AS "column" FROM m"""

ORACLES["snippet_context"] = f"""
WITH {D}, {rules(["DOC_TOKEN", "DOC_LICENSE"])}, {MATCHES}
SELECT path, CAST(line_number AS INTEGER) AS line_number, rule_id, CAST(match_ordinal AS INTEGER) AS match_ordinal,
       array_to_string(list_slice(lines, greatest(line_number - 3, 1), line_number + 3), chr(10)) AS context
FROM m"""

DIRECTIVES = r"""
own AS (
  SELECT path, line_number,
         CASE WHEN contains(line, '%%%') THEN
           CASE WHEN regexp_extract(line, '%%%(?:\s*:\s*([A-Za-z0-9_\-,\s]+))?', 1) = '' THEN ['*']
                ELSE list_filter(list_transform(string_split(regexp_extract(line, '%%%(?:\s*:\s*([A-Za-z0-9_\-,\s]+))?', 1), ','), lambda x: trim(x)), lambda x: x <> '') END END AS d
  FROM l),
force AS (
  SELECT path, line_number, coalesce(d, lag(d) OVER (PARTITION BY path ORDER BY line_number)) AS d FROM own)"""

ORACLES["inline_suppression"] = f"""
WITH {D}, {DIRECTIVES}
SELECT path, count(*) AS n_lines, count(*) FILTER (list_contains(d, '*')) AS n_all FROM force WHERE d IS NOT NULL GROUP BY path"""

ORACLES["suppressed_findings"] = f"""
WITH {D}, {rules(ALL_RULES)}, {DIRECTIVES}
SELECT rule_id, CAST(sum(len(regexp_extract_all(line, pattern))) AS BIGINT) AS n
FROM l JOIN rules ON regexp_matches(line, pattern) JOIN force USING (path, line_number)
WHERE d IS NULL OR NOT (list_contains(d, '*') OR list_contains(d, rule_id)) GROUP BY rule_id"""

ORACLES["suppression_join"] = f"""
WITH {D}, {rules(ALL_RULES[:2])}, {DIRECTIVES}
SELECT rule_id, CAST(sum(len(regexp_extract_all(line, pattern))) AS BIGINT) AS n
FROM l JOIN rules ON regexp_matches(line, pattern) JOIN force USING (path, line_number)
WHERE d IS NULL OR NOT (list_contains(d, '*') OR list_contains(d, rule_id)) GROUP BY rule_id"""

ORACLES["pack_matches"] = rf"""
WITH {D}, {rules(ALL_RULES)}, {MATCHES}
SELECT path AS file_path, rule_id, severity, count(*) AS n, CAST(sum(line_number * col + match_ordinal) AS BIGINT) AS places
FROM m
WHERE (rule_id <> 'DOC_EN' OR language = 'en')
  AND (rule_id <> 'DOC_LICENSE' OR regexp_matches(path, '/doc_1[^/]*\.txt$') OR regexp_matches(path, '^src3/[^/]*/doc_[^/]\.txt$'))
GROUP BY ALL"""


def excluded(target: str, parent: str) -> str:
    """The last of the query's patterns that matches, over a path and (for folder patterns) what stands for its folder."""
    patterns = [("src1", True, False, True), ("src1/3", False, True, True), ("src2/4", True, False, True), ("**/doc_7*", False, False, False), ("**/doc_77.txt", False, True, False), ("src5/*/doc_?[0].txt", False, False, False)]
    patterns = [(g, rooted and g == "src2/4", negated, folders) for g, rooted, negated, folders in patterns] + [(d, True, False, True) for d in DEFAULT_EXCLUDES]
    out = "false"
    for glob, rooted, negated, folders in patterns:
        seen = parent if folders else target
        out = f"CASE WHEN regexp_matches({seen}, '{ignore_to_regex(glob, rooted)}') THEN {str(not negated).lower()} ELSE {out} END"
    return out


#: What a rule matches is a whole run of word characters, all of them letters, that begins or ends with its syllable.
ORACLES["pack_of_many_rules"] = rf"""
WITH {D},
w AS (SELECT path, lower(w) AS w, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all(text, '[0-9A-Za-z_]+')) AS w FROM d) WHERE regexp_full_match(w, '[A-Za-z]{{5,}}') GROUP BY ALL),
s AS (SELECT unnest({b.SYLLABLES}) AS s),
m AS (
  SELECT s, path, n FROM w JOIN s ON s = substr(w, 1, 3)
  UNION ALL SELECT s, path, n FROM w JOIN s ON s = right(w, 3) WHERE length(w) >= 6 AND s <> substr(w, 1, 3))
SELECT 'DOC_' || upper(s) AS rule_id, count(DISTINCT path) AS n_files, CAST(sum(n) AS BIGINT) AS n_matches FROM m GROUP BY s"""

ORACLES["path_exclusion"] = f"""
WITH {D},
x AS (SELECT path, regexp_extract(path, '^[^/]*') AS d1, regexp_extract(path, '^[^/]*/[^/]*') AS d2 FROM d)
SELECT path, {excluded("d1", "d1")} OR {excluded("d2", "d2")} OR {excluded("path", "d2")} AS excluded FROM x"""

ORACLES["include_only"] = f"""
WITH {D}
SELECT language, count(*) AS n FROM d
WHERE path IN (SELECT concat(source, '/', doc_id % 10, '/doc_', doc_id, '.txt') FROM documents JOIN labels USING (doc_id)) GROUP BY language"""

ORACLES["rule_globs"] = rf"""
WITH {D}
SELECT path, regexp_matches(path, '/doc_1[^/]*\.txt$') OR regexp_matches(path, '^src3/[^/]*/doc_[^/]\.txt$') AS accepted, '' AS routed FROM d"""

ORACLES["language_routing"] = f"""
WITH r(i, language, is_source) AS (VALUES (0, 'python', true), (1, 'kotlin', true), (2, 'dockerfile', false), (3, 'dockerfile', false), (4, 'nginx', false), (5, 'ini', false),
  (6, 'x509', false), (7, '', false), (8, '', false), (9, 'env', false), (10, 'ssh-config', false), (11, 'terraform', false))
SELECT language, is_source, count(*) AS files FROM part JOIN r ON p_partkey % 12 = i GROUP BY ALL"""

ORACLES["sentinel_first_hit"] = rf"""
WITH {D},
table_(n, language, library, pattern, named) AS (VALUES (1, 'en', 'article', '\b(the|an)\b', true), (2, 'en', 'junction', '\band\b', false), (3, 'fr', 'article', '\b(les|une)\b', true), (4, 'de', 'article', '\b(der|die|das)\b', true)),
quiet AS (SELECT * FROM l WHERE path NOT IN (SELECT path FROM l WHERE regexp_matches(line, '[#%$&*]{{3}}'))),
hits AS (
  SELECT path, line_number, n, library, strlen(string_split_regex(line, pattern)[1]) + 1 AS col,
         CASE WHEN named THEN regexp_extract(line, pattern, 1) ELSE library END AS name
  FROM quiet JOIN table_ USING (language) WHERE regexp_matches(line, pattern) AND NOT contains(line, 'licensed'))
SELECT path, CAST(line_number AS INTEGER) AS line_number, CAST(col AS INTEGER) AS "column", name AS library
FROM hits QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_number, n) = 1"""

ORACLES["notebook_cells"] = f"""
WITH {D},
x AS (SELECT path, CAST(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS BIGINT) AS n FROM d WHERE text <> '')
SELECT path, CAST(0 AS INTEGER) AS cell, n AS n_lines, CAST(1 AS BIGINT) AS first_line, n AS last_line FROM x
UNION ALL
SELECT path, 2, 2, n + 2, n + 3 FROM x"""

ORACLES["scan_files"] = f"""
WITH w(n, name, rule_id, line_number, "column", layer_ordinal, keyed) AS (VALUES {", ".join(repr(x) for x in b.source_places())})
SELECT concat('p', p_partkey, '/', name) AS file_path, rule_id, line_number,
       CAST("column" + keyed * length(CAST(p_partkey AS VARCHAR)) AS INTEGER) AS "column", layer_ordinal
FROM part JOIN w ON p_partkey % {len(b.SOURCES)} = n"""

RANK = "CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END"
ORACLES["threshold_filter"] = f"WITH {F} SELECT rule_id, severity, count(*) AS n FROM f WHERE {RANK} >= 2 GROUP BY ALL"
ORACLES["exit_gate"] = f"WITH {F} SELECT CAST(coalesce(max({RANK}), -1) >= 3 AS INTEGER) AS exit_code FROM f"
ORACLES["facets"] = f"""
WITH {F}
SELECT 'severity' AS facet, severity AS value, count(*) AS n FROM f GROUP BY severity
UNION ALL SELECT 'algorithm', algorithm, count(*) FROM f GROUP BY algorithm"""
ORACLES["top_n_other"] = f"""
WITH {F},
c AS (SELECT algorithm, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, algorithm) AS nth FROM f GROUP BY algorithm)
SELECT CASE WHEN nth <= 8 THEN algorithm ELSE 'other' END AS label, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1"""
ORACLES["explorer_filter"] = f"""
WITH {F}
SELECT CASE WHEN severity IN ('info', 'low', 'medium', 'high', 'critical') THEN severity ELSE 'medium' END AS severity, algorithm, count(*) AS n
FROM f WHERE severity IN ('high', 'critical', 'odd') AND contains(lower(file_path), '/f1') GROUP BY ALL"""
ORACLES["severity_counts"] = f"WITH {F} SELECT lower(severity) AS severity, count(*) AS n FROM f GROUP BY 1"
ORACLES["supersede_anti"] = f"""
WITH {F},
a AS (SELECT * FROM f WHERE channel = 'ast'),
o AS (SELECT * FROM f WHERE channel <> 'ast' AND NOT EXISTS (SELECT 1 FROM a WHERE a.file_path = f.file_path AND a.rule_id = f.rule_id AND a.line_number = f.line_number))
SELECT 0 AS layer_ordinal, rule_id, count(*) AS n FROM a GROUP BY rule_id
UNION ALL SELECT 1, rule_id, count(*) FROM o GROUP BY rule_id"""

ALNUM = "upper(regexp_replace(algorithm, '[^A-Za-z0-9]', '', 'g'))"
ORACLES["promotion"] = f"""
WITH {F},
s AS (SELECT *, {ALNUM} AS key0 FROM f WHERE category IN ('handrolled-crypto', 'crypto-fingerprint') AND {ALNUM} <> ''),
ruling AS (
  SELECT file_path, arg_max({ALNUM}, (confidence, -position)) AS ruling
  FROM s WHERE key0 IN ('RSA', 'DH') GROUP BY file_path HAVING count(DISTINCT key0) = 2),
k AS (SELECT s.*, CASE WHEN key0 IN ('RSA', 'DH') AND ruling IS NOT NULL THEN ruling ELSE key0 END AS key FROM s LEFT JOIN ruling USING (file_path)),
r AS (SELECT file_path, key, rule_id, max(confidence) AS c FROM k GROUP BY ALL HAVING max(confidence) > 0),
g AS (SELECT file_path, key, least(0.95, 1 - product(1 - least(c, 1.0))) AS c FROM r GROUP BY ALL HAVING count(*) >= 2),
best AS (
  SELECT file_path, key, arg_max(algorithm, (confidence, -position)) AS algorithm, arg_max(quantum_safety, (confidence, -position)) AS quantum_safety,
         arg_min(line_number, position) AS line_number, arg_min("column", position) AS col
  FROM k GROUP BY ALL)
SELECT file_path, concat('HANDROLLED_', key, '_PROMOTED') AS rule_id, algorithm, quantum_safety, line_number, col AS "column", round(c * 1e6) / 1e6 AS confidence
FROM g JOIN best USING (file_path, key)"""

#: The classes of the bound labels, worked out by hand.
CLASSES = {"RSA-2048": "RSA", "RSA": "RSA", "ECDSA-P256": "ECDSA", "AES-128": "", "AES-GCM": "AES", "3DES": "DES", "SHA-1": "SHA1", "SHA-256": "SHA256", "MD5": "MD5", "HMAC": "", "HMAC-SHA1": "HMAC", "ECDSA-P-256": "ECDSA-P", "TLS": "", "X25519-256": "X25519", "": "", "quux": "", "DH": "DH"}
CLASS = case("algorithm", CLASSES, "")
ORACLES["class_key"] = f"""
WITH {F}
SELECT algorithm, count(*) AS n, {CLASS} AS class, {ALNUM} AS folded FROM f GROUP BY algorithm"""

CONF = "CASE WHEN confidence > 0 THEN confidence ELSE 0.5 END"
CLUSTER = f"""
       array_to_string(list_sort(list(DISTINCT channel)), '+') AS channels, count(DISTINCT channel) AS corroboration,
       round(least(0.99, 1 - product(1 - least({CONF}, 1.0))) * 1e6) / 1e6 AS confidence,
       coalesce(arg_max(severity, severity_rank) FILTER (severity_rank > 0), '') AS severity, count(*) AS n_findings"""
CLASSED = f"c AS (SELECT *, {CLASS} AS algorithm_class, CASE severity WHEN 'info' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 WHEN 'critical' THEN 5 ELSE 0 END AS severity_rank FROM f)"
ORACLES["fuse_channels"] = f"WITH {F}, {CLASSED} SELECT algorithm_class, {CLUSTER} FROM c WHERE algorithm_class <> '' GROUP BY algorithm_class"
ORACLES["fuse_by_file"] = f"WITH {F}, {CLASSED} SELECT file_path, algorithm_class, {CLUSTER} FROM c WHERE algorithm_class <> '' GROUP BY ALL"
ORACLES["fuse_passthrough"] = f"""
WITH {F}, {CLASSED}
SELECT concat('UNCLASSIFIED:', rule_id) AS algorithm_class, channel AS channels, severity, count(*) AS n, round(max({CONF}) * 1e6) / 1e6 AS top
FROM c WHERE algorithm_class = '' GROUP BY ALL"""

LIBRARY = "CASE rule_id WHEN 'PY_IMPORT_HASHLIB' THEN 'HASHLIB' WHEN 'GO_USE_CRYPTO' THEN 'CRYPTO' WHEN 'RB_OPENSSL_REQUIRE' THEN 'OPENSSL' END"
GENERAL = "('', 'TLS', 'CIPHER', 'HASH', 'HMAC', 'MAC', 'RNG', 'SIGNATURE')"
MEASURES = f"""
lib AS (SELECT module, count(DISTINCT {LIBRARY}) AS n_libraries, array_to_string(list_sort(list(DISTINCT {LIBRARY}) FILTER ({LIBRARY} IS NOT NULL)), ',') AS libraries FROM f GROUP BY module),
files AS (SELECT module, file_path, count(*) AS n, row_number() OVER (PARTITION BY module ORDER BY count(*) DESC, file_path) AS nth FROM f GROUP BY module, file_path),
con AS (SELECT module, CAST(sum(n) AS BIGINT) AS n_findings, count(*) AS n_files, CAST(coalesce(sum(n) FILTER (nth <= 3), 0) AS BIGINT) AS top3 FROM files GROUP BY module),
div AS (SELECT module, count(DISTINCT upper(trim(algorithm))) FILTER (upper(trim(algorithm)) NOT IN {GENERAL}) AS n_algorithms FROM f GROUP BY module),
hard AS (SELECT module, count(*) FILTER (contains(category, 'hardcoded') OR contains(rule_id, 'HARDCODED')) AS n_hardcoded, count(*) AS n FROM f GROUP BY module)"""
LIB_SCORE = "CASE WHEN n_libraries = 0 THEN 18 WHEN n_libraries = 1 THEN 25 WHEN n_libraries = 2 THEN 20 WHEN n_libraries <= 4 THEN 12 ELSE 5 END"
CON_SCORE = "CASE WHEN top3 / n_findings >= 0.80 THEN 25 WHEN top3 / n_findings >= 0.50 THEN 18 WHEN top3 / n_findings >= 0.30 THEN 12 ELSE 5 END"
DIV_SCORE = "CASE WHEN n_algorithms <= 2 THEN 25 WHEN n_algorithms <= 4 THEN 18 WHEN n_algorithms <= 6 THEN 12 ELSE 5 END"
HARD_SCORE = "CASE WHEN n_hardcoded = 0 THEN 25 WHEN n_hardcoded / n <= 0.02 THEN 20 WHEN n_hardcoded / n <= 0.05 THEN 12 WHEN n_hardcoded / n <= 0.10 THEN 5 ELSE 0 END"
ORACLES["agility_libraries"] = f"WITH {F}, {MEASURES} SELECT module, n_libraries, {LIB_SCORE} AS library_score FROM lib"
ORACLES["agility_concentration"] = f"WITH {F}, {MEASURES} SELECT module, n_findings, n_files, top3, {CON_SCORE} AS concentration_score FROM con"
ORACLES["agility_diversity"] = f"WITH {F}, {MEASURES} SELECT module, n_algorithms, {DIV_SCORE} AS diversity_score FROM div"
ORACLES["agility_hardcoded"] = f"WITH {F}, {MEASURES} SELECT module, n_hardcoded, {HARD_SCORE} AS hardcoded_score FROM hard"
CARDS = f"""
{MEASURES},
cards AS (
  SELECT module, coalesce(libraries, '') AS libraries, {LIB_SCORE} AS library_score, {CON_SCORE} AS concentration_score, {DIV_SCORE} AS diversity_score, {HARD_SCORE} AS hardcoded_score
  FROM lib JOIN con USING (module) JOIN div USING (module) JOIN hard USING (module)),
total AS (SELECT *, library_score + concentration_score + diversity_score + hardcoded_score AS total_score FROM cards)"""
ORACLES["scorecard"] = f"""
WITH {F}, {CARDS}
SELECT *, CASE WHEN total_score >= 75 THEN 'Agile' WHEN total_score >= 50 THEN 'Manageable' WHEN total_score >= 25 THEN 'Difficult' ELSE 'Brittle' END AS grade FROM total"""

LEVEL = "CASE WHEN score >= 90 THEN 'Severe' WHEN score >= 75 THEN 'Critical' WHEN score >= 55 THEN 'High' WHEN score >= 35 THEN 'Medium' WHEN score >= 15 THEN 'Low' ELSE 'Safe' END"


def algorithm_sql(algorithm: str, key_size: str, safety: str) -> str:
    base = case(f"upper({algorithm})", risk.ALGORITHM_POINTS, 5)
    base = f"CASE WHEN upper({algorithm}) = 'RSA' AND {key_size} < 2048 THEN least(10, {base} + 2) ELSE {base} END"
    return f"CASE {safety} WHEN 'quantum_safe' THEN least({base}, 2) WHEN 'hybrid' THEN least({base}, 5) WHEN 'grover_weakened' THEN least({base}, 6) WHEN 'classically_broken' THEN greatest({base}, 7) ELSE {base} END"


SERVICE = f"""
CAST(round(greatest(0.0, least(100.0, CAST({algorithm_sql("algorithm", "key_size", "quantum_safety")} AS DOUBLE) * 1.0 + CAST({case("usage_type", risk.USAGE_POINTS, 5)} AS DOUBLE) * 1.2
 + 5 * CAST(1.5 AS DOUBLE) + 7 * CAST(1.3 AS DOUBLE) + 10 * CAST(1.4 AS DOUBLE) + 7 * CAST(1.0 AS DOUBLE) + 5 * CAST(0.8 AS DOUBLE)))) AS INTEGER)"""
ORACLES["risk_score"] = f"""
WITH {F}, s AS (SELECT algorithm, key_size, quantum_safety, usage_type, {SERVICE} AS score FROM (SELECT DISTINCT algorithm, key_size, quantum_safety, usage_type FROM f))
SELECT *, {LEVEL} AS level FROM s"""
ORACLES["worst_score"] = f"WITH {F} SELECT module, max({SERVICE}) AS worst FROM f GROUP BY module"

_o = {
    "a": b._pick(["MD5", "SHA1", "RSA", "AES", "AES-ECB", "TLS", "other"], "o_orderkey"),
    "q": b._pick(b.SAFETY_CYCLE, "o_custkey"),
    "u": b._pick(["key_exchange", "signing", "hashing", "tls_config", "none"], "o_custkey"),
    "x": b._pick(["public", "partner", "internal", "dev", "odd"], "o_orderkey"),
    "d": b._pick(["regulated", "confidential", "internal", "public"], "o_custkey"),
    "e": b._pick(["production", "staging", "dev", "test"], "o_orderkey"),
    "c": b._pick(["critical", "high", "medium", "low"], "o_custkey"),
    "r": b._pick(["active", "inactive", "unknown"], "o_orderkey"),
}
ORACLES["risk_levels"] = f"""
WITH o AS (SELECT {", ".join(f"{v} AS {k}" for k, v in _o.items())}, CASE WHEN o_orderkey % 3 = 0 THEN 1024 END AS size, o_orderkey, o_custkey FROM orders),
p AS (
  SELECT CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE CAST(round(greatest(0.0, least(100.0,
    CAST({algorithm_sql("a", "size", "q")} AS DOUBLE) + {case("u", risk.USAGE_POINTS, 5)} * CAST(1.2 AS DOUBLE) + {case("x", risk.EXPOSURE_POINTS, 5)} * CAST(1.5 AS DOUBLE)
    + {case("d", risk.SENSITIVITY_POINTS, 4)} * CAST(1.3 AS DOUBLE) + {case("e", risk.ENVIRONMENT_POINTS, 5)} * CAST(1.4 AS DOUBLE) + {case("c", risk.BUSINESS_POINTS, 4)}
    + {case("r", risk.ACTIVITY_POINTS, 5)} * CAST(0.8 AS DOUBLE) + CASE WHEN o_custkey % 4 = 0 THEN 8 ELSE 0 END * CAST(0.6 AS DOUBLE)
    - least(6, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 0 END)))) AS INTEGER) END AS score
  FROM o)
SELECT score, {LEVEL} AS level, count(*) AS n FROM p GROUP BY ALL"""

MARKS = "x AS (SELECT *, sha256(rule_id || chr(0) || file_path || chr(0) || snippet || chr(0)) AS fingerprint FROM f)"
ORACLES["fingerprint"] = f"WITH {F}, {MARKS} SELECT fingerprint, min(rule_id) AS rule_id, min(file_path) AS file_path FROM x GROUP BY fingerprint"
ORACLES["baseline_new"] = f"""
WITH {F}, {MARKS}
SELECT rule_id, count(*) AS n FROM x WHERE position % 20 >= 10 AND fingerprint NOT IN (SELECT fingerprint FROM x WHERE position % 20 < 10) GROUP BY rule_id"""
ORACLES["baseline_suppressed"] = f"""
WITH {F}, {MARKS}
SELECT count(*) AS suppressed FROM x WHERE position % 20 >= 10 AND fingerprint IN (SELECT fingerprint FROM x WHERE position % 20 < 10)"""
ORACLES["enrich_overlay"] = f"""
WITH {F},
o AS (
  SELECT {b._pick([r[0] for r in b.RULES], "p_partkey")} AS rule_id, CASE WHEN p_partkey % 2 = 0 THEN concat('use ', p_partkey % 5) ELSE '' END AS recommendation,
         concat('to ', p_partkey % 3) AS migration_target, concat('ref', p_partkey) AS ref
  FROM part WHERE p_partkey % 12 < 9 QUALIFY row_number() OVER (PARTITION BY 1 ORDER BY p_partkey DESC) = 1),
j AS (
  SELECT f.rule_id, CASE WHEN position % 3 = 0 THEN 'own' ELSE coalesce(o.recommendation, '') END AS recommendation, coalesce(o.migration_target, '') AS migration_target,
         coalesce(ref, '') AS refs, o.rule_id IS NOT NULL AS enriched
  FROM f LEFT JOIN o ON f.rule_id = o.rule_id)
SELECT rule_id, recommendation, migration_target, refs, enriched, count(*) AS n FROM j GROUP BY ALL""".replace("PARTITION BY 1", f"PARTITION BY {b._pick([r[0] for r in b.RULES], 'p_partkey')}")
ORACLES["blame_join"] = f"""
WITH {F},
bl AS (
  SELECT concat('src/m', o_orderkey % 97, '/f', o_custkey % 53, '.py') AS file_path, CAST(o_orderkey % 7 * 10 AS INTEGER) AS line_number, concat('a', max(o_custkey)) AS author, max(o_orderstatus) AS commit
  FROM orders GROUP BY 1, 2)
SELECT commit AS git_blame_commit, count(*) AS n, count(DISTINCT author) AS authors FROM f LEFT JOIN bl USING (file_path, line_number) GROUP BY commit"""

R = "WITH RECURSIVE " + E
ORACLES["direct_importers"] = f"{R} SELECT importee AS node, count(*) AS direct FROM e GROUP BY importee"
ORACLES["transitive_importers"] = f"{R} SELECT node, count(*) AS transitive, max(importer) AS last FROM t WHERE node <> importer GROUP BY node"
ORACLES["same_directory"] = f"{R} SELECT node, count(*) OVER (PARTITION BY regexp_replace(node, '/[^/]*$', '')) - 1 AS siblings FROM n"
REACH = """
reach AS (
  SELECT node, coalesce(direct, 0) AS direct, coalesce(transitive, 0) AS transitive, siblings, 3 * coalesce(transitive, 0) + coalesce(direct, 0) + siblings AS blast_radius, coalesce(affected, '') AS affected
  FROM (SELECT node, count(*) OVER (PARTITION BY regexp_replace(node, '/[^/]*$', '')) - 1 AS siblings FROM n)
  LEFT JOIN (SELECT importee AS node, count(*) AS direct FROM e GROUP BY importee) USING (node)
  LEFT JOIN (SELECT node, count(*) AS transitive, array_to_string(list_slice(list_sort(list(importer)), 1, 20), ',') AS affected FROM t WHERE node <> importer GROUP BY node) USING (node))"""
BAND = "CASE WHEN blast_radius >= 200 THEN 'Catastrophic' WHEN blast_radius >= 50 THEN 'High' WHEN blast_radius >= 10 THEN 'Medium' ELSE 'Low' END"
ORACLES["impact"] = f"{R}, {REACH} SELECT node, direct, transitive, siblings, blast_radius, {BAND} AS band, affected FROM reach"
ORACLES["graph_counts"] = f"{R} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges"

ITEMS = f"""{R}, {F}, {CLASSED}, {CARDS}, {REACH},
cl AS (SELECT module, algorithm_class, count(DISTINCT channel) AS corroboration, least(0.99, 1 - product(1 - least({CONF}, 1.0))) AS conf, array_to_string(list_sort(list(DISTINCT channel)), '+') AS channels
       FROM c WHERE algorithm_class <> '' GROUP BY ALL),
i0 AS (
  SELECT c.*, CASE WHEN algorithm_class = '' THEN {CONF} ELSE cl.conf END AS sure, CASE WHEN algorithm_class = '' THEN 1 ELSE cl.corroboration END AS corroboration,
         CASE WHEN algorithm_class = '' THEN c.channel ELSE cl.channels END AS channels, coalesce(reach.blast_radius, 0) AS blast_radius,
         CASE WHEN reach.node IS NOT NULL THEN CASE WHEN reach.blast_radius >= 200 THEN 'Catastrophic' WHEN reach.blast_radius >= 50 THEN 'High' WHEN reach.blast_radius >= 10 THEN 'Medium' ELSE 'Low' END END AS band,
         total_score
  FROM c LEFT JOIN cl USING (module, algorithm_class) LEFT JOIN reach ON reach.node = replace(c.module, 'm', 's/r') JOIN total USING (module)
  WHERE c.channel = 'ast'),
items AS (
  SELECT *, CAST(least(100, CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 20 WHEN 'medium' THEN 12 WHEN 'low' THEN 6 WHEN 'info' THEN 2 ELSE 6 END
    + least(25, CAST(round(sure * 20) AS INTEGER) + CASE WHEN corroboration > 1 THEN (corroboration - 1) * 3 ELSE 0 END)
    + CASE WHEN band = 'Catastrophic' OR (band IS NULL AND blast_radius >= 200) THEN 35 WHEN band = 'High' THEN 28 WHEN band = 'Medium' THEN 16 WHEN blast_radius > 0 THEN 5 ELSE 0 END
    + least(10, greatest(0, CAST(floor((100 - total_score) / 10) AS INTEGER)))) AS INTEGER) AS score FROM i0),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, blast_radius DESC, file_path, line_number, rule_id, finding_id) AS rank FROM items)"""
ORACLES["work_items"] = f"""{ITEMS}
SELECT finding_id, rank, score, CASE WHEN score >= 80 THEN 'Immediate' WHEN score >= 60 THEN 'Scheduled' WHEN score >= 40 THEN 'Backlog' ELSE 'Monitor' END AS priority_band,
       round(sure * 100) / 100 AS fused_confidence, corroboration, blast_radius, channels
FROM ranked"""
ORACLES["plan_summary"] = f"""{ITEMS}
SELECT count(*) AS total, count(*) FILTER (score >= 80) AS immediate, count(*) FILTER (corroboration >= 2) AS corroborated, count(*) FILTER (band IN ('High', 'Catastrophic')) AS high_reach,
       count(*) FILTER (severity = 'critical') AS critical, coalesce(max(score), 0) AS top_score
FROM items"""
ORACLES["plan_phases"] = f"""{ITEMS},
ph AS (SELECT rank, CASE WHEN score >= 80 OR corroboration >= 2 OR severity = 'critical' THEN 1 WHEN blast_radius >= 10 OR score >= 40 THEN 2 ELSE 3 END AS phase FROM ranked)
SELECT phase, ['Confirm', 'Isolate', 'Close'][phase] AS name, count(*) AS n, least(count(*) * 2, 60) AS effort_days, array_to_string(list_slice(list_sort(list(rank)), 1, 20), ',') AS ranks
FROM ph GROUP BY phase"""

ORACLES["snapshot_diff"] = """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS a, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderstatus END AS z FROM orders)
SELECT concat('o/', k, '.go') AS path, CASE WHEN k % 3 = 0 THEN 'new' WHEN k % 5 = 0 THEN 'removed' ELSE 'modified' END AS state
FROM o WHERE (k % 3 = 0 AND k % 5 <> 0) OR (k % 3 <> 0 AND k % 5 = 0) OR (k % 3 <> 0 AND k % 5 <> 0 AND a <> z)"""
ORACLES["importer_expansion"] = f"""
SELECT concat('lib/s', s_suppkey, '.py') AS path, {b._pick(["new", "modified", "removed"], "s_suppkey")} AS state FROM supplier
UNION ALL
SELECT DISTINCT concat('app/p', p_partkey, '.py'), 'modified' FROM part WHERE p_partkey % 300 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 2)"""
ORACLES["latest_scan"] = """
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
ORACLES["score_events"] = """
WITH a AS (SELECT concat('f', o_orderkey % 1000) AS fingerprint, max(o_custkey % 40) AS old_score FROM orders WHERE o_orderkey % 1000 < 700 GROUP BY 1),
z AS (SELECT concat('f', o_orderkey % 1000) AS fingerprint, max(o_custkey % 45) AS new_score FROM orders WHERE o_orderkey % 1000 >= 300 GROUP BY 1)
SELECT fingerprint, CASE WHEN old_score IS NULL THEN 'created' WHEN new_score IS NULL THEN 'resolved' ELSE 'updated' END AS event, old_score, new_score
FROM a FULL JOIN z USING (fingerprint) WHERE old_score IS DISTINCT FROM new_score"""

for name in ("score_events_stream", "score_history"):
    ORACLES[name] = f"""
WITH e AS (SELECT concat('u', user_id) AS fingerprint, epoch_ms(date_trunc('hour', ts)) AS at_ms, max(floor(value / 10)) AS score FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
u AS (SELECT epoch_ms(date_trunc('hour', max(ts))) - 5400000 AS until FROM events),
n AS (
  SELECT *, lag(at_ms) OVER w AS before, lag(score) OVER w AS old, lead(at_ms) OVER w AS after, at_ms + {b.PATIENCE_MS} AS gone
  FROM e, u WHERE at_ms < until WINDOW w AS (PARTITION BY fingerprint ORDER BY at_ms)),
k AS (SELECT *, before IS NULL OR at_ms > before + {b.PATIENCE_MS} AS fresh FROM n)
SELECT fingerprint, at_ms, CASE WHEN fresh THEN 'created' ELSE 'updated' END AS event, CASE WHEN NOT fresh THEN old END AS old_score, score AS new_score FROM k WHERE fresh OR score IS DISTINCT FROM old
UNION ALL
SELECT fingerprint, gone, 'resolved', score, NULL FROM k WHERE (after IS NULL OR after > gone) AND gone < until"""

TRUTH = f"""
i AS (
  SELECT concat('i', o_orderkey) AS id, lower(concat('SRC/m', o_custkey % 97, '/f', o_orderkey % 53, '.py')) AS file, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 7 * 10 + 2 END AS line,
         [{b._pick(b.LABELS[:10], "o_orderkey")}, {b._pick(["des-ede", "MD5", "DESede"], "o_custkey")}] AS labels, o_custkey % 2 = 0 AS severe, o_custkey % 3 = 0 AS risky,
         CASE WHEN o_custkey % 5 = 0 THEN 'ast' ELSE 'floor' END AS tier, {b._pick(["python", "go", "cobol"], "o_orderkey")} AS lang, CASE WHEN o_orderkey % 4 = 0 THEN 'PY_' ELSE '' END AS prefix
  FROM orders),
ix AS (SELECT DISTINCT id, file, line, severe, risky, prefix, CASE WHEN upper(regexp_replace(label, '[^A-Za-z0-9]', '', 'g')) = 'DESEDE' THEN '3DES' ELSE upper(regexp_replace(label, '[^A-Za-z0-9]', '', 'g')) END AS alg
       FROM (SELECT *, unnest(labels) AS label FROM i)),
g AS (SELECT *, lower(file_path) AS file, {ALNUM} AS alg, CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 5 END AS grank FROM f),
fb AS (
  SELECT lower(concat('SRC/m', o_custkey % 97, '/f', o_orderkey % 53, '.py')) AS file, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 * 10 END AS a,
         CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 5 * 10 + 20 WHEN o_orderkey % 3 = 2 THEN o_orderkey % 5 * 10 END AS z, concat('r', o_orderkey) AS reason, o_custkey % 2 = 0 AS lets, o_custkey % 4 = 0 AS capped
  FROM orders WHERE o_orderkey % 10 = 1),
inside AS (
  SELECT g.*, reason, lets AND quantum_safety = 'vulnerable' AND (NOT capped OR grank <= 2) AS tolerated
  FROM g JOIN fb USING (file) WHERE a IS NULL OR line_number BETWEEN a AND z)"""
ORACLES["gate_recall"] = f"""
WITH {F}, {TRUTH},
best AS (
  SELECT id, bool_or((NOT severe OR severity IN ('high', 'critical')) AND (NOT risky OR quantum_safety IN ('vulnerable', 'hybrid'))) AS ok
  FROM ix JOIN g USING (file, alg) WHERE starts_with(rule_id, prefix) AND (line IS NULL OR line_number BETWEEN line - 2 AND line + 2) GROUP BY id)
SELECT CASE WHEN tier = 'ast' AND lang NOT IN ('python', 'go') THEN 'skipped' WHEN ok THEN 'matched' WHEN NOT ok THEN 'mismatched' ELSE 'missed' END AS outcome, count(*) AS n
FROM i LEFT JOIN best USING (id) GROUP BY 1"""
ORACLES["gate_forbidden"] = f"""
WITH {F}, {TRUTH}
SELECT reason, count(*) AS n FROM inside WHERE NOT tolerated AND quantum_safety IN ('vulnerable', 'grover_weakened', 'classically_broken') GROUP BY reason"""
ORACLES["gate_precision"] = f"""
WITH {F}, {TRUTH}
SELECT rule_id, count(*) AS n FROM g
WHERE file NOT IN (SELECT lower(concat('SRC/m', o_custkey % 97, '/f', o_orderkey % 53, '.py')) FROM orders WHERE o_orderkey % 100 = 7)
  AND finding_id NOT IN (SELECT finding_id FROM inside WHERE tolerated)
  AND finding_id NOT IN (SELECT finding_id FROM ix JOIN g USING (file, alg) WHERE starts_with(rule_id, prefix))
GROUP BY rule_id"""

#: What the bound packages have: package, algorithms, severity, ready.
KNOWN = [
    ("cryptography", "RSA ECDSA AES SHA-256 SHA-1 HMAC X509", "info", False),
    ("PyCrypto", "RSA DES 3DES RC4 MD5 SHA-1", "high", False),
    ("rsa", "RSA", "medium", False),
    ("jsonwebtoken", "RSA ECDSA HMAC", "medium", False),
    ("node-forge", "RSA AES DES 3DES RC4 MD5 SHA-1 X509", "medium", False),
    ("golang.org/x/crypto", "AES CHACHA20 POLY1305 X25519 ED25519 SSH ARGON2", "info", False),
    ("github.com/cloudflare/circl", "ML-KEM ML-DSA SLH-DSA ECDSA ED25519", "info", True),
    ("filippo.io/age", "X25519 CHACHA20 POLY1305", "info", False),
]
_known = ", ".join(f"('{p}', '{a}', '{s}', {str(r).lower()})" for p, algs, s, r in KNOWN for a in algs.split())
ORACLES["sbom_fanout"] = f"""
WITH kb(package, algorithm, severity, ready) AS (VALUES {_known}),
p AS (SELECT {b._pick(b.PACKAGES, "p_partkey")} AS package, {b._pick(b.ECOSYSTEMS, "p_partkey")} AS ecosystem, concat('svc', p_partkey % 50, '/requirements.txt') AS manifest FROM part)
SELECT concat_ws('_', 'SBOM', upper(ecosystem), upper(regexp_replace(package, '[^A-Za-z0-9]', '_', 'g')), upper(regexp_replace(algorithm, '[^A-Za-z0-9]', '_', 'g'))) AS rule_id, algorithm,
       CASE WHEN ready THEN 'quantum_safe' WHEN algorithm IN ('MD5', 'SHA-1', 'RC4', 'DES') THEN 'classically_broken' WHEN algorithm = '3DES' THEN 'grover_weakened' ELSE 'vulnerable' END AS quantum_safety,
       severity, count(*) AS n, min(manifest) AS first
FROM p JOIN kb USING (package) GROUP BY ALL"""
ORACLES["manifest_requirements"] = """
WITH p AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS line FROM part)
SELECT concat(p_brand, '/requirements.txt') AS manifest, concat(CASE WHEN p_partkey % 5 = 1 THEN 'Pkg' ELSE 'pkg' END, p_partkey) AS package,
       CASE p_partkey % 5 WHEN 1 THEN concat('>= ', p_size) WHEN 3 THEN concat('==', p_size) ELSE '' END AS version, line
FROM p WHERE p_partkey % 5 IN (1, 2, 3)"""
ORACLES["manifest_go_mod"] = """
WITH p AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 2 AS INTEGER) AS line FROM part)
SELECT concat(p_brand, '/go.mod') AS manifest, concat('mod/', p_partkey) AS package, concat('v', p_size) AS version, line FROM p WHERE p_partkey % 3 <> 0
UNION ALL
SELECT concat(p_brand, '/go.mod'), 'last/one', 'v9', CAST(max(line) + 2 AS INTEGER) FROM p GROUP BY p_brand"""

_weak = {"TLS_RSA_WITH_RC4_128_SHA": ("RC4", "critical", "classically_broken"), "TLS_RSA_WITH_3DES_EDE_CBC_SHA": ("3DES", "critical", "grover_weakened"), "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA": ("CBC", "medium", "vulnerable"), "TLS_RSA_WITH_NULL_SHA": ("NULL", "critical", "classically_broken")}
ORACLES["tls_findings"] = f"""
WITH o AS (
  SELECT c_custkey AS k, concat('h', c_custkey, '.example:443') AS file_path, {b._pick(b.TLS_CIPHERS, "c_custkey")} AS cipher, {b._pick(b.TLS_KEYS, "c_custkey")} AS key, 1024 + c_custkey % 3 * 1024 AS bits,
         {b._pick(b.TLS_SIGNATURES, "c_custkey")} AS sig, c_custkey % 60 - 10 AS days FROM customer)
SELECT file_path, 'TLS_VERSION_TLS10' AS rule_id, 'TLS 1.0' AS algorithm, 'critical' AS severity, 'vulnerable' AS quantum_safety, 'weak-protocol' AS category, 'server accepts TLS 1.0' AS snippet FROM o WHERE k % 4 = 0
UNION ALL SELECT file_path, 'TLS_VERSION_TLS11', 'TLS 1.1', 'high', 'vulnerable', 'weak-protocol', 'server accepts TLS 1.1' FROM o WHERE k % 3 = 0
{"".join(f" UNION ALL SELECT file_path, 'TLS_WEAK_CIPHER', '{a}', '{s}', '{q}', 'weak-cipher', cipher FROM o WHERE cipher = '{n}'" for n, (a, s, q) in _weak.items())}
UNION ALL SELECT file_path, 'TLS_CERT_CLASSICAL_KEY', key, 'high', 'vulnerable', 'crypto-api', concat(key, ' leaf key') FROM o WHERE key <> 'Ed25519'
UNION ALL SELECT file_path, 'TLS_CERT_RSA_WEAK', concat('RSA-', bits), 'critical', 'vulnerable', 'weak-key-size', concat('RSA-', bits) FROM o WHERE key = 'RSA' AND bits < 2048
UNION ALL SELECT file_path, 'TLS_CERT_SHA1_SIG', sig, 'high', 'vulnerable', 'weak-hash', sig FROM o WHERE sig = 'SHA1-RSA'
UNION ALL SELECT file_path, 'TLS_CERT_EXPIRED', '', 'critical', 'unknown', 'cert-validation', 'expired' FROM o WHERE days <= 0
UNION ALL SELECT file_path, 'TLS_CERT_EXPIRING', '', CASE WHEN days < 7 THEN 'critical' ELSE 'high' END, 'unknown', 'cert-validation', 'expiring' FROM o WHERE days > 0 AND days < 30
UNION ALL SELECT file_path, 'TLS_CERT_SELF_SIGNED', sig, 'medium', 'unknown', 'cert-validation', 'self-signed' FROM o WHERE k % 7 = k % 5"""

ORACLES["token_costs"] = f"""
WITH e AS (SELECT event_id, {b._pick(["gpt-4o-mini-2024", "GPT-4o", "claude-opus-x", "other"], "event_id")} AS model, event_id % 5000 AS i, event_id % 777 AS o FROM events)
SELECT event_id, CAST(round_even(CAST(CASE model WHEN 'gpt-4o-mini-2024' THEN i * 150 + o * 600 WHEN 'GPT-4o' THEN i * 2500 + o * 10000 WHEN 'claude-opus-x' THEN i * 15000 + o * 75000 ELSE i * 1000 + o * 3000 END AS DOUBLE) / 1000, 0) / 1e6 AS DOUBLE) AS cost FROM e"""
LEVELS = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"
ORACLES["report_rules"] = f"""
WITH {F}, last AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY file_path DESC, line_number DESC, "column" DESC, finding_id DESC) = 1)
SELECT rule_id, concat('found ', algorithm) AS text, {LEVELS} AS level, {case("severity", {"critical": "9.5", "high": "8.1", "medium": "5.5", "low": "3.0"}, "1.0")} AS security_severity,
       concat('security cryptography', CASE quantum_safety WHEN 'vulnerable' THEN ' pqc quantum-vulnerable' WHEN 'grover_weakened' THEN ' pqc grover-weakened' WHEN 'classically_broken' THEN ' classically-broken' ELSE '' END, ' external/cwe/cwe-327') AS tags
FROM last"""
ORACLES["report_results"] = f"WITH {F} SELECT rule_id AS \"ruleId\", {LEVELS} AS level, count(*) AS n, max(line_number) AS last_line FROM f GROUP BY ALL"
ORACLES["report_documents"] = f"""
WITH {F}, r AS (
  SELECT *, CAST(list_position(['critical', 'high', 'medium', 'low', 'info', 'odd'], severity) - 1 AS INTEGER) * 3 AS head, CASE severity WHEN 'odd' THEN 'other' ELSE severity END AS section,
         concat('use of <', algorithm, '> & more') AS message, concat('use of &lt;', algorithm, '&gt; &amp; more') AS escaped
  FROM f),
s AS (SELECT head, section, count(*) AS n FROM r GROUP BY ALL),
l AS (
  SELECT 'text' AS form, -1 AS part, string_agg(concat(section, ': ', n), '  ' ORDER BY head) AS line FROM s
  UNION ALL SELECT 'text', head + 1, concat('[', severity, '] ', file_path, ':', line_number, ' ', rule_id, ' ', message) FROM r
  UNION ALL SELECT 'markdown', -1, '# Cryptography findings'
  UNION ALL SELECT 'markdown', head, concat(chr(10), '## ', upper(section[1]), section[2:], ' (', n, ')', chr(10), chr(10), '| Rule | Place | Algorithm | Message |', chr(10), '|---|---|---|---|') FROM s
  UNION ALL SELECT 'markdown', head + 1, concat('| ', rule_id, ' | `', file_path, ':', line_number, '` | ', algorithm, ' | ', message, ' |') FROM r
  UNION ALL SELECT 'html', -1, '<!doctype html><meta charset=''utf-8''><title>Cryptography findings</title>'
  UNION ALL SELECT 'html', head, concat('<h2>', section, ' (', n, ')</h2><table>') FROM s
  UNION ALL SELECT 'html', head + 1, concat('<tr><td>', rule_id, '</td><td>', file_path, '</td><td>', line_number, '</td><td>', algorithm, '</td><td>', escaped, '</td></tr>') FROM r
  UNION ALL SELECT 'html', head + 2, '</table>' FROM s
  UNION ALL SELECT * FROM (VALUES ('json', -1, '['), ('json', 0, chr(123)), ('json', 99, ']'), ('sarif', -1, chr(123)), ('sarif', 0, chr(123)), ('sarif', 1, ']'), ('sarif', 2, chr(123)), ('sarif', 99, ']'))
  UNION ALL SELECT 'json', 0, ',' FROM (SELECT 1 FROM f OFFSET 1)
  UNION ALL SELECT 'sarif', 2, ',' FROM (SELECT 1 FROM f OFFSET 1)
  UNION ALL SELECT 'sarif', 0, ',' FROM (SELECT DISTINCT rule_id FROM f OFFSET 1)
  UNION ALL SELECT 'jsonl', 0, chr(123) FROM f)
SELECT form, CAST(part AS INTEGER) AS part, line, count(*) AS n FROM l GROUP BY ALL"""
ORACLES["readiness"] = f"""
WITH {F}, r AS (SELECT module, count(*) AS n, count(*) FILTER (quantum_safety IN ('hybrid', 'quantum_safe', 'unknown')) AS ready FROM f GROUP BY module)
SELECT module, n, ready, round(ready / n * 1e6) / 1e6 AS readiness, 3 AS rank FROM r"""

ORACLES["structural_match"] = """
WITH p AS (SELECT concat('MD5_', ['python', 'go', 'java'][p_partkey % 3 + 1]) AS rule_id, p_partkey % 4 = 0 AS noted FROM part)
SELECT rule_id, 1 AS line_number, 0 AS match_ordinal, 5 AS "column", count(*) AS n FROM p GROUP BY rule_id
UNION ALL SELECT rule_id, 2, 0, 5, count(*) FROM p WHERE NOT noted GROUP BY rule_id
UNION ALL SELECT rule_id, 2, 1, 13, count(*) FROM p WHERE NOT noted GROUP BY rule_id"""
ORACLES["x509_scan"] = """
WITH k AS (SELECT concat('k', s_suppkey) AS file_path, ['RSA', 'ECDSA', 'DSA', '', 'SSH', ''][s_suppkey % 6 + 1] AS algorithm, CAST(s_suppkey % 3 + 1 AS INTEGER) AS line_number FROM supplier)
SELECT file_path, concat('X509_PRIVATE_KEY_', algorithm) AS rule_id, algorithm, line_number, 'critical' AS severity FROM k WHERE algorithm <> ''"""

ORACLES["manifest_projects"] = """
WITH w(n, name, ecosystem, package, version, line) AS (VALUES
  (0, 'Pipfile', 'python', 'pkg{k}', '*', 4), (0, 'Pipfile', 'python', 'Quoted', '==1.{k}', 5), (0, 'Pipfile', 'python', 'dev', '>=2', 9),
  (1, 'pyproject.toml', 'python', 'alpha{k}', '>=1.0', 4), (1, 'pyproject.toml', 'python', 'beta', '== 2', 5), (1, 'pyproject.toml', 'python', 'gamma', '^{k}', 9),
  (2, 'package.json', 'javascript', 'left{k}', '^1.0', 3), (2, 'package.json', 'javascript', 'jest', '29', 5))
SELECT concat('m', s_suppkey, '/', name) AS manifest, ecosystem, replace(package, '{k}', CAST(s_suppkey AS VARCHAR)) AS package, replace(version, '{k}', CAST(s_suppkey AS VARCHAR)) AS version, line
FROM supplier JOIN w ON s_suppkey % 3 = n"""
ORACLES["graph_build"] = """
WITH s AS (SELECT s_suppkey AS k FROM supplier),
e AS (
  SELECT 'lib/s' AS a, '.py' AS z, k, k + 1 AS other FROM s WHERE k % 4 = 0
  UNION ALL SELECT 'lib/s', '.py', k, k + unnest([2, 3]) FROM s WHERE k % 4 = 1
  UNION ALL SELECT 'lib/s', '.py', k, k - 1 FROM s WHERE k % 4 = 2
  UNION ALL SELECT 'web/j', '.ts', k, k + 1 FROM s
  UNION ALL SELECT 'pkg/g', '/m.go', k, k + 1 FROM s)
SELECT concat(a, e.k, z) AS importer, concat(a, other, z) AS importee FROM e JOIN s ON s.k = other"""

ORACLES["recent_scans"] = "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50"

_PLACES = ", ".join(f"({n}, '{lang}-{n}', {line}, {column})" for n, (lang, _, _, places) in enumerate(b.STRUCTURES) for line, column in places)
ORACLES["structure_of_languages"] = f"""
WITH e(n, rule_id, line_number, col) AS (VALUES {_PLACES}),
c AS (SELECT p_partkey % {len(b.STRUCTURES)} AS n, count(*) AS n_files FROM part GROUP BY ALL)
SELECT rule_id, CAST(line_number AS INTEGER) AS line_number, CAST(col AS INTEGER) AS "column", n_files FROM e JOIN c USING (n)"""

ORACLES["incremental_scan"] = f"""
WITH {D}, {rules(ALL_RULES)},
k AS (SELECT path, CAST(regexp_extract(path, 'doc_(\\d+)', 1) AS BIGINT) % 100 AS k FROM d),
f AS (
  SELECT rule_id, path, len(regexp_extract_all(line, pattern)) AS n FROM l JOIN rules ON regexp_matches(line, pattern)
  UNION ALL SELECT 'DOC_LICENSE', path, 1 FROM k WHERE k = 7)
SELECT rule_id AS what, CAST(sum(n) AS BIGINT) AS n FROM f JOIN k USING (path) WHERE k <> 8 GROUP BY rule_id
UNION ALL SELECT 'listed', count(*) FROM k WHERE k <> 8
UNION ALL SELECT 'read', count(*) FROM k WHERE k IN (7, 9, 11)
UNION ALL SELECT 'scanned', count(*) FROM k WHERE k IN (7, 11)
UNION ALL SELECT 'gone', count(*) FROM k WHERE k = 8"""

ORACLES["scans_are_kept_once"] = f"""
WITH {F}
SELECT concat('s', position % 4) AS scan_run_id, count(*) AS n, count(DISTINCT finding_id) AS n_ids, CAST(0 AS BIGINT) AS n_unseen FROM f WHERE position % 4 <> 2 GROUP BY ALL"""

ORACLES["blame_of_versions"] = """
WITH o AS (SELECT o_orderkey AS k, o_custkey % 60 AS f, year(o_orderdate) AS y FROM orders),
t AS (SELECT f, max(v) AS last FROM o, range(1995, 2002) r(v) WHERE v >= y AND (k % 3 <> 0 OR v - y NOT BETWEEN 3 AND 4) GROUP BY f),
n AS (SELECT o.*, CASE WHEN k % 3 = 0 AND last - y > 4 THEN y + 5 ELSE y END AS since FROM o JOIN t USING (f) WHERE last >= y AND (k % 3 <> 0 OR last - y NOT BETWEEN 3 AND 4))
SELECT 'f' || f AS path, CAST(row_number() OVER (PARTITION BY f ORDER BY k) AS INTEGER) AS line, 'a' || (since % 3) AS author, 'c' || since AS commit FROM n"""

ORACLES["renamed_files"] = """
WITH d AS (SELECT doc_id % 5 AS k, CAST(doc_id AS VARCHAR) AS id, replace(coalesce(text, ''), ' ', chr(10)) AS text FROM documents),
b AS (SELECT 'a/' || id AS path, text FROM d WHERE k <> 4),
a AS (
  SELECT CASE k WHEN 0 THEN 'b/' WHEN 4 THEN 'c/' ELSE 'a/' END || id AS path,
         CASE k WHEN 0 THEN 'moved' || chr(10) || text WHEN 1 THEN text || chr(10) || 'more' ELSE text END AS text
  FROM d WHERE k <> 3),
s AS (SELECT path, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(rtrim(x, chr(13)))), lambda x: x <> '')) AS lines, side
      FROM (SELECT *, 'b' AS side FROM b WHERE path NOT IN (SELECT path FROM a) UNION ALL SELECT *, 'a' FROM a WHERE path NOT IN (SELECT path FROM b))),
l AS (SELECT side, path, len(lines) AS n, unnest(lines) AS line FROM s),
p AS (SELECT x.path AS source, y.path, any_value(x.n) AS nx, any_value(y.n) AS ny, count(*) AS c FROM l x JOIN l y ON x.side = 'b' AND y.side = 'a' AND x.line = y.line GROUP BY ALL),
r AS (SELECT path, source, c / (nx + ny - c) AS similarity FROM p WHERE c / (nx + ny - c) >= 0.5 QUALIFY row_number() OVER (PARTITION BY path ORDER BY similarity DESC, source) = 1)
SELECT path, 'renamed' AS state, source, round(similarity * 1e6) / 1e6 AS similarity FROM r
UNION ALL SELECT path, CASE side WHEN 'a' THEN 'new' ELSE 'removed' END, NULL, NULL FROM s WHERE path NOT IN (SELECT path FROM r) AND path NOT IN (SELECT source FROM r)
UNION ALL SELECT a.path, 'modified', NULL, NULL FROM a JOIN b USING (path) WHERE a.text <> b.text"""

_FACETS = {"severity": "severity IN ('high', 'critical')", "algorithm": "algorithm <> 'MD5'", "channel": "true", "module": "module IN (" + ", ".join(f"'m{i}'" for i in range(0, 97, 4)) + ")"}
ORACLES["facets_in_one_pass"] = f"WITH {F} " + " UNION ALL ".join(
    f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM f WHERE {' AND '.join(w for o, w in _FACETS.items() if o != c)} GROUP BY ALL" for c in _FACETS
)

ORACLES["gate_hot_file"] = f"""
WITH {F},
h AS (SELECT position % 100000 AS line FROM f WHERE position % 3 = 0),
r AS (SELECT o_orderkey * 7 % 100000 AS low, CASE WHEN o_orderkey % 500 = 0 THEN 20000 WHEN o_orderkey % 50 = 0 THEN 300 ELSE o_orderkey % 7 END AS wide, concat('r', o_orderkey % 100) AS reason
      FROM orders WHERE o_orderkey % 4 = 0)
SELECT reason, count(*) AS n FROM h JOIN r ON line BETWEEN low AND low + wide GROUP BY reason"""

_TEN = "[" + ", ".join(f"'{x}'" for x in b.LABELS[:10]) + "]"
ORACLES["gate_dependencies"] = f"""
WITH found AS (SELECT DISTINCT p_partkey % 20 AS m, p_partkey % 30 AS p, {_TEN}[p_partkey % 10 + 1] AS label FROM part),
s AS (SELECT s_suppkey AS s, s_suppkey % 20 AS m, s_suppkey % 30 AS p FROM supplier),
w AS (SELECT *, unnest([{_TEN}[s % 10 + 1], 'quux']) AS label FROM s WHERE s % 3 <> 0),
x AS (SELECT m, p, 'missing ' || label AS problem FROM w WHERE NOT EXISTS (SELECT 1 FROM found WHERE found.m = w.m AND found.p = w.p AND found.label = w.label)
      UNION ALL SELECT m, p, 'must not be flagged' FROM s WHERE s % 3 = 0 AND EXISTS (SELECT 1 FROM found WHERE found.m = s.m AND found.p = s.p))
SELECT problem, count(*) AS n, count(DISTINCT (m, p)) AS n_packages FROM x GROUP BY problem"""

ORACLES["rule_defaults"] = """
SELECT CASE WHEN p_partkey % 3 = 0 THEN 'hybrid' WHEN p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN 'quantum_safe' ELSE 'vulnerable' END AS safety,
       CAST(CASE WHEN p_partkey % 4 IN (0, 1) THEN CASE WHEN p_partkey % 7 = 0 THEN 0.95 ELSE 0.7 END ELSE p_partkey % 4 * 0.25 - 0.25 END AS DOUBLE) AS confidence, count(*) AS n
FROM part GROUP BY ALL"""

ORACLES["channels_together"] = f"""
WITH {F.replace("END AS channel", "END AS flag")}
SELECT ['ast', 'sbom', 'tls'][position % 3 + 1] AS channel, severity, count(*) AS n, count(key_size) FILTER (position % 3 <> 1) AS n_sized, count(line_number) FILTER (position % 3 <> 2) AS n_placed
FROM f GROUP BY ALL"""

ORACLES["rules_tested_by_examples"] = f"""
WITH {rules(ALL_RULES)},
o AS (SELECT rule_id, pattern, row_number() OVER () - 1 AS n FROM rules),
e AS (SELECT DISTINCT p_partkey % {len(ALL_RULES)} AS n, p_partkey % 2 = 0 AS expected,
        CASE WHEN p_partkey % 3 = 0 THEN 'key = "x" for the a.b@c.de at 10.0.0.1 of 123456789012 ### licensed under' ELSE concat('plain ', p_partkey) END AS text FROM part)
SELECT rule_id, CASE WHEN expected THEN 'should match' ELSE 'should not match' END AS what, count(*) AS n
FROM e JOIN o USING (n) WHERE n < 5 AND regexp_matches(text, pattern) <> expected GROUP BY ALL
UNION ALL SELECT 'DOC_EN', 'without examples', 1 UNION ALL SELECT 'DOC_TOKEN', 'has examples now', 1"""

ORACLES["tls_targets"] = r"""
WITH t AS (
  SELECT c_custkey AS k, c_custkey % 50 AS d, c_custkey % 3 AS h, c_custkey % 5 AS p FROM customer)
SELECT CASE h WHEN 0 THEN 'h' || d WHEN 1 THEN '2001:db8::' || d ELSE 'a.example-' || d END AS host,
       CAST(CASE p WHEN 0 THEN 8443 ELSE 443 END AS INTEGER) AS port, count(*) AS n
FROM t GROUP BY ALL"""
