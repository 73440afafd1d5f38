"""Rule scan queries. The SQL side tries the same rules with RE2."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitstrata.functions.common import joined
from gitstrata.operators import deps
from gitstrata.operators import models
from gitstrata.operators import scan as ops
from gitstrata.plans.deps_plans import DEPS
from gitstrata.plans.registry import query
from gitstrata.rules import patterns as pr
from gitstrata.rules import security as sr
from gitstrata.session import shared_folder, written
from gitstrata.sources.tree import read_tree


def lit(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def re2(rule_or_rx, ignore_case=None) -> str:
    rx = rule_or_rx if isinstance(rule_or_rx, str) else rule_or_rx.regex
    case = rule_or_rx.ignore_case if ignore_case is None else ignore_case
    return f"(?m{'i' if case else ''})" + rx.replace("\\w", "[\\p{L}\\p{N}_]")


def without_look(r) -> tuple[str, str | None, str | None]:
    """The expression as RE2 can read it, and what must hold of the text after its match: ``(expression, scope, test)``.

    ``A(?!.*B)``: no B in the rest of the line; ``A(?![\\s\\S]*B)``: no B in the rest of the
    text; ``A(?!B)``: no B right there. A back-reference names a function that its own body calls again.
    """
    flag = "(?i)" if r.ignore_case or r.regex.startswith("(?i)") else ""
    if "\\1" in r.regex:
        return r.regex[: r.regex.index("\\s*[^")], "again", flag
    if "(?!" not in r.regex:
        return r.regex, None, None
    head, tail = r.regex.split("(?!")
    tail = tail[:-1]
    for start, scope in ((".*", "line"), ("[\\s\\S]*", "text")):
        if tail.startswith(start):
            return head, scope, flag + tail[len(start) :]
    return head, "text", f"{flag}\\A{tail}"


# The match that ends where the line goes on may also give back what it took of later lines.
HOLDS = r"""CASE scope WHEN 'text' THEN NOT regexp_matches(rest, test) WHEN 'line' THEN contains(split_part(m[k], '(', 2), chr(10)) OR NOT regexp_matches(split_part(rest, chr(10), 1), test)
  WHEN 'again' THEN regexp_matches(rest, test || '\A' || CASE WHEN starts_with(lower(m[k]), 'def') THEN '\s*[^{]*' ELSE '\s*[^}]*' END || 'return.*' || regexp_extract(m[k], '^\w+\s+([\p{L}\p{N}_]+)', 1) || '\s*[(]') ELSE true END"""


def rule_values(rules) -> str:
    rows = ", ".join(
        f"({i}, {lit(r.family)}, {lit(r.name)}, {lit(r.severity)}, {lit(r.category)}, {lit(r.owasp)}, {r.confidence if r.confidence is not None else 'NULL'}::DOUBLE, {str(r.auto_fixable).lower()}, {lit(r.id_prefix)})"
        for i, r in enumerate(rules)
    )
    return f"r(number, family, name, severity, category, owasp, fixed, auto_fixable, id_prefix) AS (VALUES {rows})"


def hits(rules) -> str:
    """Matches of each rule in each file; one branch per rule keeps the expressions constant."""
    out = []
    for i, r in enumerate(rules):
        gate = f"language IN ({', '.join(lit(x) for x in r.languages)}) AND " if r.languages else ""
        head, scope, test = without_look(r)
        rx = lit(re2(head, r.ignore_case))
        out.append(f"SELECT repository_id, path, content, {i} AS number, {lit(scope)} AS scope, {lit(test)} AS test, regexp_extract_all(content, {rx}) AS m, string_split_regex(content, {rx}) AS p FROM f_code WHERE {gate}regexp_matches(content, {rx})")
    return "h AS (" + " UNION ALL ".join(out) + ")"


NL = "length({x}) - length(replace({x}, chr(10), ''))"


def findings_sql(rules, kind: str) -> str:
    if kind == "security":
        score = """0.7::DOUBLE + CASE WHEN contains(ll, 'password') AND contains(name, 'hardcoded') THEN 0.2 ELSE 0.0 END + CASE WHEN contains(ll, 'admin') AND contains(name, 'auth') THEN 0.2 ELSE 0.0 END
 + CASE WHEN contains(ll, 'secret') OR contains(ll, 'key') OR contains(ll, 'token') THEN 0.1 ELSE 0.0 END - CASE WHEN regexp_matches(line, '^\\s*(#|//|/\\*|\\*)') THEN 0.3 ELSE 0.0 END - CASE WHEN regexp_matches(line, '^\\s*["'']') THEN 0.2 ELSE 0.0 END"""
        key = "left(md5(name || ':' || path || ':' || line_number), 12)"
    else:
        score = """0.7::DOUBLE + CASE WHEN contains(ll, 'for') AND contains(name, 'loop') THEN 0.2 ELSE 0.0 END + CASE WHEN contains(ll, 'async') AND contains(name, 'blocking') THEN 0.1 ELSE 0.0 END
 - CASE WHEN regexp_matches(line, '^\\s*(#|//|/\\*|\\*)') THEN 0.4 ELSE 0.0 END"""
        key = "id_prefix || name || '_' || path || '_' || line_number"
    return f"""
WITH {rule_values(rules)}, {hits(rules)}, hits AS (SELECT * FROM h JOIN r USING (number)),
 ks AS (SELECT *, unnest(generate_series(1, len(m))) AS k FROM hits),
 bs AS (SELECT *, array_to_string(list_concat(p[1:k], m[1:k - 1]), '') AS before FROM ks),
 rs AS (SELECT *, substr(content, length(before) + length(m[k]) + 1) AS rest FROM bs),
 ln AS (SELECT *, CAST(1 + {NL.format(x='before')} AS INTEGER) AS line_number FROM rs WHERE {HOLDS}),
 fs AS (SELECT *, string_split(content, chr(10))[line_number] AS line, lower(line) AS ll FROM ln),
 findings AS (SELECT {key} AS finding_id, repository_id, path, line_number, number AS rule_number, family, name, severity, category, owasp, auto_fixable, trim(line) AS snippet,
  round(coalesce(fixed, least(1.0, greatest(0.1, {score}))), 9) AS confidence FROM fs)
"""


SEC, PERF = ops.security_rules(), ops.performance_rules()
SHOWN = "finding_id, repository_id, path, line_number, family, name, severity, category, snippet, confidence, auto_fixable"


def text_files(t):
    """The documents as files."""
    return t.documents.select(F.col("source").alias("repository_id"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.col("lang").alias("language"))


TEXT_FILES = "SELECT source AS repository_id, CAST(doc_id AS VARCHAR) AS path, text AS content, lang AS language FROM documents"


def shown(df):
    return df.select(*[F.round("confidence", 9).alias("confidence") if c == "confidence" else c for c in SHOWN.split(", ")])


@query("security_scan", findings_sql(SEC, "security") + f"SELECT {SHOWN} FROM findings", "f_code")
def _(t):
    return shown(ops.scan(t.f_code, SEC))


@query("security_findings_deduped", findings_sql(SEC, "security") + "SELECT finding_id, count(*) > 0 AS present, min(name) AS name, min(line_number) AS line_number FROM findings GROUP BY 1", "f_code")
def _(t):
    return ops.scan(t.f_code, SEC, dedupe=True).select("finding_id", F.lit(True).alias("present"), "name", "line_number")


@query("performance_scan", findings_sql(PERF, "performance") + f"SELECT {SHOWN} FROM findings", "f_code")
def _(t):
    return shown(ops.scan(t.f_code, PERF, "performance"))


SECRETS = [r for r in SEC if r.name == "hardcoded_secrets"]


@query("secret_scan_documents", f"""
WITH h AS (SELECT doc_id, {" + ".join(f"len(regexp_extract_all(text, {lit(re2(r))}))" for r in SECRETS)} AS findings FROM documents) SELECT doc_id, findings FROM h WHERE findings > 0""")
def _(t):
    return ops.scan(text_files(t), SECRETS).groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("findings"))


@query("finding_fixes", findings_sql(SEC, "security") + """
SELECT name, severity, CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS estimated_impact,
 CASE name WHEN 'debug_code' THEN 'remove the debug statement or guard it' WHEN 'weak_crypto' THEN 'use SHA-256 or stronger' WHEN 'hardcoded_secrets' THEN 'keep secrets in the environment or a vault' END AS fix_suggestion, count(*) AS n FROM findings GROUP BY ALL""", "f_code")
def _(t):
    return ops.with_fix(ops.scan(t.f_code, SEC)).groupBy("name", "severity", "estimated_impact", "fix_suggestion").agg(F.count("*").alias("n"))


WEIGHT = "CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 1 END"


@query("security_report", findings_sql(SEC, "security") + f""",
 s AS (SELECT repository_id, count(*) AS total_vulnerabilities, sum({WEIGHT}) AS penalty, count(*) FILTER (auto_fixable) AS auto_fixable_count,
  {", ".join(f"count(*) FILTER (severity = '{s}') AS severity_{s}" for s in sr.SEVERITIES)}, {", ".join(f"count(*) FILTER (category = '{c}') AS category_{c}" for c in sr.CATEGORIES)} FROM findings GROUP BY 1)
SELECT repository_id, coalesce(total_vulnerabilities, 0) AS total_vulnerabilities, coalesce(auto_fixable_count, 0) AS auto_fixable_count, CAST(greatest(0, 100 - coalesce(penalty, 0)) AS BIGINT) AS overall_score,
 CASE WHEN severity_critical > 0 THEN 'critical' WHEN severity_high > 2 THEN 'high' WHEN severity_high > 0 OR severity_medium > 3 THEN 'medium' ELSE 'low' END AS risk_level,
 {", ".join(f"coalesce(severity_{s}, 0) AS severity_{s}" for s in sr.SEVERITIES)}, {", ".join(f"coalesce(category_{c}, 0) AS category_{c}" for c in sr.CATEGORIES)}
FROM (SELECT DISTINCT source AS repository_id FROM documents) LEFT JOIN s USING (repository_id)""", "f_code")
def _(t):
    return ops.security_report(t.f_code, ops.scan(t.f_code, SEC))


@query("owasp_coverage", findings_sql(SEC, "security") + "SELECT repository_id, owasp, count(*) AS findings FROM findings WHERE owasp IS NOT NULL GROUP BY 1, 2", "f_code")
def _(t):
    return ops.owasp_coverage(ops.scan(t.f_code, SEC))


@query("performance_metrics", findings_sql(PERF, "performance") + f""",
 s AS (SELECT repository_id, count(*) AS total_issues, sum({WEIGHT}) AS penalty, {", ".join(f"coalesce(sum({WEIGHT}) FILTER (category = '{c}'), 0) AS p_{c}" for c in ("algorithmic", "memory", "io", "concurrency", "resource_management"))},
  count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium FROM findings GROUP BY 1)
SELECT repository_id, coalesce(total_issues, 0) AS total_issues, coalesce(critical, 0) AS critical_issues, coalesce(high, 0) AS high_priority_issues,
 CASE WHEN total_issues IS NULL THEN 95.0::DOUBLE ELSE greatest(0.0, 100.0 - penalty)::DOUBLE END AS overall_score,
 {", ".join(f"CASE WHEN total_issues IS NULL THEN 95.0::DOUBLE ELSE greatest(0.0, 100.0 - p_{c})::DOUBLE END AS {c}_score" for c in ("algorithmic", "memory", "io", "concurrency", "resource_management"))},
 CASE WHEN critical > 0 OR high > 2 THEN 'high' WHEN high > 0 OR medium > 3 THEN 'medium' ELSE 'low' END AS estimated_impact
FROM (SELECT DISTINCT source AS repository_id FROM documents) LEFT JOIN s USING (repository_id)""", "f_code")
def _(t):
    return ops.performance_metrics(t.f_code, ops.scan(t.f_code, PERF, "performance"))


@query("performance_counts", findings_sql(PERF, "performance") + f"""
SELECT repository_id, {", ".join(f"count(*) FILTER (category = '{c}') AS category_{c}" for c in ops.perf_rules.CATEGORIES)},
 {", ".join(f"count(*) FILTER (severity = '{s}') AS severity_{s}" for s in sr.SEVERITIES)}, count(*) FILTER (auto_fixable) AS auto_fixable_issues FROM findings GROUP BY 1""", "f_code")
def _(t):
    return ops.performance_counts(ops.scan(t.f_code, PERF, "performance"))


@query("top_issues", findings_sql(PERF, "performance") + f"""
SELECT repository_id, path, line_number, name, severity, CAST(row_number() OVER (PARTITION BY repository_id ORDER BY {WEIGHT} DESC, path, line_number, rule_number, snippet) AS INTEGER) AS position FROM findings QUALIFY position <= 10""", "f_code")
def _(t):
    return ops.top_issues(ops.scan(t.f_code, PERF, "performance")).select("repository_id", "path", "line_number", "name", "severity", "position")


LINES = ops.line_pattern_rules()


def title(name):
    return name.replace("_", " ").title()


LINE_SQL = f"""
WITH r(number, pattern_name, category, confidence, severity) AS (VALUES {", ".join(f"({i}, {lit(title(r.name))}, {lit(r.category)}, {r.confidence}::DOUBLE, {lit(r.severity)})" for i, r in enumerate(LINES))}),
 pairs AS ({" UNION ALL ".join(f"SELECT repository_id, path, content, {i} AS number FROM f_code WHERE regexp_matches(content, {lit(re2(r))})" for i, r in enumerate(LINES))}),
 l AS (SELECT repository_id, path AS file_path, number, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_number FROM (SELECT repository_id, path, number, string_split(content, chr(10)) AS ls FROM pairs)),
 hl AS ({" UNION ALL ".join(f"SELECT * FROM l WHERE number = {i} AND regexp_matches(line, {lit(re2(r))})" for i, r in enumerate(LINES))}),
 hit AS (SELECT repository_id, file_path, CAST(line_number AS INTEGER) AS line_number, number, pattern_name, category, confidence, severity, left(trim(line), 100) AS snippet FROM hl JOIN r USING (number))
"""


@query("line_patterns", LINE_SQL + "SELECT repository_id, file_path, line_number, pattern_name, category, confidence, severity, snippet FROM hit", "f_code")
def _(t):
    return ops.scan_lines(t.f_code).drop("rule_number", "family")


@query("dedupe_matches", LINE_SQL + """
SELECT repository_id, file_path, line_number, pattern_name, category, confidence FROM hit QUALIFY row_number() OVER (PARTITION BY repository_id, pattern_name, file_path, line_number ORDER BY confidence DESC, number) = 1""", "f_code")
def _(t):
    return ops.dedupe_matches(ops.scan_lines(t.f_code)).select("repository_id", "file_path", "line_number", "pattern_name", "category", "confidence")


@query("pattern_rollup", LINE_SQL + """
SELECT repository_id, lower(replace(pattern_name, ' ', '_')) AS pattern, count(*) AS occurrences, max(confidence) AS confidence, max_by(category, (confidence, category)) AS category, count(DISTINCT file_path) AS files FROM hit GROUP BY 1, 2""", "f_code")
def _(t):
    return models.pattern_rollup(ops.scan_lines(t.f_code))


def evidence_hits() -> str:
    out = []
    for pattern, lang, expressions in pr.DESIGN_EVIDENCE:
        for rx in expressions:
            out.append(f"SELECT repository_id, path, {lit(pattern)} AS pattern, {lit(rx)} AS rx, {len(expressions)} AS n FROM f WHERE al = {lit(lang)} AND regexp_matches(content, {lit(re2(rx, True))})")
    return " UNION ALL ".join(out)


EVIDENCE = f"""
WITH f AS (SELECT *, CASE language WHEN 'typescript' THEN 'javascript' ELSE language END AS al FROM f_code),
 h AS ({evidence_hits()}),
 e AS (SELECT repository_id, path, pattern, count(*) / any_value(n) AS confidence, string_agg(rx, ' ' ORDER BY rx) AS evidence FROM h GROUP BY 1, 2, 3)
"""


def as_architecture(t):
    lang = F.when(F.col("language") == "typescript", "javascript").otherwise(F.col("language"))
    return t.f_code.withColumn("language", lang)


@query("design_evidence", EVIDENCE + "SELECT repository_id, path, pattern, round(confidence, 9) AS confidence, evidence FROM e", "f_code")
def _(t):
    out = ops.design_evidence(as_architecture(t))
    return out.withColumn("confidence", F.round("confidence", 9)).withColumn("evidence", joined("evidence", " "))


@query("consolidate_evidence", EVIDENCE + """
, g AS (SELECT repository_id, pattern, string_agg(DISTINCT rx, ' ' ORDER BY rx) AS evidence, count(DISTINCT path) AS files FROM h GROUP BY 1, 2)
SELECT repository_id, pattern, round(least(1.0, avg(confidence)), 9) AS confidence, any_value(g.evidence) AS evidence, any_value(g.files) AS files FROM e JOIN g USING (repository_id, pattern) GROUP BY 1, 2""", "f_code")
def _(t):
    out = ops.consolidate(ops.design_evidence(as_architecture(t)))
    return out.withColumn("confidence", F.round("confidence", 9)).withColumn("evidence", joined("evidence", " "))


TECH_HITS = " UNION ALL ".join(
    f"SELECT repository_id, path, {lit(c)} AS category, {lit(n)} AS name, {lit(rx)} AS rx, {i} AS i FROM f_code WHERE regexp_matches(content, {lit(re2(rx, True))})"
    for c, n, rxs in pr.TECHNOLOGY_EVIDENCE for i, rx in enumerate(rxs)
)
TECH = f"""
WITH h AS ({TECH_HITS}),
 e AS (SELECT repository_id, path, category, name, least(1.0, count(*) * 0.3::DOUBLE) AS confidence, array_to_string(list(rx ORDER BY i)[1:3], ' ') AS evidence FROM h GROUP BY 1, 2, 3, 4)
"""


@query("technology_evidence", TECH + "SELECT repository_id, path, category, name, round(confidence, 9) AS confidence, evidence FROM e", "f_code")
def _(t):
    out = ops.technology_evidence(t.f_code)
    return out.withColumn("confidence", F.round("confidence", 9)).withColumn("evidence", F.array_join("evidence", " "))


@query("dedupe_technologies", TECH + "SELECT repository_id, name, category, round(max(confidence), 9) AS confidence, min_by(path, (-confidence, path)) AS path FROM e GROUP BY 1, 2, 3", "f_code")
def _(t):
    return ops.dedupe_technologies(ops.technology_evidence(t.f_code)).withColumn("confidence", F.round("confidence", 9))


@query("technologies_from_paths", f"""
WITH f AS (SELECT repository_id, path FROM f_manifests UNION ALL SELECT repository_id, path FROM f_code UNION ALL
  SELECT CAST(p_size AS VARCHAR), CASE p_partkey % 3 WHEN 0 THEN 'web/tsconfig.json' WHEN 1 THEN 'Dockerfile' ELSE '.github/workflows/x.yml' END FROM part),
 b AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS k FROM f),
 c(key, name, category) AS (VALUES {", ".join(f"({lit(a)}, {lit(b)}, {lit(d)})" for a, b, d in pr.CONFIG_FILES)}), d(key, name, category) AS (VALUES {", ".join(f"({lit(a)}, {lit(b)}, {lit(e)})" for a, b, e in pr.DEPLOYMENT_FILES)})
SELECT repository_id, path, name, category FROM b JOIN c ON k = key UNION ALL SELECT repository_id, path, name, category FROM b JOIN d ON k = key
UNION ALL SELECT repository_id, path, name, category FROM b, d WHERE k NOT IN (SELECT key FROM d) AND contains(path, '/') AND contains(lower(path), key)""", "f_manifests f_code")
def _(t):
    extra = t.part.select(F.col("p_size").cast("string").alias("repository_id"),
                          F.when(F.col("p_partkey") % 3 == 0, "web/tsconfig.json").when(F.col("p_partkey") % 3 == 1, "Dockerfile").otherwise(".github/workflows/x.yml").alias("path"))
    files = t.f_manifests.select("repository_id", "path").unionByName(t.f_code.select("repository_id", "path")).unionByName(extra)
    return ops.technologies_from_paths(files).drop("confidence")


@query("vulnerable_dependencies", f"""
WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_partkey % 3 WHEN 0 THEN 'python' ELSE 'javascript' END AS ecosystem, CASE p_partkey % 3 WHEN 0 THEN 'pillow' WHEN 1 THEN 'lodash' ELSE p_name END AS package,
  CASE p_partkey % 3 WHEN 0 THEN CAST(p_size % 10 AS VARCHAR) || '.3.1' WHEN 1 THEN '^4.17.' || CAST(p_size AS VARCHAR) ELSE '1' END AS version FROM part),
 a(ecosystem, package, below, cve) AS (VALUES {", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in sr.ADVISORIES)})
SELECT id, package, version, cve FROM d JOIN a USING (ecosystem, package)
WHERE list_transform(string_split(regexp_extract(version, '([0-9]+([.][0-9]+)*)', 1), '.'), lambda x: CAST(x AS INTEGER)) < list_transform(string_split(below, '.'), lambda x: CAST(x AS INTEGER))""")
def _(t):
    kind, size = F.col("p_partkey") % 3, F.col("p_size")
    rows = t.part.select(
        F.col("p_partkey").cast("string").alias("id"), F.when(kind == 0, "python").otherwise("javascript").alias("ecosystem"),
        F.when(kind == 0, "pillow").when(kind == 1, "lodash").otherwise(F.col("p_name")).alias("package"),
        F.when(kind == 0, F.concat((size % 10).cast("string"), F.lit(".3.1"))).when(kind == 1, F.concat(F.lit("^4.17."), size.cast("string"))).otherwise("1").alias("version"))
    return ops.vulnerable_dependencies(rows).select("id", "package", "version", "cve")


KEY = "list_transform(string_split(regexp_extract({}, '([0-9]+([.][0-9]+)*)', 1), '.'), lambda x: CAST(x AS BIGINT))"


@query("vulnerable_manifests", DEPS + f""", a(ecosystem, package, below, cve) AS (VALUES {", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in sr.ADVISORIES)})
SELECT repository_id, path, package, version, cve FROM d JOIN a USING (ecosystem, package) JOIN (SELECT path, CAST(regexp_extract(path, '^m([0-9]+)/', 1) AS BIGINT) AS p_partkey FROM f_manifests) USING (p_partkey)
WHERE CASE WHEN regexp_matches(version, '[0-9]') THEN {KEY.format("version")} < {KEY.format("below")} END""", "f_manifests")
def _(t):
    found = deps.all_dependencies(t.f_manifests)
    return ops.vulnerable_dependencies(found).select("repository_id", "path", "package", "version", "cve")


RANGED = """
d AS (SELECT CASE l_partkey % 2 WHEN 0 THEN 'python' ELSE 'javascript' END AS ecosystem, 'pkg' || CAST(l_partkey % 50 AS VARCHAR(20)) AS package,
  CASE WHEN l_partkey % 11 = 0 THEN 'latest' ELSE '^' || CAST(l_linenumber AS VARCHAR(20)) || '.' || CAST(l_partkey % 7 AS VARCHAR(20)) || '.' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(20)) END AS version FROM {lineitem}),
v AS (SELECT CASE s_suppkey % 2 WHEN 0 THEN 'python' ELSE 'javascript' END AS ecosystem, 'pkg' || CAST(s_suppkey % 50 AS VARCHAR(20)) AS package, 'CVE-' || CAST(s_suppkey AS VARCHAR(20)) AS cve,
  CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_nationkey % 7 AS VARCHAR(20)) || '.' || CAST(s_suppkey % 7 AS VARCHAR(20)) END AS introduced,
  CASE WHEN s_suppkey % 9 > 0 THEN CAST(s_nationkey % 7 + s_suppkey % 2 AS VARCHAR(20)) || '.3.' || CAST(s_nationkey AS VARCHAR(20)) END AS fixed FROM {supplier})
"""


@query("vulnerable_ranges", f"""WITH {RANGED.format(lineitem="lineitem", supplier="supplier")}
SELECT ecosystem, package, version, cve, count(*) AS uses FROM d JOIN v USING (ecosystem, package) WHERE version <> 'latest'
AND (introduced IS NULL OR {KEY.format("version")} >= {KEY.format("introduced")}) AND (fixed IS NULL OR {KEY.format("version")} < {KEY.format("fixed")}) GROUP BY 1, 2, 3, 4""")
def _(t):
    """Uses of each version inside an advisory's range, many advisories per package."""
    rows = {c: t.spark.sql(f"WITH {RANGED.format(lineitem='{lineitem}', supplier='{supplier}')} SELECT * FROM {c}", lineitem=t.lineitem, supplier=t.supplier) for c in "dv"}
    # Uses are counted before the join: a version's advisories are met once, not once per line that names it.
    used = written(rows["d"].groupBy("ecosystem", "package", "version").agg(F.count("*").alias("uses")), "version-uses")
    return ops.vulnerable_ranges(used, rows["v"]).groupBy("ecosystem", "package", "version", "cve").agg(F.sum("uses").alias("uses"))


@query("user_rules", """
SELECT path, CAST(1 + length(b) - length(replace(b, chr(10), '')) AS INTEGER) AS line_number, 'custom_pattern' AS name, 'intermediate' AS level, 0.85::DOUBLE AS confidence
FROM (SELECT path, array_to_string(string_split(content, 'def ')[1:k], 'def ') AS b FROM (SELECT path, content, unnest(generate_series(1, len(string_split(content, 'def ')) - 1)) AS k FROM f_code))""", "f_code")
def _(t):
    rule = ops.user_rule("custom_pattern", "def ", confidence=0.85)
    return ops.scan(t.f_code, [rule]).select("path", "line_number", "name", "level", "confidence")


DECLARES, SPELLED = r"(def|func|fn|class) +[A-Za-z_]+", r"[a-z]+_[a-z]+\("


@query("user_expressions", f"""
WITH l AS (SELECT path, language, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM f_code),
 m AS (SELECT path, n, 'declares' AS name, 'advanced' AS level, 0.7::DOUBLE AS confidence, unnest(regexp_extract_all(line, '(?i){DECLARES}')) FROM l
  UNION ALL SELECT path, n, 'snake_call', 'intermediate', 0.6::DOUBLE, unnest(regexp_extract_all(line, '{SPELLED}')) FROM l WHERE language = 'python')
SELECT path, CAST(n AS INTEGER) AS line_number, name, level, confidence FROM m""", "f_code")
def _(t):
    """Rules of one's own by expression, one of them for one language only."""
    rules = [ops.user_rule("declares", DECLARES, "advanced", 0.7, expression=True, ignore_case=True), ops.user_rule("snake_call", SPELLED, confidence=0.6, expression=True, languages=("python",))]
    return ops.scan(t.f_code, ops.numbered(rules)).select("path", "line_number", "name", "level", "confidence")


@query("tree_scan", """
SELECT lang, source, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines
FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2""")
def _(t):
    """Texts written as a tree of files and read back; copies in directories that a snapshot leaves out are not listed."""
    root = shared_folder(t.spark, "tree")
    texts = t.documents.filter("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL").select("text", "lang", "source").repartition("lang", "source")
    for below in ("src", "src/node_modules", ".git"):
        texts.write.partitionBy("lang", "source").option("maxRecordsPerFile", 1000).text(f"{root}/{below}")
    files = read_tree(t.spark, root).filter("path LIKE '%.txt'")
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]*)/", 1).alias(name)
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return files.groupBy(part("lang"), part("source")).agg(F.sum("n_bytes").alias("n_bytes"), F.sum(lines).cast("long").alias("n_lines"))
