"""Structure and architecture queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitstrata.operators import scan
from gitstrata.operators import structure as ops
from gitstrata.plans.registry import ORACLE, query
from gitstrata.plans.scan_plans import as_architecture
from gitstrata.rules import architecture as rules
from gitstrata.session import written

DIR = "coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), 'root')"
TOP = "CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END"
SUF = "lower(regexp_extract(path, '[^/]+(\\.[^./]+)$', 1))"
PATHS = "p AS (SELECT repository_id, path FROM f_code UNION ALL SELECT repository_id, path FROM f_manifests)"


def paths(t):
    return t.f_code.select("repository_id", "path").unionByName(t.f_manifests.select("repository_id", "path"))


@query("directory_profile", f"SELECT repository_id, {TOP} AS top_directory, count(*) AS files FROM f_code GROUP BY 1, 2", "f_code")
def _(t):
    return ops.directory_profile(t.f_code)


@query("depth_histogram", "SELECT repository_id, len(string_split(path, '/')) - 1 AS depth, count(*) AS files FROM f_code GROUP BY 1, 2", "f_code")
def _(t):
    return ops.depth_histogram(t.f_code)


@query("depth_summary", f"""
SELECT repository_id, max(d) AS max_depth, round(avg(d), 9) AS avg_depth, count(*) AS total_files, count(DISTINCT top) AS directory_count FROM (SELECT repository_id, len(string_split(path, '/')) - 1 AS d, {TOP} AS top FROM f_code) GROUP BY 1""", "f_code")
def _(t):
    return ops.depth_summary(t.f_code).withColumn("avg_depth", F.round("avg_depth", 9))


def style_sql() -> str:
    rows = []
    for style, words in rules.DIRECTORY_INDICATORS.items():
        score = "(" + " + ".join(f"max(CAST(contains(top, '{w}') AS INTEGER))" for w in words) + f") / {len(words)}"
        if style in rules.FILE_PATTERNS:
            need, kinds = rules.FILE_PATTERNS[style]
            hits = " + ".join("max(CAST(" + " OR ".join(f"regexp_matches(path, '(?i){rx}')" for rx in rxs) + " AS INTEGER))" for rxs in kinds.values())
            score += f" + CASE WHEN {hits} >= {need} THEN ({hits}) / {len(kinds)} ELSE 0 END"
        if style == "microservices":
            hints = " + ".join(f"max(CAST({c} AS INTEGER))" for c in ("contains(lp, 'docker')", "contains(lp, 'kubernetes') OR contains(lp, 'k8s')", "contains(lp, 'service')", "contains(lp, 'gateway')"))
            score += f" + CASE WHEN {hints} + CAST(count(*) FILTER (contains(lp, 'api')) > 2 AS INTEGER) >= 2 THEN 0.5 ELSE 0 END"
        if style == "mvc":
            hints = " + ".join(f"max(CAST({c} AS INTEGER))" for c in ("contains(lp, 'controller')", "contains(lp, 'model')", "regexp_matches(path, '\\.(html|jsx|vue|template)$')"))
            score += f" + CASE WHEN {hints} >= 2 THEN 0.3 ELSE 0 END"
        rows.append(f"SELECT repository_id, '{style}' AS style, CAST({score} AS DOUBLE) AS score FROM s GROUP BY 1")
    return f"WITH {PATHS}, s AS (SELECT *, lower(path) AS lp, lower({TOP}) AS top FROM p), a AS ({' UNION ALL '.join(rows)}), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY round(score, 9) DESC, style DESC) = 1)"


@query("architecture_style", style_sql() + """
SELECT repository_id, CASE WHEN score > 0 THEN style ELSE 'monolithic' END AS style, round(CASE WHEN score > 0 THEN least(1.0, score) ELSE 0.5 END, 9) AS confidence FROM b""", "f_code f_manifests")
def _(t):
    return ops.architecture_style(paths(t)).withColumn("confidence", F.round("confidence", 9))


MODULARITY = f"""m AS (SELECT repository_id, CASE WHEN count(*) = 1 THEN 0.3 ELSE greatest(0.0, 1 - var_pop(n) / (sum(n) * sum(n) / count(*))) END AS modularity FROM (SELECT repository_id, {DIR} AS d, count(*) AS n FROM f_code GROUP BY 1, 2) GROUP BY 1)"""
COUPLING = "c AS (SELECT repository_id, least(1.0, avg(len(regexp_extract_all(content, '(?m)^(import|from|#include|require\\()'))) / 20) AS coupling FROM f_code GROUP BY 1)"
COHESION = f"h AS (SELECT repository_id, least(1.0, avg(1.0 / k)) AS cohesion FROM (SELECT repository_id, {DIR} AS d, count(DISTINCT {SUF}) AS k FROM f_code GROUP BY 1, 2) GROUP BY 1)"
COMPLEX = "x AS (SELECT repository_id, (least(1.0, avg(len(string_split(path, '/')) - 1) / 5) + least(1.0, count(*) / 100)) / 2 AS complexity FROM f_code GROUP BY 1)"


@query("architecture_quality", f"""
WITH {MODULARITY}, {COUPLING}, {COHESION}, {COMPLEX}
SELECT repository_id, round(modularity, 9) AS modularity, round(coupling, 9) AS coupling, round(cohesion, 9) AS cohesion, round(complexity, 9) AS complexity, round((modularity + (1 - coupling) + cohesion + (1 - complexity)) / 4, 9) AS overall_score
FROM m JOIN c USING (repository_id) JOIN h USING (repository_id) JOIN x USING (repository_id)""", "f_code")
def _(t):
    out = ops.architecture_quality(t.f_code.select("repository_id", "path", "content"))
    return out.select("repository_id", *[F.round(c, 9).alias(c) for c in out.columns if c != "repository_id"])


@query("cohesion_with_patterns", f"""
WITH h AS (SELECT repository_id, avg(1.0 / k) AS base FROM (SELECT repository_id, {DIR} AS d, count(DISTINCT {SUF}) AS k FROM f_code GROUP BY 1, 2) GROUP BY 1),
 b AS (SELECT repository_id, count(DISTINCT language) * 0.1 AS bonus FROM f_code WHERE language IN ('java', 'go') GROUP BY 1)
SELECT repository_id, round(least(1.0, base + coalesce(bonus, 0.0)), 9) AS cohesion FROM h LEFT JOIN b USING (repository_id)""", "f_code")
def _(t):
    patterns = t.f_code.filter("language IN ('java', 'go')").select("repository_id", F.col("language").alias("pattern"))
    return ops.cohesion(t.f_code.select("repository_id", "path"), patterns).withColumn("cohesion", F.round("cohesion", 9))


@query("modularity", f"WITH {MODULARITY} SELECT repository_id, round(modularity, 9) AS modularity FROM m", "f_code")
def _(t):
    return ops.modularity(t.f_code.select("repository_id", "path")).withColumn("modularity", F.round("modularity", 9))


@query("import_edges", """
SELECT repository_id, path, unnest(list_concat(list_concat(regexp_extract_all(content, 'from\\s+\\..*?\\s+import|import\\s+\\..*'), regexp_extract_all(content, 'import.*?from\\s+[''"]\\..*?[''"]')),
 list_filter(regexp_extract_all(content, 'import\\s+[^;\\n]*;'), lambda x: starts_with(regexp_replace(x, '^import\\s+', ''), replace(regexp_extract(path, '^(.*)/[^/]*$', 1), '/', '.') || '.')))) AS import_text FROM f_code""", "f_code")
def _(t):
    return ops.import_edges(t.f_code.select("repository_id", "path", "content"))


def layer_cases() -> str:
    return ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(top), '{w}')" for w in words) + f" THEN '{layer}' END" for layer, words in rules.LAYERS.items())


LAYERS = f"""
WITH d AS (SELECT repository_id, {TOP} AS top, count(*) AS n FROM f_code GROUP BY 1, 2), e AS (SELECT repository_id, n, unnest([{layer_cases()}]) AS layer FROM d),
 l AS (SELECT repository_id, layer, count(*) AS directories, CAST(sum(n) AS BIGINT) AS file_count FROM e WHERE layer IS NOT NULL GROUP BY 1, 2)
"""


@query("layers", LAYERS + "SELECT * FROM l", "f_code")
def _(t):
    return ops.layers(t.f_code)


@query("layer_summary", LAYERS + "SELECT repository_id, coalesce(n, 0) AS layer_count, coalesce(n, 0) >= 2 AS is_layered FROM (SELECT DISTINCT repository_id FROM f_code) LEFT JOIN (SELECT repository_id, count(*) AS n FROM l GROUP BY 1) USING (repository_id)", "f_code")
def _(t):
    return ops.layer_summary(t.f_code)


@query("architecture_recommendations", f"""
WITH style AS ({ORACLE["architecture_style"]}), ev AS ({ORACLE["design_evidence"]}), lay AS ({ORACLE["layer_summary"]}), q AS ({ORACLE["architecture_quality"]}),
 {COHESION.replace("h AS (", "bare AS (").replace("least(1.0, avg(1.0 / k)) AS cohesion", "avg(1.0 / k) AS base")}, bonus AS (SELECT repository_id, count(DISTINCT pattern) * 0.1 AS bonus FROM ev GROUP BY 1),
 h AS (SELECT repository_id, least(1.0, base + coalesce(bonus, 0.0)) AS cohesion FROM bare LEFT JOIN bonus USING (repository_id)),
 e AS (SELECT style.repository_id, style.style, q.modularity, q.coupling, h.cohesion, q.complexity, lay.is_layered, {", ".join(f"EXISTS (SELECT 1 FROM ev WHERE ev.repository_id = style.repository_id AND pattern = '{p}') AS {p}" for p in ("singleton", "repository", "dependency_injection"))}
  FROM style JOIN q USING (repository_id) JOIN h USING (repository_id) JOIN lay USING (repository_id))
SELECT repository_id, array_to_string(list_filter([CASE WHEN modularity < 0.6 THEN 'improve modularity' END, CASE WHEN coupling > 0.7 THEN 'reduce coupling' END, CASE WHEN cohesion < 0.5 THEN 'improve cohesion' END,
 CASE WHEN complexity > 0.7 THEN 'simplify the structure' END, CASE WHEN NOT singleton AND style <> 'microservices' THEN 'consider singleton' END, CASE WHEN NOT repository THEN 'consider repository' END,
 CASE WHEN NOT dependency_injection THEN 'consider dependency injection' END, CASE WHEN style = 'monolithic' THEN 'split the monolith into modules' END, CASE WHEN style = 'microservices' THEN 'check service boundaries' END,
 CASE WHEN NOT is_layered THEN 'consider layers' END], lambda x: x IS NOT NULL)[1:5], '|') AS recommendations FROM e""", "f_code f_manifests")
def _(t):
    files = as_architecture(t).select("repository_id", "path", "content", "language")
    # The evidence is asked for three times and costs a pass over the texts: it is written once, a few rows per file.
    patterns = written(scan.design_evidence(files).select("repository_id", "path", "pattern"), "evidence")
    out = ops.architecture_recommendations(ops.architecture_style(paths(t)), ops.architecture_quality(files, patterns), patterns, ops.layer_summary(files.select("repository_id", "path")))
    return out.select("repository_id", F.array_join("recommendations", "|").alias("recommendations"))
