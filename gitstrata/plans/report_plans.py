"""Insight, score, dashboard and chart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitstrata.operators import occurrences as occ
from gitstrata.operators import reports as ops
from gitstrata.plans.commit_plans import any_of
from gitstrata.plans.registry import query
from gitstrata.rules import insights as rules

WIDE = "f_name_occurrences f_name_patterns"
STATS = """
WITH st AS (SELECT o.repository_id, o.pattern_id, p.name, p.category, p.complexity_level, p.is_antipattern, count(*) AS occurrences FROM f_name_occurrences o JOIN f_name_patterns p USING (pattern_id) GROUP BY ALL)
"""
TL = """, tl AS (SELECT repository_id, CAST(detected_at AS DATE) AS period, p.name AS pattern_name, count(*) AS occurrences FROM f_occurrences o JOIN f_patterns p USING (pattern_id) GROUP BY ALL)"""


def stats(t):
    facts = t.f_name_occurrences.groupBy("repository_id", "pattern_id").agg(F.count("*").alias("occurrences"))
    return facts.join(t.f_name_patterns, "pattern_id")


def timeline(t):
    return occ.pattern_timeline(t.f_occurrences, t.f_patterns)


def technologies(t):
    return t.f_technologies.select("repository_id", F.col("name").alias("technology"))


@query("name_families", STATS + "SELECT repository_id, " + ", ".join(f"count(*) FILTER ({any_of('lower(name)', w)}) AS {k}" for k, w in rules.NAME_FAMILIES.items()) + " FROM st GROUP BY 1", WIDE)
def _(t):
    return ops.name_families(stats(t))


RULES = "r(metric, at_least, above, below, at_most, kind, title, category, priority, confidence, impact) AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{float(x)}::DOUBLE" for x in row) + ")" for row in rules.THRESHOLDS) + ")"
HOLDS = "(at_least IS NULL OR value >= at_least) AND (above IS NULL OR value > above) AND (below IS NULL OR value < below) AND (at_most IS NULL OR value <= at_most)"
METRICS = STATS + f""", c AS (SELECT repository_id, count(*) / 300 AS commit_rate FROM f_commits GROUP BY 1), q AS (SELECT repository_id, avg(score) * 2 AS quality_score FROM f_analyses GROUP BY 1),
 te AS (SELECT repository_id, count(DISTINCT name) AS technology_count FROM f_technologies GROUP BY 1),
 fam AS (SELECT repository_id, {", ".join(f"count(*) FILTER ({any_of('lower(name)', w)}) AS {k}" for k, w in rules.NAME_FAMILIES.items())}, count(*) FILTER (complexity_level = 'advanced') - count(*) FILTER (complexity_level = 'simple') AS advanced_minus_simple FROM st GROUP BY 1),
 m AS (SELECT repository_id, 'commit_rate' AS metric, CAST(commit_rate AS DOUBLE) AS value FROM c UNION ALL SELECT repository_id, 'quality_score', quality_score FROM q UNION ALL SELECT repository_id, 'technology_count', technology_count FROM te
  {" ".join(f"UNION ALL SELECT repository_id, '{k}', {k} FROM fam" for k in [*rules.NAME_FAMILIES, 'advanced_minus_simple'])}), {RULES},
 i AS (SELECT repository_id, metric, value, kind, title, r.category, priority, confidence, impact FROM m JOIN r USING (metric) WHERE {HOLDS})
"""
IN = WIDE + " f_commits f_analyses f_technologies"


def all_metrics(t):
    level = F.col("complexity_level")
    shape = stats(t).groupBy("repository_id").agg((F.count_if(level == "advanced") - F.count_if(level == "simple")).alias("advanced_minus_simple"))
    rate = t.f_commits.groupBy("repository_id").agg((F.count("*") / 300).alias("commit_rate"))
    quality = t.f_analyses.groupBy("repository_id").agg((F.avg("score") * 2).alias("quality_score"))
    tech = t.f_technologies.groupBy("repository_id").agg(F.countDistinct("name").alias("technology_count"))
    return ops.metrics_long(families=ops.name_families(stats(t)), shape=shape, rate=rate, quality=quality, tech=tech)


@query("metrics_long", METRICS + "SELECT repository_id, metric, round(value, 6) AS value FROM m", IN)
def _(t):
    return all_metrics(t).withColumn("value", F.round("value", 6))


@query("insights", METRICS + "SELECT repository_id, metric, round(value, 6) AS value, kind, title, category, priority, confidence, impact FROM i", IN)
def _(t):
    return ops.insights(all_metrics(t)).withColumn("value", F.round("value", 6))


@query("prioritized_insights", METRICS + """SELECT repository_id, title, CAST(row_number() OVER (PARTITION BY repository_id ORDER BY CASE priority WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END DESC, impact DESC, confidence DESC, title) AS INTEGER) AS position FROM i""", IN)
def _(t):
    return ops.prioritize(ops.insights(all_metrics(t))).select("repository_id", "title", "position")


ERA = "era(technology, era) AS (VALUES " + ", ".join(f"('{n}', '{e}')" for e, names in rules.TECHNOLOGY_ERA.items() for n in names) + ")"
ERA_NAME = "CASE p_partkey % 5 WHEN 0 THEN 'React' WHEN 1 THEN 'jQuery' WHEN 2 THEN 'Deno' WHEN 3 THEN 'Vite' ELSE p_name END"


def era_rows(t):
    return t.part.select(F.col("p_size").cast("string").alias("repository_id"), F.expr(ERA_NAME).alias("technology"))


@query("technology_currency", f"WITH {ERA}, x AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS repository_id, {ERA_NAME} AS technology FROM part) SELECT repository_id, technology, era FROM x JOIN era USING (technology)")
def _(t):
    return ops.technology_currency(era_rows(t))


@query("currency_counts", f"WITH {ERA}, x AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS repository_id, {ERA_NAME} AS technology FROM part) SELECT repository_id, count(*) FILTER (era = 'modern') AS modern_technologies, count(*) FILTER (era = 'outdated') AS outdated_technologies, count(*) FILTER (era = 'emerging') AS emerging_technologies FROM x JOIN era USING (technology) GROUP BY 1")
def _(t):
    return ops.currency_counts(era_rows(t))


PRULES = RULES.split(" AS (VALUES")[0] + " AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{float(x)}::DOUBLE" for x in row) + ")" for row in rules.PATTERN_THRESHOLDS) + ")"


@query("pattern_insights", STATS + f""", b AS (SELECT repository_id, count(*) AS pattern_count, count(*) FILTER (is_antipattern) AS antipatterns, count(*) FILTER (NOT is_antipattern AND complexity_level = 'advanced') AS advanced_patterns, count(*) FILTER ({any_of('lower(name)', rules.ARCHITECTURE_NAMES)}) AS architecture_patterns FROM st GROUP BY 1),
 c AS (SELECT repository_id, count(*) AS commit_count FROM f_commits GROUP BY 1), te AS (SELECT repository_id, count(DISTINCT name) AS technology_count FROM f_technologies GROUP BY 1),
 w AS (SELECT *, greatest(0, 100 - antipatterns * 15) AS pattern_quality, pattern_count / commit_count AS patterns_per_commit FROM b LEFT JOIN c USING (repository_id) LEFT JOIN te USING (repository_id)),
 m AS ({" UNION ALL ".join(f"SELECT repository_id, '{k}' AS metric, CAST({k} AS DOUBLE) AS value FROM w WHERE {k} IS NOT NULL" for k in ("pattern_count", "antipatterns", "advanced_patterns", "architecture_patterns", "technology_count", "pattern_quality", "patterns_per_commit"))}), {PRULES}
SELECT repository_id, metric, round(value, 9) AS value, kind, title, category FROM m JOIN r USING (metric) WHERE {HOLDS}""", WIDE + " f_commits f_technologies")
def _(t):
    return ops.pattern_insights(stats(t), t.f_commits, technologies(t)).withColumn("value", F.round("value", 9))


H = STATS + f""", h AS (SELECT repository_id, count(*) AS patterns, count(*) FILTER (is_antipattern) AS antipatterns,
  sum(CASE WHEN is_antipattern THEN -10 ELSE 0 END + CASE WHEN {any_of('name', rules.SECURITY_WORDS)} THEN CASE WHEN is_antipattern THEN -15 ELSE 5 END ELSE 0 END) AS s,
  sum(CASE WHEN {any_of('name', rules.FAST_WORDS)} THEN 5 WHEN {any_of('name', rules.SLOW_WORDS)} THEN -10 ELSE 0 END) AS p, count(*) FILTER ({any_of('name', rules.STRUCTURE_WORDS)}) AS a,
  count(*) FILTER (is_antipattern AND {any_of('name', rules.CRITICAL_WORDS)}) AS critical, count(*) FILTER (is_antipattern AND {any_of('name', rules.HIGH_WORDS)}) AS high FROM st GROUP BY 1),
 hs AS (SELECT *, CAST(greatest(0, least(100, 85 + s)) AS BIGINT) AS security_score, CAST(greatest(0, least(100, 80 + p)) AS BIGINT) AS performance_score, CAST(greatest(0, least(100, 75 + least(20, 4 * a) - 8 * antipatterns)) AS BIGINT) AS architecture_score FROM h)
"""


@query("heuristic_scores", H + """
SELECT repository_id, patterns, antipatterns, critical, high, antipatterns - critical - high AS medium, security_score, performance_score, architecture_score, CASE WHEN security_score > 80 THEN 'low' WHEN security_score > 60 THEN 'medium' ELSE 'high' END AS risk_level,
 (100 - security_score) // 10 AS total_vulnerabilities, (100 - performance_score) // 8 AS total_issues, CASE WHEN performance_score >= 90 THEN 'A' WHEN performance_score >= 80 THEN 'B' WHEN performance_score >= 70 THEN 'C' WHEN performance_score >= 60 THEN 'D' ELSE 'F' END AS performance_grade,
 CASE WHEN architecture_score >= 90 THEN 'A' WHEN architecture_score >= 80 THEN 'B' WHEN architecture_score >= 70 THEN 'C' WHEN architecture_score >= 60 THEN 'D' ELSE 'F' END AS architecture_grade,
 round(least(1.0, patterns / 10), 9) AS modularity, round(greatest(0.1, 1 - patterns / 20), 9) AS coupling, round(least(1.0, 0.5 + patterns / 40), 9) AS cohesion FROM hs""", WIDE)
def _(t):
    out = ops.heuristic_scores(stats(t))
    return out.withColumns({c: F.round(c, 9) for c in ("modularity", "coupling", "cohesion")})


@query("pattern_families", STATS + f"""
SELECT repository_id, name, 'security' AS family, name AS label, CASE WHEN is_antipattern THEN 'negative' ELSE 'positive' END AS effect, CAST(NULL AS DOUBLE) AS confidence FROM st WHERE {any_of('name', rules.SECURITY_FAMILY)}
UNION ALL SELECT repository_id, name, 'performance', name, CASE WHEN {any_of('name', rules.PERFORMANCE_FAMILY)} THEN 'positive' ELSE 'negative' END, NULL FROM st WHERE {any_of('name', rules.PERFORMANCE_FAMILY + rules.PERFORMANCE_NEGATIVE)}
{" ".join(f"UNION ALL SELECT repository_id, name, 'design', '{w.title()}', 'positive', {c} FROM st WHERE contains(name, '{w}')" for w, c in rules.DESIGN_CONFIDENCE.items())}""", WIDE)
def _(t):
    return ops.pattern_families(stats(t))


@query("architectural_styles", STATS + """, a AS (SELECT repository_id, bool_or(contains(name, 'mvc')) AS mvc FROM st GROUP BY 1), b AS (SELECT repository_id, bool_or(name LIKE 'small%') AS ms FROM f_technologies GROUP BY 1)
SELECT repository_id, CASE WHEN coalesce(ms, false) THEN 'Microservices' ELSE 'Layered' END AS styles FROM a LEFT JOIN b USING (repository_id)""", WIDE + " f_technologies")
def _(t):
    tech = technologies(t).withColumn("technology", F.when(F.col("technology").startswith("small"), "Docker").otherwise(F.col("technology")))
    return ops.architectural_styles(stats(t), tech).select("repository_id", F.array_join("styles", "|").alias("styles"))


@query("heuristic_recommendations", STATS + """, g AS (SELECT repository_id, count(*) AS n, count(*) FILTER (is_antipattern) AS n_anti, bool_or(contains(name, 'auth')) AS auth, bool_or(contains(name, 'cache')) AS cache FROM st GROUP BY 1)
SELECT repository_id, CASE WHEN auth THEN '' ELSE 'add authentication|' END || 'add cryptography|' || CASE WHEN n_anti > 0 THEN 'refactor ' || n_anti || ' antipatterns|' ELSE '' END || 'validate input|log and monitor' AS security,
 CASE WHEN n < 5 THEN 'use more patterns|' WHEN n > 20 THEN 'use fewer patterns|' ELSE '' END || 'consider MVC|separate concerns|inject dependencies|keep to SOLID' AS architecture FROM g""", WIDE)
def _(t):
    out = ops.heuristic_recommendations(stats(t))
    return out.select("repository_id", F.array_join("security", "|").alias("security"), F.array_join("architecture", "|").alias("architecture"))


@query("enhanced_view", H + """, l AS (SELECT repository_id, analysis_type, score FROM f_analyses QUALIFY row_number() OVER (PARTITION BY repository_id, analysis_type ORDER BY created_at DESC, analysis_id DESC) = 1)
SELECT h.repository_id, coalesce((SELECT score FROM l WHERE l.repository_id = h.repository_id AND analysis_type = 'security'), CAST(security_score AS DOUBLE)) AS security_score, coalesce((SELECT score FROM l WHERE l.repository_id = h.repository_id AND analysis_type = 'performance'), CAST(performance_score AS DOUBLE)) AS performance_score,
 coalesce((SELECT score FROM l WHERE l.repository_id = h.repository_id AND analysis_type = 'architectural'), CAST(architecture_score AS DOUBLE)) AS architecture_score,
 EXISTS (SELECT 1 FROM l WHERE l.repository_id = h.repository_id AND analysis_type = 'security') AS security_stored, EXISTS (SELECT 1 FROM l WHERE l.repository_id = h.repository_id AND analysis_type = 'performance') AS performance_stored, EXISTS (SELECT 1 FROM l WHERE l.repository_id = h.repository_id AND analysis_type = 'architectural') AS architectural_stored FROM hs h""", WIDE + " f_analyses")
def _(t):
    return ops.enhanced_view(ops.latest_analyses(t.f_analyses), ops.heuristic_scores(stats(t)))


@query("dashboard_scores", STATS + TL + """, b AS (SELECT repository_id, count(*) AS n, count(*) FILTER (is_antipattern) AS n_anti, count(*) FILTER (complexity_level = 'advanced') AS cx, count(*) FILTER (complexity_level = 'simple') AS pl FROM st GROUP BY 1),
 j AS (SELECT b.*, coalesce(p, 0) AS p, coalesce(c, 0) AS c, coalesce(te, 0) AS te FROM b LEFT JOIN (SELECT repository_id, count(DISTINCT period) AS p FROM tl GROUP BY 1) USING (repository_id) LEFT JOIN (SELECT repository_id, count(*) AS c FROM f_commits GROUP BY 1) USING (repository_id)
  LEFT JOIN (SELECT repository_id, count(*) AS te FROM f_technologies GROUP BY 1) USING (repository_id))
SELECT repository_id, CAST(floor((n - n_anti) / greatest(n, 1) * 100 + 0.5) AS BIGINT) AS health_score, CASE WHEN p > 0 THEN c / p ELSE 0.0 END AS velocity, greatest(0, 100 - n_anti * 15 - cx * 5 + pl * 2) AS overall, greatest(0, 100 - n_anti * 20 - cx * 10) AS maintainability,
 least(100, 50 + pl * 10 - cx * 5) AS readability, least(100, 60 + n * 2 - n_anti * 10) AS testability, greatest(0, least(100, 90 - n_anti * 15)) AS code_quality, least(100, n * 12) AS pattern_diversity, greatest(0, least(100, 85 - cx * 12)) AS gauge_maintainability,
 least(100, p * 8 + 20) AS evolution_score, greatest(0, 100 - n_anti * 25) AS tech_debt, least(100, te * 10 + 30) AS modernization, n - n_anti - cx AS info_issues FROM j""", WIDE + " f_occurrences f_patterns f_commits f_technologies")
def _(t):
    return ops.dashboard_scores(stats(t), timeline(t), t.f_commits, technologies(t))


FOLD = "CASE category WHEN 'languages' THEN 'language' WHEN 'frameworks' THEN 'framework' WHEN 'libraries' THEN 'library' WHEN 'tools' THEN 'tool' ELSE 'other' END"


@query("tech_radar", f"SELECT repository_id, {FOLD} AS folded, count(*) AS count, CAST(sum(usage_count) AS BIGINT) AS usage FROM f_technologies WHERE {FOLD} <> 'other' GROUP BY 1, 2", "f_technologies")
def _(t):
    return ops.tech_radar(t.f_technologies)


@query("tech_top", f"""
SELECT repository_id, {FOLD} AS folded, name, CASE WHEN usage_count = 0 THEN 1 ELSE usage_count END AS usage, CAST(row_number() OVER (PARTITION BY repository_id, {FOLD} ORDER BY CASE WHEN usage_count = 0 THEN 1 ELSE usage_count END DESC, name, version, category) AS INTEGER) AS position FROM f_technologies QUALIFY position <= 15""", "f_technologies")
def _(t):
    return ops.tech_top(t.f_technologies).select("repository_id", "folded", "name", "usage", "position")


@query("technologies_by_category", f"SELECT repository_id, {FOLD} AS folded, name, category FROM f_technologies", "f_technologies")
def _(t):
    return ops.technologies_by_category(t.f_technologies).select("repository_id", "folded", "name", "category")


@query("tech_edges", f"SELECT DISTINCT repository_id, 'central' AS source, 'category-' || {FOLD} AS target FROM f_technologies UNION ALL SELECT DISTINCT repository_id, 'category-' || {FOLD}, name FROM f_technologies", "f_technologies")
def _(t):
    return ops.tech_edges(t.f_technologies)


@query("heatmap", "WITH x AS (SELECT 1)" + TL + """, top AS (SELECT repository_id, pattern_name FROM (SELECT repository_id, pattern_name, sum(occurrences) AS s FROM tl GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY s DESC, pattern_name) <= 4),
 g AS (SELECT p.repository_id, period, pattern_name FROM (SELECT DISTINCT repository_id, period FROM tl) p JOIN top USING (repository_id)), c AS (SELECT g.*, coalesce(tl.occurrences, 0) AS value FROM g LEFT JOIN tl USING (repository_id, period, pattern_name)),
 i AS (SELECT *, value / max(value) OVER (PARTITION BY repository_id) AS intensity FROM c)
SELECT *, CASE WHEN intensity = 0 THEN 0 WHEN intensity < 0.3 THEN 1 WHEN intensity < 0.6 THEN 2 WHEN intensity < 0.8 THEN 3 ELSE 4 END AS band FROM i""", "f_occurrences f_patterns")
def _(t):
    return ops.heatmap(timeline(t), 4)


@query("word_weights", STATS + """, k AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY occurrences DESC, name) <= 50), e AS (SELECT *, min(occurrences) OVER (PARTITION BY repository_id) AS lo, max(occurrences) OVER (PARTITION BY repository_id) AS hi FROM k)
SELECT repository_id, replace(name, '_', ' ') AS text, occurrences, round(greatest(12.0, least(48.0, 12 + (occurrences - lo) / greatest(hi - lo, 1) * 36)), 9) AS size FROM e""", WIDE)
def _(t):
    return ops.word_weights(stats(t)).withColumn("size", F.round("size", 9))


@query("complexity_groups", STATS + f"""
SELECT repository_id, CASE WHEN {any_of('name', rules.EXPERT_WORDS)} OR occurrences > 20 THEN 'expert' WHEN {any_of('name', rules.ADVANCED_WORDS)} OR occurrences > 10 THEN 'advanced' WHEN {any_of('name', rules.INTERMEDIATE_WORDS)} OR occurrences > 5 THEN 'intermediate'
 WHEN occurrences <= 3 THEN 'simple' ELSE coalesce(complexity_level, 'intermediate') END AS complexity, count(*) AS count, CAST(sum(occurrences) AS BIGINT) AS total_occurrences FROM st GROUP BY 1, 2""", WIDE)
def _(t):
    return ops.complexity_groups(stats(t))


@query("learning_progression", STATS + TL + """, p AS (SELECT repository_id, period, count(*) AS names, count(*) FILTER (occurrences > 5) AS freq, row_number() OVER (PARTITION BY repository_id ORDER BY period) - 1 AS i FROM tl GROUP BY 1, 2),
 te AS (SELECT repository_id, count(*) AS te FROM f_technologies GROUP BY 1), an AS (SELECT repository_id, count(*) FILTER (is_antipattern) AS n_anti FROM st GROUP BY 1)
SELECT repository_id, period, least(100, 20 + i * 8 + names * 3) AS skill_level, least(100, 15 + freq * 10 + i * 5) AS pattern_complexity, least(100, 10 + coalesce(te, 0) * 2 + i * 6) AS technical_diversity, greatest(10, least(100, 80 - coalesce(n_anti, 0) * 5 + i * 3)) AS code_quality
FROM p LEFT JOIN te USING (repository_id) LEFT JOIN an USING (repository_id)""", WIDE + " f_occurrences f_patterns f_technologies")
def _(t):
    return ops.learning_progression(timeline(t), technologies(t), stats(t))


@query("evolution_metrics", STATS + TL + """, s AS (SELECT repository_id, greatest(date_diff('day', min(period), max(period)), 1) AS d, count(DISTINCT period) AS p FROM tl GROUP BY 1), u AS (SELECT repository_id, sum(occurrences) AS o, count(*) AS n FROM st GROUP BY 1), c AS (SELECT repository_id, count(*) AS c FROM f_commits GROUP BY 1)
SELECT repository_id, d AS timespan_days, round(CASE WHEN p > 12 THEN c / d * 30 ELSE c / p END, 9) AS velocity, round(o / c, 9) AS pattern_density, round(n / p, 9) AS evolution_rate FROM s JOIN u USING (repository_id) JOIN c USING (repository_id)""", WIDE + " f_occurrences f_patterns f_commits")
def _(t):
    out = ops.evolution_metrics(timeline(t), stats(t), t.f_commits)
    return out.withColumns({c: F.round(c, 9) for c in ("velocity", "pattern_density", "evolution_rate")})


USAGE = "u AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS repository_id, strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority AS language FROM orders)"


def usage(t):
    return t.orders.select((F.col("o_custkey") % 50).cast("string").alias("repository_id"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderpriority").alias("language"))


@query("language_adoption", f"WITH {USAGE} SELECT repository_id, language, count(DISTINCT period) AS appearances, min(period) AS first_appearance, CAST(floor(count(DISTINCT period) / (SELECT count(DISTINCT period) FROM u x WHERE x.repository_id = u.repository_id) * 100 + 0.5) AS BIGINT) AS percentage FROM u GROUP BY 1, 2")
def _(t):
    return ops.language_adoption(usage(t))


@query("adoption_matrix", f"WITH {USAGE}, p AS (SELECT DISTINCT repository_id, period, language FROM u) SELECT a.repository_id, a.period, b.language, CAST(p.language IS NOT NULL AS INTEGER) AS present FROM (SELECT DISTINCT repository_id, period FROM p) a JOIN (SELECT DISTINCT repository_id, language FROM p) b USING (repository_id) LEFT JOIN p ON p.repository_id = a.repository_id AND p.period = a.period AND p.language = b.language")
def _(t):
    return ops.adoption_matrix(usage(t))


@query("pattern_browser", """
WITH s AS (SELECT o.repository_id, o.pattern_id, p.name, p.category, count(*) AS occurrences, min(detected_at) AS first_seen FROM f_occurrences o JOIN f_patterns p USING (pattern_id) WHERE contains(lower(name), 'c') OR contains(lower(category), 'c') GROUP BY ALL),
 e AS (SELECT repository_id, pattern_id, string_agg(coalesce(file_path, '-'), '|' ORDER BY n) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, pattern_id ORDER BY detected_at, file_path) AS n FROM f_occurrences) WHERE n <= 3 GROUP BY 1, 2)
SELECT repository_id, name, category AS "group", occurrences, first_seen, examples FROM s JOIN e USING (repository_id, pattern_id)""", "f_occurrences f_patterns")
def _(t):
    st = t.f_occurrences.groupBy("repository_id", "pattern_id").agg(F.count("*").alias("occurrences")).join(t.f_patterns, "pattern_id")
    out = ops.pattern_browser(st, t.f_occurrences, term="C")
    return out.select("repository_id", "name", "group", "occurrences", "first_seen", F.array_join("examples", "|", "-").alias("examples"))


@query("dashboard", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, analysis_id DESC) AS n FROM f_analyses WHERE analysis_type = 'quality'),
 w AS (SELECT repository_id, max(score) FILTER (n = 1) AS score, max(score) FILTER (n = 2) AS previous_score, max(created_at) FILTER (n = 1) AS last_analyzed FROM r WHERE n <= 2 GROUP BY 1)
SELECT *, CASE WHEN score - previous_score > 0 THEN 'improving' WHEN score - previous_score < 0 THEN 'declining' ELSE 'stable' END AS trend FROM w""", "f_analyses")
def _(t):
    return ops.dashboard(t.f_analyses.filter("analysis_type = 'quality'"))


@query("latest_analyses", "SELECT * FROM f_analyses QUALIFY row_number() OVER (PARTITION BY repository_id, analysis_type ORDER BY created_at DESC, analysis_id DESC) = 1", "f_analyses")
def _(t):
    return ops.latest_analyses(t.f_analyses)


@query("latest_analyses_by_model", "SELECT * FROM f_analyses WHERE model_used = 'model1' QUALIFY row_number() OVER (PARTITION BY repository_id, analysis_type ORDER BY created_at DESC, analysis_id DESC) = 1", "f_analyses")
def _(t):
    return ops.latest_analyses(t.f_analyses, "model1")


@query("last_results", "SELECT repository_id, analysis_id, CAST(row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, analysis_id DESC) AS INTEGER) AS position FROM f_analyses QUALIFY position <= 5", "f_analyses")
def _(t):
    return ops.last_results(t.f_analyses).select("repository_id", "analysis_id", "position")
