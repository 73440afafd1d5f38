"""Occurrence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitstrata.functions.common import joined
from gitstrata.operators import occurrences as ops
from gitstrata.operators import reach
from gitstrata.plans.registry import query
from gitstrata.session import written

OCC = "f_occurrences f_patterns"
WIDE = "f_name_occurrences f_name_patterns"


@query("join_patterns", """
SELECT o.occurrence_id, o.repository_id, o.pattern_id, p.name, p.category, p.is_antipattern
FROM f_occurrences o JOIN f_patterns p USING (pattern_id) WHERE p.complexity_level = 'intermediate'""", OCC)
def _(t):
    out = ops.join_patterns(t.f_occurrences, t.f_patterns, complexity="intermediate")
    return out.select("occurrence_id", "repository_id", "pattern_id", "name", "category", "is_antipattern")


@query("with_pattern_name", """
SELECT o.occurrence_id, coalesce(p.name, 'Unknown') AS pattern_name
FROM f_occurrences o LEFT JOIN (SELECT * FROM f_patterns WHERE category <> 'fault') p USING (pattern_id)""", OCC)
def _(t):
    out = ops.with_pattern_name(t.f_occurrences, t.f_patterns.filter("category <> 'fault'"))
    return out.select("occurrence_id", "pattern_name")


@query("pattern_stats", """
SELECT o.repository_id, o.pattern_id, any_value(p.name) AS name, count(*) AS total_occurrences,
  count(DISTINCT nullif(file_path, '')) AS unique_files, count(DISTINCT ai_model_used) AS models,
  round(avg(confidence_score), 9) AS avg_confidence, min(confidence_score) AS min_confidence, max(confidence_score) AS max_confidence,
  min(detected_at) AS first_detected, max(detected_at) AS last_detected, CAST(sum(processing_time_ms) AS BIGINT) AS total_processing_time_ms
FROM f_occurrences o JOIN f_patterns p ON o.pattern_id = p.pattern_id GROUP BY o.repository_id, o.pattern_id""", OCC)
def _(t):
    out = ops.pattern_stats(t.f_occurrences, t.f_patterns)
    return out.select(
        "repository_id", "pattern_id", "name", "total_occurrences", "unique_files",
        F.size("ai_models_used").cast("long").alias("models"), F.round("avg_confidence", 9).alias("avg_confidence"),
        "min_confidence", "max_confidence", "first_detected", "last_detected", "total_processing_time_ms",
    )


@query("pattern_stats_filtered", """
SELECT o.repository_id, p.name, count(*) AS total_occurrences, round(avg(confidence_score), 9) AS avg_confidence
FROM f_occurrences o JOIN f_patterns p USING (pattern_id) WHERE p.category = 'commerce' AND NOT p.is_antipattern GROUP BY ALL""", OCC)
def _(t):
    out = ops.pattern_stats(t.f_occurrences, t.f_patterns, category="commerce", antipattern=False)
    return out.select("repository_id", "name", "total_occurrences", F.round("avg_confidence", 9).alias("avg_confidence"))


@query("pattern_stats_light", """
SELECT o.repository_id, p.name, p.category, count(*) AS occurrences, round(avg(confidence_score), 9) AS avg_confidence,
  count(DISTINCT file_path) AS files_affected, max(detected_at) AS latest_detection
FROM f_occurrences o JOIN f_patterns p USING (pattern_id) GROUP BY ALL""", OCC)
def _(t):
    out = ops.pattern_stats_light(t.f_occurrences, t.f_patterns)
    return out.drop("pattern_id").withColumn("avg_confidence", F.round("avg_confidence", 9))


@query("pattern_summary", """
SELECT o.repository_id, count(DISTINCT o.pattern_id) AS total_patterns, count(*) AS total_occurrences, count(DISTINCT file_path) AS unique_files,
  count(DISTINCT CASE WHEN is_antipattern THEN o.pattern_id END) AS antipatterns_count,
  string_agg(DISTINCT category, '|' ORDER BY category) AS categories, string_agg(DISTINCT complexity_level, '|' ORDER BY complexity_level) AS complexity_levels
FROM f_occurrences o JOIN f_patterns p USING (pattern_id) GROUP BY o.repository_id""", OCC)
def _(t):
    out = ops.pattern_summary(t.f_occurrences, t.f_patterns)
    return out.withColumn("categories", joined("categories")).withColumn("complexity_levels", joined("complexity_levels"))


@query("pattern_detail", """
WITH s AS (SELECT repository_id, pattern_id, count(*) AS total_occurrences, count(DISTINCT file_path) AS unique_files FROM f_occurrences GROUP BY ALL)
SELECT o.occurrence_id, o.repository_id, p.name, s.total_occurrences, s.unique_files, o.file_path, o.confidence_score
FROM f_occurrences o JOIN s USING (repository_id, pattern_id) JOIN f_patterns p USING (pattern_id)""", OCC)
def _(t):
    out = ops.pattern_detail(t.f_occurrences, t.f_patterns)
    return out.select("occurrence_id", "repository_id", "name", "total_occurrences", "unique_files", "file_path", "confidence_score")


@query("pattern_timeline", """
SELECT repository_id, CAST(detected_at AS DATE) AS period, p.name AS pattern_name, count(*) AS occurrences,
  CAST(sum(count(*)) OVER (PARTITION BY repository_id, CAST(detected_at AS DATE)) AS BIGINT) AS period_total
FROM f_occurrences o LEFT JOIN f_patterns p USING (pattern_id) GROUP BY 1, 2, 3""", OCC)
def _(t):
    return ops.pattern_timeline(t.f_occurrences, t.f_patterns).drop("pattern_id")


@query("pattern_timeline_recent", """
SELECT repository_id, CAST(detected_at AS DATE) AS period, 'error' AS pattern_name, count(*) AS occurrences, count(*) AS period_total
FROM f_occurrences WHERE pattern_id = 'error' AND detected_at >= (SELECT max(detected_at) FROM f_occurrences WHERE pattern_id = 'error') - INTERVAL 7 DAY GROUP BY 1, 2""", OCC)
def _(t):
    return ops.pattern_timeline(t.f_occurrences, t.f_patterns, days=7, pattern_name="error").drop("pattern_id")


@query("monthly_timeline", """
SELECT repository_id, strftime(detected_at, '%Y-%m') AS period, p.name AS pattern_name, count(*) AS occurrences,
  CASE WHEN p.name LIKE '%react%' THEN 'react' WHEN p.name LIKE '%async%' THEN 'async' WHEN p.name LIKE '%javascript%' THEN 'javascript' ELSE 'other' END AS chart_category
FROM f_name_occurrences o JOIN f_name_patterns p USING (pattern_id) GROUP BY 1, 2, 3""", WIDE)
def _(t):
    return ops.monthly_timeline(t.f_name_occurrences, t.f_name_patterns).drop("pattern_id", "period_total")


TRENDS = """
WITH c AS (SELECT repository_id, pattern_id, count(*) AS all_time_count,
    count(*) FILTER (detected_at >= (SELECT max(detected_at) FROM f_occurrences) - INTERVAL 16 DAY) AS recent_count FROM f_occurrences GROUP BY 1, 2),
 a AS (SELECT *, recent_count / 16 AS recent_avg_per_day, (all_time_count - recent_count) / 16 AS hist FROM c),
 t AS (SELECT a.*, p.name, p.is_antipattern, CASE WHEN hist > 0 THEN (recent_avg_per_day - hist) / hist * 100 WHEN recent_count > 0 THEN 100.0 ELSE 0.0 END AS pct FROM a JOIN f_patterns p USING (pattern_id)),
 d AS (SELECT *, CASE WHEN pct > 10 THEN 'increasing' WHEN pct < -10 THEN 'decreasing' ELSE 'stable' END AS trend_direction,
    CASE WHEN abs(pct) > 50 THEN 'high' WHEN abs(pct) > 20 THEN 'medium' ELSE 'low' END AS significance FROM t)
"""


@query("pattern_trends", TRENDS + """
SELECT repository_id, name, recent_count, all_time_count, recent_avg_per_day, round(CAST(pct AS DOUBLE), 9) AS trend_percentage, trend_direction, significance FROM d""", OCC)
def _(t):
    out = ops.pattern_trends(t.f_occurrences, t.f_patterns, days=16)
    return out.select("repository_id", "name", "recent_count", "all_time_count", "recent_avg_per_day",
                      F.round("trend_percentage", 9).alias("trend_percentage"), "trend_direction", "significance")


@query("trend_summary", TRENDS + """
SELECT repository_id, count(*) AS total_patterns_analyzed, count(*) FILTER (trend_direction = 'increasing') AS increasing_patterns,
  count(*) FILTER (trend_direction = 'decreasing') AS decreasing_patterns, count(*) FILTER (trend_direction = 'stable') AS stable_patterns,
  count(*) FILTER (significance = 'high') AS high_significance_trends, count(*) FILTER (trend_direction = 'increasing' AND is_antipattern) AS rising_antipatterns
FROM d GROUP BY 1""", OCC)
def _(t):
    return ops.trend_summary(ops.pattern_trends(t.f_occurrences, t.f_patterns, days=16))


@query("rising_patterns", TRENDS + """
SELECT repository_id, name, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repository_id ORDER BY abs(pct) DESC, name) AS INTEGER) AS position
  FROM d WHERE trend_direction = 'increasing') WHERE position <= 3""", OCC)
def _(t):
    return ops.rising_patterns(ops.pattern_trends(t.f_occurrences, t.f_patterns, days=16)).select("repository_id", "name", "position")


GLOBAL = """
WITH g AS (SELECT p.pattern_id, p.name, p.category, p.is_antipattern, count(o.occurrence_id) AS total_occurrences, count(DISTINCT o.repository_id) AS repositories_count,
  count(DISTINCT file_path) AS unique_files_count, coalesce(round(avg(confidence_score), 9), 0.0) AS avg_confidence
  FROM f_patterns p LEFT JOIN f_occurrences o USING (pattern_id) GROUP BY 1, 2, 3, 4)
"""


@query("global_pattern_stats", GLOBAL + "SELECT *, total_occurrences * repositories_count AS popularity_score FROM g", OCC)
def _(t):
    out = ops.global_pattern_stats(t.f_occurrences, t.f_patterns)
    return out.drop("complexity_level").withColumn("avg_confidence", F.round("avg_confidence", 9))


@query("global_totals", GLOBAL + """
SELECT count(*) AS total_patterns, CAST(sum(total_occurrences) AS BIGINT) AS total_occurrences, (SELECT count(DISTINCT repository_id) FROM f_occurrences) AS total_repositories,
  count(*) FILTER (is_antipattern) AS antipatterns_count, string_agg(DISTINCT category, '|' ORDER BY category) AS categories FROM g""", OCC)
def _(t):
    return ops.global_totals(t.f_occurrences, t.f_patterns).withColumn("categories", joined("categories"))


@query("top_patterns", """
SELECT name, count(*) * count(DISTINCT repository_id) AS popularity_score FROM f_name_occurrences o JOIN f_name_patterns p USING (pattern_id)
GROUP BY pattern_id, name ORDER BY popularity_score DESC, pattern_id LIMIT 10""", WIDE)
def _(t):
    return ops.top_patterns(t.f_name_occurrences, t.f_name_patterns).select("name", "popularity_score")


@query("complexity_distribution", """
SELECT repository_id, count(*) FILTER (lvl = 'simple') AS simple, count(*) FILTER (lvl = 'intermediate') AS intermediate, count(*) FILTER (lvl = 'advanced') AS advanced
FROM (SELECT DISTINCT repository_id, pattern_id, coalesce(complexity_level, 'intermediate') AS lvl FROM f_name_occurrences JOIN f_name_patterns USING (pattern_id)) GROUP BY 1""", WIDE)
def _(t):
    stats = ops.pattern_stats_light(t.f_name_occurrences, t.f_name_patterns)
    stats = stats.join(t.f_name_patterns.select("pattern_id", "complexity_level"), "pattern_id")
    return ops.complexity_distribution(stats, ["repository_id"])


@query("latest_occurrence", """
SELECT repository_id, occurrence_id, pattern_id, detected_at FROM f_occurrences
QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY detected_at DESC, occurrence_id DESC) = 1""", "f_occurrences")
def _(t):
    return ops.latest_occurrence(t.f_occurrences).select("repository_id", "occurrence_id", "pattern_id", "detected_at")


@query("pattern_reach", """
WITH o AS (SELECT pattern_id, CAST(date_trunc('month', detected_at) AS DATE) AS month, file_path FROM f_occurrences)
SELECT pattern_id, month, count(DISTINCT file_path) AS reached, count(*) AS facts FROM o GROUP BY 1, 2 UNION ALL SELECT pattern_id, NULL, count(DISTINCT file_path), count(*) FROM o GROUP BY 1""", OCC)
def _(t):
    """Distinct files per pattern, by month and over all time, from the sets of days."""
    occ = t.f_occurrences.withColumn("day", F.to_date("detected_at"))
    days = written(reach.parts(occ, ["pattern_id", "day"], "file_path", reach.numbers(occ, "file_path")), "reach")
    months = reach.counts(days.withColumn("month", F.trunc("day", "month")), ["pattern_id", "month"])
    return months.unionByName(reach.counts(days, ["pattern_id"]).withColumn("month", F.lit(None).cast("date")))


@query("order_reach", """
SELECT l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS year, count(DISTINCT l_orderkey) AS reached, count(*) AS facts FROM lineitem GROUP BY 1, 2
UNION ALL SELECT l_returnflag, NULL, count(DISTINCT l_orderkey), count(*) FROM lineitem GROUP BY 1 UNION ALL SELECT NULL, NULL, count(DISTINCT l_orderkey), count(*) FROM lineitem""")
def _(t):
    """Distinct orders per return flag and year, per flag, and in all, from one pass over the lines."""
    lines = t.lineitem.select("l_returnflag", F.year("l_shipdate").alias("year"), "l_orderkey")
    years = written(reach.parts(lines, ["l_returnflag", "year"], "l_orderkey", reach.numbers(lines, "l_orderkey")), "reach")
    flag, year = F.lit(None).cast("string").alias("l_returnflag"), F.lit(None).cast("int").alias("year")
    flags, every = reach.counts(years, ["l_returnflag"]), reach.counts(years, [])
    return reach.counts(years, ["l_returnflag", "year"]).unionByName(flags.select("*", year)).unionByName(every.select("*", flag, year))
