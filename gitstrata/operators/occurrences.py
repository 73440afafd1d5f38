"""Pattern occurrences: joins to the pattern table, statistics, timelines, trends.

Facts are aggregated before they meet a dimension, so that joins carry one row
per group. Broadcasting is left to Spark's size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.functions.common import latest_per_key, non_empty, resolve_as_of, top_n_per_key


def filter_patterns(
    patterns: DataFrame, category: str | None = None, complexity: str | None = None, antipattern: bool | None = None
) -> DataFrame:
    """Optional restrictions on the pattern dimension."""
    if category is not None:
        patterns = patterns.filter(F.col("category") == category)
    if complexity is not None:
        patterns = patterns.filter(F.col("complexity_level") == complexity)
    if antipattern is not None:
        patterns = patterns.filter(F.col("is_antipattern") == F.lit(antipattern))
    return patterns


def join_patterns(occ: DataFrame, patterns: DataFrame, **filters: object) -> DataFrame:
    """Occurrences with their pattern; those without a kept pattern vanish."""
    return occ.join(filter_patterns(patterns, **filters), "pattern_id")


def with_pattern_name(occ: DataFrame, patterns: DataFrame) -> DataFrame:
    """Adds ``pattern_name``; ``Unknown`` when the pattern is not stored."""
    names = patterns.select("pattern_id", F.col("name").alias("pattern_name"))
    return occ.join(names, "pattern_id", "left").withColumn("pattern_name", F.coalesce("pattern_name", F.lit("Unknown")))


def pattern_stats(occ: DataFrame, patterns: DataFrame, **filters: object) -> DataFrame:
    """Per repository and pattern: counts, files, models, confidence and time range."""
    facts = occ.groupBy("repository_id", "pattern_id").agg(
        F.count("*").alias("total_occurrences"),
        F.countDistinct(non_empty("file_path")).alias("unique_files"),
        # the model set is as small as the model table
        F.array_sort(F.collect_set(non_empty("ai_model_used"))).alias("ai_models_used"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.min("confidence_score").alias("min_confidence"),
        F.max("confidence_score").alias("max_confidence"),
        F.min("detected_at").alias("first_detected"),
        F.max("detected_at").alias("last_detected"),
        F.sum(F.coalesce("processing_time_ms", F.lit(0))).alias("total_processing_time_ms"),
    )
    return join_patterns(facts, patterns, **filters)


def pattern_stats_light(occ: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per repository and pattern: count, mean confidence, files, latest."""
    facts = occ.groupBy("repository_id", "pattern_id").agg(
        F.count("*").alias("occurrences"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.countDistinct(non_empty("file_path")).alias("files_affected"),
        F.max("detected_at").alias("latest_detection"),
    )
    return facts.join(patterns.select("pattern_id", "name", "category"), "pattern_id")


def pattern_summary(occ: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per repository totals over its patterns, distinct files counted once."""
    known = occ.join(patterns.select("pattern_id"), "pattern_id", "left_semi")
    files = known.groupBy("repository_id").agg(F.countDistinct(non_empty("file_path")).alias("unique_files"))
    per_pattern = known.groupBy("repository_id", "pattern_id").agg(F.count("*").alias("n"))
    totals = (
        per_pattern.join(patterns, "pattern_id")
        .groupBy("repository_id")
        .agg(
            F.count("*").alias("total_patterns"),
            F.sum("n").alias("total_occurrences"),
            F.count_if("is_antipattern").alias("antipatterns_count"),
            F.array_sort(F.collect_set("category")).alias("categories"),
            F.array_sort(F.collect_set("complexity_level")).alias("complexity_levels"),
        )
    )
    return totals.join(files, "repository_id")


def pattern_detail(occ: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row per occurrence with the statistics of its pattern in that repository.

    The occurrence list stays in rows; nothing is gathered into one array.
    """
    stats = pattern_stats(occ, patterns).select("repository_id", "pattern_id", "name", "total_occurrences", "unique_files")
    return occ.join(stats, ["repository_id", "pattern_id"])


def pattern_timeline(
    occ: DataFrame,
    patterns: DataFrame,
    days: int | None = None,
    pattern_name: str | None = None,
    as_of: Column | None = None,
    period: str = "day",
) -> DataFrame:
    """Occurrences per repository, day and pattern, with the day's total.

    ``days=None`` keeps all of history. An unknown ``pattern_name`` is an error,
    found by one bounded lookup.
    """
    if pattern_name is not None:
        named = patterns.filter(F.col("name") == pattern_name)
        if named.isEmpty():
            raise ValueError(f"pattern {pattern_name!r} not found")
        occ = occ.join(named.select("pattern_id"), "pattern_id", "left_semi")
    if days is not None:
        occ = occ.filter(F.col("detected_at") >= resolve_as_of(occ, "detected_at", as_of) - F.make_dt_interval(F.lit(days)))
    bucket = F.to_date("detected_at") if period == "day" else F.date_format("detected_at", "yyyy-MM")
    counts = occ.groupBy("repository_id", bucket.alias("period"), "pattern_id").agg(F.count("*").alias("occurrences"))
    day = Window.partitionBy("repository_id", "period")
    return with_pattern_name(counts, patterns).withColumn("period_total", F.sum("occurrences").over(day))


# Name fragments that place a pattern in a chart category.
CHART_CATEGORIES = [("react", "react"), ("async", "async"), ("javascript", "javascript")]


def chart_category(name: Column) -> Column:
    out = F.lit("other")
    for fragment, label in reversed(CHART_CATEGORIES):
        out = F.when(F.lower(name).contains(fragment), label).otherwise(out)
    return out


def monthly_timeline(occ: DataFrame, patterns: DataFrame) -> DataFrame:
    """Occurrences per repository, month and pattern with the inferred category."""
    monthly = pattern_timeline(occ, patterns, period="month")
    return monthly.withColumn("chart_category", chart_category(F.col("pattern_name")))


def pattern_trends(
    occ: DataFrame, patterns: DataFrame, days: int = 30, as_of: Column | None = None, history: str = "window"
) -> DataFrame:
    """Recent against earlier daily rate per repository and pattern.

    ``history="window"`` divides the earlier count by the window length;
    ``"span"`` divides it by the days that really passed before the window.
    """
    now = resolve_as_of(occ, "detected_at", as_of)
    start = now - F.make_dt_interval(F.lit(days))
    counts = occ.groupBy("repository_id", "pattern_id").agg(
        F.count_if(F.col("detected_at") >= start).alias("recent_count"),
        F.count("*").alias("all_time_count"),
        F.greatest(F.datediff(start, F.min("detected_at")), F.lit(1)).alias("span_days"),
    )
    length = F.col("span_days") if history == "span" else F.lit(max(days, 1))
    trends = (
        counts.withColumn("recent_avg_per_day", F.col("recent_count") / F.lit(days))
        .withColumn("historical_avg_per_day", (F.col("all_time_count") - F.col("recent_count")) / length)
        .withColumn(
            "trend_percentage",
            F.when(
                F.col("historical_avg_per_day") > 0,
                F.try_divide(F.col("recent_avg_per_day") - F.col("historical_avg_per_day"), F.col("historical_avg_per_day")) * 100,
            )
            .when(F.col("recent_count") > 0, 100.0)
            .otherwise(0.0),
        )
        .drop("span_days")
    )
    pct = F.col("trend_percentage")
    return (
        join_patterns(trends, patterns)
        .withColumn("trend_direction", F.when(pct > 10, "increasing").when(pct < -10, "decreasing").otherwise("stable"))
        .withColumn("significance", F.when(F.abs(pct) > 50, "high").when(F.abs(pct) > 20, "medium").otherwise("low"))
    )


def trend_summary(trends: DataFrame) -> DataFrame:
    """Per repository: patterns per direction, strong trends, rising antipatterns."""
    rising = F.col("trend_direction") == "increasing"
    return trends.groupBy("repository_id").agg(
        F.count("*").alias("total_patterns_analyzed"),
        F.count_if(rising).alias("increasing_patterns"),
        F.count_if(F.col("trend_direction") == "decreasing").alias("decreasing_patterns"),
        F.count_if(F.col("trend_direction") == "stable").alias("stable_patterns"),
        F.count_if(F.col("significance") == "high").alias("high_significance_trends"),
        F.count_if(rising & F.col("is_antipattern")).alias("rising_antipatterns"),
    )


def rising_patterns(trends: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` strongest rising patterns of each repository."""
    rising = trends.filter(F.col("trend_direction") == "increasing")
    return top_n_per_key(rising, ["repository_id"], [F.abs("trend_percentage").desc(), F.col("name")], n, rank="position")


def global_pattern_stats(occ: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every stored pattern with its use over all repositories; unused ones show 0."""
    facts = occ.groupBy("pattern_id").agg(
        F.count("*").alias("total_occurrences"),
        F.countDistinct("repository_id").alias("repositories_count"),
        F.countDistinct(non_empty("file_path")).alias("unique_files_count"),
        F.avg("confidence_score").alias("avg_confidence"),
    )
    zero = {"total_occurrences": 0, "repositories_count": 0, "unique_files_count": 0, "avg_confidence": 0.0}
    return (
        patterns.join(facts, "pattern_id", "left")
        .fillna(zero)
        .withColumn("popularity_score", F.col("total_occurrences") * F.col("repositories_count"))
    )


def global_totals(occ: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row: patterns, occurrences, repositories, antipatterns, categories."""
    stats = global_pattern_stats(occ, patterns)
    repositories = occ.select(F.countDistinct("repository_id")).scalar()
    return stats.agg(
        F.count("*").alias("total_patterns"),
        F.sum("total_occurrences").alias("total_occurrences"),
        F.count_if("is_antipattern").alias("antipatterns_count"),
        F.array_sort(F.collect_set("category")).alias("categories"),
    ).withColumn("total_repositories", repositories)


def top_patterns(occ: DataFrame, patterns: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most popular patterns, ties by identifier."""
    return global_pattern_stats(occ, patterns).orderBy(F.desc("popularity_score"), "pattern_id").limit(n)


def complexity_distribution(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Patterns per level; a missing level is intermediate, unknown levels are ignored."""
    level = F.coalesce(non_empty("complexity_level"), F.lit("intermediate"))
    return stats.groupBy(*keys).agg(*[F.count_if(level == name).alias(name) for name in ("simple", "intermediate", "advanced")])


def latest_occurrence(occ: DataFrame) -> DataFrame:
    """Newest occurrence of each repository."""
    return latest_per_key(occ, ["repository_id"], ["detected_at", "occurrence_id"])
