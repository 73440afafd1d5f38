"""Model results: performance, detected patterns, complexity, sessions, benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.common import latest_per_key, non_empty, resolve_as_of, top_n_per_key


def join_models(results: DataFrame, models: DataFrame) -> DataFrame:
    """Results with their model; rows of unknown models are dropped."""
    return results.join(models, "model_name")


def recent_session_results(results: DataFrame, sessions: DataFrame, n: int = 10) -> DataFrame:
    """Results that belong to the newest ``n`` sessions of their repository."""
    recent = top_n_per_key(
        sessions.select("session_id", "repository_id", "started_at"),
        ["repository_id"],
        [F.desc("started_at"), F.col("session_id")],
        n,
    )
    return results.join(recent.select("session_id", "repository_id"), "session_id")


def model_performance(
    results: DataFrame,
    models: DataFrame,
    days: int | None = 30,
    as_of: Column | None = None,
    model_name: str | None = None,
) -> DataFrame:
    """Per model: volume, cost, success share, averages and distinct detected patterns.

    Distinct patterns come from their own exploded branch, so a result with many
    patterns does not multiply the sums.
    """
    if model_name is not None:
        results = results.filter(F.col("model_name") == model_name)
    if days is not None:
        start = resolve_as_of(results, "created_at", as_of) - F.make_dt_interval(F.lit(days))
        results = results.filter(F.col("created_at") >= start)
    failed = non_empty("error_message").isNotNull()
    facts = results.groupBy("model_name").agg(
        F.count("*").alias("total_analyses"),
        F.sum(F.coalesce("processing_time", F.lit(0.0))).alias("total_processing_time"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"),
        F.sum("cost_estimate").alias("total_cost"),
        F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("avg_confidence_score"),
        F.coalesce(F.avg("complexity_score"), F.lit(0.0)).alias("avg_complexity_score"),
        F.count_if(failed).alias("errors"),
    )
    patterns = (
        results.select("model_name", F.explode("detected_patterns").alias("pattern"))
        .groupBy("model_name")
        .agg(F.countDistinct("pattern").alias("unique_patterns_detected"))
    )
    n = F.col("total_analyses")
    out = (
        facts.withColumn("success_rate", (n - F.col("errors")) / n * 100)
        .withColumn("avg_processing_time", F.col("total_processing_time") / n)
        .withColumn("avg_tokens_per_analysis", F.col("total_tokens") / n)
        .withColumn("avg_cost_per_analysis", F.col("total_cost") / n)
        .join(patterns, "model_name", "left")
        .fillna({"unique_patterns_detected": 0})
    )
    return join_models(out, models)


def model_performance_summary(performance: DataFrame) -> DataFrame:
    """Totals over models; the success rate is the plain mean of the models' rates."""
    return performance.agg(
        F.count("*").alias("total_models"),
        F.coalesce(F.sum("total_analyses"), F.lit(0)).alias("total_analyses"),
        F.coalesce(F.sum("total_processing_time"), F.lit(0.0)).alias("total_processing_time"),
        F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.avg("success_rate"), F.lit(0.0)).alias("avg_success_rate"),
    )


def models_with_stats(models: DataFrame, results: DataFrame, only_available: bool = False) -> DataFrame:
    """Each stored model with its statistics; models without results show zero."""
    if only_available:
        models = models.filter("is_available")
    stats = model_performance(results, models.select("model_name"), days=None)
    zero = {c: 0 for c in ("total_analyses", "total_tokens", "errors", "unique_patterns_detected")}
    zero |= {c: 0.0 for c in ("total_cost", "success_rate", "avg_confidence_score", "total_processing_time")}
    return models.join(stats, "model_name", "left").fillna(zero)


def availability_counts(models: DataFrame) -> DataFrame:
    return models.agg(F.count("*").alias("total_models"), F.count_if("is_available").alias("available_models"))


def pattern_frequency(results: DataFrame, keys: list[str] | None = None, per_result: bool = True) -> DataFrame:
    """How often each pattern is detected; once per result, or every mention."""
    keys = keys or []
    names = F.array_distinct("detected_patterns") if per_result else F.col("detected_patterns")
    return results.select(*keys, F.explode(names).alias("pattern")).groupBy(*keys, "pattern").agg(F.count("*").alias("count"))


def top_detected(results: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The ``n`` most frequent detected patterns per key, with unique and total counts."""
    counts = pattern_frequency(results, keys, per_result=False)
    totals = counts.groupBy(*keys).agg(
        F.count("*").alias("total_unique_patterns"), F.sum("count").alias("total_pattern_occurrences")
    )
    top = top_n_per_key(counts, keys, [F.desc("count"), F.col("pattern")], n, rank="position")
    return top.join(totals, keys)


def complexity_assessment(results: DataFrame, keys: list[str]) -> DataFrame:
    """Mean complexity (missing and zero scores skipped), its word and its histogram."""
    score = F.nullif("complexity_score", F.lit(0.0))
    out = results.groupBy(*keys).agg(
        F.avg(score).alias("average_complexity"),
        F.count(score).alias("total_analyses"),
        F.count_if(score < 4).alias("low"),
        F.count_if((score >= 4) & (score < 7)).alias("medium"),
        F.count_if(score >= 7).alias("high"),
    )
    mean = F.col("average_complexity")
    return out.filter(F.col("total_analyses") > 0).withColumn(
        "complexity_trend", F.when(mean > 6, "increasing").when(mean < 4, "decreasing").otherwise("stable")
    )


def models_by_repository(analyses: DataFrame, occ: DataFrame) -> DataFrame:
    """Analyses per repository and model from stored analyses and raw occurrences.

    ``analyses`` holds pattern and quality rows, whose missing model is
    ``unknown``; occurrences without a model are left out.
    """
    stored = analyses.filter(F.col("analysis_type").isin("pattern", "quality")).select(
        "repository_id",
        F.coalesce(non_empty("model_used"), F.lit("unknown")).alias("model"),
        F.col("analysis_type").alias("source"),
        F.col("created_at").alias("at"),
    )
    raw = occ.filter(non_empty("ai_model_used").isNotNull()).select(
        "repository_id", F.col("ai_model_used").alias("model"), F.lit("occurrence").alias("source"), F.col("detected_at").alias("at")
    )
    return (
        stored.unionByName(raw)
        .groupBy("repository_id", "model")
        .agg(F.array_sort(F.collect_set("source")).alias("analysis_types"), F.count("*").alias("count"), F.max("at").alias("latest"))
    )


def rerun_decision(
    repositories: DataFrame, analyses: DataFrame, occ: DataFrame, requested_model: str, force: bool = False
) -> DataFrame:
    """Whether a repository must be analysed again for ``requested_model``.

    The model of the newest pattern or quality analysis decides, else the newest
    model in the wider listing; none found or a different one means a re-run.
    """
    relevant = analyses.filter(F.col("analysis_type").isin("pattern", "quality"))
    newest = latest_per_key(
        relevant.select("repository_id", "created_at", "analysis_id", F.col("model_used").alias("stored_model")),
        ["repository_id"],
        ["created_at", "analysis_id"],
    ).select("repository_id", "stored_model")
    listed = latest_per_key(
        models_by_repository(analyses, occ).select("repository_id", "latest", F.col("model").alias("listed_model")),
        ["repository_id"],
        ["latest", "listed_model"],
    ).select("repository_id", "listed_model")
    found = F.coalesce("stored_model", "listed_model")
    return (
        repositories.select("repository_id", "status")
        .join(newest, "repository_id", "left")
        .join(listed, "repository_id", "left")
        .select(
            "repository_id",
            "status",
            found.alias("latest_model"),
            (F.lit(force) | (F.col("status") != "completed") | found.isNull() | (found != requested_model)).alias("rerun"),
        )
    )


def model_comparison(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and pattern: share of the key's models that report it; consensus when all do."""
    total = results.groupBy(*keys).agg(F.countDistinct("model_name").alias("models"))
    votes = (
        results.select(*keys, "model_name", F.explode("detected_patterns").alias("pattern"))
        .groupBy(*keys, "pattern")
        .agg(F.countDistinct("model_name").alias("votes"))
    )
    return (
        votes.join(total, keys)
        .withColumn("agreement", F.col("votes") / F.col("models"))
        .withColumn("is_consensus", F.col("votes") == F.col("models"))
    )


def model_cost_and_speed(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: fastest model by mean time, total cost, cheapest model."""
    per_model = results.groupBy(*keys, "model_name").agg(
        F.avg("processing_time").alias("mean_time"), F.sum("cost_estimate").alias("cost")
    )
    return per_model.groupBy(*keys).agg(
        F.min_by("model_name", F.struct("mean_time", "model_name")).alias("fastest_model"),
        F.min("mean_time").alias("fastest_time"),
        F.sum("cost").alias("total_cost"),
        F.count("*").alias("models"),
    )


def model_benchmarks(benchmarks: DataFrame) -> DataFrame:
    """Latest record per model, benchmark and version."""
    return latest_per_key(benchmarks, ["model_id", "benchmark_name", "version"], ["date", "record_id"])


def run_accounting(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Per run: candidates, analysed ones, estimated tokens, size and duration."""
    cand = candidates.groupBy("session_id").agg(
        F.count("*").alias("candidates"),
        F.sum(F.floor(F.length("code") / 4)).alias("estimated_tokens"),
        (F.sum(F.octet_length("code")) / F.lit(1024.0**3)).alias("size_gb"),
    )
    done = results.groupBy("session_id").agg(
        F.count("*").alias("analyzed"),
        F.count_if(non_empty("error_message").isNotNull()).alias("failed"),
        F.sum("processing_time").alias("duration_seconds"),
    )
    return cand.join(done, "session_id", "left").fillna({"analyzed": 0, "failed": 0, "duration_seconds": 0.0})


def pattern_rollup(matches: DataFrame) -> DataFrame:
    """Matches per repository and normalised pattern name: count, best confidence, files."""
    name = F.replace(F.lower("pattern_name"), F.lit(" "), F.lit("_"))
    return (
        matches.withColumn("pattern", name)
        .groupBy("repository_id", "pattern")
        .agg(
            F.count("*").alias("occurrences"),
            F.max("confidence").alias("confidence"),
            F.max_by("category", F.struct("confidence", "category")).alias("category"),
            F.countDistinct("file_path").alias("files"),
        )
    )
