"""File measures rolled up to repository quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitstrata.functions import quality as q
from gitstrata.functions.common import top_n_per_key

# Weight of each metric category in the overall score.
CATEGORY_WEIGHTS = {"complexity": 0.3, "documentation": 0.2, "style": 0.2, "maintainability": 0.15, "testability": 0.15}
OTHER_WEIGHT = 0.1


def file_metrics(measures: DataFrame) -> DataFrame:
    """Long form: one row per file and metric with value, score, severity and advice."""

    def metric(name, category, value, score, warn, advice):
        return F.struct(
            F.lit(name).alias("metric"), F.lit(category).alias("category"), value.alias("value"), score.alias("score"),
            F.when(warn, "warning").otherwise("info").alias("severity"), advice.alias("recommendations"),
        )

    cyclo, doc, style = F.col("cyclomatic"), F.col("documentation_coverage"), F.col("style_score")
    rows = F.array(
        metric("cyclomatic_complexity", "complexity", cyclo, F.col("complexity_score"), cyclo > 10, q.complexity_advice(cyclo)),
        metric("documentation_coverage", "documentation", doc, doc, doc < 50, q.documentation_advice(doc)),
        metric("style_consistency", "style", style, style, style < 70, q.style_advice(style)),
    )
    return measures.select("repository_id", "path", F.explode(rows).alias("m")).select("repository_id", "path", "m.*")


def metric_means(metrics: DataFrame) -> DataFrame:
    """Mean value and score per repository and metric; a warning in any file stays a warning."""
    return metrics.groupBy("repository_id", "metric", "category").agg(
        F.avg("value").alias("value"), F.avg("score").alias("score"), F.count("*").alias("files"), F.max("severity").alias("severity")
    )


def quality_report(measures: DataFrame) -> DataFrame:
    """Per repository: weighted score, debt, maintainability, testability and averages."""
    means = metric_means(file_metrics(measures))
    weight = F.lit(OTHER_WEIGHT)
    for category, value in CATEGORY_WEIGHTS.items():
        weight = F.when(F.col("category") == category, value).otherwise(weight)
    score = F.col("score")
    structural = F.col("category").isin("complexity", "documentation", "style")
    scores = means.groupBy("repository_id").agg(
        (F.sum(score * weight) / F.sum(weight)).alias("overall_score"),
        F.coalesce(F.avg(F.when(score < 60, 100 - score)), F.lit(0.0)).alias("technical_debt_score"),
        F.coalesce(F.avg(F.when(structural, score)), F.lit(50.0)).alias("maintainability_index"),
        F.coalesce(F.avg(F.when(F.col("category").contains("complexity"), score)), F.lit(50.0)).alias("testability_score"),
    )
    totals = measures.groupBy("repository_id").agg(
        F.count("*").alias("files_analyzed"),
        F.sum("lines").alias("total_lines"),
        F.avg("cyclomatic").alias("average_complexity"),
        F.avg("documentation_coverage").alias("documentation_coverage"),
        F.avg("style_score").alias("style_consistency"),
    )
    return totals.join(scores, "repository_id")


def top_recommendations(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent advice per repository."""
    counts = (
        metrics.select("repository_id", F.explode("recommendations").alias("recommendation"))
        .groupBy("repository_id", "recommendation")
        .agg(F.count("*").alias("count"))
    )
    return top_n_per_key(counts, ["repository_id"], [F.desc("count"), F.col("recommendation")], n, rank="position")
