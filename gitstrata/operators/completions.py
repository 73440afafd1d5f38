"""Model completions: raw text to typed fields, alias fields, tag combination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPLETION = T.StructType(
    [
        T.StructField("patterns", T.ArrayType(T.StringType())),
        T.StructField("complexity_score", T.DoubleType()),
        T.StructField("suggestions", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("processing_time", T.DoubleType()),
        T.StructField("token_usage", T.MapType(T.StringType(), T.LongType())),
    ]
)

# What an unreadable completion stands for.
DEFAULT_PATTERNS = ["unknown"]
DEFAULT_COMPLEXITY = 5.0


def parse_completions(df: DataFrame, text: str = "completion") -> DataFrame:
    """Adds the typed fields and ``parsed``; never fails on a broken text.

    The text is read as it is, else from its first opening to its last closing
    brace, else the default answer is used and the row is flagged.
    """
    raw = F.col(text)
    whole = F.from_json(raw, COMPLETION)
    span = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), COMPLETION)
    answer = F.when(whole["patterns"].isNotNull(), whole).otherwise(span)
    parsed = F.coalesce(answer["patterns"].isNotNull(), F.lit(False))
    return (
        df.withColumn("_answer", answer)
        .withColumn("parsed", parsed)
        .withColumn("patterns", F.when(parsed, F.col("_answer.patterns")).otherwise(F.array(*map(F.lit, DEFAULT_PATTERNS))))
        .withColumn("complexity_score", F.coalesce(F.when(parsed, F.col("_answer.complexity_score")), F.lit(DEFAULT_COMPLEXITY)))
        .withColumn("suggestions", F.coalesce(F.when(parsed, F.col("_answer.suggestions")), F.array().cast("array<string>")))
        .withColumn("confidence", F.when(parsed, F.col("_answer.confidence")))
        .withColumn("processing_time", F.when(parsed, F.col("_answer.processing_time")))
        .withColumn("token_usage", F.when(parsed, F.col("_answer.token_usage")))
        .drop("_answer")
    )


def sync_alias(df: DataFrame, first: str, second: str) -> DataFrame:
    """Two names of one list: the first that is not empty fills both."""
    a, b = F.col(first), F.col(second)
    value = F.when(F.size(a) > 0, a).when(F.size(b) > 0, b).otherwise(F.coalesce(a, b))
    return df.withColumns({first: value, second: value})


def combine_tags(tags: DataFrame, completions: DataFrame) -> DataFrame:
    """Union of rule tags and model tags per candidate with the skill band."""
    joined = tags.join(completions.select("candidate_id", "patterns", "complexity_score"), "candidate_id", "left")
    model = F.coalesce("patterns", F.array().cast("array<string>"))
    score = F.col("complexity_score")
    return joined.select(
        "candidate_id",
        F.array_distinct(F.array_union("tags", model)).alias("combined_patterns"),
        model.alias("model_patterns"),
        score,
        F.when(score <= 3, "beginner").when(score >= 8, "advanced").otherwise("intermediate").alias("skill_level"),
    )
