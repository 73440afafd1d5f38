"""Commit history: recent commits, roll-ups of file changes, repository totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitstrata.functions import commit_text as ct
from gitstrata.functions.common import non_empty, top_n_per_key
from gitstrata.functions.paths import is_skipped


def drop_skipped(df: DataFrame, path: str = "file_path") -> DataFrame:
    """Leaves out files that a commit analysis does not read."""
    return df.filter(~is_skipped(path))


def recent_commits(commits: DataFrame, n: int | None = None) -> DataFrame:
    """The newest ``n`` commits of each repository; all of them by default."""
    if n is None:
        return commits
    return top_n_per_key(commits, ["repository_id"], [F.desc("committed_date"), F.col("hash")], n)


def classify_commits(commits: DataFrame) -> DataFrame:
    """Intent, breaking flag, message quality and author class per commit."""
    message, email = F.col("message"), F.col("author_email")
    return commits.withColumns(
        {
            "intent": ct.commit_intent(message),
            "is_breaking_message": ct.breaking_message(message),
            "message_quality": ct.message_quality(message),
            "author_class": ct.author_class(email),
        }
    )


def commit_rollup(file_changes: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """Per commit: lines, files, refactoring share, breaking flag, impact and risk.

    ``complexity_change`` is an optional column of the changes (0 when absent).
    With ``commits`` the message's own breaking mark counts too. A commit is known by its hash and, where the
    changes have ``repository_id``, by that as well: forks hold the same hash.
    """
    key = [c for c in ("repository_id", "hash") if c in file_changes.columns]
    change = F.col("complexity_change") if "complexity_change" in file_changes.columns else F.lit(0)
    additions, deletions = F.col("additions"), F.col("deletions")
    per_commit = (
        drop_skipped(file_changes)
        .groupBy(*key)
        .agg(
            F.sum("additions").alias("additions"),
            F.sum("deletions").alias("deletions"),
            F.count("*").alias("files"),
            F.sum(change).cast("long").alias("complexity_change"),
            F.avg(ct.refactor_shaped(additions, deletions).cast("int")).alias("refactoring_score"),
            F.max(ct.breaking_path(F.col("file_path"))).alias("is_breaking"),
        )
    )
    if commits is not None:
        marks = commits.groupBy(*key).agg(F.max(ct.breaking_message(F.col("message"))).alias("_mark"))
        per_commit = (
            per_commit.join(marks, key, "left")
            .withColumn("is_breaking", F.col("is_breaking") | F.coalesce("_mark", F.lit(False)))
            .drop("_mark")
        )
    size = F.col("additions") + F.col("deletions")
    return (
        per_commit.withColumn("net_lines", F.col("additions") - F.col("deletions"))
        .withColumn("commit_size", size)
        .withColumn("is_refactoring", F.col("refactoring_score") > 0.3)
        .withColumn("complexity_impact", ct.complexity_impact(F.col("complexity_change")))
        .withColumn("risk_level", ct.commit_risk(size, F.col("files"), F.col("is_breaking"), F.col("complexity_impact")))
    )


def commits_summary(commits: DataFrame, n: int | None = 10) -> DataFrame:
    """Per repository: all commits counted; lines and authors of the newest ``n``."""
    total = commits.groupBy("repository_id").agg(F.count("*").alias("total_commits"))
    subset = commits if n is None else recent_commits(commits, n)
    sums = subset.groupBy("repository_id").agg(
        F.sum(F.coalesce("additions", F.lit(0))).alias("total_additions"),
        F.sum(F.coalesce("deletions", F.lit(0))).alias("total_deletions"),
        F.countDistinct(non_empty("author_email")).alias("unique_authors"),
    )
    return total.join(sums, "repository_id")


def repository_info(commits: DataFrame) -> DataFrame:
    """Per repository: commits, first and last date, authors."""
    return commits.groupBy("repository_id").agg(
        F.count("*").alias("total_commits"),
        F.min("committed_date").alias("first_commit"),
        F.max("committed_date").alias("last_commit"),
        F.countDistinct("author_email").alias("authors"),
    )
