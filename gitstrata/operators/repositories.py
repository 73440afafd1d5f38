"""Repositories and users: listings, statistics, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.common import latest_per_key

KEY = "repository_id"


def repositories_with_stats(
    repositories: DataFrame, commits: DataFrame, technologies: DataFrame, occurrences: DataFrame, sessions: DataFrame
) -> DataFrame:
    """Each repository with its counts and its latest session; zero and ``not_analyzed`` where none."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(KEY).agg(F.count("*").alias(name))

    latest = latest_per_key(sessions.select(KEY, "started_at", "session_id", F.col("status").alias("latest_status")), [KEY], ["started_at", "session_id"])
    return (
        repositories.join(counted(commits, "commits"), KEY, "left")
        .join(counted(technologies, "technologies"), KEY, "left")
        .join(counted(occurrences, "occurrences"), KEY, "left")
        .join(latest.select(KEY, "latest_status"), KEY, "left")
        .fillna({"commits": 0, "technologies": 0, "occurrences": 0, "latest_status": "not_analyzed"})
    )


def public_repositories(
    repositories: DataFrame, tag: str | None = None, language: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of public repositories, most analysed first; an unset flag means public."""
    out = repositories.filter(F.coalesce("is_public", F.lit(True)))
    if tag is not None:
        out = out.filter(F.array_contains("tags", tag))
    if language is not None:
        out = out.filter(F.col("primary_language") == language)
    return out.orderBy(F.coalesce("analysis_count", F.lit(0)).desc(), KEY).offset(offset).limit(limit)


def with_user_flag(repositories: DataFrame, user_repositories: DataFrame, user_id: str) -> DataFrame:
    """Whether the user has the repository, and with what access."""
    own = user_repositories.filter(F.col("user_id") == user_id).select(KEY, F.col("access_type").alias("user_access_type"))
    return repositories.join(own, KEY, "left").withColumn("user_has_repository", F.col("user_access_type").isNotNull())


def not_owned(repositories: DataFrame, user_repositories: DataFrame, user_id: str) -> DataFrame:
    return repositories.join(user_repositories.filter(F.col("user_id") == user_id).select(KEY), KEY, "left_anti")


def user_repositories_of(user_repositories: DataFrame, repositories: DataFrame, user_id: str) -> DataFrame:
    """Repositories of a user; associations without a repository are dropped."""
    return user_repositories.filter(F.col("user_id") == user_id).join(repositories, KEY)


def user_preferences(user_repositories: DataFrame, repositories: DataFrame) -> DataFrame:
    """Long form: one row per user and preferred language or tag."""
    joined = user_repositories.select("user_id", KEY).join(repositories.select(KEY, "primary_language", "tags"), KEY)
    languages = joined.filter(F.col("primary_language").isNotNull()).select("user_id", F.lit("language").alias("kind"), F.col("primary_language").alias("value"))
    tags = joined.select("user_id", F.lit("tag").alias("kind"), F.explode("tags").alias("value"))
    return languages.unionByName(tags).distinct()


def relevance(language_match: Column, shared_tags: Column, analyses: Column, users: Column) -> Column:
    return (
        F.when(language_match, 3.0).otherwise(0.0)
        + shared_tags * 1.5
        + F.when(analyses > 0, F.least(analyses / 10.0, F.lit(2.0))).otherwise(0.0)
        + F.when(users > 0, F.least(users / 5.0, F.lit(1.0))).otherwise(0.0)
    )


def relevant_repositories(user_id: str, user_repositories: DataFrame, repositories: DataFrame, limit: int = 20) -> DataFrame:
    """Repositories the user lacks that fit the user's languages and tags, best first.

    Without any preference, repositories analysed at least once stand in.
    """
    prefs = user_preferences(user_repositories.filter(F.col("user_id") == user_id), repositories)
    languages = prefs.filter("kind = 'language'").select(F.col("value").alias("primary_language"), F.lit(True).alias("language_match"))
    tags = prefs.filter("kind = 'tag'").select(F.col("value").alias("tag"))
    shared = repositories.select(KEY, F.explode("tags").alias("tag")).join(tags, "tag", "left_semi").groupBy(KEY).agg(F.count("*").alias("shared_tags"))
    n_languages = languages.select(F.count("*")).scalar()
    n_tags = tags.select(F.count("*")).scalar()
    analyses, users = F.coalesce("analysis_count", F.lit(0)), F.coalesce("unique_users", F.lit(0))
    pool = (
        not_owned(repositories, user_repositories, user_id)
        .join(languages, "primary_language", "left")
        .join(shared, KEY, "left")
        .fillna({"shared_tags": 0, "language_match": False})
    )
    fits = ((n_languages == 0) | F.col("language_match")) & ((n_tags == 0) | (F.col("shared_tags") > 0))
    none = (n_languages == 0) & (n_tags == 0)
    return (
        pool.filter(fits & (~none | (analyses >= 1)))
        .withColumn("relevance_score", relevance(F.col("language_match"), F.col("shared_tags"), analyses, users))
        .orderBy(F.desc("relevance_score"), KEY)
        .limit(limit)
    )
