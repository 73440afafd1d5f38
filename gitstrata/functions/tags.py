"""Rule-of-thumb tags, complexity, skill level and suggestions, all in one projection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.common import compact_list
from gitstrata.rules import tags as rules


def _literal_count(text: Column, word: str) -> Column:
    return F.regexp_count(text, F.lit(re.escape(word)))


def _holds(text: Column, alternatives: list[list[str]]) -> Column:
    out = F.lit(False)
    for words in alternatives:
        every = F.lit(True)
        for word in words:
            every = every & text.contains(word)
        out = out | every
    return out


def simple_tags(content: Column, language: Column) -> Column:
    """Distinct tags of a text."""
    lower = F.lower(content)
    lang = F.lower(F.coalesce(language, F.lit("")))
    items = []
    for languages, table in rules.TAGS_BY_LANGUAGE.items():
        gate = lang.isin(languages.split())
        items += [(gate & _holds(lower, alternatives), tag) for tag, alternatives in table]
    items += [(_holds(lower, alternatives), tag) for tag, alternatives in rules.TAGS_ANY_LANGUAGE]
    items.append((F.size(F.split(content, "\n")) > rules.LARGE_BLOCK_LINES, "large_code_block"))
    many = rules.MANY_FUNCTIONS
    items.append(((_literal_count(content, "function") > many) | (_literal_count(content, "def ") > many), "multi_function_module"))
    return F.array_distinct(compact_list(*items))


def complexity_score(content: Column, tags: Column) -> Column:
    """Tenth of the sum of tags, branches, loops, functions, classes and lines, within 1 to 10."""
    words = ["if", "for", "while", "function", "def", "class"]
    total = F.size(tags) + F.size(F.split(content, "\n"))
    for word in words:
        total = total + _literal_count(content, word)
    return F.least(F.lit(10.0), F.greatest(F.lit(1.0), total / 10))


def skill_level(tags: Column, score: Column) -> Column:
    advanced = F.arrays_overlap(tags, F.array(*map(F.lit, rules.ADVANCED_TAGS)))
    medium = F.arrays_overlap(tags, F.array(*map(F.lit, rules.INTERMEDIATE_TAGS)))
    return F.when(advanced | (score > 7), "advanced").when(medium | (score > 4), "intermediate").otherwise("beginner")


def suggestions(tags: Column, score: Column, language: Column) -> Column:
    """What to improve, in a fixed order."""
    script = F.lower(language).isin("javascript", "typescript")
    return compact_list(
        (score > 8, "split complex functions"),
        (~F.array_contains(tags, "error_handling"), "add error handling"),
        (script & ~F.array_contains(tags, "async_await_pattern"), "use async and await"),
        (F.size(tags) < 3, "try more patterns"),
        (F.lit(True), "enable model analysis"),
    )


def with_tags(files: DataFrame, content: str = "content", language: str = "language") -> DataFrame:
    """Adds ``tags``, ``complexity_score``, ``skill_level`` and ``suggestions``."""
    return (
        files.withColumn("tags", simple_tags(F.col(content), F.col(language)))
        .withColumn("complexity_score", complexity_score(F.col(content), F.col("tags")))
        .withColumn("skill_level", skill_level(F.col("tags"), F.col("complexity_score")))
        .withColumn("suggestions", suggestions(F.col("tags"), F.col("complexity_score"), F.col(language)))
    )
