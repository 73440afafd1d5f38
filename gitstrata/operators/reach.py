"""Distinct counts that add up: who was reached, as bitmaps over dense numbers.

Values get numbers without gaps. A group's values are bitmaps of 32,768 bits, one per stretch of numbers that occurs, so
sets of days put together by OR are the sets of months or of all time, and counting bits is exact. Facts are read once,
whatever the number of groupings asked for, and stored parts (see ``PartTable``) take in new facts without the old ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def numbers(facts: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """``column, number`` of every value that is not NULL: from 0 without gaps, or on from those already ``known``.

    Values are numbered inside hash buckets, and a bucket begins where those before it end: no task sorts them all.
    """
    values = facts.select(column).filter(F.col(column).isNotNull()).distinct()
    start: Column = F.lit(0).cast("long")
    if known is not None:
        values = values.join(known, column, "left_anti")
        start = known.select(F.coalesce(F.max("number") + 1, F.lit(0).cast("long"))).scalar()
    values = values.withColumn("_bucket", F.pmod(F.xxhash64(column), F.lit(BUCKETS)))
    before = F.sum("count").over(Window.orderBy("_bucket")) - F.col("count")  # at most one row per bucket
    sizes = values.groupBy("_bucket").count().select("_bucket", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(column)) - 1
    fresh = values.withColumn("_within", within).join(sizes, "_bucket").select(column, (start + F.col("_before") + F.col("_within")).alias("number"))
    return fresh if known is None else known.select(column, "number").unionByName(fresh)


def parts(facts: DataFrame, keys: Sequence[str], column: str, numbered: DataFrame) -> DataFrame:
    """``keys, stretch, bits, facts``: the set and the number of facts of each group; a NULL is a fact without value."""
    once = facts.groupBy(*keys, column).agg(F.count("*").alias("facts")).join(numbered, column, "left")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("number"))
    return once.groupBy(*keys, F.bitmap_bucket_number("number").alias("stretch")).agg(bits.alias("bits"), F.sum("facts").alias("facts"))


def merge(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of equal groups as one; ``keys`` may be fewer than those of the parts."""
    return rows.groupBy(*keys, "stretch").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("facts").alias("facts"))


def counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, reached, facts``: distinct values and facts of each group."""
    return merge(rows, keys).groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("reached"), F.sum("facts").alias("facts"))
