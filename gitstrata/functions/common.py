"""Small building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_as_of(df: DataFrame, column: str, as_of: Column | None = None) -> Column:
    """The given point in time, or the latest event time of ``df``.

    The default is a scalar subquery: one column is scanned and reduced on the
    executors, and no cross join is planned.
    """
    return as_of if as_of is not None else df.select(F.max(column)).scalar()


def non_empty(column: str | Column) -> Column:
    """NULL for the empty string, which counts as missing everywhere here."""
    col = F.col(column) if isinstance(column, str) else column
    return F.nullif(col, F.lit(""))


def contains_any(column: Column, words: Iterable[str]) -> Column:
    """True when any of the literal ``words`` occurs in ``column``."""
    test = F.lit(False)
    for word in words:
        test = test | column.contains(word)
    return test


def count_literal(column: Column, literal: str) -> Column:
    """Number of non-overlapping occurrences of a literal substring."""
    return (F.length(column) - F.length(F.replace(column, F.lit(literal), F.lit("")))) / F.lit(len(literal))


def compact_list(*items: tuple[Column, str | Column]) -> Column:
    """The texts whose condition holds, in the order given."""
    return F.array_compact(
        F.array(*[F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in items])
    )


def banded(column: Column, bands: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """First label whose lower bound is reached; bounds go from high to low."""
    out = None
    for bound, label in bands:
        test = column >= F.lit(bound)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the largest ``order`` per key.

    Done as a ``max_by`` aggregate, so a hot key is reduced on the map side and
    never sorted whole in one task as a window would.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hash-dealt by ``keys`` into parts that grow in number with its splits, for steps that group by these keys.

    What groups by ``keys`` and more needs no other shuffle. The number is fixed, because parts that are put together by their
    size on disk hold millions of rows where these pack well, and sorting them is what a task's memory goes into.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, 8 * df.rdd.getNumPartitions()), *keys)


def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 32, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows per key in a total order, in two steps.

    A salt splits each key over ``salts`` tasks that keep ``n`` rows apiece; the
    second step ranks at most ``salts * n`` rows per key. Exact for any skew.
    """
    atomic = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*atomic), F.lit(salts)))
    near = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_rank", F.row_number().over(near)).filter(F.col("_rank") <= n).drop("_rank", "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    out = kept.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def joined(column: str | Column, sep: str = "|") -> Column:
    """Sorted, distinct values of an array as one text."""
    return F.array_join(F.array_sort(F.array_distinct(column)), sep)
