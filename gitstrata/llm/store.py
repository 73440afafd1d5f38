"""Written tables between steps, in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitstrata.session import shared_folder


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as Parquet below ``spark.checkpoint.dir``, read again.

    Cuts the lineage: a lost executor costs its running tasks and no earlier step.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int):
    """crc32 of a number's decimal text, modulo ``modulus``; NULL counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def free(columns: Iterable[str], stem: str) -> str:
    """``stem``, with as many underscores before it as it takes for no column to begin with it."""
    while any(c.lower().startswith(stem) for c in columns):
        stem = f"_{stem}"
    return stem
