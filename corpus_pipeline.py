"""From raw documents to training shards: quality rules, near-duplicates, decontamination, mixing, sharding.

Every stage takes the documents that its predecessor kept and returns documents; the last
adds ``shard``, ``slot`` and ``position``. The mixing stage's decision is the order of the rows it writes; the
last stage reads that order from the files and keeps it as ``position``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gitstrata.llm import dart_minhash, pfair_mix, quality_rules, template_windows, uniform_shards
from gitstrata.llm.store import free, table, written

SHARDS = 40
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return dart_minhash.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return template_windows.keep(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    mixed = pfair_mix.mix(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "source"))
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, their slot in it, and ``position``, their place in the mixture: a shard read in this order is mixed."""
    return uniform_shards.shuffle(placed(docs), SHARDS)


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``position``, the row's place in the order of the files it was read from; NULL if it comes from no file.

    A column of that name is replaced. One number per file is added up; the rows are not sorted.
    """
    docs = docs.drop("position")
    own = free(docs.columns, "file_")
    try:
        rows = docs.withColumns({f"{own}name": F.col("_metadata.file_path"), f"{own}row": F.col("_metadata.row_index")})
    except AnalysisException:
        return docs.withColumn("position", F.lit(None).cast("long"))
    sizes = rows.groupBy(f"{own}name").agg(F.count(F.lit(1)).alias(f"{own}rows"))
    before = F.sum(f"{own}rows").over(Window.orderBy(f"{own}name")) - F.col(f"{own}rows")
    sizes = sizes.select(f"{own}name", before.alias(f"{own}before"))
    position = (F.col(f"{own}before") + F.col(f"{own}row")).alias("position")
    # One row per file: sent to the tasks, so that no text is shuffled to meet its file's number.
    return rows.join(F.broadcast(sizes), f"{own}name").select(*[f"`{c}`" for c in docs.columns], position)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
