"""Reading source trees into the ``files`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitstrata.functions.paths import in_skipped_directory


def read_files(spark: SparkSession, path: str, view: str = "snapshot") -> DataFrame:
    """Every file below ``path`` as ``path, content, n_bytes``, skipped directories left out.

    A checkout of many small files reads as binary; larger collections should be
    kept as a Parquet table with the same columns. Bytes that are not UTF-8 are
    replaced, as a reader with ``errors="ignore"`` would lose them.
    """
    root = path.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = F.regexp_replace("path", r"^file:/+", "/")
    relative = F.regexp_extract(full, r"^\Q" + root + r"\E/(.*)$", 1)
    files = raw.select(relative.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("n_bytes"))
    return files.filter(~in_skipped_directory("path", view))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """One table in Parquet, ORC, CSV or JSON; text formats want an explicit schema."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt in ("csv", "json"):
        raise ValueError("give a schema: inferring one reads the data twice")
    return reader.load(path)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A plain scan with too few splits for the cores, hash-spread over them.

    Scanning text is bound by CPU. A table with as many splits as cores is left as
    it is, so at scale nothing is shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def write_facts(df: DataFrame, path: str, time_column: str, fmt: str = "parquet", mode: str = "append") -> None:
    """A fact table in monthly partitions, clustered by repository inside each file."""
    month = F.date_format(time_column, "yyyy-MM")
    cluster = [c for c in ("repository_id",) if c in df.columns]
    (
        df.withColumn("month", month)
        .repartition("month", *cluster)
        .sortWithinPartitions("month", *cluster)
        .write.mode(mode)
        .partitionBy("month")
        .format(fmt)
        .save(path)
    )
