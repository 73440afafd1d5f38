"""Idempotent stores: append, upsert, get-or-create, logs, copies, expiry, paging."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gitstrata.functions.common import latest_per_key, non_empty, resolve_as_of

COMMIT_KEY = ["repository_id", "hash"]
TECHNOLOGY_KEY = ["repository_id", "name", "category"]
RUN_LOG = (
    "timestamp timestamp, repo_url string, model_id string, commit_count long, candidates long, "
    "estimated_tokens long, task_counts map<string,long>, duration_seconds double"
)


def natural_key(*columns: str) -> Column:
    """A stable identifier made from the natural key, the same on every run."""
    return F.sha2(F.concat_ws("|", *columns), 256)


def new_commits(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Commits of the batch that are not stored yet, one per key."""
    rest = [c for c in batch.columns if c not in COMMIT_KEY]
    once = latest_per_key(batch, COMMIT_KEY, rest)
    return once.join(existing.select(*COMMIT_KEY), COMMIT_KEY, "left_anti")


def append_commits(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The stored commits with the new ones added; a repeated batch changes nothing."""
    return existing.unionByName(new_commits(existing, batch), allowMissingColumns=True)


def merge_technologies(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds usage, widens the time range and keeps the newest known version."""
    both = existing.unionByName(batch)
    version = non_empty("version")
    return both.groupBy(*TECHNOLOGY_KEY).agg(
        F.sum("usage_count").alias("usage_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max_by(version, F.when(version.isNotNull(), F.struct("last_seen", version.alias("v")))).alias("version"),
    )


def ensure_rows(dim: DataFrame, wanted: DataFrame, key: str, id_column: str) -> DataFrame:
    """Get or create: the dimension plus one row per natural key it lacks."""
    missing = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(dim.select(key), key, "left_anti")
    created = missing.withColumn(id_column, natural_key(key))
    return dim.unionByName(created, allowMissingColumns=True)


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    df.write.mode("append").json(path)


def read_log(df_session, path: str, schema: str = RUN_LOG) -> DataFrame:
    """Reads a JSON-lines log with its declared schema."""
    return df_session.read.schema(schema).json(path)


def copy_tables(read: Callable[[str], DataFrame], write: Callable[[str, DataFrame], None], names: Sequence[str]) -> None:
    """Copies whole tables from one store to another, each as one distributed job."""
    for name in names:
        write(name, read(name))


def drop_expired(df: DataFrame, column: str, ttl_days: int | None = None, as_of: Column | None = None) -> DataFrame:
    """Rows still alive: younger than ``ttl_days``, or with their own expiry still ahead."""
    now = resolve_as_of(df, column, as_of)
    if ttl_days is None:
        return df.filter(F.col(column).isNull() | (F.col(column) > now))
    return df.filter(F.col(column) >= now - F.make_dt_interval(F.lit(ttl_days)))


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order, with the total and whether more follows."""
    total = df.select(F.count("*")).scalar()
    return (
        df.orderBy(*order)
        .offset(offset)
        .limit(limit)
        .withColumn("total", total)
        .withColumn("has_more", F.lit(offset + limit) < F.col("total"))
    )


def write_ranked(df: DataFrame, order: Sequence[Column | str], path: str) -> None:
    """The rows in a total order, over range partitions, with the number of rows before each partition: pages at any depth.

    The order is found once. No task sees more than a range of it, and what is added up is one number per partition.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # The id holds the partition in its upper bits and the place in the partition in its lower 33.
    part, place = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    rows.select(*df.columns, place.alias("_place"), part.alias("_part")).write.partitionBy("_part").parquet(f"{path}/rows")
    sizes = df.sparkSession.read.parquet(f"{path}/rows").groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")
    sizes.withColumn("_before", before).coalesce(1).write.parquet(f"{path}/sizes")


def ranked_page(spark: SparkSession, path: str, limit: int, offset: int = 0) -> DataFrame:
    """One page of rows written by ``write_ranked``; only the partitions that hold it are read."""
    sizes = spark.read.parquet(f"{path}/sizes")
    total = sizes.select(F.coalesce(F.sum("_rows"), F.lit(0))).scalar()
    held = sizes.filter((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_rows") > offset)).select("_part", "_before")
    rows = spark.read.parquet(f"{path}/rows").join(held, "_part").withColumn("position", F.col("_before") + F.col("_place"))
    page = rows.filter(F.col("position").between(offset, offset + limit - 1)).drop("_part", "_place", "_before")
    return page.withColumn("total", total).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def page_after(df: DataFrame, order: dict[str, str], last: dict[str, Column], limit: int) -> DataFrame:
    """The page behind the row ``last``; ``order`` leads from column to ``asc`` or ``desc``. Columns must not be NULL.

    The condition on the first column reaches the scan, and every partition keeps its first ``limit`` rows.
    """
    behind, equal = F.lit(False), F.lit(True)
    for column, direction in order.items():
        further = F.col(column) > last[column] if direction == "asc" else F.col(column) < last[column]
        behind, equal = behind | (equal & further), equal & (F.col(column) == last[column])
    first, direction = next(iter(order.items()))
    bound = F.col(first) >= last[first] if direction == "asc" else F.col(first) <= last[first]
    sort = [F.asc(c) if d == "asc" else F.desc(c) for c, d in order.items()]
    return df.filter(bound & behind).orderBy(*sort).limit(limit)


def by_repository(df: DataFrame, repository_id: str) -> DataFrame:
    return df.filter(F.col("repository_id") == repository_id)


def by_url(repositories: DataFrame, url: str) -> DataFrame:
    return repositories.filter(F.col("url") == url)
