"""Structured Streaming jobs.

Sources are file folders; sinks are Parquet folders or idempotent ``foreachBatch``
writes, both in shared storage. Event time must be a ``timestamp``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gitstrata.functions.common import non_empty, resolve_as_of
from gitstrata.operators.health import metric_status
from gitstrata.operators.incremental import FILE, diff_snapshots
from gitstrata.sources.stores import TECHNOLOGY_KEY, new_commits
from gitstrata.sources.versions import KeyedTable, PartTable
from gitstrata.streaming import state


def read_stream(spark: SparkSession, folder: str, schema: StructType | str, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    reader = spark.readStream.schema(schema)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def write_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, into a Parquet folder, exactly once."""
    return stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def write_batches(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_timeline(occ: DataFrame, delay: str = "1 day") -> DataFrame:
    """Occurrences per day and pattern; a day is final once the watermark has passed it."""
    counts = occ.withWatermark("detected_at", delay).groupBy(F.window("detected_at", "1 day"), "repository_id", "pattern_id").agg(F.count("*").alias("occurrences"))
    return counts.select("repository_id", F.to_date("window.start").alias("period"), "pattern_id", "occurrences")


def stream_metric_average(metrics: DataFrame, length: str = "5 minutes", slide: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """Mean of each metric over sliding windows."""
    means = metrics.withWatermark("ts", delay).groupBy(F.window("ts", length, slide), "name").agg(F.avg("value").alias("average"), F.count("*").alias("points"))
    return means.select("name", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "average", "points")


def stream_rate_limit(log: DataFrame, limit: int = 60, window_seconds: int = 60, delay: str = "5 minutes") -> DataFrame:
    """Rejected requests: a user with ``limit`` accepted ones in the window is turned away.

    Rejected requests do not count, so the outcome depends on its own past and is
    kept as state: the accepted times of the last window, at most ``limit`` per user.
    One task sees one user's rows of a micro-batch; ``files_per_batch`` of the source
    bounds them, also for a user that sends a third of all requests.
    """
    return (
        log.withWatermark("ts", delay)
        .select("user_id", "request_id", "ts")
        .groupBy("user_id")
        .applyInPandasWithState(
            state.rate_limiter(limit, window_seconds), state.REJECTED, state.ACCEPTED, "append", "EventTimeTimeout"
        )
    )


def stream_new_commits(commits: DataFrame, delay: str = "7 days") -> DataFrame:
    """Commits with repeats inside the watermark removed."""
    return commits.withWatermark("committed_date", delay).dropDuplicatesWithinWatermark(["repository_id", "hash"])


def commit_merger(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that stores only commits the table does not have; safe to repeat.

    Each batch owns one folder: a retried batch reads the other folders and
    overwrites its own.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.parquet(path).filter(F.col("batch_id") != batch_id).drop("batch_id")
        except AnalysisException:  # the first batch finds no table
            stored = batch.limit(0)
        new_commits(stored, batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return merge


def stream_alerts(metrics: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Points where a metric turns warning or critical, or recovers."""
    flagged = metric_status(metrics.withWatermark("ts", delay))
    return (
        flagged.select("name", "event_id", "ts", "value", "status")
        .groupBy("name")
        .applyInPandasWithState(state.status_transitions, state.ALERT, state.LAST_STATUS, "append", "NoTimeout")
    )


def stream_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Activity sessions: a user's events with no pause longer than ``gap``."""
    grouped = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return grouped.select("user_id", F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "events")


def session_status(events: DataFrame, order: str) -> DataFrame:
    """Latest status per session; terminal ones are closed."""
    out = events.groupBy("session_id").agg(
        F.max_by("status", order).alias("status"), F.min(order).alias("first_step"), F.max(order).alias("last_step"), F.count("*").alias("steps")
    )
    return out.withColumn("is_open", ~F.col("status").isin("completed", "failed", "cancelled"))


def file_watcher(spark: SparkSession, path: str, results_schema: str, scan: Callable[[DataFrame], DataFrame], compact_every: int = 16) -> tuple[Callable[[DataFrame, int], None], KeyedTable]:
    """A batch writer that scans only files that are new or changed, and the table of all results.

    Both the hashes seen so far and the results are kept by file: a batch writes the rows of its changed files and nothing
    else, and a file without findings takes its old ones away. Files absent from a batch are untouched.
    """
    seen = KeyedTable(spark, f"{path}/seen", FILE, "repository_id string, path string, content_hash string", compact_every)
    results = KeyedTable(spark, f"{path}/results", FILE, results_schema, compact_every)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            snap = batch.select(*FILE, F.sha2("content", 256).alias("content_hash"))
            known = seen.read(batch_id - 1).join(snap.select(*FILE), FILE, "left_semi")
            new = diff_snapshots(known, snap).filter("change_type <> 'deleted'").select(*FILE)
            results.put(scan(batch.join(new, FILE, "left_semi")), batch_id, gone=new)
            seen.put(snap.join(new, FILE, "left_semi"), batch_id)
        finally:
            batch.unpersist()

    return run, results


TECHNOLOGY_PART = (
    "repository_id string, name string, category string, usage_count long, first_seen timestamp, last_seen timestamp, "
    "newest struct<seen:timestamp,version:string>"
)


def technology_part(rows: DataFrame) -> DataFrame:
    """Technologies of a micro-batch; a version keeps the time at which it was seen, so parts add up in any order."""
    version = non_empty("version")
    newest = F.when(version.isNotNull(), F.struct(F.col("last_seen").alias("seen"), version.alias("version")))
    return merge_technology_parts(rows.select(*TECHNOLOGY_KEY, "usage_count", "first_seen", "last_seen", newest.alias("newest")))


def merge_technology_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*TECHNOLOGY_KEY).agg(
        F.sum("usage_count").alias("usage_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("newest").alias("newest")
    )


def technology_rows(parts: DataFrame) -> DataFrame:
    return parts.withColumn("version", F.col("newest.version")).drop("newest")


def stream_usage(results: DataFrame, length: str = "30 days", delay: str = "30 days") -> DataFrame:
    """Analyses, tokens and cost per model and period."""
    sums = results.withWatermark("created_at", delay).groupBy(F.window("created_at", length), "model_name").agg(
        F.count("*").alias("analyses"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost_estimate").alias("total_cost")
    )
    return sums.select("model_name", F.col("window.start").alias("period_start"), "analyses", "total_tokens", "total_cost")


def write_parts(stream: DataFrame, part: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """``part`` of every micro-batch, each in a folder of its own; a retried batch overwrites its own only.

    Sums and counts of parts add up to those of all rows (see the ``merge_`` functions),
    so no row is late, no window is unfinished, and no state is kept: the way to
    take in history. The watermarked jobs above are for live data.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write_batches(stream, write, checkpoint)


def timeline_part(occ: DataFrame) -> DataFrame:
    return occ.groupBy("repository_id", F.to_date("detected_at").alias("period"), "pattern_id").agg(F.count("*").alias("occurrences"))


def merge_timeline(parts: DataFrame) -> DataFrame:
    return parts.groupBy("repository_id", "period", "pattern_id").agg(F.sum("occurrences").alias("occurrences"))


def average_part(metrics: DataFrame, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Sum and number of points of each metric and sliding window."""
    sums = metrics.groupBy(F.window("ts", length, slide), "name").agg(F.sum("value").alias("total"), F.count("value").alias("n_values"), F.count("*").alias("points"))
    return sums.select("name", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "total", "n_values", "points")


def fold_average(parts: DataFrame) -> DataFrame:
    """Parts of equal windows added up; still parts."""
    return parts.groupBy("name", "window_start", "window_end").agg(*[F.sum(c).alias(c) for c in ("total", "n_values", "points")])


def merge_average(parts: DataFrame) -> DataFrame:
    mean = F.try_divide(F.sum("total"), F.sum("n_values"))
    return parts.groupBy("name", "window_start", "window_end").agg(mean.alias("average"), F.sum("points").alias("points"))


def usage_part(results: DataFrame, length: str = "30 days") -> DataFrame:
    sums = results.groupBy(F.window("created_at", length), "model_name").agg(
        F.count("*").alias("analyses"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost_estimate").alias("total_cost")
    )
    return sums.select("model_name", F.col("window.start").alias("period_start"), "analyses", "total_tokens", "total_cost")


def merge_usage(parts: DataFrame) -> DataFrame:
    return parts.groupBy("model_name", "period_start").agg(*[F.sum(c).alias(c) for c in ("analyses", "total_tokens", "total_cost")])


def write_steps(stream: DataFrame, part: Callable[[DataFrame], DataFrame], table: PartTable, checkpoint: str) -> StreamingQuery:
    """``part`` of every micro-batch as one step of ``table``, which folds them from time to time."""
    return write_batches(stream, lambda batch, batch_id: table.write(part(batch), batch_id), checkpoint)


def activity_part(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Stretches of a user's events with no pause longer than ``gap``."""
    return merge_activity(events.select("user_id", F.col("ts").alias("first"), F.col("ts").alias("last"), F.lit(1).cast("long").alias("events")), gap)


def merge_activity(parts: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Stretches joined where no more than ``gap`` lies between them: the same as over all events at once, in any order.

    Stretches of one day are joined first, so the last step sorts few rows of a user that sends a third of all events.
    """
    pause = F.expr(f"INTERVAL {gap}")

    def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("first", "last")
        before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
        new = F.when(F.col("first") <= before + pause, 0).otherwise(1)
        part = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
        marked = rows.withColumn("new", new).withColumn("part", part)
        return marked.groupBy(*keys, "part").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events")).drop("part")

    days = joined(parts.withColumn("day", F.to_date("first")), ["user_id", "day"]).drop("day")
    return joined(days, ["user_id"])


ALERT_POINT = "name string, bucket long, event_id long, ts timestamp, status string"


def alert_writer(spark: SparkSession, path: str, bucket_minutes: int = 60, compact_every: int = 64) -> tuple[Callable[[DataFrame, int], None], Callable[[], DataFrame]]:
    """A batch writer for points of metrics, and a reader of all points at which a metric's status changes.

    Rows may come in any order. Every time bucket of a metric keeps a summary: its first and last status and the changes inside. A
    batch works out anew the buckets that it has rows for. Changes between buckets come from the summaries on reading.
    """
    points = PartTable(spark, f"{path}/points", ALERT_POINT, lambda rows: rows, compact_every)
    buckets = KeyedTable(spark, f"{path}/buckets", ["name", "bucket"], f"{ALERT_POINT}, previous_status string, last_status string", compact_every)

    def run(batch: DataFrame, batch_id: int) -> None:
        bucket = F.floor(F.unix_micros("ts") / F.lit(bucket_minutes * 60_000_000)).cast("long")
        points.write(metric_status(batch).select("name", bucket.alias("bucket"), "event_id", "ts", "status"), batch_id)
        new = points.stored("change", [batch_id])
        ends = new.agg(F.min("bucket"), F.max("bucket")).first()
        if ends[0] is None:
            return
        rows = points.read(batch_id).filter(F.col("bucket").between(*ends)).join(new.select("name", "bucket").distinct(), ["name", "bucket"], "left_semi")
        order = Window.partitionBy("name", "bucket").orderBy("ts", "event_id")
        whole = Window.partitionBy("name", "bucket")
        before = F.lag("status").over(order)
        last = F.max_by("status", F.struct("ts", "event_id")).over(whole)
        runs = rows.withColumn("previous_status", before).withColumn("last_status", last)
        first = F.col("previous_status").isNull()
        runs = runs.withColumn("last_status", F.when(first, F.col("last_status"))).filter(first | (F.col("previous_status") != F.col("status")))
        buckets.put(runs, batch_id)

    def read() -> DataFrame:
        rows = buckets.read()
        inside = rows.filter("previous_status IS NOT NULL").drop("last_status")
        across = F.lag("last_status").over(Window.partitionBy("name").orderBy("bucket"))
        firsts = rows.filter("previous_status IS NULL").withColumn("previous_status", across).drop("last_status")
        return inside.unionByName(firsts).filter("previous_status <> status").drop("bucket")

    return run, read


LIFECYCLE_PART = "session_id string, started_at timestamp, latest struct<ts:timestamp,step:bigint,status:string>, seen array<bigint>"
TERMINAL = ("completed", "failed", "cancelled")


def lifecycle_part(steps: DataFrame) -> DataFrame:
    """What the steps ``session_id, step, status, ts`` of a micro-batch say about their sessions."""
    step, ts = F.col("step").cast("long"), F.col("ts").cast("timestamp")
    latest = F.struct(ts.alias("ts"), step.alias("step"), "status")
    return steps.groupBy("session_id").agg(F.min(ts).alias("started_at"), F.max(latest).alias("latest"), F.collect_set(step).alias("seen"))


def merge_lifecycle(parts: DataFrame) -> DataFrame:
    """Parts of equal sessions as one part, in whatever order the steps came."""
    seen = F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen")
    return parts.groupBy("session_id").agg(F.min("started_at").alias("started_at"), F.max("latest").alias("latest"), seen)


def lifecycle(parts: DataFrame, idle: str | None = None, as_of: Column | None = None) -> DataFrame:
    """Every session: its status (that of the latest step), start, end, length, number of steps, and whether it is open.

    A session ends with a terminal step. With ``idle``, an open session without a step for that long before
    ``as_of`` (by default the latest step of all) is ``timed_out``; a later step opens it again. Repeated steps count once.
    """
    rows = parts.select("session_id", "started_at", F.col("latest.ts").alias("last"), F.col("latest.status").alias("status"), F.size("seen").cast("long").alias("steps"))
    ended = F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False))
    status = F.col("status")
    if idle is not None:
        stale = F.col("last") + F.expr(f"INTERVAL {idle}") <= resolve_as_of(rows, "last", as_of)
        status = F.when(~ended & stale, "timed_out").otherwise(status)
    return rows.select(
        "session_id", status.alias("status"), "started_at", F.when(ended, F.col("last")).alias("ended_at"), "steps",
        F.when(ended, F.timestamp_diff("SECOND", F.col("started_at"), F.col("last"))).alias("duration_seconds"), (~ended).alias("is_open"),
    )


def last_batch(query: StreamingQuery) -> int:
    """Number of the last micro-batch that read rows."""
    return max(p["batchId"] for p in query.recentProgress if p["numInputRows"] > 0)
