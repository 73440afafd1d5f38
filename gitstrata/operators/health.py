"""Metrics and logs: status, trends, averages, bounded history, rates, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.functions.common import resolve_as_of, top_n_per_key


def metric_status(metrics: DataFrame) -> DataFrame:
    """critical, warning or healthy by the metric's own thresholds."""
    value = F.col("value")
    status = F.when(value >= F.col("threshold_critical"), "critical").when(value >= F.col("threshold_warning"), "warning").otherwise("healthy")
    return metrics.withColumn("status", status)


def health_summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics per status and the worst status of each key."""
    status = F.col("status")
    out = metric_status(metrics).groupBy(*keys).agg(
        F.count_if(status == "healthy").alias("healthy"), F.count_if(status == "warning").alias("warning"), F.count_if(status == "critical").alias("critical")
    )
    return out.withColumn("overall", F.when(F.col("critical") > 0, "critical").when(F.col("warning") > 0, "warning").otherwise("healthy"))


def counters(log: DataFrame, name: str) -> DataFrame:
    return log.groupBy(name).agg(F.count("*").alias("operations"), F.count_if(F.col("status_code") >= 400).alias("errors"))


def recent(metrics: DataFrame, minutes: int, as_of: Column | None = None) -> DataFrame:
    start = resolve_as_of(metrics, "ts", as_of) - F.make_dt_interval(mins=F.lit(minutes))
    return metrics.filter((F.col("ts") >= start) & F.col("value").isNotNull())


def metric_average(metrics: DataFrame, minutes: int = 5, as_of: Column | None = None) -> DataFrame:
    """Mean of each metric over the last minutes."""
    return recent(metrics, minutes, as_of).groupBy("name").agg(F.avg("value").alias("average"), F.count("*").alias("points"))


def metric_trend(metrics: DataFrame, minutes: int = 10, as_of: Column | None = None) -> DataFrame:
    """First against last value of each metric over the last minutes."""
    order = F.struct("ts", "event_id")
    ends = recent(metrics, minutes, as_of).groupBy("name").agg(
        F.count("*").alias("points"), F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last")
    )
    change = F.when(F.col("first") != 0, F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100).otherwise(0.0)
    trend = (
        F.when(F.col("points") < 3, "insufficient_data").when(change > 10, "increasing").when(change < -10, "decreasing").otherwise("stable")
    )
    return ends.withColumn("trend", trend)


def metric_summary(metrics: DataFrame, log: DataFrame, minutes: int = 30, as_of: Column | None = None) -> DataFrame:
    """Mean and trend per metric with the operation and error counts of the same name."""
    trend = metric_trend(metrics, minutes, as_of).join(metric_average(metrics, minutes, as_of).select("name", "average"), "name")
    ops = counters(log, "name")
    return trend.join(ops, "name", "left").fillna({"operations": 0, "errors": 0}).withColumn("average", F.round("average", 2))


def moving_average(metrics: DataFrame, minutes: int = 5, cells: int = 32) -> DataFrame:
    """Mean of the preceding minutes at every point of every metric, with work in proportion to the points.

    The sum over a window is a difference of running sums: up to the point, less up to just before the window. Time is cut into cells of
    a ``cells``-th of the window. Inside a cell sums run on; between the two ends lie whole cells, at most ``cells + 1``. So no
    frame is worked out anew per point, no sum covers more than a window, and a task sorts one cell of one metric.
    """
    micros = minutes * 60 * 1_000_000
    step = -(-micros // cells)
    reach = (micros + 1) // step
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cell = lambda t: F.floor(t / F.lit(step)).cast("long")
    sums = metrics.groupBy("name", at.alias("at")).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("s"), F.count("value").alias("c")).filter("at IS NOT NULL")
    before = F.col("at") - micros - 1
    points = sums.select("name", "at", F.col("at").alias("t"), "s", "c", F.lit(1).alias("sign"))
    probes = sums.select("name", "at", before.alias("t"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("c"), F.lit(-1).alias("sign"))
    inside = Window.partitionBy("name", "cell").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    running = points.unionByName(probes).withColumn("cell", cell(F.col("t")))
    running = running.withColumns({"s": F.sum("s").over(inside), "c": F.sum("c").over(inside)})
    # Whole cells: those before each cell, as far as a window reaches; a stretch of 4096 cells also sees the end of the one before.
    whole = sums.groupBy("name", cell(F.col("at")).alias("cell")).agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    stretch, ahead = F.floor(F.col("cell") / 4096).cast("long"), F.floor((F.col("cell") + reach + 1) / 4096).cast("long")
    copies = whole.withColumn("own", stretch).withColumn("stretch", F.explode(F.array_distinct(F.array(stretch, ahead))))
    frames = {n: Window.partitionBy("name", "stretch").orderBy("cell").rangeBetween(-n, -1) for n in (reach, reach + 1)}
    near = copies.withColumns({f"{x}{n - reach}": F.sum(x).over(w) for n, w in frames.items() for x in "sc"}).filter("own = stretch")
    near = near.select(F.col("name").alias("n"), F.col("cell").alias("k"), "s0", "s1", "c0", "c1")
    far = cell(F.col("at")) - cell(before) > reach
    between = {x: F.when(F.col("sign") == 1, F.coalesce(F.when(far, F.col(f"{x}1")).otherwise(F.col(f"{x}0")), F.lit(0))).otherwise(0) for x in "sc"}
    # A probe's cell lies in the frame as a whole; its running sum goes off again.
    ends = running.join(near, running["name"].eqNullSafe(near["n"]) & (F.col("cell") == F.col("k")) & (F.col("sign") == 1), "left")
    ends = ends.select("name", "at", *[((F.col(x) * F.col("sign")) + between[x]).alias(x) for x in "sc"])
    means = ends.groupBy("name", "at").agg(F.try_divide(F.sum("s"), F.sum("c")).alias("moving_average")).select(F.col("name").alias("_name"), F.col("at").alias("_at"), "moving_average")
    marked = metrics.withColumn("_point", at)
    return marked.join(means, F.col("name").eqNullSafe(F.col("_name")) & (F.col("_point") == F.col("_at")), "left").drop("_name", "_at", "_point")


def status_changes(metrics: DataFrame, bucket_minutes: int = 60) -> DataFrame:
    """Points where a metric's status differs from that of the point before.

    Exact without sorting a whole metric in one task: inside a time bucket the
    previous point is at hand; the first point of a bucket is compared with the
    last status of the nearest earlier bucket, read from one summary row per bucket.
    """
    micros = bucket_minutes * 60 * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    points = metric_status(metrics).withColumn("_bucket", F.floor(at / F.lit(micros)))
    inside = Window.partitionBy("name", "_bucket").orderBy("ts", "event_id")
    ordered = points.withColumn("_before", F.lag("status").over(inside)).withColumn("_n", F.row_number().over(inside))
    ends = points.groupBy("name", "_bucket").agg(F.max_by("status", F.struct("ts", "event_id")).alias("_last"))
    across = Window.partitionBy("name").orderBy("_bucket")
    carried = ends.withColumn("_carried", F.lag("_last").over(across)).select("name", "_bucket", "_carried")
    out = ordered.join(carried, ["name", "_bucket"], "left").withColumn(
        "previous_status", F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_before"))
    )
    return out.filter(F.col("previous_status").isNotNull() & (F.col("previous_status") != F.col("status"))).drop("_before", "_n", "_carried", "_bucket")


def tail_per_key(df: DataFrame, key: str, n: int, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last ``n`` rows of each key, newest first."""
    return top_n_per_key(df, [key], [F.desc(time), F.desc(tie)], n, rank="position")


def request_rates(log: DataFrame, keys: list[str]) -> DataFrame:
    """Requests, error share and mean duration per key."""
    return log.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.avg((F.col("status_code") >= 400).cast("int")).alias("error_share"),
        F.avg("duration_ms").alias("avg_duration_ms"),
    )


def expiring(keys: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Active keys that expire within ``days`` with the whole days left."""
    limit = as_of + F.make_dt_interval(F.lit(days))
    left = F.floor(F.timestamp_diff("SECOND", as_of, F.col("expires_at")) / 86400)
    return (
        keys.filter(F.col("is_active") & F.col("expires_at").isNotNull() & (F.col("expires_at") <= limit))
        .withColumn("days_until_expiry", left)
        .withColumn("expired", F.col("days_until_expiry") < 0)
    )


def similar(vectors: DataFrame, query: list[float] | Column, k: int = 5, metric: str = "cosine") -> DataFrame:
    """The ``k`` stored vectors nearest to one query vector, similarity first.

    The query is a list or a scalar subquery (``df.select("embedding").scalar()``), worked out with the search and not before;
    every partition keeps its own best ``k``, so only those travel.
    """
    asked = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    vectors = vectors.withColumn("_query", asked)
    q = F.transform("_query", lambda x: x.cast("double"))
    v = F.transform("embedding", lambda x: x.cast("double"))
    zero = F.lit(0.0)
    add = lambda total, x: total + x
    if metric == "cosine":
        dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), zero, add)
        norm = F.sqrt(F.aggregate(F.transform(v, lambda a: a * a), zero, add))
        length = F.sqrt(F.aggregate(F.transform(q, lambda a: a * a), zero, add))
        score = F.try_divide(dot, norm * length)
    elif metric == "l2sq":
        score = F.lit(1.0) - F.aggregate(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)), zero, add)
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return vectors.withColumn("similarity", score).drop("_query").orderBy(F.desc("similarity"), "vec_id").limit(k)


def validate(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Adds ``violations`` (fields out of range) and ``is_valid``; NULL is in range."""
    tests = []
    for column, (low, high) in bounds.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(column) < low)
        if high is not None:
            bad = bad | (F.col(column) > high)
        tests.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(column)))
    out = df.withColumn("violations", F.array_compact(F.array(*tests)))
    return out.withColumn("is_valid", F.size("violations") == 0)


def session_duration(sessions: DataFrame, as_of: Column) -> DataFrame:
    """Seconds of each session; a terminal one without an end is closed at ``as_of``."""
    terminal = F.col("status").isin("completed", "failed", "cancelled")
    end = F.coalesce("completed_at", F.when(terminal, as_of))
    return sessions.withColumn("duration_seconds", F.timestamp_diff("SECOND", F.col("started_at"), end))


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text fields to their types; what does not fit becomes NULL."""
    return df.withColumns({column: F.col(column).try_cast(kind) for column, kind in types.items()})
