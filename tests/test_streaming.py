"""Streams against their batch twins: closed windows, disorder, late rows, restarts."""

import collections
import datetime as dt
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gitstrata.operators import health
from gitstrata.session import shared_folder
from gitstrata.streaming import jobs, state

SCHEMA = "user_id string, name string, request_id long, event_id long, ts timestamp, value double, threshold_warning double, threshold_critical double"
START = dt.datetime(2024, 1, 1)


def write(spark, folder, number, rows):
    frame = spark.createDataFrame([(u, u, i, i, START + dt.timedelta(seconds=s), v, 75.0, 90.0) for i, u, s, v in rows], SCHEMA)
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/part{number}")


def run(spark, folder, root, build, files=None):
    stream = jobs.read_stream(spark, f"{folder}/*", SCHEMA, files_per_batch=files)
    jobs.write_folder(build(stream), f"{root}/out", f"{root}/checkpoint").awaitTermination()


@pytest.fixture
def root(spark):
    return shared_folder(spark, "test")


def test_rate_limit_equals_brute_force(spark, root):
    rng = random.Random(11)
    rows = sorted(((i, rng.choice("ab"), rng.randrange(600), 1.0) for i in range(400)), key=lambda r: r[2])
    for n in range(4):  # arrives in four files, in order between files, shuffled inside
        part = rows[n * 100 : n * 100 + 100]
        rng.shuffle(part)
        write(spark, f"{root}/in", n, part)
        run(spark, f"{root}/in", root, lambda s: jobs.stream_rate_limit(s, limit=5, window_seconds=60, delay="10 minutes"))
    want, accepted = set(), collections.defaultdict(list)
    for n in range(4):
        for i, user, s, _ in sorted(rows[n * 100 : n * 100 + 100], key=lambda r: (r[2], r[0])):
            live = [x for x in accepted[user] if s - x < 60]
            if len(live) >= 5:
                want.add(i)
            else:
                live.append(s)
            accepted[user] = live
    got = {r.request_id for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == want and len(want) > 50


class Held:
    """What a state function needs of its state."""

    hasTimedOut = exists = False

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutTimestamp(self, at):
        pass

    def getCurrentWatermarkMs(self):
        return 0


def test_rate_limit_holds_a_few_numbers_a_row():
    """One key with all rows of a micro-batch: frames are not kept, and what is turned away leaves in blocks."""
    rng, n, limit = np.random.default_rng(3), 300_000, 10
    seconds = rng.integers(0, 40_000, n)
    ids = rng.permutation(n)

    def frames():
        for i in range(0, n, 10_000):
            at = slice(i, i + 10_000)
            yield pd.DataFrame({"user_id": "u" * 20, "request_id": ids[at], "ts": np.datetime64(START, "us") + seconds[at].astype("timedelta64[s]")})

    held, turned, tracked = Held(), [], 0
    tracemalloc.start()
    for frame in state.rate_limiter(limit, 600)(("u",), frames(), held):
        turned.append(frame["request_id"].to_numpy(np.int64))
        assert (frame["recent"] == limit).all() and len(frame) <= state.BLOCK
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    accepted, want = collections.deque(), set()
    for i in np.lexsort((ids, seconds)):
        while accepted and seconds[i] - accepted[0] >= 600:
            accepted.popleft()
        if len(accepted) >= limit:
            want.add(int(ids[i]))
        else:
            accepted.append(seconds[i])
    assert set(np.concatenate(turned).tolist()) == want and len(want) > n / 2
    assert peak < 100 * n


def test_windows_close_and_late_rows_are_dropped(spark, root):
    build = lambda s: jobs.stream_metric_average(s, "1 minute", "1 minute", "1 minute")
    write(spark, f"{root}/in", 0, [(1, "m", 10, 2.0), (2, "m", 5, 4.0), (3, "m", 70, 10.0)])
    run(spark, f"{root}/in", root, build)
    write(spark, f"{root}/in", 1, [(4, "m", 300, 1.0)])
    run(spark, f"{root}/in", root, build)
    write(spark, f"{root}/in", 2, [(5, "m", 20, 99.0), (6, "m", 600, 1.0)])  # 20 s is far behind by now
    run(spark, f"{root}/in", root, build)
    got = {(r.window_start.minute, r.average, r.points) for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == {(0, 3.0, 2), (1, 10.0, 1), (5, 1.0, 1)}


def test_alerts_survive_a_restart_and_equal_batch(spark, root):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), i * 7, float(rng.randrange(60, 100))) for i in range(200)]
    for n in range(4):
        write(spark, f"{root}/in", n, rows[n * 50 : n * 50 + 50])
        run(spark, f"{root}/in", root, jobs.stream_alerts)  # each call starts again from the checkpoint
    got = {(r.event_id, r.previous_status, r.status) for r in spark.read.parquet(f"{root}/out").collect()}
    batch = spark.read.schema(SCHEMA).parquet(f"{root}/in/*").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = {(r.event_id, r.previous_status, r.status) for r in health.status_changes(batch).collect()}
    assert got == want and want


def test_commit_merge_is_idempotent(spark, root):
    merge = jobs.commit_merger(f"{root}/table")
    schema = "repository_id string, hash string, committed_date timestamp"
    first = spark.createDataFrame([("r", "a", START), ("r", "b", START)], schema)
    second = spark.createDataFrame([("r", "b", START), ("r", "c", START)], schema)
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):  # retries repeat a batch
        merge(batch, number)
    assert sorted(r.hash for r in spark.read.parquet(f"{root}/table").collect()) == ["a", "b", "c"]


def test_scanner_touches_only_changed_files(spark, root):
    seen = []

    def scan(files):
        seen.append(sorted(r.path for r in files.select("path").collect()))
        return files.select("repository_id", "path", F.length("content").alias("n"))

    step, results = jobs.file_watcher(spark, root, "repository_id string, path string, n int", scan)
    schema = "repository_id string, path string, content string"
    step(spark.createDataFrame([("r", "a", "1"), ("r", "b", "1")], schema), 0)
    step(spark.createDataFrame([("r", "a", "1"), ("r", "b", "22"), ("r", "c", "1")], schema), 1)
    assert seen == [["a", "b"], ["b", "c"]]
    got = {(r.path, r.n) for r in results.read().collect()}
    assert got == {("a", 1), ("b", 2), ("c", 1)}


def test_parts_lose_nothing_in_many_small_batches(spark, root):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.randrange(40 * 86400), float(rng.randrange(100))) for i in range(300)]  # in no order
    for n in range(6):
        write(spark, f"{root}/in", n, rows[n * 50 : n * 50 + 50])
    shape = lambda df: df.withColumns({"repository_id": F.col("user_id"), "pattern_id": F.col("name"), "detected_at": F.col("ts")})
    stream = shape(jobs.read_stream(spark, f"{root}/in/*", SCHEMA, files_per_batch=1))
    batch = shape(spark.read.schema(SCHEMA).parquet(f"{root}/in/*"))
    average = lambda df: jobs.average_part(df, "2 hours", "1 hour")
    for name, part, merge in (("timeline", jobs.timeline_part, jobs.merge_timeline), ("average", average, jobs.merge_average)):
        run = jobs.write_parts(stream, part, f"{root}/{name}", f"{root}/{name}-checkpoint")
        run.awaitTermination()
        assert jobs.last_batch(run) == 5
        key = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
        assert key(merge(spark.read.parquet(f"{root}/{name}"))) == key(merge(part(batch)))
    assert merge(spark.read.parquet(f"{root}/average")).agg(F.sum("points")).first()[0] == 600  # two windows each


def test_commits_survive_many_small_batches(spark, root):
    schema = "repository_id string, hash string, committed_date timestamp"
    days = list(range(0, 400, 10))
    random.Random(1).shuffle(days)
    for n, day in enumerate(days[:6]):
        rows = [("r", str(d), START + dt.timedelta(days=d)) for d in (day, days[0])]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/part{n}")
    stream = jobs.read_stream(spark, f"{root}/in/*", schema, files_per_batch=1)
    jobs.write_batches(stream, jobs.commit_merger(f"{root}/table"), f"{root}/checkpoint").awaitTermination()
    assert sorted(r.hash for r in spark.read.parquet(f"{root}/table").collect()) == sorted(map(str, days[:6]))


def test_session_status(spark):
    rows = spark.createDataFrame(pd.DataFrame({"session_id": ["s", "s", "t"], "turn": [1, 2, 1], "status": ["running", "completed", "running"]}))
    got = {r.session_id: (r.status, r.is_open) for r in jobs.session_status(rows, "turn").collect()}
    assert got == {"s": ("completed", False), "t": ("running", True)}
