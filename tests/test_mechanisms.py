"""Tables of steps, streams in any order, searches and joins without a list of pairs: against brute force."""

import collections
import datetime as dt
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gitstrata.operators import commits, health, incremental, vectors
from gitstrata.session import shared_folder
from gitstrata.sources import stores
from gitstrata.sources.versions import KeyedTable, PartTable
from gitstrata.streaming import jobs

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def root(spark):
    return shared_folder(spark, "test")


def rows_of(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def arrive(spark, root, schema, rows, files, name="in"):
    """The rows as a folder of files in shuffled order, to be read one file a batch."""
    rows = list(rows)
    random.Random(8).shuffle(rows)
    size = -(-len(rows) // files)
    for n in range(files):
        spark.createDataFrame(rows[n * size : n * size + size], schema).coalesce(1).write.mode("append").parquet(f"{root}/{name}/part{n:03d}")
    return jobs.read_stream(spark, f"{root}/{name}/*", schema, files_per_batch=1)


# Tables of steps


def test_keyed_table_replaces_and_takes_away(spark, root):
    table = KeyedTable(spark, root, ["k"], "k string, v int", compact_every=3)
    put = lambda rows, step, gone=(): table.put(spark.createDataFrame(rows, "k string, v int"), step, spark.createDataFrame([(g,) for g in gone], "k string"))
    assert rows_of(table.read()) == []
    put([("a", 1), ("a", 2), ("b", 1)], 0)
    put([("b", 5), ("c", 1)], 1)
    put([], 2, gone=["a", "c", "x"])
    assert table.steps() == (2, []) and rows_of(table.read()) == [("b", 5)]
    put([("a", 7)], 3)
    put([("a", 7)], 3)  # a repeated step
    put([("a", 8), ("d", None)], 4, gone=["a"])  # a key in both keeps its rows
    assert table.steps() == (2, [3, 4]) and rows_of(table.read().fillna(0)) == [("a", 8), ("b", 5), ("d", 0)]
    assert rows_of(table.read(1)) == [("a", 1), ("a", 2), ("b", 5), ("c", 1)]


def test_a_step_without_its_log_line_does_not_count(spark, root):
    table = KeyedTable(spark, root, ["k"], "k string, v int")
    table.put(spark.createDataFrame([("a", 1)], "k string, v int"), 0)
    spark.createDataFrame([("a", 2, False)], "k string, v int, _gone boolean").write.parquet(table.folder("change", 1))
    assert rows_of(table.read()) == [("a", 1)]


def test_part_table_adds_up(spark, root):
    merge = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    table = PartTable(spark, root, "k string, n long", merge, compact_every=4)
    for step in range(10):
        table.write(spark.createDataFrame([("a", step), ("b", 1)], "k string, n long"), step)
    assert rows_of(table.read()) == [("a", 45), ("b", 10)] and table.steps() == (7, [8, 9])


# Streams


def test_alerts_in_any_order(spark, root):
    rng = random.Random(5)
    schema = "name string, event_id long, ts timestamp, value double, threshold_warning double, threshold_critical double"
    rows = [(rng.choice("ab"), i, START + dt.timedelta(seconds=rng.randrange(40) * 600), float(rng.randrange(60, 100)), 75.0, 90.0) for i in range(400)]
    batch = spark.createDataFrame(rows, schema)
    want = rows_of(health.status_changes(batch.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).select("name", "event_id", "status", "previous_status"))
    assert len(want) > 100
    for files in (1, 12):
        stream = arrive(spark, root, schema, rows, files, f"in{files}")
        run, read = jobs.alert_writer(spark, f"{root}/alerts{files}", compact_every=5)
        jobs.write_batches(stream, run, f"{root}/checkpoint{files}").awaitTermination()
        assert rows_of(read().drop("ts")) == want


def test_activity_in_any_order(spark, root):
    rng = random.Random(6)
    rows = [(rng.randrange(6), START + dt.timedelta(minutes=rng.randrange(9000))) for _ in range(500)]
    rows += [(9, START + dt.timedelta(minutes=30 * i)) for i in range(200)]  # days without a pause
    want = collections.Counter()
    for user, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        part = []
        for _, at in group:
            if part and at - part[-1] > dt.timedelta(minutes=30):
                want[user, part[0], part[-1], len(part)] += 1
                part = []
            part.append(at)
        want[user, part[0], part[-1], len(part)] += 1
    stream = arrive(spark, root, "user_id long, ts timestamp", rows, 7)
    table = PartTable(spark, f"{root}/parts", "user_id long, first timestamp, last timestamp, events long", jobs.merge_activity, compact_every=3)
    jobs.write_steps(stream, jobs.activity_part, table, f"{root}/checkpoint").awaitTermination()
    got = collections.Counter((r.user_id, r.first, r.last, r.events) for r in table.read().collect())
    assert got == want and len(want) > 100


def test_lifecycle_in_any_order(spark, root):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [
        ("done", 1, "created", at(0)), ("done", 2, "running", at(5)), ("done", 3, "completed", at(65)), ("done", 3, "completed", at(65)),
        ("open", 1, "running", at(70)), ("lost", 1, "running", at(1)), ("again", 2, "failed", at(3)), ("again", 3, "running", at(60)), ("again", 1, "running", at(2)),
    ]
    schema = "session_id string, step long, status string, ts timestamp"
    want = {
        "done": ("completed", at(0), at(65), 3, 3900, False), "open": ("running", at(70), None, 1, None, True),
        "lost": ("timed_out", at(1), None, 1, None, True), "again": ("running", at(2), None, 3, None, True),
    }
    for files in (1, 9):
        stream = arrive(spark, root, schema, rows, files, f"in{files}")
        table = PartTable(spark, f"{root}/parts{files}", jobs.LIFECYCLE_PART, jobs.merge_lifecycle, compact_every=4)
        jobs.write_steps(stream, jobs.lifecycle_part, table, f"{root}/checkpoint{files}").awaitTermination()
        got = {r.session_id: (r.status, r.started_at, r.ended_at, r.steps, r.duration_seconds, r.is_open) for r in jobs.lifecycle(table.read(), "30 minutes").collect()}
        assert got == want


def test_watcher_writes_only_changes(spark, root):
    scanned = []

    def scan(files):
        scanned.append(sorted(r.path for r in files.select("path").collect()))
        return files.filter("length(content) > 1").select("repository_id", "path", F.length("content").alias("n"))

    step, results = jobs.file_watcher(spark, root, "repository_id string, path string, n int", scan, compact_every=3)
    schema = "repository_id string, path string, content string"
    for n, rows in enumerate([[("r", "a", "11"), ("r", "b", "22")], [("r", "a", "11"), ("r", "b", "2")], [("r", "c", "333")], [("r", "c", "333")], [("s", "c", "55")]]):
        step(spark.createDataFrame(rows, schema), n)
    assert scanned == [["a", "b"], ["b"], ["c"], [], ["c"]]
    assert rows_of(results.read()) == [(2, "a", "r"), (2, "c", "s"), (3, "c", "r")]
    assert results.stored("change", [3]).count() == 0


def test_technologies_batch_by_batch(spark, root):
    schema = "repository_id string, name string, category string, usage_count long, first_seen timestamp, last_seen timestamp, version string"
    rng = random.Random(2)
    rows = []
    for i in range(120):
        seen = START + dt.timedelta(days=rng.randrange(100))
        rows.append((rng.choice("rs"), rng.choice("xyz"), "tool", rng.randrange(5), seen, seen, rng.choice([None, "", f"{i}"])))
    want = rows_of(stores.merge_technologies(spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)))
    stream = arrive(spark, root, schema, rows, 6)
    table = PartTable(spark, f"{root}/table", jobs.TECHNOLOGY_PART, jobs.merge_technology_parts, compact_every=2)
    jobs.write_steps(stream, jobs.technology_part, table, f"{root}/checkpoint").awaitTermination()
    assert rows_of(jobs.technology_rows(table.read())) == want


# Pages, means, pairs, neighbours


def test_pages_at_any_depth(spark, root):
    rows = [(i % 37, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    stores.write_ranked(df, [F.desc("a"), "b"], root)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    for offset, limit in ((0, 10), (2490, 33), (4995, 20), (6000, 5)):
        page = stores.ranked_page(spark, root, limit, offset)
        got = sorted(page.collect(), key=lambda r: r.position)
        assert [(r.a, r.b) for r in got] == want[offset : offset + limit]
        assert all(r.total == 5000 and r.has_more == (offset + limit < 5000) for r in got)
    last = want[2499]
    after = stores.page_after(df, {"a": "desc", "b": "asc"}, {"a": F.lit(last[0]), "b": F.lit(last[1])}, 40).collect()
    assert [tuple(r) for r in after] == want[2500:2540]


def test_moving_average_is_exact_and_quick_in_a_dense_bucket(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), START + dt.timedelta(seconds=rng.choice([rng.randrange(4000), rng.randrange(100) * 300])), rng.choice([None, float(rng.randrange(100))])) for _ in range(600)]
    rows += [("far", START - dt.timedelta(days=9000), 4.0), ("far", START, 6.0), ("none", START, None), (None, START, 3.0)]
    got = health.moving_average(spark.createDataFrame(rows, "name string, ts timestamp, value double"), 5).collect()
    assert len(got) == len(rows)
    for r in got:
        near = [v for n, t, v in rows if n == r.name and r.ts - dt.timedelta(minutes=5) <= t <= r.ts and v is not None]
        assert r.moving_average == (pytest.approx(sum(near) / len(near), abs=1e-9) if near else None)
    dense = spark.range(1_000_000).selectExpr("'m' AS name", "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id / 10000) AS ts", "cast(id % 10 as double) AS value")
    begin = dt.datetime.now()
    assert health.moving_average(dense, 5).agg(F.count("moving_average")).first()[0] == 1_000_000
    assert dt.datetime.now() - begin < dt.timedelta(seconds=60)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9])
def test_related_repositories_equal_all_pairs(spark, threshold):
    rng = random.Random(7)
    sets = {f"r{i}": {f"v{rng.randrange(40)}": rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))} for i in range(60)}
    sets |= {f"copy{i}": dict(sets["r1"], everywhere=1) for i in range(30)} | {f"near{i}": dict(sets["r1"], everywhere=1, own=i + 1) for i in range(5)}
    rows = [(r, v, w) for r, items in sets.items() for v, w in items.items()]
    rows += [("r1", "nothing", 0), ("r1", None, 3), (None, "v1", 2)]
    pairs, classes = incremental.related_repositories(spark.createDataFrame(rows, "repository_id string, name string, weight int"), threshold)
    named = {r.repository_id: r.class_id for r in classes.collect()}
    first = {}
    for r in sorted(sets):
        first.setdefault(tuple(sorted(sets[r].items())), r)
    assert named == {r: first[tuple(sorted(sets[r].items()))] for r in sets}
    want = {}
    for a, b in itertools.combinations(sorted(set(named.values())), 2):
        items = set(sets[a]) | set(sets[b])
        value = sum(min(sets[a].get(v, 0), sets[b].get(v, 0)) for v in items) / sum(max(sets[a].get(v, 0), sets[b].get(v, 0)) for v in items)
        if value >= threshold:
            want[a, b] = value
    assert {(r.repo_a, r.repo_b): pytest.approx(r.similarity) for r in pairs.collect()} == want and want


@pytest.mark.parametrize("ahead", [1, 3, 16])
def test_related_repositories_shuffle_only_pairs_that_can_be_alike(spark, monkeypatch, ahead):
    rng = random.Random(12)
    sets = {f"r{i}": {f"v{rng.randrange(60)}": rng.randrange(1, 51) for _ in range(rng.randrange(1, 7))} for i in range(300)}
    rows = [(r, v, w) for r, items in sets.items() for v, w in items.items()]
    seen, written = {}, incremental.written
    monkeypatch.setattr(incremental, "AHEAD", ahead, raising=False)
    monkeypatch.setattr(incremental, "written", lambda df, purpose: seen.setdefault(purpose, written(df, purpose)))
    pairs, classes = incremental.related_repositories(spark.createDataFrame(rows, "repository_id string, name string, weight int"), 0.3)
    want = {}
    for a, b in itertools.combinations(sorted({r.class_id for r in classes.collect()}), 2):
        shared = sum(min(w, sets[b].get(v, 0)) for v, w in sets[a].items())
        value = shared / (sum(sets[a].values()) + sum(sets[b].values()) - shared)
        if value >= 0.3:
            want[a, b] = value
    assert {(r.repo_a, r.repo_b): pytest.approx(r.similarity) for r in pairs.collect()} == want and len(want) > 100
    if ahead == 16:  # every list is whole, so the join lets through what is alike and nothing else
        assert seen["likely-pairs"].count() == len(want)


def test_similar_many_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16)) * 3
    points = np.concatenate([centers[rng.integers(0, 12, 700)] + rng.normal(size=(700, 16)), np.repeat(centers[:2], 40, axis=0)])
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    odd = [(900, None), (901, [0.0] * 16), (1000, [0.0] * 16), (1100, [1.0, None] + [0.0] * 14)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    queries = df.filter("vec_id % 20 = 0")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    for settings in ({"cells": 8, "ring": 32}, {"cells": 1}, {"cells": 20, "ring": 8}):
        got = collections.defaultdict(list)
        for r in vectors.similar_many(df, queries, k=4, **settings).orderBy("query", "position").collect():
            got[r.query].append((r.id, r.similarity))
        assert sorted(got) == [i for i in range(0, len(points), 20)]
        for q, found in got.items():
            value = np.round(unit @ unit[q], 12)
            value[q] = -2
            best = sorted(range(len(points)), key=lambda i: (-value[i], i))[:4]
            assert [s for _, s in found] == pytest.approx([value[i] for i in best], abs=1e-9)
            assert [i for i, _ in found] == best or len({round(value[i], 9) for i in best}) < 4


def test_a_fork_keeps_its_own_figures(spark):
    changes = spark.createDataFrame([("r", "h", "a.py", 1, 0), ("fork", "h", "a.py", 5, 2), ("fork", "h", "b.py", 1, 0)], "repository_id string, hash string, file_path string, additions long, deletions long")
    messages = spark.createDataFrame([("r", "h", "fix"), ("fork", "h", "breaking: x")], "repository_id string, hash string, message string")
    got = {r.repository_id: (r.additions, r.files, r.is_breaking) for r in commits.commit_rollup(changes, messages).collect()}
    assert got == {"r": (1, 1, False), "fork": (6, 2, True)}


# Versions in ranges


def test_versions_in_ranges_of_many_advisories(spark):
    from gitstrata.operators import scan

    rng = random.Random(4)
    version = lambda: rng.choice([None, "", "latest", *[rng.choice("^~v ").strip() + ".".join(str(rng.randrange(4)) for _ in range(rng.choice([1, 2, 3, 3]))) for _ in range(12)]])
    deps = [(str(i), rng.choice(["python", "javascript"]), rng.choice(["a", "a", "a", "b", "c"]), version()) for i in range(400)]
    bound = lambda: rng.choice([None, *[".".join(str(rng.randrange(4)) for _ in range(rng.choice([1, 2, 3]))) for _ in range(6)]])
    ranges = [(rng.choice(["python", "javascript"]), rng.choice(["a", "b", "z"]), bound(), bound(), f"C{i}") for i in range(150)]
    key = lambda v: tuple(int(x) for x in m[0].split(".")) if v and (m := re.search(r"\d+(\.\d+)*", v)) else None
    want = sorted(
        (d, c) for d, e, p, v in deps for e2, p2, lo, hi, c in ranges
        if (e, p) == (e2, p2) and key(v) is not None and (lo is None or key(lo) <= key(v)) and (hi is None or key(v) < key(hi))
    )
    got = scan.vulnerable_ranges(
        spark.createDataFrame(deps, "id string, ecosystem string, package string, version string"),
        spark.createDataFrame(ranges, "ecosystem string, package string, introduced string, fixed string, cve string"),
    )
    assert sorted((r.id, r.cve) for r in got.collect()) == want and len(want) > 1000
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_uses_of_versions_are_counted_before_they_meet_advisories(spark, tmp_path, monkeypatch):
    """A version that many lines name meets its advisories once; equal advisories all count."""
    from gitstrata.operators import scan
    from gitstrata.plans.catalog import QUERIES

    lines = [(i, 50 * (i % 2) + 2, 1, i % 6, float(i % 4)) for i in range(600)] + [(None, None, None, None, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    suppliers = [(s, n) for s in (2, 52, 52, 7) for n in (0, 5)] + [(None, 1)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    seen, operator = [], scan.vulnerable_ranges
    monkeypatch.setattr(scan, "vulnerable_ranges", lambda deps, advisories: seen.append(deps.count()) or operator(deps, advisories))
    got = {(r.package, r.version, r.cve): r.uses for r in QUERIES["vulnerable_ranges"](spark, str(tmp_path)).collect()}
    number = lambda v: tuple(map(int, v.lstrip("^").split(".")))
    want = collections.Counter()
    for _, p, _, n, q in lines[:-1]:
        for s, k in suppliers[:-1]:
            version = "latest" if p % 11 == 0 else f"^{n}.{p % 7}.{int(q)}"
            low = (k % 7, s % 7) if s % 5 else ()
            high = (k % 7 + s % 2, 3, k) if s % 9 else (99,)
            if version != "latest" and p % 50 == s % 50 and low <= number(version) < high:
                want[f"pkg{p % 50}", version, f"CVE-{s}"] += 1
    assert got == want and len(want) > 5 and seen[0] <= 2 * 6 * 4 + 1


# Trees of files


def test_tree_lists_nothing_that_is_left_out(spark, tmp_path, monkeypatch):
    from gitstrata.sources import tree

    for name, content in {
        "a.py": b"x", "src/b.py": b"y\xff", "src/deep/er/c.py": "é".encode(), "src/node_modules/d.js": b"n", ".git/e": b"g", "docs/.cache/f": b"h", "docs/g.md": b"", "lib/h.txt": b"z",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (tmp_path / "empty").mkdir()
    want = [("a.py", "x", 1), ("docs/g.md", "", 0), ("lib/h.txt", "z", 1), ("src/b.py", "y\ufffd", 2), ("src/deep/er/c.py", "é", 2)]
    for splits in (1, 2, 3, 64):
        got = tree.read_tree(spark, f"file://{tmp_path}/", splits=splits)
        assert sorted(map(tuple, got.collect())) == want
        assert got.rdd.getNumPartitions() >= min(splits, 4)
    seen, scandir = [], tree.os.scandir
    monkeypatch.setattr(tree.os, "scandir", lambda path: seen.append(str(path)) or scandir(path))
    reader = tree.TreeReader(str(tmp_path), "snapshot", 2)
    assert sum(b.num_rows for part in reader.partitions() for b in reader.read(part)) == len(want)
    assert seen and not any(word in path for path in seen for word in ("node_modules", ".git", ".cache"))
    assert "src/node_modules/d.js" not in {r.path for r in tree.read_tree(spark, str(tmp_path), "architecture").collect()}
    with pytest.raises(ValueError):
        tree.read_tree(spark, "hdfs://there/tree")


# Distinct counts that add up


def test_reach_adds_up_over_steps(spark, root):
    from gitstrata.operators import reach

    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randrange(4), rng.choice([None, *range(70_000)])) for _ in range(6000)] + [("a", 0, i) for i in range(0, 70_000, 7)] + [("c", 9, None)]
    table = PartTable(spark, root, "k string, day int, stretch long, bits binary, facts long", lambda r: reach.merge(r, ["k", "day"]), compact_every=2)
    known = None
    for step in range(3):
        facts = spark.createDataFrame(rows[step::3], "k string, day int, v int")
        known = spark.createDataFrame(reach.numbers(facts, "v", known).collect(), "v int, number long")
        table.write(reach.parts(facts, ["k", "day"], "v", known), step)
    assert sorted(r.number for r in known.collect()) == list(range(len({v for _, _, v in rows} - {None})))
    for keys, place in ((["k", "day"], lambda r: r[:2]), (["k"], lambda r: r[:1]), ([], lambda r: ())):
        groups = collections.defaultdict(list)
        for r in rows:
            groups[place(r)].append(r[2])
        got = {tuple(r[c] for c in keys): (r.reached, r.facts) for r in reach.counts(table.read(), keys).collect()}
        assert got == {k: (len(set(v) - {None}), len(v)) for k, v in groups.items()}
