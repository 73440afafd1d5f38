"""Hand-worked expectations, NULLs and empty inputs, and brute force where SQL cannot say it."""

import collections
import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gitstrata.functions import commit_text as ct
from gitstrata.functions.common import latest_per_key, top_n_per_key
from gitstrata.functions.quality import with_measures
from gitstrata.functions.regex import core, java_regex, needles
from gitstrata.operators import blocks, deps, health, incremental, models, occurrences, quality, reports, scan, structure
from gitstrata.operators import completions as comp
from gitstrata.operators.consensus import consensus
from gitstrata.rules import insights as insight_rules
from gitstrata.sources import stores
from gitstrata.sources.files import read_files, write_facts

OCC = "repository_id string, pattern_id string, file_path string, ai_model_used string, confidence_score double, processing_time_ms long, detected_at timestamp_ntz"
DIM = "pattern_id string, name string, category string, complexity_level string, is_antipattern boolean"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([("p", "p", "c", "simple", False), ("q", "q", None, None, True)], DIM)


def test_pattern_stats_skips_missing_paths_and_unknown_patterns(spark, dim):
    occ = spark.createDataFrame(
        [("r", "p", "", None, 0.5, None, day(0)), ("r", "p", None, "m", 1.0, 5, day(2)), ("r", "p", "a", "", 0.0, 7, day(1)), ("r", "zz", "a", "m", 1.0, 1, day(1))], OCC)
    (row,) = occurrences.pattern_stats(occ, dim).collect()
    assert (row.total_occurrences, row.unique_files, row.ai_models_used, row.avg_confidence) == (3, 1, ["m"], 0.5)
    assert (row.first_detected, row.last_detected, row.total_processing_time_ms) == (day(0), day(2), 12)


def test_trend_formula_by_hand(spark, dim):
    # p: 6 recent of 10 in a 10-day window: 0.6 against 0.4 a day = +50 %; q: only recent = 100 %
    occ = spark.createDataFrame([("r", "p", "f", "m", 1.0, 1, day(20))] * 6 + [("r", "p", "f", "m", 1.0, 1, day(1))] * 4 + [("r", "q", "f", "m", 1.0, 1, day(20))], OCC)
    out = {r.name: r for r in occurrences.pattern_trends(occ, dim, days=10).collect()}
    assert out["p"].trend_percentage == pytest.approx(50.0)
    assert (out["p"].trend_direction, out["p"].significance) == ("increasing", "medium")
    assert (out["q"].trend_percentage, out["q"].significance) == (100.0, "high")
    (summary,) = occurrences.trend_summary(occurrences.pattern_trends(occ, dim, days=10)).collect()
    assert (summary.increasing_patterns, summary.rising_antipatterns) == (2, 1)


def test_timeline_of_an_unknown_pattern_is_an_error(spark, dim):
    occ = spark.createDataFrame([], OCC)
    with pytest.raises(ValueError):
        occurrences.pattern_timeline(occ, dim, pattern_name="nothing")
    assert occurrences.pattern_stats(occ, dim).count() == 0


def test_hot_key_helpers_equal_a_plain_sort(spark):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(1000), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v int, id int").repartition(7)
    want = collections.defaultdict(list)
    for k, v, i in sorted(data, key=lambda x: (-x[1], x[2])):
        want[k].append((k, v, i))
    top = top_n_per_key(df, ["k"], [F.desc("v"), F.col("id")], 25)
    assert sorted(rows(top)) == sorted(r for rs in want.values() for r in rs[:25])
    last = latest_per_key(df, ["k"], ["v", "id"])
    assert sorted(rows(last)) == sorted(max((r for r in data if r[0] == k), key=lambda x: (x[1], x[2])) for k in want)


def test_model_performance_by_hand(spark):
    results = spark.createDataFrame(
        [("m", 2.0, 10, 0.5, None, 4.0, ["a", "b"], None, day(9)), ("m", None, None, 0.5, 0.8, None, ["a"], "", day(9)), ("m", 4.0, 20, 1.0, 0.6, 8.0, [], "boom", day(9)),
         ("gone", 1.0, 1, 1.0, 1.0, 1.0, ["z"], None, day(9)), ("m", 1.0, 1, 1.0, 1.0, 1.0, ["old"], None, day(-60))],
        "model_name string, processing_time double, total_tokens long, cost_estimate double, confidence_score double, complexity_score double, detected_patterns array<string>, error_message string, created_at timestamp_ntz")
    known = spark.createDataFrame([("m",)], "model_name string")
    (r,) = models.model_performance(results, known).collect()
    assert (r.total_analyses, r.errors, r.total_tokens, r.unique_patterns_detected) == (3, 1, 30, 2)
    assert r.success_rate == pytest.approx(200 / 3)
    assert (r.avg_processing_time, r.avg_confidence_score, r.avg_complexity_score) == (2.0, pytest.approx(0.7), 6.0)
    (s,) = models.model_performance_summary(models.model_performance(results.limit(0), known)).collect()
    assert (s.total_models, s.avg_success_rate) == (0, 0.0)


def test_consensus_methods_by_hand(spark):
    votes = spark.createDataFrame(
        [(1, "n", "a", 0.5, 10.0, None), (1, "n", "b", 1.0, 4.0, None), (1, "s", "a", 0.5, None, "x"), (1, "s", "b", 1.0, None, "y"), (1, "s", "c", 0.2, None, "x"),
         (2, "n", "a", 0.0, 3.0, None), (2, "n", "b", 0.0, 9.0, None)],
        "task_id long, key string, model_id string, confidence double, num_value double, str_value string")
    got = {(r.task_id, r.key): r for r in consensus(votes, "confidence").collect()}
    assert got[1, "n"].num_value == pytest.approx(9 / 1.5) and got[1, "s"].str_value == "x"
    assert got[2, "n"].num_value == 3.0 and got[2, "n"].confidence == 0.0
    got = {(r.task_id, r.key): r for r in consensus(votes, "majority").collect()}
    assert got[1, "n"].num_value == 7.0
    weights = spark.createDataFrame([("b", 3.0)], "model_id string, weight double")
    got = {(r.task_id, r.key): r for r in consensus(votes, "weighted", weights).collect()}
    assert got[1, "n"].num_value == pytest.approx((10 + 12) / 5) and got[1, "s"].str_value == "y"
    got = {(r.task_id, r.key): r for r in consensus(votes, "best").collect()}
    assert got[1, "n"].num_value == 4.0 and got[1, "s"].str_value == "y" and got[1, "n"].confidence == 1.0
    with pytest.raises(ValueError):
        consensus(votes, "coin")


def test_broken_completions_fall_back(spark):
    texts = ['{patterns:[a], confidence:None complexity_score:5.0 suggestions:[]}', 'ok: {"patterns": ["x"], "complexity_score": 7} end', "", None]
    out = comp.parse_completions(spark.createDataFrame([(t,) for t in texts], "completion string")).collect()
    assert [r.patterns for r in out] == [["unknown"], ["x"], ["unknown"], ["unknown"]]
    assert [r.complexity_score for r in out] == [5.0, 7.0, 5.0, 5.0]
    assert [r.parsed for r in out] == [False, True, False, False]


CODE = '''import os
# password = "hunter2-secret"
query = "SELECT * FROM t WHERE id=" + key + "x"
@app.route("/a", methods=["POST"])
def delete_row(id):
    data = yaml.load(body)
    for i in range(len(rows)):
        for j in rows:
            out.append(j)
    while (true) { x = []; }
def fact(n):
    return n * fact(n - 1)
addEventListener("x", f)
fetch(url).then(go); é_token = 'abcdefgh1234'
new Thing(a)
try:
    x()
except:
    pass
'''


@pytest.mark.parametrize("kind,rules,flags", [("security", scan.security_rules(), 0), ("performance", scan.performance_rules(), re.I)])
def test_scan_equals_finditer(spark, kind, rules, flags):
    texts = [CODE, CODE[::-1], CODE * 3, "", "nothing here"]
    files = spark.createDataFrame([("r", f"f{i}.py", text, "python") for i, text in enumerate(texts)], "repository_id string, path string, content string, language string")
    want = collections.Counter()
    for i, text in enumerate(texts):
        for rule in rules:
            if rule.languages and "python" not in rule.languages:
                continue
            for m in re.finditer(rule.regex, text, re.M | (re.I if rule.ignore_case else 0)):
                want[f"f{i}.py", rule.number, text[: m.start()].count("\n") + 1] += 1
    got = collections.Counter((r.path, r.rule_number, r.line_number) for r in scan.scan(files, rules, kind).collect())
    assert got == want and len(want) > 10


def test_needles_never_hide_a_match():
    every = scan.security_rules() + scan.performance_rules() + scan.line_pattern_rules()
    texts = [CODE, CODE.upper(), CODE * 2]
    for rule in every:
        words = needles(rule.regex)
        for text in texts:
            if re.search(rule.regex, text, re.M | re.I):
                assert all(any(w.lower() in text.lower() for w in group) for group in words), rule.regex


def test_cores_never_hide_a_match():
    every = scan.security_rules() + scan.performance_rules() + scan.line_pattern_rules()
    loops = "for a in b:\n  for c in d:\n    for e in f: g = []; h = {}\nx = y + 'z'\nx += \"y\"\nwhile p: \n\n q += 'r'\n"
    texts = [CODE, CODE.upper(), CODE * 2, loops, loops.replace(" ", "  "), "x\u00a0=\u00a0y\u00a0+ 'z'"]
    held = set()
    for rule in every:
        for text in texts:
            if core(rule.regex) and re.search(rule.regex, text, re.M | re.I):
                assert re.search(core(rule.regex), text, re.M | re.I), rule.regex
                held.add(rule.regex)
    assert len(held) > 5
    assert core(r"for\s+\w+.*:\s*\n.*for\s+\w+.*:") == r":\s*\n.*for\s+\w+"
    assert core(r"(\w+\s*=\s*\w+|\w+\s*\+=\s*[\"'].*)") == r"=\s*\w+|\+=\s*[\"']"
    # What may be missing, comments, groups named again, codes of characters and literals alone are no cores.
    for regex in ("", "|a", "()", r"a.*\(*b+", r"(?x)a.* # .* b\s*c", r"(a).*b\s*\1", r"a.*b(?!c)", r"a.*(b\s*c|d)", r".*(a|b)?", "a.*bc"):
        assert core(regex) is None, regex
    assert core(r"a.*\x41\s*b") is None and core(r"a.*\(*b\s*c") == r"b\s*c"
    assert java_regex(r"[\w+.*]\w+.*?a\\\w+.*b") == r"(?dmUu)[\w+.*]\w+.*?a\\\w.*b"


def test_long_lines_are_read_once(spark):
    """Lines with many starts and no end: each start used to read the rest of its line once per letter of a word."""
    n = 4000
    texts = ["for something " * n + ": x\nfor a\n", "a = " + "b" * (10 * n) + " += c\n", "for a in b:\n" + "for something " * n + "\n"]
    found = ["for a in b:\n  for c in d:\n    x = y + 'z'\n"]
    files = spark.createDataFrame([("r", f"{i}.md", t, "markdown") for i, t in enumerate(texts + found)], "repository_id string, path string, content string, language string")
    began = time.monotonic()
    got = {(r.path, r.name, r.line_number) for r in scan.top_issues(scan.scan(files, scan.performance_rules(), "performance")).collect()}
    assert time.monotonic() - began < 30
    assert got == {("3.md", "inefficient_loops", 1), ("3.md", "nested_loops", 1), ("3.md", "string_concatenation", 3)}


def test_confidence_and_ids(spark):
    files = spark.createDataFrame([("r", "a.py", CODE, "python")], "repository_id string, path string, content string, language string")
    found = {(r.name, r.line_number): r for r in scan.scan(files, scan.security_rules()).collect()}
    secret = found["hardcoded_secrets", 2]
    assert secret.confidence == pytest.approx(0.7 + 0.2 + 0.1 - 0.3)
    import hashlib
    assert secret.finding_id == hashlib.md5(b"hardcoded_secrets:a.py:2").hexdigest()[:12]
    clean = spark.createDataFrame([("clean", "a.py", "x", "python")], "repository_id string, path string, content string, language string")
    both = files.unionByName(clean)
    report = {r.repository_id: r for r in scan.security_report(both, scan.scan(both, scan.security_rules())).collect()}
    assert (report["clean"].overall_score, report["clean"].risk_level) == (100, "low")
    assert report["r"].risk_level == "critical"
    metrics = {r.repository_id: r for r in scan.performance_metrics(both, scan.scan(both, scan.performance_rules(), "performance")).collect()}
    assert metrics["clean"].overall_score == 95.0 and metrics["clean"].io_score == 95.0


def test_measures_of_a_small_file(spark):
    text = 'function go(a, b) {\n  if (a && b) {\n    return a ? b : 1;\n  }\n}\n// note\n'
    (r,) = with_measures(spark.createDataFrame([("r", "a.js", text)], "repository_id string, path string, content string")).collect()
    # if, return, &&, ?, : plus one
    assert (r.cyclomatic, r.nesting, r.lines, r.cognitive) == (6.0, 1, 7, 8.0)
    assert r.lines_per_function == 7.0 and r.parameters == 2.0
    assert r.documentation_coverage == pytest.approx(1 / 5 * 100)
    assert r.testability == pytest.approx((90 + 70 + 90) / 3)
    empty = spark.createDataFrame([("r", "a.js", "")], "repository_id string, path string, content string")
    (e,) = with_measures(empty).collect()
    assert (e.documentation_coverage, e.style_score, e.cyclomatic) == (0.0, 0.0, 1.0)
    assert quality.quality_report(with_measures(empty)).count() == 1


def test_blocks_of_four_shapes(spark):
    py = "def alpha(x):\n    value = x + 1\n    return value * 2 + 100000000000\n\nprint(1)\ndef tail():\n    pass\n"
    js = "const go = () => {\n  let a = 1111111111111111;\n  return a + 2222222222;\n}\nrest()\n"
    rb = "def run\n  puts 'a long enough line of ruby text here'\nend\nputs 1\n"
    other = "class Thing\n" + "".join(f"line number {i}\n" for i in range(30))
    schema, got = "repository_id string, path string, language string, content string", {}
    for r in sorted(blocks.code_blocks(spark.createDataFrame([("r", lang, lang, text) for lang, text in (("Python", py), ("JavaScript", js), ("Ruby", rb), ("Cobol", other))], schema)).collect(), key=lambda r: r.start_line):
        got.setdefault(r.language, []).append((r.start_line, r.code))
    assert got["Python"] == [(1, "\n".join(py.split("\n")[:3]))]
    assert got["JavaScript"] == [(1, js.split("\nrest")[0])]
    assert got["Ruby"] == [(1, "\n".join(rb.split("\n")[:3]))]
    assert [(n, len(t.split("\n"))) for n, t in got["Cobol"]] == [(1, 16)]
    files = spark.createDataFrame([("r", "a", "Python", py), ("r", "b", "Other", None)], schema)
    assert [r.start_line for r in blocks.code_blocks(files).collect()] == [1]


def test_npm_overlay_and_broken_manifest(spark):
    files = spark.createDataFrame(
        [("r", "a/package.json", '{"dependencies": {"x": "1", "y": "2"}, "devDependencies": {"x": "3"}}'), ("r", "b/package.json", "{broken"), ("r", "requirements.txt", "# c\n\nFlask >= 2\nnumpy~=1.2\n")],
        "repository_id string, path string, content string")
    got = {(r.package, r.version, r.scope) for r in deps.all_dependencies(files).collect()}
    assert got == {("y", "2", "runtime"), ("x", "3", "dev"), ("flask", "2", "runtime"), ("numpy", "1.2", "runtime")}


def test_modularity_and_style_edges(spark):
    one = spark.createDataFrame([("a", "x.py"), ("a", "y.py"), ("b", "m/x.py"), ("b", "n/y.py")], "repository_id string, path string")
    assert dict(rows(structure.modularity(one))) == {"a": 0.3, "b": 1.0}
    assert {r.repository_id: (r.style, r.confidence) for r in structure.architecture_style(one).collect()}["a"] == ("monolithic", 0.5)


def test_diff_decision_and_merge(spark):
    prev = spark.createDataFrame([("r", "a", "1"), ("r", "b", "1"), ("r", "c", "1")], "repository_id string, path string, content_hash string")
    cur = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "d", "1"), ("new", "z", "1")], "repository_id string, path string, content_hash string")
    diff = incremental.diff_snapshots(prev, cur)
    assert {(r.path, r.change_type) for r in diff.collect()} == {("b", "modified"), ("c", "deleted"), ("d", "added"), ("z", "added")}
    decided = incremental.reanalysis_decision(prev.withColumn("snapshot_ts", F.lit("2024-01-01").cast("timestamp_ntz")), cur, F.lit("2024-01-02").cast("timestamp_ntz"), threshold=0.9)
    assert {r.repository_id: r.full_reanalysis for r in decided.collect()} == {"r": False, "new": True}


def test_moving_average_and_changes_by_brute_force(spark):
    rng = random.Random(3)
    pts = [(i, rng.choice("ab"), float(rng.randrange(60, 100)), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(7200))) for i in range(300)]
    df = spark.createDataFrame([(*p, 75.0, 90.0) for p in pts], "event_id long, name string, value double, ts timestamp_ntz, threshold_warning double, threshold_critical double")
    got = {r.event_id: r.moving_average for r in health.moving_average(df, 5).collect()}
    for i, name, _, ts in pts:
        near = [v for _, n, v, t in pts if n == name and ts - dt.timedelta(minutes=5) <= t <= ts]
        assert got[i] == pytest.approx(sum(near) / len(near))
    status = lambda v: "critical" if v >= 90 else "warning" if v >= 75 else "healthy"
    want = set()
    for name in "ab":
        line = sorted((t, i, status(v)) for i, n, v, t in pts if n == name)
        want |= {(cur[1], prev[2], cur[2]) for prev, cur in zip(line, line[1:], strict=False) if prev[2] != cur[2]}
    assert {(r.event_id, r.previous_status, r.status) for r in health.status_changes(df, 10).collect()} == want


def test_metric_trend_needs_three_points(spark):
    two = spark.createDataFrame([(1, "m", 1.0, day(0)), (2, "m", 9.0, day(0))], "event_id long, name string, value double, ts timestamp_ntz")
    assert health.metric_trend(two).collect()[0].trend == "insufficient_data"


def test_validation_keeps_nulls(spark):
    df = spark.createDataFrame([(1.0,), (200.0,), (None,)], "s double")
    assert [r.is_valid for r in health.validate(df, {"s": (0, 100)}).collect()] == [True, False, True]


def test_repeated_batches_change_nothing(spark):
    batch = spark.createDataFrame([("r", "h1", "a"), ("r", "h1", "b"), ("r", "h2", None)], "repository_id string, hash string, message string")
    once = stores.append_commits(batch.limit(0), batch)
    twice = stores.append_commits(once, batch)
    assert sorted(map(str, rows(once))) == sorted(map(str, rows(twice))) and once.count() == 2


def test_versions_compare_by_number(spark):
    df = spark.createDataFrame([("python", "pillow", "8.10.0"), ("python", "pillow", "8.3"), ("python", "pillow", None), ("python", "pillow", "latest")], "ecosystem string, package string, version string")
    assert [r.version for r in scan.vulnerable_dependencies(df).collect()] == ["8.3"]


def test_compare_of_empty_sets(spark):
    pairs = spark.createDataFrame([("a", "b")], "repo_a string, repo_b string")
    none = spark.createDataFrame([], "repository_id string, name string")
    assert incremental.compare_pairs(pairs, none, none).collect()[0].similarity_score == 1.0


def test_insight_bounds(spark):
    metrics = spark.createDataFrame([("r", "quality_score", 90.0), ("s", "quality_score", 89.9), ("t", "commit_rate", 0.0)], "repository_id string, metric string, value double")
    got = {(r.repository_id, r.kind) for r in reports.insights(metrics).collect()}
    assert got == {("r", "achievement"), ("s", "recommendation")}
    assert len(insight_rules.THRESHOLDS) == 26


def test_message_quality_and_url(spark):
    df = spark.createDataFrame([("feat: a long descriptive text",), ("Short",), ("",), ("x",)], "m string")
    assert [r[0] for r in df.select(ct.message_quality(F.col("m"))).collect()] == ["good", "fair", "poor", "poor"]
    urls = spark.createDataFrame([("git@github.com:a/b",), ("ftp://x/y",), ("gitlab.com/a",)], "u string")
    assert [r[0] for r in urls.select(ct.normalize_git_url(F.col("u"))).collect()] == ["https://github.com/a/b.git", None, "https://gitlab.com/a.git"]


def test_read_tree_and_write_facts(spark, tmp_path):
    tree = tmp_path / "tree"
    for name, text in {"src/a.py": "x = 1\n", "node_modules/b.js": "y", ".git/c": "z", "readme.md": "é"}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(text)
    assert {(r.path, r.content) for r in read_files(spark, str(tree)).collect()} == {("src/a.py", "x = 1\n"), ("readme.md", "é")}
    facts = spark.createDataFrame([("r", day(0)), ("s", day(40))], "repository_id string, ts timestamp_ntz")
    write_facts(facts, str(tmp_path / "facts"), "ts")
    stored = spark.read.parquet(str(tmp_path / "facts"))
    assert sorted((r.repository_id, str(r.month)[:7]) for r in stored.collect()) == [("r", "2024-01"), ("s", "2024-02")]
