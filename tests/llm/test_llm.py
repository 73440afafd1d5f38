"""The operators for training text: brute force on small tables, and the defined cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gitstrata.llm import (
    dart_minhash,
    hidden_markov,
    license_scan,
    pfair_mix,
    quality_rules,
    queries,
    repeated_windows,
    support_vectors,
    template_windows,
    token_shards,
    uniform_shards,
)
from gitstrata.llm.words import slices

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, position string, kept string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts():
    """Random texts with copies, near copies, blanks of all kinds, and the cases that are easily forgotten."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["Äpfel", "don't", "x|y", "7,5", "END!!"]
    blanks = [" ", " ", " ", "\n", "  ", "\t", " \n"]
    out = ["".join(rng.choice(vocabulary) + rng.choice(blanks) for _ in range(rng.choice([1, 4, 30, 90, 160]))) for _ in range(40)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    out += [out[5], out[9], out[9], out[7] + " tail", out[12] + " " + passage, passage + " " + out[13], passage]
    long = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(6):
        near = list(long)
        near[rng.randrange(200)] = "changed"
        out.append(" ".join(near))
    return [*out, "", None, "   \n ", "one", " ".join(["same"] * 3000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 1, 9, "p", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, texts[3], None, None, None, None, None, None), rows[2], rows[2]], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_windows(texts):
    for t in slices(pa.array(texts), size=500):
        for d in range(len(t)):
            mine = words(texts[t.row + d])
            assert t.counts[d] == len(mine)
    t = next(slices(pa.array(["a b c a b c", "b c"])))
    at, h = t.windows(2)
    assert at.tolist() == [0, 1, 2, 3, 4, 6] and h[0] == h[3] and h[1] == h[4] == h[5] and h[0] != h[1]


def test_quality_rules(docs, nothing, texts):
    got = quality_rules.report(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        text = (texts[3] if r.doc_id is None else texts[r.doc_id]) or ""
        w, seen, dup = words(text), set(), 0
        for line in text.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        runs = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in text), dup, len(hit)
        )
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality_rules.keep(docs).columns == docs.columns
    assert quality_rules.report(nothing).count() == quality_rules.keep(nothing).count() == 0


def test_quality_rules_find_the_hidden_class():
    rng = np.random.default_rng(1)
    bad = rng.random(20000) < 0.2
    votes = [np.where(rng.random(20000) < 0.15, 0, np.where(rng.random(20000) < np.where(bad, 0.6, 0.02), 1, 2)) for _ in quality_rules.RULES]
    pattern = np.zeros(20000, int)
    for v in votes:
        pattern = pattern * 3 + v
    posterior = quality_rules.fit(dict(collections.Counter(pattern.tolist())))
    assert np.mean([(posterior[p] < 0.5) == b for p, b in zip(pattern.tolist(), bad, strict=True)]) > 0.98


def test_forward_is_exact_and_baum_welch_climbs():
    rng = np.random.default_rng(2)
    model = hidden_markov.Model(np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([[0.5, 0.1], [0.3, 0.2], [0.2, 0.7]]))
    seq, counts = np.array([0, 2, 1, 1, 2, 0, 0]), np.array([3, 1, 3])
    for got, s in zip(hidden_markov.forward(model, seq, counts), np.split(seq, [3, 4]), strict=True):
        total = 0.0
        for path in np.ndindex(*[2] * len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for i in range(1, len(s)):
                p *= model.step[path[i - 1], path[i]] * model.emit[s[i], path[i]]
            total += p
        assert math.isclose(got, math.log(total), rel_tol=1e-12)
    seq, counts = rng.integers(0, 3, 4000), np.full(40, 100)
    start, step, emit = hidden_markov.expect(model, seq, counts)
    assert math.isclose(emit.sum(), 4000) and math.isclose(step.sum(), 4000 - 40) and math.isclose(start.sum(), 40)
    better = hidden_markov.Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))
    assert hidden_markov.forward(better, seq, counts).sum() > hidden_markov.forward(model, seq, counts).sum()


def test_language_model(docs, nothing, texts):
    got = hidden_markov.score(docs, own=100, shared=16, states=3).collect()
    low = lambda t: [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words(t)] + [None]
    text = {r.doc_id: r.text for r in docs.collect()}
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = collections.Counter(w for r in docs.collect() if not held(r.doc_id) for w in low(r.text))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == docs.count()
    for r in got:
        w = low(text[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
    assert hidden_markov.score(nothing).count() == 0


def test_language_model_beats_single_words(spark, sf):
    got = hidden_markov.score(spark.read.parquet(f"{sf}/documents.parquet"))
    a, b = got.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert a > b


def test_language_model_learns_from_every_training_text(spark):
    """The first model and each pass take up all training texts; a text that a sample would pass over counts as well."""
    rows = [(i, i % 7 == 2, [i % 5, 5 + i % 3]) for i in range(4000)] + [(4000, False, [9, 9, 9, 9])]
    encoded = spark.createDataFrame(rows, "row long, held_out boolean, classes array<int>").repartition(3)
    base = np.full(10, 0.1)
    n = np.bincount([c for _, held, s in rows if not held for c in s], minlength=10)
    seen, of = [], hidden_markov.Model.of
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(hidden_markov.Model, "of", staticmethod(lambda start, step, emit, base: seen.append(emit) or of(start, step, emit, base)))
        model = hidden_markov.first_model(encoded, base, 3)
        hidden_markov.baum_welch(encoded, model, base)
    for emit in seen:
        assert np.allclose(emit.sum(1), n) and n[9] == 4


def brute_classes(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def runs(t):
        w = words(t)
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: runs(t) for i, t in rows}
    for i, t in rows:
        for j, u in rows:
            if j < i and ((t or "") == (u or "") or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in rows}


def test_near_duplicates(docs, nothing, texts):
    want = brute_classes(list(enumerate(texts)))
    got = dart_minhash.report(docs).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.class_id) for r in got} == {*want.items(), (None, want[3])}
    kept = dart_minhash.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert dart_minhash.report(nothing).count() == dart_minhash.keep(nothing).count() == 0


def test_hot_group_and_chain(spark):
    """Two hundred near copies without one centre, and a chain whose ends are unlike."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(200):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 5])):
            del w[rng.randrange(len(w))]
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(130)]
    rows += [(1000 + i, " ".join(chain[3 * i : 3 * i + 100])) for i in range(10)]
    want = brute_classes(rows)
    got = dart_minhash.report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == want


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    items = rng.integers(1, 2**62, 60).astype(np.uint64)
    a, b = rng.uniform(0.2, 9, 60), rng.uniform(0.2, 9, 60)
    k = 4096
    sig = dart_minhash.signatures(np.concatenate([items, items]), np.concatenate([a, b]), np.repeat([0, 1], 60), 2, k)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    alone = dart_minhash.signatures(items, None, np.zeros(60, np.int64), 1, k)
    ones = dart_minhash.signatures(items, np.ones(60), np.zeros(60, np.int64), 1, k)
    assert (alone == ones).all()


def test_repeated_windows(docs, nothing, texts):
    got = repeated_windows.removals(docs).collect()
    assert len(got) == docs.count()
    first, want = {}, {}
    for i, t in enumerate(texts):
        for k in range(len(words(t)) - 49):
            first.setdefault(tuple(words(t)[k : k + 50]), i)
    for i, t in enumerate(texts):
        w = words(t)
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    want[None] = (len(words(texts[3])), 0, hashlib.sha256(" ".join(words(texts[3])).encode()).hexdigest())
    assert sum(x[1] for x in want.values()) > 0
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
        assert sum(s.end - s.first for s in r.spans) == r.n_removed
    assert repeated_windows.removals(nothing).count() == 0


@pytest.mark.parametrize("shard_bytes", [3000, 1 << 20])
def test_token_shards(spark, docs, nothing, shard_bytes):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    odd = ["a  b", " a", "a ", "a \n b", "x\n\ny z", "it's <|endoftext|> q", "tab\t x\x1c y", "“a” b — c d", "é è", "\n"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "key long, text string")
    rows = docs.select(F.col("doc_id").alias("key"), "text").unionByName(more)
    folder = token_shards.new_folder(spark)
    manifest = token_shards.write(rows, folder, path, shard_bytes=shard_bytes)
    got = token_shards.read(manifest, folder).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(path)
    want = sorted(((-1 if r.key is None else r.key), [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in rows.collect())
    at = 0
    for r, (key, ids) in zip(got, want, strict=True):
        assert ((-1 if r.key is None else r.key), r.start, r.n_tokens) == (key, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    found = token_shards.lookup(spark.createDataFrame([(5,), (1003,), (99999,), (-7,)], "key long"), manifest, folder).collect()
    assert {r.key: list(r.ids) for r in found} == {k: i for k, i in want if k in (5, 1003)}
    none = token_shards.write(nothing.select(F.col("doc_id").alias("key"), "text"), token_shards.new_folder(spark), path)
    assert none.count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    assert sorted(token_shards.PerfectHash.build(keys).slots(keys).tolist()) == list(range(5000))


def test_support_vectors(spark, docs, nothing, sf):
    table, labels = spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{sf[:-5]}0.01/labels.parquet")
    got = support_vectors.score(table, labels.select("doc_id", F.col("quality").alias("label"))).join(labels, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95
    mine = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (None, 1), (6, None)], "doc_id long, label int")
    scores = support_vectors.score(docs, mine).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert all(r.score == 0.5 for r in support_vectors.score(docs, mine.filter("false")).collect())
    assert support_vectors.score(nothing, mine).count() == 0


def test_template_windows(spark, docs, nothing):
    ask = "{} has {} apples and gives {} apples to {}. How many apples does {} have after {} days of work?"
    items = spark.createDataFrame(
        [(1, ask.format("Anna", 3, 2, "Bob", "Anna", 5)), (2, "what is the tallest tree"), (3, None), (4, ""), (5, "9 8 7")], "item_id long, text string"
    )
    found = [
        (1, "Before that. " + ask.format("Anna", 3, 2, "Bob", "Anna", 5) + " and after."),
        (2, ask.format("Zoe", 7, 4, "Tom", "Zoe", "9")),
        (3, ask.format("Zoe", 7, 4, "Tom", "Kim", "9").replace("Zoe has", "Mia has 1")),
        (4, "so: What is the TALLEST tree of all"),
        (5, "nothing of that kind, 9 8 7"),
        (None, "what is the tallest tree"),
    ]
    mine = docs.select("doc_id", "text").unionByName(spark.createDataFrame(found, "doc_id long, text string"))
    got = template_windows.report(mine, items).collect()
    assert {(r.doc_id, r.item_id, r.same_values) for r in got if r.doc_id != 3} == {(1, 1, True), (2, 1, False), (None, 2, True)}
    whole = template_windows.keep(docs, items)
    assert whole.columns == docs.columns and whole.count() == docs.count()
    assert template_windows.report(nothing, items).count() == template_windows.report(docs, items.filter("false")).count() == 0


def test_template_windows_judge_each_occurrence(spark):
    ask = "{} has {} apples and gives {} apples to {}. How many apples does {} have after {} days of work?"
    verbatim = ask.format("Anna", 3, 2, "Bob", "Anna", 5)
    again = ask.format("Zoe", 7, 4, "Tom", "Zoe", 9)
    twice = "A has 3 apples in the box that stands by the old door. B has 5 apples in the box that stands by the old door."
    longer = ask.format("Mary Ann", 8, 6, "Jim", "Mary Ann", 11)
    items = spark.createDataFrame([(1, verbatim), (2, twice)], "item_id long, text string")
    found = [
        (1, f"{verbatim} Then: {again} And: {ask.format('Kim', 1, 6, 'Max', 'Kim', 8)}"), (2, f"{again} Now {ask.format('Eva', 12, 10, 'Ida', 'Eva', 6)}"),
        (3, f"So. {twice} End."), (4, ask.format("Zoe", 7, 4, "Tom", "Kim", 9)), (5, f"{longer} {again} {verbatim.replace('Anna', 'Mary Ann')}"),
    ]
    docs = spark.createDataFrame(found, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.same_values for r in template_windows.report(docs, items).collect()}
    assert got.pop((1, 1)) is True and got.pop((2, 1)) is False and got.pop((3, 2)) is True
    assert (5, 1) in got and all(i == 1 for _, i in got)
    assert {r.doc_id for r in template_windows.keep(docs, items).collect()} <= {4}


def test_template_windows_find_exact_text(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    items = [(1, "what is the tallest tree"), (2, "9 8 7"), (3, "The Old Man And The Sea By Ernest Hemingway"), (4, long)]
    found = [
        (1, "so: What is the TALLEST tree of all"), (2, "nothing of that kind, 9 8 7"), (3, "Read The Old Man And The Sea By Ernest Hemingway now"),
        (4, "A part: " + " ".join(long.split()[20:30]).upper()), (5, "what is the smallest tree, 9 8 6 7"), (6, " ".join(long.split()[20:27])), (7, None),
    ]
    docs = spark.createDataFrame(found, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    got = template_windows.findings(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(1, 5)} and all(r.same_values for r in got)
    assert {r.doc_id for r in template_windows.keep(docs, items).collect()} == {5, 6, 7}


def test_license_scan(spark, nothing):
    base = [(i, f"Some words of text number {i}.\nMore of it, quite plain.") for i in range(60)]
    said = {
        100: ("Text before.\nReleased under the MIT License.\nText.", "mit"),
        101: ("Licensed under the Apache License, Version 2.0.", "apache"),
        102: ("It says: this work is licensed under the GNU General Public License, version 3.", "gpl"),
        None: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    }
    rows = [*base, *[(i, t) for i, (t, _) in said.items()], (200, None), (201, ""), (202, "the license of the driver was lost in the public garden")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("confirmed").collect()
    assert {(r.doc_id, r.family) for r in got} == {(i, f) for i, (_, f) in said.items()}
    assert license_scan.scan(nothing).count() == 0


def test_uniform_shards(spark, docs, nothing):
    got = uniform_shards.shuffle(docs, 7, rows=10)
    assert got.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    rows = got.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == docs.count() and all(sorted(x) == list(range(len(x))) for x in by.values())
    sizes = [len(by[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, uniform_shards.shuffle(docs, 7, rows=10).collect()))
    assert uniform_shards.shuffle(nothing, 3).count() == 0
    few = uniform_shards.shuffle(docs.limit(2), 40).collect()
    assert len(few) == 2


def test_uniform_shards_refuse_no_number_of_rows(docs, monkeypatch):
    drawn, communication = [], uniform_shards.communication
    monkeypatch.setattr(uniform_shards, "CELLS", 40)
    monkeypatch.setattr(uniform_shards, "communication", lambda *a: drawn.append((len(a[0]), len(a[1]))) or communication(*a))
    rows = uniform_shards.shuffle(docs, 7, rows=2).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == docs.count() and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(cells == 7 and blocks * cells <= 40 for blocks, cells in drawn)


def test_communication_matrix_is_exact_and_uniform():
    total = np.zeros((3, 4))
    for seed in range(400):
        m = uniform_shards.communication([5, 9, 2], [4, 4, 4, 4], seed)
        assert m.sum(1).tolist() == [5, 9, 2] and m.sum(0).tolist() == [4] * 4 and (m >= 0).all()
        total += m
    assert abs(total / 400 - np.outer([5, 9, 2], [0.25] * 4)).max() < 0.3
    rng = np.random.default_rng(0)
    big = [uniform_shards.hypergeometric(rng, 10**9, 3 * 10**9, 400) for _ in range(300)]
    assert abs(np.mean(big) - 100) < 3 and 60 < np.var(big) < 95


def test_pfair_mix(spark, docs, nothing):
    rows = pfair_mix.mix(docs, block=2, chunk_rows=5).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(docs.count()))
    table = spark.range(900).select("id", F.when(F.col("id") < 600, "a").when(F.col("id") < 800, "b").otherwise("c").alias("source"))
    weights = {"a": 3.0, "b": 2.0, "c": 1.0, "absent": 5.0}
    rows = pfair_mix.mix(table, weights, block=5).orderBy("position").collect()
    exact, seen, stop = {"a": 0.5, "b": 1 / 3, "c": 1 / 6}, collections.Counter(), 500
    for i, r in enumerate(rows[:stop]):
        seen[r.source] += 1
        if (i + 1) % 5 == 0:
            assert all(abs(seen[s] / 5 - w * (i + 1) / 5) < 1.05 for s, w in exact.items())
    assert pfair_mix.mix(nothing).count() == 0


def test_mix_keeps_the_bound_over_many_periods():
    # what a source is off its exact share after each slot, until the first source ends
    blocks = {f"s{i:02}": 300 for i in range(19)} | {"big": 20_000}
    for weights in ({s: math.sqrt(n) for s, n in blocks.items()}, {s: n * (1 + i / 1000) for i, (s, n) in enumerate(blocks.items())}):
        total = sum(weights.values())
        plan = pfair_mix.phases(blocks, weights)
        assert sorted(t for slots in plan.values() for t in slots) == list(range(sum(blocks.values())))
        end = min(slots[-1] for slots in plan.values())
        for s, slots in plan.items():
            assert all(k - 1e-6 < (t + 1) * weights[s] / total and t * weights[s] / total < k + 1 + 1e-6 for k, t in enumerate(slots) if t <= end)


def test_schedule_meets_every_window():
    for slots in ({"a": 3, "b": 3, "c": 1}, {"a": 999, "b": 1}, {"a": 7, "b": 5, "c": 5, "d": 3}):
        period = sum(slots.values())
        for s, places in pfair_mix.schedule(slots).items():
            for k, t in enumerate(places):
                assert k * period // slots[s] <= t < -(-(k + 1) * period // slots[s])


def test_pipeline_and_queries(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.columns == [*docs.columns, "position", "shard", "slot"]
    passed = {r.doc_id for r in quality_rules.report(docs).filter("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in passed]
    classes = brute_classes(rows)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {i for i, t in rows if classes[i] == i and not any(x in t for x in items)}
    assert {r.doc_id for r in out.collect()} == want
    # The order of the mixture is there to read: every stretch of it holds each source by its weight, less than a block away.
    order = [r.source for r in out.orderBy("position").collect()]
    assert sorted(r.position for r in out.select("position").collect()) == list(range(len(want)))
    mixed = pfair_mix.mix(out.drop("position", "shard", "slot")).orderBy("position")
    assert order == [r.source for r in mixed.collect()]
    assert len(queries.QUERIES) == 13


CLASHING = [
    "quality_rules", "quality_rules_p", "quality_rules_votes", "bad_id", "bad_hash", "keep_this_row", "file_name", "file_row", "file_before", "node", "row", "class",
    "shuffle_block", "shuffle_here", "shuffle_there", "shuffle_ends", "shuffle_rank", "shuffle_chunk", "shuffle_before", "shuffle_within", "count",
    "mix_source", "mix_order", "mix_chunk", "mix_before", "mix_slots", "mix_within", "mix_index", "mix_slot", "Mix_Slot_2", "block", "position", "shard", "slot", "kept", "text_hash", "root",
]


def test_stages_leave_any_further_column_as_it_is(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    wide = docs.select("*", *[F.concat(F.lit(f"{c}="), F.col("doc_id")).alias(c) for c in CLASHING])
    wide.write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    whole = {str(r) for r in wide.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, sf)
        if name == "shards":
            made = ["shard", "slot", "position"]
            assert sorted(out.columns) == sorted(wide.columns)
            rows = {str(r) for r in out.drop(*made).collect()}
            assert rows == {str(r) for r in wide.drop(*made).collect()}
            continue
        assert out.columns == wide.columns, name
        got = [str(r) for r in out.collect()]
        assert got and set(got) <= whole and len(set(got)) == len(got), name
        assert name != "mixture" or set(got) == whole


def test_rows_without_id_spread_over_the_last_stages(spark, sf):
    import corpus_pipeline

    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    out = corpus_pipeline.shards(spark, corpus_pipeline.mixture(spark, rows, sf), sf).collect()
    assert len({r.text for r in out}) == len(out) == 30_000
    assert all(n == 750 for n in collections.Counter(r.shard for r in out).values()) and {r.position for r in out} == {None}
    # No block of equal hashes: the texts tell the rows apart.
    told = rows.select(F.pmod(F.xxhash64(F.lit(11), *[F.col(c) for c in rows.columns]), F.lit(4)).alias("b")).groupBy("b").count().collect()
    assert max(r["count"] for r in told) < 9_000


def test_rows_meet_their_files_number_without_a_shuffle(spark, docs, tmp_path):
    import corpus_pipeline

    docs.drop("position").write.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for texts whose size Spark does not know
    try:
        placed = corpus_pipeline.placed(spark.read.parquet(f"{tmp_path}/docs"))
        text = placed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    assert sorted(r.position for r in placed.select("position").collect()) == list(range(docs.count()))
