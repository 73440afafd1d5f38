"""Quality classifier: naive Bayes support vectors.

Features of a text are indicators of n-grams, hashed into ``DIMENSIONS`` places: single
and paired words in lower case, and runs of one to three word shapes (case, digits, last
character, length, same word again), with one indicator for how often whole lines come again. An indicator is scaled by
its class log-count ratio, each text is brought to length one, and a linear hinge-loss
model is fitted by dual coordinate descent. A logistic curve fitted on rows kept out of the descent
turns margins into probabilities.

Learning uses at most ``LABELLED`` labelled rows, the smallest in hash order: Spark counts their features,
the descent runs over at most ``FITTED`` of them. Scoring covers every row.

Defined cases: NULL and empty texts have no feature and get the calibrated probability of
margin zero; without usable labels every score is 0.5; a document whose labels disagree is not learned from; repeated
rows are scored each; a NULL id counts as the empty text for the held-out rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from gitstrata.llm.store import remainder, written
from gitstrata.llm.words import LOWER, Texts, lists, mix, slices

DIMENSIONS, LABELLED, FITTED = 1 << 18, 20_000, 6_000
COST, ROUNDS, SMOOTHING = 1.0, 12, 1.0
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _kinds() -> np.ndarray:
    """0 other, 1 upper, 2 lower or beyond ASCII, 3 digit, 4 sentence mark, 5 exclamation, 6 symbol."""
    out = np.zeros(256, np.uint8)
    out[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
    out[list(b"abcdefghijklmnopqrstuvwxyz")] = 2
    out[128:] = 2
    out[list(b"0123456789")] = 3
    out[list(b".,;:?'\")-")] = 4
    out[list(b"!")] = 5
    out[list(b"#*$%&|<>@^~_=+\\/{}[]")] = 6
    return out


_KIND = _kinds()


def shapes(t: Texts) -> np.ndarray:
    """A small number for each word's look."""
    start, end = t.spans
    kind = _KIND[t.data]

    def count(k: int) -> np.ndarray:
        sums = np.zeros(len(kind) + 1, np.int64)
        np.cumsum(kind == k, out=sums[1:])
        return sums[end] - sums[start]

    upper, lower, digit = count(1), count(2), count(3)
    case = np.where(upper == 0, np.where(lower == 0, 0, 1), np.where(lower == 0, 2, 3))
    again = np.zeros(len(start), np.int64)
    again[1:] = (t.words[1:] == t.words[:-1]) & (t.doc[1:] == t.doc[:-1])
    size = np.searchsorted([2, 5, 12, 24], end - start, "left")
    return (((case * 2 + (digit > 0)) * 7 + kind[end - 1]) * 5 + size) * 2 + again


def features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, in order, and how many each text has."""
    lower = Texts(LOWER[t.data], t.bounds, t.row)
    word, shape = lower.words, mix(shapes(t).astype(np.uint64) + np.uint64(7))
    found = [(np.arange(len(word)), word), (np.arange(len(word)), shape)]
    for base, most in ((word, 2), (shape, 3)):
        run = base
        for n in range(2, most + 1):
            if len(base) >= n:
                run = mix(run[:-1] * _ODD + base[n - 1 :])
                found.append((np.flatnonzero(t.doc[n - 1 :] == t.doc[: len(t.doc) - n + 1]), run))
    hashed = [h[at] if len(at) < len(h) else h for at, h in found]
    owner = [t.doc[at] for at, _ in found]
    breaks = np.flatnonzero(t.data == 10)
    a, b = np.sort(np.concatenate([t.bounds[:-1], breaks + 1])), np.sort(np.concatenate([breaks, t.bounds[1:]]))
    full = b > a
    a, b = a[full], b[full]
    line_doc = np.searchsorted(t.bounds, a, "right") - 1
    key = np.unique(t.prints(a, b) ^ mix(line_doc.astype(np.uint64)), return_index=True)[1]
    repeats = np.bincount(line_doc, minlength=len(t)) - np.bincount(line_doc[key], minlength=len(t))
    some = np.flatnonzero(repeats)
    hashed.append(mix(np.log2(repeats[some]).astype(np.uint64) + np.uint64(1 << 40)))
    owner.append(some)
    keys = np.concatenate(owner) * DIMENSIONS + (np.concatenate(hashed) % np.uint64(DIMENSIONS)).astype(np.int64)
    keys = np.sort(keys)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return (keys % DIMENSIONS).astype(np.int32), np.bincount(keys // DIMENSIONS, minlength=len(t))


def descend(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the hinge-loss model over unit rows ``ratio[x]``, by dual coordinate descent."""
    w, alpha = np.zeros(len(ratio)), np.zeros(len(x))
    rng = np.random.default_rng(5)
    rows = []
    for f in x:
        v = ratio[f]
        rows.append(v / max(np.sqrt(v @ v), 1e-12))
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            gain = y[i] * (w[x[i]] @ rows[i]) - 1
            now = min(max(alpha[i] - gain, 0.0), cost)
            if now != alpha[i]:
                w[x[i]] += (now - alpha[i]) * y[i] * rows[i]
                alpha[i] = now
    return w


def margins(flat: np.ndarray, counts: np.ndarray, weight: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Margin of each text from its features; ``weight`` holds weight times ratio."""
    edges = np.concatenate([[0], np.cumsum(counts)])
    sums = [np.diff(np.concatenate([[0.0], np.cumsum(v[flat])])[edges]) for v in (weight, square)]
    return sums[0] / np.sqrt(np.maximum(sums[1], 1e-12))


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of class one given the margin; targets are smoothed, the slope is not negative."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -50, 50)))
        g, s = p - target, p * (1 - p) + 1e-9
        h = np.array([[(s * m * m).sum() + 1e-6, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, [(g * m).sum(), g.sum()])
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return max(float(a), 0.0), float(b)


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, fitted: int = FITTED) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weights by feature, squared ratios, slope and shift, from ``docs(doc_id, text)`` and ``labels(doc_id, label)``."""
    one = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("label").alias("label"), F.max("label").alias("most")
    )
    agreed = one.filter("label = most").select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("h"))
    sample = written(agreed.orderBy("h", "doc_id").limit(labelled), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(2)):
                flat, counts = features(t)
                ids = [batch.column(i).slice(t.row, len(t)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, lists(flat, counts)], ["label", "h", "f"])

    # ``labelled`` rows of three numbers: a bounded broadcast.
    mine = docs.join(F.broadcast(sample), "doc_id").select("label", "h", "text")
    rows = written(mine.mapInArrow(run, "label int, h long, f array<int>"), "features")
    seen = rows.select("label", F.explode("f").alias("f")).groupBy("f").agg(
        F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")
    ).toPandas()  # at most DIMENSIONS rows
    n = np.full((2, DIMENSIONS), SMOOTHING)
    n[0, seen["f"]] += seen["n0"]
    n[1, seen["f"]] += seen["n1"]
    ratio = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
    cut = sample.agg(F.percentile_approx("h", min(1.0, fitted / max(labelled, 1)), 10000)).first()[0] if sample.count() >= labelled else None
    some = rows if cut is None or fitted >= labelled else rows.filter(F.col("h") <= cut)
    got = some.orderBy("h").limit(fitted).toArrow()
    if not got.num_rows:
        return np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0
    f = got.column("f").combine_chunks()
    offsets, values = np.asarray(f.offsets), np.asarray(f.values)
    x = [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    y = np.where(np.asarray(got.column("label")) == 1, 1.0, -1.0)
    kept_out = np.arange(len(x)) % 4 == 3
    w = descend([r for r, out in zip(x, kept_out, strict=True) if not out], y[~kept_out], ratio)
    check = kept_out if kept_out.any() else ~kept_out
    held = [r for r, c in zip(x, check, strict=True) if c]
    m = margins(np.concatenate(held), np.array([len(r) for r in held]), w * ratio, ratio**2)
    return w * ratio, ratio**2, *logistic(m, y[check])


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: held_out, score (probability of label 1) and the class predicted at ``threshold``."""
    held_out = remainder("doc_id", 5) == 0
    source = docs.select("doc_id", "text")
    train = source.filter(~held_out)
    weight, square, slope, shift = learn(train, labels.filter(~held_out))
    shared = docs.sparkSession.sparkContext.broadcast((weight, square))

    @arrow_udf(DoubleType())
    def probability(text: pa.Array) -> pa.Array:
        weight, square = shared.value
        m = [margins(*features(t), weight, square) for t in slices(text)]
        return pa.array(1 / (1 + np.exp(-np.clip(slope * np.concatenate(m) + shift, -500, 500))) if m else np.zeros(0))

    scored = source.select("doc_id", held_out.alias("held_out"), probability("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
