"""Language-model scoring with a hidden Markov model.

Tokens are the words of a text with A-Z lowered, then one end. Training counts every
token of every training text. The ``own`` most frequent tokens are emission classes of
their own; all other tokens, known or not, share a class with those that end in the same
three bytes (``shared`` hashed classes), so what a state must store is bounded:

    P(token | state) = P(class | state) * (c + 1) / (sum of c + 1 over the class, + 1 for the unseen)

Baum-Welch starts from counts of all training texts, each of which leans to one state by a hash of its content, then
runs ``passes`` times over all of them: each task returns its expected counts per class and state, Spark
adds them, and the driver normalises the bounded table. No step learns from a sample. Long texts are cut into pieces
of ``PIECE`` tokens for training only. Scoring is the scaled forward recursion over the
whole text and gives the exact likelihood.

Counts of frequent tokens travel as a bounded broadcast; the others are joined in Spark.

Defined cases: a NULL or empty text is one end token; without training texts every token
is unknown and the model is uniform over its classes; repeated rows are scored each and
repeated training rows count each; a NULL id counts as the empty text for the held-out rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitstrata.llm.store import remainder, written
from gitstrata.llm.words import Texts, lists, signed, slices

OWN, SHARED, STATES, PASSES = 1 << 16, 1 << 13, 8, 6
PIECE, LEAN = 128, 0.7
BATCH, MERGED = 1 << 18, 1 << 19
POOLED, DISCOUNT = 0.03, 0.9
END = np.uint64(0x1F83D9ABFB41BD6B)


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and three-byte ending of each token, the end of each text included; tokens per text."""
    start, end = t.spans
    n = t.counts
    place = np.arange(len(start)) + t.doc
    total = len(start) + len(t)
    prints, tails = np.full(total, END, np.uint64), np.full(total, END, np.uint64)
    prints[place] = t.words
    tails[place] = t.prints(np.maximum(start, end - 3), end)
    return prints, tails, n + 1


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """``(token, tail, n)`` over all texts, summed over some slices before Spark sums them."""

    def merged(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        token, tail, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(token, kind="stable")
        token, tail, n = token[order], tail[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sums = np.add.reduceat(n, at)
        return pa.RecordBatch.from_arrays([pa.array(signed(token[at])), pa.array(signed(tail[at])), pa.array(sums)], ["token", "tail", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for t in slices(batch.column(0), lower=True):
                prints, tails, _ = tokens(t)
                found, at, n = np.unique(prints, return_index=True, return_counts=True)
                parts.append((found, tails[at], n))
                held += len(found)
                if held >= MERGED:
                    yield merged(parts)
                    parts, held = [], 0
        if parts:
            yield merged(parts)

    part = docs.select(text).mapInArrow(run, "token long, tail long, n long")
    return part.groupBy("token").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Classes:
    """The bounded part of the vocabulary: frequent tokens with their counts, and the shared classes' sums."""

    token: np.ndarray
    n: np.ndarray
    weight: np.ndarray
    total: int
    kinds: int

    def __len__(self) -> int:
        return len(self.token) + len(self.weight)

    def of(self, prints: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token, and whether it has a class of its own."""
        unique, back = np.unique(prints, return_inverse=True)
        at = np.minimum(np.searchsorted(self.token, unique), max(len(self.token) - 1, 0))
        own = self.token[at] == unique if len(self.token) else np.zeros(len(unique), bool)
        own, at = own[back], at[back]
        shared = len(self.token) + (tails % np.uint64(len(self.weight))).astype(np.int64)
        return np.where(own, at, shared).astype(np.int32), own


def classes(counts: DataFrame, own: int, shared: int) -> Classes:
    """Collects the ``own`` most frequent tokens and ``shared`` sums; both are bounded by these parameters."""
    top = counts.orderBy(F.desc("n"), "token").limit(own).toPandas().sort_values("token")
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("n").alias("kinds")).first()
    out = Classes(token[order], top["n"].to_numpy(np.int64)[order], np.ones(shared), row["total"], row["kinds"])
    # Unsigned remainder of the ending, as in Classes.of.
    bucket = F.pmod(F.pmod(F.shiftrightunsigned("tail", 1), F.lit(shared)) * 2 + F.col("tail").bitwiseAND(1), F.lit(shared))
    sums = counts.groupBy(bucket.cast("int").alias("bucket")).agg((F.sum("n") + F.count("n")).alias("w")).toPandas()
    out.weight[sums["bucket"].to_numpy(np.int64)] += sums["w"].to_numpy(float)
    mine = (top["tail"].to_numpy(np.int64).view(np.uint64) % np.uint64(shared)).astype(np.int64)
    np.subtract.at(out.weight, mine, top["n"].to_numpy(float) + 1)
    return out


@dataclass
class Model:
    """Start, transition and emission probabilities."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @staticmethod
    def of(start: np.ndarray, step: np.ndarray, emit: np.ndarray, base: np.ndarray) -> Model:
        """Normalises counts.

        Each class gives ``DISCOUNT`` of its count, and every state the share ``POOLED`` of
        the rest, to the corpus' own distribution: what was seen once says little about a state.
        """
        step = step + np.eye(len(start)) * 5 + 0.1
        emit = emit + base[:, None]
        kept = emit * np.clip(1 - DISCOUNT / np.maximum(emit.sum(1, keepdims=True), DISCOUNT), 0, 1) / emit.sum(0)
        kept *= 1 - POOLED
        emit = kept + (1 - kept.sum(0)) * base[:, None]
        return Model((start + 0.5) / (start + 0.5).sum(), step / step.sum(1, keepdims=True), emit)


def padded(seq: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of sequences of near length: their numbers (longest first), and classes by step and sequence.

    Groups hold about ``BATCH`` cells, so memory does not depend on how many sequences come.
    """
    order = np.argsort(-counts, kind="stable")
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    i = 0
    while i < len(order):
        longest = counts[order[i]]
        j = min(len(order), i + max(1, BATCH // max(int(longest), 1)))
        rows = order[i:j]
        n = counts[rows]
        live = np.arange(longest)[:, None] < n[None, :]
        at = np.minimum(first[rows][None, :] + np.arange(longest)[:, None], len(seq) - 1)
        yield rows, np.where(live, seq[at], 0), n
        i = j


def forward(model: Model, seq: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Natural log of each sequence's probability."""
    out = np.zeros(len(counts))
    for rows, cells, n in padded(seq, counts):
        live = np.searchsorted(-n, -np.arange(1, len(cells) + 1), "right")
        alpha = np.broadcast_to(model.start, (len(rows), len(model.start)))
        log = np.zeros(len(rows))
        for step in range(len(cells)):
            m = live[step]
            a = alpha[:m] if step == 0 else alpha[:m] @ model.step
            a = a * model.emit[cells[step, :m]]
            scale = a.sum(1)
            log[:m] += np.log(scale)
            alpha = a / scale[:, None]
        out[rows] = log
    return out


def expect(model: Model, seq: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected start, transition and emission counts (Baum-Welch) of some sequences."""
    k = len(model.start)
    start, step, emit = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k))
    for rows, cells, n in padded(seq, counts):
        length = len(cells)
        live = np.searchsorted(-n, -np.arange(1, length + 1), "right")
        alphas, scales, seen = [], [], []
        alpha = np.broadcast_to(model.start, (len(rows), k))
        for i in range(length):
            m = live[i]
            b = model.emit[cells[i, :m]]
            a = (alpha[:m] if i == 0 else alpha[:m] @ model.step) * b
            scale = a.sum(1, keepdims=True)
            alpha = a / scale
            alphas.append(alpha)
            scales.append(scale)
            seen.append(b)
        beta = np.ones((live[-1], k))
        for i in range(length - 1, -1, -1):
            m = live[i]
            if m > len(beta):
                beta = np.concatenate([beta, np.ones((m - len(beta), k))])
            gamma = alphas[i] * beta
            alphas[i], alpha = gamma, alphas[i]
            if i:
                after = seen[i] * beta / scales[i]
                step += (alphas[i - 1][:m].T @ after) * model.step
                beta = after @ model.step.T
        start += alphas[0].sum(0)
        gamma = np.concatenate(alphas)
        where = np.concatenate([cells[i, : live[i]] for i in range(length)])
        for s in range(k):
            emit[:, s] += np.bincount(where, weights=gamma[:, s], minlength=len(emit))
    return start, step, emit


def pieces(seq: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Lengths after cutting each sequence into runs of at most ``size``."""
    whole, rest = counts // size, counts % size
    parts = whole + (rest > 0)
    out = np.full(int(parts.sum()), size)
    last = np.cumsum(parts) - 1
    out[last[rest > 0]] = rest[rest > 0]
    return out


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], np.diff(offsets)


def encode(docs: DataFrame, text: str, known: Classes) -> DataFrame:
    """``docs`` (id, held_out, text) as class sequences, with each document's tail tokens.

    ``base``: sum of log10(c + 1) over tokens with a class of their own; ``inner``: the sum
    of -log10 of the shared classes' weights over the others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        logs = np.log10(known.n + 1.0) if len(known.n) else np.zeros(1)
        inner = np.log10(known.weight)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for t in slices(batch.column(2), lower=True):
                prints, tails, counts = tokens(t)
                which, own = known.of(prints, tails)
                doc = np.repeat(np.arange(len(t)), counts)
                base = np.bincount(doc, weights=np.where(own, logs[np.where(own, which, 0)], 0.0), minlength=len(t))
                rest = np.where(own, 0, which - len(known.token))
                lost = np.bincount(doc, weights=np.where(own, 0.0, -inner[rest]), minlength=len(t))
                rare = np.flatnonzero(~own)
                # Repeats of a rare token in one text travel once.
                order = rare[np.lexsort((prints[rare], doc[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (prints[order[1:]] != prints[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(order))).astype(np.int32)
                per = np.bincount(doc[order[at]], minlength=len(t))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(t.row, len(t)), batch.column(1).slice(t.row, len(t)),
                        pa.array(counts.astype(np.int64)), pa.array(np.bincount(doc[own], minlength=len(t)).astype(np.int64)),
                        pa.array(base), pa.array(lost), pa.array(np.arange(row, row + len(t))), lists(which, counts),
                        lists(signed(prints[order[at]]), per), lists(times, per),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_own", "base", "inner", "row", "classes", "rare", "times"],
                )
                row += len(t)

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(
        run,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_own long, base double, inner double, "
        "row long, classes array<int>, rare array<long>, times array<int>",
    )


def trained(encoded: DataFrame, base: np.ndarray, states: int, count: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """The model of the start, transition and emission counts that ``count(seq, counts, print)`` gives, added over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            seq, counts = ragged(batch.column(0))
            part = count(seq, counts, np.asarray(batch.column(1))) if len(seq) else None
            if part:
                total = part if total is None else tuple(a + b for a, b in zip(total, part, strict=True))
        if total is not None:
            start, step, emit = total
            rows = np.flatnonzero(emit.any(1))
            # Rows below zero hold the start and the transitions.
            key = np.concatenate([-1 - np.arange(states + 1), rows]).astype(np.int32)
            value = np.concatenate([start[None], step, emit[rows]])
            yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(v) for v in value.T]], ["k", *[f"s{i}" for i in range(states)]])

    named = [f"s{i}" for i in range(states)]
    texts = encoded.filter(~F.col("held_out")).select("classes", F.xxhash64("classes").alias("print"))
    parts = texts.mapInArrow(run, "k int, " + ", ".join(f"{c} double" for c in named))
    sums = parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in named]).toPandas()  # at most own + shared + states + 1 rows
    table = np.zeros((len(base) + states + 1, states))
    table[sums["k"].to_numpy(np.int64)] = sums[named].to_numpy()
    return Model.of(table[-1], table[-2 : -2 - states : -1], table[: len(base)], base)


def first_model(encoded: DataFrame, base: np.ndarray, states: int) -> Model:
    """A first model from all training texts: each leans to one state by a hash of its content, and states last."""

    def count(seq: np.ndarray, counts: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lean = np.repeat((prints.view(np.uint64) % np.uint64(states)).astype(np.int64), counts)
        here = np.bincount(seq * np.int64(states) + lean, minlength=len(base) * states).reshape(-1, states)
        rest = (1 - LEAN) / max(states - 1, 1)
        return np.zeros(states), np.eye(states) * counts.sum(), here * (LEAN - rest) + here.sum(1, keepdims=True) * rest

    return trained(encoded, base, states, count)


def baum_welch(encoded: DataFrame, model: Model, base: np.ndarray) -> Model:
    """One pass over all training sequences."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def count(seq: np.ndarray, counts: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return expect(shared.value, seq, pieces(seq, counts, PIECE))

    return trained(encoded, base, len(model.start), count)


def likelihood(encoded: DataFrame, model: Model) -> DataFrame:
    """``encoded`` without sequences and with ``path``: log10 probability of each class sequence."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in encoded.columns if c != "classes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, counts = ragged(batch.column("classes"))
            path = forward(shared.value, seq, counts) / np.log(10)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(path)], [*rest, "path"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema if f.name != "classes")
    return encoded.mapInArrow(run, f"{fields}, path double")


def score(
    docs: DataFrame, text: str = "text", key: str = "doc_id", own: int = OWN, shared: int = SHARED, states: int = STATES,
    passes: int = PASSES, held_out: Callable[[str], object] = lambda key: remainder(key, 7) == 2,
) -> DataFrame:
    """One row per document: held_out, token counts, unigram base score and the model's score, both log10."""
    source = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("text"))
    counts = written(count_tokens(source.filter(~F.col("held_out")), "text"), "token-counts")
    known = classes(counts, own, shared)
    encoded = written(encode(source, "text", known), "token-classes")
    base = np.concatenate([known.n + 1.0, known.weight])
    base = base / base.sum()
    model = first_model(encoded, base, states)
    for _ in range(passes):
        model = baum_welch(encoded, model, base)
    scored = likelihood(encoded.drop("rare", "times"), model)
    # Rare tokens meet their counts in a join.
    pairs = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    pairs = pairs.select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    tail = pairs.join(counts.select("token", "n"), "token").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_log"), F.sum("times").alias("tail_known")
    )
    log, found = F.coalesce("tail_log", F.lit(0.0)), F.coalesce("tail_known", F.lit(0))
    return scored.join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_own") + found).cast("long").alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.log10(F.lit(float(known.total + known.kinds + 1)))).alias("base_score"),
        (F.col("path") + F.col("inner") + log).alias("score"),
    )
