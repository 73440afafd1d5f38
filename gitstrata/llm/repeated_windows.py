"""Substring de-duplication: words under 50-word windows that an earlier document has too.

Every window gets its Rabin-Karp hash. Windows are counted in Spark, but only where a
repeat is possible: the smallest hash among the ``ANCHOR``-word runs inside a window is its
anchor, and equal windows have equal anchors. So the anchors (about one in twenty words) are
counted first; documents with an anchor that some other text has too come back with their
texts, and of these only the windows over such anchors are counted. Exact copies of a
text are settled by the text's hash before that.

Repeated windows of a document merge into maximal intervals, which are taken out.

A window is removed from a document when its word sequence also starts in a document
with a smaller id. Windows are judged on the input.

Defined cases: a NULL text has no words; texts under ``size`` words lose nothing; a row
without id is never earlier than another and loses nothing; rows that share an id are
not earlier than each other; repeated rows each get their result; the hash of an empty
rest is that of the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitstrata.llm.store import written
from gitstrata.llm.words import Texts, lists, signed, slices

SIZE, ANCHOR = 50, 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def anchors(t: Texts, size: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word and hash of every window of ``size`` words, and place and hash of its anchor (the leftmost smallest)."""
    at, window = t.windows(size)
    runs, small = t.windows(short)
    if not len(at):
        none = np.zeros(0, np.uint64)
        return at, window, at, none
    by_word = np.full(len(t.words), np.uint64(0xFFFFFFFFFFFFFFFF))
    by_word[runs] = small
    # Sliding minimum over ``size - short + 1`` runs by doubling; ties keep the left place.
    place, value, span, reach = np.arange(len(by_word)), by_word, 1, size - short + 1
    while span < reach:
        shift = min(span, reach - span)
        later = value[shift:] < value[:-shift]
        value = np.concatenate([np.where(later, value[shift:], value[:-shift]), value[-shift:]])
        place = np.concatenate([np.where(later, place[shift:], place[:-shift]), place[-shift:]])
        span += shift
    return at, window, place[at], value[at]


def _digest(words: bytes) -> str:
    return hashlib.sha256(words).hexdigest()


def _without(t: Texts, d: int, gone: np.ndarray | None = None) -> str:
    """SHA-256 of a text's words joined by one blank, without those marked in ``gone``."""
    lo, hi = t.first[d], t.first[d + 1]
    text = t.data[t.bounds[d] : t.bounds[d + 1]]
    if gone is None:
        return _digest(b" ".join(text.tobytes().split()))
    starts, ends = (x[lo:hi] - t.bounds[d] for x in t.spans)
    raw = text.tobytes()
    return _digest(b" ".join([raw[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)]))


def _survey(texts: DataFrame, size: int, short: int) -> DataFrame:
    """Per row of ``(doc_id, node, text)``: words, hash of the whole text's words, distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(2)):
                at, _, place, value = anchors(t, size, short)
                new = np.ones(len(at), bool)
                new[1:] = place[1:] != place[:-1]
                owner, value = t.doc[at[new]], value[new]
                order = np.lexsort((value, owner))
                owner, value = owner[order], value[order]
                new = np.ones(len(value), bool)
                new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
                found = lists(signed(value[new]), np.bincount(owner[new], minlength=len(t)))
                whole = pa.array([_without(t, d) for d in range(len(t))])
                ids = [batch.column(i).slice(t.row, len(t)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(t.counts), whole, found], ["doc_id", "node", "n_words", "whole", "anchors"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "node", "text").mapInArrow(run, f"doc_id {kind}, node binary, n_words long, whole string, anchors array<long>")


def _windows(texts: DataFrame, size: int, short: int) -> DataFrame:
    """``(doc_id, node, first, h1, h2)`` for the windows of ``(doc_id, node, repeated, text)`` over a repeated anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(3)):
                at, window, _, value = anchors(t, size, short)
                mine = batch.column(2).slice(t.row, len(t))
                offsets = np.asarray(mine.offsets)
                wanted = np.asarray(mine.values)[offsets[0] : offsets[-1]].view(np.uint64)
                whose = np.repeat(np.arange(len(t), dtype=np.uint64), np.diff(offsets)) * _ODD
                hit = np.isin(value ^ (t.doc[at].astype(np.uint64) * _ODD), wanted ^ whose)
                at, window, value = at[hit], window[hit], value[hit]
                take = pa.array(t.doc[at] + t.row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array((at - t.first[t.doc[at]]).astype(np.int32)),
                     pa.array(signed(window)), pa.array(signed(value))],
                    ["doc_id", "node", "first", "h1", "h2"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "node", "repeated", "text").mapInArrow(run, f"doc_id {kind}, node binary, first int, h1 long, h2 long")


def _cut(texts: DataFrame, size: int) -> DataFrame:
    """``(doc_id, node, n_removed, kept_sha256, spans)`` from ``(doc_id, node, starts, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(3)):
                mine = batch.column(2).slice(t.row, len(t))
                removed, digests, spans = [], [], []
                for d in range(len(t)):
                    starts = np.asarray(mine[d].values)
                    step = np.zeros(t.counts[d] + 1, np.int64)
                    np.add.at(step, starts, 1)
                    np.add.at(step, starts + size, -1)
                    gone = np.cumsum(step)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    removed.append(int(gone.sum()))
                    digests.append(_without(t, d, gone))
                    spans.append([{"first": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                ids = [batch.column(i).slice(t.row, len(t)) for i in (0, 1)]
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, kind)],
                    ["doc_id", "node", "n_removed", "kept_sha256", "spans"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, node binary, n_removed long, kept_sha256 string, spans array<struct<first:bigint,end:bigint>>"
    return texts.select("doc_id", "node", "starts", "text").mapInArrow(run, schema)


def removals(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256 and the removed intervals of word numbers ``[first, end)``."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))
    survey = written(_survey(texts, size, anchor), "survey")
    least = survey.groupBy("node").agg(F.min("doc_id").alias("least"))
    known = survey.join(least, "node")
    # The first holder of each text; its copies are covered whole, or too short for a window.
    firsts = known.filter(F.col("doc_id") == F.col("least"))
    runs = firsts.select("doc_id", "node", F.explode("anchors").alias("anchor"))
    repeated = runs.groupBy("anchor").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi").select("anchor")
    wanted = runs.join(repeated, "anchor").groupBy("doc_id", "node").agg(F.collect_set("anchor").alias("repeated"))
    looked_at = written(texts.join(wanted, ["doc_id", "node"]).dropDuplicates(["doc_id", "node"]), "looked-at")
    windows = written(_windows(looked_at, size, anchor), "windows")
    earliest = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))
    later = windows.join(earliest.filter("earliest < latest").drop("latest"), ["h1", "h2"]).filter(F.col("doc_id") > F.col("earliest"))
    starts = later.groupBy("doc_id", "node").agg(F.collect_list("first").alias("starts"))
    cut = _cut(looked_at.join(starts, ["doc_id", "node"]), size)
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_words") >= size)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("end")))
    nothing = F.array().cast("array<struct<first:bigint,end:bigint>>")
    return known.drop("anchors").join(cut, ["doc_id", "node"], "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(_digest(b""))).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", nothing)).alias("spans"),
    )
