"""Stretches of words that repeat with a period, found over tiles of documents.

A run of period ``p`` that is at least ``POWER`` (4) periods long has ``3 p`` places in a row whose word equals the
word ``p`` further on. For the octave ``L <= p < 2 L`` these places hold two whole blocks between multiples
of ``L``, the boundaries. So, per octave:

* A task looks for boundaries with a block that returns ``L`` to ``2 L - 1`` words later, by hashes of ``L`` words, and
  writes the tiles (stretches of ``16 L`` words and more, overlapping by ``4 L``) that hold such a boundary. Boundaries inside
  a stretch of a period below ``L`` are left out: all periods of the octave are its multiples there.
* Tiles of documents of more than ``FAR`` words are written and dealt out anew, so that many tasks solve a long document; those
  of shorter ones are solved where they are. Either way a tile is solved on its own, on numbers of its words: a Z-function forward
  and one backward from a boundary give how far every period of the octave reaches to both sides. Periods that are multiples of
  a smaller one are dropped by the same Z-function, and so are, in a shorter document, those that cover too few words for a run.
* The fragments, intervals of places, go by document and period and are stitched where they touch.

Hashes only choose boundaries; equal words have equal hashes, and every reach is found on the words themselves.

Defined cases: a NULL text has no words; a NULL id counts as empty text in the checksum that shifts a text; rows are told
apart by id and text, so repeated ids do not mix and repeated rows each get the same result; a text
without run keeps all words and has four NULLs; the digest of nothing is that of the empty text; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.llm.repeated_windows import _digest
from gitstrata.llm.store import written
from gitstrata.llm.words import _WORD_BASE, Texts, rolling, slices

POWER, LEAST = 4, 6
TILE, LEAST_TILE = 16, 512
STEP, FAR = 1 << 18, 1 << 15


def shifted(n: int, h: int) -> np.ndarray | None:
    """For a checksum divisible by ten: which original word stands at each of ``n`` places; NULL where nothing changes."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def word_order(t: Texts, h: np.ndarray) -> np.ndarray:
    """The number, in the slice, of the word at each place of its texts."""
    at = np.arange(len(t.doc))
    for d in np.flatnonzero((h % 10 == 0) & (t.counts > 0)).tolist():
        lo = t.first[d]
        at[lo : t.first[d + 1]] = lo + shifted(int(t.counts[d]), int(h[d]))
    return at


def _returning(sums: np.ndarray, inverse: np.ndarray, places: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Least distance from ``length`` up to twice that (not included) at which the block at each place returns; 0 if none."""
    out = np.zeros(len(places), np.int64)
    step = max(1, STEP // length)
    far = np.arange(length, 2 * length)
    for low in range(0, len(places), step):
        at = places[low : low + step]
        block = (sums[at + length] - sums[at]) * inverse[at]
        there = at[:, None] + far[None, :]
        inside = there + length <= ends[low : low + step, None]
        there[~inside] = 0
        equal = ((sums[there + length] - sums[there]) * inverse[there] == block[:, None]) & inside
        hit = equal.any(1)
        out[low : low + step][hit] = far[equal[hit].argmax(1)]
    return out


def boundaries(t: Texts, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per octave, the places (in the slice) of the boundaries that may lie in a run of the octave."""
    sums, inverse = rolling(values, _WORD_BASE)
    counts, starts = t.counts, t.first[:-1]
    small = np.zeros(len(values) + 1, np.int64)
    length = 1
    while True:
        long = np.flatnonzero(counts >= max(LEAST, POWER * length))
        if not len(long):
            return
        blocks = counts[long] // length - 1
        places = np.repeat(starts[long], blocks) + length * _ranges(blocks)
        ends = np.repeat(t.first[1:][long], blocks)
        period = _returning(sums, inverse, places, ends, length)
        hit = period > 0
        places, period, ends = places[hit], period[hit], ends[hit]
        # The next three blocks have a smaller period: the octave's own are its multiples.
        known = small[places]
        near = np.minimum(places + 3 * length, ends)
        inner = (known > 0) & (places + 3 * length <= ends)
        a, b, k = places[inner], near[inner], known[inner]
        inner[inner] = (sums[b - k] - sums[a]) * inverse[a] == (sums[b] - sums[a + k]) * inverse[a + k]
        small[places[~inner]] = period[~inner]
        if (~inner).any():
            yield length, places[~inner]
        length *= 2


def _ranges(counts: np.ndarray) -> np.ndarray:
    """``0 .. counts[i] - 1``, one range behind the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _possible(found: list[tuple[int, int, int]]) -> list[dict[str, int]]:
    """Those of all fragments of a document whose period covers enough words to make a run."""
    covered: dict[int, int] = {}
    for p, first, end in found:
        covered[p] = covered.get(p, p) + end - first
    return [{"period": p, "first": first, "end": end} for p, first, end in found if covered[p] >= max(LEAST, POWER * p)]


def survey(texts: DataFrame, far: int = FAR) -> DataFrame:
    """Rows of two kinds from ``(doc_id, node, h, text)``.

    One per document (``octave`` 0): number of words, digest of all words, the fragments of a short one, and the text if there are
    fragments or tiles. One per tile of a long document: the octave ``L``, the word number ``first`` of its first word, its words as
    numbers, and the boundaries in it.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "node", "octave", "n_words", "whole", "text", "found", "first", "codes", "marks"]
    pair = pa.list_(pa.struct([("period", pa.int64()), ("first", pa.int64()), ("end", pa.int64())]))
    schema = f"doc_id {kind}, node binary, octave int, n_words long, whole string, text string, found array<struct<period:bigint,first:bigint,end:bigint>>, first int, codes array<int>, marks array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(3)):
                h = np.asarray(batch.column(2).slice(t.row, len(t)))
                order = word_order(t, h)
                values = t.words[order]
                owner, octave, first, codes, marks, numbered, found = [], [], [], [], [], {}, {}
                for length, places in boundaries(t, values):
                    size = max(TILE * length, LEAST_TILE)
                    doc = t.doc[places]
                    tile = (places - t.first[doc]) // size
                    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tile[1:] != tile[:-1])]))
                    for a, b in zip(cut.tolist(), np.append(cut[1:], len(places)).tolist(), strict=True):
                        d, base = int(doc[a]), int(t.first[doc[a]])
                        if d not in numbered:
                            numbered = {d: _numbers(t, order, d)}
                        lo = max(0, int(tile[a]) * size - length)
                        hi = min(int(t.counts[d]), (int(tile[a]) + 1) * size + 3 * length)
                        inside = (places[a:b] - base - lo).astype(np.int32)
                        if t.counts[d] <= far:
                            found.setdefault(d, []).extend((p, lo + x, lo + y) for p, x, y in fragments(numbered[d][lo:hi], inside, length))
                            continue
                        owner.append(d)
                        octave.append(length)
                        first.append(lo)
                        codes.append(numbered[d][lo:hi])
                        marks.append(inside)
                whole = [_digest(_joined(t, order, d)) for d in range(len(t))]
                found = {d: some for d, x in found.items() if (some := _possible(x))}
                long = set(owner)
                n, m = len(t), len(owner)
                place = pa.array(np.concatenate([np.arange(n), np.array(owner, np.int64)]) + t.row)
                text = [batch.column(3)[t.row + d].as_py() if found.get(d) or d in long else None for d in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(place), batch.column(1).take(place), pa.array([0] * n + octave, pa.int32()),
                     pa.array([*t.counts.tolist(), *[None] * m], pa.int64()), pa.array(whole + [None] * m, pa.string()), pa.array(text + [None] * m, pa.string()), pa.array([found.get(d) or None for d in range(n)] + [None] * m, pair),
                     pa.array([None] * n + first, pa.int32()), pa.array([None] * n + codes, pa.list_(pa.int32())), pa.array([None] * n + marks, pa.list_(pa.int32()))],
                    names,
                )

    return texts.select("doc_id", "node", "h", "text").mapInArrow(run, schema)


def _words(t: Texts, d: int) -> list[bytes]:
    return t.data[t.bounds[d] : t.bounds[d + 1]].tobytes().split()


def _numbers(t: Texts, order: np.ndarray, d: int) -> np.ndarray:
    """The words of a text as numbers, equal where the words are."""
    known: dict[bytes, int] = {}
    own = np.array([known.setdefault(w, len(known)) for w in _words(t, d)], np.int32)
    return own[order[t.first[d] : t.first[d + 1]] - t.first[d]]


def _joined(t: Texts, order: np.ndarray, d: int, kept: np.ndarray | None = None) -> bytes:
    """The words of a text in their order, or those marked in ``kept``, joined by one blank."""
    words, at = _words(t, d), order[t.first[d] : t.first[d + 1]] - t.first[d]
    return b" ".join([words[i] for i in (at if kept is None else at[kept]).tolist()])


def z_function(s: list[int]) -> list[int]:
    """For each place, how many values from there on equal those from the beginning."""
    n = len(s)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = z[i - left] if i < right else 0
        if i + k >= right:
            k = max(right - i, 0)
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def fragments(codes: np.ndarray, marks: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """``(period, first, end)``: intervals of places that equal the place a period later, from the boundaries of a tile."""
    open_, out = {}, []
    for b in marks.tolist():
        ahead = codes[b : b + 4 * length].tolist()
        z = z_function(ahead)
        multiple = np.zeros(2 * length, bool)
        found = []
        for p in range(1, min(2 * length, len(z))):
            if multiple[p] or z[p] < (length if p >= length else p):
                continue
            # The prefix is periodic with p up to p + z[p]: multiples inside are no smallest periods.
            multiple[2 * p : p + z[p] + 1 : p] = True
            if p >= length:
                found.append(p)
        if not found:
            continue
        # Backwards: the words before the boundary against those before boundary + period.
        behind = codes[max(0, b - length) : b][::-1].tolist()
        far = codes[max(0, b - length) : b + found[-1]][::-1].tolist()
        back = z_function([*behind, -1, *far])
        for p in found:
            reach = min(back[len(behind) + 1 + found[-1] - p], length)
            first, end = b - reach, b + min(z[p], 2 * length)
            if p in open_ and open_[p][1] >= first:
                open_[p] = (open_[p][0], end)
            else:
                if p in open_:
                    out.append((p, *open_[p]))
                open_[p] = (first, end)
    return out + [(p, *x) for p, x in open_.items()]


def solve(tiles: DataFrame) -> DataFrame:
    """``(node, period, first, end)`` of every fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, found = [], []
            for i in range(batch.num_rows):
                node, octave, first, codes, marks = (batch.column(k)[i] for k in range(5))
                mine = fragments(np.asarray(codes.values), np.asarray(marks.values), octave.as_py())
                place.extend([i] * len(mine))
                found.extend((p, first.as_py() + a, first.as_py() + b) for p, a, b in mine)
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], ["node", "period", "first", "end"])

    return tiles.select("node", "octave", "first", "codes", "marks").mapInArrow(run, "node binary, period long, first long, end long")


def stitch(found: DataFrame) -> DataFrame:
    """Runs ``(node, start, length, period)``: fragments of a document and period joined where they touch."""
    order = Window.partitionBy("node", "period").orderBy("first", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = found.withColumn("new", F.when(F.col("first") <= before, 0).otherwise(1))
    part = new.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = part.groupBy("node", "period", "part").agg(F.min("first").alias("start"), (F.max("end") - F.min("first") + F.col("period")).alias("length"))
    return joined.filter((F.col("length") >= POWER * F.col("period")) & (F.col("length") >= LEAST)).select("node", "start", "length", "period")


def _collapse(texts: DataFrame) -> DataFrame:
    """``texts`` with ``collapsed_sha256`` in place of the last three columns ``h, runs, text``: the words without the repeats in the runs."""
    keep = texts.columns[:-3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, found, text = batch.columns[-3:]
            for t in slices(text):
                h = np.asarray(hashes.slice(t.row, len(t)))
                order, digests = word_order(t, h), []
                for d in range(len(t)):
                    runs = found[t.row + d].values
                    start, length, period = (np.asarray(runs.field(k)) for k in ("start", "length", "period"))
                    step = np.zeros(t.counts[d] + 1, np.int64)
                    np.add.at(step, start + period, 1)
                    np.add.at(step, start + length, -1)
                    digests.append(_digest(_joined(t, order, d, np.cumsum(step)[:-1] == 0)))
                yield pa.RecordBatch.from_arrays([*[c.slice(t.row, len(t)) for c in batch.columns[:-3]], pa.array(digests, pa.string())], [*keep, "collapsed_sha256"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in texts.schema[:-3]]
    return texts.mapInArrow(run, ", ".join([*kinds, "collapsed_sha256 string"]))


def runs(docs: DataFrame, far: int = FAR) -> tuple[DataFrame, DataFrame]:
    """A row per document (``doc_id``, ``node``, ``n_words``, ``whole`` and, with tiles, ``text``), and all runs by ``node``."""
    text, decimal = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("string")
    name = F.concat(F.when(decimal.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), decimal)), F.lit("\n"), text)
    texts = docs.select(
        "doc_id", F.unhex(F.md5(name.cast("binary"))).alias("node"),
        F.crc32(F.coalesce(decimal, F.lit("")).cast("binary")).alias("h"), text.alias("text"),
    )
    seen = written(survey(texts, far), "tiles")
    tiles = seen.filter("octave > 0").select("node", "octave", "first", "codes", "marks")
    # Dealt by tile and not by document: a long document is solved by many tasks.
    near = seen.filter("octave = 0").select("node", F.inline("found"))
    found = near.unionByName(solve(tiles.repartition("node", "octave", "first")))
    return seen.filter("octave = 0").select("doc_id", "node", "n_words", "whole", "text"), stitch(found.distinct())


def report(docs: DataFrame, far: int = FAR) -> DataFrame:
    """Per document: number of runs, the longest one, and digests of the run list and of the words without repeats."""
    heads, found = runs(docs, far)
    one = F.struct("start", "length", "period")
    longest = F.struct("length", (-F.col("start")).alias("start"), (-F.col("period")).alias("period"))
    lists = found.groupBy("node").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.max(longest).alias("longest"),
        F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("sorted"),
        F.collect_list(one).alias("runs"),
    )
    lists = written(lists, "runs")
    line = F.transform("sorted", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = F.sha2(F.concat(F.array_join(line, "\n"), F.lit("\n")).cast("binary"), 256)
    ids = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h")
    none = F.lit(None).cast("long")
    # Texts without any fragment are done; the others meet their runs, and are shuffled only here.
    quiet = heads.filter("text IS NULL").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"), none.alias("period"),
        F.lit(_digest(b"")).alias("runs_sha256"), F.col("whole").alias("collapsed_sha256"),
    )
    found = heads.filter("text IS NOT NULL").join(lists, "node", "left").select(
        "doc_id", F.coalesce("n_runs", F.lit(0).cast("long")).alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"), F.coalesce(digest, F.lit(_digest(b""))).alias("runs_sha256"), ids, F.coalesce("runs", F.array().cast(lists.schema["runs"].dataType)).alias("runs"), "text",
    )
    exponent = F.call_function("div", F.col("length") * 1000, F.col("period")).alias("exponent_milli")
    return quiet.unionByName(_collapse(found)).select("doc_id", "n_runs", "start", "length", "period", exponent, "runs_sha256", "collapsed_sha256")
