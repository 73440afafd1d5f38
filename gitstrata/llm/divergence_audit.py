"""How far the sources of a language differ in their words, by single-pass in-memory indexing.

* A task adds its documents to a block of postings ``(lang, term, source, occurrences, documents)`` until the
  block holds ``BLOCK`` bytes, then writes it as a run sorted by term. A run is cut by hash shard and into
  chunks of at most ``CHUNK`` postings, one row each.
* Spark brings the chunks of a shard together in the order of their first term. A task merges them with a heap of open
  chunks, block by block, and keeps the terms of enough documents with their count in each source. What it
  holds is about ``MERGED`` postings, or twice what is left of one chunk per run and shard if that is more.
* Values of pairs of sources begin with the value as if no term occurred. The rest are corrections streamed over the
  frequencies: one per source and count, and one per pair of sources and counts that share a term.
  Equal corrections are counted before they are worked out, so the work follows the postings and not terms x sources x sources.

All arithmetic is on whole numbers (longs, decimals of 38 digits where products could be larger).

Defined cases: NULL text, lang and source count as ''; a row without id or with a repeated one is a
document of its own; a group without terms has its row in every pair and no ``term`` rows; a language that keeps no
term has value 0 in its pairs; a language with one source has no pairs; an empty table gives no rows. Only the three
columns are read, so further columns are without effect.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.functions.common import top_n_per_key
from gitstrata.llm.store import written
from gitstrata.llm.words import Texts, lists, slices

BLOCK, CHUNK, SHARDS, MERGED = 64 << 20, 512, 1024, 1 << 16
LEAST_DOCUMENTS, TOP, UNIT = 3, 200, 1_000_000_000
SALTS = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEYS = ["lang", "term", "source"]


def terms(t: Texts) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Text number and value of every term, for texts in small letters."""
    full = _LETTER[t.data]
    before = np.zeros(len(full), bool)
    before[1:] = full[:-1]
    cut = t.bounds[:-1]
    before[cut[cut < len(full)]] = False
    starts = np.flatnonzero(full & ~before)
    letters = np.ascontiguousarray(t.data[full])
    offsets = np.append((np.cumsum(full) - 1)[starts], len(letters)).astype(np.int64)
    values = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    return np.searchsorted(t.bounds, starts, "right") - 1, values.dictionary_encode()


def _postings(t: Texts, lang: pa.Array, source: pa.Array) -> pa.Table:
    """Occurrences and documents per group and term of one slice."""
    doc, coded = terms(t)
    code, size = np.asarray(coded.indices).astype(np.int64), max(len(coded.dictionary), 1)
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    n_sources = max(len(sources.dictionary), 1)
    group = np.asarray(langs.indices).astype(np.int64) * n_sources + np.asarray(sources.indices)
    per_doc, times = np.unique(doc * size + code, return_counts=True)
    key, place = np.unique(group[per_doc // size] * size + per_doc % size, return_inverse=True)
    group = key // size
    return pa.table({
        "lang": langs.dictionary.take(pa.array(group // n_sources)),
        "term": coded.dictionary.take(pa.array(key % size)),
        "source": sources.dictionary.take(pa.array(group % n_sources)),
        "count": pa.array(np.bincount(place, times, minlength=len(key)).astype(np.int64)),
        "docs": pa.array(np.bincount(place, minlength=len(key)).astype(np.int64)),
    })


def _prints(column: pa.ChunkedArray) -> np.ndarray:
    """A hash of every value of a text column."""
    values = column.combine_chunks()
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    _, offsets, data = values.cast(pa.large_string()).buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    low = offsets[0] if len(offsets) else 0
    data, offsets = data[low : offsets[-1]], offsets - low
    return Texts(data, offsets, 0).prints(offsets[:-1], offsets[1:])


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """The place of each value of a text column among its distinct values, in the order of their bytes."""
    coded = column.combine_chunks().dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[np.asarray(pc.sort_indices(coded.dictionary))] = np.arange(len(rank))
    return rank[np.asarray(coded.indices)]


def _run(block: pa.Table, most: int, shards: int) -> Iterator[pa.RecordBatch]:
    """A block as a run: chunks of at most ``most`` postings sorted by term within their language and shard."""
    lang, term, source = (_ranks(block[k]) for k in _KEYS)
    # The hashes are made in parts: a part of the block is all they hold at a time.
    shard = np.concatenate([_prints(part["term"]) ^ (_prints(part["lang"]) * _ODD) for part in (block.slice(i, 1 << 16) for i in range(0, len(block), 1 << 16))])
    shard = ((shard * _ODD) >> np.uint64(40)).astype(np.int64) % shards
    key = lang * shards + shard
    order = np.lexsort((source, term, key))
    block, key, shard = block.take(pa.array(order)).combine_chunks(), key[order], shard[order]
    place = np.arange(len(key))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    new |= (place - np.repeat(first, np.diff(np.append(first, len(key))))) % most == 0
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(key)))
    for low in range(0, len(first), 1 << 10):
        at, size = first[low : low + (1 << 10)], sizes[low : low + (1 << 10)]
        part = block.slice(at[0], int(size.sum()))
        inside = pa.array(at - at[0])
        value = {c: pa.concat_arrays(part[c].chunks) for c in part.column_names}
        yield pa.RecordBatch.from_arrays(
            [value["lang"].take(inside).cast(pa.string()), pa.array(shard[at].astype(np.int32)), value["term"].take(inside).cast(pa.string()),
             *[lists(value[c].cast(pa.string()), size) for c in ("term", "source")], *[lists(value[c], size) for c in ("count", "docs")]],
            ["lang", "shard", "first", "terms", "sources", "counts", "docs"],
        )


def index_runs(docs: DataFrame, block_bytes: int = BLOCK, chunk: int = CHUNK, shards: int = SHARDS) -> DataFrame:
    """Term-sorted runs of postings, a row per chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for batch in batches:
            lang, source = (batch.column(i).cast(pa.large_string()) for i in (1, 2))
            for t in slices(batch.column(0), lower=True):
                part = _postings(t, lang.slice(t.row, len(t)), source.slice(t.row, len(t)))
                block.append(part)
                held += part.nbytes
                if held > block_bytes:
                    block = [_folded(block)]
                    held = block[0].nbytes
                    if held * 2 > block_bytes:
                        yield from _run(block[0], chunk, shards)
                        block, held = [], 0
        if block:
            yield from _run(_folded(block), chunk, shards)

    rows = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    return rows.mapInArrow(run, "lang string, shard int, first string, terms array<string>, sources array<string>, counts array<long>, docs array<long>")


def _folded(block: list[pa.Table]) -> pa.Table:
    """The postings of a block with equal keys added up."""
    out = pa.concat_tables(block).group_by(_KEYS, use_threads=False).aggregate([("count", "sum"), ("docs", "sum")])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names])


def merged(chunks: Iterable[tuple[str, str, pa.Table]], most: int = MERGED) -> Iterator[tuple[str, pa.Table]]:
    """Blocks ``(lang, postings)`` with all postings of their terms, from chunks ``(lang, first term, postings)`` sorted by these.

    A heap holds the open chunks by their next term. When ``most`` postings are open, and twice as many as were left the last time,
    those below the next chunk's first term are complete: they leave the heap, and what is left of their chunks returns to it.
    """
    heap: list[tuple[str, int, pa.Table]] = []
    held = n = 0
    limit, now = most, None

    def below(bound: str | None) -> list[pa.Table]:
        out, back = [], []
        while heap and (bound is None or heap[0][0] < bound):
            _, k, rows = heapq.heappop(heap)
            cut = len(rows) if bound is None else pc.sum(pc.less(rows["term"], bound)).as_py()
            out.append(rows.slice(0, cut))
            if cut < len(rows):
                back.append((rows["term"][cut].as_py(), k, rows.slice(cut)))
        for entry in back:
            heapq.heappush(heap, entry)
        return out

    for lang, first, rows in chunks:
        if heap and (lang != now or held >= limit):
            part = below(first if lang == now else None)
            if part:
                yield now, pa.concat_tables(part)
            held = sum(len(x[2]) for x in heap)
            limit = max(most, 2 * held)
        now = lang
        heapq.heappush(heap, (first, n, rows))
        held += len(rows)
        n += 1
    if heap:
        yield now, pa.concat_tables(below(None))


def kept(lang: str, postings: pa.Table, least: int) -> pa.RecordBatch:
    """``(lang, term, total, postings)`` of the terms of a block that occur in at least ``least`` documents."""
    sums = postings.group_by(["term", "source"], use_threads=False).aggregate([("count", "sum"), ("docs", "sum")])
    whole = sums.group_by("term", use_threads=False).aggregate([("docs_sum", "sum")])
    wanted = whole.filter(pc.greater_equal(whole["docs_sum_sum"], least))["term"]
    sums = sums.filter(pc.is_in(sums["term"], value_set=wanted.combine_chunks())).combine_chunks()
    term, source = _ranks(sums["term"]), _ranks(sums["source"])
    order = np.lexsort((source, term))
    sums, term = sums.take(pa.array(order)).combine_chunks(), term[order]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    count = np.asarray(sums["count_sum"])
    pairs = pa.StructArray.from_arrays([_plain(sums["source"]), _plain(sums["count_sum"])], ["source", "count"])
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(first), pa.string()), _plain(sums["term"]).take(pa.array(first)), pa.array(np.add.reduceat(count, first) if len(first) else count),
         lists(pairs, np.diff(np.append(first, len(term))))],
        ["lang", "term", "total", "postings"],
    )


def _plain(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def frequencies(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The kept terms of each language: ``total`` occurrences and a list of ``(source, count)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in merged(chunk for batch in batches for chunk in opened(batch)):
            out = kept(lang, block, least)
            if out.num_rows:
                yield out

    def opened(batch: pa.RecordBatch) -> Iterator[tuple[str, str, pa.Table]]:
        sides = [batch.column(i) for i in range(2, 6)]
        bounds, values = np.asarray(sides[0].offsets), [side.values for side in sides]
        rows = pa.table(values, ["term", "source", "count", "docs"])
        langs, firsts = (batch.column(i).to_pylist() for i in (0, 1))
        for i in range(batch.num_rows):
            yield langs[i], firsts[i], rows.slice(bounds[i], bounds[i + 1] - bounds[i])

    runs = index_runs(docs).repartition("lang", "shard").sortWithinPartitions("lang", "first").drop("shard")
    return runs.mapInArrow(run, "lang string, term string, total long, postings array<struct<source:string,count:bigint>>")


def share(count: Column, n: Column, v: Column) -> Column:
    """A smoothed share in units of one thousand millionth, at least 1; NULL where there are no terms."""
    whole = (F.lit(UNIT).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + 1)).cast("decimal(38,0)")
    return F.when(v > 0, F.call_function("div", whole, (n + v).cast("decimal(38,0)")) + 1)


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``; both are at most 1,000,000,001, so a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """Rows ``(lang, source, part, item, value, rank)``: distances between sources, and the terms a source is fond of."""
    found = written(frequencies(docs, least), "frequencies")
    zero = F.lit(0).cast("long")
    seen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = found.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    single = found.select("lang", "term", "total", F.explode("postings").alias("p")).select("lang", "term", "total", "p.source", "p.count")
    sums = single.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = seen.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"), F.coalesce("lang_n", zero).alias("lang_n")), "groups")
    pairs = _pairs(found, single, groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    liked = single.join(groups, ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"),
    ).filter("p > q").select("lang", "source", "part", "item", distance(F.col("p"), F.col("q")).alias("value"))
    liked = top_n_per_key(liked, ["lang", "source"], [F.desc("value"), F.col("item")], top, rank="rank")
    return pairs.unionByName(liked.select(*pairs.columns))


def _pairs(found: DataFrame, single: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every two sources of a language, by the base value and its corrections."""
    wide, zero = "decimal(38,0)", F.lit(0).cast("long")
    known = groups.select("lang", "source", "n", "v", share(F.lit(0), F.col("n"), F.col("v")).alias("none"))
    salt = F.pmod(F.xxhash64("source"), F.lit(SALTS))
    # Every other source of the language, over SALTS tasks per language.
    others = known.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"), salt.alias("salt"))
    salted = F.explode(F.sequence(zero, F.lit(SALTS - 1).cast("long"))).alias("salt")

    def with_others(rows: DataFrame) -> DataFrame:
        return rows.select("*", salted).join(others, ["lang", "salt"]).filter("source <> item")

    base = with_others(known).select("lang", "source", "item", F.when(F.col("v") > 0, distance(F.col("none"), F.col("item_none")).cast(wide) * F.col("v")).otherwise(0).cast(wide).alias("value"))
    alike = single.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("terms")).join(known, ["lang", "source"])
    alike = with_others(alike.withColumn("p", share(F.col("count"), F.col("n"), F.col("v"))))
    p, none, other = F.col("p"), F.col("none"), F.col("item_none")
    at = ((distance(p, other) - distance(none, other)).cast(wide) * F.col("terms")).cast(wide)
    of = ((distance(other, p) - distance(other, none)).cast(wide) * F.col("terms")).cast(wide)
    ones = alike.select("lang", F.explode(F.array(F.struct("source", "item", at.alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), of.alias("value")))).alias("x"))
    # Sources that share a term: counted by their pair of counts before anything is worked out.
    left = found.select("lang", F.posexplode("postings").alias("i", "a"), "postings")
    both = left.select("lang", "a", F.explode(F.slice("postings", F.col("i") + 2, F.greatest(F.size("postings") - F.col("i") - 1, F.lit(0)))).alias("b"))
    both = both.groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.col("a.count").alias("ca"), F.col("b.count").alias("cb")).agg(F.count(F.lit(1)).alias("terms"))
    mine = known.select("lang", "source", "n", "v", F.col("none").alias("p0"))
    theirs = known.select("lang", F.col("source").alias("item"), F.col("n").alias("item_n"), F.col("none").alias("q0"))
    both = both.join(mine, ["lang", "source"]).join(theirs, ["lang", "item"])
    both = both.withColumns({"p": share(F.col("ca"), F.col("n"), F.col("v")), "q": share(F.col("cb"), F.col("item_n"), F.col("v"))})

    def correction(p: str, q: str, p0: str, q0: str) -> Column:
        p, q, p0, q0 = F.col(p), F.col(q), F.col(p0), F.col(q0)
        change = distance(p, q).cast(wide) - distance(p, q0) - distance(p0, q) + distance(p0, q0)
        return F.sum((change.cast(wide) * F.col("terms")).cast(wide)).cast(wide)

    sums = both.groupBy("lang", "source", "item").agg(correction("p", "q", "p0", "q0").alias("there"), correction("q", "p", "q0", "p0").alias("back"))
    twos = sums.select("lang", F.explode(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))).alias("x"))
    parts = base.unionByName(ones.select("lang", "x.*")).unionByName(twos.select("lang", "x.*"))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
