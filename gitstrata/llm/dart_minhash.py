"""Near-duplicate documents by DartMinHash signatures and banded joining.

A signature has ``K`` coordinates. Every element of a weighted set owns the region
``[0, weight) x [0, infinity)`` of weight and rank; darts fall into it at one per unit
of area, at places that depend on the element alone. Rank is cut into bands of doubling
height and weight into bands of doubling width; each cell's hash gives its number of
darts (Poisson), each dart's hash its coordinate and place. Bands are worked off from
low rank upwards until every coordinate has a dart; the lowest dart of a coordinate is
kept. Two signatures agree per coordinate with the probability of the sets' weighted
Jaccard similarity; the cost hardly depends on the weights.

Documents are sets of five-word runs (all words, for shorter texts) of weight one, or their
counts with ``weighted=True``. Equal texts share one node and are never compared. Nodes
that share a band of ``ROWS`` coordinates meet in a bucket; there each is compared with
three central members only, so a bucket of any size gives a linear number of pairs. Where
a bucket still holds several groups, its nodes go through an exact join on their rarest elements
(two similar sets share one of these; common passages are not among them), where sizes, places and
sketches rule pairs out. All links are decided by the exact similarity.

Defined cases: equal texts, empty ones too, always form a class; a NULL text is an empty
text; texts without a word have no near copies; rows without id follow the class of
their text and name it only by ids of others (NULL if none); repeated rows stay, each
with its class; a text's class id is the smallest id in the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitstrata.llm.store import free, written
from gitstrata.llm.words import Texts, lists, mix, signed, slices

K, ROWS, SHINGLE, SIMILARITY = 128, 4, 5, 0.8
#: Lowest rank band: [0, 2**-LOW).
LOW = 8
#: Sketches hold two bits per coordinate; at similarity 0.8 about 26 of 256 bits differ, with a deviation under 6.
SKETCH_LIMIT = 62
_ODD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _salt(*parts: int) -> np.uint64:
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = mix(x + np.uint64((p + 1) * int(_ODD) % 2**64))
    return x[0]


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(mean: float) -> np.ndarray:
    """Cumulated probabilities, up to a negligible rest."""
    top = int(mean + 12 * np.sqrt(mean) + 20)
    logs = np.cumsum(np.log(np.arange(1, top + 1)))
    p = np.exp(-mean + np.arange(top + 1) * np.log(mean) - np.concatenate([[0.0], logs]))
    return np.cumsum(p)


def signatures(item: np.ndarray, weight: np.ndarray | None, owner: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """``n`` signatures of ``k`` darts each; items are sorted by owner, repeated items count once per weight unit.

    ``weight=None`` is weight one. Owners without items keep the empty mark in all places.
    """
    out = np.full(n * k, _EMPTY, np.uint64)
    has = np.bincount(owner, minlength=n) > 0
    active = np.flatnonzero(has[owner])
    band = 0
    while len(active):
        low = 0.0 if band == 0 else 2.0 ** (band - 1 - LOW)
        high = 2.0 ** (band - LOW)
        widest = 0 if weight is None else int(np.log2(weight[active].max() + 1))
        for wide in range(widest + 1):
            left, width = 2.0**wide - 1, 2.0**wide
            at = active if weight is None else active[weight[active] > left]
            cell = mix(item[at] ^ _salt(wide, band))
            table = _poisson(width * (high - low))
            u = _unit(cell)
            some = np.flatnonzero(u >= table[0])
            darts = np.searchsorted(table, u[some], "right")
            cell, at = np.repeat(cell[some], darts), np.repeat(at[some], darts)
            nth = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mix(cell + (nth + 1).astype(np.uint64) * _ODD)
            if weight is not None:
                inside = left + width * _unit(mix(dart ^ _salt(1))) < weight[at]
                dart, at = dart[inside], at[inside]
            rank = (low + (high - low) * _unit(mix(dart ^ _salt(2)))).astype(np.float32)
            packed = (rank.view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart >> np.uint64(32))
            np.minimum.at(out, owner[at] * k + (dart % np.uint64(k)).astype(np.int64), packed)
        filled = (out.reshape(n, k) != _EMPTY).all(1)
        active = active[~filled[owner[active]]]
        band += 1
    return out.reshape(n, k)


def shingles(t: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the texts they are in; a shorter text is one run."""
    at, h = t.windows(size)
    short = np.flatnonzero((t.counts > 0) & (t.counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            for w in t.words[t.first[d] : t.first[d + 1]]:
                whole[i : i + 1] = mix(whole[i : i + 1] + w)
        owner = np.concatenate([t.doc[at], short])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([h, whole])[order], owner[order]
    return h, t.doc[at]


def counted(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct items per owner with their counts."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return h[at], owner[at], np.diff(np.append(at, len(h)))


def _signed_nodes(texts: DataFrame, weighted: bool) -> DataFrame:
    """``(node, doc_id, keys, s0..s3)``: band keys and sketch of every text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(2)):
                h, owner = shingles(t)
                weight = None
                if weighted:
                    h, owner, weight = counted(h, owner)
                sig = signatures(h, weight, owner, len(t))
                rows = np.flatnonzero(t.counts > 0)
                sig = sig[rows]
                part = sig.reshape(len(rows), K // ROWS, ROWS)
                key = np.zeros(part.shape[:2], np.uint64) + np.arange(K // ROWS, dtype=np.uint64)
                for i in range(ROWS):
                    key = mix(key + part[:, :, i])
                m = mix(sig)
                bits = np.concatenate([(m >> np.uint64(s)) & np.uint64(1) for s in (17, 43)], 1).astype(np.uint8)
                sketch = np.packbits(bits, axis=1).view(np.int64).reshape(len(rows), 4)
                take = pa.array(rows + t.row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take),
                     lists(signed(key.ravel()), np.full(len(rows), K // ROWS)), *[pa.array(sketch[:, i].copy()) for i in range(4)]],
                    ["node", "doc_id", "keys", "s0", "s1", "s2", "s3"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"node binary, doc_id {kind}, keys array<long>, s0 long, s1 long, s2 long, s3 long"
    made = texts.select("node", "doc_id", "text").mapInArrow(run, schema)
    rest = ["keys", "s0", "s1", "s2", "s3"]
    return made.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in rest])


def _sets(texts: DataFrame, wanted: DataFrame, weighted: bool) -> DataFrame:
    """``(node, items)``: the sorted run hashes of the wanted nodes; a repeat is made distinct when weighted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(1)):
                h, owner, n = counted(*shingles(t))
                if weighted:
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    h, owner = mix(np.repeat(h, n) + nth.astype(np.uint64) * _ODD), np.repeat(owner, n)
                items = lists(signed(h), np.bincount(owner, minlength=len(t)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.row, len(t)), items], ["node", "items"])

    one = texts.join(wanted.withColumnRenamed("doc_id", "first_id"), "node").filter(F.col("doc_id").eqNullSafe(F.col("first_id")))
    return one.select("node", "text").dropDuplicates(["node"]).mapInArrow(run, "node binary, items array<long>")


def _close(a: str, b: str):
    """The sketches allow the asked similarity."""
    return sum(F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(4)) <= SKETCH_LIMIT


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have at least the asked Jaccard similarity."""
    a, b = sets.toDF("a", "a_items"), sets.toDF("b", "b_items")
    both = F.size(F.array_intersect("a_items", "b_items")).cast("double")
    either = F.size("a_items") + F.size("b_items") - both
    return pairs.join(a, "a").join(b, "b").filter(both >= similarity * either - 1e-9).select("a", "b")


def _rarest(sets: DataFrame, similarity: float) -> DataFrame:
    """``(node, item, left)``: the rarest items of each set, and how many of its items are not rarer.

    All sets are ordered alike, by rarity among ``sets(node, items)``. Of two sets of at least the
    asked similarity, the first item in common is among these of both.
    """
    items = sets.select("node", F.explode("items").alias("item"))
    df = items.groupBy("item").agg(F.count("node").alias("df"))
    entry = F.struct("df", "item")
    ordered = items.join(df, "item").groupBy("node").agg(F.array_sort(F.collect_list(entry)).alias("o"))
    n = F.size("o")
    head = F.slice("o", F.lit(1), (n - F.ceil(similarity * n - 1e-9) + 1).cast("int"))
    out = ordered.select("node", n.alias("size"), F.posexplode(head).alias("at", "e")).filter("e.df > 1")
    return out.select("node", F.col("e.item").alias("item"), (F.col("size") - F.col("at")).alias("left"))


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: the smallest node of its component.

    Large-star and small-star steps in turn until nothing changes; each step is a
    grouped minimum and a join, and its links are written out.
    """
    def star(both: DataFrame, large: bool) -> DataFrame:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        near = both.filter(F.col("b") > F.col("a") if large else F.col("b") <= F.col("a"))
        moved = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
        return moved.filter(F.col("a") != F.col("b")).distinct()

    def mark(edges: DataFrame):
        return edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = written(star(both, True), "links")
        edges = written(star(edges, False), "links")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    rooted = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rooted.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(node, root)`` for texts with near copies, and ``docs`` as ``(doc_id, text, node)``."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("node"))
    nodes = written(_signed_nodes(texts, weighted), "signatures")
    entries = nodes.select("node", F.explode("keys").alias("key"))
    shared = written(entries.groupBy("key").agg(F.count("node").alias("size")).filter("size > 1"), "bands")
    members = entries.join(shared, "key")
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    # Only nodes that meet another one go on.
    met = written(nodes.join(degree, "node"), "met")
    look = F.struct("node", "s0", "s1", "s2", "s3")
    members = written(members.select("node", "key").join(met, "node").select("key", "degree", look.alias("m")), "members")
    node = F.col("m.node")
    pivots = members.groupBy("key").agg(
        F.array(F.max_by("m", F.struct("degree", node)), F.max_by("m", F.xxhash64(node)), F.min("m")).alias("p")
    )
    met_pairs = members.join(pivots, "key").select("m", F.explode(F.array_distinct("p")).alias("p"))
    found = met_pairs.filter((node != F.col("p.node")) & _close("m", "p"))
    first = written(found.select(F.least(node, F.col("p.node")).alias("a"), F.greatest(node, F.col("p.node")).alias("b")).distinct(), "pairs")
    sets = written(_sets(texts, met.select("node", "doc_id"), weighted), "sets")
    links = written(_linked(first, sets, similarity), "similar")
    roots = components(links)
    # Buckets that hold more than one group: what else may be similar there?
    placed = members.join(roots.withColumnRenamed("node", "n"), node == F.col("n"), "left").select(
        "key", "m", F.coalesce("root", node).alias("root")
    )
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
    open_nodes = written(placed.join(mixed, "key"), "mixed")
    sized = sets.join(open_nodes.groupBy(node.alias("node")).agg(F.min("root").alias("root"), F.first("m").alias("m")), "node")
    rare = _rarest(sized.select("node", "items"), similarity).join(sized.select("node", "root", "m", F.size("items").alias("n")), "node")
    rare = written(rare, "rarest")
    several = rare.groupBy("item").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("item")
    rest = rare.join(several, "item").select("item", "root", "n", "left", "m")
    x, y = rest.alias("x"), rest.alias("y")
    # What two sets share lies at or after the shared item in both orders.
    most = F.least(F.col("x.left"), F.col("y.left"))
    possible = most >= similarity * (F.col("x.n") + F.col("y.n") - most) - 1e-9
    second = x.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("x.root") < F.col("y.root")) & possible & _close("x.m", "y.m"))
    second = written(second.select(F.col("x.m.node").alias("a"), F.col("y.m.node").alias("b")).distinct(), "pairs")
    more = written(_linked(second, sets, similarity), "similar")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    return roots, texts


def report(docs: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """One row per document: its class (smallest id in it), the documents in the class, and whether it is the one to keep.

    Of rows that repeat the class id, the first in a fixed order counts as kept by :func:`keep`.
    """
    roots, texts = classes(docs.select("doc_id", "text"), similarity, weighted)
    rooted = texts.select("doc_id", "node").join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    sized = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rooted.join(sized, "root").select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` per class, the one with the smallest id (ties: the smallest whole row), columns as they were.

    Every row that has no id but a text of its own stays.
    """
    roots, _ = classes(docs.select("doc_id", "text"), similarity)
    node = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    row = F.md5(F.to_json(F.struct("*")))
    narrow = docs.select("doc_id", node.alias("node"), row.alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    rooted = narrow.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("class")).agg(first.alias("first"))
    own = free(docs.columns, "keep_this_row")
    chosen = rooted.select(F.col("first.row").alias(own))
    # Rows equal in every column differ by nothing; one of them stays.
    return docs.withColumn(own, row).join(chosen, own).dropDuplicates([own]).select(*[f"`{c}`" for c in docs.columns])
