"""Many-to-many nearest neighbours: an inverted file of cells, searched with bounds that lose nothing.

Vectors are brought to length one, so the cosine of two of them falls as their distance grows. Centroids come from
k-means on a bounded sample (about ``SAMPLE`` rows on the driver; it decides the speed, never the answer). Every stored vector belongs to its
nearest centroid, and a cell's vectors are cut by their distance to it into rings of about ``RING`` rows.
A vector at distance ``r`` from a centroid that is ``d`` away from a query is at least ``|d - r|`` away from the query.

The search has two rounds. The first looks into the rings nearest to each query until it has ``k`` vectors; their
worst distance bounds the answer. The second looks into all rings that the bound does not rule out. A
task compares one ring with the queries that need it, in blocks, and returns the best ``k`` of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.functions.common import top_n_per_key
from gitstrata.session import written

CELLS, SAMPLE, RING, ROUNDS = 64, 20_000, 4096, 8
QUERIES, BLOCK, FIRST_CELLS = 16_384, 1024, 4
SLACK = 1e-6
DIGITS = 12


def centroids(vectors: DataFrame, id: str, embedding: str, cells: int = CELLS) -> np.ndarray:
    """At most ``cells`` centroids of at most about ``SAMPLE`` vectors, picked by a hash of their id."""
    total = vectors.count()
    some = vectors.filter(F.pmod(F.xxhash64(id), F.lit(max(1, total // SAMPLE))) == 0).limit(2 * SAMPLE).select(embedding).toArrow()
    points = _matrix(some.column(0))
    k = min(cells, len(points) // 32)
    if k < 2:
        return np.zeros((1, 1))
    centers = points[np.random.default_rng(11).choice(len(points), k, replace=False)]
    for _ in range(ROUNDS):
        nearest = distances(points, centers).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        full = np.bincount(nearest, minlength=k)[:, None]
        centers = np.where(full > 0, sums / np.maximum(full, 1), centers)
    return centers


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, each of length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    flat = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def usable(embedding: str) -> Column:
    """A vector that has a direction: not NULL, no NULL inside, not all zero."""
    v = F.col(embedding)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distance of each point from each center."""
    if centers.shape[1] != points.shape[1]:
        centers = np.zeros((len(centers), points.shape[1]))
    square = (points * points).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2 * points @ centers.T
    return np.sqrt(np.maximum(square, 0))


def index(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", cells: int = CELLS, ring: int = RING) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """All usable vectors with ``cell``, ``ring`` and distance ``r``; one row per ring with its bounds; the centroids."""
    rows = vectors.filter(usable(embedding)).select(F.col(id).alias("id"), F.col(embedding).alias("v"))
    centers = centroids(rows, "id", "v", cells)

    def assign(batches):
        for batch in batches:
            far = distances(_matrix(batch.column(1)), centers) if batch.num_rows else np.zeros((0, 1))
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], ["id", "v", "cell", "r"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    near = written(rows.mapInArrow(assign, f"id {kinds['id']}, v {kinds['v']}, cell int, r double"), "vector-cells")
    # Edges of the rings: quantiles of the distance, as many as the cell's rows ask for.
    edges = near.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("r", [i / 256 for i in range(1, 256)], 10_000).alias("q"))
    steps = F.least(F.lit(256), F.ceil(F.col("n") / ring)).cast("int")
    edges = edges.select("cell", F.transform(F.sequence(F.lit(1), F.greatest(steps - 1, F.lit(1))), lambda i: F.get("q", F.floor(i * 256 / steps).cast("int") - 1)).alias("edges"), steps.alias("steps"))
    # Beyond 256 rings a ring is dealt over more parts by id, so no part grows with the corpus.
    parts = near.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(ring * 256))).cast("int").alias("parts"))
    ringed = near.join(edges.join(parts, "cell"), "cell")
    place = F.when(F.col("steps") == 1, 0).otherwise(F.size(F.filter("edges", lambda e: e < F.col("r"))))
    ringed = ringed.select("id", "v", "cell", place.alias("ring"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "r")
    bounds = ringed.groupBy("cell", "ring", "part").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
    return ringed, written(bounds, "vector-rings"), centers


def _search(stored: DataFrame, probes: DataFrame, k: int, id_type: str, query_type: str, groups: int) -> DataFrame:
    """``(query, id, similarity)``: the best ``k`` of each ring for each query that probes it."""

    def compare(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out_query, out_id, out_value = [], [], []
        if rows.num_rows and asked.num_rows:
            order = np.lexsort((np.asarray(rows["id"]),))
            rows = rows.take(pa.array(order))
            points, ids = _matrix(rows["v"]), rows["id"].combine_chunks()
            for low in range(0, asked.num_rows, BLOCK):
                part = asked.slice(low, BLOCK)
                value = np.round(_matrix(part["v"]) @ points.T, DIGITS)
                mine = part["query"].combine_chunks()
                # A query does not find itself.
                same = np.asarray(mine)[:, None] == np.asarray(ids)[None, :]
                value[same] = -np.inf
                best = np.argsort(-value, axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(value, best, 1)
                q, j = np.nonzero(found > -np.inf)
                out_query.append(mine.take(pa.array(q)))
                out_id.append(ids.take(pa.array(best[q, j])))
                out_value.append(pa.array(found[q, j]))
        kinds = {"query": asked.schema.field("query").type, "id": rows.schema.field("id").type, "similarity": pa.float64()}
        return pa.table({c: pa.chunked_array(x, kinds[c]) for c, x in zip(kinds, (out_query, out_id, out_value), strict=True)})

    keys = ["cell", "ring", "part", "team"]
    left = stored.withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    left = left.select(*keys, "id", "v")
    right = probes.select(*keys, "query", "v")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, f"query {query_type}, id {id_type}, similarity double")


def _gap() -> Column:
    """Least distance that a vector of a ring can have from a query at distance ``d`` from its cell."""
    return F.greatest(F.col("d") - F.col("high"), F.col("low") - F.col("d"), F.lit(0.0))


def similar_many(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", embedding: str = "embedding", cells: int = CELLS, ring: int = RING
) -> DataFrame:
    """The ``k`` stored vectors nearest to each query by cosine: ``query, id, similarity, position``.

    Exact: similarities are rounded to 12 digits, ties go to the smaller id, and a query does not find the row with its own id. Vectors
    without a direction (NULL, with NULL inside, all zero) are neither found nor asked for.
    """
    stored, rings, centers = index(vectors, id, embedding, cells, ring)
    asked = queries.filter(usable(embedding)).select(F.col(id).alias("query"), F.col(embedding).alias("v"))
    groups = max(1, -(-asked.count() // QUERIES))

    def far(batches):
        for batch in batches:
            table = distances(_matrix(batch.column(1)), centers) if batch.num_rows else np.zeros((0, len(centers)))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), len(centers)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["query", "v", "far"])

    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    asked = asked.mapInArrow(far, f"query {kinds['query']}, v {kinds['v']}, far array<double>")
    asked = written(asked.withColumn("team", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")), "vector-queries")
    # First round: the rings of the nearest cells, by distance, until they hold k others; numbers only, no vectors yet.
    some = F.slice(F.array_sort(F.transform("far", lambda d, i: F.struct(d.alias("d"), i.alias("cell")))), 1, FIRST_CELLS)
    near = asked.select("query", "team", F.explode(some).alias("c")).select("query", "team", "c.*").join(rings, "cell").withColumn("gap", _gap())
    first = top_n_per_key(near, ["query"], [F.col("gap"), F.desc("n"), F.col("cell"), F.col("ring"), F.col("part")], k + 1, rank="place")
    so_far = Window.partitionBy("query").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    first = first.withColumn("before", F.sum("n").over(so_far) - F.col("n")).filter(F.col("before") < k + 1)
    first = first.select("query", "team", "cell", "ring", "part")
    args = (k, stored.schema["id"].dataType.simpleString(), kinds["query"], groups)
    vector = asked.select("query", "v")
    first = written(first, "vector-first")
    found = written(_search(stored, first.join(vector, "query"), *args), "vector-found")
    bound = found.groupBy("query").agg(F.slice(F.sort_array(F.collect_list("similarity"), asc=False), 1, k).alias("best"))
    # Two unit vectors with cosine s are sqrt(2 - 2 s) apart.
    reach = F.when(F.size("best") == k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.element_at("best", -1))) + SLACK).otherwise(F.lit(2.1))
    # A query that has not found k vectors yet keeps the widest reach.
    bounded = asked.join(bound.select("query", reach.alias("reach")), "query", "left")
    wide = bounded.select("query", "team", "reach", F.posexplode("far").alias("cell", "d")).join(rings, "cell")
    wide = wide.filter(_gap() <= F.coalesce("reach", F.lit(2.1))).select("query", "team", "cell", "ring", "part")
    rest = wide.join(first.select("query", "cell", "ring", "part"), ["query", "cell", "ring", "part"], "left_anti")
    found = found.unionByName(_search(stored, rest.join(vector, "query"), *args))
    return top_n_per_key(found, ["query"], [F.desc("similarity"), F.col("id")], k, rank="position")
