"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a fixed pseudo-random order, form blocks of ``BLOCK`` rows. Block
``k`` of a source with share ``w`` of the slots is released at ``floor(k / w)`` and due
at ``ceil((k + 1) / w)``; the released block with the earliest deadline takes the next
slot. At every slot each source is then less than one block away from its exact share.

Shares are the exact rational values of the weights, never rounded to a period, so the bound
holds over the whole of a phase. One number per block is scheduled on the driver. When a
source has no block left, the others go on from there with their shares of the rest; every
row gets its place. There are at most as many such phases as sources.

Defined cases: a NULL source is a source; a source without a target weight gets none of
the first phase's slots and follows when the others are done (all such in equal shares);
targets of absent sources are ignored; equal rows are interchangeable; an empty table
gives no rows; columns named ``position`` or ``block`` are replaced, and no other name of a column but ``source`` matters.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.llm.store import free

BLOCK, CHUNK = 16, 4_000


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers in exactly the same proportion."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*[w.denominator for w in exact.values()])
    return {s: int(w * unit) for s, w in exact.items()}


def schedule(weights: dict[str, int], blocks: dict[str, int] | None = None) -> dict[str, array]:
    """The slots of each source, earliest deadline first among the released, until one has none of its ``blocks`` left (default: one period)."""
    total = sum(weights.values())
    limit = blocks or weights
    waiting = [(0, -(-total // w), s, 0) for s, w in weights.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    out = {s: array("q") for s in weights}
    for t in range(sum(limit.values())):
        while waiting and waiting[0][0] <= t:
            _, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, -weights[s], s, k))
        _, _, s, k = heapq.heappop(ready)
        out[s].append(t)
        k += 1
        if k < limit[s]:
            heapq.heappush(waiting, (k * total // weights[s], -(-(k + 1) * total // weights[s]), s, k))
        elif blocks:
            break
    return out


def phases(blocks: dict[str, int], targets: dict[str, float]) -> dict[str, array]:
    """The slot of every block of each source, in turn."""
    left = {s: n for s, n in blocks.items() if n}
    out = {s: array("q") for s in left}
    start = 0
    while left:
        weights = {s: targets[s] for s in left if targets.get(s, 0) > 0} or {s: 1.0 for s in left}
        used = schedule(whole(weights), {s: left[s] for s in weights})
        for s, slots in used.items():
            out[s].extend(start + t for t in slots)
            left[s] -= len(slots)
            if not left[s]:
                del left[s]
        start += sum(len(slots) for slots in used.values())
    return out


def mix(
    docs: DataFrame, targets: dict[str | None, float] | None = None, source: str = "source", by: list[str] | None = None,
    block: int = BLOCK, seed: int = 3, chunk_rows: int = CHUNK,
) -> DataFrame:
    """``docs`` with ``block`` (number within the source) and ``position`` (0 onwards without gaps).

    ``targets`` defaults to the square root of each source's rows. ``by`` names the columns
    that order rows within a source through their hash (default: all). Order by ``position`` to read the mixture.
    """
    spark = docs.sparkSession
    docs = docs.drop("position", "block")
    pre = free(docs.columns, "mix_")
    told = [F.col(f"`{c}`") for c in (by or docs.columns)]
    # One text per source, a NULL apart from every other.
    name = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    rows = docs.withColumns({f"{pre}source": name, f"{pre}order": F.xxhash64(F.lit(seed), *told)})
    sizes = {r[f"{pre}source"]: r["count"] for r in rows.groupBy(f"{pre}source").count().collect()}  # one row per source
    if not sizes:
        return docs.withColumns({"block": F.lit(0).cast("long"), "position": F.lit(0).cast("long")})
    wanted = {("" if s is None else f"={s}"): w for s, w in targets.items()} if targets else {s: math.sqrt(n) for s, n in sizes.items()}
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    plan = phases(blocks, wanted)
    # Last blocks may be short: how many rows are missing before each slot.
    short = [(plan[s][-1], block - n % block) for s, n in sizes.items() if n % block]
    # Number the rows of a source: chunks of its hash order, then rows within a chunk.
    bits = max(0, math.ceil(math.log2(max(sizes.values()) / chunk_rows)))
    chunk = F.shiftright(f"{pre}order", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn(f"{pre}chunk", chunk)
    told_slots, before = [], dict.fromkeys(sizes, 0)
    for r in rows.groupBy(f"{pre}source", f"{pre}chunk").count().orderBy(f"{pre}source", f"{pre}chunk").collect():  # about one for chunk_rows rows
        first = before[r[f"{pre}source"]]
        before[r[f"{pre}source"]] += r["count"]
        own = plan[r[f"{pre}source"]][first // block : (first + r["count"] - 1) // block + 1]
        told_slots.append((r[f"{pre}source"], r[f"{pre}chunk"], first, own.tolist()))
    kind = f"{pre}source string, {pre}chunk long, {pre}before long, {pre}slots array<bigint>"
    table = spark.createDataFrame(told_slots, kind)
    within = F.row_number().over(Window.partitionBy(f"{pre}source", f"{pre}chunk").orderBy(f"{pre}order", *told)) - 1
    numbered = rows.withColumn(f"{pre}within", within)
    placed = numbered.join(F.broadcast(table) if sum(blocks.values()) <= 1 << 20 else table, [f"{pre}source", f"{pre}chunk"])
    placed = placed.withColumn(f"{pre}index", F.col(f"{pre}before") + F.col(f"{pre}within"))
    number = F.floor(F.col(f"{pre}index") / block)
    slot = F.col(f"{pre}slots")[(number - F.floor(F.col(f"{pre}before") / block)).cast("int")]
    lost = F.lit(0).cast("long")
    if short:
        gaps = F.array(*[F.struct(F.lit(a).cast("long").alias("slot"), F.lit(b).cast("long").alias("n")) for a, b in sorted(short)])
        lost = F.aggregate(gaps, F.lit(0).cast("long"), lambda x, g: x + F.when(g["slot"] < F.col(f"{pre}slot"), g["n"]).otherwise(F.lit(0)))
    out = placed.withColumn(f"{pre}slot", slot)
    position = F.col(f"{pre}slot") * block + F.col(f"{pre}index") % block - lost
    return out.select(*[f"`{c}`" for c in docs.columns], number.cast("long").alias("block"), position.cast("long").alias("position"))
