"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows fall into blocks by a hash. How many rows of each block go to each shard is drawn
exactly as a uniform random permutation would deal them: block after block, from a
multivariate hypergeometric distribution over what the shards still take. Each block
is permuted, its rows are dealt by these counts, and each shard is permuted again after
the exchange: sorted by a hash in chunks of its values, each numbered from the count of
rows before it, so no such sort is longer than about ``ROWS`` rows whatever the sizes.

Only the matrix passes through the driver: blocks times shards, which grows with the rows
and not with their square. From ``CELLS`` entries on the blocks grow instead; no number of
rows is refused. Rows stay in DataFrame windows and joins; the same seed gives the same result.

Defined cases: NULLs are hashed as such; rows that are equal in every column are
interchangeable; an empty table gives no rows; shard sizes differ by one row at most;
columns named ``shard`` or ``slot`` are replaced, and no other name of a column matters.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.llm.store import free

ROWS, CELLS = 8192, 4_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn from ``good + bad`` are good."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n and good + bad else 0
    # Beyond the library's range: inversion outwards from the mode.
    low, high = max(0, n - bad), min(n, good)
    at = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    p = math.exp(log_choose(good, at) + log_choose(bad, n - at) - log_choose(good + bad, n))
    u = rng.random() - p
    up = down = at
    p_up = p_down = p
    while u > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return at


def communication(blocks: list[int], cells: list[int], seed: int) -> np.ndarray:
    """Rows of block ``i`` for cell ``j``: row sums are the blocks' sizes, column sums the cells'."""
    rng = np.random.default_rng(seed)
    left = list(cells)
    out = np.zeros((len(blocks), len(cells)), np.int64)
    for i, n in enumerate(blocks):
        rest = sum(left)
        for j, size in enumerate(left):
            rest -= size
            out[i, j] = hypergeometric(rng, size, rest, n)
            n -= int(out[i, j])
            left[j] -= int(out[i, j])
    return out


def shuffle(df: DataFrame, shards: int, by: list[str] | None = None, seed: int = 11, rows: int = ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (0 onwards without gaps in each shard).

    ``by`` names the columns that tell rows apart (default: all).
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    own = free(df.columns, "shuffle_")
    told = [F.col(f"`{c}`") for c in (by or df.columns)]
    total = df.count()
    n_blocks = max(1, min(-(-total // rows), CELLS // shards))
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    dealt = df.withColumns({
        f"{own}block": F.pmod(F.xxhash64(F.lit(seed), *told), F.lit(n_blocks)).cast("int"),
        f"{own}here": F.xxhash64(F.lit(seed + 1), *told),
        f"{own}there": F.xxhash64(F.lit(seed + 2), *told),
    })
    counts = {r[f"{own}block"]: r["count"] for r in dealt.groupBy(f"{own}block").count().collect()}
    blocks = sorted(counts)
    ends = np.cumsum(communication([counts[b] for b in blocks], sizes, seed), axis=1)
    plan = spark.createDataFrame([(b, e.tolist()) for b, e in zip(blocks, ends, strict=True)], f"{own}block int, {own}ends array<long>")
    local = Window.partitionBy(f"{own}block").orderBy(f"{own}here", f"{own}there", *told)
    ranked = dealt.withColumn(f"{own}rank", F.row_number().over(local)).join(F.broadcast(plan), f"{own}block")
    shard = F.size(F.filter(f"{own}ends", lambda e: e < F.col(f"{own}rank"))).cast("int")
    bits = max(0, math.ceil(math.log2(max(sizes[0], 1) / rows)))
    chunk = F.shiftright(f"{own}there", 64 - bits) if bits else F.lit(0).cast("long")
    sent = ranked.withColumns({"shard": shard, f"{own}chunk": chunk}).drop(f"{own}ends", f"{own}rank", f"{own}block")
    # How many rows of a shard lie before each chunk; the texts are not read for it.
    before = F.sum("count").over(Window.partitionBy("shard").orderBy(f"{own}chunk").rowsBetween(Window.unboundedPreceding, -1))
    per = sent.groupBy("shard", f"{own}chunk").count().select("shard", f"{own}chunk", F.coalesce(before, F.lit(0)).alias(f"{own}before"))
    again = Window.partitionBy("shard", f"{own}chunk").orderBy(f"{own}there", f"{own}here", *told)
    numbered = sent.withColumn(f"{own}within", F.row_number().over(again) - 1).join(per, ["shard", f"{own}chunk"])
    slot = (F.col(f"{own}before") + F.col(f"{own}within")).cast("long")
    return numbered.select(*[f"`{c}`" for c in df.columns], "shard", slot.alias("slot"))
