"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Tokens are numbers, words and currency or per-cent signs. Numbers, capitalised words and
units become typed placeholders, all other words their lower case, so a question with
other numbers and names has the same template. Hashes of every ``WINDOW``-token template
window of every text are joined with those of the benchmark items (an item with fewer
tokens is one window). Windows of placeholders only say nothing and are left out. Where a document
holds at least ``SHARE`` of an item's windows, the values in the matched slots are
compared: within an item, one value must stand for one value throughout
(``CONSISTENT`` of the slots), as in a question asked again with other values. Share and
values are judged for each occurrence of the item, and for the document as a whole; it is
found if one of them passes.

Beside the template path, ``findings`` and ``keep`` look for exact text: the same windows
over lower-cased tokens as they stand, whatever they are. One window of an item (all of an
item shorter than a window) that matches word for word is a find, whatever its share.

Defined cases: NULL and empty texts have no tokens and match nothing; an item without
usable windows is found by its exact text only; repeated rows and rows without id are found as any other
(rows equal in id and text once); an empty benchmark or table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.llm.store import free, written

WINDOW, LITERALS, SHARE, CONSISTENT = 8, 3, 0.5, 0.8
TOKEN = r"[0-9]+(?:[.,:/][0-9]+)*|[\p{L}\p{M}]+|[%$€£]"
#: Names of units.
UNITS = (
    "mm", "cm", "km", "mg", "kg", "ml", "kb", "mb", "gb", "tb", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "gram", "grams", "kilogram", "kilograms",
    "pound", "pounds", "ounce", "ounces", "ton", "tons", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds",
    "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "degree", "degrees",
    "percent", "dollar", "dollars", "cent", "cents", "euro", "euros", "mph", "kmh", "hz", "khz", "mhz", "ghz", "watt", "watts", "volt", "volts",
    "%", "$", "€", "£",
)
NUMBER, NAME, UNIT = 1, 2, 3
#: Bits of the filter on a window's first two tokens: a fixed size; a larger benchmark only lets more windows through.
FILTER_BITS = 18


def raw_tokens(text: Column) -> Column:
    """The tokens of a text as they stand."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)


def code(token: Column) -> Column:
    """A token's place in the template: a placeholder's number, or the hash of the lower-case word."""
    low, first = F.lower(token), F.substring(token, 1, 1)
    literal = F.xxhash64(low)
    return (
        F.when(token.between("0", ":"), F.lit(NUMBER).cast("long"))
        .when(low.isin(*UNITS), F.lit(UNIT).cast("long"))
        .when(token < "[", F.lit(NAME).cast("long"))  # upper-case ASCII
        .when(token < "{", literal)
        .when(first != F.lower(first), F.lit(NAME).cast("long"))
        .otherwise(literal)
    )


def is_slot(c: Column) -> Column:
    return c.isin(NUMBER, NAME, UNIT)


def _pair(codes: Column, at: Column) -> Column:
    """Bit number of the first two tokens of the window at ``at`` (from 1)."""
    two = F.element_at(codes, at).bitwiseXOR(F.shiftleft(F.element_at(codes, at + 1), 1))
    return two.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def windows(codes: Column, size: int, bits: Column | None = None) -> Column:
    """``(at, hash, n)`` of every run of ``size`` codes; of those only whose first two may start a wanted one."""
    none = F.array().cast("array<struct<at:int,hash:bigint,n:int>>")

    def one(at: Column) -> Column:
        return F.struct(at.alias("at"), F.xxhash64(F.slice(codes, at, F.lit(size))).alias("hash"), F.lit(size).alias("n"))

    def wanted(at: Column) -> Column:
        pair = _pair(codes, at)
        return F.getbit(F.element_at(bits, (F.shiftright(pair, 6) + 1).cast("int")), pair.bitwiseAND(63).cast("int")) == 1

    starts = F.sequence(F.lit(1), F.size(codes) - size + 1)
    if bits is not None and size > 1:
        starts = F.filter(starts, wanted)
    return F.when(F.size(codes) >= size, F.transform(starts, one)).otherwise(none)


def _usable(codes: Column, at: Column, size: Column) -> Column:
    """Enough of the window is literal."""
    return F.size(F.filter(F.slice(codes, at, size), lambda x: ~is_slot(x))) >= F.least(F.lit(LITERALS), size)


def word(token: Column) -> Column:
    """A token's place in the exact text: the hash of its lower case."""
    return F.xxhash64(F.lower(token))


def _tokens(benchmark: DataFrame, coded: Callable[[Column], Column]) -> DataFrame:
    """``(item_id, raw, codes, n)`` of the items that have tokens; ``n`` is the size of their windows."""
    items = benchmark.select("item_id", raw_tokens(F.col("text")).alias("raw")).filter(F.size("raw") > 0)
    items = items.withColumn("codes", F.transform("raw", coded)).withColumn("n", F.least(F.size("codes"), F.lit(WINDOW)))
    return written(items.dropDuplicates(["item_id", "raw"]), "items")


def _hits(docs: DataFrame, items: DataFrame, coded: Callable[[Column], Column], usable: Callable[..., Column]) -> tuple[DataFrame, DataFrame]:
    """Places where a usable window of an item stands in a document, and the number of usable windows of each item."""
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect()) or [WINDOW]  # at most WINDOW values
    named = ["item_id", F.xxhash64("raw").alias("item_hash"), "codes"]
    parts = [items.filter(F.col("n") == n).select(*named, F.explode(windows(F.col("codes"), n)).alias("w")) for n in sizes]
    every = reduce(DataFrame.unionByName, parts)
    every = every.filter(usable(F.col("codes"), F.col("w.at"), F.col("w.n")))
    pair = F.when(F.col("w.n") > 1, _pair(F.col("codes"), F.col("w.at")))
    wanted = every.select("item_id", "item_hash", F.col("w.at").alias("item_at"), F.col("w.hash").alias("hash"), F.col("w.n").alias("n"), pair.alias("pair"))
    wanted = written(wanted, "item-windows")
    per_item = wanted.groupBy("item_id", "item_hash").agg(F.count("item_at").alias("item_windows"))
    mask = [0] * (1 << FILTER_BITS - 6)
    for r in wanted.select("pair").distinct().dropna().collect():  # at most 2 ** FILTER_BITS values
        mask[r["pair"] >> 6] |= 1 << (r["pair"] & 63)
    bits = F.lit([x - (1 << 64) if x >> 63 else x for x in mask]).cast("array<long>")
    # Only ids and hashes leave a text.
    told = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.transform(raw_tokens(F.col("text")), coded).alias("codes"))
    found = told.select("doc_id", "text_hash", F.explode(F.concat(*[windows(F.col("codes"), n, bits) for n in sizes])).alias("w"))
    found = found.select("doc_id", "text_hash", F.col("w.at").alias("at"), F.col("w.hash").alias("hash"), F.col("w.n").alias("n"))
    return found.join(wanted.drop("pair"), ["hash", "n"]), per_item


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, item_id, matched_windows, item_windows, share, slots, consistent, same_values)`` of the documents found by template."""
    items = _tokens(benchmark, code)
    hits, per_item = _hits(docs, items, code, _usable)
    hits = written(hits, "hits")
    enough = hits.groupBy("doc_id", "text_hash", "item_id", "item_hash").agg(F.count_distinct("item_at").alias("matched_windows"))
    enough = enough.join(per_item, ["item_id", "item_hash"]).withColumn("share", F.col("matched_windows") / F.col("item_windows"))
    enough = written(enough.filter(F.col("share") >= SHARE), "enough")
    return _consistent(docs, items, hits, enough)


def exact(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """As ``matches``, of the documents that hold a window of an item word for word; no slots are compared."""
    hits, per_item = _hits(docs, _tokens(benchmark, word), word, lambda codes, at, size: F.lit(True))
    found = hits.groupBy("doc_id", "text_hash", "item_id", "item_hash").agg(F.count_distinct("item_at").alias("matched_windows"))
    found = found.join(per_item, ["item_id", "item_hash"])
    return found.select(
        "doc_id", "text_hash", "item_id", "matched_windows", "item_windows", (F.col("matched_windows") / F.col("item_windows")).alias("share"),
        F.lit(0).cast("long").alias("slots"), F.lit(1.0).alias("consistent"), F.lit(True).alias("same_values"),
    )


def _runs(places: DataFrame) -> DataFrame:
    """The places of each pair by ``run``: all of them, those at one distance from the item, and one for each item place near that distance.

    An occurrence lies at one distance; where a value has more or fewer words than the item's, the rest lies a little off.
    """
    pair = ["doc_key", "item_id", "item_hash"]
    places = places.withColumn("off", F.col("at") - F.col("item_at"))
    runs = places.select(*pair, F.col("off").alias("base"), "reach").distinct()
    cells = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("base") / F.col("reach")) + i)).alias("cell")
    near = places.withColumn("cell", F.floor(F.col("off") / F.col("reach"))).drop("reach").join(runs.select("*", cells), [*pair, "cell"])
    near = near.withColumn("apart", F.abs(F.col("off") - F.col("base"))).filter(F.col("apart") <= F.col("reach"))
    nearest = near.groupBy(*pair, "base", "item_at").agg(F.min(F.struct("apart", "off", "slots")).alias("nearest"))
    same = ["item_at", "slots"]
    return reduce(DataFrame.unionByName, [
        places.select(*pair, F.struct(F.lit(0).alias("kind"), F.lit(0).alias("base")).alias("run"), *same),
        places.select(*pair, F.struct(F.lit(1).alias("kind"), F.col("off").alias("base")).alias("run"), *same),
        nearest.select(*pair, F.struct(F.lit(2).alias("kind"), F.col("base")).alias("run"), "item_at", F.col("nearest.slots").alias("slots")),
    ])


def _consistent(docs: DataFrame, items: DataFrame, hits: DataFrame, enough: DataFrame) -> DataFrame:
    """Compares what stands in the slots of the matched windows, for each run; the best run that passes speaks for the document."""
    doc_key = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "text_hash")
    keyed = enough.withColumn("doc_key", F.xxhash64(doc_key))
    wanted = keyed.select("doc_key").distinct()
    told = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).withColumn("doc_key", F.xxhash64(doc_key))
    texts = told.join(wanted, "doc_key").dropDuplicates(["doc_key"]).select("doc_key", raw_tokens(F.col("text")).alias("doc_raw"))
    named = ["item_id", "item_hash"]
    places = hits.withColumn("doc_key", F.xxhash64(doc_key)).join(keyed.select("doc_key", *named), ["doc_key", *named])
    places = places.groupBy("doc_key", *named).agg(F.collect_set(F.struct("at", "item_at", "n")).alias("places"))
    told_items = items.select("item_id", F.xxhash64("raw").alias("item_hash"), F.col("raw").alias("item_raw"), F.col("codes").alias("item_codes"))
    both = places.join(told_items, named).join(texts, "doc_key")

    def slots(p: Column) -> Column:
        taken = F.filter(F.sequence(F.lit(0), p["n"] - 1), lambda i: is_slot(F.element_at("item_codes", p["item_at"] + i)))
        return F.transform(taken, lambda i: F.struct(
            (p["item_at"] + i).alias("item_at"), (p["at"] + i).alias("at"),
            F.element_at("item_raw", p["item_at"] + i).alias("a"), F.element_at("doc_raw", p["at"] + i).alias("b"),
        ))

    reach = F.greatest(F.lit(WINDOW), F.floor(F.size("item_codes") / 2)).cast("int")
    valued = F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["item_at"].alias("item_at"), reach.alias("reach"), slots(p).alias("slots")))
    placed = written(both.select("doc_key", *named, F.inline(valued)), "places")
    runs = _runs(placed).groupBy("doc_key", *named, "run").agg(
        F.count_distinct("item_at").alias("matched_windows"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("values")
    )
    runs = runs.join(keyed.select("doc_key", *named, "item_windows"), ["doc_key", *named])
    runs = runs.withColumn("share", F.col("matched_windows") / F.col("item_windows")).filter(F.col("share") >= SHARE)
    group = ["doc_key", *named, "run", "matched_windows", "share"]
    each = runs.select(*group, F.explode_outer("values").alias("v"))
    counted = each.groupBy(*group, F.col("v.a").alias("a"), F.col("v.b").alias("b")).agg(F.count("v").alias("n"))
    by_value = counted.groupBy(*group, "a").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same")
    )
    judged = by_value.groupBy(*group).agg(F.sum("n").alias("slots"), F.sum("most").alias("most"), F.sum("same").alias("same"))
    agreed = F.when(F.col("slots") == 0, F.lit(1.0)).otherwise(F.col("most") / F.col("slots"))
    passed = judged.withColumn("consistent", agreed).filter(F.col("consistent") >= CONSISTENT)
    passed = passed.withColumn("same_values", F.col("same") == F.col("slots"))
    order = F.struct("same_values", "share", "consistent", -F.col("run.kind"), -F.col("run.base"))
    best = passed.groupBy("doc_key", *named).agg(F.max_by(F.struct("matched_windows", "share", "slots", "consistent", "same_values"), order).alias("best"))
    out = keyed.drop("matched_windows", "share").join(best, ["doc_key", *named])
    return out.select("doc_id", "text_hash", "item_id", "best.matched_windows", "item_windows", "best.share", "best.slots", "best.consistent", "best.same_values")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents contaminated by template, one row for each item found in them."""
    return matches(docs.select("doc_id", "text"), benchmark.select("item_id", "text")).drop("text_hash")


def _both(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    return matches(docs, benchmark).withColumn("exact", F.lit(False)).unionByName(exact(docs, benchmark).withColumn("exact", F.lit(True)))


def findings(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contaminated documents, by template or by exact text, one row for each item found in them (the template's if both find it)."""
    both = _both(docs, benchmark)
    told = ["matched_windows", "item_windows", "share", "slots", "consistent", "same_values"]
    order = F.struct(~F.col("exact"), "share", "same_values", "consistent", "matched_windows")
    best = both.groupBy("doc_id", "text_hash", "item_id").agg(F.max_by(F.struct(*told), order).alias("best"))
    return best.select("doc_id", "item_id", *[F.col(f"best.{c}") for c in told])


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, by template or by exact text; columns as they were."""
    own = free(docs.columns, "bad_")
    bad = _both(docs, benchmark).select(F.col("doc_id").alias(f"{own}id"), F.col("text_hash").alias(f"{own}hash"))
    bad = written(bad.distinct(), "contaminated")
    same = (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(f"{own}hash")) & F.col("doc_id").eqNullSafe(F.col(f"{own}id"))
    return docs.join(bad, same, "left_anti")
