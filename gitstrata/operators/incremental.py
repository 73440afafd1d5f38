"""Snapshots, differences between them, and updates that touch only what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.functions.paths import with_language
from gitstrata.session import written
from gitstrata.sources.stores import natural_key

FILE = ["repository_id", "path"]
#: Items that an entry of the index of ``related_repositories`` carries along.
AHEAD = 16


def snapshot(files: DataFrame, taken_at: Column) -> DataFrame:
    """One row per file: content hash and number of lines."""
    breaks = F.regexp_count("content", F.lit("\n"))
    open_end = F.when((F.col("content") != "") & ~F.col("content").endswith("\n"), 1).otherwise(0)
    return files.select(
        *FILE, F.sha2("content", 256).alias("content_hash"), (breaks + open_end).cast("long").alias("n_lines"), taken_at.alias("snapshot_ts")
    )


def diff_snapshots(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Added, modified and deleted files; a rename is a deletion and an addition."""
    old = previous.select(*FILE, F.col("content_hash").alias("old_hash"))
    new = current.select(*FILE, F.col("content_hash").alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    )
    return old.join(new, FILE, "full").withColumn("change_type", change).filter(F.col("change_type").isNotNull())


def reanalysis_decision(
    previous: DataFrame, current: DataFrame, as_of: Column, max_age_days: int = 7, threshold: float = 0.1
) -> DataFrame:
    """Full or incremental per repository: no or old snapshot, or too many changed files.

    ``previous`` carries ``snapshot_ts``.
    """
    known = previous.groupBy("repository_id").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    sizes = current.groupBy("repository_id").agg(F.count("*").alias("total_files"))
    changed = (
        diff_snapshots(previous, current)
        .filter(F.col("change_type") != "deleted")
        .groupBy("repository_id")
        .agg(F.count("*").alias("changed_files"))
    )
    out = sizes.join(known, "repository_id", "left").join(changed, "repository_id", "left").fillna({"changed_files": 0})
    ratio = F.col("changed_files") / F.col("total_files")
    stale = F.col("snapshot_ts").isNull() | (as_of - F.col("snapshot_ts") > F.make_dt_interval(F.lit(max_age_days)))
    return out.select(
        "repository_id", "total_files", "changed_files", ratio.alias("change_ratio"), (stale | (ratio > threshold)).alias("full_reanalysis")
    )


def incremental_candidates(diff: DataFrame, files: DataFrame) -> DataFrame:
    """Whole text of the added and modified files with their language."""
    changed = diff.filter(F.col("change_type").isin("added", "modified")).select(*FILE)
    return with_language(files.drop("language").join(changed, FILE, "left_semi"), "incremental", "path")


def merge_results(previous: DataFrame, fresh: DataFrame, diff: DataFrame) -> DataFrame:
    """Earlier results of untouched files plus the new ones; stale rows go."""
    return previous.join(diff.select(*FILE), FILE, "left_anti").unionByName(fresh)


def backfill(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Missing fields filled; ``was_updated`` tells the rows that changed."""
    touched = F.lit(False)
    for column in defaults:
        touched = touched | F.col(column).isNull()
    flagged = df.withColumn("was_updated", touched)
    return flagged.withColumns({column: F.coalesce(F.col(column), value) for column, value in defaults.items()})


def backfill_counts(filled: DataFrame) -> DataFrame:
    return filled.agg(F.count("*").alias("rows"), F.count_if("was_updated").alias("updated"))


def compare_pairs(pairs: DataFrame, patterns: DataFrame, technologies: DataFrame) -> DataFrame:
    """Set comparison for each asked pair of repositories (``repo_a, repo_b``).

    Work grows with the sets of the asked pairs; repositories that were not asked
    for are never paired.
    """

    def overlap(sets: DataFrame, value: str, prefix: str) -> DataFrame:
        items = sets.select("repository_id", F.col(value).alias("v")).distinct()
        side_a = pairs.join(items.withColumnRenamed("repository_id", "repo_a"), "repo_a")
        side_b = pairs.join(items.withColumnRenamed("repository_id", "repo_b"), "repo_b")
        both = side_a.select("repo_a", "repo_b", "v", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
            side_b.select("repo_a", "repo_b", "v", F.lit(0).alias("a"), F.lit(1).alias("b"))
        )
        marked = both.groupBy("repo_a", "repo_b", "v").agg(F.max("a").alias("a"), F.max("b").alias("b"))
        return marked.groupBy("repo_a", "repo_b").agg(
            F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias(f"common_{prefix}"),
            F.count_if(F.col("b") == 0).alias(f"only_a_{prefix}"),
            F.count_if(F.col("a") == 0).alias(f"only_b_{prefix}"),
        )

    out = (
        pairs.join(overlap(patterns, "name", "patterns"), ["repo_a", "repo_b"], "left")
        .join(overlap(technologies, "name", "technologies"), ["repo_a", "repo_b"], "left")
        .fillna(0)
    )

    def jaccard(prefix: str) -> Column:
        union = F.col(f"common_{prefix}") + F.col(f"only_a_{prefix}") + F.col(f"only_b_{prefix}")
        return F.when(union > 0, F.try_divide(F.col(f"common_{prefix}"), union)).otherwise(0.0)

    everything = sum((F.col(f"{s}_{p}") for s in ("common", "only_a", "only_b") for p in ("patterns", "technologies")), F.lit(0))
    score = F.when(everything == 0, 1.0).otherwise(jaccard("patterns") * 0.7 + jaccard("technologies") * 0.3)
    return out.withColumn("similarity_score", score)


def compared_items(pairs: DataFrame, sets: DataFrame, value: str = "name") -> DataFrame:
    """The items of each asked pair and where they occur: both, only_a or only_b."""
    items = sets.select("repository_id", F.col(value).alias("item")).distinct()
    a = pairs.join(items.withColumnRenamed("repository_id", "repo_a"), "repo_a").withColumn("side", F.lit(1))
    b = pairs.join(items.withColumnRenamed("repository_id", "repo_b"), "repo_b").withColumn("side", F.lit(2))
    sides = a.unionByName(b).groupBy("repo_a", "repo_b", "item").agg(F.sum("side").alias("side"))
    where = F.when(F.col("side") == 3, "both").when(F.col("side") == 1, "only_a").otherwise("only_b")
    return sides.select("repo_a", "repo_b", "item", where.alias("found_in"))


def related_repositories(items: DataFrame, threshold: float, value: str = "name", weight: str = "weight") -> tuple[DataFrame, DataFrame]:
    """Pairs of repositories whose weighted items are alike, without a list of pairs; and the class of each repository.

    Alike means weighted Jaccard (sum of the smaller weights over sum of the larger ones) of at least ``threshold``.
    Repositories with equal items and weights form a class, named by its least id; pairs are of classes, so copies are not paired.

    A pair shares at least ``threshold`` times the larger of its total weights. So with items in one order, rarest first, both
    have a common item before their rest weighs less than that: only these prefixes are joined, as an inverted
    index. An entry carries its repository's next ``AHEAD`` items in that order, so the join itself works out what the two share
    from there on: exactly for profiles that end there, else at most that plus what follows. Pairs that cannot reach the threshold
    leave in the join and are never shuffled; the others get exact sums. Weights must be positive; rows with a NULL, or a weight
    of 0 or less, do not count.
    """
    rows = items.select("repository_id", F.col(value).alias("v"), F.col(weight).cast("double").alias("w"))
    rows = rows.filter("repository_id IS NOT NULL AND v IS NOT NULL AND w > 0").groupBy("repository_id", "v").agg(F.sum("w").alias("w"))
    # The profile's digest is a sum over its items, so it is made on the map side; two sums of 64-bit hashes tell profiles apart.
    digest = [F.sum(F.xxhash64("v", "w", F.lit(i)).cast("decimal(38,0)")).alias(f"d{i}") for i in (1, 2)]
    profiles = rows.groupBy("repository_id").agg(*digest, F.count("*").alias("n"))
    least = profiles.groupBy("d1", "d2", "n").agg(F.min("repository_id").alias("class_id"))
    classes = written(profiles.join(least, ["d1", "d2", "n"]).select("repository_id", "class_id"), "classes")
    mine = rows.join(classes.filter("repository_id = class_id").select("repository_id"), "repository_id", "left_semi")
    rarity = mine.groupBy("v").agg(F.count("*").alias("holders")).filter("holders > 1")
    rarity = written(rarity.withColumn("item", F.monotonically_increasing_id()), "rarity")
    totals = mine.groupBy("repository_id").agg(F.sum("w").alias("total"))
    ranked = mine.join(rarity, "v", "left").join(totals, "repository_id")
    ranked = written(ranked.select("repository_id", "item", "w", "total", F.coalesce("holders", F.lit(1)).alias("holders")), "weighted")
    order = Window.partitionBy("repository_id").orderBy("holders", "item")
    before = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ahead = F.collect_list(F.struct("item", "w")).over(order.rowsBetween(1, AHEAD))
    # Items of one holder can be shared by nobody, but their weight counts for the prefix.
    prefix = ranked.withColumns({"rest": F.col("total") - before, "ahead": ahead})
    prefix = prefix.filter((F.col("rest") >= F.col("total") * threshold * (1 - 1e-9)) & (F.col("holders") > 1))
    listed = F.aggregate("ahead", F.lit(0.0), lambda s, x: s + x["w"])
    # What follows the listed items: nothing when the list is not full.
    after = F.when(F.size("ahead") < AHEAD, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("rest") - F.col("w") - listed))
    entries = prefix.select("item", "repository_id", "total", "w", (F.col("rest") - F.col("w")).alias("rest"), after.alias("after"), "ahead.item", "ahead.w")
    names = ["repo", "total", "w", "rest", "after", "items", "weights"]
    a, b = (entries.toDF("item", *[f"{c}_{side}" for c in names]) for side in "ab")
    smaller, larger = F.least("total_a", "total_b"), F.greatest("total_a", "total_b")
    sized = a.join(b, "item").filter("repo_a < repo_b").filter(smaller >= larger * threshold * (1 - 1e-9))
    # Shared weight s gives s / (a + b - s). At the first common item of a pair nothing before it is shared.
    need = (F.col("total_a") + F.col("total_b")) * (threshold / (1 + threshold)) * (1 - 1e-9)

    def weight_of(x: Column, side: str) -> Column:
        return F.get(f"weights_{side}", F.array_position(f"items_{side}", x).cast("int") - 1)

    in_both = F.aggregate(F.array_intersect("items_a", "items_b"), F.lit(0.0), lambda s, x: s + F.least(weight_of(x, "a"), weight_of(x, "b")))
    in_both = F.when(F.arrays_overlap("items_a", "items_b"), in_both).otherwise(0.0)
    # Of two lists in one order only the one that ends first can have its rest in the other list, so one of the rests bounds both.
    here, rest = F.least("w_a", "w_b"), F.least("rest_a", "rest_b")
    reaches = F.when(here + rest < need, False).otherwise(here + F.least(rest, in_both + F.greatest("after_a", "after_b")) >= need)
    likely = written(sized.filter(reaches).select("repo_a", "repo_b", "total_a", "total_b").distinct(), "likely-pairs")
    side_a = likely.select("repo_a", "repo_b").join(ranked.filter("holders > 1").select(F.col("repository_id").alias("repo_a"), "item", F.col("w").alias("wa")), "repo_a")
    shared = side_a.join(ranked.select(F.col("repository_id").alias("repo_b"), "item", F.col("w").alias("wb")), ["repo_b", "item"])
    shared = shared.groupBy("repo_a", "repo_b").agg(F.sum(F.least("wa", "wb")).alias("shared"))
    pairs = likely.join(shared, ["repo_a", "repo_b"]).withColumn("similarity", F.col("shared") / (F.col("total_a") + F.col("total_b") - F.col("shared")))
    return pairs.filter(F.col("similarity") >= threshold).select("repo_a", "repo_b", "similarity"), classes


def track_access(associations: DataFrame, events: DataFrame) -> DataFrame:
    """Associations after access events: first and last access, latest access type.

    Both inputs hold ``user_id, repository_id, access_type, created_at, last_accessed``.
    """
    both = associations.unionByName(events)
    return both.groupBy("user_id", "repository_id").agg(
        F.min("created_at").alias("created_at"),
        F.max("last_accessed").alias("last_accessed"),
        F.max_by("access_type", F.struct("last_accessed", "access_type")).alias("access_type"),
    ).withColumn("association_id", natural_key("user_id", "repository_id"))


def repository_usage(associations: DataFrame) -> DataFrame:
    """Users per repository, counted anew instead of incremented."""
    return associations.groupBy("repository_id").agg(F.countDistinct("user_id").alias("unique_users"), F.count("*").alias("analysis_count"))


def remove_access(associations: DataFrame, removals: DataFrame) -> DataFrame:
    return associations.join(removals.select("user_id", "repository_id"), ["user_id", "repository_id"], "left_anti")
