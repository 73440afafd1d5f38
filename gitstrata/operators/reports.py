"""Derived reports: insights, scores, dashboards, chart data.

Inputs are small per-repository aggregates (``stats`` has one row per repository
and pattern: ``repository_id, name, category, complexity_level, is_antipattern,
occurrences``), so the windows here run over pre-aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.functions.commit_text import fold_category, grade
from gitstrata.functions.common import compact_list, contains_any, latest_per_key, non_empty, top_n_per_key
from gitstrata.rules import insights as rules

REPO = "repository_id"
_RULE = (
    "metric string, at_least double, above double, below double, at_most double, kind string, title string, category string, "
    "priority string, confidence double, impact double"
)


def metrics_long(**tables: DataFrame) -> DataFrame:
    """(repository, metric, value) rows from wide per-repository tables."""
    out = None
    for table in tables.values():
        numeric = [c for c, t in table.dtypes if c != REPO and t in ("int", "bigint", "double", "float")]
        wide = table.select(REPO, *[F.col(c).cast("double").alias(c) for c in numeric])
        rows = wide.unpivot(REPO, numeric, "metric", "value").filter(F.col("value").isNotNull())
        out = rows if out is None else out.unionByName(rows)
    return out


def name_families(stats: DataFrame) -> DataFrame:
    """Patterns per repository whose name falls in each family."""
    name = F.lower("name")
    return stats.groupBy(REPO).agg(*[F.count_if(contains_any(name, words)).alias(family) for family, words in rules.NAME_FAMILIES.items()])


def insights(metrics: DataFrame, thresholds: list[tuple] | None = None) -> DataFrame:
    """The rules of a fixed table that hold for each repository's metrics."""
    table = thresholds if thresholds is not None else rules.THRESHOLDS
    rows = [tuple(float(x) if isinstance(x, int) else x for x in row) for row in table]
    known = F.broadcast(metrics.sparkSession.createDataFrame(rows, _RULE))
    value = F.col("value")
    holds = (
        F.coalesce(value >= F.col("at_least"), F.lit(True))
        & F.coalesce(value > F.col("above"), F.lit(True))
        & F.coalesce(value < F.col("below"), F.lit(True))
        & F.coalesce(value <= F.col("at_most"), F.lit(True))
    )
    return metrics.join(known, "metric").filter(holds).drop("at_least", "above", "below", "at_most")


def prioritize(found: DataFrame) -> DataFrame:
    """Position of each insight in its repository: priority, impact, confidence, title."""
    rank = F.lit(1)
    for name, value in rules.PRIORITY.items():
        rank = F.when(F.col("priority") == name, value).otherwise(rank)
    order = Window.partitionBy(REPO).orderBy(F.desc("_rank"), F.desc("impact"), F.desc("confidence"), "title")
    # a repository has at most as many insights as there are rules
    return found.withColumn("_rank", rank).withColumn("position", F.row_number().over(order)).drop("_rank")


def technology_currency(technologies: DataFrame) -> DataFrame:
    """Technologies on the modern, outdated and emerging lists."""
    rows = [(name, era) for era, names in rules.TECHNOLOGY_ERA.items() for name in names]
    table = F.broadcast(technologies.sparkSession.createDataFrame(rows, "technology string, era string"))
    return technologies.select(REPO, "technology").distinct().join(table, "technology")


def currency_counts(technologies: DataFrame) -> DataFrame:
    era = technology_currency(technologies)
    return era.groupBy(REPO).agg(*[F.count_if(F.col("era") == e).alias(f"{e}_technologies") for e in rules.TECHNOLOGY_ERA])


def pattern_insight_metrics(stats: DataFrame, commits: DataFrame, technologies: DataFrame) -> DataFrame:
    """Counts behind the rule-based pattern insights."""
    anti = F.coalesce("is_antipattern", F.lit(False))
    level = F.coalesce(non_empty("complexity_level"), F.lit("intermediate"))
    per_repo = stats.groupBy(REPO).agg(
        F.count("*").alias("pattern_count"),
        F.count_if(anti).alias("antipatterns"),
        F.count_if(~anti & (level == "advanced")).alias("advanced_patterns"),
        F.count_if(contains_any(F.lower("name"), rules.ARCHITECTURE_NAMES)).alias("architecture_patterns"),
    )
    n_commits = commits.groupBy(REPO).agg(F.count("*").alias("commit_count"))
    n_tech = technologies.groupBy(REPO).agg(F.countDistinct("technology").alias("technology_count"))
    return (
        per_repo.join(n_commits, REPO, "left").join(n_tech, REPO, "left")
        .withColumn("pattern_quality", F.greatest(F.lit(0), 100 - F.col("antipatterns") * 15))
        .withColumn("patterns_per_commit", F.when(F.col("commit_count") > 0, F.col("pattern_count") / F.col("commit_count")))
        .withColumn("diversity_score", F.least(F.lit(100), F.col("pattern_count") * 5))
    )


def pattern_insights(stats: DataFrame, commits: DataFrame, technologies: DataFrame) -> DataFrame:
    metrics = metrics_long(m=pattern_insight_metrics(stats, commits, technologies))
    return insights(metrics, rules.PATTERN_THRESHOLDS).select(REPO, "metric", "value", "kind", "title", "category")


def _clip(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def heuristic_scores(stats: DataFrame) -> DataFrame:
    """Security, performance and architecture scores from pattern names alone."""
    name, anti = F.lower("name"), F.coalesce("is_antipattern", F.lit(False))
    secure = contains_any(name, rules.SECURITY_WORDS)
    security = F.when(anti, -10).otherwise(0) + F.when(secure & anti, -15).when(secure, 5).otherwise(0)
    speed = F.when(contains_any(name, rules.FAST_WORDS), 5).when(contains_any(name, rules.SLOW_WORDS), -10).otherwise(0)
    critical, high = contains_any(name, rules.CRITICAL_WORDS), contains_any(name, rules.HIGH_WORDS)
    sums = stats.groupBy(REPO).agg(
        F.count("*").alias("patterns"), F.sum(security).alias("s"), F.sum(speed).alias("p"),
        F.count_if(contains_any(name, rules.STRUCTURE_WORDS)).alias("a"), F.count_if(anti).alias("antipatterns"),
        F.count_if(anti & critical).alias("critical"), F.count_if(anti & ~critical & high).alias("high"),
        F.count_if(anti & ~critical & ~high).alias("medium"),
    )
    s, p = F.col("security_score"), F.col("performance_score")
    return (
        sums.withColumn("security_score", _clip(F.col("s") + 85))
        .withColumn("performance_score", _clip(F.col("p") + 80))
        .withColumn("architecture_score", _clip(F.least(F.lit(20), F.col("a") * 4) + 75 - F.col("antipatterns") * 8))
        .withColumn("risk_level", F.when(s > 80, "low").when(s > 60, "medium").otherwise("high"))
        .withColumn("total_vulnerabilities", F.floor((100 - s) / 10))
        .withColumn("total_issues", F.floor((100 - p) / 8))
        .withColumn("performance_grade", grade(p))
        .withColumn("architecture_grade", grade(F.col("architecture_score")))
        .withColumn("modularity", F.least(F.lit(1.0), F.col("patterns") / 10.0))
        .withColumn("coupling", F.greatest(F.lit(0.1), F.lit(1.0) - F.col("patterns") / 20.0))
        .withColumn("cohesion", F.least(F.lit(1.0), F.lit(0.5) + F.col("patterns") / 40.0))
        .drop("s", "p", "a")
    )


def pattern_families(stats: DataFrame) -> DataFrame:
    """Security, performance and design patterns by name, one row per hit."""
    name = F.lower("name")
    positive = F.when(F.coalesce("is_antipattern", F.lit(False)), "negative").otherwise("positive")
    none = F.lit(None).cast("double")

    def hit(family: str, label: Column, effect: Column, confidence: Column) -> Column:
        return F.struct(F.lit(family).alias("family"), label.alias("label"), effect.alias("effect"), confidence.alias("confidence"))

    fast, slow = contains_any(name, rules.PERFORMANCE_FAMILY), contains_any(name, rules.PERFORMANCE_NEGATIVE)
    hits = [
        F.when(contains_any(name, rules.SECURITY_FAMILY), hit("security", F.col("name"), positive, none)),
        F.when(fast | slow, hit("performance", F.col("name"), F.when(fast, "positive").otherwise("negative"), none)),
    ]
    hits += [
        F.when(name.contains(word), hit("design", F.lit(word.title()), F.lit("positive"), F.lit(confidence)))
        for word, confidence in rules.DESIGN_CONFIDENCE.items()
    ]
    return stats.select(REPO, "name", F.explode(F.array_compact(F.array(*hits))).alias("h")).select(REPO, "name", "h.*")


def architectural_styles(stats: DataFrame, technologies: DataFrame) -> DataFrame:
    """MVC, MVP and Microservices where names say so, else Layered."""
    name, tech = F.lower("name"), F.lower("technology")
    a = stats.groupBy(REPO).agg(F.max(name.contains("mvc")).alias("mvc"), F.max(name.contains("mvp")).alias("mvp"))
    b = technologies.groupBy(REPO).agg(F.max(tech.contains("docker") | tech.contains("kubernetes")).alias("services"))
    styles = compact_list((F.col("mvc"), "MVC"), (F.col("mvp"), "MVP"), (F.coalesce("services", F.lit(False)), "Microservices"))
    return a.join(b, REPO, "left").select(REPO, F.when(F.size(styles) > 0, styles).otherwise(F.array(F.lit("Layered"))).alias("styles"))


def heuristic_recommendations(stats: DataFrame, n: int = 5) -> DataFrame:
    """Security, performance and architecture advice from what names lack."""
    name = F.lower("name")
    seen = stats.groupBy(REPO).agg(
        F.count("*").alias("patterns"), F.count_if("is_antipattern").alias("anti"),
        *[F.max(name.contains(word)).alias(word) for word in ("auth", "crypt", "cache", "pool", "mvc")],
    )
    security = compact_list(
        (~F.col("auth"), "add authentication"), (~F.col("crypt"), "add cryptography"),
        (F.col("anti") > 0, F.concat(F.lit("refactor "), F.col("anti").cast("string"), F.lit(" antipatterns"))),
        (F.lit(True), "validate input"), (F.lit(True), "log and monitor"),
    )
    speed = compact_list(
        (~F.col("cache"), "cache what is read often"), (~F.col("pool"), "pool connections"),
        (F.lit(True), "tune queries"), (F.lit(True), "load lazily"), (F.lit(True), "work asynchronously"),
    )
    structure = compact_list(
        (F.col("patterns") < 5, "use more patterns"), (F.col("patterns") > 20, "use fewer patterns"), (~F.col("mvc"), "consider MVC"),
        (F.lit(True), "separate concerns"), (F.lit(True), "inject dependencies"), (F.lit(True), "keep to SOLID"),
    )
    return seen.select(
        REPO, F.slice(security, 1, n).alias("security"), F.slice(speed, 1, n).alias("performance"), F.slice(structure, 1, n).alias("architecture")
    )


def enhanced_view(stored: DataFrame, heuristics: DataFrame) -> DataFrame:
    """Latest stored score per kind, else the heuristic one. ``stored`` has one row per repository and type."""
    kinds = ["security", "performance", "architectural"]
    wide = stored.filter(F.col("analysis_type").isin(kinds)).groupBy(REPO).pivot("analysis_type", kinds).agg(F.max("score"))
    names = dict(zip(kinds, ["security_score", "performance_score", "architecture_score"], strict=True))
    out = heuristics.join(wide, REPO, "left")
    return out.select(
        REPO,
        *[F.coalesce(F.col(k), F.col(v).cast("double")).alias(v) for k, v in names.items()],
        *[F.col(k).isNotNull().alias(f"{k}_stored") for k in kinds],
    )


def dashboard_scores(stats: DataFrame, timeline: DataFrame, commits: DataFrame, technologies: DataFrame) -> DataFrame:
    """Health, velocity and gauge scores per repository."""
    level, anti_flag = F.col("complexity_level"), F.coalesce("is_antipattern", F.lit(False))
    base = stats.groupBy(REPO).agg(
        F.count("*").alias("n"), F.count_if(anti_flag).alias("anti"), F.count_if(level == "advanced").alias("complex"), F.count_if(level == "simple").alias("plain")
    )
    periods = timeline.groupBy(REPO).agg(F.countDistinct("period").alias("periods"))
    n_commits = commits.groupBy(REPO).agg(F.count("*").alias("commits"))
    n_tech = technologies.groupBy(REPO).agg(F.count("*").alias("technologies"))
    out = base.join(periods, REPO, "left").join(n_commits, REPO, "left").join(n_tech, REPO, "left").fillna(0)
    n, anti, hard, plain = (F.col(c) for c in ("n", "anti", "complex", "plain"))
    low, cap = lambda x: F.greatest(F.lit(0), x), lambda x: F.least(F.lit(100), x)
    return out.select(
        REPO,
        F.floor((n - anti) / F.greatest(n, F.lit(1)) * 100 + 0.5).alias("health_score"),
        F.when(F.col("periods") > 0, F.col("commits") / F.col("periods")).otherwise(0.0).alias("velocity"),
        low(100 - anti * 15 - hard * 5 + plain * 2).alias("overall"),
        low(100 - anti * 20 - hard * 10).alias("maintainability"),
        cap(plain * 10 - hard * 5 + 50).alias("readability"),
        cap(n * 2 - anti * 10 + 60).alias("testability"),
        low(cap(90 - anti * 15)).alias("code_quality"),
        cap(n * 12).alias("pattern_diversity"),
        low(cap(85 - hard * 12)).alias("gauge_maintainability"),
        cap(F.col("periods") * 8 + 20).alias("evolution_score"),
        low(100 - anti * 25).alias("tech_debt"),
        cap(F.col("technologies") * 10 + 30).alias("modernization"),
        (n - anti - hard).alias("info_issues"),
    )


def technologies_by_category(technologies: DataFrame) -> DataFrame:
    """Technologies under the seven folded categories."""
    return technologies.withColumn("folded", fold_category(F.col("category")))


def tech_radar(technologies: DataFrame) -> DataFrame:
    """Count and use per repository and folded category, ``other`` left out."""
    return (
        technologies_by_category(technologies).filter(F.col("folded") != "other")
        .groupBy(REPO, "folded").agg(F.count("*").alias("count"), F.sum(F.coalesce("usage_count", F.lit(0))).alias("usage"))
    )


def tech_top(technologies: DataFrame, n: int = 15) -> DataFrame:
    """Most used technologies of each category of a repository; no use counts as one."""
    used = technologies_by_category(technologies).withColumn("usage", F.when(F.coalesce("usage_count", F.lit(0)) == 0, 1).otherwise(F.col("usage_count")))
    return top_n_per_key(used, [REPO, "folded"], [F.desc("usage"), F.col("name"), F.col("version"), F.col("category")], n, rank="position")


def tech_edges(technologies: DataFrame) -> DataFrame:
    """Edges from the project to its categories and from those to technologies."""
    folded = technologies_by_category(technologies)
    category = F.concat(F.lit("category-"), "folded")
    first = folded.select(REPO, F.lit("central").alias("source"), category.alias("target"))
    second = folded.select(REPO, category.alias("source"), F.col("name").alias("target"))
    return first.unionByName(second).distinct()


def heatmap(timeline: DataFrame, n: int = 8) -> DataFrame:
    """Dense pattern and period grid of the ``n`` most frequent patterns with intensity bands.

    Each repository's periods meet its at most ``n`` names, so the grid is no
    larger than what is drawn.
    """
    totals = timeline.groupBy(REPO, "pattern_name").agg(F.sum("occurrences").alias("total"))
    top = top_n_per_key(totals, [REPO], [F.desc("total"), F.col("pattern_name")], n).select(REPO, "pattern_name")
    grid = timeline.select(REPO, "period").distinct().join(top, REPO)
    cells = grid.join(timeline.select(REPO, "period", "pattern_name", "occurrences"), [REPO, "period", "pattern_name"], "left").fillna({"occurrences": 0})
    peak = cells.groupBy(REPO).agg(F.max("occurrences").alias("peak"))
    share = F.when(F.col("peak") > 0, F.try_divide(F.col("occurrences"), F.col("peak"))).otherwise(0.0)
    band = F.when(share == 0, 0).when(share < 0.3, 1).when(share < 0.6, 2).when(share < 0.8, 3).otherwise(4)
    return cells.join(peak, REPO).select(REPO, "period", "pattern_name", F.col("occurrences").alias("value"), share.alias("intensity"), band.alias("band"))


def word_weights(stats: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` most frequent names of each repository with a font size."""
    top = top_n_per_key(stats.filter("occurrences > 0"), [REPO], [F.desc("occurrences"), F.col("name")], n, rank="position")
    ends = top.groupBy(REPO).agg(F.min("occurrences").alias("low"), F.max("occurrences").alias("high"))
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1))
    size = F.greatest(F.lit(12.0), F.least(F.lit(48.0), F.lit(12) + (F.col("occurrences") - F.col("low")) / span * 36))
    return top.join(ends, REPO).select(REPO, F.replace("name", F.lit("_"), F.lit(" ")).alias("text"), "occurrences", size.alias("size"))


def complexity_groups(stats: DataFrame) -> DataFrame:
    """Patterns regrouped by name and use: simple, intermediate, advanced, expert."""
    name, n = F.lower("name"), F.col("occurrences")
    level = (
        F.when(contains_any(name, rules.EXPERT_WORDS) | (n > 20), "expert")
        .when(contains_any(name, rules.ADVANCED_WORDS) | (n > 10), "advanced")
        .when(contains_any(name, rules.INTERMEDIATE_WORDS) | (n > 5), "intermediate")
        .when(n <= 3, "simple")
        .otherwise(F.coalesce(non_empty("complexity_level"), F.lit("intermediate")))
    )
    known = F.when(level.isin("simple", "intermediate", "advanced", "expert"), level).otherwise("intermediate")
    return stats.groupBy(REPO, known.alias("complexity")).agg(F.count("*").alias("count"), F.sum("occurrences").alias("total_occurrences"))


def learning_progression(timeline: DataFrame, technologies: DataFrame, stats: DataFrame) -> DataFrame:
    """Skill, complexity, diversity and quality curves over a repository's periods."""
    points = timeline.groupBy(REPO, "period").agg(F.count("*").alias("names"), F.count_if(F.col("occurrences") > 5).alias("frequent"))
    n_tech = technologies.groupBy(REPO).agg(F.count("*").alias("technologies"))
    anti = stats.groupBy(REPO).agg(F.count_if("is_antipattern").alias("anti"))
    i = F.row_number().over(Window.partitionBy(REPO).orderBy("period")) - 1
    rows = points.withColumn("i", i).join(n_tech, REPO, "left").join(anti, REPO, "left").fillna({"technologies": 0, "anti": 0})
    cap = lambda x: F.least(F.lit(100), x)
    index = F.col("i")
    return rows.select(
        REPO, "period",
        cap(index * 8 + F.col("names") * 3 + 20).alias("skill_level"),
        cap(F.col("frequent") * 10 + index * 5 + 15).alias("pattern_complexity"),
        cap(F.col("technologies") * 2 + index * 6 + 10).alias("technical_diversity"),
        F.greatest(F.lit(10), cap(index * 3 - F.col("anti") * 5 + 80)).alias("code_quality"),
    )


def evolution_metrics(timeline: DataFrame, stats: DataFrame, commits: DataFrame) -> DataFrame:
    """Span, velocity, density and rate of change per repository. ``period`` is a date."""
    span = timeline.groupBy(REPO).agg(
        F.greatest(F.datediff(F.max("period"), F.min("period")), F.lit(1)).alias("timespan_days"), F.greatest(F.countDistinct("period"), F.lit(1)).alias("periods")
    )
    use = stats.groupBy(REPO).agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("patterns"))
    n_commits = commits.groupBy(REPO).agg(F.count("*").alias("commits"))
    out = span.join(use, REPO).join(n_commits, REPO, "left").withColumn("commits", F.greatest(F.coalesce("commits", F.lit(1)), F.lit(1)))
    velocity = F.when(F.col("periods") > 12, F.col("commits") / F.col("timespan_days") * 30).otherwise(F.col("commits") / F.col("periods"))
    return out.select(
        REPO, F.col("timespan_days").cast("long").alias("timespan_days"), velocity.alias("velocity"),
        (F.col("occurrences") / F.col("commits")).alias("pattern_density"), (F.col("patterns") / F.col("periods")).alias("evolution_rate"),
    )


def language_adoption(usage: DataFrame) -> DataFrame:
    """Per repository and language: periods present, first period, share of periods (``period, language`` rows)."""
    periods = usage.groupBy(REPO).agg(F.countDistinct("period").alias("periods"))
    per_language = usage.groupBy(REPO, "language").agg(F.countDistinct("period").alias("appearances"), F.min("period").alias("first_appearance"))
    return per_language.join(periods, REPO).withColumn("percentage", F.floor(F.col("appearances") / F.col("periods") * 100 + 0.5)).drop("periods")


def adoption_matrix(usage: DataFrame) -> DataFrame:
    """1 or 0 for each period and each language a repository ever uses."""
    present = usage.select(REPO, "period", "language").distinct()
    grid = present.select(REPO, "period").distinct().join(present.select(REPO, "language").distinct(), REPO)
    return grid.join(present.withColumn("present", F.lit(1)), [REPO, "period", "language"], "left").fillna({"present": 0})


def pattern_browser(stats: DataFrame, occ: DataFrame, term: str = "", category: str | None = None, examples: int = 3) -> DataFrame:
    """Patterns that fit a search, with group, first sighting and example files."""
    found = stats
    if term:
        found = found.filter(F.lower("name").contains(term.lower()) | F.lower(F.coalesce("category", F.lit(""))).contains(term.lower()))
    if category is not None:
        found = found.filter(F.col("category") == category)
    keys = [REPO, "pattern_id"]
    wanted = occ.join(found.select(*keys), keys, "left_semi")
    first = wanted.groupBy(*keys).agg(F.min("detected_at").alias("first_seen"))
    shown = top_n_per_key(wanted.select(*keys, "detected_at", "file_path"), keys, [F.col("detected_at"), F.col("file_path")], examples, rank="n")
    files = shown.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "file_path"))).alias("s"))
    return (
        found.join(first, keys).join(files, keys)
        .withColumn("group", F.coalesce(non_empty("category"), F.lit("Uncategorized")))
        .withColumn("examples", F.transform("s", lambda x: x["file_path"])).drop("s")
    )


def dashboard(scores: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Newest score per repository with its trend against the one before."""
    two = top_n_per_key(scores, [REPO], [F.desc("created_at"), F.desc("analysis_id")], 2, rank="n")
    wide = two.groupBy(REPO).agg(
        F.max(F.when(F.col("n") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("previous_score"),
        F.max(F.when(F.col("n") == 1, F.col("created_at"))).alias("last_analyzed"),
    )
    change = F.col("score") - F.col("previous_score")
    return wide.withColumn("trend", F.when(change > tolerance, "improving").when(change < -tolerance, "declining").otherwise("stable"))


def latest_analyses(analyses: DataFrame, model: str | None = None) -> DataFrame:
    """Newest record per repository and type of analysis, optionally of one model."""
    rows = analyses if model is None else analyses.filter(F.col("model_used") == model)
    return latest_per_key(rows, [REPO, "analysis_type"], ["created_at", "analysis_id"])


def last_results(analyses: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` records of each repository."""
    return top_n_per_key(analyses, [REPO], [F.desc("created_at"), F.desc("analysis_id")], n, rank="position")
