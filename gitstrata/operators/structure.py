"""Repository structure and architecture from paths and import lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.common import compact_list, contains_any
from gitstrata.functions.paths import depth, directory, suffix, top_directory
from gitstrata.rules import architecture as rules

REPO = "repository_id"


def directory_profile(files: DataFrame) -> DataFrame:
    """Files per top-level directory."""
    return files.groupBy(REPO, top_directory("path").alias("top_directory")).agg(F.count("*").alias("files"))


def depth_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(REPO, depth("path").alias("depth")).agg(F.count("*").alias("files"))


def depth_summary(files: DataFrame) -> DataFrame:
    """Deepest and mean depth, files and top-level directories per repository."""
    return files.groupBy(REPO).agg(
        F.max(depth("path")).alias("max_depth"),
        F.avg(depth("path")).alias("avg_depth"),
        F.count("*").alias("total_files"),
        F.countDistinct(top_directory("path")).alias("directory_count"),
    )


def architecture_style(files: DataFrame) -> DataFrame:
    """Best scoring style per repository; monolithic at 0.5 when nothing points anywhere.

    One aggregate of flags over paths; equal scores go to the later name.
    """
    path, top = F.lower("path"), F.lower(top_directory("path"))
    flags: dict[str, Column] = {}
    for style, words in rules.DIRECTORY_INDICATORS.items():
        for word in words:
            flags[f"dir_{style}_{word}"] = top.contains(word)
    for style, (_, kinds) in rules.FILE_PATTERNS.items():
        for kind, expressions in kinds.items():
            test = F.lit(False)
            for rx in expressions:
                # the search is unanchored, so leading and trailing wildcards add nothing
                test = test | F.col("path").rlike("(?i)" + rx.removeprefix(".*").removesuffix(".*"))
            flags[f"file_{style}_{kind}"] = test
    flags |= {
        "hint_docker": path.contains("docker"),
        "hint_orchestration": path.contains("kubernetes") | path.contains("k8s"),
        "hint_service": path.contains("service"),
        "hint_gateway": path.contains("gateway"),
        "hint_controller": path.contains("controller"),
        "hint_model": path.contains("model"),
        "hint_view": F.col("path").rlike(r"\.(?:html|jsx|vue|template)$"),
    }
    found = files.groupBy(REPO).agg(
        *[F.max(test.cast("int")).alias(name) for name, test in flags.items()], F.count_if(path.contains("api")).alias("api_files")
    )

    def total(names: list[str]) -> Column:
        out = F.lit(0)
        for name in names:
            out = out + F.col(name)
        return out

    services = total(["hint_docker", "hint_orchestration", "hint_service", "hint_gateway"]) + (F.col("api_files") > 2).cast("int") >= 2
    views = total(["hint_controller", "hint_model", "hint_view"]) >= 2
    scores = []
    for style, words in rules.DIRECTORY_INDICATORS.items():
        score = total([f"dir_{style}_{w}" for w in words]) / F.lit(float(len(words)))
        if style in rules.FILE_PATTERNS:
            needed, kinds = rules.FILE_PATTERNS[style]
            hits = total([f"file_{style}_{k}" for k in kinds])
            score = score + F.when(hits >= needed, hits / F.lit(float(len(kinds)))).otherwise(0.0)
        if style == "microservices":
            score = score + F.when(services, 0.5).otherwise(0.0)
        if style == "mvc":
            score = score + F.when(views, 0.3).otherwise(0.0)
        scores.append(F.struct(score.alias("score"), F.lit(style).alias("style")))
    best = F.array_max(F.array(*scores))
    return found.select(REPO, best.alias("best")).select(
        REPO,
        F.when(F.col("best.score") > 0, F.col("best.style")).otherwise("monolithic").alias("style"),
        F.when(F.col("best.score") > 0, F.least(F.lit(1.0), F.col("best.score"))).otherwise(0.5).alias("confidence"),
    )


def modularity(files: DataFrame) -> DataFrame:
    """One minus the normalised variance of files per directory; 0.3 for a single directory."""
    per_dir = files.groupBy(REPO, directory("path").alias("dir")).agg(F.count("*").alias("n"))
    stats = per_dir.groupBy(REPO).agg(F.count("*").alias("dirs"), F.sum("n").alias("files"), F.var_pop("n").alias("variance"))
    worst = F.col("files") * F.col("files") / F.col("dirs")
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("variance") / worst)
    return stats.select(REPO, F.when(F.col("dirs") == 1, 0.3).otherwise(score).alias("modularity"))


def coupling(files: DataFrame) -> DataFrame:
    """Mean import lines per file, twenty or more being the most."""
    lines = F.regexp_count("content", F.lit(rules.IMPORT_LINE))
    return files.groupBy(REPO).agg(F.least(F.lit(1.0), F.avg(lines) / 20.0).alias("coupling"))


def cohesion(files: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Mean over directories of one over its suffixes, plus a tenth per design pattern."""
    per_dir = files.groupBy(REPO, directory("path").alias("dir")).agg(F.countDistinct(suffix("path")).alias("kinds"))
    base = per_dir.groupBy(REPO).agg(F.avg(F.lit(1.0) / F.col("kinds")).alias("base"))
    if patterns is None:
        return base.select(REPO, F.least(F.lit(1.0), F.col("base")).alias("cohesion"))
    bonus = patterns.groupBy(REPO).agg((F.countDistinct("pattern") * F.lit(0.1)).alias("bonus"))
    return base.join(bonus, REPO, "left").select(
        REPO, F.least(F.lit(1.0), F.col("base") + F.coalesce("bonus", F.lit(0.0))).alias("cohesion")
    )


def structure_complexity(files: DataFrame) -> DataFrame:
    by_depth = F.least(F.lit(1.0), F.avg(depth("path")) / 5.0)
    by_size = F.least(F.lit(1.0), F.count("*") / 100.0)
    return files.groupBy(REPO).agg(((by_depth + by_size) / 2).alias("complexity"))


def architecture_quality(files: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Modularity, coupling, cohesion, complexity and their overall score."""
    paths = files.select(REPO, "path")
    out = modularity(paths).join(coupling(files), REPO).join(cohesion(paths, patterns), REPO).join(structure_complexity(paths), REPO)
    overall = (F.col("modularity") + (1 - F.col("coupling")) + F.col("cohesion") + (1 - F.col("complexity"))) / 4
    return out.withColumn("overall_score", overall)


def import_edges(files: DataFrame) -> DataFrame:
    """File to imported text for imports inside the project."""
    text = F.col("content")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    package = F.replace(folder, F.lit("/"), F.lit("."))
    same_package = F.concat(F.lit(r"import\s+\Q"), package, F.lit(r"\E\..*?;"))
    found = F.concat(
        F.regexp_extract_all(text, F.lit(rules.PYTHON_LOCAL), F.lit(0)),
        F.regexp_extract_all(text, F.lit(rules.SCRIPT_LOCAL), F.lit(0)),
        F.regexp_extract_all(text, same_package, F.lit(0)),
    )
    return files.select(REPO, "path", F.explode(found).alias("import_text"))


def layers(files: DataFrame) -> DataFrame:
    """Layers that the top-level directories belong to, with directories and files."""
    profile = directory_profile(files)
    names = F.lower("top_directory")
    hits = compact_list(*[(contains_any(names, words), layer) for layer, words in rules.LAYERS.items()])
    per_layer = profile.withColumn("layer", F.explode(hits)).groupBy(REPO, "layer").agg(
        F.count("*").alias("directories"), F.sum("files").alias("file_count")
    )
    return per_layer


def layer_summary(files: DataFrame) -> DataFrame:
    counted = layers(files).groupBy(REPO).agg(F.count("*").alias("layer_count"))
    out = files.select(REPO).distinct().join(counted, REPO, "left").fillna({"layer_count": 0})
    return out.withColumn("is_layered", F.col("layer_count") >= 2)


def architecture_recommendations(
    style: DataFrame, quality: DataFrame, patterns: DataFrame, layered: DataFrame, n: int = 5
) -> DataFrame:
    """The first ``n`` recommendations that apply."""
    present = patterns.groupBy(REPO).agg(
        *[F.max((F.col("pattern") == p).cast("int")).alias(p) for p in ("singleton", "repository", "dependency_injection")]
    )
    every = style.join(quality, REPO).join(layered, REPO).join(present, REPO, "left")
    lacks = lambda p: F.coalesce(F.col(p), F.lit(0)) == 0
    items = compact_list(
        (F.col("modularity") < 0.6, "improve modularity"),
        (F.col("coupling") > 0.7, "reduce coupling"),
        (F.col("cohesion") < 0.5, "improve cohesion"),
        (F.col("complexity") > 0.7, "simplify the structure"),
        (lacks("singleton") & (F.col("style") != "microservices"), "consider singleton"),
        (lacks("repository"), "consider repository"),
        (lacks("dependency_injection"), "consider dependency injection"),
        (F.col("style") == "monolithic", "split the monolith into modules"),
        (F.col("style") == "microservices", "check service boundaries"),
        (~F.col("is_layered"), "consider layers"),
    )
    return every.select(REPO, F.slice(items, 1, n).alias("recommendations"))
