"""Rule scans of source text.

Two steps, no shuffle. First every rule is tried on each file as a plain boolean,
which yields the few (file, rule) pairs that match at all. Then only those pairs
locate their matches, with the expression taken from a broadcast rule table (the
table is fixed and has at most a few hundred rows). Texts are scanned whole and
stay in the task that read them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gitstrata.functions.common import contains_any, joined, top_n_per_key
from gitstrata.functions.paths import file_name
from gitstrata.functions.regex import folded, guarded, java_regex
from gitstrata.rules import patterns as pattern_rules
from gitstrata.rules import performance as perf_rules
from gitstrata.rules import security as sec_rules


@dataclass(frozen=True)
class Rule:
    """One expression of one rule. ``confidence=None`` means: judged by the line."""

    family: str
    name: str
    regex: str
    severity: str = "info"
    category: str = ""
    cwe: str | None = None
    owasp: str | None = None
    confidence: float | None = None
    languages: tuple[str, ...] = ()
    ignore_case: bool = False
    auto_fixable: bool = False
    id_prefix: str = ""
    level: str | None = None
    number: int = 0


def numbered(rules: Iterable[Rule]) -> list[Rule]:
    return [replace(rule, number=i) for i, rule in enumerate(rules)]


def security_rules() -> list[Rule]:
    out = [
        Rule("security", name, rx, severity, category, cwe, owasp, auto_fixable=name in sec_rules.AUTO_FIXABLE)
        for name, severity, category, cwe, owasp, expressions in sec_rules.SECURITY
        for rx in expressions
    ]
    out += [
        Rule("crypto", name, rx, severity, "cryptography", "CWE-327", sec_rules.CRYPTO, 0.8)
        for name, severity, expressions in sec_rules.CRYPTOGRAPHY
        for rx in expressions
    ]
    out += [
        Rule("language", name, rx, severity, category, cwe, owasp, confidence, tuple(langs.split()))
        for name, langs, severity, category, cwe, owasp, confidence, expressions in sec_rules.BY_LANGUAGE
        for rx in expressions
    ]
    return numbered(out)


def performance_rules() -> list[Rule]:
    out = [
        Rule("performance", name, rx, severity, category, ignore_case=True, auto_fixable=name in perf_rules.AUTO_FIXABLE)
        for name, severity, category, expressions in perf_rules.PERFORMANCE
        for rx in expressions
    ]
    out += [
        Rule("complexity", name, rx, severity, "algorithmic", confidence=0.8, ignore_case=True, id_prefix="complexity_", level=order)
        for name, severity, expressions, order in perf_rules.COMPLEXITY
        for rx in expressions
    ]
    for family, table, category, confidence in (
        ("memory", perf_rules.MEMORY, "memory", 0.7),
        ("concurrency", perf_rules.CONCURRENCY, "concurrency", 0.6),
    ):
        out += [
            Rule(family, name, rx, severity, category, confidence=confidence, ignore_case=True, id_prefix=f"{family}_")
            for name, severity, expressions in table
            for rx in expressions
        ]
    out += [
        Rule("language", name, rx, severity, category, None, None, confidence, tuple(langs.split()), False, fixable)
        for name, langs, severity, category, confidence, fixable, expressions in perf_rules.BY_LANGUAGE
        for rx in expressions
    ]
    return numbered(out)


def line_pattern_rules() -> list[Rule]:
    """Design, quality, performance, security, modern and antipattern line patterns."""
    out = []
    for family, group, name, level, expressions in pattern_rules.LINE_PATTERNS:
        category = f"{family}_{group}" if group else family
        for rx in expressions:
            out.append(
                Rule(family, name, rx, severity=level, category=category, confidence=pattern_rules.LINE_FAMILIES[family], ignore_case=True, level=level)
            )
    return numbered(out)


def user_rule(name: str, text: str, complexity: str = "intermediate", confidence: float = 0.8, expression: bool = False, **kwargs: object) -> Rule:
    """A rule of one's own: the literal ``text`` anywhere in a file, or an ``expression`` (Python's) that is checked here.

    Further settings are those of a ``Rule``: ``languages``, ``ignore_case``, ``severity``, ``category``.
    """
    if expression:
        re.compile(text)
    return Rule("user", name, text if expression else re.escape(text), confidence=confidence, level=complexity, **kwargs)


_RULE_COLUMNS = (
    "number int, family string, name string, regex string, severity string, category string, cwe string, owasp string, "
    "fixed_confidence double, auto_fixable boolean, id_prefix string, level string"
)


def _rule_table(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    rows = [
        (r.number, r.family, r.name, java_regex(r.regex, r.ignore_case), r.severity, r.category, r.cwe, r.owasp, r.confidence,
         r.auto_fixable, r.id_prefix, r.level)
        for r in rules
    ]
    return F.broadcast(files.sparkSession.createDataFrame(rows, _RULE_COLUMNS))


def _matching_pairs(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(file, rule) pairs where the rule matches somewhere and its language fits."""
    content, lower, language = F.col("content"), F.col("_folded"), F.lower(F.col("language"))
    tests = []
    for rule in rules:
        test = guarded(content, lower, rule.regex, rule.ignore_case)
        if rule.languages:
            test = language.isin(*rule.languages) & test
        tests.append(F.when(test, F.lit(rule.number)))
    numbers = F.array_compact(F.array(*tests))
    pairs = files.withColumn("_folded", folded(content)).withColumn("number", F.explode(numbers)).drop("_folded")
    return pairs.join(_rule_table(files, rules), "number")


#: Put before every match; not a character of any text, and blanked where a broken text has it.
MARK = "\uffff"


def matched_lines(content: Column, regex: Column) -> Column:
    """``(line_number, text)`` of every line in which a match begins; ``text`` has ``MARK`` before each of them.

    One pass: the marks go in where the expression matches the whole text, then the
    text is cut at its line breaks.
    """
    marked = F.regexp_replace(F.replace(content, F.lit(MARK), F.lit(" ")), regex, F.lit(MARK + "$0"))
    lines = F.transform(F.split(marked, "\n", -1), lambda text, i: F.struct((i + 1).alias("line_number"), text.alias("text")))
    return F.filter(lines, lambda line: line["text"].contains(MARK))


def security_confidence(name: Column, line: Column) -> Column:
    text = F.lower(line)
    score = (
        F.lit(0.7)
        + F.when(text.contains("password") & name.contains("hardcoded"), 0.2).otherwise(0.0)
        + F.when(text.contains("admin") & name.contains("auth"), 0.2).otherwise(0.0)
        + F.when(contains_any(text, ["secret", "key", "token"]), 0.1).otherwise(0.0)
        - F.when(line.rlike(r"^\s*(?:#|//|/\*|\*)"), 0.3).otherwise(0.0)
        - F.when(line.rlike(r"^\s*[\"']"), 0.2).otherwise(0.0)
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), score))


def performance_confidence(name: Column, line: Column) -> Column:
    text = F.lower(line)
    score = (
        F.lit(0.7)
        + F.when(text.contains("for") & name.contains("loop"), 0.2).otherwise(0.0)
        + F.when(text.contains("query") & name.contains("database"), 0.2).otherwise(0.0)
        + F.when(text.contains("async") & name.contains("blocking"), 0.1).otherwise(0.0)
        - F.when(line.rlike(r"^\s*(?:#|//|/\*|\*)"), 0.4).otherwise(0.0)
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), score))


def scan(files: DataFrame, rules: Sequence[Rule], kind: str = "security", dedupe: bool = False) -> DataFrame:
    """Every match of every rule: ``repository_id, path, name, line_number, snippet, confidence …``.

    Two expressions of one rule on one line give two findings with one id;
    ``dedupe=True`` keeps the first of them.
    """
    rules = numbered(rules)
    pairs = _matching_pairs(files.select("repository_id", "path", "content", "language"), rules)
    located = pairs.withColumn("hit", F.explode(matched_lines(F.col("content"), F.col("regex")))).drop("content", "regex")
    line = F.replace("hit.text", F.lit(MARK), F.lit(""))
    matches = F.length("hit.text") - F.length(line)
    judged = performance_confidence if kind == "performance" else security_confidence
    name, number = F.col("name"), F.col("line_number")
    if kind == "performance":
        key = F.concat("id_prefix", name, F.lit("_"), "path", F.lit("_"), number.cast("string"))
    else:
        key = F.substring(F.md5(F.concat_ws(":", name, "path", number.cast("string"))), 1, 12)
    findings = (
        located.select("*", F.col("hit.line_number").alias("line_number"), line.alias("line"), F.explode(F.sequence(F.lit(1), matches)).alias("nth"))
        .select(
            key.alias("finding_id"), "repository_id", "path", "line_number", F.col("number").alias("rule_number"), "family", "name",
            "severity", "category", "cwe", "owasp", "level",
            F.trim(F.col("line")).alias("snippet"),
            F.coalesce("fixed_confidence", judged(name, F.col("line"))).alias("confidence"), "auto_fixable",
        )
    )
    return first_per_id(findings) if dedupe else findings


def first_per_id(findings: DataFrame) -> DataFrame:
    """One finding per id: that of the first expression."""
    rest = [c for c in findings.columns if c != "finding_id"]
    kept = findings.groupBy("finding_id").agg(F.min_by(F.struct(*rest), F.struct("rule_number", "path", "line_number")).alias("r"))
    return kept.select("finding_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def with_fix(findings: DataFrame) -> DataFrame:
    """Adds the impact word and, where there is one, the text of a fix."""
    impact = F.lit("medium")
    for severity, word in perf_rules.IMPACT.items():
        impact = F.when(F.col("severity") == severity, word).otherwise(impact)
    fix = F.lit(None).cast("string")
    for name, text in sec_rules.FIXES.items():
        fix = F.when(F.col("name") == name, text).otherwise(fix)
    return findings.withColumn("estimated_impact", impact).withColumn("fix_suggestion", fix)


def scan_lines(files: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Lines that match a line pattern, tried one line at a time.

    A pattern that matches a line also matches the whole text, so the file-wide
    test prunes the pairs before any line is looked at.
    """
    rules = numbered(rules if rules is not None else line_pattern_rules())
    lines = F.transform(F.split("content", "\n"), lambda text, i: F.struct((i + 1).alias("line_number"), text.alias("text")))
    pairs = _matching_pairs(files.select("repository_id", "path", "content", "language"), rules)
    # regexp_instr keeps the expression compiled from line to line, regexp_like does not.
    hits = pairs.withColumn("hit", F.explode(F.filter(lines, lambda x: F.regexp_instr(x["text"], F.col("regex")) > 0)))
    return hits.select(
        "repository_id", F.col("path").alias("file_path"), F.col("number").alias("rule_number"), "family",
        F.initcap(F.replace("name", F.lit("_"), F.lit(" "))).alias("pattern_name"), "category",
        F.col("fixed_confidence").alias("confidence"), F.col("hit.line_number").alias("line_number"),
        F.substring(F.trim(F.col("hit.text")), 1, 100).alias("snippet"), "severity",
    )


def dedupe_matches(matches: DataFrame) -> DataFrame:
    """One match per repository, pattern, file and line: the most confident, then the first rule."""
    keys = ["repository_id", "pattern_name", "file_path", "line_number"]
    rest = [c for c in matches.columns if c not in keys]
    kept = matches.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-F.col("confidence"), "rule_number")).alias("r"))
    return kept.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def design_evidence(files: DataFrame) -> DataFrame:
    """Per file and design pattern: share of the language's expressions that match."""
    content, lower, language = F.col("content"), F.col("_folded"), F.lower(F.col("language"))
    rows = []
    for pattern, lang, expressions in pattern_rules.DESIGN_EVIDENCE:
        matched = F.array_compact(F.array(*[F.when(guarded(content, lower, rx, True), F.lit(rx)) for rx in expressions]))
        rows.append(F.when(language == lang, F.struct(F.lit(pattern).alias("pattern"), F.lit(len(expressions)).alias("rules"), matched.alias("evidence"))))
    texts = files.withColumn("_folded", folded(content))
    found = texts.select("repository_id", "path", F.explode(F.array_compact(F.array(*rows))).alias("e"))
    return found.filter(F.size("e.evidence") > 0).select(
        "repository_id", "path", "e.pattern", (F.size("e.evidence") / F.col("e.rules")).alias("confidence"), "e.evidence"
    )


def consolidate(evidence: DataFrame) -> DataFrame:
    """Per repository and pattern: mean confidence, all evidence, number of files.

    Distinct evidence lists are as few as the subsets of a pattern's expressions.
    """
    return evidence.groupBy("repository_id", "pattern").agg(
        F.least(F.lit(1.0), F.avg("confidence")).alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"),
        F.countDistinct("path").alias("files"),
    )


def technology_evidence(files: DataFrame) -> DataFrame:
    """Per file and technology: 0.3 per matching expression, at most 1."""
    content, lower = F.col("content"), F.col("_folded")
    rows = []
    for category, technology, expressions in pattern_rules.TECHNOLOGY_EVIDENCE:
        matched = F.array_compact(F.array(*[F.when(guarded(content, lower, rx, True), F.lit(rx)) for rx in expressions]))
        rows.append(F.struct(F.lit(category).alias("category"), F.lit(technology).alias("name"), matched.alias("evidence")))
    texts = files.withColumn("_folded", folded(content))
    found = texts.select("repository_id", "path", F.explode(F.filter(F.array(*rows), lambda r: F.size(r["evidence"]) > 0)).alias("e"))
    return found.select(
        "repository_id", "path", "e.category", "e.name",
        F.least(F.lit(1.0), F.size("e.evidence") * F.lit(0.3)).alias("confidence"), F.slice("e.evidence", 1, 3).alias("evidence"),
    )


def technologies_from_paths(files: DataFrame) -> DataFrame:
    """Technologies that a file name or, in a subdirectory, a part of the path gives away.

    The path test runs over a literal list of 15 fragments inside the row, so no
    nested-loop join is planned.
    """
    spark = files.sparkSession
    config = F.broadcast(spark.createDataFrame(pattern_rules.CONFIG_FILES, "key string, name string, category string"))
    deploy = F.broadcast(spark.createDataFrame(pattern_rules.DEPLOYMENT_FILES, "key string, name string, category string"))
    fragments = F.array(*[F.lit(row[0]) for row in pattern_rules.DEPLOYMENT_FILES])
    base = files.select("repository_id", "path", F.lower(file_name("path")).alias("key"))
    by_name = base.join(config, "key")
    inside = F.filter(fragments, lambda f: F.lower("path").contains(f))
    keys = (
        F.when(F.array_contains(fragments, F.col("key")), F.array("key"))
        .when(F.col("path").contains("/"), inside)
        .otherwise(F.array().cast("array<string>"))
    )
    by_path = base.select("repository_id", "path", F.explode(keys).alias("key")).join(deploy, "key")
    return by_name.unionByName(by_path).select("repository_id", "path", "name", "category", F.lit(1.0).alias("confidence"))


def dedupe_technologies(found: DataFrame) -> DataFrame:
    """One row per repository, technology and category: the most confident."""
    keys = ["repository_id", "name", "category"]
    return found.groupBy(*keys).agg(
        F.max("confidence").alias("confidence"), F.min_by("path", F.struct(-F.col("confidence"), "path")).alias("path")
    )


def version_key(version: Column) -> Column:
    """Numeric parts of a version as an array, which compares part by part."""
    number = F.regexp_extract(version, r"(\d+(?:\.\d+)*)", 1)
    return F.when(number != "", F.transform(F.split(number, r"\."), lambda part: part.try_cast("long")))


def vulnerable_dependencies(deps: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    """Dependencies whose version lies below the bound of an advisory."""
    if advisories is None:
        advisories = F.broadcast(
            deps.sparkSession.createDataFrame(sec_rules.ADVISORIES, "ecosystem string, package string, below string, cve string")
        )
    return deps.join(advisories, ["ecosystem", "package"]).filter(version_key(F.col("version")) < version_key(F.col("below")))


def vulnerable_ranges(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies whose version lies in a range of an advisory: ``ecosystem, package, introduced, fixed, cve``.

    A range holds ``introduced`` (NULL: from the first version on) and ends before ``fixed`` (NULL: has no end). A version
    without a number lies in no range. A package's versions are few however many manifests name them, so each distinct version
    meets the package's ranges once, by places on a line of all its versions and bounds: the first and the last version inside a
    range are looked up there, and versions are found by the blocks of places that a range covers. Advisories with equal bounds
    are one range until then. Manifests then meet only the versions that are hit; the result has a row for each manifest's
    dependency and advisory, so count equal dependencies first where only their number matters.
    """
    key = ["ecosystem", "package"]
    rows = deps.withColumn("_version", version_key(F.col("version")))
    # Each version and each bound once, in order; a bound stands before an equal version.
    versions = rows.filter("_version IS NOT NULL").select(*key, F.col("_version").alias("at"), F.lit(1).alias("side")).distinct()
    own = advisories.select(*key, version_key(F.col("introduced")).alias("low"), version_key(F.col("fixed")).alias("high"), "introduced", "fixed", "cve")
    # No version has a part below zero.
    own = own.withColumn("_range", F.struct(*[F.coalesce(c, F.array(F.lit(-1).cast("long"))).alias(c) for c in ("low", "high")]))
    bounds = own.select(*key, F.explode(F.array("low", "high")).alias("at"), F.lit(0).alias("side")).filter("at IS NOT NULL").distinct()
    line = versions.unionByName(bounds.join(versions.select(*key).distinct(), key, "left_semi"))
    order = Window.partitionBy(*key).orderBy("at", "side")
    line = line.withColumn("place", F.sum("side").over(order)).withColumn("place", F.when(F.col("side") == 1, F.col("place") - 1).otherwise(F.col("place")))
    placed = line.filter("side = 1").select(*key, "at", "place")
    known = line.filter("side = 0").select(*key, "at", "place")
    first, last = (known.select(*key, F.col("at").alias(a), F.col("place").alias(b)) for a, b in (("low", "first"), ("high", "last")))
    # Equal bounds are one range, however many advisories have them.
    ranges = own.select(*key, "low", "high", "_range").distinct().join(first, [*key, "low"], "left").join(last, [*key, "high"], "left")
    ends = placed.groupBy(*key).agg(F.max("place").alias("top"))
    ranges = ranges.join(ends, key).select(
        *key, "_range", F.coalesce("first", F.lit(0)).alias("first"),
        F.coalesce(F.col("last") - 1, F.col("top")).alias("last"), F.sqrt(F.col("top") + 1).cast("long").alias("width"),
    ).filter("first <= last")
    # Blocks of about the root of the number of versions: a range covers few, and a version lies in one.
    block = F.floor(F.col("place") / F.col("width"))
    placed = placed.join(ends, key).withColumn("width", F.sqrt(F.col("top") + 1).cast("long")).withColumn("block", block)
    covered = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / F.col("width")), F.floor(F.col("last") / F.col("width")))))
    hits = placed.select(*key, "at", "place", "block").join(covered.drop("width"), [*key, "block"]).filter("place BETWEEN first AND last")
    hits = hits.select(*key, F.col("at").alias("_version"), "_range")
    found = rows.join(hits, [*key, "_version"]).drop("_version")
    # This join makes many rows of few: the parts are fixed, so that small sides are not put together into one task.
    parts = 8 * deps.sparkSession.sparkContext.defaultParallelism
    found, own = (side.repartition(parts, *key, "_range") for side in (found, own.select(*key, "_range", "introduced", "fixed", "cve")))
    return found.join(own, [*key, "_range"]).drop("_range")


def _severity_weight() -> Column:
    out = F.lit(1)
    for severity, weight in sec_rules.SEVERITY_WEIGHTS.items():
        out = F.when(F.col("severity") == severity, weight).otherwise(out)
    return out


def security_report(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Per repository: score, risk level and counts by severity and category.

    A repository without findings scores 100 at low risk.
    """
    counts = [F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in sec_rules.SEVERITIES]
    counts += [F.count_if(F.col("category") == c).alias(f"category_{c}") for c in sec_rules.CATEGORIES]
    sums = findings.groupBy("repository_id").agg(
        F.count("*").alias("total_vulnerabilities"), F.sum(_severity_weight()).alias("penalty"), F.count_if("auto_fixable").alias("auto_fixable_count"), *counts
    )
    critical, high, medium = F.col("severity_critical"), F.col("severity_high"), F.col("severity_medium")
    risk = F.when(critical > 0, "critical").when(high > 2, "high").when((high > 0) | (medium > 3), "medium").otherwise("low")
    return (
        files.select("repository_id").distinct().join(sums, "repository_id", "left").fillna(0)
        .withColumn("overall_score", F.greatest(F.lit(0), 100 - F.col("penalty")))
        .withColumn("risk_level", risk).drop("penalty")
    )


def owasp_coverage(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("owasp").isNotNull()).groupBy("repository_id", "owasp").agg(F.count("*").alias("findings"))


def performance_metrics(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Per repository: overall and per-category scores; 95 each when nothing was found."""
    weight = _severity_weight()
    scored = ["algorithmic", "memory", "io", "concurrency", "resource_management"]
    penalties = [F.sum(F.when(F.col("category") == c, weight).otherwise(0)).alias(f"penalty_{c}") for c in scored]
    sums = findings.groupBy("repository_id").agg(
        F.count("*").alias("total_issues"), F.sum(weight).alias("penalty"), *penalties,
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium")],
    )
    joined_up = files.select("repository_id").distinct().join(sums, "repository_id", "left").fillna(0)
    none = F.col("total_issues") == 0

    def score(column: str) -> Column:
        return F.when(none, 95.0).otherwise(F.greatest(F.lit(0.0), F.lit(100.0) - F.col(column)))

    impact = (
        F.when((F.col("critical") > 0) | (F.col("high") > 2), "high").when((F.col("high") > 0) | (F.col("medium") > 3), "medium").otherwise("low")
    )
    return joined_up.select(
        "repository_id", "total_issues", F.col("critical").alias("critical_issues"), F.col("high").alias("high_priority_issues"),
        score("penalty").alias("overall_score"), *[score(f"penalty_{c}").alias(f"{c}_score") for c in scored], impact.alias("estimated_impact"),
    )


def performance_counts(findings: DataFrame) -> DataFrame:
    """Per repository: issues by category and by severity, zeros included."""
    return findings.groupBy("repository_id").agg(
        *[F.count_if(F.col("category") == c).alias(f"category_{c}") for c in perf_rules.CATEGORIES],
        *[F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in sec_rules.SEVERITIES],
        F.count_if("auto_fixable").alias("auto_fixable_issues"),
    )


def top_issues(findings: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` gravest findings per repository, then by file, line and rule."""
    order = [F.desc("weight"), F.col("path"), F.col("line_number"), F.col("rule_number"), F.col("snippet")]
    return top_n_per_key(findings.withColumn("weight", _severity_weight()), ["repository_id"], order, n, rank="position")


def evidence_text(df: DataFrame) -> DataFrame:
    return df.withColumn("evidence", joined("evidence"))
