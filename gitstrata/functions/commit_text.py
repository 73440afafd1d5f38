"""Column expressions over commits, urls, scores and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gitstrata.functions.common import banded, contains_any, non_empty

# Words that give away the intent of a commit message.
FEATURE_WORDS = ["feat:", "feature:", "add:", "implement"]
BUGFIX_WORDS = ["fix:", "bug:", "issue:", "error"]
REFACTOR_WORDS = ["refactor:", "clean", "improve", "optimize"]
BREAKING_WORDS = ["breaking:", "break:", "major:", "!"]
# Path fragments of a change that may break callers.
BREAKING_PATHS = ["api/", "interface", "config", "schema", "migration", "breaking", "deprecated", "remove", "delete"]
# Message prefixes and address fragments.
MESSAGE_PREFIXES = ["feat:", "fix:", "refactor:", "docs:", "test:"]
FREE_MAIL = ["gmail.com", "outlook.com", "yahoo.com"]
COMPANY_MAIL = ["company.com", "corp.com", "org"]
GIT_HOSTS = ["github.com", "gitlab.com", "bitbucket.org"]
# Plural category to singular.
CATEGORY_SINGULAR = {
    "languages": "language",
    "frameworks": "framework",
    "libraries": "library",
    "tools": "tool",
    "databases": "database",
    "platforms": "platform",
}


def commit_intent(message: Column) -> Column:
    """feature, bugfix or refactoring (first that fits), else other."""
    text = F.lower(message)
    return (
        F.when(contains_any(text, FEATURE_WORDS), "feature")
        .when(contains_any(text, BUGFIX_WORDS), "bugfix")
        .when(contains_any(text, REFACTOR_WORDS), "refactoring")
        .otherwise("other")
    )


def breaking_message(message: Column) -> Column:
    return contains_any(F.lower(message), BREAKING_WORDS)


def breaking_path(path: Column) -> Column:
    return contains_any(F.lower(path), BREAKING_PATHS)


def refactor_shaped(additions: Column, deletions: Column) -> Column:
    """Both sides change by about the same amount."""
    balance = F.abs(additions - deletions) / F.greatest(additions + deletions, F.lit(1))
    return (additions > 0) & (deletions > 0) & (balance < 0.3)


def change_type(is_new: Column, is_deleted: Column, is_renamed: Column) -> Column:
    return F.when(is_new, "added").when(is_deleted, "deleted").when(is_renamed, "renamed").otherwise("modified")


def diff_additions(diff: Column) -> Column:
    return F.regexp_count(diff, F.lit("\n\\+")).cast("long")


def diff_deletions(diff: Column) -> Column:
    return F.regexp_count(diff, F.lit("\n-")).cast("long")


def message_quality(message: Column) -> Column:
    prefix = F.lit(False)
    for word in MESSAGE_PREFIXES:
        prefix = prefix | message.startswith(word)
    points = prefix.cast("int") + (F.length(message) > 20).cast("int") + message.rlike(r"^\p{Lu}").cast("int")
    return (
        F.when(non_empty(message).isNull(), "poor").when(points >= 2, "good").when(points == 1, "fair").otherwise("poor")
    )


def author_class(email: Column) -> Column:
    return (
        F.when(non_empty(email).isNull(), "unknown")
        .when(contains_any(email, FREE_MAIL), "intermediate")
        .when(contains_any(email, COMPANY_MAIL), "experienced")
        .otherwise("junior")
    )


def complexity_impact(change: Column) -> Column:
    return F.when(F.abs(change) > 50, "high").when(F.abs(change) > 20, "medium").otherwise("low")


def commit_risk(changed_lines: Column, files: Column, breaking: Column, impact: Column) -> Column:
    """Risk level from size, spread, breaking changes and complexity impact."""
    points = (
        F.when(changed_lines > 500, 3).when(changed_lines > 200, 2).when(changed_lines > 50, 1).otherwise(0)
        + F.when(files > 10, 2).when(files > 5, 1).otherwise(0)
        + F.when(breaking, 3).otherwise(0)
        + F.when(impact == "high", 2).when(impact == "medium", 1).otherwise(0)
    )
    return F.when(points >= 5, "high").when(points >= 3, "medium").otherwise("low")


def token_estimate(text: Column) -> Column:
    """About four characters to a token."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)


def grade(score: Column, scale: str = "percent") -> Column:
    """Letter grade of a score out of 100 or, for ``scale="unit"``, out of 1."""
    bands = [(90, "A"), (80, "B"), (70, "C"), (60, "D")] if scale == "percent" else [(0.9, "A"), (0.8, "B"), (0.7, "C"), (0.6, "D")]
    return banded(score, bands, "F")


def fold_category(category: Column) -> Column:
    """Plural to singular; kinds outside the known seven become ``other``."""
    name = F.lower(F.coalesce(category, F.lit("other")))
    singular = F.coalesce(F.create_map(*[F.lit(x) for pair in CATEGORY_SINGULAR.items() for x in pair])[name], name)
    return F.when(singular.isin(*CATEGORY_SINGULAR.values(), "other"), singular).otherwise("other")


def canonical(name: Column) -> Column:
    """Key form: lower case, letters and digits only."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def display_name(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def normalize_git_url(url: Column) -> Column:
    """One https form for every way to write a git url; NULL for other schemes."""
    text = F.trim(url)
    ssh = r"^git@([^:]+):(.+?)(\.git)?$"
    from_ssh = F.concat(F.lit("https://"), F.regexp_extract(text, ssh, 1), F.lit("/"), F.regexp_extract(text, ssh, 2), F.lit(".git"))
    plain = F.regexp_replace(text, r"^git://", "https://")
    full = F.when(plain.contains("://"), plain).otherwise(F.concat(F.lit("https://"), plain))
    form = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(.*)$"
    scheme, host, path, tail = [F.regexp_extract(full, form, i) for i in range(1, 5)]
    needs_git = contains_any(host, GIT_HOSTS) & ~path.endswith(".git")
    whole = F.concat(F.lower(scheme), F.lit("://"), host, path, F.when(needs_git, ".git").otherwise(""), tail)
    return F.when(text.rlike(ssh), from_ssh).when(F.lower(scheme).isin("http", "https"), whole)
