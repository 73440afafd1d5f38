"""Text measures of one file as column expressions.

``(?U)`` gives Java's character classes the Unicode meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.common import banded, compact_list
from gitstrata.functions.regex import guarded_count

# Tokens that open another path, in any case.
DECISION_TOKENS = r"(?iU)\b(?:if|else|while|for|switch|case|catch|throw|return)\b|&&|\|\||\?|:"
NESTING_OPENS = r"(?U)^\s*\b(?:if|while|for|switch|catch)\b"
NESTING_STAYS = r"(?U)^\s*\b(?:else|elif|case)\b"
NESTING_CLOSES = r"(?U)^\s*\}"
FUNCTION_HEADER = r"(?U)function\s+\w+\s*\([^)]*\)"
PARENTHESES = r"\([^)]*\)"
VARIABLE = r"(?U)\b(?:var|let|const)\s+\w+"
FUNCTION_DOC = r'(?U)def\s+\w+\s*\([^)]*\):\s*\n\s*""".*"""'
CLASS_DOC = r'(?U)class\s+\w+\s*\([^)]*\):\s*\n\s*""".*"""'
COMMENT_LINE = r"^\s*(?://|/\*|\*|#)"
# Each match counts once, each bad practice twice.
NAMING = [
    r"function\s+[a-z][a-zA-Z0-9]*\s*\(",
    r"class\s+[A-Z][a-zA-Z0-9]*",
    r"const\s+[A-Z_][A-Z0-9_]*\s*=",
    r"var\s+[a-z][a-zA-Z0-9]*",
]
BAD_PRACTICES = [r"(?U)var\s+\w+\s*=", r"==\s+", r"eval\s*\(", r"with\s*\(", r"document\.write\s*\("]


def lines_of(content: Column) -> Column:
    return F.split(content, "\n")


def count_lines(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda line: line.rlike(pattern))).cast("long")


def count(content: Column, pattern: str) -> Column:
    return guarded_count(content, pattern)


def cyclomatic(content: Column) -> Column:
    # these tokens are in nearly every text, so nothing is gained by a guard
    return (F.regexp_count(content, F.lit(DECISION_TOKENS)) + 1).cast("double")


def max_nesting(content: Column) -> Column:
    """Deepest level of a counter that steps up on branch lines and down on closing braces.

    A fold over the lines of one text: sequential inside the row, native to Spark.
    """

    def step(state: Column, line: Column) -> Column:
        up = state["level"] + 1
        down = F.greatest(state["level"] - 1, F.lit(0))
        opens, stays, closes = line.rlike(NESTING_OPENS), line.rlike(NESTING_STAYS), line.rlike(NESTING_CLOSES)
        level = F.when(opens, up).when(stays, state["level"]).when(closes, down).otherwise(state["level"])
        deepest = F.when(opens, F.greatest(state["deepest"], up)).otherwise(state["deepest"])
        return F.struct(level.alias("level"), deepest.alias("deepest"))

    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("deepest"))
    return F.aggregate(lines_of(content), start, step)["deepest"]


def lines_per_function(content: Column) -> Column:
    functions = count(content, FUNCTION_HEADER)
    return F.when(functions > 0, F.size(lines_of(content)) / functions).otherwise(0.0)


def mean_parameters(content: Column) -> Column:
    """Mean number of words inside the parentheses of the text."""
    groups = F.regexp_extract_all(content, F.lit(PARENTHESES), F.lit(0))
    words = F.aggregate(groups, F.lit(0), lambda acc, g: acc + F.regexp_count(g, F.lit(r"(?U)\w+")))
    return F.when(F.size(groups) > 0, words / F.size(groups)).otherwise(0.0)


def variables(content: Column) -> Column:
    return count(content, VARIABLE)


def documentation_coverage(content: Column) -> Column:
    lines = lines_of(content)
    code = F.size(F.filter(lines, lambda line: line.rlike(r"\S") & ~line.rlike(r"^\s*//")))
    documented = count(content, FUNCTION_DOC) * 5 + count(content, CLASS_DOC) * 10 + count_lines(lines, COMMENT_LINE)
    return F.when(code > 0, F.least(F.lit(100.0), documented / code * 100)).otherwise(0.0)


def style_score(content: Column) -> Column:
    lines = lines_of(content)
    total = count_lines(lines, r"\S")
    violations = count_lines(lines, r"^\s\S")
    for pattern in NAMING:
        violations = violations + count(content, pattern)
    for pattern in BAD_PRACTICES:
        violations = violations + count(content, pattern) * 2
    return F.when(total > 0, F.greatest(F.lit(0.0), F.lit(100.0) - violations / total * 100)).otherwise(0.0)


def maintainability(cyclo: Column, documentation: Column, style: Column) -> Column:
    mixed = F.greatest(F.lit(0.0), F.lit(100) - cyclo * 5) * 0.4 + documentation * 0.3 + style * 0.3
    return F.least(F.lit(100.0), mixed)


def testability(function_lines: Column, cyclo: Column, parameters: Column) -> Column:
    """Mean of the factors that apply; no function header means no size factor."""
    size = F.when(function_lines < 20, 90).when(function_lines < 50, 70).otherwise(50)
    branching = F.when(cyclo < 5, 90).when(cyclo < 10, 70).when(cyclo < 20, 50).otherwise(30)
    breadth = F.when(parameters < 3, 90).when(parameters < 6, 70).otherwise(50)
    return F.when(function_lines > 0, (size + branching + breadth) / 3).otherwise((branching + breadth) / 2)


def score_complexity(cyclo: Column) -> Column:
    return (
        F.when(cyclo <= 5, 90.0).when(cyclo <= 10, 70.0).when(cyclo <= 20, 50.0).otherwise(F.greatest(F.lit(0.0), F.lit(100) - cyclo * 2))
    )


def _texts(*items: str) -> Column:
    return F.array(*map(F.lit, items))


def complexity_advice(cyclo: Column) -> Column:
    return (
        F.when(cyclo <= 5, _texts("keep complexity low", "keep current practice"))
        .when(cyclo <= 10, _texts("split complex functions", "extract helpers"))
        .when(cyclo <= 20, _texts("refactor into smaller functions", "use patterns against branching", "use strategy or command"))
        .otherwise(_texts("refactor now", "split into many functions", "use patterns widely", "rethink the architecture"))
    )


def documentation_advice(coverage: Column) -> Column:
    return (
        F.when(coverage >= 80, _texts("keep documenting"))
        .when(coverage >= 60, _texts("document complex functions", "improve inline comments"))
        .when(coverage >= 40, _texts("document all functions", "document algorithms", "document classes"))
        .otherwise(_texts("document extensively", "document public interfaces", "comment complex logic", "generate documentation"))
    )


def style_advice(score: Column) -> Column:
    return (
        F.when(score >= 90, _texts("keep the style"))
        .when(score >= 70, _texts("fix small inconsistencies", "name consistently"))
        .when(score >= 50, _texts("agree on a style guide", "run linters and formatters", "fix naming"))
        .otherwise(_texts("enforce coding standards", "format automatically", "fix all violations", "review code"))
    )


def with_measures(files: DataFrame, content: str = "content") -> DataFrame:
    """All measures of each file; the text itself is dropped."""
    text = F.col(content)
    first = files.withColumns(
        {
            "lines": F.size(lines_of(text)).cast("long"),
            "cyclomatic": cyclomatic(text),
            "nesting": max_nesting(text),
            "lines_per_function": lines_per_function(text),
            "parameters": mean_parameters(text),
            "variables": variables(text),
            "documentation_coverage": documentation_coverage(text),
            "style_score": style_score(text),
        }
    ).drop(content)
    cyclo = F.col("cyclomatic")
    return first.withColumns(
        {
            "cognitive": cyclo + F.col("nesting") * 2,
            "maintainability": maintainability(cyclo, F.col("documentation_coverage"), F.col("style_score")),
            "testability": testability(F.col("lines_per_function"), cyclo, F.col("parameters")),
            "complexity_score": score_complexity(cyclo),
        }
    )


def quality_heuristic(files: DataFrame, content: str = "content") -> DataFrame:
    """Quick score of a text with readability band, issues and improvements."""
    lines = lines_of(F.col(content))
    filled = F.filter(lines, lambda line: line.rlike(r"\S"))
    chars = F.aggregate(filled, F.lit(0).cast("long"), lambda acc, line: acc + F.length(line))
    measured = files.select(
        *[c for c in files.columns if c != content],
        F.size(filled).alias("filled_lines"),
        (chars / F.greatest(F.size(filled), F.lit(1))).alias("avg_line_length"),
        F.size(F.filter(filled, lambda line: F.length(line) > 120)).alias("long_lines"),
        (count_lines(lines, r"^\s*(?:#|//|/\*|\*)") / F.greatest(F.size(lines), F.lit(1))).alias("comment_ratio"),
    )
    mean, long, filled_n, ratio = (F.col(c) for c in ("avg_line_length", "long_lines", "filled_lines", "comment_ratio"))
    score = (
        F.lit(85)
        - F.when(mean > 100, 10).otherwise(0)
        - F.when(long > filled_n * 0.3, 15).otherwise(0)
        - F.when(ratio < 0.1, 10).otherwise(0)
        - F.when(filled_n > 200, 5).otherwise(0)
    )
    issues = compact_list(
        (mean > 100, "lines are long on average"),
        (long > 0, F.concat(long.cast("string"), F.lit(" lines exceed 120 characters"))),
        (ratio < 0.1, "few comments"),
        (filled_n > 200, "large file"),
    )
    return (
        measured.withColumn("quality_score", F.greatest(F.lit(0), F.least(F.lit(100), score)))
        .withColumn("readability", banded(F.col("quality_score"), [(85, "Excellent"), (70, "Good"), (55, "Fair")], "Needs Improvement"))
        .withColumn("issues", F.when(F.size(issues) > 0, issues).otherwise(_texts("no major issue")))
        .withColumn(
            "improvements",
            compact_list(
                (mean > 80, "break long lines"),
                (ratio < 0.2, "explain complex logic in comments"),
                (F.lit(True), "format and name consistently"),
                (F.lit(True), "enable model analysis"),
            ),
        )
    )
