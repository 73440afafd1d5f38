"""Code blocks of files and the selection of analysis candidates.

A block starts at every line that opens one, so the opening lines cut a file into stretches; a block ends inside its
stretch at the first line that its language's rule names, and otherwise with the stretch. All of it is one expression over the
lines of a file: a projection in the task that reads the file, without Python and without a shuffle. Selection is a
distributed top-n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions.common import top_n_per_key
from gitstrata.rules import blocks as rules

_SPACE = r"[\s\x1c-\x1f]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once: a lambda's argument is bound, an expression would be repeated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rule() -> Column:
    """The rule of a file's language as a struct: a look-up in a map of constants."""

    def constants(rule: rules.Block) -> Column:
        words = [F.struct(F.lit(w).alias("word"), F.lit(rule.at_front or w in rule.front).alias("front")) for w in rule.starts]
        texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
        return F.struct(
            F.lit(rule.shape).alias("shape"), F.array(*words).alias("starts"), texts(rule.comments).alias("comments"), texts(rule.ends).alias("ends"),
            F.lit(rule.brackets[0]).alias("left"), F.lit(rule.brackets[1]).alias("right"), F.lit(rule.lines).alias("lines"),
            F.lit(rule.languages == rules.STYLE_SHEETS).alias("sheet"), F.lit(rule.languages == rules.AT_MARGIN).alias("margin"),
            F.lit(rule.languages == rules.WITH_DECLARATIONS).alias("declared"),
        )

    # Languages lead to the number of their rule, so every rule stands in the plan once.
    numbers = F.create_map(*[F.lit(x) for i, rule in enumerate(rules.BLOCKS) for language in rule.languages for x in (language, i)])
    every = F.array(*[constants(rule) for rule in [*rules.BLOCKS, rules.REST]])
    return F.get(every, F.coalesce(F.try_element_at(numbers, F.coalesce("language", F.lit(""))), F.lit(len(rules.BLOCKS))))


def _lines(content: Column, rule: Column) -> Column:
    """The lines that count: number, line, bare text, depth of indent, bracket balance, and whether it opens a block."""
    shape = rule["shape"]

    def described(line: Column, i: Column) -> Column:
        bare = F.regexp_replace(line, f"(?U)^{_SPACE}+|{_SPACE}+$", "")
        text = F.when(shape == "statement", F.upper(bare)).otherwise(bare)
        indent = F.length(line) - F.length(F.regexp_replace(line, f"(?U)^{_SPACE}+", ""))
        return F.struct((i + 1).alias("n"), line.alias("line"), text.alias("text"), indent.alias("indent"))

    def opening(r: Column) -> Column:
        subject = F.when(shape.isin("budget", "tag"), F.lower(r["text"])).otherwise(r["text"])
        found = F.exists(rule["starts"], lambda w: F.when(w["front"], subject.startswith(w["word"])).otherwise(subject.contains(w["word"])))
        return F.when(rule["sheet"], subject.contains("{") & ~subject.startswith(rules.STYLE_RULE)).otherwise(found & (~rule["margin"] | (r["indent"] == 0)))

    def count(text: Column, mark: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, mark, F.lit("")))

    def marked(r: Column) -> Column:
        balance = F.when(shape == "counter", count(r["text"], rule["left"]) - count(r["text"], rule["right"])).otherwise(0)
        return F.struct(*[r[c].alias(c) for c in ("n", "line", "text", "indent")], balance.alias("balance"), opening(r).alias("opens"))

    lines = F.transform(F.split(content, "\n", -1), described)
    lines = F.filter(lines, lambda r: (shape == "budget") | ((r["text"] != "") & ~F.exists(rule["comments"], lambda w: r["text"].startswith(w))))
    return F.filter(F.transform(lines, marked), lambda r: ~(rule["declared"] & r["opens"] & ~r["text"].contains("{") & r["text"].contains(";")))


def _tag_ends(lines: Column) -> Column:
    """Numbers of the lines at which all tags opened so far are closed."""
    stack = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<int>").alias("ends"))

    def step(state: Column, r: Column) -> Column:
        text, none = F.lower(r["text"]), F.lit(None).cast("string")
        first = F.coalesce(*[F.when(text.contains(f"<{t}"), t) for t in rules.MARKUP_TAGS], none)
        top = F.try_element_at(state["open"], F.lit(-1))
        closes = ~r["opens"] & F.coalesce(text.contains(F.concat(F.lit("</"), top, F.lit(">"))), F.lit(False))
        left = F.slice(state["open"], 1, F.greatest(F.size(state["open"]) - 1, F.lit(0)))
        open_ = F.when(r["opens"] & first.isNotNull(), F.array_append(state["open"], first)).when(closes, left).otherwise(state["open"])
        ends = F.when(closes & (F.size(left) == 0), F.array_append(state["ends"], r["n"])).otherwise(state["ends"])
        return F.struct(open_.alias("open"), ends.alias("ends"))

    return F.aggregate(lines, stack, step, lambda state: state["ends"])


def _end(stretch: Column, rule: Column, tag_ends: Column) -> Column:
    """Place in the stretch (from 0) of the line that ends the block; NULL if none does."""
    first, shape = F.element_at(stretch, 1), rule["shape"]
    ending = lambda r: F.array_contains(rule["ends"], r["text"])

    def at(test: Callable[[Column], Column]) -> Column:
        return F.array_min(F.filter(F.transform(stretch, lambda r, i: F.when((i > 0) & test(r), i)), lambda i: i.isNotNull()))

    start = F.struct(first["balance"].alias("run"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("end"))

    def step(state: Column, r: Column) -> Column:
        run = state["run"] + r["balance"]
        done = F.when((run <= 0) | ending(r), state["i"] + 1)
        return F.struct(run.alias("run"), (state["i"] + 1).alias("i"), F.coalesce(state["end"], done).alias("end"))

    balanced = F.aggregate(F.slice(stretch, 2, F.greatest(F.size(stretch) - 1, F.lit(0))), start, step, lambda state: state["end"])
    closes = lambda r: (
        F.when(shape == "indent", r["indent"] <= first["indent"])
        .when(shape == "end_indent", ending(r) & (r["indent"] <= first["indent"]))
        .when(shape == "statement", r["text"].endswith(";") | r["text"].contains("END"))
        .when(shape == "tag", F.array_contains(tag_ends, r["n"]))
        .otherwise(ending(r))
    )
    return F.when(shape == "counter", balanced).when(shape == "budget", F.when(F.size(stretch) > rule["lines"], rule["lines"])).otherwise(at(closes))


def _blocks(content: Column, rule: Column) -> Column:
    """The complete blocks of one file: one still open at the end is dropped."""

    def cut(lines: Column, starts: Column, tag_ends: Column) -> Column:
        def block(place: Column, j: Column) -> Column:
            following = F.coalesce(F.get(starts, j + 1), F.size(lines))

            def closed(stretch: Column) -> Column:
                def taken(end: Column) -> Column:
                    n = F.when(rule["shape"] == "indent", end).otherwise(end + 1)
                    # A block that nothing ends is complete if another one follows.
                    rows = F.when(end.isNotNull(), F.slice(stretch, F.lit(1), F.coalesce(n, F.lit(0)))).when(j < F.size(starts) - 1, stretch)
                    code = F.array_join(F.transform(rows, lambda r: r["line"]), "\n")
                    return F.struct(F.element_at(stretch, 1)["n"].alias("start_line"), code.alias("code"))

                return _let(_end(stretch, rule, tag_ends), taken)

            return _let(F.slice(lines, place + 1, following - place), closed)

        return F.filter(F.transform(starts, block), lambda b: F.length(b["code"]) > rules.MIN_BLOCK)

    def found(lines: Column) -> Column:
        starts = F.filter(F.transform(lines, lambda r, i: F.when(r["opens"], i)), lambda i: i.isNotNull())
        ends = F.when(rule["shape"] == "tag", _tag_ends(lines)).otherwise(F.array().cast("array<int>"))
        return _let(F.struct(starts.alias("starts"), ends.alias("ends")), lambda x: cut(lines, x["starts"], x["ends"]))

    return _let(_lines(content, rule), found)


def code_blocks(files: DataFrame) -> DataFrame:
    """Blocks of every file: ``repository_id, path, language, start_line, code``.

    A NULL or empty text has none; a NULL language is handled as an unknown one.
    """
    found = _let(_rule(), lambda rule: _blocks(F.col("content"), rule))
    rows = files.filter("content <> ''").select("repository_id", "path", "language", F.explode(found).alias("block"))
    return rows.select("repository_id", "path", "language", "block.start_line", "block.code")


def candidates(blocks: DataFrame, n: int | None = None) -> DataFrame:
    """The ``n`` longest blocks of each repository in a known language, with their ``position``; all, unranked, by default."""
    fit = blocks.filter((F.col("language") != "Other") & (F.length("code") > rules.MIN_CANDIDATE))
    if n is None:
        return fit
    return top_n_per_key(fit, ["repository_id"], [F.desc(F.length("code")), F.col("path"), F.col("start_line"), F.col("code")], n, rank="position")


def to_occurrences(chosen: DataFrame, patterns: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Occurrences from candidates and their results, joined on ``candidate_id``.

    ``patterns`` holds ``candidate_id, patterns, confidence, model``; a missing
    confidence counts as 0.8. Candidates bring ``commit_date``.
    """
    out = chosen.join(patterns, "candidate_id")
    if quality is not None:
        out = out.join(quality.select("candidate_id", "quality_score"), "candidate_id", "left")
    extra = ["quality_score"] if quality is not None else []
    return out.select(
        "candidate_id", "repository_id", F.explode("patterns").alias("pattern"), F.coalesce("confidence", F.lit(0.8)).alias("confidence_score"),
        F.col("commit_date").alias("detected_at"), *extra,
    )
