"""Quality rules as weak supervision.

Every rule votes good, bad or abstains. Votes are counted per pattern of votes over the
whole table (at most ``3**len(RULES)`` patterns, whatever the number of documents);
expectation-maximisation on these counts estimates, per rule, how often it votes which
way on good and on bad text, and the share of good text. The posterior probability of
being good replaces "all rules must pass".

Defined cases: a NULL or blank text has no words, fails the base rules and is not kept;
an empty table gives an empty result; repeated rows and rows without id are judged each
by its own text; other columns are carried along untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gitstrata.llm.store import free
from gitstrata.llm.words import BLANK, Texts, slices

SYMBOLS = "#*$%&|<>"
#: Name, and the bounds of a ratio: good up to the first, bad from the second, no vote between.
RULES = (
    ("symbols", 0.002, 0.02),
    ("duplicate_lines", 0.1, 0.4),
    ("repeated_words", 0.25, 0.4),
    ("capitals", 0.15, 0.5),
    ("digits", 0.02, 0.2),
    ("twice_in_a_row", 0.02, 0.1),
    ("exclamations", 0.02, 0.2),
    ("open_lines", 0.25, 0.6),
    ("word_length", 1.0, 2.0),
)
#: A word of this many characters is usual; the rule looks at the distance in characters over this.
USUAL_LENGTH = 6.0
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_SYMBOL, _DIGIT, _BANG = _table(SYMBOLS), _table("0123456789"), _table("!")
_UPPER, _LOWER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")
_STOP = _table(".!?:;\"'")
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def repeated(key: np.ndarray) -> np.ndarray:
    """Which items occur more than once."""
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(key), bool)
    at = np.searchsorted(twice, key)
    return twice[np.minimum(at, len(twice) - 1)] == key


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each of the consecutive ranges."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def measures(t: Texts) -> tuple[list[np.ndarray], np.ndarray]:
    """The base counts of each text and the ratios that the rules look at."""
    n, (start, end) = t.counts, t.spans
    of_doc = t.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    chars = t.count_bytes(_LEAD) - t.count_bytes(BLANK)
    symbols = t.count_bytes(_SYMBOL)
    breaks = np.flatnonzero(t.data == 10)
    line_start = np.sort(np.concatenate([t.bounds[:-1], breaks + 1]))
    line_end = np.sort(np.concatenate([breaks, t.bounds[1:]]))
    last = np.searchsorted(start, line_end)
    worded = last > np.searchsorted(start, line_start)
    line_start, line_end, last = line_start[worded], line_end[worded], last[worded] - 1
    line_doc = t.doc[last]
    key = t.prints(line_start, line_end) ^ of_doc[last]
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    dup = np.bincount(line_doc[again], minlength=len(t))
    lines = np.bincount(line_doc, minlength=len(t))
    open_lines = np.bincount(line_doc[~_STOP[t.data[end[last] - 1]]], minlength=len(t))
    at, window = t.windows(3)
    hit = at[repeated(window ^ of_doc[at])]
    covered = np.zeros(len(start), bool)
    for k in range(3):
        covered[hit + k] = True
    rep = sums(covered, t.first)
    twice = np.zeros(len(start), bool)
    twice[1:] = (t.words[1:] == t.words[:-1]) & (t.doc[1:] == t.doc[:-1])
    words, letters = np.maximum(n, 1), np.maximum(chars, 1)
    upper, lower = t.count_bytes(_UPPER), t.count_bytes(_LOWER)
    ratios = np.stack([
        symbols / letters, dup / np.maximum(lines, 1), rep / words, upper / np.maximum(upper + lower, 1),
        t.count_bytes(_DIGIT) / letters, sums(twice, t.first) / words, t.count_bytes(_BANG) / words,
        open_lines / np.maximum(lines, 1), np.abs(chars / words - USUAL_LENGTH) / USUAL_LENGTH * 2,
    ])
    return [n, chars, symbols, dup, rep], np.where(n > 0, ratios, np.nan)


def votes(ratios: np.ndarray) -> np.ndarray:
    """One number per text, in base three: each rule's 0 abstains, 1 bad or 2 good."""
    out = np.zeros(ratios.shape[1], np.int32)
    for (_, good, bad), ratio in zip(RULES, ratios, strict=True):
        out = out * 3 + np.where(ratio <= good, 2, np.where(ratio >= bad, 1, 0)).astype(np.int32)
    return out


@arrow_udf(StructType([*(StructField(f, LongType()) for f in FIELDS), StructField("votes", IntegerType())]))
def measured(text: pa.Array) -> pa.Array:
    """The base counts and the votes of each text."""
    parts = [[] for _ in range(6)]
    for t in slices(text):
        counts, ratios = measures(t)
        for part, x in zip(parts, [*counts, votes(ratios)], strict=True):
            part.append(x)
    kinds = [np.int64] * 5 + [np.int32]
    arrays = [pa.array(np.concatenate(p).astype(k) if p else np.zeros(0, k)) for p, k in zip(parts, kinds, strict=True)]
    return pa.StructArray.from_arrays(arrays, names=[*FIELDS, "votes"])


#: Spark repeats a deterministic function in the filter and the projection above a join; this one is run once per text.
measured = measured.asNondeterministic()


def base_failed(m: Column) -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])


def fit(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Posterior probability of good text per pattern of votes.

    ``counts`` has the number of texts of each pattern. Two classes; per class and rule a
    distribution over abstain, bad and good, smoothed by one pseudo-count. The first
    responsibilities are the shares of good votes, pulled down by any bad vote, which
    fixes which class is which.
    """
    if not counts:
        return {}
    patterns = np.array(sorted(counts))
    n = np.array([counts[p] for p in patterns.tolist()], float)
    vote = np.stack([patterns // 3 ** (len(RULES) - 1 - i) % 3 for i in range(len(RULES))], 1)
    bad = (vote == 1).sum(1)
    good = np.clip(0.95 - 0.45 * bad, 0.05, 0.95)
    for _ in range(rounds):
        logs = []
        for share in (1 - good, good):
            weight = n * share
            log = np.full(len(n), np.log((weight.sum() + 1) / (n.sum() + 2)))
            for i in range(len(RULES)):
                seen = np.bincount(vote[:, i], weights=weight, minlength=3) + 1
                log += np.log(seen / seen.sum())[vote[:, i]]
            logs.append(log)
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    return dict(zip(patterns.tolist(), good.tolist(), strict=True))


def assess(docs: DataFrame, text: str = "text", threshold: float = 0.5, name: str = "quality_rules") -> DataFrame:
    """``docs`` with one more column ``name`` (one of that name is replaced): the base counts, ``base_failed``, ``posterior``, ``kept``.

    The texts are read twice, once to count patterns and once to judge, and never shuffled.
    """
    spark = docs.sparkSession
    docs = docs.drop(name)
    m, own = F.col(f"`{name}`"), free([*docs.columns, name], "quality_rules_")
    seen = docs.select(measured(F.col(text)).alias(name))
    counts = seen.groupBy(m["votes"].alias("votes")).count()
    posterior = fit({r["votes"]: r["count"] for r in counts.collect()})  # at most 3 ** len(RULES) rows
    known = spark.createDataFrame(list(posterior.items()), "votes int, posterior double")
    judged = docs.withColumn(name, measured(F.col(text)))
    known = F.broadcast(known.withColumnsRenamed({"votes": f"{own}votes", "posterior": f"{own}p"}))
    failed = base_failed(m)
    p = F.col(f"{own}p")
    return judged.join(known, m["votes"] == F.col(f"{own}votes"), "left").select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(
            *[m[f].alias(f) for f in FIELDS], failed.alias("base_failed"), p.alias("posterior"),
            (~failed & F.coalesce(p >= threshold, F.lit(False))).alias("kept"),
        ).alias(name),
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts, the posterior and whether it is kept."""
    m = assess(docs.select("doc_id", "text"))
    q = F.col("quality_rules")
    return m.select("doc_id", *[q[f].alias(f) for f in FIELDS], *[q[f].alias(f) for f in ("base_failed", "kept", "posterior")])


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, with their columns as they were."""
    name = free(docs.columns, "quality_rules")
    return assess(docs, name=name).filter(F.col(f"{name}.kept")).drop(name)
