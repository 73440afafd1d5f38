"""Code block queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from gitstrata.functions.paths import with_language
from gitstrata.operators import blocks as ops
from gitstrata.plans.registry import query
from gitstrata.rules import blocks as rules


EXTENSIONS = {"py": "Python", "js": "JavaScript", "java": "Java", "ts": "TypeScript", "tsx": "React", "rs": "Rust", "go": "Go", "sql": "SQL", "yml": "YAML", "md": "Other"}


def by_language(arms: Callable[[rules.Block], str]) -> str:
    """A CASE over the languages of the sources at hand, with the rule of all others at its end."""
    known = [r for r in rules.BLOCKS if set(r.languages) & set(EXTENSIONS.values())]
    lists = [", ".join(f"'{x}'" for x in r.languages) for r in known]
    return "CASE " + " ".join(f"WHEN language IN ({x}) THEN {arms(r)}" for r, x in zip(known, lists, strict=True)) + f" ELSE {arms(rules.REST)} END"


def either(tests: list[str]) -> str:
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def opens(rule: rules.Block) -> str:
    subject, test = "lower(text)" if rule.shape == "budget" else "text", "starts_with" if rule.at_front else "contains"
    found = either([f"{test}({subject}, '{w}')" for w in rule.starts])
    return f"({found} AND line = ltrim(line, ' \t'))" if rule.languages == rules.AT_MARGIN else found


def ends(rule: rules.Block) -> str:
    if rule.shape == "counter":
        return "run <= 0"
    return {"indent": "indent <= deep", "statement": "(suffix(text, ';') OR contains(text, 'END'))", "budget": f"i = {rule.lines}"}[rule.shape]


def balance(rule: rules.Block) -> str:
    return f"length(replace(text, '{rule.brackets[1]}', '')) - length(replace(text, '{rule.brackets[0]}', ''))" if rule.shape == "counter" else "0"


DECLARED = ", ".join(f"'{x}'" for x in rules.WITH_DECLARATIONS)
BLOCKS_SQL = f"""
WITH f AS (SELECT row_number() OVER () AS f, repository_id, path, CASE regexp_extract(path, '[.]([a-z]+)$', 1) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSIONS.items())} END AS language,
  string_split(content, chr(10)) AS lines FROM f_code WHERE content <> ''),
 l AS (SELECT f, repository_id, path, language, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM f),
 m AS (SELECT *, CASE language WHEN 'SQL' THEN upper(trim(line, ' \t\r')) ELSE trim(line, ' \t\r') END AS text, length(line) - length(ltrim(line, ' \t\r')) AS indent FROM l),
 o AS (SELECT *, {by_language(opens)} AS opens, {by_language(balance)} AS balance FROM m WHERE {by_language(lambda r: "true" if r.shape == "budget" else f"(text <> '' AND NOT {either([f"starts_with(text, '{c}')" for c in r.comments])})")}),
 k AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY f ORDER BY n) AS s FROM o WHERE NOT (language IN ({DECLARED}) AND opens AND NOT contains(text, '{{') AND contains(text, ';'))),
 b AS (SELECT *, row_number() OVER w - 1 AS i, sum(balance) OVER w AS run, first_value(indent) OVER w AS deep, max(s) OVER (PARTITION BY f) AS last FROM k WHERE s > 0 WINDOW w AS (PARTITION BY f, s ORDER BY n)),
 e AS (SELECT *, min(CASE WHEN i > 0 AND {by_language(ends)} THEN i END) OVER (PARTITION BY f, s) AS stop FROM b),
 found AS (SELECT repository_id, path, language, CAST(min(n) AS INTEGER) AS start_line, string_agg(line, chr(10) ORDER BY n) AS code FROM e
  WHERE (stop IS NOT NULL OR s < last) AND (stop IS NULL OR i < stop + {by_language(lambda r: "0" if r.shape == "indent" else "1")}) GROUP BY f, s, repository_id, path, language HAVING length(string_agg(line, chr(10) ORDER BY n)) > {rules.MIN_BLOCK})
"""


@query("code_blocks", BLOCKS_SQL + "SELECT repository_id, path, language, start_line, length(code) AS chars, md5(code) AS code_md5 FROM found", "f_code")
def _(t):
    files = with_language(t.f_code.drop("language"), "commit", "path")
    found = ops.code_blocks(files)
    return found.select("repository_id", "path", "language", "start_line", F.length("code").cast("long").alias("chars"), F.md5(F.col("code").cast("binary")).alias("code_md5"))


@query("block_candidates", BLOCKS_SQL + f"""SELECT repository_id, path, start_line, CAST(row_number() OVER (PARTITION BY repository_id ORDER BY length(code) DESC, path, start_line, code) AS INTEGER) AS position
FROM found WHERE language <> 'Other' AND length(code) > {rules.MIN_CANDIDATE} QUALIFY position <= 50""", "f_code")
def _(t):
    files = with_language(t.f_code.drop("language"), "commit", "path")
    return ops.candidates(ops.code_blocks(files), 50).select("repository_id", "path", "start_line", "position")


@query("longest_candidates", """
SELECT source AS repository_id, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, CAST(doc_id AS VARCHAR), text) AS INTEGER) AS position FROM documents WHERE length(text) > 20 QUALIFY position <= 50""")
def _(t):
    rows = t.documents.select(F.col("source").alias("repository_id"), F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("language"), F.lit(1).alias("start_line"), F.col("text").alias("code"), "doc_id")
    return ops.candidates(rows, 50).select("repository_id", "doc_id", "position")


@query("to_occurrences", """
SELECT p_partkey AS candidate_id, CAST(p_size AS VARCHAR) AS repository_id, unnest(string_split(p_name, ' ')) AS pattern, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size / 100 AS DOUBLE) ELSE 0.8 END AS confidence_score, p_retailprice AS quality_score FROM part""")
def _(t):
    key = F.col("p_partkey").alias("candidate_id")
    chosen = t.part.select(key, F.col("p_size").cast("string").alias("repository_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("commit_date"))
    found = t.part.select(key, F.split("p_name", " ").alias("patterns"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") / 100).alias("confidence"))
    quality = t.part.select(key, F.col("p_retailprice").alias("quality_score"))
    return ops.to_occurrences(chosen, found, quality).drop("detected_at")
