"""Text measure and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitstrata.functions import quality as q
from gitstrata.functions.common import joined
from gitstrata.functions.tags import with_tags
from gitstrata.operators import quality as ops
from gitstrata.plans.registry import query
from gitstrata.rules import tags as rules


def _cond(alternatives, column="lc"):
    words = [" AND ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in alt) for alt in alternatives]
    return "(" + " OR ".join(f"({w})" for w in words) + ")"


def _tag_items():
    out = []
    for langs, table in rules.TAGS_BY_LANGUAGE.items():
        gate = "language IN (" + ", ".join(f"'{x}'" for x in langs.split()) + ")"
        out += [f"CASE WHEN {gate} AND {_cond(alts)} THEN '{tag}' END" for tag, alts in table]
    out += [f"CASE WHEN {_cond(alts)} THEN '{tag}' END" for tag, alts in rules.TAGS_ANY_LANGUAGE]
    out.append("CASE WHEN len(string_split(content, chr(10))) > 50 THEN 'large_code_block' END")
    out.append("CASE WHEN (length(content) - length(replace(content, 'function', ''))) / 8 > 5 OR (length(content) - length(replace(content, 'def ', ''))) / 4 > 5 THEN 'multi_function_module' END")
    return ", ".join(out)


def _n(word):
    return f"(length(content) - length(replace(content, '{word}', ''))) // {len(word)}"


TAGGED = f"""
WITH l AS (SELECT *, lower(content) AS lc FROM f_code), g AS (SELECT *, list_distinct(list_filter([{_tag_items()}], lambda x: x IS NOT NULL)) AS tags FROM l),
 s AS (SELECT *, least(10.0, greatest(1.0, CAST(len(tags) + len(string_split(content, chr(10))) + {" + ".join(_n(w) for w in ("if", "for", "while", "function", "def", "class"))} AS DOUBLE) / 10)) AS complexity_score FROM g),
 k AS (SELECT *, CASE WHEN list_has_any(tags, {rules.ADVANCED_TAGS}) OR complexity_score > 7 THEN 'advanced' WHEN list_has_any(tags, {rules.INTERMEDIATE_TAGS}) OR complexity_score > 4 THEN 'intermediate' ELSE 'beginner' END AS skill_level FROM s)
"""


@query("simple_tags", TAGGED + "SELECT path, array_to_string(list_sort(tags), '|') AS tags FROM k", "f_code")
def _(t):
    return with_tags(t.f_code).select("path", joined("tags").alias("tags"))


@query("complexity_and_skill", TAGGED + "SELECT path, complexity_score, skill_level FROM k", "f_code")
def _(t):
    return with_tags(t.f_code).select("path", "complexity_score", "skill_level")


@query("suggestions", TAGGED + """
SELECT path, array_to_string(list_filter([CASE WHEN complexity_score > 8 THEN 'split complex functions' END, CASE WHEN NOT list_contains(tags, 'error_handling') THEN 'add error handling' END,
 CASE WHEN language IN ('javascript', 'typescript') AND NOT list_contains(tags, 'async_await_pattern') THEN 'use async and await' END, CASE WHEN len(tags) < 3 THEN 'try more patterns' END, 'enable model analysis'], lambda x: x IS NOT NULL), '|') AS suggestions FROM k""", "f_code")
def _(t):
    return with_tags(t.f_code).select("path", F.array_join("suggestions", "|").alias("suggestions"))


@query("quality_heuristic", """
WITH l AS (SELECT path, string_split(content, chr(10)) AS ls FROM f_code), f AS (SELECT path, ls, list_filter(ls, lambda x: regexp_matches(x, '\\S')) AS fl FROM l),
 m AS (SELECT path, len(fl) AS filled, coalesce(list_sum(list_transform(fl, lambda x: length(x))), 0) / greatest(len(fl), 1) AS mean, len(list_filter(fl, lambda x: length(x) > 120)) AS long_n,
  len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*(#|//|/\\*|\\*)'))) / greatest(len(ls), 1) AS ratio FROM f),
 s AS (SELECT *, CAST(greatest(0, least(100, 85 - CASE WHEN mean > 100 THEN 10 ELSE 0 END - CASE WHEN long_n > filled * 0.3 THEN 15 ELSE 0 END - CASE WHEN ratio < 0.1 THEN 10 ELSE 0 END - CASE WHEN filled > 200 THEN 5 ELSE 0 END)) AS INTEGER) AS quality_score FROM m)
SELECT path, round(CAST(mean AS DOUBLE), 9) AS avg_line_length, CAST(long_n AS INTEGER) AS long_lines, round(CAST(ratio AS DOUBLE), 9) AS comment_ratio, quality_score,
 CASE WHEN quality_score >= 85 THEN 'Excellent' WHEN quality_score >= 70 THEN 'Good' WHEN quality_score >= 55 THEN 'Fair' ELSE 'Needs Improvement' END AS readability FROM s""", "f_code")
def _(t):
    out = q.quality_heuristic(t.f_code)
    return out.select("path", F.round("avg_line_length", 9).alias("avg_line_length"), "long_lines", F.round("comment_ratio", 9).alias("comment_ratio"), "quality_score", "readability")


WORD = "[\\p{L}\\p{N}_]"


def _count(rx, column="content"):
    return f"len(regexp_extract_all({column}, '{rx}'))"


MEASURES = f"""
WITH w AS (SELECT repository_id, path, content, string_split(content, chr(10)) AS ls, regexp_extract_all(lower(content), '{WORD}+') AS words FROM f_code),
 a AS (SELECT repository_id, path, content, len(ls) AS lines,
  CAST(1 + len(list_filter(words, lambda x: x IN ('if', 'else', 'while', 'for', 'switch', 'case', 'catch', 'throw', 'return'))) + {_count('&&')} + {_count('[|][|]')} + {_count('[?]')} + {_count(':')} AS DOUBLE) AS cyclomatic,
  {_count(f'function\\s+{WORD}+\\s*\\([^)]*\\)')} AS functions, regexp_extract_all(content, '\\([^)]*\\)') AS pars,
  {_count(f'(?:^|[^\\p{{L}}\\p{{N}}_])(?:var|let|const)\\s+{WORD}+')} AS variables,
  len(list_filter(ls, lambda x: regexp_matches(x, '\\S') AND NOT regexp_matches(x, '^\\s*//'))) AS code_lines,
  len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*(//|/\\*|\\*|#)'))) AS comment_lines,
  len(list_filter(ls, lambda x: regexp_matches(x, '\\S'))) AS filled, len(list_filter(ls, lambda x: regexp_matches(x, '^\\s\\S'))) AS odd_indent,
  {" + ".join(_count(p) for p in ["function\\s+[a-z][a-zA-Z0-9]*\\s*\\(", "class\\s+[A-Z][a-zA-Z0-9]*", "const\\s+[A-Z_][A-Z0-9_]*\\s*=", "var\\s+[a-z][a-zA-Z0-9]*"])} AS naming,
  {" + ".join(_count(p) for p in [f"var\\s+{WORD}+\\s*=", "==\\s+", "eval\\s*\\(", "with\\s*\\(", "document\\.write\\s*\\("])} AS bad FROM w),
 b AS (SELECT *, CASE WHEN functions > 0 THEN lines / functions ELSE 0.0 END AS lines_per_function,
  CASE WHEN len(pars) > 0 THEN len(regexp_extract_all(array_to_string(pars, ' '), '{WORD}+')) / len(pars) ELSE 0.0 END AS parameters,
  CASE WHEN code_lines > 0 THEN least(100.0, comment_lines / code_lines * 100) ELSE 0.0 END AS documentation_coverage,
  CASE WHEN filled > 0 THEN greatest(0.0, 100.0 - (odd_indent + naming + bad * 2) / filled * 100) ELSE 0.0 END AS style_score,
  CASE WHEN cyclomatic <= 5 THEN 90.0 WHEN cyclomatic <= 10 THEN 70.0 WHEN cyclomatic <= 20 THEN 50.0 ELSE greatest(0.0, 100 - cyclomatic * 2) END AS complexity_score FROM a),
 c AS (SELECT *, least(100.0, greatest(0.0, 100 - cyclomatic * 5) * 0.4::DOUBLE + documentation_coverage * 0.3::DOUBLE + style_score * 0.3::DOUBLE) AS maintainability,
  CASE WHEN cyclomatic < 5 THEN 90 WHEN cyclomatic < 10 THEN 70 WHEN cyclomatic < 20 THEN 50 ELSE 30 END AS t1, CASE WHEN parameters < 3 THEN 90 WHEN parameters < 6 THEN 70 ELSE 50 END AS t2,
  CASE WHEN lines_per_function < 20 THEN 90 WHEN lines_per_function < 50 THEN 70 ELSE 50 END AS t3 FROM b)
"""


def measures(t):
    return q.with_measures(t.f_code.select("repository_id", "path", "content"))


@query("cyclomatic", MEASURES + "SELECT path, cyclomatic, complexity_score, CASE WHEN cyclomatic > 10 THEN 'warning' ELSE 'info' END AS severity FROM c", "f_code")
def _(t):
    text = F.col("content")
    out = t.f_code.select("path", q.cyclomatic(text).alias("cyclomatic"))
    return out.select("path", "cyclomatic", q.score_complexity(F.col("cyclomatic")).alias("complexity_score"), F.when(F.col("cyclomatic") > 10, "warning").otherwise("info").alias("severity"))


@query("nesting", """
WITH l AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT path, string_split(content, chr(10)) AS ls FROM f_code)),
 d AS (SELECT path, i, CASE WHEN regexp_matches(line, '^\\s*(if|while|for|switch|catch)($|[^\\p{L}\\p{N}_])') THEN 1 WHEN regexp_matches(line, '^\\s*(else|elif|case)($|[^\\p{L}\\p{N}_])') THEN 0 WHEN regexp_matches(line, '^\\s*\\}') THEN -1 ELSE 0 END AS d FROM l),
 s AS (SELECT path, i, d, sum(d) OVER (PARTITION BY path ORDER BY i) AS s FROM d), n AS (SELECT path, s - least(0, min(s) OVER (PARTITION BY path ORDER BY i)) AS level FROM s)
SELECT path, CAST(max(level) AS INTEGER) AS nesting FROM n GROUP BY 1""", "f_code")
def _(t):
    return t.f_code.select("path", q.max_nesting(F.col("content")).alias("nesting"))


@query("code_measures", MEASURES + "SELECT path, lines, round(CAST(lines_per_function AS DOUBLE), 9) AS lines_per_function, round(CAST(parameters AS DOUBLE), 9) AS parameters, variables FROM c", "f_code")
def _(t):
    return measures(t).select("path", "lines", F.round("lines_per_function", 9).alias("lines_per_function"), F.round("parameters", 9).alias("parameters"), "variables")


@query("documentation_and_style", MEASURES + "SELECT path, round(CAST(documentation_coverage AS DOUBLE), 9) AS documentation_coverage, round(CAST(style_score AS DOUBLE), 9) AS style_score FROM c", "f_code")
def _(t):
    return measures(t).select("path", F.round("documentation_coverage", 9).alias("documentation_coverage"), F.round("style_score", 9).alias("style_score"))


@query("maintainability_testability", MEASURES + """
SELECT path, round(maintainability, 9) AS maintainability, round(CASE WHEN functions > 0 THEN (t1 + t2 + t3) / 3 ELSE (t1 + t2) / 2 END, 9) AS testability FROM c""", "f_code")
def _(t):
    return measures(t).select("path", F.round("maintainability", 9).alias("maintainability"), F.round("testability", 9).alias("testability"))


@query("quality_report", MEASURES + """,
 m AS (SELECT repository_id, count(*) AS files_analyzed, CAST(sum(lines) AS BIGINT) AS total_lines, avg(cyclomatic) AS average_complexity, avg(documentation_coverage) AS documentation_coverage, avg(style_score) AS style_consistency, avg(complexity_score) AS cs FROM c GROUP BY 1)
SELECT repository_id, files_analyzed, total_lines, round(average_complexity, 6) AS average_complexity, round(documentation_coverage, 6) AS documentation_coverage, round(style_consistency, 6) AS style_consistency,
 round((cs * 0.3::DOUBLE + documentation_coverage * 0.2::DOUBLE + style_consistency * 0.2::DOUBLE) / 0.7::DOUBLE, 6) AS overall_score,
 round(coalesce((CASE WHEN cs < 60 THEN 100 - cs ELSE 0 END + CASE WHEN documentation_coverage < 60 THEN 100 - documentation_coverage ELSE 0 END + CASE WHEN style_consistency < 60 THEN 100 - style_consistency ELSE 0 END)
  / nullif(CAST(cs < 60 AS INTEGER) + CAST(documentation_coverage < 60 AS INTEGER) + CAST(style_consistency < 60 AS INTEGER), 0), 0.0), 6) AS technical_debt_score,
 round((cs + documentation_coverage + style_consistency) / 3, 6) AS maintainability_index, round(cs, 6) AS testability_score FROM m""", "f_code")
def _(t):
    out = ops.quality_report(measures(t))
    exact = {"repository_id", "files_analyzed", "total_lines"}
    return out.select(*[c if c in exact else F.round(c, 6).alias(c) for c in out.columns])


@query("metric_means", MEASURES + """,
 u AS (SELECT repository_id, 'cyclomatic_complexity' AS metric, cyclomatic AS value, complexity_score AS score, cyclomatic > 10 AS warn FROM c UNION ALL
  SELECT repository_id, 'documentation_coverage', documentation_coverage, documentation_coverage, documentation_coverage < 50 FROM c UNION ALL SELECT repository_id, 'style_consistency', style_score, style_score, style_score < 70 FROM c)
SELECT repository_id, metric, round(avg(value), 6) AS value, round(avg(score), 6) AS score, count(*) AS files, CASE WHEN bool_or(warn) THEN 'warning' ELSE 'info' END AS severity FROM u GROUP BY 1, 2""", "f_code")
def _(t):
    out = ops.metric_means(ops.file_metrics(measures(t))).drop("category")
    return out.withColumn("value", F.round("value", 6)).withColumn("score", F.round("score", 6))


@query("top_recommendations", MEASURES + """,
 u AS (SELECT repository_id, unnest(CASE WHEN cyclomatic <= 5 THEN ['keep complexity low', 'keep current practice'] WHEN cyclomatic <= 10 THEN ['split complex functions', 'extract helpers']
   WHEN cyclomatic <= 20 THEN ['refactor into smaller functions', 'use patterns against branching', 'use strategy or command'] ELSE ['refactor now', 'split into many functions', 'use patterns widely', 'rethink the architecture'] END) AS recommendation FROM c
  UNION ALL SELECT repository_id, unnest(CASE WHEN documentation_coverage >= 80 THEN ['keep documenting'] WHEN documentation_coverage >= 60 THEN ['document complex functions', 'improve inline comments']
   WHEN documentation_coverage >= 40 THEN ['document all functions', 'document algorithms', 'document classes'] ELSE ['document extensively', 'document public interfaces', 'comment complex logic', 'generate documentation'] END) FROM c
  UNION ALL SELECT repository_id, unnest(CASE WHEN style_score >= 90 THEN ['keep the style'] WHEN style_score >= 70 THEN ['fix small inconsistencies', 'name consistently'] WHEN style_score >= 50 THEN ['agree on a style guide', 'run linters and formatters', 'fix naming']
   ELSE ['enforce coding standards', 'format automatically', 'fix all violations', 'review code'] END) FROM c),
 n AS (SELECT repository_id, recommendation, count(*) AS count FROM u GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY repository_id ORDER BY count DESC, recommendation) AS INTEGER) AS position FROM n QUALIFY position <= 10""", "f_code")
def _(t):
    return ops.top_recommendations(ops.file_metrics(measures(t)), 10)
