"""Model result, consensus and completion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitstrata.functions.common import dealt, joined
from gitstrata.operators import completions as comp
from gitstrata.operators import models as ops
from gitstrata.operators.consensus import consensus
from gitstrata.plans.registry import query


def results(t):
    """Results with their patterns as a list: the words of the part name."""
    return t.f_results.withColumn("detected_patterns", F.split("detected_patterns_text", " ")).drop("detected_patterns_text")


LISTED = "r AS (SELECT *, string_split(detected_patterns_text, ' ') AS pats FROM f_results)"

PERF = f"""
WITH {LISTED}, w AS (SELECT * FROM r WHERE created_at >= (SELECT max(created_at) FROM r) - INTERVAL 400 DAY),
 f AS (SELECT model_name, count(*) AS total_analyses, sum(processing_time) AS total_processing_time, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
   sum(cost_estimate) AS total_cost, avg(confidence_score) AS avg_confidence_score, avg(complexity_score) AS avg_complexity_score, count(error_message) AS errors FROM w GROUP BY 1),
 u AS (SELECT model_name, count(DISTINCT p) AS unique_patterns_detected FROM (SELECT model_name, unnest(pats) AS p FROM w) GROUP BY 1),
 perf AS (SELECT f.*, (total_analyses - errors) / total_analyses * 100 AS success_rate, unique_patterns_detected FROM f JOIN u USING (model_name) JOIN f_models USING (model_name))
"""


@query("model_performance", PERF + """
SELECT model_name, total_analyses, total_processing_time, total_tokens, round(total_cost, 6) AS total_cost, round(avg_confidence_score, 9) AS avg_confidence_score,
 round(avg_complexity_score, 9) AS avg_complexity_score, errors, round(success_rate, 9) AS success_rate, unique_patterns_detected,
 round(total_processing_time / total_analyses, 9) AS avg_processing_time, round(total_tokens / total_analyses, 6) AS avg_tokens_per_analysis, round(total_cost / total_analyses, 9) AS avg_cost_per_analysis FROM perf""",
       "f_results f_models")
def _(t):
    out = ops.model_performance(results(t), t.f_models, days=400)
    nine = ["avg_confidence_score", "avg_complexity_score", "success_rate", "avg_processing_time", "avg_cost_per_analysis"]
    out = out.withColumns({c: F.round(c, 9) for c in nine})
    return out.withColumns({c: F.round(c, 6) for c in ["total_cost", "avg_tokens_per_analysis"]}).drop("is_available")


@query("model_performance_summary", PERF + """
SELECT count(*) AS total_models, CAST(sum(total_analyses) AS BIGINT) AS total_analyses, sum(total_processing_time) AS total_processing_time, round(sum(total_cost), 6) AS total_cost,
 round(avg(success_rate), 9) AS avg_success_rate FROM perf""", "f_results f_models")
def _(t):
    out = ops.model_performance_summary(ops.model_performance(results(t), t.f_models, days=400))
    return out.withColumn("total_cost", F.round("total_cost", 6)).withColumn("avg_success_rate", F.round("avg_success_rate", 9))


@query("model_performance_one", PERF + "SELECT model_name, total_analyses, errors FROM perf WHERE model_name = 'model1'", "f_results f_models")
def _(t):
    as_of = t.f_results.select(F.max("created_at")).scalar()
    return ops.model_performance(results(t), t.f_models, days=400, as_of=as_of, model_name="model1").select("model_name", "total_analyses", "errors")


@query("models_with_stats", """
SELECT m.model_name, m.is_available, count(r.model_name) AS total_analyses, count(r.error_message) AS errors, round(coalesce(sum(cost_estimate), 0.0), 6) AS total_cost
FROM f_models m LEFT JOIN f_results r USING (model_name) GROUP BY 1, 2""", "f_results f_models")
def _(t):
    out = ops.models_with_stats(t.f_models, results(t))
    return out.select("model_name", "is_available", "total_analyses", "errors", F.round("total_cost", 6).alias("total_cost"))


@query("available_models", "SELECT count(*) AS total_models, count(*) FILTER (is_available) AS available_models FROM f_models", "f_models")
def _(t):
    return ops.availability_counts(t.f_models)


@query("join_models", "SELECT model_name, is_available, count(*) AS n FROM f_results JOIN f_models USING (model_name) GROUP BY 1, 2", "f_results f_models")
def _(t):
    return ops.join_models(results(t), t.f_models).groupBy("model_name", "is_available").agg(F.count("*").alias("n"))


@query("recent_session_results", """
WITH s AS (SELECT session_id, repository_id FROM f_analysis_sessions QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY started_at DESC, session_id) <= 10)
SELECT s.repository_id, r.session_id, count(*) AS results, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM (SELECT CAST(l_orderkey AS VARCHAR) AS session_id, l_partkey AS total_tokens FROM lineitem) r
JOIN s USING (session_id) GROUP BY 1, 2""", "f_analysis_sessions")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").cast("string").alias("session_id"), F.col("l_partkey").alias("total_tokens"))
    out = ops.recent_session_results(rows, t.f_analysis_sessions, 10)
    return out.groupBy("repository_id", "session_id").agg(F.count("*").alias("results"), F.sum("total_tokens").alias("tokens"))


@query("pattern_frequency", f"""
WITH {LISTED} SELECT pattern, count(*) AS count FROM (SELECT unnest(list_distinct(pats)) AS pattern FROM r) GROUP BY 1""", "f_results")
def _(t):
    return ops.pattern_frequency(results(t))


@query("top_detected", f"""
WITH {LISTED}, c AS (SELECT session_id, p AS pattern, count(*) AS count FROM (SELECT session_id, unnest(pats) AS p FROM r) GROUP BY 1, 2)
SELECT session_id, pattern, count, CAST(row_number() OVER (PARTITION BY session_id ORDER BY count DESC, pattern) AS INTEGER) AS position,
 count(*) OVER (PARTITION BY session_id) AS total_unique_patterns, CAST(sum(count) OVER (PARTITION BY session_id) AS BIGINT) AS total_pattern_occurrences
FROM c QUALIFY position <= 5""", "f_results")
def _(t):
    return ops.top_detected(results(t), ["session_id"], 5)


@query("complexity_assessment", """
SELECT *, CASE WHEN average_complexity > 6 THEN 'increasing' WHEN average_complexity < 4 THEN 'decreasing' ELSE 'stable' END AS complexity_trend FROM (
 SELECT session_id, round(avg(nullif(complexity_score, 0)), 9) AS average_complexity, count(nullif(complexity_score, 0)) AS total_analyses,
 count(*) FILTER (complexity_score <> 0 AND complexity_score < 4) AS low, count(*) FILTER (complexity_score >= 4 AND complexity_score < 7) AS medium, count(*) FILTER (complexity_score >= 7) AS high
 FROM f_results GROUP BY 1)""", "f_results")
def _(t):
    return ops.complexity_assessment(results(t), ["session_id"]).withColumn("average_complexity", F.round("average_complexity", 9))


BY_MODEL = """
WITH u AS (SELECT repository_id, coalesce(nullif(model_used, ''), 'unknown') AS model, analysis_type AS source, created_at AS seen_at FROM f_analyses WHERE analysis_type IN ('pattern', 'quality')
 UNION ALL SELECT repository_id, ai_model_used, 'occurrence', detected_at FROM f_occurrences WHERE ai_model_used IS NOT NULL),
 m AS (SELECT repository_id, model, string_agg(DISTINCT source, '|' ORDER BY source) AS analysis_types, count(*) AS count, max(seen_at) AS latest FROM u GROUP BY 1, 2)
"""


@query("models_by_repository", BY_MODEL + "SELECT * FROM m", "f_analyses f_occurrences")
def _(t):
    return ops.models_by_repository(t.f_analyses, t.f_occurrences).withColumn("analysis_types", joined("analysis_types"))


@query("rerun_decision", BY_MODEL + """,
 n AS (SELECT repository_id, model_used FROM f_analyses WHERE analysis_type IN ('pattern', 'quality') QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, analysis_id DESC) = 1),
 l AS (SELECT repository_id, model FROM m QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY latest DESC, model DESC) = 1)
SELECT r.repository_id, r.status, coalesce(n.model_used, l.model) AS latest_model,
 r.status <> 'completed' OR coalesce(n.model_used, l.model) IS NULL OR coalesce(n.model_used, l.model) <> 'model2' AS rerun
FROM f_repositories r LEFT JOIN n USING (repository_id) LEFT JOIN l USING (repository_id)""", "f_analyses f_occurrences f_repositories")
def _(t):
    return ops.rerun_decision(t.f_repositories, t.f_analyses, t.f_occurrences, "model2")


@query("model_comparison", f"""
WITH {LISTED}, m AS (SELECT session_id, count(DISTINCT model_name) AS models FROM r GROUP BY 1),
 v AS (SELECT session_id, p AS pattern, count(DISTINCT model_name) AS votes FROM (SELECT session_id, model_name, unnest(pats) AS p FROM r) GROUP BY 1, 2)
SELECT session_id, pattern, votes, models, votes / models AS agreement, votes = models AS is_consensus FROM v JOIN m USING (session_id)""", "f_results")
def _(t):
    return ops.model_comparison(results(t), ["session_id"])


@query("model_cost_and_speed", """
WITH p AS (SELECT session_id, model_name, avg(processing_time) AS mt, sum(cost_estimate) AS cost FROM f_results GROUP BY 1, 2)
SELECT session_id, min_by(model_name, (mt, model_name)) AS fastest_model, round(min(mt), 9) AS fastest_time, round(sum(cost), 6) AS total_cost, count(*) AS models FROM p GROUP BY 1""", "f_results")
def _(t):
    out = ops.model_cost_and_speed(results(t), ["session_id"])
    return out.withColumn("fastest_time", F.round("fastest_time", 9)).withColumn("total_cost", F.round("total_cost", 6))


@query("model_benchmarks", """
SELECT 'model' || CAST(l_suppkey % 5 AS VARCHAR) AS model_id, l_returnflag AS benchmark_name, l_linestatus AS version,
 max(l_shipdate) AS date, max_by(l_extendedprice, (l_shipdate, l_orderkey * 1000000 + l_partkey)) AS accuracy FROM lineitem GROUP BY 1, 2, 3""")
def _(t):
    rows = t.lineitem.select(
        F.concat(F.lit("model"), (F.col("l_suppkey") % 5).cast("string")).alias("model_id"),
        F.col("l_returnflag").alias("benchmark_name"), F.col("l_linestatus").alias("version"), F.col("l_shipdate").alias("date"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("record_id"), F.col("l_extendedprice").alias("accuracy"),
    )
    return ops.model_benchmarks(rows).drop("record_id")


@query("run_accounting", """
WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS candidates, CAST(sum(length(text) // 4) AS BIGINT) AS estimated_tokens, round(sum(strlen(text)) / 1073741824, 12) AS size_gb FROM conversations GROUP BY 1),
 d AS (SELECT session_id, count(*) AS analyzed, count(error_message) AS failed, sum(processing_time) AS duration_seconds FROM f_results GROUP BY 1)
SELECT session_id, candidates, estimated_tokens, size_gb, coalesce(analyzed, 0) AS analyzed, coalesce(failed, 0) AS failed, coalesce(duration_seconds, 0) AS duration_seconds FROM c LEFT JOIN d USING (session_id)""", "f_results")
def _(t):
    cand = t.conversations.select(F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("code"))
    return ops.run_accounting(cand, results(t)).withColumn("size_gb", F.round("size_gb", 12))


def votes(t):
    """Long votes: a number and a text per model and task, one row per model."""
    base = dealt(t.f_model_results, "task_id").groupBy("task_id", "model_id").agg(
        F.max("confidence").alias("confidence"), F.max("num_value").alias("num"), F.max("str_value").alias("txt")
    )
    number = F.struct(F.lit("lines").alias("key"), F.col("num").alias("num_value"), F.lit(None).cast("string").alias("str_value"))
    text = F.struct(F.lit("flag").alias("key"), F.lit(None).cast("double").alias("num_value"), F.col("txt").alias("str_value"))
    both = base.select("task_id", "model_id", "confidence", F.inline(F.array(number, text)))
    return both.select("task_id", "key", "model_id", "confidence", "num_value", "str_value")


VOTES = """
WITH b AS (SELECT task_id, model_id, max(confidence) AS confidence, max(num_value) AS num, max(str_value) AS txt FROM f_model_results GROUP BY 1, 2),
 mode AS (SELECT task_id, txt AS str_value FROM (SELECT task_id, txt, count(*) AS n FROM b GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC, txt) = 1),
 """


@query("consensus_confidence", VOTES + """
 q AS (SELECT task_id, round(sum(num * confidence) / sum(confidence), 9) AS num_value, round(avg(confidence), 9) AS confidence FROM b GROUP BY 1)
SELECT task_id, 'lines' AS key, num_value, CAST(NULL AS VARCHAR) AS str_value, confidence FROM q
UNION ALL SELECT task_id, 'flag', NULL, mode.str_value, confidence FROM q JOIN mode USING (task_id)""", "f_model_results")
def _(t):
    return _rounded(consensus(votes(t), "confidence"))


def _rounded(df):
    return df.withColumn("num_value", F.round("num_value", 9)).withColumn("confidence", F.round("confidence", 9))


@query("consensus_majority", VOTES + """
 q AS (SELECT task_id, round(avg(num), 9) AS num_value, round(avg(confidence), 9) AS confidence FROM b GROUP BY 1)
SELECT task_id, 'lines' AS key, num_value, CAST(NULL AS VARCHAR) AS str_value, confidence FROM q
UNION ALL SELECT task_id, 'flag', NULL, mode.str_value, confidence FROM q JOIN mode USING (task_id)""", "f_model_results")
def _(t):
    return _rounded(consensus(votes(t), "majority"))


@query("consensus_weighted", VOTES + """
 w AS (SELECT b.*, CASE model_id WHEN 'model0' THEN 3.0::DOUBLE WHEN 'model1' THEN 2.0 ELSE 1.0 END AS weight FROM b),
 q AS (SELECT task_id, round(sum(num * weight) / sum(weight), 9) AS num_value, round(sum(confidence * weight) / sum(weight), 9) AS confidence FROM w GROUP BY 1),
 h AS (SELECT task_id, txt FROM w QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY weight DESC, model_id, txt) = 1)
SELECT task_id, 'lines' AS key, num_value, CAST(NULL AS VARCHAR) AS str_value, confidence FROM q
UNION ALL SELECT task_id, 'flag', NULL, h.txt, confidence FROM q JOIN h USING (task_id)""", "f_model_results")
def _(t):
    weights = t.spark.createDataFrame([("model0", 3.0), ("model1", 2.0)], "model_id string, weight double")
    return _rounded(consensus(votes(t), "weighted", F.broadcast(weights)))


@query("consensus_best", VOTES + """
 q AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY confidence DESC, model_id) = 1)
SELECT task_id, 'lines' AS key, num AS num_value, CAST(NULL AS VARCHAR) AS str_value, confidence FROM q
UNION ALL SELECT task_id, 'flag', NULL, txt, confidence FROM q""", "f_model_results")
def _(t):
    return consensus(votes(t), "best")


COMPLETION = """
SELECT p_partkey AS candidate_id, CASE p_partkey % 4
 WHEN 0 THEN '{{"patterns": ["' || replace(p_name, ' ', '", "') || '"], "complexity_score": ' || CAST(p_size AS VARCHAR(9)) || ', "confidence": 0.5}}'
 WHEN 1 THEN 'Here it is: {{"patterns": ["' || p_name || '"], "suggestions": ["split"], "token_usage": {{"total_tokens": ' || CAST(p_partkey AS VARCHAR(9)) || '}}}} as asked.'
 WHEN 2 THEN '{{patterns:[' || p_name || '], confidence:None complexity_score:5.0 suggestions:[] processing_time:None}}'
 ELSE p_name END AS completion FROM {part}"""


def completion_rows(t):
    return t.spark.sql(COMPLETION, part=t.part)


@query("parse_completions", """
SELECT p_partkey AS candidate_id, p_partkey % 4 < 2 AS parsed, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '|') WHEN 1 THEN p_name ELSE 'unknown' END AS patterns,
 CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) ELSE 5.0 END AS complexity_score, CASE WHEN p_partkey % 4 = 0 THEN CAST(0.5 AS DOUBLE) END AS confidence,
 CASE WHEN p_partkey % 4 = 1 THEN p_partkey END AS total_tokens FROM part""")
def _(t):
    out = comp.parse_completions(completion_rows(t))
    return out.select("candidate_id", "parsed", F.array_join("patterns", "|").alias("patterns"), "complexity_score", "confidence",
                      F.try_element_at("token_usage", F.lit("total_tokens")).alias("total_tokens"))


@query("sync_alias", """
SELECT p_partkey AS candidate_id, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE replace(p_name, ' ', '|') END AS patterns,
 CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE replace(p_name, ' ', '|') END AS detected_patterns FROM part""")
def _(t):
    empty = F.array().cast("array<string>")
    rows = t.part.select(
        F.col("p_partkey").alias("candidate_id"),
        F.when(F.col("p_partkey") % 3 == 0, empty).otherwise(F.split("p_name", " ")).alias("patterns"),
        F.array("p_brand").alias("detected_patterns"),
    )
    out = comp.sync_alias(rows, "patterns", "detected_patterns")
    return out.withColumns({c: F.array_join(c, "|") for c in ("patterns", "detected_patterns")})


@query("combine_tags", """
SELECT p_partkey AS candidate_id, array_to_string(list_sort(list_distinct(CASE WHEN p_partkey % 8 < 4 THEN list_concat([p_type], string_split(p_name, ' ')) ELSE [p_type] END)), '|') AS combined,
 CASE WHEN p_partkey % 8 >= 4 THEN 'intermediate' WHEN p_size <= 3 THEN 'beginner' WHEN p_size >= 8 THEN 'advanced' ELSE 'intermediate' END AS skill_level FROM part""")
def _(t):
    tags = t.part.select(F.col("p_partkey").alias("candidate_id"), F.array("p_type").alias("tags"))
    answers = t.part.filter("p_partkey % 8 < 4").select(
        F.col("p_partkey").alias("candidate_id"), F.split("p_name", " ").alias("patterns"), F.col("p_size").cast("double").alias("complexity_score"))
    out = comp.combine_tags(tags, answers)
    return out.select("candidate_id", joined("combined_patterns").alias("combined"), "skill_level")
