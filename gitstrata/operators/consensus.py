"""Consensus over the results of several models.

Input is long: ``task_id, key, model_id, confidence, num_value, str_value``; a
key is numeric when ``num_value`` is set. Each method is a pair of aggregates:
values per (task, key) and confidence per task. Groups are as large as the
number of models, and all aggregates combine on the map side. Votes that
are dealt by task already (``common.dealt``) are not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASK = ["task_id"]
KEY = ["task_id", "key"]


def _confidence(votes: DataFrame, *more: Column) -> DataFrame:
    """One row per model and task: a model's confidence counts once, not once per key."""
    return votes.groupBy("task_id", "model_id").agg(F.max("confidence").alias("confidence"), *more)


def _by_value(votes: DataFrame, value: Column) -> DataFrame:
    """Number and text per key in two aggregates of one pass: votes for equal texts first, then the key.

    ``value`` is worked out from the sums of the first aggregate: ``wv`` (number x weight), ``w``, ``v``, ``n`` and the
    number of the first model by name, ``first``.
    """
    number = F.col("num_value").isNotNull()
    weight = F.when(number, F.col("confidence"))
    equal = votes.groupBy(*KEY, "str_value").agg(
        F.sum(F.col("num_value") * F.col("confidence")).alias("wv"), F.sum(weight).alias("w"), F.sum("num_value").alias("v"),
        F.count("num_value").alias("n"), F.min(F.when(number, F.struct("model_id", "num_value"))).alias("first"), F.count("str_value").alias("votes"),
    )
    chosen = F.min(F.when(F.col("str_value").isNotNull(), F.struct((-F.col("votes")).alias("votes"), "str_value")))
    return equal.groupBy(*KEY).agg(value.alias("num_value"), chosen["str_value"].alias("str_value"))


def consensus(votes: DataFrame, method: str, weights: DataFrame | None = None) -> DataFrame:
    """``task_id, key, num_value, str_value, confidence`` by one of four methods.

    ``confidence``: numbers weighted by confidence, most frequent text.
    ``weighted``: numbers divided by the weight of all models of the task, the
    heaviest model's text; ``weights`` holds ``model_id, weight`` (default 1).
    ``majority``: plain mean, most frequent text. ``best``: the whole result of
    the most confident model.
    """
    if method in ("confidence", "majority"):
        if method == "majority":
            value = F.try_divide(F.sum("v"), F.sum("n"))
        else:
            # all confidences zero: the first model's value stands
            value = F.coalesce(F.try_divide(F.sum("wv"), F.sum("w")), F.min("first")["num_value"])
        mean = _confidence(votes).groupBy(*TASK).agg(F.avg("confidence").alias("confidence"))
        return _by_value(votes, value).filter("num_value IS NOT NULL OR str_value IS NOT NULL").join(mean, TASK)
    if method == "weighted":
        if weights is None:
            weighed = votes.withColumn("weight", F.lit(1.0))
        else:
            weighed = votes.join(weights, "model_id", "left").fillna({"weight": 1.0})
        per_task = _confidence(weighed, F.max("weight").alias("weight")).groupBy(*TASK).agg(
            F.sum("weight").alias("total_weight"),
            (F.sum(F.col("confidence") * F.col("weight")) / F.sum("weight")).alias("confidence"),
        )
        heaviest = F.min(F.when(F.col("str_value").isNotNull(), F.struct((-F.col("weight")).alias("w"), "model_id", "str_value")))
        keyed = weighed.groupBy(*KEY).agg(F.sum(F.col("num_value") * F.col("weight")).alias("num_value"), heaviest["str_value"].alias("str_value"))
        out = keyed.filter("num_value IS NOT NULL OR str_value IS NOT NULL").join(per_task, TASK)
        return out.withColumn("num_value", F.col("num_value") / F.col("total_weight")).drop("total_weight")
    if method == "best":
        # Over a task's few rows, so nothing is joined: rows dealt by task are sorted once.
        of_model, of_task = Window.partitionBy("task_id", "model_id"), Window.partitionBy("task_id")
        ranked = votes.filter("task_id IS NOT NULL").withColumn("_model", F.max("confidence").over(of_model))
        ranked = ranked.withColumns({
            "_chosen": F.min_by("model_id", F.struct(-F.col("_model"), "model_id")).over(of_task), "_best": F.max("confidence").over(of_task),
        })
        return ranked.filter("model_id = _chosen").select(*KEY, "num_value", "str_value", F.col("_best").alias("confidence"))
    raise ValueError(f"unknown consensus method {method!r}")
