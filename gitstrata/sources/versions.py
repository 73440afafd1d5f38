"""Tables that change by small steps: a base, the changes after it, and a log of what counts.

Every step (one micro-batch, one load) writes only what it changes, as one Parquet folder of its own, and then one line in the
log. Readers see what the log names, so a step that failed half way is not there, and a repeated step writes
its own folder again. Every ``compact_every`` steps the changes are folded into a new base, so a read opens one
base and at most ``compact_every`` changes. Folders are never rewritten by later steps: an older version can be read as long as it is kept.

``PartTable`` holds parts that add up (sums, counts). ``KeyedTable`` holds the rows of keys: a step replaces all
rows of the keys it names, or takes the keys away.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "step long, kind string"


class StepTable:
    """Folders of steps below ``path`` and the log that names them."""

    def __init__(self, spark: SparkSession, path: str, schema: str, compact_every: int = 16) -> None:
        self.spark, self.path, self.schema, self.compact_every = spark, path.rstrip("/"), schema, compact_every

    def steps(self, upto: int | None = None) -> tuple[int | None, list[int]]:
        """The latest base and the changes after it, as of step ``upto``; a line per step is all that is read."""
        try:
            log = self.spark.read.schema(LOG).json(f"{self.path}/log/*").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None, []
        log = [r for r in log if upto is None or r.step <= upto]
        base = max((r.step for r in log if r.kind == "base"), default=None)
        return base, sorted({r.step for r in log if r.kind == "change" and (base is None or r.step > base)})

    def folder(self, kind: str, step: int) -> str:
        return f"{self.path}/{kind}/{step:012d}"

    def stored(self, kind: str, steps: Sequence[int]) -> DataFrame:
        """The rows of some steps with their number as ``_step``."""
        rows = None
        for step in steps:
            one = self.spark.read.schema(self.schema).parquet(self.folder(kind, step)).withColumn("_step", F.lit(step).cast("long"))
            rows = one if rows is None else rows.unionByName(one)
        return rows if rows is not None else self.spark.createDataFrame([], f"{self.schema}, _step long")

    def commit(self, rows: DataFrame, kind: str, step: int) -> None:
        rows.write.mode("overwrite").parquet(self.folder(kind, step))
        line = self.spark.range(1).select(F.lit(step).cast("long").alias("step"), F.lit(kind).alias("kind"))
        line.write.mode("overwrite").json(f"{self.path}/log/{step:012d}-{kind}")

    def write(self, rows: DataFrame, step: int) -> None:
        """One step; a base follows when enough changes stand behind the last one."""
        self.commit(rows, "change", step)
        if len(self.steps(step)[1]) >= self.compact_every:
            self.compact(step)

    def compact(self, step: int) -> None:
        self.commit(self.folded(step), "base", step)

    def folded(self, upto: int | None = None) -> DataFrame:
        raise NotImplementedError


class PartTable(StepTable):
    """Parts that ``merge`` adds up; merging merged parts again must give the same."""

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], compact_every: int = 16) -> None:
        super().__init__(spark, path, schema, compact_every)
        self.merge = merge

    def folded(self, upto: int | None = None) -> DataFrame:
        base, changes = self.steps(upto)
        rows = self.stored("change", changes)
        if base is not None:
            rows = rows.unionByName(self.stored("base", [base]))
        return self.merge(rows.drop("_step"))

    read = folded


class KeyedTable(StepTable):
    """Rows by key. A step replaces all rows of its keys; a row with ``_gone`` true takes its key away."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str, compact_every: int = 16) -> None:
        super().__init__(spark, path, f"{schema}, _gone boolean", compact_every)
        self.keys = list(keys)

    def put(self, rows: DataFrame, step: int, gone: DataFrame | None = None) -> None:
        """Replaces the rows of all keys in ``rows`` and takes away the keys of ``gone``; a key in both keeps its rows."""
        change = rows.withColumn("_gone", F.lit(False))
        if gone is not None:
            marks = gone.select(*self.keys).distinct().join(rows.select(*self.keys), self.keys, "left_anti").withColumn("_gone", F.lit(True))
            change = change.unionByName(marks, allowMissingColumns=True)
        self.write(change.select(*[c for c in self.columns if c in change.columns]), step)

    @property
    def columns(self) -> list[str]:
        return [part.split()[0] for part in _fields(self.schema)]

    def folded(self, upto: int | None = None) -> DataFrame:
        base, changes = self.steps(upto)
        later = self.stored("change", changes)
        if len(changes) > 1:
            # Only rows of the last step of their key count.
            last = later.groupBy(*self.keys).agg(F.max("_step").alias("_last"))
            later = later.join(last, self.keys).filter("_step = _last").drop("_last")
        rows = later
        if base is not None:
            # The base is not shuffled where the changed keys are few: Spark broadcasts them by their size.
            rows = self.stored("base", [base]).join(later.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(later)
        return rows.filter("NOT _gone").drop("_step")

    def read(self, upto: int | None = None) -> DataFrame:
        return self.folded(upto).drop("_gone")


def _fields(schema: str) -> list[str]:
    """The fields of a schema text, split at commas outside brackets."""
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]
