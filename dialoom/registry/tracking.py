"""Experiment tracking as one append-only event table (exp_id, kind, key, value, number, at).

Kinds: start, metric, param, artifact, end. The current state is a view over the events.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

EVENTS = "exp_id STRING, kind STRING, key STRING, value STRING, number DOUBLE, at TIMESTAMP"


def metric_name(name: Column, step: Column) -> Column:
    """``name`` or ``name_step_n``."""
    return F.when(step.isNull(), name).otherwise(F.concat(name, F.lit("_step_"), step.cast("string")))


def experiments(events: DataFrame) -> DataFrame:
    """(exp_id, name, status, started_at, completed_at): running until an end event arrives."""
    def newest(kind: str, c: str) -> Column:
        return F.max_by(F.when(F.col("kind") == kind, F.col(c)), F.when(F.col("kind") == kind, F.struct("at", c)))

    return events.groupBy("exp_id").agg(
        newest("start", "value").alias("name"),
        F.coalesce(newest("end", "value"), F.lit("running")).alias("status"),
        F.min(F.when(F.col("kind") == "start", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("kind") == "end", F.col("at"))).alias("completed_at"))


def metrics(events: DataFrame) -> DataFrame:
    """(exp_id, metric, value): the newest value of every metric; parameters as ``param_<key>``."""
    rows = events.filter(F.col("kind").isin("metric", "param")).withColumn(
        "metric", F.when(F.col("kind") == "param", F.concat(F.lit("param_"), "key")).otherwise(F.col("key")))
    return rows.groupBy("exp_id", "metric").agg(F.max_by("number", F.struct("at", "number")).alias("value"))


def artifacts(events: DataFrame) -> DataFrame:
    """(exp_id, artifact): ``type:path``."""
    return events.filter(F.col("kind") == "artifact").select(
        "exp_id", F.concat_ws(":", "key", "value").alias("artifact"))


def list_experiments(state: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """Newest first, optionally of one status."""
    rows = state.filter(F.col("status") == status) if status else state
    return rows.orderBy(F.desc("started_at"), "exp_id").limit(limit)


def best_per_metric(values: DataFrame, exp_ids: list[str] | DataFrame) -> DataFrame:
    """(metric, exp_id, value): the best of the given experiments per metric.

    An experiment without the metric counts as 0; parameters are left out; the smaller id wins a tie.
    """
    spark = values.sparkSession
    wanted = exp_ids if isinstance(exp_ids, DataFrame) else spark.createDataFrame([(e,) for e in exp_ids], "exp_id STRING")
    rows = values.join(wanted.select("exp_id"), "exp_id", "left_semi").filter(~F.col("metric").startswith("param_"))
    n = wanted.select("exp_id").distinct().agg(F.count("*")).scalar()
    # a missing value is 0, so it wins only when every given value is below 0; then no id is named
    best = rows.groupBy("metric").agg(
        F.max("value").alias("top"), F.min_by("exp_id", F.struct(-F.col("value"), F.col("exp_id"))).alias("winner"),
        F.count("*").alias("have"))
    zero = (F.col("top") < 0) & (F.col("have") < n)
    return best.select("metric", F.when(~zero, F.col("winner")).alias("exp_id"),
                       F.when(zero, F.lit(0.0)).otherwise(F.col("top")).alias("value"))


class Tracker:
    """Writes experiment events below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/experiment_events"

    def events(self) -> DataFrame:
        schema = T._parse_datatype_string(EVENTS)
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def _append(self, rows: list[tuple]) -> None:
        df = self.spark.createDataFrame(rows, "exp_id STRING, kind STRING, key STRING, value STRING, number DOUBLE")
        df.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def start(self, name: str) -> str:
        new = f"exp_{uuid.uuid4().hex[:12]}"
        self._append([(new, "start", None, name, None)])
        return new

    def log_metrics(self, exp_id: str, values: dict[str, float], step: int | None = None) -> None:
        suffix = "" if step is None else f"_step_{step}"
        self._append([(exp_id, "metric", k + suffix, None, float(v)) for k, v in values.items()])

    def log_params(self, exp_id: str, values: dict) -> None:
        def number(v):
            return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
        self._append([(exp_id, "param", k, str(v), number(v)) for k, v in values.items()])

    def log_artifact(self, exp_id: str, path: str, kind: str = "model") -> None:
        self._append([(exp_id, "artifact", kind, path, None)])

    def end(self, exp_id: str, status: str = "completed") -> None:
        self._append([(exp_id, "end", None, status, None)])

    def save(self, path: str) -> None:
        """All events as JSON lines."""
        self.events().write.mode("errorifexists").json(path)


def load_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).json(path)
