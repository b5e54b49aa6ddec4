"""The dataset registry: append-only tables; updates and deletions are events, the latest one wins.

Views are plain functions over the event tables and combine per dataset before any shuffle, so a
dataset updated a billion times costs one row per partition.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

DATASETS = ("id STRING, domain STRING, size BIGINT, generation_date TIMESTAMP, model_used STRING, file_path STRING, "
            "file_format STRING, notes STRING, created_at TIMESTAMP")
QUALITY = ("dataset_id STRING, completeness DOUBLE, consistency DOUBLE, realism DOUBLE, diversity DOUBLE, overall DOUBLE, "
           "issues_count INT, warnings_count INT, updated_at TIMESTAMP")
BIAS = "dataset_id STRING, bias_detected BOOLEAN, bias_severity STRING, updated_at TIMESTAMP"
RUNS = ("id STRING, dataset_id STRING, model_type STRING, accuracy DOUBLE, f1_score DOUBLE, precision_score DOUBLE, "
        "recall_score DOUBLE, training_time_seconds DOUBLE, notes STRING, trained_at TIMESTAMP")
DELETED = "dataset_id STRING, deleted_at TIMESTAMP"
SCHEMAS = {"datasets": DATASETS, "quality": QUALITY, "bias": BIAS, "runs": RUNS, "deleted": DELETED}
SCORES = ["completeness", "consistency", "realism", "diversity", "overall"]


def latest(events: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row per key; a partial maximum runs before the shuffle."""
    rest = [c for c in events.columns if c not in (key, at)]
    newest = F.max(F.struct(at, *rest))
    return events.groupBy(key).agg(newest.alias("_e")).select(key, *[f"_e.{c}" for c in (at, *rest)])


def live(rows: DataFrame, deleted: DataFrame, key: str, at: str) -> DataFrame:
    """Rows that are newer than the last tombstone of their dataset, by the time ``at``."""
    gone = deleted.groupBy(F.col("dataset_id").alias(key)).agg(F.max("deleted_at").alias("_gone"))
    return rows.join(gone, key, "left").filter(F.col("_gone").isNull() | (F.col(at) > F.col("_gone"))).drop("_gone")


def current_datasets(datasets: DataFrame, quality: DataFrame, bias: DataFrame, deleted: DataFrame) -> DataFrame:
    """Datasets with their newest quality and bias values; NULL where there are none."""
    q = latest(live(quality, deleted, "dataset_id", "updated_at"), "dataset_id", "updated_at").withColumnRenamed("dataset_id", "id")
    b = latest(live(bias, deleted, "dataset_id", "updated_at"), "dataset_id", "updated_at").withColumnRenamed("dataset_id", "id").drop("updated_at")
    out = latest(live(datasets, deleted, "id", "created_at"), "id", "created_at").join(q, "id", "left").join(b, "id", "left")
    return out.select(
        "id", "domain", "size", "generation_date", "model_used", "file_path", "file_format", "notes", "created_at",
        F.col("overall").alias("quality_score"), F.coalesce("bias_detected", F.lit(False)).alias("bias_detected"),
        "bias_severity", *SCORES[:-1], F.col("overall").alias("quality_overall"), "issues_count", "warnings_count",
        F.col("updated_at").alias("quality_updated_at"))


def list_datasets(current: DataFrame, domain: str | None = None) -> DataFrame:
    """Newest first, optionally of one domain."""
    rows = current.filter(F.col("domain") == domain) if domain else current
    return rows.orderBy(F.desc("generation_date"), "id")


def training_history(runs: DataFrame, dataset_id: str | Column) -> DataFrame:
    """Runs of one dataset, newest first."""
    return runs.filter(F.col("dataset_id") == dataset_id).orderBy(F.desc("trained_at"), "id")


def stats(current: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: datasets, runs, mean of the known quality scores."""
    whole = current.agg(F.count("*").alias("total_datasets"), F.avg("quality_score").alias("average_quality_score"))
    return whole.withColumn("total_training_runs", runs.agg(F.count("*")).scalar())


def datasets_by_domain(current: DataFrame) -> DataFrame:
    return current.groupBy("domain").agg(F.count("*").alias("n"))


def summary(current: DataFrame) -> DataFrame:
    """One row: datasets, samples, mean of the non-zero quality scores (0 if none), distinct domains."""
    return current.agg(
        F.count("*").alias("datasets"), F.coalesce(F.sum("size"), F.lit(0)).alias("samples"),
        F.coalesce(F.avg(F.nullif("quality_score", F.lit(0.0))), F.lit(0.0)).alias("avg_quality"),
        F.countDistinct(F.coalesce("domain", F.lit("unknown"))).alias("domains"))


def run_summary(current: DataFrame, runs: DataFrame) -> DataFrame:
    """One row over the runs of all live datasets: runs, best accuracy, model types, datasets."""
    rows = runs.join(current.select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi")
    return rows.agg(
        F.count("*").alias("runs"), F.coalesce(F.max("accuracy"), F.lit(0.0)).alias("best_accuracy"),
        F.countDistinct(F.coalesce("model_type", F.lit("unknown"))).alias("model_types"),
        F.countDistinct("dataset_id").alias("datasets"))


def latest_runs(current: DataFrame, runs: DataFrame, k: int = 10) -> DataFrame:
    rows = runs.join(current.select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi")
    return rows.orderBy(F.desc("trained_at"), "id").limit(k)


def largest_dataset(current: DataFrame) -> DataFrame:
    """The dataset with most rows; the smaller id wins a tie."""
    return current.orderBy(F.desc("size"), "id").limit(1)


def compacted(events: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The event tables without the rows that no view can need any more; every view of them, with any later events added, stays the same.

    The newest row of a key hides all older ones, now and later, and a tombstone all rows up to its time. Tombstones themselves stay, the newest of
    each dataset, because an older row may still come in.
    """
    deleted = events["deleted"].groupBy("dataset_id").agg(F.max("deleted_at").alias("deleted_at"))
    out = {"deleted": deleted, "runs": live(events["runs"], deleted, "dataset_id", "trained_at")}
    for name, key, at in (("datasets", "id", "created_at"), ("quality", "dataset_id", "updated_at"), ("bias", "dataset_id", "updated_at")):
        out[name] = latest(live(events[name], deleted, key, at), key, at)
    return out


class Registry:
    """The event tables below one folder, as Parquet: a log to which every call appends, and snapshots of its current state.

    A snapshot holds the compacted tables and the names of the log files that it covers, its high-water mark. A view reads the
    newest whole snapshot and the log files that came after it. Names are the mark, not times: an event that is written late counts whatever time it carries.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, paths: str | list[str], schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(*([paths] if isinstance(paths, str) else paths))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def _newest_snapshot(self) -> str | None:
        """The folder of the newest snapshot; its mark is written last, so a broken one is never found."""
        mark = self._read(f"{self.root}/marks", T._parse_datatype_string("number BIGINT, folder STRING"))
        row = mark.agg(F.max_by("folder", "number").alias("folder")).first()
        return row["folder"]

    def table(self, name: str) -> DataFrame:
        """The snapshot's rows and those of all later log files; without a snapshot the whole log."""
        schema = T._parse_datatype_string(SCHEMAS[name])
        log, folder = self._read(f"{self.root}/{name}", schema), self._newest_snapshot()
        if folder is None:
            return log
        covered = {r["file"] for r in self.spark.read.parquet(f"{folder}/covered").filter(F.col("name") == name).collect()}      # the driver lists the files anyway
        later = [f for f in log.inputFiles() if f not in covered]
        old = self._read(f"{folder}/{name}", schema)
        return old.unionByName(self._read(later, schema)) if later else old

    def compact(self) -> str:
        """Writes a snapshot of all events so far and returns its folder. It reads the one before and the log files after it, and no other."""
        last, number = self._newest_snapshot(), self._read(f"{self.root}/marks", T._parse_datatype_string("number BIGINT, folder STRING")).count() + 1
        folder = f"{self.root}/snapshots/{number}-{uuid.uuid4().hex}"
        logs = {n: self._read(f"{self.root}/{n}", T._parse_datatype_string(s)).inputFiles() for n, s in SCHEMAS.items()}
        events = {}
        for name, text in SCHEMAS.items():
            schema = T._parse_datatype_string(text)
            done = set() if last is None else {r["file"] for r in self.spark.read.parquet(f"{last}/covered").filter(F.col("name") == name).collect()}
            later = [f for f in logs[name] if f not in done]
            rows = self._read(later, schema) if later else self.spark.createDataFrame([], schema)
            events[name] = rows if last is None else rows.unionByName(self._read(f"{last}/{name}", schema))
        for name, rows in compacted(events).items():
            rows.write.parquet(f"{folder}/{name}")
        files = [(n, f) for n, found in logs.items() for f in found]
        self.spark.createDataFrame(files, "name STRING, file STRING").write.parquet(f"{folder}/covered")
        self.spark.createDataFrame([(number, folder)], "number BIGINT, folder STRING").coalesce(1).write.mode("append").parquet(f"{self.root}/marks")
        return folder

    def append(self, name: str, rows: DataFrame) -> None:
        """Appends rows; missing columns are NULL, a missing time is now."""
        fields = T._parse_datatype_string(SCHEMAS[name]).fields
        have = set(rows.columns)
        stamps = {"created_at", "updated_at", "trained_at", "deleted_at", "generation_date"}
        rows.select(*[
            (F.col(f.name) if f.name in have else F.current_timestamp() if f.name in stamps else F.lit(None))
            .cast(f.dataType).alias(f.name) for f in fields]).write.mode("append").parquet(f"{self.root}/{name}")

    def _row(self, **values) -> DataFrame:
        return self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])

    def register_dataset(self, domain: str, rows: DataFrame | int, file_path: str, file_format: str = "json",
                         model_used: str = "unknown", notes: str | None = None) -> str:
        """Appends a dataset; ``rows`` is its size or the dataset itself, which Spark then counts."""
        new = f"ds_{uuid.uuid4().hex[:12]}"
        size = rows if isinstance(rows, int) else rows.count()
        self.append("datasets", self._row(id=new, domain=domain, size=size, file_path=file_path, file_format=file_format,
                                          model_used=model_used, notes=notes))
        return new

    def register_from_metadata(self, metadata: DataFrame) -> None:
        """Appends every row of a metadata table (domain, size, file_path, file_format, model_used, notes)."""
        fresh = F.concat(F.lit("ds_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))
        self.append("datasets", metadata if "id" in metadata.columns else metadata.withColumn("id", fresh))

    def update_quality(self, dataset_id: str, quality: DataFrame) -> None:
        """Appends the row of ``operators.quality.quality`` for a dataset."""
        self.append("quality", quality.select(
            F.lit(dataset_id).alias("dataset_id"), *SCORES, F.col("issues").alias("issues_count"),
            F.col("warnings").alias("warnings_count")))

    def update_bias(self, dataset_id: str, bias: DataFrame) -> None:
        """Appends the row of ``operators.bias.detect`` for a dataset."""
        self.append("bias", bias.select(F.lit(dataset_id).alias("dataset_id"), "bias_detected",
                                        F.col("severity").alias("bias_severity")))

    def register_run(self, dataset_id: str, model_type: str, **results) -> str:
        """Appends a training run; a metric that is not given is NULL."""
        new = f"run_{uuid.uuid4().hex[:12]}"
        names = {"precision": "precision_score", "recall": "recall_score", "training_time": "training_time_seconds"}
        self.append("runs", self._row(id=new, dataset_id=dataset_id, model_type=model_type,
                                      **{names.get(k, k): v for k, v in results.items()}))
        return new

    def delete_dataset(self, dataset_id: str) -> bool:
        """Appends a tombstone; False if there is no such live dataset."""
        if self.get(dataset_id).isEmpty():
            return False
        self.append("deleted", self._row(dataset_id=dataset_id))
        return True

    def current(self) -> DataFrame:
        return current_datasets(*[self.table(n) for n in ("datasets", "quality", "bias", "deleted")])

    def runs(self) -> DataFrame:
        return live(self.table("runs"), self.table("deleted"), "dataset_id", "trained_at")

    def get(self, dataset_id: str) -> DataFrame:
        """The dataset as one row, or no row. The filter reaches every event table before its aggregate."""
        one = {n: self.table(n).filter(F.col("id" if n == "datasets" else "dataset_id") == dataset_id)
               for n in ("datasets", "quality", "bias", "deleted")}
        return current_datasets(one["datasets"], one["quality"], one["bias"], one["deleted"])
