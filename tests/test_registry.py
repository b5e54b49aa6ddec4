"""Registry and tracking on files."""

import datetime
import random
import time

from pyspark.sql import functions as F

from dialoom.registry.tables import SCORES, Registry, datasets_by_domain, list_datasets, stats
from dialoom.registry.tracking import Tracker, artifacts, best_per_metric, experiments, list_experiments, load_events, metrics


def scored(spark, value):
    return spark.range(1).select(*[F.lit(value).alias(c) for c in SCORES], F.lit(3).alias("issues"), F.lit(1).alias("warnings"))


def test_registry(spark, tmp_path):
    reg = Registry(spark, str(tmp_path))
    assert reg.current().count() == 0 and stats(reg.current(), reg.runs()).first()["average_quality_score"] is None
    a = reg.register_dataset("customer_service", 10, "/a")
    time.sleep(0.05)
    b = reg.register_dataset("time_series", spark.range(7), "/b", notes="n")
    assert reg.get(b).first()["size"] == 7 and reg.get("nope").isEmpty()
    assert reg.get(a).first()["quality_overall"] is None
    reg.update_quality(a, scored(spark, 50.0))
    time.sleep(0.05)
    reg.update_quality(a, scored(spark, 80.0))
    row = reg.get(a).first()
    assert row["quality_score"] == 80.0 and row["issues_count"] == 3 and row["bias_detected"] is False
    reg.update_bias(a, spark.sql("SELECT true bias_detected, 'low' severity"))
    assert reg.get(a).first()["bias_severity"] == "low"
    reg.register_run(a, "logistic_regression", accuracy=0.5, precision=0.4)
    run = reg.runs().first()
    assert run["accuracy"] == 0.5 and run["precision_score"] == 0.4 and run["f1_score"] is None
    assert [r["id"] for r in list_datasets(reg.current()).collect()] == [b, a]
    s = stats(reg.current(), reg.runs()).first()
    assert (s["total_datasets"], s["total_training_runs"], s["average_quality_score"]) == (2, 1, 80.0)
    assert {r["domain"]: r["n"] for r in datasets_by_domain(reg.current()).collect()} == {"customer_service": 1, "time_series": 1}
    assert reg.delete_dataset("nope") is False and reg.delete_dataset(a) is True and reg.delete_dataset(a) is False
    assert reg.get(a).isEmpty() and reg.runs().count() == 0 and reg.current().count() == 1
    folder = reg.compact()
    assert spark.read.parquet(f"{folder}/quality").count() == 0 and spark.read.parquet(f"{folder}/datasets").count() == 1 and reg.current().count() == 1


def test_tracking(spark, tmp_path):
    t = Tracker(spark, str(tmp_path))
    a, b = t.start("one"), t.start("two")
    t.log_metrics(a, {"accuracy": 0.5})
    t.log_metrics(a, {"accuracy": 0.7, "loss": -1.0})
    t.log_metrics(b, {"accuracy": 0.6}, step=2)
    t.log_params(a, {"max_features": 10, "kind": "x"})
    t.log_artifact(a, "/m")
    t.end(a)
    state = {r["exp_id"]: r for r in experiments(t.events()).collect()}
    assert state[a]["status"] == "completed" and state[b]["status"] == "running" and state[a]["name"] == "one"
    assert list_experiments(experiments(t.events()), "running").count() == 1
    values = {(r["exp_id"], r["metric"]): r["value"] for r in metrics(t.events()).collect()}
    assert values[a, "accuracy"] == 0.7 and values[b, "accuracy_step_2"] == 0.6 and values[a, "param_max_features"] == 10
    assert artifacts(t.events()).first()["artifact"] == "model:/m"
    best = {r["metric"]: (r["exp_id"], r["value"]) for r in best_per_metric(metrics(t.events()), [a, b]).collect()}
    assert best["accuracy"] == (a, 0.7) and best["loss"][1] == 0.0 and "param_max_features" not in best
    t.save(str(tmp_path / "saved"))
    assert load_events(spark, str(tmp_path / "saved")).count() == t.events().count()


def test_a_deleted_id_can_be_registered_again(spark, tmp_path):
    reg = Registry(spark, str(tmp_path))
    row = lambda size: spark.sql(f"SELECT 'ds' id, 'd' domain, {size} size, '/p' file_path")
    reg.append("datasets", row(1))
    reg.update_quality("ds", scored(spark, 50.0))
    time.sleep(0.05)
    assert reg.delete_dataset("ds") and reg.get("ds").isEmpty()
    time.sleep(0.05)
    reg.append("datasets", row(2))
    assert [(r["size"], r["quality_overall"]) for r in reg.get("ds").collect()] == [(2, None)]
    time.sleep(0.05)
    reg.append("datasets", row(3))          # registered while it lives: the newest one counts
    assert [r["size"] for r in reg.get("ds").collect()] == [3]


def test_snapshots_change_no_view(spark, tmp_path):
    """Views of snapshots and later events equal the views of all events, with late, deleted and re-registered datasets."""
    rng = random.Random(4)
    plain, packed = Registry(spark, str(tmp_path / "plain")), Registry(spark, str(tmp_path / "packed"))
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)
    for step in range(3):
        ids = [str(rng.randrange(8)) for _ in range(14)]
        time_ = lambda: at(rng.randrange(200))  # noqa: E731, B023  (events also come late)
        rows = {"datasets": spark.createDataFrame([(i, f"d{step}", step, at(0), time_()) for i in ids], "id string, domain string, size bigint, generation_date timestamp, created_at timestamp"),
                "quality": spark.createDataFrame([(i, rng.random(), time_()) for i in ids], "dataset_id string, overall double, updated_at timestamp"),
                "bias": spark.createDataFrame([(i, True, rng.choice("ab"), time_()) for i in ids], "dataset_id string, bias_detected boolean, bias_severity string, updated_at timestamp"),
                "runs": spark.createDataFrame([(f"r{step}{k}", i, time_()) for k, i in enumerate(ids)], "id string, dataset_id string, trained_at timestamp"),
                "deleted": spark.createDataFrame([(i, time_()) for i in ids[:3]], "dataset_id string, deleted_at timestamp")}
        for name, df in rows.items():
            plain.append(name, df)
            packed.append(name, df)
        if step in (0, 1):
            folder = packed.compact()
        for view in ("current", "runs"):
            assert sorted(map(repr, getattr(packed, view)().collect())) == sorted(map(repr, getattr(plain, view)().collect()))
        assert sorted(map(repr, packed.get("3").collect())) == sorted(map(repr, plain.get("3").collect()))
    assert spark.read.parquet(f"{folder}/quality").groupBy("dataset_id").count().filter("count > 1").isEmpty()
    later = [f for f in packed.table("quality").inputFiles() if "/snapshots/" not in f]
    assert later and len(later) < len(plain.table("quality").inputFiles()) / 2      # what the snapshot covers is not read again


def test_deleted_and_registered_again(spark, tmp_path):
    reg = Registry(spark, str(tmp_path))
    rows = lambda n: spark.createDataFrame([("x", "d", n, datetime.datetime(2024, 1, n))], "id string, domain string, size bigint, created_at timestamp")
    reg.append("datasets", rows(1))
    reg.append("deleted", spark.createDataFrame([("x", datetime.datetime(2024, 1, 2))], "dataset_id string, deleted_at timestamp"))
    reg.compact()
    assert reg.current().count() == 0
    reg.append("datasets", rows(3))
    assert reg.current().first()["size"] == 3
    reg.compact()
    reg.append("datasets", rows(2))      # a late row, no newer than the deletion
    assert reg.current().first()["size"] == 3 and reg.compact() != reg.compact()
