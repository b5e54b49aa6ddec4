"""H: registry and experiment views. Datasets are customers, events and runs are their orders. F8, F9: summaries."""

from pyspark.sql import functions as F

from dialoom.registry import tables as R, tracking as K
from dialoom.session import shared_path
from suite.base import query, rounded, table


def _datasets(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.cast("string").alias("id"), F.col("c_mktsegment").alias("domain"), (k % 97).alias("size"),
        F.timestamp_seconds(F.lit(1700000000) + k * 3600).alias("generation_date"), F.lit("m").alias("model_used"),
        F.concat(F.lit("/data/"), "c_name").alias("file_path"), F.lit("json").alias("file_format"),
        F.lit(None).cast("string").alias("notes"), F.lit(None).cast("timestamp").alias("created_at"))


def _quality(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderkey % 3 = 0")
    x = F.col("o_totalprice") / 1000000
    return o.select(F.col("o_custkey").cast("string").alias("dataset_id"), x.alias("completeness"), x.alias("consistency"),
                    x.alias("realism"), x.alias("diversity"), (F.col("o_orderkey") % 101).cast("double").alias("overall"),
                    (F.col("o_orderkey") % 7).cast("int").alias("issues_count"), F.lit(0).alias("warnings_count"),
                    F.timestamp_seconds(F.col("o_orderkey")).alias("updated_at"))


def _bias(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderkey % 3 <> 0")
    return o.select(F.col("o_custkey").cast("string").alias("dataset_id"), (F.col("o_orderstatus") != "F").alias("bias_detected"),
                    F.when(F.col("o_orderstatus") == "F", "none").otherwise("low").alias("bias_severity"),
                    F.timestamp_seconds(F.col("o_orderkey")).alias("updated_at"))


def _deleted(spark, sf):
    return table(spark, sf, "customer").filter("c_custkey % 10 = 9").select(
        F.col("c_custkey").cast("string").alias("dataset_id"), F.current_timestamp().alias("deleted_at"))


def _runs(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("dataset_id"),
                    F.col("o_orderpriority").alias("model_type"), (F.col("o_totalprice") / 600000).alias("accuracy"),
                    F.lit(None).cast("double").alias("f1_score"), F.col("o_orderdate").cast("timestamp").alias("trained_at"))


def _current(spark, sf):
    return R.current_datasets(_datasets(spark, sf), _quality(spark, sf), _bias(spark, sf), _deleted(spark, sf))


CURRENT = """q AS (SELECT o_custkey AS k, o_orderkey % 101 AS overall, o_totalprice / 1000000 AS x, o_orderkey % 7 AS issues FROM orders
    WHERE o_orderkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
b AS (SELECT o_custkey AS k, o_orderstatus <> 'F' AS det, CASE o_orderstatus WHEN 'F' THEN 'none' ELSE 'low' END AS sev FROM orders
    WHERE o_orderkey % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
cur AS (SELECT c_custkey AS k, c_mktsegment AS domain, c_custkey % 97 AS size, overall::DOUBLE AS score, x, issues, coalesce(det, false) AS det, sev
  FROM customer LEFT JOIN q ON q.k = c_custkey LEFT JOIN b ON b.k = c_custkey WHERE c_custkey % 10 <> 9)"""


@query("h2_h4_h5_current_datasets", f"""WITH {CURRENT} SELECT k::VARCHAR AS id, domain, size, score AS quality_score, round(x, 6) AS realism, issues::BIGINT AS issues_count, det AS bias_detected, sev AS bias_severity FROM cur""")
def current(spark, sf):
    return rounded(_current(spark, sf).select(
        "id", "domain", "size", "quality_score", "realism", F.col("issues_count").cast("bigint").alias("issues_count"), "bias_detected", "bias_severity"))


@query("h8_snapshot_view", f"""WITH {CURRENT} SELECT k::VARCHAR AS id, domain, size, score AS quality_score, round(x, 6) AS realism, issues::BIGINT AS issues_count, det AS bias_detected, sev AS bias_severity FROM cur""")
def snapshot_view(spark, sf):
    """The same view from files: half of the events lie in a snapshot, the other half came after it."""
    reg = R.Registry(spark, shared_path(spark, "registry"))
    events = {"datasets": _datasets(spark, sf), "quality": _quality(spark, sf), "bias": _bias(spark, sf), "deleted": _deleted(spark, sf)}
    for half in (0, 1):
        for name, rows in events.items():
            key = F.xxhash64(*[c for c in rows.columns if not c.endswith("_at")])
            reg.append(name, rows.filter(F.pmod(key, F.lit(2)) == half))
        if half == 0:
            reg.compact()
    return rounded(reg.current().select(
        "id", "domain", "size", "quality_score", "realism", F.col("issues_count").cast("bigint").alias("issues_count"), "bias_detected", "bias_severity"))


@query("h3_list_datasets", f"""WITH {CURRENT} SELECT k::VARCHAR AS id, score AS quality_score FROM cur WHERE domain = 'BUILDING'""")
def list_datasets(spark, sf):
    return R.list_datasets(_current(spark, sf), "BUILDING").select("id", "quality_score")


@query("h1_h2_registered_dataset", """SELECT count(*) AS size, 'customer_service' AS domain, 2::DOUBLE AS quality_overall, 1 AS live FROM documents""")
def registered(spark, sf):
    """Registers ``documents``, updates its quality twice, registers and deletes another one."""
    reg = R.Registry(spark, shared_path(spark, "registry"))
    kept = reg.register_dataset("customer_service", table(spark, sf, "documents"), "/data/documents.parquet", "parquet")
    gone = reg.register_dataset("customer_service", table(spark, sf, "labels"), "/data/labels.parquet", "parquet")
    for score in (1.0, 2.0):
        row = spark.range(1).select(*[F.lit(score).alias(c) for c in R.SCORES], F.lit(0).alias("issues"), F.lit(0).alias("warnings"))
        reg.update_quality(kept, row)
    reg.delete_dataset(gone)
    return reg.get(kept).select("size", "domain", "quality_overall", F.lit(1).alias("live")).withColumn(
        "live", reg.current().agg(F.count("*").cast("int")).scalar())


@query("h7_training_history", """SELECT o_orderkey::VARCHAR AS id, round(o_totalprice / 600000, 6) AS accuracy FROM orders
  WHERE o_custkey = (SELECT min(o_custkey) FROM orders)""")
def history(spark, sf):
    first = table(spark, sf, "orders").agg(F.min("o_custkey").cast("string")).scalar()
    return rounded(R.training_history(_runs(spark, sf), first).select("id", "accuracy"))


@query("h6_runs_per_dataset", """SELECT o_custkey::VARCHAR AS dataset_id, count(*) AS runs, round(max(o_totalprice) / 600000, 6) AS best FROM orders
  WHERE o_custkey % 10 <> 9 GROUP BY 1""")
def runs_per_dataset(spark, sf):
    rows = R.live(_runs(spark, sf), _deleted(spark, sf), "dataset_id", "trained_at")
    return rounded(rows.groupBy("dataset_id").agg(F.count("*").alias("runs"), F.max("accuracy").alias("best")))


@query("h8_live_after_delete", """SELECT c_custkey::VARCHAR AS id FROM customer WHERE c_custkey % 10 <> 9""")
def live(spark, sf):
    return R.live(_datasets(spark, sf), _deleted(spark, sf), "id", "created_at").select("id")


@query("h12_largest_dataset", f"WITH {CURRENT} SELECT k::VARCHAR AS id, size FROM cur ORDER BY size DESC, k::VARCHAR LIMIT 1")
def largest(spark, sf):
    return R.largest_dataset(_current(spark, sf)).select("id", "size")


@query("h13_stats", f"""WITH {CURRENT} SELECT count(*) AS total_datasets, round(avg(score), 6) AS average_quality_score,
  (SELECT count(*) FROM orders WHERE o_custkey % 10 <> 9) AS total_training_runs FROM cur""")
def stats(spark, sf):
    return rounded(R.stats(_current(spark, sf), R.live(_runs(spark, sf), _deleted(spark, sf), "dataset_id", "trained_at")))


@query("h13_datasets_by_domain", f"WITH {CURRENT} SELECT domain, count(*) AS n FROM cur GROUP BY 1")
def by_domain(spark, sf):
    return R.datasets_by_domain(_current(spark, sf))


@query("f8_registry_summary", f"""WITH {CURRENT} SELECT count(*) AS datasets, sum(size)::BIGINT AS samples, round(coalesce(avg(nullif(score, 0)), 0), 6) AS avg_quality,
  count(DISTINCT domain) AS domains FROM cur""")
def summary(spark, sf):
    return rounded(R.summary(_current(spark, sf)))


@query("f9_run_summary", """SELECT count(*) AS runs, round(max(o_totalprice) / 600000, 6) AS best_accuracy, count(DISTINCT o_orderpriority) AS model_types,
  count(DISTINCT o_custkey) AS datasets FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 10 <> 9""")
def run_summary(spark, sf):
    return rounded(R.run_summary(_current(spark, sf), _runs(spark, sf)))


@query("f9_latest_runs", """SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS model_type FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE c_custkey % 10 <> 9 ORDER BY o_orderdate DESC, o_orderkey::VARCHAR LIMIT 10""")
def latest_runs(spark, sf):
    return R.latest_runs(_current(spark, sf), _runs(spark, sf)).select("id", "model_type")


# ---------------------------------------------------------------- experiments: one per user of ``events``

def _events(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "end")\
        .when(F.col("event_type") == "click", "param").when(F.col("event_type") == "view", "artifact").otherwise("metric")
    return e.select(
        F.col("user_id").cast("string").alias("exp_id"), kind.alias("kind"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("key"),
        F.when(kind == "end", F.when(F.col("event_id") % 2 == 0, "completed").otherwise("failed"))
        .otherwise(F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("value"),
        (F.col("value") - 50).alias("number"), F.col("ts").cast("timestamp").alias("at"))


EXP = """e AS (SELECT user_id::VARCHAR AS exp_id, event_type, event_id, value - 50 AS number, ts, 'm' || event_id % 3 AS key FROM events),
st AS (SELECT exp_id, max_by('v' || event_id, ts) FILTER (event_type = 'signup') AS name,
  coalesce(max_by(CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE 'failed' END, ts) FILTER (event_type = 'error'), 'running') AS status,
  min(ts) FILTER (event_type = 'signup') AS started FROM e GROUP BY 1),
met AS (SELECT exp_id, CASE event_type WHEN 'click' THEN 'param_' || key ELSE key END AS metric, max_by(number, ts) AS value
  FROM e WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2)"""


@query("h9_experiment_state", f"WITH {EXP} SELECT exp_id, name, status FROM st")
def state(spark, sf):
    return K.experiments(_events(spark, sf)).select("exp_id", "name", "status")


@query("h9_experiment_metrics", f"WITH {EXP} SELECT exp_id, metric, round(value, 6) AS value FROM met")
def metrics(spark, sf):
    return rounded(K.metrics(_events(spark, sf)))


@query("h9_metric_names", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type ELSE event_type || '_step_' || event_id % 4 END AS metric FROM events""")
def metric_names(spark, sf):
    step = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4)
    return table(spark, sf, "events").select("event_id", K.metric_name(F.col("event_type"), step).alias("metric"))


@query("h9_experiment_artifacts", f"WITH {EXP} SELECT exp_id, key || ':v' || event_id AS artifact FROM e WHERE event_type = 'view'")
def artifacts(spark, sf):
    return K.artifacts(_events(spark, sf))


@query("h10_list_experiments", f"WITH {EXP} SELECT exp_id, status FROM st WHERE status = 'failed' ORDER BY started DESC NULLS LAST, exp_id LIMIT 50")
def list_experiments(spark, sf):
    return K.list_experiments(K.experiments(_events(spark, sf)), "failed").select("exp_id", "status")


@query("h11_compare_experiments", f"""WITH {EXP}, f AS (SELECT * FROM met WHERE metric NOT LIKE 'param_%' AND exp_id IN (SELECT exp_id FROM st WHERE status <> 'running'))
  SELECT metric, exp_id, round(value, 6) AS value FROM f QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, exp_id) = 1""")
def compare_experiments(spark, sf):
    events = _events(spark, sf)
    ended = K.experiments(events).filter("status <> 'running'")
    return rounded(K.best_per_metric(K.metrics(events), ended))


@query("h14_saved_events", "SELECT user_id::VARCHAR AS exp_id, count(*) AS n, round(sum(value - 50), 4) AS total FROM events GROUP BY 1")
def saved(spark, sf):
    path = shared_path(spark, "experiments")
    _events(spark, sf).write.json(path)
    return rounded(K.load_events(spark, path).groupBy("exp_id").agg(F.count("*").alias("n"), F.sum("number").alias("total")), 4)
