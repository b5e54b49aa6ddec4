"""All stages on one small dataset."""

import json

from pyspark.sql import functions as F

from dialoom.registry.tables import Registry
from dialoom.run import RunConfig, run_existing
from dialoom.training.models import ModelConfig

TEXT = {"card_arrival": "my new card has not arrived yet", "age_limit": "how old must my child be to join", "exchange_rate": "what rate do you use for dollars"}


def test_run_existing(spark, tmp_path):
    rows = [(f"c{i:03d}", k, ["positive", "neutral", "neutral", "negative"][i % 4], ["en", "es"][i % 2], f"{t} {i}")
            for i, (k, t) in enumerate(list(TEXT.items()) * 20)]
    df = spark.createDataFrame(rows, "conversation_id STRING, intent STRING, sentiment STRING, language STRING, text STRING").select(
        "conversation_id", "intent", "sentiment", "language", F.lit("medium").alias("complexity"), F.lit("resolved").alias("resolution_status"),
        F.array(F.struct(F.lit("customer").alias("speaker"), F.col("text")), F.struct(F.lit("agent").alias("speaker"), F.lit("Let me check that").alias("text")))
        .alias("turns"))
    reference = df.select("intent")
    reg = Registry(spark, str(tmp_path / "registry"))
    config = RunConfig(model_types=("logistic_regression",), model=ModelConfig(max_features=200, ngram_range=(1, 1), min_df=1, model_params={"max_iter": 20}),
                       quality_limit=50.0, bias_limit="high")
    row = run_existing(df, reference, reg, "/data/x", config=config, report_path=str(tmp_path / "report")).first()
    assert row["conversations"] == 60 and row["accuracy"] > 0.9 and row["production_ready"]
    kept = reg.get(row["dataset_id"]).first()
    assert kept["size"] == 60 and abs(kept["quality_score"] - row["overall"]) < 1e-9 and kept["bias_severity"] == row["severity"]
    run = reg.runs().first()
    assert run["model_type"] == "logistic_regression" and run["precision_score"] > 0.9 and run["training_time_seconds"] > 0
    doc = json.loads("".join(r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()))
    assert doc["quality"]["conversations"] == 60 and doc["summary"]["production_ready"] is True and doc["training"]["model_type"] == "logistic_regression"


def test_run_plan(spark, tmp_path):
    from dialoom.run import run_plan

    plan = spark.range(90).selectExpr(
        "id AS plan_id", "element_at(array('card_arrival', 'age_limit', 'exchange_rate'), CAST(id % 3 + 1 AS INT)) AS intent",
        "IF(id % 2 = 0, 'en', 'es') AS language", "IF(id % 4 = 0, 'positive', 'neutral') AS sentiment", "'medium' AS complexity")
    examples = spark.sql("SELECT 'c' conversation_id, 'en' language, 'neutral' sentiment, 'medium' complexity, 'An example.' example")

    def respond(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for record, prompt in zip(pdf["record_id"], pdf["prompt"]):
                intent = prompt.split("Intent: ")[1].split("\n")[0]
                turns = [{"speaker": "customer", "text": TEXT[intent] + f" {record}"}, {"speaker": "agent", "text": "Let me check that"}]
                if int(record) % 10 == 9:
                    out.append(json.dumps({"recordId": record, "error": "throttled"}))
                else:
                    out.append(json.dumps({"recordId": record, "modelOutput": {"content": [{"text": json.dumps({"conversation_id": "conv_XXX", "turns": turns})}]}}))
            yield pd.DataFrame({"value": out})

    reg = Registry(spark, str(tmp_path / "registry"))
    config = RunConfig(model_types=("logistic_regression",), quality_limit=10.0, bias_limit="high",
                       model=ModelConfig(max_features=200, ngram_range=(1, 1), min_df=1, model_params={"max_iter": 20}))
    row = run_plan(plan, examples, respond, plan.select("intent"), str(tmp_path / "run"), reg, config).first()
    assert (row["responses"], row["failed"], row["conversations"]) == (90, 9, 81) and row["accuracy"] > 0.9 and row["production_ready"]
    kept = spark.read.parquet(str(tmp_path / "run" / "conversations"))
    assert kept.select("conversation_id").distinct().count() == 81 and {r[0] for r in kept.select("intent").distinct().collect()} == set(TEXT)
    assert reg.get(row["dataset_id"]).first()["size"] == 81
