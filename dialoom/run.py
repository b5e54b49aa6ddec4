"""Whole runs: from a plan, from responses, or from a finished dataset to quality, bias, training, registry, gate and report."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from dialoom.functions.text import truthy
from dialoom.operators.bias import detect, production_ready, text_sentiment
from dialoom.operators.quality import quality
from dialoom.operators.shape import corpus_from_nested
from dialoom.plans.prompts import Wording, with_examples
from dialoom.plans.responses import PLAN, extract_errors, process
from dialoom.registry.tables import Registry
from dialoom.sources.conversations import report
from dialoom.sources.exchange import errors, parse_lines, requests, results
from dialoom.streaming.ingest import generate
from dialoom.training.data import training_pairs
from dialoom.training.models import ModelConfig, train
from dialoom.training.search import best, compare_models


@dataclass(frozen=True)
class RunConfig:
    """Limits and choices of a run. With more than one model type the most accurate one is kept."""

    quality_limit: float = 70.0
    bias_limit: str = "medium"
    accuracy_limit: float = 0.70
    model_types: tuple[str, ...] = ("logistic_regression", "random_forest")
    model: ModelConfig = field(default_factory=ModelConfig)
    model_params: dict | None = None


def run_existing(df: DataFrame, reference: DataFrame, registry: Registry | None = None, file_path: str = "",
                 file_format: str = "parquet", config: RunConfig = RunConfig(), lexicon: DataFrame | None = None,
                 report_path: str | None = None) -> DataFrame:
    """One row: scores, severity, accuracy, the three checks, production_ready, and the dataset id.

    Each stage gives one row, which is all that reaches the driver. ``lexicon`` reads the sentiment from
    the text instead of the label.
    """
    spark = df.sparkSession
    kept = df.persist()
    try:
        corpus = corpus_from_nested(kept)
        scored = _fixed(quality(corpus, reference))
        read = None if lexicon is None else text_sentiment(corpus.heads, corpus.turns, lexicon)
        bias = _fixed(detect(corpus.heads, read))
        pairs = training_pairs(corpus.facts)
        params = config.model_params or {}
        types = list(config.model_types)
        kind = types[0] if len(types) == 1 else best(compare_models(pairs, config.model, types, params)).first()["model_type"]
        trained = train(pairs, replace(config.model, model_type=kind, model_params=params.get(kind, config.model.model_params)))
    finally:
        kept.unpersist()
    m = trained.metrics
    dataset = None
    if registry is not None:
        dataset = registry.register_dataset("customer_service", int(scored.first()["conversations"]), file_path, file_format)
        registry.update_quality(dataset, scored)
        registry.update_bias(dataset, bias)
        registry.register_run(dataset, kind, accuracy=float(m["accuracy"]), f1_score=float(m["f1_macro"]),
                              precision=float(m["precision_macro"]), recall=float(m["recall_macro"]),
                              training_time=float(m["training_time"]))
    names = ["accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro", "train_size", "test_size"]
    training = spark.createDataFrame([(kind, *[float(m[n]) for n in names])],
                                     "model_type STRING, " + ", ".join(f"{n} DOUBLE" for n in names))
    q, b = scored.first(), bias.first()
    row = spark.createDataFrame(
        [(dataset, int(q["conversations"]), float(q["overall"]), b["severity"], kind, float(m["accuracy"]))],
        "dataset_id STRING, conversations BIGINT, overall DOUBLE, severity STRING, model_type STRING, accuracy DOUBLE")
    summary = production_ready(row, config.quality_limit, config.bias_limit, config.accuracy_limit)
    if report_path:
        report(spark, quality=scored, bias=bias, training=training, summary=summary)\
            .coalesce(1).write.mode("errorifexists").text(report_path)
    return summary.select("*", F.lit(config.quality_limit).alias("quality_limit"), F.lit(config.bias_limit).alias("bias_limit"),
                          F.lit(config.accuracy_limit).alias("accuracy_limit"))


def run_responses(lines: DataFrame, plan: DataFrame | None, reference: DataFrame, path: str, registry: Registry | None = None,
                  config: RunConfig = RunConfig(), model_name: str = "model") -> DataFrame:
    """From response lines to a registered and gated dataset: parse, repair, write, then the stages of ``run_existing``.

    ``lines`` has a column ``value``; ``plan`` the planned labels by record id. The conversations go to ``path``/conversations, all
    failures to ``path``/errors. Adds ``responses`` (all lines) and ``failed`` to the row of ``run_existing``.
    """
    parsed = parse_lines(lines.select("value"))
    good = results(parsed)
    process(good, plan, model_name).drop("record_id").write.mode("errorifexists").parquet(f"{path}/conversations")
    empty = good.filter(~truthy(F.col("generated_text"))).select("record_id", F.lit("no text in the response").alias("error"))
    failures = errors(parsed).select("record_id", "error").unionByName(extract_errors(good).select("record_id", "error")).unionByName(empty)
    failures.write.mode("errorifexists").parquet(f"{path}/errors")
    spark = lines.sparkSession
    conversations = spark.read.parquet(f"{path}/conversations")
    failed = spark.read.parquet(f"{path}/errors").count()
    done = run_existing(conversations, reference, registry, f"{path}/conversations", "parquet", config)
    return done.withColumn("failed", F.lit(failed)).withColumn("responses", F.col("conversations") + F.col("failed"))


def run_plan(plan: DataFrame, examples: DataFrame, respond: Callable[[Iterator], Iterator], reference: DataFrame, path: str,
             registry: Registry | None = None, config: RunConfig = RunConfig(), wording: Wording = Wording()) -> DataFrame:
    """The whole way from a plan (plan_id and labels): prompts with examples, requests, responses, then ``run_responses``.

    ``respond`` maps batches of (record_id, prompt, system) to batches of response lines (value); it is called for each partition of the requests.
    The responses are written once to ``path``/responses, so nothing is asked for twice.
    """
    made = requests(with_examples(plan, examples, words=wording), F.col("plan_id"))
    asked = made.select(F.col("recordId").alias("record_id"), F.get("modelInput.messages", F.lit(0))["content"].alias("prompt"),
                        F.col("modelInput.system").alias("system"))
    generate(asked, respond, "value STRING").write.mode("errorifexists").text(f"{path}/responses")
    planned = plan.select(F.col("plan_id").cast("string").alias("record_id"), *PLAN)
    return run_responses(plan.sparkSession.read.text(f"{path}/responses"), planned, reference, path, registry, config)


def _fixed(row: DataFrame) -> DataFrame:
    """A one-row result computed once and kept as a literal table."""
    return row.sparkSession.createDataFrame(row.collect(), row.schema)
