"""Model configurations, training, prediction, persistence."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from dialoom.functions.dims import written
from dialoom.operators.evaluate import confusion, scores
from dialoom.training.data import balanced_weights, encode, split
from dialoom.training.features import cut_tfidf, gram_counts, joined_grams, with_grams, with_tokens

MODEL_TYPES = ["logistic_regression", "random_forest", "xgboost"]


@dataclass
class ModelConfig:
    """What to train. ``model_params`` takes max_iter, n_estimators, max_depth, learning_rate, C."""

    model_type: str = "logistic_regression"
    name: str = "default"
    max_features: int = 5000
    ngram_range: tuple[int, int] = (1, 2)
    min_df: int = 2
    model_params: dict = field(default_factory=dict)
    test_size: float = 0.2
    seed: int = 42
    folds: int = 0
    tags: tuple[str, ...] = ()


# The named configurations.
PRESETS = {
    "fast": ModelConfig("logistic_regression", "fast", 3000, (1, 2), 2, {"max_iter": 500}, tags=("baseline", "fast")),
    "balanced": ModelConfig("random_forest", "balanced", 5000, (1, 2), 2, {"n_estimators": 100}, tags=("balanced", "random_forest")),
    "best": ModelConfig("xgboost", "best", 5000, (1, 3), 1, {"n_estimators": 200, "max_depth": 6, "learning_rate": 0.1},
                        tags=("best", "xgboost", "production")),
    "quick_test": ModelConfig("logistic_regression", "quick_test", 1000, (1, 1), 1, {"max_iter": 100}, tags=("test", "debug")),
    "cross_validation": ModelConfig("logistic_regression", "cross_validation", 5000, (1, 2), 2, {}, folds=5,
                                    tags=("evaluation", "cross_validation")),
}


def preset(name: str) -> ModelConfig:
    if name not in PRESETS:
        raise ValueError(f"Unknown preset '{name}'. Available: {', '.join(PRESETS)}")
    base = PRESETS[name]
    return ModelConfig(**{**asdict(base), "model_params": dict(base.model_params)})


def estimator(config: ModelConfig, rows: int):
    """The Spark estimator of a configuration.

    Regularisation follows the usual C: with balanced weights summing to ``rows`` it is 1 / (C * rows).
    Spark's trees stop at depth 30, and its boosting is binary, hence one model per label.
    """
    p = config.model_params
    cols = {"featuresCol": "features", "labelCol": "code"}
    if config.model_type == "logistic_regression":
        return LogisticRegression(**cols, weightCol="weight", family="multinomial", standardization=False,
                                  maxIter=int(p.get("max_iter", 1000)), regParam=1.0 / (float(p.get("C", 1.0)) * max(rows, 1)))
    if config.model_type == "random_forest":
        return RandomForestClassifier(**cols, weightCol="weight", numTrees=int(p.get("n_estimators", 100)),
                                      maxDepth=min(30, int(p.get("max_depth") or 30)), seed=config.seed)
    if config.model_type == "xgboost":
        one = GBTClassifier(maxIter=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth", 6)),
                            stepSize=float(p.get("learning_rate", 0.1)), seed=config.seed)
        return OneVsRest(**cols, classifier=one, rawPredictionCol="rawPrediction")
    raise ValueError(f"Unknown model type: {config.model_type}")


@dataclass
class IntentModel:
    """A trained classifier: text in, label out, on any DataFrame (a stream included)."""

    config: ModelConfig
    labels: list[str]
    features: PipelineModel
    classifier: object
    metadata: dict = field(default_factory=dict)

    def predict_tokens(self, tokenised: DataFrame) -> DataFrame:
        """(label, prediction) of rows (label, tokens)."""
        scored = self.classifier.transform(self.features.transform(tokenised)).select("label", "prediction")
        return IndexToString(inputCol="prediction", outputCol="_name", labels=self.labels).transform(scored).select("label", F.col("_name").alias("prediction"))

    def _scored(self, df: DataFrame) -> DataFrame:
        tokenised = with_tokens(df, self.config.ngram_range)
        scored = self.classifier.transform(self.features.transform(tokenised))
        named = IndexToString(inputCol="prediction", outputCol="_name", labels=self.labels).transform(scored)
        drop = [c for c in ("tokens", "_counts", "_scaled", "features", "prediction") if c not in df.columns]
        return named.drop(*drop)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` to rows with ``text``."""
        scored = self._scored(df)
        return scored.select(*df.columns, F.col("_name").alias("prediction"))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Adds ``probabilities`` (label -> probability); boosted models give the softmax of their margins."""
        scored = self._scored(df)
        if "probability" in scored.columns:
            p = vector_to_array("probability")
        else:
            raw = F.transform(vector_to_array("rawPrediction"), F.exp)
            p = F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda a, x: a + x))
        names = F.array(*[F.lit(n) for n in self.labels])
        return scored.select(*df.columns, F.map_from_arrays(names, p).alias("probabilities"))

    def evaluate(self, pairs: DataFrame) -> DataFrame:
        """One row of scores over (text, label) rows."""
        return scores(confusion(self.predict(pairs)))

    def save(self, spark: SparkSession, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        self.classifier.write().overwrite().save(f"{path}/classifier")
        row = json.dumps({"config": asdict(self.config), "labels": self.labels, "metadata": self.metadata})
        spark.createDataFrame([(row,)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IntentModel:
        row = json.loads(spark.read.text(f"{path}/model").first()["value"])
        config = ModelConfig(**{**row["config"], "ngram_range": tuple(row["config"]["ngram_range"]),
                                "tags": tuple(row["config"]["tags"])})
        kinds = {"logistic_regression": "LogisticRegressionModel", "random_forest": "RandomForestClassificationModel",
                 "xgboost": "OneVsRestModel"}
        import pyspark.ml.classification as ml
        classifier = getattr(ml, kinds[config.model_type]).load(f"{path}/classifier")
        return IntentModel(config, row["labels"], PipelineModel.load(f"{path}/features"), classifier, row["metadata"])


PIECE_ROWS = 1 << 16        # rows of one task of a fit; trees hold a number for every feature of a row, so theirs have fewer
PIECE_CELLS = 1 << 23


def piece_rows(config: ModelConfig, features: int) -> int:
    """The most rows of a piece."""
    return PIECE_ROWS if config.model_type == "logistic_regression" else max(1, PIECE_CELLS // max(1, features))


def pieces(config: ModelConfig, rows: int, features: int, cores: int) -> int:
    """Partitions of the training rows, so that what one task holds does not grow with the rows."""
    return max(1, min(rows, max(cores, -(-rows // piece_rows(config, features)))))


def _in_pieces(train: DataFrame, parts: int, most: int) -> bool:
    """Whether the table is read in that many pieces anyway, none of which has more rows."""
    read = train.groupBy(F.spark_partition_id().alias("_part")).agg(F.count("*").alias("_n")).agg(F.count("*"), F.max("_n")).first()
    return read[0] >= parts and read[1] <= most


def fit_counted(train: DataFrame, counts: DataFrame, rows: int, labels: list[str], config: ModelConfig) -> IntentModel:
    """``fit_cut`` with the vocabulary cut from the ``gram_counts`` of ``train``."""
    return fit_cut(train, cut_tfidf(counts, rows, config.ngram_range, config.max_features, config.min_df), rows, labels, config)


def fit_cut(train: DataFrame, features: PipelineModel, rows: int, labels: list[str], config: ModelConfig) -> IntentModel:
    """Fits on a table of (label, weight, grams) as ``with_grams`` makes them; only the vectors are kept for the passes of the optimiser.

    Logistic regression keeps blocks of them itself, on disk where memory ends, so its vectors stay in memory alone and are made anew where they do not fit.
    A table that was written in small pieces is not shuffled.
    """
    codes = F.create_map(*[F.lit(x) for i, name in enumerate(labels) for x in (name, float(i))])
    size = len(features.stages[0].vocabulary)
    coded = train.select("weight", codes[F.col("label")].alias("code"), joined_grams(config.ngram_range).alias("tokens"))
    parts = pieces(config, rows, size, train.sparkSession.sparkContext.defaultParallelism)
    vectors = features.transform(coded).select("code", "weight", "features")
    if not _in_pieces(train, parts, piece_rows(config, size)):
        vectors = vectors.repartition(parts)
    vectors.persist(StorageLevel.MEMORY_ONLY if config.model_type == "logistic_regression" else StorageLevel.MEMORY_AND_DISK_DESER)
    try:
        classifier = estimator(config, rows).fit(vectors)
    finally:
        vectors.unpersist()
    return IntentModel(config, labels, features, classifier, {"rows": rows, "classes": len(labels), "vocabulary": size})


def label_list(rows: DataFrame) -> list[str]:
    """The sorted labels, one per class."""
    return [r["label"] for r in encode(rows).orderBy("code").collect()]


def fit(pairs: DataFrame, config: ModelConfig) -> IntentModel:
    """Trains on all rows of (text, label). The texts are taken apart once, into a written table without them."""
    grams = with_grams(balanced_weights(pairs), config.ngram_range[1])
    kept = ["label", "weight", *[f"grams_{n}" for n in range(config.ngram_range[0], config.ngram_range[1] + 1)]]
    train = written(grams.select(*kept), "grams")
    counts = gram_counts(train, config.ngram_range[1], config.ngram_range[0])
    return fit_counted(train, counts, train.count(), label_list(train), config)


@dataclass
class TrainResult:
    model: IntentModel
    metrics: dict
    predictions: DataFrame


def train(pairs: DataFrame, config: ModelConfig | None = None, exact: bool = False) -> TrainResult:
    """Split, fit on the training part, score on the test part."""
    config = config or ModelConfig()
    started = time.time()
    train_rows, test_rows = split(pairs, config.test_size, config.seed, exact)
    model = fit(train_rows, config)
    predicted = model.predict(test_rows)
    row = scores(confusion(predicted)).first().asDict()
    metrics = {**row, "train_size": model.metadata["rows"], "test_size": row["support"],
               "unique_intents": model.metadata["classes"], "training_time": time.time() - started}
    model.metadata.update({"model_type": config.model_type, "accuracy": row["accuracy"], "f1_macro": row["f1_macro"]})
    return TrainResult(model, metrics, predicted)
