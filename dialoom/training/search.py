"""Comparison, cross-validation and parameter search: distributed fits, side by side, on features that are prepared once."""

from __future__ import annotations

import itertools
import random
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from dialoom.functions.dims import written
from dialoom.operators.evaluate import confusion, scores
from dialoom.registry.tracking import Tracker
from dialoom.session import drop_shuffles, one_file_a_task
from dialoom.training import models
from dialoom.training.data import balanced_weights, folds, split
from dialoom.training.features import cut_tfidf, frequent_counts, gram_counts, joined_grams, longer_grams, only_grams, vocabularies, with_grams
from dialoom.training.models import MODEL_TYPES, ModelConfig, TrainResult, fit_counted, fit_cut, label_list, train

# The default grids.
GRIDS = {
    "logistic_regression": {"max_features": [1000, 3000, 5000], "ngram_range": [(1, 1), (1, 2)], "min_df": [1, 2]},
    "random_forest": {"max_features": [3000, 5000], "ngram_range": [(1, 1), (1, 2)], "min_df": [1, 2]},
    "xgboost": {"max_features": [3000, 5000], "ngram_range": [(1, 1), (1, 2), (1, 3)], "min_df": [1, 2]},
}
_RESULT = ("ordinal INT, model_type STRING, max_features INT, ngram_low INT, ngram_high INT, min_df INT, "
           "accuracy DOUBLE, f1_macro DOUBLE, f1_weighted DOUBLE, error STRING")


def _settings(configs: list[ModelConfig]) -> list[tuple[tuple[int, int], int, int]]:
    """(n-grams, max_features, min_df) whose vocabularies hold those of all configurations: among those that differ in ``max_features`` alone, the longest."""
    most: dict[tuple, int] = {}
    for c in configs:
        key = (max(1, c.ngram_range[0]), c.ngram_range[1]), c.min_df
        if key[0][0] <= key[0][1]:      # the others find no term
            most[key] = max(1, c.max_features, most.get(key, 1))
    return [(ngrams, n, min_df) for (ngrams, min_df), n in most.items()] or [((1, 1), 1, 1)]


@dataclass
class Prepared:
    """What all configurations of a search share: the split, the n-grams of both parts that are in any vocabulary, one table of counts, the labels."""

    train: DataFrame
    test: DataFrame
    counts: DataFrame
    rows: int
    labels: list[str]
    settings: tuple[float, int]     # test_size and seed of the split

    @staticmethod
    def of(pairs: DataFrame, configs: list[ModelConfig], exact: bool = False) -> Prepared:
        """Written tables, so every text is taken apart once whatever the number of fits: its words, without the n-grams that follow from them, and then
        the n-grams that the vocabularies hold. The training part is written in pieces that a fit can read without a shuffle."""
        config, high, settings = configs[0], max(c.ngram_range[1] for c in configs), _settings(configs)
        train_rows, test_rows = split(pairs, config.test_size, config.seed, exact)
        parts = []
        for rows, cols in ((balanced_weights(train_rows), ("label", "weight")), (test_rows, ("label",))):
            words = with_grams(rows, 1).select(*cols, "grams_1")
            parts.append(longer_grams(written(words, "words", compression="zstd"), high))
        counts, n = frequent_counts(parts[0], settings), parts[0].count()
        kept, cores = only_grams(high, vocabularies(counts, settings)), pairs.sparkSession.sparkContext.defaultParallelism
        most = min(models.PIECE_ROWS, max(1, -(-n // cores))) if parts[0].rdd.getNumPartitions() < cores else models.PIECE_ROWS
        train, test = (written(rows.withColumns(kept), "grams", maxRecordsPerFile=most) for rows in parts)
        return Prepared(train, test, counts, n, label_list(train), (config.test_size, config.seed))

    def side_by_side(self, most: int) -> int:
        """As many fits at a time as there are cores for their pieces: what they keep does not grow with the rows beyond one fit's."""
        cores = self.train.sparkSession.sparkContext.defaultParallelism
        return max(1, min(most, cores // max(1, -(-self.rows // models.PIECE_ROWS))))

    def features(self, config: ModelConfig) -> PipelineModel:
        return cut_tfidf(self.counts, self.rows, config.ngram_range, config.max_features, config.min_df)

    def train_one(self, config: ModelConfig, features: PipelineModel | None = None) -> dict:
        """Fits one configuration and scores it on the test part. Labels that only the test part has are never right."""
        model = fit_cut(self.train, features or self.features(config), self.rows, self.labels, config)
        return scores(confusion(model.predict_tokens(self.test.select("label", joined_grams(config.ngram_range).alias("tokens"))))).first().asDict()


def _failed(e: Exception) -> dict:
    """A failed fit is a row of zeros with its error."""
    return {"accuracy": 0.0, "f1_macro": 0.0, "f1_weighted": 0.0, "error": f"{type(e).__name__}: {e}"}


def _problem(prepared: Prepared, config: ModelConfig) -> tuple[str, tuple, object]:
    """(settings, terms and their weights, features): configurations that agree in the first two are one fit, as only the vocabulary
    depends on ``max_features`` and ``min_df``. In place of features the error, if there are none."""
    try:
        features = prepared.features(config)
    except Exception as e:
        return repr(config), (), e
    counter, scale, _ = features.stages
    return repr(replace(config, max_features=0, min_df=0)), (*counter.vocabulary, *scale.getScalingVec().toArray().tolist()), features


def _try(prepared: Prepared, config: ModelConfig, features: object) -> dict:
    """The metrics of one configuration. What its fit shuffled goes with it."""
    try:
        if isinstance(features, Exception):
            raise features
        return {**prepared.train_one(config, features), "error": None}
    except Exception as e:
        return _failed(e)
    finally:
        drop_shuffles(prepared.train.sparkSession)


def _results(pairs: DataFrame, configs: list[ModelConfig], side_by_side: int = 4, exact: bool = False) -> DataFrame:
    """One row per configuration, in their order; those with one vocabulary and equal settings are one fit, up to ``side_by_side`` fits at a time."""
    prepared = {}
    for c in configs:       # one preparation for each split: a search has one
        prepared.setdefault((c.test_size, c.seed), None)
    for key in prepared:
        mine = [c for c in configs if (c.test_size, c.seed) == key]
        prepared[key] = Prepared.of(pairs, mine, exact)
    drop_shuffles(pairs.sparkSession)
    target = inheritable_thread_target(pairs.sparkSession)
    with ThreadPool(max(1, side_by_side)) as pool:
        problems = pool.map(target(lambda c: _problem(prepared[c.test_size, c.seed], c)), configs)
    first = {}
    for c, (*key, features) in zip(configs, problems):
        first.setdefault(tuple(key), (c, features))
    with one_file_a_task(pairs.sparkSession), ThreadPool(min((p.side_by_side(side_by_side) for p in prepared.values()), default=1)) as pool:
        found = dict(zip(first, pool.map(target(lambda x: _try(prepared[x[0].test_size, x[0].seed], *x)), first.values(), chunksize=1)))
    rows = []
    for i, (c, (*key, _)) in enumerate(zip(configs, problems)):
        m = found[tuple(key)]
        rows.append((i, c.model_type, c.max_features, c.ngram_range[0], c.ngram_range[1], c.min_df,
                     float(m["accuracy"]), float(m["f1_macro"]), float(m["f1_weighted"]), m["error"]))
    return pairs.sparkSession.createDataFrame(rows, _RESULT)


def best(results: DataFrame) -> DataFrame:
    """The row with the highest accuracy; the earlier one wins a tie."""
    return results.orderBy(F.desc("accuracy"), "ordinal").limit(1)


def compare_models(pairs: DataFrame, base: ModelConfig | None = None, types: list[str] = MODEL_TYPES,
                   params: dict[str, dict] | None = None) -> DataFrame:
    """The model types on the same data."""
    base = base or ModelConfig()
    return _results(pairs, [replace(base, model_type=t, name=t, model_params=(params or {}).get(t, {})) for t in types])


def _expand(base: ModelConfig, grid: dict[str, list]) -> list[ModelConfig]:
    names = list(grid)
    return [replace(base, **dict(zip(names, values))) for values in itertools.product(*grid.values())]


def grid_search(pairs: DataFrame, base: ModelConfig, grid: dict[str, list] | None = None) -> DataFrame:
    """Every combination of the grid, in the order of the product."""
    return _results(pairs, _expand(base, grid or GRIDS[base.model_type]))


def random_search(pairs: DataFrame, base: ModelConfig, grid: dict[str, list] | None = None, n: int = 10,
                  seed: int = 42) -> DataFrame:
    """``n`` seeded draws from the grid."""
    rng = random.Random(seed)
    grid = grid or GRIDS[base.model_type]
    return _results(pairs, [replace(base, **{k: rng.choice(v) for k, v in grid.items()}) for _ in range(n)])


def cross_validate(pairs: DataFrame, config: ModelConfig, k: int = 5, exact: bool = False, side_by_side: int = 4) -> tuple[DataFrame, DataFrame]:
    """(summary, per fold). Each fold is scored by a model trained on all other folds.

    The texts are taken apart and counted once: the counts of all other folds are sums of the counts of each. The folds are fitted ``side_by_side``.
    """
    spark = pairs.sparkSession
    low, high = config.ngram_range
    lists = [f"grams_{n}" for n in range(low, high + 1)]
    rows = written(with_grams(folds(pairs, k, config.seed, exact), high).select("fold", "label", *lists), "grams")
    learned = rows.filter("label IS NOT NULL")      # as the weights leave out rows without a label
    each_fold = written(gram_counts(learned, high, low, by=("fold",)), "gram-counts")

    def one(i: int) -> tuple:
        rest = balanced_weights(learned.filter(F.col("fold") != i))
        counts = each_fold.filter(F.col("fold") != i).groupBy("n", "term").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs"))
        model = fit_counted(rest, counts, rest.count(), label_list(rest), config)
        held = rows.filter(F.col("fold") == i).select("label", joined_grams(config.ngram_range).alias("tokens"))
        m = scores(confusion(model.predict_tokens(held))).first()
        return i + 1, float(m["accuracy"]), float(m["f1_macro"]), int(model.metadata["rows"]), int(m["support"])

    with ThreadPool(max(1, side_by_side)) as pool:
        found = pool.map(inheritable_thread_target(spark)(one), range(k))
    each = spark.createDataFrame(found, "fold INT, accuracy DOUBLE, f1_macro DOUBLE, train_size BIGINT, test_size BIGINT")
    summary = each.agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"),
                       F.avg("f1_macro").alias("mean_f1"), F.stddev_pop("f1_macro").alias("std_f1"),
                       F.count("*").alias("num_folds"))
    return summary, each


def tracked_train(pairs: DataFrame, config: ModelConfig, tracker: Tracker, model_path: str | None = None) -> tuple[str, TrainResult]:
    """Trains inside an experiment: parameters, metrics, the saved model; status failed on an error."""
    exp = tracker.start(config.name)
    tracker.log_params(exp, {"model_type": config.model_type, "max_features": config.max_features,
                             "min_df": config.min_df, "ngram_range": str(tuple(config.ngram_range))})
    try:
        result = train(pairs, config)
        tracker.log_metrics(exp, {k: v for k, v in result.metrics.items() if isinstance(v, (int, float))})
        if model_path:
            result.model.save(pairs.sparkSession, model_path)
            tracker.log_artifact(exp, model_path)
    except Exception:
        tracker.end(exp, "failed")
        raise
    tracker.end(exp)
    return exp, result
