"""Features by hand, splits, models, search."""

import math

import pytest
from pyspark.ml.functions import vector_to_array

from dialoom.operators.evaluate import classification_report, confusion, scores
from dialoom.registry.tracking import Tracker, experiments
from dialoom.training import data as D, features as X, models as M, search as S

LANG = {"en": "the card is lost and the bank must help now", "es": "la tarjeta se ha perdido y el banco debe ayudar", "de": "die karte ist weg und die bank muss helfen"}


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(f"c{i}", f"{LANG[k]} {i % 5}x", k) for i, k in enumerate(["en", "es", "de"] * 20)]
    return spark.createDataFrame(rows, "conversation_id STRING, text STRING, label STRING")


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([("red fish red",), ("blue fish",)], "text STRING")
    rows = X.with_tokens(df, (1, 1))
    model = X.fit_tfidf(rows, min_df=1)
    vocabulary = model.stages[0].vocabulary
    v = dict(zip(vocabulary, model.transform(rows).select(vector_to_array("features")).first()[0]))
    idf = lambda d: math.log((1 + 2) / (1 + d)) + 1
    red, fish = 2 * idf(1), 1 * idf(2)
    norm = math.hypot(red, fish)
    assert abs(v["red"] - red / norm) < 1e-9 and abs(v["fish"] - fish / norm) < 1e-9 and v["blue"] == 0


def test_weights_of_a_large_vocabulary(spark):
    """A row's weights are as many as its terms, not as the vocabulary; the fit reads the tokens once."""
    df = spark.createDataFrame([(" ".join(f"w{j}" for j in range(i, i + 3)) + f" w{i}",) for i in range(500)] + [("",)], "text STRING")
    model = X.fit_tfidf(X.with_tokens(df, (1, 1)), 1 << 18, 1)
    out = model.transform(X.with_tokens(df, (1, 1))).select("features", X.term_weights().alias("v"))
    assert "vector_to_array" not in out._jdf.queryExecution().optimizedPlan().toString()
    for features, v in out.collect():
        assert features.size == 502 and len(v) in (0, 3) and v == [x for x in features.toArray() if x > 0]
    assert [type(s).__name__ for s in model.stages] == ["CountVectorizerModel", "ElementwiseProduct", "Normalizer"]


def test_tokens(spark):
    df = spark.createDataFrame([("The Café is a nice CAFÉ, x y2",), ("",)], "text STRING")
    got = [r[0] for r in df.select(X.tokens(df["text"], (1, 2))).collect()]
    assert got == [["cafe", "nice", "cafe", "y2", "cafe nice", "nice cafe", "cafe y2"], []]


def test_split_and_folds(spark, pairs):
    train, test = D.split(pairs, 0.25, exact=True)
    assert {r["label"]: r["count"] for r in test.groupBy("label").count().collect()} == {"en": 5, "es": 5, "de": 5}
    assert train.count() == 45 and train.join(test, "conversation_id").count() == 0
    lone = pairs.limit(7).withColumn("label", pairs["conversation_id"])
    assert D.split(lone, 0.2, exact=True)[1].count() == 2
    sizes = [r["count"] for r in D.folds(pairs, 5, exact=True).groupBy("fold", "label").count().collect()]
    assert sizes == [4] * 15


def test_scores_with_zero_division(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "label STRING, prediction STRING")
    s = scores(confusion(rows)).first()
    assert abs(s["accuracy"] - 1 / 3) < 1e-12 and abs(s["f1_macro"] - (2 / 3) / 3) < 1e-12 and abs(s["f1_weighted"] - 4 / 9) < 1e-12
    assert classification_report(confusion(rows)).count() == 6
    assert scores(confusion(rows.limit(0))).first()["accuracy"] == 0


@pytest.mark.parametrize("kind,params", [("logistic_regression", {"max_iter": 20}), ("random_forest", {"n_estimators": 10, "max_depth": 5}),
                                         ("xgboost", {"n_estimators": 2, "max_depth": 2})])
def test_models_learn_and_reload(spark, pairs, tmp_path, kind, params):
    config = M.ModelConfig(kind, kind, 200, (1, 1), 1, params)
    result = M.train(pairs, config)
    assert result.metrics["accuracy"] > 0.9 and result.metrics["unique_intents"] == 3
    result.model.save(spark, str(tmp_path / "m"))
    loaded = M.IntentModel.load(spark, str(tmp_path / "m"))
    new = spark.createDataFrame([("die karte ist weg",)], "text STRING")
    assert loaded.predict(new).first()["prediction"] == result.model.predict(new).first()["prediction"]
    p = loaded.predict_proba(new).first()["probabilities"]
    assert set(p) == {"en", "es", "de"} and abs(sum(p.values()) - 1) < 1e-9


def test_search_and_validation(spark, pairs):
    base = M.ModelConfig("logistic_regression", "lr", 100, (1, 1), 1, {"max_iter": 5})
    grid = S.grid_search(pairs, base, {"max_features": [5, 100], "min_df": [1]})
    assert grid.count() == 2 and grid.filter("error IS NOT NULL").count() == 0
    assert S.best(grid).first()["accuracy"] == max(r["accuracy"] for r in grid.collect())
    failed = S.compare_models(pairs, base, ["nothing"]).first()
    assert failed["accuracy"] == 0 and "Unknown model type" in failed["error"]
    assert S.random_search(pairs, base, {"max_features": [50, 100]}, 2).filter("error IS NULL").count() == 2
    summary, each = S.cross_validate(pairs, base, 3, exact=True)
    row = summary.first()
    assert row["num_folds"] == 3 and 0.5 < row["mean_accuracy"] <= 1 and each.agg({"test_size": "sum"}).first()[0] == 60


def test_features_cut_from_one_table(spark, pairs):
    """The cut models equal the fitted ones, for every setting."""
    rows = X.with_grams(pairs, 2, stop=["x"])
    counts = X.gram_counts(rows, 2)
    for ngrams, most, least in (((1, 1), 1000, 1), ((1, 2), 1000, 3), ((2, 2), 1000, 13), ((1, 2), 7, 1)):
        tokenised = X.with_tokens(pairs, ngrams, stop=["x"])
        assert tokenised.select("tokens").collect() == rows.select(X.joined_grams(ngrams).alias("tokens")).collect()
        fitted, cut = X.fit_tfidf(tokenised, 1000, least), X.cut_tfidf(counts, 60, ngrams, most, least)
        weights = [dict(zip(m.stages[0].vocabulary, m.stages[1].getScalingVec().toArray().tolist())) for m in (fitted, cut)]
        assert len(weights[1]) == min(most, len(weights[0])) and all(abs(weights[0][t] - w) < 1e-9 for t, w in weights[1].items())
        totals = {r["term"]: r["total"] for r in counts.filter(counts["n"].between(*ngrams)).collect()}
        order = sorted(weights[0], key=lambda t: (-totals[t], t))
        assert cut.stages[0].vocabulary == order[:most]
    with pytest.raises(ValueError):
        X.cut_tfidf(counts, 60, (1, 1), 10, 1000)


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest", "xgboost"])
def test_a_fit_keeps_small_pieces(spark, pairs, monkeypatch, kind):
    """What the passes of a fit read is vectors alone, in pieces whose number follows the rows."""
    seen = []
    monkeypatch.setattr(M, "PIECE_ROWS", 4)
    monkeypatch.setattr(M, "PIECE_CELLS", 4 * 18)
    make = M.estimator

    def spy(config, rows):
        out = make(config, rows)
        fit = out.fit
        out.fit = lambda df: (seen.append((df.columns, df.rdd.getNumPartitions(), df.storageLevel.useMemory)), fit(df))[1]
        return out

    monkeypatch.setattr(M, "estimator", spy)
    model = M.fit(pairs, M.ModelConfig(kind, kind, 18, (1, 1), 1, {"max_iter": 3, "n_estimators": 2, "max_depth": 2}))
    assert seen == [(["code", "weight", "features"], 15, True)] and model.metadata == {"rows": 60, "classes": 3, "vocabulary": 18}
    assert M.pieces(model.config, 6_000_000, 1000, 12) > 90 and M.pieces(model.config, 5, 1000, 12) == 5


def test_validation_takes_texts_apart_once(spark, pairs, monkeypatch):
    """Every fold has the scores of a model that is fitted on the other folds alone, and the texts are read once for all folds."""
    calls = []
    monkeypatch.setattr(S, "with_grams", lambda *a: (calls.append(1), X.with_grams(*a))[1])
    config = M.ModelConfig("logistic_regression", "lr", 9, (1, 2), 2, {"max_iter": 5})
    rows = pairs.union(spark.createDataFrame([("n1", "the card is lost", None)], pairs.schema))
    _, each = S.cross_validate(rows, config, 3)
    cut = D.folds(rows, 3, config.seed)
    for r in each.collect():
        model = M.fit(cut.filter(cut["fold"] != r["fold"] - 1), config)
        m = model.evaluate(cut.filter(cut["fold"] == r["fold"] - 1)).first()
        assert (r["train_size"], r["test_size"]) == (model.metadata["rows"], m["support"]) and abs(r["accuracy"] - m["accuracy"]) < 1e-9 and abs(r["f1_macro"] - m["f1_macro"]) < 1e-9
    assert calls == [1]


def test_one_fit_for_one_vocabulary(spark, pairs, monkeypatch):
    """Configurations whose vocabularies come out equal share a fit; where they differ, each has its own, and all rows are there."""
    fits, make = [], S.fit_cut
    monkeypatch.setattr(S, "fit_cut", lambda *a: (fits.append(a[-1]), make(*a))[1])
    base = M.ModelConfig("logistic_regression", "lr", 9, (1, 1), 1, {"max_iter": 3})
    # 22 words in all: 200 and 300 are the same; seldom words are cut by min_df 13 only
    grid = S.grid_search(pairs, base, {"max_features": [5, 200, 300], "min_df": [1, 2, 13, 1000]})
    rows = grid.orderBy("ordinal").collect()
    assert len(rows) == 12 and [r["min_df"] for r in rows[:4]] == [1, 2, 13, 1000] and [r["error"] is None for r in rows] == [True, True, True, False] * 3
    assert len(fits) == 3 and len({(c.max_features > 5, c.min_df) for c in fits}) == 3
    assert rows[1][6:] == rows[0][6:] and rows[4][6:] == rows[5][6:] == rows[8][6:] == rows[9][6:] and rows[6][6:] == rows[10][6:]
    alone = S.grid_search(pairs, base, {"max_features": [300], "min_df": [2]}).first()
    assert abs(alone["accuracy"] - rows[9]["accuracy"]) < 1e-9


@pytest.mark.parametrize("settings,rounds", [([((1, 1), 2, 1)], 1), ([((1, 2), 2, 2)], 2), ([((2, 3), 2, 2), ((1, 1), 5, 1)], None), ([((1, 2), 10_000, 1)], 1), ([((1, 1), 2, 1000)], 2)])
def test_frequent_counts_hold_whole_vocabularies(spark, monkeypatch, settings, rounds):
    """Vocabularies come out as from the counts of all n-grams, also if the heaviest ones stand in too few rows and lighter cells have to be counted."""
    texts = [" ".join(f"p{a} p{b}" for _ in range(150) for a in range(4) for b in range(4))]     # heavy, in one row
    texts += [f"here there own{i} {'few' if i % 9 == 0 else 'many'} w{i % 7} w{i % 5}" for i in range(120)] + ["", None]
    rows = X.with_grams(spark.createDataFrame([(t,) for t in texts], "text STRING"), 3, stop=[])
    words = X.longer_grams(rows.select("grams_1"), 3)
    assert words.collect() == rows.select("grams_1", "grams_2", "grams_3").collect()
    every, tried, count = X.gram_counts(rows, 3), [], X.gram_counts
    monkeypatch.setattr(X, "gram_counts", lambda *a, **k: (tried.append(k["within"]), count(*a, **k))[1])
    counts = X.frequent_counts(words, settings)
    for s in settings:
        columns = ["n", "term", "total", "docs"]
        assert X._frequent(counts, *s).select(columns).collect() == X._frequent(every, *s).select(columns).collect()
    assert rounds in (None, len(tried))
    whole = settings[0][1:] in ((10_000, 1), (2, 1000))      # there are not enough terms
    assert (tried[-1] is None) == whole and (whole or counts.count() < every.count() / 2)


def test_a_search_keeps_little(spark, monkeypatch):
    """Written are the words and the n-grams of some vocabulary, not those that stand in one place; fits read their pieces without a shuffle and leave nothing on disk themselves."""
    rows = [(f"c{i}", " ".join([f"own{i}x{j} {k} is{k}" for j in range(20)]), k) for i, k in enumerate(["en", "es", "de"] * 60)]
    pairs = spark.createDataFrame(rows, "conversation_id STRING, text STRING, label STRING")
    tables, fits, make, write = [], [], M.estimator, S.written
    monkeypatch.setattr(M, "PIECE_ROWS", 10)
    monkeypatch.setattr(S, "written", lambda df, name, **o: (tables.append((name, write(df, name, **o))), tables[-1][1])[1])

    def spy(config, rows):
        out = make(config, rows)
        fit = out.fit
        out.fit = lambda df: (fits.append((df.storageLevel.useDisk, df.rdd.glom().map(len).collect(), "Exchange" in df._jdf.queryExecution().executedPlan().toString())), fit(df))[1]
        return out

    monkeypatch.setattr(M, "estimator", spy)
    cost = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(cost)
    base = M.ModelConfig("logistic_regression", "lr", 6, (1, 2), 1, {"max_iter": 3})
    found = S.grid_search(pairs, base, {"max_features": [4, 6], "ngram_range": [(1, 1), (1, 2)]}).collect()
    assert len(found) == 4 and all(r["error"] is None and r["accuracy"] == 1 for r in found)
    assert spark.conf.get(cost) == before
    kept = [df for name, df in tables if name == "grams"]
    assert len(kept) == 2 and sum(df.count() for df in kept) == 180
    assert all(not t.startswith("own") for df in kept for r in df.collect() for t in r["grams_1"] + r["grams_2"])
    assert [set(df.columns) for name, df in tables if name == "words"] == [{"label", "weight", "grams_1"}, {"label", "grams_1"}]
    assert fits and all(not disk and not shuffled and max(sizes) <= 10 and sum(sizes) == kept[0].count() for disk, sizes, shuffled in fits)


def test_best_of_equals_is_the_first(spark, pairs):
    rows = [(i, "m", 1, 1, 1, 1, a, 0.0, 0.0, None) for i, a in ((3, 0.5), (2, 0.9), (0, 0.1), (1, 0.9), (4, 0.9))]
    assert S.best(spark.createDataFrame(rows, S._RESULT)).first()["ordinal"] == 1
    # equal draws are one fit and have equal rows
    base = M.ModelConfig("logistic_regression", "lr", 100, (1, 1), 1, {"max_iter": 5})
    found = [tuple(r)[2:] for r in S.random_search(pairs, base, {"max_features": [50]}, 3).collect()]
    assert len(found) == 3 and len(set(found)) == 1


def test_tracking_a_failure(spark, pairs, tmp_path):
    t = Tracker(spark, str(tmp_path))
    with pytest.raises(ValueError):
        S.tracked_train(pairs, M.ModelConfig("nothing"), t)
    assert experiments(t.events()).first()["status"] == "failed"


def test_presets():
    assert M.preset("best").ngram_range == (1, 3) and M.preset("cross_validation").folds == 5
    with pytest.raises(ValueError):
        M.preset("none")
