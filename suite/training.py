"""G: training data, features, models, evaluation. The classifier learns the language of a document."""

from dataclasses import replace

from pyspark.sql import functions as F

from dialoom.operators import evaluate as V
from dialoom.registry.tracking import Tracker, experiments
from dialoom.session import shared_path
from dialoom.training import data as D, features as X, models as M, search as S
from suite.base import LONG_FACTS, NESTED_FACTS, long_corpus, nested_facts, query, rounded, table, text_table

TRIM = "trim(first_customer_text, chr(9) || chr(10) || chr(13) || ' ')"


@query("g1_training_pairs", f"WITH {LONG_FACTS} SELECT conversation_id, {TRIM} AS text, intent AS label FROM facts WHERE {TRIM} <> '' AND intent <> ''")
def pairs(spark, sf):
    return D.training_pairs(long_corpus(spark, sf).facts)


@query("g1_skipped", f"WITH {NESTED_FACTS} SELECT count(*) FILTER ({TRIM} <> '' AND intent <> '') AS kept, count(*) - count(*) FILTER ({TRIM} <> '' AND intent <> '') AS skipped FROM facts")
def skipped(spark, sf):
    return D.skipped(nested_facts(spark, sf))


def _lang(spark, sf):
    """Whole document texts with their language as the label."""
    return text_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("conversation_id"), "text", F.col("lang").alias("label"))


@query("g2_label_codes", "SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT source AS label FROM documents)")
def codes(spark, sf):
    out = D.encode(table(spark, sf, "documents").select(F.col("source").alias("label")))
    return out.withColumn("code", F.col("code").cast("bigint"))


@query("g2_balanced_weights", "SELECT lang AS label, round(sum(w), 6) AS total, round(min(w), 6) AS weight FROM (SELECT lang, (SELECT count(*) / count(DISTINCT lang) FROM documents) / count(*) OVER (PARTITION BY lang) AS w FROM documents) GROUP BY 1")
def weights(spark, sf):
    return rounded(D.balanced_weights(_lang(spark, sf)).groupBy("label").agg(F.sum("weight").alias("total"), F.min("weight").alias("weight")))


@query("g3_exact_split", """WITH c AS (SELECT lang AS label, count(*) AS n, floor(count(*) * 0.2)::BIGINT AS b FROM documents GROUP BY 1),
  m AS (SELECT (ceil(sum(n) * 0.2) - sum(b))::BIGINT AS more FROM c), r AS (SELECT *, row_number() OVER (ORDER BY n * 0.2 - b DESC, label) AS i FROM c)
  SELECT label, b + (i <= more)::INT AS test, n - b - (i <= more)::INT AS train FROM r, m""")
def exact_split(spark, sf):
    train, test = D.split(_lang(spark, sf), exact=True)
    both = test.select("label", F.lit("test").alias("part")).unionByName(train.select("label", F.lit("train").alias("part")))
    return both.groupBy("label").agg(F.count_if(F.col("part") == "test").alias("test"), F.count_if(F.col("part") == "train").alias("train"))


@query("g3_unstratified_split", """SELECT ceil(count(*) * 0.2)::BIGINT AS test, (count(*) - ceil(count(*) * 0.2))::BIGINT AS train FROM documents""")
def unstratified_split(spark, sf):
    """Every text hash is a class of its own, so some classes have one row and the split is not stratified."""
    rows = _lang(spark, sf).withColumn("label", F.col("conversation_id"))
    train, test = D.split(rows, exact=True)
    return test.agg(F.count("*").alias("test")).withColumn("train", train.agg(F.count("*")).scalar())


@query("g3_hash_split", "SELECT count(*) AS n, true AS close, true AS disjoint FROM documents")
def hash_split(spark, sf):
    rows = _lang(spark, sf)
    train, test = D.split(rows)
    both = train.select("conversation_id", F.lit(0).alias("t")).unionByName(test.select("conversation_id", F.lit(1).alias("t")))
    return both.agg(F.count("*").alias("n"), (F.abs(F.avg("t") - 0.2) < 0.07).alias("close"),
                    (F.countDistinct("conversation_id") == F.count("*")).alias("disjoint"))


@query("g15_folds", "SELECT source AS label, fold, count(*) AS n FROM (SELECT source, row_number() OVER (PARTITION BY source) % 5 AS fold FROM documents) GROUP BY 1, 2")
def folds(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("conversation_id"), F.col("source").alias("label"))
    return D.folds(rows, 5, exact=True).groupBy("label", F.col("fold").cast("bigint").alias("fold")).agg(F.count("*").alias("n"))


@query("g4_token_counts", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]{2,}') AS ws FROM documents)
  SELECT doc_id, greatest(len(ws), 0) + greatest(len(ws) - 1, 0) AS tokens, md5(array_to_string(ws, ' ')) AS words FROM w""")
def token_counts(spark, sf):
    """Unigrams and bigrams without a stop list: what the vectoriser counts."""
    t = text_table(spark, sf, "documents").withColumn("t", X.tokens(F.col("text"), (1, 2), stop=[]))\
        .withColumn("u", X.tokens(F.col("text"), (1, 1), stop=[]))
    return t.select("doc_id", F.size("t").cast("bigint").alias("tokens"), F.md5(F.array_join("u", " ")).alias("words"))


@query("g4_tfidf", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 20),
  x AS (SELECT doc_id, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term)),
  s AS (SELECT doc_id, sum(x) / sqrt(sum(x * x)) AS weights, max(x) / sqrt(sum(x * x)) AS heaviest, count(*) AS terms FROM x GROUP BY 1)
  SELECT doc_id::VARCHAR AS conversation_id, round(coalesce(weights, 0), 5) AS weights, round(coalesce(heaviest, 0), 5) AS heaviest, coalesce(terms, 0) AS terms
  FROM documents LEFT JOIN s USING (doc_id)""")
def tfidf(spark, sf):
    """Unigrams that stand in 20 documents or more, without a stop list: every weight goes into the sums."""
    rows = X.with_tokens(_lang(spark, sf), (1, 1), stop=[])
    weighted = X.fit_tfidf(rows, 1 << 18, 20).transform(rows).select("conversation_id", X.term_weights().alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return weighted.select("conversation_id", F.round(total, 5).alias("weights"), F.round(F.coalesce(F.array_max("v"), F.lit(0.0)), 5).alias("heaviest"),
                           F.size("v").cast("bigint").alias("terms"))


def _config(kind, **more):
    """The preset for tests, with few trees: the checks are about the operator, not about the best score."""
    params = {"logistic_regression": {"max_iter": 30}, "random_forest": {"n_estimators": 20, "max_depth": 8}, "xgboost": {"n_estimators": 3, "max_depth": 3}}
    return replace(M.preset("quick_test"), model_type=kind, name=kind, model_params=params[kind], **more)


MAJORITY = "(SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))"


def _majority(spark, sf):
    counts = table(spark, sf, "documents").groupBy("lang").count()
    return counts.agg(F.max("count") / F.sum("count")).first()[0]


def _trained(kind):
    def run(spark, sf):
        r = M.train(_lang(spark, sf), _config(kind), exact=True)
        m = r.metrics
        return spark.createDataFrame([(kind, int(m["train_size"]), int(m["test_size"]), int(m["unique_intents"]), m["accuracy"] > _majority(spark, sf),
                                       0 < m["f1_macro"] <= 1 and 0 < m["f1_weighted"] <= 1)],
                                     "model STRING, train_size BIGINT, test_size BIGINT, classes BIGINT, learned BOOLEAN, scored BOOLEAN")
    return run


for _id, _kind in (("g5_g8_logistic_regression", "logistic_regression"), ("g6_random_forest", "random_forest"), ("g7_boosted_trees", "xgboost")):
    query(_id, f"""SELECT '{_kind}' AS model, (count(*) - ceil(count(*) * 0.2))::BIGINT AS train_size, ceil(count(*) * 0.2)::BIGINT AS test_size,
      count(DISTINCT lang) AS classes, true AS learned, true AS scored FROM documents""")(_trained(_kind))


@query("g9_predictions", """SELECT doc_id::VARCHAR AS conversation_id, lang AS label, true AS known, true AS learned FROM documents""")
def predictions(spark, sf):
    """Every document gets one of the labels, and more are right than the most frequent label would make."""
    rows = _lang(spark, sf)
    out = M.fit(rows, _config("logistic_regression")).predict(rows)
    labels = [r[0] for r in table(spark, sf, "documents").select("lang").distinct().collect()]
    right = out.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    return out.select("conversation_id", "label", F.col("prediction").isin(labels).alias("known"), F.lit(right > _majority(spark, sf)).alias("learned"))


@query("g10_probabilities", """SELECT doc_id::VARCHAR AS conversation_id, 1.0::DOUBLE AS total, (SELECT count(DISTINCT lang) FROM documents) AS labels, true AS top FROM documents""")
def probabilities(spark, sf):
    """One probability per label, one in all; the prediction is the label with the largest."""
    rows = _lang(spark, sf)
    model = M.fit(rows, _config("logistic_regression"))
    out = model.predict_proba(rows).join(model.predict(rows).select("conversation_id", "prediction"), "conversation_id")
    p = F.map_values("probabilities")
    return out.select("conversation_id", F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size(p).cast("bigint").alias("labels"),
                      (F.element_at("probabilities", F.col("prediction")) == F.array_max(p)).alias("top"))


PRED_SQL = """p AS (SELECT lang AS label, CASE WHEN doc_id % 5 = 0 THEN 'en' WHEN doc_id % 7 = 0 THEN 'pt' ELSE lang END AS prediction FROM documents),
cm AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2), names AS (SELECT label FROM p UNION SELECT prediction FROM p),
each_ AS (SELECT nm.label, coalesce((SELECT sum(n) FROM cm WHERE cm.label = nm.label), 0) AS support, coalesce((SELECT sum(n) FROM cm WHERE cm.prediction = nm.label), 0) AS predicted,
  coalesce((SELECT sum(n) FROM cm WHERE cm.label = nm.label AND cm.prediction = nm.label), 0) AS tp FROM names nm),
pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS p, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r FROM each_),
f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)"""


def _predicted(spark, sf):
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.col("lang").alias("label"), F.when(k % 5 == 0, "en").when(k % 7 == 0, "pt").otherwise(F.col("lang")).alias("prediction"))


@query("g11_scores", f"""WITH {PRED_SQL} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(p), 6) AS precision_macro, round(avg(r), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
  round(sum(p * support) / sum(support), 6) AS precision_weighted, round(sum(r * support) / sum(support), 6) AS recall_weighted, round(sum(f1 * support) / sum(support), 6) AS f1_weighted, sum(support)::BIGINT AS support FROM f""")
def score_row(spark, sf):
    return rounded(V.scores(V.confusion(_predicted(spark, sf))))


@query("g12_confusion", f"WITH {PRED_SQL} SELECT label, prediction, n FROM cm")
def confusion(spark, sf):
    return V.confusion(_predicted(spark, sf))


@query("g12_confusion_matrix", f"""WITH {PRED_SQL} SELECT nm.label, {', '.join(f"coalesce((SELECT n FROM cm WHERE cm.label = nm.label AND prediction = '{x}'), 0)::BIGINT AS {x}" for x in ('de', 'en', 'es', 'fr', 'pt'))} FROM names nm""")
def matrix(spark, sf):
    return V.confusion_matrix(V.confusion(_predicted(spark, sf)))


@query("g13_classification_report", f"""WITH {PRED_SQL}, s AS (SELECT sum(tp) / sum(support) AS acc, avg(p) AS mp, avg(r) AS mr, avg(f1) AS mf, sum(p * support) / sum(support) AS wp,
    sum(r * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf, sum(support)::BIGINT AS n FROM f)
  SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM f
  UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM s UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), n FROM s
  UNION ALL SELECT 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), n FROM s""")
def report(spark, sf):
    return rounded(V.classification_report(V.confusion(_predicted(spark, sf))))


def _search(results):
    """How a search went: the rows, the failures, the combinations, and the best row found anew from all others."""
    top = S.best(results).first()
    better = (F.col("accuracy") > top["accuracy"]) | ((F.col("accuracy") == top["accuracy"]) & (F.col("ordinal") < top["ordinal"]))
    return results.agg(F.count("*").alias("tried"), F.count("error").alias("failed"), F.countDistinct("max_features", "ngram_low", "ngram_high", "min_df").alias("combinations"),
                       F.count_if(better).alias("better_than_best"), (F.min("accuracy") > 0.3).alias("learned"))


@query("g14_compare_models", """SELECT * FROM (VALUES ('logistic_regression', 0, true, true), ('random_forest', 1, true, true), ('xgboost', 2, true, true)) v(model_type, ordinal, fitted, scored)""")
def compare(spark, sf):
    params = {k: _config(k).model_params for k in M.MODEL_TYPES}
    out = S.compare_models(_lang(spark, sf), _config("logistic_regression"), params=params)
    return out.select("model_type", "ordinal", F.col("error").isNull().alias("fitted"), F.col("accuracy").between(0.3, 1).alias("scored"))


@query("g15_cross_validation", """WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang) % 5 AS fold FROM documents), n AS (SELECT count(*) AS n FROM r)
  SELECT (fold + 1)::INT AS fold, n.n - count(*) AS train_size, count(*) AS test_size, true AS scored FROM r, n GROUP BY fold, n.n""")
def cross_validation(spark, sf):
    _, each = S.cross_validate(_lang(spark, sf), _config("logistic_regression"), 5, exact=True)
    return each.select("fold", "train_size", "test_size", F.col("accuracy").between(0.3, 1).alias("scored"))


@query("g16_grid_search", "SELECT 12::BIGINT AS tried, 0::BIGINT AS failed, 12::BIGINT AS combinations, 0::BIGINT AS better_than_best, true AS learned FROM documents LIMIT 1")
def grid(spark, sf):
    """The whole default grid of the preset for tests."""
    return _search(S.grid_search(_lang(spark, sf), M.preset("quick_test")))


@query("g17_random_search", "SELECT 10::BIGINT AS tried, 0::BIGINT AS failed, true AS drawn, 0::BIGINT AS better_than_best, true AS learned FROM documents LIMIT 1")
def random_grid(spark, sf):
    """Ten draws from the whole default grid."""
    return _search(S.random_search(_lang(spark, sf), M.preset("quick_test"))).withColumn("drawn", F.col("combinations").between(2, 10)).drop("combinations")


@query("g18_g19_tracked_model", "SELECT doc_id::VARCHAR AS conversation_id, true AS same, 'completed' AS status FROM documents")
def tracked(spark, sf):
    """Trains inside an experiment; the saved and loaded model predicts the same for every document."""
    root = shared_path(spark, "model")
    tracker = Tracker(spark, root)
    _, result = S.tracked_train(_lang(spark, sf), _config("logistic_regression"), tracker, f"{root}/saved")
    rows = _lang(spark, sf)
    kept = result.model.predict(rows).select("conversation_id", F.col("prediction").alias("kept"))
    loaded = M.IntentModel.load(spark, f"{root}/saved").predict(rows).select("conversation_id", "prediction")
    return kept.join(loaded, "conversation_id").select("conversation_id", F.col("kept").eqNullSafe(F.col("prediction")).alias("same")).withColumn(
        "status", experiments(tracker.events()).agg(F.max("status")).scalar())
