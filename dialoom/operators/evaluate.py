"""Classifier evaluation from (label, prediction) rows: confusion counts, per-label and overall metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dialoom.functions.dims import ratio


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) of the pairs that occur."""
    return rows.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """The dense matrix: one row per label, one column per prediction, zeros filled in.

    Labels are the sorted union of true and predicted ones; Spark refuses to pivot above
    ``spark.sql.pivotMaxValues`` of them.
    """
    names = counts.select("label").union(counts.select("prediction")).distinct().orderBy("label")
    wide = names.select(F.col("label"), F.col("label").alias("prediction"), F.lit(0).cast("bigint").alias("n"))
    table = counts.unionByName(wide).groupBy("label").pivot("prediction").agg(F.sum("n"))
    return table.fillna(0).orderBy("label")


def per_label(counts: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) for every label seen in truth or prediction; 0 for 0 / 0."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("label").alias("name"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("prediction").alias("name"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))))
    sums = sides.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    out = sums.select(F.col("name").alias("label"), p.alias("precision"), r.alias("recall"), "support", "tp")
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1)


def scores(counts: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted precision, recall and F1, support."""
    each = per_label(counts)
    n = F.sum("support")

    def weighted(c: str):
        return F.coalesce(F.sum(F.col(c) * F.col("support")) / n, F.lit(0.0))

    return each.agg(
        F.coalesce(F.sum("tp") / n, F.lit(0.0)).alias("accuracy"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")],
        F.coalesce(n, F.lit(0)).alias("support"))


def classification_report(counts: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) per label, plus "accuracy", "macro avg" and "weighted avg"."""
    whole = scores(counts)

    def average(kind: str) -> DataFrame:
        return whole.select(F.lit(f"{kind} avg").alias("label"), *[F.col(f"{c}_{kind}").alias(c) for c in
                                                                  ("precision", "recall", "f1")], "support")

    names = ["label", "precision", "recall", "f1", "support"]
    accuracy = whole.select(F.lit("accuracy").alias("label"), *[F.col("accuracy").alias(c) for c in
                                                               ("precision", "recall", "f1")], "support")
    return per_label(counts).select(*names).unionByName(accuracy).unionByName(average("macro"))\
        .unionByName(average("weighted"))
