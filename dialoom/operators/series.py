"""Time series and transaction measures the public documents of the domain describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoom.functions.dims import written, ratio

# Amount bands with their target shares, and the target fraud rate.
AMOUNT_TARGETS = {"small": 0.70, "medium": 0.25, "large": 0.05}
FRAUD_TARGET = 0.02


def fix_length(target: Column, length: int) -> Column:
    """The array cut to ``length``, or padded with its last value; an empty array stays empty."""
    size = F.size(target)
    padding = F.array_repeat(F.element_at(target, -1), F.greatest(F.lit(length) - size, F.lit(0)))
    return F.when(size >= length, F.slice(target, 1, length)).when(size == 0, target)\
        .otherwise(F.concat(target, padding))


def autocorrelation(points: DataFrame, lag: int) -> DataFrame:
    """(series_id, lag, autocorrelation) from (series_id, idx, value) with dense positions.

    The shifted copy meets its partner by (series_id, idx), so a long series spreads over all tasks.
    Copies of a point count once; a join of copies would pair each with each.
    """
    points = points.groupBy("series_id", "idx").agg(F.min("value").alias("value"))
    later = points.select("series_id", (F.col("idx") - lag).alias("idx"), F.col("value").alias("later"))
    both = points.select("series_id", "idx", "value").join(later, ["series_id", "idx"])
    return both.groupBy("series_id").agg(F.corr("value", "later").alias("autocorrelation"))\
        .select("series_id", F.lit(lag).alias("lag"), "autocorrelation")


def completeness(points: DataFrame) -> DataFrame:
    """(series_id, completeness): the share of points with a value."""
    return points.groupBy("series_id").agg(ratio(F.count("value"), F.count("*")).alias("completeness"))


def standardise(points: DataFrame) -> DataFrame:
    """Adds ``z`` per series (mean 0, standard deviation 1); 0 for a constant series."""
    moments = points.groupBy("series_id").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    joined = points.join(written(moments, "moments"), "series_id")
    z = F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return joined.withColumn("z", z).drop("_m", "_s")


def amount_band(amount: Column) -> Column:
    return F.when(amount < 50, "small").when(amount < 500, "medium").otherwise("large")


def amount_shares(transactions: DataFrame) -> DataFrame:
    """One row: the share of each band, the largest distance from its target, the fraud rate and its distance."""
    band = amount_band(F.col("amount"))
    found = {b: ratio(F.coalesce(F.sum((band == b).cast("bigint")), F.lit(0)), F.count("*")) for b in AMOUNT_TARGETS}
    fraud = ratio(F.coalesce(F.sum(F.col("is_fraudulent").cast("bigint")), F.lit(0)), F.count("*"))
    return transactions.agg(
        *[c.alias(b) for b, c in found.items()],
        F.greatest(*[F.abs(found[b] - t) for b, t in AMOUNT_TARGETS.items()]).alias("imbalance"),
        fraud.alias("fraud_rate"), F.abs(fraud - FRAUD_TARGET).alias("fraud_gap"))


def conversation_balance(facts: DataFrame, categories: int = 11, arcs: int = 6) -> DataFrame:
    """One row: resolution_rate, and how evenly categories and emotion arcs are used (entropy, 0..1)."""
    def evenness(column: str, values: int) -> Column:
        counts = facts.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n")).scalar()
        share = F.col("n") / total
        return counts.agg(F.coalesce(-F.sum(share * F.log2(share)) / F.log2(F.lit(float(values))), F.lit(0.0))).scalar()

    row = facts.agg(ratio(F.count_if(F.col("resolution_status") == "resolved"), F.count("*")).alias("resolution_rate"))
    return row.withColumns({"category_balance": evenness("category", categories),
                            "emotion_arc_variety": evenness("customer_emotion_arc", arcs)})
