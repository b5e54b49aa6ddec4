"""Profiles of one dataset and comparison of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoom.functions.dims import metric, ratio, to_row, written

DIMENSIONS = {"intent": "intent", "sentiment": "sentiment", "complexity": "complexity",
              "language": "language", "resolution_status": "resolution_status"}


def profile(facts: DataFrame) -> DataFrame:
    """(dimension, value, n, avg_turns): counts per label value from one scan, plus the row "all".

    Missing labels count as "unknown", a missing turn_count as 0.
    """
    names = list(DIMENSIONS)
    rows = facts.select(*[F.coalesce(c, F.lit("unknown")).alias(d) for d, c in DIMENSIONS.items()],
                        F.coalesce("turn_count", F.lit(0)).alias("turn_count"))
    sets = rows.groupingSets([[c] for c in names] + [[]], *names).agg(
        F.count("*").alias("n"), F.avg("turn_count").alias("avg_turns"),
        *[F.grouping(c).alias(f"_{c}") for c in names])
    dimension = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in names], F.lit("all"))
    counts = sets.select(dimension.alias("dimension"), F.coalesce(*names).alias("value"), "n", "avg_turns")
    # the empty grouping set gives no row for no input; this zero row loses against any real one
    zero = facts.sparkSession.createDataFrame([("all", None, 0, 0.0)], counts.schema)
    return counts.unionByName(zero).groupBy("dimension", "value").agg(
        F.max("n").alias("n"), F.max_by("avg_turns", "n").alias("avg_turns"))


def percentages(profiled: DataFrame, dimension: str) -> DataFrame:
    """(value, n, percentage) of one dimension; no rows for an empty dataset."""
    rows = profiled.filter(F.col("dimension") == dimension)
    total = rows.agg(F.sum("n")).scalar()
    return rows.select("value", "n", (F.col("n") / total * 100).alias("percentage"))


def top_values(profiled: DataFrame, dimension: str = "intent", k: int = 10) -> DataFrame:
    """The k most frequent values, ties in name order, with a display label."""
    return (profiled.filter(F.col("dimension") == dimension).select(
        "value", "n", F.initcap(F.replace("value", F.lit("_"), F.lit(" "))).alias("label"))
        .orderBy(F.desc("n"), "value").limit(k))


def _both(a: DataFrame, b: DataFrame, dimension: str) -> DataFrame:
    """Values of one dimension from two profiles, aligned: (value, n1, n2)."""
    one = a.filter(F.col("dimension") == dimension).select("value", F.col("n").alias("n1"))
    two = b.filter(F.col("dimension") == dimension).select("value", F.col("n").alias("n2"))
    return one.join(two, "value", "full_outer")


def compare_shares(a: DataFrame, b: DataFrame, dimension: str) -> DataFrame:
    """(value, dataset1, dataset2, diff) in percent over the union of the values."""
    both = _both(a, b, dimension)
    total1, total2 = both.agg(F.sum("n1")).scalar(), both.agg(F.sum("n2")).scalar()

    def percent(n: str, total: Column) -> Column:
        return F.coalesce(F.col(n) / total * 100, F.lit(0.0))

    out = both.select("value", percent("n1", total1).alias("dataset1"), percent("n2", total2).alias("dataset2"))
    return out.withColumn("diff", F.abs(F.col("dataset1") - F.col("dataset2")))


def similarity(compared: DataFrame) -> DataFrame:
    """One row (similarity): 100 minus the mean difference, at least 0; 0 when nothing is compared."""
    return compared.agg(F.coalesce(F.greatest(F.lit(0.0), 100 - F.avg("diff")), F.lit(0.0)).alias("similarity"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row comparing two profiles: counts, intent overlap (Jaccard), sentiment similarity, turns.

    The profiles are tables of counts; they are written first, so the datasets are read once for all that is compared.
    """
    a, b = written(a, "profile"), written(b, "profile")
    both = _both(a, b, "intent")
    overlap = metric(both, shared=F.count(F.when(F.col("n1").isNotNull() & F.col("n2").isNotNull(), 1)),
                     union=F.count("*"))
    close = similarity(compare_shares(a, b, "sentiment")).select(
        F.lit("sentiment_similarity").alias("metric"), F.col("similarity").alias("value"))

    def totals(p: DataFrame, i: int) -> DataFrame:
        whole = p.filter(F.col("dimension") == "all")
        return metric(whole, **{f"count{i}": F.max("n"), f"turns{i}": F.max("avg_turns")})

    row = to_row([overlap, close, totals(a, 1), totals(b, 2)],
                 ["shared", "union", "sentiment_similarity", "count1", "count2", "turns1", "turns2"])
    return row.select(
        F.col("count1").cast("bigint").alias("dataset1_count"), F.col("count2").cast("bigint").alias("dataset2_count"),
        (F.col("shared") / F.greatest(F.col("union"), F.lit(1.0))).alias("intent_overlap"),
        "sentiment_similarity", F.abs(F.col("turns1") - F.col("turns2")).alias("avg_turns_diff"))


def common_intents(a: DataFrame, b: DataFrame) -> DataFrame:
    """The intents both datasets use, missing and empty ones left out."""
    def used(df: DataFrame) -> DataFrame:
        return df.select("intent").filter(F.length("intent") > 0)

    return used(a).intersect(used(b)).orderBy("intent")


def coverage_counts(facts: DataFrame) -> DataFrame:
    """One row: rows, distinct intents and sentiments, and conversations per main language."""
    return facts.agg(
        F.count("*").alias("conversations"),
        F.countDistinct("intent").alias("intents"), F.countDistinct("sentiment").alias("sentiments"),
        F.coalesce(F.sum((F.col("language") == "en").cast("bigint")), F.lit(0)).alias("en"),
        F.coalesce(F.sum((F.col("language") == "es").cast("bigint")), F.lit(0)).alias("es"),
        ratio(F.countDistinct("intent"), F.lit(77)).alias("intent_coverage"))
