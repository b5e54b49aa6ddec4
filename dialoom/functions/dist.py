"""Frequency tables and the Jensen-Shannon divergence between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EPSILON = 1e-10     # fixed value: the share a missing key gets


def shares(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """(key, n, share) for every value of ``key``; the total is one more aggregate of the counts."""
    counts = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.withColumn("share", F.col("n") / total.scalar())


def side_counts(p: DataFrame, q: DataFrame, key: str = "key") -> DataFrame:
    """(key, n_p, n_q): how often each key occurs on either side, from one shuffle by key.

    ``p`` and ``q`` are (key, n).
    """
    zero = F.lit(0).cast("bigint")
    both = p.select(key, F.col("n").alias("n_p"), zero.alias("n_q")).unionByName(
        q.select(key, zero.alias("n_p"), F.col("n").alias("n_q")))
    return both.groupBy(key).agg(F.sum("n_p").alias("n_p"), F.sum("n_q").alias("n_q"))


def divergence(counts: DataFrame) -> Column:
    """The aggregate over (n_p, n_q) rows that gives the base-2 Jensen-Shannon divergence, in [0, 1].

    A key missing on one side gets EPSILON; both sides are scaled to sum 1 again, so a side with m
    missing keys is divided by 1 + m * EPSILON; only terms above EPSILON count.
    """
    # totals of both sides, as one scalar subquery over the same counts
    t = counts.agg(F.struct(
        F.sum("n_p").alias("p"), F.sum("n_q").alias("q"),
        (1 + F.sum((F.col("n_p") == 0).cast("int")) * EPSILON).alias("scale_p"),
        (1 + F.sum((F.col("n_q") == 0).cast("int")) * EPSILON).alias("scale_q")).alias("t")).scalar()

    def scaled(side: str) -> Column:
        n = F.col(f"n_{side}")
        return F.when(n > 0, n / t[side]).otherwise(F.lit(EPSILON)) / t[f"scale_{side}"]

    p, q = scaled("p"), scaled("q")

    def part(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c > EPSILON, c * F.log2(c / ((p + q) / 2)))), F.lit(0.0))

    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (part(p) + part(q)) / 2))


def js_divergence(p: DataFrame, q: DataFrame, key: str = "key") -> DataFrame:
    """One row (js_divergence) for two frequency tables (key, n)."""
    counts = side_counts(p, q, key)
    return counts.agg(divergence(counts).alias("js_divergence"))
