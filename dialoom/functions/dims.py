"""Small-table joins, hashing and one-row assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dialoom.session import shared_path


def written(df: DataFrame, name: str = "lookup", **options) -> DataFrame:
    """``df`` written to the shared folder and read back: its plan runs once, and the optimiser knows its true size.

    It is broadcast if that is below ``spark.sql.autoBroadcastJoinThreshold``; beyond it the join is a shuffle, whose hot keys
    adaptive execution splits. ``options`` are those of the writer.
    """
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uniform(seed: int, *cols: Column) -> Column:
    """A repeatable number in [0, 1) from the hash of ``cols``: same row, same draw, on any cluster."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.pmod(h, F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def weighted_choice(u: Column, weights: dict[str, float]) -> Column:
    """The value whose cumulative weight range holds ``u``; the weights need not add up to 1."""
    total = float(sum(weights.values()))
    out, acc = None, 0.0
    values = list(weights)
    for value in values[:-1]:
        acc += weights[value] / total
        test = u < F.lit(acc)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))


def metric(df: DataFrame, **named: Column) -> DataFrame:
    """One-row aggregate of ``df`` as (metric, value) rows."""
    row = df.agg(*[c.cast("double").alias(n) for n, c in named.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in named])
    return row.select(F.inline(pairs))


def to_row(frames: list[DataFrame], names: list[str]) -> DataFrame:
    """Joins one-row metric frames without a cross join: union them, then pick each by its name."""
    long = reduce(DataFrame.unionByName, frames)
    return long.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 when b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def compact(*messages: Column) -> Column:
    """Array of the messages that are not NULL, in the given order."""
    return F.array_compact(F.array(*messages))


def percent(c: Column, digits: int = 0) -> Column:
    """A share as text with a percent sign, halves rounded to even."""
    return F.format_string(f"%.{digits}f%%", F.bround(c * 100, digits))
