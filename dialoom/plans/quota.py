"""Generation plans: which conversation to ask for, in exact shares, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dialoom.functions.dims import uniform, weighted_choice
from dialoom.functions.text import let
from dialoom.taxonomy import INTENTS, taxonomy

# Shares in percent for a plan, and weights for independent draws.
PLAN_SHARES: dict[str, dict[str, float]] = {
    "language": {"en": 50, "es": 50},
    "sentiment": {"positive": 30, "neutral": 50, "negative": 20},
    "complexity": {"simple": 30, "medium": 50, "complex": 20},
}
DRAW_WEIGHTS: dict[str, dict[str, float]] = {
    "sentiment": {"positive": 0.25, "neutral": 0.45, "negative": 0.30},
    "complexity": {"simple": 0.40, "medium": 0.40, "complex": 0.20},
    "resolution_status": {"resolved": 0.70, "escalated": 0.15, "unresolved": 0.15},
    "language": {"en": 0.50, "es": 0.50},
}


def quotas(total: int, percent: dict[str, float]) -> dict[str, int]:
    """Rows per value: int(total * share), the last value takes the rest."""
    values = list(percent)
    out = {v: int(total * percent[v] / 100) for v in values[:-1]}
    out[values[-1]] = total - sum(out.values())
    return out


def observed(df: DataFrame, **columns: str) -> dict[str, dict[str, int]]:
    """How often each value stands in a column, by dimension: what a plan can be made to follow.

    ``columns`` names the column of each dimension. Values are in order of their names; NULL does not count. The result has
    one entry per value, so the columns are label columns.
    """
    out: dict[str, dict[str, int]] = {}
    for dimension, column in columns.items():
        rows = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).count().orderBy("v").collect()
        out[dimension] = {r["v"]: r["count"] for r in rows}
    return out


def quotas_like(total: int, counts: dict[str, int]) -> dict[str, int]:
    """Rows per value in the proportions of ``counts``: floor(total * count / all), the last value takes the rest."""
    values, every = list(counts), sum(counts.values())
    out = {v: total * counts[v] // every for v in values[:-1]}
    out[values[-1]] = total - sum(out.values())
    return out


def missing_plan(have: DataFrame, each: int, language: str = "en") -> DataFrame:
    """(intent, category, language, nr): the rows still missing until ``have`` (intent) holds ``each`` of every intent."""
    counts = have.groupBy("intent").agg(F.count("*").alias("n"))
    short = taxonomy(have.sparkSession).join(counts, "intent", "left").withColumn("short", F.lit(each) - F.coalesce("n", F.lit(0)))
    return short.filter("short > 0").select("intent", "category", F.lit(language).alias("language"),
                                            F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("short"))).alias("nr"))


def shuffled(total: int, seed: int) -> Column:
    """A seeded one-to-one mapping of ``id`` in 0..total-1 onto itself: keyed Feistel rounds over the next power of two.

    A number that lands on ``total`` or above goes through the rounds again until it is below. Each time this has
    a chance of less than one half, so 128 repetitions are enough for any row of any plan. It mixes alike at every size.
    """
    bits = max(2, (total - 1).bit_length())
    high, low = bits - bits // 2, bits // 2

    def rounds(x: Column, r: int = 0) -> Column:
        if r == 6:
            return x

        def turn(v: Column) -> Column:
            left, right = F.shiftright(v, low), v.bitwiseAND(F.lit((1 << low) - 1))
            if r % 2 == 0:
                left = left.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(r), right).bitwiseAND(F.lit((1 << high) - 1)))
            else:
                right = right.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(r), left).bitwiseAND(F.lit((1 << low) - 1)))
            return rounds(F.shiftleft(left, low).bitwiseOR(right), r + 1)

        return let(x, turn)

    return let(rounds(F.col("id")), lambda y: F.when(y < total, y).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.lit(128)), y, lambda a, _: F.when(a < total, a).otherwise(rounds(a)))))


def by_quota(position: Column, counts: dict[str, int]) -> Column:
    """The value whose quota range holds ``position``: every value occurs exactly as often as planned."""
    out, upto = F, 0
    for value, n in counts.items():
        upto += n
        out = out.when(position < upto, F.lit(value))
    return out


def cycled(index: Column, values: list[str]) -> Column:
    """values[index mod n]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def generation_plan(spark: SparkSession, total: int, percent: dict[str, dict[str, float]] | None = None,
                    seed: int = 42, like: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(plan_id, language, sentiment, complexity, intent, category): exact marginals, intents in a cycle.

    Dimensions in ``like`` follow observed counts instead of percentages.
    No shuffle at any size: each row computes its place in a seeded permutation of the quotas.
    """
    if total <= 0:
        return spark.createDataFrame(
            [], "plan_id BIGINT, language STRING, sentiment STRING, complexity STRING, intent STRING, category STRING")
    wanted = {**PLAN_SHARES, **(percent or {})}
    rows = spark.range(total)
    like = like or {}
    labels = [by_quota(shuffled(total, seed * 31 + i), quotas_like(total, like[d]) if d in like else quotas(total, wanted[d])).alias(d)
              for i, d in enumerate(("language", "sentiment", "complexity"))]
    tax = taxonomy(spark).select(F.col("ordinal").alias("_o"), "intent", "category")
    return (rows.select(F.col("id").alias("plan_id"), *labels, (F.col("id") % len(INTENTS)).cast("int").alias("_o"))
            .join(F.broadcast(tax), "_o").drop("_o"))


def language_split(spark: SparkSession, total: int, percent_en: float, seed: int = 42) -> DataFrame:
    """One plan per language, concatenated: int(total * percent_en / 100) English rows, the rest Spanish."""
    english = int(total * percent_en / 100)
    one = generation_plan(spark, english, {"language": {"en": 100, "es": 0}}, seed)
    two = generation_plan(spark, total - english, {"language": {"en": 0, "es": 100}}, seed + 1)
    return one.unionByName(two.withColumn("plan_id", F.col("plan_id") + english))


def balanced_plan(spark: SparkSession, total: int, language: str = "en") -> DataFrame:
    """(plan_id, intent, category, language): every intent max(1, total // 77) times, the first ones once more.

    The intent follows from the row number, so the rows of one intent are spread over all tasks.
    """
    n = len(INTENTS)
    each = max(1, total // n)
    extra = max(0, total - each * n)
    longer = extra * (each + 1)          # rows that belong to intents with one more
    i = F.col("id")
    ordinal = F.when(i < longer, F.floor(i / (each + 1))).otherwise(extra + F.floor((i - longer) / each)).cast("int")
    tax = taxonomy(spark).select(F.col("ordinal").alias("_o"), "intent", "category")
    return (spark.range(each * n + extra).select(i.alias("plan_id"), ordinal.alias("_o"))
            .join(F.broadcast(tax), "_o").drop("_o").withColumn("language", F.lit(language)))


def draw_parameters(rows: DataFrame, key: str, seed: int = 42, intents: list[str] = INTENTS,
                    weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Fills missing intent, sentiment, complexity and language by weighted draws; given values stay.

    A draw depends on the row's key and the seed only, so it survives a re-run of the task.
    """
    use = {**DRAW_WEIGHTS, **(weights or {})}
    out = rows

    def fixed(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    at = (uniform(seed, F.lit("intent"), F.col(key)) * len(intents)).cast("bigint")
    out = out.withColumn("intent", F.coalesce(fixed("intent"), cycled(at, intents)))
    for name in ("sentiment", "complexity", "language"):
        u = uniform(seed, F.lit(name), F.col(key))
        out = out.withColumn(name, F.coalesce(fixed(name), weighted_choice(u, use[name])))
    return out


def remaining(plan: DataFrame, done: DataFrame, key: str = "plan_id") -> DataFrame:
    """The part of a plan not done yet: resume after any interruption, in any order."""
    return plan.join(done.select(key), key, "left_anti")
