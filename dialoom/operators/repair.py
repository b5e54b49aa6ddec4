"""Repair of generated records and unique ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoom.schema import conform
from dialoom.taxonomy import with_category

# What a missing label is inferred from.
ARC_OF_SENTIMENT = {"positive": "stable_positive", "negative": "frustrated_to_satisfied"}
ARC_DEFAULT = "stable_neutral"
TIME_OF_COMPLEXITY = {"simple": "quick", "medium": "standard", "complex": "extended"}
TIME_DEFAULT = "standard"
DEFAULTS = {"intent": "general_inquiry", "sentiment": "neutral", "complexity": "medium", "language": "en"}


def _lookup(values: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def fill_gaps(df: DataFrame, expected: dict[str, Column] | None = None) -> DataFrame:
    """Fills what a generated conversation lacks; what it has stays as it is.

    ``expected`` holds the planned intent, sentiment, complexity and language as columns of ``df``;
    a missing plan falls back to DEFAULTS. The turn count follows the turns if there are any.
    """
    given = expected or {}
    rows = conform(df)
    plan = {n: F.coalesce(given.get(n, F.lit(None).cast("string")), F.lit(d)) for n, d in DEFAULTS.items()}
    rows = rows.withColumns({f"_{n}": c for n, c in plan.items()})
    rows = with_category(rows, "_category", "general", "_intent")
    out = rows.withColumns({
        "intent": F.coalesce("intent", "_intent"),
        "category": F.coalesce("category", "_category"),
        "sentiment": F.coalesce("sentiment", "_sentiment"),
        "complexity": F.coalesce("complexity", "_complexity"),
        "language": F.coalesce("language", "_language"),
        "turn_count": F.when(F.col("turns").isNotNull(), F.size("turns"))
        .otherwise(F.coalesce(F.col("turn_count").cast("int"), F.lit(0))),
        "customer_emotion_arc": F.coalesce("customer_emotion_arc",
                                           _lookup(ARC_OF_SENTIMENT, F.col("_sentiment"), ARC_DEFAULT)),
        "resolution_time_category": F.coalesce("resolution_time_category",
                                               _lookup(TIME_OF_COMPLEXITY, F.col("_complexity"), TIME_DEFAULT)),
        "resolution_status": F.coalesce("resolution_status", F.lit("resolved")),
    })
    return out.drop("_intent", "_category", "_sentiment", "_complexity", "_language")


def unique_id(conversation_id: Column, record: Column) -> Column:
    """The id, or a new one for a missing, empty or placeholder id; the same for the same record."""
    fresh = F.concat(F.lit("conv_"), F.substring(F.sha2(record.cast("string"), 256), 1, 12))
    missing = conversation_id.isNull() | (conversation_id == "") | conversation_id.startswith("conv_XXX")
    return F.when(missing, fresh).otherwise(conversation_id)


def duplicate_ids(df: DataFrame, key: str = "conversation_id") -> DataFrame:
    """(key, n) of ids that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
