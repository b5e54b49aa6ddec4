"""Record schemas: the nested conversation, its long form, and helpers to reach them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

TURN = T.StructType([
    T.StructField("speaker", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

CONVERSATION = T.StructType([
    T.StructField("conversation_id", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("complexity", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("turn_count", T.IntegerType()),
    T.StructField("customer_emotion_arc", T.StringType()),
    T.StructField("resolution_time_category", T.StringType()),
    T.StructField("resolution_status", T.StringType()),
    T.StructField("turns", T.ArrayType(TURN)),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

LABELS = [f.name for f in CONVERSATION if f.name not in ("turns", "metadata")]

REFERENCE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("intent", T.StringType()),
])


def conform(df: DataFrame, names: list[str] = LABELS) -> DataFrame:
    """Adds every missing label column as a typed NULL, so operators can name all of them."""
    have = set(df.columns)
    extra = {n: F.lit(None).cast(CONVERSATION[n].dataType) for n in names if n not in have}
    return df.withColumns(extra) if extra else df
