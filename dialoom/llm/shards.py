"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

The place of a row is computed, not stored: row number -> permuted number p -> shard p mod k, slot p div k. Shard
sizes differ by one at most, and both directions can be computed for any row without looking at others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from dialoom.llm.common import mix, stored

ROUNDS = 8


def _halves(total: int) -> tuple[int, int]:
    bits = max(total - 1, 0).bit_length()
    return bits - bits // 2, bits // 2


def _turn(x: np.ndarray, total: int, seed: int, rounds) -> np.ndarray:
    """The rounds given, over all numbers of the smallest power of two that is not below ``total``."""
    high, low = _halves(total)
    left, right = x >> np.uint64(low), x & np.uint64((1 << low) - 1)
    for r in rounds:
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + r) % (1 << 64))
        if r % 2 == 0:
            left = left ^ (mix(right ^ key) & np.uint64((1 << high) - 1))
        else:
            right = right ^ (mix(left ^ key) & np.uint64((1 << low) - 1))
    return (left << np.uint64(low)) | right


def _walk(x: np.ndarray, total: int, seed: int, rounds) -> np.ndarray:
    """Repeats the permutation for numbers that fell on ``total`` or above; under two turns are needed on average."""
    out = _turn(np.asarray(x, np.uint64), total, seed, rounds)
    while len(over := np.flatnonzero(out >= total)):
        out[over] = _turn(out[over], total, seed, rounds)
    return out.astype(np.int64)


def permute(rows: np.ndarray, total: int, seed: int = 0) -> np.ndarray:
    """The places of row numbers 0 to total - 1 in the shuffle: one-to-one."""
    return _walk(rows, total, seed, range(ROUNDS))


def unpermute(places: np.ndarray, total: int, seed: int = 0) -> np.ndarray:
    """The row numbers at places of the shuffle."""
    return _walk(places, total, seed, range(ROUNDS - 1, -1, -1))


def row_numbers(keys: DataFrame, *columns: str) -> DataFrame:
    """``keys`` with a column ``row``: gapless numbers from 0, the same for the same rows in any partitioning.

    Equal rows are counted before the shuffle and numbered one after the other. The order is by hash bucket, then by the
    columns; there are about as many buckets as rows in a bucket, so that neither a bucket nor the table of their
    sizes becomes large.
    """
    counted = stored(keys.groupBy(*columns).agg(F.count("*").alias("copies")), "row-keys")
    total, distinct = counted.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    buckets = 1 << ((max(distinct, 1).bit_length() + 1) // 2)
    counted = counted.withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy("bucket").agg(F.sum("copies").alias("bucket_rows")).withColumn("start", F.coalesce(F.sum("bucket_rows").over(before), F.lit(0)))
    inside = Window.partitionBy("bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("prior", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(sizes, "bucket")
    first = F.col("start") + F.col("prior")
    return placed.select(*columns, F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("row")).withColumn("total", F.lit(total))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(id, size, text_crc32, row, shard, slot) of every row, other columns are not looked at.

    size is the UTF-8 length of the text plus 1, text_crc32 its unsigned CRC-32; a null text counts as empty. Texts do
    not move. Rows with equal id, size and CRC are interchangeable and get neighbouring row numbers; null ids are an id
    like others. With fewer rows than shards some shards stay empty; an empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = row_numbers(keys, "id", "size", "text_crc32")

    def places(row: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(np.uint64), int(total.iloc[0]), seed) if len(row) else row)

    placed = rows.withColumn("place", F.pandas_udf(places, "long")("row", "total"))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "row", F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
                         F.floor(F.col("place") / shards).cast("long").alias("slot"))
