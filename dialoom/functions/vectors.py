"""Text vectors without a model: hashed TF-IDF weights, projected to a few dimensions by signs that follow from a seed.

A term's bucket is a part of its MD5 hash, and the sign of a bucket in each dimension is one bit of another one, so there is no vocabulary and no
matrix, and every machine and engine gets the same vectors. Inner products of the projections estimate those of the
TF-IDF vectors; texts that share no term are close to orthogonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoom.functions.dims import written
from dialoom.functions.ordered import inner_ngrams
from dialoom.functions.text import words

DIMENSIONS = 128        # the bits of one MD5 hash
BUCKETS = 1 << 16       # the table of weights has at most this many rows


def buckets(text: Column, ngrams: int = 2) -> Column:
    """The hashed words and word n-grams of a text, an array of bucket numbers with repetitions: the first four hexadecimal digits of the MD5 hash."""
    tokens = words(text)
    terms = F.concat(*[tokens if n == 1 else inner_ngrams(tokens, n) for n in range(1, ngrams + 1)])
    return F.transform(terms, lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"))


def idf_weights(texts: DataFrame, columns: list[str], ngrams: int = 2) -> DataFrame:
    """(bucket, idf) over the texts in ``columns`` that are not null: ln((1 + texts) / (1 + texts with the bucket)) + 1."""
    listed = texts.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("t")).filter("t IS NOT NULL")
    counts = listed.select(F.explode(F.array_distinct(buckets(F.col("t"), ngrams))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df"))
    n = listed.agg(F.count("*")).scalar()
    return counts.select("bucket", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def projected(rows: DataFrame, key: str, columns: dict[str, str], ngrams: int = 2, seed: int = 13) -> DataFrame:
    """(key, a vector for each entry of ``columns``: name of the vector -> column of the text) of every row of ``rows``, whose keys are distinct.

    A vector is the sum over the terms of count * idf * sign, divided by the square root of the dimensions. A null text gives a null vector, a text
    without words one of zeros. Weights are a bounded table; terms are added up by hash aggregation, so no step holds a text's terms together.
    """
    weights = written(idf_weights(rows, list(columns.values()), ngrams), "idf")
    parts = [F.struct(F.lit(name).alias("name"), buckets(F.col(c), ngrams).alias("b")) for name, c in columns.items()]
    terms = rows.select(key, F.inline(F.array(*parts))).select(key, "name", F.explode("b").alias("bucket"))
    bits = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("bucket").cast("string")))
    halves = [F.conv(F.substring(bits, 1 + 16 * k, 16), 16, -10).cast("bigint").alias(f"h{k}") for k in (0, 1)]
    scaled = terms.join(weights, "bucket").select(key, "name", F.col("idf").alias("w"), *halves)
    sums = [F.sum(F.when(F.getbit(f"h{i // 64}", F.lit(63 - i % 64)) == 1, F.col("w")).otherwise(-F.col("w"))) / float(DIMENSIONS) ** 0.5 for i in range(DIMENSIONS)]
    vectors = scaled.groupBy(key, "name").agg(*[c.alias(f"d{i}") for i, c in enumerate(sums)])
    vectors = vectors.select(key, "name", F.array(*[f"d{i}" for i in range(DIMENSIONS)]).alias("v"))
    wide = vectors.groupBy(key).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(f"_{name}") for name in columns])
    zero = F.array_repeat(F.lit(0.0), DIMENSIONS)
    found = rows.select(key, *dict.fromkeys(columns.values())).join(wide, key, "left")
    return found.select(key, *[F.when(F.col(c).isNotNull(), F.coalesce(f"_{name}", zero)).alias(name) for name, c in columns.items()])
