"""The corpus pipeline: from raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before has kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from dialoom.llm import bpe, decontaminate, langid, lines, minhash
from dialoom.llm.common import stored
from dialoom.llm.queries import remainder, table

MIN_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters or with a score below the threshold go."""
    model = langid.learn(docs.filter(remainder("doc_id", 4) != 2))
    return langid.with_language(docs, model, MIN_LANGUAGE_SCORE)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten or more documents go; ``n_chars`` follows the text."""
    left = lines.without_repeated_lines(docs, min_docs=10, min_chars=1)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id; ids may be null or repeated."""
    return minhash.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item go."""
    return decontaminate.without_matches(docs, decontaminate.matches(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of the text that they decode to."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("repeated_lines", repeated_lines), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("tokens", tokens)]
ORACLE_SQL = None       # language identification has no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
