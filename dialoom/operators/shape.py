"""The two physical forms of a conversation dataset, and the per-conversation facts of each.

*Nested*: one row per conversation, turns in an array. All facts are row expressions (no shuffle).
*Long*: one row per turn. All facts are aggregates that combine before the shuffle; nothing collects
the turns of a conversation, so one conversation may hold any share of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from dialoom.functions.ordered import longest_runs
from dialoom.functions.text import truthy
from dialoom.schema import LABELS, conform

@dataclass(frozen=True)
class Corpus:
    """The views operators read: each holds no more work than its columns need.

    ``heads``: labels, one row per conversation. ``light``: labels and turn facts without the speaker
    runs. ``facts``: all facts. ``turns``: (conversation_id, turn_idx, speaker, text).
    """

    facts: DataFrame
    turns: DataFrame
    heads: DataFrame
    light: DataFrame


def corpus_from_nested(df: DataFrame) -> Corpus:
    facts = facts_from_nested(df)
    return Corpus(facts, turns_from_nested(df), conform(df).select(*LABELS), facts)


def corpus_from_turns(heads: DataFrame, turns: DataFrame) -> Corpus:
    return Corpus(facts_from_turns(heads, turns), turns, conform(heads).select(*LABELS),
                  facts_from_turns(heads, turns, runs=False))


def turns_from_nested(df: DataFrame) -> DataFrame:
    """One row per turn, positions from 0."""
    return df.select("conversation_id", F.posexplode("turns").alias("turn_idx", "t")).select(
        "conversation_id", F.col("turn_idx").cast("bigint").alias("turn_idx"),
        F.col("t.speaker").alias("speaker"), F.col("t.text").alias("text"))


def run_length(turns: Column) -> Column:
    """Longest run of one speaker in a turn array; a missing speaker equals a missing speaker."""
    start = F.struct(F.lit(None).cast("string").alias("who"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(acc: Column, t: Column) -> Column:
        run = F.when(acc["who"].eqNullSafe(t["speaker"]), acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(t["speaker"].alias("who"), run.alias("run"),
                        F.greatest(acc["top"], run).alias("top"))

    return F.aggregate(turns, start, step)["top"]


def first_of(turns: Column, speaker: str) -> Column:
    """Text of the first turn of one speaker."""
    return F.get(F.filter(turns, lambda t: t["speaker"] == speaker), F.lit(0))["text"]


def facts_from_nested(df: DataFrame) -> DataFrame:
    df = conform(df)
    t = F.col("turns")
    n = F.coalesce(F.when(t.isNotNull(), F.size(t)), F.lit(0)).cast("bigint")

    def total(value) -> Column:
        return F.coalesce(F.aggregate(t, F.lit(0).cast("bigint"), lambda a, x: a + value(x)),
                          F.lit(0).cast("bigint"))

    return df.select(
        *LABELS,
        t.isNotNull().alias("turns_given"),
        n.alias("n_turns"),
        total(lambda x: truthy(x["speaker"]).cast("bigint")).alias("filled_speakers"),
        total(lambda x: truthy(x["text"]).cast("bigint")).alias("filled_texts"),
        total(lambda x: F.coalesce(F.length(x["text"]), F.lit(0)).cast("bigint")).alias("text_chars"),
        F.get(t, F.lit(0))["speaker"].alias("first_speaker"),
        F.get(t, F.lit(0))["text"].alias("first_text"),
        first_of(t, "customer").alias("first_customer_text"),
        F.coalesce(run_length(t), F.lit(0)).cast("bigint").alias("longest_run"),
    )


def facts_from_turns(heads: DataFrame, turns: DataFrame, runs: bool = True) -> DataFrame:
    """``heads`` holds the labels of each conversation, ``turns`` the long form.

    Without ``runs`` the longest_run column, and the range exchange it needs, are left out.
    """
    heads = conform(heads)
    first = F.min(F.struct("turn_idx", "speaker", "text"))
    asked = F.col("speaker") == "customer"
    sums = turns.groupBy("conversation_id").agg(
        F.count("*").alias("n_turns"),
        F.sum(truthy(F.col("speaker")).cast("bigint")).alias("filled_speakers"),
        F.sum(truthy(F.col("text")).cast("bigint")).alias("filled_texts"),
        F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).alias("text_chars"),
        first.alias("_first"),
        F.min(F.when(asked, F.struct("turn_idx", "text"))).alias("_asked"),
    )
    out = heads.select(*LABELS).join(sums, "conversation_id", "left")
    if runs:
        longest = longest_runs(turns, F.col("conversation_id"), F.col("turn_idx"), F.col("speaker"))
        out = out.join(longest.select(F.col("key").alias("conversation_id"), F.col("longest").alias("longest_run")),
                       "conversation_id", "left")
    counts = ["n_turns", "filled_speakers", "filled_texts", "text_chars"] + (["longest_run"] if runs else [])
    return out.select(
        *LABELS,
        F.col("n_turns").isNotNull().alias("turns_given"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.col("_first.speaker").alias("first_speaker"),
        F.col("_first.text").alias("first_text"),
        F.col("_asked.text").alias("first_customer_text"),
    )
