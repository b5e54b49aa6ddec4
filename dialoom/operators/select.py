"""Views, samples, searches and training filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoom.schema import conform

FLAT = ["conversation_id", "intent", "category", "sentiment", "complexity", "language", "turn_count",
        "resolution_status"]


def flat_view(df: DataFrame) -> DataFrame:
    """The flat nine-column view; missing text is "" and a missing count 0."""
    rows = conform(df)

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0 if c == "turn_count" else ""))

    return rows.select(*[filled(c).alias(c) for c in FLAT], filled("customer_emotion_arc").alias("emotion_arc"))


def samples(df: DataFrame, n: int = 5, intent: str | None = None, sentiment: str | None = None) -> DataFrame:
    """The first n conversations by id, optionally of one intent or sentiment."""
    rows = df
    if intent:
        rows = rows.filter(F.col("intent") == intent)
    if sentiment:
        rows = rows.filter(F.col("sentiment") == sentiment)
    return rows.orderBy("conversation_id").limit(n)


def random_row(df: DataFrame, seed: int = 42, intent: str | None = None) -> DataFrame:
    """One seeded random conversation, optionally of one intent."""
    rows = df.filter(F.col("intent") == intent) if intent else df
    return rows.orderBy(_draw(seed), "conversation_id").limit(1)


def _draw(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), "conversation_id"))


def random_pairs(a: DataFrame, b: DataFrame, seed: int = 42) -> DataFrame:
    """For every intent in both datasets one random conversation of each, side by side.

    The pick is a minimum over the hash, combined before the shuffle: one row per intent and side
    is joined, never all pairs of an intent.
    """
    fields = ["conversation_id", "sentiment", "turns"]

    def pick(df: DataFrame, side: str) -> DataFrame:
        # the size is all that is needed of the turns
        best = F.min(F.struct(_draw(seed).alias("h"), "conversation_id",
                              "sentiment", F.size("turns").alias("turns")))
        rows = df.filter(F.length("intent") > 0).groupBy("intent").agg(best.alias("p"))
        return rows.select("intent", *[F.col(f"p.{f}").alias(f"{f}{side}") for f in fields])

    return pick(a, "1").join(pick(b, "2"), "intent").withColumns({"intent1": F.col("intent"), "intent2": F.col("intent")})


def assess(pairs: DataFrame) -> DataFrame:
    """Adds length_match, sentiment_match, intent_match to rows with turns1/2, sentiment1/2, intent1/2."""
    def same(name: str) -> Column:
        one, two = F.lower(f"{name}1"), F.lower(f"{name}2")
        return F.coalesce((one == two) & (F.length(one) > 0), F.lit(False))

    length1, length2 = F.coalesce("turns1", F.lit(0)), F.coalesce("turns2", F.lit(1))
    return pairs.withColumns({"length_match": F.abs(length1 - length2) <= 2,
                              "sentiment_match": same("sentiment"), "intent_match": same("intent")})


def search(datasets: DataFrame, text: str, columns: tuple[str, ...] = ("id", "domain", "file_path", "notes")) -> DataFrame:
    """Datasets whose id, domain, path or notes contain ``text``, case ignored."""
    have = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c in datasets.columns]
    return datasets.filter(F.lower(F.concat_ws(" ", *have)).contains(text.lower()))


def training_rows(df: DataFrame, language: str | None = None, min_turns: int = 2, max_turns: int = 20,
                  intents: list[str] | DataFrame | None = None, sentiments: list[str] | None = None) -> DataFrame:
    """Conversations fit for training. ``intents`` may be a table (intent); then it is a semi join."""
    rows = df.filter(F.size("turns").between(min_turns, max_turns))
    if language:
        rows = rows.filter(F.col("language") == language)
    if isinstance(intents, DataFrame):
        rows = rows.join(intents.select("intent"), "intent", "left_semi")
    elif intents:
        rows = rows.filter(F.col("intent").isin(intents))
    if sentiments:
        rows = rows.filter(F.col("sentiment").isin(sentiments))
    return rows


def few_shot(examples: DataFrame, by: tuple[str, ...] = ("language", "sentiment", "complexity"), n: int = 3) -> DataFrame:
    """The first n examples (by conversation_id) of every combination of ``by``, with their rank.

    The rank filter runs before the shuffle too, so a frequent combination sends few rows.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("conversation_id"))
    return examples.withColumn("rank", rank).filter(F.col("rank") <= n)


def with_language_fallback(rows: DataFrame, per_language: DataFrame, value: str, default: str = "en") -> DataFrame:
    """Joins a (language, value) table; languages without a row take the row of ``default``.

    ``per_language`` holds one row per language and is written first, so that its size is known.
    """
    from dialoom.functions.dims import written

    dim = written(per_language.select(F.col("language").alias("_language"), F.col(value).alias("_own")))
    base = per_language.filter(F.col("language") == default).agg(F.max(value)).scalar()
    joined = rows.join(dim, rows["language"] == F.col("_language"), "left")
    return joined.withColumn(value, F.coalesce("_own", base)).drop("_language", "_own")
