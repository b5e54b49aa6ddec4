"""Bias: distributions against targets, coverage, balance, severity and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoom.functions.dims import compact, metric, percent, ratio, written, to_row
from dialoom.functions.dist import shares
from dialoom.functions.text import words
from dialoom.taxonomy import COMPLEXITIES, INTENTS, RESOLUTIONS, SENTIMENTS, taxonomy

# Expected shares and limits.
EXPECTED_SENTIMENT = {"positive": 0.30, "neutral": 0.50, "negative": 0.20}
EXPECTED_COMPLEXITY = {"simple": 0.30, "medium": 0.50, "complex": 0.20}
SENTIMENT_LIMIT = 0.30
COVERAGE_LIMIT = 0.10
LANGUAGE_LIMIT = 0.40
COMPLEXITY_LIMIT = 0.30
RARE_SHARE = 0.01
POLARITY_LIMIT = 0.1


def _share(column: str, value: str) -> Column:
    """Share of one value among all rows, case ignored; 0 for no rows."""
    hits = F.coalesce(F.sum((F.lower(column) == value).cast("bigint")), F.lit(0))
    return ratio(hits, F.count("*"))


def _distribution(column: str, expected: dict[str, float]) -> dict[str, Column]:
    """The share of each expected value and ``imbalance``, the largest distance from its target."""
    found = {v: _share(column, v) for v in expected}
    distance = F.greatest(*[F.abs(found[v] - target) for v, target in expected.items()])
    return {**found, "imbalance": F.when(F.count("*") == 0, F.lit(1.0)).otherwise(distance)}


def sentiment_distribution(facts: DataFrame) -> DataFrame:
    """One row: positive, neutral, negative, imbalance. Unknown values stay in the denominator."""
    return facts.agg(*[c.alias(n) for n, c in _distribution("sentiment", EXPECTED_SENTIMENT).items()])


def complexity_distribution(facts: DataFrame) -> DataFrame:
    """One row: simple, medium, complex, imbalance."""
    return facts.agg(*[c.alias(n) for n, c in _distribution("complexity", EXPECTED_COMPLEXITY).items()])


def language_balance(facts: DataFrame) -> DataFrame:
    """One row: en, es, other, balanced (both languages at or above the limit)."""
    en, es = _share("language", "en"), _share("language", "es")
    return facts.agg(
        en.alias("en"), es.alias("es"),
        F.when(F.count("*") == 0, F.lit(0.0)).otherwise(1.0 - en - es).alias("other"),
        ((en >= LANGUAGE_LIMIT) & (es >= LANGUAGE_LIMIT)).alias("balanced"))


def resolution_distribution(facts: DataFrame) -> DataFrame:
    """(status, share) for every status found."""
    return shares(facts, F.lower(F.coalesce("resolution_status", F.lit("unknown"))), "status")\
        .select("status", "share")


def text_sentiment(ids: DataFrame, turns: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(conversation_id, polarity, sentiment) from the customer's words and a (word, polarity) lexicon.

    The polarity is the mean over the known words; a conversation without any is neutral.
    """
    said = turns.filter(F.col("speaker") == "customer").select(
        "conversation_id", F.explode(words(F.col("text"))).alias("word"))
    mean = said.join(written(lexicon.select("word", "polarity"), "lexicon"), "word")\
        .groupBy("conversation_id").agg(F.avg("polarity").alias("polarity"))
    polarity = F.coalesce("polarity", F.lit(0.0))
    return ids.select("conversation_id").join(mean, "conversation_id", "left").select(
        "conversation_id", polarity.alias("polarity"),
        F.when(polarity > POLARITY_LIMIT, "positive").when(polarity < -POLARITY_LIMIT, "negative")
        .otherwise("neutral").alias("sentiment"))


def text_sentiment_distribution(ids: DataFrame, turns: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``sentiment_distribution`` of the sentiment read from the text instead of the label."""
    return sentiment_distribution(text_sentiment(ids, turns, lexicon))


def intent_coverage(facts: DataFrame, expected: int = len(INTENTS)) -> DataFrame:
    """One row: intents, intent_coverage (valid distinct intents over the expected number, at most 1)."""
    valid = facts.filter(F.col("intent").isin(INTENTS))
    n = F.countDistinct("intent")
    return valid.agg(n.alias("intents"), F.least(F.lit(1.0), n / expected).alias("intent_coverage"))


def _intent_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.coalesce("intent", F.lit("unknown")).alias("intent")).agg(F.count("*").alias("n"))


def underrepresented(facts: DataFrame, threshold: float = RARE_SHARE) -> DataFrame:
    """(ordinal, intent, n, share) of taxonomy intents below the threshold, absent ones included.

    Empty for an empty dataset.
    """
    counts = _intent_counts(facts)
    total = counts.agg(F.sum("n")).scalar()
    known = counts.filter(F.col("intent").isin(INTENTS))         # at most 77 rows meet the taxonomy
    joined = taxonomy(facts.sparkSession).join(known, "intent", "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return (joined.select("ordinal", "intent", n.alias("n"), (n / total).alias("share"))
            .filter(F.col("share") < threshold))


def topic_coverage(facts: DataFrame, k: int = 10) -> DataFrame:
    """(intent, n, share) of the k most frequent intents; ties in name order."""
    counts = _intent_counts(facts)
    total = counts.agg(F.sum("n")).scalar()
    return (counts.orderBy(F.desc("n"), "intent").limit(k)
            .select("intent", "n", (F.col("n") / total).alias("share")))


def severity(sentiment_imbalance: Column, coverage: Column, balanced: Column, complexity_imbalance: Column) -> Column:
    """none / low / medium / high for 0 / 1 / 2 / 3+ broken limits."""
    broken = ((sentiment_imbalance > SENTIMENT_LIMIT).cast("int") + (coverage < COVERAGE_LIMIT).cast("int")
              + (~balanced).cast("int") + (complexity_imbalance > COMPLEXITY_LIMIT).cast("int"))
    return F.when(broken == 0, "none").when(broken == 1, "low").when(broken == 2, "medium").otherwise("high")


def _dominant(names: list[str], prefix: str) -> tuple[Column, Column]:
    """Name and share of the largest; the first one wins a tie."""
    top = F.greatest(*[F.col(prefix + n) for n in names])
    name = F.coalesce(*[F.when(F.col(prefix + n) == top, F.lit(n)) for n in names])
    return name, top


def _recommendations() -> Column:
    s_name, s_top = _dominant(SENTIMENTS, "sentiment_")
    c_name, c_top = _dominant(COMPLEXITIES, "complexity_")
    coverage = F.col("intent_coverage")
    split = F.concat(F.lit("Language imbalance: EN="), percent(F.col("language_en")), F.lit(", ES="),
                     percent(F.col("language_es")))
    return compact(
        F.when(F.col("sentiment_imbalance") > SENTIMENT_LIMIT, F.concat(
            F.lit("Sentiment imbalance detected: '"), s_name, F.lit("' is overrepresented ("), percent(s_top),
            F.lit("). Generate more varied sentiments."))),
        F.when(coverage < COVERAGE_LIMIT, F.concat(
            F.lit("Low intent coverage: only "), percent(coverage, 1), F.lit(" of 77 intents covered. "
                  "Generate more diverse intents to improve model generalization.")))
        .when(coverage < 0.50, F.concat(
            F.lit("Intent coverage is "), percent(coverage, 1), F.lit(". Consider generating more samples to "
                  "cover underrepresented intents."))),
        F.when(F.col("underrepresented_count") > 50, F.concat(
            F.lit("Found "), F.col("underrepresented_count").cast("string"), F.lit(" underrepresented intents "
                  "(< 1% each). Consider targeted generation for: "),
            F.array_join(F.slice("underrepresented", 1, 5), ", "), F.lit("..."))),
        F.when(~F.col("language_balanced"), F.concat(split, F.when(
            F.col("language_en") > F.col("language_es"), F.lit(". Generate more Spanish conversations."))
            .otherwise(F.lit(". Generate more English conversations.")))),
        F.when(F.col("complexity_imbalance") > COMPLEXITY_LIMIT, F.concat(
            F.lit("Complexity imbalance: '"), c_name, F.lit("' is overrepresented ("), percent(c_top),
            F.lit("). Balance complexity levels."))),
    )


def detect(facts: DataFrame, sentiments: DataFrame | None = None) -> DataFrame:
    """One row with every bias measure, the severity and the recommendations.

    All label shares come from one pass; the intent counts are shared by the three intent columns.
    ``sentiments`` (conversation_id, sentiment), as from ``text_sentiment``, replaces the label.
    """
    rows = facts
    if sentiments is not None:
        # one row per conversation: copies of an id would pair each with each
        read = sentiments.groupBy("conversation_id").agg(F.min("sentiment").alias("sentiment"))
        rows = facts.drop("sentiment").join(read, "conversation_id", "left")
    en, es = _share("language", "en"), _share("language", "es")
    valid = F.when(F.col("intent").isin(INTENTS), F.col("intent"))
    base = rows.agg(
        F.count("*").alias("conversations"),
        *[c.alias(f"sentiment_{n}") for n, c in _distribution("sentiment", EXPECTED_SENTIMENT).items()],
        *[c.alias(f"complexity_{n}") for n, c in _distribution("complexity", EXPECTED_COMPLEXITY).items()],
        en.alias("language_en"), es.alias("language_es"),
        F.when(F.count("*") == 0, F.lit(0.0)).otherwise(1.0 - en - es).alias("language_other"),
        ((en >= LANGUAGE_LIMIT) & (es >= LANGUAGE_LIMIT)).alias("language_balanced"),
        *[_share("resolution_status", r).alias(f"resolution_{r}") for r in RESOLUTIONS],
        F.least(F.lit(1.0), F.countDistinct(valid) / len(INTENTS)).alias("intent_coverage"),
    )
    # at most 77 and at most 10 entries, whatever the data
    rare = underrepresented(rows).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "intent"))), lambda s: s["intent"]))
    top = topic_coverage(rows).agg(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "intent", "share"))),
        lambda s: F.struct(s["intent"], s["share"]))))
    out = base.withColumns({"underrepresented": rare.scalar(), "topic_coverage": top.scalar()})
    out = out.withColumn("underrepresented_count", F.size("underrepresented"))
    out = out.withColumns({
        "severity": severity(F.col("sentiment_imbalance"), F.col("intent_coverage"), F.col("language_balanced"),
                             F.col("complexity_imbalance")),
        "recommendations": _recommendations(),
    })
    return out.withColumn("bias_detected", F.col("severity") != "none")


def report(bias: DataFrame) -> DataFrame:
    """The flat projection of a ``detect`` row, with the first ten rare intents."""
    def named(prefix: str, names: list[str]) -> Column:
        return F.create_map(*[x for n in names for x in (F.lit(n), F.col(prefix + n))])

    return bias.select(
        named("sentiment_", SENTIMENTS).alias("sentiment_distribution"), "intent_coverage",
        named("language_", ["en", "es"]).alias("language_balance"),
        named("complexity_", COMPLEXITIES).alias("complexity_distribution"),
        F.slice("underrepresented", 1, 10).alias("underrepresented_intents"),
        "bias_detected", F.col("severity").alias("bias_severity"), "recommendations",
        F.col("conversations").alias("num_conversations"))


def summary(bias: DataFrame) -> DataFrame:
    """Findings for a row with severity, sentiment_distribution, intent_coverage, language_distribution."""
    coverage = F.coalesce("intent_coverage", F.lit(0.0))
    uneven = F.array_max(F.map_values("sentiment_distribution")) > 0.5
    one_language = (F.size("language_distribution") > 1) & (F.array_max(F.map_values("language_distribution")) > 0.8)
    return bias.select(
        F.coalesce("severity", F.lit("unknown")).alias("severity"),
        compact(F.when(uneven, F.lit("Sentiment distribution is imbalanced")),
                F.when(coverage < 0.5, F.concat(F.lit("Low intent coverage: "), percent(coverage, 1))),
                F.when(one_language, F.lit("Language distribution is imbalanced"))).alias("findings"),
        compact(F.when(uneven, F.lit("Generate more diverse sentiment samples")),
                F.when(coverage < 0.5, F.lit("Target underrepresented intents in generation")),
                F.when(one_language, F.lit("Generate more samples in underrepresented languages")))
        .alias("recommendations"))


def estimate_severity(profile: DataFrame) -> DataFrame:
    """One row (issues, severity) from a profile (dimension, value, n): the quick check."""
    dims = profile.filter(F.col("dimension").isin("sentiment", "language", "intent"))
    total = F.max(F.when(F.col("dimension") == "all", F.col("n")))
    whole = profile.agg(total).scalar()

    def above(dimension: str, limit: float) -> Column:
        hit = (F.col("dimension") == dimension) & (F.col("n") / whole > limit)
        return F.coalesce(F.sum(hit.cast("bigint")), F.lit(0))

    def values(dimension: str) -> Column:
        return F.coalesce(F.sum((F.col("dimension") == dimension).cast("bigint")), F.lit(0))

    issues = (above("sentiment", 0.6)
              + F.when(values("language") > 1, above("language", 0.9)).otherwise(F.lit(0))
              + (values("intent") < 20).cast("bigint"))
    row = dims.agg(issues.cast("bigint").alias("issues"))
    return row.withColumn("severity", F.when(F.col("issues") == 0, "none").when(F.col("issues") == 1, "low")
                          .when(F.col("issues") == 2, "medium").otherwise("high"))


def coverage_band(intents: DataFrame, expected: int = len(INTENTS)) -> DataFrame:
    """(intents, coverage, band) from a one-column table of intents found."""
    row = to_row([metric(intents.distinct(), intents=F.count("*"))], ["intents"])
    coverage = F.col("intents") / expected * 100
    return row.select(F.col("intents").cast("bigint").alias("intents"), coverage.alias("coverage"),
                      F.when(coverage < 50, "low").when(coverage < 70, "moderate").otherwise("good").alias("band"))


# ---------------------------------------------------------------- the gate

_ORDER = {"none": 0, "low": 1, "medium": 2, "high": 3}


def bias_acceptable(found: Column, limit: str = "medium") -> Column:
    """Severity at or below the limit; an unknown severity counts as 4, an unknown limit as 2."""
    ranks = F.create_map(*[F.lit(x) for kv in _ORDER.items() for x in kv])
    return F.coalesce(F.element_at(ranks, found), F.lit(4)) <= F.lit(_ORDER.get(limit, 2))


def production_ready(runs: DataFrame, quality_limit: float = 70.0, bias_limit: str = "medium",
                     accuracy_limit: float = 0.70) -> DataFrame:
    """Adds quality_ok, bias_ok, accuracy_ok and production_ready to rows with
    ``overall``, ``severity`` and ``accuracy``."""
    return runs.withColumns({
        "quality_ok": F.coalesce("overall", F.lit(0.0)) >= quality_limit,
        "bias_ok": bias_acceptable(F.coalesce("severity", F.lit("none")), bias_limit),
        "accuracy_ok": F.coalesce("accuracy", F.lit(0.0)) >= accuracy_limit,
    }).withColumn("production_ready", F.col("quality_ok") & F.col("bias_ok") & F.col("accuracy_ok"))


