"""Prompt texts as column expressions. The wording is a parameter; rules and arc descriptions come from the caller only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dialoom.functions.dims import written
from dialoom.plans.quota import draw_parameters
from dialoom.taxonomy import INTENTS, with_category

# Turn ranges, and label names per language.
TURN_RANGES = {"simple": "2-4", "medium": "4-6", "complex": "6-10"}
TURN_RANGE_DEFAULT = "4-6"
LABEL_NAMES = {
    "en": {"category": "Category", "sentiment": "Sentiment", "complexity": "Complexity",
           "turns": "Target turns", "requirements": "Requirements", "output": "Output format"},
    "es": {"category": "Categoría", "sentiment": "Sentimiento", "complexity": "Complejidad",
           "turns": "Turnos objetivo", "requirements": "Requisitos", "output": "Formato de salida"},
}
LANGUAGE_NAMES = {"en": "English"}       # every other language is written as Spanish
LANGUAGE_DEFAULT = "Spanish"


@dataclass(frozen=True)
class Wording:
    """The fixed sentences around the variable parts of a prompt."""

    opening: str = "Write one support conversation between a customer of a mobile bank and an agent."
    batch_opening: str = "support conversations between customers of a mobile bank and agents."
    requirements: tuple[str, ...] = ()      # rules of the caller; the language of the answer is always the last one
    closing: str = "Answer with this JSON object and nothing else:"
    batch_closing: str = "Answer with a JSON array of such objects and nothing else:"
    examples: str = "Examples:"
    then: str = "Now write a new conversation:"
    system: dict[str, str] = field(default_factory=lambda: {
        "en": "You write realistic support conversations for a mobile bank. Output JSON only.",
        "es": "Escribes conversaciones de soporte realistas para un banco móvil. Devuelve solo JSON.",
    })
    arcs: dict[str, str] = field(default_factory=dict)      # what the caller says about an emotion arc, by its name


DEFAULT = Wording()


def _pick(values: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def _label(name: str, language: Column) -> Column:
    return _pick({lang: names[name] for lang, names in LABEL_NAMES.items()}, language, LABEL_NAMES["en"][name])


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def prompt(words: Wording = DEFAULT) -> Column:
    """The user prompt of a row with intent, category, sentiment, complexity, language, and optionally
    emotion_arc and context (NULL for none)."""
    c = F.col
    lang = c("language")
    category = F.coalesce("category", F.lit("general"))
    told = F.coalesce(_text(" - ", F.element_at(F.create_map(*[F.lit(x) for kv in words.arcs.items() for x in kv]), c("emotion_arc"))),
                      F.lit("")) if words.arcs else F.lit("")
    arc = F.coalesce(_text("\nEmotion arc: ", c("emotion_arc"), told), F.lit(""))
    context = F.coalesce(_text("\nAdditional context: ", c("context")), F.lit(""))
    rules = "".join(f"\n{i}. {r}" for i, r in enumerate(words.requirements, 1))
    tongue = _text(f"\n{len(words.requirements) + 1}. Write in ", _pick(LANGUAGE_NAMES, lang, LANGUAGE_DEFAULT))
    return _text(
        words.opening, "\n\nIntent: ", c("intent"),
        "\n", _label("category", lang), ": ", category,
        "\n", _label("sentiment", lang), ": ", c("sentiment"),
        "\n", _label("complexity", lang), ": ", c("complexity"),
        "\n", _label("turns", lang), ": ", _pick(TURN_RANGES, c("complexity"), TURN_RANGE_DEFAULT), arc, context,
        "\n\n", _label("requirements", lang), ":", rules, tongue,
        "\n\n", _label("output", lang), ": ", words.closing, "\n",
        '{"conversation_id": "conv_XXX", "intent": "', c("intent"), '", "category": "', category,
        '", "sentiment": "', c("sentiment"), '", "complexity": "', c("complexity"), '", "language": "', lang,
        '", "turn_count": <number>, "customer_emotion_arc": "<arc_type>", '
        '"resolution_time_category": "quick|standard|extended", "resolution_status": "resolved|escalated|unresolved", '
        '"turns": [{"speaker": "customer", "text": "..."}, {"speaker": "agent", "text": "..."}]}')


def with_prompt(plan: DataFrame, words: Wording = DEFAULT) -> DataFrame:
    """Adds ``prompt``; missing category, emotion_arc or context columns are added as needed."""
    rows = plan
    if "category" not in rows.columns:
        rows = with_category(rows, "category")
    for name in ("emotion_arc", "context"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows.withColumn("prompt", prompt(words))


def example_texts(examples: DataFrame, n: int = 2) -> DataFrame:
    """(language, sentiment, complexity, examples): the first n examples of each combination as text.

    ``examples`` holds conversations with those labels and an ``example`` text.
    """
    from dialoom.operators.select import few_shot

    by = ["language", "sentiment", "complexity"]
    first = few_shot(examples.dropna(subset=by), tuple(by), n)
    numbered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "example"))),
                           lambda s: _text("Example ", s["rank"].cast("string"), ":\n", s["example"]))
    return first.groupBy(*by).agg(F.array_join(numbered, "\n\n").alias("examples"))


def with_examples(plan: DataFrame, examples: DataFrame, n: int = 2, words: Wording = DEFAULT) -> DataFrame:
    """Adds ``system`` and a ``prompt`` that starts with examples of the row's own labels.

    The example table has one row per label combination and is written first, so its plan runs once.
    """
    texts = written(example_texts(examples, n), "examples")
    rows = with_prompt(plan, words).join(texts, ["language", "sentiment", "complexity"], "left")
    full = _text(words.examples, "\n\n", F.coalesce("examples", F.lit("")), "\n\n", words.then, "\n\n", F.col("prompt"))
    return rows.withColumns({"prompt": full, "system": _pick(words.system, F.col("language"), words.system["en"])})\
        .drop("examples")


def batch_prompts(plan: DataFrame, size: int, words: Wording = DEFAULT) -> DataFrame:
    """(language, batch_id, specifications, prompt): one prompt for up to ``size`` rows of one language.

    A group holds at most ``size`` consecutive plan rows, whatever the plan's length.
    """
    spec = F.struct("plan_id", "intent", "sentiment", "complexity")
    listed = plan.groupBy("language", F.floor(F.col("plan_id") / size).alias("batch_id")).agg(
        F.array_sort(F.collect_list(spec)).alias("s"))
    lines = F.transform("s", lambda x, i: _text(
        (i + 1).cast("string"), ". Intent: ", x["intent"], ", Sentiment: ", x["sentiment"], ", Complexity: ", x["complexity"]))
    text = _text("Write ", F.size("s").cast("string"), " ", words.batch_opening, "\n\n", F.array_join(lines, "\n"),
                 "\n\nLanguage: ", _pick(LANGUAGE_NAMES, F.col("language"), LANGUAGE_DEFAULT), "\n\n", words.batch_closing,
                 "\n", '{"conversation_id": "conv_XXX", "intent": "...", "category": "...", "sentiment": "...", '
                 '"complexity": "...", "language": "', F.col("language"), '", "turn_count": <number>, '
                 '"customer_emotion_arc": "...", "resolution_time_category": "...", "resolution_status": "...", "turns": [...]}')
    return listed.select("language", "batch_id", F.size("s").alias("specifications"), text.alias("prompt"))


def prepare(spark: SparkSession, count: int, examples: DataFrame, language: str = "en",
            intents: list[str] | None = None, weights: dict[str, dict[str, float]] | None = None,
            seed: int = 42, words: Wording = DEFAULT) -> DataFrame:
    """``count`` prompts with their metadata: record_index, labels, system, prompt."""
    from dialoom.plans.quota import cycled

    rows = spark.range(count).select(F.col("id").alias("record_index"), F.lit(language).alias("language"))
    if intents:
        rows = rows.withColumn("intent", cycled(F.col("record_index"), intents))
    drawn = draw_parameters(rows, "record_index", seed, INTENTS, weights)
    return with_examples(drawn, examples, 2, words).select(
        "record_index", "intent", "sentiment", "complexity", "language", "system", "prompt")
