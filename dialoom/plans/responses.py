"""From generated text to conversation records, with every failure kept as a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoom.functions.dims import ratio
from dialoom.functions.text import between, fenced, let, strict_json, truthy
from dialoom.operators.repair import fill_gaps, unique_id
from dialoom.schema import CONVERSATION, LABELS
from dialoom.sources.exchange import PARSE_ERROR

_RECORD = CONVERSATION.simpleString()
PLAN = ["intent", "sentiment", "complexity", "language"]


def json_in(text: Column) -> Column:
    """The JSON object or array in a response, or NULL: the whole text, else the first fenced object,
    the first fenced array, the widest {...}, the widest [...]."""
    def in_fence(c: Column, opening: str, closing: str) -> Column:
        found = F.regexp_extract(c, rf"(?U)```(?:json)?\s*(\{opening}[\s\S]*?\{closing})\s*```", 1)
        return let(found, lambda f: F.when(f != "", f))

    return let(text, lambda c: F.coalesce(
        strict_json(c), strict_json(in_fence(c, "{", "}")), strict_json(in_fence(c, "[", "]")),
        strict_json(between(c, "{", "}")), strict_json(between(c, "[", "]"))))


def parse_texts(results: DataFrame, parse=None) -> DataFrame:
    """Adds ``record`` (a conversation struct) and ``failure`` to rows with ``generated_text``.

    ``parse`` turns the text into strict JSON; by default the code fence is removed, as for batch output.
    """
    text = F.col("generated_text")
    found = strict_json(fenced(text)) if parse is None else parse(text)
    one = let(F.struct(found.alias("j")), lambda s: F.struct(
        F.when(s["j"].startswith("{"), F.from_json(s["j"], _RECORD)).alias("record"),
        F.when(truthy(text) & ~F.coalesce(s["j"].startswith("{"), F.lit(False)), F.lit(PARSE_ERROR)).alias("failure")))
    # inline: each text is parsed once, and later filters stay above the parsing
    return results.select(*results.columns, F.inline(F.array(one)))


def _with_plan(parsed: DataFrame, plan: DataFrame | None, names: list[str]) -> DataFrame:
    """Left join of the plan by record id; without a plan the planned values are NULL.

    The plan is cut to one row per record first: copies on both sides would pair each with each.
    """
    if plan is None:
        return parsed.withColumns({f"plan_{n}": F.lit(None).cast("string") for n in names})
    key = "recordId" if "recordId" in plan.columns else "record_id"
    side = plan.groupBy(F.col(key).alias("record_id")).agg(F.min(F.struct(*names)).alias("_p"))
    return parsed.join(side.select("record_id", *[F.col(f"_p.{n}").alias(f"plan_{n}") for n in names]), "record_id", "left")


def extract(results: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """Conversations whose planned labels *override* the generated ones."""
    rows = _with_plan(parse_texts(results).filter(F.col("record").isNotNull()), plan, PLAN)
    return rows.select("record_id", *[
        F.coalesce(f"plan_{n}", f"record.{n}").alias(n) if n in PLAN else F.col(f"record.{n}").alias(n)
        for n in [*LABELS, "turns"]])


def extract_errors(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(record_id, error, text_preview) of the texts that did not parse, with the columns ``keep`` of ``results``."""
    return parse_texts(results).filter(F.col("failure").isNotNull()).select(
        "record_id", F.col("failure").alias("error"), F.substring("generated_text", 1, 200).alias("text_preview"), *keep)


def process(results: DataFrame, plan: DataFrame | None = None, model: str = "model",
            generated_at: Column | None = None, parse=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Conversations whose planned labels only *fill gaps*, with a unique id, their provenance and the columns ``keep``."""
    rows = _with_plan(parse_texts(results, parse).filter(F.col("record").isNotNull()), plan, PLAN)
    flat = rows.select("record_id", *keep, *[F.col(f"plan_{n}") for n in PLAN],
                       *[F.col(f"record.{n}").alias(n) for n in [*LABELS, "turns"]])
    fixed = fill_gaps(flat, {n: F.col(f"plan_{n}") for n in PLAN})
    at = generated_at if generated_at is not None else F.current_timestamp()
    provenance = F.create_map(
        F.lit("generated_at"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("model"), F.lit(model),
        F.lit("generator_version"), F.lit("1.0.0"), F.lit("batch_inference"), F.lit("true"),
        F.lit("record_id"), F.col("record_id"))
    return fixed.select(
        "record_id", unique_id(F.col("conversation_id"), F.coalesce("record_id", F.to_json("turns")))
        .alias("conversation_id"), *[n for n in LABELS if n != "conversation_id"], "turns", provenance.alias("metadata"), *keep)


def error_summary(errors: DataFrame) -> DataFrame:
    """(error_type, n): errors grouped by their first 50 characters."""
    kind = F.substring(F.coalesce("error", F.lit("unknown")), 1, 50)
    return errors.groupBy(kind.alias("error_type")).agg(F.count("*").alias("n"))


def run_metrics(results: DataFrame) -> DataFrame:
    """One row: generated, failed, success_rate (0 when nothing was tried)."""
    tried = parse_texts(results).filter(truthy(F.col("generated_text")))
    done = F.count("record")
    return tried.agg(done.alias("generated"), (F.count("*") - done).alias("failed"),
                     ratio(done, F.count("*")).alias("success_rate"))
