"""Record rules. A broken rule becomes a row (id, rule, position, message); nothing is dropped.

In a table a missing key is a NULL, so "missing" below means NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoom.functions.text import strip, truthy
from dialoom.schema import conform
from dialoom.taxonomy import INTENTS, RESOLUTIONS, SENTIMENTS, SPEAKERS, allowed

# Limits and enums of the typed record.
MIN_TURN_LENGTH, MAX_TURN_LENGTH = 10, 500
MIN_TURNS, MAX_TURNS = 2, 20
LANGUAGES = ["en", "es", "fr", "de", "pt", "it", "nl", "pl", "ru", "zh", "ja", "ko", "ar", "hi", "tr"]
TYPED_INTENTS = [
    "account_inquiry", "billing_issue", "technical_support", "product_information", "complaint",
    "cancellation_request", "feature_request", "password_reset", "refund_request", "general_inquiry",
]
TRANSACTION_TYPES = ["purchase", "withdrawal", "deposit", "transfer", "payment"]
MERCHANT_CATEGORIES = ["retail", "groceries", "restaurants", "travel", "utilities", "entertainment",
                       "healthcare", "education", "other"]
ACCOUNT_TYPES = ["checking", "savings", "credit", "investment"]
AGE_BRACKETS = ["18-25", "26-35", "36-50", "51-65", "65+"]
INCOME_BRACKETS = ["low", "medium", "high"]
FILE_FORMATS = ["json", "jsonl", "parquet", "csv"]
REQUIRED_FIELDS = [
    "conversation_id", "intent", "category", "sentiment", "complexity", "language", "turn_count",
    "customer_emotion_arc", "resolution_time_category", "resolution_status", "turns",
]
TYPED_FIELDS = ["conversation_id", "intent", "sentiment", "turns", "resolution_status", "language", "metadata"]

_VIOLATION = "struct<rule:string,position:int,message:string>"


def _broken(rule: str, condition: Column, message: Column | str, position: Column | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    where = F.lit(None).cast("int") if position is None else position.cast("int")
    return F.when(condition, F.struct(F.lit(rule).alias("rule"), where.alias("position"), text.alias("message"))
                  .cast(_VIOLATION))


def violations(df: DataFrame, key: str, *found: Column) -> DataFrame:
    """One row per broken rule. ``found`` are columns of violation structs or arrays of them."""
    rows = [c if many else F.array(c) for c, many in _kinds(found)]
    return df.select(F.col(key).alias("id"), F.inline(F.array_compact(F.concat(*rows))))


def _kinds(found):
    return [(c[0], True) if isinstance(c, tuple) else (c, False) for c in found]


def _per_turn(check) -> tuple[Column]:
    """Violations of every turn; ``check(turn, index)`` gives an array of structs or NULLs."""
    empty = F.array().cast(f"array<{_VIOLATION}>")
    return (F.coalesce(F.flatten(F.transform(F.col("turns"), check)), empty),)


def clean_text(df: DataFrame) -> DataFrame:
    """Strips the text of every turn."""
    def one(t: Column) -> Column:
        return F.struct(t["speaker"].alias("speaker"), strip(t["text"]).alias("text"))
    return df.withColumn("turns", F.transform("turns", one))


def typed_violations(df: DataFrame, intents: list[str] = TYPED_INTENTS) -> DataFrame:
    """The typed conversation: enums, 2..20 turns, 10..500 characters, customer first, known language.

    A missing language counts as "en". Columns outside the record break ``extra_field`` in every row.
    """
    extra = sorted(set(df.columns) - set(TYPED_FIELDS))
    rows = conform(df, ["language"])
    turns = F.col("turns")
    size = F.size(turns)

    def turn(t: Column, i: Column) -> Column:
        length = F.length(strip(t["text"]))
        said = F.coalesce(length, F.lit(-1))
        return F.array(
            _broken("turn.speaker", ~allowed(t["speaker"], SPEAKERS), "speaker must be customer or agent", i),
            _broken("turn.text_missing", said < 1, "Text cannot be empty or whitespace only", i),
            _broken("turn.text_short", said.between(1, MIN_TURN_LENGTH - 1), "text is too short", i),
            _broken("turn.text_long", said > MAX_TURN_LENGTH, "text is too long", i))

    first = F.get(turns, F.lit(0))["speaker"]
    return violations(
        rows, "conversation_id",
        _broken("conversation_id", F.col("conversation_id").isNull(), "conversation_id is required"),
        _broken("intent", ~allowed(F.col("intent"), intents), "intent is not allowed"),
        _broken("sentiment", ~allowed(F.col("sentiment"), SENTIMENTS), "sentiment is not allowed"),
        _broken("resolution_status", ~allowed(F.col("resolution_status"), RESOLUTIONS), "resolution_status is not allowed"),
        _broken("language", ~allowed(F.coalesce("language", F.lit("en")), LANGUAGES),
                F.concat(F.lit("Language '"), F.col("language"), F.lit("' not supported"))),
        _broken("min_turns", turns.isNull() | (size < MIN_TURNS), f"at least {MIN_TURNS} turns are required"),
        _broken("max_turns", size > MAX_TURNS, f"at most {MAX_TURNS} turns are allowed"),
        _broken("first_speaker", (size > 0) & ~F.coalesce(first == "customer", F.lit(False)),
                "First turn must be from customer"),
        *[_broken("extra_field", F.lit(True), f"extra field {name}") for name in extra],
        _per_turn(turn))


def schema_violations(df: DataFrame, intents: list[str] = INTENTS) -> DataFrame:
    """The generated conversation: 11 required fields, its turns, and an intent of the taxonomy."""
    rows = conform(df)
    size = F.size("turns")

    def turn(t: Column, i: Column) -> Column:
        number = F.concat(F.lit("Turn "), i.cast("string"))
        some = size >= 2
        return F.array(
            _broken("turn.speaker_missing", some & t["speaker"].isNull(), F.concat(number, F.lit(" missing 'speaker'")), i),
            _broken("turn.text_missing", some & t["text"].isNull(), F.concat(number, F.lit(" missing 'text'")), i),
            _broken("turn.speaker", some & ~allowed(t["speaker"], SPEAKERS), F.concat(
                number, F.lit(" has invalid speaker: "), F.coalesce(t["speaker"], F.lit("None"))), i))

    intent = F.col("intent")
    return violations(
        rows, "conversation_id",
        *[_broken("missing", F.col(f).isNull(), f"Missing required field: {f}") for f in REQUIRED_FIELDS],
        _broken("min_turns", size < 2, "Conversation must have at least 2 turns"),
        _per_turn(turn),
        _broken("intent", intent.isNotNull() & ~allowed(intent, intents), F.concat(F.lit("Invalid intent: "), intent)))


def _first(*messages: Column) -> list[Column]:
    """is_valid and error: the first message that is not NULL, in the given order."""
    error = F.coalesce(*messages)
    return [error.isNull().alias("is_valid"), F.coalesce(error, F.lit("")).alias("error")]


def first_error(df: DataFrame) -> DataFrame:
    """(conversation_id, is_valid, error): the first broken rule of the planning check."""
    rows = conform(df)
    turns = F.col("turns")
    size = F.coalesce(F.size(turns), F.lit(0))

    def turn(t: Column, i: Column) -> Column:
        number = F.concat(F.lit("Turn "), i.cast("string"))
        return F.when(t["speaker"].isNull() | t["text"].isNull(), F.concat(number, F.lit(" missing speaker or text")))\
            .when(~truthy(strip(t["text"])), F.concat(number, F.lit(" has empty text")))

    opener = F.get(turns, F.lit(0))["speaker"]
    return rows.select("conversation_id", *_first(
        *[F.when(F.col(f).isNull(), F.lit(f"Missing field: {f}")) for f in
          ("conversation_id", "intent", "sentiment", "turns", "resolution_status")],
        F.when(size < 2, F.concat(F.lit("Invalid turns count: "), size.cast("string"))),
        F.when(~F.coalesce(opener == "customer", F.lit(False)), F.lit("First speaker must be customer")),
        F.get(F.array_compact(F.transform(turns, turn)), F.lit(0))))


def first_error_strict(df: DataFrame) -> DataFrame:
    """The smoke-test variant: speaker enum per turn first, the opening speaker last."""
    rows = conform(df)
    turns = F.col("turns")
    size = F.coalesce(F.size(turns), F.lit(0))

    def turn(t: Column, i: Column) -> Column:
        number = F.concat(F.lit("Turn "), i.cast("string"))
        return F.when(t["speaker"].isNull() | t["text"].isNull(), F.concat(number, F.lit(" missing speaker or text")))\
            .when(~allowed(t["speaker"], SPEAKERS), F.concat(number, F.lit(" has invalid speaker: "), t["speaker"]))

    opener = F.get(turns, F.lit(0))["speaker"]
    return rows.select("conversation_id", *_first(
        *[F.when(F.col(f).isNull(), F.lit(f"Missing required field: {f}")) for f in
          ("conversation_id", "intent", "sentiment", "turns", "resolution_status")],
        F.when(size < 2, F.concat(F.lit("Invalid turns: expected list with at least 2 items, got "), size.cast("string"))),
        F.get(F.array_compact(F.transform(turns, turn)), F.lit(0)),
        F.when(~F.coalesce(opener == "customer", F.lit(False)), F.lit("First turn must be from customer"))))


def series_error(df: DataFrame) -> DataFrame:
    """(series_id, is_valid, error) of series whose ``target`` is an array of text values."""
    fields = ["series_id", "domain", "series_type", "frequency", "target"]
    target = F.col("target")
    head = F.slice(target, 1, 10)
    numeric = F.transform(head, lambda v, i: F.when(v.try_cast("double").isNull(), F.concat(
        F.lit("Target["), i.cast("string"), F.lit("] is not numeric"))))
    return df.select("series_id", *_first(
        *[F.when(F.col(f).isNull(), F.lit(f"Missing required field: {f}")) for f in fields],
        F.when(F.size(target) < 1, F.lit("Target array is empty")),
        F.get(F.array_compact(numeric), F.lit(0))))


def transaction_violations(df: DataFrame) -> DataFrame:
    """Transactions: enums, amount > 0, risk score in [0, 1], a timestamp."""
    category = F.col("merchant_category")
    risk = F.coalesce("risk_score", F.lit(0.0))
    return violations(
        df, "transaction_id",
        *[_broken("missing", F.col(f).isNull(), f"{f} is required")
          for f in ("transaction_id", "account_id", "timestamp")],
        _broken("transaction_type", ~allowed(F.col("transaction_type"), TRANSACTION_TYPES), "transaction_type is not allowed"),
        _broken("amount", ~F.coalesce(F.col("amount") > 0, F.lit(False)), "amount must be greater than 0"),
        _broken("merchant_category", category.isNotNull() & ~allowed(category, MERCHANT_CATEGORIES),
                "merchant_category is not allowed"),
        _broken("risk_score", ~risk.between(0, 1), "risk_score must be within 0..1"))


def account_violations(df: DataFrame) -> DataFrame:
    """Accounts: type and bracket enums, an opening date."""
    def optional(column: str, values: list[str]) -> Column:
        return _broken(column, F.col(column).isNotNull() & ~allowed(F.col(column), values), f"{column} is not allowed")

    return violations(
        df, "account_id",
        *[_broken("missing", F.col(f).isNull(), f"{f} is required") for f in ("account_id", "account_opened_date")],
        _broken("account_type", ~allowed(F.col("account_type"), ACCOUNT_TYPES), "account_type is not allowed"),
        optional("holder_age_bracket", AGE_BRACKETS), optional("holder_income_bracket", INCOME_BRACKETS))


def metric_violations(df: DataFrame) -> DataFrame:
    """Metric rows: four scores in [0, 1] and the overall score in [0, 100]; all required."""
    def outside(column: str, top: float) -> Column:
        return _broken(column, ~F.coalesce(F.col(column).between(0, top), F.lit(False)), f"{column} must be within 0..{top:g}")

    return violations(df, "dataset_id", *[outside(c, 1.0) for c in ("completeness", "consistency", "realism", "diversity")],
                      outside("overall", 100.0))


def dataset_violations(df: DataFrame) -> DataFrame:
    """Dataset metadata: size > 0, file size >= 0, a known format and domain, a generation date."""
    def no(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    return violations(
        df, "dataset_id",
        _broken("domain", no(F.col("domain") == "customer_service"), "domain is not allowed"),
        _broken("size", no(F.col("size") > 0), "size must be greater than 0"),
        _broken("file_size_mb", no(F.col("file_size_mb") >= 0), "file_size_mb must not be negative"),
        _broken("file_format", ~allowed(F.col("file_format"), FILE_FORMATS), "file_format is not allowed"),
        _broken("generation_date", F.col("generation_date").isNull(), "generation_date is required"))


def violation_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("n"))


def as_utc(c: Column) -> Column:
    """A timestamp from ISO text; text without an offset is taken as UTC whatever the session zone."""
    zoned = F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), c).otherwise(F.concat(c, F.lit("Z")))
    return F.try_to_timestamp(zoned)


