"""The intent taxonomy and the other label sets, as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The 77 public banking intents in 11 categories. Two intents carry odd spelling
# ("reverted_card_payment?", "Refund_not_showing_up"); they are matched exactly.
INTENTS_BY_CATEGORY: dict[str, list[str]] = {
    "card_management": [
        "activate_my_card", "card_about_to_expire", "card_acceptance", "card_arrival",
        "card_delivery_estimate", "card_linking", "card_not_working", "card_swallowed",
        "compromised_card", "contactless_not_working", "get_disposable_virtual_card",
        "get_physical_card", "getting_spare_card", "getting_virtual_card", "lost_or_stolen_card",
        "order_physical_card", "virtual_card_not_working", "visa_or_mastercard",
    ],
    "card_payments": [
        "card_payment_fee_charged", "card_payment_not_recognised",
        "card_payment_wrong_exchange_rate", "declined_card_payment", "pending_card_payment",
        "reverted_card_payment?", "transaction_charged_twice",
    ],
    "cash_atm": [
        "atm_support", "cash_withdrawal_charge", "cash_withdrawal_not_recognised",
        "declined_cash_withdrawal", "pending_cash_withdrawal", "wrong_amount_of_cash_received",
        "wrong_exchange_rate_for_cash_withdrawal",
    ],
    "transfers": [
        "beneficiary_not_allowed", "cancel_transfer", "declined_transfer", "failed_transfer",
        "pending_transfer", "receiving_money", "transfer_fee_charged", "transfer_into_account",
        "transfer_not_received_by_recipient", "transfer_timing",
    ],
    "top_up": [
        "automatic_top_up", "balance_not_updated_after_bank_transfer",
        "balance_not_updated_after_cheque_or_cash_deposit", "pending_top_up",
        "top_up_by_bank_transfer_charge", "top_up_by_card_charge", "top_up_by_cash_or_cheque",
        "top_up_failed", "top_up_limits", "top_up_reverted", "topping_up_by_card", "verify_top_up",
    ],
    "exchange_currency": [
        "exchange_charge", "exchange_rate", "exchange_via_app", "fiat_currency_support",
        "supported_cards_and_currencies",
    ],
    "account_security": ["change_pin", "lost_or_stolen_phone", "passcode_forgotten", "pin_blocked"],
    "verification_identity": [
        "unable_to_verify_identity", "verify_my_identity", "verify_source_of_funds",
        "why_verify_identity",
    ],
    "account_management": [
        "age_limit", "country_support", "disposable_card_limits", "edit_personal_details",
        "terminate_account",
    ],
    "payment_methods": ["apple_pay_or_google_pay", "direct_debit_payment_not_recognised"],
    "refunds": ["Refund_not_showing_up", "request_refund", "extra_charge_on_statement"],
}

ROWS: list[tuple[int, str, str]] = [
    (i, intent, category)
    for i, (category, intent) in enumerate(
        (c, x) for c, xs in INTENTS_BY_CATEGORY.items() for x in xs
    )
]
INTENTS: list[str] = [intent for _, intent, _ in ROWS]
CATEGORIES: list[str] = list(INTENTS_BY_CATEGORY)

# Allowed labels.
SPEAKERS = ["customer", "agent"]
SENTIMENTS = ["positive", "neutral", "negative"]
COMPLEXITIES = ["simple", "medium", "complex"]
RESOLUTIONS = ["resolved", "escalated", "unresolved"]
EMOTION_ARCS = [
    "stable_positive", "stable_neutral", "frustrated_to_satisfied",
    "frustrated_to_neutral", "neutral_to_frustrated", "stable_frustrated",
]
RESOLUTION_TIMES = ["quick", "standard", "extended"]
SEVERITIES = ["none", "low", "medium", "high"]


def taxonomy(spark: SparkSession) -> DataFrame:
    """The taxonomy as a table (ordinal, intent, category); 77 rows whatever the data size."""
    return spark.createDataFrame(ROWS, "ordinal INT, intent STRING, category STRING")


def intents_of(spark: SparkSession, category: str) -> DataFrame:
    """Intents of one category, in taxonomy order; empty for an unknown category."""
    return taxonomy(spark).filter(F.col("category") == category).select("ordinal", "intent")


def category_of(intent: Column) -> Column:
    """The category of an intent, NULL for an unknown one: a constant map in the plan, no join."""
    return F.element_at(F.create_map(*[F.lit(x) for _, i, c in ROWS for x in (i, c)]), intent)


def with_category(df: DataFrame, name: str = "mapped_category", default: str | None = None, key: str = "intent") -> DataFrame:
    """Adds the taxonomy category of ``key``; ``default`` for unknown intents (NULL if None)."""
    found = category_of(F.col(key))
    return df.withColumn(name, found if default is None else F.coalesce(found, F.lit(default)))


def allowed(c: Column, values: list[str]) -> Column:
    """True when ``c`` is one of ``values``; a NULL is not allowed (never NULL itself)."""
    return F.coalesce(c.isin(values), F.lit(False))
