"""Scores on hand-written conversations, empty input, and properties."""

import json
import math

import pytest
from pyspark.sql import functions as F

from dialoom.functions.dims import to_row
from dialoom.functions.dist import js_divergence
from dialoom.operators import bias as B, profile as P, quality as Q, rules as R
from dialoom.operators.shape import corpus_from_nested, corpus_from_turns, facts_from_nested
from dialoom.schema import CONVERSATION


def turns(*speakers, text="Hello, I need help with my card please"):
    return [{"speaker": s, "text": f"{text} {i}"} for i, s in enumerate(speakers)]


def conv(i, intent, sentiment, language="en", status="resolved", complexity="medium", said=None):
    return {"conversation_id": f"c{i}", "intent": intent, "sentiment": sentiment, "language": language, "complexity": complexity,
            "resolution_status": status, "turn_count": 4, "turns": turns("customer", "agent", "customer", "agent") if said is None else said}


FIVE = [conv(1, "card_arrival", "positive"), conv(2, "billing_issue", "negative"), conv(3, "account_inquiry", "neutral"),
        conv(4, "technical_support", "negative", status="escalated"), conv(5, "complaint", "neutral", "es")]


def nested(spark, rows):
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "v STRING")
    return lines.select(F.from_json("v", CONVERSATION.simpleString()).alias("r")).select("r.*")


def one(df):
    return df.first().asDict()


def test_five_conversations(spark):
    facts = facts_from_nested(nested(spark, FIVE))
    assert one(to_row([Q.completeness(facts)], ["completeness"]))["completeness"] == 1.0
    language = one(B.language_balance(facts))
    assert language["en"] == 0.8 and abs(language["es"] - 0.2) < 1e-12 and not language["balanced"]
    forty = [{**FIVE[i % 4], "conversation_id": f"x{i}"} for i in range(40)]
    assert B.underrepresented(facts_from_nested(nested(spark, forty))).count() > 70


def test_bad_conversation(spark):
    bad = conv(9, "unknown_intent", "negative", said=turns("agent", "customer"))
    row = one(to_row([Q.consistency(facts_from_nested(nested(spark, [bad])))], ["consistency"]))
    assert abs(row["consistency"] - 4 / 6) < 1e-12
    rules = {r["rule"]: r["severity"] for r in Q.consistency_issues(facts_from_nested(nested(spark, [bad]))).collect()}
    assert rules == {"first_speaker": "issue", "intent": "warning"}


def test_speaker_runs(spark):
    rows = [conv(i, None, None, said=s) for i, s in enumerate([
        turns("customer", "customer", "agent"), turns("customer", "customer", "customer"), turns(None, None, None), [], turns("agent")])]
    runs = [r["longest_run"] for r in facts_from_nested(nested(spark, rows)).orderBy("conversation_id").collect()]
    assert runs == [2, 3, 3, 0, 1]


def test_both_forms_give_the_same_facts(spark):
    rows = nested(spark, FIVE)
    a = corpus_from_nested(rows)
    b = corpus_from_turns(rows.drop("turns"), a.turns)
    names = sorted(a.facts.columns)
    assert sorted(map(str, a.facts.select(names).collect())) == sorted(map(str, b.facts.select(names).collect()))


def test_presence_is_not_truthiness(spark):
    rows = [{"conversation_id": "", "intent": "", "sentiment": None, "resolution_status": "resolved",
             "turns": [{"speaker": "customer", "text": ""}, {"speaker": None, "text": "x"}]}]
    row = one(to_row([Q.completeness(facts_from_nested(nested(spark, rows)))], ["total_checks", "passed_checks"]))
    assert row == {"total_checks": 9.0, "passed_checks": 6.0}


def test_empty_input(spark):
    empty = spark.createDataFrame([], CONVERSATION)
    reference = spark.createDataFrame([("a", "1", "card_arrival")], "text STRING, label STRING, intent STRING")
    corpus = corpus_from_nested(empty)
    row = one(Q.quality(corpus, reference))
    assert row["conversations"] == 0 and row["overall"] == 0 and row["issues"] == 1 and row["warnings"] == 0
    assert all(row[n] == 0 for n in ("completeness", "consistency", "realism", "diversity"))
    assert one(B.sentiment_distribution(corpus.facts)) == {"positive": 0.0, "neutral": 0.0, "negative": 0.0, "imbalance": 1.0}
    assert one(B.language_balance(corpus.facts)) == {"en": 0.0, "es": 0.0, "other": 0.0, "balanced": False}
    assert B.underrepresented(corpus.facts).count() == 0 and B.topic_coverage(corpus.facts).count() == 0
    assert one(B.detect(corpus.facts))["severity"] == "high"
    profile = P.profile(corpus.facts).collect()
    assert [(r["dimension"], r["n"], r["avg_turns"]) for r in profile] == [("all", 0, 0.0)]
    assert one(Q.estimate(corpus.facts)) == {"completeness": 0.0, "consistency": 0.0, "realism": 0.0, "diversity": 0.0}
    assert one(P.compare(P.profile(corpus.facts), P.profile(corpus.facts)))["intent_overlap"] == 0


def test_no_reference_is_half_realistic(spark):
    none = spark.createDataFrame([], "text STRING, label STRING, intent STRING")
    row = one(Q.quality(corpus_from_nested(nested(spark, FIVE)), none))
    # four unknown intents, no reference, the same opening message five times
    assert row["realism"] == 0.5 and row["warnings"] == 6


def python_js(p, q):
    keys, eps = set(p) | set(q), 1e-10
    a, b = {k: p.get(k, eps) for k in keys}, {k: q.get(k, eps) for k in keys}
    a, b = {k: v / sum(a.values()) for k, v in a.items()}, {k: v / sum(b.values()) for k, v in b.items()}
    part = lambda x: sum(x[k] * math.log2(x[k] / ((a[k] + b[k]) / 2)) for k in keys if x[k] > eps)
    return min(1.0, (part(a) + part(b)) / 2)


@pytest.mark.parametrize("p,q", [({"a": .5, "b": .5}, {"a": .5, "b": .5}), ({"a": 1.0}, {"b": 1.0}),
                                 ({"a": .2, "b": .3, "c": .5}, {"a": .7, "d": .3}), ({"a": .9, "b": .1}, {"a": .1, "b": .9})])
def test_js_divergence(spark, p, q):
    frame = lambda d: spark.createDataFrame([(k, round(v * 10)) for k, v in d.items()], "key STRING, n BIGINT")
    forward = js_divergence(frame(p), frame(q)).first()[0]
    assert abs(forward - python_js(p, q)) < 1e-9
    assert abs(forward - js_divergence(frame(q), frame(p)).first()[0]) < 1e-9 and 0 <= forward <= 1


def test_coherence_bands(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]),
                                  ([1.0], None)], "customer_vec ARRAY<DOUBLE>, agent_vec ARRAY<DOUBLE>")
    got = [round(r["coherence"], 4) for r in Q.coherence(rows).collect()]
    assert got == [1.0, 0.3, 1.0, 0.5, 0.5]


def test_severity_and_gate(spark):
    rows = spark.createDataFrame([("none", 80.0, 0.9), ("medium", 70.0, 0.7), ("high", 90.0, 0.9), ("odd", 90.0, 0.9), (None, None, None)],
                                 "severity STRING, overall DOUBLE, accuracy DOUBLE")
    assert [r["production_ready"] for r in B.production_ready(rows).collect()] == [True, True, False, False, False]
    assert [r["bias_ok"] for r in B.production_ready(rows, bias_limit="none").collect()] == [True, False, False, False, True]


def test_summary_bands(spark):
    scores = spark.createDataFrame([("completeness", .95), ("consistency", .73), ("realism", .5), ("other", .8)], "metric STRING, value DOUBLE")
    got = {r["metric"]: r["status"] for r in Q.quality_summary(scores).collect()}
    assert got == {"completeness": "good", "consistency": "warning", "realism": "error", "other": "good", "overall": "warning"}
    assert Q.quality_summary(scores.limit(0)).count() == 0


def test_bias_summary(spark):
    row = spark.sql("SELECT 'low' severity, map('a', 0.6, 'b', 0.4) sentiment_distribution, 0.3 intent_coverage, map('en', 0.9, 'es', 0.1) language_distribution")
    got = one(B.summary(row))
    assert got["findings"] == ["Sentiment distribution is imbalanced", "Low intent coverage: 30.0%", "Language distribution is imbalanced"]


def test_typed_rules(spark):
    rows = [{"conversation_id": "a", "intent": "billing_issue", "sentiment": "neutral", "resolution_status": "resolved", "language": "xx",
             "turns": [{"speaker": "agent", "text": "  short  "}, {"speaker": "bot", "text": "   "}, {"speaker": "customer", "text": "y" * 501}]},
            {"conversation_id": "b", "intent": "complaint", "sentiment": "neutral", "resolution_status": "resolved", "turns": turns("customer", "agent")}]
    df = nested(spark, rows).select("conversation_id", "intent", "sentiment", "turns", "resolution_status", "language")
    found = [(r["id"], r["rule"], r["position"]) for r in R.typed_violations(df).collect()]
    assert sorted(found, key=str) == sorted([
        ("a", "language", None), ("a", "first_speaker", None), ("a", "turn.text_short", 0), ("a", "turn.speaker", 1),
        ("a", "turn.text_missing", 1), ("a", "turn.text_long", 2)], key=str)
    extra = R.typed_violations(df.withColumn("surprise", F.lit(1)))
    assert extra.filter("rule = 'extra_field'").count() == 2
    assert R.clean_text(df).select(F.get("turns", F.lit(0))["text"]).first()[0] == "short"
