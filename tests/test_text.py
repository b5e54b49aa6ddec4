"""Text and JSON functions against Python's own."""

import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from dialoom.functions import text as X
from dialoom.operators.rules import as_utc
from dialoom.plans.responses import json_in


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r[1] for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def python_json(v):
    try:
        return isinstance(json.loads(v), (dict, list))
    except (ValueError, TypeError):
        return False


CASES = ['{"a":1}', ' {"a":1}\n', '{"a":1} xyz', '{"a":1}{"b":2}', '{"a":1},"y":{"b":2}', "[1]] [[2]", "{'a':1}", '{"a":1,"a":2}',
         '{"a":"é\\u00e9","t":[{"s":1}]}', "nope", '{"a":1,}', "[1,2]", "[1],[2]", "", None, "null", "5", '"s"', "{}", "[]",
         '{"a":{"b":[1,{"c":null}]}}', '{"a":1}}', '{"a" 1}', '[{"a":1}', '{"a":"}"}', '{"a":01}', '{"x":1},', "[1,]", "{,}"]


def test_strict_json_cases(spark):
    got = apply(spark, X.strict_json, CASES)
    assert [g is not None for g in got] == [python_json(c) for c in CASES]


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-10**9, 10**9) | st.text("ab\"{}[]:,\\é \n", max_size=6),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text("xy{}", max_size=3), inner, max_size=3), max_leaves=8)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(json_values, st.sampled_from(["", " x", "}", "]", ",", '{"a":1}', ',"k":1'])), min_size=20, max_size=40))
def test_strict_json_property(spark, values):
    texts = [json.dumps(v, ensure_ascii=False) + tail for v, tail in values]
    assert [g is not None for g in apply(spark, X.strict_json, texts)] == [python_json(t) for t in texts]


def test_fence(spark):
    texts = ['```json\n{"a":1}\n```', "```\n[1]\n``` tail", "plain", "```json unclosed", "a ``` b", "```json``` x"]
    assert apply(spark, X.fenced, texts) == ['{"a":1}', "[1]", "plain", "```json unclosed", "a ``` b", "```json``` x"]


def test_json_in_text_attempts(spark):
    texts = ['{"a":1}', 'x ```json\n{"a":1}\n``` y', "x ```\n[1, 2]\n``` y", 'so {"a":[1]} then', "so [1, 2] then", "no json", "} {", "{ ] ["]
    assert apply(spark, json_in, texts) == ['{"a":1}', '{"a":1}', "[1, 2]", '{"a":[1]}', "[1, 2]", None, None, None]


def test_words_and_normalised(spark):
    texts = ["¡Hola! ¿Qué tal, AMIGO_1?", "it's 5²", "", None]
    assert apply(spark, X.words, texts) == [["hola", "qué", "tal", "amigo_1"], ["it", "s", "5²"], [], []]
    assert apply(spark, X.normalised, ["  ¡Hola, Qué!  ", "a-b c."]) == ["hola qué", "ab c"]


def test_strip_all_white_space(spark):
    texts = [" \t a b 　\n", "\x1f\x85x ", "", " " * 5000]
    assert apply(spark, X.strip, texts) == [t.strip() for t in texts]
    assert len(X.WHITESPACE) == len(set(X.WHITESPACE)) == 29 and not X.WHITESPACE.strip()


def test_fold_accents(spark):
    assert apply(spark, X.fold_accents, ["Qué çedilla ñ", "plain", None]) == ["Que cedilla n", "plain", None]


def test_naive_times_are_utc(spark):
    texts = ["2024-01-01T00:00:00", "2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00.5", "no"]
    got = apply(spark, lambda c: F.unix_millis(as_utc(c)), texts)
    assert got == [1704067200000, 1704067200000, 1704067200000, 1704067200500, None]


def test_folding_gets_small_batches(spark):
    """Long texts reach Python a few megabytes at a time, and folding is the same as by single characters."""
    import unicodedata

    odd = "Å\u0301ﬁ² é\u0327ñ 각 \U0001d15e İß 漢字 " + "".join(map(chr, range(0x300, 0x370)))
    assert apply(spark, X.fold_accents, [odd]) == ["".join(ch for ch in unicodedata.normalize("NFKD", odd) if not unicodedata.combining(ch))]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    X.fold_accents(F.lit("x"))
    sizes = spark.range(40, numPartitions=1).select(F.repeat(F.lit("é"), 1 << 19).alias("t")).mapInPandas(lambda it: (p.assign(t=str(len(p))) for p in it), "t string").distinct().collect()
    assert max(int(r[0]) for r in sizes) <= 5
