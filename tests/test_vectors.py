"""Text vectors against plain Python."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from dialoom.functions.vectors import DIMENSIONS, projected
from dialoom.operators.quality import cosine, text_coherence

TEXTS = {1: ("my card is lost", "your card will be blocked"), 2: ("My CARD is lost!", "no"), 3: (None, "x"), 4: ("", "... !"), 5: ("señor é " * 40, "señor é")}


def terms(text):
    w = re.findall(r"\w+", text.lower())
    return w + [" ".join(w[i:i + 2]) for i in range(len(w) - 1)]


def bucket(term):
    return int(hashlib.md5(term.encode()).hexdigest()[:4], 16)


def plain(seed):
    texts = [t for pair in TEXTS.values() for t in pair if t is not None]
    held = [set(map(bucket, terms(t))) for t in texts]

    def vector(text):
        if text is None:
            return None
        out = [0.0] * DIMENSIONS
        for t in terms(text):
            b = bucket(t)
            idf = math.log((1 + len(texts)) / (1 + sum(b in h for h in held))) + 1
            bits = int(hashlib.md5(f"{seed}:{b}".encode()).hexdigest(), 16)
            for i in range(DIMENSIONS):
                out[i] += idf if bits >> (127 - i) & 1 else -idf
        return [x / math.sqrt(DIMENSIONS) for x in out]

    return {k: tuple(map(vector, pair)) for k, pair in TEXTS.items()}


def test_vectors_equal_plain_python(spark):
    df = spark.createDataFrame([(k, *p) for k, p in TEXTS.items()], "id int, a string, b string").repartition(3)
    got = {r.id: (r.x, r.y) for r in projected(df, "id", {"x": "a", "y": "b"}, seed=5).collect()}
    for k, want in plain(5).items():
        for have, vector in zip(got[k], want):
            assert have is None if vector is None else have == pytest.approx(vector, abs=1e-9)


def test_coherence_of_messages(spark):
    rows = [(str(k), i, who, t) for k, pair in TEXTS.items() for i, (who, t) in enumerate(zip(("customer", "agent"), pair)) if t is not None]
    rows += [("1", 2, "customer", "later words"), ("6", 0, "customer", "alone")]
    turns = spark.createDataFrame(rows, "conversation_id string, turn_idx int, speaker string, text string")
    got = {r.conversation_id: r for r in text_coherence(turns).withColumn("s", cosine(F.col("customer_vec"), F.col("agent_vec"))).collect()}
    assert len(got) == 6 and got["3"].coherence == got["4"].coherence == got["6"].coherence == 0.5        # nothing to compare
    assert got["5"].s > 0.5 and all(0.3 <= r.coherence <= 1 for r in got.values())
