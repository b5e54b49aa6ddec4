"""Hard negatives against plain integer arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import negatives

SCHEMA = "vec_id bigint, label bigint, embedding array<double>, id string, anchor int, score double"


def brute(rows, positives=5, most=5, low=80):
    rows = {i: (label, [math.floor(256 * x) for x in v]) for i, label, v in rows}
    out = set()
    for a, (label, v) in rows.items():
        if a % 10:
            continue
        scores = {i: sum(p * q for p, q in zip(v, w)) for i, (_, w) in rows.items() if i != a and len(w) == len(v)}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if rows[i][0] == label][:positives]:
            fit = [i for i in order if rows[i][0] != label and low * scores[p] <= 100 * scores[i] <= 100 * scores[p]]
            out |= {(a, p, k + 1, i, scores[p], scores[i]) for k, i in enumerate(fit[:most])}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA).repartition(3)


def got(df, **options):
    return [tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 10 == 0, **options).collect()]


@pytest.mark.parametrize("block", [4096, 3])
def test_negatives_by_brute_force(spark, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 24))
    x = base[rng.integers(0, 12, 300)] + rng.normal(size=(300, 24)) * 0.15
    x[100:180] = x[100]         # ties: one vector in many rows
    rows = [(int(i) - 40, int(i) % 3 if i > 120 else 1, v.tolist()) for i, v in enumerate(x)]        # one hot label, negative ids
    rows += [(1000 + i, i % 2, v.tolist()[:5]) for i, v in enumerate(x[:20])] + [(2000, 1, []), (2001, 1, []), (2002, 2, [])]
    want = brute(rows)
    assert len(want) > 300 and (2000, 2001, 1, 2002, 0, 0) in want
    found = got(frame(spark, rows), block=block)
    assert len(found) == len(want) and set(found) == want


def test_negatives_edge_cases(spark):
    v = [0.5, -0.25, 1.0]
    rows = [(0, 1, v), (1, 1, v), (2, 2, v), (3, 2, [-x for x in v]), (10, 1, None), (20, None, v), (30, 1, [float("nan")] + v[1:]), (40, 1, [None] + v[1:]),
            (50, 1, [float("inf")] + v[1:]), (None, 1, v), (60, 1, [1e30, 0.0, 0.0]), (1, 3, [9.0] * 3), (0, 1, v)]
    # of both rows 1 that with the smaller label counts
    assert set(got(frame(spark, rows))) == {(0, 1, 1, 2, 86016, 86016)}
    assert got(frame(spark, rows).limit(0)) == []
    assert got(frame(spark, [(1, 1, v), (2, 2, v)])) == []
    assert got(frame(spark, [(0, 1, v), (2, 2, v)])) == []
    # negative positive scores leave no window, zero leaves zero
    assert got(frame(spark, [(0, 1, v), (1, 1, [-x for x in v]), (2, 2, [-x for x in v])])) == []
    assert got(frame(spark, [(0, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 2, [0.0, 2.0])])) == [(0, 1, 1, 2, 0, 0)]


@pytest.mark.parametrize("dimensions,size", [(64, 256), (3, 1 << 30), (5000, 300), (2, 1), (700, 1 << 26)])
def test_residue_products_are_exact(dimensions, size):
    rng = np.random.default_rng(dimensions)
    x, y = (rng.integers(-size, size + 1, (7, dimensions)) for _ in range(2))
    x[0], y[0], y[1] = size, size, -size
    bound = dimensions * size * size
    r = negatives.Residues(dimensions, bound)
    want = [[sum(p * q for p, q in zip(a, b)) for b in y.tolist()] for a in x.tolist()]
    assert r.products(r.of(x), r.of(y)).tolist() == want
    assert math.prod(r.primes) > 2 * bound and all(min(dimensions, r.chunk) * (p // 2) ** 2 < 1 << 24 for p in r.primes)


def test_scores_at_the_end_of_a_long():
    r = negatives.Residues(1, negatives.LARGEST)
    x = np.array([[3037000499], [-3037000499], [0]])
    assert r.products(r.of(x), r.of(x)).tolist() == [[9223372030926249001, -9223372030926249001, 0], [-9223372030926249001, 9223372030926249001, 0], [0, 0, 0]]
