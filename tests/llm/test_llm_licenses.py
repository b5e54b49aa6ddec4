"""License scans: what the bands retrieve, long templates, template tables."""

import random

import pytest
from pyspark.sql import functions as F

from dialoom.llm import licenses

SCHEMA = "doc_id bigint, text string, s int, hits string, name string, _id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "h", "n", 2) for i, t in rows], SCHEMA)


def grams(text):
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)}


def test_texts_with_changed_words(spark):
    """Whole license texts in longer documents, with up to a sixteenth of the words replaced, inserted or left out: as by exact containment."""
    rng = random.Random(4)
    texts = {n: t for n, t in licenses.NOTICES.items() if n.endswith("text")}
    rows = []
    for i in range(600):
        w = texts[rng.choice(sorted(texts))].split()
        for _ in range(rng.randrange(len(w) // 16 + 1)):
            k = rng.randrange(len(w))
            w[k:k + 1] = rng.choice([[f"q{rng.randrange(99)}"], [], [w[k], "extra"]])
        fill = [f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(60))]
        rows.append((i, " ".join(fill + w + fill[::-1])))
    sets = {n: grams(t) for n, t in licenses.NOTICES.items()}
    want = {(i, n, len(s), len(s & grams(t))) for i, t in rows for n, s in sets.items() if len(s & grams(t)) >= 0.75 * len(s)}
    got = {tuple(r) for r in licenses.license_notices(frame(spark, rows)).collect()}
    assert got == want and len(want) > 800


def test_bands_keep_their_probability(spark):
    """Windows with two of three shingles in common share about half of the bands, and none in about one of a thousand cases."""
    rows = spark.range(8000).select(F.array(*[F.xxhash64("id", F.lit(k)) for k in range(3)]).alias("a"), F.array(*[F.xxhash64("id", F.lit(k)) for k in range(1, 4)]).alias("b"))
    keys = lambda c: F.transform(F.sequence(F.lit(1), F.lit(licenses.BANDS)), lambda b: F.array_min(F.transform(c, lambda x: F.xxhash64(x, b))))
    shared = rows.select(F.size(F.array_intersect(keys("a"), keys("b"))).alias("n")).agg(F.avg("n"), F.min("n"), F.avg((F.col("n") == 0).cast("int"))).first()
    assert abs(shared[0] - 5) < 0.15 and shared[2] < 0.0025
    # the minima of sliding windows are those of the windows by themselves
    long = spark.range(50).select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.xxhash64(F.lit(7), k)).alias("s"))
    for n in (1, 2, 3):
        got = long.select(licenses.minima(F.col("s"), n, F.lit(3)).alias("m"), F.transform("s", lambda x: F.xxhash64(x, F.lit(3))).alias("h")).first()
        assert list(got.m) == [min(got.h[i:i + n]) for i in range(10)]


def test_template_table(spark):
    table = spark.createDataFrame([("a", "one two three four five", 1), ("b", " ".join(f"w{i}" for i in range(3000)), 2)], "name string, text string, hits int")
    rows = [(1, "zero one two three four five six"), (None, " ".join(f"w{i}" for i in range(2900))), (3, " ".join(f"w{i}" for i in range(2000))), (4, None), (5, ""),
            (6, "one two"), (None, "One, Two; THREE four five"), (7, "x " * 500_000 + "one two three four five")]
    got = sorted(map(tuple, licenses.license_notices(frame(spark, rows), table).collect()), key=repr)
    assert got == sorted([(1, "a", 3, 3), (None, "b", 2998, 2898), (None, "a", 3, 3), (7, "a", 3, 3)], key=repr)
    assert licenses.license_notices(frame(spark, rows), table.limit(0)).count() == 0 and licenses.license_notices(frame(spark, []), table).count() == 0
    with pytest.raises(ValueError):
        licenses.license_notices(frame(spark, rows), spark.range(400).selectExpr("concat('n', id) AS name", "array_join(transform(sequence(0, 90), i -> concat(id, 'x', i)), ' ') AS text"))
