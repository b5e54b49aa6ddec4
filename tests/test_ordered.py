"""Order-dependent helpers against brute force, hot keys and copies included."""

import random

from pyspark.sql import functions as F

from dialoom.functions.ordered import crossing_ngrams, inner_ngrams, longest_runs
from dialoom.operators.quality import ngram_counts
from dialoom.training.data import ranked


def brute_runs(rows, only=None):
    out = {}
    for key in {r[0] for r in rows}:
        best = run = 0
        last = object()
        for _, _, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            run = run + 1 if v == last else 1
            last = v
            if only is None or v == only:
                best = max(best, run)
        out[key] = best
    return out


def run_rows(seed, n=3000):
    rng = random.Random(seed)
    rows, at = [], {}
    for _ in range(n):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}"
        at[key] = at.get(key, 0) + 1
        rows.append((key, at[key], rng.choice(["a", "a", "a", "b", None])))
    rng.shuffle(rows)
    return rows


def test_longest_runs(spark):
    for seed, partitions in ((1, 1), (2, 7), (3, 64)):
        rows = run_rows(seed)
        df = spark.createDataFrame(rows, "k STRING, t BIGINT, v STRING").repartition(5)
        for only in (None, "a", "b", "missing"):
            got = longest_runs(df, F.col("k"), F.col("t"), F.col("v"), only, partitions)
            assert {r["key"]: r["longest"] for r in got.collect()} == brute_runs(rows, only)


def test_copies_of_one_row(spark):
    """A third of all rows are copies of one turn: they still form one run, over several partitions."""
    rows = [("x", 5, "agent")] * 500 + [("x", i, "customer") for i in range(5)] + [(f"y{i}", 0, "customer") for i in range(900)]
    df = spark.createDataFrame(rows, "k STRING, t BIGINT, v STRING")
    got = {r["key"]: r["longest"] for r in longest_runs(df, F.col("k"), F.col("t"), F.col("v"), partitions=16).collect()}
    assert got["x"] == 500 and got["y3"] == 1 and len(got) == 901


def grams(turns, n):
    words = [w for _, _, ws in sorted(turns, key=lambda t: (t[0], t[1])) for w in ws]
    return [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]


def random_turns(seed, n):
    rng = random.Random(seed)
    hot = 0
    turns = []
    for i in range(n):
        if rng.random() < 0.4:
            conv, t, hot = "c5", hot, hot + 1
        else:
            conv, t = f"d{i:04d}", 0
        turns.append((conv, t, [rng.choice("abcd") for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 5, 9]))]))
    return turns


def test_ngrams_over_turn_borders(spark):
    for seed, n, partitions in ((1, 1, 3), (2, 30, 50), (3, 400, 1), (4, 400, 13), (5, 3, 8)):
        turns = random_turns(seed, n)
        df = spark.createDataFrame(turns, "conversation_id STRING, turn_idx BIGINT, w ARRAY<STRING>")
        crossing = crossing_ngrams(df, ["conversation_id", "turn_idx"], "w", (2, 3), partitions)
        inside = df.select(F.inline(F.concat(*[F.transform(inner_ngrams(F.col("w"), k), lambda g: F.struct(
            F.lit(0).alias("n"), g.alias("gram"), F.lit(1).cast("bigint").alias("count"))) for k in (2, 3)])))
        found = inside.unionByName(crossing).groupBy("gram").agg(F.sum("count").alias("c")).collect()
        want = {}
        for k in (2, 3):
            for g in grams(turns, k):
                want[g] = want.get(g, 0) + 1
        assert {r["gram"]: r["c"] for r in found} == want


def test_ngram_counts_by_hand(spark):
    turns = spark.createDataFrame([("a", 0, "customer", "one two"), ("a", 1, "agent", "no no"), ("a", 2, "customer", "three"),
                                   ("b", 0, "customer", "one two")], "conversation_id STRING, turn_idx BIGINT, speaker STRING, text STRING")
    got = {r["n"]: (r["total"], r["distinct"]) for r in ngram_counts(turns).collect()}
    assert got == {2: (4, 3), 3: (3, 3)}


def test_rank_equals_row_number(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", f"id{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "g STRING, conversation_id STRING")
    out = ranked(df, "g", "conversation_id").collect()
    for g in {r["g"] for r in out}:
        ranks = sorted(r["rank"] for r in out if r["g"] == g)
        assert ranks == list(range(1, len(ranks) + 1))
    again = {r["conversation_id"]: r["rank"] for r in ranked(df.repartition(9), "g", "conversation_id").collect()}
    assert again == {r["conversation_id"]: r["rank"] for r in out}
