"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from dialoom.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form, n, len(others), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return {w: tuple(v) for w, v in out.items()}


def test_scan_finds_all_words_one_edit_away():
    rng = random.Random(1)
    for alphabet, length in (("ab", 7), ("abc", 6), ("aé", 12)):
        words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, length))) for _ in range(300)})
        lcp = [0] + [spelling.shared(a, b) for a, b in zip(words, words[1:])]
        for w in words:
            assert [words[i] for i in spelling.near_in(w, words, lcp, 0, len(words), 0)] == [v for v in words if near(w, v)]


def texts():
    rng = random.Random(2)
    words = ["aaaaaa" + "".join(rng.choice("ab") for _ in range(rng.randrange(8))) for _ in range(150)]         # one hot beginning
    words += ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 9))) for _ in range(250)] + ["Zürich", "Zurich", "zurichh", "zuriçh", "x" * 5000, "x" * 4999]
    return [" ".join(rng.choice(words[:int(400 * rng.random() ** 3) + 6] + words[-6:]) for _ in range(rng.randrange(60))) + "×÷ 12" for _ in range(400)]


def counted(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += len(run) >= 6
    return {w: n for w, n in total.items() if n >= 5}


@pytest.mark.parametrize("block", [4096, 6])
def test_variants_by_brute_force(spark, block):
    rows = [(i % 300, t) for i, t in enumerate(texts())] + [(None, "zürich zürich zurich"), (7, None), (8, ""), (9, "zurich " * 300 + "vocable " * 200 + "vocables " * 30 + "vocabless " * 5)]
    df = spark.createDataFrame([(*r, "w", 3, "f") for r in rows], "doc_id bigint, text string, word string, n int, form string").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df, block=block).collect()}
    want = brute(counted(rows))
    assert got == want
    assert len(want) > 150 and sum(v[0] is not None for v in want.values()) > 20 and want["vocabless"][:2] == ("vocables", "vocable")


def test_no_words(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short one")], "doc_id bigint, text string")
    assert spelling.spelling_variants(df).count() == 0 and spelling.spelling_variants(df.limit(0)).count() == 0
    df = spark.createDataFrame([(1, "abcdefg " * 9)], "doc_id bigint, text string")
    assert [tuple(r) for r in spelling.spelling_variants(df, drop_one_in=0).collect()] == [("abcdefg", None, "abcdefg", 9, 0, None)]
