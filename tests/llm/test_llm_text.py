"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and other columns."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from dialoom.llm import bpe, decontaminate, langid, licenses, lines, minhash, quality, shards, substrings
from dialoom.llm.common import bit_filter, window_hashes, word_hashes

WORDS = [f"w{i}" for i in range(40)]


def corpus(seed=1, n=60):
    """Documents with exact and near copies, shared lines, nulls, empty texts and one very long text."""
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(3, 60))) for _ in range(n // 3)]
    texts = list(base)
    for _ in range(n - len(base)):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["X", "Ünd", "é"])
        texts.append(rng.choice([" ", "\n", "\t"]).join(words))
    texts += [None, "", " \n\t", "one", "One", "one two three four", "same line\nother", "Same Line \n", "\x0bsame line", " ".join(rng.choices(WORDS, k=20_000))]
    return [(i, t, "en" if i % 3 else None, i, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def frame(spark, rows):
    """Columns beside id and text have names that the operators use inside."""
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, id bigint, th string").repartition(3)


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_window_hashes_tell_windows_apart():
    words = [bytes([97 + x]) for x in np.random.default_rng(0).integers(0, 3, 300)]
    for k in (1, 2, 5, 7, 50):
        got = window_hashes(word_hashes(words), k).tolist()
        want = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]
        assert len(got) == len(want) and len(set(zip(got, want))) == len(set(want)) == len(set(got))
    assert len(window_hashes(word_hashes(words[:3]), 4)) == 0


def test_bit_filter_loses_nothing(spark):
    keys = spark.range(1000).selectExpr("xxhash64(id) AS k")
    inside = np.array([r[0] for r in keys.collect()]).view(np.uint64)
    found = bit_filter(keys, "k", log_bits=16)
    assert found.mask(inside).all() and found.mask(inside + np.uint64(1)).mean() < 0.1


def test_super_minhash_estimates_jaccard():
    rng = np.random.default_rng(3)
    size, errors = 128, []
    for _ in range(60):
        x = rng.integers(0, 2 ** 63, 90).astype(np.uint64)
        a, b = np.sort(x[:60]), np.sort(x[30:])
        sig = minhash.super_minhash(np.concatenate([a, b]), np.array([0, 60, 120]), size)
        errors.append((sig[0] == sig[1]).mean() - 30 / 90)
        assert np.isfinite(sig).all() and sorted(np.floor(sig[0]).astype(int))[0] >= 0
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (2 / 9 / size) ** 0.5     # less variance than independent hashes
    assert np.isinf(minhash.super_minhash(np.empty(0, np.uint64), np.array([0, 0]), 8)).all()
    one = minhash.super_minhash(np.array([5], np.uint64), np.array([0, 1]), 16)[0]
    assert sorted(np.floor(one).astype(int)) == list(range(16))          # a permutation


def test_near_duplicates_by_brute_force(docs, rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    assert len(links) > 20


def test_near_duplicates_in_one_bucket(spark):
    """Many variants of one text, hardly linked with each other, and many documents that share a long line only."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    line = " ".join(f"l{i}" for i in range(30))
    rows = [(0, " ".join(base), None, 0, "")]
    for i in range(1, 120):
        words = list(base)
        for _ in range(rng.choice([1, 2, 4, 8])):
            words[rng.randrange(60)] = f"n{rng.random()}"
        rows.append((i, " ".join(words), None, 0, ""))
    rows += [(i, line + " " + " ".join(rng.choices(WORDS, k=rng.choice([5, 40]))), None, 0, "") for i in range(120, 240)]
    sets = {r[0]: shingles(r[1]) for r in rows}
    want = components(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == want and len(set(want.values())) > 20


def test_pairs_come_out_in_the_first_band_of_whole_keys():
    """An earlier band that two signatures share in their cut form only has no bucket with both: it must not take the pair."""
    sig = np.arange(8, dtype=np.uint16).tobytes()
    low = np.arange(10, dtype=np.uint32).tobytes()
    keys = [np.array([k, 7, 7, 7], np.uint64).tobytes() for k in (1, 2)]
    out = []
    for number in (1, 2):
        rows = [(number, 0, 0, role, cid, 10, cid, 1, sig, number, low, keys[cid - 1]) for role, cid in ((0, 1), (0, 2), (1, 2))]
        kinds = [pa.int64()] * 8 + [pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f"c{i}" for i in range(12)])
        out.append([p for b in minhash._cross(75, 4, 2)(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns))])
    assert out == [[(1, 2)], []]


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f", None, 0, ""), (1, "a b c d e f", None, 0, ""), (None, "A B C D E F", None, 0, ""), (None, "x y", None, 0, ""), (None, None, None, 0, "")]
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == {(1, 1, True): 2, (None, 1, False): 1, (None, None, True): 2}


def test_super_minhash_of_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def line_brute(rows, min_docs, keep_first=False):
    key = lambda x: x.encode().strip(lines.SPACE).lower()
    found = collections.Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")})
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        kept = []
        for x in (t or "").split("\n"):
            k = key(x)
            if not k or found[k] < min_docs or keep_first and k not in seen:
                kept.append(x)
            seen.add(k)
        out[i] = ((t or "").count("\n") + 1, kept)
    return out


@pytest.mark.parametrize("min_docs,keep_first", [(2, False), (3, False), (2, True), (3, True)])
def test_lines_by_brute_force(spark, min_docs, keep_first):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choices(["a", " A", "b\t", "", "c", f"u{i}", "É", "é", "d"], k=rng.randint(1, 12))), None, 0, "") for i in range(50)]
    rows += [(50, None, None, 0, ""), (51, "", None, 0, ""), (52, "\n" * 5 + "a\x0b\na", None, 0, "")]
    want = line_brute(rows, min_docs, keep_first)
    options = {"min_docs": min_docs, "keep_first": keep_first}
    got = {r.doc_id: r for r in lines.line_digests(frame(spark, rows), **options).collect()}
    assert {i: (r.n_lines, r.n_dropped, r.kept_sha256) for i, r in got.items()} == {
        i: (n, n - len(k), hashlib.sha256("\n".join(k).encode()).hexdigest()) for i, (n, k) in want.items()}
    texts = {r.doc_id: r.text for r in lines.without_repeated_lines(frame(spark, rows), **options).collect()}
    assert texts == {i: None if t is None else "\n".join(want[i][1]) for i, t, *_ in rows}


def test_lines_of_hot_key_over_many_partitions(spark):
    """A third of all rows is one line: it spreads over the range partitions and is dropped everywhere."""
    rows = [(i, f"hot\nown {i}" if i % 3 else f"own {i}", None, 0, "") for i in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(900)], "h bigint, id bigint").repartitionByRange(8, "h", "id")
        assert len({r[1] for r in ranged.selectExpr("h", "spark_partition_id() AS p").filter("h = 1").distinct().collect()}) > 2
        got = lines.line_digests(frame(spark, rows), min_docs=10).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n_dropped for r in got) == 400
    assert lines.line_digests(frame(spark, [])).count() == 0


def test_lines_with_repeated_ids(spark):
    rows = [(1, "a\nb", None, 0, ""), (1, "a\nb", None, 0, ""), (1, "a\nc\nd", None, 0, ""), (None, "c", None, 0, "")]
    got = sorted(str((r.doc_id, r.text)) for r in lines.without_repeated_lines(frame(spark, rows), min_docs=2).collect())
    assert got == sorted(map(str, [(1, ""), (1, ""), (1, "d"), (None, "")]))


@pytest.mark.parametrize("size", [1, 3, 10])
def test_substrings_by_brute_force(docs, rows, size):
    first = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j:j + size]), i)
    want = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - size + 1):
            if first[tuple(w[j:j + size])] < i:
                gone.update(range(j, j + size))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(docs, size=size, digest=True).collect()}
    assert got == want
    # a full sketch only lets more through
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(docs, size=size, digest=True, most_log_cells=12).collect()}
    assert got == want


def test_substrings_of_repeated_and_null_ids(spark):
    text = " ".join(WORDS[:12])
    rows = [(2, text, None, 0, ""), (2, text, None, 0, ""), (5, "x " + text, None, 0, ""), (None, text, None, 0, ""), (7, None, None, 0, "")]
    got = sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in substrings.without_repeats(frame(spark, rows), size=10).collect())
    assert got == sorted(map(str, [(2, 12, 0, text), (2, 12, 0, text), (5, 13, 12, "x"), (None, 12, 0, text), (7, 0, 0, None)]))
    assert substrings.without_repeats(frame(spark, [])).count() == 0


def tiles_by_hand(doc, item, size):
    """Greedy string tiling as written down: the longest unmarked common run, again and again."""
    a, b, marked = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not b[i + n] and not a[d + n]:
                    n += 1
                best = max(best, (n, -i, -d))
        n, i, d = best
        if n < size:
            return marked
        for k in range(n):
            b[-i + k] = a[-d + k] = True
        marked += n


def test_tiling_by_hand():
    rng = random.Random(4)
    for _ in range(300):
        item = rng.choices("abc", k=rng.randint(3, 14))
        doc = rng.choices("abcd", k=rng.randint(0, 10)) + item[5:] + rng.choices("abcd", k=2) + item[:6] + rng.choices("abc", k=rng.randint(0, 8))
        size = 3
        hits = [(d, i) for d in range(len(doc) - size + 1) for i in range(len(item) - size + 1) if doc[d:d + size] == item[i:i + size]]
        got = decontaminate.tiled(decontaminate.common_runs(hits, size, len(item)), size)
        assert abs(got - tiles_by_hand(doc, item, size)) <= 2       # equally long runs may be taken in another order
    long = list("ab" * 3000)
    hits = ((d, i) for d in range(len(long) - 2) for i in range(4) if (d - i) % 2 == 0)
    assert decontaminate.tiled(decontaminate.common_runs(hits, 3, 6), 3) == 6


def test_decontamination(spark):
    item = [f"q{i}" for i in range(30)]
    noise = " ".join(WORDS)
    rows = [(1, f"{noise} {' '.join(item)} {noise}", None, 0, ""),                                     # whole
            (2, f"{' '.join(item[15:])}\n{noise} {' '.join(item[:15])}", None, 0, ""),                 # reordered
            (3, f"{noise} {' '.join(item[:9])}", None, 0, ""),                                         # a short quote
            (4, "; ".join(w.upper() + "!!" for w in item), None, 0, ""),                               # case and punctuation
            (5, None, None, 0, ""), (6, "", None, 0, ""), (7, noise, None, 0, ""), (8, "Short Item", None, 0, ""),
            (1, f"{noise} {' '.join(item)} {noise}", None, 0, ""), (None, " ".join(item), None, 0, "")]
    items = spark.createDataFrame([(10, " ".join(item), 1), (11, None, 2), (12, " . ", 3), (13, "short item!", 4)], "item_id int, text string, id int")
    found = decontaminate.matches(frame(spark, rows), items)
    got = sorted((str(r.id), r.item, round(r.coverage, 2)) for r in found.collect())
    assert got == [("1", 10, 1.0), ("2", 10, 1.0), ("4", 10, 1.0), ("8", 13, 1.0), ("None", 10, 1.0)]
    left = decontaminate.without_matches(frame(spark, rows), found)
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 6, 7] and left.columns == frame(spark, rows).columns
    assert decontaminate.matches(frame(spark, rows), items.limit(0)).count() == 0
    assert decontaminate.matches(frame(spark, []), items).count() == 0


def test_licenses(spark):
    rows = [(1, "foo bar. Licensed under the Apache License, Version 2.0. baz", None, 0, ""), (2, "released UNDER the mit license", None, 0, ""),
            (3, "This work is licensed under the GNU General Public License, version 3. " * 3, None, 0, ""), (4, None, None, 0, ""), (5, "", None, 0, ""),
            (6, "under the license of the public", None, 0, ""), (7, " ".join(WORDS * 500) + " Licensed under CC BY-NC 4.0.", None, 0, ""),
            (2, "released UNDER the mit license", None, 0, "")]
    got = sorted((r.doc_id, r.license) for r in licenses.license_notices(frame(spark, rows)).collect())
    assert got == [(1, "Apache-2.0"), (2, "MIT"), (2, "MIT"), (3, "GPL"), (7, "CC BY-NC")]
    assert licenses.license_notices(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        licenses.license_notices(frame(spark, rows), {"x": "two words"})
    plan = licenses.license_notices(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


def test_licenses_at_any_place(spark):
    """Short notices at thousands of places in longer texts, and some whose shingles stand apart: none may be missed."""
    rng = random.Random(11)
    notices = {f"n{i}": " ".join(f"t{i}x{j}" for j in range(5 + 2 * (i % 2))) for i in range(100)}
    rows, want = [], set()
    for i in range(12_000):
        fill = lambda: " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randint(8, 20)))
        w = notices[f"n{i % 100}"].split()
        # whole, or without the first of seven words: four of five shingles
        notice = [w, w[-6:] if len(w) == 7 else w, w[:3] + ["y"] + w[1:4] + ["y"] + w[2:]][i // 100 % 3]
        rows.append((i, " ".join([fill(), *notice, fill()]), None, 0, ""))
        want.add((i, f"n{i % 100}"))
    got = {(r.doc_id, r.license) for r in licenses.license_notices(frame(spark, rows), notices).collect()}
    assert got == want


def test_language(spark):
    rng = random.Random(0)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["straße", "über", "gehen", "nicht"], "cc": ["était", "leçon", "mère", "où"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=20)), lang, 0, "") for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(200, None, "aa", 0, ""), (201, "12 34 !!", "bb", 0, ""), (202, "", None, 0, ""), (203, "STRASSE ÜBER nicht gehen", None, 0, ""), (204, "жжж", None, 0, "")]
    docs = frame(spark, rows)
    model = langid.learn(docs.filter("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.9 for i, _, lang, *_ in rows[:120])
    assert [got[i].lang_pred for i in (200, 201, 202, 203)] == ["und", "und", "und", "bb"] and got[204].lang_pred in words and got[204].score == 0
    left = langid.with_language(docs, model, 0.3)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [*range(120), 203]
    nothing = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_language_sample_of_copies_and_rare_languages(spark):
    """Neither a text with most of the rows nor a language with most of them keeps what others have from being learned."""
    rng = random.Random(2)
    aa, bb = [["".join(rng.choices(letters, k=6)) for _ in range(30)] for letters in ("abcdefgh", "стуфхцчш")]
    some = lambda words: " ".join(rng.choices(words, k=12))
    rows = [(i, some(aa), "aa", 0, "") for i in range(30)] + [(100 + i, "zz yy xx ww vv", "aa", 0, "") for i in range(3000)]
    names, score = langid.learn(frame(spark, rows)).predict([some(aa).encode() for _ in range(20)])
    assert names == ["aa"] * 20 and score.min() > 0.8
    rows = [(i, some(aa), "aa", 0, "") for i in range(4000)] + [(5000 + i, some(bb), "bb", 0, "") for i in range(30)]
    model = langid.learn(frame(spark, rows), max_docs=100)
    names, score = model.predict([some(w).encode() for w in (aa, bb) for _ in range(20)])
    assert names == ["aa"] * 20 + ["bb"] * 20 and score.min() > 0.8 and model.usual == "aa"
    assert [langid._level(c, 100) for c in ([40, 50], [10, 500, 60], [])] == [float("inf"), 45, float("inf")]


def test_language_filter_corrects_chance():
    texts = [b"some words of one language"] * 3
    keys, *_ = langid.grams(texts)
    table = np.full((1 << langid.LOG_SLOTS, 1), np.uint64(2))        # language 1 has every bit set: all its hits are chance
    table[langid._slots(keys, 0), 0] |= np.uint64(1)
    table[langid._slots(keys, 1), 0] |= np.uint64(1)
    names, score = langid.LanguageFilter(table, ["a", "b"], "b").predict(texts)
    assert names == ["a"] * 3 and (score > 0.99).all()


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choices(WORDS, k=30)) + ". Done\nnext line"
    bad = [lambda: " ".join(w + "$$$" for w in rng.choices(WORDS, k=30)), lambda: "word " * 40, lambda: " ".join(rng.choices(WORDS, k=20)).upper() + "!!!"]
    rows = [(i, good() if i % 4 else rng.choice(bad)(), None, 0, "") for i in range(400)]
    rows += [(400, None, None, 0, ""), (401, "", None, 0, ""), (None, good(), None, 0, "")]
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(400)] + [(1, 1, 0), (9, None, 0), (None, 1, 0), (999, 0, 1)],
                                   "doc_id bigint, quality int, score int")
    docs = frame(spark, rows)
    from pyspark.sql import functions as F
    got = quality.quality_scores(docs, labels, held_out=F.col("id") % 5 == 0).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    right = [r.predicted == (1 if r.doc_id % 4 else 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(right) == 80 and np.mean(right) > 0.95
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_shards(spark):
    rows = [(i % 700 if i % 3 else None, f"é{i % 50}" if i % 7 else None, None, 0, "") for i in range(1000)]
    docs = frame(spark, rows)
    got = shards.shard(docs, 16).collect()
    again = shards.shard(docs.repartition(7), 16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(len(x) for x in by.values()) == [62] * 8 + [63] * 8 and all(sorted(x) == list(range(len(x))) for x in by.values())
    import zlib
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert shards.shard(docs.limit(0), 16).count() == 0
    for n in (1, 2, 3, 16, 17, 1000, 4097):
        places = shards.permute(np.arange(n, dtype=np.uint64), n, 3)
        assert sorted(places) == list(range(n)) and (shards.unpermute(places, n, 3) == np.arange(n)).all()
    assert shards.shard(frame(spark, [(5, "x", None, 0, "")] * 40), 4).select("shard", "slot").distinct().count() == 40


def test_bpe_against_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|endof", "a", "é", "  ", "\n", "\x1c", "\x85", " ", "'s", "'ll", "'", "12", "½", "中", "😀", "‍", "the", " There", "x" * 90, "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 15))) for _ in range(400)] + ["", "ab" * 20_000, " " * 500]
    rows = [(i, t, None, 0, "") for i, t in enumerate(texts)] + [(None, None, None, 0, ""), (3, texts[3], None, 0, "")]
    got = bpe.encode(frame(spark, rows), path).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "" if r.doc_id is None else texts[r.doc_id]
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False) == text
    digests = {r.doc_id: r for r in bpe.token_digests(frame(spark, rows), path).collect()}
    ids = library.encode(texts[0], add_special_tokens=False).ids
    assert digests[0].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and digests[0].n_tokens == len(ids)
    assert digests[None].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    model = bpe.Bpe(open(path, encoding="utf-8").read())
    assert model.decode(np.array([model.single[0xC3]], "<u4").tobytes()) == "�"
    assert bpe.encode(frame(spark, []), path).count() == 0
