"""Pipeline stages on awkward tables, and tiling against a plain search."""

import datetime
import random
from collections import Counter

import pytest

import corpus_pipeline
from dialoom.llm import decontaminate, quality

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, _th bigint, _keep int, id int, th string, k double, "
          "keep date, row map<string,int>, Text_ array<string>")


def tiling(item, document, size):
    """Greedy string tiling as it is written down: the longest unmarked match, the first in the item, then in the document."""
    used_i, used_d = set(), set()
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(document)):
                n = 0
                while i + n < len(item) and d + n < len(document) and item[i + n] == document[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                if n >= size and (best is None or n > best[0]):
                    best = (n, i, d)
        if best is None:
            return len(used_i)
        n, i, d = best
        used_i.update(range(i, i + n))
        used_d.update(range(d, d + n))


def marked(item, document, size):
    hits = [(d, i) for d in range(len(document) - size + 1) for i in range(len(item) - size + 1) if document[d:d + size] == item[i:i + size]]
    return decontaminate.tiled(decontaminate.common_runs(hits, size, len(item)), size)


def test_tiling_of_the_overlapping_copy():
    assert marked("pqrsabzyabcab", "pqrsabcabcab", 5) == tiling("pqrsabzyabcab", "pqrsabcabcab", 5) == 11
    assert marked("pqrsabzyabcab", "pqrsabcabcabc", 5) == tiling("pqrsabzyabcab", "pqrsabcabcabc", 5)
    assert marked("pqrsabcab" + "abcab", "pqrsabcabcab", 5) == tiling("pqrsabcab" + "abcab", "pqrsabcabcab", 5)


@pytest.mark.parametrize("seed", range(4))
def test_tiling_of_periodic_and_reordered_items(seed):
    rng = random.Random(seed)
    for _ in range(400):
        period = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
        parts = [period * rng.randrange(1, 6), "".join(rng.choice("abcxyz") for _ in range(rng.randrange(1, 9))), period * rng.randrange(1, 4), "pqrs"]
        rng.shuffle(parts)
        item = "".join(parts)[:40]
        cuts = sorted(rng.randrange(len(item) + 1) for _ in range(3))
        pieces = [item[a:b] for a, b in zip([0, *cuts], [*cuts, len(item)])]
        rng.shuffle(pieces)
        document = "".join(p + rng.choice(["", "-", period, period * 3]) for p in pieces)[:70]
        for size in (3, 5):
            assert marked(item, document, size) == tiling(item, document, size), (item, document, size)


def words_of(text):
    return tuple("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())


def covered(document, items, size=5):
    """Whether tiling covers half of an item."""
    runs = {document[i:i + size] for i in range(len(document) - size + 1)}
    for item in items:
        n = min(size, len(item))
        if n == size and runs & {item[i:i + size] for i in range(len(item) - size + 1)} or n < size and item and item in {document[i:i + n] for i in range(len(document) - n + 1)}:
            if marked(item, document, n) >= 0.5 * len(item):
                return True
    return False


def awkward(spark, rows):
    """The rows (doc_id, text, lang) with columns whose names the operators use, a map column among them."""
    return spark.createDataFrame([(i, t, lang, "s", n, f"x{n}", n, n, n, "t", 0.5, datetime.date(2020, 1, 1), {"a": n % 2}, ["y"]) for n, (i, t, lang) in enumerate(rows)],
                                 SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    english = [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("lang = 'en' AND length(text) > 200").orderBy("doc_id").limit(60).collect()]
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(i, t, "en") for i, t in enumerate(english)]
    rows += [(None, "A line of its own here.\nThe same line\n" + t, "en") for t in english[:12]] + [(100 + i, "the same line \nother text " + t, None) for i, t in enumerate(english[12:24])]
    rows += [(7, None, "en"), (None, None, None), (8, "", "en"), (9, " \n ", "en"), (10, (english[3] + "\n") * 2000 + "z" * 1_000_000, "en"), (11, f"{english[5]} {item} {english[6]}", "en"),
             (12, english[1], "en"), (12, english[1], "en"), (None, english[2], "en")]
    return awkward(spark, rows)


def as_rows(df):
    return Counter(repr((r.doc_id, r.text, r.lang, r._id, r._th, r._keep, r.id, r.th, r.k, r.keep, r.row, r.Text_)) for r in df.collect())


@pytest.mark.parametrize("name", ["language", "repeated_lines", "near_duplicates", "decontamination"])
def test_stage_on_awkward_rows(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    left = stage(spark, docs, SF_DIR)
    assert left.columns == docs.columns and [f.dataType for f in left.schema] == [f.dataType for f in docs.schema]
    if name == "repeated_lines":
        assert left.count() == docs.count()
        texts = {r._id: r.text for r in left.collect()}
        before = {r._id: r.text for r in docs.collect()}
        assert all((texts[i] is None) == (t is None) for i, t in before.items())
        assert not any("same line" in (t or "") for t in texts.values()) and any("other text" in (t or "") for t in texts.values())
    else:
        assert not as_rows(left) - as_rows(docs) and 20 < left.count() < docs.count()
    if name == "decontamination":
        items = [words_of(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
        found = {r._id for r in docs.collect() if covered(words_of(r.text), items)}
        assert {r._id for r in docs.collect()} - {r._id for r in left.collect()} == found and {r._id for r in docs.filter("doc_id = 11 AND text LIKE '% %'").collect()} & found
    if name == "near_duplicates":
        kept = [r for r in left.collect() if r.text and r.text.split()]
        assert len(kept) == len({r.text for r in kept}) and sum(r.doc_id == 12 for r in kept) == 1
        assert left.filter("text IS NULL OR trim(text) IN ('', '\n')").count() == docs.filter("text IS NULL OR trim(text) IN ('', '\n')").count()
    assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_tokens_on_awkward_rows(spark, docs):
    out = corpus_pipeline.tokens(spark, docs, SF_DIR)
    assert out.count() == docs.count() and out.filter("n_tokens = 0").count() == 3
    assert corpus_pipeline.tokens(spark, docs.limit(0), SF_DIR).count() == 0


def test_stages_one_after_the_other_on_awkward_rows(spark, docs):
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.stored(stage(spark, left, SF_DIR), name)
    assert 20 < left.count() < docs.count() and left.columns == docs.columns


def test_quality_with_one_label_of_a_kind(spark):
    """Also where no slot holds both labels."""
    docs = spark.createDataFrame([(i, "good plain words in a row " * (i % 3 + 1) if i else "### $$$ !!!", "x") for i in range(80)], "doc_id bigint, text string, id string")
    for seed in range(6):
        labels = spark.createDataFrame([(i, int(i != 0)) for i in range(60)], "doc_id bigint, quality int")
        rows = {r.doc_id: r for r in quality.quality_scores(docs, labels, partners=1, seed=seed).collect()}
        assert len(rows) == 80 and all(0 <= r.score <= 1 for r in rows.values()) and rows[0].score < rows[1].score
