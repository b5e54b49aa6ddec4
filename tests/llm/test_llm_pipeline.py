"""The pipeline against plain Python, stage by stage, and the registration of its queries."""

import hashlib

import pytest

import corpus_pipeline
from __spark_entry__ import queries
from dialoom.llm import lines

SF_DIR = "/root/testdata/sf0.001"


def test_registered():
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {q if q == "pipeline" else q.split("_")[0] + "_" for q in queries()}


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    out.append({r.doc_id: r for r in docs.collect()})
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), name)
        out.append({r.doc_id: r for r in docs.collect()})
    return out


def shingles(text):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages_by_brute_force(spark, stages):
    raw, known, cleaned, single, clean, coded = stages
    assert all(raw[i] == r for i, r in known.items()) and len(known) > 0.95 * len(raw)
    found = {}
    for r in known.values():
        for k in lines.line_keys(r.text.encode(), 1)[1]:
            found[k] = found.get(k, 0) + 1
    for i, r in known.items():
        left = "\n".join(x for x in r.text.split("\n") if found.get(x.encode().strip(lines.SPACE).lower(), 0) < 10)
        assert (cleaned[i].text, cleaned[i].n_chars, cleaned[i].lang, cleaned[i].source) == (left, len(left), r.lang, r.source)
    sets = {i: shingles(r.text) for i, r in cleaned.items()}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    assert set(single) == {i for i in sets if group[i] == i} and all(cleaned[i] == r for i, r in single.items())
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    items = [words(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    whole = {i for i, r in single.items() if any(" " + " ".join(x) + " " in " " + " ".join(words(r.text)) + " " for x in items)}
    assert whole and not whole & set(clean) and len(single) - len(clean) <= len(whole) + 2
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert set(coded) == set(clean)
    for i, r in coded.items():
        assert r.ids == library.encode(clean[i].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(clean[i].text.encode()).hexdigest()


def test_run_equals_stages(spark, stages):
    assert {r.doc_id: r for r in corpus_pipeline.run(spark, SF_DIR).collect()} == stages[-1]


def test_stages_keep_columns_of_documents(spark):
    empty = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, empty, SF_DIR).columns) == sorted(empty.columns)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    """One document of each group stays, and every document without a near copy."""
    base = " ".join(f"b{i}" for i in range(40))
    alone = [" ".join(f"a{k}x{i}" for i in range(20)) for k in range(6)]
    nulls = " ".join(f"n{i}" for i in range(40))
    same = " ".join(f"s{i}" for i in range(40))
    rows = [(1, base), (None, base + " more"), (None, alone[0]), (None, alone[1]),     # a null id in a group takes no other null id along
            (2, base + " other"), (2, alone[2]), (2, alone[3]),                        # neither does the id 2
            (3, same), (3, same), (3, same + " more"), (4, same),                      # repeated rows, and two texts with the smallest id
            (None, nulls), (None, nulls), (None, nulls + " more"),                     # a group of null ids only
            (5, alone[4]), (5, alone[4]), (6, alone[5]), (7, None), (7, None), (None, ""), (8, " ")]
    docs = spark.createDataFrame([(i, t, "en", str(n % 2), n) for n, (i, t) in enumerate(rows)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    left = corpus_pipeline.near_duplicates(spark, docs, SF_DIR)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    group = [(i, t) for i, t in got if t and t.startswith(("s0 ", "n0 "))]
    assert len(group) == 2 and {i for i, _ in group} == {3, None}
    want = [(1, base), (None, alone[0]), (None, alone[1]), (2, alone[2]), (2, alone[3]), (5, alone[4]), (6, alone[5]), (7, None), (7, None), (None, ""), (8, " ")]
    assert sorted((x for x in got if x not in group), key=repr) == sorted(want, key=repr)
