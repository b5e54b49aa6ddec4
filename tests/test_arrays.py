"""JSON arrays in small blocks against Python's parser."""

import json
import random

import pytest

from dialoom.sources.arrays import array_records
from dialoom.sources.conversations import read_conversations, rejected_files

BITS = ['"', "\\", "}", "{", "[", "]", ",", "\n", "é", "a", "},{", '"}', "\\\\", ": "]


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 4 else 3)
    if kind == 0:
        return "".join(rng.choice(BITS) for _ in range(rng.randrange(12)))
    if kind in (1, 2):
        return rng.choice([1, -2.5, None, True])
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choice(BITS) for _ in range(3)) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("size", ["40", "1000", "128m"])
def test_records_of_any_layout(spark, tmp_path, size):
    rng = random.Random(3)
    want = []
    for k, layout in enumerate(({}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False, "indent": 0})):
        records = [{"i": i, "x": value(rng)} for i in range(40)]
        want += [json.dumps(r, sort_keys=True) for r in records]
        (tmp_path / f"{k}.json").write_text(rng.choice(["", "\n", "  "]) + json.dumps(records, **layout) + rng.choice(["", "\n"]))
    (tmp_path / "8.json").write_text('{"no": [{"array": 1}]}')
    (tmp_path / "9.json").write_text("[]")
    (tmp_path / "a.json").write_text(" ")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [json.dumps(json.loads(r.record), sort_keys=True) for r in array_records(spark, str(tmp_path)).collect()]
        tasks = spark.read.option("lineSep", "}").text(str(tmp_path / "1.json")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == sorted(want)
    assert tasks > 20 or size != "40"
    assert {r.root for r in rejected_files(spark, str(tmp_path)).collect()} == {"{"}


def test_conversations_of_one_file(spark, tmp_path):
    rows = [{"conversation_id": f"c{i}", "intent": "x", "turns": [{"speaker": "customer", "text": 'a "}" b'}, {"speaker": "agent", "text": "},{"}], "metadata": {"k": "v"}} for i in range(30)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    got = read_conversations(spark, str(tmp_path), "json").orderBy("conversation_id").collect()
    assert [r.conversation_id for r in got] == sorted(r["conversation_id"] for r in rows)
    assert got[0].turns[0].text == 'a "}" b' and got[0].turns[1].text == "},{" and got[0].metadata == {"k": "v"}
    assert read_conversations(spark, str(tmp_path / "missing"), "json").count() == 0
