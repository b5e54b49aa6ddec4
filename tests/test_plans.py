"""Plans, prompts, the exchange, costs."""

import json

import pytest
from pyspark.sql import functions as F

from dialoom.plans import cost, prompts as P, quota, responses as X
from dialoom.sources import conversations as S, exchange as E
from dialoom.streaming import ingest as I
from dialoom.taxonomy import CATEGORIES, INTENTS, intents_of


def test_taxonomy(spark):
    assert len(INTENTS) == len(set(INTENTS)) == 77 and len(CATEGORIES) == 11
    assert intents_of(spark, "refunds").count() == 3 and intents_of(spark, "nothing").count() == 0


@pytest.mark.parametrize("total", [1, 2, 7, 100, 999, 1000])
def test_plan_marginals_are_exact(spark, total):
    plan = quota.generation_plan(spark, total, seed=total)
    rows = plan.collect()
    assert sorted(r["plan_id"] for r in rows) == list(range(total))
    for name, shares in quota.PLAN_SHARES.items():
        want = {v: n for v, n in quota.quotas(total, shares).items() if n}
        got = {}
        for r in rows:
            got[r[name]] = got.get(r[name], 0) + 1
        assert got == want
    assert rows == plan.collect()


def test_plan_has_no_shuffle(spark, capsys):
    quota.generation_plan(spark, 10**12).explain()
    plan = capsys.readouterr().out
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_empty_and_split_plans(spark):
    assert quota.generation_plan(spark, 0).count() == 0
    counts = dict(quota.language_split(spark, 11, 30).groupBy("language").count().collect())
    assert counts == {"en": 3, "es": 8}
    assert quota.language_split(spark, 5, 100).select("language").distinct().collect()[0][0] == "en"


@pytest.mark.parametrize("total,least", [(10, 77), (77, 77), (100, 100), (1000, 1000)])
def test_balanced_plan(spark, total, least):
    counts = [r["count"] for r in quota.balanced_plan(spark, total).groupBy("intent").count().collect()]
    assert len(counts) == 77 and sum(counts) == least and max(counts) - min(counts) <= 1


def test_draws_keep_given_values_and_repeat(spark):
    rows = spark.range(2000).withColumn("sentiment", F.when(F.col("id") % 2 == 0, "negative"))
    a, b = quota.draw_parameters(rows, "id", 1), quota.draw_parameters(rows.repartition(7), "id", 1)
    assert a.filter("id % 2 = 0 AND sentiment <> 'negative'").count() == 0
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.select("intent").distinct().count() == 77


def test_prompt_mentions_everything(spark):
    row = spark.createDataFrame([("age_limit", "account_management", "negative", "complex", "es", "stable_frustrated", None)],
                                "intent STRING, category STRING, sentiment STRING, complexity STRING, language STRING, emotion_arc STRING, context STRING")
    text = P.with_prompt(row).first()["prompt"]
    for part in ("Intent: age_limit", "Categoría: account_management", "Turnos objetivo: 6-10", "Emotion arc: stable_frustrated", "Write in Spanish", '"conv_XXX"'):
        assert part in text
    assert "Additional context" not in text


INNER = json.dumps({"conversation_id": "conv_XXX9", "intent": "age_limit", "turns": [{"speaker": "customer", "text": "hi"}], "turn_count": "four"})
LINES = [json.dumps({"recordId": "1", "modelOutput": {"content": [{"text": INNER}]}}), "", "   ",
         json.dumps({"recordId": "2", "modelOutput": {"content": [{"text": f"```json\n{INNER}\n```"}]}}),
         json.dumps({"recordId": "3", "error": "ThrottlingException: slow down"}), "not json at all", "[1]",
         json.dumps({"recordId": "4", "modelOutput": {"content": [{"text": "This is not valid JSON"}]}}),
         json.dumps({"recordId": "5", "error": None, "modelOutput": {"content": [{"text": INNER}]}})]


def parsed(spark):
    return E.parse_lines(spark.createDataFrame([(x,) for x in LINES], "value STRING"))


def test_response_lines(spark):
    ok, bad = E.results(parsed(spark)), E.errors(parsed(spark))
    assert sorted(r["record_id"] for r in ok.collect()) == ["1", "2", "4", "5"]
    assert sorted((r["record_id"] or "", r["error"], r["raw_line"] or "") for r in bad.collect()) == [
        ("", "JSON parse error", "[1]"), ("", "JSON parse error", "not json at all"), ("3", "ThrottlingException: slow down", "")]
    assert ok.filter("record_id = '5'").first()["generated_text"] is None
    assert {r["error_type"]: r["n"] for r in X.error_summary(bad).collect()} == {"JSON parse error": 2, "ThrottlingException: slow down": 1}


def test_extract_overrides_and_process_fills(spark):
    plan = spark.createDataFrame([("1", "card_arrival", "negative", "simple", "es")], "recordId STRING, intent STRING, sentiment STRING, complexity STRING, language STRING")
    ok = E.results(parsed(spark))
    got = {r["record_id"]: r for r in X.extract(ok, plan).collect()}
    assert got["1"]["intent"] == "card_arrival" and got["2"]["intent"] == "age_limit" and set(got) == {"1", "2"}
    done = {r["record_id"]: r for r in X.process(ok, plan).collect()}
    assert done["1"]["intent"] == "age_limit" and done["1"]["sentiment"] == "negative" and done["1"]["language"] == "es"
    assert done["1"]["customer_emotion_arc"] == "frustrated_to_satisfied" and done["1"]["resolution_time_category"] == "quick"
    assert done["2"]["sentiment"] == "neutral" and done["2"]["category"] == "general" and done["2"]["turn_count"] == 1
    assert done["1"]["conversation_id"].startswith("conv_") and "XXX" not in done["1"]["conversation_id"]
    assert done["1"]["conversation_id"] != done["2"]["conversation_id"]
    assert done["2"]["metadata"]["record_id"] == "2"
    assert X.extract_errors(ok).select("record_id").collect()[0][0] == "4"
    m = X.run_metrics(ok).first()
    assert (m["generated"], m["failed"]) == (2, 1) and X.run_metrics(ok.limit(0)).first()["success_rate"] == 0


def test_request_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "hola ñ", "sys"), (2, "x", "")], "id INT, prompt STRING, system STRING")
    made = E.requests(rows, F.col("id"))
    E.write_requests(made, str(tmp_path / "out"))
    lines = sorted(json.loads(r["value"])["modelInput"].get("system", "") for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ["", "sys"] and made.columns == ["recordId", "modelInput", "id"]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"conversation_id": "1", "turns": [{"speaker": "customer", "text": "é"}]}, {"intent": "x"}]))
    (tmp_path / "b.json").write_text(json.dumps({"conversation_id": "1"}))
    (tmp_path / "c.report.json").write_text("{}")
    read = lambda name: S.read_conversations(spark, str(tmp_path / name))
    assert read("a.json").count() == 2 and read("b.json").count() == 0 and read("none.json").count() == 0
    assert [r["name"] for r in S.files(spark, str(tmp_path)).collect()] == ["b.json", "a.json"]
    assert S.format_for(10) == "json" and S.format_for(1000) == "jsonl" and S.format_for(5, True) == "parquet"


def test_flatten(spark):
    df = spark.sql("SELECT 1 id, named_struct('a', 2, 'b', named_struct('c', 'x')) s, array(1, 2) l")
    flat = S.flatten(df)
    assert flat.columns == ["id", "s.a", "s.b.c", "l"] and tuple(flat.first()) == (1, 2, "x", "[1,2]")


def test_best_delay_without_viable(spark):
    calls = spark.createDataFrame([(1.0, True, 1.0), (1.0, False, 1.0), (2.0, False, 1.0)], "delay DOUBLE, ok BOOLEAN, seconds DOUBLE")
    assert cost.best_delay(cost.throughput(calls)).first()["delay"] == 1.0


def test_cost_by_hand(spark):
    df = spark.sql("SELECT 'a' id, array(named_struct('speaker', 'customer', 'text', 'abcd')) turns")
    row = cost.generation_cost(df).first()
    size = len('{"id":"a","turns":[{"speaker":"customer","text":"abcd"}]}')
    assert row["input_tokens"] == 500 and row["output_tokens"] == (4 + size) // 4 and row["total_turns"] == 1


def test_generator_hook(spark):
    def fn(batches):
        for pdf in batches:
            yield pdf.assign(out=pdf["id"] * 2)[["out"]]
    assert sorted(r[0] for r in I.generate(spark.range(5), fn, "out BIGINT").collect()) == [0, 2, 4, 6, 8]


def test_stream_restart_adds_nothing(spark, tmp_path):
    inbox, sink, checkpoint = (str(tmp_path / n) for n in ("in", "sink", "cp"))
    lines = spark.createDataFrame([(x,) for x in LINES if x.strip()], "value STRING")
    lines.coalesce(1).write.text(inbox)
    run = lambda: I.ingest(I.response_stream(spark, inbox), sink, checkpoint).awaitTermination()
    run()
    run()
    assert spark.read.parquet(f"{sink}/conversations").count() == 2 == I.conversations(spark, sink).count()
    assert spark.read.parquet(f"{sink}/errors").count() == 5 == I.errors(spark, sink).count()
    lines.coalesce(1).write.mode("append").text(inbox)      # the same records again, in a new file
    run()
    assert I.conversations(spark, sink).count() == 2 and I.errors(spark, sink).filter("record_id IS NOT NULL").count() == 3


def test_ingest_loses_no_line(spark, tmp_path):
    """Old files, lines without an id, broken lines with one beginning, and answers that come before or after an error."""
    import os
    import time

    inbox, sink = tmp_path / "in", str(tmp_path / "sink")
    inbox.mkdir()
    answer = lambda i: json.dumps({**({"recordId": i} if i else {}), "modelOutput": {"content": [{"text": INNER}]}})
    other = json.dumps({"modelOutput": {"content": [{"text": INNER.replace("hi", "ho")}]}})
    files = {"a": [answer("1"), json.dumps({"recordId": "2", "error": "late"}), answer(None), other, answer(None)],
             "b": ["x" * 300 + "1", "x" * 300 + "2", answer("2"), json.dumps({"recordId": "1", "error": "again"}), json.dumps({"recordId": "3", "error": "no"})],
             "old": [answer("4"), json.dumps({"recordId": "5", "modelOutput": {"content": []}})]}
    for age, (name, lines) in enumerate(files.items()):
        (inbox / name).write_text("\n".join(lines))
        os.utime(inbox / name, (time.time() - 100 + age,) * 2)
    run = lambda: I.ingest(I.response_stream(spark, str(inbox), max_files=1), sink, str(tmp_path / "cp")).awaitTermination()
    run()
    (inbox / "older").write_text(answer("6"))
    os.utime(inbox / "older", (time.time() - 5 * 86400,) * 2)
    run()
    assert spark.read.parquet(f"{sink}/conversations").count() == 7
    got = [r["record_id"] for r in I.conversations(spark, sink).collect()]
    assert sorted(map(str, got)) == ["1", "2", "4", "6", "None", "None"]
    errors = I.errors(spark, sink).collect()
    assert sorted((str(r["record_id"]), r["error"]) for r in errors) == [
        ("3", "no"), ("5", I.NO_TEXT), ("None", "JSON parse error"), ("None", "JSON parse error")]


def test_plan_shuffle_mixes_at_any_size(spark):
    for total in (10**6, 10**12, 10**14):
        rows = spark.range(2000).select(quota.shuffled(total, 7).alias("p")).collect()
        places = [r["p"] for r in rows]
        assert len(set(places)) == 2000 and 0 <= min(places) and max(places) < total
        assert 0.4 < sum(p < total / 2 for p in places) / 2000 < 0.6
        changes = sum((a < total / 2) != (b < total / 2) for a, b in zip(places, places[1:]))
        assert 800 < changes < 1200         # neighbours are independent


def test_json_files_are_judged_one_by_one(spark, tmp_path):
    (tmp_path / "a.json").write_text(' \n [{"conversation_id": "1"}, {"conversation_id": "2"}]')
    (tmp_path / "b.json").write_text('{"conversation_id": "3", "x": [1, 2]}')
    (tmp_path / "c.json").write_text('[{"conversation_id": "4"}]')
    (tmp_path / "d.json").write_text("")
    got = S.read_conversations(spark, str(tmp_path), "json")
    assert sorted(r["conversation_id"] for r in got.collect()) == ["1", "2", "4"]
    assert [r["file"].rsplit("/", 1)[1] for r in S.rejected_files(spark, str(tmp_path)).collect()] == ["b.json"]


def test_taxonomy_lookup_needs_no_join(spark, tmp_path):
    from dialoom.operators.repair import fill_gaps

    spark.range(10).selectExpr("CAST(id AS STRING) AS conversation_id", "'age_limit' AS intent", "array(named_struct('speaker', 'customer', 'text', 'x')) AS turns")\
        .write.parquet(str(tmp_path / "c"))
    df = fill_gaps(spark.read.parquet(str(tmp_path / "c")), {"intent": F.col("intent")})
    assert df.filter("category = 'general'").isEmpty() and df.count() == 10
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
