"""A: readers, writers, reference data, exports, catalogue. Files go below the shared folder."""

from pyspark.sql import functions as F

from dialoom.operators import bias as B, quality as Q
from dialoom.operators.quality import reference_shares
from dialoom.schema import CONVERSATION
from dialoom.session import shared_path
from dialoom.sources import conversations as S
from suite.base import (NESTED_FACTS, REFERENCE_SQL, TAX_SQL, nested, nested_facts, query,
                        reference_examples, rounded, table)

ROUND_TRIP = f"""WITH {NESTED_FACTS} SELECT conversation_id, intent, language, n_turns, text_chars::BIGINT AS text_chars, first_text FROM facts"""


def _seen(df):
    """What must survive a write and a read of every conversation."""
    from dialoom.operators.shape import facts_from_nested
    return facts_from_nested(df).select("conversation_id", "intent", "language", "n_turns", "text_chars", "first_text")


for _name, _fmt in (("a1_json_conversations", "json"), ("a8_parquet_dataset", "parquet"), ("a13_jsonl_dataset", "jsonl"),
                    ("a13_csv_dataset", "csv")):
    def _trip(spark, sf, fmt=_fmt):
        path = shared_path(spark, f"dataset-{fmt}")
        rows = nested(spark, sf).drop("k")
        if fmt == "json":      # files of one array each, with one file beside them that is none
            part = F.floor(F.regexp_extract("conversation_id", r"(\d+)", 1).cast("bigint") / 100).alias("part")
            arrays = rows.groupBy(part).agg(F.collect_list(F.to_json(F.struct(*rows.columns))).alias("r"))
            arrays.select("part", F.concat(F.lit("[\n"), F.array_join("r", ",\n"), F.lit("]")).alias("value")).write.partitionBy("part").text(path)
            spark.range(1).selectExpr("'{\"conversation_id\": \"x\"}' AS value").write.text(f"{path}/part=-1")
            assert S.rejected_files(spark, path).count() == 1
            return _seen(S.read_conversations(spark, path, fmt))
        # columns in the order of the record, as a reader with that schema expects them
        full = rows.select(*[F.col(f.name) if f.name in rows.columns and f.name != "turns"
                             else F.from_json(F.to_json("turns"), f.dataType).alias("turns") if f.name == "turns"
                             else F.lit(None).cast(f.dataType).alias(f.name) for f in CONVERSATION])
        S.write_conversations(full, path, fmt, by=None if fmt == "csv" else "language")
        return _seen(S.read_conversations(spark, path, fmt))
    query(_name, ROUND_TRIP)(_trip)


@query("a2_reference_shares", f"""WITH {TAX_SQL} {REFERENCE_SQL} SELECT key, n, round(share, 6) AS share FROM refs""")
def reference(spark, sf):
    return rounded(reference_shares(reference_examples(spark, sf)))


@query("a3_reference_sample", """SELECT text, quality AS label, CASE quality WHEN 1 THEN 'kept' ELSE 'poor' END AS intent
  FROM (SELECT * FROM labels JOIN documents USING (doc_id) ORDER BY doc_id LIMIT 500)""")
def reference_sample(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    names = spark.createDataFrame([(0, "poor"), (1, "kept")], "label INT, intent STRING")
    return S.sample_reference(rows.withColumnRenamed("quality", "label"), names, "doc_id", 500)


@query("a4_series_sample", """WITH c AS (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 100), p AS (
    SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS r FROM events JOIN c USING (user_id))
  SELECT user_id AS series_id, string_agg(printf('%.2f', value), ',' ORDER BY r) AS "values", count(*) AS length FROM p WHERE r <= 500 GROUP BY 1""")
def series_sample(spark, sf):
    points = table(spark, sf, "events").select(F.col("user_id").alias("series_id"), F.col("ts").alias("at"), "value")
    out = S.sample_series(points)
    text = F.array_join(F.transform("values", lambda v: F.format_string("%.2f", v)), ",")
    return out.select("series_id", text.alias("values"), F.col("length").cast("bigint").alias("length"))


@query("a9_report", f"""WITH {NESTED_FACTS} SELECT count(*) AS conversations, 1 AS reports FROM facts""")
def report(spark, sf):
    facts = nested_facts(spark, sf)
    doc = S.report(spark, quality=Q.estimate(facts), bias=B.detect(facts))
    return doc.select(F.get_json_object("report", "$.bias.conversations").cast("bigint").alias("conversations"),
                      F.when(F.get_json_object("report", "$.quality.completeness").isNotNull(), 1).otherwise(0).alias("reports"))


@query("a10_flat_export", """SELECT doc_id::VARCHAR AS id, lang AS "meta.lang", n_chars::VARCHAR AS "meta.n_chars", '["' || source || '"]' AS tags FROM documents""")
def flat_export(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.struct("lang", "n_chars").alias("meta"), F.array("source").alias("tags"))
    path = shared_path(spark, "export")
    S.export(rows, path, "csv")
    return spark.read.csv(path, header=True, escape='"')


@query("a11_catalogue", """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
  SELECT CASE WHEN lang = 'en' THEN 'ds_en' ELSE 'file_set_' || lang || '_' || CASE lang WHEN 'de' THEN '20240102' WHEN 'es' THEN '20240103' ELSE '20240104' END END AS id,
    n AS size, CASE WHEN lang = 'en' THEN 'registry' ELSE 'file' END AS source,
    CASE lang WHEN 'en' THEN '2024-01-01' WHEN 'de' THEN '2024-01-02' WHEN 'es' THEN '2024-01-03' ELSE '2024-01-04' END AS day FROM c""")
def catalogue(spark, sf):
    """One file set per language; the English one is registered, the others are found by their files."""
    docs = table(spark, sf, "documents")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("size"))
    days = F.create_map(*[F.lit(x) for kv in {"de": "20240102", "es": "20240103", "fr": "20240104", "en": "20240101"}.items() for x in kv])
    named = F.concat(F.lit("set_"), "lang", F.lit("_"), F.element_at(days, F.col("lang")))
    listing = sizes.select(F.concat(F.lit("/data/"), named, F.lit(".json")).alias("path"), F.concat(named, F.lit(".json")).alias("name"),
                           F.current_timestamp().alias("modified"), "size")
    known = listing.filter(F.col("name").startswith("set_en")).select(
        F.lit("ds_en").alias("id"), F.lit("customer_service").alias("domain"), "size",
        F.to_timestamp(F.lit("2024-01-01")).alias("generation_date"), F.col("path").alias("file_path"))
    out = S.unregistered(listing.drop("size"), listing.select("path", "size"), known)
    return out.select("id", "size", "source", F.date_format("generation_date", "yyyy-MM-dd").alias("day"))


@query("a12_dataset_files", """SELECT count(*) AS files, true AS complete FROM (SELECT DISTINCT lang FROM documents)""")
def dataset_files(spark, sf):
    root = shared_path(spark, "files")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    docs.repartition("lang").write.partitionBy("lang").json(f"{root}/data")
    docs.limit(1).coalesce(1).write.json(f"{root}/other.report.json")
    found = S.files(spark, f"{root}/data", "*.json").withColumn("folder", F.element_at(F.split("path", "/"), -2))
    return found.agg(F.countDistinct("folder").alias("files"), (F.min("bytes") > 0).alias("complete"))
