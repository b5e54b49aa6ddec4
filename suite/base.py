"""Registration, and the adapter that gives the given tables the shape of labelled conversations.

``conversations`` is the long form, ``documents`` (one line = one turn) the nested form. Neither
has labels, so these are derived from the id by arithmetic that both engines evaluate alike.
"""

from __future__ import annotations

from collections.abc import Callable


from pyspark.sql import DataFrame, SparkSession, functions as F


from dialoom.operators.shape import Corpus, corpus_from_nested, corpus_from_turns
from dialoom.sources.conversations import spread_small
from dialoom.taxonomy import ROWS, taxonomy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` is its twin for the SQL check."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are costly to work on, spread over all cores if it is one small file."""
    return spread_small(table(spark, sf_dir, name), f"{sf_dir}/{name}.parquet")


# Labels by id arithmetic; the same text is valid in Spark SQL and in the checking engine.
LABEL_SQL = {
    "intent": "CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 'not_an_intent' ELSE t_intent END",
    "category": "CASE WHEN k % 11 = 0 THEN NULL ELSE t_category END",
    "sentiment": "CASE WHEN k % 29 = 0 THEN NULL WHEN k % 10 < 3 THEN 'positive' WHEN k % 10 < 7 THEN 'neutral' "
                 "WHEN k % 10 < 9 THEN 'negative' WHEN k % 20 = 9 THEN 'Positive' ELSE 'mixed' END",
    "complexity": "CASE WHEN k % 31 = 0 THEN NULL WHEN k % 7 < 3 THEN 'simple' WHEN k % 7 < 6 THEN 'medium' "
                  "ELSE 'complex' END",
    "language": "CASE WHEN k % 23 = 0 THEN 'fr' WHEN k % 37 = 0 THEN NULL WHEN k % 2 = 0 THEN 'en' ELSE 'es' END",
    "turn_count": "CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(2 + k % 9 AS INT) END",
    "customer_emotion_arc": "CASE WHEN k % 6 = 0 THEN 'stable_positive' WHEN k % 6 = 1 THEN 'stable_neutral' "
                            "WHEN k % 6 = 2 THEN 'frustrated_to_satisfied' ELSE NULL END",
    "resolution_time_category": "CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'quick' ELSE 'standard' END",
    "resolution_status": "CASE WHEN k % 19 = 0 THEN 'pending' WHEN k % 41 = 0 THEN NULL WHEN k % 6 < 4 THEN 'resolved' "
                         "WHEN k % 6 = 4 THEN 'escalated' ELSE 'unresolved' END",
}
TAX_SQL = "tax AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{x}', '{c}')" for i, x, c in ROWS) + ") v(ordinal, t_intent, t_category))"
_LABELS_SQL = ", ".join(f"{e} AS {n}" for n, e in LABEL_SQL.items())
ID_SQL = "'conv_' || lpad(CAST(k AS VARCHAR), 12, '0')"
SPEAKER_SQL = ("CASE WHEN k % 21 = 0 AND i = 1 THEN NULL "
               "WHEN k % 9 = 0 THEN (CASE WHEN i % 2 = 0 THEN 'agent' ELSE 'customer' END) "
               "WHEN k % 8 = 0 THEN (CASE WHEN i % 4 = 3 THEN 'agent' ELSE 'customer' END) "
               "ELSE (CASE WHEN i % 2 = 0 THEN 'customer' ELSE 'agent' END) END")

# WITH parts for the long form (conversations) and the nested form (documents).
LONG_SQL = f"""{TAX_SQL},
ids AS (SELECT DISTINCT conv_id AS k FROM conversations),
heads AS (SELECT k, {ID_SQL} AS conversation_id, {_LABELS_SQL} FROM ids LEFT JOIN tax ON ordinal = k % 77),
turns AS (SELECT k, {ID_SQL} AS conversation_id, turn AS turn_idx,
  CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'agent' ELSE role END AS speaker, text
  FROM (SELECT conv_id AS k, * FROM conversations))"""
NESTED_SQL = f"""{TAX_SQL},
ids AS (SELECT doc_id AS k, string_split(text, chr(10)) AS lines FROM documents
  UNION ALL SELECT doc_id + 1000000000, NULL FROM documents WHERE doc_id % 43 = 0),
heads AS (SELECT k, lines, {ID_SQL} AS conversation_id, {_LABELS_SQL} FROM ids LEFT JOIN tax ON ordinal = k % 77),
cut AS (SELECT k, unnest(lines) AS text, CAST(unnest(range(len(lines))) AS BIGINT) AS i FROM ids),
turns AS (SELECT k, {ID_SQL} AS conversation_id, i AS turn_idx, {SPEAKER_SQL} AS speaker, text FROM cut)"""
# one row per conversation, as ``facts``
FACTS_SQL = """, runs AS (SELECT conversation_id, max(c) AS longest FROM (
  SELECT conversation_id, g, count(*) AS c FROM (
    SELECT *, sum(b) OVER (PARTITION BY conversation_id ORDER BY turn_idx) AS g FROM (
      SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER (PARTITION BY conversation_id ORDER BY turn_idx)
        AND row_number() OVER (PARTITION BY conversation_id ORDER BY turn_idx) > 1 THEN 0 ELSE 1 END AS b FROM turns))
  GROUP BY 1, 2) GROUP BY 1),
sums AS (SELECT conversation_id, count(*) AS n, sum(CASE WHEN speaker <> '' THEN 1 ELSE 0 END) AS fs,
  sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) AS ft, sum(length(text)) AS chars FROM turns GROUP BY 1),
opened AS (SELECT conversation_id, speaker, text FROM turns QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn_idx) = 1),
asked AS (SELECT conversation_id, text FROM turns WHERE speaker = 'customer'
  QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn_idx) = 1),
facts AS (SELECT h.*, s.n IS NOT NULL AS turns_given, coalesce(s.n, 0) AS n_turns, coalesce(s.fs, 0) AS filled_speakers,
  coalesce(s.ft, 0) AS filled_texts, coalesce(s.chars, 0) AS text_chars, o.speaker AS first_speaker, o.text AS first_text,
  a.text AS first_customer_text, coalesce(r.longest, 0) AS longest_run
  FROM heads h LEFT JOIN sums s USING (conversation_id) LEFT JOIN opened o USING (conversation_id)
  LEFT JOIN asked a USING (conversation_id) LEFT JOIN runs r USING (conversation_id))"""
LONG_FACTS = LONG_SQL + FACTS_SQL
NESTED_FACTS = NESTED_SQL + FACTS_SQL
WORD_SQL = r"[\p{L}\p{N}_]+"


def _conversation_id():
    return F.concat(F.lit("conv_"), F.lpad(F.col("k").cast("string"), 12, "0"))


def _label(df: DataFrame) -> DataFrame:
    tax = taxonomy(df.sparkSession).select(F.col("ordinal").alias("_o"), F.col("intent").alias("t_intent"),
                                           F.col("category").alias("t_category"))
    joined = df.join(F.broadcast(tax), F.col("k") % 77 == F.col("_o"), "left")
    keep = [c for c in df.columns if c != "k"]
    return joined.select("k", _conversation_id().alias("conversation_id"),
                         *[F.expr(e).alias(n) for n, e in LABEL_SQL.items()], *keep)


def long_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "k")
    speaker = F.when(F.col("role") == "user", "customer").when(F.col("role") == "assistant", "agent").otherwise(F.col("role"))
    return rows.select(_conversation_id().alias("conversation_id"), F.col("turn").alias("turn_idx"),
                       speaker.alias("speaker"), "text")


def long_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k")).distinct())


def long_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return corpus_from_turns(long_heads(spark, sf_dir), long_turns(spark, sf_dir))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested conversations: one per document, one turn per line; beside every 43rd one that has no turns."""
    lines = F.split("text", "\n")
    turns = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    docs = text_table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("k"), turns.alias("lines"))
    shaped = F.expr(f"""transform(lines, x -> struct({SPEAKER_SQL.replace('i %', 'x.i %').replace('i =', 'x.i =')} AS speaker, x.line AS text))""")
    shaped = rows.withColumn("turns", shaped).drop("lines")
    broken = table(spark, sf_dir, "documents").filter("doc_id % 43 = 0").select(
        (F.col("doc_id") + 1_000_000_000).alias("k"), F.lit(None).cast(shaped.schema["turns"].dataType).alias("turns"))
    return _label(shaped.union(broken))


def nested_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return corpus_from_nested(nested(spark, sf_dir))


def nested_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_corpus(spark, sf_dir).facts


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounds every double column; sums in another order differ in the last bits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def reference_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference rows (text, label, intent): one per order, in uneven shares over the taxonomy."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("key"),
        ((F.col("o_custkey") * F.col("o_custkey")) % 91).alias("slot"))
    tax = taxonomy(spark).select(F.col("ordinal").cast("bigint").alias("slot"), F.col("intent").alias("name"))
    return rows.join(F.broadcast(tax), "slot", "left").select(
        "text", F.when(F.col("slot") % 7 == 0, F.lit(None)).otherwise(F.col("slot")).cast("string").alias("label"),
        F.when(F.col("key") % 10 == 0, F.lit(None)).otherwise(F.col("name")).alias("intent"))


REFERENCE_SQL = """, slots AS (SELECT o_orderpriority AS text, o_orderkey AS key, (o_custkey * o_custkey) % 91 AS slot FROM orders),
reference AS (SELECT text, CASE WHEN slot % 7 = 0 THEN NULL ELSE CAST(slot AS VARCHAR) END AS label,
  CASE WHEN key % 10 = 0 THEN NULL ELSE t_intent END AS intent FROM slots LEFT JOIN tax ON tax.ordinal = slot),
refs AS (SELECT coalesce(intent, label, 'unknown') AS key, count(*) AS n, count(*) * 1.0 / (SELECT count(*) FROM reference) AS share
  FROM reference GROUP BY 1)"""
