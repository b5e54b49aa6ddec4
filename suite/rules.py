"""B: rules, repair, views, samples, filters, taxonomy lookups."""

from pyspark.sql import functions as F

from dialoom.operators import repair, rules as R, select as S
from dialoom.taxonomy import intents_of, taxonomy, with_category
from suite.base import LONG_SQL, NESTED_FACTS, ROWS, long_heads, nested, nested_facts, query, table

TRIM = "trim(text, chr(9) || chr(10) || chr(13) || ' ')"
SPEAK = "coalesce(speaker IN ('customer', 'agent'), false)"
ENUM = {"sentiment": "('positive','neutral','negative')", "resolution_status": "('resolved','escalated','unresolved')"}
TYPED = ("('account_inquiry','billing_issue','technical_support','product_information','complaint','cancellation_request',"
         "'feature_request','password_reset','refund_request','general_inquiry')")
LANGS = "('en','es','fr','de','pt','it','nl','pl','ru','zh','ja','ko','ar','hi','tr')"
TAX_IN = "(" + ",".join(f"'{x}'" for _, x, _ in ROWS) + ")"


def typed_sql(intents):
    return f"""v AS (
  SELECT 'intent' AS rule FROM facts WHERE NOT coalesce(intent IN {intents}, false)
  UNION ALL SELECT 'sentiment' FROM facts WHERE NOT coalesce(sentiment IN {ENUM['sentiment']}, false)
  UNION ALL SELECT 'resolution_status' FROM facts WHERE NOT coalesce(resolution_status IN {ENUM['resolution_status']}, false)
  UNION ALL SELECT 'language' FROM facts WHERE NOT coalesce(language, 'en') IN {LANGS}
  UNION ALL SELECT 'min_turns' FROM facts WHERE n_turns < 2
  UNION ALL SELECT 'max_turns' FROM facts WHERE n_turns > 20
  UNION ALL SELECT 'first_speaker' FROM facts WHERE n_turns > 0 AND NOT coalesce(first_speaker = 'customer', false)
  UNION ALL SELECT 'turn.speaker' FROM turns WHERE NOT {SPEAK}
  UNION ALL SELECT 'turn.text_missing' FROM turns WHERE length({TRIM}) < 1
  UNION ALL SELECT 'turn.text_short' FROM turns WHERE length({TRIM}) BETWEEN 1 AND 9
  UNION ALL SELECT 'turn.text_long' FROM turns WHERE length({TRIM}) > 500)"""


def _typed(spark, sf):
    return nested(spark, sf).select("conversation_id", "intent", "sentiment", "turns", "resolution_status", "language")


@query("b1_typed_rule_counts", f"WITH {NESTED_FACTS}, {typed_sql(TYPED)} SELECT rule, count(*) AS n FROM v GROUP BY 1")
def typed(spark, sf):
    return R.violation_counts(R.typed_violations(_typed(spark, sf)))


@query("b1_typed_rule_counts_taxonomy", f"WITH {NESTED_FACTS}, {typed_sql(TAX_IN)} SELECT rule, count(*) AS n FROM v GROUP BY 1")
def typed_taxonomy(spark, sf):
    return R.violation_counts(R.typed_violations(_typed(spark, sf), [x for _, x, _ in ROWS]))


@query("b2_utc_timestamps", """SELECT event_id, epoch_us(CASE event_id % 3 WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
  ELSE date_trunc('second', ts) END) AS micros FROM events""")
def utc(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    iso = F.when(F.col("event_id") % 3 == 0, text).when(F.col("event_id") % 3 == 1, F.concat(text, F.lit("Z")))\
        .otherwise(F.concat(text, F.lit("+02:00")))
    return e.select("event_id", F.unix_micros(R.as_utc(iso)).alias("micros"))


@query("b3_metric_range_rules", """WITH v AS (SELECT 'completeness' AS rule FROM customer WHERE NOT c_acctbal / 10000 BETWEEN 0 AND 1
  UNION ALL SELECT 'realism' FROM customer WHERE NOT (c_custkey % 12) / 10 BETWEEN 0 AND 1
  UNION ALL SELECT 'diversity' FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT 'overall' FROM customer WHERE NOT c_acctbal / 80 BETWEEN 0 AND 100) SELECT rule, count(*) AS n FROM v GROUP BY 1""")
def metric_rules(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        k.alias("dataset_id"), (F.col("c_acctbal") / 10000).alias("completeness"), F.lit(1.0).alias("consistency"),
        ((k % 12) / 10).alias("realism"), F.when(k % 7 == 0, None).otherwise(F.lit(0.5)).alias("diversity"),
        (F.col("c_acctbal") / 80).alias("overall"))
    return R.violation_counts(R.metric_violations(rows))


@query("b3_dataset_rules", """WITH v AS (SELECT 'size' AS rule FROM orders WHERE o_custkey % 10 = 0
  UNION ALL SELECT 'file_size_mb' FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT 'file_format' FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'domain' FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT 'generation_date' FROM orders WHERE o_orderkey % 9 = 0)
  SELECT rule, count(*) AS n FROM v GROUP BY 1""")
def dataset_rules(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("dataset_id"), (F.col("o_custkey") % 10).alias("size"),
        (F.col("o_totalprice") - 50000).alias("file_size_mb"),
        F.when(F.col("o_orderstatus") == "P", "xml").otherwise("jsonl").alias("file_format"),
        F.when(F.col("o_orderpriority") == "5-LOW", "time_series").otherwise("customer_service").alias("domain"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).alias("generation_date"))
    return R.violation_counts(R.dataset_violations(rows))


_MISSING = " UNION ALL ".join(
    f"SELECT conversation_id AS id, 'Missing required field: {f}' AS message FROM facts WHERE {f} IS NULL"
    for f in R.REQUIRED_FIELDS if f != "turns")
SCHEMA_SQL = f"""v AS ({_MISSING}
  UNION ALL SELECT conversation_id, 'Missing required field: turns' FROM facts WHERE NOT turns_given
  UNION ALL SELECT conversation_id, 'Conversation must have at least 2 turns' FROM facts WHERE turns_given AND n_turns < 2
  UNION ALL SELECT conversation_id, 'Turn ' || turn_idx || ' missing ''speaker''' FROM turns JOIN facts USING (conversation_id) WHERE n_turns >= 2 AND speaker IS NULL
  UNION ALL SELECT conversation_id, 'Turn ' || turn_idx || ' has invalid speaker: None' FROM turns JOIN facts USING (conversation_id) WHERE n_turns >= 2 AND speaker IS NULL
  UNION ALL SELECT conversation_id, 'Invalid intent: ' || intent FROM facts WHERE intent NOT IN {TAX_IN})"""


@query("b4_schema_violations", f"WITH {NESTED_FACTS}, {SCHEMA_SQL} SELECT id, message FROM v")
def schema(spark, sf):
    return R.schema_violations(nested(spark, sf)).select("id", "message")


ORDERED = ["intent", "sentiment", "turns", "resolution_status"]


def first_sql(prefix, rest):
    gone = "\n".join(f"WHEN {f + ' IS NULL' if f != 'turns' else 'NOT turns_given'} THEN '{prefix}: {f}'" for f in ORDERED)
    return f"SELECT conversation_id, e IS NULL AS is_valid, coalesce(e, '') AS error FROM (SELECT conversation_id, CASE {gone} {rest} END AS e FROM facts LEFT JOIN bad USING (conversation_id))"


@query("b5_first_error", f"""WITH {NESTED_FACTS}, bad AS (SELECT conversation_id, min_by(m, turn_idx) AS m FROM (
    SELECT conversation_id, turn_idx, CASE WHEN speaker IS NULL THEN 'Turn ' || turn_idx || ' missing speaker or text'
      WHEN {TRIM} = '' THEN 'Turn ' || turn_idx || ' has empty text' END AS m FROM turns) WHERE m IS NOT NULL GROUP BY 1)
  {first_sql('Missing field', "WHEN n_turns < 2 THEN 'Invalid turns count: ' || n_turns WHEN NOT coalesce(first_speaker = 'customer', false) THEN 'First speaker must be customer' ELSE m")}""")
def first_error(spark, sf):
    return R.first_error(nested(spark, sf))


@query("b5_first_error_strict", f"""WITH {NESTED_FACTS}, bad AS (SELECT conversation_id, min_by(m, turn_idx) AS m FROM (
    SELECT conversation_id, turn_idx, CASE WHEN speaker IS NULL THEN 'Turn ' || turn_idx || ' missing speaker or text' END AS m FROM turns) WHERE m IS NOT NULL GROUP BY 1)
  {first_sql('Missing required field', "WHEN n_turns < 2 THEN 'Invalid turns: expected list with at least 2 items, got ' || n_turns WHEN m IS NOT NULL THEN m WHEN NOT coalesce(first_speaker = 'customer', false) THEN 'First turn must be from customer'")}""")
def first_error_strict(spark, sf):
    return R.first_error_strict(nested(spark, sf))


@query("b6_series_rules", r"""WITH s AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents),
  b AS (SELECT doc_id, t, list_position(list_transform(t[1:10], lambda x: TRY_CAST(x AS DOUBLE) IS NULL), true) AS p FROM s)
  SELECT doc_id AS series_id, doc_id % 5 <> 0 AND p IS NULL AS is_valid, CASE WHEN doc_id % 5 = 0 THEN 'Missing required field: frequency'
    WHEN p IS NOT NULL THEN 'Target[' || (p - 1) || '] is not numeric' ELSE '' END AS error FROM b""")
def series_rules(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("series_id"), F.lit("sensors").alias("domain"), F.lit("load").alias("series_type"),
        F.when(F.col("doc_id") % 5 != 0, "1H").alias("frequency"), F.split("text", " ").alias("target"))
    return R.series_error(rows)


@query("b7_transaction_rules", """WITH v AS (SELECT 'transaction_type' AS rule FROM events WHERE event_type NOT IN ('purchase')
  UNION ALL SELECT 'amount' FROM events WHERE NOT value - 5 > 0 UNION ALL SELECT 'merchant_category' FROM events WHERE user_id % 3 = 0
  UNION ALL SELECT 'risk_score' FROM events WHERE NOT value / 100 BETWEEN 0 AND 1) SELECT rule, count(*) AS n FROM v GROUP BY 1""")
def transactions(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("transaction_id"), F.col("user_id").alias("account_id"), F.col("ts").alias("timestamp"),
        F.col("event_type").alias("transaction_type"), (F.col("value") - 5).alias("amount"),
        F.when(F.col("user_id") % 3 == 0, "casino").when(F.col("user_id") % 3 == 1, "travel").alias("merchant_category"),
        (F.col("value") / 100).alias("risk_score"))
    return R.violation_counts(R.transaction_violations(rows))


@query("b7_account_rules", """WITH v AS (SELECT 'account_type' AS rule FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
  UNION ALL SELECT 'holder_income_bracket' FROM customer WHERE c_nationkey > 20) SELECT rule, count(*) AS n FROM v GROUP BY 1""")
def accounts(spark, sf):
    segment = F.col("c_mktsegment")
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account_id"), F.current_timestamp().alias("account_opened_date"),
        F.when(segment == "BUILDING", "checking").when(segment == "MACHINERY", "credit").otherwise(segment).alias("account_type"),
        F.lit("18-25").alias("holder_age_bracket"),
        F.when(F.col("c_nationkey") > 20, "huge").when(F.col("c_nationkey") > 10, "low").alias("holder_income_bracket"))
    return R.violation_counts(R.account_violations(rows))


@query("b8_fill_gaps", f"""WITH {NESTED_FACTS}, planned AS (SELECT f.*, CASE WHEN k % 3 = 0 THEN NULL ELSE 'card_arrival' END AS pi,
    CASE WHEN k % 2 = 0 THEN 'negative' END AS ps, CASE WHEN k % 4 = 0 THEN 'complex' END AS pc FROM facts f)
  SELECT conversation_id, coalesce(intent, pi, 'general_inquiry') AS intent,
    coalesce(category, CASE WHEN pi = 'card_arrival' THEN 'card_management' ELSE 'general' END) AS category,
    coalesce(sentiment, ps, 'neutral') AS sentiment, coalesce(complexity, pc, 'medium') AS complexity, coalesce(language, 'en') AS language,
    CASE WHEN turns_given THEN n_turns ELSE coalesce(turn_count, 0) END::BIGINT AS turn_count,
    coalesce(customer_emotion_arc, CASE coalesce(ps, 'neutral') WHEN 'negative' THEN 'frustrated_to_satisfied' ELSE 'stable_neutral' END) AS customer_emotion_arc,
    coalesce(resolution_time_category, CASE coalesce(pc, 'medium') WHEN 'complex' THEN 'extended' ELSE 'standard' END) AS resolution_time_category,
    coalesce(resolution_status, 'resolved') AS resolution_status FROM planned""")
def fill_gaps(spark, sf):
    k = F.col("k")
    planned = {"intent": F.when(k % 3 != 0, "card_arrival"), "sentiment": F.when(k % 2 == 0, "negative"),
               "complexity": F.when(k % 4 == 0, "complex")}
    out = repair.fill_gaps(nested(spark, sf), planned).drop("k", "turns")
    return out.withColumn("turn_count", F.col("turn_count").cast("bigint"))


@query("b9_unique_ids", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'conv_' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12)
  ELSE 'conv_' || doc_id % 100 END AS conversation_id FROM documents""")
def unique_ids(spark, sf):
    k = F.col("doc_id")
    given = F.when(k % 3 == 0, None).when(k % 5 == 0, "").when(k % 7 == 0, "conv_XXX_1")\
        .otherwise(F.concat(F.lit("conv_"), (k % 100).cast("string")))
    return table(spark, sf, "documents").select(k, repair.unique_id(given, k).alias("conversation_id"))


@query("b9_duplicate_ids", """SELECT text AS conversation_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicates(spark, sf):
    return repair.duplicate_ids(table(spark, sf, "documents").withColumnRenamed("text", "conversation_id"))


@query("b10_flat_view", f"""WITH {LONG_SQL} SELECT conversation_id, coalesce(intent, '') AS intent, coalesce(category, '') AS category,
  coalesce(sentiment, '') AS sentiment, coalesce(complexity, '') AS complexity, coalesce(language, '') AS language, coalesce(turn_count, 0) AS turn_count,
  coalesce(resolution_status, '') AS resolution_status, coalesce(customer_emotion_arc, '') AS emotion_arc FROM heads""")
def flat(spark, sf):
    return S.flat_view(long_heads(spark, sf))


@query("b11_samples", f"""WITH {NESTED_FACTS} SELECT conversation_id, intent, n_turns FROM facts WHERE sentiment = 'negative' ORDER BY conversation_id LIMIT 5""")
def samples(spark, sf):
    return S.samples(nested_facts(spark, sf), 5, sentiment="negative").select("conversation_id", "intent", "n_turns")


@query("b12_random_row", f"WITH {NESTED_FACTS} SELECT conversation_id, intent FROM facts ORDER BY md5('7-' || conversation_id), conversation_id LIMIT 1")
def random_row(spark, sf):
    return S.random_row(nested(spark, sf), seed=7).select("conversation_id", "intent")


@query("b13_assess_pairs", f"""WITH {NESTED_FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY language, intent ORDER BY md5('42-' || conversation_id)) AS i FROM facts WHERE intent <> ''),
  a AS (SELECT * FROM r WHERE i = 1 AND language = 'en'), b AS (SELECT * FROM r WHERE i = 1 AND language = 'es')
  SELECT a.intent, a.conversation_id AS conversation_id1, b.conversation_id AS conversation_id2,
    abs(CASE WHEN a.turns_given THEN a.n_turns ELSE 0 END - CASE WHEN b.turns_given THEN b.n_turns ELSE 1 END) <= 2 AS length_match,
    coalesce(lower(a.sentiment) = lower(b.sentiment) AND a.sentiment <> '', false) AS sentiment_match, true AS intent_match FROM a JOIN b ON a.intent = b.intent""")
def assess(spark, sf):
    """One random pair per intent of the English and the Spanish half; the flags follow from the pick."""
    rows = nested(spark, sf)
    pairs = S.random_pairs(rows.filter("language = 'en'"), rows.filter("language = 'es'"))
    return S.assess(pairs).select("intent", "conversation_id1", "conversation_id2", "length_match", "sentiment_match", "intent_match")


@query("b13_assess_by_id", f"""WITH {NESTED_FACTS}, a AS (SELECT k // 2 AS pair, * FROM facts WHERE k % 2 = 0), b AS (SELECT k // 2 AS pair, * FROM facts WHERE k % 2 = 1)
  SELECT pair, abs(a.n_turns - CASE WHEN b.turns_given THEN b.n_turns ELSE 1 END) <= 2 AS length_match, coalesce(lower(a.sentiment) = lower(b.sentiment), false) AS sentiment_match,
    coalesce(lower(a.intent) = lower(b.intent), false) AS intent_match FROM a JOIN b USING (pair)""")
def assess_by_id(spark, sf):
    rows = nested(spark, sf).withColumn("pair", F.floor(F.col("k") / 2))
    side = lambda r, s: rows.filter(F.col("k") % 2 == r).select(
        "pair", F.size("turns").alias(f"turns{s}"), F.col("sentiment").alias(f"sentiment{s}"), F.col("intent").alias(f"intent{s}"))
    return S.assess(side(0, 1).join(side(1, 2), "pair")).select("pair", "length_match", "sentiment_match", "intent_match")


@query("b14_search", """SELECT c_custkey AS id, c_mktsegment AS domain FROM customer
  WHERE contains(lower(concat_ws(' ', c_custkey, c_mktsegment, c_name)), 'build')""")
def search(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("domain"), F.col("c_name").alias("file_path"))
    return S.search(rows, "BUILD").select("id", "domain")


@query("b15_training_rows", f"""WITH {NESTED_FACTS} SELECT conversation_id, intent FROM facts WHERE n_turns BETWEEN 2 AND 20 AND language = 'en'
  AND sentiment IN ('positive', 'negative') AND intent IN (SELECT t_intent FROM tax WHERE t_category = 'transfers')""")
def training_rows(spark, sf):
    return S.training_rows(nested(spark, sf), "en", intents=intents_of(spark, "transfers"),
                           sentiments=["positive", "negative"]).select("conversation_id", "intent")


@query("b16_category_lookup", f"""WITH {LONG_SQL} SELECT conversation_id, intent, coalesce(x.t_category, 'unknown') AS mapped, x.t_intent IS NOT NULL AS valid
  FROM heads LEFT JOIN tax x ON x.t_intent = intent""")
def category_lookup(spark, sf):
    rows = with_category(long_heads(spark, sf), "mapped")
    return rows.select("conversation_id", "intent", F.coalesce("mapped", F.lit("unknown")).alias("mapped"), F.col("mapped").isNotNull().alias("valid"))


@query("b16_intents_by_category", f"""WITH {LONG_SQL}, n AS (SELECT intent, count(*) AS n FROM heads GROUP BY 1)
  SELECT t_category AS category, count(*) AS intents, sum((n IS NOT NULL)::INT)::BIGINT AS used, coalesce(sum(n), 0)::BIGINT AS conversations
  FROM tax LEFT JOIN n ON n.intent = t_intent GROUP BY 1""")
def by_category(spark, sf):
    counts = long_heads(spark, sf).groupBy("intent").agg(F.count("*").alias("n"))
    return taxonomy(spark).join(counts, "intent", "left").groupBy("category").agg(
        F.count("*").alias("intents"), F.count("n").alias("used"), F.coalesce(F.sum("n"), F.lit(0)).alias("conversations"))


@query("b17_few_shot", f"""WITH {NESTED_FACTS} SELECT language, sentiment, complexity, conversation_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY language, sentiment, complexity ORDER BY conversation_id) AS rank FROM facts) WHERE rank <= 3""")
def few_shot(spark, sf):
    return S.few_shot(nested(spark, sf)).select("language", "sentiment", "complexity", "conversation_id", F.col("rank").cast("bigint").alias("rank"))


@query("b18_language_fallback", """WITH d AS (SELECT lang, min(text) AS opener FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1)
  SELECT doc_id, documents.lang AS language, md5(coalesce(d.opener, (SELECT opener FROM d WHERE lang = 'en'))) AS opener FROM documents LEFT JOIN d ON d.lang = documents.lang""")
def fallback(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("lang", "language")
    openers = docs.filter(F.col("language").isin("en", "fr")).groupBy("language").agg(F.min("text").alias("opener"))
    return S.with_language_fallback(docs.select("doc_id", "language"), openers, "opener").withColumn("opener", F.md5("opener"))
