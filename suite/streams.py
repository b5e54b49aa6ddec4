"""J: streams and generators. K: series and transaction measures."""

from pyspark.sql import functions as F

from dialoom.operators import series as K
from dialoom.operators.rolling import rolling_features
from dialoom.session import shared_path
from dialoom.streaming import ingest as I, monitor as M
from suite.base import NESTED_SQL, nested, query, rounded, table
from suite.plans import PLANNED_SQL, PLAN_SQL, RESPONSE_SQL, _requests, _response_plan, response_lines


def _folder(spark, sf):
    """Response lines as files: some records fail first and are answered later, a third of the lines comes twice."""
    folder = shared_path(spark, "inbox")
    lines = response_lines(spark, sf)
    early = F.to_json(F.struct(F.col("rid").alias("recordId"), F.lit("timeout").alias("error")))
    lines.filter("m IN (0, 1, 3)").select(early.alias("value")).write.text(folder)
    lines.select("value").write.mode("append").text(folder)
    lines.filter("m % 3 = 0").select("value").write.mode("append").text(folder)
    return folder


@query("j1_ingested_conversations", f"""WITH {PLANNED_SQL} SELECT rid AS record_id, coalesce(g_intent, p_intent, 'general_inquiry') AS intent,
  coalesce(g_sentiment, p_sentiment, 'neutral') AS sentiment, coalesce(p_language, 'en') AS language FROM planned WHERE m IN (0, 1, 2)""")
def ingested(spark, sf):
    """Two runs over the same folder: the second run adds nothing, repeated lines are one record, answers beat errors."""
    folder, sink, checkpoint = _folder(spark, sf), shared_path(spark, "sink"), shared_path(spark, "stream")
    plan = _response_plan(spark, sf)
    for _ in range(2):
        I.ingest(I.response_stream(spark, folder), sink, checkpoint, plan).awaitTermination()
    return I.conversations(spark, sink).select("record_id", "intent", "sentiment", "language")


@query("j1_ingest_errors", f"""WITH {RESPONSE_SQL}, bad AS (SELECT *, CASE WHEN m = 5 THEN 'Throttled: too many requests sent to this one model'
    WHEN m IN (8, 9) THEN 'no text in the response' ELSE 'JSON parse error' END AS error, 'garbage ' || replace(text, chr(10), ' ') AS line FROM r WHERE m NOT IN (0, 1, 2))
  SELECT CASE WHEN m <> 6 THEN rid END AS record_id, error, CASE WHEN m = 6 THEN substr(line, 1, 200) END AS line, count(DISTINCT CASE WHEN m = 6 THEN md5(line) ELSE rid END) AS n
  FROM bad WHERE m <> 3 GROUP BY ALL
  UNION ALL SELECT rid, 'JSON parse error or timeout', NULL, 1 FROM bad WHERE m = 3""")
def ingest_errors(spark, sf):
    folder, sink, checkpoint = _folder(spark, sf), shared_path(spark, "sink"), shared_path(spark, "stream")
    I.ingest(I.response_stream(spark, folder), sink, checkpoint).awaitTermination()
    found = I.errors(spark, sink).withColumn("line", F.when(F.col("record_id").isNull(), F.col("raw_line")))
    found = found.join(response_lines(spark, sf).filter("m = 3").select(F.col("rid").alias("record_id"), F.lit(True).alias("late")), "record_id", "left")
    # which of two failures of one file time came last is not determined
    error = F.when(F.col("late") & F.col("error").isin("JSON parse error", "timeout"), "JSON parse error or timeout").otherwise(F.col("error"))
    return found.groupBy("record_id", error.alias("error"), "line").agg(F.countDistinct(F.coalesce("record_id", F.element_at(F.split("key", "\x1f"), -1))).alias("n"))


@query("j1_standing_conversations", f"""WITH {PLANNED_SQL} SELECT rid AS record_id, coalesce(g_intent, p_intent, 'general_inquiry') AS intent,
  coalesce(g_sentiment, p_sentiment, 'neutral') AS sentiment, coalesce(p_language, 'en') AS language FROM planned WHERE m IN (0, 1, 2)""")
def standing_conversations(spark, sf):
    """The same result from the state of the stream, after a restart."""
    folder, checkpoint = _folder(spark, sf), shared_path(spark, "standing")
    for _ in range(2):
        I.follow(I.response_stream(spark, folder, max_files=3), checkpoint).awaitTermination()
    return I.standing_conversations(spark, checkpoint, _response_plan(spark, sf)).select("record_id", "intent", "sentiment", "language")


@query("j1_standing_errors", f"""WITH {RESPONSE_SQL}, bad AS (SELECT *, CASE WHEN m = 5 THEN 'Throttled: too many requests sent to this one model'
    WHEN m IN (8, 9) THEN 'no text in the response' ELSE 'JSON parse error' END AS error, 'garbage ' || replace(text, chr(10), ' ') AS line FROM r WHERE m NOT IN (0, 1, 2, 3))
  SELECT CASE WHEN m <> 6 THEN rid END AS record_id, error, CASE WHEN m = 6 THEN substr(line, 1, 200) END AS line, count(DISTINCT CASE WHEN m = 6 THEN md5(line) ELSE rid END) AS n
  FROM bad GROUP BY ALL""")
def standing_errors(spark, sf):
    """Records that failed twice at one file time are left out: which of both failures came last is not determined."""
    folder, checkpoint = _folder(spark, sf), shared_path(spark, "standing")
    I.follow(I.response_stream(spark, folder), checkpoint).awaitTermination()
    found = I.standing_errors(spark, checkpoint).withColumn("line", F.when(F.col("record_id").isNull(), F.col("raw_line")))
    twice = response_lines(spark, sf).filter("m = 3").select(F.col("rid").alias("record_id"))
    found = found.join(twice, "record_id", "left_anti")
    return found.groupBy("record_id", "error", "line").agg(F.countDistinct(F.coalesce("record_id", F.element_at(F.split("key", "\x1f"), -1))).alias("n"))


def _calls(df):
    return df.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_id", (F.col("event_type") != "error").alias("ok"))


WINDOWS = """o AS (SELECT unnest(range(6)) AS i), w AS (SELECT to_timestamp(10 * (floor(epoch(ts) / 10) - i)) AT TIME ZONE 'UTC' AS s, event_type FROM events, o),
rate AS (SELECT s, count(*) AS calls, sum((event_type = 'error')::INT)::BIGINT AS failures FROM w GROUP BY 1)"""


@query("j2_request_rate", f"WITH {WINDOWS} SELECT epoch(s)::BIGINT AS start, calls, failures, calls > 1 AS over_limit FROM rate")
def request_rate(spark, sf):
    out = M.request_rate(_calls(table(spark, sf, "events")), limit=1)
    return out.select(F.unix_timestamp("window_start").alias("start"), "calls", "failures", "over_limit")


@query("j2_request_rate_stream", f"""WITH {WINDOWS} SELECT epoch(s)::BIGINT AS start, calls, failures FROM rate
  WHERE s + INTERVAL 1 MINUTE <= date_trunc('millisecond', (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE)""")
def request_rate_stream(spark, sf):
    """The same windows from a stream: those that are over when the input ends."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    sink = shared_path(spark, "rate")
    M.request_rate(_calls(stream), watermark="5 minutes").writeStream.format("parquet").option("path", sink)\
        .option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).select(F.unix_timestamp("window_start").alias("start"), "calls", "failures")


@query("j2_failure_streaks", """WITH g AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
    - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS run FROM events),
  c AS (SELECT user_id, run, count(*) AS n FROM g WHERE bad GROUP BY 1, 2)
  SELECT u.user_id::VARCHAR AS key, coalesce(max(n), 0)::BIGINT AS longest, coalesce(max(n), 0) >= 3 AS pause FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c USING (user_id) GROUP BY 1""")
def failure_streaks(spark, sf):
    return M.failure_streaks(_calls(table(spark, sf, "events")), F.col("user_id"), F.struct("ts", "event_id"), 3)


@query("j2_failure_pauses_stream", """WITH e AS (SELECT * FROM events WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) FROM events) - 300000), g AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id)
    - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY epoch_ms(ts), event_id) AS run FROM e),
  c AS (SELECT user_id, run, count(*) AS n FROM g WHERE bad GROUP BY 1, 2)
  SELECT u.user_id::VARCHAR AS key, coalesce(max(n), 0)::BIGINT AS longest, count(CASE WHEN n >= 3 THEN 1 END) AS pauses FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN c USING (user_id) GROUP BY 1""")
def failure_pauses_stream(spark, sf):
    """The streaks of ``j2_failure_streaks`` from a stateful stream, up to its last watermark."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    sink, name = shared_path(spark, "pauses"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        M.failure_pauses(_calls(stream), "user_id", "event_id", 3).writeStream.format("parquet").option("path", sink)\
            .option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(sink).groupBy("key").agg(F.max("longest").alias("longest"), F.max("pauses").alias("pauses"))


@query("j3_generated_responses", f"WITH {PLAN_SQL} SELECT plan_id::VARCHAR AS record_id, upper(prompt) AS text FROM prompted")
def generated(spark, sf):
    def echo(batches):
        for pdf in batches:
            yield pdf.assign(text=pdf["prompt"].str.upper())[["record_id", "text"]]

    made = _requests(spark, sf).select(F.col("recordId").alias("record_id"), F.get("modelInput.messages", F.lit(0))["content"].alias("prompt"))
    return I.generate(made, echo, "record_id STRING, text STRING")


# ---------------------------------------------------------------- series

def _points(spark, sf):
    """Dense series: one per event type, one point per event, at the event's rank by id."""
    e = table(spark, sf, "events")
    return e.select((F.col("event_id") % 7).alias("series_id"), F.floor(F.col("event_id") / 7).alias("idx"),
                    F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))


POINTS = "p AS (SELECT event_id % 7 AS series_id, event_id // 7 AS idx, CASE WHEN event_id % 11 <> 0 THEN value END AS value FROM events)"


@query("k1_fixed_length", r"""SELECT doc_id, CASE WHEN len(t) >= 50 THEN array_to_string(t[1:50], ' ') ELSE array_to_string(t, ' ') || repeat(' ' || t[-1], 50 - len(t)) END AS target
  FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents)""")
def fixed_length(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("t"))
    return docs.select("doc_id", F.array_join(K.fix_length(F.col("t"), 50), " ").alias("target"))


@query("k2_autocorrelation", f"WITH {POINTS} SELECT a.series_id, 2::BIGINT AS lag, round(corr(a.value, b.value), 6) AS autocorrelation FROM p a JOIN p b ON a.series_id = b.series_id AND b.idx = a.idx + 2 GROUP BY 1")
def autocorrelation(spark, sf):
    return rounded(K.autocorrelation(_points(spark, sf), 2).withColumn("lag", F.col("lag").cast("bigint")))


@query("k2_series_completeness", f"WITH {POINTS} SELECT series_id, round(count(value) / count(*), 6) AS completeness FROM p GROUP BY 1")
def series_completeness(spark, sf):
    return rounded(K.completeness(_points(spark, sf)))


@query("k3_standardised", f"WITH {POINTS} SELECT series_id, idx, round((value - avg(value) OVER (PARTITION BY series_id)) / stddev_pop(value) OVER (PARTITION BY series_id), 4) AS z FROM p WHERE value IS NOT NULL")
def standardised(spark, sf):
    return rounded(K.standardise(_points(spark, sf).filter("value IS NOT NULL")).select("series_id", "idx", "z"), 4)


@query("k4_amount_shares", """SELECT round(a, 6) AS small, round(b, 6) AS medium, round(c, 6) AS large, round(greatest(abs(a - 0.7), abs(b - 0.25), abs(c - 0.05)), 6) AS imbalance,
  round(f, 6) AS fraud_rate, round(abs(f - 0.02), 6) AS fraud_gap FROM (SELECT avg((value < 50)::INT) AS a, avg((value >= 50 AND value < 500)::INT) AS b, avg((value >= 500)::INT) AS c,
  avg((event_type = 'error')::INT) AS f FROM events)""")
def amount_shares(spark, sf):
    rows = table(spark, sf, "events").select(F.col("value").alias("amount"), (F.col("event_type") == "error").alias("is_fraudulent"))
    return rounded(K.amount_shares(rows))


def _frame(days):
    return f"OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND CURRENT ROW)"


def _mean(over):
    return f"CAST(sum(CAST(value AS DECIMAL(18, 6))) {over} AS DOUBLE) / nullif(count(value) {over}, 0)"


_ROLLING = ", ".join(f"count(*) {_frame(d)} AS n_{d}d, {_mean(_frame(d))} AS mean_{d}d, round(stddev_pop(value) {_frame(d)}, 3) AS std_{d}d" for d in (1, 7, 30))
_PAST = "OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"


@query("k5_rolling_features", f"""SELECT event_id, {_ROLLING}, coalesce(count(*) {_PAST}, 0) AS history_n, {_mean(_PAST)} AS history_mean,
  value - {_mean(_PAST)} AS deviation, hour(ts)::INT AS hour, isodow(ts)::INT AS weekday
  FROM (SELECT event_id, ts, value, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id FROM events)""")
def rolling(spark, sf):
    """One account has a third of all events."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("user_id"))
    out = rolling_features(e, "user_id", "ts", "value").drop("ts", "value", "user_id")
    return out.select(*[F.round(c, 3).alias(c) if c.startswith("std") else F.col(c) for c in out.columns])


@query("k6_conversation_balance", f"""WITH {NESTED_SQL}, c AS (SELECT category, count(*) AS n FROM heads WHERE category IS NOT NULL GROUP BY 1),
  a AS (SELECT customer_emotion_arc, count(*) AS n FROM heads WHERE customer_emotion_arc IS NOT NULL GROUP BY 1)
  SELECT round((SELECT avg(coalesce((resolution_status = 'resolved')::INT, 0)) FROM heads), 6) AS resolution_rate,
    round((SELECT -sum(n / t * log2(n / t)) / log2(11) FROM c, (SELECT sum(n) AS t FROM c)), 6) AS category_balance,
    round((SELECT -sum(n / t * log2(n / t)) / log2(6) FROM a, (SELECT sum(n) AS t FROM a)), 6) AS emotion_arc_variety""")
def balance(spark, sf):
    return rounded(K.conversation_balance(nested(spark, sf)))
