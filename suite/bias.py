"""E: bias measures. B19: the gate."""

from pyspark.sql import functions as F

from dialoom.functions.text import words
from dialoom.operators import bias as B
from dialoom.operators.profile import profile
from dialoom.taxonomy import taxonomy
from suite.base import (LONG_SQL, NESTED_SQL, TAX_SQL, WORD_SQL, long_heads, long_turns, nested, query, rounded,
                        table)

_OPEN = NESTED_SQL


def share_sql(column, value):
    return f"(sum((coalesce(lower({column}), '') = '{value}')::INT) / count(*))"


SENT = {v: share_sql("sentiment", v) for v in B.EXPECTED_SENTIMENT}
COMP = {v: share_sql("complexity", v) for v in B.EXPECTED_COMPLEXITY}


def distribution_sql(parts, expected):
    distance = ", ".join(f"abs({c} - {expected[v]})" for v, c in parts.items())
    return ", ".join(f"round({c}, 6) AS {v}" for v, c in parts.items()) + f", round(greatest({distance}), 6) AS imbalance"


@query("e1_sentiment_distribution", f"WITH {_OPEN} SELECT {distribution_sql(SENT, B.EXPECTED_SENTIMENT)} FROM heads")
def sentiment(spark, sf):
    return rounded(B.sentiment_distribution(nested(spark, sf)))


@query("e1_sentiment_distribution_long", f"WITH {LONG_SQL} SELECT {distribution_sql(SENT, B.EXPECTED_SENTIMENT)} FROM heads")
def sentiment_long(spark, sf):
    return rounded(B.sentiment_distribution(long_heads(spark, sf)))


@query("e6_complexity_distribution", f"WITH {_OPEN} SELECT {distribution_sql(COMP, B.EXPECTED_COMPLEXITY)} FROM heads")
def complexity(spark, sf):
    return rounded(B.complexity_distribution(nested(spark, sf)))


def lexicon(spark, sf):
    """(word, polarity) over the words of the benchmark texts; the polarity follows the word's length."""
    found = table(spark, sf, "benchmark").select(F.explode(words(F.col("text"))).alias("word")).distinct()
    return found.withColumn("polarity", (F.length("word") % 5 - 2).cast("double") / 2)


TEXT_SQL = f"""lex AS (SELECT word, (length(word) % 5 - 2) / 2 AS polarity FROM (
    SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS word FROM benchmark)),
said AS (SELECT conversation_id, unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS word FROM turns WHERE speaker = 'customer'),
pol AS (SELECT conversation_id, avg(polarity) AS p FROM said JOIN lex USING (word) GROUP BY 1),
texted AS (SELECT conversation_id, coalesce(p, 0.0) AS polarity, CASE WHEN coalesce(p, 0) > 0.1 THEN 'positive'
  WHEN coalesce(p, 0) < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment FROM heads LEFT JOIN pol USING (conversation_id))"""


@query("e2_text_sentiment", f"WITH {LONG_SQL}, {TEXT_SQL} SELECT conversation_id, round(polarity, 6) AS polarity, sentiment FROM texted")
def text_sentiment(spark, sf):
    return rounded(B.text_sentiment(long_heads(spark, sf), long_turns(spark, sf), lexicon(spark, sf)))


@query("e2_text_sentiment_distribution", f"WITH {LONG_SQL}, {TEXT_SQL} SELECT {distribution_sql(SENT, B.EXPECTED_SENTIMENT)} FROM texted")
def text_distribution(spark, sf):
    return rounded(B.text_sentiment_distribution(long_heads(spark, sf), long_turns(spark, sf), lexicon(spark, sf)))


@query("e3_intent_coverage", f"""WITH {LONG_SQL} SELECT count(DISTINCT x.t_intent) AS intents,
  round(least(1.0, count(DISTINCT x.t_intent) / 77), 6) AS intent_coverage FROM heads h LEFT JOIN tax x ON x.t_intent = h.intent""")
def coverage(spark, sf):
    return rounded(B.intent_coverage(long_heads(spark, sf)))


RARE_SQL = """counts AS (SELECT coalesce(intent, 'unknown') AS intent, count(*) AS n FROM heads GROUP BY 1),
rare AS (SELECT ordinal, t_intent AS intent, coalesce(n, 0) AS n, coalesce(n, 0) / (SELECT count(*) FROM heads) AS share
  FROM tax LEFT JOIN counts ON counts.intent = t_intent WHERE coalesce(n, 0) / (SELECT count(*) FROM heads) < 0.01)"""


def lopsided(spark, sf):
    """Documents with few intents, mostly negative and complex, in their own languages."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), "lang")
    tax = taxonomy(spark).select(F.col("ordinal").cast("bigint").alias("o"), "intent")
    return docs.join(F.broadcast(tax), (F.col("k") * F.col("k")) % 77 == F.col("o"), "left").select(
        "intent", F.col("lang").alias("language"), F.lit("resolved").alias("resolution_status"),
        F.when(F.col("k") % 5 == 0, "neutral").otherwise("negative").alias("sentiment"),
        F.when(F.col("k") % 10 < 7, "complex").otherwise("medium").alias("complexity"))


LOPSIDED_SQL = f"""{TAX_SQL}, heads AS (SELECT t_intent AS intent, lang AS language, 'resolved' AS resolution_status,
  CASE WHEN doc_id % 5 = 0 THEN 'neutral' ELSE 'negative' END AS sentiment, CASE WHEN doc_id % 10 < 7 THEN 'complex' ELSE 'medium' END AS complexity
  FROM documents LEFT JOIN tax ON ordinal = (doc_id * doc_id) % 77)"""


@query("e4_underrepresented_intents", f"WITH {LOPSIDED_SQL}, {RARE_SQL} SELECT ordinal, intent, n, round(share, 6) AS share FROM rare")
def underrepresented(spark, sf):
    return rounded(B.underrepresented(lopsided(spark, sf)))


EN, ES = share_sql("language", "en"), share_sql("language", "es")


@query("e5_language_balance", f"""WITH {_OPEN} SELECT round({EN}, 6) AS en, round({ES}, 6) AS es,
  round(1.0 - {EN} - {ES}, 6) AS other, {EN} >= 0.4 AND {ES} >= 0.4 AS balanced FROM heads""")
def language(spark, sf):
    return rounded(B.language_balance(nested(spark, sf)))


@query("e5_language_balance_documents", f"""SELECT round({share_sql('lang', 'en')}, 6) AS en, round({share_sql('lang', 'es')}, 6) AS es,
  round(1.0 - {share_sql('lang', 'en')} - {share_sql('lang', 'es')}, 6) AS other,
  {share_sql('lang', 'en')} >= 0.4 AND {share_sql('lang', 'es')} >= 0.4 AS balanced FROM documents""")
def language_documents(spark, sf):
    return rounded(B.language_balance(table(spark, sf, "documents").withColumnRenamed("lang", "language")))


@query("e7_resolution_distribution", f"""WITH {_OPEN} SELECT lower(coalesce(resolution_status, 'unknown')) AS status,
  round(count(*) / (SELECT count(*) FROM heads), 6) AS share FROM heads GROUP BY 1""")
def resolution(spark, sf):
    return rounded(B.resolution_distribution(nested(spark, sf)))


@query("e10_topic_coverage", f"""WITH {_OPEN}, {RARE_SQL} SELECT intent, n, round(n / (SELECT count(*) FROM heads), 6) AS share
  FROM counts ORDER BY n DESC, intent LIMIT 10""")
def topics(spark, sf):
    return rounded(B.topic_coverage(nested(spark, sf)))


def detect_sql(heads):
    imb = lambda parts, expected: "greatest(" + ", ".join(f"abs({c} - {expected[v]})" for v, c in parts.items()) + ")"
    return f"""{RARE_SQL.replace('heads', heads)},
  base AS (SELECT count(*) AS n, {', '.join(f'{c} AS s_{v}' for v, c in SENT.items())}, {imb(SENT, B.EXPECTED_SENTIMENT)} AS s_i,
    {', '.join(f'{c} AS c_{v}' for v, c in COMP.items())}, {imb(COMP, B.EXPECTED_COMPLEXITY)} AS c_i,
    {EN} AS en, {ES} AS es, count(DISTINCT x.t_intent) / 77 AS cov FROM {heads} h LEFT JOIN tax x ON x.t_intent = h.intent),
  rares AS (SELECT count(*) AS rn, string_agg(intent, ', ' ORDER BY ordinal) FILTER (pos <= 5) AS r5,
    string_agg(intent, ', ' ORDER BY ordinal) FILTER (pos <= 10) AS r10 FROM (SELECT *, row_number() OVER (ORDER BY ordinal) AS pos FROM rare)),
  flagged AS (SELECT *, (s_i > 0.3)::INT + (cov < 0.1)::INT + (NOT (en >= 0.4 AND es >= 0.4))::INT + (c_i > 0.3)::INT AS broken FROM base, rares),
  bias AS (SELECT *, CASE broken WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS severity,
    concat_ws(' | ',
      CASE WHEN s_i > 0.3 THEN 'Sentiment imbalance detected: ''' || CASE WHEN s_positive >= s_neutral AND s_positive >= s_negative THEN 'positive'
        WHEN s_neutral >= s_negative THEN 'neutral' ELSE 'negative' END || ''' is overrepresented (' ||
        format('{{:.0f}}%', greatest(s_positive, s_neutral, s_negative) * 100) || '). Generate more varied sentiments.' END,
      CASE WHEN cov < 0.1 THEN 'Low intent coverage: only ' || format('{{:.1f}}%', cov * 100) || ' of 77 intents covered. Generate more diverse intents to improve model generalization.'
        WHEN cov < 0.5 THEN 'Intent coverage is ' || format('{{:.1f}}%', cov * 100) || '. Consider generating more samples to cover underrepresented intents.' END,
      CASE WHEN rn > 50 THEN 'Found ' || rn || ' underrepresented intents (< 1% each). Consider targeted generation for: ' || r5 || '...' END,
      CASE WHEN NOT (en >= 0.4 AND es >= 0.4) THEN 'Language imbalance: EN=' || format('{{:.0f}}%', en * 100) || ', ES=' || format('{{:.0f}}%', es * 100)
        || CASE WHEN en > es THEN '. Generate more Spanish conversations.' ELSE '. Generate more English conversations.' END END,
      CASE WHEN c_i > 0.3 THEN 'Complexity imbalance: ''' || CASE WHEN c_simple >= c_medium AND c_simple >= c_complex THEN 'simple'
        WHEN c_medium >= c_complex THEN 'medium' ELSE 'complex' END || ''' is overrepresented (' ||
        format('{{:.0f}}%', greatest(c_simple, c_medium, c_complex) * 100) || '). Balance complexity levels.' END) AS recommendations FROM flagged)"""


def _flat(found):
    return rounded(found.select(
        "conversations", "severity", "bias_detected", "intent_coverage", "sentiment_imbalance", "complexity_imbalance",
        F.col("underrepresented_count").cast("bigint").alias("underrepresented_count"),
        F.array_join("recommendations", " | ").alias("recommendations")))


FLAT_SQL = """SELECT n AS conversations, severity, broken > 0 AS bias_detected, round(cov, 6) AS intent_coverage, round(s_i, 6) AS sentiment_imbalance,
  round(c_i, 6) AS complexity_imbalance, rn AS underrepresented_count, recommendations FROM bias"""


@query("e8_e11_bias", f"WITH {_OPEN}, {detect_sql('heads')} {FLAT_SQL}")
def detect(spark, sf):
    return _flat(B.detect(nested(spark, sf)))


@query("e8_e11_bias_lopsided", f"WITH {LOPSIDED_SQL}, {detect_sql('heads')} {FLAT_SQL}")
def detect_lopsided(spark, sf):
    return _flat(B.detect(lopsided(spark, sf)))


@query("e9_bias_recommendations", f"""WITH {LOPSIDED_SQL}, {detect_sql('heads')} SELECT unnest(string_split(recommendations, ' | ')) AS recommendation FROM bias""")
def recommendations(spark, sf):
    return B.detect(lopsided(spark, sf)).select(F.explode("recommendations").alias("recommendation"))


_TEXTED = "swapped AS (SELECT h.* REPLACE (t.sentiment AS sentiment) FROM heads h JOIN texted t USING (conversation_id))"


@query("e11_bias_text_sentiment", f"WITH {LONG_SQL}, {TEXT_SQL}, {_TEXTED}, {detect_sql('swapped')} {FLAT_SQL}")
def detect_text(spark, sf):
    heads = long_heads(spark, sf)
    return _flat(B.detect(heads, B.text_sentiment(heads, long_turns(spark, sf), lexicon(spark, sf))))


@query("e12_bias_report", f"""WITH {_OPEN}, {detect_sql('heads')} SELECT round(s_positive, 6) AS positive, round(es, 6) AS es, round(c_simple, 6) AS simple,
  coalesce(r10, '') AS underrepresented_intents, broken > 0 AS bias_detected, severity AS bias_severity, n AS num_conversations FROM bias""")
def report(spark, sf):
    r = B.report(B.detect(nested(spark, sf)))
    return rounded(r.select(
        F.element_at("sentiment_distribution", "positive").alias("positive"), F.element_at("language_balance", "es").alias("es"),
        F.element_at("complexity_distribution", "simple").alias("simple"),
        F.array_join("underrepresented_intents", ", ").alias("underrepresented_intents"),
        "bias_detected", "bias_severity", "num_conversations"))


@query("e13_bias_summary", f"""WITH {_OPEN}, {detect_sql('heads')} SELECT severity, concat_ws(' | ',
  CASE WHEN greatest(s_positive, s_neutral, s_negative) > 0.5 THEN 'Sentiment distribution is imbalanced' END,
  CASE WHEN cov < 0.5 THEN 'Low intent coverage: ' || format('{{:.1f}}%', cov * 100) END,
  CASE WHEN greatest(en, es) > 0.8 THEN 'Language distribution is imbalanced' END) AS findings FROM bias""")
def summary(spark, sf):
    r = B.report(B.detect(nested(spark, sf)))
    s = B.summary(r.select(F.col("bias_severity").alias("severity"), "sentiment_distribution", "intent_coverage",
                           F.col("language_balance").alias("language_distribution")))
    return s.select("severity", F.array_join("findings", " | ").alias("findings"))


@query("e14_bias_estimate", f"""WITH {_OPEN}, p AS (SELECT 'sentiment' AS d, coalesce(sentiment, 'unknown') AS v, count(*) AS n FROM heads GROUP BY 2
  UNION ALL SELECT 'language', coalesce(language, 'unknown'), count(*) FROM heads GROUP BY 2
  UNION ALL SELECT 'intent', coalesce(intent, 'unknown'), count(*) FROM heads GROUP BY 2),
  i AS (SELECT sum((d = 'sentiment' AND n / (SELECT count(*) FROM heads) > 0.6)::INT)
    + CASE WHEN sum((d = 'language')::INT) > 1 THEN sum((d = 'language' AND n / (SELECT count(*) FROM heads) > 0.9)::INT) ELSE 0 END
    + (sum((d = 'intent')::INT) < 20)::INT AS issues FROM p)
  SELECT issues::BIGINT AS issues, CASE WHEN issues = 0 THEN 'none' WHEN issues = 1 THEN 'low' WHEN issues = 2 THEN 'medium' ELSE 'high' END AS severity FROM i""")
def estimate(spark, sf):
    return B.estimate_severity(profile(nested(spark, sf)))


@query("e15_intent_coverage_band", f"""WITH {LONG_SQL}, c AS (SELECT count(DISTINCT coalesce(intent, 'unknown')) AS n FROM heads)
  SELECT n AS intents, round(n / 77 * 100, 6) AS coverage, CASE WHEN n / 77 * 100 < 50 THEN 'low' WHEN n / 77 * 100 < 70 THEN 'moderate' ELSE 'good' END AS band FROM c""")
def band(spark, sf):
    return rounded(B.coverage_band(long_heads(spark, sf).select(F.coalesce("intent", F.lit("unknown")).alias("intent"))))


@query("b19_production_gate", """WITH r AS (SELECT c_custkey AS dataset, c_acctbal / 100 AS overall,
    CASE c_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'odd' END AS severity,
    max(o_totalprice) / 500000 AS accuracy FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3)
  SELECT dataset, overall >= 70 AS quality_ok, severity IN ('none', 'low', 'medium') AS bias_ok, coalesce(accuracy, 0) >= 0.7 AS accuracy_ok,
    overall >= 70 AND severity IN ('none', 'low', 'medium') AND coalesce(accuracy, 0) >= 0.7 AS production_ready FROM r""")
def gate(spark, sf):
    best = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        (F.max("o_totalprice") / 500000).alias("accuracy"))
    names = F.array(*[F.lit(x) for x in ("none", "low", "medium", "high", "odd")])
    runs = table(spark, sf, "customer").join(best, "c_custkey", "left").select(
        F.col("c_custkey").alias("dataset"), (F.col("c_acctbal") / 100).alias("overall"),
        F.get(names, (F.col("c_custkey") % 5).cast("int")).alias("severity"), "accuracy")
    return B.production_ready(runs).select("dataset", "quality_ok", "bias_ok", "accuracy_ok", "production_ready")
