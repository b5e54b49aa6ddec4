"""C: plans, prompts, request and response tables, costs. A5-A7, A14: the exchange and resume."""

from pyspark.sql import functions as F

from dialoom.plans import cost, prompts as P, quota, responses as X
from dialoom.session import shared_path
from dialoom.sources import exchange as E
from dialoom.taxonomy import taxonomy
from suite.base import LABEL_SQL, NESTED_SQL, TAX_SQL, nested, query, rounded, table, text_table

N_SQL = "(SELECT count(*) FROM documents)"


def _total(spark, sf):
    """Plans are as long as ``documents``; the count reads the file footers only."""
    return table(spark, sf, "documents").count()


def _marginals(plan, names):
    stacked = F.inline(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("value")) for n in names]))
    return plan.select(stacked).groupBy("dimension", "value").agg(F.count("*").alias("n"))


@query("c1_plan_marginals", f"""WITH {TAX_SQL}, t AS (SELECT {N_SQL} AS n), q AS (
  SELECT 'language' AS dimension, 'en' AS value, floor(n * 50 / 100) AS n FROM t UNION ALL SELECT 'language', 'es', n - floor(n * 50 / 100) FROM t
  UNION ALL SELECT 'sentiment', 'positive', floor(n * 30 / 100) FROM t UNION ALL SELECT 'sentiment', 'neutral', floor(n * 50 / 100) FROM t
  UNION ALL SELECT 'sentiment', 'negative', n - floor(n * 30 / 100) - floor(n * 50 / 100) FROM t
  UNION ALL SELECT 'complexity', 'simple', floor(n * 30 / 100) FROM t UNION ALL SELECT 'complexity', 'medium', floor(n * 50 / 100) FROM t
  UNION ALL SELECT 'complexity', 'complex', n - floor(n * 30 / 100) - floor(n * 50 / 100) FROM t
  UNION ALL SELECT 'intent', t_intent, n // 77 + (ordinal < n % 77)::INT FROM t, tax)
  SELECT dimension, value, n::BIGINT AS n FROM q""")
def plan_marginals(spark, sf):
    return _marginals(quota.generation_plan(spark, _total(spark, sf)), ["language", "sentiment", "complexity", "intent"])


@query("c1_plan_like_table", """WITH s AS (SELECT 'language' AS dimension, lang AS value, count(*) AS c FROM documents GROUP BY ALL
    UNION ALL SELECT 'sentiment', source, count(*) FROM documents GROUP BY ALL),
  t AS (SELECT count(*) AS every, count(*) * 3 // 2 + 7 AS n FROM documents),
  f AS (SELECT dimension, value, n * c // every AS q, row_number() OVER (PARTITION BY dimension ORDER BY value DESC) AS r FROM s, t)
  SELECT dimension, value, CASE r WHEN 1 THEN (SELECT n FROM t) - (SELECT coalesce(sum(q), 0) FROM f g WHERE g.dimension = f.dimension AND r > 1) ELSE q END::BIGINT AS n FROM f""")
def plan_like_table(spark, sf):
    """A plan one and a half times as long as ``documents`` in the shares observed there."""
    docs = table(spark, sf, "documents")
    like = quota.observed(docs, language="lang", sentiment="source")
    plan = quota.generation_plan(spark, _total(spark, sf) * 3 // 2 + 7, like=like)
    return _marginals(plan, ["language", "sentiment"]).filter("n > 0")


@query("c4_missing_plan", f"""WITH {NESTED_SQL}, h AS (SELECT intent, count(*) AS n FROM heads GROUP BY 1)
  SELECT t_intent AS intent, t_category AS category, 12 - coalesce(n, 0) AS n FROM tax LEFT JOIN h ON intent = t_intent WHERE coalesce(n, 0) < 12""")
def missing(spark, sf):
    """What the labelled documents lack until every intent has twelve."""
    return quota.missing_plan(nested(spark, sf), 12).groupBy("intent", "category").agg(F.count("*").alias("n"))


@query("c1_plan_rows", f"""WITH {TAX_SQL} SELECT range AS plan_id, t_intent AS intent, t_category AS category
  FROM range({N_SQL}) JOIN tax ON ordinal = range % 77""")
def plan_rows(spark, sf):
    return quota.generation_plan(spark, _total(spark, sf)).select("plan_id", "intent", "category")


@query("c2_weighted_choice", """WITH u AS (SELECT event_id, event_id * 7919 % 10007 / 10007 AS u FROM events)
  SELECT event_id, CASE WHEN u < 0.25 THEN 'positive' WHEN u < 0.7 THEN 'neutral' ELSE 'negative' END AS sentiment,
    CASE WHEN u < 0.4 THEN 'simple' WHEN u < 0.8 THEN 'medium' ELSE 'complex' END AS complexity FROM u""")
def weighted_choice(spark, sf):
    from dialoom.functions.dims import weighted_choice as choose
    u = F.col("event_id") * 7919 % 10007 / 10007
    return table(spark, sf, "events").select(
        "event_id", choose(u, quota.DRAW_WEIGHTS["sentiment"]).alias("sentiment"),
        choose(u, quota.DRAW_WEIGHTS["complexity"]).alias("complexity"))


@query("c2_drawn_parameters", """SELECT 'sentiment' AS dimension, true AS close FROM documents GROUP BY 1
  UNION ALL SELECT 'complexity', true FROM documents GROUP BY 1 UNION ALL SELECT 'language', true FROM documents GROUP BY 1""")
def drawn(spark, sf):
    """Every drawn share lies within 7 points of its weight."""
    rows = quota.draw_parameters(table(spark, sf, "documents").select("doc_id"), "doc_id")
    parts = []
    for name in ("sentiment", "complexity", "language"):
        far = F.greatest(*[F.abs(F.avg((F.col(name) == v).cast("double")) - w) for v, w in quota.DRAW_WEIGHTS[name].items()])
        parts.append(rows.agg((far < 0.07).alias("close")).select(F.lit(name).alias("dimension"), "close"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("c3_intent_cycle", """SELECT doc_id, (['card_arrival', 'exchange_rate', 'age_limit'])[1 + doc_id % 3] AS intent FROM documents""")
def cycle(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", quota.cycled(F.col("doc_id"), ["card_arrival", "exchange_rate", "age_limit"]).alias("intent"))


@query("c4_balanced_plan", f"""WITH {TAX_SQL}, t AS (SELECT {N_SQL} AS n) SELECT t_intent AS intent, greatest(1, n // 77) + (ordinal < n - 77 * greatest(1, n // 77))::INT AS n
  FROM tax, t""")
def balanced(spark, sf):
    return quota.balanced_plan(spark, _total(spark, sf)).groupBy("intent").agg(F.count("*").alias("n"))


def _labels_plan(spark, sf):
    """A plan whose labels follow from the row number, so that its prompts have an SQL twin."""
    tax = taxonomy(spark).select(F.col("ordinal").cast("bigint").alias("o"), "intent", "category")
    k = F.col("plan_id")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("plan_id")).join(F.broadcast(tax), k % 77 == F.col("o")).select(
        "plan_id", "intent", "category", F.when(k % 2 == 0, "en").otherwise("es").alias("language"),
        F.when(k % 3 == 0, "positive").when(k % 3 == 1, "neutral").otherwise("negative").alias("sentiment"),
        F.when(k % 4 == 0, "simple").when(k % 4 == 1, "medium").otherwise("complex").alias("complexity"),
        F.when(k % 5 == 0, "stable_neutral").alias("emotion_arc"), F.when(k % 7 == 0, "refund pending").alias("context"))


W = P.Wording(requirements=("Name one product of the bank", "End with a question or a thank you"), arcs={"stable_neutral": "even all the way"})
_RULES = "".join(f"\n{i}. {r}" for i, r in enumerate(W.requirements, 1)) + f"\n{len(W.requirements) + 1}. Write in "
_L = {n: f"CASE language WHEN 'es' THEN '{P.LABEL_NAMES['es'][n]}' ELSE '{P.LABEL_NAMES['en'][n]}' END" for n in P.LABEL_NAMES["en"]}
PLAN_SQL = f"""{TAX_SQL}, plan AS (SELECT doc_id AS plan_id, t_intent AS intent, t_category AS category,
    CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'es' END AS language, CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS sentiment,
    CASE doc_id % 4 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END AS complexity,
    CASE WHEN doc_id % 5 = 0 THEN 'stable_neutral' END AS arc, CASE WHEN doc_id % 7 = 0 THEN 'refund pending' END AS context
  FROM documents JOIN tax ON ordinal = doc_id % 77),
prompted AS (SELECT *, '{W.opening}' || chr(10) || chr(10) || 'Intent: ' || intent || chr(10) || {_L['category']} || ': ' || category
  || chr(10) || {_L['sentiment']} || ': ' || sentiment || chr(10) || {_L['complexity']} || ': ' || complexity || chr(10) || {_L['turns']} || ': '
  || CASE complexity WHEN 'simple' THEN '2-4' WHEN 'medium' THEN '4-6' ELSE '6-10' END
  || coalesce(chr(10) || 'Emotion arc: ' || arc || ' - {W.arcs['stable_neutral']}', '') || coalesce(chr(10) || 'Additional context: ' || context, '')
  || chr(10) || chr(10) || {_L['requirements']} || ':' || '{_RULES}' || CASE language WHEN 'en' THEN 'English' ELSE 'Spanish' END
  || chr(10) || chr(10) || {_L['output']} || ': {W.closing}' || chr(10)
  || '{{"conversation_id": "conv_XXX", "intent": "' || intent || '", "category": "' || category || '", "sentiment": "' || sentiment
  || '", "complexity": "' || complexity || '", "language": "' || language || '", "turn_count": <number>, "customer_emotion_arc": "<arc_type>", '
  || '"resolution_time_category": "quick|standard|extended", "resolution_status": "resolved|escalated|unresolved", '
  || '"turns": [{{"speaker": "customer", "text": "..."}}, {{"speaker": "agent", "text": "..."}}]}}' AS prompt FROM plan)"""


@query("c5_prompts", f"WITH {PLAN_SQL} SELECT plan_id, prompt FROM prompted")
def prompts(spark, sf):
    return P.with_prompt(_labels_plan(spark, sf), W).select("plan_id", "prompt")


LABELLED_SQL = f"""ids AS (SELECT doc_id AS k, text FROM documents),
labelled AS (SELECT 'conv_' || lpad(CAST(k AS VARCHAR), 12, '0') AS conversation_id, text, {LABEL_SQL['language']} AS language,
  {LABEL_SQL['sentiment']} AS sentiment, {LABEL_SQL['complexity']} AS complexity FROM ids),
ranked AS (SELECT *, row_number() OVER (PARTITION BY language, sentiment, complexity ORDER BY conversation_id) AS r FROM labelled
  WHERE language IS NOT NULL AND sentiment IS NOT NULL AND complexity IS NOT NULL),
texts AS (SELECT language, sentiment, complexity, string_agg('Example ' || r || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY r) AS examples
  FROM ranked WHERE r <= 2 GROUP BY 1, 2, 3)"""


def _examples(spark, sf):
    return nested(spark, sf).select("k", "conversation_id", "language", "sentiment", "complexity").join(
        table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("example")), "k")


@query("c6_prompts_with_examples", f"""WITH {PLAN_SQL}, {LABELLED_SQL} SELECT plan_id, md5('{W.examples}' || chr(10) || chr(10) || coalesce(examples, '') || chr(10) || chr(10)
  || '{W.then}' || chr(10) || chr(10) || prompt) AS prompt_md5, CASE language WHEN 'en' THEN '{W.system['en']}' ELSE '{W.system['es']}' END AS system
  FROM prompted LEFT JOIN texts USING (language, sentiment, complexity)""")
def prompts_with_examples(spark, sf):
    out = P.with_examples(_labels_plan(spark, sf), _examples(spark, sf), words=W)
    return out.select("plan_id", F.md5("prompt").alias("prompt_md5"), "system")


@query("c7_batch_prompts", f"""WITH {PLAN_SQL}, n AS (SELECT *, plan_id // 8 AS batch_id, row_number() OVER (PARTITION BY language, plan_id // 8 ORDER BY plan_id) AS i FROM plan)
  SELECT language, batch_id, count(*) AS specifications, 'Write ' || count(*) || ' {W.batch_opening}' || chr(10) || chr(10)
    || string_agg(i || '. Intent: ' || intent || ', Sentiment: ' || sentiment || ', Complexity: ' || complexity, chr(10) ORDER BY i)
    || chr(10) || chr(10) || 'Language: ' || CASE language WHEN 'en' THEN 'English' ELSE 'Spanish' END || chr(10) || chr(10) || '{W.batch_closing}' || chr(10)
    || '{{"conversation_id": "conv_XXX", "intent": "...", "category": "...", "sentiment": "...", "complexity": "...", "language": "' || language
    || '", "turn_count": <number>, "customer_emotion_arc": "...", "resolution_time_category": "...", "resolution_status": "...", "turns": [...]}}' AS prompt
  FROM n GROUP BY language, batch_id""")
def batch_prompts(spark, sf):
    return P.batch_prompts(_labels_plan(spark, sf), 8).withColumn("specifications", F.col("specifications").cast("bigint"))


@query("c8_prepared_prompts", f"""SELECT range AS record_index, (['card_arrival', 'age_limit'])[1 + range % 2] AS intent, 'es' AS language, '{W.system['es']}' AS system
  FROM range({N_SQL})""")
def prepared(spark, sf):
    made = P.prepare(spark, _total(spark, sf), _examples(spark, sf), "es", ["card_arrival", "age_limit"])
    return made.select("record_index", "intent", "language", "system")


@query("c9_requests", f"""WITH {PLAN_SQL} SELECT plan_id::VARCHAR AS record_id, '{{"recordId":"' || plan_id || '","modelInput":{{"anthropic_version":"bedrock-2023-05-31","max_tokens":2000,"temperature":0.7,"top_p":0.9,"messages":[{{"role":"user","content":'
  || to_json(prompt) || '}}],"system":"S"}}}}' AS line, intent FROM prompted""")
def requests(spark, sf):
    made = _requests(spark, sf)
    return made.select(F.col("recordId").alias("record_id"), F.to_json(F.struct("recordId", "modelInput")).alias("line"), "intent")


def _requests(spark, sf):
    plan = P.with_prompt(_labels_plan(spark, sf), W).withColumn("system", F.lit("S"))
    return E.requests(plan.select("plan_id", "intent", "prompt", "system"), F.col("plan_id"))


@query("a5_request_file", f"""WITH {PLAN_SQL} SELECT '{{"recordId":"' || plan_id || '","modelInput":{{"anthropic_version":"bedrock-2023-05-31","max_tokens":2000,"temperature":0.7,"top_p":0.9,"messages":[{{"role":"user","content":'
  || to_json(prompt) || '}}],"system":"S"}}}}' AS line FROM prompted""")
def request_file(spark, sf):
    """Every written line, read back as text."""
    path = shared_path(spark, "requests")
    E.write_requests(_requests(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# ---------------------------------------------------------------- responses

def response_lines(spark, sf):
    """One response line per conversation turn; ``m`` says which fault it carries."""
    rows = text_table(spark, sf, "conversations").withColumns({
        "rid": F.concat_ws("-", "conv_id", "turn"), "m": ((F.col("conv_id") * 7 + F.col("turn")) % 11).cast("int")})
    m = F.col("m")
    inner = F.to_json(F.struct(
        F.when(m % 3 == 0, "conv_XXX").when(m % 3 == 2, F.concat(F.lit("conv_"), "rid")).alias("conversation_id"),
        F.when(F.col("turn") % 2 == 1, "card_arrival").alias("intent"), F.when(m == 2, "positive").alias("sentiment"),
        F.array(F.struct(F.lit("customer").alias("speaker"), F.col("text")),
                F.struct(F.lit("agent").alias("speaker"), F.lit("ok").alias("text"))).alias("turns")))
    fence = F.lit("```")
    nl = F.lit("\n")
    text = (F.when(m == 1, F.concat(fence, F.lit("json"), nl, inner, nl, fence)).when(m == 2, F.concat(fence, nl, inner, nl, fence))
            .when(m == 3, F.concat(F.lit("Here it is: "), inner, F.lit(" Done."))).when(m == 4, F.expr("substring(_i, 1, length(_i) - 1)"))
            .when(m == 7, F.concat(inner, inner)).when(m == 9, F.lit(""))
            .when(m == 10, F.concat(fence, F.lit("json"), nl, F.lit("["), inner, F.lit("]"), nl, fence)).otherwise(inner))
    rows = rows.withColumn("_i", inner).withColumn("gen", text)
    content = F.when(m == 8, F.array().cast("array<struct<text:string>>")).otherwise(F.array(F.struct(F.col("gen").alias("text"))))
    good = F.to_json(F.struct(F.col("rid").alias("recordId"), F.struct(content.alias("content")).alias("modelOutput")))
    failed = F.to_json(F.struct(F.col("rid").alias("recordId"), F.lit("Throttled: too many requests sent to this one model").alias("error")))
    line = F.when(m == 5, failed).when(m == 6, F.concat(F.lit("garbage "), F.translate("text", "\n", " "))).otherwise(good)
    return rows.select(line.alias("value"), "rid", "m")


RESPONSE_SQL = """r AS (SELECT conv_id || '-' || turn AS rid, (conv_id * 7 + turn) % 11 AS m, conv_id, turn, text FROM conversations)"""


def _results(spark, sf):
    return E.results(E.parse_lines(response_lines(spark, sf)))


def _response_plan(spark, sf):
    tax = taxonomy(spark).select(F.col("ordinal").cast("bigint").alias("o"), "intent")
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf, "conversations").join(F.broadcast(tax), c % 77 == F.col("o")).select(
        F.concat_ws("-", c, t).alias("recordId"), F.when(c % 5 != 0, F.col("intent")).alias("intent"),
        F.when(t % 2 == 1, "negative").alias("sentiment"), F.when(c % 2 == 1, "simple").alias("complexity"),
        F.when(c % 3 == 0, "es").alias("language"))


PLANNED_SQL = f"""{TAX_SQL}, {RESPONSE_SQL}, planned AS (SELECT r.*, CASE WHEN conv_id % 5 <> 0 THEN t_intent END AS p_intent, CASE WHEN conv_id % 5 <> 0 THEN t_category END AS p_category,
  CASE WHEN turn % 2 = 1 THEN 'negative' END AS p_sentiment, CASE WHEN conv_id % 2 = 1 THEN 'simple' END AS p_complexity, CASE WHEN conv_id % 3 = 0 THEN 'es' END AS p_language,
  CASE WHEN turn % 2 = 1 THEN 'card_arrival' END AS g_intent, CASE WHEN m = 2 THEN 'positive' END AS g_sentiment
  FROM r JOIN tax ON ordinal = conv_id % 77)"""


@query("a6_c10_parsed_lines", f"""WITH {RESPONSE_SQL} SELECT CASE WHEN m <> 6 THEN rid END AS record_id,
  CASE m WHEN 5 THEN 'Throttled: too many requests sent to this one model' WHEN 6 THEN 'JSON parse error' END AS error,
  CASE WHEN m = 6 THEN substr('garbage ' || replace(text, chr(10), ' '), 1, 200) END AS raw_line, m NOT IN (5, 6, 8) AS has_text FROM r""")
def parsed_lines(spark, sf):
    p = E.parse_lines(response_lines(spark, sf).drop("rid", "m"))
    return p.select("record_id", "error", "raw_line", F.col("generated_text").isNotNull().alias("has_text"))


@query("a7_response_files", f"""WITH {RESPONSE_SQL} SELECT 'part-' || m % 3 AS name, sum((m NOT IN (5, 6))::INT)::BIGINT AS ok, sum((m IN (5, 6))::INT)::BIGINT AS failed
  FROM r GROUP BY 1""")
def response_files(spark, sf):
    """Three folders of response files read as one; the errors of all files are kept."""
    root = shared_path(spark, "responses")
    lines = response_lines(spark, sf)
    paths = [f"{root}/part-{i}" for i in range(3)]
    for i, path in enumerate(paths):
        lines.filter(F.col("m") % 3 == i).select("value").write.text(path)
    parsed = E.parse_lines(E.read_lines(spark, paths))
    return parsed.groupBy(F.regexp_extract("file", "/(part-[0-2])/", 1).alias("name")).agg(
        F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))


@query("c11_json_in_text", f"""WITH {RESPONSE_SQL} SELECT rid AS record_id, CASE WHEN m IN (0, 1, 2, 3) THEN 'object' WHEN m IN (4, 10) THEN 'array' END AS kind
  FROM r WHERE m NOT IN (5, 6)""")
def json_in_text(spark, sf):
    found = X.json_in(F.col("generated_text"))
    kind = F.when(found.startswith("{"), "object").when(found.startswith("["), "array")
    return _results(spark, sf).select("record_id", kind.alias("kind"))


@query("c12_extracted", f"""WITH {PLANNED_SQL} SELECT rid AS record_id, CASE WHEN m = 0 THEN 'conv_XXX' WHEN m = 2 THEN 'conv_' || rid END AS conversation_id,
  coalesce(p_intent, g_intent) AS intent, coalesce(p_sentiment, g_sentiment) AS sentiment, p_complexity AS complexity, p_language AS language, text AS first_text
  FROM planned WHERE m IN (0, 1, 2)""")
def extracted(spark, sf):
    out = X.extract(_results(spark, sf), _response_plan(spark, sf))
    return out.select("record_id", "conversation_id", "intent", "sentiment", "complexity", "language",
                      F.get("turns", F.lit(0))["text"].alias("first_text"))


@query("c12_extract_errors", f"""WITH {RESPONSE_SQL} SELECT rid AS record_id, 'JSON parse error' AS error FROM r WHERE m IN (3, 4, 7, 10)""")
def extract_errors(spark, sf):
    return X.extract_errors(_results(spark, sf)).select("record_id", "error")


@query("c13_processed", f"""WITH {PLANNED_SQL} SELECT rid AS record_id, CASE WHEN m = 2 THEN 'conv_' || rid ELSE 'conv_' || substr(sha256(rid), 1, 12) END AS conversation_id,
  coalesce(g_intent, p_intent, 'general_inquiry') AS intent, coalesce(p_category, 'general') AS category, coalesce(g_sentiment, p_sentiment, 'neutral') AS sentiment,
  coalesce(p_complexity, 'medium') AS complexity, coalesce(p_language, 'en') AS language, 2::BIGINT AS turn_count,
  CASE p_sentiment WHEN 'negative' THEN 'frustrated_to_satisfied' ELSE 'stable_neutral' END AS customer_emotion_arc,
  CASE p_complexity WHEN 'simple' THEN 'quick' ELSE 'standard' END AS resolution_time_category, 'resolved' AS resolution_status, rid AS source_record
  FROM planned WHERE m IN (0, 1, 2)""")
def processed(spark, sf):
    out = X.process(_results(spark, sf), _response_plan(spark, sf))
    return out.withColumn("source_record", F.element_at("metadata", "record_id"))\
        .withColumn("turn_count", F.col("turn_count").cast("bigint")).drop("turns", "metadata")


@query("c14_error_summary", f"""WITH {RESPONSE_SQL} SELECT CASE m WHEN 5 THEN substr('Throttled: too many requests sent to this one model', 1, 50) ELSE 'JSON parse error' END AS error_type,
  count(*) AS n FROM r WHERE m IN (5, 6) GROUP BY 1""")
def error_summary(spark, sf):
    return X.error_summary(E.errors(E.parse_lines(response_lines(spark, sf))))


@query("c15_run_metrics", f"""WITH {RESPONSE_SQL} SELECT sum((m IN (0, 1, 2))::INT)::BIGINT AS generated, sum((m IN (3, 4, 7, 10))::INT)::BIGINT AS failed,
  round(sum((m IN (0, 1, 2))::INT) / count(*), 6) AS success_rate FROM r WHERE m NOT IN (5, 6, 8, 9)""")
def run_metrics(spark, sf):
    return rounded(X.run_metrics(_results(spark, sf)))


# ---------------------------------------------------------------- cost

_FIELDS = ["conversation_id", *[n for n in LABEL_SQL]]


@query("c16_generation_cost", f"""WITH {NESTED_SQL}, spoken AS (SELECT conversation_id, count(*) AS nt, sum(length(text)) AS chars,
    string_agg('{{' || concat_ws(',', '"speaker":' || to_json(speaker), '"text":' || to_json(text)) || '}}', ',' ORDER BY turn_idx) AS js FROM turns GROUP BY 1),
  rec AS (SELECT nt, coalesce(chars, 0) + length('{{' || concat_ws(',', {', '.join(f"'\"{f}\":' || to_json({f})" for f in _FIELDS)}, '"turns":[' || js || ']') || '}}') AS chars
    FROM heads LEFT JOIN spoken USING (conversation_id)),
  s AS (SELECT count(*) AS n, sum(nt) AS t, sum(chars) AS chars FROM rec), k AS (SELECT *, n * 500 AS ti, floor(chars / 4) AS tok FROM s)
  SELECT n AS conversations, t::BIGINT AS total_turns, ti AS input_tokens, tok::BIGINT AS output_tokens, (ti + tok)::BIGINT AS total_tokens,
    round(ti / 1000 * 0.003, 6) AS input_cost_usd, round(tok / 1000 * 0.015, 6) AS output_cost_usd, round(ti / 1000 * 0.003 + tok / 1000 * 0.015, 6) AS total_cost_usd,
    round((ti / 1000 * 0.003 + tok / 1000 * 0.015) / n, 6) AS cost_per_item_usd FROM k""")
def generation_cost(spark, sf):
    return rounded(cost.generation_cost(nested(spark, sf).drop("k")))


@query("c17_plan_estimate", """WITH p AS (SELECT event_type, user_id % 10 AS g, count(*) AS items, 5 AS delay FROM events GROUP BY 1, 2)
  SELECT event_type, g, items, round(items * 0.003::DOUBLE, 6) AS cost_usd, items * 6.0::DOUBLE AS seconds,
    CASE WHEN items <= 100 THEN 5 WHEN items <= 500 THEN 15 WHEN items <= 1000 THEN 25 WHEN items <= 2000 THEN 45 ELSE floor(items / 1000 * 25) END::BIGINT AS batch_minutes FROM p""")
def plan_estimate(spark, sf):
    plans = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 10).alias("g")).agg(F.count("*").alias("items"))
    return rounded(cost.plan_estimate(plans.withColumn("delay", F.lit(5))).drop("delay"))


CALLS_SQL = """calls AS (SELECT (user_id % 4)::DOUBLE AS delay, NOT (event_type = 'error' AND user_id % 4 < 2) AS ok, value / 10 AS seconds FROM events),
rates AS (SELECT delay, sum(ok::INT)::BIGINT AS s, sum((NOT ok)::INT)::BIGINT AS f, coalesce(avg(CASE WHEN ok THEN seconds END), 0) AS lat FROM calls GROUP BY 1),
tp AS (SELECT *, s / (s + f) AS rate, 60 / (lat + delay) AS rpm FROM rates)"""


def _calls(spark, sf):
    d = (F.col("user_id") % 4)
    return table(spark, sf, "events").select(
        d.cast("double").alias("delay"), (~((F.col("event_type") == "error") & (d < 2))).alias("ok"), (F.col("value") / 10).alias("seconds"))


@query("c18_throughput", f"""WITH {CALLS_SQL} SELECT delay, s AS successes, f AS failures, round(lat, 6) AS avg_response_time, round(rate, 6) AS success_rate,
  round(rpm, 6) AS effective_rpm, round(rpm * rate, 6) AS effective_rpm_adjusted FROM tp""")
def throughput(spark, sf):
    return rounded(cost.throughput(_calls(spark, sf)))


@query("c18_best_delay", f"""WITH {CALLS_SQL} SELECT delay, round(rate, 6) AS success_rate, round(rpm, 6) AS effective_rpm, round(rpm * rate, 6) AS effective_rpm_adjusted
  FROM tp ORDER BY rate >= 0.8 DESC, CASE WHEN rate >= 0.8 THEN rpm * rate ELSE rate END DESC, delay LIMIT 1""")
def best_delay(spark, sf):
    return rounded(cost.best_delay(cost.throughput(_calls(spark, sf))))


@query("c19_language_split", """WITH t AS (SELECT count(*) AS n, (SELECT round(100 * avg((lang = 'en')::INT)) FROM documents) AS p FROM conversations),
  e AS (SELECT n, floor(n * p / 100)::BIGINT AS en FROM t)
  SELECT 'language' AS dimension, 'en' AS value, en AS n FROM e UNION ALL SELECT 'language', 'es', n - en FROM e""")
def language_split(spark, sf):
    """As long as ``conversations``, with the share of English that ``documents`` has."""
    share = table(spark, sf, "documents").agg(F.round(100 * F.avg((F.col("lang") == "en").cast("int")))).first()[0]
    return _marginals(quota.language_split(spark, table(spark, sf, "conversations").count(), share), ["language"])


@query("a14_remaining_plan", f"""SELECT doc_id AS plan_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def remaining(spark, sf):
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("plan_id"))
    plan = table(spark, sf, "documents").select(F.col("doc_id").alias("plan_id"))
    return quota.remaining(plan, done)
