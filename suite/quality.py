"""D: quality scores."""

from pyspark.sql import functions as F

from dialoom.functions.dims import to_row
from dialoom.operators import quality as Q
from suite.base import (LONG_FACTS, LONG_SQL, NESTED_FACTS, NESTED_SQL, REFERENCE_SQL, WORD_SQL, long_corpus,
                        long_heads, long_turns, nested, nested_corpus, nested_facts, query, reference_examples,
                        rounded, table)

S_OK = "coalesce(sentiment IN ('positive','neutral','negative'), false)"
R_OK = "coalesce(resolution_status IN ('resolved','escalated','unresolved'), false)"
CHECKS_SQL = f"""checks AS (SELECT f.*, n_turns >= 2 AS c1, coalesce(first_speaker = 'customer', false) AS c2,
  longest_run <= 2 AS c3, {S_OK} AS c4, {R_OK} AS c5, x.t_intent IS NOT NULL AS c6
  FROM facts f LEFT JOIN tax x ON x.t_intent = f.intent)"""
COMPLETE_SQL = """complete AS (SELECT 5 * count(*) + 2 * sum(n_turns) AS total,
  sum((conversation_id IS NOT NULL)::INT + (intent IS NOT NULL)::INT + (sentiment IS NOT NULL)::INT
    + turns_given::INT + (resolution_status IS NOT NULL)::INT + filled_speakers + filled_texts) AS passed FROM facts)"""


def _complete(corpus):
    row = to_row([Q.completeness(corpus.facts)], ["total_checks", "passed_checks", "completeness"])
    return rounded(row)


for _name, _corpus, _facts in (("d1_completeness", long_corpus, LONG_FACTS),
                               ("d1_completeness_nested", nested_corpus, NESTED_FACTS)):
    query(_name, f"""WITH {_facts}, {COMPLETE_SQL}
      SELECT total::DOUBLE AS total_checks, passed::DOUBLE AS passed_checks, round(passed / total, 6) AS completeness FROM complete""")(
        lambda spark, sf, c=_corpus: _complete(c(spark, sf)))


@query("d1_missing_fields", f"""WITH {NESTED_FACTS}, m AS (SELECT
  sum((conversation_id IS NULL)::INT) AS a, sum((intent IS NULL)::INT) AS b, sum((sentiment IS NULL)::INT) AS c,
  sum((NOT turns_given)::INT) AS d, sum((resolution_status IS NULL)::INT) AS e,
  sum(n_turns - filled_speakers) AS f, sum(n_turns - filled_texts) AS g FROM facts)
  SELECT unnest(['conversation_id','intent','sentiment','turns','resolution_status','turn.speaker','turn.text']) AS field,
    unnest([a, b, c, d, e, f, g])::BIGINT AS missing FROM m""")
def missing_fields(spark, sf):
    return Q.missing_fields(nested_facts(spark, sf))


@query("d2_completeness_examples", f"""WITH {NESTED_FACTS}, gaps AS (
  SELECT conversation_id, 'intent' AS field FROM facts WHERE intent IS NULL
  UNION ALL SELECT conversation_id, 'sentiment' FROM facts WHERE sentiment IS NULL
  UNION ALL SELECT conversation_id, 'turns' FROM facts WHERE NOT turns_given
  UNION ALL SELECT conversation_id, 'resolution_status' FROM facts WHERE resolution_status IS NULL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY conversation_id) AS rank FROM gaps)
  SELECT field, conversation_id, rank, 'Conv ' || conversation_id || ': Missing field ''' || field || '''' AS message
  FROM ranked WHERE rank <= 3""")
def completeness_examples(spark, sf):
    return Q.completeness_examples(nested_facts(spark, sf))


def _consistent(corpus):
    return rounded(to_row([Q.consistency(corpus.facts)], ["structural_checks", "structural_passed", "consistency"]))


for _name, _corpus, _facts in (("d3_consistency", long_corpus, LONG_FACTS),
                               ("d3_consistency_nested", nested_corpus, NESTED_FACTS)):
    query(_name, f"""WITH {_facts}, {CHECKS_SQL}, s AS (SELECT 6 * count(*) AS total,
      sum(c1::INT + c2::INT + c3::INT + c4::INT + c5::INT + c6::INT) AS passed FROM checks)
      SELECT total::DOUBLE AS structural_checks, passed::DOUBLE AS structural_passed, round(passed / total, 6) AS consistency FROM s""")(
        lambda spark, sf, c=_corpus: _consistent(c(spark, sf)))


@query("d3_consistency_flags", f"""WITH {LONG_FACTS}, {CHECKS_SQL} SELECT conversation_id, c1 AS min_turns,
  c2 AS first_speaker, c3 AS alternation, c4 AS sentiment, c5 AS resolution, c6 AS intent FROM checks""")
def consistency_flags(spark, sf):
    return Q.consistency_flags(long_corpus(spark, sf).facts)


for _name, _corpus, _facts in (("d4_speaker_runs", long_corpus, LONG_FACTS),
                               ("d4_speaker_runs_nested", nested_corpus, NESTED_FACTS)):
    query(_name, f"""WITH {_facts} SELECT conversation_id, longest_run::BIGINT AS longest_run, longest_run <= 2 AS alternates FROM facts""")(
        lambda spark, sf, c=_corpus: c(spark, sf).facts.select(
            "conversation_id", "longest_run", (F.col("longest_run") <= 2).alias("alternates")))


ISSUE_ROWS_SQL = """issues AS (
  SELECT conversation_id, 'min_turns' AS rule, 'issue' AS severity, 'Only ' || n_turns || ' turns (need >=2)' AS m FROM checks WHERE NOT c1
  UNION ALL SELECT conversation_id, 'first_speaker', 'issue', 'First turn not from customer' FROM checks WHERE NOT c2
  UNION ALL SELECT conversation_id, 'alternation', 'warning', 'Non-alternating speaker pattern' FROM checks WHERE NOT c3
  UNION ALL SELECT conversation_id, 'sentiment', 'issue', 'Invalid sentiment ''' || coalesce(sentiment, 'None') || '''' FROM checks WHERE NOT c4
  UNION ALL SELECT conversation_id, 'resolution', 'warning', 'Invalid resolution ''' || coalesce(resolution_status, 'None') || '''' FROM checks WHERE NOT c5
  UNION ALL SELECT conversation_id, 'intent', 'warning', 'Unknown intent ''' || coalesce(intent, 'None') || '''' FROM checks WHERE NOT c6)"""
ISSUES_SQL = f"{CHECKS_SQL}, {ISSUE_ROWS_SQL}"


@query("d5_consistency_issues", f"""WITH {NESTED_FACTS}, {ISSUES_SQL}
  SELECT conversation_id, rule, severity, 'Conv ' || conversation_id || ': ' || m AS message FROM issues""")
def consistency_issues(spark, sf):
    return Q.consistency_issues(nested_facts(spark, sf))


@query("d5_issue_counts", f"""WITH {LONG_FACTS}, {ISSUES_SQL} SELECT rule, severity, count(*) AS n FROM issues GROUP BY 1, 2""")
def issue_counts(spark, sf):
    return Q.issue_counts(Q.consistency_issues(long_corpus(spark, sf).facts))


def _pairs(spark, sf):
    """Vector 2i is the first question, vector 2i+1 the first answer of conversation i."""
    e = table(spark, sf, "embeddings")
    side = lambda r, n: e.filter(F.col("vec_id") % 2 == r).select(
        F.floor(F.col("vec_id") / 2).alias("pair_id"), F.col("embedding").alias(n))
    return side(0, "customer_vec").join(side(1, "agent_vec"), "pair_id", "left")


PAIRS_SQL = """pairs AS (SELECT a.vec_id // 2 AS pair_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
sims AS (SELECT pair_id, list_cosine_similarity(x, y) AS s FROM pairs),
coh AS (SELECT pair_id, CASE WHEN s IS NULL THEN 0.5 WHEN s BETWEEN 0.2 AND 0.9 THEN least(1.0, s + 0.3)
  ELSE greatest(0.3, s) END AS coherence FROM sims)"""


@query("d6_coherence", f"WITH {PAIRS_SQL} SELECT pair_id, round(coherence, 6) AS coherence FROM coh")
def coherence(spark, sf):
    return rounded(Q.coherence(_pairs(spark, sf)).select("pair_id", "coherence"))


# one vector per first message: the bits of a hash of each term's bucket are the signs of its weight
TEXT_VECTORS = f"""{LONG_FACTS}, said AS (SELECT conversation_id, speaker AS side, text FROM turns WHERE speaker IN ('customer', 'agent')
    QUALIFY row_number() OVER (PARTITION BY conversation_id, speaker ORDER BY turn_idx) = 1),
  cut AS (SELECT *, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM said WHERE text IS NOT NULL),
  terms AS (SELECT conversation_id, side, CAST('0x' || substr(md5(t), 1, 4) AS INT) AS b FROM (SELECT conversation_id, side,
    unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM cut)),
  idf AS (SELECT b, ln((1 + (SELECT count(*) FROM cut)) / (1 + count(DISTINCT (conversation_id, side)))) + 1 AS idf FROM terms GROUP BY b),
  tf AS (SELECT conversation_id, side, b, count(*) * any_value(idf) AS w, md5('13:' || b) AS h FROM terms JOIN idf USING (b) GROUP BY ALL),
  dims AS (SELECT conversation_id, side, i, sum(CASE WHEN ((strpos('0123456789abcdef', substr(h, i // 4 + 1, 1)) - 1) >> (3 - i % 4)) & 1 = 1 THEN w ELSE -w END) / sqrt(128.0) AS x
    FROM tf, (SELECT unnest(range(128)) AS i) GROUP BY ALL),
  sims AS (SELECT a.conversation_id, sum(a.x * b.x) / sqrt(sum(a.x * a.x)) / sqrt(sum(b.x * b.x)) AS s FROM dims a JOIN dims b
    ON a.conversation_id = b.conversation_id AND a.i = b.i AND a.side = 'customer' AND b.side = 'agent' GROUP BY 1),
  coh AS (SELECT conversation_id, s, CASE WHEN s IS NULL THEN 0.5 WHEN s BETWEEN 0.2 AND 0.9 THEN least(1.0, s + 0.3) ELSE greatest(0.3, s) END AS coherence
    FROM (SELECT DISTINCT conversation_id FROM turns) LEFT JOIN sims USING (conversation_id))"""


@query("d6_text_coherence", f"WITH {TEXT_VECTORS} SELECT conversation_id, round(s, 6) AS similarity, round(coherence, 6) AS coherence FROM coh")
def text_coherence(spark, sf):
    found = Q.text_coherence(long_turns(spark, sf))
    return rounded(found.select("conversation_id", Q.cosine(F.col("customer_vec"), F.col("agent_vec")).alias("similarity"), "coherence"))


@query("d7_text_blend", f"""WITH {TEXT_VECTORS}, {CHECKS_SQL}, st AS (SELECT sum(c1::INT + c2::INT + c3::INT + c4::INT + c5::INT + c6::INT) / (6.0 * count(*)) AS structural FROM checks),
  c AS (SELECT avg(coherence) AS a, min(coherence) AS lo, max(coherence) AS hi FROM coh)
  SELECT round(0.7 * structural + 0.3 * a, 6) AS score, round(structural, 6) AS structural, round(a, 6) AS avg_score, round(lo, 6) AS min_score, round(hi, 6) AS max_score FROM st, c""")
def text_blend(spark, sf):
    return rounded(Q.semantic_blend(long_corpus(spark, sf).facts, Q.text_coherence(long_turns(spark, sf))))


@query("d7_semantic_blend", f"""WITH {NESTED_FACTS}, {CHECKS_SQL}, {PAIRS_SQL}, s AS (SELECT
  sum(c1::INT + c2::INT + c3::INT + c4::INT + c5::INT + c6::INT) / (6.0 * count(*)) AS structural FROM checks),
  c AS (SELECT avg(coherence) AS a, min(coherence) AS lo, max(coherence) AS hi FROM coh)
  SELECT round(0.7 * structural + 0.3 * a, 6) AS score, round(structural, 6) AS structural, round(a, 6) AS avg_score,
    round(lo, 6) AS min_score, round(hi, 6) AS max_score FROM s, c""")
def semantic_blend(spark, sf):
    return rounded(Q.semantic_blend(nested_facts(spark, sf), Q.coherence(_pairs(spark, sf))))


JS_SQL = """mine AS (SELECT coalesce(intent, 'unknown') AS key, count(*) * 1.0 / (SELECT count(*) FROM facts) AS share FROM facts GROUP BY 1),
both_raw AS (SELECT coalesce(refs.share, 1e-10) AS p, coalesce(mine.share, 1e-10) AS q, refs.share IS NOT NULL AS in_ref,
  mine.share IS NOT NULL AS in_mine FROM refs FULL JOIN mine ON refs.key = mine.key),
both_n AS (SELECT p / (SELECT sum(p) FROM both_raw) AS p, q / (SELECT sum(q) FROM both_raw) AS q FROM both_raw),
js AS (SELECT least(1.0, (sum(CASE WHEN p > 1e-10 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END)
  + sum(CASE WHEN q > 1e-10 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2) AS js FROM both_n)"""
REALISM_SQL = f"""{JS_SQL}, cov AS (SELECT sum((in_ref AND in_mine)::INT) * 1.0 / sum(in_ref::INT) AS ic, sum(in_ref::INT) AS nr FROM both_raw),
cat AS (SELECT count(DISTINCT coalesce(x.t_category, 'unknown')) AS nc FROM facts f LEFT JOIN tax x ON x.t_intent = f.intent),
tr AS (SELECT avg(n_turns) AS avt, CASE WHEN avg(n_turns) BETWEEN 3 AND 10 THEN 1.0 ELSE greatest(0.5, 1 - abs(avg(n_turns) - 6) / 10) END AS ts,
  count(*) AS n FROM facts),
realm AS (SELECT js, ic, nr, nc / 11 AS cc, ts, avt, n,
  greatest(0.0, least(1.0, 0.40 * (1 - js) + 0.25 * ic + 0.20 * (nc / 11) + 0.15 * ts)) AS realism FROM js, cov, cat, tr)"""


@query("d8_realism", f"""WITH {NESTED_FACTS} {REFERENCE_SQL}, {REALISM_SQL}
  SELECT round(js, 6) AS js_divergence, round(ic, 6) AS intent_coverage, nr::DOUBLE AS reference_intents, round(cc, 6) AS category_coverage,
    round(ts, 6) AS turn_realism, round(avt, 6) AS avg_turns, n::DOUBLE AS conversations, round(realism, 6) AS realism FROM realm""")
def realism(spark, sf):
    return rounded(Q.realism(nested_facts(spark, sf), reference_examples(spark, sf)))


@query("d8_realism_long", f"""WITH {LONG_FACTS} {REFERENCE_SQL}, {REALISM_SQL}
  SELECT round(realism, 6) AS realism FROM realm""")
def realism_long(spark, sf):
    corpus = long_corpus(spark, sf)
    return rounded(Q.realism(corpus.light, reference_examples(spark, sf), corpus.heads).select("realism"))


@query("d9_js_divergence_by_source", """WITH a AS (SELECT lang, count(*) * 1.0 / (SELECT count(*) FROM documents) AS q FROM documents GROUP BY 1),
  b AS (SELECT event_type AS lang, count(*) * 1.0 / (SELECT count(*) FROM events) AS p FROM events GROUP BY 1
        UNION ALL SELECT 'en', 0.0 WHERE false),
  j0 AS (SELECT coalesce(p, 1e-10) AS p, coalesce(q, 1e-10) AS q FROM a FULL JOIN b ON a.lang = b.lang),
  j AS (SELECT p / (SELECT sum(p) FROM j0) AS p, q / (SELECT sum(q) FROM j0) AS q FROM j0)
  SELECT round(least(1.0, (sum(CASE WHEN p > 1e-10 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END)
    + sum(CASE WHEN q > 1e-10 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2), 6) AS js_divergence FROM j""")
def js_disjoint(spark, sf):
    from dialoom.functions.dist import js_divergence, shares
    return rounded(js_divergence(shares(table(spark, sf, "events"), F.col("event_type")),
                                 shares(table(spark, sf, "documents"), F.col("lang"))))


@query("d10_reference_coverage", f"""WITH {NESTED_FACTS} {REFERENCE_SQL}, {JS_SQL}
  SELECT round(sum((in_ref AND in_mine)::INT) * 1.0 / sum(in_ref::INT), 6) AS intent_coverage, sum(in_ref::INT)::DOUBLE AS reference_intents FROM both_raw""")
def reference_coverage(spark, sf):
    return rounded(to_row([Q.intent_match(nested(spark, sf), reference_examples(spark, sf))],
                          ["intent_coverage", "reference_intents"]))


@query("d11_category_coverage", f"""WITH {LONG_SQL}
  SELECT count(DISTINCT coalesce(x.t_category, 'unknown'))::DOUBLE AS categories,
    round(count(DISTINCT coalesce(x.t_category, 'unknown')) / 11, 6) AS category_coverage
  FROM heads h LEFT JOIN tax x ON x.t_intent = h.intent""")
def category_coverage(spark, sf):
    return rounded(to_row([Q.category_coverage(long_heads(spark, sf))], ["categories", "category_coverage"]))


@query("d12_turn_realism", f"""WITH {NESTED_FACTS} SELECT round(avg(n_turns), 6) AS avg_turns,
  round(CASE WHEN avg(n_turns) BETWEEN 3 AND 10 THEN 1.0 ELSE greatest(0.5, 1 - abs(avg(n_turns) - 6) / 10) END, 6) AS turn_realism FROM facts""")
def turn_realism(spark, sf):
    return rounded(to_row([Q.turn_realism(nested_facts(spark, sf))], ["avg_turns", "turn_realism"]))


NORMAL_SQL = r"regexp_replace(trim(lower(coalesce(first_text, '')), chr(9) || chr(10) || chr(13) || ' '), '[^\p{L}\p{N}_\s]', '', 'g')"
MESSAGE_SQL = f"""msg AS (SELECT count(DISTINCT CASE WHEN first_speaker = 'customer' THEN {NORMAL_SQL} END) AS u, count(*) AS n FROM facts)"""


@query("d14_message_variety", f"""WITH {NESTED_FACTS}, {MESSAGE_SQL}
  SELECT u::DOUBLE AS unique_messages, n::DOUBLE AS conversations, round(u / n, 6) AS message_variety FROM msg""")
def message_variety(spark, sf):
    return rounded(Q.message_variety(nested_facts(spark, sf)))


WORDS_SQL = f"""w AS (SELECT CASE WHEN speaker = 'customer' THEN 'customer' ELSE 'agent' END AS side, conversation_id, turn_idx,
  regexp_extract_all(lower(text), '{WORD_SQL}') AS ws FROM turns),
vocab AS (SELECT count(DISTINCT CASE WHEN side = 'customer' THEN word END) AS ct, sum((side = 'customer')::INT) AS cn,
  count(DISTINCT CASE WHEN side = 'agent' THEN word END) AS agt, sum((side = 'agent')::INT) AS an FROM (SELECT side, unnest(ws) AS word FROM w))"""

for _name, _turns, _sql in (("d15_vocabulary", long_turns, LONG_SQL),
                            ("d15_vocabulary_nested", lambda s, d: nested_corpus(s, d).turns, NESTED_SQL)):
    query(_name, f"""WITH {_sql}, {WORDS_SQL} SELECT ct AS customer_types, cn::BIGINT AS customer_tokens, agt AS agent_types,
      an::BIGINT AS agent_tokens, round((ct / cn + agt / an) / 2, 6) AS vocabulary FROM vocab""")(
        lambda spark, sf, t=_turns: rounded(Q.vocabulary(t(spark, sf))))

GRAMS_SQL = f"""seq AS (SELECT word, conversation_id, turn_idx, row_number() OVER (ORDER BY conversation_id, turn_idx, pos) AS r FROM (
    SELECT conversation_id, turn_idx, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w WHERE side = 'customer')),
leads AS (SELECT *, word || ' ' || lead(word) OVER (ORDER BY r) AS g2,
  word || ' ' || lead(word) OVER (ORDER BY r) || ' ' || lead(word, 2) OVER (ORDER BY r) AS g3 FROM seq),
grams AS (SELECT count(g2) AS t2, count(DISTINCT g2) AS d2, count(g3) AS t3, count(DISTINCT g3) AS d3 FROM leads),
gscore AS (SELECT *, least(1.0, (d2 / t2) / (2 * least(0.3, 1.0 / pow(t2 + 1, 0.3)))) AS s2,
  least(1.0, (d3 / t3) / (2 * least(0.3, 1.0 / pow(t3 + 2, 0.3)))) AS s3 FROM grams)"""

for _name, _turns, _sql in (("d16_ngram_diversity", long_turns, LONG_SQL),
                            ("d16_ngram_diversity_nested", lambda s, d: nested_corpus(s, d).turns, NESTED_SQL)):
    query(_name, f"""WITH {_sql}, {WORDS_SQL}, {GRAMS_SQL} SELECT t2 AS total_2, d2 AS distinct_2, t3 AS total_3, d3 AS distinct_3,
      round(s2, 6) AS bigram_diversity, round(s3, 6) AS trigram_diversity, round((s2 + s3) / 2, 6) AS ngram FROM gscore""")(
        lambda spark, sf, t=_turns: rounded(Q.ngram_diversity(t(spark, sf))))


@query("d16_ngrams_within_turn", f"""WITH {LONG_SQL}, {WORDS_SQL}, p AS (SELECT ws, unnest(range(len(ws))) AS i FROM w WHERE side = 'customer'),
  g AS (SELECT 2 AS n, array_to_string(ws[i+1:i+2], ' ') AS gram FROM p WHERE i + 2 <= len(ws)
        UNION ALL SELECT 3, array_to_string(ws[i+1:i+3], ' ') FROM p WHERE i + 3 <= len(ws))
  SELECT n, count(*) AS total, count(DISTINCT gram) AS "distinct" FROM g GROUP BY n""")
def ngrams_within_turn(spark, sf):
    return Q.ngram_counts(long_turns(spark, sf), within_turn=True)


VARIETY_SQL = """vary AS (SELECT count(DISTINCT coalesce(intent, '')) AS ui,
  count(DISTINCT CASE WHEN sentiment IN ('positive','neutral','negative') THEN sentiment END) AS us,
  count(DISTINCT CASE WHEN resolution_status IN ('resolved','escalated','unresolved') THEN resolution_status END) AS ur FROM heads)"""


@query("d17_d18_label_variety", f"""WITH {LONG_SQL}, {VARIETY_SQL} SELECT ui::DOUBLE AS unique_intents, round(ui / 77, 6) AS intent_variety,
  us::DOUBLE AS sentiments, round(us / 3, 6) AS sentiment_variety, ur::DOUBLE AS resolutions, round(ur / 3, 6) AS resolution_variety FROM vary""")
def label_variety(spark, sf):
    return rounded(to_row([Q.label_variety(long_heads(spark, sf))],
                          ["unique_intents", "intent_variety", "sentiments", "sentiment_variety", "resolutions",
                           "resolution_variety"]))


DIVERSE_SQL = f"""{MESSAGE_SQL}, {WORDS_SQL}, {GRAMS_SQL}, {VARIETY_SQL},
dcat AS (SELECT count(DISTINCT coalesce(x.t_category, 'unknown')) AS dnc FROM facts f LEFT JOIN tax x ON x.t_intent = f.intent),
diverse AS (SELECT *, greatest(0.0, least(1.0, 0.20 * ui / 77 + 0.15 * u / n + 0.15 * (ct / cn + agt / an) / 2 + 0.15 * (s2 + s3) / 2
  + 0.15 * us / 3 + 0.10 * ur / 3 + 0.10 * dnc / 11)) AS diversity FROM msg, vocab, gscore, vary, dcat)"""


@query("d13_diversity", f"""WITH {NESTED_FACTS}, {DIVERSE_SQL} SELECT round(diversity, 6) AS diversity, u::DOUBLE AS unique_messages,
  ct::DOUBLE AS customer_types, agt::DOUBLE AS agent_types, round((s2 + s3) / 2, 6) AS ngram FROM diverse""")
def diversity(spark, sf):
    return rounded(Q.diversity(nested_corpus(spark, sf)).select(
        "diversity", "unique_messages", "customer_types", "agent_types", "ngram"))


@query("d19_diversity_warnings", f"""WITH {LONG_FACTS}, {MESSAGE_SQL}, {VARIETY_SQL} SELECT concat_ws(' | ',
  CASE WHEN ui < 10 AND n >= 50 THEN 'Low intent variety: only ' || ui || ' unique intents' END,
  CASE WHEN u / n < 0.5 THEN 'Low message variety: ' || format('{{:.1f}}%', u / n * 100) || ' unique messages' END) AS warnings FROM msg, vary""")
def diversity_warnings(spark, sf):
    out = Q.diversity_warnings(Q.diversity(long_corpus(spark, sf)))
    return out.select(F.array_join("warnings", " | ").alias("warnings"))


QUALITY_SQL = f"""{COMPLETE_SQL}, {ISSUES_SQL}, {REALISM_SQL}, {DIVERSE_SQL},
  con AS (SELECT sum(c1::INT + c2::INT + c3::INT + c4::INT + c5::INT + c6::INT) / (6.0 * count(*)) AS consistency FROM checks),
  gapn AS (SELECT sum(least(c, 3)) AS gaps FROM (SELECT unnest([sum((intent IS NULL)::INT), sum((sentiment IS NULL)::INT),
    sum((NOT turns_given)::INT), sum((resolution_status IS NULL)::INT)]) AS c FROM facts)),
  said AS (SELECT sum((severity = 'issue')::INT) AS ni, sum((severity = 'warning')::INT) AS nw FROM issues),
  q AS (SELECT realm.n AS n, passed / total AS completeness, consistency, realism, diversity, gaps + ni AS issues,
    nw + (CASE WHEN ui < 10 AND diverse.n >= 50 THEN 1 ELSE 0 END) + (CASE WHEN u / diverse.n < 0.5 THEN 1 ELSE 0 END) AS warnings
    FROM complete, con, realm, diverse, gapn, said)"""
QUALITY_OUT = """SELECT n AS conversations, round(completeness, 6) AS completeness, round(consistency, 6) AS consistency,
  round(realism, 6) AS realism, round(diversity, 6) AS diversity,
  round((completeness + consistency + realism + diversity) * 25, 6) AS overall, issues::BIGINT AS issues, warnings::BIGINT AS warnings FROM q"""


@query("d20_quality", f"WITH {LONG_FACTS} {REFERENCE_SQL}, {QUALITY_SQL} {QUALITY_OUT}")
def quality_long(spark, sf):
    return rounded(Q.quality(long_corpus(spark, sf), reference_examples(spark, sf)))


@query("d20_quality_nested", f"WITH {NESTED_FACTS} {REFERENCE_SQL}, {QUALITY_SQL} {QUALITY_OUT}")
def quality_nested(spark, sf):
    return rounded(Q.quality(nested_corpus(spark, sf), reference_examples(spark, sf)))


@query("d21_verdict_by_source", """SELECT source, round(avg(quality) * 100, 6) AS overall,
  CASE WHEN avg(quality) * 100 >= 85 THEN 'PASS' WHEN avg(quality) * 100 >= 70 THEN 'WARN' ELSE 'FAIL' END AS verdict
  FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def verdicts(spark, sf):
    scored = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    overall = scored.groupBy("source").agg((F.avg("quality") * 100).alias("overall"))
    return rounded(overall.withColumn("verdict", Q.verdict(F.col("overall"))))


ESTIMATE_SQL = """est AS (SELECT avg(((conversation_id <> '')::INT + coalesce((intent <> '')::INT, 0) + coalesce((sentiment <> '')::INT, 0)
    + (n_turns > 0)::INT) / 4) AS a, avg(CASE WHEN n_turns = 0 THEN 0.0 WHEN coalesce(first_speaker = 'customer', false) AND longest_run <= 1
    THEN 1.0 ELSE 0.5 END) AS b, least(1.0, 1.5 * count(DISTINCT intent) / count(*)) AS d FROM facts)"""


@query("d22_quality_estimate", f"""WITH {NESTED_FACTS}, {ESTIMATE_SQL}
  SELECT round(a, 6) AS completeness, round(b, 6) AS consistency, 0.75::DOUBLE AS realism, round(d, 6) AS diversity FROM est""")
def estimate(spark, sf):
    return rounded(Q.estimate(nested_facts(spark, sf)))


@query("d23_quality_summary", f"""WITH {NESTED_FACTS}, {ESTIMATE_SQL}, s AS (
  SELECT unnest(['completeness','consistency','realism','diversity']) AS metric, unnest([a, b, 0.75, d])::DOUBLE AS value,
    unnest([0.95, 0.9, 0.85, 0.8])::DOUBLE AS threshold FROM est),
  r AS (SELECT metric, value, threshold, CASE WHEN value >= threshold THEN 'good' WHEN value >= threshold * 0.8 THEN 'warning' ELSE 'error' END AS status FROM s
  UNION ALL SELECT 'overall', avg(value), NULL, CASE WHEN avg(value) >= 0.85 THEN 'good' WHEN avg(value) >= 0.7 THEN 'warning' ELSE 'error' END FROM s)
  SELECT metric, round(value, 6) AS value, round(value * 100, 6) AS percentage, threshold, status FROM r""")
def quality_summary(spark, sf):
    names = ["completeness", "consistency", "realism", "diversity"]
    row = Q.estimate(nested_facts(spark, sf))
    long = row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))
    return rounded(Q.quality_summary(long))


@query("run_existing_dataset", f"""WITH {NESTED_FACTS} {REFERENCE_SQL}, {QUALITY_SQL}
  SELECT n AS conversations, round((completeness + consistency + realism + diversity) * 25, 6) AS overall, round(overall_registered, 6) AS registered, 1::BIGINT AS runs
  FROM (SELECT *, (completeness + consistency + realism + diversity) * 25 AS overall_registered FROM q)""")
def run_existing_dataset(spark, sf):
    """Quality, bias, training, registry and gate in one go; then what the registry knows."""
    from dialoom.registry.tables import Registry
    from dialoom.run import RunConfig, run_existing
    from dialoom.session import shared_path
    from dialoom.training.models import ModelConfig

    registry = Registry(spark, shared_path(spark, "run"))
    config = RunConfig(model_types=("logistic_regression",), model=ModelConfig(
        max_features=200, ngram_range=(1, 1), model_params={"max_iter": 5}))
    done = run_existing(nested(spark, sf).drop("k"), reference_examples(spark, sf), registry, "/data/x", config=config)
    known = registry.current().select(F.col("id").alias("dataset_id"), F.col("quality_overall").alias("registered"))
    runs = registry.runs().groupBy("dataset_id").agg(F.count("*").alias("runs"))
    return rounded(done.join(known, "dataset_id").join(runs, "dataset_id").select("conversations", "overall", "registered", "runs"))


def _answers(batches):
    """A generator in place of a model: one conversation about the intent of the prompt; every tenth request fails, every tenth answer is cut off."""
    import json

    import pandas as pd

    for pdf in batches:
        out = []
        for record, prompt in zip(pdf["record_id"], pdf["prompt"]):
            intent = prompt.rsplit("Intent: ", 1)[1].split("\n")[0]
            turns = [{"speaker": "customer", "text": f"I ask about {intent.replace('_', ' ')}, case {record}"}, {"speaker": "agent", "text": "Let me check that"}]
            text = json.dumps({"conversation_id": f"conv_{record}", "turns": turns})
            answer = {"error": "throttled"} if int(record) % 10 == 9 else {"modelOutput": {"content": [{"text": text[:-9] if int(record) % 10 == 8 else text}]}}
            out.append(json.dumps({"recordId": record, **answer}))
        yield pd.DataFrame({"value": out})


@query("run_plan_to_gate", """SELECT count(*) AS responses, sum((doc_id % 10 IN (8, 9))::INT)::BIGINT AS failed, sum((doc_id % 10 < 8)::INT)::BIGINT AS conversations,
  sum((doc_id % 10 < 8)::INT)::BIGINT AS registered, 1::BIGINT AS runs, 2::BIGINT AS kinds_of_errors, true AS learned, true AS gated FROM documents""")
def run_plan_to_gate(spark, sf):
    """From a plan over all documents to a registered dataset with its gate: prompts, requests, answers, repair, quality, bias, training, registry, report."""
    from dialoom.plans.responses import error_summary
    from dialoom.registry.tables import Registry
    from dialoom.run import RunConfig, run_plan
    from dialoom.session import shared_path
    from dialoom.training.models import preset
    from suite.plans import _examples, _labels_plan

    path, registry = shared_path(spark, "run-plan"), Registry(spark, shared_path(spark, "run-registry"))
    config = RunConfig(model_types=("logistic_regression",), model=preset("quick_test"))
    plan = _labels_plan(spark, sf)
    done = run_plan(plan, _examples(spark, sf), _answers, plan.select("intent"), path, registry, config)
    known = registry.current().select(F.col("id").alias("dataset_id"), F.col("size").alias("registered"), "quality_overall")
    runs = registry.runs().groupBy("dataset_id").agg(F.count("*").alias("runs"), F.max("accuracy").alias("kept_accuracy"))
    kinds = error_summary(spark.read.parquet(f"{path}/errors")).agg(F.count("*")).scalar()
    row = done.join(known, "dataset_id").join(runs, "dataset_id")
    ready = (F.col("quality_overall") >= F.col("quality_limit")) & (F.col("kept_accuracy") >= F.col("accuracy_limit")) & F.col("severity").isin("none", "low", "medium")
    return row.select("responses", "failed", "conversations", "registered", "runs", kinds.alias("kinds_of_errors"), (F.col("accuracy") > 0.1).alias("learned"),
                      (F.col("production_ready") == ready).alias("gated"))
