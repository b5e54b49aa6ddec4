"""F: profiles and comparison. The two datasets compared are the nested and the long form."""

from pyspark.sql import functions as F

from dialoom.operators import profile as P
from suite.base import LONG_SQL, NESTED_SQL, long_heads, nested, query, rounded, table

DIMS = ["intent", "sentiment", "complexity", "language", "resolution_status"]


def profile_sql(name, heads):
    parts = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, coalesce({d}, 'unknown') AS value, count(*) AS n, avg(coalesce(turn_count, 0)) AS avg_turns FROM {heads} GROUP BY 2"
        for d in DIMS)
    return f"""{name} AS ({parts} UNION ALL SELECT 'all', NULL, count(*), avg(coalesce(turn_count, 0)) FROM {heads})"""


@query("f1_profile", f"WITH {NESTED_SQL}, {profile_sql('p', 'heads')} SELECT dimension, value, n, round(avg_turns, 6) AS avg_turns FROM p")
def profile(spark, sf):
    return rounded(P.profile(nested(spark, sf)))


@query("f1_profile_long", f"WITH {LONG_SQL}, {profile_sql('p', 'heads')} SELECT dimension, value, n, round(avg_turns, 6) AS avg_turns FROM p")
def profile_long(spark, sf):
    return rounded(P.profile(long_heads(spark, sf)))


for _d in ("sentiment", "language"):
    query(f"f2_{_d}_percentages", f"""WITH {NESTED_SQL}, {profile_sql('p', 'heads')} SELECT value, n,
      round(n / (SELECT count(*) FROM heads) * 100, 6) AS percentage FROM p WHERE dimension = '{_d}'""")(
        lambda spark, sf, d=_d: rounded(P.percentages(P.profile(nested(spark, sf)), d)))


@query("f3_top_intents", f"""WITH {NESTED_SQL}, {profile_sql('p', 'heads')}, t AS (SELECT value, n FROM p WHERE dimension = 'intent' ORDER BY n DESC, value LIMIT 10)
  SELECT value, n, array_to_string(list_transform(string_split(value, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM t""")
def top_intents(spark, sf):
    return P.top_values(P.profile(nested(spark, sf)))


# the second dataset: the long form
SECOND = LONG_SQL.split("),\nids AS", 1)[1].replace("heads AS", "heads2 AS").replace("FROM ids", "FROM ids2")
BOTH_SQL = f"""{NESTED_SQL},
ids2 AS {SECOND.split('turns AS')[0].rstrip().rstrip(',')},
{profile_sql('p', 'heads')}, {profile_sql('q', 'heads2')}"""


def diff_sql(d):
    return f"""SELECT coalesce(a.value, b.value) AS value, coalesce(a.n, 0) / (SELECT count(*) FROM heads) * 100 AS dataset1,
      coalesce(b.n, 0) / (SELECT count(*) FROM heads2) * 100 AS dataset2
      FROM (SELECT * FROM p WHERE dimension = '{d}') a FULL JOIN (SELECT * FROM q WHERE dimension = '{d}') b ON a.value = b.value"""


def _two(spark, sf):
    return P.profile(nested(spark, sf)), P.profile(long_heads(spark, sf))


for _id, _d in (("f4_sentiment_comparison", "sentiment"), ("f6_complexity_comparison", "complexity"),
                ("f4_resolution_comparison", "resolution_status")):
    query(_id, f"""WITH {BOTH_SQL}, d AS ({diff_sql(_d)}) SELECT value, round(dataset1, 6) AS dataset1, round(dataset2, 6) AS dataset2,
      round(abs(dataset1 - dataset2), 6) AS diff FROM d""")(
        lambda spark, sf, d=_d: rounded(P.compare_shares(*_two(spark, sf), d)))


@query("f5_sentiment_similarity", f"""WITH {BOTH_SQL}, d AS ({diff_sql('sentiment')})
  SELECT round(greatest(0, 100 - avg(abs(dataset1 - dataset2))), 6) AS similarity FROM d""")
def similarity(spark, sf):
    return rounded(P.similarity(P.compare_shares(*_two(spark, sf), "sentiment")))


@query("f4_compare_datasets", f"""WITH {BOTH_SQL}, d AS ({diff_sql('sentiment')}),
  o AS (SELECT count(*) FILTER (a.value IS NOT NULL AND b.value IS NOT NULL) / count(*) AS overlap
    FROM (SELECT * FROM p WHERE dimension = 'intent') a FULL JOIN (SELECT * FROM q WHERE dimension = 'intent') b ON a.value = b.value)
  SELECT (SELECT count(*) FROM heads) AS dataset1_count, (SELECT count(*) FROM heads2) AS dataset2_count, round(overlap, 6) AS intent_overlap,
    round((SELECT greatest(0, 100 - avg(abs(dataset1 - dataset2))) FROM d), 6) AS sentiment_similarity,
    round(abs((SELECT avg(coalesce(turn_count, 0)) FROM heads) - (SELECT avg(coalesce(turn_count, 0)) FROM heads2)), 6) AS avg_turns_diff FROM o""")
def compare(spark, sf):
    return rounded(P.compare(*_two(spark, sf)))


@query("f7_common_intents", f"""WITH {BOTH_SQL} SELECT intent FROM heads WHERE intent <> '' INTERSECT SELECT intent FROM heads2 WHERE intent <> ''""")
def common(spark, sf):
    return P.common_intents(nested(spark, sf), long_heads(spark, sf))


@query("f10_coverage_counts", f"""WITH {NESTED_SQL} SELECT count(*) AS conversations, count(DISTINCT intent) AS intents, count(DISTINCT sentiment) AS sentiments,
  sum((coalesce(language, '') = 'en')::INT)::BIGINT AS en, sum((coalesce(language, '') = 'es')::INT)::BIGINT AS es,
  round(count(DISTINCT intent) / 77, 6) AS intent_coverage FROM heads""")
def coverage_counts(spark, sf):
    return rounded(P.coverage_counts(nested(spark, sf)))


@query("f1_language_by_source", """SELECT source, lang AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source) * 100, 6) AS percentage
  FROM documents GROUP BY 1, 2""")
def language_by_source(spark, sf):
    docs = table(spark, sf, "documents").groupBy("source", F.col("lang").alias("value")).agg(F.count("*").alias("n"))
    whole = docs.groupBy("source").agg(F.sum("n").alias("total"))
    return rounded(docs.join(whole, "source").select(
        "source", "value", "n", (F.col("n") / F.col("total") * 100).alias("percentage")))
