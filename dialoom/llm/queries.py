"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dialoom.llm import bpe, chat, decontaminate, embeddings, langid, licenses, lines, minhash, negatives, quality, shards, spelling, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, by: int):
    """The remainder of the CRC-32 of an id's text."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(by))


_MINHASH_SQL = r"""WITH RECURSIVE cut AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM cut),
flat AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT doc_id, any_value(len(s)) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept
FROM sets JOIN reach ON doc_id = a GROUP BY doc_id"""


@query(_MINHASH_SQL)
def op1_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op2_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=remainder("id", 5) == 0)


_VECTORS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(any_value(n), 0) AS n_links, min(b) AS component_id, v.vec_id = min(b) AS kept
FROM v JOIN reach r ON v.vec_id = r.a LEFT JOIN counts c ON c.a = v.vec_id GROUP BY v.vec_id"""


@query(_VECTORS_SQL)
def op3_embeddings(spark, sf_dir):
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


# white space at both ends and letter case as in the operator; chr(11) to chr(13) have no escape there
_LINES_SQL = r"""WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM cut),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
flagged AS (SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM flagged GROUP BY doc_id"""


@query(_LINES_SQL)
def op4_lines(spark, sf_dir):
    return lines.line_digests(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


_NOTICES_SQL = "VALUES " + ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in licenses.NOTICES.items())
_LICENSES_SQL = f"""WITH texts AS (SELECT doc_id, NULL AS name, text FROM documents
  UNION ALL SELECT NULL, col0, col1 FROM ({_NOTICES_SQL})),
cut AS (SELECT doc_id, name, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM texts),
runs AS (SELECT doc_id, name, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM cut),
sizes AS (SELECT name, count(*) AS n FROM runs WHERE name IS NOT NULL GROUP BY name),
hits AS (SELECT d.doc_id, t.name, count(*) AS m FROM runs d JOIN runs t ON d.s = t.s AND d.name IS NULL AND t.name IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, name AS license, CAST(n AS INT) AS n_shingles, CAST(m AS INT) AS n_matched FROM hits JOIN sizes USING (name) WHERE m >= 0.75 * n"""


@query(_LICENSES_SQL)
def op5_licenses(spark, sf_dir):
    return licenses.license_notices(table(spark, sf_dir, "documents"))


@query()
def op6_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(remainder("doc_id", 4) != 2))
    return langid.identify(docs, model).withColumn("held_out", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))


@query()
def op7_shards(spark, sf_dir):
    placed = shards.shard(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# every window as a list of words; the smallest document that holds it decides
_SUBSTRINGS_SQL = r"""WITH cut AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM cut WHERE len(w) >= 50),
runs AS (SELECT s.doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM starts s JOIN cut USING (doc_id)),
firsts AS (SELECT h, min(doc_id) AS first FROM runs GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM runs JOIN firsts USING (h) WHERE doc_id > first),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM cut),
kept AS (SELECT p.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY p.i) AS text
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT c.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM cut c LEFT JOIN kept k USING (doc_id)"""


@query(_SUBSTRINGS_SQL)
def op8_substrings(spark, sf_dir):
    return substrings.without_repeats(table(spark, sf_dir, "documents"), size=50, digest=True).withColumnRenamed("kept", "kept_sha256")


@query()
def op9_decontamination(spark, sf_dir):
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("n_item").alias("n_tokens"), "n_matched", "coverage")


@query()
def op10_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_NEGATIVES_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
best AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
found AS (SELECT s.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY s.anchor_id, p.id ORDER BY s.score DESC, s.id) AS k, s.id AS negative_id,
  p.score AS positive_score, s.score AS negative_score FROM best p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(k AS INT) AS rank, negative_id, positive_score, negative_score FROM found WHERE k <= 5"""


@query(_NEGATIVES_SQL)
def op11_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("id") % 100 == 0)


# a text grows by one backslash for each control string in it; a piece has a header line, the text, a line feed, the end mark and a line feed
_CHAT_SQL = r"""WITH extra AS (SELECT -7 AS conv_id, i AS turn, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END AS role, '\### Assistant: </turn> ok' AS text FROM range(2) r(i)),
turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM extra)),
sized AS (SELECT *, CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN len(role) ELSE 6 + len(coalesce(CAST(to_json(role) AS VARCHAR), 'null')) END
  + 6 + len(text) + len(regexp_extract_all(text, '#\\*## (?:(?:System|User|Assistant|Tool):|Other)|<\\*/turn>')) + 9 AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


@query(_CHAT_SQL)
def op12_chat(spark, sf_dir):
    odd = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.digests(chat.formatted(chat.event_log(turns)))


# CRC-32 byte by byte with the usual table, then all near pairs by words with one code point taken out
_SPELLING_SQL = r"""WITH RECURSIVE steps(i, k, x) AS (SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
often AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT run, n, t, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS b FROM often, crc),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda h, c: xor(t[(xor(h, c) & 255) + 1], h >> 8))) AS h FROM bytes),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN run[:(h % len(run))] || run[(h % len(run)) + 2:] ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
outs AS MATERIALIZED (SELECT word, n, i, word[:i] || word[i + 2:] AS d FROM (SELECT word, n, unnest(range(len(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM outs a JOIN outs b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT o.word, w.word, w.n FROM outs o JOIN words w ON o.d = w.word UNION SELECT w.word, o.word, o.n FROM outs o JOIN words w ON o.d = w.word),
counts AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
firsts AS (SELECT word, other, m FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
forms AS MATERIALIZED (SELECT w.word, CASE WHEN m >= 5 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN counts c ON w.word = c.word LEFT JOIN firsts f ON w.word = f.word),
chain(word, last) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word JOIN forms e ON c.last = e.word AND e.form IS NULL"""


@query(_SPELLING_SQL)
def op13_spelling(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
