"""Quality scores: completeness, consistency, realism, diversity, and what they are made of.

Scores come as (metric, value) rows; ``to_row`` makes one row of several such frames. Every
function works on any number of conversations, zero included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoom.functions.dims import compact, metric, percent, ratio, to_row
from dialoom.functions.dist import divergence, shares, side_counts
from dialoom.functions.ordered import crossing_ngrams, inner_ngrams
from dialoom.functions.text import normalised, truthy, words
from dialoom.functions.vectors import projected
from dialoom.operators.shape import Corpus
from dialoom.taxonomy import CATEGORIES, INTENTS, RESOLUTIONS, SENTIMENTS, allowed, taxonomy, with_category

# Required fields, weights, thresholds.
REQUIRED = ["conversation_id", "intent", "sentiment", "turns", "resolution_status"]
REALISM_PARTS = ["js_divergence", "intent_coverage", "category_coverage", "turn_realism"]
REALISM_WEIGHTS = {"distribution": 0.40, "intent_coverage": 0.25, "category_coverage": 0.20, "turns": 0.15}
DIVERSITY_WEIGHTS = {"intent": 0.20, "message": 0.15, "vocabulary": 0.15, "ngram": 0.15,
                     "sentiment": 0.15, "resolution": 0.10, "category": 0.10}
SEVERITY = {"min_turns": "issue", "first_speaker": "issue", "alternation": "warning", "sentiment": "issue",
            "resolution": "warning", "intent": "warning"}
EXAMPLES = 3
SUMMARY_THRESHOLDS = {"completeness": 0.95, "consistency": 0.90, "realism": 0.85, "diversity": 0.80}


def _present(field: str) -> Column:
    return F.col("turns_given") if field == "turns" else F.col(field).isNotNull()


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))


# ---------------------------------------------------------------- completeness

def completeness(facts: DataFrame) -> DataFrame:
    """total_checks, passed_checks, completeness; the score of an empty dataset is 0."""
    n = F.count("*")
    turns = F.coalesce(F.sum("n_turns"), F.lit(0))
    total = n * len(REQUIRED) + 2 * turns
    passed = sum((_sum(_present(f)) for f in REQUIRED), F.lit(0)) \
        + F.coalesce(F.sum(F.col("filled_speakers") + F.col("filled_texts")), F.lit(0))
    return metric(facts, total_checks=total, passed_checks=passed, completeness=ratio(passed, total))


def missing_fields(facts: DataFrame) -> DataFrame:
    """(field, missing) for every required field and the two turn fields, zero counts included."""
    turns = F.coalesce(F.sum("n_turns"), F.lit(0))
    counts = {f: _sum(~_present(f)) for f in REQUIRED}
    counts["turn.speaker"] = turns - F.coalesce(F.sum("filled_speakers"), F.lit(0))
    counts["turn.text"] = turns - F.coalesce(F.sum("filled_texts"), F.lit(0))
    row = facts.agg(*[c.cast("bigint").alias(f.replace(".", "_")) for f, c in counts.items()])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f.replace(".", "_")).alias("missing")) for f in counts])))


def completeness_examples(facts: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """(field, conversation_id, message): the first k conversations lacking each field.

    The rank filter is pushed below the shuffle, so a field missing in most rows costs k rows per
    partition.
    """
    gaps = facts.select("conversation_id", F.explode(compact(*[
        F.when(~_present(f), F.lit(f)) for f in REQUIRED])).alias("field"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy("conversation_id"))
    return (gaps.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("field", "conversation_id", F.col("rank").cast("bigint").alias("rank"),
                    F.concat(F.lit("Conv "), F.coalesce("conversation_id", F.lit("None")),
                             F.lit(": Missing field '"), F.col("field"), F.lit("'")).alias("message")))


# ---------------------------------------------------------------- consistency

def _checks() -> dict[str, Column]:
    return {
        "min_turns": F.col("n_turns") >= 2,
        "first_speaker": F.coalesce(F.col("first_speaker") == "customer", F.lit(False)),
        "alternation": F.col("longest_run") <= 2,
        "sentiment": allowed(F.col("sentiment"), SENTIMENTS),
        "resolution": allowed(F.col("resolution_status"), RESOLUTIONS),
        "intent": allowed(F.col("intent"), INTENTS),
    }


def consistency_flags(facts: DataFrame) -> DataFrame:
    """One boolean per check and conversation."""
    return facts.select("conversation_id", *[c.alias(n) for n, c in _checks().items()])


def consistency(facts: DataFrame) -> DataFrame:
    """structural_checks, structural_passed, consistency (0 for an empty dataset)."""
    checks = _checks()
    passed = sum((_sum(c) for c in checks.values()), F.lit(0))
    total = F.count("*") * len(checks)
    return metric(facts, structural_checks=total, structural_passed=passed, consistency=ratio(passed, total))


def consistency_issues(facts: DataFrame) -> DataFrame:
    """(conversation_id, rule, severity, message) for every failed check."""
    checks = _checks()
    said = {
        "min_turns": F.concat(F.lit("Only "), F.col("n_turns").cast("string"), F.lit(" turns (need >=2)")),
        "first_speaker": F.lit("First turn not from customer"),
        "alternation": F.lit("Non-alternating speaker pattern"),
        "sentiment": _quoted("Invalid sentiment", "sentiment"),
        "resolution": _quoted("Invalid resolution", "resolution_status"),
        "intent": _quoted("Unknown intent", "intent"),
    }
    found = compact(*[
        F.when(~checks[rule], F.struct(
            F.lit(rule).alias("rule"), F.lit(SEVERITY[rule]).alias("severity"),
            F.concat(F.lit("Conv "), F.coalesce("conversation_id", F.lit("None")), F.lit(": "), text)
            .alias("message")))
        for rule, text in said.items()])
    return facts.select("conversation_id", F.inline(found))


def _quoted(text: str, column: str) -> Column:
    return F.concat(F.lit(f"{text} '"), F.coalesce(F.col(column), F.lit("None")), F.lit("'"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("rule", "severity").agg(F.count("*").alias("n"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; NULL for a zero vector."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                           F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def coherence(pairs: DataFrame, customer: str = "customer_vec", agent: str = "agent_vec") -> DataFrame:
    """Adds ``coherence``: how well the first answer fits the first question, from their embeddings."""
    s = cosine(F.col(customer), F.col(agent))
    score = F.when(s.isNull(), F.lit(0.5))\
        .when(s.between(0.2, 0.9), F.least(F.lit(1.0), s + 0.3))\
        .otherwise(F.greatest(F.lit(0.3), s))
    return pairs.withColumn("coherence", score)


def first_messages(turns: DataFrame) -> DataFrame:
    """(conversation_id, customer, agent): the first message of both sides; null where a side says nothing."""
    def first(speaker: str) -> Column:
        return F.min(F.when(F.col("speaker") == speaker, F.struct("turn_idx", "text")))["text"].alias(speaker)

    return turns.groupBy("conversation_id").agg(first("customer"), first("agent"))


def text_coherence(turns: DataFrame, ngrams: int = 2, seed: int = 13) -> DataFrame:
    """(conversation_id, customer_vec, agent_vec, coherence) from the texts alone: vectors as from ``functions.vectors``, weighted over all first messages."""
    said = first_messages(turns)
    return coherence(projected(said, "conversation_id", {"customer_vec": "customer", "agent_vec": "agent"}, ngrams, seed))


def semantic_blend(facts: DataFrame, coherent: DataFrame) -> DataFrame:
    """consistency blended 70/30 with the mean coherence; the structural score alone if there is none."""
    semantic = metric(coherent, avg_score=F.avg("coherence"), min_score=F.min("coherence"),
                      max_score=F.max("coherence"))
    row = to_row([consistency(facts), semantic], ["consistency", "avg_score", "min_score", "max_score"])
    blend = 0.7 * F.col("consistency") + 0.3 * F.col("avg_score")
    return row.select(F.coalesce(blend, F.col("consistency")).alias("score"),
                      F.col("consistency").alias("structural"), "avg_score", "min_score", "max_score")


# ---------------------------------------------------------------- realism

def reference_shares(reference: DataFrame) -> DataFrame:
    """(key, n, share) of the reference intents: ``intent``, else ``label``, else "unknown"."""
    have = set(reference.columns)
    source = [F.col(c).cast("string") for c in ("intent", "label") if c in have]
    return shares(reference, F.coalesce(*source, F.lit("unknown")))


def _side_counts(heads: DataFrame, reference: DataFrame) -> DataFrame:
    """(key, n_p, n_q): reference and dataset intents; a missing intent is "unknown"."""
    have = set(reference.columns)
    source = [F.col(c).cast("string") for c in ("intent", "label") if c in have]
    theirs = reference.groupBy(F.coalesce(*source, F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"))
    mine = heads.groupBy("intent").agg(F.count("*").alias("n"))
    return side_counts(theirs, mine.select(F.coalesce("intent", F.lit("unknown")).alias("key"), "n"))


def intent_match(heads: DataFrame, reference: DataFrame) -> DataFrame:
    """(metric, value): js_divergence, intent_coverage, reference_intents; one table of counts serves all."""
    counts = _side_counts(heads, reference)
    known, used = F.col("n_p") > 0, F.col("n_q") > 0
    n = F.count_if(known)
    return metric(counts, js_divergence=divergence(counts), intent_coverage=ratio(F.count_if(known & used), n),
                  reference_intents=n)


def category_coverage(heads: DataFrame) -> DataFrame:
    """categories (unknown counts as one) and their number over the taxonomy's, before any clamp."""
    intents = heads.groupBy("intent").agg(F.count("*").alias("n"))
    mapped = with_category(intents, default="unknown")
    n = F.countDistinct("mapped_category")
    return metric(mapped, categories=n, category_coverage=n / len(CATEGORIES))


def turn_realism(facts: DataFrame) -> DataFrame:
    """avg_turns and 1 when it lies in [3, 10], else a penalty with floor 0.5."""
    return metric(facts, conversations=F.count("*"), **_turn_realism())


def _turn_realism() -> dict[str, Column]:
    avg = F.coalesce(F.avg("n_turns"), F.lit(0.0))
    score = F.when(avg.between(3, 10), F.lit(1.0)).otherwise(F.greatest(F.lit(0.5), 1 - F.abs(avg - 6) / 10))
    return {"avg_turns": avg, "turn_realism": score}


def realism(facts: DataFrame, reference: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """One row with the score and its parts; empty dataset 0, empty reference 0.5.

    ``heads``, the labels alone, spares the label passes the work of the facts.
    """
    labels = facts if heads is None else heads
    row = to_row([intent_match(labels, reference), category_coverage(labels), turn_realism(facts)],
                 [*REALISM_PARTS, "reference_intents", "avg_turns", "conversations"])
    return row.withColumn("realism", _realism_score())


def _realism_score() -> Column:
    w = REALISM_WEIGHTS
    score = (w["distribution"] * (1 - F.col("js_divergence")) + w["intent_coverage"] * F.col("intent_coverage")
             + w["category_coverage"] * F.col("category_coverage") + w["turns"] * F.col("turn_realism"))
    return F.when(F.col("conversations") == 0, F.lit(0.0)).when(F.col("reference_intents") == 0, F.lit(0.5))\
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


# ---------------------------------------------------------------- diversity

def message_variety(facts: DataFrame) -> DataFrame:
    """Distinct normalised first customer messages over all conversations.

    Distinct in two steps: one shuffle by the message's digest of 16 bytes, with equal messages combined before it.
    """
    opened = F.col("first_speaker") == "customer"
    messages = facts.filter(opened).select(F.unhex(F.md5(normalised(F.coalesce("first_text", F.lit(""))))).alias("m")).distinct()
    unique = metric(messages, unique_messages=F.count("*"))
    total = metric(facts, conversations=F.count("*"))
    row = to_row([unique, total], ["unique_messages", "conversations"])
    return row.withColumn("message_variety", ratio(F.col("unique_messages"), F.col("conversations")))


def word_counts(turns: DataFrame) -> DataFrame:
    """(side, word, n); every speaker other than the customer counts as agent side."""
    side = F.when(F.col("speaker") == "customer", "customer").otherwise("agent")
    return (turns.select(side.alias("side"), F.explode(words(F.col("text"))).alias("word"))
            .groupBy("side", "word").agg(F.count("*").alias("n")))


def vocabulary(turns: DataFrame) -> DataFrame:
    """Distinct and total words per side, and the mean of the two type/token ratios."""
    per_side = word_counts(turns).groupBy("side").agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))

    def of(side: str, c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))), F.lit(0))

    row = per_side.agg(*[of(s, c).alias(f"{s}_{c}") for s in ("customer", "agent") for c in ("types", "tokens")])
    both = [ratio(F.col(f"{s}_types"), F.col(f"{s}_tokens")) for s in ("customer", "agent")]
    return row.withColumn("vocabulary", (both[0] + both[1]) / 2)


def _counted(grams: Column, n: int) -> Column:
    one = F.lit(1).cast("bigint")
    return F.transform(grams, lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"), one.alias("count")))


def ngram_counts(turns: DataFrame, ns: tuple[int, ...] = (2, 3), within_turn: bool = False) -> DataFrame:
    """(n, total, distinct) of the n-grams over the whole customer word sequence.

    The sequence runs through all conversations in order (conversation_id, turn_idx). n-grams inside
    a turn need no order and are made where the turn is; only those crossing a turn border are
    found through the global order. Both meet in one shuffle by n-gram.
    """
    said = turns.filter(F.col("speaker") == "customer").select(
        "conversation_id", "turn_idx", words(F.col("text")).alias("w"))
    inside = said.select(F.inline(F.concat(*[_counted(inner_ngrams(F.col("w"), n), n) for n in ns])))
    grams = inside
    if not within_turn:
        grams = inside.unionByName(crossing_ngrams(said, ["conversation_id", "turn_idx"], "w", ns))
    return (grams.groupBy("n", "gram").agg(F.sum("count").alias("c"))
            .groupBy("n").agg(F.sum("c").alias("total"), F.count("*").alias("distinct")))


def text_counts(turns: DataFrame) -> DataFrame:
    """(kind, total, distinct) from one pass over the text: kind 0 agent words, 1 customer words, 2 and 3
    customer n-grams. One explode and one shuffle by term serve the vocabulary and the n-gram scores."""
    asked = F.col("speaker").eqNullSafe("customer")
    said = turns.select("conversation_id", "turn_idx", asked.alias("asked"), words(F.col("text")).alias("w"))
    w = F.col("w")
    customer = F.concat(_counted(w, 1), *[_counted(inner_ngrams(w, n), n) for n in (2, 3)])
    inside = said.select(F.inline(F.when(F.col("asked"), customer).otherwise(_counted(w, 0))))
    crossing = crossing_ngrams(said.filter("asked"), ["conversation_id", "turn_idx"], "w", (2, 3))
    return (inside.unionByName(crossing).groupBy("n", "gram").agg(F.sum("count").alias("c"))
            .groupBy(F.col("n").alias("kind")).agg(F.sum("c").alias("total"), F.count("*").alias("distinct")))


def _text_scores(turns: DataFrame) -> DataFrame:
    """(metric, value) of the vocabulary and n-gram parts of the diversity."""
    def of(kind: int, c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))

    row = text_counts(turns).agg(*[of(k, c).alias(f"{c}_{k}") for k in range(4) for c in ("total", "distinct")])
    richness = [ratio(F.col(f"distinct_{k}"), F.col(f"total_{k}")) for k in (1, 0)]
    score = {n: ngram_score(F.col(f"total_{n}"), F.col(f"distinct_{n}"), n) for n in (2, 3)}
    values = {"customer_types": F.col("distinct_1"), "agent_types": F.col("distinct_0"),
              "vocabulary": (richness[0] + richness[1]) / 2, "bigram_diversity": score[2],
              "trigram_diversity": score[3], "ngram": (score[2] + score[3]) / 2}
    return _as_metrics(row.withColumns(values), list(values))


def ngram_score(total: Column, distinct: Column, n: Column | int) -> Column:
    """Distinct over total n-grams against what a text of that length is expected to reach."""
    length = total + n - 1
    expected = F.least(F.lit(0.3), 1.0 / F.pow(length.cast("double"), F.lit(0.3)))
    return F.when(total > 0, F.least(F.lit(1.0), (distinct / total) / (expected * 2))).otherwise(F.lit(0.0))


def ngram_diversity(turns: DataFrame, within_turn: bool = False) -> DataFrame:
    """bigram and trigram diversity and their mean."""
    counts = ngram_counts(turns, within_turn=within_turn)

    def of(n: int, c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0))

    row = counts.agg(*[of(n, c).alias(f"{c}_{n}") for n in (2, 3) for c in ("total", "distinct")])
    score = {n: ngram_score(F.col(f"total_{n}"), F.col(f"distinct_{n}"), n) for n in (2, 3)}
    return row.withColumns({"bigram_diversity": score[2], "trigram_diversity": score[3],
                            "ngram": (score[2] + score[3]) / 2})


def _seen(column: str, values: list[str]) -> Column:
    return sum((F.coalesce(F.max((F.col(column) == v).cast("int")), F.lit(0)) for v in values), F.lit(0))


def _enum_variety() -> dict[str, Column]:
    sentiments, resolutions = _seen("sentiment", SENTIMENTS), _seen("resolution_status", RESOLUTIONS)
    return {"sentiments": sentiments, "sentiment_variety": sentiments / len(SENTIMENTS),
            "resolutions": resolutions, "resolution_variety": resolutions / len(RESOLUTIONS)}


def _intent_variety(heads: DataFrame) -> DataFrame:
    intents = heads.groupBy("intent").agg(F.count("*").alias("n"))
    n = F.countDistinct(F.coalesce("intent", F.lit("")))
    return metric(intents, unique_intents=n, intent_variety=n / len(INTENTS))


def label_variety(heads: DataFrame) -> DataFrame:
    """Distinct intents (missing counts as one), valid sentiments, valid resolutions, with their ratios."""
    return _intent_variety(heads).unionByName(metric(heads, **_enum_variety()))


def _as_metrics(row: DataFrame, names: list[str]) -> DataFrame:
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))


def _diversity_parts(corpus: Corpus) -> list[DataFrame]:
    """The parts that need a pass of their own: intents, opening messages, words."""
    return [_intent_variety(corpus.heads), category_coverage(corpus.heads),
            _as_metrics(message_variety(corpus.light), ["unique_messages", "conversations", "message_variety"]),
            _text_scores(corpus.turns)]


DIVERSITY_PARTS = ["unique_intents", "intent_variety", "unique_messages", "conversations", "message_variety",
                   "customer_types", "agent_types", "vocabulary", "bigram_diversity", "trigram_diversity", "ngram",
                   "sentiment_variety", "resolution_variety", "category_coverage"]


def _diversity_score() -> Column:
    w = DIVERSITY_WEIGHTS
    score = (w["intent"] * F.col("intent_variety") + w["message"] * F.col("message_variety")
             + w["vocabulary"] * F.col("vocabulary") + w["ngram"] * F.col("ngram")
             + w["sentiment"] * F.col("sentiment_variety") + w["resolution"] * F.col("resolution_variety")
             + w["category"] * F.col("category_coverage"))
    return F.when(F.col("conversations") == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def diversity(corpus: Corpus) -> DataFrame:
    """One row with the score and all its parts; 0 for an empty dataset."""
    row = to_row([*_diversity_parts(corpus), metric(corpus.heads, **_enum_variety())], DIVERSITY_PARTS)
    return row.withColumn("diversity", _diversity_score())


def diversity_warnings(diverse: DataFrame) -> DataFrame:
    """Adds ``warnings`` to a diversity row."""
    few = (F.col("unique_intents") < 10) & (F.col("conversations") >= 50)
    alike = (F.col("message_variety") < 0.5) & (F.col("conversations") > 0)
    return diverse.withColumn("warnings", compact(
        F.when(few, F.concat(F.lit("Low intent variety: only "), F.col("unique_intents").cast("int").cast("string"),
                             F.lit(" unique intents"))),
        F.when(alike, F.concat(F.lit("Low message variety: "),
                               percent(F.col("message_variety"), 1),
                               F.lit(" unique messages")))))


# ---------------------------------------------------------------- all of it

def _counted_facts(facts: DataFrame) -> DataFrame:
    """(metric, value) of all that one pass over the facts can count: checks, gaps, messages."""
    n, turns = F.count("*"), F.coalesce(F.sum("n_turns"), F.lit(0))
    filled = F.coalesce(F.sum(F.col("filled_speakers") + F.col("filled_texts")), F.lit(0))
    present = {f: _sum(_present(f)) for f in REQUIRED}
    passed = {rule: _sum(c) for rule, c in _checks().items()}
    failed = {rule: n - c for rule, c in passed.items()}
    of = lambda severity: sum((failed[r] for r in failed if SEVERITY[r] == severity), F.lit(0))
    total = n * len(REQUIRED) + 2 * turns
    return metric(
        facts,
        completeness=ratio(sum(present.values(), filled), total),
        consistency=ratio(sum(passed.values(), F.lit(0)), n * len(passed)),
        # three messages at most are given per missing field
        gaps=sum((F.least(n - c, F.lit(EXAMPLES)) for c in present.values()), F.lit(0)),
        failed_issues=of("issue"), failed_warnings=of("warning"), **_turn_realism(), **_enum_variety())


def quality(corpus: Corpus, reference: DataFrame) -> DataFrame:
    """One row: the four scores, the overall score (0..100), and counts of issues and warnings.

    Five passes: one over the facts for all that can be counted, one over the intents (a table of
    counts that its three users share), one over the opening messages, two over the words.
    """
    names = ["completeness", "consistency", "realism", "diversity"]
    row = to_row([_counted_facts(corpus.facts), intent_match(corpus.heads, reference), *_diversity_parts(corpus)],
                 [*names[:2], *REALISM_PARTS[:2], "turn_realism", "reference_intents", "gaps", "failed_issues",
                  "failed_warnings", *DIVERSITY_PARTS])
    row = row.withColumns({"realism": _realism_score(), "diversity": _diversity_score()})
    overall = sum((0.25 * F.col(n) for n in names), F.lit(0.0)) * 100
    some = F.col("conversations") > 0
    return diversity_warnings(row).select(
        F.col("conversations").cast("bigint").alias("conversations"), *names, overall.alias("overall"),
        (F.col("gaps") + F.col("failed_issues") + (~some).cast("int")).cast("bigint").alias("issues"),
        (F.col("failed_warnings") + F.size("warnings") + (some & (F.col("reference_intents") == 0)).cast("int"))
        .cast("bigint").alias("warnings"))


def verdict(overall: Column) -> Column:
    """PASS from 85, WARN from 70, else FAIL."""
    return F.when(overall >= 85, "PASS").when(overall >= 70, "WARN").otherwise("FAIL")


def estimate(facts: DataFrame) -> DataFrame:
    """The light estimate from single rows: one row with four scores, 0 for an empty dataset."""
    filled = [truthy(F.col(c)) for c in ("conversation_id", "intent", "sentiment")] + [F.col("n_turns") > 0]
    present = sum((c.cast("int") for c in filled), F.lit(0)) / 4
    ordered = F.when(F.col("n_turns") == 0, F.lit(0.0)).when(
        F.coalesce(F.col("first_speaker") == "customer", F.lit(False)) & (F.col("longest_run") <= 1), F.lit(1.0)
    ).otherwise(F.lit(0.5))
    rows = metric(facts, n=F.count("*"), completeness=F.avg(present), consistency=F.avg(ordered))
    intents = metric(facts.filter(truthy(F.col("intent"))).select("intent").distinct(), intents=F.count("*"))
    row = to_row([rows, intents], ["n", "completeness", "consistency", "intents"])
    some = F.col("n") > 0
    return row.select(
        F.coalesce("completeness", F.lit(0.0)).alias("completeness"),
        F.coalesce("consistency", F.lit(0.0)).alias("consistency"),
        F.when(some, F.lit(0.75)).otherwise(F.lit(0.0)).alias("realism"),
        F.least(F.lit(1.0), 1.5 * ratio(F.col("intents"), F.col("n"))).alias("diversity"))


def quality_summary(scores: DataFrame) -> DataFrame:
    """(metric, value, percentage, threshold, status) per score, plus the ``overall`` mean.

    ``scores`` is any (metric, value) table; metrics without a threshold of their own use 0.8.
    """
    limits = F.create_map(*[F.lit(x) for kv in SUMMARY_THRESHOLDS.items() for x in kv])
    limit = F.coalesce(F.element_at(limits, F.col("metric")), F.lit(0.8))
    each = scores.select("metric", "value", limit.alias("threshold"),
                         F.when(F.col("value") >= limit, "good")
                         .when(F.col("value") >= limit * 0.8, "warning").otherwise("error").alias("status"))
    mean = scores.agg(F.avg("value").alias("value"), F.count("*").alias("n")).filter("n > 0").select(
        F.lit("overall").alias("metric"), "value", F.lit(None).cast("double").alias("threshold"),
        F.when(F.col("value") >= 0.85, "good").when(F.col("value") >= 0.70, "warning")
        .otherwise("error").alias("status"))
    return each.unionByName(mean).select("metric", "value", (F.col("value") * 100).alias("percentage"),
                                         "threshold", "status")
