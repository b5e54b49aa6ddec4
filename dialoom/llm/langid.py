"""Language identification by n-gram filters whose slots hold one bit per language.

A bit-sliced Bloom filter: slot s of a table of fixed size has bit l set if some n-gram of language l falls on s. One look-up (the AND
of an n-gram's slots) answers for all languages at once. A text's hits per language are the popcounts of the answers; a share f of
them is by chance (f = fill of the language's slice to the power of the number of probes), which is taken off.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import mix, pieces, small_batches, stored

SIZES, LOG_SLOTS, PROBES = (2, 3, 4), 18, 2


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams of all texts, the text each belongs to, whether a text has a letter).

    Texts are lower-cased; every run of other characters than letters is one separator, which n-grams may hold and
    which also stands at both ends.
    """
    points = [np.frombuffer(t.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32) if t else np.empty(0, np.uint32) for t in texts]
    sizes = np.array([len(p) + 2 for p in points])
    flat = np.zeros(sizes.sum(), np.uint64)
    ends = np.cumsum(sizes)
    for p, end in zip(points, ends):
        flat[end - 1 - len(p):end - 1] = p
    letter = _letters()[flat.astype(np.int64)]
    letter[flat == 0] = False
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]        # the first character after a word stands for its end
    keep[:-1] |= letter[1:] & ~letter[:-1]
    # two separators in a row, one that ends a word and one that starts the next, count as one
    code, owner, is_letter = np.where(letter, flat, 0)[keep], owner[keep], letter[keep]
    single = np.ones(len(code), bool)
    single[1:] = is_letter[1:] | is_letter[:-1] | (owner[1:] != owner[:-1])
    code, owner = code[single], owner[single]
    out, of = [], []
    for n in SIZES:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        for i in range(n):
            h = mix(h ^ code[i:len(code) - n + 1 + i])
        inside = owner[:len(h)] == owner[n - 1:]
        out.append(h[inside])
        of.append(owner[:len(h)][inside])
    has = np.zeros(len(texts), bool)
    has[owner] = True
    return (np.concatenate(out), np.concatenate(of), has) if out else (np.empty(0, np.uint64), np.empty(0, np.int64), has)


def _slots(keys: np.ndarray, probe: int) -> np.ndarray:
    return (mix(keys + np.uint64(probe)) >> np.uint64(64 - LOG_SLOTS)).astype(np.int64)


class LanguageFilter:
    """``table``: slots x words of 64 languages; ``names``: the language of each bit; ``usual``: the most frequent one."""

    def __init__(self, table: np.ndarray, names: list[str], usual: str | None):
        self.table, self.names, self.usual = table, names, usual
        bits = (table[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        self.chance = bits.reshape(len(table), -1)[:, :len(names)].mean(axis=0) ** PROBES

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram the bits of all languages that contain it."""
        found = self.table[_slots(keys, 0)]
        for p in range(1, PROBES):
            found &= self.table[_slots(keys, p)]
        return found

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        keys, owner, has = grams(texts)
        masks, total = self.masks(keys), np.bincount(owner, minlength=len(texts))
        share = np.zeros((len(texts), max(1, len(self.names))))
        for i, f in enumerate(self.chance):
            hits = np.bincount(owner[(masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=len(texts))
            share[:, i] = np.clip((hits / np.maximum(total, 1) - f) / max(1 - f, 1e-9), 0, 1)
        best, score = share.argmax(axis=1), share.max(axis=1)
        names = ["und" if not has[t] or self.usual is None else self.usual if score[t] == 0 else self.names[best[t]] for t in range(len(texts))]
        return names, np.where([n == "und" for n in names], 0.0, score)


def _counted(batches):
    """(gram, lang, docs): for one partition of the training rows, in how many documents of a language an n-gram stands."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for at, texts in pieces(batch, 1, 1 << 18):
            keys, owner, _ = grams(texts)
            here = langs[at.start:at.stop]
            for lang in sorted(set(here)):
                mine = (here == lang)[owner]
                of, k = owner[mine], keys[mine]
                order = np.lexsort((of, k))
                of, k = of[order], k[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (of[1:] != of[:-1])       # an n-gram counts once for each document
                k, n = np.unique(k[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array([lang] * len(k), pa.string()), pa.array(n)], names=["gram", "lang", "docs"])


def _level(counts: list[int], most: int) -> float:
    """The most that each count may give, so that all together give ``most``: small counts give all, the others equal parts of the rest."""
    left = most
    for i, n in enumerate(sorted(counts)):
        if n > left / (len(counts) - i):
            return left / (len(counts) - i)
        left -= n
    return float("inf")


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = 20_000, min_share: float = 0.02,
          ratio: float = 0.25, seed: int = 5) -> LanguageFilter:
    """Fits the filter on at most about ``max_docs`` distinct texts of ``docs`` that have a language, picked by a hash of the text.

    Equal texts of a language count once. Languages with few texts give all of theirs, the others equal parts of the rest.
    An n-gram belongs to a language if it stands in at least ``min_share`` of its training documents, and in no less than ``ratio`` of the share
    that it has in the language where it is most common. Rows without language or text are not learned from.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text <> ''")
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(seed)))
    found = rows.groupBy("lang", "h").agg(F.count("*").alias("c")).groupBy("lang").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()       # one row per language
    level = _level([r["n"] for r in found], max_docs)
    cut = {r["lang"]: int(level / r["n"] * (1 << 30)) for r in found if r["n"] > level}
    if cut:
        limit = F.create_map(*[F.lit(x) for pair in sorted(cut.items()) for x in pair])[F.col("lang")]
        rows = rows.filter(F.pmod("h", F.lit(1 << 30)) < F.coalesce(limit, F.lit(1 << 30)))
    # the bounded sample is dealt out again: few shuffled bytes, but much work to count
    rows = stored(rows.dropDuplicates(["lang", "h"]).repartition(32, "h").select("lang", "text"), "language-sample")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}       # one row per language
    names = sorted(sizes)
    table = np.zeros((1 << LOG_SLOTS, max(1, -(-len(names) // 64))), np.uint64)
    if not names:
        return LanguageFilter(table, [], None)
    of = F.create_map(*[F.lit(x) for lang in names for x in (lang, sizes[lang])])
    counts = rows.mapInArrow(_counted, "gram bigint, lang string, docs bigint").groupBy("gram", "lang").agg(F.sum("docs").alias("docs"))
    shares = counts.withColumn("share", F.col("docs") / of[F.col("lang")]).filter(F.col("share") >= min_share).filter("docs > 1")
    top = shares.groupBy("gram").agg(F.max("share").alias("top"))
    members = shares.join(top, "gram").filter(F.col("share") >= ratio * F.col("top"))
    # the slots that each language fills: at most one row per slot and 64 languages reach the driver
    bit = F.create_map(*[F.lit(x) for i, lang in enumerate(names) for x in (lang, i)])[F.col("lang")]

    def cells(batches):
        for batch in batches:
            k = batch.column(0).to_numpy().view(np.uint64)
            bits = batch.column(1).to_numpy()
            at = np.concatenate([_slots(k, p) for p in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(bits, PROBES))], names=["slot", "bit"])

    merged = members.select("gram", bit.alias("bit")).mapInArrow(cells, "slot bigint, bit int").groupBy("slot", F.expr("bit div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("mask")).toArrow()
    table[merged["slot"].to_numpy(), merged["word"].to_numpy()] = merged["mask"].to_numpy().view(np.uint64)
    docs_of = {r["lang"]: r["c"] for r in found}
    return LanguageFilter(table, names, max(names, key=lambda x: (docs_of[x], x)))


def _predicted(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for at, texts in pieces(batch, 1, 1 << 18):
                names, score = m.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at.start, len(at)), pa.array(names), pa.array(score)],
                                                 names=["id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; only id and text are looked at.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Otherwise the language with the largest corrected share of the
    text's n-grams, the first by name among equal ones; score is that share (0 to 1). If no n-gram is known, the most frequent
    language of the training rows with score 0. Ids may be null or repeated; an empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)      # a table of fixed size
    return docs.select(id_col, text_col).mapInArrow(_predicted(sent), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def with_language(docs: DataFrame, model: LanguageFilter, min_score: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``min_score``, unchanged. Texts do not move."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def run(batches):
        m = sent.value
        for batch in batches:
            keep = []
            for _, texts in pieces(batch, column, 1 << 18):
                names, score = m.predict(texts)
                keep += [n != "und" and s >= min_score for n, s in zip(names, score)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
