"""Quality scores from pairwise preferences: a Bradley-Terry model with features.

A document's strength is w . x for standardised features x. Every training pair is a document labelled 1 against one
labelled 0; the chance that the first is preferred is the logistic function of the difference of strengths, so w is
fitted by logistic loss on feature differences without an intercept. Strengths have no origin: the threshold between good
and bad is the quantile of training strengths at the share of label 0, and scores are shifted so that it stands at ``cut``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import flat_words, pieces, stored, window_hashes

SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
_LOWER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _MARK, _OTHER = range(7)
CLASSES = np.full(256, _OTHER, np.uint8)
CLASSES[33:127] = _MARK
for _chars, _class in ((bytes(range(97, 123)), _LOWER), (bytes(range(65, 91)), _UPPER), (b"0123456789", _DIGIT),
                       (b" \t\n\x0b\x0c\r", _SPACE), (SYMBOLS, _SYMBOL)):
    CLASSES[list(_chars)] = _class
FEATURES = ["upper", "digit", "symbol", "bang", "bar", "mark", "other", "words", "word_size", "doubled", "distinct", "repeated",
            "lines", "same_lines", "any_symbol", "any_doubled", "shouts"]


def _per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[starts])


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of FEATURES per text; null and empty texts have zeros."""
    hashes, starts = flat_words(texts)
    n = np.diff(starts)
    owner = np.repeat(np.arange(len(texts)), n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    windows = window_hashes(hashes, 3)
    inside = owner[:-2] == owner[2:] if len(hashes) > 2 else np.zeros(0, bool)

    def distinct(keys, of):
        """The number of distinct keys of each text."""
        order = np.lexsort((keys, of))
        k, o = keys[order], of[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=len(texts))

    types = distinct(hashes, owner)
    grams = np.bincount(owner[2:][inside], minlength=len(texts)) if len(hashes) > 2 else np.zeros(len(texts))
    grams_of = distinct(windows[inside], owner[2:][inside]) if len(hashes) > 2 else np.zeros(len(texts))
    out = np.zeros((len(texts), len(FEATURES)))
    doubled = _per_text(same, starts)
    for i, text in enumerate(texts):
        if not text:
            continue
        kinds = np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=7)
        letters, solid = kinds[_LOWER] + kinds[_UPPER] + kinds[_OTHER], max(1, len(text) - kinds[_SPACE])
        lines = text.split(b"\n")
        words = max(1, n[i])
        out[i] = (kinds[_UPPER] / max(1, letters), kinds[_DIGIT] / solid, kinds[_SYMBOL] / solid, text.count(b"!") / words, text.count(b"|") / words,
                  kinds[_MARK] / solid, kinds[_OTHER] / solid, np.log1p(n[i]), np.log1p(solid / words), doubled[i] / words,
                  np.log(words / max(1, types[i])) / np.log1p(words), 1 - grams_of[i] / max(1, grams[i]) if grams[i] else 0.0,
                  np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.sqrt(kinds[_SYMBOL] / solid), np.sqrt(doubled[i] / words),
                  kinds[_UPPER] > kinds[_LOWER])
    return out


def _features_of(batches):
    for batch in batches:
        for at, texts in pieces(batch, 1):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at.start, len(at)), *(pa.array(x[:, i]) for i in range(x.shape[1]))],
                                             names=["id", *FEATURES])


def _sampled(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """About ``most`` rows at most, picked by a hash of the id: the documented bound of the training set."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   held_out=None, cut: float = 0.3, max_per_label: int = 20_000, partners: int = 8, seed: int = 7) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``; only its id and text are looked at.

    ``held_out`` is a condition on the column ``id``; labels of such rows are never used. The model is fitted on at most
    about ``max_per_label`` documents of each label (picked by hash), each one labelled 0 paired with about ``partners``
    labelled 1, and the other way round where these are fewer. score is between 0 and 1, predicted = score >= ``cut``. Null and empty texts
    are scored by their (zero) features. Labels that are null, of other values or of ids that are not in ``docs`` are ignored,
    repeated ones count once each. Without training rows of both labels all scores are 0.5. Rows with null ids are
    scored, never learned from. An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held_out = F.lit(False) if held_out is None else held_out
    table = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _features_of, ", ".join([f"id {kind}", *(f"{f} double" for f in FEATURES)])), "quality-features")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("label IN (0, 1)").distinct()
    train = stored(table.join(known, "id").filter(~F.coalesce(held_out, F.lit(False))), "quality-train")
    sides = [_sampled(train.filter(F.col("label") == y), max_per_label, seed) for y in (0, 1)]
    counts = [s.count() for s in sides]
    if min(counts) == 0:
        return table.select(F.col("id").alias(id_col), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.lit(0.5).alias("score"),
                            F.lit(int(0.5 >= cut)).alias("predicted"))
    stats = sides[0].union(sides[1]).agg(*[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES]).first()
    mean = {f: stats[f"m_{f}"] for f in FEATURES}
    scale = {f: stats[f"s_{f}"] or 1.0 for f in FEATURES}
    standard = lambda df: df.select("id", *[((F.col(f) - mean[f]) / scale[f]).alias(f) for f in FEATURES])
    # equal slots on both sides pair every document with about ``partners`` others, without a rank over all of them
    slots = max(1, max(counts) // partners)
    while True:
        slot = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(slots)).alias("slot")
        bad, good = (standard(s).select(slot, *[F.col(f).alias(f"{p}_{f}") for f in FEATURES]) for p, s in zip("bg", sides))
        pairs = good.join(bad, "slot").select(*[(F.col(f"g_{f}") - F.col(f"b_{f}")).alias(f) for f in FEATURES])
        if slots == 1 or not pairs.isEmpty():
            break
        slots //= 2         # few documents of a label may share no slot with the other label
    both = pairs.withColumn("won", F.lit(1.0)).union(pairs.select(*[(-F.col(f)).alias(f) for f in FEATURES], F.lit(0.0).alias("won")))
    both = VectorAssembler(inputCols=FEATURES, outputCol="difference").transform(both).select("difference", "won")
    model = LogisticRegression(featuresCol="difference", labelCol="won", fitIntercept=False, standardization=False, regParam=1e-4, maxIter=50).fit(both)
    weights = dict(zip(FEATURES, map(float, model.coefficients)))
    strength = sum(((F.col(f) - mean[f]) / scale[f] * w for f, w in weights.items()), F.lit(0.0))
    share = train.agg(F.avg(1 - F.col("label"))).first()[0]
    border = train.select(strength.alias("z")).agg(F.percentile_approx("z", float(share), 10_000)).first()[0]
    score = 1 / (1 + F.exp(-(strength - border) - float(np.log(cut / (1 - cut)))))
    return table.select(F.col("id").alias(id_col), F.coalesce(held_out, F.lit(False)).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= cut).cast("int"))
