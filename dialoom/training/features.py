"""TF-IDF over word n-grams: counts, smoothed IDF plus one, unit length."""

from __future__ import annotations

from functools import reduce
from math import log
from operator import or_

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from dialoom.functions.dims import written
from dialoom.functions.ordered import inner_ngrams
from dialoom.functions.text import fold_accents, let

TOKEN = r"[\p{L}\p{N}_]{2,}"


def stop_words() -> list[str]:
    """Spark's English list; any other list can be passed to ``tokens``."""
    return StopWordsRemover.loadDefaultStopWords("english")


def tokens(text: Column, ngrams: tuple[int, int] = (1, 2), stop: list[str] | None = None) -> Column:
    """All n-grams of the words of two or more characters, lower-cased, without accents and stop words."""
    low, high = ngrams
    return let(_kept(text, stop), lambda k: F.concat(*[k if n == 1 else inner_ngrams(k, n) for n in range(low, high + 1)]))


def _kept(text: Column, stop: list[str] | None) -> Column:
    dropped = stop_words() if stop is None else stop
    found = F.regexp_extract_all(fold_accents(F.lower(text)), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(dropped)) if dropped else found


def with_grams(pairs: DataFrame, high: int, stop: list[str] | None = None) -> DataFrame:
    """Adds the columns grams_1 to grams_<high>: the n-grams of each length by themselves. The text is taken apart once."""
    lists = let(_kept(F.col("text"), stop), lambda k: F.struct(*[(k if n == 1 else inner_ngrams(k, n)).alias(f"grams_{n}") for n in range(1, high + 1)]))
    return pairs.select(*pairs.columns, F.inline(F.array(lists)))


def longer_grams(rows: DataFrame, high: int) -> DataFrame:
    """Adds grams_2 to grams_<high>, as ``with_grams`` makes them, to rows that have grams_1."""
    return rows.withColumns({f"grams_{n}": inner_ngrams(F.col("grams_1"), n) for n in range(2, high + 1)})


def only_grams(high: int, terms: dict[int, list[str]]) -> dict[str, Column]:
    """The columns grams_1 to grams_<high> with those n-grams alone that ``terms`` lists for their n; NULL stays NULL."""
    def kept(n: int) -> Column:
        return F.filter(f"grams_{n}", lambda t: t.isin(terms[n]) if terms.get(n) else F.lit(False))

    return {f"grams_{n}": kept(n) for n in range(1, high + 1)}


def joined_grams(ngrams: tuple[int, int]) -> Column:
    """``tokens`` from the columns of ``with_grams``."""
    return F.concat(*[F.col(f"grams_{n}") for n in range(ngrams[0], ngrams[1] + 1)])


def _cell(n: int, cells: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(cells)) + F.lit(n * cells)


def gram_cells(rows: DataFrame, high: int, low: int, cells: int) -> DataFrame:
    """(cell, total): how many n-grams of ``with_grams`` fall into each of ``cells`` hash cells for each n."""
    each = [rows.select(F.explode(f"grams_{n}").alias("term")).select(_cell(n, cells).alias("cell")) for n in range(low, high + 1)]
    return reduce(DataFrame.union, each).groupBy("cell").agg(F.count("*").alias("total"))


def gram_counts(rows: DataFrame, high: int, low: int = 1, by: tuple[str, ...] = (), within: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(n, term, total, docs), for each value of the columns ``by``, of all n-grams of ``with_grams``: from this one table the vocabulary of every shorter setting can be cut.

    With ``within`` = (a few of the cells of ``gram_cells``, how many cells an n has) only of the n-grams in these cells.
    """
    def listed(n: int) -> DataFrame:
        c = F.col(f"grams_{n}")     # all n-grams of a row, then the different ones
        each = rows.select(*by, F.lit(n).alias("n"), F.size(c).alias("_all"), F.posexplode(F.concat(c, F.array_distinct(c))).alias("_at", "term"))
        if within is not None:
            each = each.withColumn("cell", _cell(n, within[1])).join(F.broadcast(within[0]), "cell", "left_semi")
        return each.select(*by, "n", "term", (F.col("_at") < F.col("_all")).cast("bigint").alias("total"), (F.col("_at") >= F.col("_all")).cast("bigint").alias("docs"))

    return reduce(DataFrame.union, map(listed, range(low, high + 1))).groupBy(*by, "n", "term").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs"))


def _frequent(counts: DataFrame, ngrams: tuple[int, int], max_features: int, min_df: int) -> DataFrame:
    """The rows of ``gram_counts`` that are a vocabulary: the largest totals, by name among equals."""
    return counts.filter(F.col("n").between(*ngrams) & (F.col("docs") >= min_df)).orderBy(F.desc("total"), "term").limit(max_features)


def frequent_counts(rows: DataFrame, settings: list[tuple[tuple[int, int], int, int]]) -> DataFrame:
    """Written ``gram_counts``, from which the vocabulary of each of ``settings`` (n-grams, max_features, min_df) can be cut as from those of all n-grams.

    No total is larger than that of its cell. So the n-grams of the heaviest cells are counted; if they show that a vocabulary may reach
    into lighter ones, those are counted too, down to its smallest total (all of them if there are not enough terms). What is shuffled is
    cells and frequent n-grams, instead of all the n-grams that stand in one place.
    """
    low, high = min(s[0][0] for s in settings), max(s[0][1] for s in settings)
    most = max(s[1] for s in settings)
    cells = 1 << max(18, (64 * most - 1).bit_length())
    sums = written(gram_cells(rows, high, low, cells), "gram-cells")
    of = {n: F.col("cell").between(n * cells, (n + 1) * cells - 1) for n in range(low, high + 1)}

    def smallest(df: DataFrame, k: int) -> int:     # of k totals; fewer are all there are
        found = df.agg(F.min("total"), F.count("*")).first()
        return found[0] if found[1] == k else 1

    least = {n: smallest(sums.filter(of[n]).orderBy(F.desc("total")).limit(4 * most), 4 * most) for n in of}
    while True:
        heavy = sums.filter(reduce(or_, [of[n] & (F.col("total") >= least[n]) for n in of])).select("cell")
        everything = max(least.values()) <= 1
        counts = written(gram_counts(rows, high, low, within=None if everything else (heavy, cells)), "gram-counts")
        needed = [(s, smallest(_frequent(counts, *s), s[1])) for s in settings]
        wanted = {n: min([total for s, total in needed if s[0][0] <= n <= s[0][1]], default=least[n]) for n in of}
        if all(least[n] <= wanted[n] for n in of):
            return counts
        least = {n: min(least[n], wanted[n]) for n in of}


def vocabularies(counts: DataFrame, settings: list[tuple[tuple[int, int], int, int]]) -> dict[int, list[str]]:
    """n -> the n-grams that are in any of the vocabularies."""
    terms: dict[int, list[str]] = {}
    for r in reduce(DataFrame.union, [_frequent(counts, *s).select("n", "term") for s in settings]).distinct().collect():
        terms.setdefault(r["n"], []).append(r["term"])
    return terms


def cut_tfidf(counts: DataFrame, rows: int, ngrams: tuple[int, int], max_features: int = 5000, min_df: int = 2) -> PipelineModel:
    """The model that ``fit_tfidf`` fits, cut from the table of ``gram_counts`` without a pass over the rows.

    The vocabulary are the ``max_features`` terms of largest total, by name among equals; only these come to the driver.
    """
    found = _frequent(counts, ngrams, max_features, min_df).select("term", "docs").collect()
    if not found:
        raise ValueError("no term stands in enough rows")
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in found], inputCol="tokens", outputCol="_counts")
    scale = ElementwiseProduct(inputCol="_counts", outputCol="_scaled", scalingVec=Vectors.dense([log((1 + rows) / (1 + r["docs"])) + 1 for r in found]))
    return PipelineModel([counter, scale, Normalizer(inputCol="_scaled", outputCol="features", p=2.0)])


def with_tokens(pairs: DataFrame, ngrams: tuple[int, int] = (1, 2), stop: list[str] | None = None) -> DataFrame:
    return pairs.withColumn("tokens", tokens(F.col("text"), ngrams, stop))


def fit_tfidf(tokenised: DataFrame, max_features: int = 5000, min_df: int = 2) -> PipelineModel:
    """Fits on ``tokens``; the model adds ``features``.

    The weight of a term is count * (ln((1 + rows) / (1 + rows with the term)) + 1), rows scaled to
    length 1. The vocabulary is cut to the most frequent terms, so its size is bounded. One pass counts terms and their rows together.
    """
    counts = gram_counts(tokenised.select(F.col("tokens").alias("grams_1")), 1)
    return cut_tfidf(counts, tokenised.count(), (1, 1), max_features, min_df)


def term_weights(features: str = "features") -> Column:
    """The weights above 0 of a row's terms, in the order of the vocabulary: as long as the row has terms, however large the vocabulary is."""
    return F.filter(F.unwrap_udt(features)["values"], lambda x: x > 0)
