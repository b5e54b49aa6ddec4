"""Order-dependent work without a window over a hot key.

A window partitioned by conversation (or user, or series) puts a key that holds a third of all
rows into one task. Here the rows are first dealt out in buckets, ranges of (key, order, value), so that a
hot key spreads over as many buckets as its size asks for. Windows run within a bucket; what goes on
in the next one is settled on a few rows for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoom.functions.dims import written


def _bucketed(df: DataFrame, by: list[str], partitions: int | None) -> DataFrame:
    """``df`` with the column ``bucket``: the number of its range by ``by``. Ranges hold about equally many rows, whatever the keys."""
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return ranged.withColumn("bucket", F.spark_partition_id())


def longest_runs(df: DataFrame, key: Column, order: Column, value: Column,
                 only: str | None = None, partitions: int | None = None) -> DataFrame:
    """(key, longest): the longest run of equal consecutive values per key, NULL equal to NULL.

    With ``only`` just the runs of that value count (0 if it never occurs). ``key`` comes back as
    a string. A window looks back one row within a bucket of a key; a run is counted by hash aggregation, a bucket becomes one
    segment (its first, last and longest run), and the segments of a key are merged: at most one for each bucket.
    """
    coded = F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), value.cast("string")))
    hit = None if only is None else "v" + only
    slim = df.select(key.cast("string").alias("key"), order.alias("at"), coded.alias("value"))
    rows = _bucketed(slim, ["key", "at", "value"], partitions)
    inside = Window.partitionBy("key", "bucket").orderBy("at", "value")
    # the number of a run within its bucket: how many rows so far differ from the one before
    starts = rows.select("key", "bucket", "at", "value", (~F.col("value").eqNullSafe(F.lag("value").over(inside))).cast("int").alias("new"))
    runs = starts.select("key", "bucket", "value", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    runs = runs.groupBy("key", "bucket", "run").agg(F.min("value").alias("value"), F.count("*").alias("len"))
    counted = F.col("len") if hit is None else F.when(F.col("value") == hit, F.col("len")).otherwise(F.lit(0).cast("bigint"))
    ends = {"head": F.min_by("value", "run"), "head_len": F.min_by("len", "run"), "tail": F.max_by("value", "run"), "tail_len": F.max_by("len", "run")}
    segments = runs.groupBy("key", "bucket").agg(F.sum("len").alias("n"), *[c.alias(n) for n, c in ends.items()], F.max(counted).alias("longest"))
    fields = ["bucket", "n", "head", "head_len", "tail", "tail_len", "longest"]
    listed = segments.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("s"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit("").alias("tail"), zero.alias("run"), zero.alias("longest"))

    def step(acc: Column, s: Column) -> Column:
        joined = s["head_len"] + F.when(acc["tail"] == s["head"], acc["run"]).otherwise(zero)
        counts = joined if hit is None else F.when(s["head"] == hit, joined).otherwise(zero)
        return F.struct(
            s["tail"].alias("tail"),
            F.when(s["head_len"] == s["n"], joined).otherwise(s["tail_len"]).alias("run"),
            F.greatest(acc["longest"], s["longest"], counts).alias("longest"),
        )

    return listed.select("key", F.aggregate("s", start, step)["longest"].alias("longest"))


def crossing_ngrams(units: DataFrame, order: list[str], tokens: str, ns: tuple[int, ...],
                    partitions: int | None = None) -> DataFrame:
    """(n, gram, count): n-grams of the one long word sequence that cross a unit (turn) border, several rows for one n-gram.

    The sequence is the concatenation of ``tokens`` in ``order``. An n-gram that starts in a unit and ends behind it is made of the unit's last
    words and the first words that follow it, so a unit sends at most 2(n-1) words. Units are dealt out in buckets, ranges of the order; the words
    that follow come from the next units of the bucket (``lead``), and at its end from the halo: the first words of the buckets after it.
    """
    reach = max(ns) - 1
    size = F.size(tokens)
    head = F.slice(tokens, 1, reach)
    tail = F.slice(tokens, F.greatest(F.lit(1), size - reach + 1), reach)
    # Copies of one unit are counted and numbered, so the order of units is made of data only. Units without words have no part in it.
    outer = units.filter(size > 0).select(*order, F.xxhash64(tokens).alias("_hash"), head.alias("_head"), tail.alias("_tail")).groupBy(
        *order, "_hash", "_head", "_tail").agg(F.count("*").alias("_copies"))
    copies = outer.select(*order, "_hash", "_head", "_tail", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
    by = [*order, "_hash", "_copy"]
    # written once, as the range of a unit must be the same for the halo and for the window
    rows = written(_bucketed(copies, by, partitions), "ngram-units")
    inside = Window.partitionBy("bucket").orderBy(*by)

    def following(word_lists: list[Column]) -> Column:
        return F.slice(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in word_lists]), 1, reach)

    def next_ones(column: str, window) -> list[Column]:
        return [F.lead(column, i).over(window) for i in range(1, reach + 1)]

    # a bucket's first words: those of its first units, which hold a word each at least
    place = rows.select("bucket", "_head", F.row_number().over(inside).alias("_place")).filter(F.col("_place") <= reach)
    firsts = [F.max(F.when(F.col("_place") == i, F.col("_head"))) for i in range(1, reach + 1)]
    heads = place.groupBy("bucket").agg(following(firsts).alias("_head"))
    everything = Window.orderBy("bucket")       # one row for each bucket
    halo = heads.select(F.col("bucket").alias("_bucket"), following(next_ones("_head", everything)).alias("_halo"))
    last = F.lead("_copy", reach).over(inside).isNull()
    near = rows.select("bucket", "_tail", following(next_ones("_head", inside)).alias("_after"), last.alias("_last"))

    def crossing(after: Column) -> Column:
        own, more = F.size("_tail"), F.size(after)
        parts = [F.when((own >= k) & (more >= n - k), F.struct(
            F.lit(n).alias("n"), F.array_join(F.concat(F.slice("_tail", own - k + 1, k), F.slice(after, 1, n - k)), " ").alias("gram"), F.lit(1).cast("bigint").alias("count")))
            for n in ns for k in range(1, n)]
        return F.inline(F.array_compact(F.array(*parts)))

    within = near.filter(~F.col("_last")).select(crossing(F.col("_after")))
    # the last units of each bucket also look into the next buckets
    ends = near.filter("_last").join(halo, F.col("bucket") == F.col("_bucket"))
    ends = ends.select("_tail", F.slice(F.concat("_after", "_halo"), 1, reach).alias("_after")).select(crossing(F.col("_after")))
    return within.union(ends)


def inner_ngrams(tokens: Column, n: int) -> Column:
    """The n-grams inside one word array, as strings; empty when it is shorter than n."""
    grams, size = tokens, F.size(tokens)
    for shift in range(2, n + 1):
        rest = F.slice(tokens, shift, F.greatest(size, F.lit(1)))
        grams = F.zip_with(grams, rest, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(grams, 1, F.greatest(size - n + 1, F.lit(0)))
