"""Training rows, label weights, splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoom.functions.dims import uniform, written
from dialoom.functions.text import strip, truthy


def training_pairs(facts: DataFrame) -> DataFrame:
    """(conversation_id, text, label): first customer message and intent; rows lacking either are left out."""
    text = strip(F.col("first_customer_text"))
    return facts.select("conversation_id", text.alias("text"), F.col("intent").alias("label"))\
        .filter(truthy(F.col("text")) & truthy(F.col("label")))


def skipped(facts: DataFrame) -> DataFrame:
    """One row: kept, skipped."""
    keep = truthy(strip(F.col("first_customer_text"))) & truthy(F.col("intent"))
    kept = F.count_if(keep)
    return facts.agg(kept.alias("kept"), (F.count("*") - kept).alias("skipped"))


def encode(pairs: DataFrame) -> DataFrame:
    """(label, code): the sorted labels numbered from 0. One row per class.

    Two levels: the labels before a prefix of two characters, then the place among those that share it.
    """
    labels = pairs.select("label").distinct().withColumn("_p", F.substring("label", 1, 2))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)        # one row per prefix
    starts = labels.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("label"))
    return labels.withColumn("_i", place).join(starts, "_p").select("label", (F.col("_start") + F.col("_i") - 1).cast("int").alias("code"))


def balanced_weights(pairs: DataFrame) -> DataFrame:
    """Adds ``weight`` = n / (classes * n of the class): every class weighs the same in total."""
    counts = pairs.groupBy("label").agg(F.count("*").alias("_n"))
    sums = counts.agg((F.sum("_n") / F.count("*")).alias("share"))
    weights = counts.select("label", (sums.scalar() / F.col("_n")).alias("weight"))
    return pairs.join(written(weights, "weights"), "label")


def draw(key: str, seed: int) -> Column:
    return uniform(seed, F.lit("split"), F.col(key))


def ranked(rows: DataFrame, group: str, key: str, seed: int = 42, name: str = "rank") -> DataFrame:
    """Adds the rank (from 1) of each row within its group, in the order of a seeded hash.

    The same as ``row_number()`` over the group, but a group is cut into hash buckets: a row's rank is
    the size of the buckets before its own plus its place in its own. No task sees a whole group. There are about as many
    buckets as rows in a bucket.
    """
    u = draw(key, seed)
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    buckets = 1 << ((int(counts.agg(F.max("_n")).first()[0] or 1).bit_length() + 1) // 2)
    cut = rows.withColumns({"_u": u, "_bucket": F.floor(u * buckets).cast("int")})
    sizes = cut.groupBy(group, "_bucket").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_c")
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_u", key))
    out = cut.withColumn("_place", place).join(
        offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return out.withColumn(name, (F.col("_before") + F.col("_place")).cast("bigint"))\
        .drop("_u", "_bucket", "_g", "_b", "_before", "_place")


def quotas_by_remainder(counts: DataFrame, test_size: float) -> DataFrame:
    """(label, q) from (label, n): ceil(total * test_size) rows in all, by largest remainder, the first label by name on a tie."""
    parts = counts.select("label", "n", (F.col("n") * test_size).alias("x")).withColumn("q", F.floor("x"))
    row = parts.agg(F.ceil(F.sum("n") * test_size).alias("total"), F.sum("q").alias("given"), F.count("*").alias("classes")).first()
    if row["total"] < row["classes"]:
        raise ValueError(f"{row['total']} test rows are fewer than the {row['classes']} classes")
    more = parts.orderBy(F.desc(F.round(F.col("x") - F.col("q"), 9)), "label").limit(int(row["total"] - row["given"])).select("label", F.lit(1).alias("_m"))
    return parts.join(more, "label", "left").select("label", (F.col("q") + F.coalesce("_m", F.lit(0))).alias("q"))


def _borders(slim: DataFrame, quotas: DataFrame, key: str) -> DataFrame:
    """(label, _bu, _bk): the draw and key of each label's q-th row in the order of the draw; none for q = 0.

    The histogram of the draws finds the bucket that holds the border; only the rows of that bucket are ranked.
    """
    cells = 1 << 12
    cut = slim.withColumn("_bucket", F.floor(F.col("_u") * cells).cast("int"))
    hist = cut.groupBy("label", "_bucket").agg(F.count("*").alias("_c")).withColumn(
        "_upto", F.sum("_c").over(Window.partitionBy("label").orderBy("_bucket")))
    held = hist.join(quotas, "label").filter((F.col("_upto") >= F.col("q")) & (F.col("_upto") - F.col("_c") < F.col("q")))
    held = held.select("label", "_bucket", (F.col("q") - F.col("_upto") + F.col("_c")).alias("_left"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("_u", key))
    near = cut.join(written(held, "borders"), ["label", "_bucket"])
    return near.withColumn("_i", place).filter(F.col("_i") == F.col("_left")).select("label", F.col("_u").alias("_bu"), F.col(key).alias("_bk"))


def split(pairs: DataFrame, test_size: float = 0.2, seed: int = 42, exact: bool = False,
          key: str = "conversation_id") -> tuple[DataFrame, DataFrame]:
    """(train, test). By default by hash threshold: no shuffle, stratified in expectation.

    ``exact``: ceil(n * test_size) test rows in all; if every class has at least two rows, in the shares of the classes. Then the rows
    are read once for a histogram of their draws, and each row is decided by its own draw and the border of its label: no text moves.
    """
    u = draw(key, seed)
    if not exact:
        test = u < test_size
        return pairs.filter(~test), pairs.filter(test)
    counts = pairs.groupBy("label").agg(F.count("*").alias("n"))
    smallest = counts.agg(F.min("n")).first()[0] or 0
    stratified = smallest >= 2
    label = F.col("label") if stratified else F.lit("all")
    slim = pairs.select(label.alias("label"), key, u.alias("_u"))
    if stratified:
        quotas = quotas_by_remainder(counts, test_size)
    else:
        quotas = counts.agg(F.ceil(F.sum("n") * test_size).alias("q")).select(F.lit("all").alias("label"), "q")
    borders = written(_borders(slim, quotas, key), "borders").withColumnRenamed("label", "_l")
    marked = pairs.withColumn("_u", u).join(borders, label.eqNullSafe(F.col("_l")), "left")
    test = F.coalesce((F.col("_u") < F.col("_bu")) | ((F.col("_u") == F.col("_bu")) & (F.col(key) <= F.col("_bk"))), F.lit(False))
    drop = ["_u", "_l", "_bu", "_bk"]
    return marked.filter(~test).drop(*drop), marked.filter(test).drop(*drop)


def folds(pairs: DataFrame, k: int = 5, seed: int = 42, exact: bool = False, key: str = "conversation_id") -> DataFrame:
    """Adds ``fold`` in 0..k-1: by hash, or exactly even within each label."""
    if exact:
        return ranked(pairs, "label", key, seed).withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank")
    return pairs.withColumn("fold", F.floor(draw(key, seed) * k).cast("int"))
