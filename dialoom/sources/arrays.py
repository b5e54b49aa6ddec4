"""Records of JSON files that hold one array each, read by as many tasks as a file has blocks.

Spark's text reader cuts a file at every ``}``, also in the middle of a block, so a piece may begin inside a string and at any depth. Both follow from
what stands before it: the parity of unescaped quotes and the sum of opened and closed brackets. Each block is summed up for both
possible states at its begin; the summaries, one row for each block, are chained; then every piece knows its state. A ``}`` outside of a
string that leads back to depth 1 ends a record. Nothing depends on how the file is laid out, on line breaks or indents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dialoom.functions.dims import written


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _pieces(spark: SparkSession, path: str | list[str], text: bool) -> DataFrame:
    """(file, block, at, odd, d0, d1): for every piece whether it has an odd number of quotes, and by how much it changes the depth, its
    closing brace included, if it begins outside (d0) or inside (d1) of a string."""
    value = F.col("value")
    bare = F.regexp_replace(value, r"(?s)\\.", "")
    strings = lambda c: F.regexp_replace(c, r'"[^"]*(?:"|\z)', "")
    outside = [strings(bare), strings(F.regexp_replace(bare, r'^[^"]*(?:"|\z)', ""))]
    odd = _count(bare, '"') % 2
    depth = [_count(o, "[{") - _count(o, "]") for o in outside]
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        odd.alias("odd"), (depth[0] - (odd == 0).cast("int")).alias("d0"), (depth[1] - (odd == 1).cast("int")).alias("d1"), "value")
    # numbers of one scan task rise with the place in the file, and one task reads a block
    inside = Window.partitionBy("file", "block").orderBy("at")
    before = F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    rows = rows.select("file", "block", "at", "odd", before.alias("in0"), "d0", "d1", *(["value"] if text else [F.substring(F.trim(F.regexp_replace("value", r"^\s+", "")), 1, 1).alias("root")]))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    kept = [F.when(F.col("in0") == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("d0", "d1"), ("d1", "d0"))]
    return rows.withColumns({f"upto{i}": F.sum(c).over(upto) for i, c in enumerate(kept)}).drop("d0", "d1")


def _at_start(rows: DataFrame) -> DataFrame:
    """(file, block, state, depth, root): what each block begins with."""
    ends = rows.groupBy("file", "block").agg(
        (F.sum("odd") % 2).alias("odd"), F.max_by("upto0", "at").alias("d0"), F.max_by("upto1", "at").alias("d1"),
        F.min_by(F.when(F.col("root") != "", F.col("root")), F.when(F.col("root") != "", F.col("at"))).alias("root"))
    chain = Window.partitionBy("file").orderBy("block")     # one row for each block of a file
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
    first = F.first("root", ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("file", "block", state.alias("state"), first.alias("root"), "d0", "d1")
    step = F.when(F.col("state") == 0, F.col("d0")).otherwise(F.col("d1"))
    return ends.select("file", "block", "state", F.coalesce(F.sum(step).over(earlier), F.lit(0)).alias("depth"), "root")


def _ends(rows: DataFrame) -> Column:
    """Whether the brace after a piece ends a record: it stands outside of strings, and depth 1 is left."""
    upto = F.when(F.col("state") == 0, F.col("upto0")).otherwise(F.col("upto1"))
    return ((F.col("state") + F.col("in0") + F.col("odd")) % 2 == 0) & (F.col("depth") + upto == 1)


def array_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, record): the text of every object of the arrays at ``path``. Files whose root is no array give no rows.

    Two scans: the first one only sums up the blocks. A record must fit into one row; a file may have any size. Broken
    JSON in a file may shift the borders of the records after it.
    """
    slim = _pieces(spark, path, text=False)
    starts = written(_at_start(slim), "array-blocks")
    found = slim.join(starts.drop("root"), ["file", "block"])
    counts = found.groupBy("file", "block").agg(F.count_if(_ends(found)).alias("ends"))
    # a block's first pieces belong to the record that the last block with an end has left open, or else to the file's first one
    chain = Window.partitionBy("file").orderBy("block")
    with_end = F.last(F.when(F.col("ends") > 0, F.struct("block", "ends")), ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, -1))
    first = F.struct(F.first("block").over(chain.rowsBetween(Window.unboundedPreceding, 0)).alias("block"), F.lit(0).cast("bigint").alias("ends"))
    homes = counts.select("file", "block", F.coalesce(with_end, first).alias("home"))
    blocks = written(starts.join(homes, ["file", "block"]), "array-homes").filter("root = '['")
    rows = _pieces(spark, path, text=True).join(blocks, ["file", "block"])
    rows = rows.select("file", "block", "at", "value", "home", _ends(rows).alias("end"))
    before = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("number", F.coalesce(F.count_if("end").over(before), F.lit(0)))
    # a record is known by the block where it begins, or would begin, and its number there
    key = F.when(F.col("number") == 0, F.col("home")).otherwise(F.struct("block", F.col("number").alias("ends")))
    records = rows.groupBy("file", key.alias("key")).agg(F.max("end").alias("whole"), F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.lit("}"))
    return records.filter("whole").select("file", F.regexp_replace(text, r"^[\s\[,]+", "").alias("record"))
