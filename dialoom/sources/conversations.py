"""Conversation files: JSON arrays, JSON lines, Parquet, CSV; reports and exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dialoom.functions.text import strip
from dialoom.sources.arrays import array_records
from dialoom.schema import CONVERSATION, REFERENCE

JSON_ARRAY_ROWS = 1000      # from this size on JSON lines are the better file format


def format_for(rows: int, tabular: bool = False) -> str:
    """The file format by size: a JSON array for few rows, JSON lines for more, Parquet for tables."""
    if tabular:
        return "parquet"
    return "json" if rows < JSON_ARRAY_ROWS else "jsonl"


def spread_small(df: DataFrame, path: str, limit: int = 512 << 20) -> DataFrame:
    """``df`` over all cores when the files at ``path`` are small in total.

    A small file is one row group, hence one task however many cores there are. Large data comes in
    enough splits by itself and is left alone: no shuffle of the raw texts.
    """
    spark = df.sparkSession
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return df.repartition(spark.sparkContext.defaultParallelism) if size < limit else df


def _or_empty(spark: SparkSession, read, schema: T.StructType) -> DataFrame:
    """The result of ``read``, or an empty table when the path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def json_roots(spark: SparkSession, path: str) -> DataFrame:
    """(file, root): the first character of every file that is not blank.

    The text up to the first comma is enough to see it, however long the one line is; only the first block of a file counts.
    """
    pieces = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), strip(F.col("value")).alias("value"),
        F.monotonically_increasing_id().alias("at")).filter("block = 0 AND value <> ''")
    # numbers of one scan task rise with the place in the file, and one task reads a block
    return pieces.groupBy("file").agg(F.min_by(F.substring("value", 1, 1), "at").alias("root"))


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, root) of the JSON files whose root is no array."""
    return json_roots(spark, path).filter("root <> '['")


def read_conversations(spark: SparkSession, path: str, fmt: str = "json",
                       schema: T.StructType = CONVERSATION) -> DataFrame:
    """Conversations from ``path``; a missing path gives no rows.

    A JSON file is one array, read by as many tasks as it has blocks; files that are none are left out, and ``rejected_files`` lists them.
    A record that is no valid JSON is a row of nulls.
    """
    def read() -> DataFrame:
        if fmt == "json":
            return array_records(spark, path).select(F.from_json("record", schema).alias("r")).select("r.*")
        if fmt == "jsonl":
            return spark.read.schema(schema).json(path)
        if fmt == "parquet":
            return spark.read.schema(schema).parquet(path)
        if fmt == "csv":
            flat = T.StructType([T.StructField(f.name, f.dataType if isinstance(f.dataType, T.AtomicType)
                                               else T.StringType()) for f in schema])
            rows = spark.read.schema(flat).csv(path, header=True, multiLine=True, escape='"')
            return rows.select(*[F.col(f.name) if isinstance(f.dataType, T.AtomicType)
                                 else F.from_json(f.name, f.dataType).alias(f.name) for f in schema])
        raise ValueError(f"unknown format {fmt!r}")

    return _or_empty(spark, read, schema)


def write_conversations(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = "language") -> None:
    """Writes a dataset; Parquet and JSON lines in one folder per language so that readers can prune."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        flatten(df).write.mode("errorifexists").csv(path, header=True, escape='"')
        return
    if by and by in df.columns:
        writer = writer.partitionBy(by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt in ("json", "jsonl"):
        writer.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields become ``a.b`` columns, arrays and maps JSON text: a table CSV can hold."""
    def columns(fields: list[T.StructField], path: list[str]) -> list[Column]:
        out = []
        for f in fields:
            here = [*path, f.name]
            c = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(f.dataType, T.StructType):
                out += columns(f.dataType.fields, here)
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append(F.to_json(c).alias(".".join(here)))
            else:
                out.append(c.alias(".".join(here)))
        return out

    return df.select(*columns(df.schema.fields, []))


def export(df: DataFrame, path: str, fmt: str) -> None:
    """The download of a dataset: JSON lines, or the flattened CSV."""
    if fmt == "json":
        df.write.mode("errorifexists").json(path)
    elif fmt == "csv":
        flatten(df).write.mode("errorifexists").csv(path, header=True, escape='"')
    else:
        raise ValueError(f"unknown format {fmt!r}")


def report(spark: SparkSession, generated_at: Column | None = None, **parts: DataFrame) -> DataFrame:
    """One row (report): a JSON document with one member per one-row frame."""
    members = [frame.select(F.to_json(F.struct("*")).alias(name)).scalar().alias(name)
               for name, frame in parts.items()]
    row = spark.range(1).select((generated_at if generated_at is not None else F.current_timestamp())
                                .alias("generated_at"), *members)
    body = [F.lit('{"generated_at":"'), F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"')]
    for name in parts:
        body += [F.lit(f',"{name}":'), F.coalesce(name, F.lit("null"))]
    return row.select(F.concat(*body, F.lit("}")).alias("report"))


def files(spark: SparkSession, folder: str, pattern: str = "*.json", skip: str = ".report.json") -> DataFrame:
    """(path, name, bytes, modified) of the dataset files below a folder, names in descending order.

    Only the listing is used; the content column is pruned away.
    """
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
               .option("recursiveFileLookup", "true").load(folder))
    name = F.element_at(F.split("path", "/"), -1)
    return (listing.select("path", name.alias("name"), F.col("length").alias("bytes"),
                           F.col("modificationTime").alias("modified"))
            .filter(~F.col("name").endswith(skip)).orderBy(F.desc("name")))


def unregistered(found: DataFrame, counts: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows plus the files not registered yet, newest first.

    ``found`` as from ``files``, ``counts`` (path, size), ``registry`` with at least id, domain, size,
    generation_date, file_path. The date of a file is the 8-digit part of its name, else its
    modification time.
    """
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    digits = F.get(F.filter(F.split(stem, "_"), lambda p: p.rlike(r"^\d{8}$")), F.lit(0))
    fresh = (found.join(registry.select(F.col("file_path").alias("path")), "path", "left_anti")
             .join(counts, "path", "left")
             .select(F.concat(F.lit("file_"), stem).alias("id"), F.lit("customer_service").alias("domain"), "size",
                     F.coalesce(F.try_to_timestamp(digits, F.lit("yyyyMMdd")), F.col("modified")).alias("generation_date"),
                     F.col("path").alias("file_path"), F.lit("file").alias("source")))
    known = registry.select("id", "domain", "size", "generation_date", "file_path", F.lit("registry").alias("source"))
    return known.unionByName(fresh).orderBy(F.desc("generation_date"), "id")


# ---------------------------------------------------------------- reference data

def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Reference examples (text, label, intent); no rows when the path does not exist."""
    return _or_empty(spark, lambda: spark.read.schema(REFERENCE).json(path, multiLine=True), REFERENCE)


def sample_reference(examples: DataFrame, names: DataFrame, order: str, n: int = 500) -> DataFrame:
    """The first n examples by ``order`` as (text, label, intent); ``names`` is (label, intent).

    The limit comes first, so the join sees n rows.
    """
    return examples.orderBy(order).limit(n).join(names, "label", "left").select("text", "label", "intent")


def sample_series(points: DataFrame, n: int = 100, m: int = 500) -> DataFrame:
    """The first m points of the first n series: (series_id, values, length).

    ``points`` is (series_id, at, value). Ranks are cut before the shuffle, so a series of any length
    sends m rows per partition.
    """
    from pyspark.sql import Window

    chosen = points.select("series_id").distinct().orderBy("series_id").limit(n)
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy("at", "value"))
    kept = points.join(F.broadcast(chosen), "series_id", "left_semi").withColumn("r", rank).filter(F.col("r") <= m)
    listed = kept.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("r", "value"))).alias("s"))
    return listed.select("series_id", F.transform("s", lambda x: x["value"]).alias("values"),
                         F.size("s").alias("length"))

