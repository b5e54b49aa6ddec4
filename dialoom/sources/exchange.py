"""The exchange with a text generator as tables: request lines out, response lines in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dialoom.functions.text import let, strict_json, strip, truthy

RESPONSE = "recordId STRING, error STRING, modelOutput STRUCT<content: ARRAY<STRUCT<text: STRING>>>"
PARSE_ERROR = "JSON parse error"


def requests(prompts: DataFrame, record_id: Column, max_tokens: int = 2000, temperature: float = 0.7,
             top_p: float = 0.9, version: str = "bedrock-2023-05-31") -> DataFrame:
    """(recordId, modelInput, metadata columns ...) from rows with ``prompt`` and ``system``.

    Everything else in ``prompts`` stays beside the request, keyed by recordId: the metadata map.
    """
    message = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    body = F.struct(
        F.lit(version).alias("anthropic_version"), F.lit(max_tokens).alias("max_tokens"),
        F.lit(temperature).alias("temperature"), F.lit(top_p).alias("top_p"),
        F.array(message).alias("messages"),
        F.when(truthy(F.col("system")), F.col("system")).alias("system"))
    rest = [c for c in prompts.columns if c not in ("prompt", "system")]
    return prompts.select(record_id.cast("string").alias("recordId"), body.alias("modelInput"), *rest)


def request_lines(made: DataFrame) -> DataFrame:
    """One JSON line per request, without the metadata."""
    return made.select(F.to_json(F.struct("recordId", "modelInput")).alias("value"))


def write_requests(made: DataFrame, path: str) -> None:
    request_lines(made).write.mode("errorifexists").text(path)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, file) of every line of one or more files or folders."""
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """(record_id, generated_text, error, raw_line, line_hash, ...): one row per line that is not blank.

    A line that is no JSON object is an error with its first 200 characters; ``line_hash`` is made of the whole line. An
    ``error`` member wins over any output.
    """
    rest = [c for c in lines.columns if c != "value"]

    def read(line: Column) -> Column:
        valid = strict_json(line)
        return let(F.when(valid.startswith("{"), valid), lambda text: let(
            F.from_json(text, RESPONSE), lambda r: fields(line, text, r)))

    def fields(line: Column, text: Column, r: Column) -> Column:
        content = r["modelOutput"]["content"]
        said = F.when((F.size(content) > 0) & ~F.array_contains(F.json_object_keys(text), "error"),
                      F.coalesce(F.get(content, F.lit(0))["text"], F.lit("")))
        error = F.when(text.isNull(), F.lit(PARSE_ERROR)).when(truthy(r["error"]), r["error"])
        return F.struct(r["recordId"].alias("record_id"), said.alias("generated_text"), error.alias("error"),
                        F.when(text.isNull(), F.substring(line, 1, 200)).alias("raw_line"), F.sha2(line, 256).alias("line_hash"))

    # inline: each line is parsed once, and later filters stay above the parsing
    return (lines.filter(strip(F.col("value")) != "")
            .select(*rest, F.inline(F.array(let(strip(F.col("value")), read)))))


def results(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNull()).drop("error", "raw_line", "line_hash")


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull()).drop("generated_text")
