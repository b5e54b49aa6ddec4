"""Text and JSON column functions; all of them run inside the JVM except ``fold_accents``."""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

from dialoom.session import small_batches

# The characters Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Letters, numbers and underscore: what Python's \w matches (Java's own \w is ASCII only).
WORD = r"[\p{L}\p{N}_]+"
PUNCTUATION = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it.

    Nested column expressions otherwise multiply: each mention is a full copy in the plan.
    """
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def strip(c: Column) -> Column:
    """Removes white space at both ends; linear in the text length (no regular expression)."""
    return F.btrim(c, F.lit(WHITESPACE))


def truthy(c: Column) -> Column:
    """True when a string is neither NULL nor empty; never NULL."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def words(c: Column) -> Column:
    """Lower-cased words in order; an empty array for NULL."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)),
                      F.array().cast("array<string>"))


def normalised(c: Column) -> Column:
    """Lower case, stripped, without punctuation: the form used to compare messages."""
    return F.regexp_replace(strip(F.lower(c)), PUNCTUATION, "")


def between(c: Column, opening: str, closing: str) -> Column:
    """From the first ``opening`` to the last ``closing`` (one character each); NULL without such a span."""
    def cut(text: Column, start: Column, stop: Column) -> Column:
        return F.when((start > 0) & (stop > start), F.substring(text, start, stop - start + 1))

    return let(c, lambda text: let(
        F.struct(F.instr(text, opening).alias("start"),
                 (F.length(text) - F.instr(F.reverse(text), closing) + 1).alias("stop"),
                 (F.instr(text, closing) > 0).alias("closed")),
        lambda at: F.when(at["closed"], cut(text, at["start"], at["stop"]))))


_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}


def strict_json(c: Column) -> Column:
    """``c`` when it is exactly one JSON object or array, else NULL.

    Spark's JSON reader stops after the first value, so trailing text would pass. The text is
    therefore read as an object member *and* as an array element: only a single complete value
    fits both places. Duplicate keys stay legal (the last one wins when read with a schema).
    """
    def one_value(text: Column) -> Column:
        member = F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x STRING, _bad STRING", _STRICT)
        element = F.from_json(F.concat(F.lit('{"x":['), text, F.lit("]}")), "x ARRAY<STRING>, _bad STRING", _STRICT)
        as_member = let(member, lambda r: r["_bad"].isNull() & r["x"].isNotNull())
        as_element = let(element, lambda r: r["_bad"].isNull() & (F.size(r["x"]) == 1))
        return F.when(text.rlike(r"^[\[{]") & as_member & as_element, text)

    return let(strip(c), one_value)


def fenced(c: Column) -> Column:
    """Content of the first Markdown code fence (``json`` fences first); the text itself if none.

    An unclosed or empty fence leaves the text unchanged.
    """
    def inside(text: Column, mark: str) -> Column:
        return let(F.instr(text, mark) + len(mark), lambda start: let(
            F.position(F.lit("```"), text, start),
            lambda stop: F.when(stop > start, strip(F.substring(text, start, stop - start))).otherwise(text)))

    return let(c, lambda text: F.when(F.instr(text, "```json") > 0, inside(text, "```json"))
               .when(F.instr(text, "```") > 0, inside(text, "```"))
               .otherwise(text))


@functools.cache
def _marks() -> str:
    """The pattern of runs of combining characters."""
    return "[" + "".join(ch for ch in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(ch)) + "]+"


def fold_accents(c: Column) -> Column:
    """Letters without their accents. Spark has no Unicode normalisation, hence an Arrow UDF, on batches of bounded size."""
    small_batches(SparkSession.active())
    marks = _marks()

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:        # needs nothing of this package on the executors
        import re
        import unicodedata

        drop = re.compile(marks).sub        # compiled once in a worker
        return texts.map(lambda t: t if t is None or t.isascii() else drop("", unicodedata.normalize("NFKD", t)))

    # plain ASCII, most of the text, stays in the JVM: only NULLs are sent for it
    return F.coalesce(fold(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)
