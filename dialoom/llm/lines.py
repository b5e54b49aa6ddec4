"""Line deduplication by a range-partitioned sort of line hashes; the result are keep bitmaps, not texts.

Every document sends one row per distinct line key: its 128-bit hash and the places where it stands. The rows are
range-partitioned and sorted by (hash, id), so the rows of a frequent line spread over as many partitions as they need,
and one pass over a partition sees the documents of a line one after the other. A pass holds at most ``min_docs`` rows
back. Only the first and the last line of a partition can go on in another one; their counts are summed by hash.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import apart, free_names, pieces, same_row, stored

SPACE = b" \t\n\x0b\x0c\r"
_ROW = "h1 bigint, h2 bigint, id {id}, th bigint, n int, at array<int>"


def line_keys(text: bytes | None, min_chars: int) -> tuple[int, dict[bytes, list[int]]]:
    """The number of lines, and for each key of at least ``min_chars`` code points the places of its lines."""
    lines = (text or b"").split(b"\n")
    places: dict[bytes, list[int]] = {}
    for i, line in enumerate(lines):
        key = line.strip(SPACE).lower()
        if len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
            places.setdefault(key, []).append(i)
    return len(lines), places


def _rows_of(min_chars: int):
    def run(batches):
        for batch in batches:
            out = []
            kind = batch.schema.field(0).type
            for rows, texts in pieces(batch, 2):
                ids, ths = (batch.column(i).slice(rows.start, len(rows)).to_pylist() for i in (0, 1))
                for id_, th, text in zip(ids, ths, texts):
                    n, places = line_keys(text, min_chars)
                    for key, at in places.items():
                        h = xxhash.xxh3_128_digest(key)
                        out.append((h[:8], h[8:], id_, th, n, at))
                        if len(out) >= 20_000:
                            yield _batch(out, kind)
                            out = []
            yield _batch(out, kind)
    return run


def _batch(out, kind):
    h1, h2, ids, ths, ns, ats = zip(*out) if out else ((),) * 6
    longs = lambda x: pa.array(np.frombuffer(b"".join(x), np.int64))
    return pa.RecordBatch.from_arrays([longs(h1), longs(h2), pa.array(ids, kind), pa.array(ths, pa.int64()), pa.array(ns, pa.int32()),
                                       pa.array(ats, pa.list_(pa.int32()))], names=["h1", "h2", "id", "th", "n", "at"])


def _stream(min_docs: int, keep_first: bool):
    """One pass over sorted rows. Kinds of rows that come out: 0 drop, 1 open (the line may go on elsewhere), 2 count.

    A line that has reached ``min_docs`` rows is decided at once, its further rows go straight out.
    """
    def run(batches):
        key = lead = kind = None
        count, held, whole = 0, [], False       # whole: the line began in this partition
        out: list[tuple] = []

        def close(last: bool):
            """Ends the current line: what is held stays in the texts, unless the line may go on elsewhere."""
            nonlocal held
            if key is not None and (last or not whole):
                out.extend((1, *row) for row in held)
                out.append((2, *key, *lead, 0, [], count))
            held = []

        for batch in batches:
            kind = batch.schema.field(2).type
            for h1, h2, id_, th, n, at in zip(*(c.to_pylist() for c in batch.columns)):
                if (h1, h2) != key:
                    began = key is not None
                    close(False)
                    key, lead, count, whole = (h1, h2), (id_, th), 0, began
                count += 1
                row = (h1, h2, id_, th, n, at, 0)
                if keep_first and (id_, th) == lead:
                    if not whole:               # an earlier partition may hold the first one
                        out.append((1, *row))
                        row = None
                    else:
                        row = (h1, h2, id_, th, n, at[1:], 0)
                if count < min_docs:
                    if row:
                        held.append(row)
                else:
                    out.extend((0, *r) for r in held)
                    held = []
                    if row:
                        out.append((0, *row))
                if len(out) >= 20_000:
                    yield _flagged(out, kind)
                    out = []
        if kind is not None:
            close(True)
            yield _flagged(out, kind)
    return run


def _flagged(out, kind):
    types = [pa.int8(), pa.int64(), pa.int64(), kind, pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64()]
    columns = list(zip(*out)) if out else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      names=["kind", "h1", "h2", "id", "th", "n", "at", "docs"])


def _bitmaps(batches):
    for batch in batches:
        keep, gone = [], []
        for n, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            bits = np.ones(n, bool)
            for at in parts:
                bits[at] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
            gone.append(n - int(bits.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(gone, pa.int32()), pa.array(keep, pa.binary())],
                                         names=["id", "th", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1,
                 keep_first: bool = False) -> DataFrame:
    """(id, th, n_lines, n_dropped, keep) of every document that loses lines; th is the xxhash64 of its text.

    Texts are cut at \\n; a null or empty text is one empty line. A line's key is the line without white space
    (0x20, 0x09-0x0D) at both ends and with A-Z lower-cased. Keys of at least ``min_chars`` code points that
    stand in at least ``min_docs`` documents lose all their lines, with ``keep_first`` all but the first one in order
    of (id, place). Every row counts as a document; rows with equal id and text get the same bitmap. Null ids are
    an id like others. ``keep`` is a zlib-compressed bitmap, bit i (highest bit of a byte first) for line i.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    schema = _ROW.format(id=kind)
    rows = stored(source.mapInArrow(_rows_of(min_chars), schema), "line-rows")
    ranged = rows.repartitionByRange("h1", "h2", "id", "th").sortWithinPartitions("h1", "h2", "id", "th")
    flagged = stored(ranged.mapInArrow(_stream(min_docs, keep_first), f"kind tinyint, {schema}, docs bigint"), "line-flags")
    # at most two counts and 2 * min_docs open rows come from a partition
    counts = flagged.filter("kind = 2").groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.min(F.struct("id", "th")).alias("lead"))
    opened = flagged.filter("kind = 1").join(counts, ["h1", "h2"]).filter(F.col("total") >= min_docs)
    if keep_first:
        leads = F.struct("id", "th") == F.col("lead")
        opened = opened.withColumn("at", F.when(leads, F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0)))).otherwise(F.col("at")))
    drops = flagged.filter("kind = 0").select("id", "th", "n", "at").union(opened.select("id", "th", "n", "at"))
    grouped = drops.filter(F.size("at") > 0).groupBy("id", "th").agg(F.max("n").alias("n"), F.collect_set("at").alias("parts"))
    return grouped.mapInArrow(_bitmaps, f"id {kind}, th bigint, n_lines int, n_dropped int, keep binary")


def kept_lines(text: bytes | None, keep: bytes | None) -> tuple[int, int, bytes]:
    """(lines before, lines dropped, the remaining text) of a document and its bitmap, if it has one."""
    lines = (text or b"").split(b"\n")
    if keep is None:
        return len(lines), 0, text or b""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:len(lines)].view(bool)
    return len(lines), len(lines) - int(bits.sum()), b"\n".join(compress(lines, bits))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "keep") -> DataFrame:
    """``docs`` with the column ``keep`` (null: all lines stay). Only rows that may have a bitmap move. ``bitmaps`` should be a written table."""
    id_, th = free_names(docs, "id", "th")
    stay, others = apart(docs, bitmaps, id_col, text_col)
    marks = bitmaps.select(F.col("id").alias(id_), F.col("th").alias(th), F.col("keep").alias(keep))
    found = others.join(marks, same_row(others, id_col, text_col, id_, th), "left").drop(id_, th)
    return stay.withColumn(keep, F.lit(None).cast("binary")).unionByName(found)


def _digests(batches):
    for batch in batches:
        for rows, texts in pieces(batch, 1):
            n, gone, sha = [], [], []
            for text, keep in zip(texts, batch.column(2).slice(rows.start, len(rows)).to_pylist()):
                lines, dropped, left = kept_lines(text, keep)
                n.append(lines)
                gone.append(dropped)
                sha.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, len(rows)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                                             names=["id", "n_lines", "n_dropped", "kept_sha256"])


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of every row; the options are those of ``keep_bitmaps``."""
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = with_bitmaps(plain, stored(keep_bitmaps(plain, "id", "text", **options), "line-bitmaps"), "id", "text")
    return joined.mapInArrow(_digests, f"id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string").withColumnRenamed("id", id_col)


def _cleaned(column: int):
    """Rows whose last column is a bitmap, without it: the lines are taken out of column number ``column``."""
    def run(batches):
        for batch in batches:
            for rows, texts in pieces(batch, column):
                part = batch.slice(rows.start, len(rows))
                keeps = part.column(part.num_columns - 1).to_pylist()
                left = pa.array([t if k is None else kept_lines(t, k)[2] for t, k in zip(texts, keeps)], pa.binary()).cast(part.schema.field(column).type)
                yield part.set_column(column, part.schema.field(column), left).select(range(part.num_columns - 1))
    return run


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the lines dropped from ``text_col``; all columns and rows stay, null texts stay null. Other columns may have any name."""
    (keep,) = free_names(docs, "keep")
    joined = with_bitmaps(docs, stored(keep_bitmaps(docs, id_col, text_col, **options), "line-bitmaps"), id_col, text_col, keep)
    cut = joined.filter(F.col(keep).isNotNull()).mapInArrow(_cleaned(docs.columns.index(text_col)), docs.schema)
    return joined.filter(F.col(keep).isNull()).drop(keep).union(cut)
