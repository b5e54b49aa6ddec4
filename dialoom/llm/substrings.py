"""Substring deduplication: repeated runs of words, found by a count-min prefilter and an exact second pass.

First pass: each partition counts, for every window of ``size`` words, the smallest hash among its short runs (equal windows
have equal ones, and neighbouring windows mostly share theirs, so there are some twenty times fewer than windows). The counts of
a partition are the non-zero cells of a count-min sketch; Spark adds the cells of all partitions. Estimates are never
too small. Second pass: only windows whose estimate is two or more are hashed and sorted; a pass over the sorted rows
finds exactly those that an earlier document holds too.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import bit_filter, bits_of, flat_words, mix, pieces, small_batches, stored, window_hashes

SHORT, DEPTH = 8, 2        # words of the short runs; rows of the sketch


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    out, have = keys, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[:len(keys) - width + 1], out[width - have:]) if have < width else out


def windows(texts: list[bytes | None], size: int):
    """(window hashes, smallest short-run hash of each, text of each, place of each) of all windows inside a text."""
    hashes, starts = flat_words(texts, lower=False)
    n = len(hashes) - size + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    short = min(SHORT, size)
    low = _smallest(window_hashes(hashes, short), size - short + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    inside = owner[:n] == owner[size - 1:]
    return window_hashes(hashes, size)[inside], low[inside], owner[:n][inside], (np.arange(n) - starts[owner[:n]])[inside]


def _cell(keys: np.ndarray, row: int, log_cells: int) -> np.ndarray:
    return (np.uint64(row) << np.uint64(log_cells)) | (mix(keys + np.uint64(row + 77)) >> np.uint64(64 - log_cells))


def _counted(size: int, log_cells: int):
    """(cell, n): the part of the sketch that a batch of documents fills; a document counts once for each key."""
    def run(batches):
        for batch in batches:
            for _, texts in pieces(batch, 1):
                _, low, owner, _ = windows(texts, size)
                change = np.ones(len(low), bool)
                change[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
                low, owner = low[change], owner[change]
                order = np.lexsort((owner, low))
                low, owner = low[order], owner[order]
                change = np.ones(len(low), bool)
                change[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
                keys, n = np.unique(low[change], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_cell(keys, r, log_cells) for r in range(DEPTH)]).astype(np.int64)),
                                                  pa.array(np.tile(n, DEPTH))], names=["cell", "n"])
    return run


def _repeated(size: int, log_cells: int, sketch):
    """(h, id): the distinct hashes of a document's windows that may stand in another one."""
    def run(batches):
        bits = sketch.value
        for batch in batches:
            for at, texts in pieces(batch, 1):
                h, low, owner, _ = windows(texts, size)
                may = np.ones(len(h), bool)
                for r in range(DEPTH):
                    cell = _cell(low, r, log_cells)
                    may &= (bits[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) == 1
                h, owner = h[may], owner[may]
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), batch.column(0).take(pa.array(owner[new] + at.start))], names=["h", "id"])
    return run


def _later(batches):
    """Rows sorted by (h, id). Kinds that come out: 0 repeats an earlier id, 1 open (may repeat one of an earlier partition),
    2 the first id of the last h of the partition."""
    last = first_id = None
    opening = True                     # still in the first h of the partition
    kind = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        kind = batch.schema.field(1).type
        h, ids = batch.column(0).to_numpy(), batch.column(1)
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[0] = h[0] != last
        start = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        firsts = ids.take(pa.array(np.maximum(start, 0)))
        if (carried := int((start < 0).sum())):
            firsts = pa.concat_arrays([pa.array([first_id] * carried, kind), firsts.slice(carried)])
        later = pa.compute.not_equal(ids, firsts).to_numpy(zero_copy_only=False)       # sorted: another id is a larger one
        open_ = np.zeros(len(h), bool)
        if opening:
            changes = np.flatnonzero(new)
            changes = changes[(changes > 0) | (last is not None)]
            end = changes[0] if len(changes) else len(h)
            open_[:end] = ~later[:end]
            opening = len(changes) == 0
        pick = np.flatnonzero(later | open_)
        yield pa.RecordBatch.from_arrays([pa.array(open_[pick].astype(np.int8)), pa.array(h[pick]), ids.take(pa.array(pick))], names=["kind", "h", "id"])
        last, first_id = h[-1], firsts[len(h) - 1].as_py()
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int8()), pa.array([last]), pa.array([first_id], kind)], names=["kind", "h", "id"])


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, most_log_cells: int = 27) -> DataFrame:
    """(id, h): the hashes of those windows of ``size`` words of a document that also start in one with a smaller id.

    The sketch has about four cells per key and row, at most 2^``most_log_cells`` (2 bits each reach the tasks, 32 MB at the
    bound); a fuller sketch lets more windows through to the exact pass and loses none. Rows with a null id take
    no part. Windows are told apart by 64-bit hashes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    source = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chars = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    keys = max(chars // 6 // max(1, (size - SHORT + 2) // 2), 1)
    log_cells = int(np.clip((4 * keys).bit_length(), 12, most_log_cells))
    cells = source.mapInArrow(_counted(size, log_cells), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).filter("n >= 2")
    log_all = log_cells + (DEPTH - 1).bit_length()
    sketch = docs.sparkSession.sparkContext.broadcast(bits_of(docs.sparkSession, cells, log_all))
    rows = stored(source.mapInArrow(_repeated(size, log_cells, sketch), f"h bigint, id {kind}"), "windows")
    flags = stored(rows.repartitionByRange("h", "id").sortWithinPartitions("h", "id").mapInArrow(_later, f"kind tinyint, h bigint, id {kind}"), "window-flags")
    firsts = flags.filter("kind = 2").groupBy("h").agg(F.min("id").alias("first"))       # one row per partition at most
    opened = flags.filter("kind = 1").join(firsts, "h").filter("id > first").select("id", "h")
    return flags.filter("kind = 0").select("id", "h").union(opened)


def kept_words(text: bytes | None, flagged: np.ndarray | None, size: int) -> tuple[int, list[bytes]]:
    """(words before, remaining words): words covered by a flagged window go."""
    words = text.split() if text else []
    if flagged is None or len(words) < size:
        return len(words), words
    h, _, _, at = windows([text], size)
    gone = np.zeros(len(words) + 1, np.int64)
    start = at[np.isin(h, flagged)]
    gone[start] += 1
    np.subtract.at(gone, start + size, 1)
    return len(words), list(compress(words, np.cumsum(gone)[:-1] == 0))


def _left(size: int, flagged: bool, digest: bool):
    def run(batches):
        for batch in batches:
            for rows, texts in pieces(batch, 1):
                n, gone, out = [], [], []
                for row, text in zip(rows, texts):
                    h = batch.column(2)[row] if flagged else None
                    h = None if h is None or not h.is_valid else h.values.to_numpy().view(np.uint64)
                    before, words = kept_words(text, h, size)
                    n.append(before)
                    gone.append(before - len(words))
                    left = b" ".join(words)
                    out.append(hashlib.sha256(left).hexdigest() if digest else text if before == len(words) else left)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, len(rows)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                                  pa.array(out, pa.string()) if digest else pa.array(out, pa.binary()).cast(pa.string())],
                                                 names=["id", "n_words", "n_removed", "kept"])
    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, digest: bool = False, **options) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row, other columns are not looked at.

    Words are runs of other characters than 0x20 and 0x09-0x0D. A word is removed if a window of ``size`` words that covers it
    also starts in a document with a smaller id; windows are those of the input. kept is the text, if words were removed the remaining ones joined by
    one space; with ``digest`` the SHA-256 of the remaining words joined by one space. Null and empty texts have no words and stay as they are. Rows
    with a null id stay whole and remove nothing; rows with equal ids do not remove each other's words. An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    flags = repeated_windows(docs, id_col, text_col, size, **options)
    sets = stored(flags.groupBy("id").agg(F.collect_list("h").alias("h")), "window-sets")       # a document's own windows
    near = bit_filter(sets.select(F.xxhash64("id").alias("k")), "k")
    schema = f"id {kind}, n_words bigint, n_removed bigint, kept string"

    def side(flagged: bool):
        """The rows that the filter lets through or those that it does not: only the former have to be joined."""
        def run(batches):
            for batch in batches:
                pick = near.mask(batch.column(2).to_numpy().view(np.uint64)) == flagged
                yield batch.select([0, 1]).filter(pa.array(pick))
        return source.withColumn("k", F.xxhash64("id")).mapInArrow(run, f"id {kind}, text string")

    clean = side(False).mapInArrow(_left(size, False, digest), schema)
    hit = side(True).join(sets, "id", "left").select("id", "text", "h").mapInArrow(_left(size, True, digest), schema)
    return clean.union(hit).withColumnRenamed("id", id_col)
