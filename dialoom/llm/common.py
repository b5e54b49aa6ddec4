"""Words, hashes and work tables that the operators share.

A word is a run of bytes other than space and 0x09-0x0D; ``bytes.split()`` cuts at exactly these, and
``bytes.lower()`` changes A-Z only.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from dialoom.session import shared_path, small_batches

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None        # glibc has it
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the result."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` hashes, as a polynomial modulo 2^64 of hashed words, mixed at the end.

    The windows are built by doubling, so the cost is log(size) passes. Empty if there are fewer words.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, have = None, 0
    block, width, power = hashes, 1, np.uint64(0x100000001B3)      # block[i]: hash of hashes[i:i + width]; power: base ** width
    with np.errstate(over="ignore"):
        left = size
        while left:
            if left & 1:
                if done is None:
                    done, have = block, width
                else:
                    k = min(len(done), len(block) - have)
                    done, have = done[:k] * power + block[have:have + k], have + width
            left >>= 1
            if left:
                block = block[:-width] * power + block[width:]
                power, width = power * power, width * 2
        return mix(done[:n] ^ np.uint64(size * 0x1000193))


def flat_words(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in one array, and where each text starts in it (with the end)."""
    words: list[bytes] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        if text:
            words += (text.lower() if lower else text).split()
        starts[i + 1] = len(words)
    return word_hashes(words), starts


def shingle_sets(texts: list[bytes | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of all ``size``-word shingles of lower-cased words, text after text, and the starts.

    Fewer words make one shingle of all of them; no words make an empty set.
    """
    hashes, at = flat_words(texts)
    counts = np.diff(at)
    long = counts >= size
    all_windows = window_hashes(hashes, size)
    n = np.where(long, counts - size + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(n)])
    flat = np.empty(starts[-1], np.uint64)
    for i in np.flatnonzero(counts):
        part = flat[starts[i]:starts[i + 1]]
        if long[i]:
            part[:] = all_windows[at[i]:at[i] + n[i]]
            part.sort()
        else:
            part[:] = window_hashes(hashes[at[i]:at[i + 1]], counts[i])
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[starts[:-1][n > 0]] = True
    return flat[new], np.concatenate([[0], np.cumsum(new)])[starts]


def pieces(batch, column: int, most: int = 1 << 19):
    """(row numbers, texts) of a batch in runs of about ``most`` bytes: bounds what the work arrays take.

    Only the texts of one run are Python objects at a time. A text that is longer makes a run of its own.
    """
    texts = batch.column(column)
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield range(first, last), as_bytes(texts.slice(first, last - first))
        first = last
    release()


def release() -> None:
    """Gives freed memory of this worker back to the system: a worker lives on through the stages of other operators."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def as_bytes(column) -> list[bytes | None]:
    """The values of an Arrow string column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a new table in the shared folder and reads it back: the lineage ends here."""
    path = shared_path(df.sparkSession, name)
    small_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many leading underscores as it takes to be no column of ``df`` (case does not matter)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


class BitFilter:
    """A Bloom filter of a fixed number of bits, sent to the tasks: at most ``2 ** log_bits / 8`` bytes whatever its input.

    More keys than it is made for only let more rows pass; an exact join follows every use.
    """

    def __init__(self, words: np.ndarray, log_bits: int, probes: int):
        self.words, self.log_bits, self.probes = words, log_bits, probes

    def mask(self, keys: np.ndarray) -> np.ndarray:
        """True where a key (uint64) may be in the set."""
        found = np.ones(len(keys), bool)
        for i in range(self.probes):
            at = _cells(keys, self.log_bits, i)
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _cells(keys: np.ndarray, log_bits: int, probe: int) -> np.ndarray:
    return mix(keys + np.uint64(probe)) >> np.uint64(64 - log_bits)


def bits_of(spark: SparkSession, cells: DataFrame, log_bits: int) -> np.ndarray:
    """A bitmap of the cell numbers in column ``cell``, merged by Spark; the result has ``2 ** log_bits`` bits at most."""
    words = cells.groupBy(F.shiftright("cell", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")).alias("b"))
    out = np.zeros(max(1, 1 << (log_bits - 6)), np.uint64)
    got = words.toArrow()        # bounded by the size of the bitmap, not by the input
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def bit_filter(keys: DataFrame, column: str, log_bits: int = 24, probes: int = 2) -> BitFilter:
    """The filter of the 64-bit keys in ``column``."""
    def cells(batches):
        for batch in batches:
            k = batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate([_cells(k, log_bits, i) for i in range(probes)]))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], names=["cell"])

    df = keys.select(F.col(column).cast("long"))
    return BitFilter(bits_of(df.sparkSession, df.mapInArrow(cells, "cell long"), log_bits), log_bits, probes)


def apart(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(the rows of ``docs`` that are certainly not among ``keys``, all others), by a bit filter of the keys.

    ``keys`` has the columns id and th, the xxhash64 of the text. Only the other rows need a join; the first ones stay where they
    are. Just the hash of a row goes through Python. ``keys`` is read twice, so it should be a written table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(keys.select(F.xxhash64("id", "th").alias("k")), "k"))
    may = F.pandas_udf(lambda k: pd.Series(sent.value.mask(k.to_numpy().view(np.uint64))), "boolean")
    found = may(F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col))))
    return docs.filter(~found), docs.filter(found)


def same_row(docs: DataFrame, id_col: str, text_col: str, other_id: str, other_th: str):
    """The condition that a row of ``docs`` has the id and the text's hash in the columns ``other_id`` and ``other_th``."""
    return docs[id_col].eqNullSafe(F.col(other_id)) & (F.xxhash64(docs[text_col]) == F.col(other_th))


def without(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose (id, xxhash64 of the text) is not among ``keys`` (id, th), unchanged; only rows that may be are joined."""
    id_, th = free_names(docs, "id", "th")
    stay, others = apart(docs, keys, id_col, text_col)
    gone = keys.select(F.col("id").alias(id_), F.col("th").alias(th)).distinct()
    return stay.unionByName(others.join(gone, same_row(others, id_col, text_col, id_, th), "left_anti"))
