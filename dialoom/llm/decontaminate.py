"""Benchmark decontamination by greedy string tiling: finds test items in documents, also with their parts reordered.

Karp-Rabin hashes of all runs of ``min_match`` tokens of a document are looked up among those of the items, first in a bit filter
of fixed size, then by a join. A (document, item) pair with common runs is tiled: the longest common run whose tokens are all
unmarked on both sides is marked, again and again, until none of ``min_match`` tokens is left. An item's coverage is its
share of marked tokens. Texts do not move; only hits do.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import bit_filter, pieces, stored, window_hashes, without

TOKENS = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall


def token_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the tokens: lower-cased runs of letters, marks and digits, so case and punctuation do not matter."""
    tokens = TOKENS(text.decode("utf-8", "replace").lower()) if text else []
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def _item_runs(min_match: int):
    def run(batches):
        for batch in batches:
            for at, texts in pieces(batch, 1):
                for item, text in zip(batch.column(0).slice(at.start, len(at)).to_pylist(), texts):
                    tokens = token_hashes(text)
                    n = len(tokens)
                    if n == 0:
                        continue
                    runs = window_hashes(tokens, min(min_match, n)).view(np.int64)
                    m = len(runs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(runs), pa.array([item] * m, batch.schema.field(0).type), pa.array(np.arange(m, dtype=np.int32)), pa.array(np.full(m, n, np.int32))],
                        names=["h", "item", "ipos", "n_item"])
    return run


def _document_runs(seen, sizes):
    def run(batches):
        for batch in batches:
            found = []
            for at, texts in pieces(batch, 2):
                for row, text in zip(at, texts):
                    tokens = token_hashes(text)
                    for size in sizes:
                        runs = window_hashes(tokens, size)
                        hit = np.flatnonzero(seen.mask(runs))
                        if len(hit):
                            found.append((np.full(len(hit), row), hit, runs[hit]))
            rows, at, h = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                                              pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], names=["id", "th", "pos", "h"])
    return run


def common_runs(hits, size: int, n_item: int):
    """Maximal common runs (length, item place, document place) from the hits (document place, item place) in order.

    A run is a row of hits on one diagonal. Of the copies of one run of the item, overlapping ones included, the first
    ``n_item + n_item // size * length + 1`` are given out, which changes no tiling: the tiles have n_item tokens together and are n_item / size at most,
    and a tile of t tokens touches less than t + length copies. So one copy that no tile touches is always among those given
    out; it can stand for any later one, and comes before it in the order of tiling.
    """
    open_: dict[int, list[int]] = {}
    copies: dict[tuple[int, int], int] = {}

    def closed(diagonal, first, last):
        length = last - first + size
        run = (first - diagonal, length)
        if (had := copies.get(run, 0)) <= n_item + n_item // size * length:
            copies[run] = had + 1
            yield length, first - diagonal, first

    for pos, same in groupby(hits, key=lambda x: x[0]):
        for diagonal in [d for d, (_, last) in open_.items() if last < pos - 1]:
            yield from closed(diagonal, *open_.pop(diagonal))
        for _, ipos in same:
            run = open_.setdefault(pos - ipos, [pos, pos])
            run[1] = pos
    for diagonal, run in sorted(open_.items(), key=lambda x: x[1]):
        yield from closed(diagonal, *run)


def tiled(runs, size: int) -> int:
    """The number of item tokens that greedy tiling marks; of equally long runs the first in the item, then in the document."""
    queue = [(-length, i, d) for length, i, d in runs]
    heapq.heapify(queue)
    item: set[int] = set()
    document: set[int] = set()
    while queue:
        length, i, d = heapq.heappop(queue)
        free = [x for x in range(-length) if i + x not in item and d + x not in document]
        if len(free) == -length:
            item.update(range(i, i - length))
            document.update(range(d, d - length))
            continue
        for _, part in groupby(enumerate(free), key=lambda x: x[1] - x[0]):       # the free stretches go back
            part = [x for _, x in part]
            if len(part) >= size:
                heapq.heappush(queue, (-len(part), i + part[0], d + part[0]))
    return len(item)


def _tiles(min_match: int):
    """Rows sorted by document, item and place: one pass, a pair at a time."""
    def run(batches):
        kinds = None

        def rows():
            nonlocal kinds
            for batch in batches:
                kinds = [batch.schema.field(i).type for i in range(3)]
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out = []
        for (id_, th, item, n), hits in groupby(rows(), key=lambda r: (r[0], r[1], r[2], r[5])):
            size = min(min_match, n)
            out.append((id_, th, item, n, tiled(common_runs(((r[3], r[4]) for r in hits), size, n), size)))
            if len(out) == 5_000:
                yield _pairs(out, kinds)
                out = []
        if out:
            yield _pairs(out, kinds)
    return run


def _pairs(out, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*kinds, pa.int32(), pa.int32()])],
                                      names=["id", "th", "item", "n_item", "n_matched"])


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
            min_match: int = 5, min_coverage: float = 0.5) -> DataFrame:
    """(id, th, item, n_item, n_matched, coverage) of every document and item with coverage >= ``min_coverage``.

    th is the xxhash64 of the document's text: rows with equal id and text are judged once. Tokens are lower-cased runs of letters and
    digits. An item with fewer than ``min_match`` tokens is one run; items and documents that are null or without tokens match nothing.
    Items with equal ids must be equal; null ids are ids like others. Other columns are not looked at. No items or no documents
    give an empty table.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    seeds = stored(items.select(item_col, item_text_col).mapInArrow(
        _item_runs(min_match), f"h bigint, item {item_kind}, ipos int, n_item int").distinct(), "item-runs")
    sizes = sorted(r[0] for r in seeds.select(F.least("n_item", F.lit(min_match))).distinct().collect())       # 1 to min_match
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    hits = source.mapInArrow(_document_runs(bit_filter(seeds, "h"), sizes), f"id {kind}, th bigint, pos int, h bigint")
    pairs = hits.join(seeds, "h").select("id", "th", "item", "pos", "ipos", "n_item").repartition("id", "th", "item").sortWithinPartitions(
        "id", "th", "item", "n_item", "pos", "ipos")
    found = pairs.mapInArrow(_tiles(min_match), f"id {kind}, th bigint, item {item_kind}, n_item int, n_matched int")
    return found.withColumn("coverage", F.col("n_matched") / F.col("n_item")).filter(F.col("coverage") >= min_coverage)


def without_matches(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that match no item, unchanged. Only rows that may match are joined, the others stay where they are."""
    return without(docs, stored(found.select("id", "th").distinct(), "matches"), id_col, text_col)
