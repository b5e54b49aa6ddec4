"""Spelling variants: words one edit apart, found by scanning sorted lists with banded edit rows that adjacent words share.

Two near words have at least half of the shorter one in common at the front or at the back. So each word is compared in two sorted
lists, that of the words and that of the reversed words, with the range of words that begin with its own first half. A list
is range-partitioned into blocks. A word visits the blocks that its range touches, but for those whose shared prefix
is already more than one edit away; within a block it scans its range with the three cells around the diagonal of
the edit matrix, one length after the other. The rows for the prefix that a word shares with the one before it (their LCP) are kept, and where a row holds no cell below two,
all words that share the prefix up to there are skipped. Each visit returns a count and the best near word, never pairs.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from itertools import groupby
from math import ceil, log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import pieces, stored

RUNS = regex.compile(r"[A-Za-z\u00C0-\u00FF]+").findall
BLOCK, MOST_BLOCKS = 4096, 4096         # words of a block; the borders of all blocks are sent to the tasks
BORDER = 64         # code points of a border that are looked at
_LAST = chr(0x10FFFF)


def _counted(drop_one_in: int, min_length: int):
    """(word, n) of the words of a partition, counted in pieces; n is summed by Spark."""
    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for at, texts in pieces(batch, 1):
                for id_, text in zip(batch.column(0).slice(at.start, len(at)).to_pylist(), texts):
                    if not text:
                        continue
                    start = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
                    for word, n in Counter(RUNS(text.lower().decode("utf-8", "replace"))).items():
                        if drop_one_in:
                            h = zlib.crc32(word.encode(), start)
                            if h % drop_one_in == 0:
                                k = h % len(word)
                                word = word[:k] + word[k + 1:]
                        if len(word) >= min_length:
                            total[word] += n
                if len(total) >= 100_000:
                    yield _counts(total)
                    total = Counter()
        yield _counts(total)
    return run


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, drop_one_in: int = 199) -> DataFrame:
    """(word, n): runs of ASCII and Latin-1 letters of all texts, A-Z lower-cased, that occur at least ``min_count`` times.

    Where the CRC-32 of ``<id>:<run>`` is divisible by ``drop_one_in`` (0: never), the run's code point number hash % length is taken out first.
    """
    counts = docs.select(id_col, text_col).mapInArrow(_counted(drop_one_in, min_length), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def shared(a: str, b: str, start: int = 0) -> int:
    """The length of the longest common prefix; the first ``start`` code points are known to be equal."""
    n = min(len(a), len(b))
    i = start
    while i < n and a[i] == b[i]:
        i += 1
    return i


def next_row(word: str, depth: int, row: tuple[int, int, int], letter: str) -> tuple[int, int, int]:
    """The edit row of a prefix of length ``depth`` and the last letter ``letter`` from that of one less.

    ``row[k]`` is the distance to the first depth - 1 + k letters of ``word``; beyond the word's ends it is 9.
    """
    n = len(word)
    a, b, c = row
    j = depth - 1
    x = min(a + (j == 0 or j > n or word[j - 1] != letter), b + 1) if 0 <= j <= n else 9
    y = min(b + (depth > n or word[depth - 1] != letter), c + 1, x + 1) if depth <= n else 9
    z = min(c + (depth + 1 > n or word[depth] != letter), y + 1) if depth + 1 <= n else 9
    return x, y, z


def near_in(word: str, words: list[str], lcp: list[int], first: int, last: int, known: int):
    """The places between ``first`` and ``last`` of sorted ``words`` that are exactly one edit from ``word``.

    All words there begin with the first ``known`` code points of ``word``. ``lcp[i]`` is the prefix that words i - 1 and i share.
    """
    rows = [(1, 0, 1)]      # rows[d - known]: the row of the prefix of length d
    size = len(word)
    letters = word + "\0\0"      # cells beyond the word's end are of no use, and do no harm
    i, same = first, known      # same: the prefix that word i shares with the last one whose rows were made
    while i < last:
        if i > first and lcp[i] < same:
            same = max(known, lcp[i])
        w = words[i]
        end = len(w)
        if end < size - 1 or end > size + 1:        # of another length: only the prefix it shares with the next one matters
            i += 1
            continue
        del rows[same - known + 1:]
        depth = known + len(rows) - 1
        a, b, c = rows[-1]
        while depth < end:
            letter = w[depth]
            x = a if letters[depth - 1] == letter else a + 1
            if x > b + 1:
                x = b + 1
            y = b if letters[depth] == letter else b + 1
            if y > c + 1:
                y = c + 1
            if y > x + 1:
                y = x + 1
            z = c if letters[depth + 1] == letter else c + 1
            if z > y + 1:
                z = y + 1
            a, b, c = x, y, z
            depth += 1
            rows.append((a, b, c))
            if a > 1 and b > 1 and c > 1:
                break
        else:
            if rows[end - known][size - end + 1] == 1:
                yield i
            same = end
            i += 1
            continue
        i += 1
        while i < last and lcp[i] >= depth:     # they share the prefix that is too far away
            i += 1
        same = depth


class Borders:
    """The first and the last word of every block, cut to BORDER code points: sorted, at most MOST_BLOCKS of them."""

    def __init__(self, rows: list[tuple[int, str, str]]):
        self.rows = sorted(rows, key=lambda r: r[1:])
        self.lows, self.highs = [r[1] for r in self.rows], [r[2] for r in self.rows]

    def visited(self, word: str, known: int) -> list[int]:
        """The blocks that may hold a word beginning with ``word[:known]`` and within one edit of ``word``."""
        prefix = word[:min(known, BORDER)]
        first = bisect_left(self.highs, prefix)
        out = []
        for k in range(first, len(self.rows)):
            if self.lows[k][:len(prefix)] > prefix:
                break
            low, high = self.lows[k], self.highs[k]
            same = shared(low, high)
            row, depth = (1, 0, 1), min(known, same)
            while depth < same and depth <= len(word):
                depth += 1
                row = next_row(word, depth, row, low[depth - 1])
                if min(row) > 1:
                    break
            if min(row) <= 1:
                out.append(self.rows[k][0])
        return out


def half(word: str, min_length: int) -> int:
    """The prefix that a near word shares at least, if it shares no such suffix: half of the shorter of both."""
    return max(len(word) - 1, min(min_length, len(word))) // 2


def _visits(sent, min_length: int):
    """(block, role, word, n) with role 1: every word in the blocks that it visits."""
    def run(batches):
        borders = sent.value
        for batch in batches:
            words, ns = (batch.column(i).to_pylist() for i in (0, 1))
            rows = [(b, w, n) for w, n in zip(words, ns) for b in borders.visited(w, half(w, min_length))]
            for at in range(0, len(rows), 20_000):
                b, w, n = zip(*rows[at:at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([1] * len(b), pa.int32()), pa.array(w, pa.string()), pa.array(n, pa.int64())],
                                                 names=["block", "role", "word", "n"])
    return run


def _scanned(min_length: int, backwards: bool):
    """Rows (block, role, word, n) sorted by all of them: one pass, a block at a time; gives (word, n_near, form, form_n) per visit."""
    def run(batches):
        flat = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        out = []
        for _, rows in groupby(flat, key=lambda r: r[0]):
            lists: dict[int, tuple[list[str], list[int], list[int]]] = {}       # by length: words, n, LCP with the word before
            for _, role, word, n in rows:
                if role == 0:
                    words, ns, lcp = lists.setdefault(len(word), ([], [], []))
                    lcp.append(shared(words[-1], word) if words else 0)
                    words.append(word)
                    ns.append(n)
                    continue
                count, best = 0, None
                for size in (len(word) - 1, len(word), len(word) + 1):
                    if size not in lists:
                        continue
                    words, ns, lcp = lists[size]
                    known = min(size, len(word)) // 2
                    first = bisect_left(words, word[:known])
                    last = bisect_left(words, word[:known] + _LAST, first) if known else len(words)
                    for i in near_in(word, words, lcp, first, last, known):
                        if backwards and shared(word[::-1], words[i][::-1]) >= known:
                            continue        # counted in the forward list
                        count += 1
                        other = words[i][::-1] if backwards else words[i]
                        if best is None or (-ns[i], other) < best:
                            best = (-ns[i], other)
                if count:
                    out.append((word[::-1] if backwards else word, count, best[1], -best[0]))
                    if len(out) >= 20_000:
                        yield _found(out)
                        out = []
        if out:
            yield _found(out)
    return run


def _found(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["word", "n_near", "form", "form_n"])


def _near(words: DataFrame, n_words: int, min_length: int, backwards: bool, block: int) -> DataFrame:
    """(word, n_near, form, form_n) of one sorted list, several rows per word."""
    spark = words.sparkSession
    if backwards:
        words = words.select(F.reverse("word").alias("word"), "n")
    blocks = int(min(MOST_BLOCKS, max(1, ceil(n_words / block))))
    listed = stored(words.repartitionByRange(blocks, "word").withColumn("block", F.spark_partition_id()), "spelling-list")
    ends = listed.groupBy("block").agg(F.substring(F.min("word"), 1, BORDER), F.substring(F.max("word"), 1, BORDER)).collect()     # MOST_BLOCKS rows at most
    sent = spark.sparkContext.broadcast(Borders([tuple(r) for r in ends]))
    visits = listed.select("word", "n").mapInArrow(_visits(sent, min_length), "block int, role int, word string, n bigint")
    rows = listed.select("block", F.lit(0).alias("role"), "word", "n").union(visits)
    rows = rows.repartition(blocks, "block").sortWithinPartitions("block", "role", "word")     # much work for few bytes: tasks are not to be joined
    return rows.mapInArrow(_scanned(min_length, backwards), "word string, n_near bigint, form string, form_n bigint")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, ratio: int = 5,
                      drop_one_in: int = 199, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocabulary``.

    n_near counts the words exactly one inserted, deleted or replaced code point away. form is the near word of largest n, the first by code points among
    equals, if that n >= ``ratio`` * the word's n, else null; form_n is its n. root follows forms to the last one, which is the word itself
    without a form. Null and empty texts have no words; rows with equal or null ids are documents like others (a null id is empty in the hash). Other columns are not looked at.
    An empty table gives an empty table.
    """
    words = stored(vocabulary(docs, id_col, text_col, min_length, min_count, drop_one_in), "spelling-words")
    n_words, most = words.agg(F.count("*"), F.max("n")).first()
    both = _near(words, n_words, min_length, False, block).union(_near(words, n_words, min_length, True, block))
    best = F.max_by(F.struct("form", "form_n"), "form_n")
    near = both.groupBy("word", "form_n").agg(F.sum("n_near").alias("n_near"), F.min("form").alias("form")).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), best.alias("best"))
    table = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(
        F.col("best.form_n") >= ratio * F.col("n"), F.col("best")).alias("best"))
    table = stored(table.select("word", "best.form", "n", "n_near", "best.form_n"), "spelling-forms")
    # counts grow by the ratio with every step, so a chain has few of them; each round doubles what a pointer skips
    links = table.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    hops = max(1, ceil(log(max(2, (most or 1) / max(1, min_count)), max(2, ratio)))) + 1
    for _ in range(ceil(log(hops, 2)) + 1):
        ahead = links.select(F.col("word").alias("at"), F.col("root").alias("ahead"))
        links = stored(links.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("ahead", "root").alias("root")), "spelling-roots")
    return table.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
