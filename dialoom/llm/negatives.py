"""Hard negatives by exact integer scores from a residue number system.

Component matrices are multiplied modulo several small primes in float32: with centred residues every partial sum stays below
2^24, so single precision is exact. The Chinese remainder theorem (mixed radix digits) gives back the signed score.

Anchors are a stated query set. They are worked off in blocks of a fixed number, each sent to the tasks, which scan the rows
where these lie: rows never move. A task keeps the best few rows of each anchor and slot; a window over these picks the best
of all tasks. One scan finds the positives, a second one the negatives of the score windows that the positives set.
"""

from __future__ import annotations

from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dialoom.llm.common import stored

LARGEST = (1 << 63) - 1
TILE = 1 << 20          # scores that a task holds at a time
_BEST = "anchor_id bigint, slot int, id bigint, score bigint"


def moduli(dimensions: int, bound: int) -> list[int]:
    """Primes whose product is over ``2 * bound``, the largest for which a float32 sum over ``dimensions`` is exact.

    With many dimensions the primes stay above 120 and the sum is cut (see ``Residues.chunk``).
    """
    half = min(510, max(63, isqrt(((1 << 24) - 1) // max(1, dimensions))))
    found: list[int] = []
    p = 2 * half + 1
    while not found or prod(found) <= 2 * bound:
        if p < 3:
            raise ValueError("the scores do not fit into a long")
        if all(p % d for d in range(2, isqrt(p) + 1)):
            found.append(p)
        p -= 1
    return found


class Residues:
    """Exact inner products of integer rows, for scores between ``-bound`` and ``bound``."""

    def __init__(self, dimensions: int, bound: int):
        self.bound, self.primes = bound, moduli(dimensions, bound)
        self.chunk = ((1 << 24) - 1) // max((p // 2) ** 2 for p in self.primes)

    def of(self, x: np.ndarray) -> list[np.ndarray]:
        """The centred residues of int64 rows, a float32 matrix for each prime."""
        return [((x + p // 2) % p - p // 2).astype(np.float32) for p in self.primes]

    def products(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """The int64 scores of all rows of ``left`` with all rows of ``right``."""
        total, weight = None, 1
        for p, a, b in zip(self.primes, left, right):
            rest = np.full((len(a), len(b)), self.bound % p, np.int64)
            for at in range(0, a.shape[1], self.chunk):
                rest += (a[:, at:at + self.chunk] @ b[:, at:at + self.chunk].T).astype(np.int64)
            rest %= p
            if total is None:
                total = rest.astype(np.uint64)
            else:           # the next mixed radix digit
                digit = (rest - (total % np.uint64(p)).astype(np.int64)) % p * pow(weight, -1, p) % p
                total += digit.astype(np.uint64) * np.uint64(weight % (1 << 64))
            weight *= p
        return (total - np.uint64(self.bound)).view(np.int64)


class Best:
    """The best ``most`` (score, id) of each anchor: higher scores first, smaller ids first among equal ones."""

    def __init__(self, anchors: int, most: int):
        self.most = most
        self.anchor, self.id, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(anchors, -LARGEST, np.int64)       # a lower score cannot get in any more

    def add(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        allowed = allowed & (scores >= self.floor[:, None])
        if allowed.sum() > 32 * len(scores) and scores.shape[1] > self.most:
            least = np.partition(np.where(allowed, scores, -LARGEST), -self.most, axis=1)[:, -self.most]
            allowed &= scores >= least[:, None]
        anchor, row = np.nonzero(allowed)
        if not len(anchor):
            return
        a, i, s = (np.concatenate(x) for x in ((self.anchor, anchor), (self.id, ids[row]), (self.score, scores[anchor, row])))
        order = np.lexsort((i, -s, a))
        a, i, s = a[order], i[order], s[order]
        first = np.searchsorted(a, a)           # the place of the anchor's best
        keep = np.arange(len(a)) - first < self.most
        self.anchor, self.id, self.score = a[keep], i[keep], s[keep]
        last = np.arange(len(a)) - first == self.most - 1
        self.floor[a[last]] = s[last]


def _prepared(batches):
    """(id, label, size, norm, vector): the rows that take part, components as floor(256 * x)."""
    for batch in batches:
        ids, labels = batch.column(0), batch.column(1)
        keep, sizes, norms, vectors = [], [], [], []
        for r, v in enumerate(batch.column(2)):
            raw = v.values
            if raw is None or raw.null_count or not ids[r].is_valid or not labels[r].is_valid:
                continue
            x = raw.to_numpy(zero_copy_only=False).astype(np.float64) * 256
            if not np.isfinite(x).all() or np.abs(x).max(initial=0) >= 2.0 ** 32:
                continue
            x = np.floor(x).astype(np.int64)
            norm = int(x @ x) if len(x) * int(np.abs(x).max(initial=0)) ** 2 <= LARGEST else sum(y * y for y in x.tolist())
            if norm > LARGEST:
                continue
            keep.append(r)
            sizes.append(len(x))
            norms.append(norm)
            vectors.append(x)
        flat = pa.array(np.concatenate([np.empty(0, np.int64), *vectors]))
        starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), labels.take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int32()),
                                          pa.array(norms, pa.int64()), pa.ListArray.from_arrays(starts, flat)],
                                         names=["id", "label", "size", "norm", "vector"])


def _matrix(column, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(flat), size)


class _Block:
    """A block of anchors: ids, labels, residues, and for each slot the scores that may enter (none: the positives are looked for)."""

    def __init__(self, rows: pa.Table, size: int, residues: Residues):
        self.ids, self.labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        self.size, self.residues, self.windows = size, residues, []
        self.parts = residues.of(_matrix(rows.column("vector"), size))

    def with_windows(self, positives: pa.Table, slots: int, low: int, high: int) -> "_Block":
        """Slot s takes the scores with low * positive <= 100 * score <= high * positive of the anchor's positive number s."""
        place = {x: i for i, x in enumerate(self.ids.tolist())}
        for _ in range(slots):
            self.windows.append((np.full(len(self.ids), 1, np.int64), np.zeros(len(self.ids), np.int64)))      # nothing fits
        for anchor, slot, score in zip(*(positives.column(c).to_pylist() for c in ("anchor_id", "slot", "score"))):
            least, most = self.windows[slot]
            least[place[anchor]], most[place[anchor]] = -(-low * score // 100), high * score // 100
        return self


def _scanned(sent, most: int):
    def run(batches):
        block = sent.value
        best = [Best(len(block.ids), most) for _ in block.windows or [None]]
        step = max(1, TILE // max(1, len(block.ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, labels = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                scores = block.residues.products(block.parts, block.residues.of(_matrix(part.column(2), block.size)))
                same = block.labels[:, None] == labels
                if not block.windows:
                    best[0].add(scores, same & (block.ids[:, None] != ids), ids)
                for (least, highest), b in zip(block.windows, best):
                    b.add(scores, ~same & (scores >= least[:, None]) & (scores <= highest[:, None]), ids)
        for slot, b in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[b.anchor]), pa.array(np.full(len(b.id), slot, np.int32)), pa.array(b.id), pa.array(b.score)],
                                             names=["anchor_id", "slot", "id", "score"])
    return run


def hard_negatives(vectors: DataFrame, anchor, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that fulfil the condition ``anchor`` on the column ``id``.

    Components become floor(256 * x) with x in double precision, a score is the integer inner product, exact. Higher
    scores come first, smaller ids among equal ones. Positives of an anchor are the first ``positives`` other rows of its label; for each one the first
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score are returned, rank 1 first.
    Ids and labels are integers. Rows with a null id, label or vector, or with a null or non-finite component, take no part; nor do vectors whose
    components reach 2^24 or whose squared integer length does not fit into a long. All other scores do (Cauchy-Schwarz). Of rows with
    one id that with the smallest (label, vector) counts. Vectors are only compared with vectors of the same length. Other columns
    are not looked at. Without anchors, positives or negatives in the window there are no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")).mapInArrow(
        _prepared, "id bigint, label bigint, size int, norm bigint, vector array<bigint>")
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vector", "size", "norm")).alias("r")).select("id", "r.*")
    rows = stored(rows.withColumn("anchor", F.coalesce(anchor, F.lit(False))), "negatives-rows")
    found = None
    facts = rows.groupBy("size").agg(F.max("norm").alias("norm"), F.sum(F.col("anchor").cast("int")).alias("anchors")).collect()       # one row per vector length
    for size, norm, anchors in facts:
        residues = Residues(size, norm)
        mine = rows.filter(F.col("size") == size)
        scan = mine.select("id", "label", "vector")
        blocks = -(-anchors // block)       # ids are distinct here, so the hash deals out blocks of about this size
        for b in range(blocks):
            part = _Block(mine.filter(F.col("anchor") & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).select("id", "label", "vector").toArrow(), size, residues)
            best = _ranked(scan.mapInArrow(_scanned(spark.sparkContext.broadcast(part), positives), _BEST), ["anchor_id"], positives)
            best = stored(best.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), "score"), "negatives-positives")
            part.with_windows(best.select("anchor_id", "slot", "score").toArrow(), positives, low, high)        # at most block * positives rows
            near = _ranked(scan.mapInArrow(_scanned(spark.sparkContext.broadcast(part), negatives), _BEST), ["anchor_id", "slot"], negatives)
            near = stored(near.join(best.withColumnRenamed("score", "positive_score"), ["anchor_id", "slot"]).select(
                "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives-found")
            found = near if found is None else found.union(near)
    if found is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return found


def _ranked(best: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first ``most`` of each key; a key has at most ``most`` rows from each task."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
