"""Near-duplicate documents: SuperMinHash signatures, banding, verification on whole shingle sets, components.

Documents with equal shingle sets form a class at once, so copies cost one row each and are never paired. Bands of the
class signatures give buckets, which are worked off in two rounds:

1. Every class of a bucket is verified against two pivots, the class with the most rows and the one with the smallest id: a
   number of pairs that grows with the bucket, not with its square. The links give components.
2. Buckets that still hold several components are searched for further pairs. Only classes outside of the bucket's largest
   component are compared, only with classes of other components, and by whole signatures and hashes inside a task; only
   pairs that reach the threshold there come out, and are then verified on their sets.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import apart, bit_filter, mix, pieces, shingle_sets, stored, without
from dialoom.llm.components import connected_components

BANDS, ROWS, WORDS = 45, 5, 5
BLOCK = 2048        # classes of a bucket that one task compares


def super_minhash(elements: np.ndarray, starts: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """The SuperMinHash signatures of sets of distinct 64-bit hashes: set i is ``elements[starts[i]:starts[i + 1]]``.

    Every element draws one random permutation of the positions, step by step: at step j it puts j plus a uniform draw at
    the j-th position of its permutation, and a position keeps the smallest value. All elements take a step
    together; since step j only offers values of at least j, a set is done after the first step by which all its
    positions are below j + 1. Large sets stop after one step, a set of one element takes ``size`` steps. The positions
    of an empty set stay infinite.
    """
    sets = len(starts) - 1
    sig = np.full((sets, size), np.inf)
    flat = sig.reshape(-1)
    owner = np.repeat(np.arange(sets), np.diff(starts))
    state, order, first = mix(elements ^ np.uint64(seed)), None, None
    for j in range(size):
        pick = mix(state ^ np.uint64(0x5851F42D4C957F2D))
        k = j + ((pick >> np.uint64(32)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            at, first = k, k
        else:
            rows = np.arange(len(owner))
            if order is None:
                order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.int32), (len(owner), 1))
                order[rows, first] = 0
            at = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
        np.minimum.at(flat, owner * size + at, j + (state >> np.uint64(11)) * 2.0 ** -53)
        left = (sig.max(axis=1) >= j + 1)[owner]
        if not left.any():
            break
        if not left.all():
            state, owner, first = state[left], owner[left], first[left]
            order = None if order is None else order[left]
        state = mix(state)
    return sig


def band_keys(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each signature one 64-bit key for each band of ``rows`` positions; the number of the band is part of it."""
    parts = sigs.view(np.uint64).reshape(len(sigs), bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), (len(sigs), bands))
    for i in range(rows):
        key = mix(key ^ parts[:, :, i])
    return key


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signed(bands: int, rows: int, words: int):
    def run(batches):
        for batch in batches:
            for at, texts in pieces(batch, 1):
                flat, starts = shingle_sets(texts, words)
                keys = band_keys(super_minhash(flat, starts, bands * rows), bands, rows).view(np.int64)
                sizes = np.diff(starts)
                marks = [digest(flat[a:b]) if a < b else None for a, b in zip(starts[:-1], starts[1:])]
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                ids = [batch.column(i).slice(at.start, len(at)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(sizes), pa.array(marks, pa.binary()), keys], names=["id", "th", "n", "digest", "bands"])
    return run


def _sets(wanted, words: int):
    """(digest, shingles) of the rows whose id may be wanted."""
    def run(batches):
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(wanted.mask(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))))
            for _, texts in pieces(batch, 1):
                flat, starts = shingle_sets(texts, words)
                sets = [flat[a:b] for a, b in zip(starts[:-1], starts[1:]) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()),
                                                  pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "shingles"])
    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left, right = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").withColumn("both", both).filter(
        F.expr(f"100L * both >= {percent}L * (size(sa) + size(sb) - both)")).select("a", "b")


def _short_signatures(bands: int, rows: int):
    """(cid, sig, low, keys): two bytes of each signature position, the lower four of each shingle hash, and the whole band keys."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = part.column(1)
                starts = sets.offsets.to_numpy() - sets.offsets[0].as_py()
                whole = super_minhash(sets.flatten().to_numpy().view(np.uint64), starts, bands * rows)
                sig, keys = mix(whole.view(np.uint64)).astype(np.uint16), band_keys(whole, bands, rows)
                low = [s.values.to_numpy().astype(np.uint32).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array(low, pa.binary()),
                                                  pa.array([r.tobytes() for r in keys], pa.binary())], names=["cid", "sig", "low", "keys"])
    return run


def _cross(percent: int, bands: int, rows_: int):
    """Rows (band, ms, vs, role, cid, n, part, main, sig, number, low, keys) sorted by the first four: one pass, a block of a bucket at a time.

    Role 0 are all classes of a cut, role 1 those outside of the bucket's main component. Gives the pairs (a, b) of
    different components that may reach the threshold, each in the first band that both share only, by the
    whole keys that make the buckets: that bucket holds both components as well, so the pair does come out there. Signatures leave out what is five standard deviations below the threshold;
    what is left is counted on halves of the shingle hashes, which never find too few in common.
    """
    p, size = percent / 100, bands * rows_
    least = int(size * p - 5 * (size * p * (1 - p)) ** 0.5)

    def pairs(rows):
        kind, cid, n, part = (np.array([r[i] for r in rows]) for i in (3, 4, 5, 6))
        sig = np.frombuffer(b"".join(r[8] for r in rows), np.uint16).reshape(len(rows), -1)
        low = [np.frombuffer(r[10], np.uint32) for r in rows]
        keys = np.frombuffer(b"".join(r[11] for r in rows), np.uint64).reshape(len(rows), bands)
        every, rest = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        outside = part[every] != rows[0][7]
        for x in rest:
            fit = (part[every] != part[x]) & (100 * np.minimum(n[every], n[x]) >= percent * np.maximum(n[every], n[x]))
            fit &= ~outside | (cid[every] < cid[x])          # both outside: once
            at = every[fit]
            at = at[(sig[at] == sig[x]).sum(1) >= least]
            at = at[(keys[at] == keys[x]).argmax(1) == rows[0][9]]
            if len(at):
                sets = [low[y] for y in at]
                both = np.add.reduceat(np.isin(np.concatenate(sets), low[x]), np.cumsum([0, *map(len, sets[:-1])]), dtype=np.int64)
                at = at[100 * both >= percent * (n[at] + n[x] - both)]
                yield np.minimum(cid[at], cid[x]), np.maximum(cid[at], cid[x])

    def run(batches):
        flat = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for _, rows in groupby(flat, key=lambda r: r[:3]):
            found = list(pairs(list(rows)))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, words: int = WORDS,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``, other columns are not looked at.

    Sets are distinct ``words``-word shingles of texts with A-Z lower-cased, held as 64-bit hashes; a shorter text is one
    shingle. Null, empty and white-space texts have an empty set and are linked with nothing. Rows of one component
    get its smallest id. Null ids count as larger than all others: a component of such rows only has a null id, which is
    kept. Repeated rows are each returned; of rows with one id all that belong to the component's smallest id are kept.
    With the defaults a pair at 75 percent shares a band with probability 1 - (1 - 0.75^5)^45 > 0.99999.
    An empty table gives an empty table.
    """
    signed, known = _components(docs, id_col, text_col, percent, words, bands, rows)
    tops = known.groupBy("top").agg(F.min("first").alias("component_id"))
    known = known.join(tops, "top").select("digest", "component_id")
    out = signed.select("id", "n", "digest").join(known, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, words: int = WORDS,
                            bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of every component of ``docs``, unchanged, and all rows of texts without words, which belong to none.

    The row with the smallest id stays (null ids last), of several texts with that id the one with the smallest xxhash64, and of
    rows with equal id and text one, the smallest as JSON. So ids may be null or repeated: rows are told apart by (id, xxhash64 of the text).
    """
    signed, known = _components(docs, id_col, text_col, percent, words, bands, rows)
    signed = signed.filter("n > 0")
    head = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("head")
    heads = signed.groupBy("digest").agg(head).join(known.select("digest", "top"), "digest").groupBy("top").agg(F.min("head").alias("head"))
    heads = heads.select(F.col("head.id").alias("hid"), F.col("head.th").alias("hth"), F.lit(True).alias("stays"))
    keys = signed.groupBy("id", "th").agg(F.count("*").alias("c")).join(heads, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")), "left")
    gone = stored(keys.filter("stays IS NULL OR c > 1").select("id", "th", F.coalesce("stays", F.lit(False)).alias("once")), "minhash-gone")
    left = without(docs, gone, id_col, text_col)
    # of repeated rows that stay none is left so far: one of each comes back, picked before it moves as far as its copies are together
    once = gone.filter("once")
    if once.isEmpty():
        return left
    _, others = apart(docs, once, id_col, text_col)
    rows = others.select(F.struct(*[others[c] for c in docs.columns]).alias("row")).select("row", F.col("row")[id_col].alias("id"), F.xxhash64(F.col("row")[text_col]).alias("th"))
    found = rows.groupBy("id", "th").agg(F.min_by("row", F.to_json("row")).alias("row"))
    names = once.select(F.col("id").alias("hid"), F.col("th").alias("hth"))
    found = found.join(names, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")), "left_semi")
    return left.union(found.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def _components(docs: DataFrame, id_col: str, text_col: str, percent: int, words: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, th, n, digest, bands) of every row, th the xxhash64 of its text, and (digest, first, top) of every class: top is its component."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    signed = stored(source.mapInArrow(_signed(bands, rows, words), f"id {kind}, th bigint, n bigint, digest binary, bands array<bigint>"), "minhash-signed")
    classes = signed.filter("n > 0").groupBy("digest", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    # the numbers are written with the rows, so a repeated task cannot change them later
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "minhash-classes")
    members = classes.select(F.posexplode("bands").alias("number", "band"), "cid")
    shared = members.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1")
    facts = classes.select("cid", "n", "first", "copies")
    members = stored(members.join(shared, "band").join(facts, "cid").select("band", "number", "cid", "c", "n", "first", "copies"), "minhash-members")

    wanted = members.select("cid").distinct().join(classes.select("cid", "digest", "first"), "cid")
    close = bit_filter(wanted.select(F.xxhash64(F.col("first").alias("id")).alias("k")).distinct(), "k")
    sets = source.select(F.xxhash64("id").alias("k"), "text").mapInArrow(_sets(close, words), "digest binary, shingles array<bigint>")
    sets = stored(sets.join(wanted.select("digest", "cid"), "digest").dropDuplicates(["cid"]).select("cid", "shingles"), "minhash-sets")

    pivots = members.groupBy("band").agg(F.min_by("cid", F.struct("first", "cid")).alias("low"), F.max_by("cid", F.struct("copies", "cid")).alias("high"))
    sizes = facts.select(F.col("cid").alias("other"), F.col("n").alias("m"))
    ends = members.join(pivots, "band").select("cid", "n", F.explode(F.array("low", "high")).alias("other")).filter("cid <> other").distinct()
    ends = ends.join(sizes, "other").filter(F.expr(f"100L * least(n, m) >= {percent}L * greatest(n, m)"))
    star = ends.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()
    first = stored(_links(star, sets, percent), "minhash-links")
    parts = stored(connected_components(first), "minhash-parts")

    # a bucket of two classes is done: both are its pivots, or one pivot and the other class
    held = members.filter("c > 2").select("band", "number", "cid", "c", "n").join(parts.withColumnRenamed("node", "cid"), "cid", "left").select(
        "band", "number", "cid", "c", "n", F.coalesce("component", "cid").alias("part"))
    counts = held.groupBy("band", "part").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("band").agg(F.max(F.struct("k", "part")).alias("main"), F.count("*").alias("k")).filter("k > 1")
    held = held.join(mixed.select("band", F.col("main.part").alias("main")), "band")
    short = sets.mapInArrow(_short_signatures(bands, rows), "cid bigint, sig binary, low binary, keys binary")
    held = held.join(short, "cid").withColumn("cuts", F.ceil(F.col("c") / BLOCK).cast("int"))
    own, all_ = F.pmod(F.xxhash64("cid"), F.col("cuts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    columns = ["cid", "n", "part", "main", "sig", "number", "low", "keys"]
    blocks = held.select("band", own.alias("ms"), all_.alias("vs"), F.lit(0).alias("role"), *columns).union(
        held.filter("part <> main").select("band", all_.alias("ms"), own.alias("vs"), F.lit(1).alias("role"), *columns))
    blocks = blocks.repartition("band", "ms", "vs").sortWithinPartitions("band", "ms", "vs", "role", "cid")
    cross = blocks.mapInArrow(_cross(percent, bands, rows), "a bigint, b bigint").distinct().join(star, ["a", "b"], "left_anti")
    second = _links(cross, sets, percent)
    # a component of the first round is one node of the second
    lifted = second.join(parts.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(
        parts.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = connected_components(lifted).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    known = classes.select("digest", "cid", "first").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid")).join(joined, "component", "left").select("digest", "first", F.coalesce("joined", "component").alias("top"))
    return signed, known
