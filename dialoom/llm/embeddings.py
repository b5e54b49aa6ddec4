"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, cut the space into a grid of cells. A vector is a member of the cell
of its nearest centroids and visits further cells in order of growing cost (the multi-sequence order) up to the cost that
belongs to the target recall; there it is compared with all members, by cosine in double precision. Equal vectors are one
entry with a count. A comparison task is a block of members against a block of visitors: frequent cells are cut into
several blocks, and a task returns counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import stored
from dialoom.llm.components import connected_components


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column, all of one length, as double rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def _marked(batches):
    """(id, mark, size, vector): mark is a digest of the vector, null if it links with nothing."""
    for batch in batches:
        marks, sizes = [], []
        for id_, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = v.values
            x = raw.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if id_ is not None and raw is not None and raw.null_count == 0 else np.zeros(0)
            ok = len(x) > 0 and np.isfinite(x).all() and 0 < np.linalg.norm(x) < np.inf
            marks.append(xxhash.xxh3_128_digest(x.tobytes()) if ok else None)
            sizes.append(len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary()), pa.array(sizes, pa.int32()), batch.column(1)],
                                         names=["id", "mark", "size", "vector"])


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    centroids = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = ((centroids ** 2).sum(1) - 2 * x @ centroids.T).argmin(1)
        for i in range(len(centroids)):
            if (mine := nearest == i).any():
                centroids[i] = x[mine].mean(0)
    return centroids


class Grid:
    """Codebooks of both halves, and the cells that a vector visits.

    For a vector in the cell of centroid a, the border to the cell of centroid b is at distance t = (d_b^2 - d_a^2) / 2|c_a - c_b|. A vector at
    the least cosine is sqrt(2 - 2 * cosine) away; in a random direction that is a normal step of sigma = that distance / sqrt(dimensions)
    across a border, so the cost of a cell is the sum over the halves of (t / sigma)^2, and the chance to miss a partner behind
    the cost z^2 is about exp(-z^2 / 2). With cost >= dimensions no partner can be missed whatever its direction.
    """

    def __init__(self, halves: list[np.ndarray], dimensions: int, cosine: float, recall: float):
        self.halves, self.cut = halves, dimensions // 2
        self.gaps = [np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(-1), 1e-18)) for c in halves]
        sigma = np.sqrt(max(2 - 2 * cosine, 1e-12) / dimensions)
        self.sigma = sigma
        self.limit = dimensions if recall >= 1 else min(dimensions, -2 * np.log(1 - recall))

    def costs(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For both halves: the nearest centroid of each row, and the cost of every centroid."""
        home, cost = [], []
        for part, c, gap in zip((x[:, :self.cut], x[:, self.cut:]), self.halves, self.gaps):
            d = (part ** 2).sum(1)[:, None] + (c ** 2).sum(1) - 2 * part @ c.T
            a = d.argmin(1)
            t = np.maximum(d - d[np.arange(len(d)), a][:, None], 0) / (2 * gap[a])
            home.append(a)
            cost.append((t / self.sigma) ** 2)
        return home, cost

    def visits(self, cost: list[np.ndarray], row: int):
        """The cells of one vector in multi-sequence order: by growing cost, up to the limit."""
        import heapq

        one, two = (np.argsort(c[row], kind="stable") for c in cost)
        queue, seen = [(cost[0][row, one[0]] + cost[1][row, two[0]], 0, 0)], {(0, 0)}
        while queue:
            total, i, j = heapq.heappop(queue)
            if total > self.limit:
                return
            yield int(one[i]), int(two[j])
            for n in ((i + 1, j), (i, j + 1)):
                if n[0] < len(one) and n[1] < len(two) and n not in seen:
                    seen.add(n)
                    heapq.heappush(queue, (cost[0][row, one[n[0]]] + cost[1][row, two[n[1]]], *n))


def _assigned(grid):
    def run(batches):
        for batch in batches:
            home, _ = grid.value.costs(_unit(_matrix(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(home[0].astype(np.int32)), pa.array(home[1].astype(np.int32))],
                                             names=["id", "copies", "vector", "i", "j"])
    return run


def _dealt(grid, splits, width):
    """Sends each vector as a member to the blocks of its own part of the grid, and as a visitor to each part that it visits.

    A part is one centroid of the first half with ``width`` of the second. A part with S splits has S x S tasks: members are cut by S
    and go to all visitors' cuts, and the other way round.
    """
    def run(batches):
        for batch in batches:
            g, split = grid.value, splits.value
            home, cost = g.costs(_unit(_matrix(batch.column(2))))
            cuts = [xxhash.xxh32_intdigest(str(x)) for x in batch.column(0).to_pylist()]
            rows, keys = [], []
            for r in range(batch.num_rows):
                parts = {(i, j // width) for i, j in g.visits(cost, r)}
                own = (int(home[0][r]), int(home[1][r]) // width)
                s = split.get(own, 1)
                keys += [(*own, cuts[r] % s, v, 0) for v in range(s)]
                rows += [r] * s
                for part in sorted(parts):
                    if s := split.get(part, 0):        # parts without members need no visitors
                        keys += [(*part, m, cuts[r] % s, 1) for m in range(s)]
                        rows += [r] * s
                if len(rows) > 20_000:
                    yield _dealt_batch(batch, rows, keys)
                    rows, keys = [], []
            if rows:
                yield _dealt_batch(batch, rows, keys)
    return run


def _dealt_batch(batch, rows, keys):
    taken = batch.take(pa.array(rows))
    key = np.array(keys, np.int32).reshape(-1, 5)
    return pa.RecordBatch.from_arrays([*(pa.array(key[:, k]) for k in range(5)), taken.column(0), taken.column(1), taken.column(2)],
                                      names=["i", "part", "ms", "vs", "role", "id", "copies", "vector"])


def _compared(grid, width: int, cosine: float):
    def run(table: pa.Table) -> pa.Table:
        g = grid.value
        role = table.column("role").to_numpy()
        i, part = table.column("i")[0].as_py(), table.column("part")[0].as_py()
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        unit = _unit(_matrix(table.column("vector")))
        member, visitor = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        out_a, out_b, out_n = [], [], []
        if len(member) and len(visitor):
            cell = g.costs(unit[member])[0][1]
            cost = g.costs(unit[visitor])[1]
            total = np.zeros(len(visitor), np.int64)
            for j in range(part * width, min((part + 1) * width, len(g.halves[1]))):
                m = member[cell == j]
                near = np.flatnonzero(cost[0][:, i] + cost[1][:, j] <= g.limit) if len(m) else []
                for at in range(0, len(near), 4096):
                    n = near[at:at + 4096]
                    v = visitor[n]
                    links = unit[v] @ unit[m].T >= cosine
                    links &= ids[v][:, None] != ids[m][None]
                    total[n] += links @ copies[m]
                    a, b = _forest(links, ids[v], ids[m])
                    out_a.append(a)
                    out_b.append(b)
            found = np.flatnonzero(total)
            out_n = [np.zeros(sum(map(len, out_a)), np.int64), total[found]]
            out_a.append(ids[visitor[found]])
            out_b.append(ids[visitor[found]])
        empty = np.empty(0, np.int64)
        return pa.table({"a": np.concatenate([empty, *out_a]), "b": np.concatenate([empty, *out_b]), "n": np.concatenate([empty, *out_n]).astype(np.int64)})
    return run


def _forest(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector, smallest vector of its component) for the bipartite links of one block, by spreading the smallest id."""
    r, c = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    links, rows, columns = links[np.ix_(r, c)], rows[r], columns[c]
    if not len(r):
        return rows, rows
    far = max(rows.max(), columns.max())
    of_row, of_column = rows.copy(), columns.copy()
    while True:
        column = np.minimum(of_column, np.where(links, of_row[:, None], far).min(0))
        row = np.minimum(of_row, np.where(links, column[None], far).min(1))
        if (row == of_row).all() and (column == of_column).all():
            return np.concatenate([rows, columns]), np.concatenate([row, column])
        of_row, of_column = row, column


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, recall: float = 0.9999,
                 max_sample: int = 20_000, cell_rows: int = 64, block_rows: int = 4096) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; ids are integers, other columns are not looked at.

    n_links counts the other rows found with at least this cosine. Vectors that are null, zero or hold null or non-finite components,
    and rows with a null id, link with nothing. Vectors link only with vectors of the same length. Rows with
    one id and different vectors are one node of the components. The codebooks are fitted on about ``max_sample`` vectors at most,
    picked by hash; every vector is indexed. An empty table gives an empty table. Links below ``cosine`` are never reported;
    ``recall`` is the target for pairs just at the threshold, and closer pairs are missed less often.
    """
    spark = vectors.sparkSession
    element = vectors.schema[vector_col].dataType.simpleString()
    marked = stored(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).mapInArrow(
        _marked, f"id bigint, mark binary, size int, vector {element}"), "vectors")
    classes = stored(marked.filter("mark IS NOT NULL").groupBy("mark", "size").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "vector-classes")
    found = None
    for size, n in [tuple(r) for r in classes.groupBy("size").count().collect()]:       # one row per vector length
        part = _links_of(spark, classes.filter(F.col("size") == size).select("id", "copies", "vector"), size, n, cosine, recall, max_sample, cell_rows, block_rows)
        found = part if found is None else found.union(part)
    rows = marked.select("id", "mark").join(classes.select("mark", F.col("id").alias("first"), "copies"), "mark", "left")
    if found is None:
        out = rows.withColumn("n_links", F.lit(0).cast("long")).withColumn("component", F.col("id"))
    else:
        found = stored(found, "vector-links")
        counts = found.filter("a = b").groupBy("a").agg(F.sum("n").alias("n"))
        parts = connected_components(found.filter("a <> b").select("a", "b"))
        out = rows.join(counts.withColumnRenamed("a", "first"), "first", "left").join(parts.withColumnRenamed("node", "first"), "first", "left")
        out = out.withColumn("n_links", F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).withColumn(
            "component", F.coalesce("component", "first", "id"))
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _links_of(spark, classes, size, n, cosine, recall, max_sample, cell_rows, block_rows):
    """(a, b, n): the count n of a = b, or a link between a and b."""
    share = min(1.0, max_sample / n)
    sample = _unit(_matrix(classes.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("vector").toArrow().column(0)))
    k = int(np.clip(round((n / cell_rows) ** 0.5), 1, 256))
    if not len(sample):
        k, sample = 1, np.zeros((1, size))
    grid = spark.sparkContext.broadcast(Grid([k_means(sample[:, :size // 2], k), k_means(sample[:, size // 2:], k)], size, cosine, recall))
    width = int(np.ceil(k / max(1, np.ceil(n / k / block_rows))))
    element = classes.schema["vector"].dataType.simpleString()
    assigned = classes.mapInArrow(_assigned(grid), f"id bigint, copies bigint, vector {element}, i int, j int")
    sizes = assigned.groupBy("i", F.floor(F.col("j") / width).alias("part")).count().collect()      # 256 x 256 rows at most
    splits = spark.sparkContext.broadcast({(r[0], r[1]): -(-r[2] // block_rows) for r in sizes})
    dealt = classes.mapInArrow(_dealt(grid, splits, width), f"i int, part int, ms int, vs int, role int, id bigint, copies bigint, vector {element}")
    return dealt.groupBy("i", "part", "ms", "vs").applyInArrow(_compared(grid, width, cosine), "a bigint, b bigint, n bigint")
