"""The vector operator against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import components, embeddings
from dialoom.llm.components import connected_components


def brute(x, ids, cosine=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= cosine
    np.fill_diagonal(links, False)
    parent = np.arange(len(x))
    while True:
        new = np.minimum(parent, np.where(links, parent[None], len(x)).min(1))
        if (new == parent).all():
            return links, ids[parent]
        parent = new


@pytest.mark.parametrize("block_rows,cell_rows", [(4096, 64), (20, 16)])
def test_vectors_by_brute_force(spark, block_rows, cell_rows):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 32))
    near = np.concatenate([base[i] + rng.normal(size=(n, 32)) * s for i, n, s in ((0, 120, 0.1), (1, 10, 0.25), (2, 5, 0.3), (3, 3, 0))])
    x = np.concatenate([base, near]).astype(np.float32)
    ids = rng.permutation(len(x)) + 1000
    order = np.argsort(ids)
    x, ids = x[order], ids[order]
    links, component = brute(x.astype(float), ids)
    rows = [(int(i), v.tolist(), 1) for i, v in zip(ids, x)]
    bad = [(1, None, 0), (2, [0.0] * 32, 0), (3, [float("nan")] + [1.0] * 31, 0), (4, [None] + [1.0] * 31, 0), (5, [], 0), (None, x[0].tolist(), 0), (6, [1.0, 2.0], 0), (7, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, copies int").repartition(3)
    got = {r.vec_id: r for r in embeddings.near_vectors(df, block_rows=block_rows, cell_rows=cell_rows).collect()}
    n = np.array([got[i].n_links for i in ids])
    assert (n <= links.sum(1)).all() and n.sum() >= 0.99 * links.sum() > 1000
    assert np.mean([got[i].component_id == c for i, c in zip(ids, component)]) > 0.99
    for i in (1, 2, 3, 4, 5, None):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[6].n_links, got[7].n_links, got[7].component_id) == (1, 1, 6)
    exact = {r.vec_id: r.n_links for r in embeddings.near_vectors(df, recall=1.0, cell_rows=cell_rows).collect()}
    assert [exact[i] for i in ids] == links.sum(1).tolist()


def test_vectors_edge_cases(spark):
    df = spark.createDataFrame([(i % 3, [1.0, 2.0]) for i in range(9)], "vec_id bigint, embedding array<double>")
    assert {(r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()} == {(i, 8, 0) for i in range(3)}
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    assert embeddings.near_vectors(df.selectExpr("vec_id", "CAST(NULL AS ARRAY<DOUBLE>) AS embedding")).filter("n_links = 0").count() == 9


def test_multi_sequence_order_and_bound():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = embeddings.Grid([embeddings.k_means(x[:, :4], 6), embeddings.k_means(x[:, 4:], 6)], 8, 0.9, 1.0)
    home, cost = grid.costs(x)
    for row in range(20):
        cells = list(grid.visits(cost, row))
        total = [cost[0][row, i] + cost[1][row, j] for i, j in cells]
        assert total == sorted(total) and len(cells) == (cost[0][row][:, None] + cost[1][row][None] <= grid.limit).sum()
        close = np.flatnonzero(x @ x[row] >= 0.9)
        assert {(home[0][k], home[1][k]) for k in close} <= set(cells)       # nothing is missed at recall 1


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 300) if i % 50] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(links, "u bigint, v bigint").repartition(6)
    want = {i: i - (i - 1) % 50 for i in range(1, 301)} | {i: 1000 for i in range(1000, 1400)}
    assert dict(map(tuple, connected_components(df).collect())) == want
    assert connected_components(df.limit(0)).count() == 0


def test_components_of_a_hub(spark):
    """A star whose hub has most links, with stars behind it; every link of a hub counts."""
    links = [(1, i) for i in range(2, 4000)] + [(i, 10_000 + i) for i in range(2, 4000, 7)] + [(20_000 + i, 20_001 + i) for i in range(40)]
    df = spark.createDataFrame(links, "u bigint, v bigint").repartition(5)
    want = {n: 1 if n < 20_000 else 20_000 for pair in links for n in pair}
    for hub in (1, 10, 1 << 20):
        assert dict(map(tuple, connected_components(df, hub=hub).collect())) == want


def test_links_of_a_hub_stay_where_they_are(spark):
    rows = spark.range(50_000).selectExpr("1L AS a", "id + 2 AS b").repartition(8)
    spread = components._with_least(rows, 100).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 8000


def test_forests_are_given_out_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(components, "MOST_NODES", 10)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i + 1, i + 9)), pa.array(range(i, i + 8))], names=["a", "b"]) for i in range(0, 64, 8)]
    out = [r for b in components._forest(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert len(out) == 64 and all(a > b for a, b in out)
