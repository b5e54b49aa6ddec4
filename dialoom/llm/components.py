"""Connected components by alternating star steps; no task sees a component or all links of a node.

A star step gives every link of a node the node's smallest neighbour. Nodes with very many links (hubs) are few by their
definition, at most MOST_HUBS, so their smallest neighbours go to the links, and only the links of other nodes are dealt out by node.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import stored

HUB, MOST_HUBS = 4096, 2048         # a hub has at least HUB links, and more than a 1 / MOST_HUBS of all
MOST_NODES = 500_000                # nodes that a forest holds before it is given out


def _forest(batches):
    """The links of one partition as stars: a link that closes a circle is left out, as far as the nodes held can show it."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def stars():
        nodes = [x for x in parent if root(x) != x]
        for at in range(0, len(nodes), 50_000):
            part = nodes[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, kind.field(0).type), pa.array([root(x) for x in part], kind.field(1).type)],
                                             names=["a", "b"])

    kind = None
    for batch in batches:
        kind = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > MOST_NODES:
            yield from stars()
            parent.clear()
    if parent:
        yield from stars()


def _with_least(rows: DataFrame, hub: int) -> DataFrame:
    """The links (a, b) with m, the smallest b of each a."""
    least = stored(rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    n = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(hub, n // MOST_HUBS)
    hubs = F.broadcast(least.filter(F.col("n") > limit).select("a", "m"))      # at most n / limit <= MOST_HUBS rows
    others = rows.join(hubs, "a", "left_anti").join(least.filter(F.col("n") <= limit).select("a", "m"), "a")
    return others.select("a", "b", "m").union(rows.join(hubs, "a").select("a", "b", "m"))


def connected_components(links: DataFrame, hub: int = HUB) -> DataFrame:
    """(node, component) for every node of the first two columns of ``links``; component = the smallest node.

    Each partition first reduces its links to a spanning forest, then large-star and small-star steps run until the
    links are stars. Nulls and links of a node with itself are dropped; no links give an empty table.
    """
    u, v = links.columns[:2]
    kind = dict(links.dtypes)[u]
    links = links.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).filter("a <> b")
    now, before = stored(links.mapInArrow(_forest, f"a {kind}, b {kind}").distinct(), "links"), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if mark["n"] == 0 or (mark["n"], mark["x"]) == before:
            break
        before = (mark["n"], mark["x"])
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, hub).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "large")
        small = _with_least(large, hub).select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.a", "s.b")
        now = stored(small.filter("a <> b").mapInArrow(_forest, f"a {kind}, b {kind}").distinct(), "links")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
