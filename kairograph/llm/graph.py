"""Connected components of a link table, without gathering more links in a task than it can hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Links to a task; link tables are small beside the texts, and tasks without work cost time too.
LINKS_A_TASK = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the links a, b, without the least nodes themselves."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: a.size], place[a.size :]
    label = np.arange(nodes.size)
    while True:
        low = np.minimum(label[u], label[v])
        if np.array_equal(label[u], label[v]):
            break
        for x in (u, v):  # the roots of both ends are hung on the lower one
            np.minimum.at(label, label[x], low)
        while not np.array_equal(label, up := label[label]):
            label = up
    hung = label != np.arange(nodes.size)
    return nodes[hung], nodes[label[hung]]


def _local(batches):
    """Each task's links as stars."""
    import pyarrow as pa

    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node of its component, which has the row (root, root) too.

    Tasks of LINKS_A_TASK links each turn theirs into stars.  If one task does, that is all; else alternating
    large-star and small-star steps follow: every neighbour over a node is hung on the least of them, until each
    node hangs on a root.  Sums by node are combined before the shuffle; the table is written to the shared folder
    after every round.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v"), "links")
    for _ in range(rounds):
        tasks = -(-edges.count() // LINKS_A_TASK)
        old, edges = edges, stored(edges.coalesce(max(1, tasks)).mapInArrow(_local, "u long, v long"), "links")
        discard(old)
        if tasks <= 1:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["k"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct().coalesce(tasks), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, large["u"] == low["k"]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct().coalesce(tasks), "links")
        for old in (edges, large):
            discard(old)
        edges = new
        # stars: a node that hangs has one edge and nothing hangs on it
        hangs = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).select("u", "n", F.lit(False).alias("held"))
        held = edges.select(F.col("v").alias("u")).distinct().select("u", F.lit(0).cast("long").alias("n"), F.lit(True).alias("held"))
        odd = hangs.unionByName(held).groupBy("u").agg(F.max("n").alias("n"), F.max("held").alias("held")).filter("n > 1 or (held and n > 0)")
        if odd.coalesce(tasks).isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
