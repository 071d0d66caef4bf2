"""Connected components of a large set of links: forests of what a task holds, and alternating stars between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.common import durable, skew_join
from gatewright.session import in_arrow

#: Links that one task joins.
LINKS = 1_000_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of links (a, b) but the smallest of its component, and that one: the lower root is taken over along all links, and roots of roots, until nothing moves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (left := root[u] != root[v]).any():
        u, v = u[left], v[left]
        low = np.minimum(root[u], root[v])
        for x in (root[u], root[v]):  # roots alone, so what is in one tree stays there
            np.minimum.at(root, x, low)
        while (root != (up := root[root])).any():
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _forest(batches):
    held = [tuple(batch.column(batch.schema.get_field_index(c)).to_numpy() for c in "ab") for batch in batches]
    if held:
        a, b = roots_of(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours are moved to the smallest node among them and itself.

    links: (a, b), a > b. The large star takes all neighbours and moves the larger ones; the
    small star takes the smaller neighbours and moves them with the node.
    """
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = skew_join(ends, least, ["a"])
    if large:
        out = moved.where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        out = moved.select(F.explode(F.array("a", "b")).alias("x"), F.col("m").alias("y"))
    return out.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the smallest node connected to it.

    Links are dealt to as many tasks as it takes for LINKS each; a task gives on a forest of its own. With
    several tasks each round goes on with a pair of aggregates and joins between them, is written to the
    checkpoint folder, and the driver sees one count and one sum of it; a round leaves no more links than it
    got, and the rounds grow with the logarithm of the longest chain. Links of one task are done at once.
    """
    now = durable(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        summed = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        seen = now.agg(F.count(F.lit(1)), summed).first()
        parts = -(-seen[0] // LINKS)
        if tuple(seen) == mark or parts == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)
        forests = in_arrow(now.repartition(parts), _forest, "a long, b long")
        if parts == 1:
            return durable(forests).select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = durable(_star(_star(forests, True), False))
