"""Connected components of a distributed graph by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, spread_join

#: Edges that a task reduces to a forest before the rounds.
FOREST = 100_000


def _signature(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def lowest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, and the smallest node that the edges connect each to."""
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, root = place[: len(u)], place[len(u) :], np.arange(len(nodes))
    while True:
        low, old = np.minimum(root[a], root[b]), root.copy()
        for at in (a, b, old[a], old[b]):
            np.minimum.at(root, at, low)
        root[:] = root[root]
        if (root == old).all():
            return nodes, nodes[root]


def _forest(edges: DataFrame, n: int) -> DataFrame:
    """Fewer edges that connect the same nodes: each task replaces its own FOREST or so by a star for each part."""

    def run(batches):
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if parts:
            nodes, low = lowest(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != low]), pa.array(low[nodes != low])], ["u", "v"])

    return edges.repartition(n // FOREST + 1).mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long, neither null); component is the smallest node reachable.

    The edges are first thinned out by tasks that each see a bounded number of them. Each round then hangs every node's larger, then
    its smaller neighbours under its smallest one, and is written to the shared folder. A hub keeps its leaves as
    single rows: no group is gathered, and the few hubs of a round are broadcast to their leaves. Rounds are logarithmic in
    the length of the longest chain. Only a count and a checksum reach the driver.
    """
    given = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    kept = materialise(_forest(given, given.count()).distinct(), "edges")
    before = _signature(kept)
    while before[0]:
        both = materialise(kept.union(kept.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges-both")
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = spread_join(both.filter("v > u"), low, ["u"], "n", 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, "edges-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = spread_join(large, low, ["u"], "n", before[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        kept = materialise(small.filter("u <> v").distinct(), "edges")
        after = _signature(kept)
        if after == before:
            break
        before = after
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).union(kept.select("v", "v").distinct())
