"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pricebench.llm.common import cut_lineage, cut_sized

#: Edges (16 bytes each) that one task unites; a graph is contracted until it has no more.
TASK_EDGES = 1_000_000


def _lowest(edges: DataFrame, node: str, other: str, rows: int) -> DataFrame:
    """Each node's smallest neighbour.  Stored, so that a node with very many edges is split in the join that follows."""
    return cut_sized(edges.groupBy(F.col(node).alias("node")).agg(F.min(other).alias("low")), rows)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def united(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their roots: the lesser root of two always wins."""
    nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    root = list(range(len(nodes)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in zip(at[: len(hi)].tolist(), at[len(hi) :].tolist()):
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return nodes, nodes[[top(i) for i in range(len(nodes))]] if len(nodes) else nodes


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    edges = pd.concat(list(batches) or [pd.DataFrame({"hi": [], "lo": []}, dtype="int64")])
    node, root = united(edges["hi"].to_numpy(np.int64), edges["lo"].to_numpy(np.int64))
    yield pd.DataFrame({"node": node, "root": root})


def components(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node it reaches.

    Alternates the two star contractions until the edges are stars around the
    roots, or so few that one task can unite them.  In the contraction each node's
    neighbours are only aggregated and joined, never gathered, and lineage is cut
    each time.  Loops and repeated edges are ignored; no edges give no rows.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges = cut_lineage(edges)
    before = None
    while (n := edges.count()) > task_edges:
        if (now := _digest(edges)) == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct().toDF("node", "root"))
        before = now
        # Larger neighbours move to the smallest neighbour.
        both = edges.union(edges.select("lo", "hi")).toDF("node", "other")
        low = _lowest(both, "node", "other", 2 * n)
        large = both.where(F.col("other") > F.col("node")).join(low, "node").select(
            F.col("other").alias("hi"), F.least("low", "node").alias("lo")).distinct()
        large = cut_sized(large, n)
        # Smaller neighbours and the node itself move to the smallest one.
        low = _lowest(large, "hi", "lo", n)
        moved = large.join(low, large["hi"] == low["node"]).where(F.col("lo") != F.col("low")).select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        edges = cut_sized(low.select(F.col("node").alias("hi"), F.col("low").alias("lo")).union(moved).distinct(), 2 * n)
    return edges.coalesce(1).mapInPandas(_in_one_task, "node long, root long")
