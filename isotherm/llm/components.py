"""Connected components by alternating stars, on Spark joins alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.store import stage


def is_settled(e: DataFrame) -> bool:
    """Whether the edges ``u > v`` are stars around their least nodes: no node is the higher end of two, or of one and the lower end of another."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    return ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below")).where("above > 1 or (above > 0 and below > 0)").isEmpty()


#: edges that a task contracts at once
EDGES = 1 << 20


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as stars: each node of an edge with the least node that these edges lead to."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while True:
        x, y = least[a], least[b]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        while (least[least] != least).any():
            least = least[least]
    far = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[far], nodes[least[far]]


def contract(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars, some at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= EDGES:
                yield stars(held)
                held, n = [], 0
        if held:
            yield stars(held)

    def stars(held: list[pd.DataFrame]) -> pd.DataFrame:
        u, v = (np.concatenate([f[c].to_numpy() for f in held]) for c in ("u", "v"))
        return pd.DataFrame(dict(zip(("u", "v"), contracted(u, v), strict=True)))

    return edges.mapInPandas(run, "u long, v long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node on an edge; a component is its least node.

    Tasks first contract what edges they hold.  Then large-star and small-star rounds, each a minimum per node (combined before
    the shuffle) and an equi-join on the node, contracted again; ends once the edges
    are stars (``is_settled``), which no further round would change.  Nodes
    without an edge are not returned.  No links: an empty table.
    """
    e = stage(contract(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")).distinct(), "edges")
    for k in range(max_rounds + 1):
        if is_settled(e):
            break
        if k == max_rounds:
            raise RuntimeError("components did not settle")
        # large star: neighbours above a node go to the node's least neighbour
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and the node, go to its least neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = stage(contract(small.select("x.*").where("u <> v")).distinct(), "edges")
    return of_stars(e)


def of_stars(e: DataFrame) -> DataFrame:
    """``(node, component)`` of edges ``u, v`` that are stars around their least nodes."""
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
