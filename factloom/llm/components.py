"""Connected components of an edge table, by contraction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized_join


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the smallest node of the component of each."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            far = new[new]
            if (far == new).all():
                break
            new = far
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def connected(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", most_rounds: int = 60, broadcast_rows: int = 250_000, local_edges: int = 500_000) -> DataFrame:
    """(node, label) for every node of an edge; label: the smallest node of its component.

    In a round every node joins its smallest neighbour, and that one's; the edges between what is left are the next
    round's, and fewer. When at most `local_edges` are left (16 bytes each) one task finishes them. All rounds are
    written tables, so no lineage grows; an error is raised should the rounds not suffice.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    live = scratch.keep(edges.select(*pair(a, b)).filter("a <> b").distinct())
    loops = edges.filter(F.col(a) == F.col(b)).select(F.col(a).alias("node")).distinct()
    steps = []
    for _ in range(most_rounds):
        if (n := live.count()) <= local_edges:
            break
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).union(live.select("b", "a"))
        near = scratch.keep(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("up")))
        up = near.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = scratch.keep(near.join(up, "up").select("node", F.col("top").alias("up")))
        scratch.drop(near)
        end = lambda x: step.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up"))  # noqa: E731, B023
        new = scratch.keep(live.join(end("a"), "a").join(end("b"), "b").select(*pair("a_up", "b_up")).filter("a <> b").distinct())
        scratch.drop(live)
        live = new
        steps.append(step)
    else:
        raise RuntimeError("components did not settle")

    def finish(batches):
        parts = [batch[["a", "b"]].to_numpy(np.int64) for batch in batches]
        if parts:
            rows = np.concatenate(parts)
            nodes, labels = _roots(rows[:, 0], rows[:, 1])
            yield pd.DataFrame({"node": nodes, "label": labels})

    labels = scratch.keep(live.repartition(1).mapInPandas(finish, "node long, label long")) if n else live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    for step in reversed(steps):
        known = labels.select(F.col("node").alias("up"), "label")
        inner = sized_join(step, known, "up", "left", known.count(), broadcast_rows).select("node", F.coalesce("label", "up").alias("label"))
        labels = scratch.keep(inner.union(labels.join(step.select("node"), "node", "left_anti")))
    return labels.union(loops.join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("label")))
