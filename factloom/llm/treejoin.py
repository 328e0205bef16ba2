"""The part that similarity joins over trees of nodes have in common.

Items sit in nodes, an item in several. First each item is compared with the pivots that it meets most often, a node's
pivot being the item that sits in the fullest nodes: so a group of many like items costs links by their number, not by
their pairs. Then items of a small node that are still apart are compared by their signatures; in a large node all
are compared with its pivot. What looks alike is verified, verified links form components, and a large node goes on
only while it holds several components. What is still large and mixed at the
last level is compared in blocks. So no node is listed pair by pair unless it is small or can't be told apart
otherwise, and no pair is dropped for its node's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized_join
from .components import connected


def _pairs(frame: pd.DataFrame, alike) -> pd.DataFrame:
    """Pairs of rows of one node that look alike and have different labels; rows of a node stand together."""
    node, cid, label = (frame[c].to_numpy(np.int64) for c in ("node", "cid", "label"))
    sig = np.frombuffer(b"".join(frame["sig"]), np.uint8).reshape(len(node), -1)
    left, right, lag = [], [], 1
    at = np.arange(len(node) - 1)
    while len(at):
        at = at[at + lag < len(node)]
        at = at[node[at] == node[at + lag]]
        for k in range(0, len(at), 1 << 16):
            i = at[k : k + (1 << 16)]
            i = i[label[i] != label[i + lag]]
            i = i[alike(sig[i], sig[i + lag])]
            left.append(cid[i])
            right.append(cid[i + lag])
        lag += 1
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _compare(alike):
    """A mapInPandas function over rows (node, cid, label, sig) sorted by node."""

    def compare(batches):
        rest = None
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(frame):
                continue
            last = frame["node"].to_numpy() == frame["node"].iloc[-1]
            rest, frame = frame[last], frame[~last].reset_index(drop=True)
            if len(frame):
                yield _pairs(frame, alike)
        if rest is not None and len(rest):
            yield _pairs(rest.reset_index(drop=True), alike)

    return compare


class TreeJoin:
    """classes: (cid, sig, ...), sig being bytes of one length. alike: of two arrays of signatures, which rows look alike."""

    def __init__(self, scratch: Scratch, classes: DataFrame, alike, *, node_limit: int, most_levels: int, small_rows: int = 250_000):
        self.scratch, self.classes, self.alike, self.limit, self.levels = scratch, classes, alike, node_limit, most_levels
        self.small = small_rows
        self.sigs, self.many = classes.select("cid", "sig"), classes.count()

    def join(self, big: DataFrame, kept: DataFrame, on: str, how: str = "inner") -> DataFrame:
        """A join with a kept table of narrow rows, which is broadcast if it has at most `small_rows` rows."""
        return sized_join(big, kept, on, how, kept.count(), self.small)

    def signed(self, rows: DataFrame, on: str = "cid", sig: str = "sig") -> DataFrame:
        """The rows with the signature of the class that column `on` names."""
        # A signature counts as several narrow rows.
        return sized_join(rows, self.sigs.select(F.col("cid").alias(on), F.col("sig").alias(sig)), on, "inner", self.many, self.small // 2)

    def verify(self, edges: DataFrame) -> DataFrame:
        """The links (a, b) among the edges, as a kept table."""
        raise NotImplementedError

    def branch(self, large: DataFrame) -> DataFrame:
        """(cid, node) of the next level; the default lets large nodes stand as they are."""
        return large.select("cid", "node")

    def mixed(self, rows: DataFrame, sizes: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Rows of nodes that hold several components, with their labels."""
        rows = self.join(rows, sizes, "node")
        if labels is None:
            return rows.withColumn("label", F.col("cid"))
        rows = self.scratch.keep(self.join(rows, labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid")))
        several = rows.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("node")
        return self.join(rows, self.scratch.keep(several), "node")

    def blocks(self, large: DataFrame) -> DataFrame:
        """Rows dealt to all pairs of blocks of their node; each pair of blocks is a node of its own."""
        own = F.pmod(F.xxhash64("cid"), F.col("count"))
        cut = large.withColumn("count", F.ceil(F.col("n") / self.limit).cast("long")).withColumn("own", own)
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
        return cut.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "cid", "label")

    def candidates(self, rows: DataFrame) -> DataFrame:
        with_sig = self.signed(rows).select("node", "cid", "label", "sig")
        return with_sig.repartition("node").sortWithinPartitions("node").mapInPandas(_compare(self.alike), "a long, b long")

    def pivots(self, large: DataFrame, few: int | None = None) -> DataFrame:
        """Pairs (a, b) that look alike of a node's items and its pivot; with `few` each item's most frequent pivots only."""
        weight = self.scratch.keep(large.groupBy("cid").agg(F.sum("n").alias("weight")))
        best = self.join(large, weight, "cid").groupBy("node").agg(F.max(F.struct("weight", "cid", "label")).alias("p"))
        best = self.scratch.keep(best.select("node", F.col("p.cid").alias("pivot"), F.col("p.label").alias("pivot_label")))
        met = self.join(large, best, "node").filter("label <> pivot_label")
        if few:
            met = met.groupBy("cid", "pivot").agg(F.count(F.lit(1)).alias("times")).groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "pivot")), False), 1, few).alias("p"))
            met = met.select("cid", F.explode("p.pivot").alias("pivot"))
        stars = met.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
        alike = self.alike

        @F.pandas_udf("boolean")
        def close(x: pd.Series, y: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=bool)
            return pd.Series(alike(*(np.frombuffer(b"".join(v), np.uint8).reshape(len(x), -1) for v in (x, y))))

        both = self.signed(self.signed(stars, "a", "x"), "b", "y")
        return both.filter(close("x", "y")).select("a", "b")

    def run(self, rows: DataFrame) -> DataFrame | None:
        """(node, label) of the linked items, label being the smallest cid of the component; None without links.

        rows: (cid, node) of the first level, a kept table.
        """
        keep, drop = self.scratch.keep, self.scratch.drop
        links, labels = None, None
        for level in range(1, self.levels + 1):
            sizes = keep(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
            if level == 1:
                met = keep(self.join(rows, sizes, "node").withColumn("label", F.col("cid")))
                first = keep(self.pivots(met, 2))
                if not first.isEmpty():
                    links = self.verify(first)
                    labels = None if links.isEmpty() else connected(links, self.scratch)
                drop(met, first)
            here = keep(self.mixed(rows, sizes, labels).select("node", "cid", "label", "n"))
            drop(rows, sizes)
            if here.isEmpty():
                break
            large = here.filter(F.col("n") > self.limit)
            any_large = not large.isEmpty()
            found = self.candidates(here.filter(F.col("n") <= self.limit).select("node", "cid", "label"))
            if any_large:
                found = found.union(self.pivots(large) if level < self.levels else self.candidates(self.blocks(large)))
            edges = keep(found.distinct())
            if not edges.isEmpty():
                good = self.verify(edges)
                links = good if links is None else keep(links.union(good))
                if not links.isEmpty():
                    labels = connected(links, self.scratch)
            if not any_large or level == self.levels:
                break
            rows = keep(self.branch(large).distinct())
            self.scratch.tidy()
        return labels
