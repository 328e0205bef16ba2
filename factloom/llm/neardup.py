"""MinHash near-dedup as a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets form one class; the join works on classes. Every class has minwise
tokens, one for each of 64 hash functions. In each of several independent trees a class goes down from the root:
a node chooses one function, and a second with probability 1/threshold - 1, and the class moves to the children named
by its minwise tokens there. Similar classes keep together, others part. Classes in a node of at most `node_limit`
are compared with one another by their tokens; larger nodes branch again.

A large node of very similar classes never falls apart, as all share their tokens. So in each large node all classes
are first compared with one pivot, the class that sits in the fullest nodes. Candidate links are verified on the
full sets, components are formed, and a large node branches further only while it holds several components. What is
still large and mixed after `most_levels` is compared in blocks, so no case is dropped. No step lists all pairs of
a group: within a component only enough links are found to connect it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, sized_join
from .substring import U, mix, runs, word_hashes
from .treejoin import TreeJoin

COORDINATES = 64
_rnd = np.random.default_rng(42)
_MULT = _rnd.integers(1, 1 << 63, COORDINATES, dtype=np.int64).astype(U) | U(1)
_ADD = _rnd.integers(1, 1 << 63, COORDINATES, dtype=np.int64).astype(U)


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-word shingles, A-Z lower-cased; the whole text where it has fewer words."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    words, counts = word_hashes(raw)
    out, at = [], 0
    for c in counts.tolist():
        w = words[at : at + c]
        at += c
        out.append(np.unique(runs(w, n, 0x9FB21C651E98DF25)) if c >= n else mix(runs(w, c, 0x9FB21C651E98DF25) + U(c)) if c else np.zeros(0, U))
    return out


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The minwise token of each of the 64 functions, as 32 bits."""
    low = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 1 << 15):
        part = shingles[None, at : at + (1 << 15)]
        low = np.minimum(low, (((part ^ _ADD[:, None]) * _MULT[:, None]) >> U(32)).astype(np.uint32).min(1))
    return low


#: Bits of the parity sketch of a set.
BITS = 1024


def parity(shingles: np.ndarray) -> np.ndarray:
    """A sketch of BITS bits, each telling whether an odd number of shingles falls on it. Two sketches differ at about as many bits as their sets at shingles, while these are few."""
    return np.packbits(np.bincount(((shingles * U(0xD6E8FEB86659FD93)) >> U(40)).astype(np.int64) % BITS, minlength=BITS) & 1)


def _signature(shingles: np.ndarray, low: np.ndarray) -> bytes:
    """The low bytes of the minwise tokens, the parity sketch, and the number of shingles in four bytes."""
    return (low & 0xFF).astype(np.uint8).tobytes() + parity(shingles).tobytes() + np.array([len(shingles)], "<u4").tobytes()


class Alike:
    """Whether signatures look alike, as all but one in 100,000 links do (4.6 standard deviations in each test).

    Links at the threshold agree in most minwise tokens. And their sets differ at no more than a part of both sizes, by
    which the number of different bits of their sketches is bounded; where sets differ at so many shingles that the
    sketches are full, that bound is beyond what any two sketches differ at, and only the tokens tell.
    """

    def __init__(self, percent: int):
        t = percent / 100
        self.percent = percent
        self.least = max(1, int(COORDINATES * t - 4.6 * (COORDINATES * t * (1 - t)) ** 0.5))
        n, d = BITS, np.arange(8 * BITS, dtype=np.float64)
        one, two = (1 - 2 / n) ** d, (1 - 4 / n) ** d
        self.most = n / 2 * (1 - one) + 4.6 * np.sqrt(np.maximum(n * (1 - one**2) + n * (n - 1) * (two - one**2), 0) / 4) + 1e-6

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        end = COORDINATES + BITS // 8
        near = (x[:, :COORDINATES] == y[:, :COORDINATES]).sum(1) >= self.least
        at = np.flatnonzero(near)
        x, y = x[at], y[at]
        sizes = sum(np.ascontiguousarray(v[:, end:]).view("<u4").ravel().astype(np.int64) for v in (x, y))
        apart = np.bitwise_count(x[:, COORDINATES:end] ^ y[:, COORDINATES:end]).sum(1)
        near[at] = apart <= self.most[np.minimum((100 - self.percent) * sizes // (100 + self.percent), len(self.most) - 1)]
        return near


def _choices(nodes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node: its first function, its second, and whether it has a second."""
    h = mix(nodes.astype(U) ^ U(0x2545F4914F6CDD1D))
    one = (h & U(63)).astype(np.int64)
    two = (one + 1 + ((h >> U(8)) % U(63)).astype(np.int64)) % 64
    return one, two, ((h >> U(32)).astype(np.float64) / 2**32) < 1 / threshold - 1


def _child(nodes: np.ndarray, function: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(nodes.astype(U) * U(0x9E3779B97F4A7C15) + function.astype(U) + U(1)) ^ token.astype(U)).astype(np.int64)


def _profile(trees: int, threshold: float, n: int):
    roots = mix(np.arange(1, trees + 1, dtype=U)).astype(np.int64)
    one, two, second = _choices(roots, threshold)

    @F.pandas_udf("n_shingles long, s1 long, s2 long, sig binary, nodes array<long>")
    def profile(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for at in range(0, len(texts), 64):
            for s in shingle_sets(list(texts.iloc[at : at + 64]), n):
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                low = minwise(s)
                name = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                nodes = np.concatenate((_child(roots, one, low[one]), _child(roots[second], two[second], low[two[second]])))
                rows.append((len(s), int(name[0]), int(name[1]), _signature(s, low), nodes.tolist()))
        return pd.DataFrame(rows, columns=["n_shingles", "s1", "s2", "sig", "nodes"]).astype({"s1": "Int64", "s2": "Int64"})

    return profile


@F.pandas_udf(T.LongType())
def _shared(x: pd.Series, y: pd.Series) -> pd.Series:
    sets = ((np.frombuffer(a, U), np.frombuffer(b, U)) for a, b in zip(x, y, strict=True))
    return pd.Series([len(np.intersect1d(a, b, assume_unique=True)) for a, b in sets], dtype="int64")


def _classes(rows: DataFrame, scratch: Scratch, percent: int, n: int, trees: int) -> tuple[DataFrame, DataFrame]:
    """Every row with its set's name, and the classes of equal sets, each with the row that stands for it."""
    k1, k2 = (F.xxhash64(F.lit(i), F.col("text")) for i in (1, 2))
    base = scratch.keep(rows.select("doc_id", k1.alias("k1"), k2.alias("k2"), _profile(trees, percent / 100, n)("text").alias("p")).select("doc_id", "k1", "k2", "p.*"), text_rows=512)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2"))
    of = base.filter("n_shingles > 0").groupBy("s1", "s2").agg(one.alias("first"), F.min("sig").alias("sig"), F.min("nodes").alias("nodes"))
    return base, scratch.keep(of.withColumn("cid", F.monotonically_increasing_id()))


class _Join(TreeJoin):
    def __init__(self, rows: DataFrame, scratch: Scratch, classes: DataFrame, percent: int, n: int, broadcast_rows: int, **options):
        self.rows, self.percent, self.n, self.bound = rows, percent, n, broadcast_rows
        self.sets: list[DataFrame] = []
        super().__init__(scratch, classes, Alike(percent), small_rows=broadcast_rows, **options)

    def load_sets(self, edges: DataFrame) -> DataFrame:
        """Full sets of the classes of the edges; those loaded before are kept."""
        need = edges.select(F.col("a").alias("cid")).union(edges.select("b")).distinct()
        for known in self.sets:
            need = need.join(known.select("cid"), "cid", "left_anti")
        need = self.scratch.keep(need.join(self.classes.select("cid", "first"), "cid").select("cid", F.col("first.doc_id").alias("first_id"), "first.k1", "first.k2"))
        n, words = need.count(), self.n

        @F.pandas_udf("binary")
        def full(texts: pd.Series) -> pd.Series:
            return pd.Series([s.tobytes() for at in range(0, len(texts), 64) for s in shingle_sets(list(texts.iloc[at : at + 64]), words)], dtype=object)

        texts = self.rows.select("doc_id", "text", F.xxhash64(F.lit(1), F.col("text")).alias("k1"), F.xxhash64(F.lit(2), F.col("text")).alias("k2"))
        found = sized_join(texts, need, ["k1", "k2"], "inner", n, self.bound).filter(F.col("doc_id").eqNullSafe(F.col("first_id")))
        self.sets.append(self.scratch.keep(found.dropDuplicates(["cid"]).select("cid", full("text").alias("hashes")), text_rows=512))
        sets = self.sets[0]
        for more in self.sets[1:]:
            sets = sets.union(more)
        return sets

    def verify(self, edges: DataFrame) -> DataFrame:
        """The edges whose full sets are similar enough."""
        sets = self.load_sets(edges)
        with_a = edges.join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("x")), "a")
        both = with_a.join(sets.select(F.col("cid").alias("b"), F.col("hashes").alias("y")), "b")
        measured = both.select("a", "b", (F.octet_length("x") / 8 + F.octet_length("y") / 8).alias("sum"), _shared("x", "y").alias("both"))
        return self.scratch.keep(measured.filter(100 * F.col("both") >= self.percent * (F.col("sum") - F.col("both"))).select("a", "b"), text_rows=500)

    def branch(self, large: DataFrame) -> DataFrame:
        threshold = self.percent / 100

        def children(batches):
            for batch in batches:
                node, cid = batch["node"].to_numpy(np.int64), batch["cid"].to_numpy(np.int64)
                sig = np.frombuffer(b"".join(batch["sig"]), np.uint8).reshape(len(node), -1)
                one, two, second = _choices(node, threshold)
                every = np.arange(len(node))
                yield pd.DataFrame({"cid": np.concatenate((cid, cid[second])), "node": np.concatenate((_child(node, one, sig[every, one]), _child(node[second], two[second], sig[every[second], two[second]])))})

        return self.signed(large).select("node", "cid", "sig").mapInPandas(children, "cid long, node long")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, percent: int = 75, shingle: int = 5, trees: int = 12, node_limit: int = 1000, most_levels: int = 10, broadcast_rows: int = 40_000, scratch: Scratch | None = None) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if their shingle sets' Jaccard similarity is at least `percent` in 100; component_id is the
    smallest doc_id that links lead to. kept: doc_id equals component_id. A text without words (or null) has an empty
    set and is linked with nothing. Null ids come after all others: a row without an id is kept only if its whole
    component has none. Rows that repeat an id are judged each by their own text. Other columns are ignored; an empty
    table gives an empty result. `trees` sets the recall: a pair at the threshold is missed by one tree with about
    0.2 at the first level and 0.5 at the fourth, and by all twelve with less than 0.001. What the result reads is in
    `scratch`, for a caller that drops it once the result is written.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    before = list(scratch.held())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base, classes = _classes(rows, scratch, percent, shingle, trees)
    join = _Join(rows, scratch, classes, percent, shingle, broadcast_rows, node_limit=node_limit, most_levels=most_levels)
    labels = join.run(scratch.keep(classes.select("cid", F.explode("nodes").alias("node"))))
    slim = classes.select("s1", "s2", "cid", F.col("first.doc_id").alias("first_id"))
    if labels is not None:
        slim = scratch.keep(slim.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("s1", "s2", "first_id", F.coalesce("label", "cid").alias("label")))
        least = scratch.keep(slim.groupBy("label").agg(F.min("first_id").alias("component_id")))
        slim = scratch.keep(slim.join(least, "label").select("s1", "s2", "component_id"))
    else:
        slim = scratch.keep(slim.select("s1", "s2", F.col("first_id").alias("component_id")))
    scratch.only(*before, base, slim)
    found = base.select("doc_id", "n_shingles", "s1", "s2").join(slim, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
