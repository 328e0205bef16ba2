"""Exact dedup by deterministic block naming.

Each text, without white space, is cut into blocks of a fixed number of characters. The distinct blocks are
sorted and numbered; these integers are the blocks' names. Then adjacent names are paired, the distinct pairs
are sorted and numbered in turn, and so on, until one name is left for each document. Two documents get the same
name in the same round exactly if their texts are equal: names never collide, as each stands for one block or
one pair of names.

Blocks are sent over the network once, deduplicated before the shuffle. Occurrences travel as two 64-bit keys,
whose one-to-one relation to the distinct blocks is checked on the data; if it doesn't hold the keys are drawn
anew under another seed. So keys only address names and never decide equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, squeezed


def _keys(block: Column, seed: int, width: int) -> tuple[Column, Column]:
    """Two independent 64-bit keys of a block; width below 64 keeps so many bits, which tests use to force clashes."""
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    return tuple(F.xxhash64(F.lit(2 * seed + i), block).bitwiseAND(mask) for i in (0, 1))


def _blocks(text: Column, chars: int) -> Column:
    """Blocks of the text in order; one empty block for an empty text."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0)))


def _numbered(df: DataFrame, *by: str) -> DataFrame:
    """A distinct integer `name` for each row of distinct rows, by their order within hash-dealt partitions."""
    return df.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def name_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, block_chars: int = 1024, key_bits: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """Every row with its identity: rid, doc_id, n_points, text_sha256, level, name.

    (level, name) is equal for two rows exactly if their texts are equal without ASCII white space. A null text
    counts as empty. Each input row has an own rid, so null or repeated ids and repeated rows keep their rows.
    Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("bare", squeezed(F.col("text")))
    split = rows.select(F.explode(_blocks(F.col("bare"), block_chars)).alias("block"))
    for seed in range(16):
        k1, k2 = _keys(F.col("block"), seed, key_bits)
        distinct = split.select(k1.alias("k1"), k2.alias("k2"), "block").distinct()
        names = scratch.keep(_numbered(distinct, "block").select("k1", "k2", "name"))
        if names.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
            break
        scratch.drop(names)
    else:
        raise ValueError("no seed gives distinct keys to distinct blocks")

    def pair(block: Column) -> Column:
        return F.struct(*(k.alias(n) for k, n in zip(_keys(block, seed, key_bits), ("k1", "k2"), strict=True)))

    base = scratch.keep(
        rows.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", F.char_length("text").cast("long").alias("n_points"),
            F.sha2(F.col("bare").cast("binary"), 256).alias("text_sha256"), F.transform(_blocks(F.col("bare"), block_chars), pair).alias("keys"),
        )
    )
    most = base.agg(F.max(F.size("keys"))).first()[0] or 1
    live = base.select("rid", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key")).select("rid", "n", "pos", "key.k1", "key.k2")
    live = scratch.keep(live.join(names, ["k1", "k2"]).select("rid", "n", "pos", "name"))
    scratch.drop(names)
    done, level = [live.filter("n = 1").select("rid", F.lit(0).alias("level"), "name")], 0
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        half = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = live.filter("n > 1").groupBy("rid", "n", (F.col("pos") / 2).cast("int").alias("at")).agg(half(0).alias("left"), F.coalesce(half(1), F.lit(-1)).alias("right"))
        pairs = scratch.keep(pairs.select("rid", ((F.col("n") + 1) / 2).cast("int").alias("n"), F.col("at").alias("pos"), "left", "right"))
        names = scratch.keep(_numbered(pairs.select("left", "right").distinct(), "left", "right"))
        live = scratch.keep(pairs.join(names, ["left", "right"]).select("rid", "n", "pos", "name"))
        scratch.drop(pairs, names)
        done.append(live.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return base.drop("keys").join(found, "rid")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts (see name_documents) the one with the most code points in its original text stays,
    then the one with the smallest doc_id (null last), then the first read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    named = scratch.keep(name_documents(docs, doc_id, text, scratch=scratch, **options))
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    groups = scratch.keep(named.groupBy("level", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")))
    return named.join(groups, ["level", "name"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256")
