"""Closed frequent itemsets of baskets and the rules between them, level by level over blocks of baskets.

The baskets are dealt into blocks of bounded size, each kept as one sparse matrix (row starts and item ids as numpy
arrays). A level's frontier is a table of closed sets with the items that extend them often enough. Its children go
to every block in packed batches; a block multiplies the occurrence of the batch's prefixes with its basket-item matrix,
which gives the supports of all extensions at once, and Spark sums these over the blocks. An extension with the support
of its prefix belongs to the closure; a closure that holds an earlier item outside the parent has another owner, and is
left to it. So every closed set is made once, without looking it up. What a block gets or gives depends on the number of
frequent sets, which a support in proportion to the baskets bounds; nothing is collected to the driver or one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized_join

#: Baskets of more frequent items than this are left out of the first count of pairs, see _frequent_pairs.
WIDE = 256
#: So many entries of a product are held at once.
ENTRIES = 2_000_000
#: A batch of the frontier has about so many sets.
BATCH = 4096
#: No more frequent items than this are broadcast.
MOST_ITEMS = 1_000_000

_PACKED = "batch int, sids binary, starts binary, items binary, col_starts binary, cols binary"


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each run of a length, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _slices(sizes: np.ndarray, most: int):
    """Bounds of runs of neighbours whose sizes sum up to `most` or a little more; a larger one stands alone."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def _pack_block(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """A block's baskets as one row: starts and items of a sparse matrix, without baskets of one item."""
    basket, item = rows["basket"].to_numpy(), rows["item"].to_numpy()
    order = np.lexsort((item, basket))
    basket, item = basket[order], item[order]
    first = np.flatnonzero(np.r_[True, basket[1:] != basket[:-1]])
    size = np.diff(np.r_[first, len(basket)])
    item, size = item[np.repeat(size > 1, size)], size[size > 1]
    wide, light = int((size > most).sum()), size[size <= most].astype(np.int64)
    starts = np.r_[0, np.cumsum(size)].astype(np.int64)
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "starts": [starts.tobytes()], "items": [item.astype(np.int64).tobytes()], "n_pairs": [int((light * (light - 1) // 2).sum())], "n_wide": [wide]})


def _pairs_in(starts: np.ndarray, items: np.ndarray, most: int, with_wide: bool):
    """Arrays a, b of all pairs a < b within a basket, in parts of bounded size."""
    sizes = np.diff(starts)
    for k in np.unique(sizes):
        if k > most and not with_wide:
            continue
        own = starts[:-1][sizes == k]
        if k > most:
            for at in own:
                row = items[at : at + k]
                for i in range(k - 1):
                    yield np.full(k - 1 - i, row[i]), row[i + 1 :]
            continue
        left, right = np.triu_indices(k, 1)
        for at in range(0, len(own), step := max(1, ENTRIES // len(left))):
            part = own[at : at + step, None]
            yield items[part + left].ravel(), items[part + right].ravel()


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs with the sum of their counts, in order."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], np.add.reduceat(n, first)


def _frequent_pairs(blocks: DataFrame, shards: int, least: int, most: int, with_wide: bool) -> DataFrame:
    """a, b, n of all pairs a < b that reach `least`. A block sends each shard of pairs one packet."""

    def send(batches):
        for pdf in batches:
            for starts, items in zip(pdf["starts"], pdf["items"], strict=True):
                held, size = [], 0
                for part in _pairs_in(np.frombuffer(starts, np.int64), np.frombuffer(items, np.int64), most, with_wide):
                    held.append(part)
                    size += len(part[0])
                    if size >= 2 * ENTRIES:
                        yield packets(held)
                        held, size = [], 0
                if held:
                    yield packets(held)

    def packets(held):
        a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        a, b, n = _summed(a, b, np.ones(len(a), np.int64))
        mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        shard = ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        cut = [(s, order[x:y]) for s, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)) if x < y]
        return pd.DataFrame({"shard": [s for s, _ in cut], "a": [a[o].tobytes() for _, o in cut], "b": [b[o].tobytes() for _, o in cut], "n": [n[o].astype(np.int32).tobytes() for _, o in cut]})

    def total(pdf):
        a, b = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("a", "b"))
        a, b, n = _summed(a, b, np.frombuffer(b"".join(pdf["n"]), np.int32).astype(np.int64))
        return pd.DataFrame({"a": a, "b": b, "n": n})[n >= least]

    sent = blocks.select("starts", "items").mapInPandas(send, "shard int, a binary, b binary, n binary")
    return sent.groupBy("shard").applyInPandas(total, "a long, b long, n long")


def _pack_sets(rows: pd.DataFrame) -> pd.DataFrame:
    def joined(column):
        arrays = [np.asarray(x if x is not None else [], np.int64) for x in column]
        return np.r_[0, np.cumsum([len(x) for x in arrays])].astype(np.int64).tobytes(), np.concatenate([np.sort(x) for x in arrays]).tobytes()

    (starts, items), (col_starts, cols) = joined(rows["items"]), joined(rows["cols"])
    return pd.DataFrame({"batch": [rows["batch"].iloc[0]], "sids": [rows["sid"].to_numpy(np.int64).tobytes()], "starts": [starts], "items": [items], "col_starts": [col_starts], "cols": [cols]})


class _Matrix:
    """A block's baskets by row and by column."""

    def __init__(self, starts: bytes, items: bytes):
        self.starts, items = np.frombuffer(starts, np.int64), np.frombuffer(items, np.int64)
        self.sizes = np.diff(self.starts)
        self.names, self.codes = np.unique(items, return_inverse=True)
        rows = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.cells = rows * len(self.names) + self.codes  # ascending, as rows are and items within a row
        self.by_column = rows[np.argsort(self.codes, kind="stable")]
        self.column_sizes = np.bincount(self.codes, minlength=len(self.names))
        self.column_starts = np.cumsum(self.column_sizes) - self.column_sizes

    def coded(self, items: np.ndarray) -> np.ndarray:
        """Columns of items; -1 where this block has none."""
        at = np.minimum(np.searchsorted(self.names, items), len(self.names) - 1)
        return np.where(self.names[at] == items, at, -1)

    def occurrences(self, starts: np.ndarray, codes: np.ndarray, entries: int):
        """set, row of every basket that holds all items of a set, in parts. codes: by set, the rarest first."""
        sizes = np.diff(starts)
        first = codes[starts[:-1]]
        for at, end in _slices(self.column_sizes[first], entries):
            own = first[at:end]
            which = np.repeat(np.arange(at, end), self.column_sizes[own])
            row = self.by_column[_ragged(self.column_starts[own], self.column_sizes[own])]
            for k in range(1, int(sizes[at:end].max())):
                asked = sizes[which] > k
                cell = row * len(self.names) + codes[np.minimum(starts[which] + k, len(codes) - 1)]
                found = self.cells[np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)] == cell
                which, row = which[found | ~asked], row[found | ~asked]
            yield which, row


def _product(sets: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    return product(sets, block, ENTRIES)


def product(sets: pd.DataFrame, block: pd.DataFrame, entries: int) -> pd.DataFrame:
    """sid, own, item, n of one block: the support of each set (own) and of the set with each of its columns."""
    out = []
    if len(block) and len(sets):
        matrix = _Matrix(block["starts"].iloc[0], block["items"].iloc[0])
        if len(matrix.names):
            for batch in sets.itertuples():
                out += _batch_product(matrix, *(np.frombuffer(x, np.int64) for x in (batch.sids, batch.starts, batch.items, batch.col_starts, batch.cols)), entries)
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"sid": np.zeros(0, np.int64), "own": np.zeros(0, bool), "item": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})


def _batch_product(matrix: _Matrix, sids, starts, items, col_starts, cols, entries: int) -> list[pd.DataFrame]:
    codes, width = matrix.coded(items), len(matrix.names)
    of = np.repeat(np.arange(len(sids)), np.diff(starts))
    here = np.ones(len(sids), bool)
    here[of[codes < 0]] = False
    chosen = np.flatnonzero(here)
    if not len(chosen):
        return []
    keep = here[of]
    codes, of = codes[keep], np.searchsorted(chosen, of[keep])
    order = np.lexsort((matrix.column_sizes[codes], of))
    codes, starts = codes[order], np.r_[0, np.cumsum(np.diff(starts)[chosen])]
    col_of = np.repeat(np.arange(len(sids)), np.diff(col_starts))
    col_codes = matrix.coded(cols)
    keep = here[col_of] & (col_codes >= 0)
    wanted = np.searchsorted(chosen, col_of[keep]) * width + col_codes[keep]  # ascending, as columns are within a set
    own, found = np.zeros(len(chosen), np.int64), np.zeros(len(wanted), np.int64)
    has_columns = np.zeros(len(chosen), bool)
    has_columns[wanted // width] = True
    for which, row in matrix.occurrences(starts, codes, entries):
        own += np.bincount(which, minlength=len(chosen))
        which, row = which[has_columns[which]], row[has_columns[which]]
        for at, end in _slices(matrix.sizes[row], entries):
            size = matrix.sizes[row[at:end]]
            key = np.repeat(which[at:end], size) * width + matrix.codes[_ragged(matrix.starts[row[at:end]], size)]
            place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            found += np.bincount(place[wanted[place] == key], minlength=len(wanted))
    some, hit = own > 0, found > 0
    return [
        pd.DataFrame({"sid": sids[chosen[some]], "own": True, "item": 0, "n": own[some]}),
        pd.DataFrame({"sid": sids[chosen[wanted[hit] // width]], "own": False, "item": matrix.names[wanted[hit] % width], "n": found[hit]}),
    ]


class _Blocks:
    """The blocks of baskets, and counts over all of them."""

    def __init__(self, scratch: Scratch, kept: DataFrame, entries: int, block_entries: int):
        most = WIDE
        self.scratch, self.most, self.number = scratch, most, max(1, math.ceil(entries / block_entries))
        dealt = kept.withColumn("block", F.pmod(F.xxhash64("basket"), F.lit(self.number)).cast("int"))
        self.table = scratch.keep(dealt.groupBy("block").applyInPandas(lambda rows: _pack_block(rows, most), "block int, starts binary, items binary, n_pairs long, n_wide long"))
        self.pairs, self.wide = self.table.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)), F.coalesce(F.sum("n_wide"), F.lit(0))).first()

    def counts(self, sets: DataFrame, number: int) -> DataFrame:
        """sid, own, item, n: supports of `number` sets (sid, items) and of each with every one of its cols."""
        batches = max(1, math.ceil(number / BATCH))
        packed = sets.withColumn("batch", F.pmod(F.xxhash64("sid"), F.lit(batches)).cast("int")).groupBy("batch").applyInPandas(_pack_sets, _PACKED)
        dealt = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.number - 1))))
        blocks = self.table.select("block", "starts", "items")
        found = dealt.groupBy("block").cogroup(blocks.groupBy("block")).applyInPandas(_product, "sid long, own boolean, item long, n long")
        return found.groupBy("sid", "own", "item").agg(F.sum("n").alias("n"))

    def frequent_pairs(self, least: int) -> DataFrame:
        """a, b, n of the frequent pairs a < b.

        Few wide baskets add little to any pair, but most of the pairs. While there are fewer of them than `least`, a
        frequent pair has at least the difference in the other baskets; what reaches that is then counted in all.
        """
        shards, few = max(1, math.ceil(self.pairs / 200_000)), 0 < self.wide < least
        found = self.scratch.keep(_frequent_pairs(self.table, shards, least - self.wide if few else least, self.most, self.wide >= least))
        if not few:
            return found
        sets = self.scratch.keep(found.select(F.monotonically_increasing_id().alias("sid"), F.array("a", "b").alias("items"), F.lit(None).cast("array<long>").alias("cols")))
        exact = self.counts(sets, sets.count()).filter(F.col("n") >= least)
        return self.scratch.keep(sets.join(exact.select("sid", "n"), "sid").select(F.col("items")[0].alias("a"), F.col("items")[1].alias("b"), "n"))


def _closed(children: DataFrame) -> DataFrame:
    """items, core, support, more of the children that own their closure.

    children: base (the parent's items), item (the one added), support, seen: array of (item, n) for the frequent
    extensions of both together, null without any.
    """
    seen = F.coalesce("seen", F.array().cast("array<struct<item:long,n:long>>"))
    same = F.filter(seen, lambda x: x["n"] == F.col("support"))
    owned = children.filter(~F.exists(same, lambda x: x["item"] < F.col("item")))
    items = F.array_sort(F.concat("base", F.array("item"), F.transform(same, lambda x: x["item"])))
    return owned.select(items.alias("items"), F.col("item").alias("core"), "support", F.filter(seen, lambda x: x["n"] < F.col("support")).alias("more"))


def _gathered(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy(key).agg(F.collect_list(F.struct("item", "n")).alias("seen"))


def closed_itemsets(lines: DataFrame, basket: str = "sale_id", item: str = "item_id", least: int = 5, share: int = 20_000, block_entries: int = 50_000) -> tuple[DataFrame, DataFrame, int, _Blocks | None]:
    """The closed itemsets (items ascending, support), the items' supports, the number of baskets, and the blocks.

    Rows without a basket or an item are left out; repeated rows count once; further columns don't matter. basket and
    item are integers. An itemset counts with `least` baskets or more, and at least one in `share` of all. Without rows
    there are no itemsets.
    """
    spark = lines.sparkSession
    scratch = Scratch(spark)
    given = lines.select(F.col(basket).cast("long").alias("basket"), F.col(item).cast("long").alias("item")).filter("basket IS NOT NULL AND item IS NOT NULL")
    baskets = given.select("basket").distinct().count()
    least = max(least, -(-baskets // share))
    pairs = scratch.keep(given.distinct())
    supports = scratch.keep(pairs.groupBy("item").agg(F.count("*").alias("support")).filter(F.col("support") >= least))
    number, entries = supports.agg(F.count("*"), F.coalesce(F.sum("support"), F.lit(0))).first()
    blocks = _Blocks(scratch, sized_join(pairs, supports.select("item"), "item", "left_semi", number, MOST_ITEMS), entries, block_entries)
    scratch.drop(pairs)

    found = blocks.frequent_pairs(least)
    near = scratch.keep(found.select("a", F.col("b").alias("item"), "n").union(found.select(F.col("b").alias("a"), F.col("a").alias("item"), "n")))
    seen = _gathered(near, "a").withColumnRenamed("a", "item")
    level = scratch.keep(_closed(supports.join(seen, "item", "left").select(F.array().cast("array<long>").alias("base"), "item", "support", "seen")))
    levels = [level]
    while True:
        frontier = scratch.keep(level.filter(F.exists("more", lambda x: x["item"] > F.col("core"))).withColumn("pid", F.monotonically_increasing_id()))
        more = frontier.select("pid", F.explode("more").alias("x")).select("pid", "x.item", "x.n")
        children = frontier.select("pid", "items", F.explode(F.filter("more", lambda x: x["item"] > F.col("core"))).alias("x")).select(F.monotonically_increasing_id().alias("sid"), "pid", F.col("items").alias("base"), "x.item", F.col("x.n").alias("support"))
        children = scratch.keep(children)
        if not (n_children := children.count()):
            break
        # A frequent extension of a child is one of its parent, and makes a frequent pair with the item added.
        met = children.select("sid", "pid", F.col("item").alias("a")).join(near.select("a", "item"), "a").join(more.select("pid", "item"), ["pid", "item"], "left_semi")
        cols = met.groupBy("sid").agg(F.collect_list("item").alias("cols"))
        asked = scratch.keep(children.join(cols, "sid").select("sid", F.concat("base", F.array("item")).alias("items"), "cols"))
        counted = blocks.counts(asked, n_children).filter(~F.col("own") & (F.col("n") >= least))
        level = scratch.keep(_closed(children.join(_gathered(counted, "sid"), "sid", "left")))
        levels.append(level)
    closed = levels[0].select("items", "support")
    for x in levels[1:]:
        closed = closed.union(x.select("items", "support"))
    return scratch.keep(closed), supports, baskets, blocks


def itemsets_with_rules(lines: DataFrame, basket: str = "sale_id", item: str = "item_id", least: int = 5, share: int = 20_000, confidence: int = 60, block_entries: int = 50_000) -> DataFrame:
    """Closed itemsets with their rules: items (array, ascending), support, rules: array of (item, a, s) by item.

    Taking an item of support s from an itemset leaves a rest of support a; that is a rule if the itemset's support is
    at least `confidence` percent of a, and support * baskets > a * s. Rests that aren't closed are counted in the
    blocks. What closed_itemsets says of nulls, repeated rows and empty tables holds here.
    """
    closed, supports, baskets, blocks = closed_itemsets(lines, basket, item, least, share, block_entries)
    scratch = blocks.scratch
    named = scratch.keep(closed.withColumn("cid", F.monotonically_increasing_id()))
    taken = named.filter(F.size("items") > 1).select("cid", "items", "support", F.explode("items").alias("item"))
    taken = scratch.keep(taken.select("cid", "support", "item", F.array_remove("items", F.col("item")).alias("rest")))
    known = named.select(F.col("items").alias("rest"), F.col("support").alias("a"))
    single = supports.select(F.array("item").alias("rest"), F.col("support").alias("a"))
    large = taken.filter(F.size("rest") > 1)
    open_rests = scratch.keep(large.select("rest").distinct().join(known, "rest", "left_anti").select(F.monotonically_increasing_id().alias("sid"), F.col("rest").alias("items"), F.lit(None).cast("array<long>").alias("cols")))
    counted = open_rests.join(blocks.counts(open_rests, open_rests.count()), "sid").select(F.col("items").alias("rest"), F.col("n").alias("a"))
    rests = scratch.keep(known.filter(F.size("rest") > 1).union(single).union(counted))
    rated = taken.join(rests, "rest").join(supports.select("item", F.col("support").alias("s")), "item")
    held = rated.filter((100 * F.col("support") >= confidence * F.col("a")) & (F.col("support") * F.lit(baskets) > F.col("a") * F.col("s")))
    rules = held.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("item", "a", "s"))).alias("rules"))
    return named.join(rules, "cid", "left").select("items", "support", F.coalesce("rules", F.array().cast("array<struct<item:long,a:long,s:long>>")).alias("rules"))


def digest(found: DataFrame) -> DataFrame:
    """items, n_items, support, n_rules, best_item and rules_sha256 of itemsets with rules."""
    written = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["item"].cast("string"), r["a"].cast("string"), r["s"].cast("string"))), ";")
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"].alias("a"), r["item"].alias("item"))))["item"]
    return found.select(
        F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), F.size("items").cast("long").alias("n_items"), "support",
        F.size("rules").cast("long").alias("n_rules"), best.alias("best_item"), F.sha2(written.cast("binary"), 256).alias("rules_sha256"),
    )
