"""Benchmark decontamination by spaced seeds.

A mask such as 1110110011 picks some of ten consecutive words and ignores the others, so a seed survives words that were
exchanged at the ignored places. Every item's seeds, at all its places and for all masks, are joined with the seeds of
every place of every training text. Around a hit the two texts are laid side by side along the hit's diagonal, and
the hit counts if within some window nearly all words agree. All of it is Spark SQL expressions within one scan.

find_overlaps() takes the masks it is given, which may miss overlaps with several exchanged words. find_all_overlaps()
takes masks of which, wherever words are exchanged, one is unharmed at some place of the window, so it misses none.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Scratch, sized_join

MASKS = ("1110110011", "1101011101", "1011101101")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def split_words(text: Column) -> Column:
    """The words, in lower case and without ASCII punctuation; null counts as empty."""
    bare = F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), PUNCTUATION, "")
    return F.array_remove(F.split(bare, f"[{WHITE}]+"), "")


def words(text: Column) -> Column:
    """Hashes of the words."""
    return F.transform(split_words(text), lambda w: F.xxhash64(w))


def _seeds(h: Column, masks: list[str]) -> list[Column]:
    """For each mask the seeds of all places in order. The mask's number is part of the seed."""

    def one(m: int, mask: str) -> Column:
        n = F.size(h) - (len(mask) - 1)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.lit(m), *(F.get(h, i + k) for k, c in enumerate(mask) if c == "1")))

    return [one(m, mask) for m, mask in enumerate(masks)]


def find_overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", *, masks: tuple[str, ...] = MASKS, window: int = 13, substitutions: int = 3, least_words: int = 5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, n_hits, best_window, n_words: one row for each document and item that overlap.

    They overlap if along some seed's diagonal a window of `window` words agrees but for at most `substitutions` words.
    An item shorter than the window is its own window, with proportionally fewer substitutions; one shorter than a
    mask has a seed of all its words; items of fewer than `least_words` words are not looked for. n_hits counts seed
    hits on such diagonals, best_window the agreeing words of the best window, n_words those of the best diagonal.
    Null texts have no words. Rows that repeat an id, null included, are taken together. Other columns are ignored;
    empty tables give an empty result.
    """
    tests = items.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("ih")).filter(F.size("ih") >= least_words)
    spans = {len(m) for m in masks}
    # Lengths of items too short for the masks: fewer than there are words in a mask.
    short = sorted(r[0] for r in tests.filter(F.size("ih") < max(spans)).select(F.size("ih")).distinct().collect())
    every = [*masks, *("1" * n for n in short)]

    def tagged(m: int, seeds: Column) -> Column:
        wanted = F.lit(True) if m < len(masks) else F.size("ih") == len(every[m])
        found = F.transform(seeds, lambda s, i: F.struct(s.alias("seed"), F.lit(m).alias("m"), i.alias("at")))
        return F.when(wanted, found).otherwise(F.array().cast("array<struct<seed:bigint,m:int,at:int>>"))

    index = tests.select("item_id", "ih", F.explode(F.concat(*(tagged(m, s) for m, s in enumerate(_seeds(F.col("ih"), every))))).alias("s")).select("item_id", "ih", "s.*")
    rows = index.count()
    hashed = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("h"))
    places = hashed.select("doc_id", "h", F.posexplode(F.concat(*_seeds(F.col("h"), every))).alias("pos", "seed"))
    met = sized_join(places, index, "seed", "inner", rows, broadcast_rows)
    room = [F.greatest(F.size("h") - (len(mask) - 1), F.lit(0)) for mask in every]
    start, offsets = F.lit(0), []
    for r in room:
        offsets.append(start)
        start = start + r
    diagonal = met.withColumn("shift", F.col("pos") - F.get(F.array(*offsets), F.col("m")) - F.col("at"))
    n = F.size("ih")
    agree = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(F.get(F.col("h"), F.col("shift") + j) == F.get(F.col("ih"), j), 1).otherwise(0))
    agree = diagonal.select("doc_id", "item_id", agree.alias("agree"))
    width = F.least(F.lit(window), F.size("agree"))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("agree") - width), lambda j: total(F.slice("agree", j + 1, width))))
    judged = agree.select("doc_id", "item_id", best.alias("best"), width.alias("width"), total(F.col("agree")).alias("n"))
    good = judged.filter(F.col("best") >= F.col("width") - F.floor(F.col("width") * substitutions / window))
    return good.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_hits"), F.max("best").alias("best_window"), F.max("n").alias("n_words"))


@lru_cache(maxsize=64)
def lossless_masks(width: int, substitutions: int, most: int = 4) -> tuple[str, ...]:
    """Masks of which, at some place within `width` words, one meets none of any `substitutions` exchanged words.

    Of the heaviest masks that do so with `most` masks or less, each in turn is the one that helps most of the
    placements left. Without exchanged words that is the mask of all words, and with many the mask of one word.
    """
    harms = list(combinations(range(width), substitutions))
    all_, at = (1 << len(harms)) - 1, [0] * width
    for i, harm in enumerate(harms):
        for p in harm:
            at[p] |= 1 << i
    for weight in range(width - substitutions, 0, -1):
        helps = {}
        for span in range(weight, width + 1):
            for inner in combinations(range(1, span - 1), max(0, weight - 2)) if weight > 1 else [()] * (span == 1):
                picked = sorted({0, *inner, span - 1})
                free = 0
                for shift in range(width - span + 1):
                    hit = 0
                    for p in picked:
                        hit |= at[p + shift]
                    free |= all_ & ~hit
                helps["".join("1" if k in picked else "0" for k in range(span))] = free
        left, chosen = all_, []
        while left and len(chosen) < most:
            best = max(helps, key=lambda m: ((helps[m] & left).bit_count(), -len(m), m))
            if not helps[best] & left:
                break
            chosen.append(best)
            left &= ~helps[best]
        if not left:
            return tuple(chosen)
    raise ValueError("a window needs more words than substitutions")


def find_all_overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", *, window: int = 13, substitutions: int = 3, broadcast_rows: int = 1_000_000, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, item_id, n_hits, best_window, n_words: one row for each document and item that overlap.

    They overlap if for some shift a window of `window` words of the item agrees with the text but for at most
    `substitutions` words; what lies outside the text does not agree. An item shorter than the window is its own
    window, with proportionally fewer substitutions, none below five words. An item without words overlaps with
    nothing. n_hits counts the seeds that agree on such shifts, best_window the agreeing words of the best window,
    n_words those of the best shift. No overlap is missed: of the masks of a window's width one meets none of the
    exchanged words. Null texts have no words. Rows that repeat an id, null included, are taken together. Other columns
    are ignored; empty tables give an empty result. What the result reads is in `scratch`, for a caller that drops it
    once the result is written.
    """
    if not 0 <= substitutions < window:
        raise ValueError("a window needs more words than substitutions")
    scratch = scratch or Scratch(docs.sparkSession)
    tests = items.select(F.col(item_id).alias("item_id"), split_words(F.col(item_text)).alias("iw")).filter(F.size("iw") > 0)
    tests = scratch.keep(tests.withColumn("item", F.monotonically_increasing_id()).withColumn("width", F.least(F.size("iw"), F.lit(window))))
    widths: dict[str, list[int]] = {}
    for (width,) in tests.select("width").distinct().collect():
        for mask in lossless_masks(width, width * substitutions // window):
            widths.setdefault(mask, []).append(width)
    masks = sorted(widths, key=lambda m: (len(m), m))
    names = [F.xxhash64(F.lit(i), F.coalesce(F.col(text).cast("string"), F.lit(""))).alias(f"k{i}") for i in (1, 2)]
    named = docs.select(F.col(doc_id).alias("doc_id"), *names, F.col(text).alias("text"))

    def places(rows: DataFrame, column: str, *own: Column | str) -> DataFrame:
        # The places are exploded before they are hashed, which is compiled; the words are left behind at once.
        at = rows.select(*own, column, F.posexplode(column).alias("pos", "word"))
        seed = lambda mask: F.xxhash64(F.lit(mask), *(F.get(F.col(column), F.col("pos") + k) for k, c in enumerate(mask) if c == "1"))
        return at.select(*own, "pos", F.explode(F.array(*(F.when(F.col("pos") <= F.size(column) - len(m), seed(m)) for m in masks))).alias("seed")).filter("seed IS NOT NULL")

    none = F.lit(None).cast("long")
    if masks:
        wanted = F.filter(F.array(*(F.when(F.col("width").isin(w), F.lit(i)) for i, w in enumerate(widths[m] for m in masks))), lambda x: x.isNotNull())
        index = tests.select("item", F.size("iw").alias("len"), "iw", wanted.alias("wanted"), F.posexplode("iw").alias("at", "word"))
        seed = lambda mask: F.xxhash64(F.lit(mask), *(F.get(F.col("iw"), F.col("at") + k) for k, c in enumerate(mask) if c == "1"))
        seeds = F.array(*(F.when((F.col("at") <= F.size("iw") - len(m)) & F.array_contains("wanted", F.lit(i)), seed(m)) for i, m in enumerate(masks)))
        index = scratch.keep(index.select("item", "len", "at", F.explode(seeds).alias("seed")).filter("seed IS NOT NULL"))
        spots = places(named.select("doc_id", "k1", "k2", split_words(F.col("text")).alias("w")), "w", "doc_id", "k1", "k2")
        hits = sized_join(spots, index, "seed", "inner", index.count(), broadcast_rows).select("doc_id", "k1", "k2", "item", "len", (F.col("pos") - F.col("at")).alias("shift"))
    else:
        hits = named.select("doc_id", "k1", "k2", none.alias("item"), F.lit(0).alias("len"), F.lit(0).alias("shift")).limit(0)
    shifts = hits.groupBy("doc_id", "k1", "k2", "item", "len", "shift").agg(F.count(F.lit(1)).alias("n"))
    shifts = scratch.keep(shifts.groupBy("k1", "k2", F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("item", "len", "shift", "n")).alias("met")))
    again = sized_join(named, shifts, ["k1", "k2"], "inner", shifts.count(), broadcast_rows // 10).filter(F.col("doc_id").eqNullSafe(F.col("d")))
    again = again.dropDuplicates(["k1", "k2", "d"]).select("doc_id", split_words(F.col("text")).alias("w"), "met")
    # Each candidate takes along the words beside its item only, null where the text has none.
    beside = F.transform(F.sequence(F.lit(0), F.col("m.len") - 1), lambda j: F.when(F.col("m.shift") + j >= 0, F.get(F.col("w"), F.col("m.shift") + j)))
    laid = again.select("doc_id", "w", F.explode("met").alias("m")).select("doc_id", "m.item", "m.n", beside.alias("part"))
    laid = sized_join(laid, tests, "item", "inner", tests.count(), broadcast_rows // 10)
    agree = F.zip_with("part", "iw", lambda x, y: F.when(x == y, 1).otherwise(0))
    agree = laid.select("doc_id", "item_id", "n", "width", agree.alias("agree"))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    least = F.col("width") - F.floor(F.col("width") * substitutions / window)
    counted = agree.withColumn("all", total(F.col("agree"))).filter(F.col("all") >= least)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("agree") - F.col("width")), lambda j: total(F.slice("agree", j + 1, F.col("width")))))
    good = counted.withColumn("best", best).filter(F.col("best") >= least)
    return good.groupBy("doc_id", "item_id").agg(F.sum("n").alias("n_hits"), F.max("best").alias("best_window"), F.max("all").alias("n_words"))


def remove_overlapping(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", *, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The documents without those in `found`, a kept table; rows that repeat an id, null included, share its fate."""
    ids = found.select(F.col("doc_id").alias("__gone")).distinct()
    n = ids.count()
    return docs.join(F.broadcast(ids) if n <= broadcast_rows else ids, F.col(doc_id).eqNullSafe(F.col("__gone")), "left_anti")
