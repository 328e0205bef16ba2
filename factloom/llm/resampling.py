"""Target-distribution importance resampling: weights from hashed word runs, and an exact draw of the k best documents.

Two passes over the texts: the first counts the features of the corpus by bucket, the second sums the gains of the
buckets over each document. Both work on arrays of bytes: a table of bytes finds the words of a batch, and the checksum
of a run of words goes on from that of the run without its last word. The draw finds the exact k-th key by radix
selection: digit by digit, the keys that agree with the digits found so far are counted by their next digit. Only the
rows up to that key are sorted, by range, and ranked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, sized_join

#: Words of more bytes than this are summed one by one.
LONG = 48
#: About so many bytes of text are taken at once; a longer text is taken in pieces.
PIECE = 1 << 20
#: Bits of a digit of the radix selection: 2 ** DIGIT counters at most go to the driver each time.
DIGIT = 12
#: A part of the drawn rows has about so many when they are sorted.
PART = 100_000


def _crc_table() -> np.ndarray:
    """The checksum of each byte, by the reflected polynomial of crc32."""
    at = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        at = np.where(at & 1, at >> 1 ^ np.uint32(0xEDB88320), at >> 1)
    return at


_CRC = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


class Words:
    """The words of several texts, lower-cased, in order: `starts` and `lengths` in bytes, and the text `of` each."""

    def __init__(self, texts: list[bytes]):
        self.bytes = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        edges = np.flatnonzero(np.diff(_IS_WORD[self.bytes], prepend=False))
        self.starts = edges[::2]
        self.lengths = edges[1::2] - self.starts
        self.of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.starts, "right")
        self.order = np.argsort(-self.lengths, kind="stable")
        upto = np.cumsum(np.bincount(np.minimum(self.lengths, LONG + 1), minlength=LONG + 2))
        self.longer = len(self.starts) - upto[:LONG]  # words of more than 0, 1, 2, ... bytes

    def go_on(self, state: np.ndarray) -> np.ndarray:
        """The state of a checksum for each word, after the bytes of the word."""
        at, starts = state[self.order], self.starts[self.order]
        for j, n in enumerate(self.longer):
            if not n:
                break
            at[:n] = at[:n] >> np.uint32(8) ^ _CRC[(at[:n] ^ self.bytes[starts[:n] + j]) & np.uint32(255)]
        out = np.empty_like(state)
        out[self.order] = at
        for i in np.flatnonzero(self.lengths > LONG):
            out[i] = zlib.crc32(self.bytes[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes(), int(state[i] ^ _ONES)) ^ 0xFFFFFFFF
        return out

    def runs(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of 1 to `most` words of one text: the words that end one, and the checksums."""
        n = len(self.starts)
        state = self.go_on(np.full(n, _ONES))
        yield np.arange(n), state ^ _ONES
        for k in range(1, min(most, n)):
            spaced = state[:-1] >> np.uint32(8) ^ _CRC[(state[:-1] ^ np.uint32(32)) & np.uint32(255)]
            state = self.go_on(np.r_[_ONES, spaced])  # the first k states stand for no run
            ends = np.flatnonzero(self.of[k:] == self.of[:-k]) + k
            yield ends, state[ends] ^ _ONES


def _pieces(text: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """A text in pieces of about PIECE bytes, cut between words; each begins with the last most - 1 words before it, whose number is given."""
    at, head = 0, []
    while at < len(text) or not at:
        end = at + PIECE
        while end < len(text) and _IS_WORD[_LOWER[text[end]]]:
            end += 1
        part = text[at:end]
        yield b" ".join([*head, part]), len(head)
        if end < len(text) and most > 1:
            tail = Words([b" ".join([*head, part])])
            head = [tail.bytes[s : s + n].tobytes() for s, n in zip(tail.starts[1 - most :], tail.lengths[1 - most :], strict=True)]
        at = end


def features(texts, buckets: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The features of texts (bytes or None) in parts: place of the text, bucket, and whether it is a single word."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for part, before in _pieces(text or b"", most):
            held.append((i, part, before))
            size += len(part)
            if size >= PIECE:
                yield _part_features(held, buckets, most)
                held, size = [], 0
    if held:
        yield _part_features(held, buckets, most)


def _part_features(held: list[tuple[int, bytes, int]], buckets: int, most: int):
    words = Words([part for _, part, _ in held])
    place, before = (np.array([x[i] for x in held]) for i in (0, 2))
    new = np.arange(len(words.of)) - np.searchsorted(words.of, words.of) >= before[words.of]
    of, bucket, single = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for k, (ends, sums) in enumerate(words.runs(most)):
        ends, sums = ends[new[ends]], sums[new[ends]]
        of.append(place[words.of[ends]])
        bucket.append((sums % np.uint32(buckets)).astype(np.int64))
        single.append(np.full(len(ends), k == 0))
    return np.concatenate(of), np.concatenate(bucket), np.concatenate(single)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = 10_000, most: int = 3) -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task sends one row for a bucket, which Spark sums; the driver gets `buckets` numbers."""

    def count(batches):
        seen = np.zeros(buckets, np.int64)
        for pdf in batches:
            for _, bucket, _ in features(pdf["text"], buckets, most):
                seen += np.bincount(bucket, minlength=buckets)
        hit = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": hit, "n": seen[hit]})

    sums = docs.select(F.col(text).cast("binary").alias("text")).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed shares of the target and of the corpus, rounded down."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + n) / ((x + 1) * (t + n)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", most: int = 3) -> DataFrame:
    """The rows with n_features, n_words and weight, the sum of the gains of the features of the whole text.

    A null or empty text has no features and the weight 0. Columns of these names are replaced, others stay.
    """
    buckets = len(gain)

    @F.pandas_udf("n_features long, n_words long, weight long")
    def summed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = np.zeros((3, len(texts)), np.int64)
            for of, bucket, single in features(texts, buckets, most):
                if len(of):
                    low, n = of.min(), of.max() - of.min() + 1
                    out[0, low : low + n] += np.bincount(of - low, minlength=n)
                    out[1, low : low + n] += np.bincount(of[single] - low, minlength=n)
                    np.add.at(out[2], of, gain[bucket])
            yield pd.DataFrame(out.T, columns=["n_features", "n_words", "weight"])

    names = ["n_features", "n_words", "weight"]
    found = docs.withColumn("__found", summed(F.col(text).cast("binary")))
    return found.select(*[c for c in docs.columns if c not in names], *[F.col(f"__found.{c}").alias(c) for c in names])


def luck(doc_id: Column, seed: int = 42) -> Column:
    """A Gumbel variable times 1000, rounded down, from the hash of seed and id; a null id counts as empty."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")


_LEAST = -(1 << 63)


def kth_key(rows: DataFrame, key: list[str], k: int) -> tuple[int, ...]:
    """The k-th smallest key (1 is the smallest) of long columns without nulls, compared one after the other."""
    found: list[int] = []
    for i, c in enumerate(key):
        low, high = (x - _LEAST for x in rows.agg(F.min(c), F.max(c)).first())
        bits = (low ^ high).bit_length()
        value = high >> bits << bits
        while bits:
            width = min(DIGIT, bits)
            bits -= width
            digit = F.shiftrightunsigned(F.col(c).bitwiseXOR(F.lit(_LEAST)), bits).bitwiseAND(F.lit((1 << width) - 1))
            for d, n in sorted(map(tuple, rows.groupBy(digit.alias("digit")).count().collect())):
                if k <= n:
                    break
                k -= n
            value |= d << bits
            rows = rows.filter(digit == d)
            if n == 1:
                return (*found, *rows.select(*key[i:]).first())
        found.append(value + _LEAST)
        rows = rows.filter(F.col(c) == found[-1])
    return tuple(found)


def _upto(key: list[str], values: tuple[int, ...]) -> Column:
    """Whether a row's key is at most `values`."""
    out = F.lit(True)
    for c, v in reversed(list(zip(key, values, strict=True))):
        out = (F.col(c) < v) | ((F.col(c) == v) & out)
    return out


def draw(docs: DataFrame, number: int, may: Column, score: str = "score", doc_id: str = "doc_id") -> DataFrame:
    """The rows with rank: 1 to `number` for the rows that may be drawn and have the highest scores, else null.

    Ties go to the smaller doc_id, null last; rows that agree in both are drawn in any order, but each gets a rank of
    its own. Fewer rows that may be drawn than `number` get ranks all. A column named rank is replaced.
    """
    scratch = Scratch(docs.sparkSession)
    key = ["__down", "__no_id", "__id", "__row"]
    rows = scratch.keep(docs.drop("rank").select(
        "*", F.bitwise_not(F.col(score).cast("long")).alias("__down"), F.col(doc_id).isNull().cast("long").alias("__no_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("__id"),
        F.monotonically_increasing_id().alias("__row"), F.coalesce(may, F.lit(False)).alias("__may"),
    ))
    able = rows.filter("__may")
    number = min(number, able.count())
    none = F.lit(None).cast("long").alias("rank")
    if number < 1:
        return rows.select(*[c for c in rows.columns if not c.startswith("__")], none)
    chosen = F.col("__may") & _upto(key, kth_key(able.select(*key), key, number))
    parts = max(1, math.ceil(number / PART))
    ordered = scratch.keep(rows.filter(chosen).repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = sized_join(ordered.withColumn("__part", part), before, "__part", "inner", parts, 1_000_000)
    rank = F.col("__before") + F.col("__at") - F.shiftleft("__part", 33) + 1
    own = [c for c in rows.columns if not c.startswith("__")]
    return ranked.select(*own, rank.cast("long").alias("rank")).union(rows.filter(~chosen).select(*own, none))


def importance_resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = 10_000, most: int = 3, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """The documents with n_features, n_words, weight, score and rank, drawn so that they follow the target's texts.

    Of the documents with `least_words` words or more, `percent` percent (rounded down) with the highest scores get a
    rank. A null text counts as empty; very long texts are read whole, in pieces; null or repeated ids and repeated rows
    are each a row of their own (see draw for ties); columns with the names of results, and the reserved __down, __no_id,
    __id, __row and __may, are replaced; an empty table gives an empty one, an empty target weighs all buckets alike.
    """
    gain = gains(bucket_counts(docs, text, buckets, most), bucket_counts(target, target_text, buckets, most))
    reserved = ["score", "rank", "__down", "__no_id", "__id", "__row", "__may", "__at", "__part", "__before", "__found"]
    weighed = weigh(docs.drop(*[c for c in reserved if c not in (doc_id, text)]), gain, text, most)
    scored = Scratch(docs.sparkSession).keep(weighed.drop(text).withColumn("score", F.col("weight") + luck(F.col(doc_id), seed)))
    able = F.col("n_words") >= least_words
    return draw(scored, percent * scored.filter(able).count() // 100, able, "score", doc_id)
