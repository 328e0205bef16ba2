"""Exact substring dedup by fixed-block anchors.

A window is `window` consecutive words of one document. Every window contains a whole block of b = (window + 1) // 2
words that starts at a multiple of b words. So the blocks of all documents are the index, and every rolling run of b
words is a probe; only around runs that occur in two documents, and once as a block, can a window be shared. Hits are
extended to all windows that contain them, these are matched by a 96-bit fingerprint, and the windows that an earlier
document has too run together into the maximal repeats, whose words are removed.

Documents are dealt into shards of bounded size by a hash. A shard sends each distinct run or window once to the
bucket of its fingerprint, packed into arrays, and gets back those that matter; so a passage that a third of all
documents share costs one entry for each shard. Three passes read the texts: anchors, windows, result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

U = np.uint64
LAST = (1 << 63) - 1
KEY = 30


@lru_cache(maxsize=1)
def _tables():
    rnd = np.random.default_rng(20240101)
    white = np.zeros(256, bool)
    white[[32, *range(9, 14)]] = True
    return white, rnd.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15 | 1
    up, down = np.full(n + 1, base, U), np.full(n + 1, pow(base, -1, 1 << 64), U)
    up[0] = down[0] = U(1)
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def _hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    white, values = _tables()
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~white[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(16, (len(data)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U)), start


def _hash_long(raw: bytes, start: int, end: int, piece: int) -> np.ndarray:
    """The hash of the one word in raw[start:end], taken piece by piece."""
    _, values = _tables()
    up, _ = _powers(1 << max(16, piece.bit_length()))
    base, total = int(up[1]), 0
    for at in range(start, end, piece):
        data = np.frombuffer(raw, np.uint8, min(piece, end - at), at)
        total += int((values[data] * up[: len(data)]).sum(dtype=U)) * pow(base, at - start, 1 << 64)
    return mix(np.array([(total + end - start) % (1 << 64)], U))


def word_hashes(texts: list[bytes], piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and the number of words of each text.

    Texts are hashed together in pieces, long ones cut at white space and a word longer than a piece within itself, so
    that memory stays bounded.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    batch, size, ids = [], 0, []
    signs = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")

    def flush():
        nonlocal batch, size, ids
        if batch:
            h, start = _hash_piece(b"\n".join(batch))
            bounds = np.cumsum([0] + [len(b) + 1 for b in batch])
            np.add.at(counts, ids, np.diff(np.searchsorted(start, bounds)))
            hashes.append(h)
        batch, size, ids = [], 0, []

    for i, raw in enumerate(texts):
        at = 0
        while len(raw) - at > piece:
            cut = max(raw.rfind(c, at + 1, at + piece) for c in signs)
            flush()
            if cut < 0:
                start = at + (raw[at : at + 1] in signs)
                cut = min((c for c in (raw.find(w, start) for w in signs) if c >= 0), default=len(raw))
                hashes.append(_hash_long(raw, start, cut, piece))
                counts[i] += 1
            else:
                batch, size, ids = [raw[at:cut]], cut - at, [i]
                flush()
            at = cut
        if size + len(raw) - at > piece:
            flush()
        batch.append(raw[at:])
        ids.append(i)
        size += len(raw) - at + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, U)), counts


def runs(words: np.ndarray, n: int, factor: int) -> np.ndarray:
    """Hash of each run of n words, by its first word."""
    if len(words) < n:
        return np.zeros(0, U)
    total = np.zeros(len(words) - n + 1, U)
    for k in range(n):
        total = total * U(factor) + words[k : len(words) - n + 1 + k]
    return mix(total)


class Shard:
    """The words of one shard's documents: hashes, document of each word, and where runs of n words may start."""

    def __init__(self, texts: list[bytes]):
        self.words, self.counts = word_hashes(texts)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.first = np.cumsum(self.counts) - self.counts

    def whole(self, n: int) -> np.ndarray:
        """Whether the run of n words at each place lies within one document."""
        m = max(len(self.words) - n + 1, 0)
        return self.doc[:m] == self.doc[n - 1 :] if m else np.zeros(0, bool)

    def anchors(self, b: int, buckets: int) -> np.ndarray:
        """bucket and key of each run of b words, as one number."""
        h = runs(self.words, b, 0xD6E8FEB86659FD93)
        return (h >> U(32)) % U(buckets) << U(KEY) | h & U((1 << KEY) - 1)


def _segments(keys: np.ndarray) -> np.ndarray:
    """Starts of the segments of equal sorted keys."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _by_bucket(bucket: np.ndarray):
    """(bucket, slice) of each run of one bucket in a sorted array."""
    at = _segments(bucket)
    return [(int(bucket[a]), slice(a, z)) for a, z in zip(at, [*at[1:], len(bucket)], strict=True)] if len(at) else []


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in keys that are among the sorted wanted keys, and where they are there."""
    if not len(wanted) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = np.zeros(1 << 22, bool)
    low = lambda k: ((k * U(0x9E3779B97F4A7C15)) >> U(42)).astype(np.int64)
    mark[low(wanted)] = True
    at = np.flatnonzero(mark[low(keys)])
    where = np.minimum(np.searchsorted(wanted, keys[at]), len(wanted) - 1)
    good = wanted[where] == keys[at]
    return at[good], where[good]


def _texts(pdf: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, window: int = 13, shard_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20, with_text: bool = False) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for.

    Words are runs of anything but ASCII white space. A word is removed if some window that covers it also starts in
    a document with a smaller doc_id. A null text has no words. A row without an id counts as larger than all
    others; rows that repeat an id don't affect each other. Other columns are ignored. An empty table gives an empty
    result. Ids are whole numbers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    block = (window + 1) // 2
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), F.col(doc_id).isNull().alias("no_id"), body.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, buckets = max(-(-total // shard_bytes), 2 * least), max(-(-total // bucket_bytes), least)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))

    def send_anchors(key, pdf):
        s = Shard(_texts(pdf))
        code = s.anchors(block, buckets)
        place = np.flatnonzero(s.whole(block))
        code, doc = code[place], s.doc[place]
        aligned = (place - s.first[doc]) % block == 0
        order = np.argsort(code)
        code, doc, aligned = code[order], doc[order], aligned[order]
        at = _segments(code)
        if not len(at):
            return pd.DataFrame({"bucket": [], "shard": [], "keys": []})
        many = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        flags = many.astype(np.uint32) * 2 + np.logical_or.reduceat(aligned, at)
        code = code[at]
        packed = ((code & U((1 << KEY) - 1)).astype(np.uint32) << np.uint32(2)) | flags
        parts = [(b, packed[p].tobytes()) for b, p in _by_bucket(code >> U(KEY))]
        return pd.DataFrame({"bucket": [b for b, _ in parts], "shard": key[0], "keys": [x for _, x in parts]})

    def match_anchors(key, pdf):
        packed = np.frombuffer(b"".join(pdf["keys"]), np.uint32)
        source = np.repeat(np.arange(len(pdf)), [len(x) // 4 for x in pdf["keys"]])
        order = np.argsort(packed)
        packed, source = packed[order], source[order]
        keys = packed >> np.uint32(2)
        at = _segments(keys)
        n = np.diff(np.append(at, len(keys)))
        hit = ((n > 1) | (np.maximum.reduceat(packed & 2, at) > 0)) & (np.maximum.reduceat(packed & 1, at) > 0)
        keep = np.repeat(hit, n)
        keys, source = keys[keep], source[keep]
        order = np.argsort(source, kind="stable")
        keys, parts = keys[order], _by_bucket(source[order])
        return pd.DataFrame({"shard": pdf["shard"].to_numpy()[[i for i, _ in parts]], "bucket": key[0], "keys": [keys[p].tobytes() for _, p in parts]})

    sent = rows.groupBy("shard").applyInPandas(send_anchors, "bucket long, shard long, keys binary")
    hits = scratch.keep(sent.groupBy("bucket").applyInPandas(match_anchors, "shard long, bucket long, keys binary"))
    scratch.tidy()

    def fingerprints(s: Shard, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = runs(s.words, window, 0xA0761D6478BD642F)[at]
        more = (runs(s.words, window, 0xE7037ED1A0B428DB)[at] >> U(32)).astype(np.uint32)
        return h, more

    def send_windows(key, pdf, hits):
        none = pd.DataFrame({"bucket": [], "shard": [], "prints": [], "more": [], "ids": []})
        if not len(hits):
            return none
        s = Shard(_texts(pdf))
        wanted = np.sort(np.concatenate([np.frombuffer(k, np.uint32).astype(U) | U(b) << U(KEY) for b, k in zip(hits["bucket"], hits["keys"], strict=True)]))
        found, _ = _find(s.anchors(block, buckets), wanted)
        near = np.zeros(len(s.words) + 1, np.int64)
        np.add.at(near, np.maximum(found - (window - block), 0), 1)
        np.add.at(near, found + 1, -1)
        inside = s.whole(window)
        at = np.flatnonzero((np.cumsum(near)[: len(inside)] > 0) & inside)
        if not len(at):
            return none
        h, more = fingerprints(s, at)
        ids = pdf["doc_id"].to_numpy(np.int64)[s.doc[at]]
        order = np.lexsort((ids, more, h))
        h, more, ids = h[order], more[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (more[1:] != more[:-1]))))
        low, high = ids[first], ids[np.append(first[1:], len(ids)) - 1]
        h, more = h[first], more[first]
        # The lowest bit tells the bucket whether the shard has the window in two documents.
        more = (more & np.uint32(0xFFFFFFFE)) | (low != high)
        bucket = (h % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, more, low = h[order], more[order], low[order]
        parts = _by_bucket(bucket[order])
        return pd.DataFrame({"bucket": [b for b, _ in parts], "shard": key[0], "prints": [h[p].tobytes() for _, p in parts], "more": [more[p].tobytes() for _, p in parts], "ids": [low[p].tobytes() for _, p in parts]})

    def match_windows(key, pdf):
        h, more, low = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("prints", U), ("more", np.uint32), ("ids", np.int64)))
        source = np.repeat(np.arange(len(pdf)), [len(x) // 8 for x in pdf["prints"]])
        order = np.lexsort((more >> np.uint32(1), h))
        h, more, low, source = h[order], more[order], low[order], source[order]
        at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (more[1:] >> np.uint32(1) != more[:-1] >> np.uint32(1)))))
        n = np.diff(np.append(at, len(h)))
        least = np.repeat(np.minimum.reduceat(low, at), n)
        keep = (least < low) | (more & 1 > 0)
        h, more, least, source = h[keep], more[keep], least[keep], source[keep]
        order = np.argsort(source, kind="stable")
        h, more, least, parts = h[order], more[order], least[order], _by_bucket(source[order])
        return pd.DataFrame({"shard": pdf["shard"].to_numpy()[[i for i, _ in parts]], "prints": [h[p].tobytes() for _, p in parts], "more": [more[p].tobytes() for _, p in parts], "ids": [least[p].tobytes() for _, p in parts]})

    sent = rows.groupBy("shard").cogroup(hits.groupBy("shard")).applyInPandas(send_windows, "bucket long, shard long, prints binary, more binary, ids binary")
    repeats = scratch.keep(sent.groupBy("bucket").applyInPandas(match_windows, "shard long, prints binary, more binary, ids binary"))
    scratch.tidy()

    def result(key, pdf, repeats):
        texts = _texts(pdf)
        s = Shard(texts)
        cover = np.zeros(len(s.words) + 1, np.int64)
        if len(repeats):
            h, more, least = (np.frombuffer(b"".join(repeats[c]), t) for c, t in (("prints", U), ("more", np.uint32), ("ids", np.int64)))
            order = np.lexsort((more, h))
            h, more, least = h[order], more[order], least[order]
            # Fingerprints whose first 64 bits clash are told apart by the rest; `same` walks through them.
            inside = np.flatnonzero(s.whole(window))
            full, extra = fingerprints(s, inside)
            distinct = _segments(h)
            at, where = _find(full, h[distinct])
            size = np.diff(np.append(distinct, len(h)))
            ids = pdf["doc_id"].to_numpy(np.int64)
            for same in range(int(size.max())):
                ok = size[where] > same
                a, j = at[ok], distinct[where[ok]] + same
                equal = (extra[a] >> np.uint32(1)) == (more[j] >> np.uint32(1))
                gone = inside[a[equal & (least[j] < ids[s.doc[inside[a]]])]]
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + window, -1)
        out = np.cumsum(cover)[:-1] > 0
        rows = []
        for i, raw in enumerate(texts):
            words, lost = raw.split(), out[s.first[i] : s.first[i] + s.counts[i]]
            kept = b" ".join(words if not lost.any() else [w for w, x in zip(words, lost.tolist(), strict=True) if not x])
            rows.append((len(words), int(lost.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
        done = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])
        done.insert(0, "doc_id", pdf["doc_id"].to_numpy())
        done.insert(1, "no_id", pdf["no_id"].to_numpy())
        return done

    final = rows.groupBy("shard").cogroup(repeats.groupBy("shard")).applyInPandas(result, "doc_id long, no_id boolean, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return final.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))
