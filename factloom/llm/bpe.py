"""Byte-level BPE by a sentencepiece model that is written straight from a rank vocabulary.

Every token's bytes are mapped to printable characters, one for each byte; these strings are the pieces, scored
by their negative rank, under an identity normaliser. sentencepiece merges the best-scored adjacent pieces first,
the leftmost on ties, which is the rank order of byte-level BPE. Pre-tokens are encoded one by one; ids are
decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def read_ranks(data: bytes) -> list[bytes]:
    """Token bytes by rank from a rank file: base64 token, space, rank."""
    found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, data.splitlines())}
    return [found[i] for i in range(len(found))]


def _field(number: int, kind: int, value: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(value)) if kind == 2 else b"") + value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model as bytes: piece i is token i, the unknown piece stands last."""
    import struct

    chars = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, 2, _field(1, 2, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, _varint(kind)))

    pieces = b"".join(piece("".join(chars[b] for b in token), -float(rank), 1) for rank, token in enumerate(tokens))
    minus = _varint((1 << 64) - 1)
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(tokens) + 1)) + _field(40, 0, _varint(len(tokens))) + b"".join(_field(n, 0, minus) for n in (41, 42, 43))
    normaliser = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return pieces + piece("<unk>", 0.0, 2) + _field(2, 2, trainer) + _field(3, 2, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary.

    memo_limit bounds the remembered pre-tokens and thereby the memory; at the bound they are forgotten.
    """

    def __init__(self, ranks: bytes, pattern: str, memo_limit: int = 300_000):
        import regex
        import sentencepiece

        self.tokens = read_ranks(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.pattern, self.limit, self.memo = regex.compile(pattern), memo_limit, {}
        self.names = [str(i) for i in range(len(self.tokens))]
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.chars = {b: c for c, b in self.byte_of.items()}
        # A whole pre-token that is in the vocabulary is one token, whatever the merges would give.
        self.whole = {token: i for i, token in enumerate(self.tokens)}

    def _learn(self, words: set[str]) -> None:
        new = {w for w in words if w not in self.memo}
        if len(self.memo) + len(new) > self.limit:
            self.memo.clear()
            new = words
        rest = []
        for w in new:
            raw = w.encode()
            if (i := self.whole.get(raw)) is not None:
                self.memo[w] = (i,)
            else:
                rest.append((w, raw.decode("latin-1").translate(self.chars)))
        for (w, _), ids in zip(rest, self.model.encode([x for _, x in rest], num_threads=1) if rest else [], strict=True):
            self.memo[w] = tuple(ids)

    def _pretokens(self, text: str, step: int = 1 << 16):
        """A long text's pre-tokens in several lists, so that memory stays bounded."""
        part = []
        for m in self.pattern.finditer(text):
            part.append(m.group())
            if len(part) == step:
                yield part
                part = []
        yield part

    def _ids(self, words: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, words)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts, chars: int = 1 << 19):
        """The ids of each text in turn. New pre-tokens of about `chars` characters of text are learned in one call."""
        texts, at = [x or "" for x in texts], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= chars):
                size += len(texts[end])
                end += 1
            if end - at == 1 and size > 1 << 20:
                out: list[int] = []
                for words in self._pretokens(texts[at]):
                    self._learn(set(words))
                    out += self._ids(words)
                yield out
            else:
                cut = [self.pattern.findall(x) for x in texts[at:end]]
                self._learn(set().union(*cut))
                yield from map(self._ids, cut)
            at = end

    def forget(self) -> None:
        """Frees the remembered pre-tokens: a worker lives on for tasks of other steps."""
        self.memo = {}
        release()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(name: str, pattern: str) -> Codec:
    with open(SparkFiles.get(name), "rb") as f:
        return Codec(f.read(), pattern)


def ship(spark, vocabulary: str) -> str:
    """Sends the vocabulary file to the executors once; its size is fixed by the vocabulary."""
    spark.sparkContext.addFile(vocabulary)
    return vocabulary.rpartition("/")[2]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the token ids of the whole text as an array; a null text counts as empty and gives an empty array."""
    name = ship(docs.sparkSession, vocabulary)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        codec = _codec(name, pattern)
        return pd.Series(list(codec.encode_all(texts)))

    return docs.withColumn(out, ids(F.col(text)))


def decode(tokens: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; null ids count as none."""
    name = ship(tokens.sparkSession, vocabulary)

    @F.pandas_udf("binary")
    def back(column: pd.Series) -> pd.Series:
        codec = _codec(name, pattern)
        return pd.Series([codec.decode(x if x is not None else []) for x in column])

    return tokens.withColumn(out, back(F.col(ids)))


def digests(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text", *, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, by encoding the whole text and decoding the ids; ids too if asked for.

    Both directions run in one pass, so that the ids needn't travel. A null text counts as empty; null or repeated
    ids, repeated rows and further columns change nothing, each input row gives one row.
    """
    name = ship(docs.sparkSession, vocabulary)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(name, pattern)
        for texts in batches:
            rows = []
            for ids in codec.encode_all(texts):
                rows.append((len(ids), hashlib.sha256(",".join(map(codec.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest(), np.array(ids, np.int32) if with_ids else None))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])
        codec.forget()

    return docs.select(F.col(doc_id).alias("doc_id"), both(F.col(text)).alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256", *(["d.ids"] if with_ids else []))
