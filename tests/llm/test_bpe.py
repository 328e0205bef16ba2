import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from factloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.Codec(f.read(), public_tokenizers.PATTERN)


TEXTS = [
    "", " ", "  a  b\n\n c ", "Hello world, it's 2024!!", "naïve café — ñandú Straße", "日本語 текст", "😀😀 👩‍👩‍👧", "<|endoftext|>", "▁under▁score ▁",
    "x" * 3000, "\x00\x01\t\r\n", "aaaaaaaaaaaaaaaaaaaaaaaa b" * 50, "don't DON'T we'll", "   wide", "﻿bom", "е́ combining",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_public_encoder(codec, reference, text):
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_every_token_and_random_bytes(codec, reference):
    import random

    rnd = random.Random(7)
    for token in rnd.sample(codec.tokens, 3000):
        text = token.decode("utf-8", "ignore")
        assert codec.encode(text) == reference.encode_ordinary(text)
    for _ in range(300):
        text = "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x250), rnd.randrange(0x370, 0x2000), rnd.randrange(0x1F300, 0x1F700)])) for _ in range(rnd.randrange(1, 80)))
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_forgetting_and_long_texts_change_nothing(reference):
    with open(PATH, "rb") as f:
        small = bpe.Codec(f.read(), public_tokenizers.PATTERN, memo_limit=3)
    text = "the cat sat on the mat, le chat était là " * 5
    assert small.encode(text) == reference.encode_ordinary(text)
    long = "word and another 12345 \n" * 60_000
    assert small.encode(long) == reference.encode_ordinary(long)


def test_columns(spark):
    rows = [(1, "ab cd", "x"), (2, None, "y"), (2, None, "y"), (None, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {(i, d) for i, _, d in got} == {(1, sha("ab cd")), (2, sha("")), (None, sha("é"))} and (2, 0, sha("")) in got
    both = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN, out="tokens"), PATH, public_tokenizers.PATTERN, ids="tokens")
    assert [bytes(r.decoded).decode() for r in both.orderBy(F.col("doc_id").asc_nulls_last()).collect()] == ["ab cd", "", "", "é"]
    assert bpe.digests(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
