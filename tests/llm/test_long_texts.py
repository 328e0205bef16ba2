"""Long texts, long words, many hits and popular payloads: pieces give what the whole gives."""

import random
import time

import numpy as np
import pytest

from factloom.llm import bpe, language, quality, secrets, substring, warc
from factloom.llm.common import Scratch
from factloom.llm.neardup import near_dedup


def test_words_longer_than_a_piece():
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("ab \n", k=rnd.randrange(0, 60))).encode() for _ in range(50)] + [b"x" * 500 + b" y", b" " + b"q" * 300, b"", b"z" * 1000, b" " * 400]
    whole, pieces = substring.word_hashes(texts), substring.word_hashes(texts, piece=64)
    assert (whole[0] == pieces[0]).all() and pieces[1].tolist() == [len(t.split()) for t in texts]


def test_a_long_word_costs_little_memory():
    import tracemalloc

    tracemalloc.start()
    substring.word_hashes([b"w" * (16 << 20)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_trigrams_do_not_depend_on_pieces():
    text = "".join(random.Random(2).choices("abcé雨İ .,", k=3000))
    whole = np.concatenate(list(language.trigrams(text)))
    assert all((whole == np.concatenate(list(language.trigrams(text, n)))).all() for n in (1, 7, 1000))
    assert list(language.trigrams("")) == [] and list(language.trigrams("...")) == [] and len(list(language.trigrams("\U00032000"))) == 1


def test_line_features_and_marginals_do_not_depend_on_blocks():
    rnd = random.Random(3)
    text = "\n".join("".join(rnd.choices("abc $1.", k=rnd.randrange(0, 30))) for _ in range(300))
    x, w = quality.line_features(text)
    parts = list(quality.blocks_of_features(text, 7))
    assert len(parts) > 40 and np.allclose(x, np.concatenate([p[0] for p in parts])) and np.allclose(w, np.concatenate([p[1] for p in parts]))
    score, moves = np.random.default_rng(1).normal(size=300), np.array([[0.3, -0.2], [0.1, 0.5]])
    assert np.allclose(quality.marginals(score, moves), quality.marginals(score, moves, 7))


def test_a_text_of_line_feeds_has_a_quality():
    model = quality.Crf(np.linspace(-0.1, 0.1, quality.WIDTH), np.zeros((2, 2)))
    assert 0 <= model.quality("\n" * 200_000) <= 1


def test_many_hits_in_one_text(spark):
    text = " ".join(f"token={i:07d}" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "token=1234567"), (4, None)], "doc_id long, text string")
    start = time.monotonic()
    rows = {r.doc_id: r.base for r in secrets.scan(df, [0.0] * secrets.N**2).select("doc_id", "base").collect()}
    assert time.monotonic() - start < 60
    assert [(s.start, s.end) for s in rows[1]] == [(14 * i, 14 * i + 13) for i in range(20_000)] and len(rows[3]) == 1 and rows[2] == rows[4] == []


def test_a_popular_payload_is_dealt_out(spark):
    pages = [(i, f"https://a.example/{i}", None if i % 3 == 0 else "x" * 1500 if i % 3 == 1 else f"own {i}") for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    scratch = Scratch(spark)
    folder = warc.write_archive(df, f"{scratch.root}/archive", scratch=scratch)
    found = [warc.whole_records(warc.parse_records(warc.read_archive(spark, folder, records_each=n, broadcast_rows=b))).drop("verified").collect() for n, b in ((1000, 100), (3, 100), (3, 0))]
    rows = [sorted(map(tuple, f), key=repr) for f in found]
    assert len(rows[0]) == 60 and rows[0] == rows[1] == rows[2]
    scratch.close()


def test_near_dedup_takes_long_texts(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:59_000])), (3, " ".join(reversed(base))), (4, "q" * 300_000), (5, "q" * 300_000 + "r")]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True)]


def test_the_folder_is_only_made_up_on_a_single_machine():
    from factloom.llm import common

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        common.shared_folder(Session())


def test_digests_of_ids(spark):
    import base64
    import hashlib

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "Hello  wörld 雨\n\n123"), (2, ""), (3, None), (4, "a" * 3000), (4, "a")]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.PATTERN).collect()
    digest = lambda x: hashlib.sha256(x).hexdigest()
    ids = lambda t: encoding.encode_ordinary(t or "")
    expected = [(i, len(ids(t)), digest(",".join(map(str, ids(t))).encode()), digest((t or "").encode())) for i, t in rows]
    assert sorted(map(tuple, got)) == sorted(expected)
