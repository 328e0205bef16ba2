import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import resampling
from factloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_features(text, buckets=10_000, most=3):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, buckets=10_000, percent=5, least=20):
    s, t = (Counter(b for x in texts for b in plain_features(x, buckets)) for texts in ([x for _, x in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = plain_features(text, buckets)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


TEXTS = [None, "", " \n", "one", "One TWO", "naïve Ünder ÀB9_x", "a" * 100, "x" * 47 + " " + "y" * 48 + " " + "z" * 49, "日本語 текст 12,3", "\x00\x7f{a}[b]", "a b c d e f g h i j k l m n o p q r s t u v w", "é" * 30 + "-" + "B" * 200 + " c"]


@pytest.mark.parametrize("piece", [1 << 20, 7, 1])
def test_features_equal_plain_ones_in_pieces_of_any_size(monkeypatch, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("abAB9é -\n語") for _ in range(rnd.randrange(60))) for _ in range(60)]
    for most in (1, 2, 3, 5):
        got = [[] for _ in texts]
        singles = np.zeros(len(texts), int)
        for of, bucket, single in resampling.features([None if t is None else t.encode() for t in texts], 977, most):
            for i, b, one in zip(of, bucket, single, strict=True):
                got[i].append(int(b))
                singles[i] += one
        for i, t in enumerate(texts):
            assert sorted(got[i]) == sorted(plain_features(t, 977, most)) and singles[i] == len(words_of(t))


def test_a_long_text_and_a_long_word():
    for text in ("Wort und word " * 200_000, "b" * 3_000_000 + " c d"):
        got = np.concatenate([b for _, b, _ in resampling.features([text.encode()], 10_000, 3)])
        assert sorted(got.tolist()) == sorted(plain_features(text))


@pytest.mark.parametrize("digit", [1, 5, 12])
def test_kth_key_of_ties_extremes_and_every_k(spark, monkeypatch, digit):
    monkeypatch.setattr(resampling, "DIGIT", digit)
    rnd = random.Random(2)
    rows = [(rnd.choice([-(1 << 63), (1 << 63) - 1, -1, 0, 5, 5, 6]), rnd.randrange(3), k) for k in range(40)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for k in (1, 2, 17, 39, 40):
        assert resampling.kth_key(df, ["a", "b", "c"], k) == sorted(rows)[k - 1]


def test_draw_ranks_over_several_parts_with_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PART", 6)
    rows = [(k % 7 if k % 10 else None, k % 4, f"x{k % 3}", 9) for k in range(60)] + [(1, 3, "same", 9)] * 20
    df = spark.createDataFrame(rows, "doc_id long, score long, text string, rank int")
    for number in (0, 1, 13, 31, 500):
        got = resampling.draw(df, number, F.col("text") != "x2")
        assert got.columns == ["doc_id", "score", "text", "rank"]
        got = [tuple(r) for r in got.collect()]
        able = sorted(((r[1], r[0]) for r in rows if r[2] != "x2"), key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        drawn = sorted((r for r in got if r[3] is not None), key=lambda r: r[3])
        assert [r[3] for r in drawn] == list(range(1, min(number, len(able)) + 1)) and [(r[1], r[0]) for r in drawn] == able[:number]
        assert Counter(r[:3] for r in got) == Counter(r[:3] for r in rows)


def test_whole_operator_with_nulls_repeats_and_clashing_names(spark):
    rnd = random.Random(4)
    some = ["alpha", "Beta", "gamma", "delta", "epsilon", "日本"]
    docs = [(k if k % 9 else None, " ".join(rnd.choice(some) for _ in range(rnd.randrange(60)))) for k in range(120)] + [(500 + i, t) for i, t in enumerate(TEXTS)] + [(7, "alpha beta " * 12)] * 5
    target = ["alpha beta alpha beta", None, "gamma"]
    df = spark.createDataFrame([(*d, 1.5, "r", 3) for d in docs], "doc_id long, text string, score double, rank string, __row int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.importance_resample(df, goal, percent=30).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = plain(docs, target, percent=30)
    strip = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    # Rows without an id and those of one id may change places only among equal scores.
    assert strip(got) == strip(want)
    empty = resampling.importance_resample(df.limit(0), goal)
    assert empty.collect() == [] and {"doc_id", "n_features", "weight", "score", "rank"} <= set(empty.columns)
    assert resampling.importance_resample(df, goal.limit(0)).count() == len(docs)


def test_query_over_the_whole_tables(spark):
    got = QUERIES["op13_importance_resampling"](spark, SF)
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, target)
