import hashlib
import random
import re

import pytest

from factloom.llm import substring


def brute(rows, window):
    cut = [(i if i is not None else substring.LAST, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in cut:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, w), (doc_id, _) in zip(cut, rows, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["ñandú", "日本", "\x85x", "a b"]
    passages = [rnd.choices(words, k=rnd.randrange(12, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        body = []
        for _ in range(rnd.randrange(0, 4)):
            body += rnd.choices(words, k=rnd.randrange(0, 30)) + (rnd.choice(passages)[rnd.randrange(0, 3) :] if rnd.random() < 0.6 else [])
        rows.append((i * 7 % 61, rnd.choice([" ", "\n", " \t "]).join(body)))
    rows += [(100, None), (101, ""), (102, " \n "), (None, rows[5][1]), (None, rows[5][1]), rows[6], (3000, "same " * 100), (3001, "same " * 30), (-5, "same " * 13), (3002, " ".join(passages[0]) + " x" * 13)]
    return rows


@pytest.mark.parametrize(("seed", "window"), [(1, 13), (2, 13), (3, 4)])
def test_equals_brute_force(spark, seed, window):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, shard string, ids int")
    got = substring.substring_dedup(df, window=window, shard_bytes=2000, bucket_bytes=3000).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, window)


def test_word_hashes_ignore_pieces():
    texts = [("word%d \t" % i * 9).encode() for i in range(50)] + [b"", b"   ", b"x" * 5000, b"lead " * 300]
    a, n = substring.word_hashes(texts)
    b, m = substring.word_hashes(texts, piece=64)
    assert (a == b).all() and (n == m).all() and n.tolist() == [len(t.split()) for t in texts]


def test_kept_text_and_empty_table(spark):
    text = " ".join(f"t{i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (2, "lead " + text + " tail")], "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in substring.substring_dedup(df, with_text=True).collect()} == {1: text, 2: "lead tail"}
    assert substring.substring_dedup(df.limit(0)).collect() == []
