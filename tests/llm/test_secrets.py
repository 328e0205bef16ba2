import re

import pytest

from factloom.llm import secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.ASCII)


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


HEX = "1eb9c654e721b4f812088970e66a6345cee33dd6"
TEXTS = [
    None, "", " ", f'token = "{HEX}" the', "token=token:abcdef", "PassWord: 'hunter2hunter' x secret=abc secret=abcdef", "AKIA" + "A1B2" * 4, "AKIA" + "A" * 15,
    "xAKIAAKIA" + "Z9" * 9 + "!", "😀é " + HEX + "😀 api_key = zz.zz==", HEX[:23] + "g" + HEX[:24], "\n\nAPIKEY:\n abc password=AKIA" + "Q7" * 10, "a" * 30, ("secret : qwertz " + HEX + " ") * 300,
    "token: pass secret=0123456789abcdef01234567", "api_key'='x", "token==abcdef\x85token= abcdefg",
]


@pytest.fixture(scope="module")
def model(spark):
    words = "The quick brown fox jumps over lazy dogs while reading several ordinary documents about configuration identifiers and naming " * 3
    docs = spark.createDataFrame([(i, words) for i in range(40)], "doc_id long, text string")
    return secrets.train(secrets.labelled_samples(docs))


def test_base_spans_equal_brute_force(spark, model):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, base string, spans string")
    for r in secrets.scan(df, model).select("doc_id", secrets.listed("base").alias("b")).collect():
        assert r.b == ",".join(brute(TEXTS[r.doc_id])), r.doc_id


def test_models_separate_random_from_ordinary(spark, model):
    import base64
    import hashlib
    import random

    rnd = random.Random(3)
    odd = [base64.b64encode(hashlib.sha256(f"t{i}".encode()).digest()).decode()[: rnd.randrange(20, 40)].rstrip("=") for i in range(300)]
    words = "several ordinary documents reading quick configuration identifiers naming about lazy brown while jumps".split()
    plain = [rnd.choice("_-").join(rnd.choices(words, k=3)) for _ in range(300)]
    df = spark.createDataFrame([(i, f"see {w} .") for i, w in enumerate(odd + plain)], "doc_id long, text string")
    hit = {r.doc_id for r in secrets.scan(df, model).collect() if r.markov}
    assert sum(i in hit for i in range(300)) >= 285 and sum(i in hit for i in range(300, 600)) <= 6
    one = secrets.scan(df.filter("doc_id = 0"), model).first().markov
    assert not one or (one[0].start, one[0].end) == (4, 4 + len(odd[0]))


def test_empty_inputs(spark, model):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.scan(df, model).collect() == []
    none = secrets.train(spark.createDataFrame([], "token string, is_random boolean"))
    assert len(none) == secrets.N**2 and not any(none)
    assert secrets.train(secrets.labelled_samples(df))
