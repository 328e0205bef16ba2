import random

import numpy as np

from factloom.llm import language

WORDS = {"en": "the of and that with from this house water reading".split(), "de": "der die und nicht ein schön straße wasser lesen haus".split(), "es": "el los que para niño agua leer casa una más".split()}


def texts(n, seed):
    rnd = random.Random(seed)
    return [(lang, " ".join(rnd.choices(words, k=rnd.randrange(3, 60)))) for lang, words in WORDS.items() for _ in range(n)]


def model(spark):
    rows = texts(40, 1) + [(None, "the the"), ("en", None)]
    return language.train(spark.createDataFrame([(t, lang, "x") for lang, t in rows], "text string, lang string, bucket string"))


def test_held_out_accuracy_and_mixtures(spark):
    m = model(spark)
    assert m.languages == ["de", "en", "es"]
    held = texts(40, 2)
    right = sum(max(p, key=p.get) == lang for lang, t in held for p in [m.proportions(t)])
    assert right >= 0.97 * len(held)
    rnd = random.Random(5)
    mixed = " ".join(rnd.choices(WORDS["en"], k=300)) + " " + " ".join(rnd.choices(WORDS["de"], k=150))
    share = m.proportions(mixed)
    assert set(share) == {"en", "de"} and 0.5 < share["en"] < 0.8 and abs(sum(share.values()) - 1) < 1e-6


def test_counted_form_equals_the_plain_one(spark):
    m = model(spark)
    text = " ".join(random.Random(8).choices(WORDS["en"] + WORDS["es"], k=40_000))
    got = m.proportions(text)
    old, language.BITS = language.BITS, 15
    assert set(got) == {"en", "es"} and language.BITS == old
    assert sum(len(p) for p in language.trigrams(text)) == sum(len(p) for p in language.trigrams(text, chunk=1 << 24))
    a = np.sort(np.concatenate(list(language.trigrams(text[:5000], chunk=5000))))
    assert len(a) > 0


def test_defined_results(spark):
    m = model(spark)
    rows = [(1, "the water house", "a"), (2, None, "b"), (2, None, "b"), (3, "", None), (4, "123 ... \n", "c"), (None, "der die und", "d"), (6, "X", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in language.language_id(df, m).collect()), key=repr)
    assert len(got) == len(rows) and all(0 <= s <= 1 for *_, s in got)
    by = dict((i, lang) for i, lang, _ in got)
    assert by[1] == "en" and by[2] == by[3] == by[4] == "und" and by[None] == "de" and by[6] in m.languages
    assert language.language_id(df.limit(0), m).collect() == []
    none = language.train(spark.createDataFrame([], "text string, lang string"))
    assert none.languages == [] and none.proportions("the") == {}
