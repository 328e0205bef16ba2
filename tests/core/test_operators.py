import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import dates, text
from factloom.operators import evidence, matching, provenance, searches
from factloom.sources import providers, results

from .test_functions import one


def parsed(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")
    return [r.p.normalized if r.p else None for r in dates.parse(df, "raw", "p").orderBy("i").collect()]


def test_ranges_with_a_bare_day(spark):
    assert parsed(spark, ["from 5 to 10 May 2022", "5 - 10 May 2022", "3 to 5 June 2024", "May 5 to 10 2022", "March-5, 2024", "2023-May 2024", "June 31, 2024", "Feb 29 2024"]) == ["2022-05-05 to 2022-05-10", "2022-05-05 to 2022-05-10", "2024-06-03 to 2024-06-05", None, None, None, None, "2024-02-29"]


def test_identity_folds_space_and_case(spark):
    values = [("http://a", "Straße  x"), ("http://a", "STRASSE X"), ("http://a", "strasse x"), ("a\tb", "x\x07y")]
    got = one(spark, values, evidence.identity(F.col("s"), F.col("t")), "s string, t string")
    assert got[0] == got[1] == got[2]
    import hashlib

    assert got[3] == "ev-" + hashlib.sha256(json.dumps(["a\tb", "x\x07y"], ensure_ascii=False).encode()).hexdigest()[:16]


def test_phrases_of_four_words_and_cut_words(spark):
    phrases = spark.createDataFrame([(1, "alpha beta gamma delta eps"), (2, "a b c d"), (3, "b c d"), (4, "one two three four five six seven")], "item_id long, phrase string")
    texts = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon"), (2, "xa b c dy"), (3, "b c"), (4, "zone two three four five six sevens"), (5, "")], "doc_id long, body string")
    assert sorted(map(tuple, matching.phrase_hits(phrases, texts).collect())) == [(1, 1), (2, 2), (3, 2), (4, 4)]


def test_repeated_runs_of_a_text_are_not_dealt_out_before_they_meet_a_phrase(spark):
    phrases = spark.createDataFrame([(1, "x a b c d y"), (2, "p a b c d q")], "item_id long, phrase string")
    texts = spark.createDataFrame([(1, "x a b c d y a b c d y a b c d"), (2, "no a b c d")], "doc_id long, body string")
    found = matching.phrase_hits(phrases, texts)
    assert [tuple(r) for r in found.collect()] == [(1, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "[doc_id" not in "".join(x for x in plan.splitlines() if "Aggregate [" in x and "run" in x)


def test_nearest_vectors_in_few_blocks_as_tables_grow(spark):
    assert [matching._blocks(n, 2048) for n in (0, 1, 2048, 4096, 30_000, 500_000, 1_000_000)] == [1, 1, 1, 2, 15, 16, 31]
    import numpy as np

    v = np.random.default_rng(1).normal(size=(90, 5)).round(1)
    v /= np.linalg.norm(v, axis=1)[:, None]
    s = np.round(v @ v.T, 9)
    expected = {(i, j, r + 1) for i in range(90) for r, j in enumerate(sorted((j for j in range(90) if j != i), key=lambda j: (-s[i, j], j))[:3])}
    means = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "g long, mean array<double>")
    assert {(r.g, r.other, r.rank) for r in matching.nearest(means, "g", 3, block=4).collect()} == expected


@pytest.mark.parametrize("kind", ["jaccard", "containment"])
def test_similar_sets_equal_all_pairs(spark, kind):
    import random

    rnd = random.Random(3)
    sets = [(i, sorted({f"w{int(rnd.paretovariate(0.7)) % 40}" for _ in range(rnd.randrange(0, 14))})) for i in range(60)]
    for least in (0.5, 0.65, 1.0):
        expected = []
        for i, a in sets:
            for j, b in sets:
                if i < j and a and b:
                    both = len(set(a) & set(b))
                    s = both / (len(a) + len(b) - both) if kind == "jaccard" else both / min(len(a), len(b))
                    if s >= least:
                        expected.append((i, j, round(s, 9)))
        got = matching.similar_sets(spark.createDataFrame(sets, "i long, w array<string>"), "i", "w", least, kind).collect()
        assert sorted((r.a, r.b, round(r.similarity, 9)) for r in got) == sorted(expected)


@pytest.mark.parametrize("kind", ["jaccard", "containment"])
def test_similar_sets_meet_across_blocks_without_shuffled_pairs(spark, kind):
    import random

    rnd = random.Random(5)
    base = [{f"w{int(rnd.paretovariate(0.5)) % 300}" for _ in range(rnd.randrange(1, 60))} for _ in range(12)]
    sets = [(i, sorted({w for w in rnd.choice(base) if rnd.random() < 0.8} | {f"x{rnd.randrange(40)}"})) for i in range(150)]
    share = lambda a, b: len(a & b) / (len(a | b) if kind == "jaccard" else min(len(a), len(b)))
    expected = [(i, j, round(share(set(a), set(b)), 9)) for i, a in sets for j, b in sets if i < j and share(set(a), set(b)) >= 0.6]
    df = matching.similar_sets(spark.createDataFrame(sets, "i long, w array<string>"), "i", "w", 0.6, kind, block=100)
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in df.collect()) == sorted(expected) and len(expected) > 500
    # Only the sets' blocks meet in the plan: there is no join of pairs.
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan


def test_vectors_without_length_take_no_part(spark):
    rows = [("a", 1, [1.0, 0.0], 3), ("a", 2, [0.0, 1.0], 5), ("b", 1, [1.0, 0.0], 3), ("c", 1, [0.0, 0.0], 3), ("d", 1, [float("nan"), 1.0], 3)]
    df = spark.createDataFrame(rows, "g string, f int, v array<float>, h long")
    got = matching.frame_matches(df, "g", "f", "v", "h").collect()
    assert sorted((r.g, r.other, r.similarity, r.frame_coverage, r.perceptual_distance, r.matched) for r in got) == [("a", "b", 1.0, 0.5, 0, 1), ("b", "a", 1.0, 0.5, 0, 1)]


def test_merged_matches_prefer_what_no_search_has_made(spark):
    rows = [(1, "https://a.example/x/", "reverse_image", 1, "2020-01-02"), (1, "https://www.a.example/x", "visual", 2, "2020-01-03"), (1, "https://b.example/", "visual", 3, None)]
    df = spark.createDataFrame(rows, "claim long, url string, source string, seq long, date string")
    got = provenance.merged(df, "claim", "url", "source", "seq", ["date"]).orderBy("rank").collect()
    assert [(r.rank, r.url, r.source, r.date) for r in got] == [(1, "https://www.a.example/x", "visual", "2020-01-03"), (2, "https://b.example/", "visual", None)]


def test_first_of_keeps_order(spark):
    df = spark.createDataFrame([(1, 3, "a"), (1, 1, "A"), (1, 2, "b"), (2, 1, "c")], "k long, n long, v string")
    got = searches.first_of(df, ["k"], F.lower("v"), ["n"], ["v"], 1)
    assert sorted((r.k, r.rank, r.v) for r in got.collect()) == [(1, 1, "A"), (2, 1, "c")]


def test_providers_answer_alike(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, None)], "i long, q string")

    def call(asked):
        if "bad" in asked:
            raise RuntimeError("at https://x/?key=secret failed")
        return [x.upper() for x in asked]

    got = providers.lookup(rows, "q", providers.Service(call, batch=1)).orderBy("i").collect()
    assert [(r.answer, r.error) for r in got] == [("A", None), ("A", None), (None, "at https://x/?key=[redacted] failed"), (None, None)]
    known = spark.createDataFrame([("a", "A")], "request string, answer string")
    got = providers.lookup(rows, "q", providers.Recorded(known)).orderBy("i").collect()
    assert [(r.answer, r.error) for r in got] == [("A", None), ("A", None), (None, "not recorded"), (None, None)]


def test_result_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "claim_id long, v string")
    results.insert(rows, f"file://{tmp_path}/t", "claim_id")
    results.insert(rows.union(spark.createDataFrame([(3, "new")], rows.schema)).withColumn("v", F.lit("again")), f"file://{tmp_path}/t", "claim_id")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/t").collect()), key=repr) == [(1, "x"), (2, None), (3, "again")]
    results.insert(rows, f"file://{tmp_path}/t", "claim_id", reset=True)
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 2
    results.export(rows, f"file://{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/out").collect()) == ['{"claim_id":1,"v":"x"}', '{"claim_id":2,"v":null}']
    (tmp_path / "ids.txt").write_text("﻿b\n\n a \nc\n")
    assert [r.claim_id for r in results.test_ids(spark, f"file://{tmp_path}/ids.txt", 2).orderBy("seq").collect()] == ["b", "a"]
    done = spark.createDataFrame([("a", "ok", "TRUE", 1.5), ("b", "error", None, 0.25)], "claim_id string, status string, verdict string, seconds double")
    assert tuple(results.batch_report(done).first()) == (2, 1, 1, 1, 0, 0, 1.75)
    asked = spark.createDataFrame([(1, " c ", "", None, None, None)], "claim_id long, claim string, post_url string, transcript string, metadata map<string,string>, keyframes array<string>")
    assert tuple(results.payload(asked).first()) == (1, "c", None, None, {}, [])


def test_excerpts(spark):
    told = "First one. In the middle stands Lima today! Last."
    at = told.index("Lima")
    assert one(spark, [told], text.excerpt(F.col("v"), F.lit(at), F.lit(at + 4))) == ["In the middle stands Lima today!"]


def test_nearest_in_blocks_of_any_size_equals_all_pairs(spark):
    import random

    import numpy as np

    rnd = random.Random(4)
    rows = [(f"g{k % 25}", [rnd.choice([-1.0, 0.5, 1.0]) for _ in range(4)]) for k in range(60)] + [("zero", [0.0] * 4), ("apart", [1.0, 0.0, 0.0, 0.0]), ("apart", [-1.0, 0.0, 0.0, 0.0]), ("nan", [float("nan")] * 4), ("g1", [0.0] * 4)]
    df = spark.createDataFrame(rows, "g string, v array<float>")
    means = {}
    for g in {r[0] for r in rows}:
        own = [np.array(v) / np.linalg.norm(v) for h, v in rows if h == g and np.isfinite(v).all() and np.linalg.norm(v) > 0]
        if own and np.linalg.norm(m := np.mean(own, 0)) > 1.2e-7:
            means[g] = m / np.linalg.norm(m)
    want = {}
    for g, m in means.items():
        best = sorted((-round(float(m @ o), 9), h) for h, o in means.items() if h != g)[:6]
        want |= {(g, k): (h, -s) for k, (s, h) in enumerate(best, 1)}
    assert "zero" not in means and "apart" not in means and "g1" in means
    for block in (1, 7, 1000):
        got = {(r.g, r.rank): (r.other, r.s) for r in matching.nearest(matching.mean_units(df, "g", "v"), "g", 6, block=block).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-9 for k in want)


def test_queries_on_dates_compile(spark):
    import __spark_entry__

    queries = __spark_entry__.queries()
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("date_parse", "date_compare", "date_fields", "date_rules", "calendar_dates", "date_grounded"):
            queries[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
