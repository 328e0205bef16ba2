"""Budgets of pages, bounds of what is shown and resumed runs against plain Python."""

import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators import prompts, retrieval
from factloom.streaming.batch import Batch, outcomes


def test_budgets_equal_the_fold_in_order(spark):
    rnd = random.Random(1)
    purposes = [*retrieval.BUDGETS, "other", None]
    urls = [f"https://a.example/{k}" for k in range(14)] + ["http://10.0.0.1/x", "https://www.snopes.com/fact-check/x", "ftp://a.example/1", None, "", "https://A.example/3#part"]
    rows = [(c, s, rnd.choice(purposes), rnd.choice(urls)) for c in range(60) for s in rnd.sample(range(1000), rnd.randrange(1, 40))]
    rows += [(99, s, rnd.choice(purposes[:4]), f"https://b.example/{rnd.randrange(300)}") for s in range(3000)]
    want = {}
    for c in {r[0] for r in rows}:
        taken, spent = {}, dict.fromkeys(retrieval.BUDGETS, 0)
        for _, s, purpose, url in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]):
            key = (url or "").replace("A.example", "a.example").partition("#")[0]
            if not key.startswith("https://") or "snopes" in key:
                want[c, s] = "screened"
            elif key in taken:
                want[c, s] = "repeated"
            elif spent.get(purpose, 0) < retrieval.BUDGETS.get(purpose, 0):
                taken[key] = s
                spent[purpose] += 1
                want[c, s] = "fetched"
            else:
                want[c, s] = "over budget"
    got = retrieval.decisions(spark.createDataFrame(rows, "claim_id long, seq long, purpose string, url string"))
    assert {(r.claim_id, r.seq): r.decision for r in got.collect()} == want
    assert {*want.values()} == {"screened", "repeated", "fetched", "over budget"} and sum(v == "fetched" for (c, _), v in want.items() if c == 99) == 18


def test_page_evidence_and_archives(spark):
    decided = spark.createDataFrame([(1, 1, "fetched", "k1", "T", "d"), (1, 2, "repeated", "k1", None, "  again "), (1, 3, "fetched", "k2", "T", "d"), (1, 4, "over budget", "k3", "T", "d"), (1, 5, "fetched", "k4", None, "")], "claim_id int, seq int, decision string, key string, title string, description string")
    pages = spark.createDataFrame([("k1", "s1", "body", "Ann", None, "2020-01-01"), ("k2", "s2", "", "A", "B", "C"), ("k4", "s4", None, None, None, None)], "key string, source string, body string, author string, site_name string, published_at string")
    assert [tuple(r) for r in retrieval.page_evidence(decided, pages).collect()] == [(1, 1, "retrieved_page", "s1", "body\nPage author: Ann\nPublication date (not capture date): 2020-01-01", True)]
    assert sorted(tuple(r)[1:5] for r in retrieval.candidate_evidence(decided, pages).collect()) == [(1, "search_candidate", "s1", "T d"), (2, "search_candidate", "s1", "again"), (3, "search_candidate", "s2", "T d")]
    posts = spark.createDataFrame([(1, "p"), (2, None)], "claim_id int, url string")
    found = spark.createDataFrame([(1, k, f"s{k % 7}") for k in range(30)] + [(2, 1, "x")], "claim_id int, seq int, source string")
    got = sorted(tuple(r) for r in retrieval.archive_requests(posts, found).collect())
    assert got == [(1, 1, "p"), (1, 2, "s0"), (1, 3, "s1"), (1, 4, "s2"), (1, 5, "s3"), (2, 1, "x")]


def test_packing_equals_the_fold_for_any_number_of_items(spark):
    rnd = random.Random(2)
    rows = [(c, k, rnd.choice([None, 0, 1, 5, 40, 90, 200]), f"t{k}") for c in [*range(30), None, (1 << 60) + 1] for k in rnd.sample(range(500), rnd.randrange(1, 30))]
    rows += [(77, k, 3, "x") for k in range(20_000)]
    want = set()
    for c in {r[0] for r in rows}:
        used = place = 0
        for _, k, n, t in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]):
            if used + (n or 0) <= 100:
                used += n or 0
                want.add((c, k, n, t, place))
                place += 1
    df = spark.createDataFrame(rows, "claim_id long, seq int, size int, told string").repartition(7)
    got = prompts.packed(df, "claim_id", ["seq"], "size", 100)
    assert got.columns == ["claim_id", "seq", "size", "told", "place"] and {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert prompts.packed(df.limit(0), "claim_id", ["seq"], "size", 100).collect() == []


def test_bounds_reach_every_depth_but_elements_of_lists(spark):
    kind = T.StructType().add("a", "string").add("n", T.IntegerType()).add("l", T.ArrayType(T.StringType())).add("m", T.MapType(T.StringType(), T.StructType().add("x", "string")))
    long, many = "y" * 30, [str(k) * 30 for k in range(15)]
    df = spark.createDataFrame([((long, 5, many, {"k": (long,), "none": None}),), ((None, None, None, None),), (None,)], T.StructType().add("v", kind))
    first, empty, none = prompts.bounded_rows(df, "v", length=10).collect()
    assert first.v.asDict(True) == {"a": "y" * 10 + "...", "n": 5, "l": many[:10], "m": {"k": {"x": "y" * 10 + "..."}, "none": None}}
    assert empty.v.asDict() == dict.fromkeys("anlm") and none.v is None
    order = spark.createDataFrame([("page", True), ("page", None), ("keyframe_analysis", False), ("keyframe_analysis", True)], "k string, v boolean")
    assert [r[0] for r in order.select(prompts.weight(F.col("k"), F.col("v"))).collect()] == [2, 3, 1, 0]


def judged(records):
    odd = F.col("claim_id").rlike("3$")
    return records.filter(~F.col("claim_id").rlike("7$")).select("claim_id", F.when(~odd, "TRUE").alias("verdict"), F.lit(2).alias("seconds"), F.when(odd, "failed").alias("error"))


def test_a_failed_record_is_a_row_of_its_own(spark):
    got = {r.claim_id: tuple(r)[1:] for r in outcomes(spark.createDataFrame([("11",), ("13",), ("17",)], "claim_id string"), judged).collect()}
    assert got == {"11": ("ok", "TRUE", 2.0, []), "13": ("error", None, 2.0, ["failed"]), "17": ("error", None, 0.0, ["no result"])}


def test_a_run_that_stops_and_starts_again_gives_the_same_table(spark, tmp_path):
    source, schema = tmp_path / "in", "claim_id string, text string"
    source.mkdir()

    def put(name, ids):
        (source / name).write_text("".join(json.dumps({"claim_id": str(i), "text": "x"}) + "\n" for i in ids))

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))

    state = {"broken": True}

    def verify(records):
        if state["broken"] and records.filter("claim_id = '25'").count():
            raise RuntimeError("the machine went away")
        return judged(records)

    run = Batch(str(tmp_path / "out"), verify)
    assert run.report(spark) is None
    put("a.json", [*range(20), 3, 3])
    run.run(stream(), str(tmp_path / "at"))
    put("b.json", range(10, 30))
    try:
        run.run(stream(), str(tmp_path / "at"))
        raise AssertionError("the run had to fail")
    except Exception as e:
        assert "the machine went away" in str(e)
    assert run.table(spark).count() == 20
    state["broken"] = False
    run.run(stream(), str(tmp_path / "at"))
    run.run(stream(), str(tmp_path / "at"))
    rows = {r.claim_id: r for r in run.table(spark).collect()}
    assert len(rows) == run.table(spark).count() == 30 and rows["25"].verdict == "TRUE" and rows["23"].status == "error"
    # A batch that is repeated overwrites its own part only.
    run.take(spark.createDataFrame([(str(i), "x") for i in range(10, 30)], schema), 1)
    assert run.table(spark).count() == 30
    report = run.report(spark).first()
    assert (report.total, report.completed, report.failed, report.n_true) == (30, 24, 6, 24)
