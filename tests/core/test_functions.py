import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import dates, text, urls
from factloom.operators import evidence, matching, rules, splits


def one(spark, values, column, schema="v string"):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.x for r in rows.select("i", column.alias("x")).orderBy("i").collect()]


def test_canonical_key_and_split(spark):
    links = ["https://youtu.be/abc?t=1", "https://www.youtube.com/shorts/abc", "https://m.youtube.com/watch?v=abc&t=2", "https://twitter.com/u/status/1?s=20", "https://example.com/a/?b=2&a=1", None, "https://www.example.com/"]
    keys = one(spark, [(x, "c1") for x in links], urls.canonical_key(F.col("u"), F.col("c")), "u string, c string")
    assert keys == ["youtube:abc"] * 3 + ["x.com/u/status/1?s=20", "example.com/a?a=1&b=2", "claim:c1", "claim:c1"]
    assert one(spark, keys, splits.bucket(F.col("v"))) == [26, 26, 26, 57, 41, 74, 74]
    assert one(spark, ["claim:c1", "youtube:abc"], splits.split(splits.bucket(F.col("v")))) == ["validation", "train"]


def test_evidence_identity(spark):
    assert one(spark, ["http://Example.com/a/?utm_x=1&b=2&a=1#f", "input:supplied_metadata"], urls.evidence_source(F.col("v"))) == ["https://example.com/a?a=1&b=2", "input:supplied_metadata"]
    assert one(spark, ["Hello  world page"], evidence.identity(F.lit("https://example.com/a?a=1"), F.col("v"))) == ["ev-9286729281f1b4bc"]


def test_evidence_dedup_keeps_place_and_takes_verified_values(spark):
    rows = [("s", "t", 1, False, "a"), ("s", "t", 2, True, "b"), ("s", "t", 3, True, "c"), ("q", "t", 5, True, "d"), ("q", "t", 6, False, "e"), ("z", "t", 7, False, None)]
    df = spark.createDataFrame(rows, "source string, text string, seq int, verified boolean, type string")
    got = sorted(tuple(r) for r in evidence.dedup(df, ["source", "text"], "seq", "verified", ["type"]).collect())
    assert got == [("q", "t", 5, True, "d"), ("s", "t", 1, True, "b"), ("z", "t", 7, False, None)]


def test_citations(spark):
    held = spark.createDataFrame([("ev-1", "The  March was filmed in Paris.", True), ("ev-2", "The March was filmed", False)], "evidence_id string, text string, verified boolean")
    cited = spark.createDataFrame([("ev-1", "march was filmed"), ("ev-1", "Paris."), ("ev-1", "filmed in Berlin"), ("ev-1", "march was filmed"), ("ev-2", "march was filmed"), ("ev-9", "march was filmed"), (None, None)], "evidence_id string, quote string")
    assert [tuple(r) for r in evidence.valid_citations(cited, held, True).collect()] == [("ev-1", "march was filmed")]
    assert len(evidence.valid_citations(cited, held, False).collect()) == 2


def test_screens(spark):
    public = ["ftp://a.b", "http://localhost", "http://10.0.0.1", "http://u:p@a.com", "https://a.com", None]
    assert one(spark, public, urls.is_public(F.col("v"))) == [False] * 4 + [True, False]
    marked = ["https://www.snopes.com/x", "https://web.archive.org/web/2020/https://snopes.com/x", "https://x.com/snopes/status/1", "https://example.com/fact-check/a", "https://example.com/a", None]
    assert one(spark, marked, urls.is_factcheck(F.col("v"))) == [True] * 4 + [False, False]
    said = ["Our rating: mostly false", "Snopes says it was debunked", "a fact check", "source: Snopes", "a plain text", None]
    assert one(spark, said, text.is_factcheck(F.col("v"))) == [True] * 4 + [False, False]


DAY = datetime.date
CASES = {
    "January 5, 2024": ("day", DAY(2024, 1, 5), DAY(2024, 1, 5), "2024-01-05"), "5th May 2021": ("day", DAY(2021, 5, 5), DAY(2021, 5, 5), "2021-05-05"),
    "2024-05-01T10:00:00Z": ("day", DAY(2024, 5, 1), DAY(2024, 5, 1), "2024-05-01"), "2024-01": ("month", DAY(2024, 1, 1), DAY(2024, 1, 31), "2024-01"),
    "2023": ("year", DAY(2023, 1, 1), DAY(2023, 12, 31), "2023"), "June 3-5, 2024": ("range", DAY(2024, 6, 3), DAY(2024, 6, 5), "2024-06-03 to 2024-06-05"),
    "March - May 2023": ("range", DAY(2023, 3, 1), DAY(2023, 5, 31), "2023-03 to 2023-05"), "2019–2021": ("range", DAY(2019, 1, 1), DAY(2021, 12, 31), "2019 to 2021"),
    "between May 1 and May 4 2022": ("range", DAY(2022, 5, 1), DAY(2022, 5, 4), "2022-05-01 to 2022-05-04"), "from 2024-05-01 to 2024-04-01": None, "Sept 2024": None, "": None, "2024-02-30": None,
}


def test_dates(spark):
    df = spark.createDataFrame([(k,) for k in [*CASES, None]], "raw string")
    got = {r.raw: (r.p.granularity, r.p.start, r.p.end, r.p.normalized) if r.p else None for r in dates.parse(df, "raw", "p").collect()}
    assert got == {**CASES, None: None}


def test_words_and_phrases(spark):
    w = text.words
    assert one(spark, [("a b c", "b c d"), ("a", "")], text.jaccard(w(F.col("a")), w(F.col("b"))), "a string, b string") == [0.5, 0.0]
    assert one(spark, [("a b", "a b c d"), ("", "a")], text.containment(w(F.col("a")), w(F.col("b"))), "a string, b string") == [1.0, 0.0]
    assert one(spark, ["abcdef", None, " abc "], text.trimmed(F.col("v"), 3)) == ["abc...", "", "abc"]
    assert one(spark, ["one two three", " ".join(map(str, range(20)))], text.quoted_phrase(F.col("v"))) == [None, '"' + " ".join(map(str, range(18))) + '"']


@pytest.mark.parametrize(("n", "k", "expected"), [(8, 4, [0, 2, 5, 7]), (6, 3, [0, 2, 5]), (2, 3, [0, 1])])
def test_even_positions(spark, n, k, expected):
    assert one(spark, [n], rules.even_positions(F.col("v"), k), "v int") == [expected]


def test_places_and_verdicts(spark):
    assert one(spark, ["New York City", "Central Park", "wearing Red", None], rules.place_is_plausible(F.col("v"))) == [True, False, False, False]
    rows = [("supported", "unknown", "supported", True), ("supported", "supported", "unknown", False), ("supported", "supported", "unknown", True), ("unknown", "refuted", "supported", True)]
    assert one(spark, rows, rules.verdict(F.col("a"), F.array("b"), F.col("c"), F.col("d")), "a string, b string, c string, d boolean") == ["NEI", "TRUE", "NEI", "FALSE"]


def test_hamming_blocks_lose_nothing(spark):
    import random

    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    items = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(base + [x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 16))) for x in base])]
    df = spark.createDataFrame(items, "id long, h long")
    expected = sorted((a, b, bin((x ^ y) & (1 << 64) - 1).count("1")) for a, x in items for b, y in items if a < b and bin((x ^ y) & (1 << 64) - 1).count("1") <= 12)
    assert sorted(tuple(r) for r in matching.hamming_pairs(df, 12).collect()) == expected


def test_only_texts_with_marks_of_a_range_are_searched_for_sides(spark):
    texts = ["2020-01-02", "2020-1", "2020-2021", "May 2020 - June 2020", "5 MAY 2020 UNTIL 6 may 2020", "between May 1 and May 3, 2020", "May 1–3, 2020", "5 May 2020", "2020-01-02 - 2020-01-05"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    sides = [r.s for r in df.orderBy("i").select(dates._sides(dates.cleaned(F.col("t"))).alias("s")).collect()]
    assert [len(s) for s in sides] == [1, 1, 3, 3, 3, 3, 3, 1, 3] and all(s[1] and s[2] for s in sides if len(s) == 3)
