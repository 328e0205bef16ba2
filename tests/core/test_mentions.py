"""Texts of claims, chunks and mentions at their seams."""

from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import mentions
from factloom.plans import asking, registry

FOUND = "piece string, kind string, score double, word string, start int, end int"


def run(spark, body, findings):
    texts = spark.createDataFrame([(1, body)], "claim_id int, text string")
    chunks = mentions.chunked(texts)
    pieces = {r.at: r.piece for r in chunks.collect()}
    found = [(pieces[at], kind, score, word, start, end) for at, kind, score, word, start, end in findings]
    got = mentions.mentions(chunks, spark.createDataFrame(found, FOUND), "claim_id").collect()
    return sorted((r.name, r.score, r.start, r.end, r.event) for r in got)


def test_a_mention_in_the_overlap_of_two_chunks_is_one_and_spans_are_of_the_whole_text(spark):
    body = "é" * 760 + " The fire happened in Paris today. " + "x" * 900 + " Rome"
    at = body.index("Paris")
    assert 750 <= at and at + 5 <= 800
    rome = body.index("Rome")
    first = rome // 750 * 750
    got = run(spark, body, [(0, "B-LOC", 0.9, "Paris", at, at + 5), (750, "LOC", 0.95, "Paris", at - 750, at - 745), (first, "LOC", 0.99, "Rome", rome - first, rome - first + 4)])
    assert got == [("Paris", 0.95, at, at + 5, True), ("Rome", 0.99, rome, rome + 4, False)]
    assert body[at : at + 5] == "Paris"


def test_boundaries_are_repaired_and_what_cannot_be_is_left_out(spark):
    body = "In Parisian style. Later Paris, then Lima."
    inner, whole, lima = body.index("Paris"), body.index("Paris,"), body.index("Lima")
    assert run(spark, body, [(0, "LOC", 0.9, "Paris", inner, inner + 5)]) == [("Paris", 0.9, whole, whole + 5, False)]
    assert run(spark, body, [(0, "LOC", 0.9, "##Lima", None, None)]) == [("Lima", 0.9, lima, lima + 4, False)]
    assert run(spark, body, [(0, "LOC", 0.9, "Lima", 40, 900)]) == [("Lima", 0.9, lima, lima + 4, False)]
    assert run(spark, body, [(0, "LOC", 0.79, "Lima", lima, lima + 4), (0, "PER", 0.9, "Lima", lima, lima + 4), (0, "LOC", 0.9, "Quito", None, None), (0, "LOC", 0.9, "style", 12, 17), (0, "LOC", 0.9, ". ", 17, 19)]) == []


def test_texts_of_a_claim(spark):
    record = (1, " c ", None, "d", " ", "x" * 12500, "https://f.example/a/", "https://v.example", "f.json")
    records = spark.createDataFrame([record], "claim_id int, claim string, caption string, description string, transcript string, content string, url string, video_url string, source_file string")
    cited = spark.createDataFrame([(1, 2, "https://e.example/1", "later"), (1, 1, None, "first")], "claim_id int, n int, source string, observation string")
    pages = [(1, 0, "https://F.example/a", "own"), (1, 1, "https://p.example:8080/x/", "page"), (1, 2, "HTTPS://p.example:8080/x", "again"), (1, 3, "https://E.example/1//", "cited"), (1, 4, None, "none"), (1, 5, "no link", "y" * 2100)]
    seen = spark.createDataFrame([(1, "9.jpeg", "SIGN")], "claim_id int, frame string, text string")
    got = [tuple(r)[2:] for r in mentions.claim_texts(records, cited, spark.createDataFrame(pages, "claim_id int, n int, url string, text string"), seen).orderBy("seq").collect()]
    assert got == [
        ("claim", "claim", "f.json", "c"), ("platform", "current_video", "https://v.example", "d"), ("fact_check", "fact_check", "https://f.example/a/", "x" * 12000 + "..."), ("fact_check", "fact_check", "", "first"),
        ("fact_check", "fact_check", "https://e.example/1", "later"), ("retrieved_page", "retrieved:p.example", "https://p.example:8080/x/", "page"), ("retrieved_page", "retrieved:no link", "no link", "y" * 2000 + "..."), ("vision", "vision", "9.jpeg", "SIGN"),
    ]


def test_a_sentence_asserts_as_its_text_does(spark):
    rows = [("The rally took place. It was filmed in Lima.", "Lima"), ("Lima is far.", "Lima"), ("Nothing here", "Lima"), ("We report live from Old Goa now", "Old Goa")]
    got = spark.createDataFrame(rows, "t string, n string").select(text.is_asserted(F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in got] == [True, False, False, True]


def test_all_names_of_a_chunk_are_mentions(spark, tmp_path):
    """Also those that share the space between them, are repeated, stand behind letters beyond ASCII or are cut by a chunk's end."""
    import duckdb

    body = "Alexandria Bratislava, é雨 Alexandria. xDamascus Kathmandu_ Islamabad1 Reykjavík\nMontevideo" + " y" * 340 + " Wellington " + "z" * 30 + " Casablanca"
    rows = [(1, body), (2, "Samarkand"), (3, " lower only "), (4, None), (5, "  Samarkand Samarkand")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, asking.place_mentions(spark, str(tmp_path)).collect()))
    assert [(d, n, s) for d, n, s in got if d != 1] == [(2, "Samarkand", 0), (5, "Samarkand", 0), (5, "Samarkand", 10)]
    first = [(n, s) for d, n, s in got if d == 1]
    assert {n for n, _ in first} >= {"Alexandria", "Bratislava", "Montevideo", "Wellington", "Casablanca"} and len(first) >= 6
    assert all(body[s : s + len(n)] == n for n, s in first) and not {"Damascus", "Kathmandu", "Islamabad"} & {n for n, _ in first}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(db.execute(registry.ORACLES["place_mentions"]).fetchall()) == got
