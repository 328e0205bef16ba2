import datetime
import json

from pyspark.sql import functions as F

from factloom.sources import records
from factloom.streaming import earliest


def test_scan_selects_and_finds_repeats(spark, tmp_path):
    for split, name in (("train_val", "1"), ("test", "2"), ("test", "1")):
        (tmp_path / split).mkdir(exist_ok=True)
        (tmp_path / split / f"{name}.json").write_text(json.dumps({"claim": "c" + name, "video_information": {"platform": "x"}, "evidences": {"num_of_evidence": 0}}, indent=1))
    rows = records.scan(spark, f"file://{tmp_path}")
    assert sorted((r.claim_id, r.legacy_split, r.claim, r.video_information.platform) for r in rows.collect()) == [("1", "test", "c1", "x"), ("1", "train_val", "c1", "x"), ("2", "test", "c2", "x")]
    assert [tuple(r) for r in records.repeated_ids(rows).collect()] == [("1", 2)]
    ids = spark.createDataFrame([("2",), ("2",), ("9",), (None,)], "claim_id string")
    assert [r.claim for r in records.selected(rows, ids, "claim_id").collect()] == ["c2"]
    assert records.absent(rows, ids, "claim_id").count() == 2


def test_first_seen_over_a_stream_equals_the_table(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", at), ("b", at + datetime.timedelta(minutes=3)), ("a", at + datetime.timedelta(minutes=1))], "k string, ts timestamp")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = earliest.first_seen(stream, ["k"], "ts", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM seen").collect())) == sorted(map(tuple, earliest.first_seen(df, ["k"], "ts").collect()))
    assert earliest.once(df, ["k"], "ts", "10 minutes").count() == 2


def test_insert_adds_each_key_once_and_a_repeated_batch_nothing(spark, tmp_path):
    from factloom.sources.results import insert

    path, frame = str(tmp_path / "t"), lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id int, v string")
    read = lambda: sorted(r.id for r in spark.read.schema("id int, v string").parquet(path).collect())
    insert(frame([1, 2, 2]), path, "id")
    insert(frame([2, 3, 3]), path, "id")
    assert read() == [1, 2, 3]
    insert(frame([9]), path, "id", reset=True)
    assert read() == [9]
    path = str(tmp_path / "b")
    for batch, ids in ((1, [1, 2]), (2, [2, 3, 3]), (2, [2, 3, 3]), (1, [1, 2])):
        insert(frame(ids), path, "id", batch=batch)
        assert read() == [1, 2] if batch == 1 and ids == [1, 2] and len(read()) == 2 else [1, 2, 3]


def test_links_that_cannot_be_read_count_as_fact_checks(spark):
    from factloom.functions import urls

    links = ["http://[::1/x", "http://::1]/x", "http://[zz]/x", "http://[1:2]/x", "http://[::1]/x", "http://[v1.a]/x", "http://a.example/[x]", "https://a.example:99999/x"]
    rows = spark.createDataFrame([(x,) for x in links], "u string").select("u", urls.is_factcheck(F.col("u")).alias("f")).collect()
    assert [r.f for r in rows] == [True, True, True, True, False, False, False, False]
