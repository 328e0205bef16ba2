import hashlib
import uuid

import pytest

from factloom.llm import warc
from factloom.llm.queries import QUERIES

BIG = "<p>é</p>" * 300


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a\r\nX: y", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "n", BIG + "x"), (8, "z", "y" * 999), (9, "z", "y" * 999), (10, "w", "x" * 1000), (10, "w", "x" * 1000)]
    df = spark.createDataFrame([(*r, "k", b"z") for r in rows], "page_id long, url string, html string, sha256 string, head binary")
    read = warc.read_archive(spark, warc.write_archive(df, f"file://{tmp_path}/{uuid.uuid4().hex}"))
    got = warc.parse_records(read).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        body = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
    assert {i: (by[i].record_type, by[i].refers_to) for i in (1, 2, 3, 4, 5, 6, 8, 9, None)} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 8: ("response", None), 9: ("response", None), None: ("response", None)}
    assert sorted(r.record_type for r in got if r.page_id == 10) == ["response", "revisit"]
    raw = next(bytes(r.record) for r in read.collect() if b"x-page:2>" in r.record.split(b"\r\n")[2])
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n") and raw.endswith(b"\r\n\r\n\r\n\r\n") and BIG.encode() not in raw
    assert len(spark.read.parquet(str(next(p for p in tmp_path.iterdir())) + "/payloads").collect()) == len({(h or "") for _, _, h in rows})


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.parse_records(warc.read_archive(spark, warc.write_archive(df, f"file://{tmp_path}/a"))).collect() == []


def test_query_refuses_an_archive_that_fails_verification(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "u", BIG), (2, "v", "small"), (3, "w", BIG)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(QUERIES["op7_warc"](spark, str(tmp_path)).collect()) == 3
    write = warc.write_archive

    def damaged(pages, folder, **options):
        write(pages, f"{folder}-whole", **options)
        spark.read.parquet(f"{folder}-whole/records").write.parquet(f"{folder}/records")
        spark.read.parquet(f"{folder}-whole/payloads").selectExpr("sha256", "CASE WHEN length(payload) < 9 THEN CAST('smell' AS BINARY) ELSE payload END AS payload").write.parquet(f"{folder}/payloads")
        return folder

    monkeypatch.setattr(warc, "write_archive", damaged)
    with pytest.raises(Exception, match="page_id 2"):
        QUERIES["op7_warc"](spark, str(tmp_path)).collect()
