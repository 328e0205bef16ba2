import pytest
from pyspark.sql import functions as F

from factloom.functions import pages, social, urls

from .test_functions import one


def test_literal_addresses(spark):
    refused = ["http://[::1]/", "http://[fd00::1]", "http://[fe80::1]:80/x", "http://192.0.2.1", "http://198.18.0.1", "http://203.0.113.9", "http://0.0.0.0", "http://100.64.0.1", "http://[::ffff:10.0.0.1]/", "http://[2001:db8::1]", "http://[not an address]/", "http://[::1", "http://u@a.com", "ftp://a.com", "", None]
    assert one(spark, refused, urls.is_public(F.col("v"))) == [False] * len(refused)
    taken = ["http://8.8.8.8", "https://[2606:4700::1111]/", "http://[::ffff:8.8.8.8]/", "http://192.0.0.9", "http://010.0.0.1", "https://a.com:8080/x", "HTTPS://A.com"]
    assert one(spark, taken, urls.is_public(F.col("v"))) == [True] * len(taken)


def test_archived_and_encoded_fact_checks(spark):
    links = ["https://example.com/%66act-check/a", "HTTPS://WWW.SNOPES.COM/x", "http://[broken/", "https://web.archive.org/web/1/https://web.archive.org/web/2/https://web.archive.org/web/3/https://snopes.com/x", "https://web.archive.org/web/1/https://example.com/", "https://m.facebook.com/pages/PolitiFact"]
    assert one(spark, links, urls.is_factcheck(F.col("v"))) == [True, True, True, True, False, True]


@pytest.mark.parametrize("target", [None, "https://youtu.be/abc"])
def test_social(spark, target):
    links = ["https://t.co/x", None, " 'https://www.facebook.com/plugins/video.php?href=https%3A%2F%2Ffb.watch%2Fa%2F' ", "https://youtu.be/"]
    got = one(spark, links, social.social(F.col("v"), None if target is None else F.lit(target)))
    if target is None:
        assert [tuple(r) for r in got] == [("https://t.co/x", "x", "needs_redirect", False), ("", None, "unsupported", True), ("https://fb.watch/a/", "facebook", "needs_redirect", True), ("https://youtu.be/", "youtube", "ok", False)]
    else:
        assert [r.url for r in got] == ["https://www.youtube.com/watch?v=abc", "", "https://www.youtube.com/watch?v=abc", "https://youtu.be/"]


def test_page_reader_survives_broken_pages():
    assert pages._read(None)[-1] is None
    row = pages._read("<title>A &amp; B<p>x</title><article><p>One<script>no()</script><!-- c --> two <b>three</article>rest")
    assert row[8] == "A & B<p>x" or row[8].startswith("A & B")
    assert row[-1] == "One two three"
    assert pages._read('<script type="application/ld+json">[1, {"a": {"@type": "Article", "name": "N"}}]</script>')[0] == "N"


def test_lenient_answers():
    assert pages._answer('x {"a": "b\nc"} y') == {"a": "b\nc"}
    assert pages._answer("{'a': (1, None)}") == {"a": (1, None)}
    assert pages._answer("]nothing[") is None and pages._answer("") is None


def test_page_queries_read_whole_references_only(spark, tmp_path):
    import hashlib

    from __spark_entry__ import queries

    told = "<title>A &amp; B &amp</title><article><h1>A &lt;b&gt; &amp</h1><p>Cut &#x2</p><p>one &quot;two&quot; &am</p></article>"
    spark.createDataFrame([(5, "https://a.example/p", told)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    run = lambda name: queries()[name](spark, str(tmp_path)).collect()[0]
    assert run("page_excerpts").excerpt == 'A <b> &amp Cut &#x2 one "two" &am'
    assert run("page_metadata").title == "A & B &amp"
    assert run("page_articles").text_sha256 == hashlib.sha256(b'A <b> &amp Cut &#x2 one "two" &am').hexdigest()
