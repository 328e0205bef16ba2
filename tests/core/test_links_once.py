"""A link that many requests name is read once."""

from factloom.operators import retrieval


def test_requests_share_the_reading_of_a_link(spark):
    rows = [(c, s, "web", url) for c in range(3) for s, url in enumerate(["https://A.example/x#1", "https://a.example/x", None, "", "ftp://a.example/x", " https://a.example/y"])]
    done = retrieval.decisions(spark.createDataFrame(rows, "claim_id long, seq long, purpose string, url string"))
    assert done.columns == ["claim_id", "seq", "purpose", "url", "key", "decision"]
    got = {(r.seq, r.key, r.decision) for r in done.collect()}
    assert got >= {(0, "https://a.example/x", "fetched"), (1, "https://a.example/x", "repeated"), (2, None, "screened"), (3, None, "screened"), (4, None, "screened")} and done.count() == len(rows)
    assert "Aggregate [url" in done._jdf.queryExecution().optimizedPlan().toString()
