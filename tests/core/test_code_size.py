"""What the JVM doesn't compile is interpreted: methods of more than 8000 bytes."""

import json
import re

from pyspark.sql import functions as F

from factloom.functions import dates
from factloom.operators import claims
from factloom.operators import evidence as ev
from factloom.operators.claims import State
from factloom.plans import states

LARGEST = 8000


def largest(spark, build):
    """The largest method of build()'s plan, as it is before it runs."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", build()._jdf.queryExecution().explainString(mode))))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_forms_of_a_plain_date(spark):
    forms = {"20240229": "2024-02-29", "20230229": None, "2024-3-5": "2024-03-05", " 20240101.0": "2024-01-01", "00000101": None, "0001-1-1": "0001-01-01", "2024-0101": None, "20240101\n": "2024-01-01", "20240101 ": "2024-01-01", "20240101\n\n": None, "2024": None, "2024-01-01T00": None, "20241301": None}
    rows = spark.createDataFrame([(k,) for k in forms], "x string").repartition(2)
    assert {r.x: r.day for r in rows.select("x", dates.plain_date(F.col("x")).alias("day")).collect()} == forms


def test_quoted_texts_are_json(spark):
    texts = ["".join(map(chr, range(0, 200))) + "\U0001f600", 'a "b" \\', "", "\x00\x1f\x7f"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").repartition(2)
    assert {r.x: r.q for r in rows.select("x", ev._quoted(F.col("x")).alias("q")).collect()} == {t: json.dumps(t, ensure_ascii=False) for t in texts}


def test_links_of_a_bootstrap_leave_other_values_alone(spark):
    """No field but the status and its leader is merged for evidence and links."""
    values = spark.createDataFrame([(1, "date.video_upload_date", "2020-01-01")], "claim_id long, field string, value string")
    evidence = spark.createDataFrame([(1, "dataset-video-metadata-0", "dataset_video_metadata", "s", "o")], "claim_id long, evidence_id string, type string, source string, observation string")
    links = spark.createDataFrame([], "claim_id long, field string, evidence_id string")
    columns = "claim_id long, source_file string, claim string, url string, content string, platform string, video_url string, video_date string, video_headline string, video_description string, video_transcript string, references array<struct<text:string,refs:array<string>>>"
    records = spark.createDataFrame([(1, "f", "c", "u", "t", "CNN", "v", "20240101", "the headline", "d", None, [])], columns)
    found = claims.bootstrap(State(values, evidence, links), records).links
    assert "motivation.claimed_framing, value" not in found._jdf.queryExecution().optimizedPlan().toString()
    held = {(r.field, r.evidence_id == "dataset-video-metadata-0") for r in found.filter("evidence_id LIKE 'dataset-video-metadata-%'").collect()}
    told = {(f, False) for f in claims.TOLD_BY_RECORD}
    both = {(f, old) for f in ("provenance.provenance_status", "source.uploader_name", "source.original_source_name", "source.source_type", "source.source_is_uploader") for old in (False, True)}
    assert held == told | both


def test_claim_queries_stay_compiled(spark):
    for query in (states.bootstrap_evidence, states.reset_values, states.web_values):
        assert largest(spark, lambda: query(spark, "/root/testdata/sf0.001")) < LARGEST, query.__name__
