"""What a visual analysis saw, with each part of the answer worked out once."""

from pyspark.sql import functions as F

from factloom.operators import answers


def test_places_are_held_against_a_summary_that_is_made_once(spark):
    found = answers.vision_lists(F.col("found"))
    rows = spark.createDataFrame([(1, {"Scene Summary": ["  A square ", "in Lima "], "OCR-text": ["Stop", None, "Stop", "x" * 301], "candidate_locations": ["Lima", "Quito", "Lima", None]}), (2, None), (3, {"candidateLocations": None})], "id int, found map<string,array<string>>")
    # A part stands in the plan once for each result that it belongs to.
    plan = rows.select(found["candidate_locations"].alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("scenesummary") == plan.count("candidatelocations") == 1
    got = {r.id: (r.scene_summary, r.ocr_text, r.candidate_locations) for r in rows.select("id", *(c.alias(n) for n, c in found.items())).collect()}
    assert got[1] == ("A square  in Lima", ["Stop", "x" * 300 + "..."], ["Lima"])
    assert got[3] == ("", [], [])
