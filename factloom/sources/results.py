"""Annotations and results of claims as nested rows, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import plain_date
from ..operators.rules import platform

_TEXT, _FLAG = T.StringType(), T.BooleanType()
#: The fields of a verification by pillar; those that are lists are empty lists where nothing is known, the others null.
FIELDS = {
    "provenance": {"provenance_status": _TEXT, "earliest_known_url": _TEXT, "earliest_known_date": _TEXT, "near_duplicate_matches": T.ArrayType(_TEXT), "previous_context_summary": _TEXT, "provenance_mismatch": _FLAG},
    "source": {"original_source_name": _TEXT, "uploader_name": _TEXT, "uploader_profile": _TEXT, "source_type": _TEXT, "source_is_uploader": _FLAG, "source_mismatch": _FLAG},
    "date": {"claimed_date": _TEXT, "video_upload_date": _TEXT, "earliest_online_date": _TEXT, "estimated_date": _TEXT, "capture_date_granularity": _TEXT, "date_mismatch_type": _TEXT},
    "location": {"claimed_location": _TEXT, "candidate_locations": T.ArrayType(_TEXT), "visual_location_clues": T.ArrayType(_TEXT), "verified_location": _TEXT, "verified_coordinates": T.MapType(_TEXT, T.DoubleType()), "location_mismatch_type": _TEXT},
    "motivation": {"claimed_framing": _TEXT, "original_caption": _TEXT, "original_description": _TEXT, "original_context_category": _TEXT, "motivation_mismatch_type": _TEXT},
}


def _has(rows: DataFrame, path: str) -> bool:
    kind = rows.schema
    for step in path.split("."):
        if not isinstance(kind, T.StructType) or step not in kind.names:
            return False
        kind = kind[step].dataType
    return True


def _empty(kind: T.DataType):
    return F.array().cast(kind) if isinstance(kind, T.ArrayType) else F.lit(None).cast(kind)


def verification(rows: DataFrame, column: str = "verification"):
    """All fields of a verification as a struct of pillars: those that the rows have, and empty ones."""
    field = lambda p, f, kind: (F.coalesce(F.col(f"{column}.{p}.{f}").cast(kind), _empty(kind)) if _has(rows, f"{column}.{p}.{f}") else _empty(kind)).alias(f)
    return F.struct(*(F.struct(*(field(p, f, kind) for f, kind in fields.items())).alias(p) for p, fields in FIELDS.items()))


def sidecar(records: DataFrame) -> DataFrame:
    """The annotation that a record starts with.

    records: claim_id, rating, source_file, legacy_split, claim, video_information (platform, video_date, video_url, video_transcript).
    """
    said = F.col("video_information.video_transcript")
    there = F.coalesce(F.trim(said), F.lit("")) != ""
    video = F.struct(
        platform(F.col("video_information.platform")).alias("platform"), plain_date(F.col("video_information.video_date")).alias("video_date"), F.col("video_information.video_url").alias("video_url"),
        F.when(there, said).alias("video_transcript"), F.when(there, "available").otherwise("missing").alias("transcript_status"),
    )
    none = F.lit(None).cast("string")
    review = F.struct(F.lit("not_started").alias("status"), none.alias("reviewer"), none.alias("reviewed_at"), none.alias("notes"))
    return records.select(
        "claim_id", "rating", "source_file", "legacy_split", video.alias("normalized_video_information"), F.array(F.struct(F.lit("claim_1").alias("id"), F.col("claim").alias("text"))).alias("claim_components"),
        verification(records).alias("verification"), F.array().cast("array<struct<id:string,type:string,source:string,observation:string>>").alias("evidence"), F.create_map().cast("map<string,array<string>>").alias("field_evidence"), review.alias("review"),
    )


def readable(annotations: DataFrame) -> DataFrame:
    """The result of a claim: its first component's text, its video and the verification with all fields."""
    video = F.struct(*(F.col(f"normalized_video_information.{f}").alias(f) for f in ("platform", "video_url", "video_date", "video_transcript")))
    return annotations.select("claim_id", F.get("claim_components", 0)["text"].alias("claim"), video.alias("video_information"), verification(annotations).alias("verification"), "rating")


def payload(records: DataFrame) -> DataFrame:
    """What a verification is asked with, trimmed, with empty lists and maps for what is missing. records: claim, post_url, transcript, metadata, keyframes."""
    bare = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    return records.select("claim_id", F.trim(F.coalesce("claim", F.lit(""))).alias("claim"), bare("post_url"), bare("transcript"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), F.coalesce("keyframes", F.array().cast("array<string>")).alias("keyframes"))


def test_ids(spark, path: str, limit: int = 0) -> DataFrame:
    """The ids of a list file in its order, the first `limit` where one is set. A byte-order mark and blank lines don't count."""
    rows = spark.read.text(path).select(F.trim(F.replace("value", F.lit("﻿"), F.lit(""))).alias("claim_id"), F.monotonically_increasing_id().alias("seq")).filter("claim_id <> ''")
    return rows.orderBy("seq").limit(limit).select("claim_id", "seq") if limit else rows


def insert(rows: DataFrame, path: str, key: str, reset: bool = False, batch: int | None = None) -> None:
    """Adds the rows whose key isn't in the table yet, each key once; with `reset` the rows replace the table.

    With a `batch` number the rows go into that batch's own part and replace what a former try has left there, so a run
    that is repeated inserts nothing twice. A table is written with batch numbers throughout or not at all.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    place, part = jvm.org.apache.hadoop.fs.Path(path), f"{path}/batch={batch}" if batch is not None else path
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = rows.dropDuplicates([key])
    if reset:
        rows.write.mode("overwrite").parquet(path)
        return
    if batch is not None:
        fs.delete(jvm.org.apache.hadoop.fs.Path(part), True)
    if fs.exists(place) and fs.listStatus(place):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(key), key, "left_anti")
    rows.write.mode("append").parquet(part)


def export(results: DataFrame, path: str) -> None:
    """Results as JSON, one a line, nulls kept; lone surrogates become U+FFFD."""
    results.select(F.make_valid_utf8(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("value")).write.mode("overwrite").text(path)


def batch_report(outcomes: DataFrame) -> DataFrame:
    """One row over the outcomes (claim_id, status, verdict, seconds): how many have ended how, and the time taken."""
    verdict = lambda v: F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}")
    return outcomes.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("completed"), F.count_if(F.col("status") != "ok").alias("failed"), *(verdict(v) for v in ("TRUE", "FALSE", "NEI")), F.round(F.sum("seconds"), 3).alias("elapsed_seconds"))
