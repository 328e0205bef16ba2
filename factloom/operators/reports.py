"""Counts over annotations: what is filled, what is missing, what lacks evidence, and how checks have ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a video's metadata, and platforms by the group that reports name.
CORE_FIELDS = ["title", "description", "uploader_name", "uploader_profile", "upload_date"]
PLATFORM_LABELS = {"x": "X (Twitter)", "youtube": "YouTube", "tiktok": "TikTok", "facebook": "Facebook", "instagram": "Instagram"}
NEWS_PLATFORMS = ["nytimes", "foxnews", "nbcnews", "cnbc", "today"]
NEWS_LABEL = "News sites (NYT, Fox, NBC, CNBC, Today)"
#: States of a stage that are an issue.
ISSUES = ["error", "parse_error", "low_quality"]


def is_missing(value: Column, kind: str = "text") -> Column:
    """Null or empty, of a text, an array or a map; other kinds only if null."""
    empty = {"text": lambda: value == "", "array": lambda: F.size(value) == 0, "map": lambda: F.size(F.map_keys(value)) == 0}.get(kind, lambda: F.lit(False))
    return value.isNull() | empty()


def is_filled(value: Column, kind: str = "text") -> Column:
    """As the audit counts: an empty text or array isn't filled, an empty map is."""
    return ~is_missing(value, "other" if kind == "map" else kind)


def has_words(value: Column) -> Column:
    """As page metadata counts: null and white space aren't filled."""
    return value.isNotNull() & (F.trim(value.cast("string")) != "")


def percentage(count: Column, total: Column) -> Column:
    return F.when(total > 0, 100 * count / total).otherwise(0.0)


def platform_group(platform: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(platform, F.lit(""))))
    named = F.try_element_at(F.create_map(*(F.lit(x) for pair in PLATFORM_LABELS.items() for x in pair)), low)
    return F.when(named.isNotNull(), named).when(low.isin(NEWS_PLATFORMS), NEWS_LABEL).otherwise("Others")


def metadata_status(fields: list[Column]) -> Column:
    n = sum((f.cast("int") for f in fields[1:]), fields[0].cast("int"))
    return F.when(n == len(fields), "complete").when(n > 0, "partial").otherwise("missing")


def breakdown(rows: DataFrame, field: str, decision: str = "decision") -> DataFrame:
    """field, total, kept, discarded, unknown."""
    n = lambda x: F.count_if(F.col(decision) == x)
    return rows.groupBy(field).agg(F.count(F.lit(1)).alias("total"), n("keep").alias("kept"), n("discard").alias("discarded"), n("unknown").alias("unknown"))


def metadata_breakdown(rows: DataFrame, field: str, fields: list[str]) -> DataFrame:
    """field, total, complete, partial, missing, and how many rows have each of the metadata fields."""
    status = metadata_status([has_words(F.col(f)) for f in fields])
    counted = rows.withColumn("__status", status)
    n = lambda x: F.count_if(F.col("__status") == x).alias(x)
    return counted.groupBy(field).agg(F.count(F.lit(1)).alias("total"), n("complete"), n("partial"), n("missing"), *(F.count_if(has_words(F.col(f))).alias(f"has_{f}") for f in fields))


def summary(rows: DataFrame, decision: str = "decision") -> DataFrame:
    """One row: records kept, discarded and unknown, with percentages to two places."""
    counts = rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(decision) == k).alias(name) for k, name in (("keep", "kept"), ("discard", "discarded"), ("unknown", "unknown"))))
    return counts.select("*", *(F.round(percentage(F.col(c), F.col("total")), 2).alias(f"{c}_percentage") for c in ("kept", "discarded", "unknown")))


def group_results(checks: DataFrame, by: str, order: str, fields: list[str]) -> DataFrame:
    """The outcome of a group from the checks of its links, which come in order.

    One kept link keeps the group, with its reason; else one that is unknown makes it unknown, else it goes. Of several
    links that all failed the reason says so. The metadata are those of the first check with the most fields filled.
    """
    n = sum((has_words(F.col(f)).cast("int") for f in fields[1:]), has_words(F.col(fields[0])).cast("int"))
    rows = checks.withColumn("__n", n)
    first = lambda cond, *what: F.min(F.when(cond, F.struct(order, *what)))
    of = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_checks"), first(F.col("decision") == "keep", "reason", "url").alias("kept"), F.bool_or(F.col("decision") == "unknown").alias("open"),
        first(F.lit(True), "reason").alias("first"), F.min(F.struct((-F.col("__n")).alias("less"), order, "url", *fields)).alias("best"),
    )
    decision = F.when(F.col("kept").isNotNull(), "keep").when(F.col("open"), "unknown").otherwise("discard")
    several = F.when(F.col("open"), "all_equivalent_urls_inconclusive").otherwise("all_equivalent_urls_failed")
    reason = F.when(F.col("kept").isNotNull(), F.col("kept.reason")).when(F.col("n_checks") == 1, F.col("first.reason")).otherwise(several)
    return of.select(by, decision.alias("decision"), reason.alias("reason"), F.col("kept.url").alias("successful_url"), metadata_status([has_words(F.col(f"best.{f}")) for f in fields]).alias("metadata_status"), F.col("best.url").alias("metadata_url"), *(F.col(f"best.{f}").alias(f) for f in fields))


def audit(fields: DataFrame, links: DataFrame, evidence: DataFrame, stages: DataFrame, metadata: DataFrame, paths: dict[str, str], claim: str = "claim_id") -> DataFrame:
    """part, name, n: all parts of an audit as counts.

    fields: (claim, field, value); links: (claim, field, evidence_id); evidence: (claim, evidence_id, type);
    stages: (claim, stage, status, errors); metadata: (claim, field, value), fields being those of `paths`, which gives
    where each is kept. coverage counts filled fields by name; unsupported filled fields that no evidence is linked to;
    dangling fields with a link to no evidence; issues stages with errors; stale links from platform metadata to a field
    that the metadata don't have; types evidence by type.
    """
    filled = fields.filter(is_filled(F.col("value"))).select(claim, "field")
    known = links.join(evidence.select(claim, "evidence_id", "type"), [claim, "evidence_id"], "left")
    held = known.groupBy(claim, "field").agg(F.bool_or(F.col("type").isNotNull()).alias("held"), F.bool_or(F.col("type").isNull()).alias("dangling"), F.bool_or(F.coalesce(F.col("type") == "platform_metadata", F.lit(False))).alias("platform"))
    has = metadata.filter(has_words(F.col("value"))).select(claim, F.try_element_at(F.create_map(*(F.lit(x) for pair in paths.items() for x in pair)), F.col("field")).alias("field"))
    one = lambda df, part, name: df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "name", "n")
    total = lambda df, part: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), F.lit("").alias("name"), "n")
    parts = [
        one(filled, "coverage", F.col("field")),
        total(filled.join(held.filter("held").select(claim, "field"), [claim, "field"], "left_anti"), "unsupported"),
        total(held.filter("dangling"), "dangling"),
        total(stages.filter(F.coalesce(F.col("status").isin(ISSUES), F.lit(False)) | (F.size(F.coalesce("errors", F.array())) > 0)), "issues"),
        total(held.filter("platform").filter(F.col("field").isin(list(paths.values()))).join(has, [claim, "field"], "left_anti"), "stale"),
        one(evidence, "types", F.col("type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def record_gaps(records: DataFrame, date: str, read_date: Column, transcript: str, n_evidence: str, n_referenced: str, relation: str) -> DataFrame:
    """One row: records without date, with one that can't be read, without transcript, without evidence, without relations, and how much evidence there is."""
    words = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    return records.agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(~words(date)).alias("dates_missing"), F.count_if(words(date) & read_date.isNull()).alias("dates_invalid"), F.count_if(~words(transcript)).alias("transcripts_missing"),
        F.count_if(F.col(n_evidence) == 0).alias("without_evidence"), F.sum(n_evidence).cast("long").alias("evidence_items"), F.sum(n_referenced).cast("long").alias("referenced_items"), F.count_if(~words(relation)).alias("empty_relations"),
    )
