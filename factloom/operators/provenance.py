"""Where a video stood before: matches from searches, the earliest of them, and what follows for its provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls

#: What a video's provenance can be, and sources of matches that a search has produced.
STATUSES = ["original", "earlier version found", "repost", "edited excerpt", "compilation", "screen recording", "unknown"]
GENERATED = ["reverse_image", "transcript_search", "caption_search"]


def status_fields(summary: Column, mismatch: Column, status: Column, framing: Column) -> dict[str, Column]:
    """Summary and mismatch go where there is no summary or it says what the claim says; an unknown status is unknown."""
    empty = (F.coalesce(summary, F.lit("")) == "") | summary.eqNullSafe(framing)
    return {"summary": F.when(~empty, summary), "mismatch": F.when(~empty, mismatch), "status": F.when(status.isin(STATUSES), status).otherwise("unknown")}


def candidate_date(*dates: Column) -> Column:
    """The earliest of the dates given, which are ISO texts; null without one."""
    return F.array_min(F.filter(F.array(*dates), lambda x: x.isNotNull()))


def has_phrase(kind: Column, query: Column, *parts: Column) -> Column:
    """Whether a result of a transcript or caption search holds the phrase that was searched for."""
    phrase = text.normalised(F.regexp_replace(F.coalesce(query, F.lit("")), '^"+|"+$', ""))
    hay = text.normalised(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)))
    return F.coalesce(kind.isin("transcript", "caption") & (phrase != "") & F.contains(hay, phrase), F.lit(False))


def is_image_match(kinds: Column) -> Column:
    """Only pages with full or partial copies of a frame count."""
    return F.coalesce(F.arrays_overlap(kinds, F.array(F.lit("full"), F.lit("partial"))), F.lit(False))


def merged(matches: DataFrame, by: str, url: str, source: str, order: str, values: list[str]) -> DataFrame:
    """One match for each video of a claim: the first that no search has produced, else the first; ranked undated last, by date and link.

    `values` has to hold a column `date`. One aggregation with partial results; a claim's ranking sorts its own matches.
    """
    made = F.coalesce(F.col(source).isin(GENERATED), F.lit(False))
    best = F.min(F.struct(made.alias("made"), F.col(order).alias("order"), F.col(url).alias("url"), F.col(source).alias("source"), *(F.col(v) for v in values)))
    one = matches.groupBy(by, urls.match_key(F.col(url)).alias("key")).agg(best.alias("b")).select(by, "b.url", "b.source", *(f"b.{v}" for v in values))
    ranked = one.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("date").isNull().alias("undated"), "date", "url", "source", *(v for v in values if v != "date")))).alias("all"))
    return ranked.select(by, F.posexplode("all").alias("place", "m")).select(by, (F.col("place") + 1).alias("rank"), "m.url", "m.source", *(f"m.{v}" for v in values))


def earliest(matches: DataFrame, current: DataFrame, by: str) -> DataFrame:
    """by, url, date, priority of the earliest dated place of each claim: the video itself (priority 0) before a match (1), then by link.

    matches: (by, url, date); current: (by, url, date), a row for each claim.
    """
    rows = current.select(by, F.lit(0).alias("priority"), "url", "date").union(matches.select(by, F.lit(1).alias("priority"), "url", "date")).filter("date IS NOT NULL")
    return rows.groupBy(by).agg(F.min(F.struct("date", "priority", F.coalesce("url", F.lit("")).alias("url"))).alias("e")).select(by, F.nullif(F.col("e.url"), F.lit("")).alias("url"), "e.date", "e.priority")


def found_status(earliest_url: Column, earliest_date: Column, video_url: Column, video_date: Column, upload: Column) -> Column:
    """earlier version found, if the earliest place is dated before the video or, where it is the video itself, before its upload; else unknown."""
    same = urls.match_key(earliest_url) == urls.match_key(video_url)
    before = F.when(F.coalesce(same, F.lit(False)), earliest_date < upload).otherwise(earliest_date < video_date)
    return F.when(earliest_date.isNull(), "unknown").when(F.coalesce(before, F.lit(False)), "earlier version found").otherwise("unknown")


def online_date(earliest_date: Column, existing: Column, same_place: Column) -> Column:
    """The earliest date online: that of the earliest place, or the one known before if it was of the same place."""
    return F.least(earliest_date, F.when(same_place, existing))
