"""What lies outside: searches, archives, geocoders, downloads and models, as lookups of recorded answers or as services.

A provider gives a text, mostly JSON, for a request. A recorded one is a table, so a lookup is a join and a run can be
repeated without a network; a service is a function of a batch of requests, called once for each distinct request. The
answers are read by the column functions below, whichever provider they are from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text, urls


class Provider(Protocol):
    """Answers requests: (request) -> (request, answer, error)."""

    def answers(self, requests: DataFrame) -> DataFrame: ...


class Recorded:
    """A provider over a table (request, answer), of which each request has one row at most."""

    def __init__(self, table: DataFrame):
        self.table = table

    def answers(self, requests: DataFrame) -> DataFrame:
        met = requests.select("request").join(self.table.select("request", "answer"), "request", "left")
        return met.select("request", "answer", F.when(F.col("answer").isNull(), "not recorded").alias("error"))


class Service:
    """A provider over a function that answers a list of requests; one that raises gives its message as the error, cut and redacted."""

    def __init__(self, call: Callable[[list[str]], list[str | None]], batch: int = 100):
        self.call, self.batch = call, batch

    def answers(self, requests: DataFrame) -> DataFrame:
        call, size = self.call, self.batch

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), size):
                    asked = frame["request"].iloc[at : at + size].tolist()
                    try:
                        got, error = call(asked), None
                    except Exception as e:  # any failure of a service is recorded beside its requests
                        got, error = [None] * len(asked), str(e)
                    yield pd.DataFrame({"request": asked, "answer": pd.Series(got, dtype=object), "error": pd.Series([error] * len(asked), dtype=object)})

        found = requests.select("request").mapInPandas(ask, "request string, answer string, error string")
        return found.select("request", "answer", F.when(F.col("error").isNotNull(), text.redacted(text.clean(F.col("error"), 500))).alias("error"))


def lookup(rows: DataFrame, request: str, provider: Provider) -> DataFrame:
    """Adds answer and error; equal requests are asked once, and a null one not at all."""
    asked = rows.select(F.col(request).alias("request")).filter("request IS NOT NULL").distinct()
    got = provider.answers(asked).select(F.col("request").alias(request), "answer", "error")
    return rows.join(got, request, "left")


def _results(answer: Column, schema: str, link: Callable[[Column], Column], said: str) -> Column:
    items = F.from_json(answer, schema)
    made = F.transform(items, lambda x, i: F.struct(link(x).alias("url"), text.trimmed(x["title"], 300).alias("title"), text.trimmed(x[said], 500).alias("description"), (i + 1).alias("rank")))
    return F.filter(F.coalesce(made, F.array().cast("array<struct<url:string,title:string,description:string,rank:int>>")), lambda x: F.coalesce(x["url"], F.lit("")) != "")


def brave_results(answer: Column) -> Column:
    """Results (url, title, description, rank) of a web search's answer; ranks count from 1 and skip what has no link."""
    return _results(F.get_json_object(answer, "$.web.results"), "array<struct<url:string,title:string,description:string>>", lambda x: x["url"], "description")


def ddgs_results(answer: Column) -> Column:
    """The same of the other search's list; a result's link is its href, else its url."""
    return _results(answer, "array<struct<href:string,url:string,title:string,body:string>>", lambda x: F.coalesce(F.nullif(x["href"], F.lit("")), x["url"]), "body")


def first_snapshot(answer: Column) -> Column:
    """struct(date, url, snapshot_url, status_code) of the earliest snapshot, the row after an archive's heading; null without one."""
    row = F.get(F.from_json(answer, "array<array<string>>"), 1)
    stamp = F.get(row, 0)
    found = F.struct(dates.plain_date(F.substring(stamp, 1, 8)).alias("date"), F.get(row, 1).alias("url"), F.concat(F.lit("https://web.archive.org/web/"), stamp, F.lit("/"), F.get(row, 1)).alias("snapshot_url"), F.get(row, 2).alias("status_code"))
    return F.when(row.isNotNull(), found)


#: File extensions of videos.
VIDEO = ["mp4", "webm", "mov", "mkv", "flv", "avi", "m4v", "ts"]
FORMAT = "struct<url:string,vcodec:string,height:double,width:double,fps:double,ext:string>"
INFO = f"struct<url:string,vcodec:string,height:double,width:double,fps:double,ext:string,formats:array<{FORMAT}>,requested_formats:array<{FORMAT}>>"


def _is_video(x: Column) -> Column:
    sized = (F.coalesce(x["vcodec"], F.lit("")) != "") | (F.coalesce(x["height"], F.lit(0.0)) != 0) | (F.coalesce(x["width"], F.lit(0.0)) != 0) | (F.coalesce(x["fps"], F.lit(0.0)) != 0)
    named = F.lower(F.coalesce(x["ext"], F.lit(""))).isin(VIDEO) | F.lower(urls.path(x["url"])).rlike(r"\.(" + "|".join(VIDEO) + ")$")
    return F.coalesce((F.coalesce(x["url"], F.lit("")) != "") & (F.lower(F.coalesce(x["vcodec"], F.lit(""))) != "none") & (sized | named), F.lit(False))


def _has_video(info: Column) -> Column:
    some = lambda items: F.coalesce(F.exists(items, _is_video), F.lit(False))
    return F.coalesce(some(info["formats"]) | some(info["requested_formats"]) | _is_video(info), F.lit(False))


def has_video(answer: Column) -> Column:
    """Whether a downloader's metadata name a video stream, in their formats, themselves or an entry."""
    entries = F.from_json(F.get_json_object(answer, "$.entries"), f"array<{INFO}>")
    return _has_video(F.from_json(answer, INFO)) | F.coalesce(F.exists(entries, _has_video), F.lit(False))


def merged_info(answer: Column) -> Column:
    """The fields of a downloader's metadata as a map of texts, the first entry's in place of the whole's where they are filled."""
    full = lambda m: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    own, entry = full(F.from_json(answer, "map<string,string>")), full(F.from_json(F.get_json_object(answer, "$.entries[0]"), "map<string,string>"))
    keys = F.array_except(F.array_union(F.map_keys(own), F.map_keys(entry)), F.array(F.lit("entries")))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.try_element_at(entry, k), F.try_element_at(own, k))))


def info_metadata(answer: Column, link: Column) -> dict[str, Column]:
    """Title, description, uploader, its page, upload date and web page of a downloader's metadata, cleaned and made whole."""
    m = merged_info(answer)
    at = lambda k: F.try_element_at(m, F.lit(k))
    clean = lambda v, n: F.nullif(text.clean(F.regexp_replace(v, "<[^>]+>", " "), n), F.lit(""))
    stamp = at("timestamp").try_cast("double")
    return {
        "title": clean(at("title"), 1000), "description": clean(at("description"), 10000), "uploader_name": clean(F.coalesce(at("uploader"), at("channel")), 300),
        "uploader_profile": urls.absolute(F.coalesce(at("uploader_url"), at("channel_url")), link), "upload_date": F.coalesce(dates.any_date(at("upload_date")), dates.epoch_date(stamp)),
        "webpage_url": F.coalesce(urls.absolute(at("webpage_url"), link), link), "extractor": clean(at("extractor"), 200),
    }


def frame_times(duration: Column, n: int = 4) -> Column:
    """The midpoints of n equal parts of a video, in seconds to six places."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(duration * (i + 0.5) / n, 6))


def media_choice(keyframes: Column, video_path: Column, post_url: Column) -> Column:
    """What a claim's frames are taken from: keyframes before a file of the video, and that before its link; null for nothing."""
    return F.when(F.size(F.coalesce(keyframes, F.array().cast("array<string>"))) > 0, "keyframes").when(video_path.isNotNull(), "video").when(post_url.isNotNull(), "post")


def frame_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Frames of a listing, those whose name is a number, with claim (their folder), frame_no and their place in order."""
    name = F.regexp_extract(path, r"([^/]*)/(\d+)\.(?i:jpe?g|png)$", 2)
    rows = files.withColumn("frame_no", name.try_cast("bigint")).filter("frame_no IS NOT NULL").withColumn("claim", F.regexp_extract(path, r"([^/]*)/\d+\.[^/.]*$", 1))
    held = rows.groupBy("claim").agg(F.array_sort(F.collect_list(F.struct("frame_no", F.col(path).alias("path")))).alias("all"))
    return held.select("claim", F.posexplode("all").alias("place", "f")).select("claim", "place", "f.frame_no", "f.path")
