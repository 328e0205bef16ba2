"""Queries over recorded answers of services, media and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import providers
from .registry import by_form, query, read


@query("""WITH q AS (SELECT event_id, 'q' || event_id % 50 AS request FROM events)
SELECT event_id, CASE WHEN event_id % 50 % 5 > 0 THEN 'https://r.example/' || event_id % 50 END AS url, CASE WHEN event_id % 50 % 5 > 0 THEN 2 END AS rank, CASE WHEN event_id % 50 % 5 > 0 THEN 'Title ' || event_id % 50 END AS title, CASE WHEN event_id % 50 % 5 = 0 THEN 'not recorded' END AS error FROM q""")
def recorded_searches(spark, d):
    n = F.col("event_id") % 50
    rows = read(spark, d, "events").select("event_id", F.concat(F.lit("q"), n.cast("string")).alias("request"))
    said = F.concat(F.lit('{"web": {"results": [{"title": "no link"}, {"url": "https://r.example/'), n.cast("string"), F.lit('", "title": " Title '), n.cast("string"), F.lit('", "description": "d"}]}}'))
    known = read(spark, d, "events").filter(n % 5 > 0).select(F.concat(F.lit("q"), n.cast("string")).alias("request"), said.alias("answer")).distinct()
    found = providers.lookup(rows, "request", providers.Recorded(known)).withColumn("r", F.get(providers.brave_results(F.col("answer")), 0))
    return found.select("event_id", "r.url", "r.rank", "r.title", "error")


@query("SELECT event_id, length('q' || event_id % 7) AS n, 'QQ' || event_id % 7 AS answer FROM events")
def service_lookups(spark, d):
    rows = read(spark, d, "events").select("event_id", F.concat(F.lit("q"), (F.col("event_id") % 7).cast("string")).alias("request"))
    found = providers.lookup(rows, "request", providers.Service(lambda asked: [x.upper().replace("Q", "QQ") for x in asked]))
    return found.select("event_id", F.char_length("request").cast("long").alias("n"), "answer")


by_form(
    "list_searches", "events", "event_id",
    {"answer": ["concat('[{\"href\": \"https://a.example/', n, '\", \"title\": \"T\", \"body\": \"', repeat('b', 600), '\"}]')", "concat('[{\"title\": \"x\"}, {\"url\": \"https://b.example/', n, '\", \"body\": \" c \"}]')", "'[]'", "NULL"]},
    {"url": ["concat('https://a.example/', n)", "concat('https://b.example/', n)", "NULL", "NULL"], "rank": ["1", "2", "NULL", "NULL"], "described": ["concat(repeat('b', 500), '...')", "'c'", "NULL", "NULL"], "n_results": ["1", "1", "0", "0"]},
    lambda answer: {"url": F.get(providers.ddgs_results(answer.cast("string")), 0)["url"], "rank": F.get(providers.ddgs_results(answer.cast("string")), 0)["rank"], "described": F.get(providers.ddgs_results(answer.cast("string")), 0)["description"], "n_results": F.size(providers.ddgs_results(answer.cast("string")))},
)
by_form(
    "first_snapshots", "events", "event_id",
    {"answer": ["concat('[[\"timestamp\",\"original\",\"statuscode\"],[\"20110203040506\",\"http://a.example/', n, '\",\"200\"]]')", "'[[\"timestamp\",\"original\",\"statuscode\"]]'", "'[]'", "NULL"]},
    {"date": ["'2011-02-03'", "NULL", "NULL", "NULL"], "snapshot_url": ["concat('https://web.archive.org/web/20110203040506/http://a.example/', n)", "NULL", "NULL", "NULL"]},
    lambda answer: {"date": providers.first_snapshot(answer.cast("string"))["date"], "snapshot_url": providers.first_snapshot(answer.cast("string"))["snapshot_url"]},
)
by_form(
    "video_streams", "events", "event_id",
    {"answer": ["concat('{\"formats\": [{\"url\": \"u', n, '\", \"vcodec\": \"none\"}, {\"url\": \"v\", \"height\": 720}], \"title\": \"A\"}')", "'{\"url\": \"https://a.example/x.MP4\", \"title\": \" \"}'", "'{\"url\": \"https://a.example/x.mp3\", \"vcodec\": \"None\"}'", "concat('{\"title\": \"list\", \"uploader\": \"U\", \"entries\": [{\"title\": \"first ', n, '\", \"formats\": [{\"url\": \"x\", \"ext\": \"webm\"}], \"timestamp\": 86400}]}')", "'{}'"]},
    {"has_video": ["true", "true", "false", "true", "false"], "title": ["'A'", "NULL", "NULL", "concat('first ', n)", "NULL"], "uploader_name": ["NULL", "NULL", "NULL", "'U'", "NULL"], "upload_date": ["NULL", "NULL", "NULL", "'1970-01-02'", "NULL"]},
    lambda answer: {"has_video": providers.has_video(answer), **{k: v for k, v in providers.info_metadata(answer, F.lit("https://a.example/")).items() if k in ("title", "uploader_name", "upload_date")}},
)


@query("SELECT event_id, round(value * 0.5 / 4, 6) AS first, round(value * 3.5 / 4, 6) AS last, CASE event_id % 4 WHEN 0 THEN 'keyframes' WHEN 1 THEN 'video' WHEN 2 THEN 'post' END AS taken_from FROM events")
def media_frames(spark, d):
    n, none = F.col("event_id") % 4, F.lit(None).cast("string")
    times = providers.frame_times(F.col("value"))
    taken = providers.media_choice(F.when(n == 0, F.array(F.lit("1.jpeg"))), F.when(n <= 1, "v.mp4").otherwise(none), F.when(n <= 2, "https://a.example").otherwise(none))
    return read(spark, d, "events").select("event_id", F.get(times, 0).alias("first"), F.get(times, 3).alias("last"), taken.alias("taken_from"))


@query("SELECT 'c' || user_id AS claim, event_id AS frame_no, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events WHERE event_id % 9 < 8")
def ordered_frames(spark, d):
    n = F.col("event_id")
    path = F.concat(F.lit("s3://frames/c"), F.col("user_id").cast("string"), F.lit("/"), F.when(n % 9 == 8, F.concat(F.lit("cover"), n.cast("string"))).otherwise(n.cast("string")), F.when(n % 2 == 0, ".jpeg").otherwise(".JPG"))
    return providers.frame_paths(read(spark, d, "events").select(path.alias("path"))).select("claim", "frame_no", F.col("place").cast("long").alias("place"))
