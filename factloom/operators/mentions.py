"""Places that a claim's texts mention: the texts, their chunks, what a recogniser finds in these, and the mentions that hold.

A recogniser answers chunks, not texts, so each chunk is one request of a provider; what it finds is mapped back to the
text it stands in, where a mention in the overlap of two chunks is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .rules import place_is_plausible

#: What a recogniser's finding needs to count, and how the sources of a claim's texts are named.
LEAST_SCORE = 0.80
CHUNK, STRIDE = 800, 750


def claim_texts(records: DataFrame, cited: DataFrame, pages: DataFrame, seen: DataFrame) -> DataFrame:
    """claim_id, seq, category, support_group, source, text: a claim's texts in the order in which they are read; blank ones are left out.

    records: claim_id, claim, caption, description, transcript, content, url, video_url, source_file. cited: claim_id, n,
    source, observation of fact-check evidence. pages: claim_id, n, url, text of retrieved pages, of which those of the
    claim's own links and repeated ones don't count, slashes at the end and case aside; each host is a group of its own.
    seen: claim_id, frame, text of what the frames show.
    """
    own = lambda n, category, group, source, said: F.struct(F.lit(n).alias("a"), F.lit(category).alias("category"), F.lit(group).alias("support_group"), source.alias("source"), said.alias("text"))
    video, file = F.col("video_url"), F.col("source_file")
    fixed = F.array(
        own(0, "claim", "claim", file, F.col("claim")), own(1, "platform", "current_video", video, F.col("caption")), own(2, "platform", "current_video", video, F.col("description")),
        own(3, "transcript", "current_video", file, F.col("transcript")), own(4, "fact_check", "fact_check", F.col("url"), text.trimmed(F.col("content"), 12000)),
    )
    rows = records.select("claim_id", F.explode(fixed).alias("x")).select("claim_id", "x.a", F.lit(0).alias("b"), "x.category", "x.support_group", "x.source", "x.text")
    told = cited.select("claim_id", F.lit(5).alias("a"), F.col("n").alias("b"), F.lit("fact_check").alias("category"), F.lit("fact_check").alias("support_group"), "source", F.col("observation").alias("text"))
    same = lambda u: F.lower(F.regexp_replace(u, "/+$", ""))
    known = records.select("claim_id", F.explode(F.array("url", "video_url")).alias("url")).union(cited.select("claim_id", F.col("source").alias("url"))).select("claim_id", same(F.col("url")).alias("key")).distinct()
    keyed = pages.filter(F.coalesce("url", F.lit("")) != "").withColumn("key", same(F.col("url"))).join(known, ["claim_id", "key"], "left_anti")
    first = keyed.groupBy("claim_id", "key").agg(F.min(F.struct("n", "url", "text")).alias("x"))
    host = F.regexp_extract("x.url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    found = first.select("claim_id", F.lit(6).alias("a"), F.col("x.n").alias("b"), F.lit("retrieved_page").alias("category"), F.concat(F.lit("retrieved:"), F.lower(F.coalesce(F.nullif(host, F.lit("")), "x.url"))).alias("support_group"), F.col("x.url").alias("source"), text.trimmed(F.col("x.text"), 2000).alias("text"))
    shown = seen.select("claim_id", F.lit(7).alias("a"), F.lit(0).alias("b"), F.lit("vision").alias("category"), F.lit("vision").alias("support_group"), F.col("frame").alias("source"), "text")
    every = rows.union(told).union(found).union(shown).withColumn("text", text.stripped(F.col("text"))).filter("text <> ''")
    return every.select("claim_id", F.struct("a", "b").alias("seq"), "category", "support_group", F.coalesce("source", F.lit("")).alias("source"), "text")


def chunked(texts: DataFrame) -> DataFrame:
    """The texts' chunks: all columns but text, at (where a chunk begins) and piece."""
    own = [c for c in texts.columns if c != "text"]
    return texts.select(*own, F.explode(text.chunks(F.col("text"), CHUNK, STRIDE)).alias("c")).select(*own, "c.at", "c.piece")


def mentions(chunks: DataFrame, found: DataFrame, *own: str) -> DataFrame:
    """own columns, name, score, start, end (in code points of the whole text), excerpt and event of each place that a chunk mentions.

    found: piece, kind, score, word, start, end: what a recogniser finds in a piece, a row for each finding. A finding
    counts if its kind ends in LOC and its score is LEAST_SCORE or more, and its cleaned name can be a place. Its span
    has to lie on whole words; else, or without a span within the piece, the first place where the name stands as
    whole words counts, and without one nothing. A mention that two chunks share is one, with the better score.
    """
    met = chunks.join(found.filter(F.col("kind").endswith("LOC") & (F.col("score") >= LEAST_SCORE)), "piece")
    size = F.char_length("piece")
    within = F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= size), F.lit(False))
    met = met.withColumn("within", within).withColumn("name", text.clean_place(F.when(F.col("within"), F.expr("substring(piece, start + 1, end - start)")).otherwise(F.col("word")))).filter("name <> ''")
    alnum = lambda at: F.coalesce(F.substring("piece", at, F.lit(1)).rlike(r"[\p{L}\p{N}]"), F.lit(False))
    whole = F.col("within") & ((F.col("start") == 0) | ~alnum(F.col("start"))) & ((F.col("end") == size) | ~alnum(F.col("end") + 1))
    met = met.withColumns({"whole": whole, "again": text.place_of(F.col("piece"), F.col("name"))}).filter("whole OR again > 0")
    met = met.withColumns({"start": F.when(F.col("whole"), F.col("start")).otherwise(F.col("again") - 1), "end": F.when(F.col("whole"), F.col("end")).otherwise(F.col("again") - 1 + F.char_length("name"))})
    met = met.filter(F.coalesce(place_is_plausible(F.col("name")), F.lit(False))).withColumn("excerpt", text.excerpt(F.col("piece"), F.col("start"), F.col("end")))
    event = text.sentence_asserts(F.col("excerpt"), F.col("name"))
    rows = met.select(*own, "name", "score", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"), "excerpt", event.alias("event"))
    best = F.min(F.struct((~F.col("event")).alias("a"), (-F.col("score")).alias("b"), "name", "score", "excerpt", "event")).alias("x")
    return rows.groupBy(*own, "start", "end").agg(best).select(*own, "x.name", "x.score", "start", "end", "x.excerpt", "x.event")
