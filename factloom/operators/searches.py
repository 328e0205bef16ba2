"""What to search for, and how results of several searches become one ranked list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def first_of(rows: DataFrame, by: list[str], key: Column, order: list[str], values: list[str], most: int | None = None) -> DataFrame:
    """The first row of each key, in order and numbered from 1 within `by`; the first `most` where a limit is set.

    Repeats go by one aggregation with partial results. Of a claim's results as many are sorted as differ.
    """
    one = rows.groupBy(*by, key.alias("__key")).agg(F.min(F.struct(*order, *(v for v in values if v not in order))).alias("f"))
    held = one.groupBy(*by).agg(F.array_sort(F.collect_list("f")).alias("all"))
    few = F.slice("all", 1, most) if most else F.col("all")
    return held.select(*by, F.posexplode(few).alias("place", "f")).select(*by, (F.col("place") + 1).alias("rank"), *(F.col(f"f.{v}").alias(v) for v in values))


def query_specs(claims: DataFrame, observations: DataFrame, claim: str, most: int = 5) -> DataFrame:
    """claim, rank, query, query_type: phrases of transcript, caption and claim, then accounts and the handles that evidence names.

    claims: (claim, transcript, caption, text, uploader, source); observations: (claim, seq, observation).
    """
    account = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit('"'), F.replace(F.trim(c), F.lit('"'), F.lit("")), F.lit('"')))
    own = F.array(
        *(F.struct(F.lit(i).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("c"), text.quoted_phrase(F.col(c)).alias("query"), F.lit(kind).alias("query_type")) for i, (c, kind) in enumerate((("transcript", "transcript"), ("caption", "caption"), ("text", "claim")))),
        *(F.struct(F.lit(3 + i).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("c"), account(F.col(c)).alias("query"), F.lit("account").alias("query_type")) for i, c in enumerate(("uploader", "source"))),
    )
    handles = observations.select(claim, F.col("seq").cast("long").alias("b"), F.posexplode(F.regexp_extract_all("observation", F.lit(r"@[A-Za-z0-9_.]+"), F.lit(0))).alias("c", "name"))
    rows = claims.select(claim, F.explode(own).alias("q")).select(claim, "q.*").union(handles.select(claim, F.lit(5).alias("a"), "b", "c", account(F.col("name")).alias("query"), F.lit("account").alias("query_type")))
    return first_of(rows.filter("query IS NOT NULL"), [claim], text.folded(F.col("query")), ["a", "b", "c"], ["query", "query_type"], most)


def base_queries(claims: DataFrame, claim: str, values: list[str], fallback: str, most: int = 4, words: int = 30) -> DataFrame:
    """claim, queries: up to `most` different texts of at most `words` words, and two more that are bound to sites."""
    cut = lambda c: F.array_join(F.slice(F.filter(F.split(F.replace(text.clean(F.col(c)), F.lit('"'), F.lit("")), " "), lambda w: w != ""), 1, words), " ")
    rows = claims.withColumn("__all", F.filter(F.array(*(cut(v) for v in values)), lambda x: x != ""))
    low = F.transform("__all", lambda x: text.folded(x))
    rows = rows.withColumn("__few", F.slice(F.filter("__all", lambda x, i: F.array_position(low, text.folded(x)) == i + 1), 1, most))
    basis = F.coalesce(F.get("__few", 0), text.clean(F.col(fallback), 300))
    return rows.select(claim, F.concat("__few", F.array(F.concat(basis, F.lit(" site:youtube.com")), F.concat(basis, F.lit(" (site:x.com OR site:facebook.com OR site:tiktok.com)")))).alias("queries"))


def merged_images(hits: DataFrame, by: list[str]) -> DataFrame:
    """by, url, score, n_frames of each image: the best score, by which images are ranked, a missing one counting as 0.

    hits: (by, url, frame, score).
    """
    return hits.filter(F.coalesce("url", F.lit("")) != "").groupBy(*by, "url").agg(F.max("score").alias("score"), F.count_distinct("frame").alias("n_frames"))


def ranked_pages(hits: DataFrame, claim: str, most: int = 10) -> DataFrame:
    """claim, rank, url, title, match_types, match_count: pages with full copies first, then by frames, then by link.

    hits: (claim, url, seq, frame, title, full, partial), a row for each frame that a page matches.
    """
    title = F.when(F.coalesce("title", F.lit("")) != "", F.struct("seq", "title"))
    pages = hits.groupBy(claim, "url").agg(F.min(title).alias("t"), F.bool_or("full").alias("full"), F.bool_or("partial").alias("partial"), F.count_distinct("frame").alias("match_count"))
    kinds = F.array_compact(F.array(F.when(F.col("full"), "full"), F.when(F.col("partial"), "partial")))
    order = F.struct((~F.col("full")).alias("a"), (-F.col("match_count")).alias("b"), "url", F.coalesce("t.title", F.lit("")).alias("title"), F.when(F.size(kinds) > 0, F.array_join(kinds, ",")).otherwise("unspecified").alias("match_types"), "match_count")
    held = pages.groupBy(claim).agg(F.slice(F.array_sort(F.collect_list(order)), 1, most).alias("all"))
    return held.select(claim, F.posexplode("all").alias("place", "p")).select(claim, (F.col("place") + 1).alias("rank"), "p.url", "p.title", "p.match_types", "p.match_count")


def merged_names(hits: DataFrame, claim: str) -> DataFrame:
    """claim, key, description, score, n_frames: entities by id, or by their folded description; the first one's words, the best score.

    hits: (claim, seq, entity_id, description, frame, score).
    """
    key = F.coalesce(F.nullif("entity_id", F.lit("")), text.folded(F.col("description")))
    rows = hits.withColumn("key", key).filter(F.coalesce("key", F.lit("")) != "")
    return rows.groupBy(claim, "key").agg(F.min_by("description", "seq").alias("description"), F.max("score").alias("score"), F.count_distinct("frame").alias("n_frames"))


def with_evidence(candidates: DataFrame, evidence: DataFrame, claim: str) -> DataFrame:
    """Candidates with the evidence of their link or, failing that, of their canonical link. evidence: (claim, url, evidence_id)."""
    one = evidence.groupBy(claim, "url").agg(F.min("evidence_id").alias("evidence_id"))
    by = lambda c: one.select(claim, F.col("url").alias(c), F.col("evidence_id").alias(f"__{c}"))
    met = candidates.join(by("url"), [claim, "url"], "left").join(by("canonical_url"), [claim, "canonical_url"], "left")
    return met.select(*candidates.columns, F.coalesce("__url", "__canonical_url").alias("evidence_id"))


def place_candidates(mentions: DataFrame, claim: str) -> DataFrame:
    """claim, rank, name, n_groups, n_event_groups: places by the groups of sources that say the event was there, then by all groups, then by name.

    mentions: (claim, seq, name, category, support_group, score, event). Of a group's mentions of a place one stays: one
    of the event before others, then the best score, then the first.
    """
    best = F.min(F.struct((~F.col("event")).alias("a"), (-F.col("score")).alias("b"), "seq", "event"))
    one = mentions.groupBy(claim, text.folded(F.col("name")).alias("key"), "support_group").agg(best.alias("m"), F.min(F.struct("seq", "name")).alias("first"))
    of = one.groupBy(claim, "key").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n_groups"), F.count_if("m.event").alias("n_event_groups"))
    order = F.struct((-F.col("n_event_groups")).alias("a"), (-F.col("n_groups")).alias("b"), F.lower("first.name").alias("c"), F.col("first.name").alias("name"), "n_groups", "n_event_groups")
    held = of.groupBy(claim).agg(F.array_sort(F.collect_list(order)).alias("all"))
    return held.select(claim, F.posexplode("all").alias("place", "p")).select(claim, (F.col("place") + 1).alias("rank"), "p.name", "p.n_groups", "p.n_event_groups")
