"""Answers of models and geocoders: what of them can be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sources, text
from ..functions.urls import let
from .entities import address_value
from .rules import place_is_plausible

#: Words that may stand before a JSON answer, dimensions of a claim, and the lists of a visual analysis with texts that only repeat the question.
LEAD = r"(?i)^(?:Here is (?:the |your )?)?(?:JSON(?: object| output| response)?|answer|response|output)\s*:$"
DIMENSIONS = ["subject", "action", "time", "location", "attribution", "context"]
LISTS = {"ocr_text": "ocrtext", "landmarks": "landmarks", "signs_and_logos": "signsandlogos", "languages": "languages", "terrain_and_weather": "terrainandweather"}
MISSPELT = {"signsandlogs": "signsandlogos", "terrainandwether": "terrainandweather"}
PLACEHOLDERS = ["unique visible text", "recognizable landmark", "unique sign or logo", "visible language", "visible environmental clue", "visible weather", "visible terrain and weather"]
EMPTY_SCENES = ["short factual description", "short, factual description"]


def strict_object(answer: Column) -> Column:
    """The text of the one JSON object that an answer consists of, after a finished block of thinking, allowed words before it or a fence around it; null if there is anything else."""
    bare = text.stripped(F.regexp_replace(text.stripped(answer), "^﻿", ""))
    thought = F.when(bare.startswith("<think>"), F.nullif(F.regexp_extract(bare, r"(?s)^<think>.*?</think>(.*)$", 1), F.lit(""))).otherwise(bare)
    open_ = text.stripped(F.regexp_replace(text.stripped(thought), "^</think>", ""))
    lead = text.stripped(F.regexp_extract(open_, r"(?s)^(.*?)(?=\{|```)", 1))
    rest = F.when((lead == "") | lead.rlike(LEAD), F.regexp_replace(open_, r"(?s)^.*?(?=\{|```)", ""))
    body = F.when(rest.startswith("```"), F.nullif(F.regexp_extract(rest, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1), F.lit(""))).otherwise(rest)
    whole = F.when(thought.isNotNull() & body.rlike(r"(?s)^\{.*\}$"), body)
    return F.when(F.try_parse_json(whole).isNotNull(), whole)


def components(claim: Column, normalized: Column, parts: Column) -> Column:
    """The components of a claim, numbered claim_1 and on, with white space collapsed; null unless all keep to the claim's words.

    parts: array of struct(text, subject, action, time, location, attribution, context). The normalised claim has to be the
    claim but for white space, and every component and dimension a passage of it.
    """
    whole = text.collapsed(claim)
    names = ["text", *DIMENSIONS]
    flat = F.transform(parts, lambda p, i: F.struct(F.concat(F.lit("claim_"), (i + 1).cast("string")).alias("id"), *(F.when(p[n].isNotNull(), text.collapsed(p[n])).alias(n) for n in names)))
    held = F.forall(flat, lambda p: p["text"].isNotNull() & F.forall(F.array(*(p[n] for n in names)), lambda v: F.coalesce(F.contains(whole, v), F.lit(True))))
    return F.when((text.collapsed(normalized) == whole) & held, flat)


def vision_lists(found: Column) -> dict[str, Column]:
    """Summary, lists and candidate places of a visual analysis. found: a map of texts to arrays of texts, keys written in any way.

    Of each list the first three different texts stay, without those that only repeat the question; a place has to be
    plausible and named by the summary or what is read, seen or recognised.
    """
    key = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "")
    fixed = lambda k: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in MISSPELT.items() for x in pair)), key(k)), key(k))
    # Keys are read once for each of the results, and what the places are held against once for all places.
    entries = F.transform(F.map_entries(found), lambda e: F.struct(fixed(e["key"]).alias("key"), e["value"].alias("value")))
    at = lambda of, name: F.flatten(F.transform(F.filter(of, lambda e: e["key"] == name), lambda e: F.coalesce(e["value"], F.array().cast("array<string>"))))
    short = lambda x, n: let(text.stripped(x), lambda t: text.cut(t, n))
    tidy = lambda items: F.slice(F.array_distinct(F.filter(F.transform(items, lambda x: short(x, 300)), lambda x: (x != "") & ~F.lower(x).isin(PLACEHOLDERS))), 1, 3)
    of_list = lambda k: lambda of: tidy(at(of, k))
    empty = lambda v: F.lower(v).isin(EMPTY_SCENES) | F.lower(v).contains("no additional information provided")
    scene = lambda of: let(short(F.array_join(at(of, "scenesummary"), " "), 500), lambda v: F.when(empty(v), "").otherwise(v))
    out = {"scene_summary": let(entries, scene), **{name: let(entries, of_list(k)) for name, k in LISTS.items()}}
    told = lambda of: F.lower(F.concat_ws(" ", scene(of), *(tidy(at(of, LISTS[x])) for x in ("ocr_text", "landmarks", "signs_and_logos"))))
    places = lambda of: F.transform(at(of, "candidatelocations"), lambda x: short(x, 200))
    named = lambda of: let(told(of), lambda said: F.slice(F.array_distinct(F.filter(places(of), lambda x: F.contains(said, F.lower(x)) & F.coalesce(place_is_plausible(x), F.lit(False)))), 1, 3))
    out["candidate_locations"] = let(entries, named)
    return out


def place_mismatch(claimed: Column, verified: Column, claimed_row: Column, verified_row: Column) -> Column:
    """How two places differ: same by name or as one place of the map, else the highest level at which both are known and differ, else unknown.

    Rows: struct(osm_type, osm_id, address map). Null without both names, or without both rows.
    """
    norm = lambda v: F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(v, F.lit("")), sources.MARKED, sources.BARE)), r"(?U)[\W_]+", " "))
    there = lambda v: F.coalesce(v, F.lit("")) != ""
    one = claimed_row.isNotNull() & verified_row.isNotNull() & claimed_row["osm_type"].eqNullSafe(verified_row["osm_type"]) & claimed_row["osm_id"].eqNullSafe(verified_row["osm_id"])
    levels = [("different country", ["country_code", "country"]), ("different region", ["state", "region", "province", "state_district"]), ("different city", ["city"])]
    out = F.when(~there(claimed) | ~there(verified), None).when((norm(claimed) == norm(verified)) | one, "same").when(claimed_row.isNull() | verified_row.isNull(), None)
    for name, keys in levels:
        a, b = address_value(claimed_row["address"], keys), address_value(verified_row["address"], keys)
        out = out.when(F.coalesce((a != "") & (b != "") & (a != b), F.lit(False)), name)
    return out.otherwise("unknown")


def best_place(rows: DataFrame, by: str, seq: str, score: str, target: str, values: list[str]) -> DataFrame:
    """by, strategy, candidate_count, target_candidate_count, selected_index, score and the values of the best row: the first with the highest score among those of an administrative kind."""
    best = F.min(F.when(F.col(target), F.struct((-F.col(score)).alias("less"), seq, *values)))
    of = rows.groupBy(by).agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if(target).alias("target_candidate_count"), best.alias("b"))
    strategy = F.when(F.col("b").isNotNull(), "query_and_admin_context").otherwise("no_target_place_candidates")
    return of.select(by, strategy.alias("strategy"), "candidate_count", "target_candidate_count", F.col(f"b.{seq}").alias("selected_index"), F.round(-F.col("b.less"), 4).alias("score"), *(F.col(f"b.{v}").alias(v) for v in values))


def relations(assessments: DataFrame) -> DataFrame:
    """component_id, pillar, stance, evidence_id, quote: what each citation says of a component; unresolved where the assessment is unknown.

    assessments: component_id, pillar, status, supporting and refuting (arrays of struct(evidence_id, quote)).
    """
    side = lambda c, stance: F.transform(F.coalesce(c, F.array().cast("array<struct<evidence_id:string,quote:string>>")), lambda x: F.struct(F.lit(stance).alias("stance"), x["evidence_id"].alias("evidence_id"), x["quote"].alias("quote")))
    rows = assessments.select("component_id", "pillar", "status", F.explode(F.concat(side(F.col("supporting"), "supports"), side(F.col("refuting"), "refutes"))).alias("c"))
    return rows.select("component_id", "pillar", F.when(F.col("status") == "unknown", "unresolved").otherwise(F.col("c.stance")).alias("stance"), "c.evidence_id", "c.quote")


def trace(assessments: DataFrame) -> DataFrame:
    """component_id, pillar, status, evidence_ids: the different evidence of each assessment, in order."""
    none = F.array().cast("array<struct<evidence_id:string,quote:string>>")
    ids = F.transform(F.concat(F.coalesce("supporting", none), F.coalesce("refuting", none)), lambda c: c["evidence_id"])
    return assessments.select("component_id", "pillar", "status", F.array_distinct(ids).alias("evidence_ids"))


def cell(value: Column) -> Column:
    """A value as a cell of a Markdown table."""
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def ratio(count: Column, total: Column) -> Column:
    """count/total (share%), the share to one place."""
    share = F.when(total > 0, 100 * count / total).otherwise(F.lit(0.0))
    return F.format_string("%d/%d (%.1f%%)", count, total, share)
