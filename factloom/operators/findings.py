"""What may be taken over from evidence and from a model's answer into a component's fields.

Seeding: links that mean the same post form a closure, which grows in the order of the evidence; metadata and archive
records of these links give the first values. Copying: each field is a row with its rule (which types of evidence may
carry it, how its value has to be grounded), joined with answers and citations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from . import entities, provenance, rules
from .evidence import DECISIVE
from .rounds import cut

ITEM_LINKS = ["requested_url", "source", "final_url", "canonical_url"]


def alias_closure(posts: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claim_id, url, since) of all aliases of a claim's post, and (claim_id, seq) of the items that were matched.

    posts: claim_id, post_url. items: claim_id, seq, urls (array). Items come in the order of seq: one is matched if it
    has a link that was an alias before it, and makes its other links aliases from then on. since is the item that first
    brought a link, -1 for the post's own. A round follows all new aliases at once, by joins on claim and link, so a
    claim of many items is no group; there are as many rounds as the longest chain has links. Links are compared in
    canonical form; null and empty ones don't count.
    """
    start = posts.filter(F.coalesce("post_url", F.lit("")) != "").select("claim_id", urls.evidence_source(F.col("post_url")).alias("url"), F.lit(-1).cast("long").alias("since")).distinct()
    exploded = items.select("claim_id", F.col("seq").cast("long").alias("seq"), F.explode("urls").alias("url")).filter(F.coalesce("url", F.lit("")) != "")
    links = cut(exploded.select("claim_id", "seq", urls.evidence_source(F.col("url")).alias("url")).distinct())
    known = new = cut(start)
    matched = None
    while True:
        hits = new.join(links, ["claim_id", "url"]).filter(F.col("seq") > F.col("since")).select("claim_id", "seq").distinct()
        hits = cut(hits if matched is None else hits.join(matched, ["claim_id", "seq"], "left_anti"))
        if hits.isEmpty():
            break
        matched = hits if matched is None else matched.union(hits)
        brought = links.join(hits, ["claim_id", "seq"]).groupBy("claim_id", "url").agg(F.min("seq").alias("since"))
        # Only links that are new, or known from an earlier item on, can match anything more.
        old = known.groupBy("claim_id", "url").agg(F.min("since").alias("before"))
        new = cut(brought.join(old, ["claim_id", "url"], "left").filter(F.col("before").isNull() | (F.col("since") < F.col("before"))).select("claim_id", "url", "since"))
        known = known.union(new)
    closed = known.groupBy("claim_id", "url").agg(F.min("since").alias("since"))
    return closed, matched if matched is not None else links.select("claim_id", "seq").limit(0)


#: What a platform's metadata tell, and where it goes.
SEEDED = {"uploader_name": "source.uploader_name", "uploader_profile": "source.uploader_profile", "upload_date": "date.video_upload_date"}


def seeded(posts: DataFrame, items: DataFrame) -> DataFrame:
    """claim_id, field, value, evidence_id of what verified evidence of the post itself tells.

    items: claim_id, seq, evidence_id, type, verified, requested_url, source, final_url, canonical_url, observation,
    archive_url, archive_date. Platform metadata (a JSON object) of an alias give name, profile and date where the
    observation itself holds them; of several the last one counts. The earliest archived date that its observation
    states gives date.earliest_online_date; the first of equal ones counts.
    """
    sound = items.filter(F.coalesce("verified", F.lit(False)))
    pages = sound.filter("type = 'platform_metadata'").withColumn("urls", F.array(*ITEM_LINKS))
    aliases, matched = alias_closure(posts, pages)
    read = pages.join(matched, ["claim_id", "seq"]).withColumn("told", F.from_json("observation", ", ".join(f"{k} string" for k in SEEDED)))
    told = read.select("claim_id", "seq", "evidence_id", "source", "observation", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"told.{k}").alias("value")) for k in SEEDED))).alias("x")).select("claim_id", "seq", "evidence_id", "source", "observation", "x.key", "x.value").filter(F.coalesce("value", F.lit("")) != "")
    told = told.withColumn("field", F.try_element_at(F.create_map(*(F.lit(x) for p in SEEDED.items() for x in p)), F.col("key")))
    held = with_grounding(told, "value", "observation", F.array(urls.evidence_source(F.col("source"))), F.col("key").isin("upload_date"), F.col("key") == "uploader_name", F.col("key") == "uploader_profile").filter("grounded")
    last = held.groupBy("claim_id", "field").agg(F.max_by(F.struct("value", "evidence_id"), "seq").alias("x")).select("claim_id", "field", "x.value", "x.evidence_id")
    kept = sound.filter("type = 'archive_record' AND coalesce(archive_url, '') <> ''").withColumn("url", urls.evidence_source(F.col("archive_url"))).join(aliases.select("claim_id", "url"), ["claim_id", "url"], "left_semi")
    dated = dates.parse(kept, "archive_date", "__day")
    dated = dated.filter(dates.grounded(F.col("archive_date"), F.col("__day"), F.col("observation")))
    first = dated.groupBy("claim_id").agg(F.min(F.struct(F.col("__day.start").alias("start"), "seq", F.col("archive_date").alias("value"), "evidence_id")).alias("x"))
    return last.union(first.select("claim_id", F.lit("date.earliest_online_date").alias("field"), "x.value", "x.evidence_id"))


def with_grounding(rows: DataFrame, value: str, quotes: str, sources: Column, is_date: Column, is_name: Column, is_link: Column) -> DataFrame:
    """The rows with `grounded`: whether the quotes hold a date, a source's name or a link, each in its own way.

    sources: canonical links of the evidence that is quoted, one of which a link may also be. Other rows are null there.
    """
    day = rows.filter(is_date)
    read = dates.parse(day, value, "__p")
    found = read.withColumn("grounded", dates.grounded(F.col(value), F.col("__p"), F.col(quotes))).drop("__p")
    link = F.array_contains(sources, urls.evidence_source(F.col(value))) | F.contains(text.normalised(F.col(quotes)), text.normalised(F.col(value)))
    rest = rows.filter(~is_date).withColumn("grounded", F.when(is_name, entities.is_named(F.col(value), F.col(quotes))).when(is_link, link))
    return found.select(*rows.columns, "grounded").union(rest)


#: How precisely a capture date is known, and how two places can differ.
GRANULARITIES = ["day", "month", "year", "range", "unknown"]
PLACE_MISMATCHES = ["same", "different city", "different region", "different country", "unknown"]


def field_rules(spark: SparkSession, enums: dict[str, list[str]]) -> DataFrame:
    """A row for each field that an answer may give: pillar, field, types (of evidence, null for all but geocoder's), decisive, ground, list, once.

    ground: enum, flag, list, date, name, link, words (the value stands in a quote) or cited (any valid citation).
    once: fields that keep a value they have. enums: the allowed values of fields of that kind.
    """
    fact, page = ["retrieved_page"], ["retrieved_page"]
    links = {"earliest_known_url", "uploader_profile"}
    words = {"verified_location", "original_caption", "original_description"}
    listed = {"near_duplicate_matches", "candidate_locations", "visual_location_clues"}
    dated = {"estimated_date", "earliest_known_date", "earliest_online_date", "video_upload_date"}
    special = {"video_upload_date": ["platform_metadata"], "earliest_online_date": ["archive_record"], "original_source_name": page, "source_type": page}
    from ..sources.results import FIELDS

    out = []
    for pillar, fields in FIELDS.items():
        for f in fields:
            if f in ("claimed_date", "claimed_location", "claimed_framing"):
                continue
            kind = "enum" if f in enums else "flag" if f in ("provenance_mismatch", "source_is_uploader", "source_mismatch") else "list" if f in listed else "date" if f in dated else "name" if f in ("original_source_name", "uploader_name") else "link" if f in links else "words" if f in words else "cited"
            types = None if f in listed else special.get(f, ["retrieved_page", "platform_metadata"] if pillar == "source" else fact)
            out.append((pillar, f, types, f not in listed, kind, enums.get(f), f in ("uploader_name", "uploader_profile", "video_upload_date", "earliest_online_date")))
    return spark.createDataFrame(out, "pillar string, field string, types array<string>, decisive boolean, ground string, allowed array<string>, once boolean")


def known_enums() -> dict[str, list[str]]:
    """The fields that have one of a few values, and these."""
    return {
        "provenance_status": provenance.STATUSES, "source_type": entities.KINDS, "capture_date_granularity": GRANULARITIES, "date_mismatch_type": rules.DATE_MISMATCHES,
        "location_mismatch_type": PLACE_MISMATCHES, "original_context_category": rules.CONTEXTS, "motivation_mismatch_type": rules.FRAMINGS,
    }


def copied_fields(answers: DataFrame, citations: DataFrame, evidence: DataFrame, table: DataFrame, present: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(claim_id, pillar, field, value) that an answer may set, and (claim_id, pillar, field, evidence_id) that they rest on.

    answers: claim_id, pillar, field, value, kind (string, boolean, list, other; lists are JSON). citations: claim_id,
    pillar, field, evidence_id, quote. evidence: claim_id, evidence_id, type, verified, source, text. present: (claim_id,
    pillar, field) that have a value, which fields with `once` keep. A field takes a value only with valid citations (a
    quote of eight characters or more that the evidence holds) of evidence that its rule allows, and only if these
    ground the value in the way of its kind. An estimated date needs a retrieved page among them.
    """
    key = ["claim_id", "pillar", "field"]
    asked = answers.filter("value IS NOT NULL").join(F.broadcast(table), ["pillar", "field"])
    if present is not None:
        asked = asked.filter("NOT once").union(asked.filter("once").join(present.select(*key), key, "left_anti").select(asked.columns))
    asked = asked.filter((F.col("ground") == "list") == (F.col("kind") == "list"))
    held = evidence.select("claim_id", "evidence_id", "type", "verified", "source", "text")
    quote = F.trim("quote")
    met = asked.join(citations.filter(F.char_length(quote) >= 8).select(*key, "evidence_id", quote.alias("quote")).distinct(), key).join(held, ["claim_id", "evidence_id"])
    able = F.when(F.col("types").isNull(), F.col("type") != "geocoder_result").otherwise(F.expr("array_contains(types, type)"))
    sound = ~F.col("decisive") | (F.coalesce("verified", F.lit(False)) & F.col("type").isin(DECISIVE))
    met = met.filter(able & sound & F.contains(text.normalised(F.col("text")), text.normalised(F.col("quote"))))
    of = met.groupBy(*key, "value", "kind", "ground", "allowed").agg(
        F.array_join(F.array_sort(F.collect_set("quote")), " ").alias("quotes"), F.collect_set(urls.evidence_source(F.col("source"))).alias("sources"), F.bool_or(F.col("type") == "retrieved_page").alias("has_page"), F.collect_set("evidence_id").alias("ids"))
    of = with_grounding(of, "value", "quotes", F.col("sources"), (F.col("ground") == "date") & (F.col("kind") == "string"), (F.col("ground") == "name") & (F.col("kind") == "string"), (F.col("ground") == "link") & (F.col("kind") == "string"))
    said = (F.col("kind") == "string") & (text.stripped(F.col("value")) != "")
    items = F.from_json("value", "array<string>")
    fits = (
        F.when(F.col("ground") == "enum", (F.col("kind") == "string") & F.expr("array_contains(allowed, value)")).when(F.col("ground") == "flag", F.col("kind") == "boolean")
        .when(F.col("ground") == "list", F.size(items) <= 10).when(F.col("ground") == "words", said & F.contains(text.normalised(F.col("quotes")), text.normalised(F.col("value"))))
        .when(F.col("ground") == "cited", said).otherwise(said & F.col("grounded"))
    )
    taken = of.filter(F.coalesce(fits, F.lit(False)) & ((F.col("field") != "estimated_date") | F.col("has_page")))
    return taken.select(*key, "value"), taken.select(*key, F.explode("ids").alias("evidence_id"))
