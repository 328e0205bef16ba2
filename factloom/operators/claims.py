"""What is known of claims, as long tables, and how a stage merges its findings into it.

values (claim_id, field, value): one row for a field, its value as text; lists and structs are JSON. evidence (claim_id,
evidence_id, type, source, observation): what has been found. links (claim_id, field, evidence_id): what a field's value
rests on. Every stage is one merge: its new values meet the old ones in a full outer join, a rule for each field says
which of them holds, and fields that others were derived from take these along when they change. All joins and groups
are by claim and field, so a claim costs its own fields only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import plain_date
from ..functions.sources import uploader
from ..functions.text import clean_place, folded, trimmed
from ..functions.urls import account_page
from . import evidence as ev
from .entities import platform_source
from .rules import place_is_plausible, platform

KEY = ["claim_id", "field"]


class State(NamedTuple):
    values: DataFrame
    evidence: DataFrame
    links: DataFrame


class Rule(NamedTuple):
    """How a field takes a new value. fill: where the old one is null. update: where the new one isn't. force: always.

    A field with a leader takes its new value, whatever it is, where the leader's rule lets the leader take one.
    """

    mode: str
    leader: str | None = None


def stacked(rows: DataFrame, fields: dict[str, Column], where: Column | None = None) -> DataFrame:
    """claim_id, field, value of a wide table; `where` picks the rows that give any."""
    rows = rows if where is None else rows.filter(where)
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), v.cast("string").alias("value")) for f, v in fields.items()))
    return rows.select("claim_id", F.explode(pairs).alias("x")).select("claim_id", "x.field", "x.value")


def wide(values: DataFrame, fields: dict[str, str]) -> DataFrame:
    """claim_id and a column for each of the fields; null where a claim has no row for one."""
    return values.groupBy("claim_id").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(c) for c, f in fields.items()))


def _lookup(pairs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in pairs.items() for x in p)), F.col("field")) if pairs else F.lit(None).cast("string")


def merge(old: DataFrame, new: DataFrame, rules: dict[str, Rule], protected: DataFrame | None = None) -> DataFrame:
    """claim_id, field, value, old, decision: the old values with the new ones merged in by the rules.

    decision: filled (old null), replaced, cleared (new null), same, protected (held against a new value) or kept.
    protected: (claim_id, field) that keep their old values. Fields without a rule keep theirs; a field that was never
    there appears with null if it takes nothing. Keys are unique in old, new and protected.
    """
    a = old.select(*KEY, F.col("value").alias("old"))
    b = new.select(*KEY, F.col("value").alias("new"), F.lit(True).alias("given"))
    both = a.join(b, KEY, "full_outer").withColumn("given", F.coalesce("given", F.lit(False)))
    mode = _lookup({f: r.mode for f, r in rules.items()})
    led = {f: r.leader for f, r in rules.items() if r.leader}
    both = both.withColumns({"mode": mode, "lead_old": F.col("old"), "lead_new": F.col("new")})
    if led:
        heads = sorted({*led.values()})
        leaders = a.filter(F.col("field").isin(heads)).join(b.filter(F.col("field").isin(heads)), KEY, "full_outer").select("claim_id", F.col("field").alias("leader"), F.col("old").alias("h_old"), F.col("new").alias("h_new"))
        both = both.withColumn("leader", _lookup(led)).join(leaders, ["claim_id", "leader"], "left")
        follows = F.col("leader").isNotNull()
        both = both.withColumns({"lead_old": F.when(follows, F.col("h_old")).otherwise(F.col("old")), "lead_new": F.when(follows, F.col("h_new")).otherwise(F.col("new"))})
    wants = F.when(F.col("mode") == "fill", F.col("lead_old").isNull()).when(F.col("mode") == "update", F.col("lead_new").isNotNull()).when(F.col("mode") == "force", True)
    both = both.withColumn("wants", F.col("given") & F.coalesce(wants, F.lit(False)))
    held = F.lit(False)
    if protected is not None:
        both = both.join(protected.select(*KEY, F.lit(True).alias("held")), KEY, "left")
        held = F.coalesce("held", F.lit(False))
    takes = F.col("wants") & ~held
    decision = (
        F.when(F.col("wants") & held, "protected").when(~takes, "kept").when(F.col("new").eqNullSafe(F.col("old")), "same")
        .when(F.col("old").isNull(), "filled").when(F.col("new").isNull(), "cleared").otherwise("replaced")
    )
    return both.select(*KEY, F.when(takes, F.col("new")).otherwise(F.col("old")).alias("value"), "old", decision.alias("decision"))


def exactly(value: Column) -> Column:
    return value


def invalidated(merged: DataFrame, derived: dict[str, list[str]], norm=exactly) -> DataFrame:
    """The merged values, with derived fields null whose inputs have changed and that no new value was given for.

    derived: the inputs of each derived field. norm: what of a value counts as a change; null counts as empty there.
    """
    of = {}
    for field, inputs in derived.items():
        for i in inputs:
            of.setdefault(i, []).append(field)
    table = F.try_element_at(F.create_map(*(x for i, fields in of.items() for x in (F.lit(i), F.array(*map(F.lit, fields))))), F.col("field"))
    differs = norm(F.coalesce("value", F.lit(""))) != norm(F.coalesce("old", F.lit("")))
    stale = merged.filter(F.col("field").isin(list(of)) & differs).select("claim_id", F.explode(table).alias("field")).distinct()
    rows = merged.join(stale.withColumn("stale", F.lit(True)), KEY, "left")
    gone = F.coalesce("stale", F.lit(False)) & F.col("value").isNotNull() & F.col("decision").isin("kept", "protected", "same")
    return rows.select(*KEY, F.when(~gone, F.col("value")).alias("value"), "old", F.when(gone, "invalidated").otherwise(F.col("decision")).alias("decision"))


def fingerprints(values: DataFrame, derived: dict[str, list[str]]) -> DataFrame:
    """claim_id, field, fingerprint: the SHA-256 of each derived field's inputs (name, value in turn, as JSON), to hold against a later state."""
    out = None
    for field, inputs in derived.items():
        given = wide(values.filter(F.col("field").isin(inputs)), {i: i for i in inputs})
        text = F.to_json(F.array(*(x for i in inputs for x in (F.lit(i), F.col(f"`{i}`")))))
        one = given.select("claim_id", F.lit(field).alias("field"), F.sha2(text.cast("binary"), 256).alias("fingerprint"))
        out = one if out is None else out.union(one)
    return out


def relinked(links: DataFrame, added: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """The links without those of the fields in `dropped` (claim_id, field), and with the added ones, each once."""
    if dropped is not None:
        links = links.join(dropped.select(*KEY).distinct(), KEY, "left_anti")
    return links.select(*KEY, "evidence_id").union(added.select(*KEY, "evidence_id")).distinct()


def _written(text: Column) -> Column:
    """How a missing text is written in an identity."""
    return F.coalesce(text, F.lit("None"))


def _identity(kind: Column, source: Column, observation: Column, model: Column) -> Column:
    return ev.labelled_identity(kind, _written(source), _written(observation), model)


def with_evidence(state: State, found: DataFrame, gone: list[str] | None = None, also: DataFrame | None = None) -> State:
    """The state with more evidence (claim_id, type, source, observation, fields, optional model), linked with its fields.

    Evidence of the types in `gone` goes first, with its links. Evidence that is there already stays as it is. also: more
    links, which are added with those of the new evidence.
    """
    held, links = state.evidence, state.links
    for kind in gone or []:
        held, links = ev.without_type(held, links, kind)
    model = F.col("model") if "model" in found.columns else F.lit(None).cast("string")
    named = found.withColumn("evidence_id", _identity(F.col("type"), F.col("source"), F.col("observation"), model)).withColumn("source", _written(F.col("source")))
    new = named.groupBy("claim_id", "evidence_id").agg(F.min(F.struct("type", "source", "observation")).alias("x")).select("claim_id", "evidence_id", "x.type", "x.source", "x.observation")
    fresh = new.join(held.select("claim_id", "evidence_id"), ["claim_id", "evidence_id"], "left_anti")
    more = named.select("claim_id", F.explode("fields").alias("field"), "evidence_id")
    return State(state.values, held.select(new.columns).union(fresh), relinked(links, more if also is None else more.union(also.select(more.columns))))


def _of(kind: str, source: Column, observation: Column, *fields: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), source.alias("source"), observation.alias("observation"), F.array(*map(F.lit, fields)).cast("array<string>").alias("fields"))


def _evidence_rows(rows: DataFrame, *found: Column) -> DataFrame:
    return rows.select("claim_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("claim_id", "x.*")


#: Fields that a record's metadata tell, and the sentences that say where they come from.
TOLD_BY_RECORD = ["date.video_upload_date", "provenance.earliest_known_url", "provenance.earliest_known_date", "motivation.original_caption", "motivation.original_description"]
RECORD_METADATA = "Video URL, platform, upload date, title, and description imported from TRUE."
METADATA_FOUND = "Platform metadata retrieved for the available fields."
NAME_INFERRED = "Uploader account identifier inferred from the video URL path."
SNAPSHOT = "Earliest successful Wayback snapshot for the video URL."
_STATUS, _CONTEXT, _NAME, _KIND, _SAME = "provenance.provenance_status", "provenance.previous_context_summary", "source.original_source_name", "source.source_type", "source.source_is_uploader"
EARLIER = "earlier version found"


def official_source(rows: DataFrame) -> DataFrame:
    """The rows with `official`: the publisher whose own platform the column `platform` names."""
    return rows.withColumn("official", platform_source(platform(F.col("platform"))))


def bootstrap(state: State, records: DataFrame, force: bool = False) -> State:
    """The state after a record's own statements: they fill what is not known yet, or with `force` replace it.

    records: claim_id, source_file, claim, url, content, platform, video_url, video_date, video_headline,
    video_description, video_transcript, references (array of text and refs). The earliest known place brings its date
    and the status unknown along. A publisher's own platform names the source whatever was known.
    """
    # The day is a column of its own, as two of the fields need it.
    records, day = official_source(records).withColumn("day", plain_date(F.col("video_date"))), F.col("day")
    own = {
        "motivation.claimed_framing": F.col("claim"), "date.video_upload_date": day, "provenance.earliest_known_url": F.col("video_url"), "provenance.earliest_known_date": day,
        _STATUS: F.lit("unknown"), "motivation.original_caption": F.col("video_headline"), "motivation.original_description": F.col("video_description"),
    }
    mode, lead = "force" if force else "fill", "provenance.earliest_known_url"
    rules = {f: Rule(mode, lead if not force and f in ("provenance.earliest_known_date", _STATUS) else None) for f in own}
    named = {"source.uploader_name": F.col("official"), _NAME: F.col("official"), _KIND: F.lit("news outlet"), _SAME: F.lit("true")}
    merged = merge(state.values, stacked(records, own).union(stacked(records, named, F.col("official").isNotNull())), rules | {f: Rule("force") for f in named})
    file, said = F.col("source_file"), F.col("video_transcript")
    fixed = _evidence_rows(
        records,
        _of("claim_text", file, F.col("claim"), "motivation.claimed_framing"),
        _of("dataset_video_metadata", file, F.lit(RECORD_METADATA), *TOLD_BY_RECORD),
        _of("fact_check_article", F.col("url"), trimmed(F.col("content"), 2000)),
        F.when(F.coalesce(F.trim(said), F.lit("")) != "", _of("dataset_transcript", file, trimmed(said, 2000))),
    )
    cited = records.select("claim_id", "url", F.explode("references").alias("r")).select("claim_id", F.struct(F.lit("fact_check_evidence").alias("type"), F.coalesce(F.get("r.refs", 0), "url").alias("source"), trimmed(F.col("r.text"), 2000).alias("observation"), F.array().cast("array<string>").alias("fields")).alias("x")).select("claim_id", "x.*")
    # The status is merged by itself, and the record's own evidence named, so that links don't take all values and evidence along.
    few = [lead, _STATUS]
    status = merge(state.values.filter(F.col("field").isin(few)), stacked(records, {f: own[f] for f in few}), {f: rules[f] for f in few})
    moved = status.filter((F.col("field") == _STATUS) & F.col("decision").isin("filled", "replaced", "same")).select(*KEY)
    names = stacked(records, named, F.col("official").isNotNull()).select(*KEY)
    kind = "dataset_video_metadata"
    its_own = records.select("claim_id", _identity(F.lit(kind), file, F.lit(RECORD_METADATA), F.lit(None).cast("string")).alias("evidence_id")).distinct()
    held = state.evidence.filter(F.col("type") == kind).select("claim_id", "evidence_id")
    metadata = held.union(its_own.join(state.evidence.select("claim_id", "evidence_id"), ["claim_id", "evidence_id"], "left_anti"))
    return with_evidence(State(merged.select(*KEY, "value"), state.evidence, state.links), fixed.union(cited), ["asr_transcript"], moved.union(names).join(metadata, "claim_id").select(*KEY, "evidence_id"))


#: Fields that a new reading of the texts starts from nothing, and the types of evidence that vouch for a name of a source.
READ_ANEW = ["provenance.provenance_mismatch", "source.source_mismatch", "date.claimed_date", "date.estimated_date", "date.capture_date_granularity", "date.date_mismatch_type", "location.claimed_location", "location.verified_location", "location.location_mismatch_type", "motivation.original_context_category", "motivation.motivation_mismatch_type"]
VOUCHING = ["provenance_image_candidate", "provenance_search_candidate"]


def vouched(state: State, field: str, kinds: list[str]) -> DataFrame:
    """claim_id of the claims whose field is linked with evidence of one of the types."""
    own = state.evidence.filter(F.col("type").isin(kinds)).select("claim_id", "evidence_id")
    return state.links.filter(F.col("field") == field).join(own, ["claim_id", "evidence_id"], "left_semi").select("claim_id").distinct()


def reset_texts(state: State, platforms: DataFrame, seen_places: DataFrame) -> State:
    """The state before the texts of a claim are read again: what a reading finds goes, and so do its links.

    platforms: (claim_id, platform), a row for each claim. seen_places: (claim_id, value), the JSON list of places that
    frames show; `[]` for claims without. What search has found stays: the status of an earlier version with its
    context, and a source's name with evidence in VOUCHING. A publisher's own platform names the source.
    """
    kept = state.values.filter((F.col("field") == _STATUS) & (F.col("value") == EARLIER)).select("claim_id", F.lit(True).alias("earlier"))
    rows = official_source(platforms).join(kept, "claim_id", "left").join(seen_places.select("claim_id", F.col("value").alias("places")), "claim_id", "left")
    rows = rows.join(vouched(state, _NAME, VOUCHING).withColumn("vouched", F.lit(True)), "claim_id", "left")
    earlier, known, official = F.coalesce("earlier", F.lit(False)), F.coalesce("vouched", F.lit(False)), F.col("official").isNotNull()
    null = F.lit(None).cast("string")
    new = stacked(rows, {**dict.fromkeys(READ_ANEW, null), _KIND: F.when(official, "news outlet"), _SAME: F.when(official, "true"), "location.candidate_locations": F.coalesce("places", F.lit("[]"))})
    context = stacked(rows, {_CONTEXT: null, _STATUS: F.lit("unknown")}, ~earlier)
    name = stacked(rows, {_NAME: F.col("official")}, official | ~known)
    merged = merge(state.values, new.union(context).union(name), {f: Rule("force") for f in [*READ_ANEW, _KIND, _SAME, "location.candidate_locations", _CONTEXT, _STATUS, _NAME]})
    unnamed = stacked(rows, {_KIND: null, _SAME: null}, ~official).union(stacked(rows, {_NAME: null}, ~official & ~known))
    dropped = stacked(rows, dict.fromkeys(READ_ANEW, null)).union(stacked(rows, {_CONTEXT: null}, ~earlier)).union(unnamed)
    return State(merged.select(*KEY, "value"), state.evidence, relinked(state.links, state.links.limit(0), dropped))


#: Where a platform's own metadata go.
METADATA_FIELDS = {"uploader_name": "source.uploader_name", "uploader_profile": "source.uploader_profile", "upload_date": "date.video_upload_date", "title": "motivation.original_caption", "description": "motivation.original_description"}


def web_metadata(state: State, records: DataFrame, found: DataFrame) -> State:
    """The state after a video's page and its archive were asked.

    First the fields of METADATA_FIELDS are those of the record again, then what the page tells replaces them, and an
    account in the link names the uploader where nothing else does. An archived copy before the earliest known date
    becomes the earliest place. records: as of bootstrap. found: claim_id, page_url, the columns of METADATA_FIELDS,
    archive_date, archive_url, archive_snapshot; all null where nothing was found.
    """
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    own = official_source(records)
    restored = merge(state.values, stacked(own, {
        "source.uploader_name": F.col("official"), "source.uploader_profile": F.lit(None), "date.video_upload_date": plain_date(F.col("video_date")),
        "motivation.original_caption": F.col("video_headline"), "motivation.original_description": F.col("video_description"),
    }), {f: Rule("force") for f in METADATA_FIELDS.values()})
    told = merge(restored, stacked(found, {f: filled(c) for c, f in METADATA_FIELDS.items()}), {f: Rule("update") for f in METADATA_FIELDS.values()})
    rows = records.select("claim_id", "video_url", "source_file").join(found, "claim_id")
    link = F.coalesce(filled("video_url"), "page_url", "source_file")
    guess = rows.select("claim_id", link.alias("link"), uploader(link).alias("account"), account_page(link).alias("page"))
    spots = {"source.uploader_name": F.col("account"), "source.uploader_profile": F.col("page")}
    # An empty name is none, as for what a page tells.
    known = told.withColumn("value", F.when(F.col("field").isin(list(spots)), F.nullif(F.col("value"), F.lit(""))).otherwise(F.col("value")))
    inferred = merge(known, stacked(guess, spots).filter("value IS NOT NULL"), {f: Rule("fill") for f in spots})
    values = inferred.select(*KEY, "value")
    place = wide(values.filter("field = 'provenance.earliest_known_date'"), {"known": "provenance.earliest_known_date"})
    archived = found.filter("archive_date IS NOT NULL").join(place, "claim_id", "left")
    first = (F.coalesce(F.col("known"), F.lit("")) == "") | (F.col("archive_date") < F.col("known"))
    dated = stacked(archived, {"date.earliest_online_date": F.col("archive_date")}).union(stacked(archived, {"provenance.earliest_known_date": F.col("archive_date"), "provenance.earliest_known_url": F.col("archive_url")}, first))
    values = merge(values, dated, {f: Rule("force") for f in ("date.earliest_online_date", "provenance.earliest_known_date", "provenance.earliest_known_url")}).select(*KEY, "value")
    given = F.filter(F.array(*(F.when(filled(c).isNotNull(), F.lit(f)) for c, f in METADATA_FIELDS.items())), lambda f: f.isNotNull())
    page = rows.select("claim_id", F.lit("platform_metadata").alias("type"), F.coalesce("page_url", "source_file").alias("source"), F.lit(METADATA_FOUND).alias("observation"), given.alias("fields"))
    guessed = inferred.filter(F.col("field").isin(list(spots)) & (F.col("decision") == "filled")).groupBy("claim_id").agg(F.collect_set("field").alias("fields"))
    pattern = guess.join(guessed, "claim_id").select("claim_id", F.lit("uploader_url_pattern").alias("type"), F.col("link").alias("source"), F.lit(NAME_INFERRED).alias("observation"), "fields")
    snapshot = archived.select("claim_id", F.lit("archive_record").alias("type"), F.col("archive_snapshot").alias("source"), F.lit(SNAPSHOT).alias("observation"), F.array(*map(F.lit, ["provenance.earliest_known_url", "provenance.earliest_known_date", "date.earliest_online_date"])).alias("fields"))
    return with_evidence(State(values, state.evidence, state.links), page.union(pattern).union(snapshot), ["platform_metadata", "uploader_url_pattern"])


#: States of a review in which nobody has decided anything yet.
UNREVIEWED = ["not_started", "automated"]
_CLAIMED, _VERIFIED, _LISTED, _DIFFERS, _SPOT = (f"location.{f}" for f in ("claimed_location", "verified_location", "candidate_locations", "location_mismatch_type", "verified_coordinates"))


def _place(value: Column) -> Column:
    return folded(clean_place(F.coalesce(value, F.lit(""))))


def chosen_places(candidates: DataFrame) -> DataFrame:
    """claim_id, claimed, verified: the one place that the claim names, and the one with most support besides the claim's, of two groups at least.

    candidates: claim_id, name, sources, event_groups (arrays). Several that could be chosen give null.
    """
    support = F.size(F.array_distinct(F.array_remove(F.coalesce("event_groups", "sources"), "claim")))
    rows = candidates.withColumns({"said": F.array_contains(F.coalesce("event_sources", "sources"), "claim"), "support": support})
    most = rows.filter("support >= 2").groupBy("claim_id").agg(F.max("support").alias("most"))
    rows = rows.join(most, "claim_id", "left")
    best = F.coalesce(F.col("support") == F.col("most"), F.lit(False))
    of = rows.groupBy("claim_id").agg(F.count_if("said").alias("n_said"), F.max(F.when(F.col("said"), F.col("name"))).alias("one_said"), F.count_if(best).alias("n_best"), F.max(F.when(best, F.col("name"))).alias("one_best"))
    return of.select("claim_id", F.when(F.col("n_said") == 1, F.col("one_said")).alias("claimed"), F.when(F.col("n_best") == 1, F.col("one_best")).alias("verified"))


def merge_places(state: State, candidates: DataFrame, former: DataFrame, reviews: DataFrame, model: str | None = None) -> State:
    """The state after places were found in a claim's texts.

    candidates: claim_id, seq, name, sources, event_sources, event_groups (arrays), source (of the first mention).
    former: (claim_id, name) that this stage had found before. reviews: (claim_id, status), a row for each claim.
    A plausible place that other evidence vouches for, or that somebody has reviewed, stays against the stage's choice.
    Coordinates and mismatch stay while both places do. The list of places has the new ones in order, then the other
    plausible ones of before that weren't the stage's own, then the chosen ones where they aren't among these.
    """
    own_kind = "location_text_candidate"
    theirs = state.evidence.filter(F.col("type") == own_kind).select("claim_id", "evidence_id")
    foreign = state.links.filter(F.col("field").isin(_CLAIMED, _VERIFIED)).join(theirs, ["claim_id", "evidence_id"], "left_anti").select(*KEY).distinct()
    decided = reviews.filter(F.col("status").isNotNull() & ~F.col("status").isin(UNREVIEWED)).select("claim_id")
    held = state.values.filter(F.col("field").isin(_CLAIMED, _VERIFIED) & F.coalesce(place_is_plausible(F.col("value")), F.lit(False))).select(*KEY)
    protected = held.join(foreign, KEY, "left_semi").union(held.join(decided, "claim_id", "left_semi")).distinct()

    chosen = reviews.select("claim_id").join(chosen_places(candidates), "claim_id", "left")
    named = _evidence_names(candidates, model)
    found = with_evidence(state, named, [own_kind])
    merged = merge(state.values, stacked(chosen, {_CLAIMED: F.col("claimed"), _VERIFIED: F.col("verified")}), {_CLAIMED: Rule("force"), _VERIFIED: Rule("force")}, protected)
    merged = invalidated(merged, {_DIFFERS: [_CLAIMED, _VERIFIED], _SPOT: [_CLAIMED, _VERIFIED]}, _place)
    now = wide(merged, {"claimed": _CLAIMED, "verified": _VERIFIED})
    was = wide(state.values, {"was_claimed": _CLAIMED, "was_verified": _VERIFIED, "listed": _LISTED})
    rows = now.join(was, "claim_id", "left")
    both = (F.coalesce("claimed", F.lit("")) != "") & (F.coalesce("verified", F.lit("")) != "")
    same = rows.filter(both & (_place(F.col("claimed")) == _place(F.col("verified"))))
    values = merge(merged, stacked(same, {_DIFFERS: F.lit("same")}), {_DIFFERS: Rule("force")}).select(*KEY, "value")

    # The list: rank 0 for the stage's own, 1 for those of before, 2 for the chosen ones; the first spelling of a name holds.
    new = candidates.select("claim_id", F.lit(0).alias("rank"), F.col("seq").cast("long").alias("at"), "name")
    before = rows.select("claim_id", F.posexplode(F.from_json("listed", "array<string>")).alias("at", "name")).select("claim_id", F.lit(1).alias("rank"), F.col("at").cast("long").alias("at"), clean_place(F.col("name")).alias("name"))
    before = before.filter(F.coalesce(place_is_plausible(F.col("name")), F.lit(False))).withColumn("key", _place(F.col("name")))
    before = before.join(former.select("claim_id", _place(F.col("name")).alias("key")).distinct(), ["claim_id", "key"], "left_anti").select("claim_id", "rank", "at", "name")
    picked = rows.select("claim_id", F.lit(2).alias("rank"), F.posexplode(F.array("claimed", "verified")).alias("at", "name")).filter(F.coalesce("name", F.lit("")) != "").select("claim_id", "rank", F.col("at").cast("long").alias("at"), "name")
    one = new.union(before).union(picked).groupBy("claim_id", folded(F.col("name")).alias("key")).agg(F.min(F.struct("rank", "at", "name")).alias("x"))
    lists = one.groupBy("claim_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"])).alias("list"))
    lists = reviews.select("claim_id").join(lists, "claim_id", "left")
    values = merge(values, stacked(lists, {_LISTED: F.coalesce("list", F.lit("[]"))}), {_LISTED: Rule("force")}).select(*KEY, "value")

    # A chosen place rests on its own evidence; so does `same`, where a place has just changed.
    ids = named.select("claim_id", F.col("name"), ev.labelled_identity(F.col("type"), F.col("source"), F.col("observation"), F.col("model")).alias("evidence_id"), folded(F.col("name")).alias("key"))
    picks = merged.filter(F.col("field").isin(_CLAIMED, _VERIFIED) & ~F.col("decision").isin("protected", "kept") & F.col("value").isNotNull())
    rests = picks.select("claim_id", "field", _place(F.col("value")).alias("key")).join(ids.select("claim_id", "key", "evidence_id"), ["claim_id", "key"])
    moved = rows.filter((_place(F.col("claimed")) != _place(F.col("was_claimed"))) | (_place(F.col("verified")) != _place(F.col("was_verified")))).select("claim_id")
    agree = rests.join(same.select("claim_id"), "claim_id", "left_semi").join(moved, "claim_id", "left_semi").select("claim_id", F.lit(_DIFFERS).alias("field"), "evidence_id")
    return State(values, found.evidence, relinked(found.links, rests.select(*KEY, "evidence_id").union(agree)))


def _evidence_names(candidates: DataFrame, model: str | None) -> DataFrame:
    said = F.concat(F.lit("Supported by: "), F.array_join("sources", ", "))
    return candidates.select("claim_id", F.lit("location_text_candidate").alias("type"), F.coalesce("source", F.lit("")).alias("source"), said.alias("observation"), F.array(F.lit(_LISTED)).alias("fields"), F.lit(model).cast("string").alias("model"), "name")
