"""The verdict of a claim: a judge's decisions and reviews, held against the findings that they are about.

Everything is rows by claim, component and pillar. Decisions and components have to match one to one, and so do reviews
and the assessments that need one: what doesn't is an error row, and its claim gets no verdict. A review may confirm,
downgrade or resolve a finding, but not reverse it; its citations count where the evidence holds and may carry them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .evidence import DECISIVE
from .verdicts import CONFLICT, NO_EVIDENCE, may_support

COMPONENT = ["claim_id", "component_id"]
PILLAR = [*COMPONENT, "pillar"]
#: The order of assessments within a component.
PILLARS = ["core", "provenance", "source", "date", "location", "motivation"]
#: What is said of a rating or a review that doesn't hold.
NO_RATING = "Insufficient grounded evidence for the proposed rating."
NO_OVERALL = "Insufficient grounded evidence for the proposed overall rating."
REVERSED = "Reviews cannot reverse a known finding"
KNOWN = ["supported", "refuted"]


class Judged(NamedTuple):
    """assessments (with the reviews merged in), citations (of the conclusive ones), components, claims, errors and review_errors."""

    assessments: DataFrame
    citations: DataFrame
    components: DataFrame
    claims: DataFrame
    errors: DataFrame
    review_errors: DataFrame


def place_of(pillar: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PILLARS)), pillar)


def decision_errors(components: DataFrame, decisions: DataFrame) -> DataFrame:
    """claim_id, component_id, problem of each component that hasn't exactly one decision, and of each decision without a component.

    problem: missing, doubled or unknown. A full outer join of both counts, with partial counts before the shuffle.
    """
    have = components.select(*COMPONENT).distinct().withColumn("expected", F.lit(True))
    given = decisions.groupBy(*COMPONENT).agg(F.count(F.lit(1)).alias("n"))
    both = have.join(given, COMPONENT, "full_outer")
    problem = F.when(F.col("expected").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "doubled")
    return both.select(*COMPONENT, problem.alias("problem")).filter("problem IS NOT NULL")


def review_key_errors(assessments: DataFrame, reviews: DataFrame) -> DataFrame:
    """claim_id, component_id, pillar, problem (unreviewed or uncalled-for) where reviews and the assessments that need one don't match."""
    needed = assessments.filter("status <> 'not_applicable'").select(*PILLAR).withColumn("needed", F.lit(True))
    both = needed.join(reviews.select(*PILLAR).distinct().withColumn("given", F.lit(True)), PILLAR, "full_outer")
    return both.filter("needed IS NULL OR given IS NULL").select(*PILLAR, F.when(F.col("given").isNull(), "unreviewed").otherwise("uncalled-for").alias("problem"))


def usable(citations: DataFrame, evidence: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """The citations (claim_id, component_id, pillar, side, evidence_id, quote) that may carry a finding of their pillar, each once.

    The quote has eight characters or more and stands in the evidence, and with `shown` (claim_id, evidence_id, text) also
    in what of it was shown. Evidence is verified and of a type that may decide, but for frames on core and location.
    """
    quote = F.trim("quote")
    cited = citations.filter(F.char_length(quote) >= 8).select(*PILLAR, "side", "evidence_id", quote.alias("quote")).distinct()
    held = cited.join(evidence.select("claim_id", "evidence_id", "type", "verified", "text"), ["claim_id", "evidence_id"])
    frames = F.col("pillar").isin("core", "location") & (F.col("type") == "keyframe_analysis")
    sound = F.coalesce(F.col("verified"), F.lit(False)) & F.col("type").isin(DECISIVE)
    held = held.filter(may_support(F.col("pillar"), F.col("type")) & (frames | sound) & F.contains(text.normalised(F.col("text")), text.normalised(F.col("quote"))))
    if shown is not None:
        seen = shown.select("claim_id", "evidence_id", F.col("text").alias("seen"))
        held = held.join(seen, ["claim_id", "evidence_id"]).filter(F.contains(text.normalised(F.col("seen")), text.normalised(F.col("quote"))))
    return held.select(*PILLAR, "side", "evidence_id", "quote")


def _sides(citations: DataFrame) -> DataFrame:
    return citations.groupBy(*PILLAR).agg(F.count_if(F.col("side") == "supports").alias("n_for"), F.count_if(F.col("side") == "refutes").alias("n_against"))


def reviewed(assessments: DataFrame, reviews: DataFrame, review_citations: DataFrame, own_citations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assessments with their reviews merged in, the citations that they rest on then, and errors of reviews.

    assessments: claim_id, component_id, pillar, status, explanation. reviews: the same and error (null for a review
    that keeps its contract). review_citations: usable ones. own_citations: those of the assessments. An assessment keeps
    what it says where its review breaks the contract or would reverse it; `corrected` marks these, and reviews whose
    status their citations don't bear.
    """
    r = reviews.select(*PILLAR, F.col("status").alias("r_status"), F.col("explanation").alias("r_said"), "error")
    both = assessments.filter("status <> 'not_applicable'").join(r, PILLAR).join(_sides(review_citations), PILLAR, "left")
    n_for, n_against = F.coalesce("n_for", F.lit(0)), F.coalesce("n_against", F.lit(0))
    reverses = F.col("status").isin(KNOWN) & (F.col("r_status") != F.col("status")) & (F.col("r_status") != "unknown")
    problem = F.when(reverses, REVERSED).otherwise(F.col("error"))
    both = both.withColumns({"problem": problem, "split": (n_for > 0) & (n_against > 0), "bare": ((F.col("r_status") == "supported") & (n_for == 0)) | ((F.col("r_status") == "refuted") & (n_against == 0))})
    kept, status = F.col("problem").isNotNull(), F.when(F.col("split") | F.col("bare"), "unknown").otherwise(F.col("r_status"))
    said = text.plain(F.when(F.col("split"), CONFLICT).when(F.col("bare"), NO_EVIDENCE).otherwise(F.col("r_said")))
    merged = both.select(
        *PILLAR, F.when(kept, F.col("status")).otherwise(status).alias("status"), F.when(kept, F.col("explanation")).otherwise(said).alias("explanation"),
        (~kept).alias("by_judge"), (kept | (status != F.col("r_status"))).alias("corrected"), "problem",
    )
    aside = assessments.filter("status = 'not_applicable'").select(*PILLAR, "status", "explanation", F.lit(False).alias("by_judge"), F.lit(False).alias("corrected"))
    judged, old = merged.filter("by_judge").select(*PILLAR), merged.filter("NOT by_judge").select(*PILLAR)
    rests = review_citations.join(judged, PILLAR, "left_semi").union(own_citations.select(review_citations.columns).join(old, PILLAR, "left_semi"))
    return merged.drop("problem").union(aside), rests, merged.filter("problem IS NOT NULL").select(*PILLAR, F.col("problem").alias("message"))


def _counted(assessments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Assessments that bear on the verdict: without the provenance of components that don't require it."""
    free = decisions.filter("NOT provenance_required").select(*COMPONENT, F.lit("provenance").alias("pillar"))
    return assessments.join(free, PILLAR, "left_anti")


def component_verdicts(assessments: DataFrame, decisions: DataFrame) -> DataFrame:
    """claim_id, component_id, verdict, proposed, explanation, changed, and what the claim's verdict needs: core, unknown, refuted.

    A proposed TRUE needs a supported core and neither unknown nor refuted assessments, FALSE a refuted one; else the
    verdict is NEI. Where the proposal or an assessment was corrected, the explanation tells the first two different
    reasons of unknown and refuted assessments.
    """
    counted = _counted(assessments, decisions)
    open_ones = F.col("status").isin("unknown", "refuted")
    of = counted.groupBy(*COMPONENT).agg(
        F.coalesce(F.bool_or((F.col("pillar") == "core") & (F.col("status") == "supported")), F.lit(False)).alias("core"), F.bool_or(F.col("status") == "unknown").alias("unknown"), F.bool_or(F.col("status") == "refuted").alias("refuted"),
        F.max(F.when(F.col("pillar") == "core", F.col("explanation"))).alias("core_said"),
        F.array_sort(F.collect_list(F.when(open_ones, F.struct(place_of(F.col("pillar")).alias("at"), "explanation")))).alias("reasons"),
    )
    corrected = assessments.groupBy(*COMPONENT).agg(F.bool_or("corrected").alias("corrected"))
    rows = decisions.select(*COMPONENT, F.col("verdict").alias("proposed"), F.col("explanation").alias("said")).join(of, COMPONENT).join(corrected, COMPONENT)
    holds = F.when(F.col("proposed") == "FALSE", F.col("refuted")).when(F.col("proposed") == "TRUE", F.col("core") & ~F.col("unknown") & ~F.col("refuted")).otherwise(F.lit(True))
    rows = rows.withColumn("verdict", F.when(holds, F.col("proposed")).otherwise("NEI")).withColumn("changed", F.col("corrected") | (F.col("proposed") != F.col("verdict")))
    told = F.array_join(F.slice(F.array_distinct(F.transform("reasons", lambda x: x["explanation"])), 1, 2), " ")
    instead = F.coalesce(F.nullif(told, F.lit("")), F.when(F.col("verdict") == "NEI", NO_RATING).otherwise(F.col("core_said")))
    return rows.select(*COMPONENT, "verdict", "proposed", F.when(F.col("changed"), instead).otherwise(text.plain(F.col("said"))).alias("explanation"), "changed", "core", "unknown", "refuted")


def claim_verdicts(components: DataFrame, verdicts: DataFrame) -> DataFrame:
    """claim_id, verdict, explanation of claims (claim_id, verdict, explanation: as proposed) from their components' verdicts.

    components: claim_id, component_id, place. A proposed TRUE needs every core supported, nothing unknown or refuted and
    no component left at NEI, FALSE something refuted. Where anything was corrected, the explanations of the components with the
    claim's verdict stand for its own.
    """
    placed = verdicts.join(components.select(*COMPONENT, "place"), COMPONENT)
    return placed.groupBy("claim_id").agg(
        F.bool_and("core").alias("core"), F.bool_or("unknown").alias("unknown"), F.bool_or("refuted").alias("refuted"), F.bool_or(F.col("verdict") == "NEI").alias("open"), F.bool_or("changed").alias("changed"),
        F.array_sort(F.collect_list(F.struct("place", "verdict", "explanation"))).alias("told"),
    )


def overall(claims: DataFrame, of: DataFrame) -> DataFrame:
    rows = claims.select("claim_id", F.col("verdict").alias("proposed"), F.col("explanation").alias("said")).join(of, "claim_id")
    true = F.col("core") & ~F.col("unknown") & ~F.col("refuted") & ~F.col("open")
    holds = F.when(F.col("proposed") == "FALSE", F.col("refuted")).when(F.col("proposed") == "TRUE", true).otherwise(F.lit(True))
    rows = rows.withColumn("verdict", F.when(holds, F.col("proposed")).otherwise("NEI"))
    same = F.array_join(F.transform(F.filter("told", lambda x: x["verdict"] == F.col("verdict")), lambda x: x["explanation"]), " ")
    changed = F.col("changed") | (F.col("proposed") != F.col("verdict"))
    return rows.select("claim_id", "verdict", "proposed", F.when(changed, F.coalesce(F.nullif(same, F.lit("")), F.lit(NO_OVERALL))).otherwise(text.plain(F.col("said"))).alias("explanation"))


def questions(claims: DataFrame, components: DataFrame, verdicts: DataFrame, asked: DataFrame, failed: DataFrame, with_context: DataFrame) -> DataFrame:
    """claim_id, place, question: what is left open in claims (claim_id, verdict) at NEI where the judge asked nothing, else what it asked.

    components: claim_id, component_id, place, text. verdicts: of component_verdicts. asked: claim_id, place, question.
    failed: claim_id, pillar, place of analyses that failed on an open finding. with_context: claim_id of the claims
    with information on their video. First comes one question on the failed analyses or, without any, on the video, then
    one for each component at NEI, or for every one if none is.
    """
    judged = asked.join(claims.select("claim_id"), "claim_id", "left_semi").select("claim_id", F.col("place").cast("long").alias("place"), text.plain(F.col("question")).alias("question"))
    silent = claims.filter("verdict = 'NEI'").select("claim_id").join(asked.select("claim_id").distinct(), "claim_id", "left_anti")
    names = failed.groupBy("claim_id", "pillar").agg(F.min("place").alias("place")).groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "pillar"))), lambda x: x["pillar"]), ", ").alias("names"))
    led = silent.join(names, "claim_id", "left").join(with_context.select("claim_id").distinct().withColumn("seen", F.lit(True)), "claim_id", "left")
    first = F.when(F.col("names").isNotNull(), F.concat(F.lit("What independent evidence can resolve the unknown findings after the "), "names", F.lit(" agent analyses failed?"))).when(F.col("seen"), "Which independent evidence corroborates the claim beyond the available video information?")
    lead = led.select("claim_id", F.lit(-1).cast("long").alias("place"), first.alias("question")).filter("question IS NOT NULL")
    placed = components.join(silent, "claim_id", "left_semi").join(verdicts.select(*COMPONENT, (F.col("verdict") == "NEI").alias("open")), COMPONENT)
    some = placed.groupBy("claim_id").agg(F.bool_or("open").alias("some"))
    each = placed.join(some, "claim_id").filter("open OR NOT some").select("claim_id", F.col("place").cast("long").alias("place"), text.plain(F.concat(F.lit("What evidence would verify this claim: "), "text", F.lit("?"))).alias("question"))
    return judged.union(lead).union(each)


def judge(components: DataFrame, claims: DataFrame, decisions: DataFrame, assessments: DataFrame, citations: DataFrame, reviews: DataFrame, review_citations: DataFrame, evidence: DataFrame, shown: DataFrame) -> Judged:
    """Verdicts of claims by a judge's answer.

    components: claim_id, component_id, place, text. claims: claim_id, verdict, explanation. decisions: claim_id,
    component_id, verdict, explanation, provenance_required. assessments, reviews and their citations as for reviewed and usable.
    evidence: claim_id, evidence_id, type, verified, text; shown: what of it the judge was shown. A claim with an error
    gets no verdict; its errors say why, by component and pillar.
    """
    none = F.lit(None).cast("string")
    wrong = decision_errors(components, decisions).select(*COMPONENT, none.alias("pillar"), "problem")
    sound = wrong.select("claim_id").distinct()
    wrong = wrong.union(review_key_errors(assessments, reviews).join(sound, "claim_id", "left_anti"))
    broken = wrong.select("claim_id").distinct()
    whole = lambda df: df.join(broken, "claim_id", "left_anti")
    decided = whole(decisions)
    merged, rests, review_errors = reviewed(whole(assessments), whole(reviews), usable(whole(review_citations), evidence, shown), whole(citations))
    conclusive = _counted(merged, decided).filter(F.col("status").isin(KNOWN)).select(*PILLAR, F.when(F.col("status") == "supported", "supports").otherwise("refutes").alias("side"))
    carried = usable(rests.join(conclusive, [*PILLAR, "side"], "left_semi"), evidence)
    unheld = conclusive.join(carried, [*PILLAR, "side"], "left_anti").select(*PILLAR, F.lit("without valid evidence").alias("problem"))
    lost = unheld.select("claim_id").distinct()
    held = lambda df: df.join(lost, "claim_id", "left_anti")
    verdicts = held(component_verdicts(merged, decided))
    result = overall(claims, claim_verdicts(components, verdicts))
    return Judged(held(merged), held(carried), verdicts, result, wrong.union(unheld), review_errors)
