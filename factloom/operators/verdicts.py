"""Assessments of a claim's components, what may support them, and the verdict over all components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an assessment says when nothing else can be said.
NO_EVIDENCE = "Insufficient independently grounded evidence."
NOT_ASKED = "The claim does not assert this dimension."
CONFLICT = "Supporting and refuting evidence remain in conflict."
#: The labels that each verdict sums up.
LABELS = {"TRUE": ["True", "Mostly True", "Correct Attribution"], "FALSE": ["False", "Miscaptioned", "Mixture", "Fake", "Mostly False"], "NEI": []}


def assessed(status: Column, supporting: Column, refuting: Column, applies: Column, said: Column, most: int = 1500) -> dict[str, Column]:
    """Status and explanation of an assessment. supporting, refuting: how many valid citations stand on each side.

    A status holds only with a citation on its side and none on the other.
    """
    both = (supporting > 0) & (refuting > 0)
    held = (status == "supported") & (supporting > 0) | (status == "refuted") & (refuting > 0)
    kept = F.coalesce(held & ~both, F.lit(False))
    plain = F.coalesce(kept | ((status == "unknown") & ~both), F.lit(False))
    found = F.when(~applies, "not_applicable").when(kept, status).otherwise("unknown")
    aside = F.when(status == "not_applicable", said).otherwise(NOT_ASKED)
    return {"status": found, "explanation": F.when(~applies, aside).when(plain, F.substring(said, 1, most)).when(both, CONFLICT).otherwise(NO_EVIDENCE)}


def may_support(pillar: Column, kind: Column) -> Column:
    """Whether evidence of a type can carry a verdict's citation for a pillar."""
    return (kind == "retrieved_page") | ((pillar == "source") & (kind == "platform_metadata")) | (pillar.isin("core", "location") & (kind == "keyframe_analysis"))


def of_claims(components: DataFrame, claim: str, core: str, pillars: str, provenance: str, required: str) -> DataFrame:
    """claim, verdict: FALSE if any assessment of any component is refuted; TRUE if every core is supported and nothing is unknown; else NEI.

    The provenance of a component counts where it is required. Each component is folded in its row, so a claim is one
    aggregation with partial results.
    """
    every = F.concat(F.array(core), F.col(pillars), F.when(F.col(required), F.array(provenance)).otherwise(F.array().cast("array<string>")))
    rows = components.select(claim, F.exists(every, lambda s: s == "refuted").alias("refuted"), F.exists(every, lambda s: s == "unknown").alias("unknown"), (F.col(core) == "supported").alias("core"))
    of = rows.groupBy(claim).agg(F.bool_or("refuted").alias("refuted"), F.bool_or("unknown").alias("unknown"), F.bool_and("core").alias("core"))
    return of.select(claim, F.when(F.col("refuted"), "FALSE").when(F.col("core") & ~F.col("unknown"), "TRUE").otherwise("NEI").alias("verdict"))
