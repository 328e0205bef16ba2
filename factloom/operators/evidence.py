"""Evidence tables: identity, dedup with upgrade, and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised


#: The types of evidence that can decide.
DECISIVE = ["retrieved_page", "platform_metadata", "archive_record", "geocoder_result"]


#: Characters that a JSON string literal spells in another way.
ESCAPES = {"\\": "\\\\", '"': '\\"', **{chr(c): {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(c, f"\\u{c:04x}") for c in range(32)}}


def _quoted(text: Column) -> Column:
    """A JSON string literal, non-ASCII characters kept, control characters escaped."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    # Texts with control characters are spelt out; a chain of replacements would be too long for compiled code.
    table = F.create_map(*(F.lit(x) for p in ESCAPES.items() for x in p))
    spelt = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), spelt).otherwise(plain), F.lit('"'))


def identity(source: Column, text: Column) -> Column:
    """ev- and 16 hex digits of the SHA-256 of the JSON array of canonical source and normalised text."""
    return F.concat(F.lit("ev-"), F.substring(F.sha2(F.concat(F.lit("["), _quoted(source), F.lit(", "), _quoted(normalised(text)), F.lit("]")).cast("binary"), 256), 1, 16))


def labelled_identity(kind: Column, source: Column, observation: Column, model: Column) -> Column:
    """The type with dashes and 10 hex digits of the SHA-256 of the JSON array of type, source, observation and model."""
    parts = F.concat(F.lit("["), _quoted(kind), F.lit(", "), _quoted(source), F.lit(", "), _quoted(observation), F.lit(", "), F.coalesce(_quoted(model), F.lit("null")), F.lit("]"))
    return F.concat(F.replace(kind, F.lit("_"), F.lit("-")), F.lit("-"), F.substring(F.sha2(parts.cast("binary"), 256), 1, 10))


def dedup(items: DataFrame, keys: list[str], order: str, verified: str, values: list[str]) -> DataFrame:
    """One row for each key at the place of its first item; values come from the first verified item, if any, else from the first.

    One aggregation with partial results: a key with many items costs each task one row.
    """
    first = F.min(F.struct(order, *values))
    sound = F.min(F.when(F.col(verified), F.struct(order, *values)))
    found = items.groupBy(*keys).agg(first.alias("first"), sound.alias("sound"))
    return found.select(*keys, F.col(f"first.{order}").alias(order), F.col("sound").isNotNull().alias(verified), *(F.coalesce(F.col("sound"), F.col("first"))[v].alias(v) for v in values))


def valid_citations(citations: DataFrame, evidence: DataFrame, decisive: bool) -> DataFrame:
    """Distinct citations (evidence_id, quote) whose quote of 8 characters or more stands in the evidence.

    Decisive ones need verified evidence, of a type in DECISIVE where the evidence has a column `type`.
    """
    quote = F.trim("quote")
    held = evidence.filter("verified") if decisive else evidence
    held = held.filter(F.col("type").isin(DECISIVE)) if decisive and "type" in evidence.columns else held
    met = citations.filter(F.char_length(quote) >= 8).join(held, "evidence_id").filter(F.contains(normalised(F.col("text")), normalised(quote)))
    return met.select("evidence_id", quote.alias("quote")).distinct()


def without_type(evidence: DataFrame, links: DataFrame, kind: str, claim: str = "claim_id") -> tuple[DataFrame, DataFrame]:
    """Evidence and field links after all evidence of one type is taken out; a field whose links are all gone has none."""
    gone = evidence.filter(F.col("type") == kind).select(claim, "evidence_id")
    return evidence.filter(F.coalesce(F.col("type") != kind, F.lit(True))), links.join(gone, [claim, "evidence_id"], "left_anti")
