"""Contracts of JSON answers: a schema as tables, and a walk over VARIANT values that tells where an answer breaks it.

A schema is written as nested Python values and turned into three small tables: nodes (what a value has to be),
properties (what an object holds) and options (the values that a text may have). The walk goes down one level of the
schema at a time, for all answers at once: values are joined with their nodes, what doesn't fit becomes an error row with
its path, and objects and arrays are exploded into the values of the next level. A schema has a fixed depth, so there
are as many levels as that. Answers of many values cost rows, never one large row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import entities, provenance, rules
from .findings import GRANULARITIES, PLACE_MISMATCHES
from .rounds import cut

#: What is said of a value that doesn't fit.
SAYS = {
    "string": "Input should be a valid string", "integer": "Input should be a valid integer", "boolean": "Input should be a valid boolean", "list": "Input should be a valid list", "object": "Input should be a valid dictionary",
    "null": "Input should be None", "text or object": "Input should be a valid string or dictionary", "number": "Input should be a valid number",
    "missing": "Field required", "extra": "Extra inputs are not permitted", "blank": "String should have at least 1 character", "short": "List should have at least 1 item after validation, not 0", "broken": "Invalid JSON",
}


@dataclass(frozen=True)
class Text:
    filled: bool = False
    options: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plain:
    """integer, number, boolean, null, any, or `text or object`."""

    kind: str


@dataclass(frozen=True)
class Maybe:
    of: object


@dataclass(frozen=True)
class Many:
    of: object
    filled: bool = False


@dataclass(frozen=True)
class Keyed:
    """An object whose keys are free, or one of some, and whose values are all alike."""

    of: object
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class Object:
    fields: dict = field(hash=False)
    optional: frozenset = frozenset()


def tables(spark: SparkSession, schema) -> tuple[DataFrame, DataFrame, int]:
    """nodes (node, kind, nullable, filled, options, item), properties (node, key, place, child, required) and the schema's depth. The root is node 0."""
    nodes, properties, deepest = [], [], 0

    def add(x, depth: int) -> int:
        nonlocal deepest
        deepest = max(deepest, depth)
        at = len(nodes)
        nodes.append(None)
        nullable, x = isinstance(x, Maybe), x.of if isinstance(x, Maybe) else x
        kind, filled, options, item = {Text: "string", Many: "list", Object: "object", Keyed: "keyed"}.get(type(x)) or x.kind, getattr(x, "filled", False), None, None
        if isinstance(x, Text) and x.options:
            options = list(x.options)
        if isinstance(x, Keyed) and x.keys:
            options = list(x.keys)
        if isinstance(x, (Many, Keyed)):
            item = add(x.of, depth + 1)
        if isinstance(x, Object):
            for place, (key, child) in enumerate(x.fields.items()):
                properties.append((at, key, place, add(child, depth + 1), key not in x.optional))
        nodes[at] = (at, kind, nullable, filled, options, item)
        return at

    add(schema, 0)
    return (
        spark.createDataFrame(nodes, "node int, kind string, nullable boolean, filled boolean, options array<string>, item int"),
        spark.createDataFrame(properties, "node int, key string, place int, child int, required boolean"), deepest,
    )


def one_of(options: Column) -> Column:
    """Input should be 'a', 'b' or 'c'."""
    quoted = F.transform(options, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    n = F.size(options)
    return F.concat(F.lit("Input should be "), F.when(n == 1, F.get(quoted, 0)).otherwise(F.concat(F.array_join(F.slice(quoted, 1, n - 1), ", "), F.lit(" or "), F.get(quoted, n - 1))))


def _kind(v: Column) -> Column:
    """What a variant is: null, string, boolean, integer, number, list or object."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "VOID", "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.isin("BIGINT", "DECIMAL(38,0)"), "integer").when(s.startswith("ARRAY"), "list").when(s.startswith("OBJECT"), "object")
        .when(s.rlike(r"^DECIMAL\(\d+,0\)$"), "integer").otherwise("number")
    )


def errors(answers: DataFrame, schema, key: str = "id", text: str = "answer") -> DataFrame:
    """key, place, path, message of every value that breaks the schema.

    answers: the key, which is unique, and a JSON text. place orders the errors of an answer: fields as the schema has
    them, then fields that it doesn't know by name, elements as they stand. The path is dotted, $ for the answer itself.
    Null and broken texts are one error. Two values of one key in an object are an error of the whole.
    """
    nodes, properties, depth = tables(answers.sparkSession, schema)
    value = F.try_parse_json(F.col(text))
    rows = answers.select(F.col(key).alias("id"), value.alias("v"), F.array().cast("array<int>").alias("place"), F.array().cast("array<string>").alias("path"), F.lit(0).alias("node"))
    found = rows.filter("v IS NULL").select("id", "place", "path", F.lit(SAYS["broken"]).alias("message"))
    rows = rows.filter("v IS NOT NULL")
    for level in range(depth + 1):
        # Each level is written once, as it is read for its errors and for the next level.
        typed = cut(_typed(rows, nodes))
        if typed.isEmpty():
            break
        found = found.union(typed.filter("message IS NOT NULL").select("id", "place", "path", "message"))
        inner = typed.filter("fits AND is IN ('list', 'object') AND kind IN ('list', 'object', 'keyed')")
        needed = inner.filter("kind = 'object'").select("id", "place", "path", "node", "v").join(F.broadcast(properties.filter("required")).withColumnRenamed("place", "n"), "node")
        lacks = needed.filter(~F.coalesce(F.array_contains(F.json_object_keys(F.to_json("v")), F.col("key")), F.lit(False)))
        found = found.union(lacks.select("id", F.concat("place", F.array("n")).alias("place"), F.concat("path", F.array("key")).alias("path"), F.lit(SAYS["missing"]).alias("message")))
        parts = inner.select("id", "place", "path", "node", "kind", "item", "options", "v").lateralJoin(answers.sparkSession.tvf.variant_explode(F.col("v").outer()).select("pos", F.col("key").alias("name"), F.col("value").alias("inner")))
        parts = parts.withColumn("step", F.coalesce("name", F.col("pos").cast("string"))).join(F.broadcast(properties.select("node", F.col("key").alias("step"), F.col("place").alias("n"), "child")), ["node", "step"], "left")
        parts = parts.withColumns({"deeper": F.concat("path", F.array("step")), "child": F.when(F.col("kind") == "object", F.col("child")).otherwise(F.col("item"))})
        unkeyed = (F.col("kind") == "keyed") & ~F.coalesce(F.expr("array_contains(options, step)"), F.lit(True))
        stray = parts.filter(F.col("child").isNull() | unkeyed)
        found = found.union(stray.select(
            "id", F.concat("place", F.when(F.col("kind") == "keyed", F.array("pos", F.lit(-1))).otherwise(F.array(F.lit(1000) + F.col("pos")))).alias("place"),
            F.when(F.col("kind") == "keyed", F.concat("deeper", F.array(F.lit("[key]")))).otherwise(F.col("deeper")).alias("path"), F.when(F.col("kind") == "keyed", one_of(F.col("options"))).otherwise(SAYS["extra"]).alias("message"),
        ))
        rows = parts.filter("child IS NOT NULL").select("id", F.col("inner").alias("v"), F.concat("place", F.array(F.coalesce("n", "pos"))).alias("place"), F.col("deeper").alias("path"), F.col("child").alias("node"))
    return found.select(F.col("id").alias(key), "place", F.when(F.size("path") == 0, "$").otherwise(F.array_join("path", ".")).alias("path"), "message")


def _typed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The values with what their node asks, what they are, whether that fits, and what is wrong with them."""
    typed = rows.withColumn("is", _kind(F.col("v"))).join(F.broadcast(nodes), "node")
    typed = typed.withColumn("said", F.when(F.col("is") == "string", F.expr("variant_get(v, '$', 'string')")))
    fits = (
        ((F.col("is") == "null") & F.col("nullable")) | (F.col("kind") == "any") | (F.col("is") == F.col("kind")) | ((F.col("kind") == "number") & (F.col("is") == "integer"))
        | ((F.col("kind") == "keyed") & (F.col("is") == "object")) | ((F.col("kind") == "text or object") & F.col("is").isin("string", "object"))
    )
    typed = typed.withColumn("fits", fits)
    wrong = F.when(F.col("kind") == "keyed", SAYS["object"]).otherwise(F.try_element_at(F.create_map(*(F.lit(x) for p in SAYS.items() for x in p)), F.col("kind")))
    unlisted = (F.col("is") == "string") & ~F.coalesce(F.expr("array_contains(options, said)"), F.lit(False))
    message = (
        F.when((F.col("kind") == "string") & F.col("options").isNotNull() & (~F.col("fits") | unlisted), one_of(F.col("options"))).when(~F.col("fits"), wrong)
        .when((F.col("is") == "string") & F.col("filled") & (F.trim("said") == ""), SAYS["blank"])
        .when((F.col("is") == "list") & F.col("filled") & F.expr("variant_get(v, '$[0]') IS NULL"), SAYS["short"])
    )
    return typed.withColumn("message", message).drop("said", "filled", "nullable")


def reports(answers: DataFrame, schema, name: str, key: str = "id", text: str = "answer", most: int = 3) -> DataFrame:
    """key, n_errors, report of each answer that breaks the schema: `name: path: message; ...` of its first errors and the number of the others.

    Spark cuts each answer's errors to the first ones before it shuffles them, and counts them in parts.
    """
    from pyspark.sql import Window

    rows = errors(answers, schema, key, text)
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("place", "path", "message"))).filter(F.col("k") <= most)
    told = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "path", "message"))), lambda x: F.concat(x["path"], F.lit(": "), x["message"])), "; ").alias("told"))
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_errors"))
    rest = F.when(F.col("n_errors") > most, F.concat(F.lit("; "), (F.col("n_errors") - most).cast("string"), F.lit(" more validation errors"))).otherwise("")
    return told.join(counted, key).select(key, "n_errors", F.concat(F.lit(f"{name}: "), "told", rest).alias("report"))


# The contracts of a judge's and of the other answers.

FILLED = Text(filled=True)
_CITATION = Object({"evidence_id": FILLED, "quote": FILLED})
_STATUSES = ("supported", "refuted", "unknown", "not_applicable")


def assessment(applies: bool) -> Object:
    return Object({"status": Text(options=_STATUSES[: 3 if applies else 4]), "explanation": Text(), "supporting_citations": Many(_CITATION), "refuting_citations": Many(_CITATION)})


_NOTE = Maybe(Text())
_LOOSE = Many(Plain("text or object"))
_PILLARS = {
    "provenance": {"provenance_status": Maybe(Text(options=tuple(sorted(provenance.STATUSES)))), "earliest_known_url": _NOTE, "earliest_known_date": _NOTE, "near_duplicate_matches": _LOOSE, "previous_context_summary": _NOTE, "provenance_mismatch": Maybe(Plain("boolean"))},
    "source": {"uploader_name": _NOTE, "uploader_profile": _NOTE, "original_source_name": _NOTE, "source_type": Maybe(Text(options=tuple(sorted(entities.KINDS)))), "source_is_uploader": Maybe(Plain("boolean")), "source_mismatch": Maybe(Plain("boolean"))},
    "date": {"claimed_date": _NOTE, "video_upload_date": _NOTE, "earliest_online_date": _NOTE, "estimated_date": _NOTE, "capture_date_granularity": Maybe(Text(options=tuple(sorted(GRANULARITIES)))), "date_mismatch_type": Maybe(Text(options=tuple(sorted(rules.DATE_MISMATCHES))))},
    "location": {"claimed_location": _NOTE, "candidate_locations": _LOOSE, "visual_location_clues": _LOOSE, "verified_location": _NOTE, "verified_coordinates": Plain("null"), "location_mismatch_type": Maybe(Text(options=tuple(sorted(PLACE_MISMATCHES))))},
    "motivation": {"claimed_framing": _NOTE, "original_caption": _NOTE, "original_description": _NOTE, "original_context_category": Maybe(Text(options=tuple(sorted(rules.CONTEXTS)))), "motivation_mismatch_type": Maybe(Text(options=tuple(sorted(rules.FRAMINGS))))},
}
REVIEWED = ("core", *_PILLARS)
VERDICT = Object({
    "verdict": Text(options=("TRUE", "FALSE", "NEI")), "explanation": Text(), "open_questions": Many(Text()),
    "component_verdicts": Many(Object({"component_id": FILLED, "verdict": Text(options=("TRUE", "FALSE", "NEI")), "explanation": Text(), "provenance_required": Plain("boolean"), "assessment_reviews": Keyed(assessment(True), REVIEWED)}, frozenset({"provenance_required"})), filled=True),
})
CLAIM = Object({"normalized_claim": FILLED, "claim_components": Many(Object({"text": FILLED} | {k: Maybe(FILLED) for k in ("subject", "action", "time", "location", "attribution", "context")}), filled=True)})


def pillar_answer(pillar: str) -> Object:
    """The contract of the answer on one pillar; that on provenance also assesses the core."""
    fields = _PILLARS[pillar]
    parts = {"fields": Object({pillar: Object(fields)}), "field_citations": Keyed(Many(_CITATION), tuple(f"{pillar}.{f}" for f in fields)), "assessments": Object({pillar: assessment(pillar == "provenance")})}
    return Object(parts | ({"core_assessment": assessment(True)} if pillar == "provenance" else {}))
