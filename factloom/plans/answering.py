"""Queries over answers of models and geocoders, and over relations between claims and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers
from .registry import by_form, query, read

by_form(
    "strict_answers", "orders", "o_orderkey",
    {"raw": ["concat('{\"a\": ', n, '}')", "concat('<think>no {x}</think> Here is the JSON:', chr(10), '{\"b\": ', n, '}')", "concat('```json', chr(10), '{\"c\": ', n, '}', chr(10), '```')", "'<think>never done {\"a\": 1}'", "'Well, {\"a\": 1}'", "'{\"a\": 1} and more'", "'{\"a\": }'", "'[1]'", "NULL"]},
    {"body": ["concat('{\"a\": ', n, '}')", "concat('{\"b\": ', n, '}')", "concat('{\"c\": ', n, '}')", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL"]},
    lambda raw: {"body": answers.strict_object(raw.cast("string"))},
)
_PART = "named_struct('text', {0}, 'subject', {1}, 'action', CAST(NULL AS STRING), 'time', CAST(NULL AS STRING), 'location', CAST(NULL AS STRING), 'attribution', CAST(NULL AS STRING), 'context', CAST(NULL AS STRING))"
by_form(
    "claim_components", "orders", "o_orderkey",
    {"claim": ["concat('A  bird ', n, ' sang')", "concat('A bird ', n)", "concat('A bird ', n)", "'A bird'"], "normalized": ["concat('A bird ', n, '  sang')", "concat('A bird ', n)", "concat('The bird ', n)", "'A bird'"], "parts": [f"array({_PART.format('concat(n, chr(10), chr(115), chr(97), chr(110), chr(103))', repr('A bird'))})", f"array({_PART.format(repr('A cat'), 'CAST(NULL AS STRING)')})", f"array({_PART.format(repr('bird'), 'CAST(NULL AS STRING)')})", f"array({_PART.format(repr('bird'), repr('cat'))})"]},
    {"id": ["'claim_1'", "NULL", "NULL", "NULL"], "told": ["concat(n, ' sang')", "NULL", "NULL", "NULL"]},
    lambda claim, normalized, parts: {"id": F.get(answers.components(claim, normalized, parts), 0)["id"], "told": F.get(answers.components(claim, normalized, parts), 0)["text"]},
)
by_form(
    "vision_lists", "orders", "o_orderkey",
    {"found": ["map('Scene Summary', array(concat('A square in Lima ', n)), 'OCR-text', array('Stop', 'stop', 'Stop', ' ', 'Unique visible text', 'c', 'd'), 'candidate_locations', array('Lima', 'Quito', 'lima'))", "map('scene_summary', array('Short factual description'), 'signs_and_logs', array(concat('Sign ', n)), 'candidateLocations', array(concat('Sign ', n), 'Sign'))", "CAST(map() AS MAP<STRING, ARRAY<STRING>>)"]},
    {"scene": ["concat('A square in Lima ', n)", "''", "''"], "seen": ["'Stop|stop|c'", "''", "''"], "signs": ["''", "concat('Sign ', n)", "''"], "places": ["'Lima'", "concat('Sign ', n, '|Sign')", "''"]},
    lambda found: dict(zip(("scene", "seen", "signs", "places"), (lambda v: (v["scene_summary"], F.array_join(v["ocr_text"], "|"), F.array_join(v["signs_and_logos"], "|"), F.array_join(v["candidate_locations"], "|")))(answers.vision_lists(found)), strict=True)),
)
_ROW = "named_struct('osm_type', 'node', 'osm_id', {0}, 'address', {1})"
_NONE = "CAST(NULL AS STRUCT<osm_type: STRING, osm_id: BIGINT, address: MAP<STRING, STRING>>)"
by_form(
    "place_mismatches", "orders", "o_orderkey",
    {
        "claimed": ["'São Paulo'", "concat('Town ', n)", "'A'", "'A'", "'A'", "'A'", "''", "'A'"], "verified": ["'sao paulo'", "'B'", "'B'", "'B'", "'B'", "'B'", "'B'", "'B'"],
        "x": [_NONE, _ROW.format("n", "map('city', 'x')"), _ROW.format("CAST(1 AS BIGINT)", "map('country', 'Peru', 'city', 'x')"), _ROW.format("CAST(1 AS BIGINT)", "map('country', 'Peru', 'region', 'r1')"), _ROW.format("CAST(1 AS BIGINT)", "map('city', concat('c', n))"), _ROW.format("CAST(1 AS BIGINT)", "map('city', 'x')"), _NONE, _NONE],
        "y": [_NONE, _ROW.format("n", "map('city', 'y')"), _ROW.format("CAST(2 AS BIGINT)", "map('country', 'Chile', 'city', 'y')"), _ROW.format("CAST(2 AS BIGINT)", "map('country', 'PERU', 'state', 'r2')"), _ROW.format("CAST(2 AS BIGINT)", "map('city', 'other')"), _ROW.format("CAST(2 AS BIGINT)", "map('country', 'Peru')"), _NONE, _NONE],
    },
    {"mismatch": ["'same'", "'same'", "'different country'", "'different region'", "'different city'", "'unknown'", "NULL", "NULL"]},
    lambda claimed, verified, x, y: {"mismatch": answers.place_mismatch(claimed, verified, x, y)},
)


@query("""WITH r AS (SELECT user_id, event_id, value AS score, event_id % 3 = 0 AS target, event_type AS name FROM events WHERE event_id % 29 = 0),
b AS (SELECT user_id, arg_max(event_id, (score, -event_id)) FILTER (target) AS i FROM r GROUP BY 1)
SELECT b.user_id, CASE WHEN i IS NOT NULL THEN 'query_and_admin_context' ELSE 'no_target_place_candidates' END AS strategy, c.candidate_count, c.target_candidate_count, i AS selected_index, round(r.score, 4) AS score, r.name FROM b JOIN (SELECT user_id, count(*) AS candidate_count, count(*) FILTER (target) AS target_candidate_count FROM r GROUP BY 1) c USING (user_id) LEFT JOIN r ON r.event_id = b.i""")
def best_places(spark, d):
    n = F.col("event_id")
    rows = read(spark, d, "events").filter(n % 29 == 0).select("user_id", "event_id", F.col("value").alias("score"), (n % 3 == 0).alias("target"), F.col("event_type").alias("name"))
    return answers.best_place(rows, "user_id", "event_id", "score", "target", ["name"])


_ASSESSED = "WITH a AS (SELECT event_id AS component_id, event_type AS pillar, CASE event_id % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'refuted' ELSE 'unknown' END AS status, event_id % 4 AS k FROM events) "


def _assessed(spark, d):
    n = F.col("event_id")
    cite = lambda e, q: F.struct(e.alias("evidence_id"), q.alias("quote"))
    e1, e2 = F.concat(F.lit("e"), (n % 10).cast("string")), F.lit("shared")
    yes = F.when(n % 4 < 2, F.array(cite(e1, F.lit("q1")), cite(e2, F.lit("q2"))))
    no = F.when(n % 4 == 1, F.array(cite(e2, F.lit("q3")))).otherwise(F.array().cast("array<struct<evidence_id:string,quote:string>>"))
    status = F.when(n % 3 == 0, "supported").when(n % 3 == 1, "refuted").otherwise("unknown")
    return read(spark, d, "events").select(n.alias("component_id"), F.col("event_type").alias("pillar"), status.alias("status"), yes.alias("supporting"), no.alias("refuting"))


@query(_ASSESSED + """, c AS (SELECT *, 'supports' AS side, 'e' || component_id % 10 AS evidence_id, 'q1' AS quote FROM a WHERE k < 2 UNION ALL SELECT *, 'supports', 'shared', 'q2' FROM a WHERE k < 2 UNION ALL SELECT *, 'refutes', 'shared', 'q3' FROM a WHERE k = 1)
SELECT component_id, pillar, CASE WHEN status = 'unknown' THEN 'unresolved' ELSE side END AS stance, evidence_id, quote FROM c""")
def relations(spark, d):
    return answers.relations(_assessed(spark, d))


@query(_ASSESSED + "SELECT component_id, pillar, status, CASE WHEN k < 2 THEN 'e' || component_id % 10 || ',shared' ELSE '' END AS evidence FROM a")
def relation_trace(spark, d):
    return answers.trace(_assessed(spark, d)).select("component_id", "pillar", "status", F.array_join("evidence_ids", ",").alias("evidence"))


@query(r"""SELECT lang, replace(replace(coalesce(any_value(lang) || '|' || chr(10) || 'x', ''), '|', '\|'), chr(10), ' ') AS cell, count(*) FILTER (n_chars > 1000) || '/' || count(*) || ' (' || printf('%.1f', 100.0 * count(*) FILTER (n_chars > 1000) / count(*)) || '%)' AS long_ones FROM documents GROUP BY lang""")
def report_cells(spark, d):
    of = read(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 1000).alias("many"))
    return of.select("lang", answers.cell(F.concat("lang", F.lit("|\nx"))).alias("cell"), answers.ratio(F.col("many"), F.col("n")).alias("long_ones"))


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def record_with_annotation(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
