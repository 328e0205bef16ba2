"""Queries over the states of claims: merges of new values into old ones, and the stages that are made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims
from ..operators.claims import Rule, State
from .registry import query, read

# A client's row is the state, its last change the new values; deletions bring nulls.
_RULES = {"segment": Rule("fill", "city"), "city": Rule("update"), "balance": Rule("force")}
_DERIVED = {"email": ["city", "segment"], "name": ["balance"]}
_OLD, _NEW = ["name", "email", "segment", "city", "balance"], ["segment", "city", "balance"]


def _cents(column: str = "balance"):
    return F.round(F.col(column) * 100).cast("long")


def _client_state(spark, d):
    """Old values, new values, and (claim_id, field) that is protected."""
    rows = read(spark, d, "clients").select(F.col("client_id").alias("claim_id"), "source", "name", "email", "segment", "city", _cents().alias("balance"))
    last = read(spark, d, "client_changes").groupBy(F.col("client_id").alias("claim_id")).agg(F.max_by(F.struct("op", "segment", "city", _cents().alias("balance")), F.struct("seq", "change_id")).alias("x")).select("claim_id", "x.*")
    new = {c: F.when(F.coalesce(F.col("op") != "D", F.lit(True)), F.col(c)) for c in _NEW}
    held = rows.filter("source = 'crm'").select("claim_id", F.lit("city").alias("field"))
    return claims.stacked(rows, {c: F.col(c) for c in _OLD}), claims.stacked(last, new), held


def _merged_sql() -> str:
    """o_<field>, n_<field>, and for each field whether it takes the new value (t_) and may (w_); one row a client."""
    old = ", ".join(f"c.{f} AS o_{f}" for f in _OLD[:-1]) + ", CAST(round(c.balance * 100) AS BIGINT) AS o_balance, c.client_id IS NOT NULL AS had, c.source = 'crm' AS crm"
    return f"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC) AS k FROM client_changes) WHERE k = 1),
n AS (SELECT client_id, CASE WHEN op = 'D' THEN NULL ELSE segment END AS segment, CASE WHEN op = 'D' THEN NULL ELSE city END AS city, CASE WHEN op = 'D' THEN NULL ELSE CAST(round(balance * 100) AS BIGINT) END AS balance FROM l),
j AS (SELECT coalesce(c.client_id, n.client_id) AS claim_id, {old}, n.segment AS n_segment, n.city AS n_city, n.balance AS n_balance, n.client_id IS NOT NULL AS given FROM clients c FULL JOIN n ON c.client_id = n.client_id),
w AS (SELECT *, given AND o_city IS NULL AS w_segment, given AND n_city IS NOT NULL AS w_city, given AS w_balance FROM j),
t AS (SELECT *, w_segment AS t_segment, w_city AND NOT coalesce(crm, false) AS t_city, w_balance AS t_balance FROM w),
m AS (""" + " UNION ALL ".join(
        f"""SELECT claim_id, '{f}' AS field, CAST(CASE WHEN t_{f} THEN n_{f} ELSE o_{f} END AS VARCHAR) AS value, CAST(o_{f} AS VARCHAR) AS old,
CASE WHEN w_{f} AND NOT t_{f} THEN 'protected' WHEN NOT t_{f} THEN 'kept' WHEN n_{f} IS NOT DISTINCT FROM o_{f} THEN 'same' WHEN o_{f} IS NULL THEN 'filled' WHEN n_{f} IS NULL THEN 'cleared' ELSE 'replaced' END AS decision FROM t WHERE had OR given"""
        if f in _NEW else f"SELECT claim_id, '{f}' AS field, o_{f} AS value, o_{f} AS old, 'kept' AS decision FROM t WHERE had"
        for f in _OLD
    ) + ")"


_MERGED = _merged_sql()


def _merged(spark, d):
    old, new, held = _client_state(spark, d)
    return claims.merge(old, new, _RULES, held)


@query(_MERGED + " SELECT * FROM m")
def state_merge(spark, d):
    return _merged(spark, d)


_STALE = ", s AS (SELECT claim_id, bool_or(field IN ('city', 'segment')) AS email, bool_or(field = 'balance') AS name FROM m WHERE lower(coalesce(value, '')) <> lower(coalesce(old, '')) GROUP BY claim_id)"
_GONE = "m.value IS NOT NULL AND m.decision IN ('kept', 'protected', 'same') AND coalesce(CASE m.field WHEN 'email' THEN s.email WHEN 'name' THEN s.name END, false)"


@query(_MERGED + _STALE + f" SELECT m.claim_id, m.field, CASE WHEN NOT ({_GONE}) THEN m.value END AS value, m.old, CASE WHEN {_GONE} THEN 'invalidated' ELSE m.decision END AS decision FROM m LEFT JOIN s ON m.claim_id = s.claim_id")
def state_invalidated(spark, d):
    return claims.invalidated(_merged(spark, d), _DERIVED, F.lower)


_PIVOT = "SELECT claim_id, max(value) FILTER (field = 'city') AS city, max(value) FILTER (field = 'segment') AS segment, max(value) FILTER (field = 'balance') AS balance FROM m GROUP BY claim_id"


@query(_MERGED + f", p AS ({_PIVOT}) SELECT claim_id, 'email' AS field, sha256(to_json(['city', city, 'segment', segment])) AS fingerprint FROM p UNION ALL SELECT claim_id, 'name', sha256(to_json(['balance', balance])) FROM p")
def state_fingerprints(spark, d):
    return claims.fingerprints(_merged(spark, d), _DERIVED)


_WHEN = "'2024-03-01'"


@query(f"""WITH l AS (SELECT client_id, u.field, change_id, coalesce(valid_at >= TIMESTAMP {_WHEN}, false) AS late, op FROM client_changes, (SELECT unnest(['city', 'segment']) AS field) u
WHERE CASE u.field WHEN 'city' THEN city ELSE segment END IS NOT NULL),
g AS (SELECT DISTINCT client_id FROM client_changes WHERE op = 'D')
SELECT DISTINCT client_id AS claim_id, field, 'change-' || change_id AS evidence_id FROM l WHERE late OR NOT (field = 'city' AND client_id IN (SELECT client_id FROM g))""")
def state_links(spark, d):
    rows = read(spark, d, "client_changes").withColumn("evidence_id", F.concat(F.lit("change-"), F.col("change_id").cast("string"))).withColumnRenamed("client_id", "claim_id")
    linked = rows.select("claim_id", "evidence_id", F.coalesce(F.col("valid_at") >= F.lit("2024-03-01").cast("timestamp"), F.lit(False)).alias("late"), F.explode(F.filter(F.array(F.when(F.col("city").isNotNull(), "city"), F.when(F.col("segment").isNotNull(), "segment")), lambda x: x.isNotNull())).alias("field"))
    gone = rows.filter("op = 'D'").select("claim_id", F.lit("city").alias("field"))
    return claims.relinked(linked.filter("NOT late"), linked.filter("late"), gone)


@query("""WITH v AS (SELECT client_id AS claim_id, city AS name, list(DISTINCT CASE source WHEN 'crm' THEN 'claim' ELSE source END) AS groups FROM client_changes WHERE city IS NOT NULL GROUP BY ALL),
r AS (SELECT *, list_contains(groups, 'claim') AS said, len(list_filter(groups, lambda x: x <> 'claim')) AS support FROM v),
k AS (SELECT *, support >= 2 AND support = max(support) OVER (PARTITION BY claim_id) AS best FROM r)
SELECT claim_id, CASE WHEN count(*) FILTER (said) = 1 THEN max(name) FILTER (said) END AS claimed, CASE WHEN count(*) FILTER (best) = 1 THEN max(name) FILTER (best) END AS verified FROM k GROUP BY claim_id""")
def places_chosen(spark, d):
    return claims.chosen_places(_candidates(spark, d))


def _candidates(spark, d):
    group = F.when(F.col("source") == "crm", "claim").otherwise(F.col("source"))
    rows = read(spark, d, "client_changes").filter("city IS NOT NULL").groupBy(F.col("client_id").alias("claim_id"), F.col("city").alias("name"))
    found = rows.agg(F.array_sort(F.collect_set(group)).alias("sources"), F.min("change_id").alias("seq"))
    null = F.lit(None).cast("array<string>")
    return found.select("claim_id", "seq", "name", "sources", null.alias("event_sources"), null.alias("event_groups"), F.lit("changes").alias("source"))


@query("""WITH v AS (SELECT client_id AS claim_id, city AS name, min(change_id) AS seq, list(DISTINCT CASE source WHEN 'crm' THEN 'claim' ELSE source END) AS groups FROM client_changes WHERE city IS NOT NULL GROUP BY ALL),
r AS (SELECT *, list_contains(groups, 'claim') AS said, len(list_filter(groups, lambda x: x <> 'claim')) AS support FROM v),
k AS (SELECT *, support >= 2 AND support = max(support) OVER (PARTITION BY claim_id) AS best FROM r),
h AS (SELECT claim_id, CASE WHEN count(*) FILTER (said) = 1 THEN max(name) FILTER (said) END AS chosen, CASE WHEN count(*) FILTER (best) = 1 THEN max(name) FILTER (best) END AS verified FROM k GROUP BY claim_id),
c AS (SELECT c.client_id AS claim_id, c.city, c.segment = 'public' AND c.city IS NOT NULL AND length(c.city) >= 3 AS held, chosen, h.verified FROM clients c LEFT JOIN h ON h.claim_id = c.client_id),
n AS (SELECT claim_id, city, CASE WHEN held THEN city ELSE chosen END AS claimed, verified FROM c),
m AS (SELECT *, lower(coalesce(claimed, '')) <> lower(coalesce(city, '')) OR verified IS NOT NULL AS moved, lower(claimed) = lower(verified) AS same FROM n),
a AS (SELECT claim_id, 0 AS rank, seq AS spot, name FROM v WHERE claim_id IN (SELECT claim_id FROM m) UNION ALL SELECT claim_id, 1, 0, city FROM m WHERE city IS NOT NULL AND length(city) >= 3 UNION ALL SELECT claim_id, 2, 0, claimed FROM m WHERE claimed IS NOT NULL UNION ALL SELECT claim_id, 2, 1, verified FROM m WHERE verified IS NOT NULL),
b AS (SELECT claim_id, min((rank, spot, name)) AS x FROM a GROUP BY claim_id, lower(name)),
l AS (SELECT claim_id, list(x[3] ORDER BY x) AS names FROM b GROUP BY claim_id)
SELECT m.claim_id, claimed, verified, to_json(coalesce(names, [])) AS listed, CASE WHEN same THEN 'same' WHEN NOT moved THEN 'different city' END AS differs FROM m LEFT JOIN l ON l.claim_id = m.claim_id""")
def places_merged(spark, d):
    """Clients' cities as claimed places, the cities of their changes as what the texts tell; public clients are reviewed."""
    rows = read(spark, d, "clients").withColumnRenamed("client_id", "claim_id")
    place = lambda f: f"location.{f}"
    values = claims.stacked(rows, {place("claimed_location"): F.col("city"), place("candidate_locations"): F.to_json(F.filter(F.array("city"), lambda x: x.isNotNull())), place("location_mismatch_type"): F.lit("different city")})
    none = State(values, spark.createDataFrame([], "claim_id long, evidence_id string, type string, source string, observation string"), spark.createDataFrame([], "claim_id long, field string, evidence_id string"))
    reviews = rows.select("claim_id", F.when(F.col("segment") == "public", "done").otherwise("automated").alias("status"))
    known = rows.select("claim_id")
    found = claims.merge_places(none, _candidates(spark, d).join(known, "claim_id", "left_semi"), rows.select("claim_id", F.lit(None).cast("string").alias("name")), reviews)
    fields = {"claimed": "claimed_location", "verified": "verified_location", "listed": "candidate_locations", "differs": "location_mismatch_type"}
    return claims.wide(found.values, {c: place(f) for c, f in fields.items()})


# Events as records of videos, with what was known of some of them before.

_RECORDS = """WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN value < 100 THEN 'told before' END AS o_framing, CASE WHEN value BETWEEN 40 AND 160 THEN 'https://example.com/first' END AS o_url,
CASE WHEN value < 80 THEN 'c' END AS o_caption, CASE WHEN value > 120 THEN '2023-12-31' END AS o_upload, 'https://x.com/u' || user_id || '/status/1' AS video FROM events)"""


def _records(spark, d):
    e, value = read(spark, d, "events"), F.col("value")
    return e.select(
        F.col("event_id").alias("claim_id"), F.concat(F.lit("e/"), F.col("event_id").cast("string")).alias("source_file"), F.col("event_type").alias("claim"), F.concat(F.lit("https://example.com/a/"), F.col("user_id").cast("string")).alias("url"),
        F.col("props").alias("content"), F.when(value > 200, "CNN").otherwise(F.col("event_type")).alias("platform"), F.concat(F.lit("https://x.com/u"), F.col("user_id").cast("string"), F.lit("/status/1")).alias("video_url"),
        F.date_format("ts", "yyyyMMdd").alias("video_date"), F.when(value > 20, F.upper("event_type")).alias("video_headline"), F.col("props").alias("video_description"), F.when(value < 50, F.col("props")).alias("video_transcript"),
        F.when(value > 150, F.array(F.struct(F.col("event_type").alias("text"), F.array(F.lit("https://example.com/r")).alias("refs")))).otherwise(F.array().cast("array<struct<text:string,refs:array<string>>>")).alias("references"), "ts", "value",
    )


def _known(spark, d) -> State:
    e, value = read(spark, d, "events").withColumnRenamed("event_id", "claim_id"), F.col("value")
    values = claims.stacked(e, {
        "motivation.claimed_framing": F.when(value < 100, "told before"), "provenance.earliest_known_url": F.when(value.between(40, 160), "https://example.com/first"),
        "motivation.original_caption": F.when(value < 80, "c"), "date.video_upload_date": F.when(value > 120, "2023-12-31"),
    })
    heard = e.filter(value < 10).select("claim_id", F.lit("heard").alias("evidence_id"), F.lit("asr_transcript").alias("type"), F.lit("s").alias("source"), F.lit("o").alias("observation"))
    return State(values, heard, heard.select("claim_id", F.lit("motivation.claimed_framing").alias("field"), "evidence_id"))


def _rows(fields: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT event_id AS claim_id, '{f}' AS field, {v} AS value FROM e" for f, v in fields.items())


_BOOTED = {
    "motivation.claimed_framing": "coalesce(o_framing, event_type)", "date.video_upload_date": "coalesce(o_upload, day)", "provenance.earliest_known_url": "coalesce(o_url, video)",
    "provenance.earliest_known_date": "CASE WHEN o_url IS NULL THEN day END", "provenance.provenance_status": "CASE WHEN o_url IS NULL THEN 'unknown' END",
    "motivation.original_caption": "coalesce(o_caption, CASE WHEN value > 20 THEN upper(event_type) END)", "motivation.original_description": "props",
    "source.uploader_name": "CASE WHEN value > 200 THEN 'CNN' END", "source.original_source_name": "CASE WHEN value > 200 THEN 'CNN' END",
    "source.source_type": "CASE WHEN value > 200 THEN 'news outlet' END", "source.source_is_uploader": "CASE WHEN value > 200 THEN 'true' END",
}


@query(f"{_RECORDS}, r AS ({_rows(_BOOTED)}) SELECT * FROM r WHERE value IS NOT NULL")
def bootstrap_values(spark, d):
    return claims.bootstrap(_known(spark, d), _records(spark, d)).values.filter("value IS NOT NULL")


def _id(kind: str, source: str, observation: str) -> str:
    return f"""'{kind.replace("_", "-")}-' || substr(sha256('["{kind}", ' || to_json({source}) || ', ' || to_json({observation}) || ', null]'), 1, 10)"""


_FILE = "'e/' || event_id"
_EVIDENCE = [
    ("claim_text", _FILE, "event_type", "1", "true"),
    ("dataset_video_metadata", _FILE, f"'{claims.RECORD_METADATA}'", "5 + CASE WHEN o_url IS NULL THEN 1 ELSE 0 END + CASE WHEN value > 200 THEN 4 ELSE 0 END", "true"),
    ("fact_check_article", "'https://example.com/a/' || user_id", "props", "0", "true"),
    ("fact_check_evidence", "'https://example.com/r'", "event_type", "0", "value > 150"),
    ("dataset_transcript", _FILE, "props", "0", "value < 50"),
]


@query(_RECORDS + " " + " UNION ALL ".join(f"SELECT event_id AS claim_id, {_id(kind, source, said)} AS evidence_id, '{kind}' AS type, CAST({n} AS BIGINT) AS n_links FROM e WHERE {where}" for kind, source, said, n, where in _EVIDENCE))
def bootstrap_evidence(spark, d):
    state = claims.bootstrap(_known(spark, d), _records(spark, d))
    linked = state.links.groupBy("claim_id", "evidence_id").agg(F.count(F.lit(1)).alias("n_links"))
    return state.evidence.join(linked, ["claim_id", "evidence_id"], "left").select("claim_id", "evidence_id", "type", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


_EARLIER = "value > 150 AND coalesce(CASE WHEN o_url IS NULL THEN day END, '') IN ('', day)"
_ASKED = _BOOTED | {
    "source.uploader_name": "CASE WHEN value < 30 THEN 'Someone' WHEN value > 200 THEN 'CNN' ELSE '@u' || user_id END", "source.uploader_profile": "'https://x.com/u' || user_id",
    "date.video_upload_date": "CASE WHEN value > 100 THEN strftime(ts - INTERVAL 2 DAY, '%Y-%m-%d') ELSE day END", "motivation.original_caption": "CASE WHEN value > 50 THEN event_type WHEN value > 20 THEN upper(event_type) END",
    "provenance.earliest_known_date": f"CASE WHEN {_EARLIER} THEN strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') WHEN o_url IS NULL THEN day END", "provenance.earliest_known_url": f"CASE WHEN {_EARLIER} THEN 'https://archive.example/' || event_id ELSE coalesce(o_url, video) END",
    "date.earliest_online_date": "CASE WHEN value > 150 THEN strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') END",
}


@query(f"{_RECORDS}, r AS ({_rows(_ASKED)}) SELECT * FROM r WHERE value IS NOT NULL")
def web_values(spark, d):
    """The states after bootstrap, with what pages and an archive tell of the events' videos."""
    records, value = _records(spark, d), F.col("value")
    ago = lambda n: F.date_format(F.col("ts") - F.expr(f"INTERVAL {n} DAYS"), "yyyy-MM-dd")
    key = F.col("claim_id").cast("string")
    found = records.select(
        "claim_id", F.concat(F.lit("https://pages.example/"), key).alias("page_url"), F.when(value < 30, "Someone").when(value < 60, "").alias("uploader_name"), F.lit(None).cast("string").alias("uploader_profile"),
        F.when(value > 100, ago(2)).alias("upload_date"), F.when(value > 50, F.col("claim")).alias("title"), F.lit(None).cast("string").alias("description"), F.when(value > 150, ago(1)).alias("archive_date"),
        F.concat(F.lit("https://archive.example/"), key).alias("archive_url"), F.concat(F.lit("https://archive.example/s/"), key).alias("archive_snapshot"),
    )
    return claims.web_metadata(claims.bootstrap(_known(spark, d), records), records, found).values.filter("value IS NOT NULL")


_RESET = {f: "NULL" for f in claims.READ_ANEW} | _BOOTED | {
    "provenance.provenance_status": "'unknown'", "source.original_source_name": _BOOTED["source.original_source_name"], "location.candidate_locations": "CASE WHEN value > 250 THEN json_array(event_type)::VARCHAR ELSE '[]' END",
}


@query(f"{_RECORDS}, r AS ({_rows(_RESET)}) SELECT * FROM r WHERE value IS NOT NULL")
def reset_values(spark, d):
    """The states after bootstrap, made ready for a new reading of the texts."""
    records = _records(spark, d)
    seen = records.filter("value > 250").select("claim_id", F.to_json(F.array("claim")).alias("value"))
    return claims.reset_texts(claims.bootstrap(_known(spark, d), records), records.select("claim_id", "platform"), seen).values.filter("value IS NOT NULL")
