"""Queries over findings and verdicts: alias closure, seeding, copied fields, decisions, reviews and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings, judging
from .registry import query, read

# Changes of clients as evidence in order: those that share a segment, or a source within a range of the balance, mean the same post.

def _items(which: str) -> str:
    return f"""WITH RECURSIVE c AS (SELECT DISTINCT client_id, change_id, city, segment, source, balance, valid_at, op FROM client_changes),
i AS (SELECT client_id AS claim_id, change_id AS seq, 'https://kind.example/' || segment AS url FROM c WHERE segment IS NOT NULL AND {which}
UNION ALL SELECT client_id, change_id, 'https://till.example/' || source || '/' || CAST(floor(balance / 2500) AS BIGINT) FROM c WHERE balance IS NOT NULL AND {which}),
a(claim_id, url, since) AS (SELECT client_id, 'https://kind.example/' || segment, CAST(-1 AS BIGINT) FROM clients WHERE segment IS NOT NULL
UNION SELECT k.claim_id, k.url, k.seq FROM a JOIN i ON a.claim_id = i.claim_id AND a.url = i.url AND i.seq > a.since JOIN i k ON k.claim_id = i.claim_id AND k.seq = i.seq)"""


def _posts(spark, d):
    return read(spark, d, "clients").select(F.col("client_id").alias("claim_id"), F.concat(F.lit("https://kind.example/"), "segment").alias("post_url"))


def _changes(spark, d):
    rows = read(spark, d, "client_changes").select("client_id", "change_id", "city", "segment", "source", "balance", "valid_at", "op").distinct()
    till = F.concat(F.lit("https://till.example/"), "source", F.lit("/"), F.floor(F.col("balance") / 2500).cast("string"))
    return rows.withColumnsRenamed({"client_id": "claim_id", "change_id": "seq"}).withColumns({"page": F.concat(F.lit("https://kind.example/"), "segment"), "till": till})


@query(_items("true") + " SELECT claim_id, url, min(since) AS since FROM a GROUP BY claim_id, url")
def alias_closure(spark, d):
    items = _changes(spark, d).select("claim_id", "seq", F.array("page", "till").alias("urls"))
    return findings.alias_closure(_posts(spark, d), items)[0]


@query(_items("op <> 'D'") + """, m AS (SELECT DISTINCT i.claim_id, i.seq FROM a JOIN i ON a.claim_id = i.claim_id AND a.url = i.url AND i.seq > a.since JOIN c ON c.client_id = i.claim_id AND c.change_id = i.seq WHERE c.op <> 'D'),
x AS (SELECT m.claim_id, m.seq, 'till of ' || c.city AS uploader_name, strftime(c.valid_at, '%Y-%m-%d') AS upload_date FROM m JOIN c ON c.client_id = m.claim_id AND c.change_id = m.seq)
SELECT claim_id, 'source.uploader_name' AS field, arg_max(uploader_name, seq) AS value, 'change-' || max(seq) AS evidence_id FROM x WHERE uploader_name IS NOT NULL GROUP BY claim_id
UNION ALL SELECT claim_id, 'date.video_upload_date', arg_max(upload_date, seq), 'change-' || max(seq) FROM x WHERE upload_date IS NOT NULL GROUP BY claim_id
UNION ALL SELECT claim_id, 'date.earliest_online_date', arg_min(day, (day, seq)), 'change-' || arg_min(seq, (day, seq)) FROM (
SELECT DISTINCT c.client_id AS claim_id, c.change_id AS seq, strftime(c.valid_at, '%Y-%m-%d') AS day FROM c JOIN (SELECT DISTINCT claim_id, url FROM a) u ON u.claim_id = c.client_id AND u.url = 'https://kind.example/' || c.segment WHERE c.op = 'D' AND c.balance > 0 AND c.valid_at IS NOT NULL) GROUP BY claim_id""")
def seeded_values(spark, d):
    """Changes as metadata records, deletions as archive records; those of a negative balance don't state their date."""
    rows, day = _changes(spark, d), F.date_format("valid_at", "yyyy-MM-dd")
    gone, none = F.col("op") == "D", F.lit(None).cast("string")
    told = F.to_json(F.struct(F.concat(F.lit("till of "), "city").alias("uploader_name"), day.alias("upload_date")))
    items = rows.select(
        "claim_id", "seq", F.concat(F.lit("change-"), F.col("seq").cast("string")).alias("evidence_id"), F.when(gone, "archive_record").otherwise("platform_metadata").alias("type"), F.lit(True).alias("verified"), F.col("page").alias("requested_url"),
        F.col("till").alias("source"), none.alias("final_url"), none.alias("canonical_url"), F.when(~gone, told).otherwise(F.when(F.col("balance") > 0, F.concat(F.lit("kept on "), day))).alias("observation"),
        F.when(gone, F.col("page")).alias("archive_url"), F.when(gone, day).alias("archive_date"),
    )
    return findings.seeded(_posts(spark, d), items)


# Items as evidence of their own fields.


@query("""WITH e AS (SELECT *, name || ' of brand ' || brand || ' for ' || kind AS text, size >= 10 AS verified, CASE WHEN price < 100 THEN 'retrieved_page' WHEN price < 300 THEN 'platform_metadata' ELSE 'keyframe_analysis' END AS type FROM (SELECT DISTINCT item_id, name, brand, kind, size, price FROM items)),
v AS (SELECT * FROM e WHERE verified AND length(name) >= 8 AND text IS NOT NULL)
SELECT item_id AS claim_id, 'location' AS pillar, 'verified_location' AS field, brand AS value FROM e WHERE verified AND type = 'retrieved_page' AND size % 2 = 0 AND text IS NOT NULL
UNION ALL SELECT item_id, 'motivation', 'original_caption', name FROM v WHERE type = 'retrieved_page'
UNION ALL SELECT item_id, 'provenance', 'provenance_status', 'repost' FROM v WHERE type = 'retrieved_page' AND kind = 'home'
UNION ALL SELECT item_id, 'source', 'source_mismatch', 'true' FROM v WHERE type IN ('retrieved_page', 'platform_metadata')
UNION ALL SELECT item_id, 'location', 'candidate_locations', CAST(to_json([brand, kind]) AS VARCHAR) FROM e WHERE length(name) >= 8 AND text IS NOT NULL""")
def copied_fields(spark, d):
    items = read(spark, d, "items").select("item_id", "name", "brand", "kind", "size", "price").distinct().withColumnRenamed("item_id", "claim_id")
    kind = F.when(F.col("price") < 100, "retrieved_page").when(F.col("price") < 300, "platform_metadata").otherwise("keyframe_analysis")
    evidence = items.select("claim_id", F.lit("e1").alias("evidence_id"), kind.alias("type"), (F.col("size") >= 10).alias("verified"), F.lit("https://shop.example").alias("source"), F.concat("name", F.lit(" of brand "), "brand", F.lit(" for "), "kind").alias("text"))
    row = lambda pillar, field, value, kind, quote: F.struct(F.lit(pillar).alias("pillar"), F.lit(field).alias("field"), value.alias("value"), F.lit(kind).alias("kind"), quote.alias("quote"))
    # A brand stands in the quote of even sizes only.
    longer = F.when(F.col("size") % 2 == 0, F.concat("name", F.lit(" of brand "), "brand")).otherwise(F.col("name"))
    asked = items.select("claim_id", F.explode(F.array(
        row("location", "verified_location", F.col("brand"), "string", longer), row("motivation", "original_caption", F.col("name"), "string", F.col("name")),
        row("provenance", "provenance_status", F.when(F.col("kind") == "home", "repost").otherwise(F.col("kind")), "string", F.col("name")), row("source", "source_mismatch", F.lit("true"), "boolean", F.col("name")),
        row("location", "candidate_locations", F.to_json(F.array("brand", "kind")), "list", F.col("name")),
    )).alias("x")).select("claim_id", "x.*")
    cited = asked.select("claim_id", "pillar", "field", F.lit("e1").alias("evidence_id"), "quote")
    return findings.copied_fields(asked.drop("quote"), cited, evidence, findings.field_rules(spark, findings.known_enums()))[0]


# Sales as claims, their lines as components; lines aren't unique, so some have several decisions.


@query("""WITH e AS (SELECT DISTINCT sale_id AS claim_id, line_no AS component_id FROM sale_lines WHERE sale_id IS NOT NULL AND line_no IS NOT NULL AND quantity IS NOT NULL AND quantity > 0),
g AS (SELECT sale_id AS claim_id, line_no AS component_id, count(*) AS n FROM sale_lines WHERE sale_id IS NOT NULL AND line_no IS NOT NULL AND discount IS NOT NULL AND item_id IS NOT NULL GROUP BY ALL)
SELECT coalesce(e.claim_id, g.claim_id) AS claim_id, coalesce(e.component_id, g.component_id) AS component_id, CASE WHEN e.claim_id IS NULL THEN 'unknown' WHEN g.n IS NULL THEN 'missing' ELSE 'doubled' END AS problem
FROM e FULL JOIN g ON e.claim_id = g.claim_id AND e.component_id = g.component_id WHERE e.claim_id IS NULL OR g.n IS NULL OR g.n > 1""")
def decision_errors(spark, d):
    rows = read(spark, d, "sale_lines").filter("sale_id IS NOT NULL AND line_no IS NOT NULL").withColumnsRenamed({"sale_id": "claim_id", "line_no": "component_id"})
    return judging.decision_errors(rows.filter("quantity > 0").select("claim_id", "component_id"), rows.filter("discount IS NOT NULL AND item_id IS NOT NULL"))


_LINES = """WITH l AS (SELECT sale_id AS claim_id, line_no AS component_id, max(quantity) AS q, max(discount) AS disc, max(amount) AS amount, max(vendor_id) AS vendor FROM sale_lines WHERE sale_id IS NOT NULL AND line_no IS NOT NULL GROUP BY ALL),
f AS (SELECT *, CASE WHEN q > 25 THEN 'supported' WHEN q < 5 THEN 'refuted' ELSE 'unknown' END AS core, CASE WHEN disc IS NULL THEN 'not_applicable' WHEN disc > 0.03 THEN 'supported' ELSE 'unknown' END AS date, CASE WHEN vendor IS NULL THEN 'unknown' ELSE 'supported' END AS provenance,
CASE WHEN amount > 1000 THEN 'TRUE' WHEN amount > 200 THEN 'FALSE' ELSE 'NEI' END AS proposed, coalesce(q % 2 = 0, false) AS required FROM l),
s AS (SELECT *, core = 'refuted' AS refuted, core = 'unknown' OR date = 'unknown' OR (required AND provenance = 'unknown') AS unknown FROM f),
v AS (SELECT *, CASE WHEN proposed = 'FALSE' AND NOT refuted OR proposed = 'TRUE' AND (core <> 'supported' OR unknown) THEN 'NEI' ELSE proposed END AS verdict FROM s)"""
_REASONS = "array_to_string(list_filter([CASE WHEN core <> 'supported' THEN 'core ' || core END, CASE WHEN required AND provenance = 'unknown' THEN 'provenance unknown' END, CASE WHEN date = 'unknown' THEN 'date unknown' END], lambda x: x IS NOT NULL)[1:2], ' ')"


def _assessed(spark, d):
    rows = read(spark, d, "sale_lines").filter("sale_id IS NOT NULL AND line_no IS NOT NULL").groupBy(F.col("sale_id").alias("claim_id"), F.col("line_no").alias("component_id"))
    rows = rows.agg(F.max("quantity").alias("q"), F.max("discount").alias("disc"), F.max("amount").alias("amount"), F.max("vendor_id").alias("vendor"))
    core = F.when(F.col("q") > 25, "supported").when(F.col("q") < 5, "refuted").otherwise("unknown")
    day = F.when(F.col("disc").isNull(), "not_applicable").when(F.col("disc") > 0.03, "supported").otherwise("unknown")
    origin = F.when(F.col("vendor").isNull(), "unknown").otherwise("supported")
    of = F.explode(F.array(*(F.struct(F.lit(p).alias("pillar"), s.alias("status")) for p, s in (("core", core), ("date", day), ("provenance", origin)))))
    assessments = rows.select("claim_id", "component_id", of.alias("x")).select("claim_id", "component_id", "x.*").withColumn("explanation", F.concat_ws(" ", "pillar", "status"))
    proposed = F.when(F.col("amount") > 1000, "TRUE").when(F.col("amount") > 200, "FALSE").otherwise("NEI")
    decisions = rows.select("claim_id", "component_id", proposed.alias("verdict"), F.lit("as sold").alias("explanation"), F.coalesce(F.col("q") % 2 == 0, F.lit(False)).alias("provenance_required"))
    return assessments, decisions


@query(_LINES + f" SELECT claim_id, component_id, proposed, verdict, CASE WHEN verdict = proposed THEN 'as sold' ELSE coalesce(nullif({_REASONS}, ''), '{judging.NO_RATING}') END AS explanation FROM v")
def component_verdicts(spark, d):
    assessments, decisions = _assessed(spark, d)
    return judging.component_verdicts(assessments.withColumn("corrected", F.lit(False)), decisions).select("claim_id", "component_id", "proposed", "verdict", "explanation")


@query(_LINES + """, c AS (SELECT claim_id, bool_and(core = 'supported') AS core, bool_or(unknown) AS unknown, bool_or(refuted) AS refuted, bool_or(verdict = 'NEI') AS open FROM v GROUP BY claim_id),
p AS (SELECT sale_id AS claim_id, min(CASE WHEN status = 'done' THEN 'TRUE' WHEN status = 'open' THEN 'FALSE' ELSE 'NEI' END) AS proposed FROM sales WHERE sale_id IS NOT NULL GROUP BY sale_id)
SELECT p.claim_id, proposed, CASE WHEN proposed = 'FALSE' AND NOT refuted OR proposed = 'TRUE' AND (NOT core OR unknown OR refuted OR open) THEN 'NEI' ELSE proposed END AS verdict FROM p JOIN c ON c.claim_id = p.claim_id""")
def overall_verdicts(spark, d):
    assessments, decisions = _assessed(spark, d)
    verdicts = judging.component_verdicts(assessments.withColumn("corrected", F.lit(False)), decisions)
    asked = F.when(F.col("status") == "done", "TRUE").when(F.col("status") == "open", "FALSE").otherwise("NEI")
    claims = read(spark, d, "sales").filter("sale_id IS NOT NULL").groupBy(F.col("sale_id").alias("claim_id")).agg(F.min(asked).alias("verdict"), F.lit("as sold").alias("explanation"))
    components = decisions.select("claim_id", "component_id", F.col("component_id").alias("place"))
    return judging.overall(claims, judging.claim_verdicts(components, verdicts)).select("claim_id", "proposed", "verdict")


# Reviews: a line's finding and what another look at its vendor says, with quotes from the vendor's name.


@query(_LINES + """, n AS (SELECT vendor_id, max(name) AS name FROM vendors GROUP BY vendor_id), r AS (SELECT f.*, CASE WHEN amount > 500 THEN core WHEN amount > 250 THEN 'unknown' ELSE 'refuted' END AS said, length(trim(substr(n.name, 1, 9))) >= 8 AS cited FROM f LEFT JOIN n ON n.vendor_id = f.vendor),
m AS (SELECT *, core <> said AND said <> 'unknown' AND core <> 'unknown' AS reverses, coalesce(cited, false) AS held FROM r)
SELECT claim_id, component_id, CASE WHEN reverses THEN core WHEN said <> 'unknown' AND NOT held THEN 'unknown' ELSE said END AS status,
CASE WHEN reverses THEN 'core ' || core WHEN said <> 'unknown' AND NOT held THEN 'Insufficient independently grounded evidence.' ELSE 'looked again' END AS explanation, reverses OR (said <> 'unknown' AND NOT held) AS corrected FROM m""")
def reviewed_findings(spark, d):
    key = ["claim_id", "component_id"]
    own = _assessed(spark, d)[0].filter("pillar = 'core'")
    lines = read(spark, d, "sale_lines").filter("sale_id IS NOT NULL AND line_no IS NOT NULL").groupBy(F.col("sale_id").alias("claim_id"), F.col("line_no").alias("component_id")).agg(F.max("amount").alias("amount"), F.max("vendor_id").alias("vendor_id"))
    said = F.when(F.col("amount") > 500, F.col("status")).when(F.col("amount") > 250, "unknown").otherwise("refuted")
    reviews = own.join(lines, key).select(*key, "pillar", said.alias("status"), F.lit("looked again").alias("explanation"), F.lit(None).cast("string").alias("error"))
    names = read(spark, d, "vendors").groupBy("vendor_id").agg(F.max("name").alias("name"))
    evidence = lines.join(names, "vendor_id").select("claim_id", F.concat(F.lit("v"), F.col("component_id").cast("string")).alias("evidence_id"), F.lit("retrieved_page").alias("type"), F.lit(True).alias("verified"), F.col("name").alias("text"))
    quotes = reviews.join(lines, key).join(names, "vendor_id").select(*key, "pillar", F.when(F.col("status") == "supported", "supports").otherwise("refutes").alias("side"), F.concat(F.lit("v"), F.col("component_id").cast("string")).alias("evidence_id"), F.substring("name", 1, 9).alias("quote"))
    usable = judging.usable(quotes, evidence)
    return judging.reviewed(own, reviews, usable, usable)[0].select(*key, "status", "explanation", "corrected")
