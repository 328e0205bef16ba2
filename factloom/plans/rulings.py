"""Queries over the rule operators: dates, places, sources, provenance, evidence and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..operators import entities, evidence, prompts, provenance, rules, verdicts
from .registry import by_form, query, read

NULL = "CAST(NULL AS STRING)"

# Dates

_DAY = "date_add(DATE '2020-01-01', CAST(o_orderkey % 900 AS INTEGER))"
_SQL_DAY = "(DATE '2020-01-01' + CAST(o_orderkey % 900 AS INTEGER))"


def _days(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.expr(_DAY).alias("day"))


_VALUES = ["date_format(day, 'MMMM d, yyyy')", "date_format(day, 'yyyy-MM-dd')", "date_format(day, 'MMMM yyyy')", "date_format(day, 'yyyy')", "concat('from ', date_format(day, 'MMMM d'), ' to ', date_format(date_add(day, 40), 'MMMM d, yyyy'))", "'no date'"]
_TOLD = ["concat('Seen on ', date_format(day, 'd MMM yyyy'), ', they say.')", "concat('On ', date_format(day, 'yyyy/M/d'), ' it was posted')", "concat('In ', date_format(day, 'MMMM'), ' of the year ', date_format(day, 'yyyy'))", "concat('It was ', date_format(day, 'yyyy'), '.')", "concat('Between ', date_format(day, 'd MMMM'), ' and ', date_format(date_add(day, 40), 'MMMM d'), ' of ', date_format(day, 'yyyy'), ' or ', date_format(date_add(day, 40), 'yyyy'))", "'no date at all'"]
_OFF = "date_format(date_add(day, 32), 'd MMMM yyyy')"


@query(f"""WITH o AS (SELECT o_orderkey, {_SQL_DAY} AS day FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN false WHEN (o_orderkey // 6) % 2 = 0 THEN year(day) = year(day + 40) OR o_orderkey % 6 <> 4
WHEN o_orderkey % 6 = 3 THEN year(day) = year(day + 32) ELSE false END AS grounded FROM o""")
def date_grounded(spark, d):
    case = lambda forms: F.expr("CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END")
    rows = _days(spark, d).withColumn("raw", case(_VALUES)).withColumn("told", F.when(F.expr("(o_orderkey div 6) % 2 = 0"), case(_TOLD)).otherwise(F.expr(_OFF)))
    return dates.parse(rows, "raw", "p").select("o_orderkey", dates.grounded(F.col("raw"), F.col("p"), F.col("told")).alias("grounded"))


@query(f"""WITH o AS (SELECT o_orderkey, {_SQL_DAY} AS day FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 4) THEN strftime(day, '%Y-%m-%d') END AS plain, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 3, 4) THEN strftime(day, '%Y-%m-%d') END AS found, strftime(day, '%Y-%m-%d') AS seconds, strftime(day, '%Y-%m-%d') AS millis FROM o""")
def dates_as_supplied(spark, d):
    forms = ["date_format(day, 'yyyyMMdd')", "date_format(day, ' yyyy-MM-dd ')", "concat(date_format(day, 'yyyyMMdd'), '.0')", "concat('at ', date_format(day, 'yyyy-MM-dd'), 'T10:00:00Z')", "date_format(day, 'yyyy-M-d')", "concat('x', date_format(day, 'yyyy-MM'))"]
    raw = F.expr("CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END")
    seconds = F.unix_date("day").cast("long") * 86400 + 3600
    rows = _days(spark, d)
    return rows.select("o_orderkey", dates.plain_date(raw).alias("plain"), dates.any_date(raw).alias("found"), dates.epoch_date(seconds).alias("seconds"), dates.epoch_date(seconds * 1000).alias("millis"))


@query(f"""WITH o AS (SELECT o_orderkey, {_SQL_DAY} AS day FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day, '%Y-%m') WHEN 2 THEN strftime(day, '%Y') WHEN 3 THEN 'on a ' || strftime(day, '%Y') || ' day' ELSE strftime(day, '%Y-%m-') || '03 to ' || strftime(day, '%Y-%m-') || '05' END AS date FROM o""")
def calendar_dates(spark, d):
    forms = ["concat('On ', date_format(day, 'MMMM d, yyyy'))", "concat('in ', date_format(day, 'MMM yyyy'))", "date_format(day, 'yyyy')", "concat('on a ', date_format(day, 'yyyy'), ' day')", "concat('from 3 to 5 ', date_format(day, 'MMMM yyyy'))"]
    rows = _days(spark, d).withColumn("raw", F.expr("CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"))
    return dates.calendar_date(rows, "raw", "date").select("o_orderkey", "date")


_PRIOR = [NULL, "'same'", "'wrong event date'", "'never heard of'"]


@query(f"""WITH o AS (SELECT o_orderkey, {_SQL_DAY} AS day, o_orderkey // 7 AS k FROM orders),
s AS (SELECT *, CASE k % 4 WHEN 1 THEN 'same' WHEN 2 THEN 'wrong event date' END AS prior FROM o)
SELECT o_orderkey,
CASE o_orderkey % 7 WHEN 2 THEN strftime(day, '%Y-%m') WHEN 4 THEN 'Sometime' WHEN 6 THEN NULL WHEN 5 THEN 'long ago' ELSE strftime(day, '%Y-%m-%d') END AS claimed_date,
CASE o_orderkey % 7 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day - 10, '%Y-%m-%d') WHEN 2 THEN strftime(day, '%Y-%m-%d') WHEN 3 THEN NULL WHEN 4 THEN 'sometime ' WHEN 5 THEN 'back then' ELSE strftime(day, '%Y-%m-%d') END AS estimated_date,
CASE o_orderkey % 7 WHEN 3 THEN NULL WHEN 4 THEN 'unknown' WHEN 5 THEN 'unknown' ELSE 'day' END AS granularity,
CASE o_orderkey % 7 WHEN 0 THEN 'same' WHEN 1 THEN CASE WHEN prior = 'wrong event date' THEN prior ELSE 'older video' END WHEN 2 THEN 'same' WHEN 4 THEN 'same' WHEN 5 THEN nullif(prior, 'same') END AS mismatch FROM s""")
def date_fields(spark, d):
    e = ["date_format(day, 'MMMM d, yyyy')", "date_format(date_sub(day, 10), 'yyyy-MM-dd')", "date_format(day, 'd MMM yyyy')", "date_format(date_add(day, 100), 'yyyy-MM-dd')", "'sometime '", "'back then'", "date_format(day, 'yyyy/MM/dd')"]
    c = ["date_format(day, 'yyyy-MM-dd')", "date_format(day, 'd MMMM yyyy')", "date_format(day, 'yyyy-MM')", "date_format(day, 'yyyy-MM-dd')", "'Sometime'", "'long ago'", NULL]
    case = lambda forms, key="o_orderkey": F.expr(f"CASE {key} % {len(forms)} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END")
    rows = _days(spark, d).withColumns({"e": case(e), "c": case(c), "u": F.date_format("day", "yyyy-MM-dd"), "prior": case(_PRIOR, "(o_orderkey div 7)")})
    for column in "ecu":
        rows = dates.parse(rows, column, f"p{column}")
    out = rules.date_fields(F.col("e"), F.col("pe"), F.col("c"), F.col("pc"), F.col("pu"), F.col("prior"))
    return rows.select("o_orderkey", *(v.alias(k) for k, v in out.items()))


# Sources

by_form(
    "source_fields", "orders", "o_orderkey",
    {
        "name": ["'AFP'", "concat('Blog ', n)", "'Reuters'", "''", "'YouTube'", f"{NULL}", "'The Onion Files'", "'BBC'", "'CNN'"],
        "uploader": ["'Agence France-Presse'", "concat('blog', n)", "'CNN'", "'CNN'", "'x'", "'y'", "'The Onion Files'", "'unknown'", "'@cnn'"],
        "kind": [NULL, "'unknown'", "'news agency'", "'news outlet'", "'odd kind'", "'eyewitness'", "'unknown'", NULL, "'unknown'"],
        "told": ["'an AFP report'", "'nothing'", "'Reuters said it is fiction'", "'x'", "'x'", "'x'", "concat('the onion files are ', repeat('z ', 150), ' satire')", "concat('BBC ', repeat('w ', 300), 'satire')", "'CNN on satire'"],
        "protected": ["false", "false", "false", "false", "false", "false", "false", "false", "true"],
    },
    {
        "kind": ["'news outlet'", "'unknown'", "'news agency'", "NULL", "'unknown'", "NULL", "'satire source'", "'news outlet'", "'news outlet'"],
        "mismatch": ["true", "true", "true", "NULL", "true", "NULL", "true", "true", "true"],
        "is_uploader": ["true", "n >= 1", "false", "NULL", "NULL", "NULL", "true", "NULL", "true"],
    },
    lambda name, uploader, kind, told, protected: entities.source_fields(name, uploader, kind, F.lit(True), told, protected),
)
by_form(
    "source_named", "orders", "o_orderkey",
    {"name": ["'NY Times'", "concat('Paper ', n)", "concat('Paper ', n)", "'YouTube'", "'AP'", "'n/a'"], "told": ["'as The New York Times wrote'", "concat('the PAPER ', n, ' wrote')", "concat('the paper ', n, '0 wrote')", "'on YouTube'", "'a map of apes'", "'n/a'"]},
    {"named": ["true", "true", "false", "false", "false", "false"], "known": ["true", "true", "true", "false", "true", "false"], "shown": ["'The New York Times'", "NULL", "NULL", "NULL", "'AP News'", "NULL"]},
    lambda name, told: {"named": entities.is_named(name, told), "known": entities.is_known(name), "shown": entities.shown_name(name)},
)
by_form(
    "platform_names", "orders", "o_orderkey",
    {"raw": ["' Twitter '", "'YOUTU'", "'redd'", "'tiktokcdn'", NULL, "''", "concat('site', n)", "'nytimes'"]},
    {"platform": ["'x'", "'youtube'", "'reddit'", "'tiktok'", "'unknown'", "'unknown'", "concat('site', n)", "'nytimes'"], "official": ["NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "'The New York Times'"]},
    lambda raw: {"platform": rules.platform(raw), "official": entities.platform_source(rules.platform(raw))},
)

# Places

by_form(
    "place_fields", "orders", "o_orderkey",
    {
        "told": ["concat('It was filmed in Brazil, not the United States. ', n)", "'not Paris but Berlin'", "'nothing'", "'nothing'", "'nothing'", "'The clip was actually filmed in Old Goa'", "'It was not actually filmed in Rome, the video is from New Delhi'", "'shows footage of Kyoto Tower'"],
        "claimed": ["'x'", "'x'", "'Lima'", "'Lima'", "'Lima'", "'Pune'", NULL, "'Kyoto'"],
        "verified": ["'y'", "'y'", "'LIMA'", "'Quito'", "''", NULL, NULL, "'Osaka'"],
        "mismatch": ["'different country'", "'same'", NULL, "'same'", "'different city'", "'different city'", "'same'", "'different region'"],
    },
    {
        "claimed": ["'United States'", "'Paris'", "'Lima'", "'Lima'", "'Lima'", "'Pune'", "NULL", "'Kyoto'"],
        "verified": ["'Brazil'", "'Berlin'", "'LIMA'", "'Quito'", "''", "'Old Goa'", "'New Delhi'", "'Osaka'"],
        "mismatch": ["'different country'", "NULL", "'same'", "NULL", "NULL", "'different city'", "NULL", "'different region'"],
    },
    lambda told, claimed, verified, mismatch: entities.place_fields(claimed, verified, mismatch, rules.place_contrast(told)),
)
by_form(
    "plausible_places", "events", "event_id",
    {"names": ["array('Paris', 'paris', ' Paris ', 'Central Park')", "array('New York City', concat('wearing Red ', n), 'New York City')", "array('Al', 'Goa', concat('Old Town district, ', 'Goa'))", "CAST(array() AS ARRAY<STRING>)"]},
    {"places": ["'Paris'", "'New York City'", "'Goa|Old Town district, Goa'", "''"], "first": ["'Paris'", "'New York City'", "'Goa'", "NULL"]},
    lambda names: {"places": F.array_join(entities.plausible_places(names), "|"), "first": F.get(entities.plausible_places(names), 0)},
)
by_form(
    "target_places", "events", "event_id",
    {"addresstype": ["'State_District'", "'road'", NULL, "'hamlet'"], "kind": ["'x'", "'city'", "'Country'", "'village'"], "city": [NULL, "'  São  Paulo '", "''", "concat('Town-', n)"], "country": ["'Bénin'", "'Brasil'", "'Perú'", "'X'"]},
    {"target": ["true", "true", "true", "false"], "address": ["'benin'", "'sao paulo'", "'peru'", "concat('town ', n)"]},
    lambda a, k, city, country: {"target": entities.is_target_place(a, k), "address": entities.address_value(F.create_map(F.lit("city"), city, F.lit("country"), country), ["city", "country"])},
)


@query("""WITH v AS (SELECT user_id, event_type AS name, list_sort(list(DISTINCT CASE event_id % 3 WHEN 0 THEN 'claim' WHEN 1 THEN 'web' ELSE 'vision' END)) AS groups FROM events WHERE event_id % 7 < 2 GROUP BY ALL)
SELECT user_id, CASE WHEN count(*) FILTER (list_contains(groups, 'claim')) = 1 THEN min(name) FILTER (list_contains(groups, 'claim')) END AS claimed FROM v GROUP BY user_id""")
def claimed_place(spark, d):
    group = F.when(F.col("event_id") % 3 == 0, "claim").when(F.col("event_id") % 3 == 1, "web").otherwise("vision")
    rows = read(spark, d, "events").filter("event_id % 7 < 2").groupBy("user_id", F.col("event_type").alias("name")).agg(F.collect_set(group).alias("groups"))
    of = rows.groupBy("user_id").agg(F.collect_list(F.struct("name", "groups")).alias("all"))
    return of.select("user_id", entities.choose_claimed(F.col("all")).alias("claimed"))


# Provenance

by_form(
    "provenance_fields", "orders", "o_orderkey",
    {"summary": [NULL, "''", "concat('was ', n)", "concat('is ', n)"], "status": ["'repost'", "'odd'", NULL, "'compilation'"], "framing": ["'f'", "'f'", "'f'", "concat('is ', n)"]},
    {"summary": ["NULL", "NULL", "concat('was ', n)", "NULL"], "mismatch": ["NULL", "NULL", "true", "NULL"], "status": ["'repost'", "'unknown'", "'unknown'", "'compilation'"]},
    lambda summary, status, framing: provenance.status_fields(summary, F.lit(True), status, framing),
)

_MATCH = """WITH m AS (SELECT user_id, event_id, 'https://example.com/' || (floor(value)::INTEGER) AS url, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS date,
CASE event_id % 3 WHEN 0 THEN 'reverse_image' WHEN 1 THEN 'caption_search' ELSE 'visual' END AS source FROM events WHERE event_id % 2 = 0),
b AS (SELECT user_id, url, arg_min(event_id, (source <> 'visual', event_id)) AS event_id FROM m GROUP BY ALL)"""


def _matches(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, "reverse_image").when(F.col("event_id") % 3 == 1, "caption_search").otherwise("visual")
    rows = read(spark, d, "events").filter("event_id % 2 = 0")
    day = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd"))
    return rows.select("user_id", "event_id", F.concat(F.lit("https://example.com/"), F.floor("value").cast("string")).alias("url"), day.alias("date"), kind.alias("source"))


@query(_MATCH + " SELECT b.user_id, b.url, m.source, m.date, row_number() OVER (PARTITION BY b.user_id ORDER BY m.date IS NULL, m.date, b.url) AS rank FROM b JOIN m USING (event_id)")
def merged_matches(spark, d):
    return provenance.merged(_matches(spark, d), "user_id", "url", "source", "event_id", ["date"]).select("user_id", "url", "source", "date", "rank")


@query(_MATCH + """, c AS (SELECT user_id, 'https://example.com/own' AS url, strftime(min(ts) + INTERVAL 3 DAY, '%Y-%m-%d') AS date FROM events GROUP BY user_id),
u AS (SELECT user_id, 0 AS priority, url, date FROM c UNION ALL SELECT b.user_id, 1, b.url, m.date FROM b JOIN m USING (event_id)),
e AS (SELECT user_id, min(struct_pack(date := date, priority := priority, url := url)) AS e FROM u WHERE date IS NOT NULL GROUP BY user_id)
SELECT user_id, e.url AS url, e.date AS date, CASE WHEN e.url <> c.url AND e.date < c.date THEN 'earlier version found' ELSE 'unknown' END AS status, least(e.date, CASE WHEN e.url = c.url THEN '2023-01-01' END) AS online FROM e JOIN c USING (user_id)""")
def earliest_place(spark, d):
    found = provenance.merged(_matches(spark, d), "user_id", "url", "source", "event_id", ["date"])
    own = read(spark, d, "events").groupBy("user_id").agg(F.date_format(F.min("ts") + F.expr("INTERVAL 3 DAYS"), "yyyy-MM-dd").alias("date"))
    own = own.select("user_id", F.lit("https://example.com/own").alias("url"), "date")
    met = provenance.earliest(found, own, "user_id").join(own.toDF("user_id", "own_url", "own_date"), "user_id")
    status = provenance.found_status(F.col("url"), F.col("date"), F.col("own_url"), F.col("own_date"), F.col("own_date"))
    same = urls.match_key(F.col("url")) == urls.match_key(F.col("own_url"))
    return met.select("user_id", "url", "date", status.alias("status"), provenance.online_date(F.col("date"), F.lit("2023-01-01"), same).alias("online"))


by_form(
    "search_phrases", "events", "event_id",
    {"kind": ["'transcript'", "'caption'", "'account'", "'caption'", "'transcript'"], "query": ["concat('\"Said  It ', n, '\"')", "concat('\"said it ', n, '\"')", "'\"said\"'", "'\"\"'", "concat('\"end start ', n, '\"')"], "title": ["concat('they said it ', n, ' times')", "'nothing'", "'said'", "'x'", "'the end'"], "described": ["'x'", NULL, "'x'", "'x'", "concat('start ', n)"]},
    {"has_phrase": ["true", "false", "false", "false", "true"], "image": ["true", "true", "false", "true", "true"], "seen": ["'2020-01-02'", "'2020-01-02'", "'2020-01-02'", "'2020-01-02'", "'2020-01-02'"]},
    lambda kind, query, title, described: {"has_phrase": provenance.has_phrase(kind, query, title, described), "image": provenance.is_image_match(F.when(kind == "account", F.array(F.lit("unspecified"))).otherwise(F.array(F.lit("unspecified"), F.lit("partial")))), "seen": provenance.candidate_date(F.lit(None).cast("string"), F.lit("2021-01-01"), F.lit("2020-01-02"))},
)

# Evidence and verdicts


@query("""SELECT event_id, replace(event_type, '_', '-') || '-' || substr(sha256('["' || event_type || '", "u' || user_id || '", "' || replace(replace(replace(props, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '", ' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '"m' || event_id % 3 || '"' END || ']'), 1, 10) AS id FROM (SELECT * REPLACE (props || chr(10) || 'é' AS props) FROM events)""")
def labelled_evidence_id(spark, d):
    model = F.when(F.col("event_id") % 2 != 0, F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")))
    observed = F.concat("props", F.lit("\né"))
    return read(spark, d, "events").select("event_id", evidence.labelled_identity(F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")), observed, model).alias("id"))


@query("""WITH e AS (SELECT user_id AS claim, event_id AS evidence_id, event_type AS type FROM events), l AS (SELECT claim, evidence_id, 'field' || evidence_id % 3 AS field FROM e)
SELECT claim, field, count(*) AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.claim = l.claim AND e.evidence_id = l.evidence_id AND e.type = 'click') GROUP BY ALL""")
def evidence_without_type(spark, d):
    held = read(spark, d, "events").select(F.col("user_id").alias("claim"), F.col("event_id").alias("evidence_id"), F.col("event_type").alias("type"))
    links = held.select("claim", "evidence_id", F.concat(F.lit("field"), (F.col("evidence_id") % 3).cast("string")).alias("field"))
    _, left = evidence.without_type(held, links, "click", "claim")
    return left.groupBy("claim", "field").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
s AS (SELECT conv_id, k, turn, CASE WHEN size <= 2000 THEN size ELSE 0 END AS used, size <= 2000 AS kept FROM r WHERE k = 1
UNION ALL SELECT r.conv_id, r.k, r.turn, CASE WHEN s.used + r.size <= 2000 THEN s.used + r.size ELSE s.used END, s.used + r.size <= 2000 FROM s JOIN r ON r.conv_id = s.conv_id AND r.k = s.k + 1)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM s WHERE kept""")
def packed_evidence(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.char_length("text").alias("size"))
    return prompts.packed(rows, "conv_id", ["turn"], "size", 2000).select("conv_id", "turn", F.col("place").cast("long").alias("place"))


_ST = "CASE ({0}) % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'refuted' WHEN 2 THEN 'unknown' ELSE 'not_applicable' END"


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 5 THEN 'supported' ELSE {_ST.format("l_partkey % 8")} END AS core, {_ST.format("CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey ELSE 0 END")} AS place, {_ST.format("l_partkey")} AS prov, l_suppkey % 2 = 0 AS required FROM lineitem),
a AS (SELECT l_orderkey, core AS s, true AS is_core FROM c UNION ALL SELECT l_orderkey, place, false FROM c UNION ALL SELECT l_orderkey, prov, false FROM c WHERE required)
SELECT l_orderkey, CASE WHEN bool_or(s = 'refuted') THEN 'FALSE' WHEN bool_and(CASE WHEN is_core THEN s = 'supported' ELSE s <> 'unknown' END) THEN 'TRUE' ELSE 'NEI' END AS verdict FROM a GROUP BY l_orderkey""")
def claim_verdict(spark, d):
    st = lambda e: F.expr(_ST.format(e))
    rows = read(spark, d, "lineitem")
    core = F.when(F.col("l_linenumber") > 5, "supported").otherwise(st("l_partkey % 8"))
    parts = rows.select("l_orderkey", core.alias("core"), F.array(st("CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey ELSE 0 END")).alias("pillars"), st("l_partkey").alias("prov"), (F.col("l_suppkey") % 2 == 0).alias("required"))
    return verdicts.of_claims(parts, "l_orderkey", "core", "pillars", "prov", "required")


by_form(
    "assessments", "orders", "o_orderkey",
    {"status": ["'supported'", "'supported'", "'refuted'", "'refuted'", "'unknown'", "'not_applicable'", "'supported'", "'supported'"], "yes": ["1", "0", "2", "0", "0", "0", "1", "2"], "no": ["0", "0", "0", "3", "0", "0", "1", "0"], "applies": ["true", "true", "true", "true", "true", "false", "true", "false"], "said": ["concat('**Shown** ', n)", "'a'", "'b'", "'see [1]'", "'no word'", "'not asked'", "'c'", "'d'"]},
    {"status": ["'supported'", "'unknown'", "'unknown'", "'refuted'", "'unknown'", "'not_applicable'", "'unknown'", "'not_applicable'"], "explanation": ["concat('Shown ', n)", "'Insufficient independently grounded evidence.'", "'Insufficient independently grounded evidence.'", "'see'", "'no word'", "'not asked'", "'Supporting and refuting evidence remain in conflict.'", "'The claim does not assert this dimension.'"]},
    lambda status, yes, no, applies, said: verdicts.assessed(status, yes, no, applies, text.plain(said)),
)


@query("""WITH c AS (SELECT doc_id, lang, source, doc_id % 5 AS kind FROM documents), e AS (SELECT *, CASE kind WHEN 0 THEN 'retrieved_page' WHEN 1 THEN 'platform_metadata' WHEN 2 THEN 'archive_record' WHEN 3 THEN 'keyframe_analysis' ELSE 'model_text' END AS type FROM c), p AS (SELECT unnest(['core', 'source', 'location', 'date']) AS pillar)
SELECT pillar, type, count(*) AS n FROM e, p WHERE type = 'retrieved_page' OR (pillar = 'source' AND type = 'platform_metadata') OR (pillar IN ('core', 'location') AND type = 'keyframe_analysis') GROUP BY ALL""")
def evidence_by_pillar(spark, d):
    kind = F.col("doc_id") % 5
    of = F.when(kind == 0, "retrieved_page").when(kind == 1, "platform_metadata").when(kind == 2, "archive_record").when(kind == 3, "keyframe_analysis").otherwise("model_text")
    rows = read(spark, d, "documents").select(of.alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    asked = F.explode(F.array(*(F.lit(x) for x in ("core", "source", "location", "date")))).alias("pillar")
    met = rows.select("type", "n", asked)
    return met.filter(verdicts.may_support(F.col("pillar"), F.col("type"))).select("pillar", "type", "n")


by_form(
    "answered_enums", "orders", "o_orderkey",
    {"raw": ["' Satire '", "'NEWS REPORT'", "concat('odd ', n)", NULL]},
    {"value": ["'satire'", "'news report'", "NULL", "NULL"]},
    lambda raw: {"value": rules.enum_value(raw, rules.CONTEXTS)},
)
