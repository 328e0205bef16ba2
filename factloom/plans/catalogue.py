"""All registered queries outside the training-data part, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, sources, text, urls
from ..operators import evidence, matching, rules, splits
from ..sources import records
from ..streaming import earliest
from .registry import ORACLES, QUERIES, by_form, query  # noqa: F401
from .registry import read as _t

# Links

_CUT = r"""
WITH p AS (SELECT page_id, url, trim(url) AS u FROM pages),
c AS (SELECT page_id, url, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
        regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS net,
        regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) AS path,
        list_sort(list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '')) AS q FROM p),
k AS (SELECT page_id, url,
        regexp_replace(lower(net), '^www\.', '') AS site, rtrim(path, '/') AS place, array_to_string(q, '&') AS qt FROM c),
keyed AS (SELECT page_id, url, CASE WHEN place = '' AND qt = '' THEN 'claim:' || page_id
        ELSE CASE WHEN site = 'twitter.com' THEN 'x.com' ELSE site END || CASE WHEN place = '' THEN '/' ELSE place END || CASE WHEN qt <> '' THEN '?' || qt ELSE '' END END AS key FROM k)
"""
_BUCKET = "CAST('0x' || substr(sha256('42:' || key), 1, 8) AS BIGINT) % 100"
_SPLIT = f"CASE WHEN {_BUCKET} < 70 THEN 'train' WHEN {_BUCKET} < 85 THEN 'validation' ELSE 'test' END"


def _keyed(spark, d):
    return _t(spark, d, "pages").select(F.col("page_id").alias("id"), "url", urls.canonical_key(F.col("url"), F.col("page_id").cast("string")).alias("key"))


@query(_CUT + "SELECT page_id, key FROM keyed")
def url_canonical_key(spark, d):
    return _keyed(spark, d).select(F.col("id").alias("page_id"), "key")


@query(_CUT + r"""SELECT page_id, CASE WHEN scheme IN ('http', 'https') THEN 'https://' || lower(net) || rtrim(path, '/') || CASE WHEN len(f) > 0 THEN '?' || array_to_string(f, '&') ELSE '' END ELSE u END AS source
FROM (SELECT *, list_filter(q, lambda x: NOT starts_with(lower(x), 'utm_') AND NOT regexp_matches(x, '^(fbclid|gclid)=') AND NOT regexp_matches(x, '=$') AND contains(x, '=')) AS f FROM c)""")
def url_evidence_canonical(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.evidence_source(F.col("url")).alias("source"))


@query(_CUT + r"""SELECT page_id, scheme || '://' || lower(net) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN contains(url, '?') AND regexp_extract(url, '^[^?#]*\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1) ELSE '' END AS key FROM c""")
def url_retrieval_key(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.retrieval_key(F.col("url")).alias("key"))


_LINKS = ["ftp://a.b", "http://localhost", "http://10.0.0.1/x", "http://u:p@a.com", "https://a.com", "http://172.20.1.1", "http://8.8.8.8/dns", "https://www.snopes.com/x", "https://web.archive.org/web/2020/https://snopes.com/x", "https://x.com/snopes/status/1", "https://example.com/fact-check/a", "https://example.com/a", "https://m.facebook.com/pages/PolitiFact", "https://youtu.be/abc?t=1"]
_VALUES = ", ".join(f"('{x}')" for x in _LINKS)


def _links(spark, d):
    return _t(spark, d, "pages").select("url").union(spark.createDataFrame([(x,) for x in _LINKS], "url string"))


@query(f"""WITH l AS (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES {_VALUES}) v(url)),
h AS (SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS net FROM l)
SELECT url, count(*) AS n FROM h WHERE regexp_matches(url, '^https?:') AND net <> '' AND NOT contains(net, '@') AND lower(net) <> 'localhost'
AND NOT regexp_matches(net, '^(0|10|127)\\.|^192\\.168\\.|^169\\.254\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.') GROUP BY url""".replace("\\\\", "\\"))
def url_public_filter(spark, d):
    return _links(spark, d).filter(urls.is_public(F.col("url"))).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH l AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES {_VALUES}) v(url))),
o AS (SELECT url, CASE WHEN regexp_matches(url, '^https?://web.archive.org/web/') THEN regexp_extract(url, '/web/[^/]+/(https?://.+)', 1) ELSE url END AS u FROM l),
h AS (SELECT url, u, lower(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM o)
SELECT url, (regexp_matches(host, '(^|\\.)({"|".join(x.replace(".", "[.]") for x in urls.FACTCHECK_DOMAINS)})$')
  OR (regexp_matches(host, '^(www\\.)?(m\\.)?({"|".join(urls.SOCIAL_HOSTS)})$') AND regexp_matches(lower(path), '^/((c|user|pages)/)?({"|".join(urls.FACTCHECK_HANDLES)})(/|$)'))
  OR regexp_matches(path, '{urls.FACTCHECK_LABEL}', 'i')) AS is_factcheck FROM h""".replace("\\\\", "\\"))
def factcheck_url_screen(spark, d):
    return _links(spark, d).select("url").distinct().select("url", urls.is_factcheck(F.col("url")).alias("is_factcheck"))


@query(f"""SELECT doc_id, (regexp_matches(text, '{urls.FACTCHECK_LABEL}', 'i') OR regexp_matches(text, '{text.MARKER}', 'i') OR regexp_matches(text, '{text.ATTRIBUTION}', 'i')
OR (regexp_matches(text, '{text.CONCLUSION}', 'i') AND regexp_matches(text, '{text.CUE}', 'i'))) AS is_factcheck FROM documents""")
def factcheck_text_screen(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.is_factcheck(F.col("text")).alias("is_factcheck"))


# Splits and groups


@query(_CUT + f"SELECT page_id, {_BUCKET} AS bucket, {_SPLIT} AS split FROM keyed")
def split_assign(spark, d):
    return _keyed(spark, d).select(F.col("id").alias("page_id"), splits.bucket(F.col("key")).alias("bucket"), splits.split(splits.bucket(F.col("key"))).alias("split"))


@query(_CUT + f"SELECT {_SPLIT} AS split, count(*) AS n, count(DISTINCT key) AS n_keys FROM keyed GROUP BY 1")
def split_counts(spark, d):
    return _keyed(spark, d).groupBy(splits.split(splits.bucket(F.col("key"))).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_keys"))


@query(_CUT + f""", s AS (SELECT key, CASE WHEN page_id % 97 = 0 THEN 'test' ELSE {_SPLIT} END AS split FROM keyed)
SELECT count(*) AS n_keys, count(*) FILTER (n > 1) AS n_groups, max(n) AS largest, count(*) FILTER (s > 1) AS n_leaks
FROM (SELECT key, count(*) AS n, count(DISTINCT split) AS s FROM s GROUP BY key)""")
def split_leak_check(spark, d):
    # The split that is checked was written down with the record, so a group can stand in two of them; here some are misfiled.
    own = splits.split(splits.bucket(F.col("key")))
    rows = _keyed(spark, d).withColumn("split", F.when(F.col("id") % 97 == 0, "test").otherwise(own))
    of = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("low"), F.max("split").alias("high"))
    return of.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_groups"), F.max("n").alias("largest"), F.count_if(F.col("low") != F.col("high")).alias("n_leaks"))


@query("""SELECT md5(text) AS key, count(*) AS members, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY md5(text) HAVING count(*) > 1""")
def dup_groups(spark, d):
    return splits.groups(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("key")), "key")


# Reports


@query("SELECT coalesce(CAST(quality AS VARCHAR), 'none') AS rating, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def rating_histogram(spark, d):
    rows = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("rating")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source AS split, coalesce(quality, -1) AS rating, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def split_x_rating(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "source").join(_t(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy(F.col("source").alias("split"), F.coalesce("quality", F.lit(-1)).alias("rating")).agg(F.count(F.lit(1)).alias("n"))


_FIELDS = ["lang", "source", "quality", "toxic"]


def _filled(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "lang", "source").join(_t(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", "lang", *(F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), False).otherwise(True).alias(f"has_{f}") for f in _FIELDS))


_HAS = "WITH f AS (SELECT doc_id, lang, " + ", ".join(f"coalesce(CAST({f} AS VARCHAR), '') <> '' AS has_{f}" for f in _FIELDS) + " FROM documents LEFT JOIN labels USING (doc_id)) "


@query(_HAS + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (has_{f}) AS filled, count(*) FILTER (NOT has_{f}) AS missing FROM f" for f in _FIELDS))
def field_coverage(spark, d):
    rows = _filled(spark, d).select(F.expr(f"stack({len(_FIELDS)}, " + ", ".join(f"'{f}', has_{f}" for f in _FIELDS) + ") AS (field, filled)"))
    return rows.groupBy("field").agg(F.count_if("filled").alias("filled"), F.count_if(~F.col("filled")).alias("missing"))


@query(_HAS + "SELECT lang AS pillar, sum(" + " + ".join(f"CAST(has_{f} AS BIGINT)" for f in _FIELDS) + f") AS filled, count(*) * {len(_FIELDS)} AS cells FROM f GROUP BY lang")
def fill_rate(spark, d):
    total = sum((F.col(f"has_{f}").cast("long") for f in _FIELDS[1:]), F.col(f"has_{_FIELDS[0]}").cast("long"))
    return _filled(spark, d).groupBy(F.col("lang").alias("pillar")).agg(F.sum(total).cast("decimal(38,0)").cast("long").alias("filled"), (F.count(F.lit(1)) * len(_FIELDS)).alias("cells"))


@query(_HAS + "SELECT count(*) AS n, count(*) FILTER (NOT has_quality) AS first_missing, count(*) FILTER (NOT has_toxic) AS second_missing, count(*) FILTER (NOT has_quality AND NOT has_toxic) AS both_missing, count(*) FILTER (NOT has_quality OR NOT has_toxic) AS any_missing FROM f")
def missing_overlap(spark, d):
    a, b = ~F.col("has_quality"), ~F.col("has_toxic")
    return _filled(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("first_missing"), F.count_if(b).alias("second_missing"), F.count_if(a & b).alias("both_missing"), F.count_if(a | b).alias("any_missing"))


@query("SELECT count(*) FILTER (toxic IS NOT NULL) AS compared, count(*) FILTER (toxic IS NOT NULL AND quality = toxic) AS equal FROM documents LEFT JOIN labels USING (doc_id)")
def match_note(spark, d):
    rows = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left")
    known = F.col("toxic").isNotNull()
    return rows.agg(F.count_if(known).alias("compared"), F.count_if(known & (F.col("quality") == F.col("toxic"))).alias("equal"))


_DECISION = "CASE o_orderstatus WHEN 'F' THEN 'keep' WHEN 'O' THEN 'unknown' ELSE 'discard' END"


@query(f"SELECT o_orderpriority AS field, count(*) AS total, count(*) FILTER ({_DECISION} = 'keep') AS kept, count(*) FILTER ({_DECISION} = 'discard') AS discarded, count(*) FILTER ({_DECISION} = 'unknown') AS unknown FROM orders GROUP BY 1")
def decision_breakdown(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("field"), F.expr(_DECISION).alias("x"))
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("x") == "keep").alias("kept"), F.count_if(F.col("x") == "discard").alias("discarded"), F.count_if(F.col("x") == "unknown").alias("unknown"))


@query(f"SELECT o_custkey AS key, CASE WHEN bool_or(x = 'keep') THEN 'keep' WHEN bool_or(x = 'unknown') THEN 'unknown' ELSE 'discard' END AS decision, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM (SELECT *, {_DECISION} AS x FROM orders) GROUP BY 1")
def group_decision(spark, d):
    rows = _t(spark, d, "orders").withColumn("x", F.expr(_DECISION))
    decision = F.when(F.bool_or(F.col("x") == "keep"), "keep").when(F.bool_or(F.col("x") == "unknown"), "unknown").otherwise("discard")
    return rows.groupBy(F.col("o_custkey").alias("key")).agg(decision.alias("decision"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


_PARTS = {"keep": "o_orderstatus = 'F' OR o_orderkey % 1000 = 1", "discard": "o_orderstatus = 'P' AND o_orderkey % 50 > 0", "unknown": "o_orderstatus = 'O'"}


@query("WITH p AS (SELECT o_orderkey, " + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in _PARTS.values()) + " AS parts FROM orders) SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_ids, count(*) FILTER (parts > 0) AS covered, count(*) FILTER (parts > 1) AS overlapping FROM p")
def partition_identity(spark, d):
    # Kept, discarded and unknown ids are lists of their own: every id has to be in one, and none in two.
    orders = _t(spark, d, "orders")
    lists = [orders.filter(c).select("o_orderkey", F.lit(1).alias("part")) for c in _PARTS.values()]
    listed = lists[0].union(lists[1]).union(lists[2]).groupBy("o_orderkey").agg(F.sum("part").alias("parts"))
    of = orders.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")).join(listed, "o_orderkey", "left")
    return of.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("parts") > 0).alias("covered"), F.count_if(F.col("parts") > 1).alias("overlapping"))


# Selection and sinks


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_select(spark, d):
    chosen = _t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return _t(spark, d, "orders").select("o_orderkey", "o_custkey").join(chosen, "o_custkey", "left_semi")


@query("SELECT doc_id, 'old' AS state FROM labels UNION ALL SELECT doc_id, 'new' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_if_absent(spark, d):
    old = _t(spark, d, "labels").select("doc_id")
    new = _t(spark, d, "documents").select("doc_id").join(old, "doc_id", "left_anti")
    return old.withColumn("state", F.lit("old")).union(new.withColumn("state", F.lit("new")))


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def audit_dangling(spark, d):
    return _t(spark, d, "labels").select("doc_id").join(_t(spark, d, "documents").select("doc_id"), "doc_id", "left_anti")


@query("SELECT lang, count(*) AS unsupported FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang")
def audit_unsupported(spark, d):
    return _t(spark, d, "documents").select("doc_id", "lang").join(_t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("unsupported"))


# Dates

_FORMS = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m') WHEN 3 THEN strftime(o_orderdate, '%Y') WHEN 4 THEN strftime(o_orderdate, '%d %b %Y') ELSE 'not a date' END"""
_INTERVAL = """CASE WHEN o_orderkey % 6 IN (0, 1, 4) THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 6 = 2 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN o_orderkey % 6 = 3 THEN CAST(date_trunc('year', o_orderdate) AS DATE) END AS lo,
CASE WHEN o_orderkey % 6 IN (0, 1, 4) THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 6 = 2 THEN last_day(o_orderdate) WHEN o_orderkey % 6 = 3 THEN CAST(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) END AS hi,
CASE WHEN o_orderkey % 6 IN (0, 1, 4) THEN 'day' WHEN o_orderkey % 6 = 2 THEN 'month' WHEN o_orderkey % 6 = 3 THEN 'year' END AS g"""


def _dated(spark, d):
    at = F.col("o_orderdate")
    forms = ["yyyy-MM-dd", "MMMM d, yyyy", "yyyy-MM", "yyyy", "dd MMM yyyy"]
    form = F.when(F.col("o_orderkey") % 6 == 0, F.date_format(at, forms[0]))
    for i, f in enumerate(forms[1:], 1):
        form = form.when(F.col("o_orderkey") % 6 == i, F.date_format(at, f))
    return dates.parse(_t(spark, d, "orders").select("o_orderkey", form.otherwise("not a date").alias("raw")), "raw", "p")


@query(f"SELECT o_orderkey, {_FORMS} AS raw, lo AS start_date, hi AS end_date, g AS granularity FROM (SELECT *, {_INTERVAL} FROM orders)")
def date_parse(spark, d):
    return _dated(spark, d).select("o_orderkey", "raw", F.col("p.start").alias("start_date"), F.col("p.end").alias("end_date"), F.col("p.granularity").alias("granularity"))


@query(f"SELECT o_orderkey, l_linenumber, CASE WHEN hi < CAST(l_shipdate AS DATE) THEN -1 WHEN lo > CAST(l_shipdate AS DATE) THEN 1 WHEN lo IS NOT NULL THEN 0 END AS compared FROM (SELECT *, {_INTERVAL} FROM orders) JOIN lineitem ON l_orderkey = o_orderkey")
def date_compare(spark, d):
    ship = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.to_date("l_shipdate").alias("s"))
    other = F.struct(F.col("s").alias("start"), F.col("s").alias("end"))
    return _dated(spark, d).select("o_orderkey", "p").join(ship, "o_orderkey").select("o_orderkey", "l_linenumber", dates.compare(F.col("p"), other).alias("compared"))


@query(f"""SELECT o_orderkey, l_linenumber, keep AS kept, CASE WHEN keep THEN g END AS granularity,
CASE WHEN keep THEN CASE WHEN hi < s THEN CASE WHEN l_returnflag = 'R' THEN 'wrong event date' ELSE 'older video' END WHEN lo > s THEN CASE WHEN l_returnflag = 'R' THEN 'wrong event date' ELSE 'newer video' END ELSE 'same' END END AS mismatch
FROM (SELECT *, CAST(l_shipdate AS DATE) AS s, lo IS NOT NULL AND NOT (lo - (CAST(l_shipdate AS DATE) - 60) > 30) AS keep FROM (SELECT *, {_INTERVAL} FROM orders) JOIN lineitem ON l_orderkey = o_orderkey)""")
def date_rules(spark, d):
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.to_date("l_shipdate").alias("s"), F.when(F.col("l_returnflag") == "R", "wrong event date").alias("prior"))
    met = _dated(spark, d).select("o_orderkey", "p").join(lines, "o_orderkey")
    claimed = F.struct(F.col("s").alias("start"), F.col("s").alias("end"), F.date_format("s", "yyyy-MM-dd").alias("normalized"))
    upload = F.struct(F.date_sub("s", 60).alias("start"), F.date_sub("s", 60).alias("end"))
    out = rules.date_fields(F.col("p.normalized"), F.col("p"), F.date_format("s", "yyyy-MM-dd"), claimed, upload, F.col("prior"))
    return met.select("o_orderkey", "l_linenumber", out["estimated_date"].isNotNull().alias("kept"), out["granularity"].alias("granularity"), out["mismatch"].alias("mismatch"))


@query("""WITH m AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id),
e AS (SELECT e.user_id, arg_min(e.event_id, (e.ts, e.event_id)) AS earliest FROM events e JOIN m ON e.user_id = m.user_id JOIN events c ON c.event_id = m.last WHERE CAST(e.ts AS DATE) < CAST(c.ts AS DATE) GROUP BY e.user_id)
SELECT m.user_id, e.earliest, CASE WHEN e.earliest IS NULL THEN 'original' ELSE 'earlier version found' END AS status FROM m LEFT JOIN e USING (user_id)""")
def earliest_version(spark, d):
    # The first of all events is the earliest; it counts if its day is before that of the last one, so one aggregation does.
    of = _t(spark, d, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("first"), F.max(F.struct("event_id", "ts")).alias("last"))
    earlier = F.to_date("first.ts") < F.to_date("last.ts")
    return of.select("user_id", F.when(earlier, F.col("first.event_id")).alias("earliest"), F.when(earlier, "earlier version found").otherwise("original").alias("status"))


# Similarity


@query("""WITH u AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS v FROM embeddings),
c AS (SELECT label, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM u), m AS (SELECT label, d, avg(x) AS x FROM c GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label),
p AS (SELECT a.label AS label, b.label AS other, sum(a.x * b.x) / any_value(na.n * nb.n) AS s FROM m a JOIN m b ON a.d = b.d AND a.label <> b.label JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY ALL)
SELECT label, other, round(s, 4) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, other) AS rank FROM p) WHERE rank <= 5""")
def near_dup_vectors(spark, d):
    means = matching.mean_units(_t(spark, d, "embeddings").select("label", "embedding"), "label", "embedding")
    return matching.nearest(means, "label", 5).select("label", "other", F.round("s", 4).alias("similarity"), "rank")


_FRAMES = """WITH f AS (SELECT vec_id, vec_id // 4 AS g, embedding AS e, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y)))) AS v FROM embeddings),
c AS (SELECT g, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM f), m AS (SELECT g, d, avg(x) AS x FROM c GROUP BY ALL), n AS (SELECT g, sqrt(sum(x * x)) AS n FROM m GROUP BY g),
p AS (SELECT a.g AS g, b.g AS o, round(sum(a.x * b.x) / any_value(na.n * nb.n), 9) AS s FROM m a JOIN m b ON a.d = b.d AND a.g <> b.g JOIN n na ON na.g = a.g JOIN n nb ON nb.g = b.g GROUP BY ALL),
t AS (SELECT g, o FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, o) AS r FROM p) WHERE r <= 20),
x AS (SELECT t.g, t.o, a.vec_id AS f, b.vec_id AS k, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 9) AS s, list_sum(list_transform(list_zip(a.e[1:64], b.e[1:64]), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) AS d FROM t JOIN f a ON a.g = t.g JOIN f b ON b.g = t.o),
own AS (SELECT g, o, max(s) AS best, min(d) AS closest, avg(CASE WHEN s >= 0.3 THEN 1 ELSE 0 END) AS seen, avg(CASE WHEN d <= 26 THEN 1 ELSE 0 END) AS bits, count(*) FILTER (s >= 0.3) AS n FROM (SELECT g, o, f, max(s) AS s, min(d) AS d FROM x GROUP BY ALL) GROUP BY ALL),
oth AS (SELECT g, o, avg(CASE WHEN s >= 0.3 THEN 1 ELSE 0 END) AS seen, avg(CASE WHEN d <= 26 THEN 1 ELSE 0 END) AS bits FROM (SELECT g, o, k, max(s) AS s, min(d) AS d FROM x GROUP BY ALL) GROUP BY ALL),
z AS (SELECT g, o AS other, round(least(best, 1.0), 4) AS similarity, round(least(own.seen, oth.seen), 4) AS frame_coverage, closest::INTEGER AS perceptual_distance, round(least(own.bits, oth.bits), 4) AS perceptual_coverage, n AS matched FROM own JOIN oth USING (g, o) WHERE best >= 0.4 AND least(own.seen, oth.seen) >= 0.25 AND closest <= 26 AND least(own.bits, oth.bits) >= 0.25)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY similarity DESC, frame_coverage DESC, other) AS rank FROM z) WHERE rank <= 5"""


@query(_FRAMES)
def frame_matches(spark, d):
    # The limits are looser than the defaults, as vectors of this table are farther apart than frames of one scene.
    rows = _t(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 4").alias("g"), "embedding", matching.sign_hash(F.col("embedding")).alias("h"))
    return matching.frame_matches(rows, "g", "vec_id", "embedding", "h", least=0.4, frame_least=0.3, distance=26)


@query("""SELECT a.vec_id AS a, b.vec_id AS b, CAST(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) <= 16""")
def hamming_pairs(spark, d):
    return matching.hamming_pairs(_t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), matching.sign_hash(F.col("embedding")).alias("h")), 16)


_NORM = r"replace(lower(trim(regexp_replace(coalesce({0}, ''), '[ \t\n\x0b\f\r]+', ' ', 'g'))), 'ß', 'ss')"


@query(f"""WITH b AS (SELECT item_id, {_NORM.format("text")} AS body FROM benchmark), p AS (SELECT item_id, array_to_string(string_split(body, ' ')[1:18], ' ') AS phrase FROM b WHERE len(string_split(body, ' ')) >= 4)
SELECT item_id, doc_id FROM p JOIN (SELECT doc_id, {_NORM.format("text")} AS body FROM documents) ON contains(body, phrase)""")
def exact_phrase_hits(spark, d):
    phrases = _t(spark, d, "benchmark").select("item_id", F.split(text.normalised(F.col("text")), " ").alias("w")).filter(F.size("w") >= 4).select("item_id", F.array_join(F.slice("w", 1, 18), " ").alias("phrase"))
    return matching.phrase_hits(phrases, _t(spark, d, "documents").select("doc_id", text.normalised(F.col("text")).alias("body")))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split(replace(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')), '"', ''), ' '), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) >= 4 THEN '"' || array_to_string(w[1:18], ' ') || '"' END AS phrase FROM w""")
def quoted_phrase(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.quoted_phrase(F.col("text")).alias("phrase"))


@query(r"""WITH q AS (SELECT conv_id, turn, '"' || array_to_string(string_split(t, ' ')[1:18], ' ') || '"' AS q FROM (SELECT conv_id, turn, replace(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')), '"', '') AS t FROM conversations) WHERE len(string_split(t, ' ')) >= 4),
f AS (SELECT conv_id, lower(q) AS k, arg_min(q, turn) AS query, min(turn) AS turn FROM q GROUP BY ALL)
SELECT conv_id, query, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS rank FROM f) WHERE rank <= 5""")
def query_specs_dedup(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", text.quoted_phrase(F.col("text")).alias("q")).dropna(subset=["q"])
    first = rows.groupBy("conv_id", F.lower("q").alias("k")).agg(F.min(F.struct("turn", "q")).alias("f"))
    flat = first.select("conv_id", "k", F.col("f.turn").alias("turn"), F.col("f.q").alias("query"))
    return matching.ranked(flat, ["conv_id"], [F.col("turn"), F.col("k")], 5).select("conv_id", "query", "rank")


@query(_CUT + """, u AS (SELECT key, page_id, page_id % 2 = 0 AS generated FROM keyed), f AS (SELECT key, arg_min(page_id, (generated, page_id)) AS page_id FROM u GROUP BY key)
SELECT key, page_id, page_id % 2 = 0 AS generated FROM f""")
def match_merge_rank(spark, d):
    best = _keyed(spark, d).groupBy("key").agg(F.min(F.struct((F.col("id") % 2 == 0).alias("generated"), "id")).alias("b"))
    return best.select("key", F.col("b.id").alias("page_id"), F.col("b.generated").alias("generated"))


_SETS = """WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM w),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS shared FROM c a JOIN c b ON a.word = b.word AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id) """


def _sets(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.words(F.col("text")).alias("w"))


@query(_SETS + "SELECT a, b, shared / (x + y - shared) AS similarity FROM p WHERE 2 * shared >= x + y - shared")
def jaccard_pairs(spark, d):
    return matching.similar_sets(_sets(spark, d), "doc_id", "w", 0.5)


@query(_SETS + "SELECT a, b, shared / least(x, y) AS similarity FROM p WHERE 100 * shared >= 65 * least(x, y)")
def containment_pairs(spark, d):
    return matching.similar_sets(_sets(spark, d), "doc_id", "w", 0.65, "containment")


@query('SELECT doc_id, "at", substr(text, "at" + 1, 800) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 750)) AS "at" FROM documents WHERE length(text) > 0)')
def chunk_800_750(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(text.chunks(F.col("text"))).alias("c")).select("doc_id", F.col("c.at").cast("long").alias("at"), "c.piece")


@query(r"""SELECT doc_id, length(text) > 200 AS cut, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END AS short FROM (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def trim_ellipsis(spark, d):
    return _t(spark, d, "documents").select("doc_id", (F.char_length("text") > 200).alias("cut"), text.trimmed(F.col("text"), 200).alias("short"))


# Places

_MISMATCH = """SELECT l.l_orderkey, l.l_linenumber, CASE WHEN nc.n_regionkey <> ns.n_regionkey THEN 'different country' WHEN nc.n_nationkey <> ns.n_nationkey THEN 'different region' WHEN c.c_mktsegment <> 'BUILDING' THEN 'different city' ELSE 'unknown' END AS mismatch
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation nc ON nc.n_nationkey = c.c_nationkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation ns ON ns.n_nationkey = s.s_nationkey"""


@query(_MISMATCH)
def hierarchy_mismatch(spark, d):
    nation = _t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    buyer = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(nation.toDF("c_nationkey", "region_c"), "c_nationkey")
    seller = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(nation.toDF("s_nationkey", "region_s"), "s_nationkey")
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    met = lines.join(orders, "l_orderkey").join(buyer, "c_custkey").join(seller, "s_suppkey")
    out = rules.hierarchy((F.col("region_c"), F.col("region_s")), (F.col("c_nationkey"), F.col("s_nationkey")), (F.col("c_mktsegment"), F.lit("BUILDING")))
    return met.select("l_orderkey", "l_linenumber", out.alias("mismatch"))


@query("""WITH v AS (SELECT user_id, event_type AS name, count(DISTINCT CAST(event_id % 4 AS BIGINT)) FILTER (event_id % 4 <> 0) AS votes FROM events GROUP BY ALL),
t AS (SELECT *, max(votes) OVER (PARTITION BY user_id) AS top FROM v)
SELECT user_id, CASE WHEN count(*) = 1 AND max(votes) >= 2 THEN any_value(name) END AS place FROM t WHERE votes = top GROUP BY user_id""")
def location_vote(spark, d):
    votes = _t(spark, d, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.countDistinct(F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4)).alias("votes"))
    # Votes by name are few, so they are gathered in a user's row rather than ranked in a window.
    of = votes.groupBy("user_id").agg(F.max("votes").alias("top"), F.collect_list(F.struct("votes", "name")).alias("all"))
    best = F.filter("all", lambda x: x["votes"] == F.col("top"))
    return of.select("user_id", F.when((F.size(best) == 1) & (F.col("top") >= 2), F.get(best, 0)["name"]).alias("place"))


_PLACES = {"New York City": True, "Central Park": False, "wearing Red": False, "Paris": True, "of": False, "Ohio": True, "Al": False, "the Hague": True, "lower case": False, "Bay of Bengal": True, "orange county": True, "London Bridge": False, "": False}


by_form("location_plausible", "orders", "o_orderkey", {"name": [f"'{k}'" for k in _PLACES]}, {"plausible": [str(v) for v in _PLACES.values()]}, lambda name: {"plausible": rules.place_is_plausible(name)})


# Evidence and verdicts

_EVIDENCE = rf"""WITH e AS (SELECT doc_id, 'ev-' || substr(sha256('["' || source || '", "' || replace(replace({_NORM.format("text")}, '\', '\\'), '"', '\"') || '"]'), 1, 16) AS evidence_id, source, lang, doc_id % 3 = 0 AS verified FROM documents)"""


def _evidence(spark, d):
    return _t(spark, d, "documents").select("doc_id", evidence.identity(F.col("source"), F.col("text")).alias("evidence_id"), "source", "lang", (F.col("doc_id") % 3 == 0).alias("verified"))


@query(_EVIDENCE + " SELECT doc_id, evidence_id FROM e")
def evidence_id(spark, d):
    return _evidence(spark, d).select("doc_id", "evidence_id")


@query(_EVIDENCE + " SELECT evidence_id, min(doc_id) AS doc_id, bool_or(verified) AS verified, coalesce(arg_min(lang, doc_id) FILTER (verified), arg_min(lang, doc_id)) AS lang FROM e GROUP BY evidence_id")
def evidence_dedup_upgrade(spark, d):
    return evidence.dedup(_evidence(spark, d), ["evidence_id"], "doc_id", "verified", ["lang"])


@query(rf"""WITH c AS (SELECT doc_id AS evidence_id, trim(substr(text, 5, CAST(6 + doc_id % 40 AS INTEGER))) AS quote FROM documents UNION ALL SELECT doc_id, 'never written anywhere' FROM documents)
SELECT DISTINCT evidence_id, quote FROM c JOIN documents ON doc_id = evidence_id WHERE length(quote) >= 8 AND doc_id % 3 = 0 AND doc_id % 5 < 4 AND contains({_NORM.format("text")}, {_NORM.format("quote")})""")
def citation_validate(spark, d):
    docs = _t(spark, d, "documents")
    made = docs.select(F.col("doc_id").alias("evidence_id"), F.substring(F.col("text"), F.lit(5), (6 + F.col("doc_id") % 40).cast("int")).alias("quote"))
    cited = made.union(docs.select("doc_id", F.lit("never written anywhere")))
    kind = F.get(F.array(*(F.lit(x) for x in [*evidence.DECISIVE, "model_text"])), (F.col("doc_id") % 5).cast("int"))
    held = docs.select(F.col("doc_id").alias("evidence_id"), "text", (F.col("doc_id") % 3 == 0).alias("verified"), kind.alias("type"))
    return evidence.valid_citations(cited, held, decisive=True)


_STATUS = "CASE {0} % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'refuted' ELSE 'unknown' END"


@query(f"""WITH s AS (SELECT o_orderkey, {_STATUS.format("o_orderkey")} AS core, {_STATUS.format("o_custkey")} AS place, {_STATUS.format("(o_orderkey // 3)")} AS prov, o_orderkey % 2 = 0 AS required FROM orders)
SELECT o_orderkey, CASE WHEN core = 'refuted' OR place = 'refuted' OR (required AND prov = 'refuted') THEN 'FALSE' WHEN core = 'supported' AND place = 'supported' AND (NOT required OR prov = 'supported') THEN 'TRUE' ELSE 'NEI' END AS verdict FROM s""")
def verdict_gate(spark, d):
    status = lambda c: F.expr(_STATUS.format(c))
    rows = _t(spark, d, "orders").select("o_orderkey", status("o_orderkey").alias("core"), status("o_custkey").alias("place"), status("(o_orderkey div 3)").alias("prov"), (F.col("o_orderkey") % 2 == 0).alias("required"))
    return rows.select("o_orderkey", rules.verdict(F.col("core"), F.array("place"), F.col("prov"), F.col("required")).alias("verdict"))


@query("SELECT doc_id AS component, 'quality' AS pillar, CASE quality WHEN 1 THEN 'supports' ELSE 'refutes' END AS stance FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', CASE toxic WHEN 1 THEN 'refutes' ELSE 'supports' END FROM labels WHERE toxic IS NOT NULL")
def decision_edges(spark, d):
    sides = F.array(F.struct(F.lit("quality").alias("pillar"), F.col("quality").alias("v"), F.lit(1).alias("good")), F.struct(F.lit("toxic").alias("pillar"), F.col("toxic").alias("v"), F.lit(0).alias("good")))
    rows = _t(spark, d, "labels").select(F.col("doc_id").alias("component"), F.explode(sides).alias("e")).filter("e.v IS NOT NULL")
    return rows.select("component", "e.pillar", F.when(F.col("e.v") == F.col("e.good"), "supports").otherwise("refutes").alias("stance"))


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
i AS (SELECT unnest(range(0, 4)) AS i)
SELECT DISTINCT user_id, event_id, pos FROM n LEFT JOIN i ON true WHERE n <= 4 OR pos = round_even(i * (n - 1) / 3.0, 0)""")
def even_sample(spark, d):
    w = Window.partitionBy("user_id")
    rows = _t(spark, d, "events").select("user_id", "event_id", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("pos"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.filter(F.array_contains(rules.even_positions(F.col("n"), 4), F.col("pos").cast("int"))).select("user_id", "event_id", "pos")


@query(r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')), '') AS heading, contains(html, '<article') AS has_article FROM pages""")
def page_title_meta(spark, d):
    pick = lambda tag: F.regexp_extract("html", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return _t(spark, d, "pages").select("page_id", F.nullif(F.trim(pick("title")), F.lit("")).alias("title"), F.nullif(F.trim(F.regexp_replace(pick("h1"), "<[^>]+>", " ")), F.lit("")).alias("heading"), F.contains(F.col("html"), F.lit("<article")).alias("has_article"))


# Sources, framing and geocoding: each row of a table takes one of the stated cases, (inputs ..., expected)


def _cases(name: str, inputs: str, output: str, rows: list[tuple], compute):
    def show(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    columns = [x.split()[0] for x in inputs.split(", ")]
    by_form(name, "orders", "o_orderkey", {c: [show(r[i]) for r in rows] for i, c in enumerate(columns)}, {output: [show(r[-1]) for r in rows]}, lambda *c: {output: compute(*c)})


_cases("source_normalize", "name string", "publisher", [("AFP", "agence france presse"), ("The Guardian", "guardian"), ("https://www.reuters.com/", "www"), ("Café & Co (@cafe)", "cafe and co"), ("@NYTimes", "new york times"), ("", ""), ("Unknown Blog", "unknown blog")], sources.publisher)
_cases("source_match", "a string, b string", "same", [("AFP", "Agence France-Presse", True), ("YouTube", "Vimeo", False), ("Some Blog", "SomeBlog", True), ("a b", "ab", False), ("", "", False)], sources.same_source)
_cases("uploader_from_url", "url string", "account", [("https://www.youtube.com/@name/videos", "name"), ("https://youtube.com/channel/UC1", "UC1"), ("https://www.facebook.com/watch/?v=1", None), ("https://m.facebook.com/page.name/posts/1", "page.name"), ("https://x.com/user/status/1", "@user"), ("https://x.com/i/status/1", None), ("ftp://x.com/user", None), ("https://example.com/user", None)], sources.uploader)
_cases("location_contrast", "text string", "contrast", [("filmed in Brazil, not the United States", "United States > Brazil"), ("not Paris but Berlin", "Paris > Berlin"), ("in the park", None), ("", None)], lambda t: F.concat(rules.place_contrast(t)["claimed"], F.lit(" > "), rules.place_contrast(t)["verified"]))
_cases(
    "motivation_rules", "context string, mismatch string, framed string, protected boolean, source_type string, compared int, overlap double", "result",
    [("satire", "satire as real", "x", False, "unknown", 0, 0.0, "satire as real"), ("news report", "satire as real", "x", False, "unknown", 0, 0.0, None), ("bad", "old news as current", "x", True, "unknown", -1, 0.0, "old news as current"), ("bad", "old news as current", "x", True, "unknown", 0, 0.0, None), ("archive", "same", "x", False, "unknown", 0, 0.3, "same"), ("archive", "same", "x", False, "unknown", 0, 0.2, None), ("unknown", "political reframing", "x", False, "unknown", 0, 0.0, None), ("archive", "unknown", " ", False, "unknown", 0, 0.0, None), ("bad", "unknown", "x", False, "satire source", 0, 0.0, "unknown")],
    lambda *c: rules.framing(*c)[1],
)
_cases(
    "geocode_score", "importance double, asked string, names string, display string, target boolean", "score",
    [(0.5, "paris", "paris|france", "paris france", True, 11.0), (0.25, "par", "paris", "paris texas", False, 3.25), (None, "rome", "paris", "paris", False, 0.0)],
    lambda i, a, n, s, t: rules.geocode_score(i, a, F.split(n, "[|]"), s, F.split(a, ","), F.array(F.lit("spain")), t),
)


@query("SELECT user_id, event_type, min(ts) AS first_seen FROM events GROUP BY ALL")
def earliest_seen(spark, d):
    return earliest.first_seen(_t(spark, d, "events"), ["user_id", "event_type"], "ts")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def selected_scan(spark, d):
    return records.selected(_t(spark, d, "documents").select("doc_id", "lang", "source"), _t(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id")
