"""Queries over reports, audits, searches and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import reports, searches
from ..sources import results
from .registry import by_form, query, read

# Reports

_PLATFORMS = ["x", "YouTube", "tiktok ", "facebook", "instagram", "nytimes", "CNBC", "vimeo", "unknown", ""]
_PLATFORM = "CASE page_id % 10 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PLATFORMS)) + " END"


@query(f"""SELECT CASE lower(trim(p)) WHEN 'x' THEN 'X (Twitter)' WHEN 'youtube' THEN 'YouTube' WHEN 'tiktok' THEN 'TikTok' WHEN 'facebook' THEN 'Facebook' WHEN 'instagram' THEN 'Instagram' WHEN 'nytimes' THEN 'News sites (NYT, Fox, NBC, CNBC, Today)' WHEN 'cnbc' THEN 'News sites (NYT, Fox, NBC, CNBC, Today)' ELSE 'Others' END AS platform, count(*) AS n FROM (SELECT {_PLATFORM} AS p FROM pages) GROUP BY 1""")
def platforms_by_group(spark, d):
    return read(spark, d, "pages").select(F.expr(_PLATFORM).alias("p")).groupBy(reports.platform_group(F.col("p")).alias("platform")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT CASE doc_id % 6 WHEN 0 THEN ' Unknown ' WHEN 1 THEN NULL WHEN 2 THEN lang ELSE source END AS v FROM documents)
SELECT count(*) AS n, count(*) FILTER (lower(trim(v)) = 'unknown') AS unknown, round(100.0 * count(*) FILTER (lower(trim(v)) = 'unknown') / count(*), 1) AS share FROM r""")
def unknown_share(spark, d):
    v = F.when(F.col("doc_id") % 6 == 0, " Unknown ").when(F.col("doc_id") % 6 == 1, None).when(F.col("doc_id") % 6 == 2, F.col("lang")).otherwise(F.col("source"))
    of = read(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower(F.trim(v)) == "unknown").alias("unknown"))
    return of.select("n", "unknown", F.round(reports.percentage(F.col("unknown"), F.col("n")), 1).alias("share"))


_GAPS = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN '20200101' WHEN 3 THEN '2020-02-30' ELSE '2020-02-29' END"
_TEXT = "CASE o_orderkey % 3 WHEN 0 THEN 'said' WHEN 1 THEN '  ' ELSE NULL END"


@query(f"""SELECT count(*) AS samples, count(*) FILTER (o_orderkey % 5 < 2) AS dates_missing, count(*) FILTER (o_orderkey % 5 = 3) AS dates_invalid, count(*) FILTER (o_orderkey % 3 > 0) AS transcripts_missing,
count(*) FILTER (o_custkey % 4 = 0) AS without_evidence, sum(o_custkey % 4)::BIGINT AS evidence_items, sum(CASE WHEN o_custkey % 4 > 1 THEN 1 ELSE 0 END)::BIGINT AS referenced_items, count(*) FILTER (o_custkey % 2 = 0) AS empty_relations FROM orders""")
def record_gaps(spark, d):
    rows = read(spark, d, "orders").select(F.expr(_GAPS).alias("date"), F.expr(_TEXT).alias("said"), (F.col("o_custkey") % 4).alias("n"), F.when(F.col("o_custkey") % 4 > 1, 1).otherwise(0).alias("r"), F.when(F.col("o_custkey") % 2 == 1, "agrees").alias("relation"))
    return reports.record_gaps(rows, "date", dates.plain_date(F.col("date")), "said", "n", "r", "relation")


_DECISIONS = "CASE o_orderstatus WHEN 'F' THEN 'keep' WHEN 'O' THEN 'unknown' ELSE 'discard' END"
_META = {"title": "CASE WHEN o_orderkey % 2 = 0 THEN 't' END", "description": "CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'd' END", "uploader_name": "CASE WHEN o_custkey % 2 = 0 THEN 'u' END", "uploader_profile": "CASE WHEN o_custkey % 3 = 0 THEN 'p' END", "upload_date": "CASE WHEN o_custkey % 5 > 0 THEN '2020-01-01' ELSE '' END"}
_CHECKED = f"WITH c AS (SELECT *, {_DECISIONS} AS decision, " + ", ".join(f"{e} AS {k}" for k, e in _META.items()) + " FROM orders), s AS (SELECT *, " + " + ".join(f"CASE WHEN trim(coalesce({k}, '')) <> '' THEN 1 ELSE 0 END" for k in _META) + " AS n_filled FROM c) "


def _checked(spark, d):
    return read(spark, d, "orders").select("*", F.expr(_DECISIONS).alias("decision"), *(F.expr(e).alias(k) for k, e in _META.items()))


@query(_CHECKED + "SELECT o_orderpriority AS platform, count(*) AS total, count(*) FILTER (n_filled = 5) AS complete, count(*) FILTER (n_filled BETWEEN 1 AND 4) AS partial, count(*) FILTER (n_filled = 0) AS missing, " + ", ".join(f"count(*) FILTER (trim(coalesce({k}, '')) <> '') AS has_{k}" for k in _META) + " FROM s GROUP BY 1")
def metadata_breakdown(spark, d):
    return reports.metadata_breakdown(_checked(spark, d).withColumnRenamed("o_orderpriority", "platform"), "platform", list(_META))


@query(_CHECKED + """SELECT count(*) AS total, count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision = 'discard') AS discarded, count(*) FILTER (decision = 'unknown') AS unknown,
round(100.0 * count(*) FILTER (decision = 'keep') / count(*), 2) AS kept_percentage, round(100.0 * count(*) FILTER (decision = 'discard') / count(*), 2) AS discarded_percentage, round(100.0 * count(*) FILTER (decision = 'unknown') / count(*), 2) AS unknown_percentage FROM s""")
def summary_percentages(spark, d):
    return reports.summary(_checked(spark, d))


_GROUPS = _CHECKED + """, r AS (SELECT *, 'r' || o_orderkey % 3 AS reason, 'u' || o_orderkey AS url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM s),
g AS (SELECT o_custkey AS key, max(n) AS n, arg_min(reason, k) FILTER (decision = 'keep') AS kept, arg_min(url, k) FILTER (decision = 'keep') AS kept_url, bool_or(decision = 'unknown') AS open, arg_min(reason, k) AS first, arg_min(url, (-n_filled, k)) AS best, arg_min(n_filled, (-n_filled, k)) AS most FROM r GROUP BY 1),
d AS (SELECT key, CASE WHEN kept IS NOT NULL THEN 'keep' WHEN open THEN 'unknown' ELSE 'discard' END AS decision, coalesce(kept, CASE WHEN n = 1 THEN first WHEN open THEN 'all_equivalent_urls_inconclusive' ELSE 'all_equivalent_urls_failed' END) AS reason, kept_url AS successful_url, CASE most WHEN 5 THEN 'complete' WHEN 0 THEN 'missing' ELSE 'partial' END AS metadata_status, best AS metadata_url FROM g) """


def _grouped(spark, d):
    rows = _checked(spark, d).withColumns({"reason": F.concat(F.lit("r"), (F.col("o_orderkey") % 3).cast("string")), "url": F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))})
    return reports.group_results(rows, "o_custkey", "o_orderkey", list(_META)).withColumnRenamed("o_custkey", "key")


@query(_GROUPS + "SELECT * FROM d")
def group_results(spark, d):
    return _grouped(spark, d).select("key", "decision", "reason", "successful_url", "metadata_status", "metadata_url")


@query(_GROUPS + "SELECT decision, reason, count(*) AS n FROM d WHERE decision <> 'keep' GROUP BY ALL")
def reasons_histogram(spark, d):
    return _grouped(spark, d).filter("decision <> 'keep'").groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(_GROUPS + "SELECT o_orderkey, decision, reason, metadata_status FROM d JOIN orders ON o_custkey = key")
def records_with_group(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key")).join(_grouped(spark, d), "key").select("o_orderkey", "decision", "reason", "metadata_status")


@query("SELECT length(CAST(doc_id AS STRING)) AS id_length, count(*) AS n FROM documents GROUP BY 1")
def id_lengths(spark, d):
    return read(spark, d, "documents").groupBy(F.char_length(F.col("doc_id").cast("string")).cast("long").alias("id_length")).agg(F.count(F.lit(1)).alias("n"))


_AUDIT = """WITH f AS (SELECT doc_id AS c, 'lang' AS field, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END FROM documents UNION ALL SELECT doc_id, 'verification.source.uploader_name', CASE WHEN doc_id % 2 = 0 THEN 'u' END FROM documents),
e AS (SELECT doc_id AS c, 'e1' AS id, CASE WHEN doc_id % 2 = 0 THEN 'platform_metadata' ELSE 'retrieved_page' END AS type FROM documents WHERE doc_id % 5 > 0),
l AS (SELECT doc_id AS c, 'lang' AS field, 'e1' AS id FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, 'lang', 'e2' FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'verification.source.uploader_name', 'e1' FROM documents WHERE doc_id % 4 < 2),
k AS (SELECT l.c, l.field, bool_or(e.id IS NOT NULL) AS held, bool_or(e.id IS NULL) AS dangling, bool_or(coalesce(e.type = 'platform_metadata', false)) AS platform FROM l LEFT JOIN e ON e.c = l.c AND e.id = l.id GROUP BY ALL),
filled AS (SELECT * FROM f WHERE coalesce(value, '') <> '')
SELECT 'coverage' AS part, field AS name, count(*) AS n FROM filled GROUP BY field
UNION ALL SELECT 'unsupported', '', count(*) FROM filled WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.c = filled.c AND k.field = filled.field AND k.held)
UNION ALL SELECT 'dangling', '', count(*) FROM k WHERE dangling
UNION ALL SELECT 'issues', '', count(*) FROM events WHERE event_type = 'error' OR event_id % 13 = 0
UNION ALL SELECT 'stale', '', count(*) FROM k WHERE platform AND field = 'verification.source.uploader_name' AND c % 6 <> 0
UNION ALL SELECT 'types', type, count(*) FROM e GROUP BY type"""


@query(_AUDIT)
def audit_report(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("claim_id"), "lang", "source")
    key, path = F.col("claim_id"), "verification.source.uploader_name"
    pairs = F.array(F.struct(F.lit("lang").alias("field"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("field"), F.when(key % 7 == 0, "").otherwise(F.col("source")).alias("value")), F.struct(F.lit(path).alias("field"), F.when(key % 2 == 0, "u").alias("value")))
    fields = docs.select("claim_id", F.explode(pairs).alias("f")).select("claim_id", "f.field", "f.value")
    held = docs.filter(key % 5 > 0).select("claim_id", F.lit("e1").alias("evidence_id"), F.when(key % 2 == 0, "platform_metadata").otherwise("retrieved_page").alias("type"))
    made = F.array_compact(F.array(F.when(key % 3 > 0, F.struct(F.lit("lang").alias("field"), F.lit("e1").alias("evidence_id"))), F.when(key % 11 == 0, F.struct(F.lit("lang").alias("field"), F.lit("e2").alias("evidence_id"))), F.when(key % 4 < 2, F.struct(F.lit(path).alias("field"), F.lit("e1").alias("evidence_id")))))
    links = docs.select("claim_id", F.explode(made).alias("l")).select("claim_id", "l.field", "l.evidence_id")
    stages = read(spark, d, "events").select(F.col("event_id").alias("claim_id"), F.col("event_type").alias("stage"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 13 == 0, F.array(F.lit("failed"))).alias("errors"))
    metadata = docs.select("claim_id", F.lit("uploader_name").alias("field"), F.when(key % 6 == 0, "u").alias("value"))
    return reports.audit(fields, links, held, stages, metadata, {"uploader_name": path})


# Searches

_WORDS = r"list_filter(string_split(replace(trim(regexp_replace(coalesce({0}, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')), '\"', ''), ' '), lambda x: x <> '')".replace('\\"', '"')
_PHRASE = "CASE WHEN len({0}) >= 4 THEN '\"' || array_to_string(({0})[1:18], ' ') || '\"' END"


@query(f"""WITH c AS (SELECT conv_id, max(text) FILTER (turn = 0) AS a, max(text) FILTER (turn = 1) AS b, max(text) FILTER (turn = 2) AS t FROM conversations GROUP BY 1),
q AS (SELECT conv_id, 0 AS k1, 0 AS k2, 0 AS k3, {_PHRASE.format(_WORDS.format("a"))} AS query, 'transcript' AS query_type FROM c UNION ALL SELECT conv_id, 1, 0, 0, {_PHRASE.format(_WORDS.format("b"))}, 'caption' FROM c UNION ALL SELECT conv_id, 2, 0, 0, {_PHRASE.format(_WORDS.format("t"))}, 'claim' FROM c
UNION ALL SELECT conv_id, 3, 0, 0, '"User ' || conv_id || '"', 'account' FROM c UNION ALL SELECT conv_id, 4, 0, 0, CASE WHEN conv_id % 2 = 0 THEN '"USER ' || conv_id || '"' END, 'account' FROM c
UNION ALL SELECT conv_id, 5, turn, 0, '"@' || role || '"', 'account' FROM conversations UNION ALL SELECT conv_id, 5, turn, 1, '"@t.' || turn || '"', 'account' FROM conversations),
f AS (SELECT conv_id, arg_min(query, (k1, k2, k3)) AS query, arg_min(query_type, (k1, k2, k3)) AS query_type, min((k1, k2, k3)) AS k FROM q WHERE query IS NOT NULL GROUP BY conv_id, replace(lower(query), 'ß', 'ss'))
SELECT conv_id, rank, query, query_type FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS rank FROM f) WHERE rank <= 5""")
def query_specs(spark, d):
    talk = read(spark, d, "conversations")
    said = lambda n: F.max(F.when(F.col("turn") == n, F.col("text")))
    user = F.concat(F.lit("User "), F.col("conv_id").cast("string"))
    claims = talk.groupBy("conv_id").agg(said(0).alias("transcript"), said(1).alias("caption"), said(2).alias("text")).select("*", user.alias("uploader"), F.when(F.col("conv_id") % 2 == 0, F.upper(user)).alias("source"))
    seen = talk.select("conv_id", F.col("turn").alias("seq"), F.concat(F.lit("by @"), "role", F.lit(" with @t."), F.col("turn").cast("string")).alias("observation"))
    return searches.query_specs(claims, seen, "conv_id").select("conv_id", "rank", "query", "query_type")


@query(f"""WITH w AS (SELECT conv_id, turn, array_to_string(({_WORDS.format("text")})[1:30], ' ') AS q FROM conversations WHERE turn < 4),
c AS (SELECT conv_id, list(q ORDER BY turn) FILTER (q <> '') AS all_ FROM w GROUP BY 1),
f AS (SELECT conv_id, list_filter(all_, lambda x, i: list_position(list_transform(all_, lambda y: replace(lower(y), 'ß', 'ss')), replace(lower(x), 'ß', 'ss')) = i)[1:4] AS few FROM c)
SELECT conv_id, array_to_string(list_concat(few, [few[1] || ' site:youtube.com', few[1] || ' (site:x.com OR site:facebook.com OR site:tiktok.com)']), '|') AS queries FROM f""")
def base_queries(spark, d):
    said = lambda n: F.max(F.when(F.col("turn") == n, F.col("text"))).alias(f"t{n}")
    claims = read(spark, d, "conversations").groupBy("conv_id").agg(*(said(n) for n in range(4)))
    return searches.base_queries(claims, "conv_id", ["t0", "t1", "t2", "t3"], "t0").select("conv_id", F.array_join("queries", "|").alias("queries"))


_HITS = "WITH h AS (SELECT user_id AS claim, 'https://e.com/' || event_id % 40 AS url, event_id AS seq, event_id % 6 AS frame, CASE WHEN event_id % 3 > 0 THEN event_type END AS title, event_id % 5 = 0 AS is_full, event_id % 4 = 0 AS is_part, value AS score FROM events)"


def _hits(spark, d):
    n = F.col("event_id")
    return read(spark, d, "events").select(F.col("user_id").alias("claim"), F.concat(F.lit("https://e.com/"), (n % 40).cast("string")).alias("url"), n.alias("seq"), (n % 6).alias("frame"), F.when(n % 3 > 0, F.col("event_type")).alias("title"), (n % 5 == 0).alias("full"), (n % 4 == 0).alias("partial"), F.col("value").alias("score"))


@query(_HITS + """, p AS (SELECT claim, url, coalesce(arg_min(title, seq) FILTER (title IS NOT NULL), '') AS title, bool_or(is_full) AS f, bool_or(is_part) AS q, count(DISTINCT frame) AS match_count FROM h GROUP BY ALL)
SELECT * EXCLUDE (f, q) FROM (SELECT *, CASE WHEN f AND q THEN 'full,partial' WHEN f THEN 'full' WHEN q THEN 'partial' ELSE 'unspecified' END AS match_types, row_number() OVER (PARTITION BY claim ORDER BY NOT f, match_count DESC, url) AS rank FROM p) WHERE rank <= 10""")
def ranked_pages(spark, d):
    return searches.ranked_pages(_hits(spark, d), "claim")


@query(_HITS + " SELECT claim, url, max(score) AS score, count(DISTINCT frame) AS n_frames FROM h GROUP BY ALL")
def merged_images(spark, d):
    return searches.merged_images(_hits(spark, d), ["claim"])


@query(_HITS + """, n AS (SELECT claim, seq, CASE WHEN seq % 2 = 0 THEN 'id' || seq % 10 END AS id, upper(coalesce(title, 'none')) || seq % 3 AS description, frame, score FROM h)
SELECT claim, coalesce(id, lower(description)) AS key, arg_min(description, seq) AS description, max(score) AS score, count(DISTINCT frame) AS n_frames FROM n GROUP BY claim, coalesce(id, lower(description))""")
def merged_entities(spark, d):
    seq = F.col("seq")
    rows = _hits(spark, d).select("claim", "seq", F.when(seq % 2 == 0, F.concat(F.lit("id"), (seq % 10).cast("string"))).alias("entity_id"), F.concat(F.upper(F.coalesce("title", F.lit("none"))), (seq % 3).cast("string")).alias("description"), "frame", "score")
    return searches.merged_names(rows, "claim")


@query(_HITS + """, u AS (SELECT claim, seq % 4 AS query, seq, url FROM h), f AS (SELECT claim, url, min((query, seq)) AS k FROM u GROUP BY ALL)
SELECT claim, url, row_number() OVER (PARTITION BY claim ORDER BY k) AS rank FROM f""")
def urls_over_queries(spark, d):
    rows = _hits(spark, d).select("claim", (F.col("seq") % 4).alias("query"), "seq", "url")
    return searches.first_of(rows, ["claim"], F.col("url"), ["query", "seq"], ["url"])


@query(_HITS + """, c AS (SELECT DISTINCT claim, url, 'https://e.com/' || (seq % 40 + 1) AS canonical_url FROM h), e AS (SELECT claim, 'https://e.com/' || event_id % 17 AS url, 'e' || min(event_id % 9) AS id FROM (SELECT *, user_id AS claim FROM events) WHERE event_id % 2 = 0 GROUP BY ALL)
SELECT c.claim, c.url, c.canonical_url, coalesce(a.id, b.id) AS evidence_id FROM c LEFT JOIN e a ON a.claim = c.claim AND a.url = c.url LEFT JOIN e b ON b.claim = c.claim AND b.url = c.canonical_url""")
def candidates_with_evidence(spark, d):
    found = _hits(spark, d).select("claim", "url", F.concat(F.lit("https://e.com/"), (F.col("seq") % 40 + 1).cast("string")).alias("canonical_url")).distinct()
    held = read(spark, d, "events").filter("event_id % 2 = 0").select(F.col("user_id").alias("claim"), F.concat(F.lit("https://e.com/"), (F.col("event_id") % 17).cast("string")).alias("url"), F.concat(F.lit("e"), (F.col("event_id") % 9).cast("string")).alias("evidence_id"))
    return searches.with_evidence(found, held, "claim").select("claim", "url", "canonical_url", "evidence_id")


@query("""WITH m AS (SELECT user_id AS claim, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS name, 'g' || event_id % 3 AS g, round(value / 100, 3) AS score, event_id % 5 = 0 AS event FROM events WHERE event_id % 3 < 2 OR event_id % 11 = 0),
o AS (SELECT claim, lower(name) AS key, g, arg_min(event, (NOT event, -score, seq)) AS event, min((seq, name)) AS first FROM m GROUP BY claim, lower(name), g),
c AS (SELECT claim, key, min(first) AS first, count(*) AS n_groups, count(*) FILTER (event) AS n_event_groups FROM o GROUP BY ALL)
SELECT claim, first[2] AS name, n_groups, n_event_groups, row_number() OVER (PARTITION BY claim ORDER BY n_event_groups DESC, n_groups DESC, key) AS rank FROM c""".replace("min((seq, name))", "arg_min(name, seq)").replace("arg_min(event, (NOT event, -score, seq)) AS event, arg_min(name, seq) AS first", "arg_min(event, (NOT event, -score, seq)) AS event, min({'s': seq, 'n': name}) AS first").replace("first[2]", "first.n"))
def place_candidates(spark, d):
    n = F.col("event_id")
    rows = read(spark, d, "events").filter("event_id % 3 < 2 OR event_id % 11 = 0")
    told = rows.select(F.col("user_id").alias("claim"), n.alias("seq"), F.when(n % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("name"), F.lit("web").alias("category"), F.concat(F.lit("g"), (n % 3).cast("string")).alias("support_group"), F.round(F.col("value") / 100, 3).alias("score"), (n % 5 == 0).alias("event"))
    return searches.place_candidates(told, "claim")


# Texts

_NORM = r"lower(trim(regexp_replace(coalesce({0}, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')))"


@query(rf"""SELECT doc_id, {_NORM.format("substr(text, 3, 40)")} <> '' AND contains(regexp_replace(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+', ' ', 'g'), {_NORM.format("substr(text, 3, 40)")}) AS own, contains(regexp_replace(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+', ' ', 'g'), 'the ') AS has_the,
substr(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')), 1, 50) AS start FROM documents""")
def grounded_values(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", text.is_grounded(F.substring(t, 3, 40), t).alias("own"), F.contains(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), text.SPACES, " "), F.lit("the ")).alias("has_the"), text.clean(t, 50).alias("start"))


by_form(
    "plain_texts", "orders", "o_orderkey",
    {"raw": ["concat('**Bold ', n, '** and _it_')", "concat('# Title', chr(10), '- item ', n)", "concat('See [the page](https://a.b/c_(d)) ', n)", "concat('As https://a.b/', n, '. shown (ev-12ab) [1, 2]')", "concat('<p>One</p><p>Two &amp; ', n, '</p>')", "concat('> quoted', chr(10), chr(10), chr(10), chr(10), 'end ', n)"]},
    {"plain": ["concat('Bold ', n, ' and it')", "concat('Title', chr(10), 'item ', n)", "concat('See the page ', n)", "'As. shown'", "concat('One', chr(10), chr(10), 'Two & ', n)", "concat('quoted', chr(10), chr(10), 'end ', n)"]},
    lambda raw: {"plain": text.plain(raw)},
)
by_form(
    "redacted_errors", "orders", "o_orderkey",
    {"raw": ["concat('at https://a.b/?key=s', n, '&x=1')", "concat('https://a.b/?x=1&API_KEY=', n, ' failed')", "concat('token=', n)", "NULL"]},
    {"shown": ["'at https://a.b/?key=[redacted]&x=1'", "'https://a.b/?x=1&API_KEY=[redacted] failed'", "concat('token=', n)", "NULL"]},
    lambda raw: {"shown": text.redacted(raw)},
)
by_form(
    "html_texts", "orders", "o_orderkey",
    {"raw": ["concat('<b>A &amp; B</b>  ', n)", "'&eacute;t&#233;'", "'&lt;i&gt;x'", "concat('long ', repeat('x', 20))", "NULL"]},
    {"shown": ["concat('A & B ', n)", "'été'", "'x'", "concat('long ', repeat('x', 7), '...')", "''"]},
    lambda raw: {"shown": F.when(raw.startswith("long"), text.clean_html(raw, 12)).otherwise(text.clean_html(raw, 300))},
)
by_form(
    "asserted_places", "orders", "o_orderkey",
    {"told": ["concat('A protest was held in Lima on day ', n, '.')", "concat('Lima is nice. ', n)", "'In Lima, a fire broke out'", "'It was recorded by someone from Lima'", "'Reporting from the Lima of today'", "'An attack near Callao, Lima'", "'A protest. People live well in Lima'", "'nothing'"]},
    {"asserted": ["true", "false", "true", "true", "true", "true", "true", "false"], "told_by": ["concat('A protest was held in Lima on day ', n, '.')", "'Lima is nice.'", "'In Lima, a fire broke out'", "'It was recorded by someone from Lima'", "'Reporting from the Lima of today'", "'An attack near Callao, Lima'", "'People live well in Lima'", "NULL"]},
    lambda told: {"asserted": text.is_asserted(told, F.lit("Lima")), "told_by": F.when(text.place_of(told, F.lit("Lima")) > 0, text.excerpt(told, text.place_of(told, F.lit("Lima")) - 1, text.place_of(told, F.lit("Lima")) + 3))},
)
by_form(
    "clean_places", "orders", "o_orderkey",
    {"raw": ["concat(' New  York ##er, ', n)", "'(Paris).'", "'##ville'", "NULL"]},
    {"place": ["concat('New Yorker, ', n)", "'Paris'", "'ville'", "''"]},
    lambda raw: {"place": text.clean_place(raw)},
)
by_form(
    "meaningful_bodies", "orders", "o_orderkey",
    {"body": ["concat('Four words say enough ', n)", "'Log in Sign up Post YouTube May June'", "'The Title'", "'one two one two one'", "'雨が降っている日は家で本を読む'", "''", "NULL"], "title": ["'t'", "'t'", "'the title'", "'t'", "'t'", "'t'", "'t'"]},
    {"meaningful": ["true", "false", "false", "false", "true", "false", "false"]},
    lambda body, title: {"meaningful": text.is_meaningful(body, title)},
)
by_form(
    "useful_contexts", "orders", "o_orderkey",
    {"summary": ["concat('The footage was filmed in 2011 during a drill ', n)", "'Too short'", "'The footage is not provided by the given information'", "'a flood hit the old town last week'", "'some words that nobody else has used at all'", "'words of the page that the evidence also has'"], "framing": ["'a war'", "'x'", "'x'", "'A flood hit the old town'", "'x'", "'x'"], "told": ["''", "''", "''", "''", "'other things'", "'the page has words of evidence'"]},
    {"useful": ["true", "false", "false", "false", "false", "true"]},
    lambda summary, framing, told: {"useful": text.is_useful_context(summary, framing, told)},
)

# Records


@query("""SELECT doc_id AS claim_id, source || '/' || doc_id || '.json' AS source_file, CASE WHEN source = 'src1' THEN 'x' ELSE 'unknown' END AS platform, CASE WHEN doc_id % 3 = 0 THEN '2020-01-02' END AS video_date, CASE WHEN trim(coalesce(t, '')) <> '' THEN t END AS transcript, CASE WHEN trim(coalesce(t, '')) <> '' THEN 'available' ELSE 'missing' END AS transcript_status, 'claim_1' AS component_id, lang AS component_text, 'not_started' AS review
FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE substr(text, 1, 20) END AS t FROM documents)""")
def sidecars(spark, d):
    n = F.col("doc_id")
    rows = read(spark, d, "documents").select(
        n.cast("string").alias("claim_id"), F.lit("True").alias("rating"), F.concat("source", F.lit("/"), n.cast("string"), F.lit(".json")).alias("source_file"), F.lit("train").alias("legacy_split"), F.col("lang").alias("claim"),
        F.struct(F.when(F.col("source") == "src1", " Twitter").alias("platform"), F.when(n % 3 == 0, "20200102").otherwise("soon").alias("video_date"), F.lit("u").alias("video_url"), F.when(n % 4 == 0, "  ").otherwise(F.substring("text", 1, 20)).alias("video_transcript")).alias("video_information"),
    )
    made = results.sidecar(rows)
    video = "normalized_video_information"
    return made.select(F.col("claim_id").cast("long").alias("claim_id"), "source_file", f"{video}.platform", f"{video}.video_date", F.col(f"{video}.video_transcript").alias("transcript"), f"{video}.transcript_status", F.col("claim_components")[0]["id"].alias("component_id"), F.col("claim_components")[0]["text"].alias("component_text"), F.col("review.status").alias("review"))


@query("""SELECT doc_id AS claim_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS claimed, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS n_candidates, lang AS claim FROM documents""")
def projected_results(spark, d):
    n = F.col("doc_id")
    place = F.struct(F.when(n % 2 == 0, F.col("lang")).alias("claimed_location"), F.when(n % 3 > 0, F.array(F.col("source"))).alias("candidate_locations"))
    rows = read(spark, d, "documents").select(n.alias("claim_id"), F.array(F.struct(F.lit("claim_1").alias("id"), F.col("lang").alias("text"))).alias("claim_components"), F.struct(F.lit("x").alias("platform"), F.lit("u").alias("video_url"), F.lit(None).cast("string").alias("video_date"), F.lit(None).cast("string").alias("video_transcript")).alias("normalized_video_information"), F.struct(place.alias("location")).alias("verification"), F.lit(None).cast("string").alias("rating"))
    out = results.readable(rows)
    return out.select("claim_id", F.col("verification.location.claimed_location").alias("claimed"), F.size("verification.location.candidate_locations").alias("n_candidates"), "claim")
