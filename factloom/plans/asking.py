"""Queries over what is asked and shown: budgets of pages, archived copies, bounded values, order of evidence, outcomes of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import mentions, prompts, retrieval
from ..streaming import batch
from .registry import query, read

# A user's events as requests, in their order; the rest of the value names the page.

_ASKED = """WITH RECURSIVE r AS (SELECT user_id AS claim_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'web' WHEN 'click' THEN 'social' WHEN 'purchase' THEN 'image' WHEN 'signup' THEN 'metadata' ELSE event_type END AS purpose,
CASE WHEN value < 3 THEN 'http://localhost/x' ELSE 'https://Site.example/' || CAST(floor(value / 4) AS BIGINT) || '#top' END AS url, CASE WHEN value >= 3 THEN 'https://site.example/' || CAST(floor(value / 4) AS BIGINT) END AS key FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY seq) AS k, CASE purpose WHEN 'web' THEN 6 WHEN 'error' THEN 0 ELSE 4 END AS most FROM r WHERE key IS NOT NULL),
f(claim_id, k, taken) AS (SELECT DISTINCT claim_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(key VARCHAR, purpose VARCHAR, seq BIGINT)[]) FROM o
UNION ALL SELECT o.claim_id, o.k, CASE WHEN len(list_filter(taken, lambda t: t.key = o.key)) = 0 AND len(list_filter(taken, lambda t: t.purpose = o.purpose)) < most THEN list_append(taken, struct_pack(key := o.key, purpose := o.purpose, seq := o.seq)) ELSE taken END FROM f JOIN o ON o.claim_id = f.claim_id AND o.k = f.k + 1),
g AS (SELECT claim_id, unnest(arg_max(taken, k)) AS t FROM f GROUP BY claim_id),
d AS (SELECT r.*, CASE WHEN r.key IS NULL THEN 'screened' WHEN t.seq = r.seq THEN 'fetched' WHEN t.seq < r.seq THEN 'repeated' ELSE 'over budget' END AS decision FROM r LEFT JOIN g ON g.claim_id = r.claim_id AND g.t.key = r.key)"""


def _requests(spark, d):
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in {"view": "web", "click": "social", "purchase": "image", "signup": "metadata"}.items() for x in p)), F.col("event_type")), F.col("event_type"))
    url = F.when(F.col("value") < 3, "http://localhost/x").otherwise(F.concat(F.lit("https://Site.example/"), F.floor(F.col("value") / 4).cast("string"), F.lit("#top")))
    return read(spark, d, "events").select(F.col("user_id").alias("claim_id"), F.col("event_id").alias("seq"), kind.alias("purpose"), url.alias("url"))


@query(_ASKED + " SELECT claim_id, seq, purpose, key, decision FROM d")
def page_budgets(spark, d):
    return retrieval.decisions(_requests(spark, d)).select("claim_id", "seq", "purpose", "key", "decision")


# Pages of even numbers could be read; those of users over 50 name their site.


@query(_ASKED + """, p AS (SELECT *, CAST(regexp_extract(key, '[0-9]+$') AS BIGINT) AS n FROM d WHERE key IS NOT NULL)
SELECT claim_id, seq, 'retrieved_page' AS type, 'page ' || n || CASE WHEN n > 20 THEN chr(10) || 'Site name: site' ELSE '' END AS observation FROM p WHERE decision = 'fetched' AND n % 2 = 0
UNION ALL SELECT claim_id, seq, 'search_candidate', 'asked for ' || purpose FROM p WHERE decision IN ('fetched', 'repeated') AND n % 2 = 0""")
def page_evidence(spark, d):
    decided = retrieval.decisions(_requests(spark, d)).withColumns({"title": F.lit("asked  for"), "description": F.col("purpose")})
    n = F.regexp_extract("key", "[0-9]+$", 0).cast("long")
    pages = decided.filter("key IS NOT NULL").select("key").distinct().filter(n % 2 == 0).select(
        "key", F.col("key").alias("source"), F.concat(F.lit("page "), n.cast("string")).alias("body"), F.lit(None).cast("string").alias("author"), F.when(n > 20, "site").alias("site_name"), F.lit("").alias("published_at"))
    columns = ["claim_id", "seq", "type", "observation"]
    return retrieval.page_evidence(decided, pages).select(columns).union(retrieval.candidate_evidence(decided, pages).select(columns))


@query(_ASKED + """, a AS (SELECT DISTINCT claim_id, CAST(-1 AS BIGINT) AS seq, 'https://post.example/' || claim_id AS url FROM r UNION ALL SELECT claim_id, min(seq), key FROM d WHERE decision = 'fetched' GROUP BY claim_id, key)
SELECT claim_id, place, url FROM (SELECT claim_id, url, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY seq, url) AS INTEGER) AS place FROM a) WHERE place <= 5""")
def archive_requests(spark, d):
    rows = _requests(spark, d)
    posts = rows.select("claim_id", F.concat(F.lit("https://post.example/"), F.col("claim_id").cast("string")).alias("url")).distinct()
    return retrieval.archive_requests(posts, retrieval.decisions(rows).filter("decision = 'fetched'").select("claim_id", "seq", F.col("key").alias("source")))


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, text, lang, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, CASE WHEN length(t) > 300 THEN substr(t, 1, 300) || '...' ELSE t END AS body, array_to_string(w[1:10], ' ') AS words, CASE WHEN length(t) > 300 THEN substr(t, 1, 300) || '...' ELSE t END AS inner_text, lang FROM t""")
def bounded_documents(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "text", F.split("text", " ").alias("words"), F.create_map(F.lit("told"), F.struct(F.col("text").alias("text"), "lang")).alias("deep"))
    cut = prompts.bounded_rows(rows, "text", "words", "deep", length=300)
    return cut.select("doc_id", F.col("text").alias("body"), F.array_join("words", " ").alias("words"), F.col("deep")["told"]["text"].alias("inner_text"), F.col("deep")["told"]["lang"].alias("lang"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 2 END + CASE WHEN value > 50 THEN 0 ELSE 1 END AS weight FROM events")
def evidence_weights(spark, d):
    kind = F.when(F.col("event_type") == "view", "keyframe_analysis").otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", prompts.weight(kind, F.col("value") > 50).alias("weight"))


@query("""WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT CAST(d.doc_id AS VARCHAR) AS claim_id, CASE WHEN l.doc_id IS NULL OR toxic = 1 THEN 'error' ELSE 'ok' END AS status, CASE WHEN toxic = 0 THEN CASE WHEN quality = 1 THEN 'TRUE' ELSE 'NEI' END END AS verdict, coalesce(CASE WHEN l.doc_id IS NULL THEN 'no result' WHEN toxic = 1 THEN 'toxic' END, '') AS error
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN l ON l.doc_id = d.doc_id""")
def batch_outcomes(spark, d):
    labels = read(spark, d, "labels").groupBy(F.col("doc_id").cast("string").alias("claim_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))

    def judged(records):
        return records.join(labels, "claim_id").select("claim_id", F.when(F.col("quality") == 1, "TRUE").otherwise("NEI").alias("verdict"), F.lit(1).alias("seconds"), F.when(F.col("toxic") == 1, "toxic").alias("error"))

    done = batch.outcomes(read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("claim_id")).distinct(), judged)
    return done.select("claim_id", "status", "verdict", F.array_join("errors", "; ").alias("error"))


# A recogniser of all names of seven letters or more, over the documents' chunks.


@query(r"""WITH c AS (SELECT doc_id, unnest(range(0, length(text), 750)) AS spot, text FROM (SELECT doc_id, regexp_replace(text, '^[\s]+|[\s]+$', '', 'g') AS text FROM documents)), p AS (SELECT doc_id, spot, string_split_regex(substr(text, spot + 1, 800), '[^\p{L}\p{N}_]') AS w FROM c),
f AS (SELECT doc_id, spot, w, unnest(w) AS name, unnest(range(1, len(w) + 1)) AS k FROM p)
SELECT DISTINCT doc_id, name, CAST(spot + coalesce(list_sum(list_transform(w[1:k - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS start FROM f WHERE regexp_full_match(name, '[A-Z][a-z]{6,}')""")
def place_mentions(spark, d):
    texts = read(spark, d, "documents").select("doc_id", text.stripped(F.col("text")).alias("text")).filter("text <> ''")
    chunks = mentions.chunked(texts)
    return mentions.mentions(chunks, _names(chunks.select("piece").distinct()), "doc_id").select("doc_id", "name", F.col("start").cast("long").alias("start"))


def _names(pieces):
    """Each name of a piece with its span. What lies between the names comes along with them, so that lengths add up to places."""
    pattern = F.lit(r"(?s)\G(.*?)(?<![\p{L}\p{N}_])([A-Z][a-z]{6,})(?![\p{L}\p{N}_])")
    both = pieces.select("piece", F.regexp_extract_all("piece", pattern, F.lit(1)).alias("gaps"), F.regexp_extract_all("piece", pattern, F.lit(2)).alias("names"))
    met = both.select("piece", "gaps", "names", F.posexplode("names").alias("k", "word"))
    long = lambda words: F.char_length(F.array_join(words, ""))
    end = long(F.slice("gaps", F.lit(1), F.col("k") + 1)) + long(F.slice("names", F.lit(1), F.col("k") + 1))
    return met.select("piece", F.lit("LOC").alias("kind"), F.lit(0.9).alias("score"), "word", (end - F.char_length("word")).alias("start"), end.alias("end"))
