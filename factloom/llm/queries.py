"""The registered queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import baskets, bpe, chat, decontaminate, exact_dedup, language, line_dedup, neardup, quality, resampling, secrets, substring, warc
from .common import Scratch, remainder, table

QUERIES: dict = {}
ORACLES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op9_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS k FROM d),
g AS (SELECT bare, max(CASE WHEN k = 1 THEN doc_id END) AS keep_id, count(*) AS group_size FROM r GROUP BY bare)
SELECT r.doc_id, g.keep_id, g.group_size, r.k = 1 AS kept, sha256(r.bare) AS text_sha256
FROM r JOIN g USING (bare)
"""


@_query
def op10_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op4_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))
    many = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", many("assign"), many("access"), many("hex"), F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.concat("base", "markov")).alias("spans"))


@_query
def op7_warc(spark, sf_dir):
    scratch = Scratch(spark)
    folder = warc.write_archive(table(spark, sf_dir, "pages"), f"{scratch.root}/archive", scratch=scratch)
    scratch.tidy()
    return warc.whole_records(warc.parse_records(warc.read_archive(spark, folder, scratch=scratch))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op7_warc"] = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM w
"""


@_query
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(remainder(F.col("doc_id"), 3) != 1))
    return language.language_id(docs, model, "doc_id", "text", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"))


@_query
def op2_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op3_substring_dedup(spark, sf_dir):
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


@_query
def op6_near_dedup(spark, sf_dir):
    return neardup.near_dedup(table(spark, sf_dir, "documents"))


@_query
def op5_decontaminate(spark, sf_dir):
    return decontaminate.find_all_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op8_fuzzy_lines(spark, sf_dir):
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@_query
def op11_basket_itemsets(spark, sf_dir):
    return baskets.digest(baskets.itemsets_with_rules(table(spark, sf_dir, "sale_lines")))


@_query
def op13_importance_resampling(spark, sf_dir):
    drawn = resampling.importance_resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@_query
def op12_chat_formatting(spark, sf_dir):
    import public_tokenizers

    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.format_conversations(turns, public_tokenizers.path("byte_bpe_50k.json")))


ORACLES["op12_chat_formatting"] = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss, {chat.escaped_sql("text")} AS n_text,
             CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 20 + {chat.escaped_sql("role")} END AS n_head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(n_head + n_text + 8) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
