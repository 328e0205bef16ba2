"""Which pages of a claim are fetched: requests in order, screened, each page once, within a budget for each purpose.

The decisions are made before anything is fetched, over the table of all requests, so that fetching is one lookup of
distinct pages, by a recorded or a live provider, and replaying it a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls

#: How many pages a claim may ask for by purpose, and how many archived copies.
BUDGETS = {"metadata": 4, "web": 6, "social": 4, "image": 4}
ARCHIVES = 5
#: What a page's author, site and date are called in what is kept of it.
TOLD = (("Page author", "author"), ("Site name", "site_name"), ("Publication date (not capture date)", "published_at"))


def decisions(requests: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    """The requests (claim_id, seq, purpose, url) with key and decision: screened, fetched, repeated or over budget.

    Requests of a claim come by seq, which is unique in it. A link that isn't public, or that leads to a fact check, is
    screened. A page that was fetched before is repeated, for whatever purpose; else the request is fetched while its
    purpose has had less pages than its budget, and over budget beyond; such a page may still be fetched for another
    purpose. An unknown purpose has no budget.

    Only the first request of a page for a purpose can be fetched, and of these only the first ones: before the budget
    of a purpose is used up, no more pages of its own and of the other purposes' budgets can have been taken. So each
    claim is cut to a bounded number of requests, in the shuffle already, before they are gone through in order.
    """
    budgets = budgets or BUDGETS
    limit = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in budgets.items() for x in p)), F.col("purpose")), F.lit(0))
    # A link is read once, however many requests name it; rows without one have no key.
    url = F.col("url")
    open_ = F.coalesce(urls.is_public(url), F.lit(False)) & ~F.coalesce(urls.is_factcheck(url), F.lit(True))
    keys = requests.filter("url IS NOT NULL").select("url").distinct().select("url", F.when(open_, urls.retrieval_key(url)).alias("key"))
    rows = requests.join(keys, "url", "left")
    firsts = rows.filter("key IS NOT NULL").groupBy("claim_id", "purpose", "key").agg(F.min("seq").alias("seq"))
    order = Window.partitionBy("claim_id", "purpose").orderBy("seq")
    able = firsts.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sum(budgets.values())).withColumn("most", limit)
    of = able.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("seq", "purpose", "key", "most"))).alias("asked"))
    none = F.filter("asked", lambda x: F.lit(False))

    def step(taken: Column, x: Column) -> Column:
        known = F.exists(taken, lambda t: t["key"] == x["key"])
        spent = F.size(F.filter(taken, lambda t: t["purpose"] == x["purpose"]))
        return F.when(~known & (spent < x["most"]), F.concat(taken, F.array(x))).otherwise(taken)

    fetched = of.select("claim_id", F.explode(F.aggregate("asked", none, step)).alias("x")).select("claim_id", "x.key", F.col("x.seq").alias("first"))
    met = rows.join(fetched, ["claim_id", "key"], "left")
    decision = F.when(F.col("key").isNull(), "screened").when(F.col("first") == F.col("seq"), "fetched").when(F.col("first") < F.col("seq"), "repeated").otherwise("over budget")
    return met.select(*requests.columns, "key", decision.alias("decision"))


def page_evidence(decided: DataFrame, pages: DataFrame) -> DataFrame:
    """claim_id, seq, type, source, observation, verified of the pages fetched that have a body: the body, and what is told of its author, site and date.

    pages: key, source, body, author, site_name, published_at; a row for each page that could be read.
    """
    met = decided.filter("decision = 'fetched'").join(pages, "key").filter(F.coalesce("body", F.lit("")) != "")
    lines = [F.when(F.coalesce(F.col(f), F.lit("")) != "", F.concat(F.lit(f"\n{label}: "), F.col(f))).otherwise("") for label, f in TOLD]
    return met.select("claim_id", "seq", F.lit("retrieved_page").alias("type"), "source", F.concat("body", *lines).alias("observation"), F.lit(True).alias("verified"))


def candidate_evidence(decided: DataFrame, pages: DataFrame, kind: str = "search_candidate") -> DataFrame:
    """claim_id, seq, type, source, observation, verified of search results whose page was read, by this request or before.

    decided: as of decisions, with title and description of each result, which are cut to 1000 characters. A result that
    speaks of a fact check has to be left out before, as it must not use up a budget.
    """
    said = text.clean(F.concat_ws(" ", "title", "description"), 1000)
    met = decided.filter("decision IN ('fetched', 'repeated')").join(pages.select("key", "source"), "key")
    return met.select("claim_id", "seq", F.lit(kind).alias("type"), "source", said.alias("observation"), F.lit(False).alias("verified")).filter("observation <> ''")


def archive_requests(posts: DataFrame, found: DataFrame, most: int = ARCHIVES) -> DataFrame:
    """claim_id, place, url of the links whose archived copies are asked for: the post's own, then the sources of fetched pages in order, each once, `most` in all.

    posts: claim_id, url. found: claim_id, seq, source. Spark cuts each claim to the first ones before it shuffles them.
    """
    rows = posts.filter(F.coalesce("url", F.lit("")) != "").select("claim_id", F.lit(-1).cast("long").alias("seq"), "url").union(found.select("claim_id", F.col("seq").cast("long"), F.col("source").alias("url")))
    one = rows.groupBy("claim_id", "url").agg(F.min("seq").alias("seq"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("claim_id").orderBy("seq", "url"))).filter(F.col("place") <= most).select("claim_id", "place", "url")
