"""Names of publishers and accounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import NO_ACCOUNT, host, path, scheme

#: Publishers by canonical name, with the names they also go by.
PUBLISHERS = {
    "agence france presse": ["afp", "agence france presse"],
    "associated press": ["ap", "apnews", "ap news", "associated press"],
    "bbc news": ["bbc", "bbc news"],
    "c span": ["c span", "cspan"],
    "cnn": ["cnn", "cnn news"],
    "cnbc": ["cnbc", "cnbc television"],
    "guardian": ["theguardian", "the guardian", "guardian"],
    "dw news": ["dw", "dw news", "deutsche welle"],
    "abc news": ["abc", "abc news", "abcnews"],
    "cbs news": ["cbsnews", "cbs news"],
    "pbs newshour": ["pbs", "pbs news", "pbs newshour"],
    "fox news": ["foxnews", "fox news"],
    "nbc news": ["nbcnews", "nbc news"],
    "new york times": ["nyt", "nytimes", "ny times", "the new york times", "new york times"],
    "reuters": ["reuters", "reuters news"],
    "washington post": ["washingtonpost", "washington post", "the washington post"],
    "usa today": ["usatoday", "usa today"],
    "sky news": ["sky", "sky news", "skynews"],
    "france 24": ["france24", "france 24"],
    "al jazeera": ["aljazeera", "al jazeera"],
    "today": ["today", "today show", "the today show"],
}
#: Latin letters with marks and their base letters; a marked letter outside this list counts as a separator.
MARKED, BARE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēėęěğīįłńňōőřśşšťūůűųźżž", "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeegiilnnoorssstuuuuzzz"


def plain_name(name: Column) -> Column:
    """Lower case, marks dropped, a link's first path step or site, no (@handle), & as and, other signs as spaces."""
    t = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    link = F.when(t.rlike("^https?://"), t).when(t.startswith("www."), F.concat(F.lit("https://"), t))
    steps = F.filter(F.split(path(link), "/"), lambda x: x != "")
    t = F.when(link.isNotNull(), F.coalesce(F.get(steps, 0), F.substring_index(host(link), ".", 1))).otherwise(t)
    t = F.regexp_replace(F.translate(t, MARKED, BARE), r"\s*\(@?[\w.-]+\)\s*$", "")
    return F.trim(F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def publisher(name: Column) -> Column:
    """The canonical publisher of a name, else the plain name without a leading `the`."""
    t = F.regexp_replace(plain_name(name), r"^the\s+", "")
    table = F.create_map(*(F.lit(x) for canonical, names in PUBLISHERS.items() for alias in sorted({*names, canonical}) for x in (alias, canonical)))
    return F.coalesce(F.try_element_at(table, t), t)


def same_source(a: Column, b: Column) -> Column:
    """Whether two names mean one source: equal publishers, or equal without spaces and five characters or longer."""
    x, y = publisher(a), publisher(b)
    tight = lambda v: F.replace(v, F.lit(" "), F.lit(""))
    return (x != "") & (y != "") & ((x == y) | ((F.char_length(tight(x)) >= 5) & (tight(x) == tight(y))))


def uploader(url: Column) -> Column:
    """The account that a link's path names, or null."""
    u = F.trim(F.coalesce(url, F.lit("")))
    h, first = host(u), F.regexp_extract(path(u), "^/+([^/]+)", 1)
    on = lambda *sites: h.rlike("(^|\\.)(" + "|".join(s.replace(".", "[.]") for s in sites) + ")$")
    tube = F.coalesce(*(F.nullif(F.regexp_extract(path(u), p, 1), F.lit("")) for p in ("^/@([^/]+)", "^/(?:channel|user|c)/([^/]+)")))
    known = scheme(u).isin("http", "https") & (first != "")
    return F.when(
        known,
        F.when(on("youtube.com"), tube)
        .when(on("facebook.com") & ~F.lower(first).isin(NO_ACCOUNT["facebook"]), first)
        .when(on("twitter.com", "x.com") & ~F.lower(first).isin(NO_ACCOUNT["x"]), F.concat(F.lit("@"), first)),
    )
