"""Sources and places of a claim: what they are called, of which kind they are, whether they are the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import sources
from .rules import place_is_plausible

#: Kinds of sources, names of platforms that say nothing of a source, names for an unknown one, words for satire.
KINDS = ["eyewitness", "news outlet", "news agency", "official account", "political actor", "activist group", "entertainment source", "satire source", "unknown"]
GENERIC = ["facebook", "instagram", "reddit", "snopes", "telegram", "tiktok", "twitter", "x", "youtube"]
UNKNOWN = ["", "n a", "none", "unknown", "unidentified"]
SATIRE = ["satire", "satirical", "fiction", "fabricated", "fake news"]
#: Display name and platform of each publisher, all of which are news outlets.
SHOWN = {
    "agence france presse": ("AFP", "afp"),
    "associated press": ("AP News", "apnews"),
    "bbc news": ("BBC News", "bbc"),
    "c span": ("C-SPAN", "cspan"),
    "cnn": ("CNN", "cnn"),
    "cnbc": ("CNBC", "cnbc"),
    "guardian": ("The Guardian", "theguardian"),
    "dw news": ("DW News", "dw"),
    "abc news": ("ABC News", "abc"),
    "cbs news": ("CBS News", "cbsnews"),
    "pbs newshour": ("PBS NewsHour", "pbs"),
    "fox news": ("Fox News", "foxnews"),
    "nbc news": ("NBC News", "nbcnews"),
    "new york times": ("The New York Times", "nytimes"),
    "reuters": ("Reuters", "reuters"),
    "washington post": ("The Washington Post", "washingtonpost"),
    "usa today": ("USA Today", "usatoday"),
    "sky news": ("Sky News", "sky"),
    "france 24": ("France 24", "france24"),
    "al jazeera": ("Al Jazeera", "aljazeera"),
    "today": ("TODAY", "today"),
}


def shown_name(name: Column) -> Column:
    """The display name of a known publisher; null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for k, (shown, _) in SHOWN.items() for x in (k, shown))), sources.publisher(name))


def platform_source(platform: Column) -> Column:
    """The display name of the publisher whose own platform this is; null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for shown, site in SHOWN.values() for x in (site, shown))), platform)


def is_known(name: Column) -> Column:
    """Whether a name names a source, rather than a platform or nobody."""
    return ~sources.publisher(name).isin(UNKNOWN + GENERIC)


def aliases(name: Column) -> Column:
    """All names that a source goes by; its plain name where it is no known publisher."""
    p = sources.publisher(name)
    table = F.create_map(*(x for canonical, names in sources.PUBLISHERS.items() for x in (F.lit(canonical), F.array(*(F.lit(n) for n in sorted({*names, canonical}))))))
    return F.coalesce(F.try_element_at(table, p), F.array(p))


def _whole(alias: Column) -> Column:
    return F.concat(F.lit(r"(?<![a-z0-9])\Q"), alias, F.lit(r"\E(?![a-z0-9])"))


def is_named(name: Column, text: Column) -> Column:
    """Whether a text names a source, by any of its names as whole words."""
    told = sources.plain_name(text)
    return is_known(name) & F.exists(aliases(name), lambda a: (a != "") & F.rlike(told, _whole(a)))


def kind_of(name: Column, kind: Column, text: Column, protected: Column) -> Column:
    """The kind of a source: as given; else satire if the text speaks of it within 400 characters of a name; else by the list of publishers."""
    told = sources.plain_name(text)
    # A word of satire lies within the window of 400 characters as a whole, so what may lie between depends on its length.
    before = "|".join(rf"{w}\b.{{0,{400 - len(w)}}}?" for w in SATIRE)
    after = "|".join(rf".{{0,{400 - len(w)}}}?\b{w}\b" for w in SATIRE)
    near = lambda a: F.rlike(told, F.concat(F.lit(rf"\b(?:{before})"), _whole(a))) | F.rlike(told, F.concat(_whole(a), F.lit(f"(?:{after})")))
    satire = ~F.coalesce(protected, F.lit(False)) & F.exists(aliases(name), lambda a: (a != "") & near(a))
    listed = F.when(sources.publisher(name).isin(list(sources.PUBLISHERS)), "news outlet").otherwise("unknown")
    given = F.when(kind.isin(KINDS) & (kind != "unknown"), kind)
    return F.when(F.coalesce(name, F.lit("")) != "", F.coalesce(given, F.when(satire, "satire source").otherwise(listed)))


def source_fields(name: Column, uploader: Column, kind: Column, mismatch: Column, text: Column, protected: Column) -> dict[str, Column]:
    """Kind, mismatch and whether the source is the uploader, which is null unless both are known by name."""
    given = F.coalesce(name, F.lit("")) != ""
    both = is_known(name) & is_known(uploader)
    return {"kind": kind_of(name, kind, text, protected), "mismatch": F.when(given, mismatch), "is_uploader": F.when(both, sources.same_source(name, uploader))}


def place_fields(claimed: Column, verified: Column, mismatch: Column, contrast: Column) -> dict[str, Column]:
    """Places as a contrast in the text states them, else as they were; the same place is no mismatch, and a stale `same` goes."""
    c, v = F.coalesce(contrast["claimed"], claimed), F.coalesce(contrast["verified"], verified)
    both = (F.coalesce(c, F.lit("")) != "") & (F.coalesce(v, F.lit("")) != "")
    differs = F.when(F.lower(c) == F.lower(v), "same").when(mismatch != "same", mismatch)
    return {"claimed": c, "verified": v, "mismatch": F.when(both, differs)}


def plausible_places(names: Column) -> Column:
    """Distinct plausible names in order, each trimmed to 200 characters."""
    cut = F.transform(names, lambda n: F.when(F.char_length(F.trim(n)) > 200, F.concat(F.substring(F.trim(n), 1, 200), F.lit("..."))).otherwise(F.trim(n)))
    return F.array_distinct(F.filter(cut, lambda n: F.coalesce(place_is_plausible(n), F.lit(False))))


#: Kinds of places that a geocoder may return for an administrative area, in the order of an address.
PLACE_KINDS = ["city", "country", "county", "district", "province", "region", "state", "state district"]


def is_target_place(*kinds: Column) -> Column:
    norm = lambda k: F.trim(F.regexp_replace(F.lower(F.coalesce(k, F.lit(""))), r"[\W_]+", " "))
    return F.arrays_overlap(F.array(*(norm(k) for k in kinds)), F.array(*(F.lit(k) for k in PLACE_KINDS)))


def choose_claimed(candidates: Column) -> Column:
    """The name of the one candidate that the claim supports; null for none or several. candidates: array of (name, groups)."""
    names = F.transform(F.filter(candidates, lambda c: F.array_contains(c["groups"], "claim")), lambda c: c["name"])
    return F.when(F.size(names) == 1, F.get(names, 0))


def address_value(address: Column, keys: list[str]) -> Column:
    """The first value of an address that is there, normalised."""
    first = F.coalesce(*(F.nullif(F.try_element_at(address, F.lit(k)), F.lit("")) for k in keys))
    return F.trim(F.regexp_replace(F.lower(F.translate(first, sources.MARKED, sources.BARE)), r"(?U)[\W_]+", " "))
