"""URL column functions. The canonical forms differ on purpose; each serves its own comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sites and account names of fact-checkers, and what marks a path as a fact check.
FACTCHECK_DOMAINS = ["snopes.com", "politifact.com", "factcheck.org", "fullfact.org", "factcheck.afp.com", "mythdetector.com", "mythdetector.ge", "leadstories.com", "checkyourfact.com"]
FACTCHECK_HANDLES = ["snopes", "politifact", "fullfact", "factcheckorg", "factcheckdotorg", "afpfactcheck", "leadstories", "checkyourfact", "mythdetector"]
FACTCHECK_LABEL = r"\bfact[\s_-]?check(?:ing|ed|er|ers)?\b|\bclaim\s*review\b"
SOCIAL_HOSTS = ["facebook.com", "x.com", "twitter.com", "tiktok.com", "youtube.com", "instagram.com"]
TRACKERS = ["fbclid", "gclid"]
#: First steps of a path that name no account.
NO_ACCOUNT = {
    "facebook": ["video", "videos", "watch", "reel", "share", "groups", "pages", "plugins", "login", "profile.php", "story.php", "permalink.php", "l.php"],
    "x": ["i", "status", "intent", "share", "home", "search", "explore", "hashtag", "login"],
}

NET = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def let(value: Column, body) -> Column:
    """body(value), the value being computed once and standing once in the plan, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def net(url: Column) -> Column:
    return F.regexp_extract(url, NET, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, QUERY, 1)


def pairs(text: Column, blank: bool) -> Column:
    """Sorted (k, v) of a query string; without `blank`, pairs with an empty value are left out."""
    cut = F.transform(F.filter(F.split(text, "&"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v")))
    return F.array_sort(cut if blank else F.filter(cut, lambda p: p["v"] != ""))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def host_of(site: Column) -> Column:
    """Lower-case host of what stands between // and the path, without user, port, brackets or a final dot."""
    low = F.regexp_replace(F.lower(site), r"^.*@", "")
    return let(low, lambda v: F.when(v.rlike(r"^\[[^\]]*\](:\d*)?$"), F.regexp_extract(v, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(F.regexp_replace(v, r":\d*$", ""), r"\.$", "")))


def host(url: Column) -> Column:
    return host_of(net(url))


def canonical_key(url: Column, claim_id: Column) -> Column:
    """The key under which links to one video are one; the claim itself where the link names no page."""
    u = F.trim(url)
    site = F.regexp_replace(F.regexp_replace(F.lower(net(u)), r"^.*@", ""), r"^www\.", "")
    place = F.regexp_replace(path(u), "/+$", "")
    found = pairs(query(u), blank=True)
    steps = F.filter(F.split(place, "/"), lambda x: x != "")
    shared = F.get(F.filter(found, lambda p: p["k"] == "v"), F.size(F.filter(found, lambda p: p["k"] == "v")) - 1)["v"]
    video = F.when((site == "youtu.be") & (place != ""), F.get(steps, 0)).when(
        site.endswith("youtube.com"), F.when((F.size(steps) >= 2) & F.get(steps, 0).isin("embed", "shorts", "live"), F.get(steps, 1)).otherwise(shared)
    )
    claim = F.concat(F.lit("claim:"), claim_id)
    text = joined(found)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", claim)
        .when(F.coalesce(video, F.lit("")) != "", F.concat(F.lit("youtube:"), video))
        .when((place == "") & (F.size(found) == 0), claim)
        .otherwise(F.concat(F.when(site == "twitter.com", "x.com").otherwise(site), F.when(place == "", "/").otherwise(place), F.when(text != "", F.concat(F.lit("?"), text)).otherwise("")))
    )


def evidence_source(url: Column) -> Column:
    """https, lower-case host, no trackers, no blank parameters, no fragment; other sources as they are."""
    u = F.trim(url)
    kept = F.filter(pairs(query(u), blank=False), lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(TRACKERS))
    text = joined(kept)
    web = F.concat(F.lit("https://"), F.lower(net(u)), F.regexp_replace(path(u), "/+$", ""), F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))
    return F.when(scheme(u).isin("http", "https"), web).otherwise(u)


def retrieval_key(url: Column) -> Column:
    """Lower-case scheme and host, the query kept, the fragment dropped, / for an empty path."""
    q = query(url)
    return F.concat(scheme(url), F.lit("://"), F.lower(net(url)), F.when(path(url) == "", "/").otherwise(path(url)), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


#: Networks whose addresses are not global, and those within them that are, as registered for IPv4.
NOT_GLOBAL = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]
GLOBAL_AFTER_ALL = ["192.0.0.9/32", "192.0.0.10/32"]
#: The same for IPv6, as patterns of the 32 hex digits of an address.
NOT_GLOBAL_6 = r"^(0{31}[01]|0064ff9b0001.*|0100000000000000.*|20010[01].*|20010db8.*|2002.*|f[cd].*|fe[89ab].*)$"
GLOBAL_AFTER_ALL_6 = r"^(200100010{23}[12]|20010003.*|200100040112.*|2001002.*|2001003.*)$"
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _number(dotted: Column) -> Column:
    """The number of a dotted address; null if it is none."""
    parts = F.transform(F.split(dotted, r"\."), lambda x: x.try_cast("bigint"))
    return F.when(dotted.rlike(IP4), F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, x: n * 256 + x))


def _within(number: Column, networks: list[str]) -> Column:
    import ipaddress

    ranges = [ipaddress.ip_network(x) for x in networks]
    out = F.lit(False)
    for r in ranges:
        out = out | number.between(int(r.network_address), int(r.broadcast_address))
    return out


def global_ip4(number: Column) -> Column:
    """Whether the IPv4 address with this number is global."""
    return let(number, lambda n: ~_within(n, NOT_GLOBAL) | _within(n, GLOBAL_AFTER_ALL))


def hex_ip6(address: Column) -> Column:
    """The 32 hex digits of an IPv6 address in any of its written forms; null if it is none."""
    tail = lambda a: let(F.lpad(F.lower(F.hex(_number(F.regexp_extract(a, r"([0-9.]+)$", 1)))), 8, "0"), lambda h: F.concat(F.regexp_replace(a, r"[0-9.]+$", ""), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")

    def digits(plain: Column) -> Column:
        short = plain.contains("::")
        sides = F.struct(groups(F.when(short, F.substring_index(plain, "::", 1)).otherwise(plain)).alias("left"), groups(F.when(short, F.substring_index(plain, "::", -1)).otherwise(F.lit(""))).alias("right"))
        many = lambda s: F.size(s["left"]) + F.size(s["right"])
        every = lambda s: F.concat(s["left"], F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - many(s), F.lit(0))), s["right"])
        form = F.when(short, ~plain.rlike("::.*::|:::")).otherwise(plain.rlike("^[^:]+(:[^:]+){7}$"))
        whole = lambda s: F.when(short, many(s) < 8).otherwise(many(s) == 8)
        good = lambda e: F.forall(e, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return let(sides, lambda s: F.when(form & whole(s), let(every(s), lambda e: F.when(good(e), F.array_join(F.transform(e, lambda g: F.lpad(g, 4, "0")), "")))))

    return let(address, lambda a: let(F.when(a.rlike(r"\.\d+$"), tail(a)).otherwise(a), digits))


def _public_literal(site: Column, h: Column) -> Column:
    mapped = lambda d: global_ip4(F.conv(F.substring(d, 25, 8), 16, 10).cast("bigint"))
    six = lambda d: F.when(d.startswith("0" * 20 + "ffff"), mapped(d)).otherwise(~d.rlike(NOT_GLOBAL_6) | d.rlike(GLOBAL_AFTER_ALL_6))
    return F.when(site.contains("[") | site.contains("]"), F.coalesce(let(hex_ip6(h), six), F.lit(False))).when(h.rlike(IP4), global_ip4(_number(h))).otherwise(True)


def is_public(url: Column) -> Column:
    """http or https, a host, no user, not localhost; a literal address must be a global one."""

    def judged(u: Column) -> Column:
        user = lambda site: F.regexp_extract(site, r"^(.*)@", 1)
        fine = lambda site, h: (h != "") & user(site).isin("", ":") & (h != "localhost") & _public_literal(site, h)
        return scheme(u).isin("http", "https") & let(net(u), lambda site: let(host_of(site), lambda h: fine(site, h)))

    return F.coalesce(let(F.trim(url), judged), F.lit(False))


def decoded(text: Column) -> Column:
    """Percent-decoded; as it is where that can't be done."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def is_factcheck(url: Column) -> Column:
    """Whether a link leads to a fact-checker: by site, account name or path, archived copies included, however often archived.

    A link that can't be read, as its host's brackets don't match or hold no IPv6 address, counts as one.
    """
    archive = r"^(?:/web/[^/]+/https?://web\.archive\.org(?::\d+)?)*/web/[^/]+/(https?://.+)$"

    def judged(u: Column) -> Column:
        return let(F.struct(net(u).alias("site"), host(u).alias("h"), decoded(path(u)).alias("place")), at)

    def at(p: Column) -> Column:
        site, h, place = p["site"], p["h"], p["place"]
        named = lambda steps: F.when((F.size(steps) > 1) & F.lower(F.get(steps, 0)).isin("c", "user", "pages"), F.get(steps, 1)).otherwise(F.get(steps, 0))
        name = let(F.split(F.regexp_replace(place, "^/+|/+$", ""), "/"), named)
        social = F.regexp_replace(F.regexp_replace(h, r"^www\.", ""), r"^m\.", "").isin(SOCIAL_HOSTS)
        account = social & F.regexp_replace(F.lower(name), "[^a-z0-9]", "").isin(FACTCHECK_HANDLES)
        checker = h.rlike(r"(^|\.)(" + "|".join(x.replace(".", "[.]") for x in FACTCHECK_DOMAINS) + ")$")
        literal = F.regexp_extract(site, r"\[([^\]]*)\]", 1)
        broken = (site.contains("[") != site.contains("]")) | (site.contains("[") & hex_ip6(literal).isNull() & ~literal.rlike(r"^v[0-9A-Fa-f]+\..+"))
        return F.coalesce(broken, F.lit(True)) | account | checker | place.rlike("(?i)" + FACTCHECK_LABEL)

    inner = lambda u: F.when(host(u) == "web.archive.org", F.nullif(F.regexp_extract(decoded(path(u)), archive, 1), F.lit("")))
    return let(F.coalesce(url, F.lit("")), lambda u: let(F.coalesce(inner(u), u), judged))


def account_page(url: Column) -> Column:
    """The page of the account that a link's path names, or null."""
    u = F.trim(F.coalesce(url, F.lit("")))
    h, first, place = host(u), F.regexp_extract(path(u), "^/+([^/]+)", 1), path(u)
    on = lambda *sites: h.rlike("(^|\\.)(" + "|".join(s.replace(".", "[.]") for s in sites) + ")$")
    handle, kind, channel = (F.regexp_extract(place, p, g) for p, g in ((r"^/@([^/]+)(?:/|$)", 1), (r"^/(channel|user|c)/([^/]+)(?:/|$)", 1), (r"^/(channel|user|c)/([^/]+)(?:/|$)", 2)))
    tube = F.when(handle != "", F.concat(F.lit("https://www.youtube.com/@"), handle)).when(channel != "", F.concat(F.lit("https://www.youtube.com/"), kind, F.lit("/"), channel))
    known = scheme(u).isin("http", "https") & (first != "")
    return F.when(
        known,
        F.when(on("youtube.com"), tube)
        .when(on("facebook.com") & ~F.lower(first).isin(NO_ACCOUNT["facebook"]), F.concat(F.lit("https://www.facebook.com/"), first))
        .when(on("twitter.com", "x.com") & ~F.lower(first).isin(NO_ACCOUNT["x"]), F.concat(F.lit("https://x.com/"), first)),
    )


def match_key(url: Column) -> Column:
    """The key under which a matched page and a video are one: the video's key, else the link without final slashes."""
    key = canonical_key(url, F.lit(""))
    return F.when(F.coalesce(url, F.lit("")) != "", F.when(key == "claim:", F.lower(F.regexp_replace(url, "/+$", ""))).otherwise(key))


def absolute(link: Column, base: Column) -> Column:
    """A link of a page as a whole link, null unless it is public: with a scheme, from //, from the root or beside the page."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    beside = F.regexp_replace(F.when(path(base) == "", F.lit("/")).otherwise(path(base)), "[^/]*$", "")

    def whole(v: Column) -> Column:
        return (
            F.when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), v)
            .when(v.startswith("//"), F.concat(scheme(base), F.lit(":"), v))
            .when(v.startswith("/"), F.concat(origin, v))
            .when(v.startswith("?"), F.concat(origin, path(base), v))
            .when(v.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), v))
            .otherwise(F.concat(origin, beside, v))
        )

    return let(F.nullif(F.trim(link), F.lit("")), lambda v: F.when(v.isNotNull(), let(whole(v), lambda w: F.when(is_public(w), w))))
