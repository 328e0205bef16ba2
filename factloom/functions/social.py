"""Links to posts and videos on social platforms, put into one form each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import let, net, query
from .urls import path as raw_path

#: Hosts of the platforms, without www.
FACEBOOK = ["facebook.com", "m.facebook.com", "web.facebook.com", "fb.watch"]
X = ["twitter.com", "x.com", "mobile.twitter.com", "mobile.x.com"]
YOUTUBE = ["youtube.com", "m.youtube.com", "youtu.be"]
INSTAGRAM = ["instagram.com", "m.instagram.com"]


def parameter(text: Column, name: str) -> Column:
    """The first value of a query parameter that isn't blank, decoded; null without one."""
    found = F.nullif(F.regexp_extract(text, rf"(?:^|&){name}=([^&]+)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(found), found)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def stripped(url: Column) -> Column:
    """Without white space and quotes around it, escaped ampersands plain."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s+|\s+$", "")
    return F.replace(F.replace(F.regexp_replace(bare, r"""^['"]+|['"]+$""", ""), F.lit("\\&"), F.lit("&")), F.lit("&amp;"), F.lit("&"))


def _one(u: Column) -> Column:
    """struct(url, platform, status) of a stripped link that isn't wrapped in another one."""
    parts = lambda v: F.struct(v.alias("u"), F.regexp_replace(F.lower(net(v)), r"^www\.", "").alias("site"), F.regexp_replace(raw_path(v), ";[^/]*$", "").alias("place"), query(v).alias("asked"))
    return let(let(u, parts), lambda p: _named(p["u"], p["site"], p["place"], p["asked"]))


def _named(u: Column, site: Column, place: Column, asked: Column) -> Column:
    out = lambda platform, status, url=u: F.struct(url.alias("url"), F.lit(platform).alias("platform"), (F.lit(status) if isinstance(status, str) else status).alias("status"))
    made = lambda platform, *parts: out(platform, "normalized", F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)))

    shown, video, reel = parameter(asked, "v"), F.get(F.reverse(F.regexp_extract_all(place, F.lit(r"/(\d+)(?:/|$)"), F.lit(1))), 0), _found(place, r"/reel/(\d+)")
    clean = F.concat(F.lit("https://www.facebook.com"), place)
    facebook = (
        F.when((F.regexp_replace(place, "/+$", "") == "/watch") & shown.isNotNull(), made("facebook", "https://www.facebook.com/watch/?v=", shown))
        .when(place.contains("/videos/") & video.isNotNull(), made("facebook", "https://www.facebook.com/watch/?v=", video))
        .when(reel.isNotNull(), made("facebook", "https://www.facebook.com/reel/", reel, "/"))
        .when((site == "fb.watch") | place.contains("/share/v/") | place.contains("/share/r/"), out("facebook", "needs_redirect"))
        .otherwise(out("facebook", F.when(clean == u, "ok").otherwise("normalized"), clean))
    )
    post = _found(place, r"/status(?:es)?/(\d+)")
    x = F.when(post.isNotNull(), made("x", "https://x.com/i/web/status/", post)).otherwise(out("x", "ok"))
    short = _found(place, r"^/*([^/]+)")
    framed = F.coalesce(_found(place, r"^/embed/([^/?]+)"), _found(place, r"^/shorts/([^/?]+)"), F.when(place == "/watch", shown))
    youtube = (
        F.when(site == "youtu.be", F.when(short.isNotNull(), made("youtube", "https://www.youtube.com/watch?v=", short)).otherwise(out("youtube", "ok")))
        .when(place == "/results", out("youtube", "search_page"))
        .when(framed.isNotNull(), made("youtube", "https://www.youtube.com/watch?v=", framed))
        .otherwise(out("youtube", "ok"))
    )
    clip, user, embed = _found(place, r"/@[^/]+/video/(\d+)"), _found(place, r"/@([^/]+)/video/"), _found(place, r"^/embed/(\d+)")
    tiktok = (
        F.when(site.contains("tiktokcdn.com"), out("tiktok", "ephemeral_media_url"))
        .when(clip.isNotNull(), made("tiktok", "https://www.tiktok.com/@", user, "/video/", clip))
        .when(embed.isNotNull(), made("tiktok", "https://www.tiktok.com/embed/", embed))
        .otherwise(out("tiktok", "ok"))
    )
    kind, code = _found(place, r"/(p|reel|tv)/([^/?#]+)", 1), _found(place, r"/(p|reel|tv)/([^/?#]+)", 2)
    instagram = F.when(kind.isNotNull(), made("instagram", "https://www.instagram.com/", kind, "/", code, "/")).otherwise(out("instagram", "ok"))
    return (
        F.when(site.isin(FACEBOOK), facebook)
        .when(site.isin(X), x)
        .when(site == "t.co", out("x", "needs_redirect"))
        .when(site.isin(YOUTUBE), youtube)
        .when(site.endswith("tiktok.com") | site.contains("tiktokcdn.com"), tiktok)
        .when(site.isin(INSTAGRAM), instagram)
        .when(site.endswith("reddit.com") | (site == "redd.it"), made("reddit", "https://www.reddit.com", place))
        .otherwise(F.struct(u.alias("url"), F.lit(None).cast("string").alias("platform"), F.lit("unsupported").alias("status")))
    )


def social(url: Column, target: Column | None = None) -> Column:
    """struct(url, platform, status, changed): the platform's own form of a link.

    A player that wraps a link stands for the link. target: where the link redirects to, if that was looked up; a
    link that needs a redirect then stands for its target. status is one of normalized, ok, needs_redirect,
    search_page, ephemeral_media_url, unsupported.
    """
    def unwrapped(u: Column) -> Column:
        host = F.regexp_replace(F.lower(net(u)), r"^www\.", "")
        inner = F.when(host.isin(FACEBOOK) & raw_path(u).contains("/plugins/video.php"), parameter(query(u), "href"))
        return let(inner, lambda i: F.struct(F.when(i.isNotNull(), stripped(i)).otherwise(u).alias("link"), i.isNotNull().alias("inner")))

    def found(w: Column) -> Column:
        return let(_one(w["link"]), lambda one: ended(w, one))

    def ended(w: Column, one: Column) -> Column:
        again = F.lit(False) if target is None else F.coalesce((one["status"] == "needs_redirect") & (target != w["link"]), F.lit(False))
        last = one if target is None else F.when(again, _one(stripped(target))).otherwise(one)
        return let(last, lambda x: F.struct(x["url"].alias("url"), x["platform"].alias("platform"), x["status"].alias("status"), (w["inner"] | again | ~x["url"].eqNullSafe(url)).alias("changed")))

    return let(let(stripped(url), unwrapped), found)
