"""Queries over links: platform forms, public addresses, match keys, account pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import social, urls
from .registry import query, read

#: Written forms of links by the number of an event, and what the platform's own form and status are.
_FORMS = [
    ("concat('https://www.facebook.com/watch/?v=', n, '&ref=share')", "concat('https://www.facebook.com/watch/?v=', n)", "facebook", "normalized"),
    ("concat('https://m.facebook.com/some.page/videos/title/', n, '/?t=1')", "concat('https://www.facebook.com/watch/?v=', n)", "facebook", "normalized"),
    ("concat('http://facebook.com/reel/', n, '?s=1')", "concat('https://www.facebook.com/reel/', n, '/')", "facebook", "normalized"),
    ("concat('https://www.facebook.com/plugins/video.php?height=3&href=https%3A%2F%2Fwww.facebook.com%2Fp%2Fvideos%2F', n, '%2F&x=1')", "concat('https://www.facebook.com/watch/?v=', n)", "facebook", "normalized"),
    ("concat('https://fb.watch/', n, '/')", "concat('https://fb.watch/', n, '/')", "facebook", "needs_redirect"),
    ("concat('https://www.facebook.com/share/v/', n)", "concat('https://www.facebook.com/share/v/', n)", "facebook", "needs_redirect"),
    ("concat('https://web.facebook.com/user', n, '/posts?x=1')", "concat('https://www.facebook.com/user', n, '/posts')", "facebook", "normalized"),
    ("concat('https://twitter.com/u/statuses/', n, '?s=20')", "concat('https://x.com/i/web/status/', n)", "x", "normalized"),
    ("concat('https://x.com/u', n)", "concat('https://x.com/u', n)", "x", "ok"),
    ("concat('https://t.co/a', n)", "concat('https://t.co/a', n)", "x", "needs_redirect"),
    ("concat(' \"https://youtu.be/id', n, '?t=3\" ')", "concat('https://www.youtube.com/watch?v=id', n)", "youtube", "normalized"),
    ("concat('https://www.youtube.com/shorts/id', n)", "concat('https://www.youtube.com/watch?v=id', n)", "youtube", "normalized"),
    ("concat('https://m.youtube.com/watch?a=b&amp;v=id', n)", "concat('https://www.youtube.com/watch?v=id', n)", "youtube", "normalized"),
    ("concat('https://www.youtube.com/results?q=', n)", "concat('https://www.youtube.com/results?q=', n)", "youtube", "search_page"),
    ("concat('https://vm.tiktok.com/@user.', n, '/video/', n, '?lang=en')", "concat('https://www.tiktok.com/@user.', n, '/video/', n)", "tiktok", "normalized"),
    ("concat('https://v16.tiktokcdn.com/', n, '.mp4')", "concat('https://v16.tiktokcdn.com/', n, '.mp4')", "tiktok", "ephemeral_media_url"),
    ("concat('https://www.instagram.com/user/reel/C', n, '/?igsh=1')", "concat('https://www.instagram.com/reel/C', n, '/')", "instagram", "normalized"),
    ("concat('https://old.reddit.com/r/a/comments/', n, '/?x=1')", "concat('https://www.reddit.com/r/a/comments/', n, '/')", "reddit", "normalized"),
    ("concat('https://example.com/watch?v=', n)", "concat('https://example.com/watch?v=', n)", None, "unsupported"),
    ("concat('https://v.redd.it/', n)", "concat('https://v.redd.it/', n)", None, "unsupported"),
    ("concat('https://www.tiktok.com/embed/', n)", "concat('https://www.tiktok.com/embed/', n)", "tiktok", "normalized"),
]
_N = len(_FORMS)


def _case(column: int) -> str:
    show = lambda x: "NULL" if x is None else x if column < 2 else f"'{x}'"
    return f"CASE event_id % {_N} " + " ".join(f"WHEN {i} THEN {show(f[column])}" for i, f in enumerate(_FORMS)) + " END"


_LINKED = f"WITH e AS (SELECT event_id, event_id AS n FROM events), l AS (SELECT event_id, {_case(0)} AS link, {_case(1)} AS url, {_case(2)} AS platform, {_case(3)} AS status FROM e) "


def _linked(spark, d):
    rows = read(spark, d, "events").select("event_id", F.col("event_id").alias("n"))
    return rows.select("event_id", F.expr(_case(0)).alias("link"))


@query(_LINKED + "SELECT event_id, link, url, platform, status, url <> link AS changed FROM l")
def social_links(spark, d):
    return _linked(spark, d).select("event_id", "link", social.social(F.col("link")).alias("s")).select("event_id", "link", "s.*")


@query(_LINKED + """, t AS (SELECT concat('https://t.co/a', event_id) AS link, concat('https://youtu.be/t', event_id) AS target FROM events WHERE event_id % 2 = 1)
SELECT event_id, coalesce('https://www.youtube.com/watch?v=t' || event_id, url) AS url, CASE WHEN t.link IS NOT NULL THEN 'youtube' ELSE platform END AS platform, CASE WHEN t.link IS NOT NULL THEN 'normalized' ELSE status END AS status
FROM l LEFT JOIN t ON t.link = l.link""".replace("coalesce('https://www.youtube.com/watch?v=t' || event_id, url)", "CASE WHEN t.link IS NOT NULL THEN 'https://www.youtube.com/watch?v=t' || event_id ELSE url END"))
def social_links_resolved(spark, d):
    # Looked-up redirects are a table, so resolving is a left join on the link and no request is made here.
    known = read(spark, d, "events").filter("event_id % 2 = 1").select(F.concat(F.lit("https://t.co/a"), F.col("event_id").cast("string")).alias("link"), F.concat(F.lit("https://youtu.be/t"), F.col("event_id").cast("string")).alias("target"))
    met = _linked(spark, d).join(known, "link", "left")
    return met.select("event_id", social.social(F.col("link"), F.col("target")).alias("s")).select("event_id", "s.url", "s.platform", "s.status")


_KEYS = ["concat('https://www.youtube.com/watch?v=id', n)", "concat('http://YouTu.be/id', n)", "concat('https://twitter.com/u/status/', n)", "'https://EXAMPLE.com/'", "concat('https://www.Example.com/A/', n, '/')", "NULL"]
_KEYED = ["concat('youtube:id', n)", "concat('youtube:id', n)", "concat('x.com/u/status/', n)", "'https://example.com'", "concat('example.com/A/', n)", "NULL"]
_pick = lambda forms: f"CASE event_id % {len(forms)} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"


@query(f"SELECT event_id, {_pick(_KEYED)} AS key FROM (SELECT event_id, event_id AS n FROM events)")
def match_key(spark, d):
    rows = read(spark, d, "events").select("event_id", F.col("event_id").alias("n"))
    return rows.select("event_id", urls.match_key(F.expr(_pick(_KEYS))).alias("key"))


_ACCOUNTS = ["concat('https://www.youtube.com/@name', n, '/videos')", "concat('https://youtube.com/channel/UC', n)", "concat('https://m.facebook.com/page.', n, '/posts/1')", "concat('https://x.com/user', n, '/status/1')", "concat('https://x.com/i/status/', n)", "concat('https://www.facebook.com/watch/?v=', n)", "concat('ftp://x.com/user', n)", "concat('https://example.com/user', n)"]
_NAMES = ["concat('name', n)", "concat('UC', n)", "concat('page.', n)", "concat('@user', n)", "NULL", "NULL", "NULL", "NULL"]
_HOMES = ["concat('https://www.youtube.com/@name', n)", "concat('https://www.youtube.com/channel/UC', n)", "concat('https://www.facebook.com/page.', n)", "concat('https://x.com/user', n)", "NULL", "NULL", "NULL", "NULL"]


@query(f"SELECT event_id, {_pick(_NAMES)} AS account, {_pick(_HOMES)} AS profile FROM (SELECT event_id, event_id AS n FROM events)")
def uploader_profile(spark, d):
    from ..functions import sources

    rows = read(spark, d, "events").select("event_id", F.col("event_id").alias("n")).withColumn("u", F.expr(_pick(_ACCOUNTS)))
    return rows.select("event_id", sources.uploader(F.col("u")).alias("account"), urls.account_page(F.col("u")).alias("profile"))


def _number(dotted: str) -> int:
    a, b, c, e = map(int, dotted.split("."))
    return (a << 24) + (b << 16) + (c << 8) + e


#: First and last address of each network that isn't global, written out by hand for the SQL.
_RANGES = [("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("240.0.0.0", "255.255.255.255")]
_EDGES = [_number(x) + k for a, z in _RANGES for x, k in ((a, -1), (a, 0), (z, 0), (z, 1)) if 0 <= _number(x) + k < 1 << 32] + [_number("192.0.0.9"), _number("192.0.0.10"), _number("192.0.0.11"), _number("8.8.8.8")]
_IP = f"CASE WHEN event_id < {len(_EDGES)} THEN [{', '.join(map(str, _EDGES))}][event_id + 1] ELSE (event_id * 2654435761) % 4294967296 END"


@query(f"""WITH a AS (SELECT event_id, CAST({_IP} AS BIGINT) AS ip FROM events)
SELECT event_id, ip NOT BETWEEN 3221225481 AND 3221225482 AND ({" OR ".join(f"ip BETWEEN {_number(a)} AND {_number(z)}" for a, z in _RANGES)}) AS refused FROM a""")
def public_address(spark, d):
    ip = F.when(F.col("event_id") < len(_EDGES), F.get(F.array(*(F.lit(x).cast("bigint") for x in _EDGES)), F.col("event_id").cast("int"))).otherwise((F.col("event_id") * 2654435761) % 4294967296)
    rows = read(spark, d, "events").select("event_id", ip.alias("ip"))
    dotted = F.concat_ws(".", *((F.floor(F.col("ip") / (1 << 24 - 8 * i)) % 256).cast("string") for i in range(4)))
    links = F.concat(F.lit("http://"), dotted, F.when(F.col("event_id") % 2 == 0, ":80/x").otherwise("/y"))
    return rows.select("event_id", (~urls.is_public(links)).alias("refused"))


_SIX = [("::1", True), ("fd00::%s", True), ("fe80::%s", True), ("2001:db8::%s", True), ("2002:%s::1", True), ("64:ff9b:1::%s", True), ("::ffff:10.0.0.1", True), ("::ffff:8.8.8.8", False), ("2606:4700::%s", False), ("2a00:1450:4001:81b::%s", False), ("2001:20::%s", False), ("100::%s", True), ("1:2:3:4:5:6:7:8:%s", True), ("fe80:::%s", True)]



@query(f"SELECT event_id, CASE event_id % {len(_SIX)} " + " ".join(f"WHEN {i} THEN {r}" for i, (_, r) in enumerate(_SIX)) + " END AS refused FROM events")
def public_address_v6(spark, d):
    group = F.lower(F.hex(F.col("event_id") % 65536))
    address = F.get(F.array(*(F.replace(F.lit(a), F.lit("%s"), group) for a, _ in _SIX)), (F.col("event_id") % len(_SIX)).cast("int"))
    return read(spark, d, "events").select("event_id", (~urls.is_public(F.concat(F.lit("http://["), address, F.lit("]/")))).alias("refused"))


_ARCHIVED = ["concat('https://web.archive.org/web/2020/https://web.archive.org/web/2019/http://www.snopes.com/', n)", "concat('https://example.com/%66act-check/', n)", "concat('HTTPS://WWW.SNOPES.COM/', n)", "concat('http://[broken/', n)", "concat('https://web.archive.org/web/2020/https://example.com/', n)", "concat('https://www.youtube.com/c/PolitiFact/', n)", "concat('https://notsnopes.com/', n)", "concat('https://example.com/100%/', n)"]


@query(f"SELECT event_id, event_id % {len(_ARCHIVED)} IN (0, 1, 2, 3, 5) AS is_factcheck FROM events")
def factcheck_url_forms(spark, d):
    rows = read(spark, d, "events").select("event_id", F.col("event_id").alias("n"))
    return rows.select("event_id", urls.is_factcheck(F.expr(_pick(_ARCHIVED))).alias("is_factcheck"))


_HREFS = [("'/a/' || page_id", "origin || '/a/' || page_id"), ("'b' || page_id || '?x=1'", "origin || regexp_replace(path, '[^/]*$', '') || 'b' || page_id || '?x=1'"), ("'//cdn.example.com/' || page_id", "scheme || '://cdn.example.com/' || page_id"), ("'http://10.0.0.1/' || page_id", "NULL"), ("'mailto:a@b.c'", "NULL"), ("'https://example.org/' || page_id", "'https://example.org/' || page_id"), ("''", "NULL")]


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS path FROM pages)
SELECT page_id, CASE page_id % {len(_HREFS)} {" ".join(f"WHEN {i} THEN {r}" for i, (_, r) in enumerate(_HREFS))} END AS link FROM p""")
def absolute_links(spark, d):
    href = F.expr(f"CASE page_id % {len(_HREFS)} " + " ".join(f"WHEN {i} THEN {h}" for i, (h, _) in enumerate(_HREFS)) + " END")
    return read(spark, d, "pages").select("page_id", urls.absolute(href, F.col("url")).alias("link"))
