"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order Markov chains over characters are trained from labelled samples, one on random strings and one on
ordinary identifiers. A token outside the pattern hits is reported where the log-likelihood ratio of the two is
high. Everything on the main path is a Spark SQL expression within a single scan; the models are one array of
fixed size (68 x 68 log ratios).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds, in the order in which kinds at one place are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
N = len(ALPHABET) + 1


def _places(text: Column, pattern: str, kind: str, order: int, keep=None) -> Column:
    """Spans (start, order, end, kind, hit) of the leftmost non-overlapping matches, in code points.

    The text between the matches, from split(), gives the distances; the matches themselves, from
    regexp_extract_all(), the lengths. Both walk the text as one search does.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    at = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), F.char_length(hit).alias("n"), hit.alias("hit")))

    kind_of = "array<struct<start:int,order:int,end:int,kind:string,hit:string>>"
    none = F.array().cast(kind_of)

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), (start + x["n"]).alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit"))
        return F.struct((start + x["n"]).alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    # Matches are summed up in blocks of about the root of their number, then the blocks: appending to one long array
    # would copy it for every match.
    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)
    moved = lambda done, b: F.struct((done["at"] + b["at"]).alias("at"), F.concat(done["to"], F.array(done["at"])).alias("to"))
    shift = lambda s, by: F.struct((s["start"] + by).alias("start"), s["order"].alias("order"), (s["end"] + by).alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit"))

    def summed(found: Column) -> Column:
        return let(F.ceil(F.sqrt(F.size(found))).cast("int") + 1, lambda width: let(blocks(found, width), joined))

    def blocks(found: Column, width: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), width)
        return F.transform(starts, lambda i: F.aggregate(F.slice(found, i, width), F.struct(F.lit(0).alias("at"), none.alias("spans")), step))

    def joined(parts: Column) -> Column:
        shifts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("to")), moved, lambda done: done["to"])
        return F.flatten(F.zip_with(parts, shifts, lambda b, by: F.transform(b["spans"], lambda s: shift(s, by))))

    # Bound once, so that the text is searched once.
    spans = let(at, summed)
    return F.when(F.rlike(text, F.lit(pattern)), F.filter(spans, keep) if keep else spans).otherwise(none)


def base_spans(text: Column) -> list[Column]:
    """The spans of the kinds assign, access and hex."""
    value = lambda hit: F.regexp_extract(hit, ASSIGN, 2)
    return [_places(text, ASSIGN, "assign", 0, lambda s: F.char_length(value(s["hit"])) >= 6), _places(text, ACCESS, "access", 1), _places(text, HEX, "hex", 2)]


def labelled_samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, sample_docs: int = 300, random_strings: int = 4000) -> DataFrame:
    """Training rows (token, is_random).

    Random strings are digests written in several alphabets. Ordinary identifiers are the words of about `sample_docs`
    documents, alone and joined as identifiers are, without digits and without any hit of the fixed patterns. The
    bound is on what the models are fitted to; the scan reads everything.
    """
    spark = docs.sparkSession
    n = docs.count()
    share = min(1.0, sample_docs / max(n, 1))
    chosen = docs.filter(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words = chosen.select(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,}(?![A-Za-z0-9+/_=-])"), F.lit(0)).alias("w"))
    title = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 100))
    joined = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.array(F.concat(a, F.lit("_"), b), F.concat(a, title(b)), F.concat(F.upper(a), F.lit("_"), F.upper(b)), F.concat(a, F.lit("-"), b)))
    ordinary = words.select(F.explode(F.concat("w", F.when(F.size("w") > 1, F.flatten(joined)).otherwise(F.array().cast("array<string>")))).alias("token"))
    seed = spark.range(random_strings).select(F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256).alias("hex"))
    coded = F.base64(F.unhex("hex"))
    kinds = [F.substring("hex", 1, 40), F.upper(F.substring("hex", 1, 32)), F.substring(coded, 1, 40), F.translate(F.substring(coded, 1, 36), "+/=", "xQ7"), F.upper(F.translate(F.substring(coded, 1, 32), "+/=", "K4Z")), F.lower(F.translate(F.substring(coded, 1, 32), "+/=", "m5w"))]
    return ordinary.withColumn("is_random", F.lit(False)).union(seed.select(F.explode(F.array(*kinds)).alias("token"), F.lit(True).alias("is_random")))


def _codes(token: Column) -> Column:
    """Positions in the alphabet from 1, after a leading 0 for the start."""
    return F.concat(F.array(F.lit(0)), F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)))


def train(samples: DataFrame, token: str = "token", is_random: str = "is_random") -> list[float]:
    """Log ratios of the two chains' transition probabilities, add-one smoothed, as an N x N array by rows.

    Characters outside the alphabet and null or empty tokens are left out; without samples every ratio is 0.
    """
    spark = samples.sparkSession
    codes = samples.filter(F.col(token).isNotNull() & (F.col(token) != "") & F.col(is_random).isNotNull()).select(F.col(is_random).alias("r"), _codes(F.col(token)).alias("c"))
    pairs = codes.select("r", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).filter("p.b > 0")
    counts = pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count_if("r").alias("x"), F.count_if(~F.col("r")).alias("y"))
    grid = spark.range(N * N).select((F.col("id") / N).cast("int").alias("a"), (F.col("id") % N).cast("int").alias("b"))
    full = grid.join(counts, ["a", "b"], "left").fillna(0)
    rows = full.groupBy("a").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.array_sort(F.collect_list(F.struct("b", "x", "y"))).alias("cells"))
    ratio = F.transform("cells", lambda c: F.log((c["x"] + 1) / (F.col("sx") + N)) - F.log((c["y"] + 1) / (F.col("sy") + N)))
    return [v for r in rows.select("a", ratio.alias("v")).orderBy("a").collect() for v in r.v]


def _score(token: Column, model: Column) -> Column:
    """Log-likelihood ratio of a token, by its characters."""
    codes = _codes(token)
    steps = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * N + b)
    return F.aggregate(steps, F.lit(0.0), lambda total, i: total + F.get(model, i))


def scan(docs: DataFrame, model: list[float], doc_id: str = "doc_id", text: str = "text", *, least_ratio: float = 0.25) -> DataFrame:
    """One row for each input row: doc_id, base (array of spans), markov (array of spans).

    A Markov span is a maximal token of at least 16 characters that overlaps no base span and whose log-likelihood
    ratio is at least `least_ratio` a character. A null or empty text has no spans; repeated rows and null ids keep
    their rows; other columns are ignored.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    values = F.split(F.lit(",".join(f"{v:.6f}" for v in model)), ",").cast("array<double>")
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"))
    rows = rows.select("doc_id", "text", F.array_sort(F.concat(*base_spans(F.col("text")))).alias("base"))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    odd = lambda s: _score(s["hit"], values) >= least_ratio * F.char_length(s["hit"])
    return rows.select("doc_id", "base", _places(F.col("text"), CANDIDATE, "markov", 3, lambda s: odd(s) & free(s)).alias("markov"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by start and then by the order of kinds."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
