"""Language ID by multilingual mixture inference.

Training counts character trigrams of every training text, hashed into a fixed number of buckets, by language. For
a document the trigrams are taken as draws from a mixture of the languages' trigram distributions. Expectation-
maximisation estimates the proportions; languages join the set one at a time, as long as the likelihood grows by
more than the penalty for one more proportion. The document's language is the one with the largest proportion.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 15


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigrams(text: str, chunk: int = 1 << 20):
    """Bucket numbers of the trigrams of letters and single spaces, in pieces that bound the memory.

    Pieces hang together: each begins with the last two signs of the one before, and only the text's own ends are padded.
    """
    letters, low = _letter_table(), text.lower()
    rest, inside = np.array([32], np.uint32), False
    for at in range(0, len(low), chunk):
        points = np.frombuffer(low[at : at + chunk].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters[points]
        points = np.where(is_letter, points, np.uint32(32))
        before = np.empty_like(is_letter)
        before[0], before[1:] = inside, is_letter[:-1]
        inside = bool(is_letter[-1])
        points = np.concatenate((rest, points[is_letter | before]))
        if at + chunk >= len(low) and points[-1] != 32:
            points = np.append(points, np.uint32(32))
        if len(points) > 2:
            mixed = points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1] * np.uint32(0x85EBCA77) ^ points[2:] * np.uint32(0xC2B2AE3D)
            yield (mixed * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)).astype(np.int64)
        rest = points[-2:]


class Model:
    """Smoothed trigram distributions, one row of 2^15 numbers for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5, penalty: float = 3.0, rounds: int = 12):
        self.languages, self.penalty, self.rounds = languages, penalty, rounds
        counts = counts + smoothing
        self.p = (counts / counts.sum(1, keepdims=True)).astype(np.float64) if len(languages) else counts
        self.log_p = np.log(self.p)

    def proportions(self, text: str | None) -> dict[str, float]:
        """The chosen languages with their proportions; none for a text without letters or an untrained model."""
        parts = list(trigrams(text or ""))
        if not parts or not self.languages:
            return {}
        codes = np.concatenate(parts)
        if len(codes) > 4 << BITS:
            count = np.bincount(codes, minlength=1 << BITS)
            codes = np.flatnonzero(count)
            weight, n = count[codes].astype(np.float64), float(count.sum())
        else:
            weight, n = None, float(len(codes))
        total = (lambda x: x.sum()) if weight is None else (lambda x: x @ weight)
        p = self.p[:, codes]
        single = self.log_p[:, codes].sum(1) if weight is None else self.log_p[:, codes] @ weight
        chosen = [int(single.argmax())]
        share, mix, best = np.ones(1), p[chosen[0]], float(single.max())
        price = self.penalty * 0.5 * np.log(n + 1)
        while len(chosen) < len(self.languages):
            offers = []
            for m in range(len(self.languages)):
                # The gain is at most n log(mean ratio), as the logarithm is concave.
                if m not in chosen and (ratio := total(p[m] / mix) / n) > 1 and n * np.log(ratio) > price:
                    offers.append(self._em(p[chosen + [m]], np.append(share * 0.9, 0.1), weight, n, total) + (m,))
            if not offers or (top := max(offers, key=lambda x: x[0]))[0] - best <= price:
                break
            best, share, mix = top[:3]
            chosen = chosen + [top[3]]
        return {self.languages[i]: float(s) for i, s in zip(chosen, share, strict=True)}

    def _em(self, p: np.ndarray, share: np.ndarray, weight, n: float, total):
        mix = share @ p
        for _ in range(self.rounds):
            inverse = 1 / mix if weight is None else weight / mix
            share = share * (p @ inverse) / n
            mix = share @ p
        return float(total(np.log(mix))), share, mix


def train(docs: DataFrame, text: str = "text", lang: str = "lang", *, most_languages: int = 256, **options) -> Model:
    """Counts over all rows with a language; rows with a null language or text are left out.

    Each task sends one row for a language and bucket it has met; the sums have at most languages x 2^15 rows, which
    the driver gathers. More than `most_languages` languages raise an error, so the model's size is bounded.
    """

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for code, body in zip(batch["lang"], batch["text"], strict=True):
                into = seen.setdefault(code, np.zeros(1 << BITS, np.int64))
                for part in trigrams(body):
                    into += np.bincount(part, minlength=1 << BITS)
        for code, into in seen.items():
            at = np.flatnonzero(into)
            yield pd.DataFrame({"lang": code, "bucket": at.astype(np.int32), "n": into[at]})

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()
    sums = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.limit(most_languages * (1 << BITS) + 1).toPandas()
    languages = sorted(found["lang"].unique())
    if len(languages) > most_languages:
        raise ValueError(f"{len(languages)} languages; the bound is {most_languages}")
    counts = np.zeros((len(languages), 1 << BITS))
    counts[found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"]
    return Model(languages, counts, **options)


def identify(model: Model, spark) -> callable:
    """A column function text -> struct(lang_pred, score, languages).

    score is the proportion of the language named; `languages` has all chosen ones as name:proportion. A null text
    or one without letters gives `und` and 0.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, languages string")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            share = sorted(shared.value.proportions(x).items(), key=lambda y: (-y[1], y[0]))
            rows.append((share[0][0], min(share[0][1], 1.0), ",".join(f"{k}:{v:.3f}" for k, v in share)) if share else ("und", 0.0, ""))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "languages"])

    def column(text: Column) -> Column:
        return of(text.cast("string"))

    return column


def language_id(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", *extra: Column) -> DataFrame:
    """doc_id, the extra columns, lang_pred, score, languages; one row for each input row, whatever its id."""
    named = docs.select(F.col(doc_id).alias("doc_id"), *extra, identify(model, docs.sparkSession)(F.col(text)).alias("found"))
    return named.select(*[c for c in named.columns if c != "found"], "found.*")
