"""Document quality by a linear-chain conditional random field over lines.

Each line is labelled good or bad. Its features are shape statistics of the line and of the lines before and after
it. Training takes a document's label for the label of all its lines. A document's quality is the mean of its lines'
forward-backward marginals, weighted by their lengths, put on the scale of label frequencies by a logistic
curve fitted to the training documents.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OWN = 13
WIDTH = 3 * OWN + 2


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of a code point: 0 other, 1 lower or uncased letter, 2 upper-case letter, 3 digit, 4 white space, 5 punctuation."""
    table = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        table[i] = 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".,;:'\"!?()-" else 0
    return table


def _own_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x OWN) of the lines themselves, and their lengths."""
    n = len(lines)
    points = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _classes()[np.minimum(points, 0xFFFF)]
    lengths = np.fromiter(map(len, lines), np.int64, n)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    count = lambda k: np.add.reduceat((kinds == k).astype(np.int32), starts)
    size = np.maximum(lengths, 1)
    upper, letters = count(2), count(1) + count(2)
    words = np.zeros((n, 4))
    for i, line in enumerate(lines):
        w = line.split()
        if w:
            words[i] = len(w), len(set(w)) / len(w), sum(map(eq, w, w[1:])) / len(w), w[-1][-1] in ".!?"
    own = np.zeros((n, OWN))
    own[:, 0] = 1
    own[:, 1] = np.log1p(lengths) / 5
    own[:, 2] = upper / np.maximum(letters, 1)
    own[:, 3] = count(3) / size
    own[:, 4] = count(0) / size * 4
    own[:, 5] = count(5) / size * 4
    own[:, 6] = letters / np.maximum(words[:, 0], 1) / 10
    own[:, 7] = words[:, 1]
    own[:, 8] = words[:, 2]
    own[:, 9] = words[:, 3]
    own[:, 10] = lengths == 0
    own[:, 11] = words[:, 0] == 1
    own[:, 12] = (own[:, 4] > 0.15) | (own[:, 8] > 0.2) | (own[:, 2] > 0.5)
    return own, lengths


def _with_neighbours(own: np.ndarray, first: bool, last: bool, start: int, end: int) -> np.ndarray:
    """Features of the rows start to end of `own`, with those of the rows before and after."""
    n = end - start
    x = np.zeros((n, WIDTH))
    x[:, :OWN] = own[start:end]
    x[start == 0 :, OWN : 2 * OWN] = own[max(start - 1, 0) : end - 1]
    x[: n - (end == len(own)), 2 * OWN : 3 * OWN] = own[start + 1 : end + 1]
    x[0, -2] += first
    x[-1, -1] += last
    return x


def blocks_of_features(text: str | None, block: int = 20_000, chars: int = 1 << 20):
    """(features, weights) of a text's lines, some thousand at a time, so that memory is bounded; a null or empty text is one empty line."""
    lines = (text or "").split("\n")
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and end - at < block and (end == at or size + len(lines[end]) <= chars):
            size += len(lines[end]) + 1
            end += 1
        low, high = max(at - 1, 0), min(end + 1, len(lines))
        own, lengths = _own_features(lines[low:high])
        yield _with_neighbours(own, at == 0, end == len(lines), at - low, end - low), np.maximum(lengths[at - low : end - low], 1).astype(np.float64)
        at = end


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x WIDTH) and weights of all lines of a text; a null or empty text is one empty line."""
    parts = list(blocks_of_features(text))
    return tuple(np.concatenate([p[i] for p in parts]) for i in (0, 1))


def marginals(score: np.ndarray, moves: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """P(good) of each line, by the forward-backward algorithm. score: log weight of good; moves[a, b]: of b after a.

    Numbers of Python are made for `block` lines at a time.
    """
    (bb, bg), (gb, gg) = np.exp(moves).tolist()
    odds = np.exp(np.clip(score, -30, 30))
    out, p, first = np.empty(len(odds)), 0.5, True
    for at in range(0, len(odds), block):
        ahead = []
        for o in odds[at : at + block].tolist():
            good, bad = (o, 1.0) if first else (o * (p * gg + (1 - p) * bg), p * gb + (1 - p) * bb)
            first = False
            p = good / (good + bad)
            ahead.append(p)
        out[at : at + block] = ahead
    back = 0.5
    for at in range((len(odds) - 1) // block * block, -1, -block):
        ahead, weight = out[at : at + block].tolist(), odds[at : at + block].tolist()
        for t in range(len(ahead) - 1, -1, -1):
            p = ahead[t]
            good, bad = p * back, (1 - p) * (1 - back)
            ahead[t] = good / (good + bad) if good + bad else p
            g, b = weight[t] * back, 1 - back
            good, bad = gg * g + gb * b, bg * g + bb * b
            back = good / (good + bad)
        out[at : at + block] = ahead
    return out


class Crf:
    """Weights of the line features, the moves between labels, and the curve from mean marginal to quality."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.moves, self.slope, self.offset = weights, moves, slope, offset

    def lines(self, text: str | None) -> np.ndarray:
        return marginals(np.concatenate([x @ self.weights for x, _ in blocks_of_features(text)]), self.moves)

    def raw(self, text: str | None) -> float:
        parts = [(x @ self.weights, w) for x, w in blocks_of_features(text)]
        score, w = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        return float(marginals(score, self.moves) @ w / w.sum())

    def curve(self, p: float) -> float:
        p = min(max(p, 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-(self.slope * math.log(p / (1 - p)) + self.offset)))

    def quality(self, text: str | None) -> float:
        return self.curve(self.raw(text))


def _gradient(x, lengths, gold, weight, w, moves):
    """Gradient of the weighted log-likelihood over documents sorted by falling length; x: (time, document, feature)."""
    score = np.clip(x @ w, -30, 30)
    steps, n = score.shape
    alive = [(lengths > t).sum() for t in range(steps)]
    m = np.exp(moves)
    e = np.stack([np.ones_like(score), np.exp(score)], -1)
    ahead, back = np.zeros((steps, n, 2)), np.full((steps, n, 2), 0.5)
    ahead[0] = e[0] / e[0].sum(1, keepdims=True)
    for t in range(1, steps):
        k = alive[t]
        a = (ahead[t - 1, :k] @ m) * e[t, :k]
        ahead[t, :k] = a / a.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        k = alive[t + 1]
        b = (back[t + 1, :k] * e[t + 1, :k]) @ m.T
        back[t, :k] = b / b.sum(1, keepdims=True)
    both = ahead * back
    p = both[..., 1] / np.maximum(both.sum(-1), 1e-300)
    mask = np.arange(steps)[:, None] < lengths[None]
    dw = np.einsum("td,tdf->f", (gold[None] - p) * mask * weight[None], x)
    dm = np.zeros((2, 2))
    if steps > 1:
        pair = ahead[:-1, :, :, None] * m[None, None] * (e[1:] * back[1:])[:, :, None, :]
        pair /= np.maximum(pair.sum((2, 3), keepdims=True), 1e-300)
        inside = mask[1:] * weight[None]
        dm -= np.einsum("tdab,td->ab", pair, inside)
        dm[0, 0] += (inside * (1 - gold)[None]).sum()
        dm[1, 1] += (inside * gold[None]).sum()
    return dw, dm


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], *, rounds: int = 120, rate: float = 0.15, ridge: float = 1e-3, most_move: float = 1.5) -> Crf:
    """Fits to (features, line weights, label) of documents; without samples every quality is 0.5.

    Documents count by the inverse root of their number of lines. Moves stay within `most_move`, so that a
    document's lines can still differ. Documents of like length are handled together.
    """
    w, moves = np.zeros(WIDTH), np.zeros((2, 2))
    if not samples:
        return Crf(w, moves)
    samples = sorted(samples, key=lambda s: -len(s[0]))
    packs, i = [], 0
    while i < len(samples):
        longest, j = len(samples[i][0]), i
        while j < len(samples) and len(samples[j][0]) * 2 >= longest and (j - i + 1) * longest <= 200_000:
            j += 1
        j = max(j, i + 1)
        part = samples[i:j]
        x = np.zeros((longest, len(part), WIDTH))
        for d, (f, _, _) in enumerate(part):
            x[: len(f), d] = f
        lengths = np.array([len(f) for f, _, _ in part])
        packs.append((x, lengths, np.array([float(y) for *_, y in part]), 1 / np.sqrt(lengths)))
        i = j
    total = sum((p[1] * p[3]).sum() for p in packs)
    one, two, m1, m2 = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), np.zeros((2, 2))
    for k in range(1, rounds + 1):
        parts = [_gradient(*p, w, moves) for p in packs]
        dw = sum(a for a, _ in parts) / total - ridge * w
        dm = sum(b for _, b in parts) / total - ridge * moves
        one, two = 0.9 * one + 0.1 * dw, 0.99 * two + 0.01 * dw**2
        m1, m2 = 0.9 * m1 + 0.1 * dm, 0.99 * m2 + 0.01 * dm**2
        w = w + rate * (one / (1 - 0.9**k)) / (np.sqrt(two / (1 - 0.99**k)) + 1e-8)
        moves = np.clip(moves + rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8), -most_move, most_move)
    model = Crf(w, moves)
    raw = np.array([marginals(x @ w, moves) @ u / u.sum() for x, u, _ in samples])
    y, z = np.array([float(s[2]) for s in samples]), np.log(np.clip(raw, 1e-6, 1 - 1e-6) / np.clip(1 - raw, 1e-6, 1))
    a, b = 0.5, 0.0
    for _ in range(400):
        q = 1 / (1 + np.exp(-(a * z + b)))
        a, b = max(a + 0.05 * (((y - q) * z).mean() - 1e-3 * a), 1e-3), b + 0.2 * (y - q).mean()
    return Crf(model.weights, moves, float(a), float(b))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", *, train_docs: int = 3000, train_lines: int = 200, **options) -> Crf:
    """Fits the field to about `train_docs` labelled documents, chosen by a hash of the id.

    The bound is on what the model is fitted to. At most twice as many labels are broadcast, to find their texts
    in the one scan, and of a document of more than `train_lines` lines a stretch of so many, at a place given by the
    text's hash: in all no more than 2 * train_docs * train_lines rows of features (200 MB) reach the driver. Labels
    that are null are left out; of repeated labels of a document the largest counts.
    """
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, train_docs / max(rows.count(), 1))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(2 * train_docs)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def features(batches):
        for batch in batches:
            got = []
            for t, y in zip(batch["text"], batch["label"], strict=True):
                lines = (t or "").split("\n")
                at = zlib.crc32((t or "").encode("utf-8", "surrogatepass")) % max(len(lines) - train_lines + 1, 1)
                x, w = line_features("\n".join(lines[at : at + train_lines]))
                got.append((x.astype(np.float32).tobytes(), w.tobytes(), y))
            yield pd.DataFrame(got, columns=["x", "w", "y"])

    found = texts.mapInPandas(features, "x binary, w binary, y int").collect()
    return fit([(np.frombuffer(r.x, np.float32).reshape(-1, WIDTH).astype(np.float64), np.frombuffer(r.w), r.y) for r in found], **options)


def score(docs: DataFrame, model: Crf, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the quality (0 to 1) of every whole text; null and empty texts count as one empty line."""

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series([model.quality(x) for x in texts], dtype=float)

    return docs.withColumn(out, quality(F.col(text).cast("string")))


def label_lines(docs: DataFrame, model: Crf, text: str = "text", out: str = "good_lines") -> DataFrame:
    """Adds P(good) of every line, in order."""

    @F.pandas_udf("array<double>")
    def lines(texts: pd.Series) -> pd.Series:
        return pd.Series([model.lines(x).tolist() for x in texts])

    return docs.withColumn(out, lines(F.col(text).cast("string")))
