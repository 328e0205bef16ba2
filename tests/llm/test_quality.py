import itertools
import random

import numpy as np

from factloom.llm import quality


def test_marginals_equal_enumeration():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 5):
        score, moves = rnd.normal(size=n), rnd.normal(size=(2, 2))
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(s for s, k in zip(score, y, strict=True) if k) + sum(moves[a, b] for a, b in itertools.pairwise(y)))
            total += p
            good += p * np.array(y)
        assert np.allclose(quality.marginals(score, moves), good / total)


def test_gradient_equals_differences():
    rnd = np.random.default_rng(2)
    x, lengths, gold, weight = rnd.normal(size=(4, 3, quality.WIDTH)), np.array([4, 3, 1]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 0.5, 2.0])
    for d, n in enumerate(lengths):
        x[n:, d] = 0
    w, moves = rnd.normal(size=quality.WIDTH) * 0.1, rnd.normal(size=(2, 2))

    def likelihood(w, moves):
        out = 0.0
        for d, n in enumerate(lengths):
            f = lambda y: sum((x[t, d] @ w) * y[t] for t in range(n)) + sum(moves[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
            out += weight[d] * (f([int(gold[d])] * n) - np.log(sum(np.exp(f(y)) for y in itertools.product((0, 1), repeat=int(n)))))
        return out

    dw, dm = quality._gradient(x, lengths, gold, weight, w, moves)
    for i in range(4):
        e = np.eye(quality.WIDTH)[i] * 1e-5
        assert abs((likelihood(w + e, moves) - likelihood(w - e, moves)) / 2e-5 - dw[i]) < 1e-4
    for i, j in itertools.product((0, 1), repeat=2):
        e = np.zeros((2, 2))
        e[i, j] = 1e-5
        assert abs((likelihood(w, moves + e) - likelihood(w, moves - e)) / 2e-5 - dm[i, j]) < 1e-4


def sample(rnd, good):
    line = lambda: " ".join(rnd.choices("alpha beta gamma delta house river quick sun".split(), k=12)).capitalize() + "."
    junk = lambda: "".join(rnd.choices("$%#*&|", k=30)) if rnd.random() < 0.5 else "buy " * 20
    return "\n".join(line() if good or i == 0 else junk() for i in range(rnd.randrange(2, 9)))


def test_held_out_and_defined_results(spark):
    rnd = random.Random(3)
    rows = [(i, sample(rnd, i % 3 > 0), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows] + [(900, None, "z"), (None, "x", "z")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 200] + [(5, None), (6, rows[6][2]), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, rounds=40)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values())
    good, bad = [got[i] for i, _, y in rows[200:] if y], [got[i] for i, _, y in rows[200:] if not y]
    assert min(good) > max(bad)
    lines = quality.label_lines(docs.filter("doc_id = 1"), model).first()
    assert len(lines.good_lines) == len(rows[1][1].split("\n"))
    assert quality.score(docs.limit(0), model).collect() == []
    assert quality.train(docs, labels.limit(0)).quality("anything") == 0.5
