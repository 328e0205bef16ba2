import random

import pytest

from factloom.llm.neardup import near_dedup


def shingles(text, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[top(i)] = top(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[top(i)] = min(low.get(top(i), doc_id), doc_id)
    return sorted(((d, len(s), low.get(top(i)) if s else d, d == (low.get(top(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed, bases=20, hot=30):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rnd.choices(vocabulary, k=30)
    rows = []

    def near(base, share):
        w = list(base)
        for _ in range(max(1, int(len(w) * share))):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        return w

    for b in range(bases):
        base = rnd.choices(vocabulary, k=rnd.randrange(4, 300)) + (passage if b % 2 else [])
        rows.append(base)
        rows += [near(base, rnd.choice([0.01, 0.02, 0.03, 0.05, 0.1])) for _ in range(hot if b == 0 else rnd.randrange(0, 5))]
        rows += [base] * (b % 3)
    ids = rnd.sample(range(10_000), len(rows))
    out = [(i, rnd.choice([" ", "\n"]).join(w)) for i, w in zip(ids, rows, strict=True)]
    return out + [(20_000, None), (20_001, ""), (20_002, " \t"), (20_003, "One two"), (20_004, "one TWO"), (20_005, "one two three"), (None, out[3][1]), (None, "lonely null id row here now"), out[4], (20_006, "a b c d e"), (20_007, "a b c d e a b c d e")]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"node_limit": 6, "most_levels": 3, "trees": 20}), (3, {"node_limit": 8, "most_levels": 2, "broadcast_rows": 0, "trees": 20})])
def test_equals_brute_force(spark, seed, options):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, sig string")
    assert sorted((tuple(r) for r in near_dedup(df, **options).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signatures_let_links_pass_and_hold_back_most_of_what_is_less_alike():
    import numpy as np

    from factloom.llm.neardup import Alike, _signature, minwise

    rnd = np.random.default_rng(5)
    alike = Alike(75)
    for size in (6, 40, 150, 2000, 30_000):
        passed = {}
        for similarity in (0.6, 0.75, 0.8):
            pairs = []
            for _ in range(60 if size < 10_000 else 8):
                both = -int(-2 * size * similarity // (1 + similarity))  # the least number shared for this similarity
                words = rnd.integers(0, 1 << 63, 2 * size, dtype=np.int64).astype(np.uint64)
                sets = [words[:size], words[size - both : 2 * size - both]]
                pairs.append([np.frombuffer(_signature(s, minwise(s)), np.uint8) for s in map(np.unique, sets)])
            passed[similarity] = alike(*(np.array([p[i] for p in pairs]) for i in (0, 1))).mean()
        assert passed[0.75] == passed[0.8] == 1
        assert size != 150 or passed[0.6] < 0.1


def test_recall_of_twelve_trees_just_above_the_threshold(spark):
    rnd = random.Random(12)
    rows, pairs = [], 0
    for k in range(600):
        base = [f"v{rnd.randrange(10**7)}" for _ in range(rnd.randrange(60, 120))]
        n = len(base) - 4  # shingles; c of them change with the last c words
        c = max(c for c in range(1, n) if 100 * (n - c) >= 75 * (n + c))
        pairs += 1
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[: len(base) - c], *(f"u{rnd.randrange(10**7)}" for _ in range(c))]))]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    found = got.filter("component_id % 2 = 0 AND doc_id % 2 = 1 AND component_id = doc_id - 1").count()
    assert found >= 0.995 * pairs, f"{found} of {pairs} pairs found"
