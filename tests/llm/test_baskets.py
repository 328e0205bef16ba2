import hashlib
import random
from itertools import combinations

import pytest

from factloom.llm import baskets
from factloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "sale_id long, item_id long, flag string, support string"


def plain(pairs, least=5, share=20_000, confidence=60):
    """Closed itemsets with their rules, by intersecting baskets: an itemset is closed if it is the intersection of the baskets that hold it."""
    held = {}
    for b, i in pairs:
        if b is not None and i is not None:
            held.setdefault(b, set()).add(i)
    all_baskets = [frozenset(x) for x in held.values()]
    n = len(all_baskets)
    least = max(least, -(-n // share))
    by_item = {}
    for k, b in enumerate(all_baskets):
        for i in b:
            by_item.setdefault(i, set()).add(k)

    def places(items):
        return set.intersection(*(by_item[i] for i in items))

    found, open_sets = {}, [frozenset([i]) for i in by_item]
    while open_sets:
        s = open_sets.pop()
        at = places(s)
        if len(at) < least:
            continue
        closure = frozenset.intersection(*(all_baskets[k] for k in at))
        if closure not in found:
            found[closure] = len(at)
            near = set().union(*(all_baskets[k] for k in at))
            open_sets += [closure | {i} for i in near - closure]
    out = {}
    for s, support in found.items():
        rules = []
        for c in sorted(s) if len(s) > 1 else []:
            a = len(places(s - {c}))
            if 100 * support >= confidence * a and support * n > a * len(by_item[c]):
                rules.append((c, a, len(by_item[c])))
        text = ";".join(f"{c}:{a}:{x}" for c, a, x in rules)
        best = min(rules, key=lambda r: (r[1], r[0]))[0] if rules else None
        out[",".join(map(str, sorted(s)))] = (len(s), support, len(rules), best, hashlib.sha256(text.encode()).hexdigest())
    return out


def digested(df):
    return {r.items: (r.n_items, r.support, r.n_rules, r.best_item, r.rules_sha256) for r in baskets.digest(df).collect()}


def rows_of(rnd, n_baskets, n_items, bundles):
    rows = []
    for b in range(n_baskets):
        own = {int(n_items * rnd.random() ** 3) for _ in range(rnd.randrange(1, 6))}
        if rnd.random() < 0.5:
            own |= set(rnd.choice(bundles))
        rows += [(b, i) for i in own]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_search_with_bundles_wide_baskets_and_small_blocks(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    monkeypatch.setattr(baskets, "WIDE", 12)
    monkeypatch.setattr(baskets, "BATCH", 7)
    bundles = [rnd.sample(range(40), rnd.randrange(2, 7)) for _ in range(6)]
    rows = rows_of(rnd, 150, 40, bundles)
    # One basket holds a large part of all rows; in the second run more wide baskets than the least support do.
    rows += [(1000 + k, i) for k in range([1, 8, 3][seed]) for i in range(-2, 38)]
    given = [(b, i, "kept", "x") for b, i in rows] + [(None, 3, "a", ""), (5, None, "b", None), *[(1, 1, "again", "")] * 30]
    df = spark.createDataFrame(given, SCHEMA)
    got = digested(baskets.itemsets_with_rules(df, block_entries=60))
    assert got == plain([x[:2] for x in given]) and any(v[2] for v in got.values())


def test_all_pairs_are_counted_whole_by_each_way(spark, monkeypatch):
    rnd = random.Random(9)
    given = [(b, i, "", "") for b in range(40) for i in rnd.sample(range(25), 10)]
    df = spark.createDataFrame(given, SCHEMA)
    want = plain([x[:2] for x in given])
    for wide in (3, 9, 10, 100):
        monkeypatch.setattr(baskets, "WIDE", wide)
        assert digested(baskets.itemsets_with_rules(df, block_entries=100)) == want


def test_an_item_in_every_basket_and_deep_chains(spark):
    chain = [(b, i) for b in range(30) for i in range(b // 5 + 1)]  # each itemset 0..k is closed
    got = digested(baskets.itemsets_with_rules(spark.createDataFrame([(*x, "", "") for x in chain], SCHEMA)))
    assert got == plain(chain) and set(got) == {",".join(map(str, range(k + 1))) for k in range(6)}
    last = [(b, i) for b in range(12) for i in (99, b % 2, 10 + b % 3)]
    assert digested(baskets.itemsets_with_rules(spark.createDataFrame([(*x, "", "") for x in last], SCHEMA), least=2)) == plain(last, least=2)


def test_defined_results_without_rows_or_frequent_items(spark):
    assert baskets.itemsets_with_rules(spark.createDataFrame([], SCHEMA)).collect() == []
    assert baskets.itemsets_with_rules(spark.createDataFrame([(None, None, None, None), (1, None, "", "")], SCHEMA)).collect() == []
    assert baskets.itemsets_with_rules(spark.createDataFrame([(b, b, "", "") for b in range(9)], SCHEMA)).collect() == []


def test_share_raises_the_least_support(spark):
    given = [(b, i, "", "") for b in range(100) for i in (b % 9, 20 + b % 2)]
    df = spark.createDataFrame(given, SCHEMA)
    assert digested(baskets.itemsets_with_rules(df, least=1, share=8)) == plain([x[:2] for x in given], least=1, share=8)


def test_query_over_the_whole_table(spark):
    got = {r["items"]: (r.n_items, r.support, r.n_rules, r.best_item, r.rules_sha256) for r in QUERIES["op11_basket_itemsets"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/sale_lines.parquet").select("sale_id", "item_id").collect()
    assert got == plain([tuple(r) for r in rows]) and len(got) > 20


def test_plain_search_itself():
    rows = [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 3)]
    want = {}
    for k in (1, 2, 3):
        for s in combinations((1, 2, 3), k):
            want[s] = sum(all((b, i) in rows for i in s) for b in range(3))
    closed = {s for s, n in want.items() if n >= 1 and all(want[t] < n for t in want if set(t) > set(s))}
    assert {tuple(map(int, k.split(","))) for k in plain(rows, least=1)} == closed


def test_products_in_parts_of_any_size_equal_plain_counts():
    import numpy as np
    import pandas as pd

    rnd = random.Random(6)
    own = [sorted(rnd.sample(range(20), rnd.randrange(2, 9))) for _ in range(80)]
    block = baskets._pack_block(pd.DataFrame({"block": 0, "basket": [k for k, b in enumerate(own) for _ in b], "item": [i for b in own for i in b]}), 100)
    sets = [(s, sorted(rnd.sample(range(22), rnd.randrange(1, 4))), rnd.sample(range(22), rnd.randrange(0, 5)) or None) for s in range(60)]
    batch = baskets._pack_sets(pd.DataFrame(sets, columns=["sid", "items", "cols"]).assign(batch=0))
    want = set()
    for s, items, cols in sets:
        want |= {(s, True, 0, sum(set(items) <= set(b) for b in own))} | {(s, False, c, sum({*items, c} <= set(b) for b in own)) for c in cols or []}
    want = {x for x in want if x[3]}
    for entries in (1, 7, 100, 10**6):
        got = baskets.product(batch, block, entries)
        assert {tuple(map(int, r)) for r in got.to_numpy()} == {tuple(map(int, r)) for r in want} and len(got) == len(want)
    parts = [np.concatenate(x) for x in zip(*baskets._pairs_in(np.frombuffer(block["starts"][0], np.int64), np.frombuffer(block["items"][0], np.int64), 4, True), strict=True)]
    assert sorted(zip(*(p.tolist() for p in parts), strict=True)) == sorted(x for b in own for x in combinations(b, 2))
