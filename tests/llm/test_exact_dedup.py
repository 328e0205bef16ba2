import hashlib
import re
from collections import defaultdict

import pytest

from factloom.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, rid string, name int, level int, keys string"


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, i, doc_id))
    out = []
    for bare, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m[3] == best[3], hashlib.sha256(bare.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


ROWS = [
    (1, "a b c"), (2, "abc"), (3, None), (4, ""), (5, " \n\t"), (6, "x" * 5000), (7, "x" * 4999 + " x"), (8, "x" * 4999),
    (9, "é😀 z" * 700), (10, "é😀z" * 700), (11, "aab"), (12, "aba"), (13, "abc"), (13, "abc"), (None, "abc"), (14, "a bc"),
    (15, "line sep\u0085"), (16, "line sep\u0085 "), (17, "ab" * 3), (18, "ab" * 3 + "a"),
]


@pytest.mark.parametrize("options", [{}, {"block_chars": 2}, {"block_chars": 3, "key_bits": 7}])
def test_equals_brute_force(spark, options):
    df = spark.createDataFrame([(*r, "x", 1, 2, "k") for r in ROWS], SCHEMA)
    got = sorted((tuple(r) for r in exact_dedup(df, **options).collect()), key=repr)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in brute(ROWS)]
    assert sum(r[3] for r in got) == sum(r[3] for r in brute(ROWS))


def test_keys_that_always_clash_are_reported(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    with pytest.raises(ValueError):
        exact_dedup(df, key_bits=0)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
