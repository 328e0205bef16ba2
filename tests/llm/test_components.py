import random

import pytest

from factloom.llm.common import Scratch
from factloom.llm.components import connected


@pytest.mark.parametrize("options", [{}, {"local_edges": 30, "broadcast_rows": 0}])
def test_labels_are_the_smallest_nodes(spark, options):
    rnd = random.Random(2)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (900, 900)]
    edges += [(2000, 2000 + i) for i in range(1, 30)] + edges[:10]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), **options).collect()
    assert sorted(map(tuple, got)) == sorted((x, top(x)) for x in list(up))


def test_no_edges(spark):
    assert connected(spark.createDataFrame([], "a long, b long"), Scratch(spark)).collect() == []
