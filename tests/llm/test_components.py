import random

import pytest

from driftlog.llm.components import connected_components


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_against_brute_force(spark, kind):
    r = random.Random(kind)
    n = 60
    edges = {"path": [(i, i + 1) for i in range(0, 40)], "star": [(7, i) for i in range(20, 50)], "random": [(r.randrange(n), r.randrange(n)) for _ in range(40)]}[kind]
    r.shuffle(edges)
    label = list(range(n))
    for a, b in edges:
        if label[a] != label[b]:
            lo, hi = sorted((label[a], label[b]))
            label = [lo if x == hi else x for x in label]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (None, 3), (5, None)], "src long, dst long")
    got = [(x.node, x.root) for x in connected_components(df).collect()]
    assert sorted(got) == sorted((x, label[x]) for x in nodes)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
