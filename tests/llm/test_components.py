"""Components against union-find, and where tables are written."""

import random

import pytest

from unitlens.llm.components import connected_components
from unitlens.llm.storage import saved, shared_path


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1, 1), (None, 2), (2, None)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]  # a long path
    edges += [(5000, 5001 + i) for i in range(80)] * 2  # a hub, twice
    rng.shuffle(edges)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == brute(edges) and got.count() == len(brute(edges))


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_tables_go_to_the_shared_folder(spark):
    assert shared_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert saved(spark.range(3), "three").count() == 3
