"""Shortest paths by two frontiers against a plain search."""

import random
from collections import defaultdict

import pytest

from quarry.operators import iterate

pytestmark = pytest.mark.usefixtures("few_partitions")


def plain(edges, start, goal, most):
    """Length and edges (hop, src, dst) of all shortest paths."""
    near, back = defaultdict(set), defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        back[b].add(a)

    def levels(of, node):
        d, todo = {node: 0}, [node]
        for x in todo:
            for y in of[x]:
                if y not in d:
                    d[y] = d[x] + 1
                    todo.append(y)
        return d

    f, b = levels(near, start), levels(back, goal)
    if goal not in f or f[goal] > most:
        return None
    return f[goal], {(f[x], x, y) for x, y in edges if x in f and y in b and f[x] + 1 + b[y] == f[goal]}


def test_all_shortest_paths(spark):
    rng = random.Random(2)
    for n, m in ((6, 8), (14, 40), (20, 30)):
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
        frame = spark.createDataFrame(edges, "src long, dst long")
        for start, goal, most in ((0, 1, 5), (2, 2, 0), (3, n - 1, 2)):
            want = plain(edges, start, goal, most)
            got = iterate.shortest_dag(frame, start, goal, most)
            assert (want is None) == (got is None)
            if want:
                assert got[0] == want[0] and {tuple(r) for r in got[1].collect()} == want[1]


def test_least_path_and_limits(spark):
    diamond = spark.createDataFrame([(1, 3), (1, 2), (2, 9), (3, 9), (9, 4), (4, 1)], "src long, dst long")
    assert [tuple(r) for r in iterate.shortest_path(diamond, 1, 4, 5).collect()] == [(3, [1, 2, 9, 4])]
    assert iterate.shortest_path(diamond, 1, 4, 2).collect() == [] and iterate.shortest_path(diamond, 4, 77, 9).collect() == []
    assert [tuple(r) for r in iterate.shortest_path(diamond, 5, 5, 0).collect()] == [(0, [5])]
