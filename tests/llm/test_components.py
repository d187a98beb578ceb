import random

from tracelake.llm.components import components


def test_random_graphs_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(-60, 300), rng.randrange(-60, 300)) for _ in range(150)]
    edges += [(1000 + i, 1001 + i) for i in range(30)] + [(2000, 2000 + i) for i in range(40)] + [(5, 5), (5, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root}
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()]
    assert sorted(got) == sorted(want.items())


def test_no_edges(spark):
    assert components(spark.createDataFrame([(1, 1)], "u bigint, v bigint")).collect() == []
