import random

from tallyspring.llm.components import components


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(7, 7), (900, 899), (899, 900)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert len(found) == len(nodes) and {r["node"]: r["component"] for r in found} == {x: find(x) for x in nodes}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
