"""Connected components against brute force."""

import random

import pytest

from tidemark.llm.common import connected_components

RANDOM = random.Random(3)
CASES = {
    "empty": [],
    "loops and nulls": [(5, 5), (None, 3)],
    "repeated and reversed": [(1, 2), (2, 1), (1, 2)],
    "path": [(i, i + 1) for i in range(40)],
    "two hubs": [(0, i) for i in range(1, 50)] + [(7, 99), (99, -4)],
    "random": [(RANDOM.randrange(200), RANDOM.randrange(200)) for _ in range(150)],
}


def brute_force(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("case", CASES)
def test_components(spark, case):
    rows = connected_components(spark.createDataFrame(CASES[case], "a bigint, b bigint")).collect()
    assert len(rows) == len({r["id"] for r in rows})
    assert {r["id"]: r["component"] for r in rows} == brute_force(CASES[case])
