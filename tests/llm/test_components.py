import random

import pytest

from gleanspark.llm import components as module
from gleanspark.llm.components import components


def named(edges):
    root = {i: i for e in edges if None not in e and e[0] != e[1] for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a in root and b in root:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, find(i)) for i in root)


def of_kind(kind):
    rnd = random.Random(4)
    return {
        "path": [(i * 37 % 301, (i + 1) * 37 % 301) for i in range(300)],
        "hub": [(i, 90) for i in range(180)] + [(500, 501)],
        "random": [(rnd.randrange(-200, 200), rnd.randrange(-200, 200)) for _ in range(170)],
        "odd": [(5, 3), (3, 5), (3, 5), (9, 9), (None, 3), (4, None), (None, None), (-(2**63), 2**63 - 1)],
        "none": [],
    }[kind]


@pytest.mark.parametrize("most", [16, 1 << 16])
@pytest.mark.parametrize("kind", ["path", "hub", "random", "odd", "none"])
def test_nodes_are_named_by_their_smallest(spark, monkeypatch, kind, most):
    monkeypatch.setattr(module, "TASK_EDGES", most)
    edges = of_kind(kind)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert sorted(tuple(r) for r in components(frame).collect()) == named(edges)


def test_few_edges_take_no_rounds(spark, monkeypatch):
    tables, real = [], module.stored
    monkeypatch.setattr(module, "stored", lambda *a: tables.append(a[1]) or real(*a))
    path = spark.createDataFrame(of_kind("path"), "a long, b long")
    assert {r.component for r in components(path).collect()} == {0}
    assert len(tables) <= 2
