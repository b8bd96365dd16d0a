"""What components of linked requests move, and how many rows meet in one pass."""

import pytest

from gleanspark.plans import ordered


def parts(found):
    groups = {}
    for node, component in found:
        groups.setdefault(component, set()).add(node)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize(
    ("edges", "want"),
    [
        ([(5, 3), (3, 9), (9, 9), (4, 8), (8, 4), (7, 7)], [[3, 5, 9], [4, 8]]),
        ([(i, -1) for i in range(50)] + [(100, 101)], [[-1, *range(50)], [100, 101]]),
        ([(7, 7)], []),
        ([], []),
    ],
)
def test_nodes_of_one_component_have_one_name(spark, edges, want):
    found = ordered.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert parts((r.node, r.component) for r in found) == want
    assert len({r.node for r in found}) == len(found)


def test_a_long_path_moves_little_more_than_itself(spark, monkeypatch):
    moved, real = [], ordered.written

    def counted(frame):
        kept = real(frame)
        moved.append(kept.count())
        return kept

    monkeypatch.setattr(ordered, "written", counted)
    path = spark.range(1024).selectExpr("id * 37 % 1025 AS a", "(id + 1) * 37 % 1025 AS b")
    assert len({r.component for r in ordered.connected(path).collect()}) == 1
    assert sum(moved) < 10 * 1024


def test_bundles_stay_below_the_limit(spark, limits):
    limits(ordered_maxRows=64)
    rows = ordered.written(spark.range(600).selectExpr("id AS seq", "id div 3 AS k", "cast(null AS long) AS n"))

    def decide(part):
        return part.assign(n=len(part))

    links = "filter(array(xxhash64(k), if(seq % 2 = 0, xxhash64(k), null)), x -> x IS NOT NULL)"
    decided, open_ = ordered.by_components(rows, ordered.F.expr(links), decide, rows.schema)
    got = decided.collect()
    assert sorted(r.seq for r in got) == list(range(600)) and open_.count() == 0
    assert max(r.n for r in got) <= 32
