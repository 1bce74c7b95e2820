import random

import pytest

from qcloom.llm import common as C


@pytest.mark.parametrize("at_once", [0, 10**6])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(C, "EDGES_IN_ONE_TASK", at_once)
    r = random.Random(0)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)] + [(400, k) for k in range(401, 430)] + [(7, 7), (None, 3)]
    seen = {}
    for a, b in edges:
        if a is not None and a != b:
            seen.setdefault(a, set()).add(b)
            seen.setdefault(b, set()).add(a)
    want = {}
    for x in seen:
        group, todo = {x}, [x]
        while todo:
            for y in seen[todo.pop()] - group:
                group.add(y)
                todo.append(y)
        want[x] = min(group)
    got = C.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch_reads_the_session(spark):
    C.scratch(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    C.scratch(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().get() == folder
    d = C.written(spark.range(5))
    assert d.count() == 5 and d.inputFiles()[0].startswith("file:") and C.fresh(d, "ID", "x", "x") == ["ID_", "x", "x_"]
