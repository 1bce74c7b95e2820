import numpy as np
import pytest

from qcloom.llm import vectors as X

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    def unit(v, label):
        if label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, np.float32).astype(np.float64)
        return a / np.linalg.norm(a)

    u = [unit(v, k) for _, v, k in rows]
    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            if u[i] is not None and u[j] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine:
                links[i].append(j)
                links[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(links[i]), root, rows[i][0] == root))
    return sorted(out)


def data(n=250, dim=24, seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 8, dim))
    rows = []
    for i in range(n):
        v = base[r.integers(len(base))] + r.normal(size=dim) * r.choice([0, 0.1, 0.25, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v * r.choice([1, 3])], int(r.integers(3))))
    bad = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [1.0, 2.0], [1.0, 2.0]]
    rows += [(n + k, v, 0) for k, v in enumerate(bad)] + [(n + 20 + k, rows[0][1], None if k == 0 else rows[0][2]) for k in range(4)]
    return rows


@pytest.mark.parametrize("dim,blocks,cell_rows,seed", [(24, 8, 200_000, 0), (24, 8, 5, 1), (5, 3, 5, 2), (1, 8, 200_000, 3), (64, 8, 0, 4)])
def test_against_brute_force(spark, dim, blocks, cell_rows, seed):
    rows = data(dim=dim, seed=seed)
    got = X.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), blocks=blocks, cell_rows=cell_rows)
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("task_rows,cell_rows", [(20, 200_000), (7, 5)])
def test_dense_cells_are_many_tasks(spark, task_rows, cell_rows):
    rows = data(n=300, dim=16, seed=7)
    got = X.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), task_rows=task_rows, cell_rows=cell_rows)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_cosines_in_doubt_are_exact(spark, monkeypatch):
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 8))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] + 0.3 * r.normal(size=8)], 0) for i in range(150)]
    monkeypatch.setattr(X, "DOUBT", 0.02)  # many pairs are looked at again
    assert sorted(map(tuple, X.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
    a, b = [1.0] + [0.0] * 7, [0.93, float(np.float32((1 - 0.93**2) ** 0.5))] + [0.0] * 6
    edge = [(k, [float(np.float32(x)) for x in b[:1]] + [float(np.float32(b[1] + e))] + b[2:], 0) for k, e in enumerate((-2e-7, -1e-7, 0, 1e-7, 2e-7), 1)]
    got = X.near_duplicates(spark.createDataFrame([(0, a, 0), *edge], SCHEMA))
    assert sorted(map(tuple, got.collect())) == brute([(0, a, 0), *edge])


def test_long_vectors_and_null_ids(spark):
    r = np.random.default_rng(1)
    long = [[float(x) for x in r.normal(size=3000)] for _ in range(3)]
    rows = [(0, long[0], 1), (1, [x * 2 for x in long[0]], 1), (2, long[1], 1), (None, long[0], 1)]
    got = {x.vec_id: tuple(x)[1:] for x in X.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[0] == (1, 0, True) and got[1] == (1, 0, False) and got[2] == (0, 2, True) and got[None] == (0, None, None)


def test_edges(spark):
    assert X.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], SCHEMA).selectExpr("*", "1 as rep", "2 as v", "3 as digest")
    assert sorted(map(tuple, X.near_duplicates(only).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    twice = spark.createDataFrame([(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (1, [2.0, 0.0], 1)], SCHEMA)
    assert sorted(map(tuple, X.near_duplicates(twice).collect())) == [(1, 2, 1, True), (3, 2, 1, False), (3, 2, 1, False)]


def by_rows(rows):
    """Links and components of rows, not of ids."""
    x = [np.array(v, np.float64) for _, v, _ in rows]
    near = [[j for j in range(len(rows)) if j != i and rows[i][2] == rows[j][2] and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.93] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        root = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(near[i]), root, rows[i][0] == root))
    return sorted(out)


def test_repeated_ids_are_other_vectors(spark):
    one = [(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, [1.0, 0.05], 0), (1, [1.0, 0.0], 1), (9, [0.0, 1.0], 1)]
    two = [(1, [1.0, 0.0], 0), (1, [1.0, 0.1], 0)]
    r = np.random.default_rng(8)
    base = r.normal(size=(9, 6))
    many = [(int(r.integers(1, 30)), [float(np.float32(y)) for y in base[k % 9] + 0.15 * r.normal(size=6)], int(r.integers(0, 3))) for k in range(120)]
    for rows in (one, two, many, many + many[:20]):
        got = X.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert sorted(map(tuple, got.collect())) == by_rows(rows)
