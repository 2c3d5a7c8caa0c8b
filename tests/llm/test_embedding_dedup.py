"""Near-duplicate embeddings against all pairs in double precision."""

import math
import random

import numpy as np
import pytest

from roomtrace.llm import embedding_dedup as near

SCHEMA = "vec_id long, embedding array<double>, label int, node long, n string, cell string"


def awkward(seed=2, n=160, dim=12):
    r = np.random.default_rng(seed)
    rows, centre = [], r.normal(size=(12, dim))
    for i in range(n):
        v = r.normal(size=dim) if i % 3 else centre[i % 12] + r.normal(size=dim) * (0.05 + 0.25 * (i % 5))
        rows.append((i, (v * 10.0 ** (i % 7 - 3)).tolist()))
    rows += [(500 + k, rows[3][1]) for k in range(20)] + [(3, rows[3][1]), (600, (np.array(rows[3][1]) * 2.5).tolist())]
    rows += [(None, rows[6][1]), (None, r.normal(size=dim).tolist()), (700, None), (701, []), (702, [0.0] * dim), (703, [1.0] * (dim - 1) + [None])]
    rows += [(704, [1.0] * (dim - 1) + [float("nan")]), (705, [float("inf")] * dim), (706, [1.0] * dim), (707, [1.0] * (dim + 1)), (708, [2.0] * (dim + 1)),
             (709, [1e300] * dim), (710, [1e-300] * dim), (711, [-1.0] * dim), (712, [-0.0] * (dim - 1) + [1.0]), (713, [0.0] * (dim - 1) + [1.0])]
    return rows


def brute(rows, t):
    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        if len(a) != len(b):
            return False
        a, b = (np.array(x) / max(map(abs, x)) for x in (a, b))
        return np.array_equal(a, b) or a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= t

    n = len(rows)
    good = [usable(v) for _, v in rows]
    links = [[j for j in range(n) if j != i and good[i] and good[j] and linked(rows[i][1], rows[j][1])] for i in range(n)]
    key = [math.inf if i is None else i for i, _ in rows]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(key[j] for j in seen)
        out.append((rows[i][0], len(links[i]), None if least == math.inf else least, least == key[i]))
    return out


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("t,tile", [(0.95, 16384), (0.95, 16), (0.8, 50), (0.99, 7)])
def test_near_duplicates_are_brute_force(spark, t, tile):
    rows = awkward()
    frame = spark.createDataFrame([(*x, 1, 2, "n", "c") for x in rows], SCHEMA).repartition(4)
    got = [tuple(x) for x in near.near_duplicates(frame, t, tile=tile).collect()]
    assert order(got) == order(brute(rows, t))


def test_hot_vector_and_cluster(spark):
    r = random.Random(3)
    base = [r.gauss(0, 1) for _ in range(8)]
    rows = [(i, base) for i in range(400)] + [(1000 + i, [x + r.gauss(0, 0.02) for x in base]) for i in range(300)] + [(5000 + i, [r.gauss(0, 1) for _ in range(8)]) for i in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    rows = [(x.vec_id, x.embedding) for x in frame.collect()]
    assert order(tuple(x) for x in near.near_duplicates(frame, tile=64).collect()) == order(brute(rows, 0.95))


def test_empty_and_bounds(spark):
    assert near.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(x) for x in near.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()] == [(1, 0, 1, True)]
    with pytest.raises(ValueError):
        near.near_duplicates(spark.createDataFrame([], SCHEMA), 0.0)


@pytest.mark.parametrize("dim", [3, 64, 1500])
def test_error_bounds_hold_and_few_pairs_are_computed_again(dim):
    r = np.random.default_rng(dim)
    base = r.normal(size=dim)
    v = np.vstack([r.normal(size=(200, dim)), base + r.normal(size=(150, dim)) * np.linspace(0.05, 0.9, 150)[:, None]])
    u = near.unit(v)
    q = near.Quantised(u)
    about = (q.codes.astype(float) * q.scale[:, None]) @ (q.codes.astype(float) * q.scale[:, None]).T
    assert (np.abs(about - u @ u.T) <= q.error[:, None] + q.error + q.error[:, None] * q.error + 1e-9).all()
    for t in (0.5, 0.8, 0.95):
        want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= t)) if i < j}
        got, again = set(), 0
        for i, j, n in near.linked_pairs(v, None, t):
            got |= set(zip(i.tolist(), j.tolist()))
            again += n
        assert got == want
        half = {(i, j + 170) for i, j, in ((a, b) for x, y, _ in near.linked_pairs(v[:170], v[170:], t) for a, b in zip(x.tolist(), y.tolist()))}
        assert half == {(i, j) for i, j in want if i < 170 <= j}
        if dim > 3:
            assert again < 0.1 * len(v) ** 2 / 2


def test_every_linked_pair_meets_in_one_cell():
    r = np.random.default_rng(1)
    v = r.normal(size=(400, 4))
    pivots = near.pivots_of(v.tolist(), 20)[4]
    home, seen = near.visits(v, pivots, 0.9)
    u = near.unit(v)
    for i, j in zip(*np.nonzero(u @ u.T >= 0.9)):
        if i < j:
            cells = [{home[k], *seen[k]} for k in (i, j)]
            meet = [c for c in cells[0] & cells[1] if c in (home[i], home[j]) and (home[i] == c or home[j] == c)]
            assert len(meet) == 1
