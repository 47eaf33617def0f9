"""Near-duplicate vectors against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from granary.llm import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, threshold=0.93):
    n = len(rows)
    able = [r[2] is not None and bool(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], float) / np.abs(np.array(r[1], float)).max() if ok else None for r, ok in zip(rows, able)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    links = [[j for j in range(n) if j != i and able[i] and able[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), low, low is not None and rows[i][0] == low))
    return out


def check(spark, rows, schema=SCHEMA, **extra):
    df = spark.createDataFrame(rows, schema).repartition(3).withColumns(extra)
    got = near_vectors.near_vectors(df).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)
    return got


def near(rng, base, cosine):
    """A unit vector at that cosine from a unit vector."""
    other = rng.normal(size=len(base))
    other -= other @ base * base
    return cosine * base + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def test_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for group in range(6):
        base = rng.normal(size=24)
        base /= np.linalg.norm(base)
        for k in range(60):
            v = near(rng, base, [0.97, 0.95, 0.931, 0.93, 0.929, 0.9][k % 6])
            rows.append((len(rows), (v * 10.0 ** (k % 7 - 3)).astype(np.float32).tolist(), group % 3 if k % 5 else None))
    rows += [(1000 + k, rng.normal(size=24).astype(np.float32).tolist(), k % 3) for k in range(200)]
    rows += [(2000 + k, rows[7][1], rows[7][2]) for k in range(50)] + [rows[9], rows[9]]
    got = check(spark, rows, part=F.lit(1), key=F.lit("k"), name=F.lit(2))
    assert max(r.n_links for r in got) > 50


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, -0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], 1), (8, [2.0, -0.0], 1), (9, [1.0, 0.0], 1), (10, [1.0, 0.0], None), (11, [1.0], 1), (12, [1e-30, 0.0], 1), (None, [3e38, 0.0], 1), (None, [0.0, 5.0], 2), (None, None, None), (7, [1.0, 0.0], 1), (13, [-1.0, 0.0], 1)]
    check(spark, rows)
    check(spark, [(i, v and [x if x is None else x * 1e200 for x in v], g) for i, v, g in rows], "vec_id long, embedding array<double>, label int")
    check(spark, [])


def test_bounds_hold_and_decide():
    rng = np.random.default_rng(2)
    base = rng.normal(size=1500)
    base /= np.linalg.norm(base)
    v = near_vectors.unit(np.array([near(rng, base, c) for c in np.linspace(0.85, 1, 60)]))
    q, scale, rest = near_vectors.quantised(v)
    approx = near_vectors.product(q, q) * scale[:, None] * scale[None]
    assert (np.abs(approx - v @ v.T) <= rest[:, None] + rest[None] + rest[:, None] * rest[None] + near_vectors.ROUNDING).all()
    assert (near_vectors.product(q, q) == q.astype(int) @ q.astype(int).T).all()


def test_blocks_meet(spark):
    """Several blocks and tiles of one label: components of 0.93 along a chain that leaves no block whole."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=1024)
    rows = []
    for k in range(1300):  # more components than a block holds
        if k % 10 == 0:
            v = rng.normal(size=1024)
        v = near(rng, v / np.linalg.norm(v), 0.94)
        rows.append((k, v.astype(np.float32).tolist(), 4))
    got = check(spark, rows)
    assert {r.component_id for r in got} == set(range(0, 1300, 10))
