"""Hard negatives against all rows."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from granary.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, cut=None):
    able = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    dim = max((len(r[1]) for r in able), default=0)
    whole = lambda x: max(-cut, min(cut, math.floor(256 * x))) if cut else math.floor(256 * x)
    own = [(r[0], r[2], [whole(float(x)) for x in r[1]] + [0] * (dim - len(r[1]))) for r in able]
    out = []
    for i, (a, label, v) in enumerate(own):
        if a is None or a % 50:
            continue
        all_ = [(-sum(x * y for x, y in zip(v, w)), b is None, b, g) for j, (b, g, w) in enumerate(own) if j != i]
        for score, _, b, _ in sorted((s for s in all_ if s[3] == label), key=lambda s: (s[0], s[1], s[2] or 0))[:5]:
            fit = sorted((s for s in all_ if s[3] != label and 50 * -score <= 100 * -s[0] <= 95 * -score), key=lambda s: (s[0], s[1], s[2] or 0))
            out += [(a, b, k + 1, s[2], -score, -s[0]) for k, s in enumerate(fit[:3])]
    return out


def check(spark, rows, schema=SCHEMA, cut=None, **options):
    df = spark.createDataFrame(rows, schema).repartition(3).withColumns({"q": F.lit(1), "pivot": F.lit("p"), "length": F.lit(0)})
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **options).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows, cut), key=key)
    return got


def clustered(rng, n, dim=8, groups=12):
    centres = rng.normal(size=(groups, dim))
    v = centres[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)


def test_all_rows(spark):
    rng = np.random.default_rng(5)
    v = clustered(rng, 900)
    rows = [(k, x.tolist(), int(rng.integers(0, 4)) if k % 31 else None) for k, x in enumerate(v)]
    rows += [(1000 + k, rows[3][1], 3 if k % 2 else 1) for k in range(200)]  # copies: one key, ties by vec_id
    assert len(check(spark, rows, pivots=6, rings=4)) > 100
    check(spark, rows[:60], pivots=1, rings=1)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5], 1), (50, [0.5, -0.5], 1), (50, [0.5, -0.5], 1), (100, [0.0, 0.0], 2), (150, [0.1], 2), (None, [0.5, 0.4], 1), (None, [0.4, 0.4], 2), (7, [0.4, 0.3], 2), (8, [0.4, 0.3], 2), (9, None, 1), (10, [], 1), (11, [nan, 1.0], 1), (12, [inf, 0.0], 2), (13, [None, 1.0], 2), (14, [0.3, 0.3], None), (15, [0.3, 0.3], 3), (200, [-0.5, -0.5], 5), (250, [0.45, 0.45], 3)]
    rows = rows + [(k, [0.01 * k, 0.2], k % 3) for k in range(20, 40)]
    check(spark, rows)
    check(spark, rows, pivots=3, rings=3)
    check(spark, [])
    check(spark, [(0, [1.0], 1)])
    check(spark, rows[9:15])


def test_large_numbers(spark):
    """Scores beyond what doubles hold exactly, and components that are cut."""
    rng = np.random.default_rng(6)
    rows = [(k, (rng.integers(1, 1 << 22, 4) + 0.5).astype(float).tolist(), k % 3) for k in range(150)] + [(200, [1e300, -1e300, 1.0, 5.0], 1)]
    assert check(spark, rows, "vec_id long, embedding array<double>, label int", cut=int((1 << 31) / 2) - 1, pivots=4, rings=3)


def test_far_cells_are_left_out(spark):
    """On clustered vectors the requests of the last step don't reach all cells."""
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(k, x.tolist(), str(k % 2)) for k, x in enumerate(clustered(rng, 2000))], "vec_id long, embedding array<float>, label string")
    every, dim, length = negatives.whole_numbers(rows, 256)
    index = negatives.indexed(every, dim, length, 12, 4)
    wide = [F.array(F.lit(v).cast("long")).alias(c) for v, c in ((negatives.LEAST, "lows"), (negatives.MOST, "highs"))]
    searches = every.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "label", negatives.label_group(F.col("label")).alias("grp"), "vector", *wide)
    asked = lambda bests: negatives._requests(searches.withColumn("bests", F.array(F.lit(bests).cast("long"))), index, True, (0.0, 1.0)).agg(F.sum(F.size("anchors"))).first()[0]
    assert asked(60_000) < asked(negatives.LEAST) / 2


def test_requests_are_not_broadcast(spark, monkeypatch):
    """Requests are anchors times cells: no step may bring them, or the blocks, to the driver. They are sent in pieces."""
    plans, scanned = [], negatives._scanned

    def noted(met, *rest):
        plans.append(met._jdf.queryExecution().executedPlan().toString())
        return scanned(met, *rest)

    monkeypatch.setattr(negatives, "_scanned", noted)
    monkeypatch.setattr(negatives, "REQUESTED", 2_000, raising=False)
    rng = np.random.default_rng(8)
    rows = [(k, x.tolist(), k % 3) for k, x in enumerate(clustered(rng, 700))]
    assert check(spark, rows, pivots=5, rings=3)
    joins = [re.search(r"\w+Join\b", p).group() for p in plans]  # the last join of each step
    assert joins and set(joins) == {"SortMergeJoin"}
