"""Percentiles of large groups by counted ranges against Spark's own."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import evaluate

SHARES = (0.0, 0.05, 0.5, 0.95, 1.0)


def drawn(spark):
    r = random.Random(9)
    rows = [("even", float(k)) for k in range(300)] + [("one", 7.5)] * 200 + [("wide", r.choice([-1, 1]) * 10.0 ** r.randint(-12, 12)) for _ in range(400)]
    rows += [("ties", float(r.choice([1, 1, 1, 2, 1000]))) for _ in range(250)] + [(None, r.gauss(0, 1)) for _ in range(333)] + [("small", 2.0), ("small", 4.0), ("none", None)] + [("even", None)] * 5
    return spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize("large", [100, 10_000])
def test_groups(spark, large):
    df = drawn(spark)
    own = [F.coalesce(F.percentile("v", F.lit(s)), F.lit(0.0)).alias(f"p{round(s * 100)}") for s in SHARES]
    rows = lambda x: sorted(map(str, x.collect()))
    assert rows(evaluate.percentiles(df, "v", SHARES, ["g"], large)) == rows(df.groupBy("g").agg(*own))


def test_all_rows(spark):
    df = drawn(spark)
    own = df.agg(*[F.percentile("v", F.lit(s)).alias(f"p{round(s * 100)}") for s in SHARES]).first()
    assert evaluate.percentiles(df, "v", SHARES, large=50).first() == own
    assert evaluate.percentiles(df.where("false"), "v", (0.5,)).first()[0] == 0.0
