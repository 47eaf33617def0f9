"""Pruned nearest points against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import clusters, dense

SCHEMA = "point_id long, vector array<double>, kb_id string, values map<string,string>"


def drawn(spark, n, dim, groups, spread):
    r = np.random.default_rng(8)
    centres = r.normal(size=(groups, dim)) * 3
    v = centres[r.integers(0, groups, n)] + spread * r.normal(size=(n, dim))
    rows = [(k, x.tolist(), f"kb{k % 3}", {"even": str(k % 2 == 0)}) for k, x in enumerate(v)]
    return spark.createDataFrame(rows + [(n, [0.0] * dim, "kb0", None), (n + 1, rows[4][1], "kb1", None), (n + 2, rows[4][1], "kb1", None)], SCHEMA)


@pytest.mark.parametrize("distance", ["cosine", "euclid", "dot"])
def test_equal_to_all_products(spark, tmp_path, distance):
    points = drawn(spark, 1500, 12, 20, 0.3)
    queries = points.where("point_id % 60 = 4").select(F.col("point_id").alias("query_id"), "vector", F.when(F.col("point_id") % 120 == 4, F.array("kb_id")).alias("kb_ids"), F.when(F.col("point_id") % 180 == 4, F.create_map(F.lit("even"), F.lit("True"))).alias("filters"))

    def keep(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    index = clusters.clustered(points, distance, keep, 60)
    hits, counts = clusters.nearest(index, queries, 5)
    want = dense.nearest(points, queries, 5, distance)
    rows = lambda df: sorted((r.query_id, r["rank"], r.point_id, round(r.score, 9)) for r in df.collect())
    assert rows(hits) == rows(want) and len(rows(want)) > 100
    if distance != "dot":
        assert counts["products"] < counts["all"] / 2
    assert clusters.nearest(index, queries.where("false"), 5)[0].count() == 0


def test_few_points(spark):
    points = drawn(spark, 6, 4, 2, 1.0)
    queries = points.where("point_id = 0").select(F.col("point_id").alias("query_id"), "vector")
    index = clusters.clustered(points, "cosine", lambda df, _: df.cache())
    hits, counts = clusters.nearest(index, queries, 50)
    assert hits.count() == points.count() - 1 and counts["products"] == counts["all"]
    none = clusters.clustered(points.where("false"), "cosine", lambda df, _: df.cache())
    assert clusters.nearest(none, queries, 5)[0].count() == 0
