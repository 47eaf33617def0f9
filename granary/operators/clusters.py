"""Exact nearest points over a clustered table: clusters that can't hold an answer aren't read.

Points lie by the nearest of a few centres, sorted by cluster and by distance from its centre, so a scan of some clusters skips
the files and row groups of others. By the triangle inequality a point of a cluster of radius r is no nearer to a query than
|q - c| - r. A query first meets the clusters of the best bounds, then those whose bound still reaches its k-th best score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from granary.operators import dense
from granary.operators.packing import MOST, ranked

#: Centres at most; they, and a bound for each query of a block and each of them, are in the driver's memory.
CENTRES = 4096
#: Points that the first clusters of a query should hold for each one that it asks for.
AHEAD = 8


@dataclass(frozen=True)
class Clustered:
    """points: with cluster and distance, stored by them; for each cluster its centre, radius and number of points."""

    points: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    kind: str


def clustered(points: DataFrame, distance: str, keep: Callable[[DataFrame, str], DataFrame], centres: int | None = None) -> Clustered:
    """The clusters of points (point_id, vector, ...); keep stores the table. centres: as many, or the square root of the points'
    number, at most CENTRES. Zero vectors lie at no angle: where cosines are asked for, they are left out, as they have none."""
    n = points.count()
    k = max(1, min(centres or round(n**0.5), CENTRES))
    lengths = np.linalg.norm
    usable = points.where(F.exists("vector", lambda x: x != 0)) if distance == "cosine" else points
    chosen = usable.orderBy(F.xxhash64(F.lit("centre"), "point_id"), "point_id").select("vector").limit(k).collect()
    own = np.array([r.vector for r in chosen], np.float64).reshape(len(chosen), -1 if chosen else 0)
    own = own / lengths(own, axis=1, keepdims=True) if distance == "cosine" else own
    names = usable.columns
    step = max(1, dense.PRODUCTS // max(1, len(own)))  # points that meet the centres at once

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(names.index("vector")).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
            v = v / lengths(v, axis=1, keepdims=True) if distance == "cosine" else v
            near, far = np.empty(len(v), np.int32), np.empty(len(v))
            for at in range(0, len(v), step):
                some = dense.products(v[at : at + step], own, "euclid")
                near[at : at + step], far[at : at + step] = some.argmin(1), some.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(far)], [*names, "cluster", "distance"])

    schema = StructType([*usable.schema.fields, StructField("cluster", IntegerType()), StructField("distance", DoubleType())])
    placed = usable.mapInArrow(run, schema)
    stored = keep(placed.repartitionByRange("cluster", "distance").sortWithinPartitions("cluster", "distance"), "clusters")
    radii, sizes = np.zeros(len(own)), np.zeros(len(own), np.int64)
    for r in stored.groupBy("cluster").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect():
        radii[r.cluster], sizes[r.cluster] = r.radius, r.n
    return Clustered(stored, own, radii * (1 + 1e-9) + 1e-7, sizes, distance)


def bounds(index: Clustered, queries: np.ndarray) -> np.ndarray:
    """For each query and cluster a score that no point of the cluster exceeds (euclid: a distance, negated)."""
    if not len(index.centres):
        return np.zeros((len(queries), 0))
    q = queries / np.linalg.norm(queries, axis=1, keepdims=True) if index.kind == "cosine" else queries
    if index.kind == "dot":  # q p = q c + q (p - c)
        return q @ index.centres.T + np.linalg.norm(q, axis=1)[:, None] * index.radii[None] + 1e-9
    near = np.maximum(dense.products(q, index.centres, "euclid") - 1e-7 - index.radii[None], 0)
    return (1 - near**2 / 2 if index.kind == "cosine" else -near) + 1e-9


def nearest(index: Clustered, queries: DataFrame, k: int = MOST) -> tuple[DataFrame, dict[str, int]]:
    """((query_id, point_id, score, rank), counts): the k best points of each query as dense.nearest gives them, and how many
    products of a query and a point were taken, of how many. Queries come to the driver a block at a time; a block is two scans,
    each of the clusters that its queries want."""
    scope = [c for c in ("kb_ids", "filters") if c in queries.columns]
    rows = queries.select("query_id", "vector", *scope).toLocalIterator()
    found: list[DataFrame] = []
    counts = {"products": 0, "all": 0}
    while block := list(islice(rows, dense.QUERIES)):
        asked = np.array([r.vector for r in block], np.float64)
        most = bounds(index, asked)
        order = np.argsort(-most, axis=1, kind="stable")
        before = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
        first = np.zeros(most.shape, bool)
        np.put_along_axis(first, order, before < AHEAD * k, axis=1)
        hits = _visited(index, queries, block, k, first)
        best = ranked(hits, "query_id", ascending=index.kind == "euclid", tie="point_id").where(F.col("rank") == k).select("query_id", "score").collect()
        reached = {r.query_id: (-r.score if index.kind == "euclid" else r.score) for r in best}
        rest = ~first & (most >= np.array([reached.get(r.query_id, -np.inf) for r in block])[:, None])
        found += [hits, _visited(index, queries, block, k, rest)]
        counts["products"] += int(((first | rest) * index.sizes[None]).sum())
        counts["all"] += len(block) * int(index.sizes.sum())
    if not found:
        found = [_visited(index, queries, [], k, np.zeros((0, len(index.sizes)), bool))]
    every = reduce(DataFrame.unionByName, found)
    return ranked(every, "query_id", ascending=index.kind == "euclid", tie="point_id").where(F.col("rank") <= k), counts


def _visited(index: Clustered, queries: DataFrame, block: list, k: int, visits: np.ndarray) -> DataFrame:
    """The best of the clusters that the queries of a block visit; no other cluster is read."""
    wanted = [int(c) for c in np.flatnonzero(visits.any(0))]
    points = index.points.where(F.col("cluster").isin(wanted)) if wanted else index.points.where("false")
    return dense._block(points, queries, block, "point_id", k, index.kind, False, visits)
