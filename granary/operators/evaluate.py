"""Retrieval quality against labelled cases, and comparison of two runs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from granary.operators.lexical import bounded, matches

METRICS = ["recall_at_k", "hit_at_k", "mrr_at_k", "ndcg_at_k", "precision_at_k", "empty_on_unanswerable", "empty_on_answerable", "kb_leakage"]


def gains(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Hits (case_id, rank, doc_id, text) that show their label's evidence, the first of each document only.

    labels: case_id, doc_id, contains. A document earns at its first hit whose excerpt has the evidence, not at its first hit.
    """
    shown = hits.join(labels, ["case_id", "doc_id"]).where(F.contains("text", "contains"))
    first = Window.partitionBy("case_id", "doc_id").orderBy("rank")
    return shown.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("case_id", "doc_id", "rank")


def evaluated(cases: DataFrame, labels: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """METRICS of each case (case_id, category, kb_ids).

    hits: case_id, rank, doc_id, kb_id, text. Metrics of answerable cases are null where nothing is expected, and the other
    way round. Precision is over k. Leakage counts all hits outside the case's knowledge bases.
    """
    expected = labels.groupBy("case_id").agg(F.countDistinct("doc_id").alias("expected"))
    earned = gains(hits.where(F.col("rank") <= k), labels).groupBy("case_id").agg(
        F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    scope = cases.select("case_id", "kb_ids")
    shown = hits.join(scope, "case_id").groupBy("case_id").agg(
        F.count("*").alias("hits"), F.sum(F.when((F.size("kb_ids") > 0) & ~F.array_contains("kb_ids", F.col("kb_id")), 1).otherwise(0)).alias("leaked")
    )
    rows = cases.join(expected, "case_id", "left").join(earned, "case_id", "left").join(shown, "case_id", "left")
    n, found = F.coalesce("expected", F.lit(0)), F.coalesce("found", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    answerable = lambda value: F.when(n > 0, value)
    empty = (F.coalesce("hits", F.lit(0)) == 0).cast("double")
    return rows.select(
        "case_id", "category",
        answerable(found / n).alias("recall_at_k"), answerable((found > 0).cast("double")).alias("hit_at_k"),
        answerable(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr_at_k"), answerable(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_at_k"),
        answerable(found / F.lit(float(k))).alias("precision_at_k"), F.when(n == 0, empty).alias("empty_on_unanswerable"),
        answerable(empty).alias("empty_on_answerable"), F.coalesce("leaked", F.lit(0)).cast("long").alias("kb_leakage"),
    )


def label_faults(cases: DataFrame, labels: DataFrame, documents: DataFrame) -> DataFrame:
    """(case_id, doc_id, fault) of labels that can't be earned: missing document, missing evidence, out of scope or filtered out.

    documents: doc_id, kb_id, content, and values (metadata) if cases have filters.
    """
    filtered = "filters" in cases.columns and "values" in documents.columns
    rows = labels.join(cases.select("case_id", "kb_ids", *["filters"] * filtered), "case_id").join(documents, "doc_id", "left")
    fault = F.when(F.col("content").isNull(), "missing document").when(~F.contains("content", "contains"), "missing evidence").when(F.col("kb_ids").isNotNull() & ~F.array_contains("kb_ids", F.col("kb_id")), "out of scope")
    if filtered:
        fault = fault.when(~matches(F.col("values"), F.col("filters")), "filtered out")
    return rows.select("case_id", "doc_id", fault.alias("fault")).where("fault is not null")


def rolled_up(results: DataFrame) -> DataFrame:
    """Means of METRICS over all cases (category null) and by category; nulls don't count, and a mean of none is null."""
    means = [F.avg(m).alias(m) for m in METRICS if m != "kb_leakage"]
    rows = results.rollup("category").agg(F.count("*").alias("queries"), *means, F.sum("kb_leakage").alias("kb_leakage"), F.grouping("category").alias("overall"))
    return rows.withColumn("overall", F.col("overall") == 1)


#: Values of a group up to which one task sorts them, and cells that a larger one's range is counted in.
LARGE, CELLS = 1_000_000, 4096


def percentiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), large: int = LARGE) -> DataFrame:
    """by and p50, p95 and so on for each share: exact percentiles between neighbours, as Spark's percentile gives them.

    Nulls don't count; a group without values gets 0, values must be finite. A group of more than large values is never in one
    task: the ranges that hold its percentiles' neighbours are counted in CELLS, partly before the shuffle, and narrowed to the
    cell of each rank, until a cell has one value. There is at most one such group for each so many rows; their ranges are in the
    driver's memory, a few numbers each.
    """
    by, names = list(by), [f"p{round(s * 100)}" for s in shares]
    plain = [F.coalesce(F.percentile("_v", F.lit(float(s))), F.lit(0.0)).alias(n) for s, n in zip(shares, names)]
    rows = rows.select(*by, F.col(value).cast("double").alias("_v"))
    groups = [tuple(r) for r in rows.groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v"), F.max("_v")).where(F.col("n") > large).collect()]
    if not groups:
        return rows.groupBy(*by).agg(*plain)
    kinds = [rows.schema[c] for c in by]
    hot = StructType([*kinds, *(StructField(n, DoubleType()) for n in names)])
    found = [(*g, *values) for g, values in _selected(rows, by, kinds, shares, groups)]
    out = rows.sparkSession.createDataFrame(found, hot)
    if not by:
        return out
    of = bounded(out.select(*[F.col(c).alias(f"_{c}") for c in by]), 100_000)
    rest = rows.join(of, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]), "left_anti")
    return rest.groupBy(*by).agg(*plain).unionByName(out)


def _selected(rows: DataFrame, by: list[str], kinds: list[StructField], shares: Sequence[float], groups: list[tuple]) -> Iterator[tuple[tuple, list[float]]]:
    """The percentiles of groups (by, n, least, greatest). A search is (group, rank) and its range (low, high, values below)."""
    ranks = {g: sorted({int(f(s * (g[-3] - 1))) for s in shares for f in (math.floor, math.ceil)}) for g in groups}
    open_ = {(g[:-3], r): (g[-2], g[-1], 0) for g in groups for r in ranks[g]}
    known: dict[tuple, float] = {}
    schema = StructType([*(StructField(f"_{k.name}", k.dataType) for k in kinds), StructField("low", DoubleType()), StructField("high", DoubleType())])
    while open_:
        known |= {key: low for key, (low, high, _) in open_.items() if low == high}
        open_ = {key: v for key, v in open_.items() if key not in known}
        if not open_:
            break
        ranges = rows.sparkSession.createDataFrame(sorted({(*g, low, high) for (g, _), (low, high, _) in open_.items()}, key=str), schema)
        mine = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], (F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high")))
        cell = F.least(F.floor((F.col("_v") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS), F.lit(CELLS - 1))
        counted = rows.join(F.broadcast(ranges), mine).groupBy(*[f"_{c}" for c in by], "low", "high", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        cells: dict[tuple, list] = {}
        for r in counted.orderBy("cell").toLocalIterator():
            cells.setdefault((tuple(r[f"_{c}"] for c in by), r.low, r.high), []).append((r.n, r.least, r.most))
        narrowed = {}
        for (g, rank), (low, high, below) in open_.items():
            for n, least, most in cells[g, low, high]:
                if rank < below + n:
                    narrowed[g, rank] = (least, most, below)
                    break
                below += n
        open_ = narrowed
    for g in groups:
        out = []
        for s in shares:
            at = s * (g[-3] - 1)
            low, high = known[g[:-3], math.floor(at)], known[g[:-3], math.ceil(at)]
            out.append(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
        yield g[:-3], out


def deltas(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(case_id, metric, baseline, candidate, delta) where a metric of a case differs and both have it."""
    long = lambda df, name: df.select("case_id", *[F.col(m).cast("double") for m in METRICS]).unpivot("case_id", METRICS, "metric", name)
    both = long(baseline, "baseline").join(long(candidate, "candidate"), ["case_id", "metric"])
    return both.withColumn("delta", F.col("candidate") - F.col("baseline")).where("delta <> 0")


def unpaired(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Case ids that only one of two runs has."""
    a, b = baseline.select("case_id").withColumn("a", F.lit(1)), candidate.select("case_id").withColumn("b", F.lit(1))
    return a.join(b, "case_id", "full").where("a is null or b is null").select("case_id")


#: Paired differences up to which a bootstrap sends them to its tasks, 8 bytes each.
CASES = 1_000_000


def bootstrap(pairs: DataFrame, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """(low, high): the 95 % interval of the mean paired difference. pairs: case_id, baseline, candidate of a metric.

    Draws are taken from SHA-256 of seed, resample and draw, so that anyone can repeat them. Differences are numbered in the
    order of case_id. A benchmark's cases were judged by hand, so they are few; more than CASES are an error. Resamples are spread
    over the cluster, a row each.
    """
    spark = pairs.sparkSession
    rows = pairs.where("baseline is not null and candidate is not null").select("case_id", (F.col("candidate") - F.col("baseline")).alias("d")).limit(CASES + 1).toPandas()
    if len(rows) > CASES:
        raise ValueError(f"a bootstrap takes at most {CASES} cases")
    d = rows.sort_values("case_id", kind="stable")["d"].to_numpy(np.float64)

    def run(batches):
        for batch in batches:
            means = []
            for r in batch.column(0).to_pylist():
                start = hashlib.sha256(f"{seed}:{r}:".encode())
                draws = np.empty(len(d), np.int64)
                for j in range(len(d)):
                    one = start.copy()
                    one.update(b"%d" % j)
                    draws[j] = int.from_bytes(one.digest()[:4], "big") % len(d)
                means.append(float(d[draws].mean()))
            yield pa.RecordBatch.from_arrays([pa.array(means, pa.float64())], ["mean"])

    means = spark.range(resamples if len(d) else 0).mapInArrow(run, "mean double")
    return means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
