"""Hard negatives by one-dimensional distance keys.

Vectors of whole numbers get one more coordinate, so that all have the same length; then the order of inner products with an
anchor is that of distances from it. Each row is stored under its nearest pivot and its distance from it, in cells: a group of
labels, a pivot, and a ring of distances, the table sorted by pivot and ring. By the triangle inequality a cell whose rings are
from lo to hi about a pivot at distance D from the anchor holds nothing nearer than max(lo - D, D - hi) and nothing farther
than D + hi. A search scans cells by that bound in steps: the nearest ones first, so the intervals of keys about each pivot
widen; a cell is left out once its bound is beyond the k-th best so far, or outside the scores asked for. What is left out
can't hold an answer, so results are exact whatever the bounds achieve.

Cells of many rows, such as thousands of copies at one key, are dealt by hash to blocks of at most BLOCK components. Anchors
are joined with the blocks they ask for by a shuffle of both, as requests are many times as large as the anchors; a task has
one block and the anchors of one request at a time and returns at most k rows for each search. Pivots (at most PIVOTS), rings (at most RINGS for each) and the directory of cells, with at most
GROUPS * PIVOTS * RINGS rows, are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import kernels
from granary.llm.common import small, text_batches, written
from granary.llm.vectors import flat, usable, width

PIVOTS = RINGS = 32
#: Groups that labels are dealt to by hash.
GROUPS = 16
#: Components in a block of a cell.
BLOCK = 1 << 19
#: Share of the cells, nearest first, that a search may have scanned after each step.
STEPS = (1 / 16, 1 / 4, 1.0)
#: Anchors in a request.
ANCHORS = 500
#: Bytes of requests that a task makes at once, about.
REQUESTED = 8 << 20
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Scores are sums in double precision while they stay below this, else in 64-bit integers.
DOUBLE = 1 << 52


@dataclass
class Index:
    """blocks: written (grp, pivot, ring, part, ids, labels, vectors), by pivot and ring; the rest is small."""

    blocks: DataFrame
    pivots: np.ndarray
    length: float
    dim: int
    #: Columns grp, pivot, ring, parts and lo, hi: the cells.
    cells: np.ndarray
    keys: np.ndarray
    kind: str


def whole_numbers(rows: DataFrame, scale: int) -> tuple[DataFrame, int, float]:
    """(vec_id, label, vector, length) of the rows that take part, with vectors as packed integers; their dimension (the largest:
    shorter ones are padded by zeros) and the greatest length, all squared.

    Components are floor(scale * x), cut at 2 ** 31 / sqrt(dimension) on either side, so that every score is exact in 64 bits.
    """
    kind = width(rows)
    able = rows.where(usable() & F.col("label").isNotNull()).select("vec_id", "label", "embedding")
    dim = able.agg(F.max(F.size("embedding"))).first()[0] or 1
    most = float(int((1 << 31) / dim**0.5) - 1)

    def run(batches):
        for batch in batches:
            values, where = flat(batch.column(2), kind)
            values = np.clip(np.floor(values.astype(np.float64) * scale), -most, most)
            sizes = np.diff(where)
            full = np.zeros((len(sizes), dim), "<i4")
            full[np.arange(dim) < sizes[:, None]] = values
            raw = full.tobytes()
            length = (full.astype(np.int64) ** 2).sum(1)
            packed = [raw[4 * dim * k : 4 * dim * (k + 1)] for k in range(len(sizes))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(length)], ["vec_id", "label", "vector", "length"])

    out = written(able.mapInArrow(kernels.lean(run), "vec_id long, label string, vector binary, length long"), "whole")
    return out, dim, float(out.agg(F.max("length")).first()[0] or 0)


def matrix(packed: list[bytes], dim: int) -> np.ndarray:
    """Packed integer vectors as rows of doubles."""
    if not packed:
        return np.zeros((0, dim))
    return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), dim).astype(np.float64)


def distances(points: np.ndarray, own: np.ndarray, pivots: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Distances of points, whose further coordinates are own, from pivots, whose are last."""
    squares = np.einsum("ij,ij->i", points, points)[:, None] + (np.einsum("ij,ij->i", pivots, pivots) + last * last)[None]
    return np.sqrt(np.maximum(squares + (own * own)[:, None] - 2 * (points @ pivots.T + own[:, None] * last[None]), 0))


def indexed(rows: DataFrame, dim: int, length: float, pivots: int | None = None, rings: int | None = None) -> Index:
    """The index over rows of whole_numbers. More rows get more pivots and rings, in proportion to the square root of the blocks
    that they fill, from 2 on; or as many as given."""
    n = rows.count()
    fitting = int(np.clip(round((n * dim / BLOCK) ** 0.5), 2, PIVOTS))
    pivots, rings = pivots or fitting, min(rings or fitting, RINGS)
    chosen = rows.select("vector").distinct().orderBy(F.xxhash64(F.lit("pivot"), "vector"), "vector").limit(pivots).collect()
    at = matrix([r["vector"] for r in chosen], dim)
    last = np.sqrt(np.maximum(length - np.einsum("ij,ij->i", at, at), 0))

    def keyed(batches):
        for batch in batches:
            points = matrix(batch.column(2).to_pylist(), dim)
            own = np.sqrt(np.maximum(length - batch.column(3).to_numpy().astype(float), 0))
            far = distances(points, own, at, last)
            near = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(near, pa.int32()), pa.array(far[np.arange(len(near)), near])], ["vec_id", "label", "vector", "grp", "pivot", "distance"])

    grouped = rows.withColumn("grp", label_group(F.col("label")))
    table = grouped.mapInArrow(kernels.lean(keyed), "vec_id long, label string, vector binary, grp int, pivot int, distance double")
    table = written(table, "keyed")
    cuts: dict[int, list[float]] = {}
    if rings > 1:
        shares = [k / rings for k in range(1, rings)]
        cuts = {r["pivot"]: r["cuts"] for r in table.groupBy("pivot").agg(F.percentile_approx("distance", shares, 10_000).alias("cuts")).collect()}
    limits = F.array(*[F.array(*[F.lit(float(c)) for c in cuts.get(p, [])]).cast("array<double>") for p in range(max(1, len(at)))])
    ring = F.size(F.filter(F.get(limits, F.col("pivot")), lambda c: c < F.col("distance"))).cast("int")
    table = table.withColumn("ring", ring)
    cells = table.groupBy("grp", "pivot", "ring").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.ceil(F.count("*") * dim / F.lit(BLOCK)).cast("int").alias("parts"))
    cells = written(cells, "cells")
    found = cells.orderBy("grp", "pivot", "ring").collect()
    dealt = table.join(small(cells.select("grp", "pivot", "ring", "parts")), ["grp", "pivot", "ring"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts")).cast("int"))

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")  # null last
        first = {c: rows[c][:1] for c in ("grp", "pivot", "ring", "part")}
        return pa.table(first | {"ids": pa.array([rows["vec_id"].to_pylist()], pa.list_(pa.int64())), "labels": pa.array([rows["label"].to_pylist()], pa.list_(pa.string())), "vectors": pa.array([b"".join(rows["vector"].to_pylist())], pa.binary())})

    dealt = dealt.select("grp", "pivot", "ring", "part", "vec_id", "label", "vector").groupBy("grp", "pivot", "ring", "part")
    blocks = dealt.applyInArrow(packed, "grp int, pivot int, ring int, part int, ids array<long>, labels array<string>, vectors binary")
    blocks = written(blocks.sortWithinPartitions("pivot", "ring"), "distance-index")
    numbers = np.array([(r["grp"], r["pivot"], r["ring"], r["parts"]) for r in found], np.int64).reshape(-1, 4)
    return Index(blocks, at, length, dim, numbers, np.array([(r["lo"], r["hi"]) for r in found], float).reshape(-1, 2), "double" if length < DOUBLE else "long")


def label_group(label: Column) -> Column:
    return F.pmod(F.xxhash64(label), F.lit(GROUPS)).cast("int")


def scores(anchors: np.ndarray, vectors: np.ndarray, kind: str) -> np.ndarray:
    """Exact inner products of integers."""
    if kind == "double":
        return (anchors @ vectors.T).astype(np.int64)
    return anchors.astype(np.int64) @ vectors.astype(np.int64).T


def first(got: np.ndarray, able: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k greatest scores of each row that are able, the earlier columns of a tie."""
    many = np.flatnonzero(np.count_nonzero(able, axis=1) > k)
    if len(many):
        some = np.where(able[many], got[many], LEAST)
        able[many] &= some >= np.partition(some, -k, axis=1)[:, -k, None]
    i, j = np.nonzero(able)
    order = np.lexsort((j, -got[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep]


def _requests(searches: DataFrame, index: Index, same: bool, share: tuple[float, float]) -> DataFrame:
    """Of the searches (q, label, grp, vector, lows, highs, bests) those cells that lie in the step's share of each anchor's
    order and may hold an answer: (grp, pivot, ring, part, anchors), anchors packed as an array."""
    at, length, dim, cells, keys = index.pivots, index.length, index.dim, index.cells, index.keys
    last = np.sqrt(np.maximum(length - np.einsum("ij,ij->i", at, at), 0)) if len(at) else np.zeros(0)

    def run(batches):
        for batch in batches:
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns)}
            for start in range(0, batch.num_rows, ANCHORS):
                part = {n: c.slice(start, ANCHORS) for n, c in columns.items()}
                yield from asked(part)

    def asked(part: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        q = matrix(part["vector"].to_pylist(), dim)
        far = distances(q, np.zeros(len(q)), at, last)[:, cells[:, 1]]
        square = (np.einsum("ij,ij->i", q, q) + length)[:, None]
        slack = 1e-6 * square + 1  # more than rounding of distances can do
        least = np.maximum(np.maximum(keys[None, :, 0] - far, far - keys[None, :, 1]), 0)
        above = (square - least**2) / 2 + slack  # no row of the cell has a higher score
        below = (square - (far + keys[None, :, 1]) ** 2) / 2 - slack
        allowed = (cells[None, :, 0] == part["grp"].to_numpy()[:, None]) if same else np.ones(above.shape, bool)
        place = np.argsort(np.argsort(np.where(allowed, -above, np.inf), axis=1, kind="stable"), axis=1)
        count = allowed.sum(1, keepdims=True)
        need = allowed & (place >= np.ceil(count * share[0])) & (place < np.ceil(count * share[1]))
        wanted = np.zeros(need.shape, bool)
        lows, highs, bests = (part[c].to_pylist() for c in ("lows", "highs", "bests"))
        for s in range(max(map(len, lows), default=0)):
            low = np.array([max(a[s], b[s]) if s < len(a) else MOST for a, b in zip(lows, bests)], float)[:, None]
            high = np.array([a[s] if s < len(a) else LEAST for a in highs], float)[:, None]
            wanted |= (above >= low) & (below <= high)
        need &= wanted
        # of each cell asked for, a row for each of its parts; rows are sent by about REQUESTED bytes
        entries = pa.StructArray.from_arrays([part[c] for c in fields], fields)
        found = np.flatnonzero(need.any(0))
        found = np.repeat(found, cells[found, 3])
        number = np.arange(len(found)) - np.searchsorted(found, found)
        ends = np.cumsum(need.sum(0)[found])
        most = max(1, REQUESTED // (4 * dim + 24 * max(map(len, lows), default=0) + 64))
        start = 0
        while start < len(found):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            own = [np.flatnonzero(need[:, c]) for c in found[start:stop]]
            starts = np.cumsum([0, *map(len, own)]).astype(np.int32)
            anchors = pa.ListArray.from_arrays(pa.array(starts), entries.take(pa.array(np.concatenate(own))))
            keys_of = [*cells[found[start:stop], :3].T, number[start:stop]]
            yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in keys_of], anchors], ["grp", "pivot", "ring", "part", "anchors"])
            start = stop

    fields = ["q", "label", "vector", "lows", "highs", "bests"]
    schema = "grp int, pivot int, ring int, part int, anchors array<struct<q long, label string, vector binary, lows array<long>, highs array<long>, bests array<long>>>"
    return searches.select("grp", *fields).mapInArrow(kernels.lean(run), schema)


def _scanned(met: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """(q, search, score, vec_id): for each search the k best rows of each block it asked for."""
    dim, kind = index.dim, index.kind

    def run(batches):
        for batch in batches:
            for ids, labels, vectors, anchors in zip(*batch.columns):
                ids, anchors = ids.values, dict(zip(("q", "label", "vector", "lows", "highs", "bests"), anchors.values.flatten()))
                names, code = np.unique(np.array(labels.as_py()), return_inverse=True)
                known = {str(name): c for c, name in enumerate(names)}
                x, q = matrix([vectors.as_py()], dim * len(ids)).reshape(len(ids), dim), matrix(anchors["vector"].to_pylist(), dim)
                got = scores(q, x, kind)
                agree = code[None] == np.array([known.get(a, -1) for a in anchors["label"].to_pylist()])[:, None]
                fits = agree if same else ~agree
                lows, highs, bests = (anchors[c].to_pylist() for c in ("lows", "highs", "bests"))
                for s in range(max(map(len, lows))):
                    low = np.array([max(a[s], b[s]) if s < len(a) else MOST for a, b in zip(lows, bests)])[:, None]
                    high = np.array([a[s] if s < len(a) else LEAST for a in highs])[:, None]
                    i, j = first(got, fits & (got >= low) & (got <= high), k)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([anchors["q"].take(pa.array(i)), pa.array(np.full(len(i), s, np.int32)), pa.array(got[i, j]), ids.take(pa.array(j))], ["q", "search", "score", "vec_id"])

    return met.select("ids", "labels", "vectors", "anchors").mapInArrow(kernels.lean(run), "q long, search int, score long, vec_id long")


def best(searches: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """(q, search, place, score, vec_id): the first k rows of the index for each search.

    searches: (q, label, vector, lows, highs), a row for each anchor, with the least and the greatest score of each of its
    searches. same: only rows of the anchor's label count, else only others. Higher scores first, ties by smaller vec_id,
    null last.
    """
    order = Window.partitionBy("q", "search").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    base = searches.withColumn("grp", label_group(F.col("label")))
    none = F.transform("lows", lambda x: F.lit(LEAST).cast("long"))
    kept = None
    for share in zip((0.0, *STEPS), STEPS):
        if kept is None:
            known = base.withColumn("bests", none)
        else:  # the k-th best score of each search that has k
            full = kept.where(F.col("place") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("search", "score"))).alias("full"))
            at = F.transform("lows", lambda x, i: F.coalesce(F.element_at("full", i.cast("int")), F.lit(LEAST).cast("long")))
            known = base.join(full, "q", "left").withColumn("bests", F.when(F.col("full").isNull(), none).otherwise(at))
        asked = _requests(known, index, same, share)
        met = _scanned(asked.join(index.blocks.hint("merge"), ["grp", "pivot", "ring", "part"]), index, k, same)
        every = met if kept is None else met.unionByName(kept.drop("place"))
        kept = written(every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k), "best")
    return kept


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: Fraction = Fraction(1, 2), most: Fraction = Fraction(95, 100), scale: int = 256, pivots: int | None = None, rings: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, label, embedding).

    Components become floor(scale * x); a score is an inner product of these. Anchors are the rows where anchor, an expression
    over vec_id, holds. An anchor's positives are the first rows of its label besides itself, by score, then smaller vec_id; for
    each of them the negatives are the first rows of other labels whose score is between least and most times the positive's,
    both included. None fit where the positive's score is negative. rank counts from 1.

    Rows without label, or with a null or empty vector or a null or non-finite component, take no part. Null vec_id: never an
    anchor, last in ties. Rows of one vec_id are rows: each may be an anchor, a positive of the others, a negative. Of vectors
    of unlike dimension the shorter ones are padded by zeros; components beyond 2 ** 31 / sqrt(dimension) are cut to that. Other
    columns are ignored, whatever their names. Empty table: empty result.
    """
    text_batches(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding"))
    every, dim, length = whole_numbers(rows, scale)
    index = indexed(every, dim, length, pivots, rings)
    anchors = written(every.where(anchor).withColumn("q", F.monotonically_increasing_id()), "anchors")
    all_scores = [F.array(F.lit(v).cast("long")) for v in (LEAST, MOST)]
    near = best(anchors.select("q", "label", "vector", all_scores[0].alias("lows"), all_scores[1].alias("highs")), index, positives + 1, True)
    # the anchor's own row, or one that can't be told from it
    near = near.join(anchors.select("q", F.col("vec_id").alias("anchor_id"), "length"), "q")
    own = F.min(F.when((F.col("vec_id") == F.col("anchor_id")) & (F.col("score") == F.col("length")), F.col("place"))).over(Window.partitionBy("q"))
    near = near.withColumn("own", F.coalesce(own, F.lit(positives + 1))).where("place <> own")
    near = near.select("q", "anchor_id", (F.col("place") - (F.col("place") > F.col("own")).cast("int")).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    low = F.expr(f"cast(ceil(cast(positive_score as decimal(38, 0)) * {least.numerator} / {least.denominator}) as long)")
    high = F.expr(f"cast(floor(cast(positive_score as decimal(38, 0)) * {most.numerator} / {most.denominator}) as long)")
    near = written(near.withColumn("low", low).withColumn("high", high), "positives").where("low <= high")
    windows = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("w"))
    windows = anchors.select("q", "label", "vector").join(windows, "q")
    found = best(windows.select("q", "label", "vector", F.col("w.low").alias("lows"), F.col("w.high").alias("highs")), index, negatives, False)
    numbered = near.withColumn("search", F.row_number().over(Window.partitionBy("q").orderBy("place")) - 1)
    out = numbered.join(found.select("q", "search", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["q", "search"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
