"""Near-duplicate embeddings by products of int8 tiles with rigorous error bounds.

1. Equal vectors of a label are one class, so copies are never paired.
2. The classes of a label are dealt by hash to blocks of at most BLOCK components, packed as one row each: the vectors, and
   for each its scale, its 8-bit components q and the length e of what rounding took from the unit vector v = scale * q + rest.
   A label of any size is as many blocks as it needs.
3. Every two blocks of a label are a task. It multiplies the 8-bit components tile by tile; integers of this size are exact
   in a product of 32-bit floats. By Cauchy and Schwarz the true cosine of two vectors lies within e + f + e * f of the scaled
   product, so a pair is decided by the product unless the threshold is that near; only those pairs are computed in double
   precision. A task returns the number of links of each class and the edges of a spanning forest, never pairs.
4. Components of the edges.

Work is that of all products within a label, a quarter of a cycle each; memory is that of two blocks and a tile.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import kernels
from granary.llm.common import components, small, text_batches, written
from granary.llm.jaccard import Forest
from granary.llm.vectors import flat, usable, width

#: Components in a block, and rows and columns of a tile.
BLOCK = 1 << 19
TILE = 1024
#: Pairs that are computed in double precision at once.
PAIRS = 1 << 15
#: 8-bit products summed at once: their sum stays below 2 ** 24, so 32-bit floats hold it exactly.
EXACT = 1024
#: Bound of what rounding in 32-bit floats adds to the scaled product of unit vectors, and in double precision to a cosine.
ROUNDING = 1e-5
FINE = 1e-12
#: Bytes of a class's key.
KEY = 16


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, whatever their magnitude; none may be zero."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit components, scales, and lengths of the rests of unit vectors."""
    scale = np.abs(v).max(1) / 127
    q = np.rint(v / scale[:, None])
    rest = v - q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt(np.einsum("ij,ij->i", rest, rest)) + FINE


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of 8-bit matrices, without rounding up to 2 ** 24."""
    out = None
    for k in range(0, a.shape[1], EXACT):
        part = a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
        out = part if out is None else out + part
    return out


class Block:
    """Vectors of a block with what the tiles need of them."""

    def __init__(self, row: dict, kind: np.dtype):
        self.keys = [row["keys"][k : k + KEY] for k in range(0, len(row["keys"]), KEY)]
        self.copies = np.frombuffer(row["copies"], np.int64)
        self.unit = unit(np.frombuffer(row["vectors"], kind).reshape(len(self.keys), -1).astype(np.float64))
        self.q, self.scale, self.rest = quantised(self.unit)


def tiles(a: Block, b: Block, threshold: float, same: bool):
    """Of each tile its first row, its first column, and the rows and columns in it that are linked. same: a and b are one block,
    of which only the pairs with a later column are looked at."""
    for i in range(0, len(a.keys), TILE):
        for j in range(i if same else 0, len(b.keys), TILE):
            x, y = slice(i, i + TILE), slice(j, j + TILE)
            near = product(a.q[x], b.q[y])
            near *= a.scale[x, None].astype(np.float32)
            near *= b.scale[None, y].astype(np.float32)
            e, f = a.rest[x], b.rest[y]
            # by the tile's largest bound first, then by each pair's own
            most = e.max() + f.max() + e.max() * f.max() + ROUNDING
            one, two = np.nonzero(near >= np.float32(threshold - most - ROUNDING))
            if same and i == j:
                keep = two > one
                one, two = one[keep], two[keep]
            bound = e[one] + f[two] + e[one] * f[two] + ROUNDING
            value = near[one, two].astype(np.float64)
            linked = value - bound >= threshold
            open_ = np.flatnonzero(~linked & (value + bound >= threshold))
            for k in range(0, len(open_), PAIRS):
                p = open_[k : k + PAIRS]
                linked[p] = np.einsum("ij,ij->i", a.unit[i + one[p]], b.unit[j + two[p]]) >= threshold
            yield i, j, one[linked], two[linked]


def _linked(table: pa.Table, kind: np.dtype, threshold: float) -> pa.Table:
    """(key, links, root) of the classes of two blocks, or of one with itself, that have a link in this task."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    same = len(rows) == 1
    a = Block(rows[0], kind)
    b = a if same else Block(rows[1], kind)
    keys, shift = (a.keys, 0) if same else (a.keys + b.keys, len(a.keys))
    links, forest = np.zeros(len(keys), np.int64), Forest(len(keys))
    for i, j, one, two in tiles(a, b, threshold, same):
        if not len(one):
            continue
        one, two = one + i, two + j
        links += np.bincount(one, weights=b.copies[two], minlength=len(keys)).astype(np.int64)
        links += np.bincount(two + shift, weights=a.copies[one], minlength=len(keys)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
        for k, found in zip(one[cuts], np.split(two, cuts[1:])):
            forest.merge(int(k), found + shift)
    keep = np.flatnonzero(links)
    return pa.table({"key": pa.array([keys[k] for k in keep], pa.binary()), "links": links[keep], "root": pa.array([keys[forest.root[k]] for k in keep], pa.binary())})


def classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, label, dim, vector) of rows (vec_id, label, embedding): key is a digest of label and vector, null where the
    vector can't be linked with anything."""
    kind = width(vectors)

    def run(batches):
        for batch in batches:
            values, where = flat(batch.column(2), kind)
            values += 0.0  # -0.0 is 0.0
            raw, keys = [], []
            for label, a, b in zip(batch.column(1).to_pylist(), where[:-1], where[1:]):
                own = values[a:b]
                raw.append(own.tobytes() if own.any() else None)
                keys.append(hashlib.blake2b(f"{len(label)}:{label}:".encode() + raw[-1], digest_size=KEY).digest() if raw[-1] else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1), pa.array(np.diff(where), pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "key", "label", "dim", "vector"])

    able = F.when(usable() & F.col("label").isNotNull(), F.col("embedding"))
    return vectors.select("vec_id", "label", able.alias("embedding")).mapInArrow(kernels.lean(run), "vec_id long, key binary, label string, dim int, vector binary")


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, label, embedding).

    Two rows link if their labels are equal and not null, their vectors have one dimension, and the cosine in double precision
    is at least threshold, which must be positive. n_links: other rows linked directly, copies included. component_id: the
    smallest vec_id reachable, the row's own included. kept: vec_id = component_id.

    Null vectors, empty ones, zero vectors and those with null or non-finite components link with nothing, as do rows without
    label: component_id is their vec_id. Null vec_id: linked and counted, never kept; component_id is null only if no vec_id is
    reachable. Rows of one vec_id are rows: all of them are kept if it is the component's smallest. Vectors of any length and
    magnitude; other columns are ignored, whatever their names. Empty table: empty result.
    """
    spark = vectors.sparkSession
    text_batches(spark)
    kind = width(vectors)
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<float>" if kind.itemsize == 4 else "array<double>"))
    rows = written(classes(vectors), "vectors")
    each = rows.where("key is not null").groupBy("key", "label", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    each = written(each, "vector-classes")
    parts = each.groupBy("label", "dim").agg(F.ceil(F.count("*") * F.col("dim") / F.lit(BLOCK)).cast("int").alias("parts"))
    dealt = each.join(small(parts), ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))

    def packed(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("key")
        first = {c: ordered[c][:1] for c in ("label", "dim", "parts", "part")}
        whole = {"keys": b"".join(ordered["key"].to_pylist()), "copies": ordered["copies"].to_numpy().tobytes(), "vectors": b"".join(ordered["vector"].to_pylist())}
        return pa.table(first | {k: pa.array([v], pa.binary()) for k, v in whole.items()})

    schema = "label string, dim int, parts int, part int, keys binary, copies binary, vectors binary"
    blocks = written(dealt.select("label", "dim", "parts", "part", "key", "copies", "vector").groupBy("label", "dim", "part").applyInArrow(packed, schema), "vector-blocks")
    met = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other")).drop("other", "parts")
    linked = met.groupBy("label", "dim", "a", "b").applyInArrow(lambda t: _linked(t, kind, threshold), "key binary, links long, root binary")
    linked = written(linked, "vector-links")
    found = components(linked.where("key <> root"), "key", "root").withColumnRenamed("id", "key")
    found = each.select("key", "rep", "copies").join(found, "key", "left")
    low = found.where("component is not null").groupBy("component").agg(F.min("rep").alias("low"))
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    found = found.join(low, "component", "left").join(links, "key", "left")
    found = found.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "rep").alias("least"))
    out = rows.select("vec_id", "key").join(found, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
