"""Deletion vectors: which rows of a bucketed table are dead, as bitmaps of their places in their files.

A deletion writes bitmaps, not points: reads leave marked rows out. Files are named by the last four parts of their path, so
that a store can be moved. Buckets of which a large share is dead, or that lie in many folders, are compacted: written anew
without what is dead, and their bitmaps go.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.lexical import bounded
from granary.sources.store import Patch, Store, bucket_of

VECTORS = "file string, page long, bits binary"
#: A bucket is compacted from this share of dead rows on, or in more than so many folders.
DEAD, FOLDERS = 0.25, 8


def placed(table: DataFrame) -> DataFrame:
    """A table's rows with _file, _page and _bit: where each lies. A page is the rows of one bitmap."""
    row = F.col("_metadata.row_index") + 1  # bitmaps count from 1
    file = F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+/[^/]+/[^/]+)$", 1)
    return table.select("*", file.alias("_file"), F.bitmap_bucket_number(row).alias("_page"), F.bitmap_bit_position(row).alias("_bit"))


def marked(rows: DataFrame) -> DataFrame:
    """VECTORS of placed rows."""
    return rows.groupBy(F.col("_file").alias("file"), F.col("_page").alias("page")).agg(F.bitmap_construct_agg("_bit").alias("bits"))


def joined(vectors: DataFrame, more: DataFrame) -> DataFrame:
    """The rows of either."""
    return vectors.unionByName(more).groupBy("file", "page").agg(F.bitmap_or_agg("bits").alias("bits"))


def alive(store: Store, active: dict[str, Any], table: str, buckets: set[int] | None = None) -> DataFrame:
    """The rows of a table that aren't dead, with their places."""
    rows = placed(store.read(active, table, buckets))
    vectors = bounded(store.read(active, f"{table}.dead"), 10_000)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    dead = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
    return rows.join(vectors, (F.col("_file") == F.col("file")) & (F.col("_page") == F.col("page")), "left").where(~F.coalesce(dead, F.lit(False))).drop("file", "page", "bits")


def crowded(store: Store, active: dict[str, Any], table: str) -> frozenset[int]:
    """Buckets that should be compacted."""
    folders: dict[int, int] = {}
    for k in active["places"][table]:
        folders[int(k.split(".")[0])] = folders.get(int(k.split(".")[0]), 0) + 1
    of = lambda c: F.regexp_extract(c, r"bucket=(\d+)/", 1).cast("int")
    dead = store.read(active, f"{table}.dead").groupBy(of("file").alias("bucket")).agg(F.sum(F.bitmap_count("bits")).alias("dead"))
    if not dead.limit(1).count():
        return frozenset(k for k, n in folders.items() if n > FOLDERS)
    rows = placed(store.read(active, table)).groupBy(of("_file").alias("bucket")).agg(F.count("*").alias("rows"))
    heavy = {r.bucket for r in rows.join(dead, "bucket").where(F.col("dead") >= DEAD * F.col("rows")).collect()}
    return frozenset(heavy | {k for k, n in folders.items() if n > FOLDERS})


def compacted(store: Store, active: dict[str, Any], table: str, key: str, buckets: frozenset[int]) -> dict[str, DataFrame | Patch]:
    """The tables of a generation in which these buckets have no dead row; key: the column that buckets are by."""
    rows = alive(store, active, table, set(buckets)).drop("_file", "_page", "_bit")
    left = store.read(active, f"{table}.dead").where(~F.regexp_extract("file", r"bucket=(\d+)/", 1).cast("int").isin(*buckets))
    return {table: Patch(rows.withColumn("bucket", bucket_of(F.col(key), store.buckets(active))), buckets), f"{table}.dead": left}
