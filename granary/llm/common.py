"""What the operators share: places that every executor sees, written tables, joins with a checked size, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a side may be broadcast; every such side here has rows of at most a few hundred bytes.
BROADCAST_ROWS = 200_000
#: Edges in a file of a step of components, about; rows in a file of a table whose size is known.
EDGES, FILE_ROWS = 100_000, 2_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which all executors and the driver see.

    Where the setting is absent the context's own checkpoint folder is used; on one machine (local mode: tests) a temporary one
    is set, on a cluster that is an error, as executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once.

    rows: what df has at most, if that is known; then it takes no more tasks and files than FILE_ROWS rows each need.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if rows is not None:
        df = df.coalesce(-(-max(1, rows) // FILE_ROWS))
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes what written made of each, once nothing will read it again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows that it has at most so many rows, else as it is (a shuffle join follows).

    df should be cheap to count: a written table or an aggregate's small result.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 500 rows and about 16 MB, since rows hold whole texts; a smaller number of rows stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 500:
        spark.conf.set(key, "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The column if df has it, else nulls of that type."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def components(edges: DataFrame, a: str = "a", b: str = "b", vertices: int | None = None) -> DataFrame:
    """Connected components of an undirected edge list: rows (id, component), component being the smallest id reachable.

    Alternating large-star and small-star steps: each is an aggregate by vertex (combined on the map side, so a vertex of
    very many edges costs one row per task) and one join, whose hot keys adaptive execution may split. Edges never grow in
    number; the loop ends when a step changes nothing. Every step is a written table. Ids that are in no edge, or only in
    a loop, are absent; null ends are dropped. vertices: how many there are at most, if known (see written).
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc", vertices)
    files = -(-max(1, pairs.count()) // EDGES)  # edges never grow in number, so no step needs more
    seen = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        star = star.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, pairs = pairs, written(star.select("e.u", "e.v").where("u <> v").distinct().coalesce(files), "cc")
        discard(last)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    tops = pairs.select(F.col("v").alias("id")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tops.select("id", F.col("id").alias("component")))
