"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WORD, small, written

#: Hash buckets of each source among which the fractional repetition finds its edge; only the edge's own bucket is sorted.
BUCKETS = 4096


def water_filling(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """Targets of sources. sizes: rows (source, source_size), one for each source, null allowed.

    Sources sorted by code point, null last, take the weights in turn. Together they get share * the sum of sizes, in
    proportion to weight, but none more than epochs * its own size; what is clamped off goes to the others by weight, and
    so on. That end state is target = least(cap, weight * level): with sources sorted by cap / weight, the level is the
    rest after the first k caps divided by the weights behind them, for the first k at which no later source is above its
    cap. Where all caps together are less than the share, each target is its cap. Sources of size 0 get 0.
    Adds weight, cap and target (double). The table has a row for each source, so its windows run in one task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ladder = Window.orderBy(F.col("ratio"), F.col("source").isNull(), F.col("source"))
    up_to = ladder.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
    df = df.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    df = df.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    df = df.withColumn("caps", F.sum("cap").over(up_to) - F.col("cap"))
    df = df.withColumn("behind", F.sum("weight").over(whole) - F.sum("weight").over(up_to) + F.col("weight"))
    df = df.withColumn("level", (F.col("total") - F.col("caps")) / F.col("behind"))
    df = df.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))).over(whole)["level"])
    df = df.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap")))
    return df.select("source", "source_size", "weight", "cap", "target")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with size (words of the text), source_size, target and repeats (times that the mix takes the document).

    A source of target t and size s takes every document floor(t / s) times and, for the fraction left, one more time those
    that come first in the order of md5(seed, doc_id), up to the document whose inclusion brings the sum nearest the target.
    Reruns agree. Rows of one doc_id and source are one in that order: they share the last one's fate. Documents of size 0
    get no fractional repetition.

    A hot source is summed in BUCKETS ranges of that hash, partly before the shuffle, and only the bucket in which the edge
    falls is sorted, equal rows as one with their count; no task holds a source, nor all rows of a doc_id. Null text: size 0, repeats as the source's whole repetition. Words are counted in
    whole texts, however long. Null doc_id hashes like an empty one. Null source is a source of its own; sources whose cap is
    as far above their weight tie and fill up together. Empty table: empty result. Other columns are kept; columns named size,
    source_size, target or repeats are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "repeats")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    sized = docs.withColumn("size", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"))
    sized = sized.withColumn("_mix_key", key).withColumn("_mix_bucket", F.conv(F.substring("_mix_key", 1, 3), 16, 10).cast("int"))
    slim = written(sized.select("source", "size", "_mix_key", "_mix_bucket"), "mix")
    ranges = written(slim.groupBy("source", "_mix_bucket").agg(F.sum("size").alias("words")), "mix-ranges")
    plan = water_filling(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # the bucket in which a source's rest is used up, and what is left of the rest at its beginning
    run = Window.partitionBy("source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = ranges.withColumn("upto", F.sum("words").over(run)).alias("r").join(small(plan).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    edge = edge.where("upto > rest").groupBy("p.source").agg(F.min(F.struct("_mix_bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))).alias("edge"))
    plan = plan.alias("p").join(edge.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
    plan = written(plan.select(F.col("p.source").alias("_mix_source"), "source_size", "target", F.col("whole").alias("_mix_whole"), F.coalesce("edge._mix_bucket", F.lit(BUCKETS)).alias("_mix_edge"), F.coalesce("edge.left", F.lit(0.0)).alias("_mix_left")), "mix-plan")
    of_source = lambda df: df.join(small(plan), F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source")
    # in the edge's bucket a row is taken while its middle lies before the end: the sum that is nearest
    rows = of_source(slim).where("_mix_bucket = _mix_edge and size > 0").groupBy("source", "_mix_key", "size", "_mix_left").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("_mix_key").rowsBetween(Window.unboundedPreceding, -1)
    room = (F.col("_mix_left") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0))) / F.col("size")
    more = rows.withColumn("_mix_more", F.least("n", F.greatest(F.ceil(room - F.lit(0.5)), F.lit(0)))).where("_mix_more > 0")
    more = written(more.select(F.col("source").alias("_mix_source"), F.col("_mix_key").alias("_mix_taken"), "_mix_more", "n"), "mix-edge")
    of_edge = F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_key") == F.col("_mix_taken"))
    whole = more.where("_mix_more = n").select("_mix_source", "_mix_taken", F.lit(1).alias("_mix_more"))
    out = of_source(sized).join(small(whole), of_edge, "left").drop("_mix_source", "_mix_taken")
    parts = more.where("_mix_more < n").drop("n")
    if parts.limit(1).count():  # of equal rows some are taken: at most one such group in a source
        out = out.join(small(parts.drop("_mix_more")), of_edge, "left_anti").unionByName(_numbered(of_source(sized).join(small(parts), of_edge)).drop("_mix_source", "_mix_taken"))
    taken = F.when((F.col("_mix_bucket") < F.col("_mix_edge")) & (F.col("size") > 0), 1).otherwise(F.coalesce("_mix_more", F.lit(0)))
    return out.select(*docs.columns, "size", "source_size", "target", (F.col("_mix_whole") + taken).cast("int").alias("repeats"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with _mix_more 1 for so many of each (_mix_source, _mix_taken) as it said, else 0: the first by task and place in it."""
    table = written(rows.withColumn("_mix_at", F.monotonically_increasing_id()), "mix-equal").withColumn("_mix_part", F.shiftright("_mix_at", 33))
    group = ["_mix_source", "_mix_taken"]
    sums = table.groupBy(*group, "_mix_part").agg(F.count("*").alias("_n"))
    run = Window.partitionBy(*group).orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_of{c}") for c in (*group, "_mix_part")], F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    met = table.join(small(written(sums, "mix-equal-parts")), F.col("_mix_source").eqNullSafe(F.col("_of_mix_source")) & (F.col("_mix_taken") == F.col("_of_mix_taken")) & (F.col("_mix_part") == F.col("_of_mix_part")))
    place = F.row_number().over(Window.partitionBy(*group, "_mix_part").orderBy("_mix_at"))
    return met.withColumn("_mix_more", (F.col("_before") + place <= F.col("_mix_more")).cast("int")).select(*rows.columns)


def repeated(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as many times as its repeats, columns as before."""
    own = {c: f"_own_{k}" for k, c in enumerate(docs.columns) if c in ("size", "source_size", "target", "repeats")}
    plan = mix(docs.withColumnsRenamed(own), **options).where("repeats > 0")
    every = plan.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return every.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
