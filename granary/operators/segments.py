"""A search index kept up with its chunks: what a change adds and takes is a segment of its own.

Bags, the chunks with their tokens, lie in buckets by document next to the chunks; only those of new chunks are tokenized. A
segment has the postings of the chunks that came, as blocks with their bounds; the chunks that went; and what both add to the
counts of tokens and the sums of lengths, below zero for those that went. Searches add the segments up. Segments of like size
are merged as new ones come, so there are about as many as the index doubled, and what a merge keeps is what is still there.

Tables of segment k: blocks.k and terms.k in buckets by token, gone.k, sums.k.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import lexical
from granary.sources.store import Patch, Store, bucket_of

#: Chunks in a span, as expected: those whose postings of a token are one block.
SPAN = 128
#: A segment is merged with the ones behind it once it has less than so many times their postings.
RATIO = 2
BAG = ["chunk_id", "doc_id", "kb_id", "length", "values", "tokens"]
BAGS = "chunk_id string, doc_id string, kb_id string, length long, values map<string,string>, tokens array<string>"
TABLES = ("blocks", "terms", "gone", "sums")


def bagged(described: DataFrame) -> DataFrame:
    """The bags of chunks with their documents' columns."""
    return lexical.bags(described).select(*BAG)


def weight(bags: DataFrame) -> int:
    """Postings that bags will have."""
    return bags.agg(F.coalesce(F.sum(F.size(F.array_distinct("tokens"))), F.lit(0))).first()[0]


def blocks(postings: DataFrame, chunks: int, buckets: int) -> DataFrame:
    """Postings as blocks: those of a token in a span of chunks of one knowledge base, with the greatest tf and the least length.

    A span is a range of chunks' hashes. A block's size doesn't grow with a token's frequency, and no token is in one task.
    Postings are shuffled once and sorted; a block is a run of them.
    """
    span = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, chunks // SPAN))).cast("int")
    names = ["token", "kb_id", "span", "chunk_id", "tf", "length"]
    rows = postings.withColumn("span", span).select(names).repartition("token", "kb_id", "span").sortWithinPartitions(names)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def made_of(t: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
        column = lambda c: t.column(c).combine_chunks()
        firsts = pa.array(begins[:-1])
        every = pa.StructArray.from_arrays([column(c) for c in names[3:]], names[3:])
        lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), every)
        least = lambda f, c: pa.array(f.reduceat(column(c).to_numpy(), begins[:-1]))
        return pa.RecordBatch.from_arrays([*[column(c).take(firsts) for c in names[:3]], least(np.maximum, "tf"), least(np.minimum, "length"), lists], [*names[:3], "most_tf", "least_length", "postings"])

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            differ = np.zeros(len(t), bool)
            for c in names[:3]:
                code = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                differ[1:] |= code[1:] != code[:-1]
            begins = np.r_[0, np.flatnonzero(differ)]
            if len(begins) > 1:  # the last run may go on
                yield made_of(t.slice(0, begins[-1]), begins)
            rest = t.slice(begins[-1])
        if rest is not None:
            yield made_of(rest, np.array([0, len(rest)]))

    out = f"token string, kb_id {kinds['kb_id']}, span int, most_tf {kinds['tf']}, least_length {kinds['length']}, postings array<struct<{','.join(f'{c}:{kinds[c]}' for c in names[3:])}>>"
    return rows.mapInArrow(run, out).withColumn("bucket", bucket_of(F.col("token"), buckets))


def deltas(fresh: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What bags that came and bags that went add to the counts of tokens, (kb_id, token, df), and to the sums, (kb_id, n, total)."""
    signed = fresh.withColumn("sign", F.lit(1)).unionByName(gone.withColumn("sign", F.lit(-1)))
    each = signed.select("kb_id", "sign", F.explode(F.array_distinct("tokens")).alias("token"))
    terms = each.groupBy("kb_id", "token").agg(F.sum("sign").alias("df"))
    sums = signed.groupBy("kb_id").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("length")).alias("total"))
    return terms, sums


def added(store: Store, active: dict[str, Any] | None, fresh: DataFrame, gone: DataFrame) -> tuple[dict[str, Any], list[dict[str, Any]], list[str]]:
    """(tables, segments, without) for the next generation: the new segment, merged with the last ones if they are of its size.

    fresh, gone: bags, as stored tables. Chunks that went and came again are both.
    """
    old = list((active or {}).get("segments", []))
    n = store.buckets(active)
    every = frozenset(range(n))
    number = old[-1]["number"] + 1 if old else 0
    came, went, size = fresh.count(), gone.count(), weight(fresh)
    if not came and not went:
        return {}, old, []
    first, total = len(old), size
    while first and old[first - 1]["postings"] < RATIO * total:
        first -= 1
        total += old[first]["postings"]
    postings, (terms, sums) = lexical.counted(fresh), deltas(fresh, gone)
    left = gone.select("chunk_id")
    if merged := old[first:]:
        mine = stored(store, active, merged, left)
        postings = mine.read().unionByName(postings)
        terms = mine.terms(None).unionByName(terms).groupBy("kb_id", "token").agg(F.sum("df").alias("df"))
        sums = mine.sums.unionByName(sums).groupBy("kb_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        left = mine.gone.select("chunk_id").distinct()
    # what is below zero here is taken from a segment before
    terms, sums = terms.where("df <> 0"), sums.where("n <> 0 or total <> 0")
    chunks = came + sum(s["chunks"] for s in merged)
    tables = {
        f"blocks.{number}": Patch(blocks(postings, chunks, n), every, ("token",)),
        f"terms.{number}": Patch(terms.withColumn("bucket", bucket_of(F.col("token"), n)), every, ("token",)),
        f"gone.{number}": left if first else left.where("false"),
        f"sums.{number}": sums,
    }
    segments = old[:first] + [{"number": number, "postings": total, "chunks": chunks}]
    return tables, segments, [f"{t}.{s['number']}" for s in merged for t in TABLES]


def made(chunks: DataFrame, keep: Callable[[DataFrame, str], DataFrame], buckets: int = 64) -> lexical.Index:
    """The index of chunks as one segment that no store has; keep stores its tables for as long as it is used."""
    bags = keep(lexical.bags(chunks).select("chunk_id", "kb_id", "length", "values", "tokens"), "bags")
    sums = bags.groupBy("kb_id").agg(F.count("*").alias("n"), F.sum("length").alias("total"))
    own = keep(blocks(lexical.counted(bags), bags.count(), buckets).withColumn("segment", F.lit(0)), "blocks")
    terms = own.groupBy("kb_id", "token").agg(F.sum(F.size("postings")).alias("df"))
    rows = {"blocks": own, "terms": keep(terms.withColumn("bucket", bucket_of(F.col("token"), buckets)), "terms")}
    part = lambda name, b: (rows[name] if b is None else rows[name].where(F.col("bucket").isin(sorted(b)))).drop("bucket")
    gone = bags.sparkSession.createDataFrame([], "chunk_id string, segment int")
    return lexical.Index(None, bags.drop("tokens"), lambda b: part("blocks", b), lambda b: part("terms", b), sums, gone, buckets)


def stored(store: Store, active: dict[str, Any], segments: list[dict[str, Any]] | None = None, gone: DataFrame | None = None) -> lexical.Index:
    """The index of a generation, or of some of its segments; gone: further chunks that left since."""
    numbers = [s["number"] for s in (active["segments"] if segments is None else segments)]

    def union(table: str, buckets: set[int] | None = None) -> DataFrame:
        parts = [store.read(active, f"{table}.{k}", buckets).withColumn("segment", F.lit(k)) for k in numbers]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    left = union("gone")
    if gone is not None:
        left = left.unionByName(gone.select("chunk_id", F.lit(numbers[-1] + 1).alias("segment")))
    sizes = store.read(active, "bags").select("chunk_id", "kb_id", "length", "values")
    return lexical.Index(None, sizes, lambda b: union("blocks", b), lambda b: union("terms", b).drop("segment"), union("sums").drop("segment"), left, store.buckets(active))
