"""Documents, chunks and their search index brought up to date, bucket by bucket."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import lexical, segments, sync
from granary.operators.chunking import chunked
from granary.sources.store import Patch, Store, bucket_of

DOCUMENTS = ", ".join(f"{c} string" for c in sync.DOCUMENT)
CHUNKS = "chunk_id string, doc_id string, heading string, start_line int, end_line int, text string"


def described(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks with their documents' columns."""
    d = documents.select(F.col("id").alias("doc_id"), "kb_id", "path", "title", "metadata", "source_hash")
    return chunks.join(d, "doc_id").withColumn("values", lexical.metadata_values(F.col("metadata")))


def table(store: Store, active: dict[str, Any] | None, name: str, buckets: set[int] | None = None) -> DataFrame:
    """A generation's table; an empty one if there is no generation."""
    if active and name in active["places"]:
        return store.read(active, name, buckets)
    return store.spark.createDataFrame([], {"documents": DOCUMENTS, "chunks": CHUNKS, "bags": segments.BAGS}[name])


def advance(store: Store, statuses: DataFrame, files: Callable[[DataFrame], DataFrame], chunk_chars: int, facts: Callable[[dict[str, DataFrame]], dict[str, Any]], keep: Callable[[DataFrame, str], DataFrame]) -> int:
    """The next generation of a store under its lock: how many chunks were written.

    statuses: (id, status), a stored table. files(ids) gives (id, kb_id, path, source_hash, content) of those that were added or
    updated. Only these are parsed and tokenized, and only the buckets of what was added, updated or deleted are written; the
    rest, and the index of the rest, are the files that they were. Nothing changed: no new generation. keep stores a table for the
    time of the build; facts are for the manifest, from the tables as written; it also has the digests of the version's buckets.
    """
    active = store.active()
    n = store.buckets(active)
    changed = statuses.where("status <> 'unchanged'").select("id", "status", bucket_of(F.col("id"), n).alias("bucket"))
    touched = frozenset(r.bucket for r in changed.select("bucket").distinct().collect())
    if active and not touched:
        return 0
    left = changed.where("status <> 'added'").select("id")
    parsed = keep(chunked(files(changed.where("status <> 'deleted'").select("id")), chunk_chars), "parsed")
    rows = sync.chunk_rows(parsed)
    fresh = keep(segments.bagged(described(parsed, rows)), "fresh")
    old = {name: table(store, active, name, set(touched)) for name in ("documents", "chunks", "bags")}
    of_left = left.withColumnRenamed("id", "doc_id")
    gone = keep(old["bags"].join(of_left, "doc_id", "left_semi"), "gone")
    index, held, without = segments.added(store, active, fresh, gone)

    def patch(name: str, key: str, new: DataFrame) -> Patch:
        same = old[name].join(left.withColumnRenamed("id", key), key, "left_anti").select(*new.columns)
        return Patch(same.unionByName(new).withColumn("bucket", bucket_of(F.col(key), n)), touched)

    tables = {
        "documents": patch("documents", "id", parsed.select(*sync.DOCUMENT)),
        "chunks": patch("chunks", "doc_id", rows.select(*sync.CHUNK)),
        "bags": patch("bags", "doc_id", fresh.select(*segments.BAG)),
        **index,
    }

    def manifest(there: dict[str, DataFrame]) -> dict[str, Any]:
        mine = there["documents"].where(bucket_of(F.col("id"), n).isin(sorted(touched)))
        digests = {k: v for k, v in (active or {}).get("digests", {}).items() if int(k) not in touched} | sync.leaves(sync.version_tree(mine, n))
        return facts(there) | {"segments": held, "digests": digests}

    store.publish(tables, manifest, "text", active, without)
    return fresh.count()
