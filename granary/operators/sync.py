"""Incremental synchronisation of a snapshot by content hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.identity import chunk_id
from granary.operators.chunking import chunked, pipeline_hash
from granary.sources.store import bucket_of

DOCUMENT = ["id", "kb_id", "path", "source_hash", "pipeline_hash", "title", "metadata", "content"]
CHUNK = ["chunk_id", "doc_id", "heading", "start_line", "end_line", "text"]


def changes(incoming: DataFrame, indexed: DataFrame) -> DataFrame:
    """(id, status): added, updated, unchanged or deleted, from (id, source_hash, pipeline_hash) of both sides."""
    i, d = incoming.alias("i"), indexed.alias("d")
    same = (F.col("i.source_hash") == F.col("d.source_hash")) & (F.col("i.pipeline_hash") == F.col("d.pipeline_hash"))
    status = F.when(F.col("d.id").isNull(), "added").when(F.col("i.id").isNull(), "deleted").when(same, "unchanged").otherwise("updated")
    return i.join(d, F.col("i.id") == F.col("d.id"), "full").select(F.coalesce("i.id", "d.id").alias("id"), status.alias("status"))


def version_tree(versions: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, digest) of versions (id, source_hash): the leaves of a hash tree, those of equal versions are equal.

    A bucket's digest is of its number of documents and of sums of parts of their digests, so a task sends a row for each bucket
    and no order is needed; it tells versions apart, but isn't made to withstand somebody who looks for a collision.
    """
    each = F.sha2(F.concat_ws(":", F.length("id").cast("string"), "id", "source_hash"), 256)
    parts = [F.conv(F.substring(each, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    rows = versions.select(bucket_of(F.col("id"), buckets).alias("bucket"), *[p.alias(f"p{k}") for k, p in enumerate(parts)])
    sums = rows.groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(4)])
    return sums.select("bucket", "n", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "p0", "p1", "p2", "p3")]), 256).alias("digest"))


def leaves(tree: DataFrame) -> dict[str, str]:
    """A version tree's digests by bucket, as a manifest holds them."""
    return {str(r.bucket): r.digest for r in tree.collect()}


def unlike(a: dict[str, str], b: dict[str, str]) -> frozenset[int]:
    """The buckets in which two versions differ."""
    return frozenset(int(k) for k in {*a, *b} if a.get(k) != b.get(k))


def changed_versions(a: DataFrame, b: DataFrame, buckets: int = 64) -> DataFrame:
    """id of the documents that only one of two tables (id, source_hash) has, or both in unlike versions. Rows of buckets with
    equal digests are never compared."""
    differ = sorted(unlike(leaves(version_tree(a, buckets)), leaves(version_tree(b, buckets))))
    x, y = (t.select("id", "source_hash").where(bucket_of(F.col("id"), buckets).isin(differ)) for t in (a, b))
    met = x.alias("x").join(y.alias("y"), F.col("x.id") == F.col("y.id"), "full")
    return met.where(~F.col("x.source_hash").eqNullSafe(F.col("y.source_hash"))).select(F.coalesce("x.id", "y.id").alias("id"))


def chunk_rows(documents: DataFrame) -> DataFrame:
    """A row for each chunk of chunked documents, named by document, versions and lines."""
    each = documents.select("id", "source_hash", "pipeline_hash", F.explode("chunks").alias("c"))
    name = chunk_id(F.col("id"), F.col("source_hash"), F.col("pipeline_hash"), F.col("c.start_line"), F.col("c.end_line"))
    return each.select(name.alias("chunk_id"), F.col("id").alias("doc_id"), "c.heading", "c.start_line", "c.end_line", "c.text")


def synchronised(files: DataFrame, documents: DataFrame, chunks: DataFrame, chunk_chars: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, statuses) of the next snapshot. files: id, kb_id, path, source_hash, content.

    Only files that are new or have other hashes are parsed; the others' rows are taken over. keep may store the parsed files,
    as both documents and chunks come from them.
    """
    statuses = changes(files.select("id", "source_hash", F.lit(pipeline_hash(chunk_chars)).alias("pipeline_hash")), documents)
    fresh = keep(chunked(files.join(statuses.where("status in ('added', 'updated')"), "id", "left_semi"), chunk_chars))
    same = statuses.where("status = 'unchanged'")
    all_documents = fresh.select(*DOCUMENT).unionByName(documents.join(same, "id", "left_semi").select(*DOCUMENT))
    all_chunks = chunk_rows(fresh).unionByName(chunks.join(same.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(*CHUNK))
    return all_documents, all_chunks, statuses


def counters(statuses: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, bytes_read, added, updated, unchanged, deleted."""
    one = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s)
    by_status = statuses.agg(*[one(s) for s in ("added", "updated", "unchanged", "deleted")])
    read = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_read"))
    return read.crossJoin(by_status)
