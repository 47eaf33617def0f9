"""An extension: a stream of changed documents kept in step with a snapshot by the same hashes."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import snapshot, sync
from granary.operators.chunking import pipeline_hash
from granary.sources.store import Store, bucket_of


def follow(arrivals: DataFrame, store: Store, chunk_chars: int, checkpoint: str | Path, **trigger):
    """Applies a stream of documents (id, kb_id, path, source_hash, content) to a store, batch by batch.

    A batch should hold one version of a document; of several that of the greatest hash is taken, as their order is unknown. What
    a batch doesn't name stays: a stream says nothing of deletions. Each batch that changes something is a generation of its own,
    published whole, of which only the buckets and the index segment of its documents are written; a batch that comes again after
    a failure changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        with store.lock(), store.staging() as keep:
            one = batch.groupBy("id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "id"]), "source_hash").alias("r")).select("id", "r.*")
            one = keep(one, "arrived")
            active = store.active()
            named = {r.b for r in one.select(bucket_of(F.col("id"), store.buckets(active)).alias("b")).distinct().collect()}
            there = snapshot.table(store, active, "documents", named).join(one.select("id"), "id", "left_semi")
            statuses = keep(sync.changes(one.select("id", "source_hash", F.lit(pipeline_hash(chunk_chars)).alias("pipeline_hash")), there), "statuses")
            snapshot.advance(store, statuses, lambda ids: one.join(ids, "id", "left_semi"), chunk_chars, lambda _: {}, keep)

    return arrivals.writeStream.foreachBatch(apply).option("checkpointLocation", str(checkpoint)).trigger(**(trigger or {"availableNow": True})).start()
