"""A collection of vectors with a fixed contract: points in buckets by document, deletions as bitmaps beside them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import identity, vectors
from granary.functions.embeddings import Spec
from granary.operators import deletions, dense
from granary.operators.lexical import bounded, metadata_values
from granary.sources.store import Append, Store, Trace, bucket_of, storage_bytes, write_whole

POINT = "kb_id string, doc_id string, chunk_id string, unit_id string, source_hash string, vector array<double>, metadata string"
#: What names a point, with the contract.
NAMING = ("kb_id", "doc_id", "chunk_id", "unit_id")


@dataclass(frozen=True)
class Contract:
    """What a collection's vectors are of: a model, a corpus version, and the documents' hashes by id."""

    spec: Spec
    corpus: str
    sources: tuple[tuple[str, str], ...]

    @property
    def id(self) -> str:
        return identity.digest(identity.canonical(asdict(self)))

    @property
    def record(self) -> dict[str, Any]:
        """What a collection's folder says of it."""
        return {"dimension": self.spec.dimension, "distance": self.spec.distance, "contract_id": self.id}

    def faults(self, points: DataFrame) -> DataFrame:
        """(point_id, fault) of points that the contract doesn't allow: a blank name, a document that it doesn't have in that
        version or that is named unlike its knowledge base, a repeated name, a faulty vector."""
        known = bounded(points.sparkSession.createDataFrame(list(self.sources), "_doc string, _hash string"), 1_000_000)
        blank = F.exists(F.array(*NAMING, "source_hash"), lambda x: F.coalesce(F.trim(x), F.lit("")) == "")
        version = F.coalesce(F.col("_hash") == F.col("source_hash"), F.lit(False)) & F.coalesce(F.col("doc_id").startswith(F.concat("kb_id", F.lit(":"))), F.lit(False))
        said = F.when(blank, "name").when(~version, "version").otherwise(vectors.fault(F.col("vector"), self.spec.dimension, self.spec.distance, self.spec.normalize))
        each = points.join(known, F.col("doc_id") == F.col("_doc"), "left").select("point_id", said.alias("fault")).where("fault is not null")
        return each.unionByName(points.groupBy("point_id").count().where("count > 1").select("point_id", F.lit("repeated").alias("fault")))

    def named(self, points: DataFrame) -> DataFrame:
        """points with point_id."""
        name = identity.json_array(identity.json_text(F.lit(self.id)), *[identity.json_text(F.col(c)) for c in NAMING])
        return points.withColumn("point_id", identity.uuid5(name))


class VectorStore(Protocol):
    """Where vectors are kept and searched. Calls after close are errors."""

    def create(self) -> bool: ...

    def upsert(self, points: DataFrame) -> int: ...

    def search(self, vector: list[float], kb_ids: list[str] | None = None, filters: dict | None = None, top_k: int = 5) -> list[dict[str, Any]]: ...

    def count(self, kb_ids: list[str] | None = None) -> int: ...

    def delete_documents(self, doc_ids: list[str]) -> int: ...

    def close(self) -> None: ...


class Collection:
    """A VectorStore under a folder. A change is a generation, published whole or not at all: new points are added files, and
    what they replace, like what is deleted, is a bit in a bitmap. compact() writes crowded buckets anew."""

    def __init__(self, spark: SparkSession, contract: Contract, folder: str | Path, traces: str | Path | None = None, buckets: int | None = None):
        self.spark, self.contract, self.folder = spark, contract, Path(folder)
        self.traces = Path(traces or self.folder / "traces.jsonl")
        self.store: Store | None = Store(spark, self.folder / "points", buckets)

    # --- what every operation passes -----------------------------------------------------------------------------------

    @contextmanager
    def _at_work(self, operation: str, stage: str, writes: bool = False, **facts: Any) -> Iterator[Trace]:
        """An operation of an open collection, timed as a trace; one writer at a time."""
        if self.store is None:
            raise ValueError("the collection is closed")
        with Trace(self.traces, f"vector_{operation}", contract_id=self.contract.id, **facts) as trace:
            self._match(missing=operation == "create")
            if not writes:
                with trace.stage(stage):
                    yield trace
                return
            with self.store.lock(), trace.stage(stage):
                yield trace

    def _match(self, missing: bool) -> None:
        """The folder's record is the contract's; missing: there may be none yet."""
        place = self.folder / "collection.json"
        if not place.exists():
            if missing:
                return
            raise ValueError("the collection hasn't been created")
        there, mine = json.loads(place.read_text("utf-8")), self.contract.record
        if unlike := sorted(k for k in mine if mine[k] != there.get(k)):
            raise ValueError(f"the collection has another schema: {unlike}")

    def _points(self, buckets: set[int] | None = None) -> DataFrame:
        """Live points with their places."""
        if active := self.store.active():
            return deletions.alive(self.store, active, "points", buckets)
        return self.spark.createDataFrame([], f"{POINT}, point_id string, _file string, _page long, _bit long")

    def _change(self, fresh: DataFrame | None, dead: DataFrame) -> None:
        """A generation with fresh points and without the placed ones of dead."""
        active = self.store.active()
        marks = deletions.marked(dead)
        vectors_ = deletions.joined(self.store.read(active, "points.dead"), marks) if active else marks
        tables: dict[str, Any] = {"points.dead": vectors_}
        if fresh is not None:
            tables["points"] = Append(fresh.withColumn("bucket", bucket_of(F.col("doc_id"), self.store.buckets(active))))
        self.store.publish(tables, {}, "points", active)

    def _buckets(self, doc_ids: DataFrame) -> set[int]:
        return {r.b for r in doc_ids.select(bucket_of(F.col("doc_id"), self.store.buckets(self.store.active())).alias("b")).distinct().collect()}

    # --- the protocol --------------------------------------------------------------------------------------------------

    def create(self) -> bool:
        """Whether it was made now; one of another schema is an error and stays as it is."""
        with self._at_work("create", "schema") as trace:
            fresh = not (self.folder / "collection.json").exists()
            if fresh:
                write_whole(self.folder / "collection.json", json.dumps(self.contract.record), fresh=True)
            trace.facts["created"] = fresh
        return fresh

    def upsert(self, points: DataFrame) -> int:
        """Adds points (POINT) or puts them in place of their namesakes; how many. One faulty point refuses all of them. Only the
        buckets of the points' documents are looked at."""
        with self._at_work("upsert", "write", writes=True), self.store.staging() as keep:
            batch = keep(self.contract.named(points), "batch")
            if bad := self.contract.faults(batch).limit(5).collect():
                raise ValueError(f"refused points: {[tuple(r) for r in bad]}")
            old = self._points(self._buckets(batch)).join(batch.select("point_id"), "point_id", "left_semi")
            self._change(batch, old)
            return batch.count()

    def search(self, vector: list[float], kb_ids: list[str] | None = None, filters: dict | None = None, top_k: int = 5) -> list[dict[str, Any]]:
        """The best points within the scope, with their payload and score. A point without a finite score, or a hit from outside
        the scope, is an error."""
        with self._at_work("search", "rank", top_k=top_k):
            asked = self.contract.spec.checked(vector)
            if kb_ids is not None and not set(kb_ids) <= {d.split(":", 1)[0] for d, _ in self.contract.sources}:
                raise ValueError("no such knowledge bases")
            raw = [("q", asked, kb_ids, identity.canonical(filters) if filters else None)]
            q = self.spark.createDataFrame(raw, "query_id string, vector array<double>, kb_ids array<string>, _f string")
            q = q.withColumn("filters", F.when(F.col("_f").isNotNull(), metadata_values(F.col("_f"))))
            points = self._points().withColumn("values", metadata_values(F.col("metadata")))
            hits = dense.nearest(points, q, top_k, self.contract.spec.distance, strict=True)
            hits = self.spark.createDataFrame(hits.collect(), hits.schema)
            if bad := dense.hit_faults(hits, points, q).limit(5).collect():
                raise ValueError(f"the search returned what it mustn't: {[tuple(r) for r in bad]}")
            rows = hits.join(points.drop("vector", "values", "_file", "_page", "_bit"), "point_id").orderBy("rank").collect()
        return [{k: v for k, v in r.asDict().items() if k not in ("query_id", "rank")} | {"metadata": json.loads(r.metadata)} for r in rows]

    def count(self, kb_ids: list[str] | None = None) -> int:
        with self._at_work("count", "scan"):
            points = self._points()
            return (points if kb_ids is None else points.where(F.col("kb_id").isin(kb_ids))).count()

    def delete_documents(self, doc_ids: list[str]) -> int:
        """How many points of the documents there were; they are gone. Bitmaps are written, no points."""
        with self._at_work("delete_documents", "write", writes=True), self.store.staging() as keep:
            named = self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string").distinct()
            places = self._points(self._buckets(named)).join(named, "doc_id", "left_semi").select("_file", "_page", "_bit")
            dead = keep(places, "dead")
            if gone := dead.count():
                self._change(None, dead)
            return gone

    def compact(self) -> int:
        """Writes crowded buckets anew, without dead points; how many."""
        with self._at_work("compact", "write", writes=True):
            active = self.store.active()
            crowded = deletions.crowded(self.store, active, "points") if active else frozenset()
            if crowded:
                self.store.publish(deletions.compacted(self.store, active, "points", "doc_id", crowded), {}, "points", active)
            return len(crowded)

    def storage_bytes(self) -> int:
        return storage_bytes(self.folder)

    def close(self) -> None:
        self.store = None

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_) -> None:
        self.close()
