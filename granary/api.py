"""The engine as users call it: index, search, read, build vectors, evaluate, compare, preview and connect sources."""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, replace
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import identity, text, vectors
from granary.functions.embeddings import Hashed, Provider, encoded, unit_windows
from granary.operators import dense, evaluate, lexical, segments, snapshot, sync, windows
from granary.operators.chunking import PARSER_VERSION, pipeline_hash
from granary.sources.config import EXCLUDE, INCLUDE, Config, Source, dump_config
from granary.provenance import MACHINE, peak_memory, provenance
from granary.sources.files import hash_files, read_cases, read_files, read_traces, stat_files
from granary.sources.store import Store, Trace, bucket_of, storage_bytes, write_whole

# Fixed value: the rules by which hits are credited.
BENCHMARK_VERSION = "evidence-visible-v1"
#: What two reports must have in common to be compared.
COMPARABLE = ("schema_version", "benchmark_version", "dataset_hash", "corpus_hash", "top_k", "max_chars", "repeats", "warmup")


def _unlike(runs: DataFrame, n: int) -> DataFrame:
    """Hits (run, case_id, rank, ...) that some run of n doesn't have; scores agree up to rounding."""
    same = runs.groupBy("case_id", "rank").agg(F.countDistinct("run").alias("runs"), F.countDistinct("chunk_id", "doc_id", "kb_id", "text").alias("kinds"), F.min("score").alias("low"), F.max("score").alias("high"))
    near = F.col("high") - F.col("low") <= F.greatest(F.lit(1e-7), F.lit(1e-6) * F.greatest(F.abs("low"), F.abs("high")))
    return same.where((F.col("runs") < n) | (F.col("kinds") > 1) | ~near)


class Engine:
    """Retrieval over the knowledge bases of a configuration, on a Spark session."""

    def __init__(self, spark: SparkSession, config: Config, provider: Provider | None = None):
        self.spark, self.config = spark, config
        self.provider = provider or Hashed()
        self.store, self.dense_store = Store(spark, config.storage / "text"), Store(spark, config.storage / "vectors")

    # --- index ---------------------------------------------------------------------------------------------------------

    @property
    def kb_ids(self) -> list[str]:
        return [s.id for s in self.config.sources]

    def scope_hash(self) -> str:
        """What a vector generation was made for; another set of sources or chunk size makes it invisible."""
        return identity.digest([self.config.chunk_chars, self.config.max_file_bytes, [[s.id, str(s.root), list(s.include), list(s.exclude)] for s in self.config.sources], PARSER_VERSION])

    def _tables(self, store: Store, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
        active = store.active(scope)
        return snapshot.table(store, active, "documents"), snapshot.table(store, active, "chunks")

    def index(self) -> dict[str, Any]:
        """Brings the snapshot and its search index up to date with the files; all or nothing. Sources that are no longer
        configured go. All files are hashed; those that changed are read again and parsed, and only their buckets and an index
        segment of theirs are written. A file that changes in between is an error."""
        with Trace(self.config.traces, "ingest") as trace:
            with self.store.lock(), self.store.staging() as keep:
                with trace.stage("scan"):
                    hashed = keep(hash_files(self.spark, self.config.sources, self.config.max_file_bytes), "hashed")
                    version = F.lit(pipeline_hash(self.config.chunk_chars)).alias("pipeline_hash")
                    statuses = keep(sync.changes(hashed.select("id", "source_hash", version), snapshot.table(self.store, self.store.active(), "documents")), "statuses")

                def files(ids: DataFrame) -> DataFrame:
                    read = read_files(self.spark, self.config.sources, self.config.max_file_bytes, ids)
                    seen = hashed.select("id", F.col("source_hash").alias("_seen"))
                    same = F.when(F.col("source_hash") == F.col("_seen"), F.col("source_hash")).otherwise(F.raise_error(F.concat("id", F.lit(" changed during the build"))))
                    return read.join(seen, "id").withColumn("source_hash", same).drop("_seen")

                with trace.stage("parse_chunk"):
                    written = snapshot.advance(self.store, statuses, files, self.config.chunk_chars, lambda _: {}, keep)
                counts = sync.counters(statuses, hashed).first().asDict() | {"chunks_written": written}
            trace.facts["counts"] = counts
        return counts | {"trace_id": trace.id, "operation_ms": trace.ms}

    @staticmethod
    def corpus_hash(documents: DataFrame) -> str:
        row = identity.corpus_hash(documents).first()
        return row.corpus_hash if row else identity.digest("[]")

    def _snapshot(self) -> tuple[Store, str | None]:
        """Where searches read: the vector generation's snapshot, if it is active, else the text's."""
        return (self.dense_store, self.scope_hash()) if self.dense_store.active(self.scope_hash()) else (self.store, None)

    def chunks(self) -> DataFrame:
        """Chunks with their documents' columns, of configured sources only."""
        documents, chunks = self._tables(*self._snapshot())
        return snapshot.described(documents.where(F.col("kb_id").isin(self.kb_ids)), chunks)

    def search_index(self) -> lexical.Index:
        """The stored index of the same chunks."""
        store, scope = self._snapshot()
        active = store.active(scope)
        if not active:
            return lexical.indexed(self.chunks())
        return segments.stored(store, active).of(self.kb_ids)

    def list_knowledge_bases(self) -> DataFrame:
        documents = self._tables(self.store)[0]
        return documents.where(F.col("kb_id").isin(self.kb_ids)).groupBy("kb_id").agg(F.count("*").alias("documents")).orderBy("kb_id")

    # --- search --------------------------------------------------------------------------------------------------------

    def _checked(self, query: str, kb_ids: list[str] | None, top_k: int, max_chars: int) -> None:
        if not query.strip() or len(query) > 2000:
            raise ValueError("a query has 1 to 2000 characters")
        if not 1 <= top_k <= 50 or not 1 <= max_chars <= 20_000:
            raise ValueError("top_k is 1 to 50, max_chars 1 to 20000")
        if kb_ids is not None and (not kb_ids or not set(kb_ids) <= set(self.kb_ids)):
            raise ValueError("no such knowledge bases")

    def _queries(self, rows: Iterable[tuple[str, str, list[str] | None, dict | None]], top_k: int, max_chars: int) -> DataFrame:
        """Queries (id, text, kb_ids, filters) as search takes them."""
        raw = [(i, q, kb, None if not f else identity.canonical(f), top_k, max_chars) for i, q, kb, f in rows]
        df = self.spark.createDataFrame(raw, "query_id string, text string, kb_ids array<string>, _f string, top_k int, max_chars int")
        return df.withColumn("filters", F.when(F.col("_f").isNotNull(), lexical.metadata_values(F.col("_f")))).drop("_f")

    def search_many(self, queries: DataFrame, strategy: str = "bm25", keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
        """Hits of many queries (query_id, text, kb_ids, filters, top_k, max_chars). keep stores a table for the time of the
        search, as a cache does; with it BM25 without filters reads only the postings that can matter."""
        if strategy != "dense":
            return lexical.search(self.chunks(), queries, strategy, self.search_index(), keep)
        active = self.dense_store.active(self.scope_hash())
        if not active:
            raise RuntimeError("no vector generation for this scope: build one first")
        if active["spec"] != asdict(self.provider.spec):
            raise RuntimeError("the vector generation was made with another model")
        asked = queries.select(F.col("query_id").alias("key"), windows.prepared(F.col("text"), "query", self.provider.spec.template_version).alias("text"))
        q = queries.drop("text").join(encoded(asked, self.provider).withColumnRenamed("key", "query_id"), "query_id")
        points = self.dense_store.read(active, "points").join(self.search_index().sizes.select("chunk_id", "values"), "chunk_id")
        if dense.resolved(points, self.chunks()).limit(1).count():
            raise RuntimeError("vectors and texts of the generation don't agree")
        return dense.search(points, self.chunks(), q, self.provider.spec.distance)

    def search(self, query: str, kb_ids: list[str] | None = None, top_k: int = 5, max_chars: int = 4000, filters: dict | None = None, strategy: str = "bm25") -> dict[str, Any]:
        """One query's hits with citations. Filters must equal the metadata (a null one: key missing or null)."""
        self._checked(query, kb_ids, top_k, max_chars)
        if strategy == "dense" and any(not isinstance(v, str | bool | int | float) for v in (filters or {}).values()):
            raise ValueError("dense filters must be texts, numbers or truth values")
        with Trace(self.config.traces, "search", query_hash=identity.digest(query), strategy=strategy, tokenizer=text.TOKENIZER_VERSION, kb_ids=kb_ids, top_k=top_k, max_chars=max_chars, filter_keys=sorted(filters or {})) as trace, trace.stage("rank"):
            held: list[DataFrame] = []
            rows = self.search_many(self._queries([("q", query, kb_ids, filters)], top_k, max_chars), strategy, lambda df, _: held.append(df.cache()) or held[-1]).orderBy("rank").collect()
            for df in held:
                df.unpersist()
        keys = ("chunk_id", "doc_id", "kb_id", "path", "title", "heading", "source_hash", "start_line", "end_line", "score", "text", "truncated")
        hits = [{k: r[k] for k in keys} | {"metadata": json.loads(r["metadata"])} for r in rows]
        return {"trace_id": trace.id, "status": "candidates_found" if hits else "no_evidence", "content_chars": sum(len(h["text"]) for h in hits), "hits": hits}

    def read_document(self, doc_id: str, start_line: int = 1, max_chars: int = 4000, source_hash: str | None = None) -> dict[str, Any]:
        """Part of a document from a line on; an error if it is unknown, hidden, or of another version than asked for."""
        if start_line < 1 or not 1 <= max_chars <= 20_000:
            raise ValueError("start_line begins at 1, max_chars is 1 to 20000")
        documents = self._tables(self.store)[0].where((F.col("id") == doc_id) & F.col("kb_id").isin(self.kb_ids))
        got = text.read_slice(F.col("content"), start_line, max_chars)
        row = documents.select("id", "title", "metadata", "source_hash", *[c.alias(k) for k, c in got.items()]).first()
        if row is None:
            raise ValueError("unknown document")
        if source_hash is not None and row.source_hash != source_hash:
            raise ValueError("the document has another version")
        if not row.valid:
            raise ValueError("start_line is behind the document's end")
        return {"doc_id": row.id, "title": row.title, "metadata": json.loads(row.metadata), "source_hash": row.source_hash, "start_line": start_line, "end_line": row.end_line, "text": row.text, "truncated": row.truncated}

    # --- vectors -------------------------------------------------------------------------------------------------------

    def build_vector(self) -> dict[str, Any]:
        """A new generation: snapshot, windows, vectors (from the cache where it has them), checks, then the pointer.

        A failure leaves the active generation as it was, and a report of it.
        """
        report: dict[str, Any] = {"status": "failed", "started": datetime.now(UTC).isoformat()}
        with self.dense_store.lock(), Trace(self.config.traces, "build_vector") as trace:
            try:
                before = self._versions()
                with trace.stage("snapshot"):
                    self.index()
                    documents, chunks = self._tables(self.store)
                    text_generation = self.store.active()
                    source = documents.select(F.col("id").alias("doc_id"), "kb_id", "source_hash", "title")
                with trace.stage("token_windows"):
                    context = F.concat_ws("\n", "title", "heading", F.lit(""))
                    prefix = F.lit(windows.PREFIXES[self.provider.spec.template_version]["passage"])
                    units = unit_windows(chunks.join(source, "doc_id").select("chunk_id", F.concat(prefix, context).alias("context"), "text"), self.provider)
                    units = units.withColumn("key", windows.cache_key(F.lit(self.provider.spec.fingerprint), "passage", F.col("text"))).cache()
                    tables = units.count()
                with trace.stage("encode"):
                    cache_path = self.config.storage / "embedding-cache"
                    cache = self.spark.read.parquet(str(cache_path)) if cache_path.exists() else self.spark.createDataFrame([], "key string, vector array<double>")
                    lacking = windows.missing(units.select("key", "text", "tokens"), cache)
                    misses, encoded_tokens = lacking.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
                    encoding = {"hits": tables - units.join(lacking.select("key"), "key", "left_semi").count(), "misses": misses, "encoded_tokens": encoded_tokens, "encode_calls": int(misses > 0), "encode_ms": 0.0}
                    if misses:
                        began = time.perf_counter()
                        encoded(lacking, self.provider).write.mode("append").parquet(str(cache_path))
                        encoding["encode_ms"] = 1000 * (time.perf_counter() - began)
                        cache = self.spark.read.parquet(str(cache_path)).dropDuplicates(["key"])
                found = windows.remembered(units.select("chunk_id", "start", "end", "tokens", "key"), cache, self.spark.createDataFrame([], "key string, vector array<double>"))
                point = identity.unit_id(F.col("chunk_id"), F.col("start"), F.col("end"), F.lit(self.provider.spec.fingerprint))
                points = found.join(chunks.select("chunk_id", "doc_id"), "chunk_id").join(source.drop("title"), "doc_id").select(point.alias("point_id"), "chunk_id", "doc_id", "kb_id", "source_hash", "start", "end", "vector")
                counts = units.groupBy("chunk_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("points"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("split_chunks"), F.coalesce(F.sum("t"), F.lit(0)).alias("input_tokens")).first().asDict()

                def manifest(there: dict[str, DataFrame]) -> dict[str, Any]:
                    """Checks the points as written; the pointer moves only if they hold."""
                    with trace.stage("verify"):
                        spec, made = self.provider.spec, there["points"]
                        if bad := made.where(vectors.fault(F.col("vector"), spec.dimension, spec.distance, spec.normalize).isNotNull()).limit(1).count():
                            raise ValueError(f"{bad} faulty vectors")
                        if made.select("point_id").distinct().count() != tables or self._versions() != before:
                            raise RuntimeError("sources changed during the build")
                    report.update(documents=documents.count(), chunks=chunks.count())
                    return {"spec": asdict(self.provider.spec), "corpus_hash": self.corpus_hash(documents), "segments": text_generation["segments"], "sources": before, "documents": report["documents"], **counts}

                with trace.stage("publish"):
                    # documents, chunks and index are the text generation's own folders
                    generation = self.dense_store.publish({"points": points}, manifest, self.scope_hash(), text_generation)
                units.unpersist()
                report |= {"status": "ready", "generation": generation, "cache_misses": misses, "encoding": encoding, "embedding_spec": asdict(self.provider.spec), "storage_bytes": storage_bytes(self.dense_store.folder(generation)), "process_memory": peak_memory(), **counts}
            except Exception as error:
                report["error_type"] = type(error).__name__
                raise
            finally:
                write_whole(self.dense_store.root / "last-build.json", json.dumps(report))
        return report | {"operation_ms": trace.ms, "stages_ms": dict(trace.line()["stages_ms"])}

    def _versions(self) -> dict[str, str]:
        """Digests by bucket of all sources' files as they are now."""
        return sync.leaves(sync.version_tree(hash_files(self.spark, self.config.sources), self.store.buckets(self.store.active())))

    def vector_status(self) -> dict[str, Any]:
        """not_built, ready, stale (sources or model changed) or failed (the last build did, whatever is active); of a stale one
        how many documents changed. Versions are compared by their buckets' digests, and only buckets that differ are read."""
        active, last = self.dense_store.active(self.scope_hash()), self.dense_store.root / "last-build.json"
        status: dict[str, Any] = {"status": "not_built", "has_ready_generation": bool(active)}
        if active:
            differ = sync.unlike(active["sources"], self._versions())
            fresh = not differ and active["spec"] == asdict(self.provider.spec)
            status |= {"changed_documents": self._changed(active, differ) if differ else 0}
            status |= {"status": "ready" if fresh else "stale", "generation": active["generation"], "contract_id": active["contract_id"], "points": active["points"], "documents": active["documents"]}
        if last.exists() and (attempt := json.loads(last.read_text("utf-8")))["status"] == "failed":
            status |= {"status": "failed", "last_build_status": attempt["status"]}
        return status

    def _changed(self, active: dict[str, Any], buckets: frozenset[int]) -> int:
        """Documents of some buckets whose files differ from a generation's."""
        n = self.dense_store.buckets(active)
        now = hash_files(self.spark, self.config.sources).where(bucket_of(F.col("id"), n).isin(sorted(buckets)))
        then = self.dense_store.read(active, "documents", buckets)
        return sync.changed_versions(now, then, n).count()

    # --- evaluation ----------------------------------------------------------------------------------------------------

    def run_benchmark(self, cases_path: str | Path, output: str | Path, strategy: str = "bm25", top_k: int = 5, max_chars: int = 4000, repeats: int = 1, warmup: int = 0, seed: int = 42) -> dict[str, Any]:
        """Scores labelled cases over an index of its own, so that the live one stays; writes report, cases and summary to a
        new folder. Every case is a search of its own, timed by itself, in a seeded order that each repeat shuffles anew. Hits are
        a table of the run; repeats must agree."""
        if repeats < 1 or warmup < 0:
            raise ValueError("repeats begin at 1, warmup at 0")
        self._checked("x", None, top_k, max_chars)
        run_id = f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"
        folder = Path(output) / run_id
        folder.mkdir(parents=True)
        own = Engine(self.spark, replace(self.config, storage=folder / "index"), self.provider)
        cases = read_cases(self.spark, str(cases_path)).withColumnRenamed("id", "case_id")
        labels = cases.select("case_id", F.explode("relevant").alias("r")).select("case_id", "r.doc_id", "r.contains")
        built = own.build_vector() if strategy == "dense" else own.index()
        documents = own._tables(own.store)[0]
        faults = evaluate.label_faults(cases, labels, documents.select(F.col("id").alias("doc_id"), "kb_id", "content", lexical.metadata_values(F.col("metadata")).alias("values"))).collect()
        if faults:
            raise ValueError(f"labels can't be earned: {[tuple(f) for f in faults[:5]]}")
        asked = cases.select(F.col("case_id").alias("query_id"), "category", F.col("query").alias("text"), "kb_ids", "filters", F.lit(top_k).alias("top_k"), F.lit(max_chars).alias("max_chars"))
        order = sorted((r.query_id, r.category) for r in asked.select("query_id", "category").collect())
        latencies: dict[str, list[float]] = {case: [] for case, _ in order}
        measured, draw = set(), random.Random(seed)
        columns = ("case_id", "rank", "chunk_id", "doc_id", "kb_id", "score", "text")
        for k in range(warmup + repeats):
            draw.shuffle(order)
            for case, _ in order:
                held: list[DataFrame] = []
                with Trace(own.config.traces, "search_many", strategy=strategy, top_k=top_k, max_chars=max_chars) as trace, trace.stage("rank"):
                    hits = own.search_many(asked.where(F.col("query_id") == case).drop("category"), strategy, lambda df, _: held.append(df.cache()) or held[-1]).withColumnRenamed("query_id", "case_id")
                    hits.select(*columns).coalesce(1).write.mode("append").parquet(str(folder / "hits" / f"run={k}"))
                for df in held:
                    df.unpersist()
                if k >= warmup:
                    latencies[case].append(trace.ms)
                    measured.add(trace.id)
        runs = self.spark.read.parquet(str(folder / "hits"))
        if _unlike(runs, warmup + repeats).limit(1).count():
            raise RuntimeError("repeats don't agree")
        hits = runs.where(F.col("run") == warmup + repeats - 1).drop("run")
        results = evaluate.evaluated(cases, labels, hits, top_k).cache()
        raw = Path(cases_path).read_text("utf-8-sig")
        timed = self.spark.createDataFrame([(category, ms) for case, category in order for ms in latencies[case]], "category string, ms double")
        spread = {r.category: r for r in evaluate.percentiles(timed, "ms", (0.5, 0.95), ["category"]).unionByName(evaluate.percentiles(timed, "ms", (0.5, 0.95)).withColumn("category", F.lit(None).cast("string"))).collect()}
        shown = cases.select("case_id", "category").join(hits.groupBy("case_id").agg(F.sum(F.length("text")).alias("n")), "case_id", "left")
        chars = {r.category: r.chars for r in shown.rollup("category").agg(F.avg(F.coalesce("n", F.lit(0))).alias("chars")).collect()}
        metrics = []
        for r in evaluate.rolled_up(results).orderBy(F.desc("overall"), "category").collect():
            ms = spread[None if r.overall else r.category]
            metrics.append(r.asDict() | {"latency_p50_ms": ms.p50, "latency_p95_ms": ms.p95, "mean_content_chars": chars[None if r.overall else r.category]})
        report = {
            "schema_version": 1, "benchmark_version": BENCHMARK_VERSION, "run_id": run_id, "strategy": strategy, "top_k": top_k, "max_chars": max_chars, "repeats": repeats, "warmup": warmup,
            "dataset_hash": identity.digest([json.loads(x) for x in raw.splitlines() if x.strip()]), "corpus_hash": self.corpus_hash(documents), "config_hash": identity.digest(dump_config(self.config)),
            "settings": {"chunk_chars": self.config.chunk_chars, "tokenizer": text.TOKENIZER_VERSION, "bm25_k1": lexical.K1, "bm25_b": lexical.B, "timing_scope": "each case by itself"},
            "environment": provenance(), "indexing" if strategy != "dense" else "vector_build": built, "process_memory": peak_memory(),
            "mean_content_chars": metrics[0]["mean_content_chars"], "metrics": metrics, "stages_ms": self._stages(own.config.traces, measured),
            "queries": [r.asDict() | {"latencies_ms": latencies[r.case_id]} for r in results.orderBy("case_id").collect()],
        }
        write_whole(folder / "report.json", json.dumps(report, ensure_ascii=False, indent=1), fresh=True)
        write_whole(folder / "dataset.jsonl", raw, fresh=True)
        first = report["metrics"][0]
        write_whole(folder / "summary.md", "\n".join(f"- {k}: {v}" for k, v in first.items() if k not in ("category", "overall")) + "\n", fresh=True)
        results.unpersist()
        return report | {"folder": str(folder)}

    def _stages(self, traces: Path, ids: set[str]) -> dict[str, dict[str, float]]:
        """p50 and p95 of each stage over the traces of these ids; one that lacks a stage counts 0."""
        rows = read_traces(self.spark, str(traces)).where(F.col("trace_id").isin(sorted(ids)))
        names = sorted(r.k for r in rows.select(F.explode(F.map_keys("stages_ms")).alias("k")).distinct().collect())
        if not names:
            return {}
        each = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.coalesce(F.col("stages_ms")[n], F.lit(0.0)).alias("ms")) for n in names])).alias("s")).select("s.*")
        return {r.stage: {"p50": r.p50, "p95": r.p95} for r in evaluate.percentiles(each, "ms", (0.5, 0.95), ["stage"]).collect()}

    def compare(self, baseline: dict[str, Any], candidate: dict[str, Any], output: str | Path | None = None) -> dict[str, Any]:
        """Differences of metrics, by case and overall, the bootstrap interval of recall, and warnings; runs must be comparable.

        output: a file to write it to, which must not be there yet."""
        if unlike := [k for k in COMPARABLE if baseline.get(k) != candidate.get(k)]:
            raise ValueError(f"reports can't be compared: {', '.join(unlike)}")
        schema = "case_id string, category string, " + ", ".join(f"{m} double" for m in evaluate.METRICS)
        names = ["case_id", "category", *evaluate.METRICS]
        a, b = (self.spark.createDataFrame([tuple(float(q[n]) if n in evaluate.METRICS and q[n] is not None else q[n] for n in names) for q in r["queries"]], schema) for r in (baseline, candidate))
        if evaluate.unpaired(a, b).limit(1).count():
            raise ValueError("reports have other cases")
        pairs = a.select("case_id", F.col("recall_at_k").alias("baseline")).join(b.select("case_id", F.col("recall_at_k").alias("candidate")), "case_id")
        interval = evaluate.bootstrap(pairs).first()
        warnings = ["differences on a small development set describe it; they don't prove a general gain"]
        warnings += [f"{k} differs: latencies aren't comparable" for k in MACHINE if baseline.get("environment", {}).get(k) != candidate.get("environment", {}).get(k)]
        before, after = (r["metrics"][0] for r in (baseline, candidate))
        both = [k for k, v in before.items() if all(isinstance(x, int | float) and not isinstance(x, bool) for x in (v, after.get(k)))]
        result = {
            "baseline": baseline.get("run_id"), "candidate": candidate.get("run_id"), "metric_deltas": {k: after[k] - before[k] for k in both},
            "deltas": [r.asDict() for r in evaluate.deltas(a, b).orderBy("case_id", "metric").collect()], "recall_delta_95": [interval.low, interval.high], "warnings": warnings,
        }
        if output:
            write_whole(Path(output), json.dumps(result, ensure_ascii=False, indent=1), fresh=True)
        return result

    # --- onboarding ----------------------------------------------------------------------------------------------------

    def source(self, kb_id: str, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> Source:
        """A source as a user names it, checked: an absolute folder, patterns, and no clash with a configured one."""
        path = Path(root).expanduser()
        if not path.is_absolute():
            raise ValueError("the folder's path must be absolute")
        include, exclude = list(INCLUDE if include is None else include), list(EXCLUDE if exclude is None else exclude)
        if not include or len(include) + len(exclude) > 100 or any(not isinstance(p, str) or not 0 < len(p) <= 512 for p in include + exclude):
            raise ValueError("1 to 100 patterns of 1 to 512 characters, one of them to include")
        wanted = Source(kb_id, path.resolve(), tuple(include), tuple(exclude))
        for s in self.config.sources:
            if s.id == kb_id and (s.root.resolve(), s.include, s.exclude) != (wanted.root, wanted.include, wanted.exclude):
                raise ValueError("the knowledge base's id is taken by another scope")
            if s.id != kb_id and s.root.resolve() == wanted.root:
                raise ValueError("the folder is connected under another id")
        return wanted

    def preview(self, source: Source) -> dict[str, Any]:
        """What connecting a source would read: counts, sizes and a fingerprint of the files as they are; no contents."""
        files = stat_files(self.spark, [source]).cache()
        total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum((F.col("size") > self.config.max_file_bytes).cast("long")), F.lit(0)).alias("oversize")).first().asDict()
        samples = [r.path for r in files.orderBy("path").limit(10).collect()]
        state = files.select(F.col("path").alias("id"), F.concat_ws(":", "size", "mtime_ns", "ctime_ns").alias("source_hash"))
        scope = [dump_config(self.config), source.id, str(source.root), list(source.include), list(source.exclude), self.corpus_hash(state)]
        files.unpersist()
        return total | {"samples": samples, "can_connect": total["files"] > 0 and not total["oversize"], "preview_id": identity.digest(scope)}

    def connect(self, source: Source, preview_id: str, config_path: str | Path) -> Engine:
        """Adds or replaces a source after its preview was confirmed; the configuration is written only when its index stands."""
        if self.preview(source)["preview_id"] != preview_id:
            raise ValueError("the source or the configuration changed since the preview")
        if not self.preview(source)["can_connect"]:
            raise ValueError("the source has no files, or some that are too large")
        sources = tuple(s for s in self.config.sources if s.id != source.id) + (source,)
        engine = Engine(self.spark, replace(self.config, sources=sources), self.provider)
        engine.index()
        first = engine._tables(engine.store)[0].where(F.col("kb_id") == source.id).orderBy("id").limit(1).collect()
        if first:
            engine.read_document(first[0].id)
        write_whole(Path(config_path), dump_config(engine.config))
        return engine

    def status(self) -> dict[str, Any]:
        """Documents by configured source (0 for those without any), and the vectors' status."""
        configured = self.spark.createDataFrame([(s.id,) for s in self.config.sources], "kb_id string")
        rows = configured.join(self.list_knowledge_bases(), "kb_id", "left").select("kb_id", F.coalesce("documents", F.lit(0)).alias("documents")).orderBy("kb_id").collect()
        state = "ready" if rows and all(r.documents for r in rows) else "needs_index"
        return {"status": state, "knowledge_bases": [r.asDict() for r in rows], "vectors": self.vector_status()["status"]}
