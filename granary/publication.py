"""What may leave a repository: its Git candidates checked in tasks, summaries of reports, clean copies."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import tempfile
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.identity import digest
from granary.functions.text import normal_path
from granary.operators import audit
from granary.sources.config import load_config
from granary.sources.store import write_whole

CANDIDATES = "commit string, file string, blob string, link boolean"
#: Git's mode of a symbolic link.
LINK = "120000"


def git(root: Path, *args: str) -> bytes:
    return subprocess.run(["git", "-C", str(root), *args], capture_output=True, check=True).stdout


def listed(root: Path, staged: bool) -> list[tuple]:
    """CANDIDATES that a commit now would publish: changed entries of the index if staged, else the working tree's files. Git's
    listing of one tree, so no more than its names; blob is null for files of the working tree."""
    if staged:
        before = "HEAD" if git(root, "rev-list", "--all", "-n1") else git(root, "hash-object", "-t", "tree", "/dev/null").decode().strip()
        raw = git(root, "diff-index", "--cached", "--no-renames", "--diff-filter=d", "-z", before).decode().split("\0")
        return [(None, name, meta.split()[3], meta.split()[1] == LINK) for meta, name in zip(raw[::2], raw[1::2])]
    names = filter(None, git(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z").decode().split("\0"))
    return [(None, n, None, (root / n).is_symlink()) for n in names if os.path.lexists(root / n) and not (root / n).is_dir()]


def committed(spark: SparkSession, root: Path, folder: Path) -> DataFrame:
    """CANDIDATES of the whole history, each path and blob once, with a commit that has it.

    Git's log of all changes runs once and goes to a file in folder line by line, each change with its commit before it; Spark
    reads that file. The driver holds no list.
    """
    place = folder / "history.jsonl"
    log = subprocess.Popen(["git", "-C", str(root), "log", "--all", "-m", "--root", "--raw", "--no-renames", "--no-abbrev", "-z", "--format=%x00%H"], stdout=subprocess.PIPE)
    with place.open("w", encoding="utf-8") as out:
        commit, change = "", None
        for part in _parts(log.stdout):
            text = part.decode("utf-8", "replace").lstrip("\n")
            if text.startswith(":"):
                change = text.split()
            elif change:
                if change[4] != "D":
                    out.write(json.dumps({"commit": commit[:12], "file": text, "blob": change[3], "link": change[1] == LINK, "module": change[1] == "160000"}) + "\n")
                change = None
            elif text:
                commit = text
    if log.wait():
        raise RuntimeError("git log failed")
    rows = spark.read.schema(CANDIDATES + ", module boolean").json(str(place)).where("not module")
    return rows.groupBy("file", "blob").agg(F.min("commit").alias("commit"), F.max("link").alias("link")).select("commit", "file", "blob", "link")


def _parts(stream: BinaryIO) -> Iterator[bytes]:
    """A stream's parts between zero bytes, however many."""
    held = b""
    while piece := stream.read(1 << 16):
        *whole, held = (held + piece).split(b"\0")
        yield from whole
    if held:
        yield held


def contents(found: DataFrame, root: Path) -> DataFrame:
    """found with content, read by tasks, up to one byte more than a text may have; blobs of a task by one Git process."""
    where = str(root)

    def run(batches):
        with subprocess.Popen(["git", "-C", where, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as objects:

            def blob(name: str) -> bytes:
                objects.stdin.write(name.encode() + b"\n")
                objects.stdin.flush()
                size = int(objects.stdout.readline().split()[2])
                raw = objects.stdout.read(min(size, audit.MOST_BYTES + 1))
                left = size - len(raw) + 1
                while left:
                    left -= len(objects.stdout.read(min(left, 1 << 20)))
                return raw

            for batch in batches:
                for row in batch.to_pylist():
                    raw = b""
                    if row["blob"] and not row["link"]:
                        raw = blob(row["blob"])
                    elif not row["link"]:
                        with open(Path(where) / row["file"], "rb") as f:
                            raw = f.read(audit.MOST_BYTES + 1)
                    yield pa.RecordBatch.from_pylist([row | {"content": raw}], schema)
            objects.stdin.close()

    schema = pa.schema([("commit", pa.string()), ("file", pa.string()), ("blob", pa.string()), ("link", pa.bool_()), ("content", pa.binary())])
    return found.select("commit", "file", "blob", "link").repartition(max(1, found.sparkSession.sparkContext.defaultParallelism), "file", "blob").mapInArrow(run, CANDIDATES + ", content binary")


def own_folders(spark: SparkSession, root: Path) -> tuple[str, ...]:
    """Folders of this machine that no published line may name, as findings see paths: the repository, the home folder, and the
    sources that local configurations connect from elsewhere."""
    places = {root, Path.home()}
    for path in (root / ".state").glob("*.connected.toml"):
        try:
            places |= {s.root.resolve() for s in load_config(path).sources}
        except (OSError, ValueError, TypeError) as error:
            raise ValueError("a local source configuration can't be read") from error
    rows = [(str(p),) for p in places if p == root or not p.is_relative_to(root)]
    named = spark.createDataFrame(rows, "place string").select(normal_path(F.col("place")).alias("place"))
    return tuple(sorted(r.place for r in named.where("length(place) > 8").collect()))  # a shorter one is in too many lines


def findings(spark: SparkSession, root: str | Path, staged: bool = False, history: bool = False) -> DataFrame:
    """(commit, file, line, reason) of everything that mustn't be published; what matched is never shown."""
    root = Path(root).resolve()
    with tempfile.TemporaryDirectory() as folder:  # Git runs on this machine, and so do the tasks that ask it
        found = spark.createDataFrame(listed(root, staged), CANDIDATES)
        if history:
            found = found.unionByName(committed(spark, root, Path(folder)))
        return spark.createDataFrame(_findings(found, root).collect(), FINDINGS)


FINDINGS = "commit string, file string, line long, reason string"


def _findings(found: DataFrame, root: Path) -> DataFrame:
    rows = contents(found, root)
    whole = F.when(F.col("link"), "symbolic link").when(audit.private_artifact(F.col("file")), "private artifact").otherwise(audit.guard(F.col("content")))
    rows = rows.withColumn("reason", whole)
    named = rows.where("reason is not null").select("commit", "file", F.lit(None).cast("long").alias("line"), "reason")
    texts = rows.where("reason is null").select("commit", "file", F.regexp_replace(F.col("content").cast("string"), "^﻿", "").alias("text"))
    reports = texts.where(F.startswith("file", F.lit(audit.REPORTS)) & F.endswith("file", F.lit("report.json")))
    named = named.union(audit.report_faults(reports).select("commit", "file", F.lit(None).cast("long"), "fault"))
    lines = audit.text_findings(texts.withColumn("id", F.struct("commit", "file")), private=own_folders(found.sparkSession, root))
    return named.union(lines.select("id.commit", "id.file", "line", F.col("finding").alias("reason"))).orderBy("commit", "file", "line", "reason")


def clean_copy(spark: SparkSession, root: str | Path, target: str | Path) -> Path:
    """The repository's publishable files in a new folder, if the audit finds nothing."""
    root = Path(root).resolve()
    if n := findings(spark, root).count():
        raise ValueError(f"{n} findings: nothing is copied")
    folder = Path(target) / f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"
    folder.mkdir(parents=True)
    for _, name, _, _ in listed(root, False):
        to = (folder / name).resolve()
        if folder.resolve() not in to.parents:
            raise ValueError("a path leads out of the copy")
        to.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(root / name, to)
    return folder


#: What a public summary may hold of a report, and of its vector build as numbers.
PUBLIC = ("strategy", "top_k", "max_chars", "repeats", "warmup", "dataset_hash", "corpus_hash", "settings", "metrics", "stages_ms")
BUILD_NUMBERS = ("documents", "chunks", "points", "split_chunks", "input_tokens", "operation_ms", "storage_bytes")
ENCODING_NUMBERS = ("hits", "misses", "encoded_tokens", "encode_calls", "encode_ms")


def figures(report: dict[str, Any]) -> list[tuple[str, str, str]]:
    """(section, key, value as JSON) of the figures that a summary would publish of a report's vector build."""
    build = report["vector_build"]
    sections = {"vector_build": {k: build[k] for k in BUILD_NUMBERS if k in build}, "encoding": build["encoding"]}
    return [(section, k, json.dumps(v)) for section, values in sections.items() for k, v in values.items()]


def public_summary(spark: SparkSession, report: dict[str, Any], cases: list[Any], corpus_hash: str, target: str | Path) -> Path:
    """A report's figures without ids, queries, paths or hits, in a new folder; only for the approved cases and corpus."""
    if report["dataset_hash"] != digest(cases) or report["corpus_hash"] != corpus_hash:
        raise ValueError("the report isn't of the approved cases and corpus")
    public = {"schema_version": 1, "kind": "synthetic-benchmark-summary", "provenance": {k: report["environment"][k] for k in ("code_hash", "python")}}
    public |= {k: report[k] for k in PUBLIC}
    if report["strategy"] == "dense":
        rows = figures(report)
        allowed = [("vector_build", k) for k in BUILD_NUMBERS] + [("encoding", k) for k in ENCODING_NUMBERS]
        found = audit.figure_faults(spark.createDataFrame(rows, "section string, key string, value string"), spark.createDataFrame(allowed, "section string, key string")).collect()
        if found:
            raise ValueError(f"the vector build holds something else than figures: {[tuple(f) for f in found]}")
        of = lambda section: {k: json.loads(v) for s, k, v in rows if s == section}
        public |= {"vector_build": of("vector_build") | {"encoding": of("encoding")}, "embedding_spec": report["vector_build"]["embedding_spec"]}
    folder = Path(target)
    folder.mkdir(parents=True)
    write_whole(folder / "report.json", json.dumps(public, ensure_ascii=False, indent=1), fresh=True)
    write_whole(folder / "summary.md", "\n".join(f"- {k}: {v}" for k, v in public["metrics"][0].items()) + "\n", fresh=True)
    return folder / "report.json"
