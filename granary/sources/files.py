"""Files of knowledge bases as a DataFrame, and JSON sources.

Spark's own listing hides names that begin with _ (and can't tell ctime), so tasks list folders themselves: the roots first, then
whatever lies in them, a folder of a root to a task. Roots must be visible to the executors; the driver lists and reads nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import glob_regex
from granary.sources.config import Source

LISTED = "kb_id string, path string, place string"
HASHED = "id string, kb_id string, path string, size long, source_hash string"


def listed_files(spark: SparkSession, sources: Iterable[Source]) -> DataFrame:
    """LISTED: every source's files. A missing root, or a link that leads out of it, is an error; dotted names are left out."""
    sources = list(sources)
    for s in sources:
        if not Path(s.root).is_dir():
            raise FileNotFoundError(f"source {s.id} has no folder {s.root}")
    rules = {s.id: (str(s.root), chosen(s)) for s in sources}

    def first(batches):
        """A root's own files and folders."""
        for batch in batches:
            for kb in batch.column(0).to_pylist():
                own = [e for e in sorted(os.scandir(rules[kb][0]), key=lambda e: e.name) if not e.name.startswith(".") and not (e.is_symlink() and e.is_dir())]
                yield _rows([(kb, e.name, e.is_dir()) for e in own], ("kb_id", "name", "folder"), (pa.string(), pa.string(), pa.bool_()))

    def walked(batches):
        for batch in batches:
            for kb, name, folder in zip(*[c.to_pylist() for c in batch.columns]):
                root, keep = rules[kb]
                names = walk(Path(root), Path(root) / name) if folder else [name]
                yield _rows([(kb, path, os.path.join(root, path)) for path in names if keep(path, Path(root))], ("kb_id", "path", "place"), (pa.string(),) * 3)

    tops = spark.createDataFrame([(s.id,) for s in sources], "kb_id string").repartition(max(1, len(sources)))
    tops = tops.mapInArrow(first, "kb_id string, name string, folder boolean").repartition("kb_id", "name")
    return tops.mapInArrow(walked, LISTED)


def _rows(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), kinds)], list(names))


def walk(root: Path, folder: Path) -> Iterator[str]:
    """Relative paths of the files in a folder of root, dotted names left out."""
    for here, names, files in os.walk(folder):
        names[:] = [n for n in names if not n.startswith(".")]
        for name in files:
            if not name.startswith("."):
                yield (Path(here) / name).relative_to(root).as_posix()


def chosen(source: Source) -> Callable[[str, Path], bool]:
    """Whether a source has a file, by its relative path; one that the patterns choose but that leads out of the root is an error."""
    include, exclude = ([re.compile(glob_regex(p)) for p in patterns] for patterns in (source.include, source.exclude))

    def keep(path: str, root: Path) -> bool:
        if not any(p.match(path) for p in include) or any(p.match(path) for p in exclude):
            return False
        if not (root / path).resolve().is_relative_to(root.resolve()):
            raise ValueError(f"{source.id}:{path} leads out of its source")
        return True

    return keep


def source_files(source: Source) -> list[str]:
    """The same for one source on this machine: relative paths, sorted."""
    root = Path(source.root)
    if not root.is_dir():
        raise FileNotFoundError(f"source {source.id} has no folder {root}")
    keep = chosen(source)
    return sorted(path for path in walk(root, root) if keep(path, root))


def hash_files(spark: SparkSession, sources: Iterable[Source], max_bytes: int | None = None) -> DataFrame:
    """HASHED of all files as they are now; their bytes are read and hashed in tasks. A file of more than max_bytes is an error."""

    def run(batches):
        for batch in batches:
            sizes, hashes = [], []
            for kb, path, place in zip(*[c.to_pylist() for c in batch.columns]):
                with open(place, "rb") as f:
                    hashes.append(hashlib.file_digest(f, "sha256").hexdigest())
                    sizes.append(f.tell())
                if max_bytes is not None and sizes[-1] > max_bytes:
                    raise ValueError(f"{kb}:{path} is larger than {max_bytes} bytes")
            ids = [f"{kb}:{path}" for kb, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())], ["id", "kb_id", "path", "size", "source_hash"])

    return listed_files(spark, sources).repartition("kb_id", "path").mapInArrow(run, HASHED)


FILES = "id string, kb_id string, path string, size long, source_hash string, content string"


def stat_files(spark: SparkSession, sources: Iterable[Source]) -> DataFrame:
    """(kb_id, path, size, mtime_ns, ctime_ns) of all files; nothing of their content is read."""

    def run(batches):
        for batch in batches:
            found = [os.stat(place) for place in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([getattr(st, n) for st in found], pa.int64()) for n in ("st_size", "st_mtime_ns", "st_ctime_ns")]], ["kb_id", "path", "size", "mtime_ns", "ctime_ns"])

    return listed_files(spark, sources).mapInArrow(run, "kb_id string, path string, size long, mtime_ns long, ctime_ns long")


def read_files(spark: SparkSession, sources: Iterable[Source], max_bytes: int, only: DataFrame | None = None) -> DataFrame:
    """FILES of all sources; only: of these ids. A file that is too large or no UTF-8 fails the job.

    source_hash is of the bytes, a byte order mark included; content is without it.
    """
    names = listed_files(spark, sources)
    if only is not None:
        names = names.withColumn("id", F.concat_ws(":", "kb_id", "path")).join(only.select("id"), "id", "left_semi").drop("id")
    names = names.repartition("kb_id", "path")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{row['kb_id']}:{row['path']}"
                with open(row["place"], "rb") as f:
                    raw = f.read(max_bytes + 1)
                if len(raw) > max_bytes:
                    raise ValueError(f"{name} is larger than {max_bytes} bytes")
                columns = [name, row["kb_id"], row["path"], len(raw), hashlib.sha256(raw).hexdigest(), raw.decode("utf-8-sig")]
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], ["id", "kb_id", "path", "size", "source_hash", "content"])

    return names.mapInArrow(run, FILES)


CASES = "id string, category string, query string, kb_ids array<string>, filters map<string,string>, relevant array<struct<doc_id:string,contains:string>>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases of a JSON-lines file, checked: unique ids, a category and a query that aren't blank, labels of distinct
    documents with evidence. Filters' values are kept as texts that equal values share."""
    cases = spark.read.schema(CASES.replace("map<string,string>", "string")).json(path)
    from granary.operators.lexical import metadata_values

    bad = cases.select(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"),
        F.sum((F.coalesce(F.trim("query"), F.lit("")) == "").cast("int")).alias("queries"), F.sum((F.coalesce(F.trim("category"), F.lit("")) == "").cast("int")).alias("categories"),
        F.sum(F.col("relevant").isNull().cast("int")).alias("unlabelled"),
        F.sum((F.size(F.array_distinct(F.col("relevant.doc_id"))) < F.size("relevant")).cast("int")).alias("repeated"),
        F.sum(F.exists(F.col("relevant.contains"), lambda c: F.coalesce(c, F.lit("")) == "").cast("int")).alias("evidence"),
    ).first()
    if not bad.n or bad.ids != bad.n:
        raise ValueError("there are no cases, or ids occur again")
    if bad.queries or bad.categories or bad.unlabelled or bad.repeated or bad.evidence:
        raise ValueError(f"faulty cases: {bad.asDict()}")
    return cases.withColumn("filters", F.when(F.col("filters").isNotNull(), metadata_values(F.col("filters"))))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace records of a JSON-lines file."""
    return spark.read.schema("trace_id string, timestamp string, operation string, status string, error_type string, operation_ms double, stages_ms map<string,double>").json(path)


def read_report(path: str | Path) -> dict:
    return json.loads(Path(path).read_text("utf-8"))
