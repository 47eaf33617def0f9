"""Markdown documents to line-addressed chunks.

A document's lines pass one state machine each (fences, headings, the size so far), so the scan is a Python function over Arrow
batches, linear in the text; everything around it stays in expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from granary.functions.identity import canonical, digest
from granary.functions.text import FENCE, HEADING

PARSER_VERSION = "markdown-lines-v1"
_HEADING, _FENCE = re.compile(HEADING), re.compile(FENCE)
#: Bytes of text that a task parses before it hands the chunks on, or one document.
PARSED = 1 << 20


def pipeline_hash(chunk_chars: int) -> str:
    return digest(canonical({"parser": PARSER_VERSION, "chunk_chars": chunk_chars}))


def front_matter(lines: list[str]) -> tuple[dict, int]:
    """The mapping between a first line --- and the next one, and the number of lines that it takes."""
    if not lines or lines[0].strip() != "---":
        return {}, 0
    closing = [k for k, line in enumerate(lines) if k and line.strip() == "---"][:1]
    if not closing:
        raise ValueError("the frontmatter has no end")
    import yaml

    found = yaml.safe_load("".join(lines[1 : closing[0]]))
    if found is None or found == "" or found == [] or found is False or found == 0:
        found = {}
    if not isinstance(found, dict):
        raise ValueError("the frontmatter is no mapping")
    return json.loads(json.dumps(found, default=str)), closing[0] + 1


class Outline:
    """The labels of the headings that enclose a place, by level."""

    def __init__(self):
        self.open: dict[int, str] = {}

    def enter(self, level: int, label: str) -> None:
        self.open = {k: v for k, v in self.open.items() if k < level} | {level: label}

    def __str__(self) -> str:
        return " > ".join(self.open.values())


class Fences:
    """Whether a line is within a code fence: one is closed by a mark of its character that is as long or longer."""

    def __init__(self):
        self.mark = ""

    def pass_line(self, line: str) -> None:
        if found := _FENCE.match(line):
            if not self.mark:
                self.mark = found[1]
            elif found[1].startswith(self.mark):
                self.mark = ""


def chunks_of(lines: list[str], first: int, limit: int) -> Iterator[tuple[str, int, int, str, str | None]]:
    """(heading path, first line, last line, text, title) of each chunk; title is the label of its level-1 heading, if it
    begins with one. Line numbers start at 1 with the document's first line; chunks of white space alone are left out.

    A chunk ends before a heading, and before a line that finds it at the limit or above; neither within a fence.
    """
    outline, fences = Outline(), Fences()
    begin, size, path, title = first, 0, "", None
    for k in range(first, len(lines) + 1):
        last = k == len(lines)
        heading = None if last or fences.mark else _HEADING.match(lines[k])
        if last or heading or (size >= limit and not fences.mark):
            text = "".join(lines[begin:k])
            if text.strip():
                yield path, begin + 1, k, text, title
            if heading:
                outline.enter(len(heading[1]), heading[2])
            begin, size, path = k, 0, str(outline)
            title = heading[2] if heading and len(heading[1]) == 1 else None
        if not last:
            size += len(lines[k])
            fences.pass_line(lines[k])


def parse(content: str, stem: str, limit: int) -> tuple[str, dict, list[tuple[str, int, int, str]]]:
    """(title, metadata, chunks) of a document. The title is the metadata's or the file's stem; as long as it equals the stem,
    a level-1 heading replaces it."""
    lines = content.splitlines(keepends=True)
    metadata, first = front_matter(lines)
    title, out = str(metadata.get("title") or stem), []
    for path, a, b, text, heading in chunks_of(lines, first, limit):
        if heading is not None and title == stem:
            title = heading
        out.append((path, a, b, text))
    return title, metadata, out


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices whose texts in column have at most so many bytes, or one row."""
    for batch in batches:
        ends = np.cumsum([n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()])
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), "right")))
            yield batch.slice(start, end - start)
            start = end


CHUNKED = "id string, kb_id string, path string, source_hash string, pipeline_hash string, title string, metadata string, content string, chunks array<struct<heading:string,start_line:int,end_line:int,text:string>>"


def chunked(documents: DataFrame, chunk_chars: int) -> DataFrame:
    """Documents (id, kb_id, path, source_hash, content) with title, metadata (canonical JSON) and chunks. A document that
    can't be parsed fails the job, so that nothing of a batch is published."""
    version = pipeline_hash(chunk_chars)
    kind = pa.list_(pa.struct([("heading", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string())]))

    def run(batches):
        for batch in slices(batches, "content", PARSED):
            rows = batch.to_pylist()
            found = []
            for r in rows:
                stem = r["path"].rsplit("/", 1)[-1]
                stem = stem.rsplit(".", 1)[0] if "." in stem[1:] else stem
                try:
                    found.append(parse(r["content"] or "", stem, chunk_chars))
                except ValueError as error:
                    raise ValueError(f"{r['id']}: {error}") from error
            columns = [batch.column(c) for c in ("id", "kb_id", "path", "source_hash")]
            columns += [pa.array([version] * len(rows), pa.string()), pa.array([f[0] for f in found], pa.string()), pa.array([canonical(f[1]) for f in found], pa.string()), batch.column("content")]
            columns.append(pa.array([[dict(zip(("heading", "start_line", "end_line", "text"), c)) for c in f[2]] for f in found], kind))
            yield pa.RecordBatch.from_arrays(columns, ["id", "kb_id", "path", "source_hash", "pipeline_hash", "title", "metadata", "content", "chunks"])

    return documents.select("id", "kb_id", "path", "source_hash", "content").mapInArrow(run, CHUNKED)
