"""Hashes that name things: canonical JSON, digests, chunk and unit ids, name-based UUIDs."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The URL namespace of name-based UUIDs.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def canonical(value: Any) -> str:
    """JSON with sorted keys, no blanks and characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest(value: Any) -> str:
    """SHA-256 in hex of bytes, of a text in UTF-8, or of a value's canonical JSON."""
    raw = value if isinstance(value, bytes) else value.encode() if isinstance(value, str) else canonical(value).encode()
    return hashlib.sha256(raw).hexdigest()


def json_text(text: Column) -> Column:
    """A text as canonical JSON has it."""
    quoted = F.get(F.split(F.to_json(F.struct(text.alias("x"))), '^\\{"x":', 2), F.lit(1))
    quoted = F.substring(quoted, 1, F.length(quoted) - 1)
    # control characters have hex digits in lower case
    for k in (11, *range(14, 32)):
        quoted = F.replace(quoted, F.lit(f"\\u{k:04X}"), F.lit(f"\\u{k:04x}")) if f"{k:04X}" != f"{k:04x}" else quoted
    return quoted


def json_array(*parts: Column) -> Column:
    """Canonical JSON of an array whose elements are given as JSON."""
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def chunk_id(doc_id: Column, source_hash: Column, pipeline_hash: Column, start: Column, end: Column) -> Column:
    return sha256(json_array(json_text(doc_id), json_text(source_hash), json_text(pipeline_hash), start.cast("string"), end.cast("string")))


def unit_id(chunk: Column, start: Column, end: Column, fingerprint: Column) -> Column:
    return sha256(json_array(json_text(chunk), start.cast("string"), end.cast("string"), json_text(fingerprint)))


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The name-based UUID (version 5)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def corpus_hash(documents: DataFrame) -> DataFrame:
    """One row, corpus_hash: the hash of the canonical list of (id, source_hash), in the order of id.

    The pairs are sorted outside memory and run through the hash one by one, so a corpus of any size needs no more.
    """
    pair = F.concat(F.lit('{"id":'), json_text(F.col("id")), F.lit(',"source_hash":'), json_text(F.col("source_hash")), F.lit("}"))

    def run(batches):
        total, first = hashlib.sha256(b"["), True
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if rows:
                total.update(("" if first else ",").encode() + ",".join(rows).encode())
                first = False
        total.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([total.hexdigest()])], ["corpus_hash"])

    ordered = documents.select("id", "source_hash").repartition(1).sortWithinPartitions("id", "source_hash")
    return ordered.select(pair.alias("pair")).mapInArrow(run, "corpus_hash string")
