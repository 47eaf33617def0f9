"""Token ids of texts in a seekable binary format.

A shard file is a row of independent zstandard frames, one for each document, in ascending order of doc_id. A frame's content
is the document's ids as little-endian unsigned 32-bit integers. Behind them are two skippable frames:

    documents (magic 0x184D2A50): for each frame doc_id (int64, the smallest value for null), in little-endian order
    seek table (magic 0x184D2A5E): for each frame the sizes compressed and decompressed and the low 32 bits of the content's
        XXH64 (uint32 each); then the number of frames (uint32), 0x80 (a byte: checksums are there), 0x8F92EAB1 (uint32)

So any zstandard decoder reads all ids, and a reader of some documents fetches the tail, then only their frames, whose
checksums it compares.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm import kernels
from granary.llm.common import shared_dir, small, text_batches, written

# Fixed values of the zstandard seekable format.
SKIPPABLE_DOCUMENTS = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER = struct.Struct("<IBI")

NULL_ID = -(1 << 63)
#: Distinct pieces of text whose ids a worker remembers (about 30 bytes each); with more it forgets all and begins anew.
PIECES = 1_000_000
#: Bytes of text that are cut into pieces together.
TOGETHER = 1 << 19
#: Bytes of text in a shard, about, where there are more than the session's shuffle partitions would hold.
SHARD_BYTES = 1 << 28

_WHITE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
_PUNCTUATION = np.isin(np.arange(256), list(b'.,;:!?&%$#*|"()-'))
_WORD = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which byte-level pre-tokenization surely begins a token, whatever follows, and the end.

    That is where a text begins; before ASCII white space behind another character, since a token has white space at its
    beginning only; and between a letter or digit and punctuation other than the apostrophe, since no token has both. The
    pre-tokenizer looks ahead no further than the end of a run of white space, so what lies between two cuts can be encoded
    by itself. Bytes beyond ASCII count as white space where they may end such a character, and as letters from À to ÿ.
    """
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    at = np.flatnonzero(_WHITE[data])
    at = at[at > 0]
    at = at[~_WHITE[data[at - 1]]]
    before, two, three = data[at - 1], data[at - 2], data[at - 3]  # at a text's beginning these may be another's, which only keeps a cut
    wide = (before >= 0x80) & ((two == 0xC2) & ((before == 0x85) | (before == 0xA0)) | (three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A)))
    begins[at[~wide]] = True
    at = np.flatnonzero(_PUNCTUATION[data])
    at = at[at > 0]
    before = data[at - 1]
    begins[at[_WORD[before] | (data[at - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)]] = True
    return np.flatnonzero(begins)


class Pieces:
    """Ids of pieces by the pieces' hashes, in arrays: hashes in ascending order, and where in one array their ids begin and end."""

    def __init__(self):
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.n = np.zeros(1 << 16, np.uint32), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys, and which are known."""
        at = np.searchsorted(self.keys, keys)
        return at, np.r_[self.keys, np.uint64(0)][at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Adds distinct unknown keys with their ids in a row."""
        while self.n + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[self.n : self.n + len(ids)] = ids
        starts = self.n + np.cumsum(sizes) - sizes
        self.n += len(ids)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.starts = np.insert(self.starts, at, starts[order])
        self.sizes = np.insert(self.sizes, at, sizes[order])


class Encoder:
    """A tokenizers file's byte-level BPE over many texts at once: each distinct piece between cuts is encoded once.

    Pieces are told apart by 64-bit hashes. Strings of added tokens in a text are ordinary text if ordinary; else they have
    their ids, as with the library's default, and texts that hold one are encoded whole.
    """

    def __init__(self, path: str, end_id: int, ordinary: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [] if ordinary else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True  # their strings in a piece are ordinary text
        self.end = np.array([end_id], "<u4").tobytes()
        self.known = Pieces()

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        self.known.add(keys, sizes, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Of each text its ids and the end id as little-endian unsigned 32-bit integers."""
        holds = np.zeros(len(texts), bool)
        for t in self.added:
            holds |= pa.compute.match_substring(texts, t).fill_null(False).to_numpy(zero_copy_only=False)
        for k, content in enumerate(self._encode(texts)):
            if holds[k]:
                content = self._whole(texts[k].as_py())
            yield content

    def _whole(self, text: str) -> bytes:
        """A text by itself, with the library's defaults."""
        self.tokenizer.encode_special_tokens = False
        try:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end
        finally:
            self.tokenizer.encode_special_tokens = True

    def _encode(self, texts: pa.Array) -> Iterator[bytes]:
        for _, data, offsets in kernels.chunks(texts, TOGETHER):
            if len(self.known.keys) > PIECES:
                self.known = Pieces()
            at = cuts(data, offsets)
            starts, ends = at[:-1], at[1:]
            coded = pa.array(kernels.hashes(data, starts, ends)).dictionary_encode()
            keys, which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            place, there = self.known.find(keys)
            if not there.all():
                first = np.empty(len(keys), np.int64)
                first[which[::-1]] = np.arange(len(which))[::-1]
                new = np.flatnonzero(~there)
                self._learn(data, keys[new], starts[first[new]], ends[first[new]])
                place = self.known.find(keys)[0]
            begin, size = self.known.starts[place][which], self.known.sizes[place][which].astype(np.int64)
            to = np.cumsum(size)
            out = self.known.ids[np.repeat(begin - to + size, size) + np.arange(to[-1] if len(to) else 0)].astype("<u4", copy=False)
            edge = np.r_[0, to][np.searchsorted(at, offsets)]
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                yield out[a:b].tobytes() + self.end


@cache
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id, ordinary=False)


def together(batches: Iterable[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches, some put together so that the column has so many bytes, about."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.column(column).nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def frames(docs: DataFrame, path: str, end_id: int, bounds: list[tuple[int, int]]) -> DataFrame:
    """(shard, doc_id, place, n_tokens, check, frame) of documents (doc_id, text, place); bounds are where shards but the first begin."""
    ends = np.array(bounds, np.dtype([("doc_id", "<i8"), ("place", "<i8")])) if bounds else None

    def run(batches):
        own, pack = encoder(path, end_id), zstandard.ZstdCompressor(level=1)
        for batch in together(batches, 1, 2 * TOGETHER):
            rows = []
            for content in own.encode(batch.column(1)):
                rows.append((len(content) // 4, xxhash.xxh64_intdigest(content) & 0xFFFFFFFF, pack.compress(content)))
            n, check, data = zip(*rows) if rows else ((), (), ())
            shard = np.zeros(batch.num_rows, np.int32)
            if ends is not None:
                keys = np.empty(batch.num_rows, ends.dtype)
                keys["doc_id"], keys["place"] = batch.column(0).fill_null(NULL_ID), batch.column(2)
                shard = np.searchsorted(ends, keys, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(check, pa.int64()), pa.array(data, pa.binary())], ["shard", "doc_id", "place", "n_tokens", "check", "frame"])

    return docs.mapInArrow(kernels.lean(run), "shard int, doc_id long, place long, n_tokens long, check long, frame binary")


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def write_shard(out, rows: Iterable[tuple[int | None, int, int, bytes]]) -> int:
    """Writes (doc_id, n_tokens, check, frame) to a binary file in the order given; how many there were."""
    ids, table = array("q"), array("I")
    for doc_id, n, check, frame in rows:
        out.write(frame)
        ids.append(NULL_ID if doc_id is None else doc_id)
        table.extend((len(frame), 4 * n, check))
    out.write(skippable(SKIPPABLE_DOCUMENTS, np.array(ids, "<i8").tobytes()))
    out.write(skippable(SKIPPABLE_SEEK_TABLE, np.array(table, "<u4").tobytes() + FOOTER.pack(len(ids), CHECKSUM_FLAG, SEEKABLE_MAGIC)))
    return len(ids)


class ShardReader:
    """The documents of a shard; opens a seekable binary file of the given size and reads its tail only."""

    def __init__(self, file, size: int):
        self.file = file
        if size < FOOTER.size + 8:
            raise ValueError("not a shard: too short")
        n, flag, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("not a shard: no seek table")
        tail = 8 + 8 * n + 8 + 12 * n + FOOTER.size
        raw = self._at(size - tail, tail)
        if struct.unpack_from("<II", raw) != (SKIPPABLE_DOCUMENTS, 8 * n):
            raise ValueError("not a shard: no documents' ids")
        self.ids = np.frombuffer(raw, "<i8", n, 8)
        table = np.frombuffer(raw, "<u4", 3 * n, 8 + 8 * n + 8).reshape(n, 3).astype(np.int64)
        self.sizes, self.contents, self.checks = table.T
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.ids)

    def ids_of(self, k: int) -> bytes:
        """The k-th frame's content, checked."""
        content = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.sizes[k])), max_output_size=int(self.contents[k]))
        if len(content) != self.contents[k] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def find(self, wanted: Iterable[int]) -> list[int]:
        """Places of the documents of these ids; the ids ascend, so each is looked up by bisection."""
        wanted = np.array(sorted(set(wanted)), np.int64)
        a, b = np.searchsorted(self.ids, wanted, "left"), np.searchsorted(self.ids, wanted, "right")
        return [k for x, y in zip(a, b) for k in range(x, y)]


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> str:
    """Encodes documents (doc_id, text) and writes shards in ascending order of doc_id; the folder's URI.

    Shards are ranges of (doc_id, a hash of the text) of about shard_bytes of text, or as many as the session has shuffle
    partitions where that is more; so neither a large corpus nor a doc_id of very many rows (null above all) makes a shard
    large. The ranges are found over ids and hashes alone. Frames are made where the texts lie; only they, not the texts, are
    dealt to the shards. Each shard is a file, written under the attempt's own name and moved into place, so a task that runs
    again leaves one whole file.

    Null text: the end id alone. Null doc_id: first. Rows of one doc_id: a frame each, in the order of their texts' hashes.
    Texts are encoded whole, however long. Empty table: no file. Other columns are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    folder = folder or shared_dir(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("place"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    keys = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "place")
    ranges = keys.repartitionByRange(parts, "doc_id", "place").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "place")).alias("least"))
    bounds = sorted((r.least.doc_id, r.least.place) for r in ranges.collect())[1:]
    made = frames(docs, path, end_id, bounds).repartitionById(len(bounds) + 1, "shard")
    ordered = made.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "place", "n_tokens", "check").select("shard", "doc_id", "n_tokens", "check", "frame")

    def write(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        task, shard = TaskContext.get(), first.column(0)[0].as_py()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/shard-{shard:08d}.zst"
        trial = f"{root}/_{task.taskAttemptId()}.part"

        def rows():
            for b in chain((first,), batches):
                yield from zip(*(c.to_pylist() for c in b.columns[1:]))

        with fs.open_output_stream(trial) as out:
            n = write_shard(out, rows())
        fs.move(trial, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "n"])

    ordered.mapInArrow(kernels.lean(write), "file string, n long").agg(F.sum("n")).first()
    return folder


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, file): the folder's files in their order."""
    fs, root = filesystem(folder)
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    names = sorted(f"{folder}/{x.base_name}" for x in found if x.base_name.startswith("shard-"))
    # as a literal, since rows from the driver's Python would start Python workers of another kind on the executors
    df = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(names)), "array<string>")).alias("shard", "file"))
    return df.select(F.col("shard").cast("long"), "file").repartition(max(1, len(names)), "shard")


def read_tokens(spark: SparkSession, folder: str, wanted: list[int] | None = None, ids: bool = True) -> DataFrame:
    """Documents in a folder's shards, or those of the wanted ids only, whose frames alone are fetched and decompressed.

    (shard, place, doc_id, n_tokens, ids_crc32, ids): ids an array, null if not asked for; ids_crc32 the unsigned CRC-32 of
    the ids as little-endian unsigned 32-bit integers.
    """

    def run(batches):
        for batch in batches:
            for shard, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = filesystem(file)
                with fs.open_input_file(name) as raw:
                    reader = ShardReader(raw, raw.size())
                    places = range(len(reader)) if wanted is None else reader.find(wanted)
                    for k in range(0, len(places), 500):
                        own = places[k : k + 500]
                        content = [reader.ids_of(x) for x in own]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([shard] * len(own), pa.int64()), pa.array(list(own), pa.int64()),
                            pa.array([None if reader.ids[x] == NULL_ID else int(reader.ids[x]) for x in own], pa.int64()),
                            pa.array([len(c) // 4 for c in content], pa.int64()), pa.array([zlib.crc32(c) for c in content], pa.int64()),
                            pa.array([np.frombuffer(c, "<u4").astype(np.int32) if ids else None for c in content], pa.list_(pa.int32())),
                        ], ["shard", "place", "doc_id", "n_tokens", "ids_crc32", "ids"])

    return shards(spark, folder).mapInArrow(kernels.lean(run), "shard long, place long, doc_id long, n_tokens long, ids_crc32 long, ids array<int>")


def offsets(tokens: DataFrame) -> DataFrame:
    """tokens with start: the ids of all documents before it. Sums shards first; a window then runs within each shard."""
    tokens = written(tokens, "tokens-read")
    sums = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.join(small(sums), "shard").withColumn("start", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).cast("long"))
