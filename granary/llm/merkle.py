"""Merkle manifest of a table: a tree for each source over its rows, a tree over the sources, and a proof for every row.

1. Leaves are hashed where the texts are; only digests go on. A range partitioning by (source, id, leaf) and the counts of its
   partitions give each leaf its place in its source, so no task ever holds a source.
2. Nodes are events keyed by their parent. A task gets whole runs of ARITY ** LEVELS consecutive nodes (a block) and combines
   them: a partial parent takes its children's digests by place, and as soon as it has as many as the size of the level says
   it becomes an event of the level above. What is left, the block's top, is the frontier: it is shuffled to a block of the
   next band, until each source has one node. Blocks are written with the digests they were given.
3. The same bands over the sources' roots give the root.
4. Proofs go the other way: a block's top brings the siblings on its way to the root; the children that the parents took
   are the links back, and every node's way is its siblings, then its parent's way.

A block is a row, so hot sources are many rows dealt by hash; a band has a 729th of the rows of the one below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import kernels
from granary.llm.common import column, small, text_batches, written

ARITY = 3
#: Levels that a task climbs in one go.
LEVELS = 6
BLOCK = ARITY**LEVELS
#: Ways to the root that may be broadcast; each has at most 2 digests for each of some forty levels.
WAYS = 4000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    """A row's digest: each field as its UTF-8 byte count, a colon and its value, a null as a hyphen."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def level_sizes(size: int, levels: int = LEVELS) -> list[int]:
    """Nodes of a level of that size and of those above it, up to a level of one node or so many levels."""
    sizes = [size]
    while sizes[-1] > 1 and len(sizes) <= levels:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


class Parents:
    """The parents of one block, each made when its last child comes in, in whatever order children come.

    children: by (level, place of the parent) the digests it was made of, the links back.
    """

    def __init__(self, size: int):
        self.sizes = level_sizes(size)
        self.partial: dict[tuple[int, int], dict[int, str]] = {}
        self.children: dict[tuple[int, int], list[str]] = {}
        self.top: tuple[int, str] | None = None

    def add(self, place: int, digest: str) -> None:
        level = 0
        while level + 1 < len(self.sizes):
            parent, level = place // ARITY, level + 1
            due = min(ARITY, self.sizes[level - 1] - parent * ARITY)
            got = self.partial.setdefault((level, parent), {})
            got[place] = digest
            if len(got) < due:
                return
            own = [got[k] for k in sorted(got)]
            del self.partial[level, parent]
            self.children[level, parent] = own
            place, digest = parent, sha("".join(own))
        self.top = (place, digest)


def combined(nodes: DataFrame, name: str) -> DataFrame:
    """Blocks of nodes (tree, place, size, digest, id, claim): (tree, block, size, digests, ids, claims, top, done).

    size is that of the nodes' level in the whole tree. digests and claims are packed, 32 bytes each; a missing claim is the
    digest. done: the top is the tree's only node on its level, so its root.
    """

    def packed(key: tuple[int, int, int], rows: list[tuple]) -> tuple:
        tree, block, size = key
        made = Parents(size)
        for place, digest, _, _ in rows:
            made.add(place, digest.hex())
        ids = [r[2] for r in rows]
        return tree, block, size, b"".join(r[1] for r in rows), ids, b"".join(r[3] or r[1] for r in rows), bytes.fromhex(made.top[1]), made.sizes[-1] == 1

    def run(batches):
        key, rows = None, []
        for batch in batches:
            out = []
            for tree, block, place, size, *rest in zip(*[c.to_pylist() for c in batch.columns]):
                if key != (tree, block, size):
                    if rows:
                        out.append(packed(key, rows))
                    key, rows = (tree, block, size), []
                rows.append((place, *rest))
            if out:
                yield _table(out)
        if rows:
            yield _table([packed(key, rows)])

    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.bool_()]
    names = ["tree", "block", "size", "digests", "ids", "claims", "top", "done"]

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    dealt = nodes.withColumn("block", F.expr(f"place div {BLOCK}")).select("tree", "block", "place", "size", "digest", "id", "claim")
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    return written(dealt.mapInArrow(kernels.lean(run), "tree long, block long, size long, digests binary, ids array<long>, claims binary, top binary, done boolean"), name)


def climbed(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """The bands of blocks over nodes, lowest first; largest: nodes of the largest tree."""
    bands = []
    while True:
        bands.append(combined(nodes, f"merkle-{len(bands)}"))
        if largest <= BLOCK:
            return bands
        largest = -(-largest // BLOCK)
        nodes = bands[-1].where("not done").select("tree", F.col("block").alias("place"), F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("size"), F.col("top").alias("digest"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claim"))


def tops(bands: list[DataFrame]) -> DataFrame:
    """(tree, top) of each tree."""
    found = [b.where("done").select("tree", "top") for b in bands]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def indexed(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with _index, each row's place in that order, nulls first. Equal rows take any of their places."""
    table = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = written(table, name).withColumn("_part", F.shiftright("_at", 33))
    sizes = table.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), f"{name}-parts")
    return table.join(small(sizes), "_part").withColumn("_index", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_at")


@dataclass
class Manifest:
    """Written tables: sources (source, tree, size), and the bands of the sources' trees and of the tree over them."""

    sources: DataFrame
    bands: list[DataFrame]
    upper: list[DataFrame]

    def subroots(self) -> DataFrame:
        """(source, size, subroot) of each source."""
        return self.sources.join(tops(self.bands), "tree").select("source", "size", F.lower(F.hex("top")).alias("subroot"))

    def root(self) -> str | None:
        """None for a table without rows."""
        found = tops(self.upper).first()
        return found and bytes(found["top"]).hex()


def manifest(leaves: DataFrame) -> Manifest:
    """Trees over leaves (id long, source string, leaf hex string, claim hex string or null).

    In a source leaves ascend by id, null first, equal ids by leaf; sources ascend bytewise, null first. claim is a digest
    that proofs are to be checked for in the leaf's place; null: the leaf itself. No rows: no source and no root.
    """
    text_batches(leaves.sparkSession)
    slim = written(leaves.select("id", "source", F.unhex("leaf").alias("digest"), F.unhex("claim").alias("claim")), "leaves")
    rows = indexed(slim, ["source", "id", "digest"], "leaves-sorted")
    sources = rows.groupBy("source").agg(F.count("*").alias("size"), F.min("_index").alias("first"))
    sources = written(indexed(sources, ["first"], "sources-sorted").withColumnRenamed("_index", "tree"), "sources")
    found = sources.agg(F.max("size"), F.count("*")).first()
    keyed = small(sources.select(F.col("source").alias("_source"), "tree", "size", "first"))
    nodes = rows.join(keyed, F.col("source").eqNullSafe(F.col("_source")))
    bands = climbed(nodes.select("tree", (F.col("_index") - F.col("first")).alias("place"), "size", "digest", "id", "claim"), found[0] or 0)
    upper = tops(bands).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(found[1]).cast("long").alias("size"), F.col("top").alias("digest"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claim"))
    return Manifest(sources.select("source", "tree", "size"), bands, climbed(upper, found[1]))


def ways(size: int, block: int, digests: bytes, above: str) -> Iterator[str]:
    """The way to the root of each node of a block: for each level "left siblings:right siblings", joined by commas.

    above: the way of the block's top, empty if it is the root.
    """
    count, base = len(digests) // 32, block * BLOCK
    made = Parents(size)
    for k in range(count):
        made.add(base + k, digests[32 * k : 32 * k + 32].hex())
    depth = len(made.sizes) - 1
    own = {(depth, made.top[0]): above}
    for level, parent in sorted(made.children, reverse=True):
        children, behind = made.children[level, parent], own[level, parent]
        for k in range(len(children)):
            step = "".join(children[:k]) + ":" + "".join(children[k + 1 :])
            own[level - 1, parent * ARITY + k] = f"{step},{behind}" if behind else step
    return (own[0, base + k] for k in range(count))


def folded(digest: str, way: str) -> str:
    """The root that a leaf's digest and its way give."""
    for step in way.split(",") if way else ():
        left, right = step.split(":")
        digest = sha(left + digest + right)
    return digest


def _downward(band: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, place, way) of a band's nodes from (tree, block, way) of its blocks' tops."""

    def run(batches):
        for batch in batches:
            for tree, block, size, digests, above in zip(*[c.to_pylist() for c in batch.columns]):
                own = list(ways(size, block, digests, above))
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(own), pa.int64()), pa.array(np.arange(len(own)) + block * BLOCK), pa.array(own, pa.string())], ["tree", "place", "way"])

    met = band.join(small(above, WAYS), ["tree", "block"]).select("tree", "block", "size", "digests", "way")
    return written(met.mapInArrow(kernels.lean(run), "tree long, place long, way string"), "ways")


def proofs(made: Manifest, siblings: bool = False) -> DataFrame:
    """Of each leaf (id, leaf, subroot, root, proof_sha256, folded_root, verified): the check of its claim.

    proof_sha256: of the leaf's siblings, level by level through the source's root to the root, left to right. folded_root: what
    the claim and those siblings give; verified: that is the root. siblings: adds proof, the siblings with a colon in the leaf's
    own place on each level, levels joined by commas.
    """
    root = made.root() or ""
    above = made.upper[-1].select("tree", "block", F.lit("").alias("way"))
    for band in reversed(made.upper):
        above = _downward(band, above).withColumnRenamed("place", "block")
    of_sources = written(above.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), "way").join(tops(made.bands), "tree").select("tree", "block", "way", "top"), "source-ways")
    above = None
    for band in reversed(made.bands):
        own = band.where("done").select("tree", "block").join(small(of_sources.drop("top"), WAYS), ["tree", "block"])
        above = own if above is None else own.unionByName(above)
        if band is not made.bands[0]:
            above = _downward(band, above).withColumnRenamed("place", "block")
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["proof"] * siblings]

    def run(batches):
        for batch in batches:
            for block, size, digests, ids, claims, way, top in zip(*[c.to_pylist() for c in batch.columns]):
                leaves, claimed, proof, shas, roots = [], [], [], [], []
                for k, own in enumerate(ways(size, block, digests, way)):
                    leaves.append(digests[32 * k : 32 * k + 32].hex())
                    claimed.append(claims[32 * k : 32 * k + 32].hex())
                    shas.append(sha(own.replace(":", "").replace(",", "")))
                    roots.append(folded(claimed[-1], own))
                    if siblings:
                        proof.append(own)
                n = len(leaves)
                columns = [pa.array(ids, pa.int64()), pa.array(leaves), pa.array([top.hex()] * n), pa.array([root] * n), pa.array(shas), pa.array(roots), pa.array([r == root for r in roots]), *[pa.array(proof, pa.string())] * siblings]
                yield pa.RecordBatch.from_arrays(columns, names)

    met = made.bands[0].join(small(above, WAYS), ["tree", "block"]).withColumnRenamed("top", "_top")
    met = met.join(small(of_sources.select("tree", F.col("top")), WAYS * 10), "tree").select("block", "size", "digests", "ids", "claims", "way", "top")
    return met.mapInArrow(kernels.lean(run), "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof string" * siblings)


def tampered(docs: DataFrame) -> DataFrame:
    """docs with the leaf of each row and, as claim, that of a copy without line feeds where 2 divides the id's crc32."""
    named = docs.select(*[column(docs, c, "long" if c in ("doc_id", "n_chars") else "string") for c in FIELDS])
    forged = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, leaf([*map(F.col, FIELDS[:-1]), F.translate("text", "\n", "")]))
    return named.select(F.col("doc_id").alias("id"), "source", leaf([*map(F.col, FIELDS)]).alias("leaf"), forged.alias("claim"))


def audited(docs: DataFrame, siblings: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each document: proofs of a manifest against a copy
    that lost its line feeds where 2 divides crc32(doc_id).

    docs: doc_id, source, lang, n_chars, text; what is missing counts as null, other columns are ignored, whatever their names.
    Nulls have a digest of their own; null source is a source, the first; null doc_id comes first in it and isn't tampered with.
    Repeated rows are leaves of their own, next to each other; rows of one doc_id ascend by digest. Empty and very long texts
    are hashed whole, in the JVM. Empty table: empty result.
    """
    return proofs(manifest(tampered(docs)), siblings).withColumnRenamed("id", "doc_id")
