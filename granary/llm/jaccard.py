"""N-gram Jaccard join: exact links between documents whose sets of word shingles overlap, by prefix trees.

1. Each text becomes its sorted set of 64-bit shingle hashes. Equal sets are one class, named by a hash of the set; copies
   are never paired.
2. A filter leaves out classes that can't have a partner. Two sets with Jaccard similarity t or more, the smaller of n,
   share at least ceil(t n) shingles; so of the n - ceil(t n) + e smallest ones by hash of either at least e are in both
   lists. A class survives if e or more of its list are found in another class's list. That is counted in hash ranges; a
   task sends a shingle that it meets in several classes only twice, however frequent it is.
3. For the survivors the shingles get one global order, rarest first. Two linked sets share one of their first
   n - ceil(t n) + 1; components over such shared prefixes are blocks, and a link never leaves its block.
4. Each block is joined by a trie of its ordered sets, which a probing set walks once, carrying the overlap so far and
   leaving out every subtree whose sets can't reach the threshold with what remains of either. Blocks of many shingles
   are split by hash into parts, and each pair of parts is a task of its own, so that memory is bounded; only degrees and
   the edges of a spanning forest leave a task.
5. Components of those edges give each document its class.

Where links needn't be counted, most pairs of a large group are left out: a part is walked by a few sets first (hubs), whose
links put most of a group into one component, then only by the sets outside the largest component. Parts of one block are
connected by the hubs of its largest components, sent to each part, and only what is still outside the block's largest
component meets all parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import kernels
from granary.llm.common import components, discard, small, text_batches, written

#: Shingles in one part of a block, about.
PART = 200_000
#: Sets whose links are looked for first where links aren't counted: in a part, and of a block in each of its parts.
HUBS = 8
#: Hash ranges of the filter, and the shingles in one, about, above which there are more.
RANGES = 64
RANGE = 2_000_000
#: Shingles that a task of the filter holds before it sends them off.
HELD = 400_000


def set_key(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    a = kernels.mixed(shingles ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    b = kernels.mixed(shingles + np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes()


def _need(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles that a set of n must share with any partner: ceil(n * num / den)."""
    return -((-n * num) // den)


def _extra(n: np.ndarray) -> np.ndarray:
    return 1 + n // 10


def described(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, key, half) of each document; half is the key's first half, both are null for an empty set."""

    def run(batches):
        for batch in batches:
            sizes, keys, halves = [], [], []
            for _, data, offsets in kernels.chunks(batch.column(1)):
                for s in kernels.shingle_sets(data, offsets, n):
                    sizes.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    halves.append(int.from_bytes(keys[-1][:8], "little", signed=True) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(halves, pa.int64())], ["doc_id", "n_shingles", "key", "half"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernels.lean(run), "doc_id long, n_shingles long, key binary, half long")


def _spread(docs: DataFrame, n: int, num: int, den: int, ranges: int) -> DataFrame:
    """The first shingles by hash of each set, packed by hash range: (range, shingles, keys, count).

    One row holds what a task's run of documents has in a range. count is 1 where the class is to be told whether the
    shingle is elsewhere; shingles that several classes of the run share count at once (ranges below 0 have those counts, any
    classes' in any of them), and only two classes announce them.
    """
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def pack(sets: dict[bytes, np.ndarray]) -> Iterator[pa.RecordBatch]:
        names = np.frombuffer(b"".join(sets), np.uint64)[::2]  # the first half of a key will do to tell classes apart
        lists = list(sets.values())
        sizes = np.array([len(s) for s in lists])
        token, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        fresh = np.r_[True, token[1:] != token[:-1]]
        run = np.cumsum(fresh) - 1
        place = np.arange(len(token)) - np.flatnonzero(fresh)[run]
        several = np.bincount(run)[run] > 1
        met = np.bincount(owner[several], minlength=len(lists))
        keep = place < 2
        token, owner, told = token[keep], owner[keep], ~several[keep]
        part = (token >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(token), np.int64)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
        rows = [(int(part[a]), token[a:b].tobytes(), names[owner[a:b]].tobytes(), told[a:b].astype(np.uint8).tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        if len(hit := np.flatnonzero(met)):
            rows.append((-1 - int(names[hit[0]] % np.uint64(RANGES)), b"", names[hit].tobytes(), met[hit].astype(np.uint32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["range", "shingles", "keys", "told"])

    def run(batches):
        sets: dict[bytes, np.ndarray] = {}
        held = 0
        for batch in batches:
            for _, data, offsets in kernels.chunks(batch.column(0)):
                for s in kernels.shingle_sets(data, offsets, n):
                    size = len(s)
                    if size and (key := set_key(s)) not in sets:
                        first = s[: min(size, int(size - _need(size, num, den) + _extra(size)))]
                        sets[key] = first.copy()
                        held += len(first)
                if held >= HELD:
                    yield from pack(sets)
                    sets, held = {}, 0
        if sets:
            yield from pack(sets)

    return docs.select("text").mapInArrow(kernels.lean(run), "range long, shingles binary, keys binary, told binary")


def _met(spread: DataFrame) -> DataFrame:
    """(half, met): how many shingles of a class's list another class's list has."""

    def count(table: pa.Table) -> pa.Table:
        owner = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
        if table["range"][0].as_py() < 0:
            counts = np.frombuffer(b"".join(table["told"].to_pylist()), np.uint32)
            names, which = np.unique(owner, return_inverse=True)
            return pa.table({"half": names.view(np.int64), "met": np.bincount(which, weights=counts).astype(np.int64)})
        token = np.frombuffer(b"".join(table["shingles"].to_pylist()), np.uint64)
        told = np.frombuffer(b"".join(table["told"].to_pylist()), np.uint8).astype(bool)
        order = np.argsort(token, kind="stable")
        token, owner, told = token[order], owner[order], told[order]
        fresh = np.r_[True, token[1:] != token[:-1]] if len(token) else np.zeros(0, bool)
        at = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        # a shingle is shared if its run has an owner other than the first one's
        differs = np.add.reduceat((owner != owner[at][run]).astype(np.int64), at) > 0 if len(at) else np.zeros(0, bool)
        names, counts = np.unique(owner[told & differs[run]], return_counts=True)
        return pa.table({"half": names.view(np.int64), "met": counts.astype(np.int64)})

    return spread.groupBy("range").applyInArrow(kernels.trimmed(count), "half long, met long").groupBy("half").agg(F.sum("met").alias("met"))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(name, shingles) of texts (text, key), named by the key's first half; rows whose text has another key than a given one
    are left out."""

    def run(batches):
        for batch in batches:
            for i, data, offsets in kernels.chunks(batch.column(0)):
                keys = batch.column(1).slice(i, len(offsets) - 1).to_pylist()
                rows = [(k, s) for s, key in zip(kernels.shingle_sets(data, offsets, n), keys) if len(s) for k in [set_key(s)] if key is None or k == key]
                flat = np.concatenate([s for _, s in rows] or [np.zeros(0, np.uint64)]).view(np.int64)
                where = np.cumsum([0, *(len(s) for _, s in rows)])
                names = np.frombuffer(b"".join(k[:8] for k, _ in rows), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(flat))], ["name", "shingles"])

    return docs.select("text", "key").mapInArrow(kernels.lean(run), "name long, shingles array<long>")


class PrefixTree:
    """Sets in one global order as a trie: the sorted list of their sequences with the lengths of neighbours' common prefixes.

    A node is a prefix, its subtree the run of sequences that share it. A walk in that order keeps, for every set at once,
    the overlap with the current prefix, so sets below a node share what was counted on the way to it.
    """

    #: Shingles between two tests whether a subtree can be left out.
    STEP = 16

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        sets = [sets[i] for i in self.order]
        self.sizes, self.num, self.den = np.asarray(sizes)[self.order], num, den
        m = len(sets)
        lengths = np.array([len(s) for s in sets])
        self.prefix = [0] * m
        for i in range(1, m):
            k = min(lengths[i - 1], lengths[i])
            unlike = np.flatnonzero(sets[i - 1][:k] != sets[i][:k])
            self.prefix[i] = int(unlike[0]) if len(unlike) else int(k)
        _, local = np.unique(np.concatenate(sets), return_inverse=True)
        owners = np.repeat(np.arange(m), lengths)[np.argsort(local, kind="stable")]
        cuts = np.cumsum(np.bincount(local))
        self.owners = np.split(owners, cuts[:-1])
        self.sets = np.split(local, np.cumsum(lengths)[:-1])
        # what a probe must reach at depth 0 for a set to be linked with it, if all the set's shingles were shared
        self.bound = num * self.sizes - (num + den) * lengths

    def linked(self, i: int) -> np.ndarray:
        """All sets that one is linked with, as positions in the sorted list."""
        overlap = np.bincount(np.concatenate([self.owners[t] for t in self.sets[i]]), minlength=len(self.sets))
        found = (self.num + self.den) * overlap >= self.num * (self.sizes + self.sizes[i])
        found[i] = False
        return np.flatnonzero(found)

    def links(self, side: np.ndarray | None = None, probes: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(set, the later sets that it is linked with), as positions in the sorted list; side: only between unlike sides.

        probes: only sets so marked walk the trie, and meet the earlier ones that don't as well.
        """
        m, both = len(self.sets), self.num + self.den
        others = np.arange(m) if probes is None else np.where(probes, np.arange(m), m)
        side = None if side is None else np.asarray(side)[self.order]
        stack = [(0, np.zeros(m, np.int64))]
        i = 0
        while i < m:
            while stack[-1][0] > self.prefix[i]:
                stack.pop()
            if probes is not None and not probes[i]:
                i += 1
                continue
            depth, overlap = stack[-1]
            s, subtree = self.sets[i], None
            while depth < len(s):
                to = min(len(s), self.prefix[i] if depth < self.prefix[i] else depth + self.STEP)
                overlap = overlap + np.bincount(np.concatenate([self.owners[t] for t in s[depth:to]]), minlength=m)
                depth = to
                if depth == self.prefix[i]:
                    stack.append((depth, overlap))
                end = i + 1
                while end < m and self.prefix[end] >= depth:
                    end += 1
                able = (both * (overlap - depth) - self.num * self.sizes >= self.bound[i:end].min()) & (others > i)
                if side is not None and end == i + 1:
                    able &= side != side[i]
                if not able.any():
                    subtree = end
                    break
            if subtree is None:
                stack.append((depth, overlap))
                found = (others > i) & (both * overlap >= self.num * (self.sizes + self.sizes[i]))
                if side is not None:
                    found &= side != side[i]
                if found.any():
                    yield i, np.flatnonzero(found)
                i += 1
            else:
                i = subtree


class Forest:
    """Components of a task's sets, by position."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def merge(self, i: int, found: np.ndarray) -> None:
        tops = np.unique(self.root[np.r_[i, found]])
        if len(tops) > 1:
            self.root[np.isin(self.root, tops)] = tops[0]


def _tree(table: pa.Table, num: int, den: int) -> PrefixTree:
    lists = table["shingles"].combine_chunks()
    flat, where = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    return PrefixTree([flat[a:b] for a, b in zip(where[:-1], where[1:])], table["n"].to_numpy(), num, den)


def _joined(table: pa.Table, num: int, den: int) -> pa.Table:
    """Of each set of a task: how many documents it is linked with, and a set of its component within the task."""
    tree = _tree(table, num, den)
    names, copies = table["name"].to_numpy()[tree.order], table["copies"].to_numpy()[tree.order]
    cross = table["a"][0].as_py() != table["b"][0].as_py()
    links, forest = np.zeros(len(names), np.int64), Forest(len(names))
    for i, found in tree.links(table["part"].to_numpy() if cross else None):
        links[i] += copies[found].sum()
        links[found] += copies[i]
        forest.merge(i, found)
    keep = links > 0
    return pa.table({"name": names[keep], "links": links[keep], "root": names[forest.root[keep]]})


def _connected(table: pa.Table, num: int, den: int) -> pa.Table:
    """(name, root) of a task's sets: a set of its component within the task. Sets marked probe are those that walk the trie;
    where all are, hubs do so first, and then only those outside the largest component."""
    tree = _tree(table, num, den)
    names, probes = table["name"].to_numpy()[tree.order], table["probe"].to_numpy(zero_copy_only=False)[tree.order]
    forest = Forest(len(names))
    if probes.all():
        free = np.ones(len(names), bool)
        for _ in range(HUBS):
            i = int(free.argmax())
            if not free[i]:
                break
            found = tree.linked(i)
            forest.merge(i, found)
            free[i] = free[found] = False
        tops, sizes = np.unique(forest.root, return_counts=True)
        probes = forest.root != tops[sizes.argmax()]
    for i, found in tree.links(probes=probes):
        forest.merge(i, found)
    return pa.table({"name": names, "root": names[forest.root]})


def _edges(lists: DataFrame, percent: int, left: int) -> DataFrame:
    """(name, root): edges that connect what links connect, of left sets (component, part, parts, name, n, shingles)."""
    task = lambda t: _connected(t, percent, 100)
    columns = ("component", "part", "parts", "name", "n", "shingles", "probe")
    own = written(lists.withColumn("probe", F.lit(True)).select(*columns).groupBy("component", "part").applyInArrow(kernels.trimmed(task), "name long, root long"), "within", left)
    several = lists.where("parts > 1")
    if not several.limit(1).count():
        return own.where("name <> root")
    # the hubs of a block: sets that stand for its parts' largest components; each part's sets meet them all
    sizes = several.select("component", "part", "name").join(own, "name").groupBy("component", "part", "root").agg(F.count("*").alias("size"))
    largest = Window.partitionBy("component").orderBy(F.desc("size"), "root")
    hubs = sizes.withColumn("k", F.row_number().over(largest)).where(F.col("k") <= HUBS).select("component", F.col("root").alias("name"))
    hubs = written(several.join(small(written(hubs, "hub-names", left)), ["component", "name"], "left_semi"), "hubs", left)
    sent = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("probe", F.lit(True))
    met = several.join(small(hubs.select("name")), "name", "left_anti").withColumn("probe", F.lit(False)).select(*columns).union(sent.select(*columns))
    near = written(met.groupBy("component", "part").applyInArrow(kernels.trimmed(task), "name long, root long"), "hub-links", left)
    # what isn't in its block's largest component yet meets all parts
    edges = own.union(near).where("name <> root")
    found = components(edges, "name", "root", left).withColumnRenamed("id", "name").withColumnRenamed("component", "label")
    labelled = several.join(found, "name", "left").withColumn("label", F.coalesce("label", "name"))
    sums = labelled.groupBy("component", "label").agg(F.count("*").alias("size"))
    main = sums.groupBy("component").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    outside = written(labelled.join(main, "component").where("label <> main").drop("label", "main"), "outside", left)
    if not outside.limit(1).count():
        return edges
    turns = outside.groupBy("component").agg(F.ceil(F.sum(F.size("shingles")) / F.lit(PART)).cast("int").alias("turns"))
    walk = outside.join(turns, "component").withColumn("turn", F.pmod(F.xxhash64(F.lit(1), "name"), F.col("turns")).cast("int"))
    walk = walk.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("probe", F.lit(True))
    still = several.join(turns, "component").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    still = still.join(outside.select("name"), "name", "left_anti").withColumn("probe", F.lit(False))
    # outside sets of the same turn meet in its tasks, those of unlike turns where they lie in the other's part
    walk_all = walk.select(*columns, "turn").union(still.select(*columns, "turn"))
    across = outside.join(turns, "component").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    across = across.where(F.col("turn") != F.pmod(F.xxhash64(F.lit(1), "name"), F.col("turns"))).withColumn("probe", F.lit(False))
    last = walk_all.union(across.select(*columns, "turn")).groupBy("component", "part", "turn").applyInArrow(kernels.trimmed(task), "name long, root long")
    return edges.union(written(last, "outside-links").where("name <> root"))


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, links: bool = True) -> DataFrame:
    """Classes of documents linked by Jaccard similarity: (doc_id, n_shingles, n_links, component_id) for each row of docs.

    docs: doc_id, text; other columns are ignored, whatever their names. A-Z are lower-cased, words are runs of anything but
    ASCII white space, the set is that of distinct windows of n words (fewer words: all of them as one). Two documents link if
    100 * intersection >= percent * union (a tie links). n_links counts the other documents linked with it, copies included;
    component_id is the smallest doc_id reachable, its own included. Without links n_links is left out, and groups of very
    many near copies take time in proportion to their size, not to its square.

    Null or empty texts, or such without words: n_shingles 0, no link, component_id is their doc_id. Null doc_id: counted and
    linked like others, never a representative; component_id is null only if no doc_id is reachable. Repeated rows are copies
    of each other. Texts are taken whole, however long. Empty table: empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    seen = written(described(docs, n), "sets")
    total = seen.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = max(RANGES, 1 << min(20, (total * 3 // 10 // RANGE).bit_length()))
    classes = seen.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("half").alias("half"))
    classes = written(classes, "classes", seen.count())
    least = F.expr(f"1 + cast(ceil(n * {percent} / 100D) as long) div 10")
    alive = classes.join(_met(_spread(docs, n, percent, 100, ranges)), "half").where(F.col("met") >= least)
    alive = written(alive.select(F.col("half").alias("name"), "rep", "key", "n", "copies"), "alive", classes.count())
    left = alive.count()
    of_ids = docs.join(small(alive.where("rep is not null").select("rep", "key")), F.col("doc_id") == F.col("rep")).select("text", "key")
    sets = _sets(of_ids, n)
    again = seen.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count() > 0
    if alive.where("rep is null").limit(1).count():  # classes without any doc_id: looked for among the texts without
        unnamed = _sets(docs.where("doc_id is null").select("text", F.lit(None).cast("binary").alias("key")), n)
        sets, again = sets.union(unnamed.join(small(alive.where("rep is null").select("name")), "name", "left_semi")), True
    sets = written(sets.dropDuplicates(["name"]) if again else sets, "survivors")

    each = sets.select("name", F.explode("shingles").alias("s"))
    shared = each.join(each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "s")
    lists = shared.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("df", "s")))["s"].alias("shingles"))
    lists = lists.join(alive.select("name", "n", "copies"), "name")
    lists = lists.withColumn("first", F.expr(f"n - cast(ceil(n * {percent} / 100D) as long) + 1 - (n - size(shingles))")).where("first > 0")
    lists = written(lists, "lists", left)
    discard(sets)
    heads = lists.select("name", F.explode(F.slice("shingles", 1, F.col("first").cast("int"))).alias("s"))
    blocks = components(heads.join(heads.groupBy("s").agg(F.min("name").alias("low")), "s").select("name", "low"), "name", "low", left)
    lists = lists.join(blocks.withColumnRenamed("id", "name"), "name")
    parts = lists.groupBy("component").agg(F.ceil(F.sum(F.size("shingles")) / F.lit(PART)).cast("int").alias("parts"))
    lists = lists.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    if links:
        tasks = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        tasks = tasks.select("component", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "name", "n", "copies", "part", "shingles")
        joined = tasks.groupBy("component", "a", "b").applyInArrow(kernels.trimmed(lambda t: _joined(t, percent, 100)), "name long, links long, root long")
        joined = written(joined, "joined")
        edges = joined.where("name <> root").select("name", "root")
    else:
        edges = _edges(written(lists.select("component", "part", "parts", "name", "n", "shingles"), "parts", left), percent, left)
    found = components(edges, "name", "root", left).withColumnRenamed("id", "half")
    found = classes.select("key", "half", "rep", "copies").join(found, "half", "left")
    low = found.where("component is not null").groupBy("component").agg(F.min("rep").alias("low"))
    found = found.join(low, "component", "left")
    if links:
        found = found.join(joined.groupBy(F.col("name").alias("half")).agg(F.sum("links").alias("links")), "half", "left")
    out = seen.drop("half").join(found.drop("half", "component"), "key", "left")
    counted = [(F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links")] if links else []
    return out.select("doc_id", "n_shingles", *counted, F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.coalesce("low", "rep")).alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each class of jaccard_join, that of the smallest doc_id; columns as before.

    Rows without doc_id stay, as nothing tells them apart. Of repeated rows of a doc_id one stays.
    """
    classes = written(jaccard_join(docs, n, percent, links=False), "near")
    gone = written(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_near_id")).distinct(), "gone", classes.count())
    kept = docs.join(small(gone), docs["doc_id"] == gone["_near_id"], "left_anti")
    if classes.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
    return kept
