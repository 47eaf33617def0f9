"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import small, written

#: Fixed masks over consecutive tokens: 1 counts, 0 is ignored. Agreement without any of them is 1100 and 10 in a row, so half of the
#: tokens and one more at most: every alignment that hits accepts by its defaults has a seed.
MASKS = ("111", "1101")
#: Seeds, one for each mask and place of a benchmark text, in a block that is broadcast, about.
SEEDS = 1_000_000
#: Tokens of an alignment up to which its least number of seeds is worked out for each length.
LENGTHS = 64
#: Tokens of a document whose seeds are made together, which bounds what a long text takes.
SEGMENT = 4096


def token_hashes(text: Column) -> Column:
    """Hashes of the tokens: runs of letters and digits, lower-cased."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda t: F.xxhash64(t))


def _seeds(tokens: str, mask: int, masks: Sequence[str]) -> Column:
    """The hashes of a mask's counted tokens from each place on at which the shortest mask fits; null where this one doesn't."""
    counted = ", ".join(f"{tokens}[i + {j}]" for j, c in enumerate(masks[mask]) if c == "1")
    places = f"sequence(0, size({tokens}) - {min(map(len, masks))})"
    return F.expr(f"transform({places}, i -> if(i + {len(masks[mask])} <= size({tokens}), xxhash64({mask}, {counted}), null))")


def _placed(df: DataFrame, tokens: str, masks: Sequence[str]) -> DataFrame:
    """df's other columns with seed and the place where it begins; rows with fewer tokens than any mask have none."""
    rest = [c for c in df.columns if c != tokens]
    df = df.where(F.size(tokens) >= min(map(len, masks))).withColumn("_n", F.size(tokens) - min(map(len, masks)) + 1)
    each = df.select(*rest, "_n", F.posexplode(F.concat(*[_seeds(tokens, m, masks) for m in range(len(masks))])).alias("_at", "seed"))
    return each.where("seed is not null").select(*rest, "seed", (F.col("_at") % F.col("_n")).alias("place"))


def fewest(masks: Sequence[str], n: int, matched: int) -> int:
    """The seeds that any alignment of n tokens has at least, if so many of them agree."""
    span = max(map(len, masks))
    least = {("", 0): 0}  # by the last span - 1 tokens and the number that agree
    for _ in range(n):
        longer: dict[tuple[str, int], int] = {}
        for (end, ones), seeds in least.items():
            for c in "01":
                seen = end + c
                new = seeds + sum(len(m) <= len(seen) and all(a == "0" or b == "1" for a, b in zip(m, seen[-len(m) :])) for m in masks)
                key = seen[max(0, len(seen) - span + 1) :], ones + int(c)
                longer[key] = min(longer.get(key, new), new)
        least = longer
    return min((x for (_, ones), x in least.items() if ones >= matched), default=0)


@cache
def _needed(masks: Sequence[str], least: float, floor: int, window: int, within: int) -> list[int]:
    """For each length of an alignment the seeds that it has at least if hits accepts it; the last is for all lengths from LENGTHS on.

    An alignment that is longer falls into parts of LENGTHS / 2 to LENGTHS tokens, one of which agrees in the share.
    """
    found = [fewest(masks, n, n if n < floor else max(floor, ceil(least * n))) for n in range(LENGTHS)]
    found.append(min(fewest(masks, n, ceil(least * n)) for n in range(LENGTHS // 2, LENGTHS)))
    part = fewest(masks, window, within)
    return [max(1, x if n < window else min(x, part)) for n, x in enumerate(found)]


def _pairs(docs: DataFrame, benchmark: DataFrame, least: float, floor: int, window: int, within: int, masks: Sequence[str]) -> DataFrame:
    """(key, doc_id, item_id, tokens, matched) of documents (key, doc_id, text): a row for each accepted alignment."""
    shortest, longest = min(map(len, masks)), max(map(len, masks))
    items = benchmark.select(F.col("item_id").cast("long"), token_hashes(F.col("text").cast("string")).alias("item")).where("item_id is not null and size(item) > 0")
    # rows of one item_id may hold other texts, so a text has a name of its own
    items = written(items.withColumn("text_key", F.xxhash64("item")).withColumn("length", F.size("item")).distinct(), "items")
    seeds = written(_placed(items, "item", masks), "seeds")
    blocks = max(1, -(-seeds.count() // SEEDS))
    hashed = docs.select("key", token_hashes(F.col("text")).alias("doc")).where(F.size("doc") >= shortest).withColumn("size", F.size("doc"))
    segments = hashed.withColumn("base", F.explode(F.sequence(F.lit(0), F.size("doc") - shortest, F.lit(SEGMENT))))
    segments = segments.select("key", "size", "base", F.slice("doc", F.col("base") + 1, F.lit(SEGMENT + longest - 1)).alias("doc"))
    each = _placed(segments, "doc", masks).withColumnRenamed("place", "at")
    common = F.least(F.col("length"), F.col("size") - F.col("shift")) - F.greatest(F.lit(0), -F.col("shift"))
    needed = F.array(*map(F.lit, _needed(tuple(masks), least, floor, window, within)))
    aligned = []
    for k in range(blocks):
        own = seeds.where(F.pmod(F.col("text_key"), F.lit(blocks)) == k) if blocks > 1 else seeds
        met = each.join(small(own, 2 * SEEDS), "seed")
        met = met.groupBy("key", "size", "item_id", "text_key", "length", (F.col("base") + F.col("at") - F.col("place")).alias("shift")).agg(F.count("*").alias("n"))
        aligned.append(met.where(F.col("n") >= F.get(needed, F.least(common, F.lit(LENGTHS)))).select("key", "item_id", "text_key", "shift").distinct())
    met = written(reduce(DataFrame.union, aligned), "alignments")

    again = docs.join(small(met.select(F.col("key").alias("_key")).distinct()), F.col("key") == F.col("_key"), "left_semi").dropDuplicates(["key"])
    pairs = again.select("key", "doc_id", token_hashes(F.col("text")).alias("doc")).join(met, "key").join(small(items), ["item_id", "text_key"])
    # the part of the benchmark text that lies within the document
    pairs = pairs.withColumn("a", F.greatest(F.lit(0), -F.col("shift"))).withColumn("b", F.greatest(F.col("a"), F.least(F.col("length"), F.size("doc") - F.col("shift"))))
    pairs = pairs.select("key", "doc_id", "item_id", F.col("length").alias("tokens"), F.expr("zip_with(slice(item, a + 1, b - a), slice(doc, shift + a + 1, b - a), (x, y) -> int(x = y))").alias("same"))
    pairs = pairs.withColumn("matched", F.aggregate("same", F.lit(0), lambda n, x: n + x))
    part = F.expr(f"exists(sequence(0, size(same) - {window}), i -> aggregate(slice(same, i + 1, {window}), 0, (n, x) -> n + x) >= {within})")
    enough = (F.col("matched") >= F.lit(least) * F.size("same")) & (F.col("matched") >= F.least(F.lit(floor), F.col("tokens"))) | F.when((F.col("matched") >= within) & (F.size("same") >= window), part)
    found = pairs.where(enough).select("key", "doc_id", "item_id", "tokens", "matched")

    # texts of fewer tokens than a mask: whole or not at all, so their own hash is the seed
    for n in sorted(r.length for r in items.where(F.col("length") < shortest).select("length").distinct().collect()):
        named = lambda t: F.expr(f"transform(sequence(0, size({t}) - {n}), i -> xxhash64(slice({t}, i + 1, {n})))")
        own = items.where(F.col("length") == n).select("item_id", named("item")[0].alias("seed"))
        there = docs.select("key", "doc_id", token_hashes(F.col("text")).alias("doc")).where(F.size("doc") >= n).select("key", "doc_id", F.explode(F.array_distinct(named("doc"))).alias("seed"))
        found = found.union(there.join(small(own, SEEDS), "seed").select("key", "doc_id", "item_id", F.lit(n), F.lit(n)))
    return found


def _keyed(docs: DataFrame) -> Column:
    """Names a row by id and text, so that rows without id, and rows of one id, are told apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def hits(docs: DataFrame, benchmark: DataFrame, least: float = 0.6, floor: int = 8, window: int = 13, within: int = 11, masks: Sequence[str] = MASKS) -> DataFrame:
    """(doc_id, item_id, tokens, matched): the benchmark texts that documents hold, with substitutions at most.

    docs: doc_id, text; benchmark: item_id, text. A seed found in both fixes how the two texts lie on each other; along that
    alignment the tokens are compared, whatever lies between seeds. The pair is reported if a whole benchmark text, or what of
    it the document's ends leave, agrees in a share of least, and in floor tokens or more (all of it, if it has fewer); or if
    a part of it does: within tokens of some window of them. matched is the best alignment's count (of equal ones that of the
    longest text), tokens the benchmark text's length. With the default masks no such alignment is without a seed.

    Null and empty texts have no tokens and are in no pair. Documents and benchmark texts without an id can't be named and are
    left out (clean takes such documents into account). Repeated rows of a document give one pair; rows of one item_id with
    other texts are looked for each. Texts are searched whole, however long. Other columns are ignored, whatever their names.
    Empty tables: empty result.

    The seeds of documents, in segments of SEGMENT tokens, are looked up in a broadcast table of the benchmark's seeds, in
    blocks of whole benchmark texts of about SEEDS seeds, with a pass over the documents for each; equal alignments are put
    together before they move. Alignments with fewer seeds than any accepted one of their length has are dropped, and only the
    documents of the others are read again and compared. Benchmark texts shorter than a mask are looked up by their own hash.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    found = _pairs(own.select(_keyed(own).alias("key"), "doc_id", "text"), benchmark, least, floor, window, within, masks)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "tokens")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.tokens").cast("long").alias("tokens"), F.col("best.matched").cast("long").alias("matched"))


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.6, floor: int = 8, window: int = 13, within: int = 11, masks: Sequence[str] = MASKS) -> DataFrame:
    """docs without the rows that hold a benchmark text, with or without doc_id; columns as before."""
    own = docs.select(_keyed(docs).alias("key"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bad = written(_pairs(own, benchmark, least, floor, window, within, masks).select(F.col("key").alias("_leak_key")).distinct(), "leaks")
    return docs.join(small(bad), _keyed(docs) == F.col("_leak_key"), "left_anti")
