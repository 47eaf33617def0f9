"""Token-limited windows of chunks, and vectors remembered by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.identity import json_array, json_text, sha256

#: Prefixes of the e5 template by role.
PREFIXES = {"e5-v1": {"query": "query: ", "passage": "passage: "}, "plain-v1": {"query": "", "passage": ""}}


def prepared(text: Column, role: str, template: str) -> Column:
    """The text as a template of an embedding model wants it."""
    return F.concat(F.lit(PREFIXES[template][role]), text)


def windows_of(text: str, context: str, count: Callable[[str], int], limit: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of consecutive windows that cover the text, each the longest whose count with the context before
    it is within limit. Counts must not fall as a text grows."""
    if count(context) >= limit:
        raise ValueError("the title leaves no room in a window")
    out, start = [], 0
    while start < len(text):
        low, high = start, min(len(text), start + max(1, limit) * 64)
        while high < len(text) and count(context + text[start:high]) <= limit:
            low, high = high, min(len(text), high + (high - start))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if count(context + text[start:middle]) <= limit else (low, middle - 1)
        if low == start:
            raise ValueError("a single character doesn't fit into a window")
        out.append((start, low, count(context + text[start:low])))
        start = low
    return out


def fixed_windows(chunks: DataFrame, limit: int, overhead: int = 2) -> DataFrame:
    """The same in closed form where a text's tokens are its characters and overhead more: chunk_id, start, end, tokens, text.

    chunks: chunk_id, context, text. A context that leaves no room is an error.
    """
    room = F.lit(limit - overhead) - F.length("context")
    checked = F.when(room < 1, F.raise_error(F.lit("the title leaves no room in a window"))).otherwise(room.cast("int"))
    rows = chunks.withColumn("_room", checked).where(F.length("text") > 0)
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.col("_room"))))
    end = F.least(F.col("start") + F.col("_room"), F.length("text"))
    return rows.select("chunk_id", "start", end.alias("end"), (end - F.col("start") + F.length("context") + overhead).alias("tokens"), F.substr("text", F.col("start") + 1, end - F.col("start")).alias("text"))


def cache_key(fingerprint: Column, role: str, text: Column) -> Column:
    """Names a prepared text's vector under a model."""
    return sha256(json_array(json_text(fingerprint), F.lit(f'"{role}"'), json_text(text)))


def missing(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct wanted (key, text) that the cache (key, vector) lacks: what has to be encoded, once each."""
    return wanted.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def remembered(wanted: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """wanted with vector, from the cache or from what was encoded."""
    return wanted.join(cache.select("key", "vector").unionByName(fresh.select("key", "vector")), "key")
