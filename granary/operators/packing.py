"""Ranks and character budgets of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The most hits that a query may ask for.
MOST = 50


def ranked(scored: DataFrame, *by: str, ascending: bool = False, tie: str = "chunk_id", score: str = "score") -> DataFrame:
    """scored with rank by score within by, ties by id. Only the MOST best rows of a group are kept; Spark cuts each
    partition's part of a group to those before the shuffle."""
    best = F.col(score).asc() if ascending else F.col(score).desc()
    order = Window.partitionBy(*by).orderBy(best, F.col(tie)) if by else Window.orderBy(best, F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST)


def packed(hits: DataFrame, by: str = "query_id", k: str = "top_k", budget: str = "max_chars") -> DataFrame:
    """Ranked hits (query, rank, text, top_k, max_chars) cut to their query's k and budget of characters.

    A hit's excerpt is the beginning of its text, as long as the excerpts before it leave room for; hits behind the last
    room are dropped. truncated says whether the excerpt is less than the text.
    """
    before = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = hits.where(F.col("rank") <= F.col(k)).withColumn("_used", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    rows = rows.where(F.col("_used") < F.col(budget)).withColumn("_room", (F.col(budget) - F.col("_used")).cast("int"))
    rows = rows.withColumn("truncated", F.length("text") > F.col("_room")).withColumn("text", F.substr("text", F.lit(1), F.col("_room")))
    return rows.drop("_used", "_room")
