"""The driver's tables as the engine's entities: documents, chunks, cases, points."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.identity import sha256
from granary.operators.lexical import bounded, metadata_values


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (kb:path), kb_id, path, source_hash, pipeline_hash, title, metadata, content, and doc_id, lang, quality."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    quality = F.when(F.col("quality").isNull(), "").otherwise(F.concat(F.lit(',"quality":'), F.col("quality").cast("string")))
    return docs.select(
        F.concat("source", F.lit(":d"), "doc_id").alias("id"), F.col("source").alias("kb_id"), F.concat(F.lit("d"), "doc_id").alias("path"),
        sha256(F.col("text")).alias("source_hash"), F.lit("p1").alias("pipeline_hash"), F.concat(F.lit("d"), "doc_id").alias("title"),
        F.concat(F.lit('{"lang":"'), "lang", F.lit('"'), quality, F.lit("}")).alias("metadata"), F.col("text").alias("content"), "doc_id", "lang", "quality",
    )


#: The same for SQL.
DOCUMENTS = """docs AS (
    SELECT source || ':d' || doc_id AS id, source AS kb_id, 'd' || doc_id AS path, sha256(text) AS source_hash, 'p1' AS pipeline_hash, 'd' || doc_id AS title,
        '{"lang":"' || lang || '"' || CASE WHEN quality IS NULL THEN '' ELSE ',"quality":' || quality END || '}' AS metadata, text AS content, doc_id, lang, quality
    FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk: chunk_id, doc_id, kb_id, title, heading, text, metadata, source_hash, values."""
    d = documents(spark, sf_dir)
    return d.select(F.col("path").alias("chunk_id"), F.col("id").alias("doc_id"), "kb_id", "title", F.lit("").alias("heading"), F.col("content").alias("text"), "metadata", "source_hash", metadata_values(F.col("metadata")).alias("values"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th benchmark text, whole, as a query; every third of them in two knowledge bases, every fifth in one language."""
    b = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0")
    n = (F.col("item_id") / 20).cast("long")
    return b.select(
        F.concat(F.lit("q"), "item_id").alias("query_id"), "text",
        F.when(n % 3 == 0, F.array(F.lit("src0"), F.lit("src3"))).alias("kb_ids"),
        F.when(n % 5 == 0, F.create_map(F.lit("lang"), F.lit('"en'))).alias("filters"),
        F.lit(5).alias("top_k"), F.lit(20_000).alias("max_chars"),
    )


#: Queries, members of their scopes, and their terms.
QUERIES = """q AS (
    SELECT 'q' || item_id AS query_id, text, (item_id // 20) % 3 = 0 AS two, (item_id // 20) % 5 = 0 AS en FROM benchmark WHERE item_id % 20 = 0),
member AS (SELECT q.query_id, d.path AS chunk_id FROM q JOIN docs d ON (NOT q.two OR d.kb_id IN ('src0', 'src3')) AND (NOT q.en OR d.lang = 'en')),
bag AS (SELECT path AS chunk_id, regexp_extract_all(lower(title || chr(10) || chr(10) || content), '[a-z0-9_]+') AS tokens FROM docs),
term AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM q),
tf AS (SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS token FROM bag) GROUP BY ALL),
found AS (SELECT m.query_id, m.chunk_id, t.token, tf.tf, len(b.tokens) AS length FROM term t JOIN tf USING (token) JOIN member m ON m.query_id = t.query_id AND m.chunk_id = tf.chunk_id JOIN bag b ON b.chunk_id = m.chunk_id)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: point_id, chunk_id (two points each), doc_id, kb_id (label), source_hash, vector, values."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("point_id"), F.concat(F.lit("c"), (F.col("vec_id") / 2).cast("long")).alias("chunk_id"), F.concat(F.lit("d"), (F.col("vec_id") / 4).cast("long")).alias("doc_id"),
        F.concat(F.lit("kb"), "label").alias("kb_id"), F.lit("h").alias("source_hash"), F.col("embedding").cast("array<double>").alias("vector"),
        F.create_map(F.lit("even"), F.when(F.col("vec_id") % 2 == 0, "1.0").otherwise("0.0")).alias("values"),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th embedding as a query; every third of them in one knowledge base, every fourth among even points."""
    p = points(spark, sf_dir).where("point_id % 20 = 0")
    n = (F.col("point_id") / 20).cast("long")
    return p.select(
        F.col("point_id").alias("query_id"), "vector", F.when(n % 3 == 0, F.array("kb_id")).alias("kb_ids"),
        F.when(n % 4 == 0, F.create_map(F.lit("even"), F.lit("1.0"))).alias("filters"), F.lit(5).alias("top_k"), F.lit(20_000).alias("max_chars"),
    )


#: Points in the queries' scopes with their cosine.
POINTS = """p AS (SELECT vec_id AS point_id, 'c' || vec_id // 2 AS chunk_id, 'd' || vec_id // 4 AS doc_id, 'kb' || label AS kb_id, embedding::DOUBLE[] AS v, vec_id % 2 = 0 AS even FROM embeddings),
s AS (SELECT q.point_id AS query_id, p.*, list_dot_product(q.v, p.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(p.v, p.v))) AS score
    FROM p q JOIN p ON q.point_id % 20 = 0 AND ((q.point_id // 20) % 3 <> 0 OR p.kb_id = q.kb_id) AND ((q.point_id // 20) % 4 <> 0 OR p.even))"""


def kept(df: DataFrame, _: str = "") -> DataFrame:
    """df computed once for all its users in a query: a few rows, on the executors' disks; lost ones are computed again."""
    return df.persist(StorageLevel.DISK_ONLY)


#: Words of a benchmark text that name the documents which may hold it.
NAMED = 5


def holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs' columns and item_id, contains: the documents whose content holds an item's text (item_id, contains) verbatim.

    Documents are looked up by runs of NAMED words: of an item's words all but the first and the last surely stand in a holder
    as words, so a run of them does. Only the documents that have it are searched. Items of fewer words meet all documents.
    """
    words = lambda c: F.split(c, r"[\x20\x09-\x0D]+")
    listed = items.select("item_id", "contains", words(F.col("contains")).alias("w"))
    inner = listed.where(F.size("w") >= NAMED + 2).withColumn("run", F.xxhash64(F.slice("w", 2, NAMED)))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (NAMED - 1)), lambda i: F.xxhash64(F.slice(F.col("w"), i, F.lit(NAMED))))
    each = docs.withColumn("w", words(F.col("content"))).where(F.size("w") >= NAMED).select("id", F.explode(F.array_distinct(runs)).alias("run"))
    near = each.join(bounded(inner.select("run", "item_id", "contains"), 100_000), "run").select("id", "item_id", "contains").distinct()
    found = docs.join(near, "id")
    short = docs.join(bounded(listed.where(F.size("w") < NAMED + 2).select("item_id", "contains"), 10_000), F.contains("content", "contains"))
    return found.where(F.contains("content", "contains")).unionByName(short)


def cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, labels, hits): all benchmark texts as cases, documents that hold them as labels, and hits drawn by id.

    A case's category is its item modulo 4; those of 3 have a knowledge base. Hits of case i are the documents whose id is i
    modulo the number of items (none for every seventh case) and the labelled ones, ranked by id; a hit's text is the whole
    document.
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("contains"))
    d = documents(spark, sf_dir)
    name = F.concat(F.lit("q"), "item_id").alias("case_id")
    of = b.select(name, F.concat(F.lit("cat"), F.col("item_id") % 4).alias("category"), F.when(F.col("item_id") % 4 == 3, F.array(F.lit("src1"), F.lit("src2"), F.lit("src5"))).alias("kb_ids"))
    held = kept(holding(d, b).select("item_id", "contains", "id", "kb_id", "doc_id"))
    labels = held.select(name, F.col("id").alias("doc_id"), "contains")
    turn = F.col("doc_id") % F.lit(max(1, b.count()))
    drawn = d.join(bounded(b.where("item_id % 7 <> 0").select("item_id"), 100_000), turn == F.col("item_id"))
    both = drawn.select("item_id", F.col("doc_id").alias("n"), "id").union(held.select("item_id", F.col("doc_id").alias("n"), "id")).distinct()
    from granary.operators.packing import ranked

    # ranked by ids alone; only the documents of hits are joined with their texts
    hits = ranked(both.select(name, F.col("n").cast("double").alias("score"), F.col("id").alias("doc_id")), "case_id", ascending=True, tie="doc_id").where("rank <= 5")
    return of, labels, hits.join(d.select(F.col("id").alias("doc_id"), "kb_id", F.col("content").alias("text")), "doc_id")


CASES = """b AS (SELECT item_id, text AS contains FROM benchmark),
of AS (SELECT item_id, 'q' || item_id AS case_id, 'cat' || item_id % 4 AS category, CASE WHEN item_id % 4 = 3 THEN ['src1', 'src2', 'src5'] END AS kb_ids FROM b),
held AS (SELECT item_id, doc_id AS n, id, kb_id, content, contains FROM docs JOIN b ON contains(content, contains)),
labelled AS (SELECT 'q' || item_id AS case_id, id AS doc_id, contains FROM held),
hit AS (
    SELECT 'q' || item_id AS case_id, id AS doc_id, kb_id, content AS text, row_number() OVER (PARTITION BY item_id ORDER BY n, id) AS rank
    FROM (SELECT item_id, doc_id AS n, id, kb_id, content FROM docs JOIN b ON doc_id % (SELECT count(*) FROM b) = item_id AND item_id % 7 <> 0 UNION SELECT item_id, n, id, kb_id, content FROM held)
    QUALIFY rank <= 5),
earned AS (
    SELECT case_id, doc_id, min(rank) AS rank FROM hit JOIN labelled USING (case_id, doc_id) WHERE contains(text, contains) GROUP BY ALL),
per AS (
    SELECT case_id, category, kb_ids,
        (SELECT count(DISTINCT doc_id) FROM labelled l WHERE l.case_id = o.case_id) AS expected,
        (SELECT count(*) FROM earned e WHERE e.case_id = o.case_id) AS found,
        (SELECT min(rank) FROM earned e WHERE e.case_id = o.case_id) AS first,
        (SELECT coalesce(sum(1 / log2(rank + 1)), 0) FROM earned e WHERE e.case_id = o.case_id) AS dcg,
        (SELECT count(*) FROM hit h WHERE h.case_id = o.case_id) AS hits,
        (SELECT count(*) FROM hit h WHERE h.case_id = o.case_id AND o.kb_ids IS NOT NULL AND NOT list_contains(o.kb_ids, h.kb_id)) AS kb_leakage
    FROM of o),
metric AS (
    SELECT case_id, category, CASE WHEN expected > 0 THEN found / expected END AS recall_at_k, CASE WHEN expected > 0 THEN (found > 0)::DOUBLE END AS hit_at_k,
        CASE WHEN expected > 0 THEN coalesce(1.0::DOUBLE / first, 0) END AS mrr_at_k,
        CASE WHEN expected > 0 THEN dcg / list_sum([1 / log2(i + 1) for i in range(1, least(expected, 5) + 1)]) END AS ndcg_at_k,
        CASE WHEN expected > 0 THEN found / 5.0::DOUBLE END AS precision_at_k, CASE WHEN expected = 0 THEN (hits = 0)::DOUBLE END AS empty_on_unanswerable,
        CASE WHEN expected > 0 THEN (hits = 0)::DOUBLE END AS empty_on_answerable, kb_leakage::BIGINT AS kb_leakage
    FROM per)"""
