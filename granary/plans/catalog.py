"""Queries of the engine's operators over the driver's tables, each with its SQL. Keys begin with the survey's ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import identity, text
from granary.operators import audit, evaluate, lexical, packing, segments, sync
from granary.plans import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def big(x, name: str):
    return F.col(x).cast("bigint").alias(name) if isinstance(x, str) else x.cast("bigint").alias(name)


def six(x, name: str):
    return F.round(x, 6).alias(name)


D = f"WITH {T.DOCUMENTS} "

# --- scans -------------------------------------------------------------------------------------------------------------


@query("s2_read_hash", "SELECT doc_id, sha256(text) AS source_hash, strlen(text)::BIGINT AS size FROM documents")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id", identity.sha256(F.col("text")).alias("source_hash"), big(F.octet_length("text"), "size"))


@query("s4_snapshot_scan", D + "SELECT path AS chunk_id, kb_id, title, metadata, source_hash, length(content)::BIGINT AS n FROM docs")
def _(s, d):
    return T.chunks(s, d).select("chunk_id", "kb_id", "title", "metadata", "source_hash", big(F.length("text"), "n"))


@query("s5_point_lookup", D + "SELECT id, title, source_hash FROM docs WHERE id = 'src7:d7'")
def _(s, d):
    return T.documents(s, d).where("id = 'src7:d7'").select("id", "title", "source_hash")


@query("s6_manifest", D + "SELECT id, source_hash FROM docs")
def _(s, d):
    return T.documents(s, d).select("id", "source_hash").orderBy("id")


@query("s8_case_checks", "SELECT count(*) AS cases, count(DISTINCT item_id) AS ids, count(*) FILTER (trim(text) = '') AS blank FROM benchmark")
def _(s, d):
    return T.table(s, d, "benchmark").agg(F.count("*").alias("cases"), F.countDistinct("item_id").alias("ids"), big(F.sum((F.trim("text") == "").cast("int")), "blank"))


@query("s10_trace_scan", "SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 100 = 0) GROUP BY 1")
def _(s, d):
    e = T.table(s, d, "events")
    return e.join(e.where("event_id % 100 = 0").select("user_id"), "user_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


# --- synchronisation ---------------------------------------------------------------------------------------------------

TWO = f"""WITH {T.DOCUMENTS},
before AS (SELECT id, source_hash, pipeline_hash, strlen(content) AS size FROM docs WHERE doc_id % 11 <> 0),
now AS (SELECT id, sha256(CASE WHEN doc_id % 5 = 1 THEN content || '!' ELSE content END) AS source_hash, pipeline_hash, strlen(content) + (doc_id % 5 = 1)::INT AS size FROM docs WHERE doc_id % 7 <> 0),
change AS (
    SELECT coalesce(n.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' WHEN n.source_hash = b.source_hash THEN 'unchanged' ELSE 'updated' END AS status
    FROM now n FULL JOIN before b ON n.id = b.id) """


def two(s, d) -> tuple[DataFrame, DataFrame]:
    """A snapshot without every 11th document, and files without every 7th and with every 5th changed."""
    docs = T.documents(s, d)
    content = F.when(F.col("doc_id") % 5 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    now = docs.where("doc_id % 7 <> 0").withColumn("content", content).withColumn("source_hash", identity.sha256(F.col("content"))).withColumn("size", F.octet_length("content"))
    return docs.where("doc_id % 11 <> 0"), now


@query("j3_change_status", TWO + "SELECT id, status FROM change")
def _(s, d):
    before, now = two(s, d)
    return sync.changes(now, before)


@query("j2_stale", TWO + "SELECT id FROM before ANTI JOIN now USING (id)")
def _(s, d):
    before, now = two(s, d)
    return before.join(now, "id", "left_anti").select("id")


@query("k1_next_snapshot", TWO + "SELECT id, source_hash FROM now")
def _(s, d):
    before, now = two(s, d)
    none = s.createDataFrame([], "chunk_id string, doc_id string, heading string, start_line int, end_line int, text string")
    return sync.synchronised(now.drop("pipeline_hash"), before, none, 1200)[0].select("id", "source_hash")


@query("a10_ingest_counters", TWO + """SELECT (SELECT count(*) FROM now) AS files, (SELECT sum(size)::BIGINT FROM now) AS bytes_read,
    count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'deleted') AS deleted FROM change""")
def _(s, d):
    before, now = two(s, d)
    return sync.counters(sync.changes(now, before), now)


@query("u2_difference", TWO + "SELECT id FROM before EXCEPT SELECT id FROM now")
def _(s, d):
    before, now = two(s, d)
    return before.select("id").subtract(now.select("id"))


@query("u5_equal_sets", TWO + "SELECT (SELECT count(*) FROM (SELECT id FROM before EXCEPT ALL SELECT id FROM now)) AS only_before, (SELECT count(*) FROM (SELECT id FROM now EXCEPT ALL SELECT id FROM before)) AS only_now")
def _(s, d):
    before, now = (x.select("id") for x in two(s, d))
    return before.exceptAll(now).agg(F.count("*").alias("only_before")).crossJoin(now.exceptAll(before).agg(F.count("*").alias("only_now")))


@query("j12_fresh", TWO + "SELECT NOT EXISTS (SELECT id, source_hash FROM now EXCEPT SELECT id, source_hash FROM before) AND NOT EXISTS (SELECT id, source_hash FROM before EXCEPT SELECT id, source_hash FROM now) AS fresh")
def _(s, d):
    before, now = (x.select("id", "source_hash") for x in two(s, d))
    off = before.exceptAll(now).union(now.exceptAll(before))
    return off.agg((F.count("*") == 0).alias("fresh"))


@query("j12_changed_versions", TWO + "SELECT id FROM change WHERE status <> 'unchanged'")
def _(s, d):
    """What differs between two versions, by their hash trees."""
    before, now = two(s, d)
    return sync.changed_versions(before, now)


@query("u1_union_sources", D + "SELECT id FROM docs WHERE kb_id = 'src1' UNION ALL SELECT id FROM docs WHERE kb_id = 'src2'")
def _(s, d):
    docs = T.documents(s, d)
    return docs.where("kb_id = 'src1'").unionByName(docs.where("kb_id = 'src2'")).select("id")


# --- filters and counts ------------------------------------------------------------------------------------------------


@query("p1_scope", D + "SELECT id FROM docs WHERE kb_id IN ('src0', 'src3')")
def _(s, d):
    return T.documents(s, d).where(lexical.in_scope(F.col("kb_id"), F.array(F.lit("src0"), F.lit("src3")))).select("id")


@query("p2_metadata_filter", D + "SELECT id FROM docs WHERE lang = 'en' AND quality = 1")
def _(s, d):
    wanted = F.create_map(F.lit("lang"), F.lit('"en'), F.lit("quality"), F.lit("1.0"))
    return T.chunks(s, d).where(lexical.matches(F.col("values"), wanted)).select(F.col("doc_id").alias("id"))


@query("p2_null_filter", D + "SELECT id FROM docs WHERE quality IS NULL")
def _(s, d):
    wanted = F.create_map(F.lit("quality"), F.lit(None).cast("string"))
    return T.chunks(s, d).where(lexical.matches(F.col("values"), wanted)).select(F.col("doc_id").alias("id"))


@query("p3_configured_sources", D + "SELECT id FROM docs WHERE kb_id IN (SELECT DISTINCT 'src' || n_nationkey FROM nation WHERE n_nationkey < 5)")
def _(s, d):
    configured = T.table(s, d, "nation").where("n_nationkey < 5").select(F.concat(F.lit("src"), "n_nationkey").alias("kb_id"))
    return T.documents(s, d).join(configured, "kb_id", "left_semi").select("id")


@query("p11_oversize", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 8000")
def _(s, d):
    return T.table(s, d, "documents").where("n_chars > 8000").select("doc_id", "n_chars")


@query("p12_private_path", "SELECT page_id, lower(regexp_replace(replace(url, '\\', '/'), '/+', '/', 'g')) LIKE 'https:/www.%' OR regexp_matches(lower(regexp_replace(replace(url, '\\', '/'), '/+', '/', 'g')), '#top$') AS private FROM pages")
def _(s, d):
    return T.table(s, d, "pages").select("page_id", audit.private_path(F.col("url"), ["https:/www."], ["#top$"]).alias("private"))


@query("a1_documents_by_kb", D + "SELECT kb_id, count(*) AS documents FROM docs GROUP BY 1")
def _(s, d):
    return T.documents(s, d).groupBy("kb_id").agg(F.count("*").alias("documents")).orderBy("kb_id")


@query("j13_status_counts", D + "SELECT 'src' || k.n_nationkey AS kb_id, count(docs.id) AS documents FROM nation k LEFT JOIN docs ON docs.kb_id = 'src' || k.n_nationkey GROUP BY 1")
def _(s, d):
    configured = T.table(s, d, "nation").select(F.concat(F.lit("src"), "n_nationkey").alias("kb_id"))
    counts = T.documents(s, d).groupBy("kb_id").agg(F.count("*").alias("documents"))
    return configured.join(counts, "kb_id", "left").select("kb_id", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"))


@query("a28_preview_totals", "SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(*) FILTER (strlen(text) > 8000) AS oversize FROM documents")
def _(s, d):
    size = F.octet_length("text")
    return T.table(s, d, "documents").agg(F.count("*").alias("files"), big(F.sum(size), "bytes"), big(F.sum((size > 8000).cast("int")), "oversize"))


@query("l5_first_document", D + "SELECT kb_id, min(id) AS id FROM docs WHERE kb_id = 'src4' GROUP BY 1")
def _(s, d):
    return T.documents(s, d).where("kb_id = 'src4'").orderBy("id").limit(1).select("kb_id", "id")


@query("a26_corpus_hash", D + """SELECT sha256('[' || string_agg('{"id":"' || id || '","source_hash":"' || source_hash || '"}', ',' ORDER BY id) || ']') AS corpus_hash FROM docs""")
def _(s, d):
    return identity.corpus_hash(T.documents(s, d))


@query("j1_chunk_document", D + "SELECT d.path AS chunk_id, d.title, d.source_hash FROM docs d JOIN docs e ON d.id = e.id WHERE e.kb_id <> 'src9'")
def _(s, d):
    docs = T.documents(s, d)
    c = docs.select(F.col("path").alias("chunk_id"), F.col("id").alias("doc_id"))
    return c.join(docs.where("kb_id <> 'src9'").select(F.col("id").alias("doc_id"), "title", "source_hash"), "doc_id").drop("doc_id")


# --- tokens and lexical ranking ----------------------------------------------------------------------------------------

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


@query("f1_tokenize", f"SELECT doc_id, len({TOKENS})::BIGINT AS n, sha256(array_to_string({TOKENS}, ' ')) AS tokens FROM documents")
def _(s, d):
    t = text.tokens(F.col("text"))
    return T.table(s, d, "documents").select("doc_id", big(F.size(t), "n"), identity.sha256(F.array_join(t, " ")).alias("tokens"))


@query("f2_lower", "SELECT doc_id, sha256(lower(text)) AS low FROM documents")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id", identity.sha256(F.lower("text")).alias("low"))


@query("a2_term_frequency", f"SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY ALL")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


@query("a3_length", f"SELECT doc_id, len({TOKENS})::BIGINT AS length FROM documents")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id", big(F.size(text.tokens(F.col("text"))), "length"))


@query("a4_mean_length", f"SELECT source, round(avg(len({TOKENS})), 6) AS mean FROM documents GROUP BY 1")
def _(s, d):
    return T.table(s, d, "documents").groupBy("source").agg(six(F.avg(F.size(text.tokens(F.col("text")))), "mean"))


@query("a5_document_frequency", f"SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY 1")
def _(s, d):
    each = T.table(s, d, "documents").select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("df"))


@query("u3_token_overlap", f"""WITH b AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS token FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS token FROM documents)
    SELECT item_id, doc_id, count(*) AS shared FROM b JOIN d USING (token) GROUP BY ALL""")
def _(s, d):
    """All pairs of a benchmark text and a document that share tokens; pairs without a row share none."""
    own = lambda name, key: T.table(s, d, name).select(key, F.array_distinct(text.tokens(F.col("text"))).alias("tokens"))
    return lexical.shared(own("documents", "doc_id"), own("benchmark", "item_id"))


@query("u4_distinct_terms", f"SELECT item_id, len(list_distinct({TOKENS}))::BIGINT AS terms FROM benchmark")
def _(s, d):
    return T.table(s, d, "benchmark").select("item_id", big(F.size(F.array_distinct(text.tokens(F.col("text")))), "terms"))


LEX = f"WITH {T.DOCUMENTS}, {T.QUERIES}, "
OVERLAP = LEX + "score AS (SELECT query_id, chunk_id, count(*)::DOUBLE AS score FROM found GROUP BY ALL) "
BM25 = LEX + """stat AS (SELECT query_id, count(*) AS n, avg(len(tokens)) AS mean FROM member JOIN bag USING (chunk_id) GROUP BY 1),
df AS (SELECT query_id, token, count(*) AS df FROM found GROUP BY ALL),
score AS (
    SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)) ORDER BY token) AS score
    FROM found JOIN stat USING (query_id) JOIN df USING (query_id, token) GROUP BY ALL) """
TOP = """, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM score QUALIFY rank <= 5),
pack AS (
    SELECT query_id, chunk_id, rank, round(score, 6) AS score, content, coalesce(sum(length(content)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
    FROM top JOIN docs ON docs.path = chunk_id)
SELECT query_id, chunk_id, rank::BIGINT AS rank, score, sha256(substr(content, 1, (20000 - used)::BIGINT)) AS excerpt, length(content) > 20000 - used AS truncated FROM pack WHERE used < 20000"""


@query("a7_overlap_score", OVERLAP + "SELECT query_id, chunk_id, score FROM score")
def _(s, d):
    return lexical.scores(T.chunks(s, d), T.queries(s, d), "overlap")


@query("a6_bm25_score", BM25 + "SELECT query_id, chunk_id, round(score, 6) AS score FROM score")
def _(s, d):
    return lexical.scores(T.chunks(s, d), T.queries(s, d), keep=T.kept).select("query_id", "chunk_id", six(F.col("score"), "score"))


def excerpts(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", big("rank", "rank"), six(F.col("score"), "score"), identity.sha256(F.col("text")).alias("excerpt"), "truncated")


@query("c2_search_bm25", BM25 + TOP)
def _(s, d):
    return excerpts(lexical.search(T.chunks(s, d), T.queries(s, d), keep=T.kept))


@query("c2_search_overlap", OVERLAP + TOP)
def _(s, d):
    return excerpts(lexical.search(T.chunks(s, d), T.queries(s, d), "overlap", keep=T.kept))


@query("l1_bounded_top", BM25 + """, t AS (SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM score JOIN q USING (query_id) WHERE NOT en QUALIFY rank <= 5)
SELECT query_id, chunk_id, score, rank::BIGINT AS rank FROM t""")
def _(s, d):
    """The best chunks by a segment of the index: only spans whose bound reaches the best so far are read."""
    asked = T.queries(s, d).where("filters is null")
    hits = lexical.top(segments.made(T.chunks(s, d), T.kept), asked, T.kept)
    return hits.select("query_id", "chunk_id", six(F.col("score"), "score"), big("rank", "rank"))


@query("a5_index_counts", f"""WITH {T.DOCUMENTS}, bag AS (SELECT kb_id, unnest(list_distinct(regexp_extract_all(lower(title || chr(10) || chr(10) || content), '[a-z0-9_]+'))) AS token FROM docs)
SELECT kb_id, token, count(*) AS df FROM bag GROUP BY ALL""")
def _(s, d):
    """The counts that an index keeps for each knowledge base: documents come in two parts, and a third of the first goes again."""
    bags = lexical.bags(T.chunks(s, d)).select("chunk_id", "kb_id", "length", "tokens")
    n = F.substring("chunk_id", 2, 19).cast("long")
    first, last, back = bags.where(n % 2 == 0), bags.where(n % 2 == 1), bags.where(n % 6 == 0)
    none = bags.where("false")
    steps = [segments.deltas(first, none)[0], segments.deltas(last, back)[0], segments.deltas(back, none)[0]]
    every = steps[0].unionByName(steps[1]).unionByName(steps[2])
    return every.groupBy("kb_id", "token").agg(F.sum("df").alias("df"))


@query("j4_postings", LEX + "x AS (SELECT 1) SELECT query_id, chunk_id, token, tf FROM found")
def _(s, d):
    found, terms = lexical.scoped_postings(lexical.indexed(T.chunks(s, d)), T.queries(s, d))
    return found.join(terms, ["scope", "token"]).select("query_id", "chunk_id", "token", "tf")


@query("p4_positive_scores", OVERLAP + "SELECT query_id, count(*) AS hits FROM score WHERE score > 0 GROUP BY 1")
def _(s, d):
    return lexical.scores(T.chunks(s, d), T.queries(s, d), "overlap").where("score > 0").groupBy("query_id").agg(F.count("*").alias("hits"))


@query("w1_rank", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50")
def _(s, d):
    return packing.ranked(T.table(s, d, "documents"), "source", tie="doc_id", score="n_chars").select("source", "doc_id", big("rank", "rank"))


@query("l1_top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def _(s, d):
    return T.table(s, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "n_chars")


@query("l3_offset", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 20")
def _(s, d):
    return T.table(s, d, "documents").orderBy(F.desc("n_chars"), "doc_id").offset(20).limit(10).select("doc_id", "n_chars")


@query("l4_ordered", "SELECT DISTINCT source, lang FROM documents ORDER BY 1, 2")
def _(s, d):
    return T.table(s, d, "documents").select("source", "lang").distinct().orderBy("source", "lang")


@query("w2_pack", """WITH t AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations)
SELECT conv_id, turn, substr(text, 1, (300 - used)::BIGINT) AS text, length(text) > 300 - used AS truncated FROM t WHERE used < 300""")
def _(s, d):
    c = T.table(s, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text", F.lit(50).alias("top_k"), F.lit(300).alias("max_chars"))
    return packing.packed(c).select(F.col("query_id").alias("conv_id"), F.col("rank").alias("turn"), "text", "truncated")


# --- evaluation --------------------------------------------------------------------------------------------------------

EVAL = f"WITH {T.DOCUMENTS}, {T.CASES} "


@query("a17_case_metrics", EVAL + "SELECT case_id, category, round(recall_at_k, 6) AS recall_at_k, hit_at_k, round(mrr_at_k, 6) AS mrr_at_k, round(ndcg_at_k, 6) AS ndcg_at_k, round(precision_at_k, 6) AS precision_at_k, empty_on_unanswerable, empty_on_answerable, kb_leakage FROM metric")
def _(s, d):
    r = evaluate.evaluated(*T.cases(s, d), 5)
    return r.select("case_id", "category", *[six(F.col(m), m) if m not in ("kb_leakage",) else F.col(m) for m in evaluate.METRICS])


@query("a14_rollup", EVAL + """SELECT category, grouping(category) = 1 AS overall, count(*) AS queries, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(hit_at_k), 6) AS hit_at_k, round(avg(mrr_at_k), 6) AS mrr_at_k,
    round(avg(ndcg_at_k), 6) AS ndcg_at_k, round(avg(precision_at_k), 6) AS precision_at_k, round(avg(empty_on_unanswerable), 6) AS empty_on_unanswerable, round(avg(empty_on_answerable), 6) AS empty_on_answerable, sum(kb_leakage)::BIGINT AS kb_leakage
    FROM metric GROUP BY GROUPING SETS ((), (category))""")
def _(s, d):
    r = evaluate.rolled_up(evaluate.evaluated(*T.cases(s, d), 5))
    return r.select("category", "overall", "queries", *[six(F.col(m), m) if m != "kb_leakage" else F.col(m) for m in evaluate.METRICS])


@query("a11_null_skipping_mean", "SELECT source, avg(quality) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(s, d):
    return T.documents(s, d).groupBy(F.col("kb_id").alias("source")).agg(F.avg("quality").alias("quality"))


@query("w4_first_credit", EVAL + "SELECT case_id, doc_id, rank::BIGINT AS rank FROM earned")
def _(s, d):
    _, labels, hits = T.cases(s, d)
    return evaluate.gains(hits, labels).select("case_id", "doc_id", big("rank", "rank"))


@query("w3_first_rank", EVAL + "SELECT case_id, min(rank)::BIGINT AS first FROM earned GROUP BY 1")
def _(s, d):
    _, labels, hits = T.cases(s, d)
    return evaluate.gains(hits, labels).groupBy("case_id").agg(big(F.min("rank"), "first"))


@query("j8_hits_labels", EVAL + "SELECT case_id, doc_id, rank::BIGINT AS rank, contains(text, contains) AS shown FROM hit JOIN labelled USING (case_id, doc_id)")
def _(s, d):
    _, labels, hits = T.cases(s, d)
    return hits.join(labels, ["case_id", "doc_id"]).select("case_id", "doc_id", big("rank", "rank"), F.contains("text", "contains").alias("shown"))


@query("p9_visible_evidence", EVAL + "SELECT case_id, doc_id FROM hit JOIN labelled USING (case_id, doc_id) WHERE contains(text, contains)")
def _(s, d):
    _, labels, hits = T.cases(s, d)
    return hits.join(labels, ["case_id", "doc_id"]).where(F.contains("text", "contains")).select("case_id", "doc_id")


@query("p8_hit_projection", EVAL + "SELECT case_id, doc_id, kb_id, rank::BIGINT AS rank FROM hit")
def _(s, d):
    return T.cases(s, d)[2].select("case_id", "doc_id", "kb_id", big("rank", "rank"))


@query("j7_label_faults", EVAL + """SELECT case_id, l.doc_id, CASE WHEN content IS NULL THEN 'missing document' WHEN NOT contains(content, contains) THEN 'missing evidence' ELSE 'out of scope' END AS fault
    FROM (SELECT case_id, CASE WHEN case_id LIKE '%9' THEN doc_id || 'x' ELSE doc_id END AS doc_id, CASE WHEN case_id LIKE '%8' THEN contains || 'x' ELSE contains END AS contains FROM labelled) l JOIN of USING (case_id) LEFT JOIN docs ON docs.id = l.doc_id
    WHERE content IS NULL OR NOT contains(content, contains) OR (kb_ids IS NOT NULL AND NOT list_contains(kb_ids, kb_id))""")
def _(s, d):
    cases, labels, _ = T.cases(s, d)
    labels = labels.withColumn("doc_id", F.when(F.col("case_id").endswith("9"), F.concat("doc_id", F.lit("x"))).otherwise(F.col("doc_id"))).withColumn("contains", F.when(F.col("case_id").endswith("8"), F.concat("contains", F.lit("x"))).otherwise(F.col("contains")))
    return evaluate.label_faults(cases, labels, T.documents(s, d).select(F.col("id").alias("doc_id"), "kb_id", "content"))


#: A second run in which the case's metrics are those of the case behind it.
PAIRS = EVAL + """, base AS (SELECT case_id, recall_at_k AS b, mrr_at_k AS bm FROM metric), cand AS (
    SELECT case_id, lead(recall_at_k) OVER (ORDER BY case_id) AS c, lead(mrr_at_k) OVER (ORDER BY case_id) AS cm FROM metric) """


def runs(s, d) -> tuple[DataFrame, DataFrame]:
    base = evaluate.evaluated(*T.cases(s, d), 5)
    behind = Window.orderBy("case_id")
    return base, base.select("case_id", *[(F.lead(m).over(behind) if m in ("recall_at_k", "mrr_at_k") else F.col(m)).alias(m) for m in evaluate.METRICS])


@query("a23_metric_deltas", PAIRS + """SELECT case_id, 'recall_at_k' AS metric, round(c - b, 6) AS delta FROM base JOIN cand USING (case_id) WHERE c - b <> 0
    UNION ALL SELECT case_id, 'mrr_at_k', round(cm - bm, 6) FROM base JOIN cand USING (case_id) WHERE cm - bm <> 0""")
def _(s, d):
    return evaluate.deltas(*runs(s, d)).select("case_id", "metric", six(F.col("delta"), "delta"))


@query("j10_unpaired", EVAL + "SELECT case_id FROM metric WHERE case_id LIKE '%1' OR case_id LIKE '%2'")
def _(s, d):
    r = evaluate.evaluated(*T.cases(s, d), 5)
    return evaluate.unpaired(r.where(~F.col("case_id").endswith("1")), r.where(~F.col("case_id").endswith("2")))


@query("a24_bootstrap", PAIRS + """, diff AS (SELECT c - b AS d, row_number() OVER (ORDER BY case_id) - 1 AS i FROM base JOIN cand USING (case_id) WHERE b IS NOT NULL AND c IS NOT NULL),
n AS (SELECT count(*) AS n FROM diff),
draw AS (SELECT r, ('0x' || substr(sha256('42:' || r || ':' || j), 1, 8))::BIGINT % n AS i FROM n, range(2000) x(r), range(n) y(j)),
means AS (SELECT r, avg(d) AS mean FROM draw JOIN diff USING (i) GROUP BY 1)
SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM means""")
def _(s, d):
    a, b = runs(s, d)
    pairs = a.select("case_id", F.col("recall_at_k").alias("baseline")).join(b.select("case_id", F.col("recall_at_k").alias("candidate")), "case_id")
    return evaluate.bootstrap(pairs).select(six(F.col("low"), "low"), six(F.col("high"), "high"))


@query("a12_percentiles", "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def _(s, d):
    r = evaluate.percentiles(T.table(s, d, "events"), "value", (0.5, 0.95))
    return r.select(six(F.col("p50"), "p50"), six(F.col("p95"), "p95"))


@query("a13_latencies", "SELECT event_type, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95 FROM (SELECT event_type, unnest([value, value * 2]) AS v FROM events) GROUP BY 1")
def _(s, d):
    e = T.table(s, d, "events").select("event_type", F.explode(F.array("value", F.col("value") * 2)).alias("v"))
    r = evaluate.percentiles(e, "v", (0.5, 0.95), ["event_type"])
    return r.select("event_type", six(F.col("p50"), "p50"), six(F.col("p95"), "p95"))


@query("a15_stage_percentiles", """WITH u AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT event_type FROM events), s AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL)
SELECT t.event_type, round(quantile_cont(coalesce(v, 0), 0.5), 6) AS p50, round(quantile_cont(coalesce(v, 0), 0.95), 6) AS p95 FROM u CROSS JOIN t LEFT JOIN s USING (user_id, event_type) GROUP BY 1""")
def _(s, d):
    e = T.table(s, d, "events")
    stages = e.groupBy("user_id", "event_type").agg(F.sum("value").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("stages_ms"))
    # a trace that lacks a stage counts 0 for it; stage names are few, traces are many
    named = e.select("event_type").distinct()
    every = stages.join(lexical.bounded(named, 10_000), F.lit(True)).select("event_type", F.coalesce(F.col("stages_ms")[F.col("event_type")], F.lit(0.0)).alias("v"))
    r = evaluate.percentiles(every, "v", (0.5, 0.95), ["event_type"])
    return r.select("event_type", six(F.col("p50"), "p50"), six(F.col("p95"), "p95"))


@query("j9_measured_traces", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' OR event_id % 10 = 0)")
def _(s, d):
    e = T.table(s, d, "events")
    return e.join(e.where("event_type = 'purchase' or event_id % 10 = 0").select("user_id"), "user_id", "left_semi").select("event_id")


@query("a22_mean_sizes", "SELECT role, avg(length(text)) AS chars, avg(strlen(text)) AS bytes FROM conversations GROUP BY 1")
def _(s, d):
    return T.table(s, d, "conversations").groupBy("role").agg(F.avg(F.length("text")).alias("chars"), F.avg(F.octet_length("text")).alias("bytes"))
