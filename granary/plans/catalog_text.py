"""Queries of the scalar functions, chunking, vectors and audit, each with its SQL."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from granary.functions import identity, text, vectors
from granary.operators import audit, chunking, clusters, dense, sync, windows
from granary.plans import tables as T
from granary.plans.catalog import D, ORACLE_SQL, QUERIES, big, query, six

__all__ = ["ORACLE_SQL", "QUERIES"]

# --- scalar functions --------------------------------------------------------------------------------------------------


@query("f3_canonical", D + """SELECT id, '{"id":"' || id || '","n":' || length(content) || '}' AS json FROM docs""")
def _(s, d):
    return T.documents(s, d).select("id", F.concat(F.lit('{"id":'), identity.json_text(F.col("id")), F.lit(',"n":'), F.length("content").cast("string"), F.lit("}")).alias("json"))


@query("f3_canonical_text", "SELECT doc_id, sha256(to_json(text)::VARCHAR) AS json FROM documents")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id", identity.sha256(identity.json_text(F.col("text"))).alias("json"))


@query("f4_digest", "SELECT item_id, sha256(text) AS digest FROM benchmark")
def _(s, d):
    return T.table(s, d, "benchmark").select("item_id", identity.sha256(F.col("text")).alias("digest"))


@query("f5_uuid5", """WITH h AS (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages WHERE url IS NOT NULL)
SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (('0x' || substr(h, 17, 1))::INT & 3), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def _(s, d):
    return T.table(s, d, "pages").where("url is not null").select("page_id", identity.uuid5(F.col("url")).alias("id"))


@query("f6_chunk_id", D + """SELECT id, sha256('["' || id || '","' || source_hash || '","p1",1,9]') AS chunk_id FROM docs""")
def _(s, d):
    return T.documents(s, d).select("id", identity.chunk_id(F.col("id"), F.col("source_hash"), F.col("pipeline_hash"), F.lit(1), F.lit(9)).alias("chunk_id"))


@query("f6_unit_id", D + """SELECT id, sha256('["' || path || '",0,7,"f"]') AS unit_id FROM docs""")
def _(s, d):
    return T.documents(s, d).select("id", identity.unit_id(F.col("path"), F.lit(0), F.lit(7), F.lit("f")).alias("unit_id"))


#: Documents have no carriage returns or other line ends than line feeds.
SPLIT = r"regexp_extract_all(text, '[^\n]*\n|[^\n]+')"


@query("f7_lines", f"SELECT doc_id, len({SPLIT})::BIGINT AS lines, length({SPLIT}[1])::BIGINT AS first FROM documents")
def _(s, d):
    t = text.lines(F.col("text"))
    return T.table(s, d, "documents").select("doc_id", big(F.size(t), "lines"), big(F.length(F.get(t, F.lit(0))), "first"))


#: Lines of a document as Markdown: every 4th a heading of a level by its number, every 9th a fence.
MARKED = r"""marked AS (
    SELECT doc_id, n, CASE WHEN n % 9 = 0 THEN repeat('`', 3 + (n % 2)::INT) || 'x' WHEN n % 4 = 0 THEN repeat('#', 1 + ((n // 4) % 3)::INT) || ' ' || substr(line, 1, 12) || ' ##' ELSE line END AS line
    FROM (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def marked(s, d) -> DataFrame:
    lines = T.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
    mark = F.concat(F.expr("repeat('`', 3 + n % 2)"), F.lit("x"))
    head = F.concat(F.expr("repeat('#', 1 + (n div 4) % 3)"), F.lit(" "), F.substring("line", 1, 12), F.lit(" ##"))
    return lines.select("doc_id", F.col("n").cast("bigint").alias("n"), F.when(F.col("n") % 9 == 0, mark).when(F.col("n") % 4 == 0, head).otherwise(F.col("line")).alias("line"))


HEAD = r"regexp_extract(rtrim(line), '^(#{{1,6}})\s+(.+?)\s*#*\s*$', {})"


@query("f10_heading", f"WITH {MARKED} SELECT doc_id, n, length({HEAD.format(1)})::BIGINT AS level, {HEAD.format(2)} AS label FROM marked WHERE starts_with(line, '#')")
def _(s, d):
    return marked(s, d).where(F.startswith("line", F.lit("#"))).select("doc_id", "n", big(text.heading_level(F.col("line")), "level"), text.heading_label(F.col("line")).alias("label"))


@query("f11_fence", rf"WITH {MARKED} SELECT doc_id, n, regexp_extract(line, '^\s{{0,3}}(`{{3,}}|~{{3,}})', 1) AS mark FROM marked WHERE starts_with(line, '`')")
def _(s, d):
    return marked(s, d).where(F.startswith("line", F.lit("`"))).select("doc_id", "n", text.fence(F.col("line")).alias("mark"))


@query("w5_heading_path", f"""WITH {MARKED}, h AS (SELECT doc_id, n, length({HEAD.format(1)}) AS level, {HEAD.format(2)} AS label FROM marked),
cur AS (SELECT doc_id, n, {', '.join(f"last_value(CASE WHEN level = {k} THEN n END IGNORE NULLS) OVER w AS n{k}, last_value(CASE WHEN level = {k} THEN label END IGNORE NULLS) OVER w AS l{k}" for k in (1, 2, 3))}
    FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING))
SELECT doc_id, n, concat_ws(' > ', l1, CASE WHEN n2 > coalesce(n1, 0) THEN l2 END, CASE WHEN n3 > greatest(coalesce(n1, 0), coalesce(n2, 0)) THEN l3 END) AS path FROM cur""")
def _(s, d):
    h = marked(s, d).withColumn("level", text.heading_level(F.col("line"))).withColumn("label", text.heading_label(F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.select("doc_id", "n", *[F.last(F.when(F.col("level") == k, F.struct("n", "label")), True).over(w).alias(f"h{k}") for k in (1, 2, 3)])
    before = lambda k: F.greatest(F.lit(0), F.lit(0), *[F.coalesce(f"h{j}.n", F.lit(0)) for j in range(1, k)])
    return h.select("doc_id", "n", F.concat_ws(" > ", *[F.when(F.col(f"h{k}.n") > before(k), F.col(f"h{k}.label")) for k in (1, 2, 3)]).alias("path"))


@query("f12_join_labels", "SELECT conv_id, string_agg(role, ' > ' ORDER BY turn) AS path FROM conversations GROUP BY 1")
def _(s, d):
    c = T.table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return c.select("conv_id", F.concat_ws(" > ", F.col("r.role")).alias("path"))


@query("f9_title", D + "SELECT id, CASE WHEN quality = 1 THEN 'label ' || lang WHEN doc_id % 2 = 0 THEN substr(content, 1, 9) ELSE path END AS title FROM docs")
def _(s, d):
    """A title of the metadata (made up for those of quality 1), or the first heading while the title is the stem."""
    own = F.when(F.col("quality") == 1, F.concat(F.lit("label "), "lang"))
    heading = F.when(F.col("doc_id") % 2 == 0, F.substring("content", 1, 9))
    title = F.coalesce(own, F.col("path"))
    return T.documents(s, d).select("id", F.when(title == F.col("path"), F.coalesce(heading, title)).otherwise(title).alias("title"))


@query("f13_characters", "SELECT doc_id, length(text)::BIGINT AS n, substr(text, 3, 20) AS part FROM documents")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id", big(F.length("text"), "n"), F.substring("text", 3, 20).alias("part"))


@query("f14_bytes", "SELECT doc_id, strlen(text)::BIGINT AS n FROM documents")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id", big(F.octet_length("text"), "n"))


@query("f15_json", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(s, d):
    return T.table(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("f16_numbers", "SELECT event_id, round(ln(1 + abs(value)), 6) AS ln, round(log2(2 + abs(value)), 6) AS log2, isfinite(value) AS finite, abs(value - 1) <= greatest(1e-6 * greatest(abs(value), 1), 1e-7) AS close FROM events")
def _(s, d):
    v = F.col("value")
    finite = ~(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return T.table(s, d, "events").select("event_id", six(F.ln(1 + F.abs(v)), "ln"), six(F.log2(2 + F.abs(v)), "log2"), finite.alias("finite"), (F.abs(v - 1) <= F.greatest(1e-6 * F.greatest(F.abs(v), F.lit(1.0)), F.lit(1e-7))).alias("close"))


@query("f25_read_slice", r"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l FROM documents), r AS (SELECT doc_id, len(l) AS n, array_to_string(l[2:], '') AS rest FROM l)
SELECT doc_id, substr(rest, 1, 200) AS text, length(rest) > 200 AS truncated FROM r WHERE n >= 1""")
def _(s, d):
    got = text.read_slice(F.col("text"), 2, 200)
    return T.table(s, d, "documents").where(got["valid"]).select("doc_id", got["text"].alias("text"), got["truncated"].alias("truncated"))


@query("f26_doc_id", D + "SELECT id, split_part(id, ':', 1) AS kb_id, substr(id, instr(id, ':') + 1) AS path FROM docs")
def _(s, d):
    return T.documents(s, d).select("id", F.substring_index("id", ":", 1).alias("kb_id"), F.substr("id", F.instr("id", ":") + 1).alias("path"))


@query("f27_id_patterns", D + "SELECT id, regexp_full_match(id, '[a-z0-9_-]+:.+') AS named, regexp_full_match(source_hash, '[0-9a-f]{64}') AS hashed FROM docs")
def _(s, d):
    return T.documents(s, d).select("id", F.col("id").rlike("(?s)^[a-z0-9_-]+:.+$").alias("named"), F.col("source_hash").rlike("^[0-9a-f]{64}$").alias("hashed"))


@query("f28_kb_charset", "SELECT DISTINCT c_mktsegment AS name, regexp_full_match(c_mktsegment, '[a-z0-9_-]+') AS valid FROM customer")
def _(s, d):
    return T.table(s, d, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_mktsegment").rlike("^[a-z0-9_-]+$").alias("valid")).distinct()


@query("f29_url", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages WHERE url IS NOT NULL")
def _(s, d):
    parts = text.url_parts(F.col("url"))
    return T.table(s, d, "pages").where("url is not null").select("page_id", parts["scheme"].alias("scheme"), parts["host"].alias("host"))


@query("f33_findings", "SELECT doc_id AS id, 1::BIGINT AS line, 'possible-api-key' AS finding FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT doc_id, 2, 'user-home-path' FROM documents WHERE doc_id % 10 = 3")
def _(s, d):
    """Every tenth document behind two lines that give something away; the documents themselves don't."""
    bad = F.concat(F.lit("sk-proj-"), F.expr("repeat('a', 24)"), F.lit("\n/home//u"), "doc_id", F.lit("/x\n"))
    return audit.text_findings(T.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.when(F.col("doc_id") % 10 == 3, bad).otherwise(F.lit("")), "text").alias("text")))


@query("f34_normal_path", r"SELECT page_id, lower(regexp_replace(replace(url, '\', '/'), '/+', '/', 'g')) AS path FROM pages")
def _(s, d):
    return T.table(s, d, "pages").select("page_id", text.normal_path(F.col("url")).alias("path"))


@query("f35_guards", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'binary' WHEN doc_id % 3 = 1 THEN 'not utf-8' END AS why FROM documents")
def _(s, d):
    raw = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("00"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    return T.table(s, d, "documents").select("doc_id", audit.guard(raw).alias("why"))


@query("f36_globs", "SELECT page_id, url LIKE '%example.org%' AND NOT regexp_matches(url, '/[a-z][a-z]/[0-9][0-9]$') AND NOT regexp_matches(url, '(^|/)\\.') AS chosen FROM pages")
def _(s, d):
    return T.table(s, d, "pages").select("page_id", text.globs(F.col("url"), ["*example.org*"], ["*/[a-z][a-z]/[0-9][0-9]"]).alias("chosen"))


# --- chunking ----------------------------------------------------------------------------------------------------------


@query("w6_chunks", rf"""WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line, len(l) AS total FROM (SELECT doc_id, {SPLIT} AS l FROM documents)),
walk AS (
    SELECT doc_id, n, line, total, 1 AS chunk, length(line) AS size FROM l WHERE n = 1
    UNION ALL
    SELECT l.doc_id, l.n, l.line, l.total, CASE WHEN w.size >= 1200 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.size >= 1200 THEN length(l.line) ELSE w.size + length(l.line) END
    FROM walk w JOIN l ON l.doc_id = w.doc_id AND l.n = w.n + 1)
SELECT 'k:d' || doc_id AS doc_id, min(n)::BIGINT AS start_line, max(n)::BIGINT AS end_line, sha256(string_agg(line, '' ORDER BY n)) AS text FROM walk GROUP BY doc_id, chunk HAVING trim(string_agg(line, ''), chr(10) || ' ') <> ''""")
def _(s, d):
    files = T.table(s, d, "documents").select(F.concat(F.lit("k:d"), "doc_id").alias("id"), F.lit("k").alias("kb_id"), F.concat(F.lit("d"), "doc_id").alias("path"), F.lit("h").alias("source_hash"), F.col("text").alias("content"))
    rows = sync.chunk_rows(chunking.chunked(files, 1200))
    return rows.select("doc_id", big("start_line", "start_line"), big("end_line", "end_line"), identity.sha256(F.col("text")).alias("text"))


@query("a29_build_counters", """SELECT count(*) AS documents, sum(greatest(1, ceil(length(text) / 90.0::DOUBLE)))::BIGINT AS points, count(*) FILTER (length(text) > 90) AS split_chunks,
    sum(length(text) + 10 * ceil(length(text) / 90.0::DOUBLE))::BIGINT AS input_tokens FROM documents WHERE text <> ''""")
def _(s, d):
    c = T.table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("12345678").alias("context"), "text")
    units = windows.fixed_windows(c, 100)
    per = units.groupBy("chunk_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return per.agg(F.count("*").alias("documents"), F.sum("n").alias("points"), big(F.sum((F.col("n") > 1).cast("int")), "split_chunks"), big(F.sum("tokens"), "input_tokens"))


@query("f22_windows", """SELECT doc_id AS chunk_id, k * 90 AS start, least((k + 1) * 90, length(text)) AS "end", least(90, length(text) - k * 90) + 10 AS tokens, substr(text, k * 90 + 1, 90) AS text
    FROM (SELECT doc_id, text, unnest(range(ceil(length(text) / 90.0::DOUBLE)::BIGINT)) AS k FROM documents)""")
def _(s, d):
    c = T.table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("12345678").alias("context"), "text")
    return windows.fixed_windows(c, 100).select("chunk_id", big("start", "start"), big("end", "end"), big("tokens", "tokens"), "text")


@query("f20_template", "SELECT item_id, 'query: ' || text AS q, 'passage: ' || text AS p, text AS plain FROM benchmark")
def _(s, d):
    t = F.col("text")
    return T.table(s, d, "benchmark").select("item_id", windows.prepared(t, "query", "e5-v1").alias("q"), windows.prepared(t, "passage", "e5-v1").alias("p"), windows.prepared(t, "query", "plain-v1").alias("plain"))


KEYS = """k AS (SELECT doc_id, sha256('["f","passage",' || to_json(text)::VARCHAR || ']') AS key FROM documents)"""


def keyed(s, d) -> DataFrame:
    return T.table(s, d, "documents").select("doc_id", windows.cache_key(F.lit("f"), "passage", F.col("text")).alias("key"))


@query("f23_cache_key", f"WITH {KEYS} SELECT doc_id, key FROM k")
def _(s, d):
    return keyed(s, d)


@query("j11_cache_misses", f"WITH {KEYS} SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 3 = 0)")
def _(s, d):
    k = keyed(s, d)
    return windows.missing(k, k.where("doc_id % 3 = 0")).select("key")


@query("k7_cache_rows", f"WITH {KEYS} SELECT count(DISTINCT key) AS rows FROM k")
def _(s, d):
    k = keyed(s, d)
    old = k.where("doc_id % 3 = 0").dropDuplicates(["key"]).withColumn("vector", F.array(F.lit(1.0)))
    fresh = windows.missing(k, old).withColumn("vector", F.array(F.lit(2.0)))
    return old.unionByName(fresh).agg(F.countDistinct("key").alias("rows"))


# --- vectors -----------------------------------------------------------------------------------------------------------

POINTS = f"WITH {T.POINTS} "


@query("f17_vector_faults", """SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'dimension' WHEN vec_id % 5 = 1 THEN 'finite' WHEN vec_id % 5 = 2 THEN 'zero' WHEN vec_id % 5 = 3 THEN 'norm' END AS fault FROM embeddings""")
def _(s, d):
    v, k = F.col("embedding").cast("array<double>"), F.col("vec_id") % 5
    bent = F.when(k == 0, F.slice(v, 1, 63)).when(k == 1, F.concat(F.array(F.lit(float("nan"))), F.slice(v, 2, 63))).when(k == 2, F.transform(v, lambda x: x * 0)).when(k == 3, F.transform(v, lambda x: x * 2)).otherwise(v)
    return T.table(s, d, "embeddings").select("vec_id", vectors.fault(bent, 64).alias("fault"))


@query("f18_normalize", "SELECT vec_id, round(list_sum([x * x for x in [y * 3 / sqrt(list_sum([z * z * 9 for z in e])) for y in e]]), 6) AS norm, round(e[1] / sqrt(list_sum([z * z for z in e])), 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def _(s, d):
    v = vectors.normalized(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3))
    return T.table(s, d, "embeddings").select("vec_id", six(vectors.dot(v, v), "norm"), six(v[0], "first"))


@query("f19_similarities", """SELECT a.vec_id, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 6) AS cosine, round(list_dot_product(a.e, b.e), 6) AS dot, round(list_distance(a.e, b.e), 6) AS euclid
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id // 2""")
def _(s, d):
    e = T.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = e.select(F.col("vec_id").alias("o"), F.col("a").alias("b"))
    pairs = e.join(b, (F.col("vec_id") / 2).cast("long") == F.col("o"))
    return pairs.select("vec_id", *[six(vectors.similarity(F.col("a"), F.col("b"), x), x) for x in ("cosine", "dot", "euclid")])


#: The best parents of each query, as many as a search may return.
POOLED = POINTS + ", m AS (SELECT query_id, chunk_id, max(score) AS score FROM s GROUP BY ALL), c AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) <= 50) "


@query("j5_exact_scores", POINTS + "SELECT query_id, point_id, round(score, 6) AS score FROM s")
def _(s, d):
    return dense.exact(T.points(s, d), T.vector_queries(s, d), digits=6).select("query_id", "point_id", "score")


NEAREST = """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT q.vec_id AS query_id, p.vec_id AS point_id, round(list_dot_product(q.e, p.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(p.e, p.e)), 6) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, p.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(p.e, p.e)), 9) DESC, p.vec_id) AS rank
FROM p q JOIN p ON q.vec_id % 20 = 0 QUALIFY rank <= 5"""


@query("l2_nearest", NEAREST)
def _(s, d):
    p = T.points(s, d).select("point_id", "vector")
    near = dense.nearest(p, p.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "vector"), 5)
    return near.select("query_id", "point_id", six(F.col("score"), "score"), big("rank", "rank"))


@query("l2_clustered", NEAREST)
def _(s, d):
    """The same by clusters of points, leaving out those whose bound is below the best so far."""
    p = T.points(s, d).select("point_id", "vector")
    index = clusters.clustered(p, "cosine", T.kept)
    near, _ = clusters.nearest(index, p.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "vector"), 5)
    return near.select("query_id", "point_id", six(F.col("score"), "score"), big("rank", "rank"))


@query("p6_filter_before_rank", POINTS + "SELECT query_id, count(*) AS candidates FROM s GROUP BY 1")
def _(s, d):
    return dense.candidates(T.points(s, d), T.vector_queries(s, d))


@query("a8_pooled", POINTS + "SELECT query_id, chunk_id, round(max(score), 6) AS score FROM s GROUP BY ALL")
def _(s, d):
    return dense.maxima(T.points(s, d), T.vector_queries(s, d)).select("query_id", "chunk_id", six(F.col("score"), "score"))


@query("w9_top_parents", POOLED + "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM c QUALIFY rank <= 5")
def _(s, d):
    return dense.parents(T.points(s, d), T.vector_queries(s, d), 5).select("query_id", "chunk_id", big("rank", "rank"))


@query("c3_search_dense", POOLED + """, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM c QUALIFY rank <= 5)
SELECT query_id, chunk_id, rank::BIGINT AS rank, round(score, 6) AS score, 'text of ' || chunk_id AS text FROM t""")
def _(s, d):
    p = T.points(s, d)
    chunks = p.select("chunk_id").distinct().withColumn("text", F.concat(F.lit("text of "), "chunk_id"))
    return dense.search(p, chunks, T.vector_queries(s, d)).select("query_id", "chunk_id", big("rank", "rank"), six(F.col("score"), "score"), "text")


@query("j6_unresolved", POINTS + "SELECT DISTINCT chunk_id FROM p WHERE point_id % 10 = 3")
def _(s, d):
    p = T.points(s, d)
    bent = p.withColumn("source_hash", F.when(F.col("point_id") % 10 == 3, "other").otherwise(F.col("source_hash")))
    parents = p.groupBy("chunk_id").agg(F.first("doc_id").alias("doc_id"), F.lit("h").alias("source_hash"), F.first("kb_id").alias("kb_id"))
    return dense.resolved(bent.drop("kb_id").join(parents.select("chunk_id", "kb_id"), "chunk_id"), parents).select("chunk_id").distinct()


@query("p7_result_checks", POINTS + """, bent AS (
    SELECT CASE WHEN point_id % 50 = 7 THEN 'foreign contract' WHEN kb_id = 'kb9' THEN 'unknown knowledge base' WHEN point_id % 50 = 11 THEN 'document of another knowledge base' WHEN point_id % 50 = 3 THEN 'finite' END AS fault FROM p),
far AS (
    SELECT q.point_id, (q.point_id // 20) % 3 = 0 AND p.kb_id <> q.kb_id AS kb, (q.point_id // 20) % 4 = 0 AND NOT p.even AS filters,
        row_number() OVER (PARTITION BY q.point_id ORDER BY round(list_dot_product(q.v, p.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(p.v, p.v))), 12) DESC, p.point_id) AS rank
    FROM p q JOIN p ON q.point_id % 20 = 0 QUALIFY rank <= 5)
SELECT fault, count(*) AS n FROM (SELECT fault FROM bent UNION ALL SELECT CASE WHEN kb THEN 'outside the knowledge bases' WHEN filters THEN 'outside the filters' END FROM far) WHERE fault IS NOT NULL GROUP BY 1""")
def _(s, d):
    """Points bent in four ways, and the hits of searches that ignore their scope: every one of them is found."""
    p, q = T.points(s, d), T.vector_queries(s, d)
    n = F.col("point_id") % 50
    bent = p.withColumn("contract_id", F.when(n == 7, "other").otherwise("ours"))
    bent = bent.withColumn("doc_id", F.concat(F.when(n == 11, F.lit("elsewhere")).otherwise(F.col("kb_id")), F.lit(":"), "doc_id"))
    bent = bent.withColumn("vector", F.when(n == 3, F.transform("vector", lambda x, i: F.when(i == 0, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("vector")))
    points = dense.point_faults(bent, "ours", p.select("kb_id").where("kb_id <> 'kb9'"), 64, normalized=False)
    hits = dense.hit_faults(dense.nearest(p, q.select("query_id", "vector"), 5), p, q)
    return points.select("fault").unionByName(hits.select("fault")).groupBy("fault").agg(F.count("*").alias("n"))


@query("k2_upsert", "SELECT vec_id AS point_id, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def _(s, d):
    p = T.points(s, d).select("point_id", "vector")
    old = p.where("point_id % 3 = 0").withColumn("version", F.lit("old"))
    return dense.upserted(old, p.where("point_id % 2 = 0").withColumn("version", F.lit("new")), 64).select("point_id", "version")


@query("k3_delete_documents", "SELECT (SELECT count(*) FROM embeddings) - count(*) AS removed, count(*) AS left_over FROM embeddings WHERE (vec_id // 4) % 5 <> 0")
def _(s, d):
    p = T.points(s, d)
    gone = p.where((F.substring("doc_id", 2, 9).cast("long") % 5) == 0).select("doc_id").distinct()
    rest = dense.removed(p, gone)
    return p.agg(F.count("*").alias("n")).crossJoin(rest.agg(F.count("*").alias("left_over"))).select((F.col("n") - F.col("left_over")).alias("removed"), "left_over")


@query("a9_point_count", POINTS + "SELECT count(*) AS points FROM p WHERE kb_id IN ('kb1', 'kb2') AND even")
def _(s, d):
    return T.points(s, d).where("kb_id in ('kb1', 'kb2') and values['even'] = '1.0'").agg(F.count("*").alias("points"))


@query("w7_markdown_chunks", rf"""WITH RECURSIVE {MARKED},
l AS (SELECT doc_id, n, line || chr(10) AS line, length(regexp_extract(line, '^\s{{0,3}}(`{{3,}}|~{{3,}})', 1)) AS mark, {HEAD.format(1)} <> '' AS heading FROM marked),
walk AS (
    SELECT doc_id, n, line, 1 AS chunk, length(line) AS size, mark AS fence FROM l WHERE n = 1
    UNION ALL
    SELECT l.doc_id, l.n, l.line, w.chunk + (w.fence = 0 AND (l.heading OR w.size >= 300))::INT,
        CASE WHEN w.fence = 0 AND (l.heading OR w.size >= 300) THEN 0 ELSE w.size END + length(l.line),
        CASE WHEN l.mark = 0 THEN w.fence WHEN w.fence = 0 THEN l.mark WHEN l.mark >= w.fence THEN 0 ELSE w.fence END
    FROM walk w JOIN l ON l.doc_id = w.doc_id AND l.n = w.n + 1)
SELECT 'k:d' || doc_id AS doc_id, min(n)::BIGINT AS start_line, max(n)::BIGINT AS end_line, sha256(string_agg(line, '' ORDER BY n)) AS text FROM walk GROUP BY doc_id, chunk HAVING trim(string_agg(line, ''), chr(10) || ' ') <> ''""")
def _(s, d):
    rows = marked(s, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("content"))
    files = rows.select(F.concat(F.lit("k:d"), "doc_id").alias("id"), F.lit("k").alias("kb_id"), F.concat(F.lit("d"), "doc_id").alias("path"), F.lit("h").alias("source_hash"), "content")
    chunks = sync.chunk_rows(chunking.chunked(files, 300))
    return chunks.select("doc_id", big("start_line", "start_line"), big("end_line", "end_line"), identity.sha256(F.col("text")).alias("text"))
