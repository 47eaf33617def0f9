"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, html, jaccard, langid, merkle, mixing, near_vectors, negatives, quality_model, quality_rules, secrets, tokens, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' records, written to archives and read back."""
    return warc.archived(spark, warc.write_warc(table(spark, sf_dir, "pages")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of the documents."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), 5, 80)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of the documents."""
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found")


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the documents by the co-trained classifier."""
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the documents."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text, with it."""
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the documents."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of the pages."""
    return html.extract(table(spark, sf_dir, "pages"))


#: The id that ends a document in op9_tokens.
END_ID = 2


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids lie among all, read back from the shards."""
    folder = tokens.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return tokens.offsets(tokens.read_tokens(spark, folder, ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents against the root, for a copy of which a half is tampered with."""
    return merkle.audited(table(spark, sf_dir, "documents"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of the embeddings within their labels."""
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every anchor and positive among the embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_secrets": op3_secrets,
    "op4_quality_model": op4_quality_model,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontaminate": op6_decontaminate,
    "op7_langid": op7_langid,
    "op8_html": op8_html,
    "op9_tokens": op9_tokens,
    "op10_mixing": op10_mixing,
    "op11_merkle": op11_merkle,
    "op12_near_vectors": op12_near_vectors,
    "op13_negatives": op13_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": r"""
        WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS sha, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
        b AS (SELECT *, unhex(sha)::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY sha) AS first FROM p)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: CASE WHEN substr(bits, i * 5 + j + 1, 1) = '1' THEN 16 >> j ELSE 0 END))::BIGINT, 1)), '') AS payload_digest,
            CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM b
    """,
    # all pairs of documents that share a shingle
    "op2_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
            FROM d),
        e AS (SELECT r, len(g) AS n, unnest(g) AS x FROM s),
        link AS (
            SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r
            GROUP BY a.r, b.r HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach AS (SELECT r, r AS o FROM s UNION SELECT reach.r, link.b FROM reach JOIN link ON reach.o = link.a),
        least AS (SELECT reach.r, min(s.doc_id) AS component_id FROM reach JOIN s ON s.r = reach.o GROUP BY reach.r),
        degree AS (SELECT a AS r, count(*) AS n_links FROM link GROUP BY a)
        SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(n_links, 0)::BIGINT AS n_links, component_id
        FROM s JOIN least USING (r) LEFT JOIN degree USING (r)
    """,
    # all alignments in which a token agrees; seeds play no part
    "op6_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t
            FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
        b AS (
            SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t
            FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        dt AS (SELECT doc_id, t AS doc, len(t) AS size, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM d),
        bt AS (SELECT item_id, t AS item, len(t) AS tokens, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM b),
        met AS (
            SELECT doc_id, size, hash(doc) AS h, item_id, item, tokens, dt.p - bt.p AS shift, count(*) AS matched, list(bt.p ORDER BY bt.p) AS places
            FROM dt JOIN bt USING (token) GROUP BY ALL HAVING count(*) >= least(8, tokens)),
        fit AS (SELECT *, least(tokens, size - shift) - greatest(0, -shift) AS common FROM met),
        best AS (
            SELECT doc_id, item_id, max({'m': matched, 't': tokens}) AS best FROM fit
            WHERE matched >= 0.6::DOUBLE * common
                OR (common >= 13 AND len(list_filter(range(1, len(places) - 9), lambda k: places[k + 10] - places[k] <= 12)) > 0)
            GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, best.t::BIGINT AS tokens, best.m::BIGINT AS matched FROM best
    """,
    "op10_mixing": r"""
        WITH docs AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
            FROM documents),
        sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
        turned AS (
            SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight,
                source_size * 2.0::DOUBLE AS cap
            FROM sized),
        ladder AS (
            SELECT *, cap / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total,
                sum(cap) OVER up - cap AS caps, sum(weight) OVER () - sum(weight) OVER up + weight AS behind
            FROM turned
            WINDOW up AS (ORDER BY cap / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
        level AS (
            SELECT (total - caps) / behind AS level FROM ladder
            WHERE (total - caps) / behind <= ratio ORDER BY ratio, source IS NULL, source LIMIT 1),
        plan AS (
            SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM level)), cap) AS target FROM ladder),
        rows_ AS (
            SELECT d.doc_id, d.size, p.source_size, p.target,
                CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 1 END AS whole,
                sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS middle
            FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target,
            (size * (whole + CASE WHEN size > 0 AND middle < target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM rows_
    """,
    # nodes level by level, each with its siblings, then every leaf's way up
    "op11_merkle": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                text, replace(text, chr(10), '') AS bare,
                xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                    lambda crc, c: list_reduce(list_prepend(xor(crc, c), list_transform(range(8), lambda i: i::BIGINT)),
                        lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS crc
            FROM documents),
        hashed AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) END AS forged
            FROM d),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                count(*) OVER (PARTITION BY source) AS size, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
            FROM hashed),
        up AS (
            SELECT tree, 0 AS level, pos, size, leaf AS h FROM leaves
            UNION ALL
            SELECT tree, level + 1, pos // 3, any_value((size + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM up
            WHERE size > 1 GROUP BY tree, level, pos // 3),
        subroots AS (SELECT tree, h AS subroot FROM up WHERE size = 1),
        over_ AS (
            SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS size, subroot AS h FROM subroots
            UNION ALL
            SELECT level + 1, pos // 3, any_value((size + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM over_
            WHERE size > 1 GROUP BY level, pos // 3),
        nodes AS (SELECT tree, level, pos, size, h FROM up UNION ALL SELECT -1, level, pos, size, h FROM over_),
        beside AS (
            SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
                coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
            FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3
            WHERE a.size > 1 GROUP BY a.tree, a.level, a.pos),
        way AS (
            SELECT doc_id, tree, pos AS leaf_pos, leaf, pos, 0 AS level, tree AS at, '' AS proof, coalesce(forged, leaf) AS f FROM leaves
            UNION ALL
            SELECT w.doc_id, w.tree, w.leaf_pos, w.leaf,
                CASE WHEN b.pos IS NULL THEN w.tree ELSE w.pos // 3 END, CASE WHEN b.pos IS NULL THEN 0 ELSE w.level + 1 END,
                CASE WHEN b.pos IS NULL THEN -1 ELSE w.at END, w.proof || coalesce(b.l || b.r, ''),
                CASE WHEN b.pos IS NULL THEN w.f ELSE sha256(b.l || w.f || b.r) END
            FROM way w LEFT JOIN beside b ON b.tree = w.at AND b.level = w.level AND b.pos = w.pos
            WHERE b.pos IS NOT NULL OR w.at >= 0),
        last AS (SELECT w.* FROM way w WHERE w.at = -1 AND w.level = (SELECT max(level) FROM over_))
        SELECT doc_id, leaf, subroot, (SELECT h FROM over_ WHERE size = 1) AS root, sha256(proof) AS proof_sha256, f AS folded_root,
            f = (SELECT h FROM over_ WHERE size = 1) AS verified
        FROM last JOIN subroots USING (tree)
    """,
    # all pairs of a label
    "op12_near_vectors": r"""
        WITH RECURSIVE v AS (
            SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e,
                label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false)
                    AND coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS able
            FROM embeddings),
        link AS (
            SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
            WHERE a.able AND b.able AND list_cosine_similarity(a.e, b.e) >= 0.93),
        reach AS (SELECT r, r AS o FROM v UNION SELECT reach.r, link.b FROM reach JOIN link ON reach.o = link.a),
        least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.o GROUP BY reach.r),
        degree AS (SELECT a AS r, count(*) AS n_links FROM link GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
        FROM v JOIN least USING (r) LEFT JOIN degree USING (r)
    """,
    # all rows against every anchor
    "op13_negatives": r"""
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false)),
        pairs AS (
            SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.e, b.e)::BIGINT AS score
            FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
        positives AS (
            SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS k
            FROM pairs WHERE same),
        found AS (
            SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
                row_number() OVER (PARTITION BY p.r, p.k ORDER BY n.score DESC, n.vec_id NULLS LAST)::INT AS rank
            FROM positives p JOIN pairs n ON p.r = n.r AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
            WHERE p.k <= 5)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
    """,
}
