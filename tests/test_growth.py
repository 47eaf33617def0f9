"""What tasks hold and shuffle at once: steps in small pieces against plain forms."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.operators import chunking, clusters, dense, lexical, segments


def explained(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


def vectors(spark):
    r = np.random.default_rng(5)
    rows = [(i, f"c{i % 23 if i % 2 else 99}", "kl"[i % 2], [float(x) for x in r.integers(-3, 4, 4)], {"even": str(i % 3)}) for i in range(150)]
    points = spark.createDataFrame(rows, "point_id long, chunk_id string, kb_id string, vector array<double>, values map<string,string>")
    asked = [(k, [float(x) for x in r.integers(1, 4, 4)], [None, ["k"], ["l"], ["none"]][k % 4], {"even": "1"} if k % 3 == 0 else None) for k in range(9)]
    return points, spark.createDataFrame(asked, "query_id long, vector array<double>, kb_ids array<string>, filters map<string,string>")


def test_maxima_without_shuffled_pairs(spark, monkeypatch, small_batches):
    points, queries = vectors(spark)
    monkeypatch.setattr(dense, "QUERIES", 4)
    monkeypatch.setattr(dense, "PRODUCTS", 20, raising=False)
    for distance in ("cosine", "euclid"):
        every = dense.scored(points, queries, distance).where("score is not null and not isnan(score)")
        want = {(r.query_id, r.chunk_id): r.score for r in dense.pooled(every, distance).collect()}
        found = dense.maxima(points, queries, distance)
        rows = found.collect()
        assert len(rows) == len(want) and all(abs(r.score - want[r.query_id, r.chunk_id]) < 1e-9 for r in rows)
        above = explained(found).split("MapInArrow")[0]
        assert "Exchange" not in above and "Aggregate" not in above


def test_products_in_pieces(spark, monkeypatch):
    points, queries = vectors(spark)
    queries = queries.select("query_id", "vector")
    want = {(r.query_id, r.point_id, r.rank): r.score for r in dense.nearest(points, queries, 5).collect()}
    whole = dense.products

    def checked(a, b, distance):
        if len(a) * len(b) > 160:
            raise MemoryError("a task holds more products than PRODUCTS")
        return whole(a, b, distance)

    monkeypatch.setattr(dense, "PRODUCTS", 160, raising=False)
    monkeypatch.setattr(dense, "products", checked)
    assert {(r.query_id, r.point_id, r.rank): r.score for r in dense.nearest(points, queries, 5).collect()} == want
    assert dense.exact(points, queries).count() == dense.scored(points, queries.withColumn("kb_ids", F.lit(None).cast("array<string>")).withColumn("filters", F.lit(None).cast("map<string,string>"))).where("score is not null and not isnan(score)").count()


def test_centres_met_in_pieces(spark, monkeypatch):
    points, _ = vectors(spark)
    placed = lambda: {r.point_id: round(r.distance, 9) for r in clusters.clustered(points, "cosine", lambda df, _: df).points.collect()}
    want, whole = placed(), dense.products

    def checked(a, b, distance):
        if len(a) * len(b) > 160:
            raise MemoryError("a task holds more products than PRODUCTS")
        return whole(a, b, distance)

    monkeypatch.setattr(clusters, "dense", SimpleNamespace(PRODUCTS=160, products=checked))
    assert placed() == want and len(want) > 140


def test_matrices_held_for_products(monkeypatch):
    r = np.random.default_rng(13)
    a, b = r.normal(size=(300, 16)), r.normal(size=(300, 16))
    b[100:], a[:200] = a[-1], a[-1]  # copies: their distances are taken from differences
    straight = {"dot": a @ b.T, "cosine": a @ b.T / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)), "euclid": np.linalg.norm(a[:, None] - b[None], axis=2)}
    monkeypatch.setattr(dense, "PRODUCTS", 10_000)
    for distance, most in (("dot", 1.5), ("cosine", 2.5), ("euclid", 5)):
        tracemalloc.start()
        s = dense.products(a, b, distance)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.allclose(s, straight[distance], rtol=0, atol=1e-12) and peak < most * s.nbytes, (distance, peak / s.nbytes)
    assert (dense.products(a, b, "euclid")[:200, 100:] == 0).all()


def test_equal_scores_follow_each_other(spark, monkeypatch, small_batches):
    points, queries = vectors(spark)
    points = points.coalesce(1)
    for distance in ("cosine", "dot", "euclid"):
        every = dense.scored(points, queries, distance).where("score is not null and not isnan(score)").select("query_id", "point_id", "score").collect()
        want = {(r.query_id, r.point_id): r.score for r in every}
        with monkeypatch.context() as small:
            for most in (dense.ALIKE, 160) if hasattr(dense, "ALIKE") else (0,):
                small.setattr(dense, "ALIKE", most, raising=False)
                small.setattr(dense, "PRODUCTS", 60)
                rows = dense.exact(points, queries, distance).collect()
                assert len(rows) == len(want) == len({(r.query_id, r.point_id) for r in rows}) and all(abs(r.score - want[r.query_id, r.point_id]) < 1e-9 for r in rows)
                if most != 160:
                    runs = 1 + sum(round(a.score, 6) != round(b.score, 6) for a, b in zip(rows, rows[1:]))
                    assert runs == len({round(r.score, 6) for r in rows}) < len(rows)


def test_scores_of_few_digits(spark, monkeypatch):
    """Scores are rounded as SQL rounds them, one row a pair though ids repeat, also where a piece's scores are too large to sort."""
    rows = [(7, [1.0, 127.99609369], 1), (7, [1.0, 0.0], 1), (8, [0.0078125, 0.0], 1), (9, [-0.0078125, 0.0], 1), (10, [-1e-9, 0.0], 1), (None, [3e9, 0.0], 1)]
    points = spark.createDataFrame([(i, v, "k", {"even": "1"}) for i, v, _ in rows], "point_id long, vector array<double>, kb_id string, values map<string,string>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (1, [2.0, 0.0])], "query_id long, vector array<double>")
    want = sorted((str(i), f) for i, f in [(7, 1.0), (7, 2.0), (7, 1.0), (7, 2.0), (8, 0.007813), (8, 0.015625), (9, -0.007813), (9, -0.015625), (10, 0.0), (10, 0.0), (None, 3e9), (None, 6e9)])
    whole = dense.by_score
    for least in (0, 1 << 14):  # sorted in one integer; or too large for that
        with monkeypatch.context() as small:
            small.setattr(dense, "by_score", lambda pieces, size, least=least: whole(pieces, max(size, least)))
            got = dense.exact(points, queries, "dot", digits=6).collect()
            assert sorted((str(r.point_id), r.score) for r in got) == want and not any(str(r.score) == "-0.0" for r in got)


def test_equal_scores_of_many_queries(spark):
    """Scores of more queries than another search's pass takes are sorted together."""
    r = np.random.default_rng(4)
    points = spark.createDataFrame([(k, [float(x) for x in r.integers(-2, 3, 3)], "k", {"even": "1"}) for k in range(12)], "point_id long, vector array<double>, kb_id string, values map<string,string>").coalesce(1)
    queries = spark.createDataFrame([(k, [float(x) for x in r.integers(-2, 3, 3)]) for k in range(1_500)], "query_id long, vector array<double>")
    rows = dense.exact(points, queries, "dot").collect()
    assert len(rows) == 18_000 and sum(a.score != b.score for a, b in zip(rows, rows[1:])) + 1 == len({r.score for r in rows})


def test_scores_sorted_in_one_integer(monkeypatch):
    r = np.random.default_rng(3)
    s = np.trunc(r.normal(size=(400, 500)) * 1e6)
    s[r.random(s.shape) < 0.3] = -np.inf
    monkeypatch.setattr(dense, "PRODUCTS", 4_000)
    tracemalloc.start()
    n, last, seen = 0, -np.inf, np.zeros(s.size, bool)
    for values, places in dense.by_score((s[k : k + 8] for k in range(0, 400, 8)), s.size):
        assert (s.ravel()[places] == values).all() and (np.diff(values) >= 0).all() and values[0] >= last
        n, last, seen[places] = n + len(values), values[-1], True
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == seen.sum() == np.isfinite(s).sum() and peak < 1.6 * s.nbytes
    batches = [pa.RecordBatch.from_pydict({"x": list(range(k, k + 7))}) for k in range(0, 70, 7)]
    parts = list(dense.gathered(iter(batches), 20))
    assert [p.num_rows for p in parts] == [20, 20, 20, 10] and sum((p.to_pydict()["x"] for p in parts), []) == list(range(70))


def test_texts_parsed_in_slices(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"content": ["a" * 5, None, "", "b" * 30, "c" * 4, "d" * 6, "é" * 3]})
    parts = list(chunking.slices([batch, batch.slice(0, 0)], "content", 10))
    assert [p.num_rows for p in parts] == [3, 1, 2, 1] and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    rows = [(f"k:d{i}", "k", f"d{i}", "h", "# a\n" + "x y\n" * i) for i in range(30)]
    docs = spark.createDataFrame(rows, "id string, kb_id string, path string, source_hash string, content string")
    want = sorted(map(str, chunking.chunked(docs, 20).collect()))
    monkeypatch.setattr(chunking, "PARSED", 50)
    assert sorted(map(str, chunking.chunked(docs, 20).collect())) == want


def test_overlap_without_shuffled_pairs(spark, monkeypatch, small_batches):
    r = np.random.default_rng(7)
    words = [f"w{k}" for k in range(40)]
    docs = [(k, [str(x) for x in r.choice(words, r.integers(0, 30), False)]) for k in range(50)] + [(3, ["w1", "w2", "w3"]), (None, ["w1"]), (None, ["w1", "w5"]), (60, None), (61, ["other"])]
    docs = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    items = spark.createDataFrame([(f"i{k}", [str(x) for x in r.choice(words, r.integers(0, 9))]) for k in range(12)] + [("none", None)], "item_id string, tokens array<string>")
    each = lambda df, key: df.select(key, F.explode("tokens").alias("token")).distinct()
    want = sorted(map(str, each(docs, "doc_id").join(each(items, "item_id"), "token").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared")).collect()))
    found = lexical.shared(docs.where("doc_id < 3 or doc_id > 3"), items)
    assert "Aggregate" not in explained(found) and "Exchange" not in explained(found)
    monkeypatch.setattr(lexical, "HELD", 100)
    assert sorted(map(str, lexical.shared(docs, items).collect())) == want
    monkeypatch.setattr(lexical, "CELLS", 0)
    assert sorted(map(str, lexical.shared(docs, items).collect())) == want
    assert lexical.shared(docs, items.where("false")).count() == 0


def test_index_by_one_shuffle(spark, monkeypatch, small_batches):
    r = np.random.default_rng(9)
    rows = [(f"c{k}", ["a", "b", None][k % 3], [str(x) for x in r.choice(["the", "rose", "frost", "ß", "x1"], r.integers(0, 12))]) for k in range(400)]
    bags = spark.createDataFrame(rows, "chunk_id string, kb_id string, tokens array<string>").withColumn("length", F.size("tokens").cast("long"))
    each = bags.select("chunk_id", "kb_id", "length", F.explode("tokens").alias("token")).groupBy("token", "chunk_id", "kb_id", "length").agg(F.count("*").alias("tf"))
    monkeypatch.setattr(lexical, "TOKENS", 20, raising=False)
    postings = lexical.counted(bags)
    columns = ["token", "chunk_id", "kb_id", "tf", "length"]
    assert sorted(map(str, postings.select(columns).collect())) == sorted(map(str, each.select(columns).collect()))
    span = F.pmod(F.xxhash64("chunk_id"), F.lit(3)).cast("int")
    plain = each.withColumn("span", span).groupBy("token", "kb_id", "span").agg(F.max("tf").alias("most_tf"), F.min("length").alias("least_length"), F.sort_array(F.collect_list(F.struct("chunk_id", "tf", "length"))).alias("postings"))
    made = segments.blocks(postings, 3 * segments.SPAN, 8)
    assert sorted(map(str, made.drop("bucket").collect())) == sorted(map(str, plain.collect()))
    assert explained(made).count("Exchange") == 1


def test_scores_by_one_shuffle(spark, small_batches):
    r = np.random.default_rng(11)
    words = ["the", "rose", "frost", "loam", "x1"]
    rows = [(f"c{k}", "ab"[k % 2], f"t{k}", "", " ".join(str(x) for x in r.choice(words, r.integers(0, 12))), {"lang": "xy"[k % 3 > 0]}) for k in range(120)]
    chunks = spark.createDataFrame(rows, "chunk_id string, kb_id string, title string, heading string, text string, values map<string,string>")
    asked = [(f"q{k}", " ".join(words[: k + 1]), [None, ["a"], ["b", "a"]][k % 3], {"lang": "x"} if k == 2 else None) for k in range(5)]
    queries = spark.createDataFrame(asked, "query_id string, text string, kb_ids array<string>, filters map<string,string>")
    for strategy in ("bm25", "overlap"):
        want = {(x.query_id, x.chunk_id): x.score for x in lexical.scores(chunks, queries, strategy).collect()}
        got = lexical.scores(chunks, queries, strategy, lambda df, _: df.persist())
        assert {(x.query_id, x.chunk_id): x.score for x in got.collect()} == want and want
        # the postings' way to the answer: one exchange, by query and chunk
        plan = explained(got)
        assert "hashpartitioning(scope" not in plan.split("BroadcastExchange")[0] and "SortMergeJoin" not in plan.split("BroadcastExchange")[0]
