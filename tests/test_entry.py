"""The driver's contract."""

import re

import __spark_entry__ as entry


def test_names():
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and len(names) > 100
    if entry.llm:
        assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "rank", "score", "excerpt", "truncated"] and df.count() > 0


def test_windows_of_all_documents(spark):
    d = "/root/testdata/sf0.001"
    got = {}
    for r in entry.queries()["f22_windows"](spark, d).collect():
        got.setdefault(r.chunk_id, []).append((r.start, r.end, r.tokens, r.text))
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        t = r.text
        if t:
            want[r.doc_id] = [(k, min(k + 90, len(t)), min(90, len(t) - k) + 10, t[k : k + 90]) for k in range(0, len(t), 90)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_overlap_of_all_pairs(spark):
    d = "/root/testdata/sf0.001"
    words = lambda t: set(re.findall("[a-z0-9_]+", t.lower()))
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    docs = [(r.doc_id, words(r.text or "")) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = {(i, k): len(a & b) for i, a in items for k, b in docs if a & b}
    got = {(r.item_id, r.doc_id): r.shared for r in entry.queries()["u3_token_overlap"](spark, d).collect()}
    assert got == want and len({i for i, _ in got}) == len(items)
