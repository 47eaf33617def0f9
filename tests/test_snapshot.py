"""Snapshots and their index, changed step by step, against ones made anew."""

import os
import random

import pytest
from pyspark.sql import functions as F

from granary.functions.identity import digest
from granary.operators import lexical, segments, snapshot, sync
from granary.operators.chunking import pipeline_hash
from granary.operators.packing import ranked
from granary.sources.store import Store

WORDS = "rose loam water seed soil rain frost mulch pruning graft the a of in".split()
SCHEMA = "id string, kb_id string, path string, source_hash string, content string"


def apply(spark, store, files: dict[str, str]) -> int:
    rows = [(i, i.split(":")[0], i.split(":")[1], digest(t), t) for i, t in files.items()]
    df = spark.createDataFrame(rows, SCHEMA)
    with store.lock(), store.staging() as keep:
        there = snapshot.table(store, store.active(), "documents")
        statuses = keep(sync.changes(df.select("id", "source_hash", F.lit(pipeline_hash(60)).alias("pipeline_hash")), there), "statuses")
        return snapshot.advance(store, statuses, lambda ids: df.join(ids, "id", "left_semi"), 60, lambda _: {}, keep)


def text(r: random.Random) -> str:
    lines = ["# " + r.choice(WORDS), *(" ".join(r.choices(WORDS, weights=range(1, len(WORDS) + 1), k=r.randint(1, 12))) for _ in range(r.randint(1, 6)))]
    return "\n".join(lines) + "\n"


def queries(spark, n=12):
    r = random.Random(3)
    rows = [(f"q{k}", " ".join(r.sample(WORDS, r.randint(1, 5))), [None, ["a"], ["a", "b"]][k % 3], None, r.choice([1, 3, 8]), 5000) for k in range(n)]
    return spark.createDataFrame(rows, "query_id string, text string, kb_ids array<string>, filters map<string,string>, top_k int, max_chars int")


def whole(df):
    return sorted(map(str, df.collect()))


def test_changes_step_by_step(spark, tmp_path):
    r = random.Random(1)
    store = Store(spark, tmp_path / "s", 8)
    files = {f"{'abc'[k % 3]}:d{k}.md": text(r) for k in range(40)}
    taken: dict[str, str] = {}
    asked = queries(spark)
    assert apply(spark, store, files) > 0
    for step in range(4):
        for _ in range(6):  # 24 changes: updates, removals, additions, and what was removed comes back
            kind, name = r.choice(["update", "remove", "add", "back"]), r.choice(sorted(files))
            if kind == "update":
                files[name] = text(r)
            elif kind == "remove":
                taken[name] = files.pop(name)
            elif kind == "add":
                files[f"{r.choice('abc')}:n{step}{r.random()}.md"] = text(r)
            elif taken:
                back = r.choice(sorted(taken))
                files[back] = taken.pop(back)
        apply(spark, store, files)
    anew = Store(spark, tmp_path / "n", 8)
    apply(spark, anew, files)
    for name in ("documents", "chunks", "bags"):
        columns = {"documents": sync.DOCUMENT, "chunks": sync.CHUNK, "bags": segments.BAG}[name]
        assert whole(store.read(store.active(), name).select(columns)) == whole(anew.read(anew.active(), name).select(columns))
    assert store.active()["digests"] == anew.active()["digests"]
    one, two = segments.stored(store, store.active()), segments.stored(anew, anew.active())
    assert 1 < len(store.active()["segments"]) <= 5
    columns = ["token", "chunk_id", "kb_id", "tf", "length"]
    assert whole(one.read().select(columns)) == whole(two.read().select(columns))
    sums = lambda x: whole(x.terms(None).groupBy("kb_id", "token").agg(F.sum("df").alias("df")).where("df <> 0")) + whole(x.sums.groupBy("kb_id").agg(F.sum("n"), F.sum("total")))
    assert sums(one) == sums(two)
    # searches over segments, with and without bounds, agree with those over chunks
    active = store.active()
    chunks = snapshot.described(store.read(active, "documents"), store.read(active, "chunks"))
    want = ranked(lexical.scores(chunks, asked), "query_id").join(asked.select("query_id", "top_k"), "query_id").where("rank <= top_k").select("query_id", "rank", "chunk_id", F.round("score", 9))
    assert whole(ranked(lexical.scores(one, asked), "query_id").join(asked.select("query_id", "top_k"), "query_id").where("rank <= top_k").select("query_id", "rank", "chunk_id", F.round("score", 9))) == whole(want)
    assert whole(lexical.top(one, asked, lambda df, _: df.cache()).select("query_id", "rank", "chunk_id", F.round("score", 9))) == whole(want)
    # nothing that isn't named is left, and what is named still reads
    assert store.vacuum() and whole(segments.stored(store, store.active()).read().select(columns)) == whole(two.read().select(columns))


def test_one_change_writes_one_bucket(spark, tmp_path, monkeypatch):
    store = Store(spark, tmp_path / "s", 8)
    r = random.Random(2)
    files = {f"a:d{k}.md": text(r) for k in range(50)}
    apply(spark, store, files)
    before = store.active()
    times = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "s").rglob("*.parquet"))}
    tokenized = []
    real = segments.bagged
    monkeypatch.setattr(segments, "bagged", lambda df: tokenized.append(df.count()) or real(df))
    files["a:d7.md"] = "only rose here\n"
    assert apply(spark, store, files) == 1 and tokenized == [1]
    after = store.active()
    for name in ("documents", "chunks", "bags"):
        was, now = (set(x["places"][name].values()) for x in (before, after))
        assert len(was - now) <= 1 == len(now - was)
    assert all(os.stat(p).st_mtime_ns == t for p, t in times.items())
    assert [s["number"] for s in after["segments"]] == [0, 1] and after["segments"][1]["postings"] < 10
    assert apply(spark, store, files) == 0 and store.active()["generation"] == after["generation"]


def test_bounds_leave_spans_out(spark, tmp_path):
    """A rare word among many chunks of common ones: most spans can't reach its chunks' scores and aren't read."""
    store = Store(spark, tmp_path / "s", 4)
    r = random.Random(4)
    files = {f"a:d{k}.md": " ".join(r.choices(["the", "of", "in", "water"], k=r.randint(5, 30))) + (" orchid orchid orchid" if k % 400 == 0 else "") + "\n" for k in range(4000)}
    apply(spark, store, files)
    active = store.active()
    index = segments.stored(store, active)
    asked = spark.createDataFrame([("q", "the orchid of water", None, None, 3, 5000)], "query_id string, text string, kb_ids array<string>, filters map<string,string>, top_k int, max_chars int")
    read: dict[str, object] = {}
    hits = lexical.top(index, asked, lambda df, name: read.setdefault(name, df.cache()))
    want = ranked(lexical.scores(index, asked), "query_id").where("rank <= 3").select("chunk_id", "rank")
    assert whole(hits.select("chunk_id", "rank")) == whole(want)
    every, rest = read["spans"].count(), read["rest"].count()
    assert every > 25 and rest + lexical.FIRST_SPANS < every / 2


def test_incomplete_generation_is_an_error(spark, tmp_path):
    store = Store(spark, tmp_path / "s", 4)
    apply(spark, store, {"a:x.md": "rose\n"})
    place = next(iter(store.active()["places"]["documents"].values()))
    os.rename(place, place + "-gone")
    with pytest.raises(ValueError, match="incomplete"):
        store.active()
