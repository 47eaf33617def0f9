"""The engine end to end over Markdown files."""

import json
import os

import pytest

from granary.api import Engine
from granary.operators.chunking import parse
from granary.sources.config import Config, Source, dump_config, load_config
from granary.sources.files import source_files
from granary.sources.store import Store, write_whole

FIRST = "---\nstatus: reviewed\nday: 2024-05-01\ntags: [a, b]\n---\n# Garden notes\nTomatoes need water.\n## Soil\n```\n# not a heading\n```\nLoam is best for roses.\n"


@pytest.fixture
def engine(spark, tmp_path):
    for kb in ("alpha", "beta"):
        (tmp_path / kb / "deep").mkdir(parents=True)
    (tmp_path / "alpha/first.md").write_text(FIRST)
    (tmp_path / "alpha/_second.md").write_text("﻿status\nplain 语义检索 text about roses\n")
    (tmp_path / "alpha/.hidden.md").write_text("hidden")
    (tmp_path / "beta/deep/third.md").write_text("# Other\nRoses and roses and loam\n")
    return Engine(spark, Config(tmp_path / "state", (Source("alpha", tmp_path / "alpha"), Source("beta", tmp_path / "beta"))))


def test_parse():
    title, metadata, chunks = parse(FIRST, "first", 1200)
    assert title == "Garden notes" and metadata == {"status": "reviewed", "day": "2024-05-01", "tags": ["a", "b"]}
    assert [(c[0], c[1], c[2]) for c in chunks] == [("Garden notes", 6, 7), ("Garden notes > Soil", 8, 12)]
    assert parse("a\n" * 30, "x", 20)[2][0][1:3] == (1, 10)
    assert parse("", "x", 100) == ("x", {}, [])
    assert parse("~~~\n" + "line\n" * 50 + "~~~~\nend\n", "x", 20)[2][0][1:3] == (1, 52)
    with pytest.raises(ValueError, match="no end"):
        parse("---\na: 1\n", "x", 100)
    with pytest.raises(ValueError, match="no mapping"):
        parse("---\n- a\n---\n", "x", 100)


def test_index_and_search(engine, tmp_path):
    counts = engine.index()
    assert (counts["files"], counts["added"], counts["chunks_written"]) == (3, 3, 4)
    again = engine.index()
    assert (again["unchanged"], again["added"], again["chunks_written"]) == (3, 0, 0)
    assert [tuple(r) for r in engine.list_knowledge_bases().collect()] == [("alpha", 2), ("beta", 1)]

    found = engine.search("roses loam")
    assert found["hits"][0]["doc_id"] == "beta:deep/third.md" and found["status"] == "candidates_found"
    scoped = engine.search("roses loam", kb_ids=["alpha"], filters={"status": "reviewed"})["hits"]
    assert [h["doc_id"] for h in scoped] == ["alpha:first.md"] and scoped[0]["heading"] == "Garden notes > Soil"
    assert (scoped[0]["start_line"], scoped[0]["end_line"]) == (8, 12)
    assert {h["doc_id"] for h in engine.search("roses", filters={"status": None})["hits"]} == {"alpha:_second.md", "beta:deep/third.md"}
    assert engine.search("检索")["hits"][0]["doc_id"] == "alpha:_second.md"
    assert engine.search("zebra")["status"] == "no_evidence"
    cut = engine.search("roses", max_chars=9)
    assert cut["content_chars"] == 9 and cut["hits"][0]["truncated"]
    for bad in ({"query": " "}, {"query": "x", "top_k": 51}, {"query": "x", "kb_ids": []}, {"query": "x", "kb_ids": ["none"]}):
        with pytest.raises(ValueError):
            engine.search(**bad)
    part = engine.read_document("alpha:first.md", 6, 10)
    assert part["text"] == "# Garden n" and part["truncated"]
    with pytest.raises(ValueError, match="version"):
        engine.read_document("alpha:first.md", source_hash="0" * 64)
    with pytest.raises(ValueError, match="unknown"):
        engine.read_document("alpha:none.md")
    with pytest.raises(ValueError, match="behind"):
        engine.read_document("alpha:first.md", 99)
    traces = (tmp_path / "state/traces.jsonl").read_text()
    assert "roses" not in traces and '"operation": "search"' in traces


def test_changes_are_all_or_nothing(engine, tmp_path, spark):
    engine.index()
    (tmp_path / "alpha/first.md").write_text("---\nbroken\n")
    (tmp_path / "alpha/new.md").write_text("new")
    with pytest.raises(Exception, match="no end"):
        engine.index()
    assert engine.search("tomatoes")["hits"]
    (tmp_path / "alpha/first.md").write_text("changed")
    os.remove(tmp_path / "alpha/_second.md")
    counts = engine.index()
    assert (counts["added"], counts["updated"], counts["deleted"], counts["unchanged"]) == (1, 1, 1, 1)
    os.rename(tmp_path / "beta", tmp_path / "gone")
    with pytest.raises(FileNotFoundError):
        engine.index()
    assert {r.kb_id for r in engine.list_knowledge_bases().collect()} == {"alpha", "beta"}
    only = Engine(spark, Config(tmp_path / "state", (Source("alpha", tmp_path / "alpha"),)))
    assert {r.kb_id for r in only.list_knowledge_bases().collect()} == {"alpha"}


def test_vectors(engine, tmp_path):
    assert engine.vector_status()["status"] == "not_built"
    with pytest.raises(RuntimeError, match="no vector"):
        engine.search("roses", strategy="dense")
    built = engine.build_vector()
    assert built["status"] == "ready" and built["points"] == 4 and built["cache_misses"] == 4
    assert engine.vector_status()["status"] == "ready"
    hits = engine.search("roses and loam", strategy="dense", top_k=2)["hits"]
    assert hits[0]["doc_id"] == "beta:deep/third.md" and len(hits) == 2
    assert engine.build_vector()["cache_misses"] == 0
    (tmp_path / "alpha/first.md").write_text("---\nx\n")
    with pytest.raises(Exception):
        engine.build_vector()
    assert engine.vector_status()["status"] == "failed" and engine.search("roses", strategy="dense")["hits"]
    os.remove(tmp_path / "alpha/first.md")
    engine.build_vector()
    assert engine.vector_status()["changed_documents"] == 0
    (tmp_path / "alpha/first.md").write_text("late")
    status = engine.vector_status()
    assert status["status"] == "stale" and status["changed_documents"] == 1


def test_benchmark_and_compare(engine, tmp_path):
    cases = [
        {"id": "a", "category": "exact", "query": "loam roses", "kb_ids": ["alpha"], "relevant": [{"doc_id": "alpha:first.md", "contains": "Loam is best"}]},
        {"id": "b", "category": "none", "query": "zebra", "relevant": []},
    ]
    path = tmp_path / "cases.jsonl"
    path.write_text("\n".join(map(json.dumps, cases)))
    report = engine.run_benchmark(path, tmp_path / "runs", repeats=2)
    overall = report["metrics"][0]
    assert overall["overall"] and overall["recall_at_k"] == 1.0 and overall["empty_on_unanswerable"] == 1.0 and overall["precision_at_k"] == 0.2
    other = engine.run_benchmark(path, tmp_path / "runs", strategy="overlap", repeats=2)
    assert engine.compare(report, other)["recall_delta_95"] == [0.0, 0.0]
    with pytest.raises(ValueError, match="top_k"):
        engine.compare(report, other | {"top_k": 3})
    cases[0]["relevant"][0]["contains"] = "nowhere"
    path.write_text("\n".join(map(json.dumps, cases)))
    with pytest.raises(ValueError, match="can't be earned"):
        engine.run_benchmark(path, tmp_path / "runs")


def test_preview_and_connect(engine, tmp_path):
    (tmp_path / "more").mkdir()
    (tmp_path / "more/x.md").write_text("fresh words")
    source = Source("more", tmp_path / "more")
    seen = engine.preview(source)
    assert (seen["files"], seen["bytes"], seen["oversize"], seen["samples"]) == (1, 11, 0, ["x.md"])
    (tmp_path / "more/y.md").write_text("other")
    with pytest.raises(ValueError, match="changed"):
        engine.connect(source, seen["preview_id"], tmp_path / "c.toml")
    assert not (tmp_path / "c.toml").exists()
    joined = engine.connect(source, engine.preview(source)["preview_id"], tmp_path / "c.toml")
    assert joined.search("fresh")["hits"] and load_config(tmp_path / "c.toml").sources[-1].id == "more"
    assert joined.status()["knowledge_bases"][2] == {"kb_id": "more", "documents": 2}


def test_config_and_files(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("x")
    (tmp_path / "in/secret.md").write_text("x")
    config = Config(tmp_path / "s", (Source("k", tmp_path / "in", exclude=("secret*",)),))
    (tmp_path / "c.toml").write_text("﻿" + dump_config(config))
    assert load_config(tmp_path / "c.toml") == config
    assert source_files(config.sources[0]) == ["a.md"]
    (tmp_path / "in/out.md").symlink_to("/etc/hostname")
    with pytest.raises(ValueError, match="leads out"):
        source_files(config.sources[0])
    (tmp_path / "c.toml").write_text("storge = 'x'")
    with pytest.raises(ValueError, match="unknown settings"):
        load_config(tmp_path / "c.toml")
    with pytest.raises(ValueError, match="invalid knowledge base"):
        Source("No", tmp_path)


def test_store(spark, tmp_path):
    store = Store(spark, tmp_path / "s")
    df = spark.range(3)
    store.publish({"t": df}, {"a": 1}, "scope")
    assert store.active("scope")["a"] == 1 and store.active("other") is None
    with store.lock(), pytest.raises(RuntimeError, match="another build"):
        with store.lock():
            pass
    path = store.folder(store.active()["generation"]) / "manifest.json"
    path.write_text(path.read_text().replace('"a": 1', '"a": 2'))
    with pytest.raises(ValueError, match="changed"):
        store.active()
    with pytest.raises(FileExistsError):
        write_whole(path, "x", fresh=True)
