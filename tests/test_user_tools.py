"""What users start: command line, tools, checks, vector collections, publication, downloads, local models."""

import hashlib
import io
import json
import subprocess
from pathlib import Path

import numpy as np
import pytest

from granary import checks, cli, provenance, publication, tools
from granary.api import Engine
from granary.functions.embeddings import Hashed, Http, Onnx, Spec
from granary.operators import audit, dense
from granary.operators.collection import Collection, Contract
from granary.sources import models
from granary.sources.config import Config, Source, dump_config
from granary.sources.store import Trace, append_line


@pytest.fixture
def config(tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb/a.md").write_text("# Garden\nRoses like loam.\n")
    (tmp_path / "more").mkdir()
    (tmp_path / "more/b.md").write_text("---\nstatus: new\n---\n# Kitchen\nBread needs yeast.\n")
    path = tmp_path / "config.toml"
    path.write_text(dump_config(Config(tmp_path / "state", (Source("kb", tmp_path / "kb"),))))
    return path


def test_commands(spark, config, tmp_path, capsys):
    def run(*argv, code=0):
        assert cli.main(["--config", str(config), *argv], spark) == code
        out = capsys.readouterr()
        return json.loads(out.out) if code == 0 else out.err

    assert run("setup-status")["status"] == "needs_index"
    assert run("index")["added"] == 1 and run("list") == [{"kb_id": "kb", "documents": 1}]
    hit = run("search", "roses", "--kb", "kb", "--top-k", "1")["hits"][0]
    assert hit["doc_id"] == "kb:a.md" and run("read", "kb:a.md", "--source-hash", hit["source_hash"])["text"].startswith("# Garden")
    assert "ValueError" in run("read", "kb:none.md", code=2)
    seen = run("preview", "more", str(tmp_path / "more"))
    assert seen["can_connect"] and "confirm" in run("connect", "more", str(tmp_path / "more"), "--preview-id", seen["preview_id"], code=2)
    assert run("connect", "more", str(tmp_path / "more"), "--preview-id", seen["preview_id"], "--confirmed")["status"] == "ready"
    assert run("search", "yeast", "--filters", '{"status": "new"}')["hits"][0]["doc_id"] == "more:b.md"
    assert "absolute" in run("preview", "x", "relative", code=2) and "another id" in run("preview", "more", str(tmp_path / "kb"), code=2) and "another scope" in run("preview", "more", str(tmp_path / "more"), "--include", "*.txt", code=2)
    cases = tmp_path / "cases.jsonl"
    cases.write_text("\n".join(json.dumps({"id": c, "category": c, "query": q, "relevant": r}) for c, q, r in (("a", "roses loam", [{"doc_id": "kb:a.md", "contains": "loam"}]), ("b", "zebra", []))))
    first = run("benchmark", "--dataset", str(cases), "--output", str(tmp_path / "runs"), "--repeats", "2", "--warmup", "0")["report"]
    report = json.loads(Path(first).read_text())
    assert report["metrics"][0]["recall_at_k"] == 1 and report["stages_ms"]["rank"]["p50"] > 0 and report["environment"]["code_hash"] and report["process_memory"] > 0
    assert {m["category"]: m["latency_p95_ms"] > 0 for m in report["metrics"]} == {None: True, "a": True, "b": True} and len(report["queries"][0]["latencies_ms"]) == 2
    compared = run("compare", first, first, "--output", str(tmp_path / "c.json"))
    assert compared["metric_deltas"]["recall_at_k"] == 0 and len(compared["warnings"]) == 1 and json.loads((tmp_path / "c.json").read_text()) == compared
    assert "FileExistsError" in run("compare", first, first, "--output", str(tmp_path / "c.json"), code=2)
    assert "repeats" in run("benchmark", "--dataset", str(cases), "--output", str(tmp_path / "runs"), "--repeats", "0", code=2)
    installed = run("install")
    assert len(installed["tools"]) == 6 and installed["registration"]["args"][-1] == "serve"
    assert run("vector-status")["status"] == "not_built"
    approved = report["corpus_hash"]
    data = [json.loads(x) for x in cases.read_text().splitlines()]
    summary = json.loads(publication.public_summary(spark, report, data, approved, tmp_path / "public").read_text())
    assert "queries" not in summary and summary["metrics"] == report["metrics"]
    with pytest.raises(ValueError, match="approved"):
        publication.public_summary(spark, report, data[:1], approved, tmp_path / "other")


def test_server(spark, config):
    from granary.sources.config import load_config

    engine = Engine(spark, load_config(config))
    engine.index()
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/call", "params": {"name": "search_knowledge", "arguments": {"query": "loam"}}}, {"id": 3, "method": "tools/call", "params": {"name": "read_document", "arguments": {}}}, {"id": 4, "method": "nothing"}]
    out = io.BytesIO()
    tools.serve(tools.Tools(engine), io.BytesIO(b"\n".join([json.dumps(x).encode() for x in asked] + [b"{"])), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, None]
    assert json.loads(replies[1]["result"]["content"][0]["text"])["hits"] and replies[2]["result"]["isError"] and replies[3]["error"]["code"] == -32601


def test_vector_check(spark, tmp_path):
    done = checks.run_vector_check(spark, tmp_path / "checks")
    report = json.loads(Path(done["report"]).read_text())
    assert done["status"] == "passed" and done["passed_count"] == len(report["checks"]) > 20
    assert report["storage_bytes"] > 0 and report["stage_timings_ms"]["vector_search.rank"]["samples"] >= 5


def test_vector_check_finds_a_fault(spark, tmp_path, monkeypatch):
    real = Collection.count
    monkeypatch.setattr(Collection, "count", lambda self, kb_ids=None: real(self, kb_ids) + 1)
    with pytest.raises(ValueError, match="all points"):
        checks.run_vector_check(spark, tmp_path / "checks")
    assert json.loads(next((tmp_path / "checks").rglob("report.json")).read_text())["status"] == "failed"


def test_deletions_write_bitmaps_only(spark, tmp_path):
    bench = checks.Bench(spark, tmp_path / "c", tmp_path / "t.jsonl")
    bench.store.create()
    names = list(bench.drawn)
    bench.put(names)
    before = {p for p in (tmp_path / "c").rglob("*.parquet")}
    assert bench.drop(names[:1]) == 1 and bench.store.count() == len(names) - 1
    fresh = {p for p in (tmp_path / "c").rglob("*.parquet")} - before
    assert fresh and all(p.parent.name == "points.dead" for p in fresh)
    assert bench.found() == bench.ranked() and bench.found(["north"]) == bench.ranked(["north"])
    assert bench.put(names[:1]) == 1 and bench.found() == bench.ranked()  # what was deleted may come again


def test_collection_of_another_schema_stays(spark, tmp_path):
    contract = lambda n: Contract(Spec("p", "m", "1", n, 9), "c", (("a:x", "h"),))
    with Collection(spark, contract(3), tmp_path) as store:
        assert store.create()
    before = (tmp_path / "collection.json").read_text()
    with Collection(spark, contract(4), tmp_path) as store, pytest.raises(ValueError, match="another schema"):
        store.create()
    assert (tmp_path / "collection.json").read_text() == before
    with pytest.raises(ValueError, match="closed"):
        store.count()
    with pytest.raises(ValueError, match="created"):
        Collection(spark, contract(3), tmp_path / "none").count()


def test_embedding_check(spark, tmp_path):
    done = checks.run_embedding_check(spark, Hashed(16, 120), tmp_path)
    assert done["status"] == "passed" and done["passed_count"] == 6

    class Broken(Hashed):
        def encode(self, texts):
            return [[2.0] * 16 for _ in texts]

    with pytest.raises(Exception):
        checks.run_embedding_check(spark, Broken(16, 120), tmp_path / "broken")
    assert json.loads(next((tmp_path / "broken").rglob("report.json")).read_text())["status"] == "failed"


def test_local_model(tmp_path):
    from tokenizers import Tokenizer, models as parts

    (tmp_path / "onnx").mkdir()
    with pytest.raises(ValueError, match="installed"):
        Onnx(tmp_path, "m", "1", 4, 9)
    (tmp_path / "onnx/model.onnx").write_bytes(b"no model")
    words = Tokenizer(parts.WordLevel({"<pad>": 0, "a": 1, "b": 2}, unk_token="<pad>"))
    from tokenizers.pre_tokenizers import Whitespace

    words.pre_tokenizer = Whitespace()
    words.save(str(tmp_path / "tokenizer.json"))
    model = Onnx(tmp_path, "m", "1", 4, 9, batch=2)
    words.enable_padding(pad_id=0, pad_token="<pad>")

    class Session:
        def get_inputs(self):
            return [type("Input", (), {"name": n}) for n in ("input_ids", "attention_mask")]

        def run(self, _, fields):
            return [np.stack([np.eye(4)[row] for row in fields["input_ids"]]) + 0.0]

    model._loaded = (words, Session())
    got = np.array(model.encode(["a", "a b b", "b"]))
    assert np.allclose(got, [[0, 1, 0, 0], np.array([0, 1, 2, 0]) / 5**0.5, [0, 0, 1, 0]]) and model.count("a b") == 2
    assert model.__getstate__()["_loaded"] is None and model.spec.revision.startswith("1:")


def test_addresses():
    spec = Spec("api", "m", "1", 2, 9)
    for bad in ("http://host/v1", "https://host/v1?x=1", "https://u@host/", "ftp://host", "https://host/#f"):
        with pytest.raises(ValueError):
            Http(spec, bad)
    for good in ("https://host/v1", "http://localhost:1/v1", "http://127.0.0.1/", "http://[::1]/"):
        Http(spec, good)


def test_download(tmp_path):
    body = b"weights"
    pinned = {"model": "o/m", "revision": "r", "files": {"onnx/model.onnx": hashlib.sha256(body).hexdigest(), "config.json": None}}
    asked = []

    def opener(url):
        asked.append(url)
        return io.BytesIO(body)

    report = models.download(tmp_path, pinned, "https://h", opener)
    assert asked[0] == "https://h/o/m/resolve/r/onnx/model.onnx" and report["total_bytes"] == 14
    models.download(tmp_path, pinned, "https://h", opener)
    assert len(asked) == 2
    (tmp_path / "onnx/model.onnx").write_bytes(b"damaged")
    with pytest.raises(ValueError, match="another hash"):
        models.download(tmp_path, pinned, "https://h", lambda url: io.BytesIO(b"wrong"))
    assert not list(tmp_path.rglob("*.partial"))


def test_publication(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", "-C", str(root), *a], check=True, capture_output=True)
    git("init", "-q")
    (root / "ok.md").write_text("fine\n")
    (root / "gone.txt").write_text("key sk-proj-" + "a" * 24)
    git("add", "-A")
    git("commit", "-qm", "one")
    git("rm", "-q", "gone.txt")
    (root / "bin").write_bytes(b"\0")
    (root / "run.jsonl").write_text("{}")
    (root / ".env.example").write_text("A=1\n")
    (root / "deep.pem").write_text("x")
    (root / "home.md").write_text("a\nsee /home/someone/x\n")
    found = {(r.commit is not None, r.file, r.line, r.reason) for r in publication.findings(spark, root, history=True).collect()}
    assert found == {(True, "gone.txt", 1, "possible-api-key"), (False, "bin", None, "binary"), (False, "run.jsonl", None, "private artifact"), (False, "deep.pem", None, "private artifact"), (False, "home.md", 2, "user-home-path")}
    with pytest.raises(ValueError, match="nothing is copied"):
        publication.clean_copy(spark, root, tmp_path / "out")
    for name in ("bin", "run.jsonl", "deep.pem", "home.md"):
        (root / name).unlink()
    (root / "link").symlink_to("ok.md")
    git("add", "-A")
    assert [r.reason for r in publication.findings(spark, root, staged=True).collect()] == ["symbolic link"]
    (root / "link").unlink()
    copy = publication.clean_copy(spark, root, tmp_path / "out")
    assert sorted(p.name for p in copy.iterdir()) == [".env.example", "ok.md"]


def test_reports_may_hold_figures_only(spark):
    fine = {"schema_version": 1, "kind": "synthetic-benchmark-summary", "provenance": {"code_hash": "a" * 64, "python": "3.13"}, "strategy": "bm25", "top_k": 5, "settings": {"chunk_chars": 1200, "timing_scope": "each case"}, "metrics": [{"category": None, "overall": True, "queries": 3, "recall_at_k": 0.5, "mrr_at_k": None}], "stages_ms": {"rank": {"p50": 1.5}}}
    odd = {"n": fine | {"queries": [{"query": "private words"}]}, "k": fine | {"kind": "run"}, "m": fine | {"metrics": [{"recall_at_k": "high"}]}, "s": fine | {"settings": {"chunk_chars": -1}}, "i": fine | {"top_k": float("inf")}, "h": fine | {"provenance": {"code_hash": "/home/someone"}}, "e": {}}
    rows = [(None, k, json.dumps(v)) for k, v in (odd | {"fine": fine}).items()] + [(None, "broken", "{"), (None, "list", "[1]"), ("c", "fine", json.dumps(fine))]
    found = {(r.file, r.fault) for r in audit.report_faults(spark.createDataFrame(rows, "commit string, file string, text string")).collect()}
    figures, part = "report holds something else than figures", "report has an unreviewed part"
    assert found == {("n", part), ("k", figures), ("m", figures), ("s", figures), ("i", figures), ("h", figures), ("e", part), ("broken", "report can't be read"), ("list", "report can't be read")}


def test_small_parts(spark, tmp_path):
    bad = {"a": "-1", "x": "1", "c": "true", "d": "NaN", "e": "[]", "f": '"1"', "g": None, "h": "1e999"}
    figures = spark.createDataFrame([("s", k, v) for k, v in bad.items()] + [("s", "b", "0.5"), ("s", "i", "3"), ("t", "b", "1")], "section string, key string, value string")
    allowed = spark.createDataFrame([("s", k) for k in "abcdefghi"], "section string, key string")
    assert {(r.section, r.key) for r in audit.figure_faults(figures, allowed).collect()} == {("s", k) for k in bad} | {("t", "b")}
    assert provenance.provenance()["python"] and provenance.peak_memory() > 1 << 20
    with pytest.raises(KeyError), Trace(tmp_path / "t.jsonl", "x", k=1) as trace:
        for _ in range(2):
            with trace.stage("part"):
                pass
        raise KeyError
    append_line(tmp_path / "t.jsonl", {"b": 2})
    line, other = map(json.loads, (tmp_path / "t.jsonl").read_text().splitlines())
    assert line["error_type"] == "KeyError" and list(line["stages_ms"]) == ["part"] and line["operation_ms"] >= line["stages_ms"]["part"] and other == {"b": 2}


def test_blocked_search_against_pairs(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(f"p{i:03}", f"c{i // 3}", f"d{i // 6}", ["k", "l", None][i % 3], [float(x) for x in r.integers(-2, 3, 4)], {"s": ["x", "y", None][i % 3]} if i % 4 else {}) for i in range(200)]
    points = spark.createDataFrame(rows, "point_id string, chunk_id string, doc_id string, kb_id string, vector array<double>, values map<string,string>")
    asked = [(f"q{j}", [float(x) for x in r.integers(1, 4, 4)], kb, f) for j, (kb, f) in enumerate([(None, None), (["k"], None), (["k", "l"], {"s": "x"}), (None, {"s": None}), (["none"], None), (None, {"s": "y"}), (None, {"s": "x", "t": None})])]
    queries = spark.createDataFrame(asked, "query_id string, vector array<double>, kb_ids array<string>, filters map<string,string>")
    monkeypatch.setattr(dense, "QUERIES", 3)
    for distance in ("cosine", "dot", "euclid"):
        pairs = dense.scored(points, queries, distance).where("score is not null and not isnan(score)").collect()
        sign = 1 if distance == "euclid" else -1
        for found, key in ((dense.nearest(points, queries, 5, distance), "point_id"), (dense.parents(points, queries, 5, distance), "chunk_id")):
            best = {}
            for p in pairs:
                own = best.setdefault(p.query_id, {})
                own[p[key]] = min(own.get(p[key], np.inf), sign * round(p.score, 9))
            want = {(q, k) for q, own in best.items() for k, _ in sorted(own.items(), key=lambda x: (x[1], x[0]))[:5]}
            assert {(x.query_id, x[key]) for x in found.collect()} == want
    counts = {x.query_id: x.candidates for x in dense.candidates(points, queries).collect()}
    every = {q: n for q, n in ((a[0], dense.scored(points, queries.where(queries["query_id"] == a[0])).count()) for a in asked) if n}
    assert counts == every
