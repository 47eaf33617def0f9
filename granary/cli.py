"""The command line: python -m granary.cli --config FILE COMMAND. Results are JSON on standard output."""

from __future__ import annotations

import argparse
import io
import json
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from granary import checks, publication, tools
from granary.api import Engine
from granary.functions.embeddings import Hashed, Http, Onnx, Provider, Spec
from granary.sources.config import Config, load_config
from granary.sources.files import read_report
from granary.sources.models import E5, download

STRATEGIES = ("bm25", "overlap", "dense")


def provider(config: Config) -> Provider:
    """The embedding model that the configuration's table names: kind local, api or hashed (default), and its settings."""
    own = dict(config.embedding)
    kind = own.pop("kind", "hashed")
    if kind == "local":
        return Onnx(**own)
    if kind == "api":
        import os

        url, key = own.pop("url"), os.environ.get(own.pop("key_variable", "EMBEDDING_API_KEY"), "")
        batch, encoding = own.pop("batch", 16), own.pop("encoding", None)
        if not key:
            raise ValueError("the service's key isn't in the environment")
        return Http(Spec(**{"provider": "api"} | own), url, key, batch, encoding=encoding)
    if kind == "hashed":
        return Hashed(**own)
    raise ValueError("embedding.kind is local, api or hashed")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="granary", description=__doc__)
    top.add_argument("--config", type=Path, default=Path("config.toml"))
    commands = top.add_subparsers(dest="command", required=True)
    add = commands.add_parser
    for name, said in (("index", "bring the index up to date"), ("list", "knowledge bases"), ("serve", "offer the tools over standard input and output"), ("setup-status", "what is configured and indexed"), ("install", "how a client starts the server, tried out"), ("embedding-check", "check the embedding model"), ("vector-build", "build vectors"), ("vector-status", "state of the vectors")):
        add(name, help=said)
    add("model-download", help="fetch the pinned model").add_argument("--folder", type=Path)
    add("vector-check", help="check vector storage").add_argument("--output", type=Path)
    for name in ("preview", "connect"):
        own = add(name, help="what connecting a folder would read" if name == "preview" else "connect a folder after its preview")
        own.add_argument("kb_id")
        own.add_argument("root")
        own.add_argument("--include", action="append")
        own.add_argument("--exclude", action="append")
        if name == "connect":
            own.add_argument("--preview-id", required=True)
            own.add_argument("--confirmed", action="store_true")
    own = add("search", help="excerpts for a query")
    own.add_argument("query")
    own.add_argument("--kb", action="append")
    own.add_argument("--filters", type=json.loads)
    _search_options(own)
    own = add("read", help="part of a document")
    own.add_argument("doc_id")
    own.add_argument("--source-hash")
    own.add_argument("--start-line", type=int, default=1)
    own.add_argument("--max-chars", type=int, default=4000)
    own = add("benchmark", help="score labelled cases")
    own.add_argument("--dataset", type=Path, required=True)
    own.add_argument("--output", type=Path, default=Path("runs"))
    own.add_argument("--repeats", type=int, default=5)
    own.add_argument("--warmup", type=int, default=1)
    _search_options(own)
    own = add("compare", help="compare two reports")
    own.add_argument("baseline", type=Path)
    own.add_argument("candidate", type=Path)
    own.add_argument("--output", type=Path)
    own = add("audit", help="check what a repository would publish")
    own.add_argument("--root", type=Path, default=Path())
    own.add_argument("--staged", action="store_true")
    own.add_argument("--history", action="store_true")
    return top


def _search_options(own: argparse.ArgumentParser) -> None:
    own.add_argument("--strategy", choices=STRATEGIES, default="bm25")
    own.add_argument("--top-k", type=int, default=5)
    own.add_argument("--max-chars", type=int, default=4000)


def _install(engine: Engine, args: argparse.Namespace) -> dict[str, Any]:
    """The server's registration, after its tools were listed and called in this process."""
    asked = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "get_setup_status"}}]
    out = io.BytesIO()
    tools.serve(tools.Tools(engine), io.BytesIO("\n".join(map(json.dumps, asked)).encode()), out)
    replies = [json.loads(x)["result"] for x in out.getvalue().splitlines()]
    if replies[2]["isError"]:
        raise ValueError(f"the server doesn't work: {replies[2]['content'][0]['text']}")
    return {"registration": tools.registration(args.config, sys.executable), "tools": [t["name"] for t in replies[1]["tools"]], "setup": json.loads(replies[2]["content"][0]["text"])}


def _serve(engine: Engine, _: argparse.Namespace) -> None:
    tools.serve(tools.Tools(engine), sys.stdin.buffer, sys.stdout.buffer)


COMMANDS: dict[str, Callable[[Engine, argparse.Namespace], Any]] = {
    "index": lambda e, a: e.build_vector() if e.config.embedding else e.index(),
    "list": lambda e, a: [r.asDict() for r in e.list_knowledge_bases().collect()],
    "serve": _serve,
    "setup-status": lambda e, a: e.status(),
    "install": _install,
    "model-download": lambda e, a: download(a.folder or e.config.storage / "models" / E5["model"].split("/")[1]),
    "embedding-check": lambda e, a: checks.run_embedding_check(e.spark, e.provider, e.config.storage / "embedding-checks"),
    "vector-build": lambda e, a: e.build_vector(),
    "vector-status": lambda e, a: e.vector_status(),
    "vector-check": lambda e, a: checks.run_vector_check(e.spark, a.output or e.config.storage / "vector-checks"),
    "preview": lambda e, a: tools.Tools(e).call("preview_knowledge_base", {"kb_id": a.kb_id, "root": a.root, "include": a.include, "exclude": a.exclude}),
    "connect": lambda e, a: tools.Tools(e).call("connect_knowledge_base", {"kb_id": a.kb_id, "root": a.root, "preview_id": a.preview_id, "confirmed": a.confirmed, "include": a.include, "exclude": a.exclude}),
    "search": lambda e, a: e.search(a.query, a.kb, a.top_k, a.max_chars, a.filters, a.strategy),
    "read": lambda e, a: e.read_document(a.doc_id, a.start_line, a.max_chars, a.source_hash),
    "benchmark": lambda e, a: {"report": e.run_benchmark(a.dataset, a.output, a.strategy, a.top_k, a.max_chars, a.repeats, a.warmup)["folder"] + "/report.json"},
    "compare": lambda e, a: e.compare(read_report(a.baseline), read_report(a.candidate), a.output),
    "audit": lambda e, a: [r.asDict() for r in publication.findings(e.spark, a.root, a.staged, a.history).collect()],
}
#: These take the configuration as it is written; the others take the one with connected sources, if there is one.
AS_WRITTEN = {"benchmark", "compare", "vector-check", "embedding-check", "model-download", "audit"}


def run(args: argparse.Namespace, spark: SparkSession) -> Any:
    config = load_config(args.config)
    config = config if args.command in AS_WRITTEN else config.active()
    return COMMANDS[args.command](Engine(spark, config, provider(config)), args)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code: 0, 1 if an audit or a check found something, 2 if the command failed."""
    args = parser().parse_args(argv)
    try:
        result = run(args, spark or SparkSession.builder.appName("granary").getOrCreate())
    except (ValueError, OSError, RuntimeError) as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 2
    if args.command != "serve":
        print(json.dumps(result, ensure_ascii=False, indent=1, default=str))
    return int(args.command == "audit" and bool(result))


if __name__ == "__main__":
    sys.exit(main())
