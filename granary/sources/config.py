"""Settings of an engine: sources, storage, limits, the embedding model."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

KB_ID = re.compile(r"[a-z0-9_-]+")
# What a source includes and excludes unless told otherwise.
INCLUDE = ("*.md", "**/*.md")
EXCLUDE = (".*/**", "**/.*/**")


@dataclass(frozen=True)
class Source:
    """A knowledge base: files under root that match one of include and none of exclude."""

    id: str
    root: Path
    include: tuple[str, ...] = INCLUDE
    exclude: tuple[str, ...] = EXCLUDE

    def __post_init__(self):
        if not KB_ID.fullmatch(self.id):
            raise ValueError(f"invalid knowledge base id: {self.id!r}")


@dataclass(frozen=True)
class Config:
    storage: Path
    sources: tuple[Source, ...]
    chunk_chars: int = 1200
    max_file_bytes: int = 2_000_000
    embedding: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.sources or len({s.id for s in self.sources}) != len(self.sources):
            raise ValueError("sources must be given and their ids unique")
        if not 100 <= self.chunk_chars <= 20_000 or not 1 <= self.max_file_bytes <= 100_000_000:
            raise ValueError("chunk_chars must be 100..20000, max_file_bytes 1..100000000")

    @property
    def traces(self) -> Path:
        return self.storage / "traces.jsonl"

    @property
    def connected(self) -> Path:
        """Where the configuration with the sources that a user connected is kept."""
        return self.storage / "connected.toml"

    def active(self) -> Config:
        return load_config(self.connected) if self.connected.exists() else self


def _known(cls, values: dict, where: str) -> dict:
    if odd := set(values) - {f.name for f in fields(cls)}:
        raise ValueError(f"unknown settings in {where}: {', '.join(sorted(odd))}")
    return values


def load_config(path: str | Path) -> Config:
    """Reads a TOML file; paths are relative to its folder, a byte order mark may stand before it.

    Keys: storage, chunk_chars, max_file_bytes, tables embedding and sources (id, root, include, exclude). Unknown ones are
    errors.
    """
    path = Path(path)
    data = tomllib.loads(path.read_bytes().decode("utf-8-sig"))
    here = path.resolve().parent
    sources = []
    for raw in data.pop("sources", []):
        raw = _known(Source, raw, "sources")
        if "id" not in raw or "root" not in raw:
            raise ValueError("a source needs id and root")
        lists = {k: tuple(raw[k]) for k in ("include", "exclude") if k in raw}
        sources.append(Source(raw["id"], here / raw["root"], **lists))
    _known(Config, data, "the configuration")
    return Config(**data | {"storage": here / data.get("storage", ".state"), "sources": tuple(sources)})


def dump_config(config: Config) -> str:
    """The TOML that load_config reads back (with absolute paths)."""
    import json

    text = lambda x: json.dumps(str(x), ensure_ascii=False)
    rows = [f"storage = {text(config.storage)}", f"chunk_chars = {config.chunk_chars}", f"max_file_bytes = {config.max_file_bytes}"]
    if config.embedding:
        rows += ["", "[embedding]", *(f"{k} = {json.dumps(v)}" for k, v in config.embedding.items())]
    for s in config.sources:
        rows += ["", "[[sources]]", f"id = {text(s.id)}", f"root = {text(s.root)}", f"include = [{', '.join(map(text, s.include))}]", f"exclude = [{', '.join(map(text, s.exclude))}]"]
    return "\n".join(rows) + "\n"
