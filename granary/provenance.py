"""What a measurement was taken with: code, revision, machine, packages, memory."""

from __future__ import annotations

import platform
import resource
import subprocess
import sys
from importlib.metadata import distributions
from pathlib import Path
from typing import Any

from granary.functions.embeddings import file_digest
from granary.functions.identity import canonical, digest

#: Differences of these make two runs' latencies no longer comparable.
MACHINE = ("python", "platform", "machine", "processor")


def code_hashes(root: Path) -> dict[str, str]:
    """Hashes of the package's files by relative path."""
    return {p.relative_to(root).as_posix(): file_digest(p) for p in sorted(root.rglob("*.py"))}


def revision(root: Path) -> tuple[str | None, bool | None]:
    """The commit, and whether anything differs from it; both None outside a repository."""
    try:
        ask = lambda *args: subprocess.run(["git", *args], cwd=root, text=True, capture_output=True, timeout=5, check=True).stdout.strip()
        return ask("rev-parse", "HEAD") or None, bool(ask("status", "--porcelain"))
    except (OSError, subprocess.SubprocessError):
        return None, None


def provenance() -> dict[str, Any]:
    root = Path(__file__).resolve().parent
    files, (commit, dirty) = code_hashes(root), revision(root)
    packages = {d.metadata["Name"]: d.version for d in distributions() if d.metadata["Name"]}
    return {
        "git_commit": commit, "git_dirty": dirty, "code_hash": digest(canonical(files)), "file_hashes": files, "dependencies": dict(sorted(packages.items())),
        **{k: getattr(platform, "python_version" if k == "python" else k)() for k in MACHINE},
    }


def peak_memory() -> int:
    """Bytes that this process has held at most."""
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    return peak if sys.platform == "darwin" else peak * 1024
