"""Secret scans with multipart credential linking."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import kernels
from granary.llm.common import text_batches

# Fixed patterns of the base kinds; a match that is too short is dropped after it has been consumed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: One of these, in either case, is in every text that ASSIGN matches.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "user", "key", "endpoint")

# Weak kinds: each alone is common in clean text.
USER = re.compile(r"""(?<![A-Za-z0-9_])(?:user(?:name|_?id)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""", re.IGNORECASE | re.ASCII)
USER_WORDS = ("user", "login", "account", "client", "access")
KEY = re.compile(r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])")
ENDPOINT = re.compile(r"""\b(?:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.])""", re.ASCII)

#: Where one scope ends and the next begins: blank lines, headings of sections, rules, fences, and between sibling objects.
EDGE = re.compile(r"\n[ \t\r]*\n|^[ \t]*(?:\[[^\]\n]*\]|\#{1,6}[ \t]|-{3,}|={3,}|`{3,}|~{3,})[^\n]*$|\}\s*,?\s*\{", re.M)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) in code points of the kinds assign, access and hex, leftmost and not overlapping within a kind."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _varied(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


class Scopes:
    """A text's consecutive scopes, each from one edge's beginning to the next one's."""

    def __init__(self, text: str):
        self.edges = [m.start() for m in EDGE.finditer(text)]

    def around(self, at: int) -> tuple[float, float]:
        k = bisect_right(self.edges, at)
        return self.edges[k - 1] if k else -1, self.edges[k] if k < len(self.edges) else float("inf")


class Near:
    """An interval join: whether an interval has one of the given ones within a reach, and within its own scope if there are scopes.

    The given ones are sorted by start, with the running maximum of ends for those that began before.
    """

    def __init__(self, spans: list[Span], reach: int, scopes: Scopes | None = None):
        self.reach, self.scopes = reach, scopes
        self.starts = [s[0] for s in spans]
        self.furthest = list(accumulate((s[1] for s in spans), max))

    def __call__(self, span: Span) -> bool:
        low, high = span[0] - self.reach, span[1] + self.reach
        if self.scopes:
            begin, end = self.scopes.around(span[0])
            low, high = max(low, begin + 1), min(high, end - 1)
        k = bisect_right(self.starts, high)
        return k > 0 and self.furthest[k - 1] >= low


def linked_spans(text: str, base: list[Span], reach: int = 200) -> list[Span]:
    """The weak spans whose complementary parts are within reach and in the same scope (see EDGE).

    Identifiers are access ids and user assignments; secrets are assignments, hex runs and bare keys of 40 characters that an
    identifier is near to. A bare key is reported near an identifier, a user assignment near a secret, an endpoint near a
    secret that is itself near an identifier: then all three parts are there. Weak spans within spans of base kinds aren't
    candidates.
    """
    low = text.lower()
    taken = Near(sorted(base), 0)
    free = lambda a, b: not taken((a + 1, b - 1, "")) if base else True
    users = [(m.start(), m.end(), "user") for m in USER.finditer(text) if free(m.start(), m.end())] if any(w in low for w in USER_WORDS) else []
    ids = sorted([s for s in base if s[2] == "access"] + users)
    if not ids:
        return []
    scopes = Scopes(text)
    near = Near(ids, reach, scopes)
    keys = [s for m in KEY.finditer(text) if _varied(m.group()) and near(s := (m.start(), m.end(), "key")) and free(m.start(), m.end())]
    secrets = sorted([s for s in base if s[2] != "access" and near(s)] + keys)
    if not secrets:
        return []
    near = Near(secrets, reach, scopes)
    ends = [s for m in ENDPOINT.finditer(text) if near(s := (m.start(), m.end(), "endpoint")) and free(m.start(), m.end())]
    return [s for s in users if near(s)] + keys + ends


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """docs (doc_id, text) with their secrets: doc_id, spans array<struct<kind,start,end,text>> and digests of the base kinds.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base kinds' spans), spans (all as text), found (all as an
    array with what they hold). Spans are in code points, ends exclusive. Base kinds are always reported; user, key and
    endpoint only when linked, see linked_spans. Spans that begin together come in the order of KINDS.

    Null and empty texts have no spans: the digest is that of no bytes. Texts are scanned whole, a task holding one batch of
    them. Null doc_id and repeated rows pass through; other columns are ignored, whatever their names. Rows map one to one, so
    nothing is gathered. Empty table: empty result.
    """
    text_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = base + linked_spans(text, base, reach)
                n = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(spans), [{"kind": k, "start": a, "end": b, "text": text[a:b]} for a, b, k in sorted(spans)]))
            columns = zip(*rows) if rows else [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [kind]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(kernels.lean(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,text:string>>")
