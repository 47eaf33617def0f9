"""Text functions as Spark SQL expressions: tokens, lines, Markdown marks, globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokenizer's name in traces, its characters, what ends a line, and Markdown marks.
TOKENIZER_VERSION = "latin-word-cjk-bigram-v1"
CJK = "\\u3400-\\u9fff"
#: What splits lines: line feed, carriage return or both, vertical tab, form feed, separators 1C to 1E, 85, 2028 and 2029.
LINE = "[^\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]*(?:\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029])|[^\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]+"
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
FENCE = r"^\s{0,3}(`{3,}|~{3,})"


def tokens(text: Column) -> Column:
    """Search tokens: lower-cased runs of a-z, 0-9 and _, and overlapping pairs of CJK characters (a single one by itself)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9_]+|[{CJK}]+"), F.lit(0))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))
    paired = F.flatten(F.transform(runs, lambda w: F.when(w.rlike(f"^[{CJK}]") & (F.length(w) > 1), pairs(w)).otherwise(F.array(w))))
    return F.when(text.rlike(f"[{CJK}]"), paired).otherwise(runs)


def lines(text: Column) -> Column:
    """The text's lines with their ends."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading at the line's start, else 0."""
    return F.length(F.regexp_extract(F.rtrim(line), HEADING, 1))


def heading_label(line: Column) -> Column:
    return F.regexp_extract(F.rtrim(line), HEADING, 2)


def fence(line: Column) -> Column:
    """The fence mark that a line begins with, else the empty text."""
    return F.regexp_extract(line, FENCE, 1)


def read_slice(content: Column, start_line: int, max_chars: int) -> dict[str, Column]:
    """What reading a document from a line on gives: text, truncated, end_line; valid says whether there is such a line."""
    every = lines(content)
    rest = F.array_join(F.slice(every, start_line, F.greatest(F.size(every) - start_line + 1, F.lit(0))), "")
    shown = F.substring(rest, 1, max_chars)
    return {
        "text": shown,
        "truncated": F.length(rest) > max_chars,
        "end_line": (F.greatest(F.size(lines(shown)), F.lit(1)) + start_line - 1).cast("long"),
        "valid": F.lit(start_line) <= F.size(every) + 1,
    }


def glob_regex(pattern: str) -> str:
    """A whole-text pattern for a shell glob in which * also crosses /, with ? and [...] as usual and case told apart."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += c if c.isalnum() or c in "/_" else "\\" + c
        i += 1
    return f"(?s)^{out}$"


def globs(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a path matches one of include and none of exclude, and has no part that begins with a dot."""
    some = lambda patterns: F.array_contains(F.array(*[path.rlike(glob_regex(p)) for p in patterns]), True) if patterns else F.lit(False)
    return some(include) & ~some(exclude) & ~path.rlike(r"(^|/)\.")


def normal_path(path: Column) -> Column:
    """Slashes forward and single, case folded (ß as ss, ς as σ, ſ as s)."""
    low = F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/"))
    return F.replace(F.translate(low, "ςſ", "σs"), F.lit("ß"), F.lit("ss"))


def url_parts(url: Column) -> dict[str, Column]:
    """What decides whether a service's address may be used."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return {
        "scheme": F.try_parse_url(url, F.lit("PROTOCOL")),
        "host": host,
        "usable": F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & (F.length(host) > 0) & F.try_parse_url(url, F.lit("USERINFO")).isNull(), F.lit(False)),
    }
