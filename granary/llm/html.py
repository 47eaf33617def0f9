"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree."""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import kernels
from granary.llm.common import text_batches

# Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no markup and never shown as the page's text; XMP shows it as it stands.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
XMP = frozenset(("xmp", "plaintext"))
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary"
    " svg table tbody td tfoot th thead tr ul video audio canvas math object xmp plaintext".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Start tags that end an open p, and elements that end an open one of their own kind.
ENDS_P = BLOCK - frozenset(("body", "html", "head", "button", "caption", "option", "optgroup", "legend", "tbody", "td", "tfoot", "th", "thead", "tr", "svg", "video", "audio", "canvas", "math", "object"))
SIBLING = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select", "optgroup")}
ALIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
CELLS = ("td", "th", "table")
BEYOND_CELLS = frozenset(("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"))

#: Words of a class, id, role or name that say what an element is for. A name is a word or words joined by hyphens, underscores
#: or capitals; each is matched as a whole.
ROLES = (
    ("menu", re.compile(r"nav\w*|(sub)?menus?|breadcrumb\w*|crumbs?|toc|pager|paginat\w*|paging|tabs?|tablist|skip")),
    ("edge", re.compile(r"header\w*|masthead|banner|footer\w*|copyright|colophon|bottom|topbar|bar")),
    ("side", re.compile(r"side|sidebar\w*|aside|complementary|related|recommend\w*|widgets?|teasers?|popular|trending|archives?|tags?|shar(e|ing)|social|follow|authors?|byline|meta")),
    ("ad", re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|dfp|taboola|outbrain|affiliate")),
    ("notice", re.compile(r"cookie\w*|consent|gdpr|notices?|alerts?|alertdialog|popup|modal|overlay|newsletter\w*|subscri\w*|sign|signup|paywall|toast|disclaimer|privacy")),
    ("talk", re.compile(r"comment(s|list|er|body|text|form)?|disqus\w*|repl(y|ies)|discussion|responses?|respond|reviews?|feedback|guestbook")),
    ("form", re.compile(r"\w*form|search\w*|login|signin|contact\w*|inputs?|fields?")),
    ("main", re.compile(r"article\w*|content|main|posts?|h?entry|story|body|text|page|prose")),
)
#: First and last words of a name that tells a state, a theme's layout or what a page is filed under, not what the element is for.
STATE = frozenset("has no not with without is are was js tag tagged category cat topic term format status type template theme layout single show hide hides can will logged postid".split())
STATED = frozenset("open opened closed enabled disabled on off active visible present left right fixed sticky loaded ready true false".split())
#: Last words of a name for something that holds other things, of which a word for content is the rest.
AROUND = frozenset("wrap wrapper container layout inner outer grid row col columns area".split())
#: Elements whose names are those of a theme or of the page's subject: their words aren't passed on to what is within.
THEMED = frozenset(("html", "body", "main", "article"))
A_COMMENT = re.compile(r"(?<![\w-])(comment|reply)(?!-?\w*(open|closed|enabled|disabled))", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>\0]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|name|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
SPACE = re.compile(r"\s+")


#: Tags that are features of the blocks within them.
STRUCTURE = ("article", "main", "section", "aside", "nav", "header", "footer", "form", "ul", "ol", "table", "dl", "figure", "blockquote", "pre", "select", "button", "label", "p", "li", "td", "a", "b", "dialog", "menu", "head", "title", "div", "span", "body")
SAYS = ("hidden", *(name for name, _ in ROLES))
PLAIN = frozenset(("html", "body", "div", "span", "b", "i", "em", "strong"))
NOTE = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie|subscribe|sign ?in|log ?in|newsletter|read more|share this|privacy policy|terms of|advertis|sponsored|powered by|comments?\b|repl(?:y|ies)\b", re.I)

FEATURES: dict[str, int] = {}
for _name in (
    *(f"in {t}" for t in STRUCTURE), *(f"is {t}" for t in (*STRUCTURE, "heading", "other")), *(f"under {t}" for t in (*STRUCTURE, "-")),
    *(f"said {r}" for r in SAYS), *(f"nearest {r}" for r in ("None", *SAYS)),
    *(f"words {k}" for k in range(7)), *(f"links {k}" for k in range(4)), "ends", "open", "note", "low",
):
    FEATURES.setdefault(_name, len(FEATURES))


@dataclass(slots=True)
class Element:
    """An element with what it and its ancestors say of the blocks within, summed on the way down: depth costs nothing."""

    tag: str
    block: bool
    inside: int  # bits of STRUCTURE
    said: int  # bits of SAYS
    nearest: str | None  # what the nearest element that says anything says first
    inner: str  # the nearest block element's tag
    outer: str  # the outermost tag that isn't PLAIN
    known: list[int] | None = None  # numbers of these features, once a block asked for them


ROOT = Element("", False, 0, 0, None, "-", "-")
_STRUCTURE_BIT = {t: 1 << k for k, t in enumerate(STRUCTURE)}
_SAYS_BIT = {r: 1 << k for k, r in enumerate(SAYS)}


@dataclass(slots=True)
class Block:
    text: str
    element: Element
    linked: int  # characters within links


@lru_cache(4096)
def _roles_of(name: str) -> tuple[str, ...]:
    """What one name says, in the order of ROLES."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or len(words) > 1 and (words[0] in STATE or words[-1] in STATED):
        return ()
    found = tuple(role for role, pattern in ROLES if any(pattern.fullmatch(w) for w in words))
    return ("main",) if words[-1] in AROUND and "main" in found else found


def _roles(said: str) -> list[str]:
    """What a value says: the roles of its names, each once. Names of over 60 letters are no words."""
    names = {name: None for name in said.split() if len(name) <= 60}
    every = {role for name in names for role in _roles_of(name)}
    return [role for role, _ in ROLES if role in every]


def _flags(attributes: str) -> list[str]:
    """What an element's attributes say, each once, in their order."""
    flags: list[str] = []
    if attributes and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("hidden", "aria-hidden"):
                if value.lower() != "false" and not (name == "aria-hidden" and value.lower() != "true"):
                    flags.append("hidden")
            elif name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    flags.append("hidden")
            else:
                flags += _roles(value)
    return flags


def _element(tag: str, attributes: str, parent: Element) -> Element:
    flags, block = _flags(attributes), tag in BLOCK
    said, nearest = parent.said, parent.nearest
    if tag in THEMED:  # an article among comments is one of them, whatever surrounds both
        talk = tag == "article" and "main" not in flags and A_COMMENT.search(attributes)
        flags = [flag for flag in flags if flag == "hidden" and tag == "article" or flag == "talk" and talk]
        if tag == "main":
            said, nearest = said & _SAYS_BIT["hidden"], None
    for flag in flags:
        said |= _SAYS_BIT[flag]
    outer = tag if parent.outer == "-" and tag not in PLAIN else parent.outer
    return Element(tag, block, parent.inside | _STRUCTURE_BIT.get(tag, 0), said, flags[0] if flags else nearest, tag if block else parent.inner, outer)


class _Open:
    """The open elements, and where those of a tag and the block elements lie among them."""

    def __init__(self):
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    @property
    def top(self) -> Element:
        return self.stack[-1] if self.stack else ROOT

    def last(self, *tags: str) -> int:
        """The place of the nearest open element of one of the tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, element: Element) -> None:
        if element.block:
            self.blocks.append(len(self.stack))
        self.places.setdefault(element.tag, []).append(len(self.stack))
        self.stack.append(element)

    def pop(self) -> Element:
        element = self.stack.pop()
        self.places[element.tag].pop()
        if element.block:
            self.blocks.pop()
        return element


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order: runs of text that no block element's tag or line break interrupts.

    Tags need not be closed or well nested: a start tag that can't be within an open p or item ends it, an end tag closes up to
    the nearest open element of its name if there is one within the same table cell. Scripts, styles, form fields, the title,
    fallbacks of frames, comments and declarations have no text; noscript and template are elements like others. Character
    references are decoded, white space becomes one space. Time and memory grow with the page's length, however deep it is.
    """
    out: list[Block] = []
    opened = _Open()
    held: list[str] = []
    where: Element | None = None
    linked = 0

    def flush() -> None:
        nonlocal where, linked
        if held:
            text = SPACE.sub(" ", "".join(held)).strip()
            if text:
                out.append(Block(text, where or ROOT, linked))
            held.clear()
        where, linked = None, 0

    def say(raw: str) -> None:
        nonlocal where, linked
        if "&" in raw:
            raw = entities.unescape(raw)
        if where is None and not raw.isspace():
            where = opened.top
        held.append(raw)
        if opened.places.get("a"):
            linked += len(raw)

    def close(k: int) -> None:
        if opened.blocks and opened.blocks[-1] >= k:
            flush()
        while len(opened.stack) > k:
            opened.pop()

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        m = TOKEN.match(page, start)
        if m is None:  # a lone <
            say(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            say(page[at:start])
        at = m.end()
        if m[3] is None:
            if m[1]:
                say(m[1])
            continue
        tag = m[3].lower()
        if m[2]:
            k = opened.last(tag)
            if tag == "br" or tag == "p" and k < 0:
                flush()
            elif k >= 0 and (tag in BEYOND_CELLS or k >= opened.last(*CELLS)):
                close(k)
            continue
        if tag in RAW or tag in XMP:
            if tag in XMP:
                flush()
            end = _end_tag(tag).search(page, at) if tag != "plaintext" else None
            if tag in XMP:
                opened.push(_element(tag, m[4], opened.top))
                where = opened.top
                held.append(page[at : end.start() if end else n])
                close(len(opened.stack) - 1)
            at = end.end() if end else n
            continue
        if tag == "br" or tag == "hr":
            flush()
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P and opened.blocks and opened.stack[opened.blocks[-1]].tag == "p":
            close(opened.blocks[-1])
        if tag in SIBLING and (k := opened.last(*ALIKE.get(tag, (tag,)))) > opened.last(*SIBLING[tag]):
            close(k)
        if tag in BLOCK:
            flush()
        if not m[4].rstrip().endswith("/") or tag not in ("svg", "path", "use", "math"):
            opened.push(_element(tag, m[4], opened.top))
    flush()
    return out


@cache
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|$)", re.I)


def _above(e: Element) -> list[int]:
    """Numbers of the features that a block has from its element and that one's ancestors."""
    if e.known is None:
        names = [f"in {t}" for t, bit in _STRUCTURE_BIT.items() if e.inside & bit]
        names.append(f"is {'heading' if e.inner in HEADINGS else e.inner if e.inner in STRUCTURE else 'other'}")
        names.append(f"under {e.outer if e.outer in STRUCTURE else '-'}")
        names += [f"said {r}" for r, bit in _SAYS_BIT.items() if e.said & bit]
        names.append(f"nearest {e.nearest}")
        e.known = [FEATURES[x] for x in names]
    return e.known


def features(block: Block) -> list[int]:
    """Numbers of a block's features: its ancestors' tags and what their attributes say, and its text's looks."""
    text, found = block.text, list(_above(block.element))
    words = text.count(" ") + 1
    found.append(FEATURES[f"words {min(6, words.bit_length())}"])
    found.append(FEATURES[f"links {min(3, int(4 * block.linked / len(text)))}"])
    found.append(FEATURES["ends" if text[-1] in ".!?…。:\"”" else "open"])
    if words < 60 and NOTE.search(text):
        found.append(FEATURES["note"])
    if text[0].islower():
        found.append(FEATURES["low"])
    return found


def vector(page_blocks: list[Block]) -> list[list[int]]:
    return [features(b) for b in page_blocks]


class Chain:
    """A linear-chain CRF with labels 0 (boilerplate) and 1 (main text)."""

    def __init__(self, state: np.ndarray, change: np.ndarray, first: np.ndarray):
        self.state, self.change, self.first = state, change, first

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.state[r].sum(0) for r in rows])

    def decode(self, rows: list[list[int]]) -> list[int]:
        """Viterbi: the likeliest labels; where two paths tie, the one of more boilerplate."""
        if not rows:
            return []
        s = self.scores(rows).tolist()
        (stay0, to1), (to0, stay1) = self.change.tolist()
        a, b = s[0][0] + self.first[0], s[0][1] + self.first[1]
        back = []
        for x, y in s[1:]:
            from0, from1 = a + stay0 >= b + to0, a + to1 >= b + stay1
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + stay0 if from0 else b + to0) + x, (a + to1 if from1 else b + stay1) + y
        path = [0 if a >= b else 1]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def gradient(self, rows: list[list[int]], labels: list[int]):
        """Expected minus observed counts of one page, and its negative log-likelihood, by forward-backward."""
        s = self.scores(rows)
        n = len(rows)
        forward, backward = np.empty((n, 2)), np.zeros((n, 2))
        forward[0] = s[0] + self.first
        for k in range(1, n):
            forward[k] = s[k] + np.logaddexp(forward[k - 1, 0] + self.change[0], forward[k - 1, 1] + self.change[1])
        for k in range(n - 2, -1, -1):
            ahead = s[k + 1] + backward[k + 1]
            backward[k] = np.logaddexp(self.change[:, 0] + ahead[0], self.change[:, 1] + ahead[1])
        total = np.logaddexp(*forward[-1])
        single = np.exp(forward + backward - total)
        first = single[0] - np.eye(2)[labels[0]]
        change = np.zeros((2, 2))
        for k in range(1, n):
            change += np.exp(forward[k - 1][:, None] + self.change + (s[k] + backward[k])[None] - total)
            change[labels[k - 1], labels[k]] -= 1
        own = sum(s[k, y] for k, y in enumerate(labels)) + self.first[labels[0]] + sum(self.change[a, b] for a, b in zip(labels, labels[1:]))
        return single - np.eye(2)[labels], change, first, total - own


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 12, rate: float = 0.3, penalty: float = 1e-3, seed: int = 5) -> Chain:
    """A chain from pages of blocks and their labels, by stochastic gradient with AdaGrad steps."""
    chain = Chain(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)), np.zeros(2))
    rows = [(vector(b), y) for b, y in pages if b]
    sums = [np.full(p.shape, 1e-2) for p in (chain.state, chain.change, chain.first)]
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(rows)
        for x, y in rows:
            node, change, first, _ = chain.gradient(x, y)
            state = np.zeros_like(chain.state)
            for features_, g in zip(x, node):
                state[features_] += g
            for p, g, total in zip((chain.state, chain.change, chain.first), (state, change, first), sums):
                g = g + penalty * p
                total += g * g
                p -= rate * g / np.sqrt(total)
    return chain


@cache
def default_chain(pages: int = 400, epochs: int = 10) -> Chain:
    """The chain trained on so many drawn pages with known labels."""
    from granary.llm.html_pages import labelled

    return train(labelled(pages), epochs)


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, chain.decode(vector(found))) if y)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each page (page_id, url, html): its main text.

    Whole pages are read, whatever their length; blocks are joined in page order by one space. Null or empty html, and pages
    without a main block: empty text, n_chars 0. Null page_id and url pass through; repeated rows are rows. Empty table:
    empty result. The chain (default: default_chain()) is a few KB and goes with the tasks.
    """
    text_batches(pages.sparkSession)
    chain = chain or default_chain()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", chain) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(kernels.lean(run), "page_id long, url string, text string, n_chars long")
