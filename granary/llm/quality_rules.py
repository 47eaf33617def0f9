"""Quality rules: repetition counts and the divergence of a document's characters and words from its language's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import kernels
from granary.llm.common import text_batches, written

SYMBOLS = b"#*$%&|<>"
#: Places of the histogram of words, by hash; those of a language's commonest words are its common words.
SLOTS = 1 << 14
COMMON = 64
#: Languages of which a task holds sums at once (130 KB each) before it sends them off.
HELD = 200
CLASSES = ("space", "lower", "upper", "digit", "stop", "mark", "symbol", "control", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "sign", "kana", "han", "hangul", "other")
#: Classes of code points beyond ASCII, by the first byte of their UTF-8: blocks of scripts, as far as that byte tells them apart.
SCRIPTS = (("latin", 0xC2, 0xCC), ("greek", 0xCD, 0xCF), ("cyrillic", 0xD0, 0xD4), ("hebrew", 0xD6, 0xD7), ("arabic", 0xD8, 0xDB), ("indic", 0xE0, 0xE0), ("sign", 0xE2, 0xE2), ("kana", 0xE3, 0xE3), ("han", 0xE4, 0xE9), ("hangul", 0xEA, 0xED), ("sign", 0xF0, 0xF4))

_CLASS = np.full(256, CLASSES.index("control"), np.uint8)
_CLASS[list(b" \t\n\v\f\r")] = CLASSES.index("space")
_CLASS[list(range(97, 123))] = CLASSES.index("lower")
_CLASS[list(range(65, 91))] = CLASSES.index("upper")
_CLASS[list(b"0123456789")] = CLASSES.index("digit")
_CLASS[list(b".,;:!?'\"-()")] = CLASSES.index("stop")
_CLASS[list(b"+/=@[\\]^_`{}~")] = CLASSES.index("mark")
_CLASS[list(SYMBOLS)] = CLASSES.index("symbol")
_CLASS[0xC2:] = CLASSES.index("other")
for _name, _first, _last in SCRIPTS:
    _CLASS[_first : _last + 1] = CLASSES.index(_name)
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


class Measured:
    """The counts of a chunk's texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.texts = data, offsets, len(offsets) - 1
        self.starts, self.ends, self.first = kernels.words(data, offsets)
        self.n_words = np.diff(self.first)
        self.lead = kernels.codepoints(data)

    def base(self) -> dict[str, np.ndarray]:
        points = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(self.lead, out=points[1:])
        return {
            "n_words": self.n_words,
            "word_chars": kernels.per_text(points[self.ends] - points[self.starts], self.first),
            "n_symbols": kernels.per_text(_IS_SYMBOL[self.data], self.offsets),
            "n_dup_lines": self._dup_lines(),
            "n_repeat_words": self._repeat_words(),
        }

    def _dup_lines(self) -> np.ndarray:
        starts, ends = kernels.spans_where(self.data != 10, self.offsets)
        worded = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends = starts[worded], ends[worded]
        text = np.searchsorted(self.offsets, starts, "right") - 1
        first = self._repeated(text, kernels.hashes(self.data, starts, ends))[1]
        return np.bincount(text[~first], minlength=self.texts)

    @staticmethod
    def _repeated(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each value occurs again in its text, and whether it is its first occurrence."""
        if not len(value):
            return np.zeros(0, bool), np.zeros(0, bool)
        order = np.argsort(kernels.mixed(value + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
        t, v = text[order], value[order]
        fresh = np.r_[True, (v[1:] != v[:-1]) | (t[1:] != t[:-1])]
        run = np.cumsum(fresh) - 1
        several, first = np.empty(len(value), bool), np.empty(len(value), bool)
        several[order], first[order] = (np.bincount(run) > 1)[run], fresh
        return several, first

    def _repeat_words(self, n: int = 5) -> np.ndarray:
        """Words in windows of n words that are in the text twice or more."""
        word = kernels.hashes(self.data, self.starts, self.ends)
        text = np.repeat(np.arange(self.texts), self.n_words)
        place = np.arange(len(word)) - self.first[text]
        inside = np.flatnonzero(place <= self.n_words[text] - n)
        several = inside[self._repeated(text[inside], kernels.windows(word, n)[inside])[0]]
        change = np.zeros(len(word) + 1, np.int64)
        np.add.at(change, several, 1)
        np.add.at(change, several + n, -1)
        return np.bincount(text[np.cumsum(change)[:-1] > 0], minlength=self.texts)

    def characters(self) -> np.ndarray:
        """For each text, code points by class."""
        text = np.repeat(np.arange(self.texts), np.diff(self.offsets))
        kind = _CLASS[self.data]
        return np.bincount((text * len(CLASSES) + kind)[self.lead], minlength=self.texts * len(CLASSES)).reshape(self.texts, -1)

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word its text, and the slot of its letters in lower case without the punctuation behind it."""
        ends = self.ends
        for _ in range(4):
            trim = (ends - self.starts > 1) & (_CLASS[self.data[ends - 1]] == CLASSES.index("stop"))
            ends = ends - trim
        word = kernels.hashes(self.data, self.starts, ends, lower=True)
        return np.repeat(np.arange(self.texts), self.n_words), (word >> np.uint64(64 - 14)).astype(np.int64)


def references(docs: DataFrame) -> DataFrame:
    """(lang, kind, slot, n): each language's code points by class (kind 0) and words by slot (kind 1), over all documents.

    A task sums the documents of up to HELD languages before it sends anything, at most SLOTS rows for each. Null is a language.
    """

    def run(batches):
        sums: dict[str | None, list[np.ndarray]] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, data, offsets in kernels.chunks(batch.column(0)):
                seen = Measured(data, offsets)
                characters, (text, slot) = seen.characters(), seen.slots()
                own = langs[i : i + seen.texts]
                for lang in set(own):
                    chosen = np.array([x == lang for x in own])
                    if lang not in sums:
                        sums[lang] = [np.zeros(len(CLASSES), np.int64), np.zeros(SLOTS, np.int64)]
                    sums[lang][0] += characters[chosen].sum(0)
                    sums[lang][1] += np.bincount(slot[chosen[text]], minlength=SLOTS)
            if len(sums) > HELD:
                yield from send(sums)
                sums = {}
        yield from send(sums)

    def send(sums):
        for lang, both in sums.items():
            for kind, counts in enumerate(both):
                slot = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(np.full(len(slot), kind, np.int32)), pa.array(slot.astype(np.int32)), pa.array(counts[slot])], ["lang", "kind", "slot", "n"])

    return docs.select("text", "lang").mapInArrow(kernels.lean(run), "lang string, kind int, slot int, n long").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n"))


def models(sums: DataFrame) -> dict[str | None, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By language, however many: shares of the classes, its COMMON slots, and their shares of all words with the rest behind them.

    Of slots with equal counts the smaller is taken. What comes to the driver is COMMON + len(CLASSES) rows a language, about a KB.
    """
    by = Window.partitionBy("lang", "kind")
    top = sums.withColumn("total", F.sum("n").over(by)).withColumn("k", F.row_number().over(by.orderBy(F.desc("n"), "slot"))).where(F.col("k") <= COMMON)
    found: dict = {}
    for r in top.orderBy("lang", "kind", "k").collect():
        own = found.setdefault(r["lang"], (np.zeros(len(CLASSES)), [], []))
        if r["kind"] == 0:
            own[0][r["slot"]] = r["n"] / r["total"]
        else:
            own[1].append(r["slot"])
            own[2].append(r["n"] / r["total"])
    return {lang: (c, np.array(slots, np.int64), np.array([*shares, max(0.0, 1 - sum(shares))])) for lang, (c, slots, shares) in found.items()}


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) between the rows of p and q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0.0).sum(-1)
        return np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))


def apply_rules(docs: DataFrame, max_classes: float = 0.3, max_words: float = 0.5, min_chars: int = 100, min_words: int = 40) -> DataFrame:
    """Counts and verdict of each document (doc_id, text, lang).

    (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept).
    base_failed: n_words < 10, or 100 * n_repeat_words > 20 * n_words. Else the method's verdict: the Jensen-Shannon distance
    of the document's shares of character classes from its language's must be at most max_classes, that of its shares of
    common words at most max_words. References come from all documents. A distance is null, and forbids nothing, in texts of
    fewer than min_chars code points or min_words words, whose histograms are chance.

    Null text counts as empty: no words, base_failed. Null lang is a language of its own. Texts are counted whole, 256 KB of
    them or one at a time. Repeated rows and null doc_ids are rows like others, and count in the references as often as they
    occur; a distance that equals its limit is kept. Other columns are ignored, whatever their names. Empty table: empty
    result.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    known = models(written(references(docs), "references"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            for i, data, offsets in kernels.chunks(batch.column(1)):
                seen = Measured(data, offsets)
                base, langs = seen.base(), batch.column(2).slice(i, seen.texts).to_pylist()
                failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
                characters, (text, slot) = seen.characters(), seen.slots()
                by_class, by_word = np.full(seen.texts, np.nan), np.full(seen.texts, np.nan)
                for lang in set(langs):
                    if lang not in known:  # its texts have no characters
                        continue
                    own = np.array([x == lang for x in langs])
                    classes, slots, shares = known[lang]
                    by_class[own] = divergence(_shares(characters[own]), classes)
                    row, column = np.cumsum(own) - 1, np.full(SLOTS, len(slots))
                    column[slots] = np.arange(len(slots))
                    mine = own[text]
                    counts = np.bincount(row[text[mine]] * (len(slots) + 1) + column[slot[mine]], minlength=own.sum() * (len(slots) + 1)).reshape(own.sum(), -1)
                    by_word[own] = divergence(_shares(counts), shares)
                by_class[characters.sum(1) < min_chars] = np.nan
                by_word[base["n_words"] < min_words] = np.nan
                kept = ~failed & ~(by_class > max_classes) & ~(by_word > max_words)
                columns = [batch.column(0).slice(i, seen.texts), *(pa.array(base[n].astype(np.int64)) for n in names), pa.array(failed), pa.array(by_class, from_pandas=True), pa.array(by_word, from_pandas=True), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "class_distance", "word_distance", "kept"])

    return docs.mapInArrow(kernels.lean(run), f"doc_id long, {', '.join(f'{n} long' for n in names)}, base_failed boolean, class_distance double, word_distance double, kept boolean")


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)
