"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import kernels
from granary.llm.common import small, text_batches, written

#: Letters in an n-gram.
N = 4
#: Slots of the filter and hash functions; a slot holds a bit for each language, in words of 64.
SLOTS = 1 << 20
HASHES = 3
#: Documents of each language, as expected, that the filters are fitted on unless told otherwise.
FIT = 2000
#: Bytes of a text among which a letter is looked for at a time.
LOOK = 400
#: An n-gram belongs to a language's filter from this share of its n-grams on.
SHARE = 2e-5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Letters of ASCII, and all bytes of other characters; the rest is folded into a single edge between words.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True
_LETTER[0x80:] = True
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each n-gram its text and its number: N bytes in lower case, with an edge for what is no letter.

    Accented capitals of Latin-1 are folded by their second byte (À to Þ to à to þ). N-grams lie within a text, and those of
    edges alone are left out.
    """
    if len(data) < N:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    letter = _LETTER[data]
    byte = np.where(letter, _FOLD[data], 32).astype(np.uint64)
    high = np.r_[False, (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)]
    byte[high] += np.uint64(0x20)
    m = len(data) - N + 1
    gram, solid = np.zeros(m, np.uint64), np.zeros(m, np.int8)
    for j in range(N):
        gram |= byte[j : j + m] << np.uint64(8 * j)
        solid += letter[j : j + m]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    keep = (solid > N // 2) & (np.arange(m) + N <= offsets[1:][text])
    return text[keep], gram[keep]


def slots(gram: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield (kernels.mixed(gram * _MIX[k]) >> np.uint64(44)).astype(np.int64)


class Filters:
    """For each language a Bloom filter, sliced by bit: slot s holds as bits the languages whose filters have bit s.

    A slot takes as many 64-bit words as the languages need, 8 MB for every 64. They come most frequent first.
    """

    def __init__(self, grams: dict[str, np.ndarray]):
        self.languages = list(grams)
        self.tables = np.zeros((-(-len(self.languages) // 64), SLOTS), np.uint64)
        for k, lang in enumerate(self.languages):
            for s in slots(grams[lang]):
                self.tables[k // 64, s] |= np.uint64(1) << np.uint64(k % 64)
        full = [np.count_nonzero(self.tables[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / SLOTS for k in range(len(self.languages))]
        self.false = np.array(full, float) ** HASHES

    def masks(self, gram: np.ndarray, word: int = 0) -> np.ndarray:
        """Which of 64 languages contain each n-gram, as bits: one look-up for each hash function, whatever their number."""
        found = np.full(len(gram), ~np.uint64(0))
        for s in slots(gram):
            found &= self.tables[word, s]
        return found

    def decide(self, text: np.ndarray, gram: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text the index of its language (-1: no n-gram) and a score.

        A language's count c of n contained n-grams, of which a share f is expected to be false, stands for (c - f n) / (1 - f)
        true ones. N-grams that all languages contain tell nothing and count for none. The largest count decides, the more
        frequent language where several tie; the score is its share of all languages' counts.
        """
        words = [self.masks(gram, w) for w in range(len(self.tables))]
        everywhere = np.ones(len(gram), bool)
        for w, masks in enumerate(words):
            every = np.uint64((1 << min(64, len(self.languages) - 64 * w)) - 1)
            everywhere &= masks & every == every
        for masks in words:
            masks[everywhere] = 0
        n = np.bincount(text, minlength=texts)
        counts = np.empty((len(self.languages), texts))
        for k, false in enumerate(self.false):
            hit = (words[k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(bool)
            counts[k] = (np.bincount(text[hit], minlength=texts) - false * n) / (1 - false) if false < 1 else 0
        counts = np.maximum(counts, 0)
        total = counts.sum(0)
        best = counts.argmax(0)
        score = np.divide(counts[best, np.arange(texts)], total, out=np.full(texts, 1 / max(1, len(self.languages))), where=total > 0)
        return np.where(n > 0, best, -1), score


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, documents: int = FIT) -> Filters:
    """Filters of the languages in docs (doc_id, text, lang), however many, from so many documents of each or so.

    The documents are those of the lowest hashes of doc_id and text. n-grams are counted on the executors; what comes to the
    driver are those of a share of SHARE or more, at most 1 / SHARE for each language.
    """
    docs = docs.where("lang is not null and text is not null")
    counts = written(docs.groupBy("lang").agg(F.count("*").alias("_n")), "languages")
    langs = [r["lang"] for r in counts.orderBy(F.desc("_n"), "lang").collect()]
    if not langs:
        return Filters({})
    rank = F.xxhash64(F.lit("langid"), "doc_id", "text") / F.lit(2.0**64) + F.lit(0.5)
    chosen = docs.join(small(counts), "lang").where(rank * F.col("_n") < documents).select("text", "lang")

    def run(batches):
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            own = batch.column(1).to_pylist()
            for i, data, offsets in kernels.chunks(batch.column(0)):
                text, gram = ngrams(data, offsets)
                mine = np.array(own[i : i + len(offsets) - 1])
                for lang in set(mine):
                    sums.setdefault(lang, []).append(np.unique(gram[(mine == lang)[text]], return_counts=True))
        for lang, parts in sums.items():
            gram, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            count = np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(count)], ["lang", "gram", "n"])

    sums = written(chosen.mapInArrow(kernels.lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = sums.groupBy("lang").agg(F.sum("n").alias("total"))
    rows = sums.join(small(totals), "lang").where(F.col("n") >= F.lit(SHARE) * F.col("total")).select("lang", "gram").toArrow()
    coded = rows["lang"].combine_chunks().dictionary_encode()
    names, which, gram = coded.dictionary.to_pylist(), coded.indices.to_numpy(), rows["gram"].to_numpy().view(np.uint64)
    own = {lang: gram[which == k] for k, lang in enumerate(names)}
    return Filters({lang: own.get(lang, gram[:0]) for lang in langs})


def identify(docs: DataFrame, documents: int = FIT) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document (doc_id, text, lang).

    held_out: crc32 of doc_id as text, modulo 4, is 2; the filters are fitted on others of a non-null lang, so many of each
    language as expected. The prediction looks at the text alone, the whole of it.

    Null text, or text without letters: und, score 0. Text too short for an n-gram, and ties: the more frequent language among
    those fitted on, of equally frequent ones the first by name; the score is that of a draw. Null doc_id isn't held out. With
    no language learned all are und. Repeated rows are rows; other columns are ignored, whatever their names. Empty table:
    empty result.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    filters = fit(docs.where(~held_out()), documents)

    def run(batches):
        names = np.array([*filters.languages, "und"], object)
        for batch in batches:
            spaced = pa.compute.binary_join_element_wise("  ", batch.column(2).fill_null(""), "  ", "")
            for i, data, offsets in kernels.chunks(spaced):
                texts = len(offsets) - 1
                text, gram = ngrams(data, offsets)
                raw = data.tobytes()
                best, score = filters.decide(text, gram, texts) if filters.languages else (np.full(texts, -1), np.zeros(texts))
                lettered = kernels.per_text(_LETTER[data], offsets) > 0
                for k in np.flatnonzero(lettered):
                    lettered[k] = any(c.isalpha() for at in range(offsets[k], offsets[k + 1], LOOK) for c in raw[at : min(at + LOOK + 3, offsets[k + 1])].decode("utf-8", "ignore"))
                best = np.where(lettered & (best < 0) & bool(filters.languages), 0, np.where(lettered, best, -1))
                score = np.where(best < 0, 0.0, score)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, texts), batch.column(1).slice(i, texts), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(kernels.lean(run), "doc_id long, held_out boolean, lang_pred string, score double")
