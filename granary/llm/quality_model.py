"""Quality classifier by co-training: one model reads a document's text, the other what is known of it without the text.

The two views are trained on labelled documents, hand each other the pool's documents that they are sure of, over rounds, are
calibrated on labelled documents kept aside, and their calibrated views together score all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import kernels
from granary.llm.common import column, small, text_batches, written

#: Labelled documents and others for the exchange, as expected, that the model is fitted on unless told otherwise.
LABELLED = 3000
POOL = 3000
ROUNDS = 3
#: Pseudo-labels that a view gives in a round, at most as a share of the pool, and how sure it must be.
GIVEN = 0.2
SURE = 0.95
#: Slots of hashed words, of a word's first and last bytes, of languages, of sources, and of lengths by half powers of two.
WORDS, EDGES, LANGS, SOURCES, LENGTHS = 512, 256, 16, 64, 48
TEXT = WORDS + 2 * EDGES + 11
META = LANGS + SOURCES + LENGTHS + 1

_KINDS = np.zeros((6, 256), bool)
_KINDS[0, 65:91] = _KINDS[1, 48:58] = _KINDS[2, 0xC2:] = True
_KINDS[3, list(b".,;:!?")] = _KINDS[4, list(b"#*$%&|<>@=+/\\^~_{}[]")] = _KINDS[5, list(kernels.SPACES)] = True


def _slot(names: list[str | None], slots: int, first: int) -> np.ndarray:
    raw = [b"\0" if x is None else x.encode() + b"\1" for x in names]
    ends = np.cumsum([len(x) for x in raw])
    return first + (kernels.hashes(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends[:-1]], ends) % np.uint64(slots)).astype(np.int64)


def views(data: np.ndarray, offsets: np.ndarray, lang: list[str | None], source: list[str | None], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text view, metadata view) of a chunk's texts, a row each. The second looks at lang, source and n_chars alone."""
    texts = len(offsets) - 1
    starts, ends, first = kernels.words(data, offsets)
    n_words = np.diff(first)
    row = np.repeat(np.arange(texts), n_words) * TEXT
    hashed = kernels.hashes(data, starts, ends, lower=True)
    word = (hashed % np.uint64(WORDS)).astype(np.int64)
    place = np.concatenate([row + word, row + WORDS + data[starts], row + WORDS + EDGES + data[ends - 1]])
    text = np.bincount(place, minlength=texts * TEXT).reshape(texts, TEXT) / np.maximum(n_words, 1)[:, None]
    # words that repeat the one before, and how many of the slots that so many different words would take are taken
    again = np.r_[False, (hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1])]
    size = np.diff(offsets)
    lines = kernels.per_text(data == 10, offsets) + 1
    looks = [kernels.per_text(again, first) / np.maximum(n_words, 1), (text[:, :WORDS] > 0).sum(1) / np.maximum(WORDS * (1 - np.exp(-n_words / WORDS)), 1)]
    looks += [np.log1p(lines), np.log1p(size / lines), kernels.per_text(ends - starts, first) / np.maximum(n_words, 1) / 10]
    looks += [kernels.per_text(kind[data], offsets) / np.maximum(size, 1) for kind in _KINDS]
    text[:, -len(looks) :] = np.stack(looks, 1)

    meta = np.zeros((texts, META))
    every = np.arange(texts)
    meta[every, _slot(lang, LANGS, 0)] = 1
    meta[every, _slot(source, SOURCES, LANGS)] = 1
    said = np.log2(1 + np.maximum(np.array([-1 if x is None else x for x in n_chars], float), 0))
    known = np.array([x is not None for x in n_chars], bool)
    meta[every[known], LANGS + SOURCES + np.minimum(2 * said[known], LENGTHS - 1).astype(int)] = 1
    meta[:, -1] = said
    return text, meta


@dataclass
class Logistic:
    """A linear model on features divided by their spread."""

    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x / self.scale, -8, 8) @ self.weights + self.bias

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> Logistic:
        """Accelerated gradient descent with the step that the features' largest singular value allows."""
        scale = x.std(0) + 1e-3
        z = np.c_[np.clip(x / scale, -8, 8), np.ones(len(x))].astype(np.float32)
        v = np.ones(z.shape[1], np.float32)
        for _ in range(20):
            v = z.T @ (z @ v)
            v /= np.linalg.norm(v) + 1e-12
        step = 1 / (float(np.linalg.norm(z @ v)) ** 2 / len(z) / 4 * 1.05 + penalty)
        w = previous = np.zeros(z.shape[1], np.float32)
        for k in range(steps):
            ahead = w + k / (k + 3) * (w - previous)
            gradient = z.T @ (sigmoid(z @ ahead) - y) / len(z) + penalty * np.r_[ahead[:-1], 0]
            previous, w = w, (ahead - step * gradient).astype(np.float32)
        return cls(scale, w[:-1].astype(float), float(w[-1]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    #: Of the two views' logits; its output is the calibrated probability of good quality.
    both: Logistic

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return sigmoid(self.both.logit(np.c_[self.text.logit(text), self.meta.logit(meta)]))


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], aside: np.ndarray) -> CoTrained:
    """Co-training on labelled views with labels y; the rows marked aside calibrate and are never trained on.

    In a round each view labels the pool and passes on those documents of which it is surest, as many of either class as the
    class's share among the labels allows, to the other view's training set of that round. Labels of the pool are made anew
    in every round, so early mistakes can be taken back.
    """
    x, own = [v[~aside] for v in labelled], y[~aside]
    models = [Logistic.fit(v, own) for v in x]
    share = own.mean()
    for _ in range(ROUNDS if len(pool[0]) else 0):
        p = [sigmoid(m.logit(v)) for m, v in zip(models, pool)]
        fresh = []
        for view in (0, 1):
            other = p[1 - view]
            chosen, said = [], []
            for label, sure, part in ((1, other, share), (0, 1 - other, 1 - share)):
                best = np.argsort(-sure, kind="stable")[: int(GIVEN * len(other) * part)]
                best = best[sure[best] >= SURE]
                chosen.append(best)
                said.append(np.full(len(best), label))
            chosen = np.concatenate(chosen)
            fresh.append(Logistic.fit(np.concatenate([x[view], pool[view][chosen]]), np.concatenate([own, *said])))
        models = fresh
    logits = np.stack([m.logit(v[aside]) for m, v in zip(models, labelled)], 1)
    return CoTrained(*models, Logistic.fit(logits, y[aside], penalty=1e-2))


def _featured(docs: DataFrame) -> DataFrame:
    """Views of sampled documents, packed as float32: (label, aside, text, meta)."""

    def run(batches):
        for batch in batches:
            for i, data, offsets in kernels.chunks(batch.column(0)):
                n = len(offsets) - 1
                lang, source, n_chars, label, aside = (batch.column(c).slice(i, n) for c in (1, 2, 3, 4, 5))
                both = views(data, offsets, lang.to_pylist(), source.to_pylist(), n_chars.to_pylist())
                packed = [pa.array([r.tobytes() for r in v.astype(np.float32)], pa.binary()) for v in both]
                yield pa.RecordBatch.from_arrays([label, aside, *packed], ["label", "aside", "text", "meta"])

    return docs.mapInArrow(kernels.lean(run), "label int, aside boolean, text binary, meta binary")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), column(docs, "lang", "string"), column(docs, "source", "string"), column(docs, "n_chars", "long"))


def sampled(labels: DataFrame, target: str = "quality", documents: int = LABELLED) -> DataFrame:
    """(doc_id, label, chosen) of labels (doc_id, target): one row a doc_id, its least label; chosen are about so many of them."""
    labels = labels.select(F.col("doc_id").cast("long"), F.col(target).cast("int").alias("label")).where("doc_id is not null and label is not null")
    labels = written(labels.groupBy("doc_id").agg(F.min("label").alias("label")), "labels")
    return labels.withColumn("chosen", _draw("label", "doc_id") * F.lit(max(1, labels.count())) < documents)


def _draw(seed: str, *of: str) -> Column:
    """A number from 0 to 1 by a hash of the columns."""
    return F.xxhash64(F.lit(seed), *of) / F.lit(2.0**64) + F.lit(0.5)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", labelled: int = LABELLED, pool: int = POOL) -> CoTrained | None:
    """A model from labels (doc_id, target of 0 or 1) and documents; None if the labelled documents lack either class.

    About labelled of the labelled doc_ids are drawn by a hash, one row of each (that whose text has the least hash), a quarter
    of them set aside for calibration; for the pool about so many of all other rows, by a hash of doc_id and text, equal rows
    once. The sample's views, 8 KB a document, are all that comes to the driver. Null labels and ids are ignored; where a
    doc_id has several labels, the least counts.
    """
    docs = _slim(docs)
    chosen = sampled(labels, target, labelled).where("chosen").select(F.col("doc_id").alias("_id"), "label")
    n_docs = docs.count()
    sample = docs.join(small(chosen, 4 * labelled), F.col("doc_id") == F.col("_id"), "left")
    sample = sample.where(F.col("label").isNotNull() | (_draw("pool", "doc_id", "text") * F.lit(max(1, n_docs)) < pool))
    sample = sample.withColumn("aside", F.col("label").isNotNull() & (_draw("aside", "doc_id") < 0.25))
    key = F.when(F.col("label").isNotNull(), F.xxhash64(F.lit(1), "doc_id")).otherwise(F.xxhash64(F.lit(0), "doc_id", "text"))
    one = F.min_by(F.struct("text", "lang", "source", "n_chars", "label", "aside"), F.struct(F.xxhash64("text"), F.xxhash64("lang", "source", "n_chars")))
    sample = sample.groupBy(key.alias("key")).agg(one.alias("one")).select("one.*")
    rows = written(_featured(sample), "views").toArrow()
    label = rows["label"].to_numpy(zero_copy_only=False).astype(float)
    aside = rows["aside"].to_numpy(zero_copy_only=False).astype(bool)
    both = [np.frombuffer(b"".join(rows[c].to_pylist()), np.float32).reshape(-1, width) for c, width in (("text", TEXT), ("meta", META))]
    known = ~np.isnan(label)
    # rows come in any order: one order, so that runs agree
    order = np.lexsort((both[0] @ np.arange(1, TEXT + 1, dtype=np.float64), both[1] @ np.arange(1, META + 1, dtype=np.float64), np.nan_to_num(label, nan=-1)))
    both, label, aside, known = [v[order] for v in both], label[order], aside[order], known[order]
    y, aside = label[known], aside[known]
    if any(len(set(part)) < 2 for part in (y[aside], y[~aside])):
        return None
    return co_train((both[0][known], both[1][known]), y, (both[0][~known], both[1][~known]), aside)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """(doc_id, score, kept) of each document (doc_id, text; lang, source and n_chars if there are such columns).

    score is the calibrated probability of good quality by both views, kept whether it is threshold or more (a tie stays).
    The model is fitted on about labelled of the labelled documents and pool others (see fit); every document is scored, by its
    whole text.

    Null or empty texts have no words and are judged by their metadata and their emptiness. Null lang, source and n_chars are
    values of their own. Without labels of both classes nothing can be judged: score null, kept true. Repeated rows are judged
    alike. Other columns are ignored, whatever their names. Empty table: empty result.
    """
    text_batches(docs.sparkSession)
    docs = _slim(docs)
    model = fit(docs, labels, labelled=labelled, pool=pool)
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("kept"))

    def run(batches):
        for batch in batches:
            for i, score in _scores(model, batch):
                n = len(score)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(score), pa.array(score >= threshold)], ["doc_id", "score", "kept"])

    return docs.mapInArrow(kernels.lean(run), "doc_id long, score double, kept boolean")


def _scores(model: CoTrained, batch: pa.RecordBatch):
    """(index of the first, scores) of the batch's documents by chunks."""
    for i, data, offsets in kernels.chunks(batch.column("text")):
        n = len(offsets) - 1
        lang, source, n_chars = (batch.column(c).slice(i, n).to_pylist() if c in batch.schema.names else [None] * n for c in ("lang", "source", "n_chars"))
        yield i, np.round(model.score(*views(data, offsets, lang, source, n_chars)), 6)


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source, n_chars and others) that classify keeps; no join, as rows pass whole."""
    text_batches(docs.sparkSession)
    model = fit(docs, labels, labelled=labelled, pool=pool)
    if model is None:
        return docs

    def run(batches):
        for batch in batches:
            for i, score in _scores(model, batch):
                yield batch.slice(i, len(score)).filter(pa.array(score >= threshold))

    return docs.mapInArrow(kernels.lean(run), docs.schema)
