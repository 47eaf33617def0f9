"""Array kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa

from granary.llm import kernels

TEXTS = ["one two one", "", None, " \t", "é😀 one\nTwo\x0btwo", "x" * 5000 + " one", "one two three four five six", "ONE two", "nb\xa0sp one"]


def hashed(texts, **how):
    out = []
    for _, data, offsets in kernels.chunks(pa.array(texts)):
        starts, ends, first = kernels.words(data, offsets)
        h = kernels.hashes(data, starts, ends, **how)
        out += [list(zip([bytes(data[a:b]).decode() for a, b in zip(starts[x:y], ends[x:y])], h[x:y])) for x, y in zip(first[:-1], first[1:])]
    return out


def test_words_and_hashes(monkeypatch):
    whole = hashed(TEXTS)
    assert [[w for w, _ in t] for t in whole] == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    by_word = {}
    for w, h in (x for t in whole for x in t):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    monkeypatch.setattr(kernels, "CHUNK", 16)  # spans by spans, and texts in other company, hash alike
    assert hashed(TEXTS) == whole and hashed(TEXTS[::-1])[::-1] == whole
    lower = {w: h for t in hashed(TEXTS, lower=True) for w, h in t}
    assert lower["ONE"] == lower["one"] and lower["Two"] == lower["two"]


def test_large_strings_and_slices():
    a = pa.array(TEXTS, pa.large_string())
    sets = lambda x: [s.tolist() for _, d, o in kernels.chunks(x) for s in kernels.shingle_sets(d, o)]
    assert sets(a) == sets(pa.array(TEXTS)) == sets(pa.array(["pad", *TEXTS]).slice(1))
    assert [len(s) for s in sets(a)] == [1, 0, 0, 0, 1, 1, 2, 1, 1]
    assert sets(pa.array([], pa.string())) == []


def test_codepoints_and_sums():
    data = np.frombuffer("aé😀".encode(), np.uint8)
    assert kernels.codepoints(data).sum() == 3
    assert kernels.per_text(np.array([1, 2, 3]), np.array([0, 0, 2, 3])).tolist() == [0, 3, 3]


def test_windows_of_any_length():
    words = [f"w{i}" for i in range(200)]
    data = " ".join(words + words).encode()
    (few,) = kernels.shingle_sets(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 100)
    assert len(few) == 200
