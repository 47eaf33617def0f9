"""The join against all pairs."""

import random
import re

import numpy as np

from granary.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall((text or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [[j for j in range(len(rows)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(len(rows))]
    found = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo = [j for k in [todo.pop()] for j in near[k] if j not in seen and not seen.add(j)] + todo
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        found.append((rows[i][0], len(sets[i]), len(near[i]), min(ids) if ids else None))
    return sorted(found, key=str)


def corpus():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    shared = " ".join(r.choice(words) for _ in range(30))
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([3, 6, 40, 90, 300]))]
        for _ in range(r.randint(1, 7)):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(own))
                own[k : k + r.randint(0, 1)] = [r.choice(words)]
            rows.append((n, " ".join(own) + (f" {shared}" if r.random() < 0.3 else ""), "x"))
            n += 1
    rows += [(n, None, "x"), (n + 1, "", "x"), (n + 2, " \t\n", "x"), (n + 3, "ONE two", "x"), (n + 4, "one TWO", "x"), (n + 5, "Éé one", "x"), (n + 6, "éé one", "x")]
    rows += [rows[0], rows[0], (None, rows[1][1], "x"), (None, "nobody else has this text at all", "x"), (None, None, None)]
    long = " ".join(r.choice(words) for _ in range(60))
    # classes without any doc_id, linked with each other and with one that has one
    rows += [(None, long + " a", "x"), (None, long + " b", "x"), (n + 50, long + " c", "x"), (None, long[::-1] + " a", "x"), (None, long[::-1] + " b", "x")]
    return rows


def test_brute_force(spark):
    rows = corpus()
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_parts_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 150)
    monkeypatch.setattr(jaccard, "HELD", 300)
    rows = corpus()
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_without_counts(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    want = sorted(((i, n, c) for i, n, _, c in brute(rows)), key=str)
    for part in (200_000, 150, 60):
        monkeypatch.setattr(jaccard, "PART", part)
        monkeypatch.setattr(jaccard, "HUBS", 2 if part == 60 else 8)
        assert sorted((tuple(r) for r in jaccard.jaccard_join(df, links=False).collect()), key=str) == want


def test_large_groups_take_linear_time():
    """Near copies of one text: the time for four times as many grows about as much, and all become one component."""
    import time

    import pyarrow as pa

    r = np.random.default_rng(4)
    base = np.arange(100)

    def took(m):
        sets = [np.unique(np.r_[np.delete(base, r.integers(0, 100, 5)), r.integers(1000, 10**9, 4)]) for _ in range(m)]
        table = pa.table({"name": np.arange(m), "n": [len(s) for s in sets], "shingles": pa.array(sets, pa.list_(pa.int64())), "probe": np.ones(m, bool)})
        began = time.perf_counter()
        got = jaccard._connected(table, 80, 100)
        assert len(set(got["root"].to_pylist())) == 1
        return time.perf_counter() - began

    took(500)
    assert took(20_000) < 8 * took(5_000) + 1


def test_empty_and_representatives(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_join(empty).count() == 0 and jaccard.representatives(empty).count() == 0
    rows = [(5, "a b c d e f g", 1), (3, "a b c d e f g", 2), (9, "x y z", 3), (9, "x y z", 3), (None, "q", 4), (7, None, 5)]
    kept = jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string, _id int"))
    assert kept.columns == ["doc_id", "text", "_id"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 9, None, 7], key=str)


def test_tree():
    r = np.random.default_rng(1)
    for _ in range(30):
        sets = [np.sort(r.choice(40, r.integers(1, 30), replace=False)) for _ in range(25)]
        sizes = np.array([len(s) + r.integers(0, 2) for s in sets])
        tree = jaccard.PrefixTree(sets, sizes, 60, 100)
        got = {frozenset((tree.order[i], tree.order[j])) for i, found in tree.links() for j in found}
        want = {frozenset((i, j)) for i in range(25) for j in range(i) if 160 * len(set(sets[i]) & set(sets[j])) >= 60 * (sizes[i] + sizes[j])}
        assert got == want
