"""Merkle manifest against a plain tree."""

import hashlib
import zlib

from pyspark.sql import functions as F

from granary.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(enc, (doc_id, source, lang, n_chars, text))))


def tree(leaves):
    """The root, and of each leaf its siblings as (left, right) for each level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, p in enumerate(paths):
            run = at[k] // 3 * 3
            p.append(("".join(level[run : at[k]]), "".join(level[at[k] + 1 : run + 3])))
        at = [a // 3 for a in at]
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def expected(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in sources}
    trees = {s: tree([leaf(*r) for r in own[s]]) for s in sources}
    root, above = tree([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above):
        for r, path in zip(own[s], trees[s][1]):
            bare = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            fold = leaf(r[0], r[1].replace("\n", "") if bare else r[1], *r[2:])
            for left, right in path + up:
                fold = sha(left + fold + right)
            out.append((r[0], leaf(*r), trees[s][0], root, sha("".join(a + b for a, b in path + up)), fold, fold == root))
    return out


def check(spark, rows):
    got = merkle.audited(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)
    return got


def test_odd_rows(spark):
    rows = [(i, f"line {i}\nnext", "en", f"s{i % 5}", i) for i in range(100)]
    rows += [(None, None, None, None, None), (None, "a", "en", None, 1), (7, "ä\n" * 3, None, "é", 6), (8, "", "de", "é", 0), (9, "x\ny" * 100_000, "en", "lone", 3)]
    rows += [rows[3], rows[3], (3, "other", "en", "s3", 1), (10**15, "𝄞\n", "", "", -5)]
    got = check(spark, rows)
    assert {r.verified for r in got} == {True, False}


def test_several_bands_and_one_row(spark):
    rows = [(i, f"t{i}\n", "en", "hot" if i % 7 else f"rare{i % 5}", 3) for i in range(3000)]
    check(spark, rows)
    check(spark, rows[:1])


def test_many_sources(spark):
    check(spark, [(i, "a\nb", "en", f"host{i}", 3) for i in range(800)])


def test_siblings_and_tables(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 2}", 2) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("x")).withColumn("tree", F.lit(1)).withColumn("_at", F.lit(1))
    made = merkle.manifest(merkle.tampered(docs))
    for r in merkle.proofs(made, siblings=True).collect():
        assert merkle.folded(r.leaf, r.proof) == r.root == made.root() and r.verified
    assert {r.size for r in made.subroots().collect()} == {10}


def test_empty(spark):
    made = merkle.manifest(merkle.tampered(spark.createDataFrame([], SCHEMA)))
    assert made.root() is None and merkle.proofs(made).count() == 0 and made.subroots().count() == 0
    assert merkle.audited(spark.createDataFrame([], "doc_id long")).count() == 0
