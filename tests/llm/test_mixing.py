"""Mixing against a plain loop."""

import hashlib
import re

from pyspark.sql import functions as F

from granary.llm import mixing

ROWS = [(i, " ".join(["w"] * (i % 37 + 1)), f"s{i % 3}" if i % 11 else None, i) for i in range(400)] + [(400, None, "s0", 0), (401, "", "s1", 0), (402, "x " * 3000, "s2", 0), (7, "w " * 8, "s1", 7)]
SCHEMA = "doc_id long, text string, source string, size long"


def expected(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = {}
    for _, t, s, _ in rows:
        totals[s] = totals.get(s, 0) + size(t)
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(totals.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * totals[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * totals[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    return totals, target


def test_targets_and_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = mixing.mix(df).collect()
    totals, target = expected(ROWS)
    assert len(got) == len(ROWS)
    taken = dict.fromkeys(totals, 0)
    for r in got:
        assert r.source_size == totals[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.repeats <= 2
        taken[r.source] += r.repeats * r.size
    for s in totals:
        assert abs(taken[s] - target[s]) <= max(size for (_, _, src, _) in ROWS for size in [3000 if src == "s2" else 37]) / 2 + 1
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.source or "", r.size, r.repeats)
    assert sorted(map(key, again)) == sorted(map(key, got))
    clashing = df.withColumn("whole", F.lit(9)).withColumn("_key", F.lit("k")).withColumn("target", F.lit("t"))
    assert mixing.repeated(clashing).columns == clashing.columns and {r.target for r in mixing.repeated(clashing).collect()} == {"t"}
    out = mixing.repeated(df)
    assert out.columns == df.columns and out.count() == sum(r.repeats for r in got)


def test_order_is_that_of_the_hash(spark):
    rows = [(i, "a b c d", "one", 0) for i in range(50)] + [(100, "a " * 100, "two", 0)]
    got = {r.doc_id: r.repeats for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect() if r.source == "one"}
    text = hashlib.md5(b"a b c d").hexdigest()
    order = sorted(got, key=lambda i: hashlib.md5(f"mix:{i}:{text}".encode()).hexdigest())
    assert [got[i] for i in order] == sorted(got.values(), reverse=True)


def taken_by_sql(rows):
    """The query's SQL over rows."""
    import duckdb
    import pandas as pd

    from granary.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["doc_id", "text", "source", "size"]))
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM given")
    return sorted(con.execute(ORACLE_SQL["op10_mixing"]).fetchall(), key=str)


def test_equal_and_missing_ids(spark):
    """Targets are met where all rows of a source share one doc_id or have none, with unlike texts or the same one."""
    kinds = [(None, "many"), (7, "many"), (None, "same"), (9, "same")]
    rows = [(i, f"w{k if kind == 'many' else 0} " * (k % 9 + 10 if kind == "many" else 14), f"s{n}", 0) for n, (i, kind) in enumerate(kinds) for k in range(200)]
    rows += [(10_000 + k, "big " * 30, "large", 0) for k in range(900)] + [(k % 3, "t " * 5, None, 0) for k in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df.repartition(5)).collect()
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.repeats * r.size
    target = {r.source: r.target for r in got}
    assert any(t % w for t, w in zip(target.values(), taken.values())) and all(abs(taken[s] - target[s]) <= 15 for s in target)
    want = [(r[0], r[1], r[2], float(r[3]), r[4]) for r in taken_by_sql([(i if i is not None else None, t, s, z) for i, t, s, z in rows])]
    assert sorted(((r.doc_id, r.size, r.source_size, r.target, r.repeats * r.size) for r in got), key=str) == sorted(want, key=str)
    again = mixing.mix(df).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.repeated(df).count() == sum(r.repeats for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).count() == 0 and mixing.repeated(df).count() == 0
    none = spark.createDataFrame([(None, None, None, None)], SCHEMA)
    assert mixing.mix(none).select("size", "repeats", "target").first() == (0, 1, 0.0)


def test_all_clamped(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 10)], "source string, source_size long")
    assert {r.target for r in mixing.water_filling(sizes, share=9.0).collect()} == {20.0}
    assert mixing.water_filling(sizes.where("false")).count() == 0
    assert mixing.water_filling(sizes).agg(F.sum("target")).first()[0] == 30.0
