"""The pipeline on a small table: each stage against what it must do."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(7)
    good = [" ".join(f"w{r.randrange(997)}" for _ in range(60)) + "." for _ in range(120)]
    leak = " ".join(f"bench{j}" for j in range(30))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)]
    rows += [(500, good[0], "en", "s1", 1), (501, good[1] + " end", "en", "s1", 1), (502, good[2] + " " + leak, "en", "s2", 1)]
    junk = [(600 + i, "WIN!! BUY|| $$$ " * (8 + i % 20), "en", "s0", 9) for i in range(60)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120, 2)] + [(600 + i, 0) for i in range(0, 60, 2)], "doc_id long, quality int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([(1, leak)], "item_id long, text string"))):
        df.coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    sf, now, kept = str(tmp_path), docs, []
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.written(stage(spark, now, sf), "t")
        kept.append([r.doc_id for r in now.select("doc_id").collect()])
    assert set(kept[0]) == {row[0] for row in rows}
    assert set(kept[1]) == set(kept[0]) - {500, 501} and len(kept[1]) == len(set(kept[1]))
    assert set(kept[2]) == set(kept[1]) - {502}
    assert set(kept[3]) <= set(kept[2]) and max(map(kept[3].count, kept[3])) <= 2 and sorted(kept[4]) == sorted(kept[3])
    last = now.orderBy("start").collect()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(last, last[1:]))
    assert corpus_pipeline.run(spark, sf).count() == len(last)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls, repeated rows, rows without id and further columns pass all stages; empty tables give empty results."""
    r = random.Random(8)
    text = lambda: " ".join(f"w{r.randrange(997)}" for _ in range(60))
    leak = " ".join(f"bench{j}" for j in range(30))
    rows = [(i, text(), "en", f"s{i % 2}", 300, "x") for i in range(40)]
    rows += [rows[3], (None, text(), None, None, None, None), (None, leak, "en", "s1", 9, "x"), (900, None, "en", None, None, "x"), (901, "", None, "s0", 0, None), (902, "word " * 50_000, "en", "s0", 250_000, "x")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, size string"
    docs = spark.createDataFrame(rows, kinds)
    for part, table in (("some", docs), ("none", docs.where("false"))):
        sf = f"{tmp_path}/{part}"
        table.coalesce(1).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int").coalesce(1).write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, leak), (None, None)], "item_id long, text string").coalesce(1).write.parquet(f"{sf}/benchmark.parquet")
        now = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = corpus_pipeline.written(stage(spark, now, sf), "t")
            if k < 4:
                assert now.columns == docs.columns
            if k == 2 and part == "some":
                kept = sorted((x.doc_id for x in now.collect()), key=str)
                assert kept == sorted([*range(40), None, 900, 901, 902], key=str)
        assert (now.count() > 0) == (part == "some")
