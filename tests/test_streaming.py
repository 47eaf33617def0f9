"""The streaming extension against a batch synchronisation."""

from granary.functions.identity import digest
from granary.sources.store import Store
from granary.streaming.sync import follow

SCHEMA = "id string, kb_id string, path string, source_hash string, content string"


def test_follow(spark, tmp_path):
    def arrive(name, *docs):
        rows = [(f"k:{p}", "k", p, digest(t), t) for p, t in docs]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    store = Store(spark, tmp_path / "store")
    run = lambda: follow(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), store, 1200, tmp_path / "cp").awaitTermination()
    arrive("1", ("a.md", "# A\nold\n"), ("b.md", "# B\nsame\n"))
    run()
    arrive("2", ("a.md", "# A\nnew\n"), ("c.md", "text\n"))
    run()
    active = store.active()
    assert {r.id: r.content for r in store.read(active, "documents").collect()} == {"k:a.md": "# A\nnew\n", "k:b.md": "# B\nsame\n", "k:c.md": "text\n"}
    assert {r.text for r in store.read(active, "chunks").collect()} == {"# A\nnew\n", "# B\nsame\n", "text\n"}
