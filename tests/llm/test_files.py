"""WARC, token shards and page text: exact round trips and held-out accuracy."""

import base64
import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from granary.llm import html, tokens, warc
from granary.llm.html_pages import labelled
from granary.llm.queries import tokenizer_path

PAGES = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c/\r\nX: y", "é" * 100_000), (None, "u", "<p>x</p>"), (5, "u", None), (6, "u", ""), (5, "u", None), (9, "u", "a\r\n\r\nWARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, compress):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    folder = warc.write_warc(df, compress=compress)
    got = sorted(warc.archived(spark, folder).collect(), key=str)
    want = []
    for i, _, h in PAGES:
        same = [p for p, _, o in PAGES if (o or "") == (h or "") and p is not None]
        raw = (h or "").encode()
        top = max(same) if same else None
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=lambda x: str(tuple(x))) or sorted(map(tuple, got), key=str) == sorted(want, key=str)
    read = warc.read_warc(spark, folder)
    assert read.where("record_type = 'revisit'").count() == sum(w[3] == "revisit" for w in want)
    assert {r.payload for r in read.where("page_id in (3, 9)").collect()} == {("é" * 100_000).encode(), PAGES[-1][2].encode()}
    # filters are answered by the source, and a schema without payload leaves it undecoded
    reader = warc.WarcReader(warc.WarcSource({"path": folder}).reader(spark.createDataFrame([], warc.SCHEMA).schema).schema, {"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert [type(f).__name__ for f in reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("page_id",), 1)])] == ["GreaterThan"]
    rows = [r for p in reader.partitions() for r in reader.records(p.uri)]
    assert len(rows) == sum(w[3] == "revisit" for w in want)
    assert warc.read_warc(spark, folder, ["page_id", "target_uri"]).where("page_id = 3").first().target_uri == "http://c/ X: y"


def test_skipped_members_are_not_inflated(spark, monkeypatch):
    rows = [(i, "u", f"{i} " + "x" * 300_000) for i in range(8)]
    folder = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    fs, root = tokens.filesystem(folder)
    name = [x.path for x in fs.get_file_info(pa.fs.FileSelector(root)) if x.base_name.endswith(".gz")][0]
    with fs.open_input_file(name) as raw:
        file = warc.Inflated(raw)
        archive = warc.Plain(file, warc.HEAD)
        seen = 0
        while (head := archive.head()) is not None:
            length = int(warc.parse(head)["content-length"])
            if seen == 5:
                assert archive.read(length) == rows[int(warc.parse(head)["x-page-id"])][2].encode()
            else:
                archive.skip(length + 4)
            seen += 1
    assert seen == 8 and file.inflated < 300_000 + 9 * 2 * warc.HEAD
    with fs.open_input_stream(name, compression="gzip") as whole:  # ordinary gzip to others
        assert whole.read().count(b"WARC/1.1") == 8
    # members that don't say their length, and a whole archive in one
    plain = [warc.record({"WARC-Type": "response", "X-Page-ID": str(i)}, b"y" * 5000) for i in range(4)]
    for raw in (b"".join(zlib.compress(x, wbits=31) for x in plain), zlib.compress(b"".join(plain), wbits=31)):
        archive, ids = warc.Plain(warc.Inflated(io.BytesIO(raw)), warc.HEAD), []
        while (head := archive.head()) is not None:
            ids.append(int(warc.parse(head)["x-page-id"]))
            archive.skip(5004)
        assert ids == [0, 1, 2, 3]


def test_warc_of_many_groups(spark, monkeypatch):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    want = sorted(map(str, warc.archived(spark, warc.write_warc(df)).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(str, warc.archived(spark, warc.write_warc(df)).collect())) == want


def test_warc_threshold_empty_and_damage(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = warc.write_warc(df, threshold=9)
    assert warc.archived(spark, folder).where("record_type = 'revisit'").count() == 0
    assert warc.archived(spark, warc.write_warc(df.where("false"))).count() == 0
    (tmp_path / "x.warc").write_bytes(warc.record({"WARC-Type": "response", "WARC-Payload-Digest": "sha1:" + "A" * 32}, b"other"))
    with pytest.raises(Exception, match="damaged"):
        warc.read_warc(spark, f"file://{tmp_path}/x.warc").collect()


TEXTS = ["", " ", "a  b", "a \n b\n\nc", "\n", "x\t y", "it's  'll 's\n's", "a\x1c b", "<|endoftext|> a", "1 2 3\n4 \n", "\0 b", " b c", "²., ½?! 5). Ⅷ. é, é!! word.word. (a.) --", "中文 text, mixed。中文", "a  b ", "word " * 5000]


def test_encoder():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    for together in (TEXTS, TEXTS[::-1]):
        got = list(tokens.Encoder(tokenizer_path(), 2).encode(pa.array(together)))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in together]


def test_added_tokens():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    texts = [*TEXTS, "hello <|endoftext|> world", "a<|endoftext|>", "<|endoftext|><|endoftext|>\n b", "<|endoftext| >"]
    got = list(tokens.encoder(tokenizer_path(), 2).encode(pa.array([*texts, None])))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts] + [[2]]


def test_shards(spark):
    rows = [(i * 7 % 31, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(3)
    folder = tokens.write_tokens(df, tokenizer_path(), 2)
    got = tokens.offsets(tokens.read_tokens(spark, folder)).orderBy("shard", "place").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert {r.doc_id for r in tokens.read_tokens(spark, folder, wanted=[3, 7, 999]).collect()} == {3, 7}
    assert tokens.offsets(tokens.read_tokens(spark, tokens.write_tokens(df.where("false"), tokenizer_path(), 2))).count() == 0


def test_many_rows_of_one_id_fill_many_shards(spark):
    rows = [(None, f"text {i} " * 9) for i in range(300)] + [(5, f"other {i} " * 9) for i in range(100)] + [(i, "x") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = tokens.write_tokens(df, tokenizer_path(), 2, shard_bytes=2000)
    read = tokens.offsets(tokens.read_tokens(spark, folder)).orderBy("start").collect()
    assert [r.doc_id for r in read] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    sizes = [r.n for r in tokens.read_tokens(spark, folder, ids=False).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < 120
    assert tokens.read_tokens(spark, folder, wanted=[5]).count() == 101


def test_shard_checks():
    import xxhash
    import zstandard

    content = np.arange(9, dtype="<u4").tobytes()
    out = io.BytesIO()
    tokens.write_shard(out, [(k, 9, xxhash.xxh64_intdigest(content) & 0xFFFFFFFF, zstandard.compress(content)) for k in (1, 2, 2)])
    raw = out.getvalue()
    reader = tokens.ShardReader(io.BytesIO(raw), len(raw))
    assert reader.find([2, 5]) == [1, 2] and reader.ids_of(1) == content
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == content * 3
    bad = bytearray(raw)
    bad[int(reader.starts[1]) + 12] ^= 1
    with pytest.raises(Exception):
        tokens.ShardReader(io.BytesIO(bytes(bad)), len(bad)).ids_of(1)
    with pytest.raises(ValueError, match="not a shard"):
        tokens.ShardReader(io.BytesIO(raw[:-1]), len(raw) - 1)


def test_main_text(spark):
    chain = html.default_chain()
    right = total = 0
    for found, labels in labelled(120, seed=99):
        got = chain.decode(html.vector(found))
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.98
    page = "<html><head><title>T</title><script>var x='</p>'</script></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>A&amp;B  title</h1><p><b>First\n  line.<br>Second &lt;x&gt; line.</p><p>Third<div class='comments'><p>Nice!</p></div></article><aside><p>Related</p></aside><footer>&copy; all</footer>"
    rows = [(1, "u", page), (None, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b"), (5, "u", "plain words & no tags at all"), (1, "u", page)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert [r.text for r in got if r.page_id == 1] == ["A&B title First line. Second <x> line. Third"] * 2
    assert [(r.text, r.n_chars) for r in got if r.page_id in (None, 3)] == [("", 0)] * 2
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == 6


BODY = "<h1>The headline</h1><p>First paragraph of the article, long enough to be read.</p><p>Second paragraph with more of it.</p>"
JUNK = ("<nav class='main-nav'><ul><li><a href='/'>Home</a><li><a href='/b'>Blog</a></ul></nav>", "<aside class='sidebar'><h3>Related</h3><ul><li><a href='/r'>Another one</a></ul></aside><footer>&copy; 2024 Someone</footer>")


@pytest.mark.parametrize(
    "shell",
    [
        "<body><main><article class='post comments-open'>{}</article></main>",
        "<body><main><article class='post-12 has-post-thumbnail category-news tag-budget'>{}</article></main>",
        "<body class='has-sidebar page'><main>{}</main>",
        "<body class='single single-post postid-7 logged-in no-sidebar'><div id='page' class='site'><div id='content' class='site-content'><article id='post-7' class='post-7 post type-post status-publish format-standard hentry category-food tag-soup'>{}</article></div></div>",
        "<body class='has-header has-sidebar'><div class='content-sidebar-wrap'><main class='content'><article class='entry'>{}</article></main></div>",
        "<body class='sidebar-right nav-closed'><div class='site-container'><article class='review h-entry'>{}</article></div>",
        "<body class='cookie-bar-visible js-menu-ready'><main id='main' role='main'>{}</main>",
        "<html class='no-js has-ads'><body class='page-template-with-menu'><main><article class='story is-sponsored'>{}</article></main>",
        "<body><div class='wrapper has-footer'><main class='archive'><article class='post format-aside tag-privacy'>{}</article></main></div>",
        "<body><main class='with-sidebar'><div class='entry-content'>{}</div></main>",
        "<body class='search-enabled comments-closed'><article class='tag-forms category-reviews'><div class='postBody'>{}</div></article>",
        "<body><div class='layout hasSidebar'><article class='article article--sharing-enabled'>{}</article></div>",
        "<body class='home blog'><div class='primary content-area'><main class='site-main'><article class='post sticky'>{}</article></main></div>",
    ],
)
def test_articles_under_theme_classes(shell):
    before, after = shell.split("{}")
    cut = max(before.find("<main"), 0) or before.find("<article")
    page = before[:cut] + JUNK[0] + before[cut:] + BODY + after + JUNK[1]
    want = "The headline First paragraph of the article, long enough to be read. Second paragraph with more of it."
    assert html.main_text(before + BODY + after, html.default_chain()) == want
    assert html.main_text(page, html.default_chain()) == want


def test_comments_and_cards_are_left_out():
    page = f"<body class='comments-open'><main><article class='post'>{BODY}</article><section class='comments-area'><article class='comment'><p>Nice one, I agree.</p></article></section><section class='related-posts'><article class='post'><h4><a href='/x'>Other story</a></h4><p>A card of it.</p></article></section></main>{JUNK[1]}"
    assert html.main_text(page, html.default_chain()) == "The headline First paragraph of the article, long enough to be read. Second paragraph with more of it."


def test_blocks_of_odd_markup():
    said = lambda page: [(b.text, b.element.inner) for b in html.blocks(page)]
    assert said("<article><noscript><p>Kept.</p></noscript><xmp>a <b> c</xmp><template><p>t</p></template><iframe><p>no</p></iframe><textarea>no</textarea>end") == [("Kept.", "p"), ("a <b> c", "xmp"), ("t", "p"), ("end", "article")]
    assert said("<table><tr><td>a<td>b</table><ul><li>c<li>d</ul></x></p>e") == [("a", "td"), ("b", "td"), ("c", "li"), ("d", "li"), ("e", "-")]
    long = html.blocks(f"<div class='{'x ' * 500}sidebar'>t</div>")[0]
    assert html.FEATURES["said side"] in html.features(long)


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x" + "</y>" * 100_000, "<p>" + "<b>" * 100_000 + "x" + "</p>" * 50_000, "<table>" + "<tr><td>" * 50_000 + "x" + "</div>" * 50_000, "<ul><li>" * 50_000 + "x"])
def test_deep_pages_are_linear(page):
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.perf_counter()
    found = html.blocks(page)
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b.text for b in found] == ["x"] and took < 30 and peak < 1e8


def test_pages_against_their_article(spark):
    """The whole pages table of the smallest scale: the article element's own text, without the parts that are no article's."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        skip = ("nav", "aside", "footer", "form", "script", "style")

        def __init__(self):
            super().__init__()
            self.open, self.text = [], []

        def handle_starttag(self, tag, attrs):
            if tag not in ("br", "img", "input", "meta", "link", "hr"):
                self.open.append((tag, dict(attrs).get("class") or ""))
            self.text.append(" " if tag not in ("b", "i", "a", "em", "strong", "span", "code") else "")

        def handle_endtag(self, tag):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    del self.open[k:]
                    break
            self.text.append(" " if tag not in ("b", "i", "a", "em", "strong", "span", "code") else "")

        def handle_data(self, data):
            tags = [t for t, _ in self.open]
            if "article" in tags and not set(tags) & set(self.skip) and not any(re.search(r"comment|cookie|\bad\b|share|related|sidebar", c) for _, c in self.open):
                self.text.append(data)

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(rows).collect()}
    for r in rows.collect():
        want = Article()
        want.feed(r.html or "")
        assert got[r.page_id].split() == "".join(want.text).split(), r.page_id


def test_viterbi_and_gradient():
    r = np.random.default_rng(2)
    chain = html.Chain(r.normal(size=(5, 2)), r.normal(size=(2, 2)), r.normal(size=2))
    rows = [[0], [1, 2], [3], [], [4, 0]]
    score = lambda y: chain.first[y[0]] + sum(chain.scores(rows)[k, v] for k, v in enumerate(y)) + sum(chain.change[a, b] for a, b in zip(y, y[1:]))
    every = [[(k >> j) & 1 for j in range(5)] for k in range(32)]
    assert chain.decode(rows) == max(every, key=score)
    node, _, _, loss = chain.gradient(rows, every[13])
    assert abs(loss - (np.logaddexp.reduce([score(y) for y in every]) - score(every[13]))) < 1e-9
    chain.state[3, 1] += 1e-6
    assert abs((chain.gradient(rows, every[13])[3] - loss) / 1e-6 - node[2, 1]) < 1e-4
