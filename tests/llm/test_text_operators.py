"""Packing, main text, URL filter and quality against plain Python, with odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sessionloom.llm import html_text, packing, quality, url_filter
from sessionloom.llm.queries import QUERIES, TOKENIZER
from sessionloom.llm.textbytes import text_blocks

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(TOKENIZER)


# -- packing --------------------------------------------------------------------------------
def test_units_give_the_ids_of_whole_texts():
    random.seed(3)
    plain, units = Tokenizer.from_file(PATH), packing.UnitTokenizer(PATH, limit=3000)
    texts = ["don't we'll THEY'RE o'clock 'tis!'s a's!' x", "İstanbul ΑΣΣ straße", "éé!é ≠ a̸!", "tab\tnbsp\u00a0x\u3000y\x0bz\x1cq",
             "<|endoftext|> <|ENDOFTEXT|>hi<|startoftext|>x", "12a3!4%5 a1! ①²x", "—!—a—'s", "", "   \n ", "''s's", "日本語ab日本", "🙂a🙂!", "\x00a\x00"]
    texts += ["".join(random.choice("aB1!'%— \n\té́sreİ🙂<|") for _ in range(random.randint(0, 60))) for _ in range(1500)]
    for first, last, data, offsets in text_blocks(pa.array(texts), 3000):
        for ids, text in zip(units.encode(data, offsets), texts[first:last]):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("capacity", [8, 64])
def test_groups_are_packed_without_padding(capacity):
    random.seed(capacity)
    for _ in range(200):
        lengths = [random.randint(1, 3 * capacity) for _ in range(random.randint(0, 30))]
        pieces = packing.pack_group(lengths, capacity)
        covered, filled = defaultdict(list), defaultdict(list)
        for document, start, length, sequence, offset in pieces:
            covered[document] += range(start, start + length)
            filled[sequence] += range(offset, offset + length)
        assert all(sorted(covered[d]) == list(range(n)) for d, n in enumerate(lengths))
        sizes = [len(x) for x in filled.values()]
        assert all(sorted(x) == list(range(len(x))) for x in filled.values())
        assert all(n & (n - 1) == 0 for n in sizes) and sum(n < capacity for n in sizes) <= capacity.bit_length()


def test_first_fit_decreasing_takes_the_first_bin_with_room():
    assert packing.first_fit_decreasing([5, 7, 3, 5], 10) == [[1, 2], [0, 3]]
    assert packing.first_fit_decreasing([], 10) == []


def check_packed(rows, texts):
    """texts: (doc_id, text) of every row; ids must be different."""
    plain, pieces = Tokenizer.from_file(PATH), defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == {d for d, _ in texts}
    for doc_id, text in texts:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[doc_id], key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1])
        assert sum(r["length"] for r in own) == len(ids) and all(r["doc_tokens"] == len(ids) for r in own)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing_query(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_packed(QUERIES["op1_packing"](spark, SMALL).collect(), texts)


def test_packing_of_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "word " * 20_000), (None, "no id"), (4, " \n ")]
    rows = spark.createDataFrame([(*t, 1, 1) for t in texts], "doc_id long, text string, start int, _key int")
    check_packed(packing.pack_documents(rows, PATH).collect(), texts)
    assert packing.pack_documents(rows.limit(0), PATH).count() == 0
    twice = packing.pack_documents(rows.filter("doc_id = 1").union(rows.filter("doc_id = 1")), PATH).collect()
    assert [r["length"] for r in twice] == [1, 1]


# -- main text ------------------------------------------------------------------------------
def test_labelled_pages_have_a_mark_per_block():
    tree = html_text.trained_tree()
    for page, marks in html_text.LABELLED_PAGES:
        blocks = html_text.text_blocks(page)
        assert len(blocks) == len(marks)
        assert "".join("+" if kept else "-" for kept in html_text.classify(tree, html_text.features(blocks))) == marks


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("<!-- <p>no</p> -->", ""),
    ("<article><p>a &amp; b&nbsp; c<br>d<!-- x --></p><script>var t='</p>'</script><p>e <i>f</i>g</article><footer>no</footer>", "a & b c d e fg"),
    ("<nav><ul><li><a href='a>b'>x</a></ul></nav><article><h1>T</h1><p><b>One<p>two", "T One two"),
    ("<article><p>kept</p><div class='user-comments'><p>a long comment of a reader with many words in it</p></div></article>", "kept"),
    ("<article><p>x &lt;p&gt; y < z</p><style>p{}</style></article>", "x <p> y < z"),
    ("<article><header><h1>T</h1></header><p>x</p><form>mail <input></form><aside>also</aside></article>", "T x"),
])
def test_main_text(page, text):
    assert html_text.main_text(page, html_text.trained_tree()) == text


def test_main_text_query(spark):
    import html
    import re

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in QUERIES["op3_html_text"](spark, SMALL).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]]["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|b|br|article)>", " ", article)).split())
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), pages[r["page_id"]]["url"])


# -- URL filter -----------------------------------------------------------------------------
@pytest.mark.parametrize("url, host, path, rule, verdict", [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a.net/x", "", "", None, "allow"),
    ("http://A.NET", "a.net", "", None, "allow"), ("http://a.net/", "a.net", "/", "net/", "block"),
    ("https://x.example.net/en/1?q#f", "x.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://badexample.net/en/1", "badexample.net", "/en/1", "net/", "block"),
    ("http://example.com/de/#x", "example.com", "/de/", "example.com/de/", "block"),
    ("http://casino.org/fr/", "casino.org", "/fr/", "org/fr/", "allow"),
    ("http://my-casino.org/en", "my-casino.org", "/en", None, "block"),
    ("http://mycasino.org/en", "mycasino.org", "/en", None, "allow"),
    ("http://free.org/free", "free.org", "/free", None, "allow"), ("http://free.org/bets", "free.org", "/bets", None, "block"),
    ("http://a.org?u=http://casino", "a.org", "", None, "allow"), ("x\n://H/p", "h", "/p", None, "allow"),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(7, url, "x")], "page_id long, url string, host string")
    r = url_filter.filter_urls(df).first()
    assert (r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) == (7, host, path, rule, verdict)


# -- quality --------------------------------------------------------------------------------
def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op5_quality"](spark, sf)
    assert scored.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_quality_of_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 1), (3, "x" * 200_000, 0), (None, "text", 1), (4, "Good text here.", 1), (4, "Good text here.", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int")
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 0), (4, 1), (4, 0), (None, 1), (2, 1)], "doc_id long, quality int")
    found = quality.score_quality(df, labels)
    assert found.count() == 6 and found.filter("score IS NULL OR held_out IS NULL").count() == 0
    assert [r["score"] for r in quality.score_quality(df, labels.limit(0)).collect()] == [0.5] * 6
    assert quality.score_quality(df.limit(0), labels).count() == 0
