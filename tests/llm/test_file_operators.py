"""Tokens, packing, archives and page texts, against plain restatements and round trips."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from proxyspark.llm import extract, packing, registry, tokenfiles, warc
from proxyspark.llm.common import table
from proxyspark.llm.tokens import CachedEncoder
from tests.llm.conftest import rows_of

SMALL = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ENCODERS = {p: CachedEncoder(p, limit=500) for p in (BYTE, WORD)}
TOKENIZERS = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}

PIECES = st.lists(st.sampled_from([
    " ", "  ", "   ", "\n", "\n\n", "\t", "a", "Word", "it's", "I'LL", "!'s", "'Re", "x'", "é", "é", "İ", "ſ", "'ſ", "ß", "Σ", "ΟΔΟΣ", "12", "²",
    "½", "Ⅷ", "中文", " ", " ", "　", "\x1c", "\x85", "<|endoftext|>", "<|", "_", "...", "#x", "\U0001F600", "\x01", "\x00"]), max_size=20).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_cached_ids_equal_the_library(text):
    for path in (BYTE, WORD):
        got = np.frombuffer(ENCODERS[path].encode(text), "<u2").tolist()
        assert got == TOKENIZERS[path].encode(text, add_special_tokens=False).ids, (path, text)


def test_a_text_takes_few_calls_of_the_library():
    text = "\n".join(f"Line{'abcdefghij'[k % 10] * (k // 10 + 1)}x ends{chr(97 + k % 26) * 3}.\t({k})" for k in range(60)) + "\r\nlast\n\n"
    for path in (BYTE, WORD):
        enc, calls = CachedEncoder(path), []

        class Counting:
            def __getattr__(self, name):
                calls.append(name)
                return getattr(TOKENIZERS[path], name)
        enc.tokenizer = Counting()
        got = np.frombuffer(enc.encode(text), "<u2").tolist()
        assert got == TOKENIZERS[path].encode(text, add_special_tokens=False).ids
        assert len(calls) <= 2
        # A line break is no part of what is remembered beside words.
        assert path == WORD or not [c for c in enc.ids if "\nLine" in c]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op8_round_trip(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in table(spark, SMALL, "documents").collect())
    start, want = 0, []
    for doc_id, text in docs:
        ids = TOKENIZERS[BYTE].encode(text, add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    got = rows_of(registry.op8_tokenfiles(spark, SMALL), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(want, key=repr)


def test_token_files_edges(spark, docs_of, tmp_path):
    docs = docs_of([(5, "five"), (1, None), (1, "one"), (None, "none"), (3, ""), (2, "two " * 50_000)])
    folder = f"file://{tmp_path}/tokens"
    got = [tuple(r) for r in tokenfiles.token_files(spark, docs, BYTE, 2, folder).orderBy("start").collect()]
    texts = ["none", "", "one", "two " * 50_000, "", "five"]
    start = 0
    for (doc_id, at, n, c), want_id, text in zip(got, [None, 1, 1, 2, 3, 5], texts):
        ids = TOKENIZERS[BYTE].encode(text, add_special_tokens=False).ids + [2]
        assert (doc_id, at, n, c) == (want_id, start, len(ids), crc(ids))
        start += n
    names = os.listdir(tmp_path / "tokens")
    assert sum(os.path.getsize(tmp_path / "tokens" / n) for n in names if n.endswith(".ids")) == 2 * start
    assert tokenfiles.token_files(spark, docs_of([]), BYTE, 2).count() == 0


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_op4_rows_and_fill(spark):
    rows = registry.op4_packing(spark, SMALL).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, SMALL, "documents").collect()}
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
    assert of.keys() == docs.keys()
    for doc_id, text in docs.items():
        ids = TOKENIZERS[WORD].encode(text, add_special_tokens=False).ids + [1]
        want = [(k, lo, len(ids[lo:lo + 4096]), crc(ids[lo:lo + 4096])) for k, lo in enumerate(range(0, len(ids), 4096))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in of[doc_id]) == want
    assert check_packing(rows, 4096) == -(-sum(r["length"] for r in rows) // 4096)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=30))
def test_plan_places_every_item_once(histogram):
    steps = packing.plan(dict(histogram), 60)
    placed, bins = {}, {}
    for length, rank, count, sequence, offset in steps:
        placed.setdefault(length, []).extend(range(rank, rank + count))
        for k in range(count):
            bins.setdefault(sequence + k, []).append((offset, length))
    assert {n: sorted(r) for n, r in placed.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 60 and sum(3 * n > 60 for _, n in places) <= 2
    # First-fit decreasing needs at most 11/9 of the best; so must this.
    low = max(-(-sum(n * c for n, c in histogram.items()) // 60), sum(c for n, c in histogram.items() if n > 30))
    assert len(bins) <= 11 / 9 * low + 1 or len(bins) <= first_fit(histogram, 60)


def first_fit(histogram, capacity):
    free = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        k = next((k for k, f in enumerate(free) if f >= n), None)
        if k is None:
            free.append(capacity - n)
        else:
            free[k] -= n
    return len(free)


def test_packing_edges(spark, docs_of, monkeypatch):
    docs = docs_of([(1, None), (2, ""), (3, "word " * 9000), (4, "same text"), (4, "same text"), (None, "x y z")])
    items = packing.pieces(docs, WORD, 1, with_ids=True)
    assert rows_of(items, "doc_id", "piece", "length") == sorted(
        [(1, 0, 1), (2, 0, 1), (3, 0, 4096), (3, 1, 4096), (3, 2, 809), (4, 0, 3), (4, 0, 3), (None, 0, 4)], key=repr)
    assert all(len(r["ids"]) == r["length"] for r in items.collect())
    rows = packing.pack(packing.pieces(docs, WORD, 1)).collect()
    assert len(rows) == 8 and check_packing(rows, 4096) == 3
    assert packing.pack(packing.pieces(docs_of([]), WORD, 1)).count() == 0
    many = docs_of([(k, "a b c") for k in range(500)])
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 50)  # one length, several salts
    found = packing.ranked(packing.pieces(many, WORD, 1), 500, 50)
    assert sorted(r["_rank"] for r in found.collect()) == list(range(500))


# ---- archives

def test_op7_round_trip(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in table(spark, SMALL, "pages").collect()}
    last = {}
    for page_id, data in pages.items():
        last[data] = max(page_id, last.get(data, page_id))
    for r in registry.op7_warc(spark, SMALL).collect():
        data = pages.pop(r["page_id"])
        refers = last[data] if len(data) >= 1000 and last[data] != r["page_id"] else None
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == ("revisit" if refers is not None else "response", refers)
    assert not pages


def test_archives_keep_pages_whole(spark, tmp_path):
    big, url = "<p>é\r\n\r\n&amp;</p>" * 200, "http://a.example/ü x\n"
    rows = [(1, url, big), (2, None, big), (3, "", "small"), (4, "u", "small"), (5, "u", None), (None, "u", "x"), (2, None, big),
            (6, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/warc"
    got = rows_of(warc.archive(spark, pages, folder), "page_id", "record_type", "refers_to", "html")
    want = [(1, "revisit", 2, None), (2, "response", None, big), (2, "response", None, big), (3, "response", None, "small"),
            (4, "response", None, "small"), (5, "response", None, ""), (6, "response", None, "y" * 3_000_000), (None, "response", None, "x")]
    assert got == sorted(want, key=repr)
    for name in (n for n in os.listdir(tmp_path / "warc") if n.endswith(".zst")):
        assert (tmp_path / "warc" / name).read_bytes()[:4] == b"\x5d\x2a\x4d\x18"
    assert warc.archive(spark, pages.limit(0)).count() == 0


# ---- main text

def test_main_text_of_one_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We</div>
    <article><header><h2>Head &amp; more</h2></header><p>One&nbsp;two
      three<br>four <b>bold</b>text<p>Next &lt;p&gt; 1 < 2<!-- no --><ul><li>a<li>b</ul><aside>aside</aside>
    <form><input><button>Send</button></form><table><tr><td>c<td>d</table><div class="sponsored">x</div><section class="comments"><p>me</p></section>
    </article><div class="sidebar"><p>Side</p></div><article class="comment">late</article><footer>&copy; x</footer></body></html>"""
    assert extract.main_text(page, frozenset()) == "Head & more\nOne two three four boldtext\nNext <p> 1 < 2\na\nb\nc\nd"
    assert extract.main_text("", frozenset()) == "" and extract.main_text("plain  text", frozenset()) == "plain text"
    assert extract.main_text("<article><p>cut off <a hre", frozenset()) == "cut off"
    assert extract.main_text("<div><p>a</div>b</p>c", frozenset()) == "a\nb\nc"


def test_style_tree_removes_what_repeats(spark):
    def page(k):
        return (f"<body><div><ul><li>Home</li><li>News</li></ul></div><div><p>Body text number {k}</p><p>and {k * k}</p></div>"
                f"<section><p>All rights reserved</p></section></body>")
    rows = [(k, f"https://h.example:80/{k}", page(k)) for k in range(20)] + [(50, "https://one.example/", page(50)), (51, None, None), (52, "bad", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, paths string")
    got = {r["page_id"]: r for r in extract.extract(pages).collect()}
    assert len(got) == 23
    for k in range(20):
        assert got[k]["text"] == f"Body text number {k}\nand {k * k}" and got[k]["n_chars"] == len(got[k]["text"])
    assert got[50]["text"].startswith("Home\nNews\nBody text number 50")  # a host of one page: nothing is known to repeat
    assert got[51]["text"] == got[52]["text"] == "" and got[51]["url"] is None
    assert extract.extract(pages.limit(0)).count() == 0


def test_style_tree_decides_inside_and_beside_articles(spark):
    def page(k):
        return (f"<body><div class='intro'><p>Own words {k} beside it</p></div><div class='strip'><p>Same on every page</p></div>"
                f"<article class='teaser-box'><p>Read the other story</p></article>"
                f"<article><p>Story {k}</p><div class='box'><p>All rights reserved</p></div><p>ends {k * k}</p></article></body>")
    copy = "<body><article><p>The same story</p><div class='box'><p>twice</p></div></article></body>"
    rows = [(k, f"https://h.example/{k}", page(k)) for k in range(20)] + [(50, "https://one.example/", page(50))]
    rows += [(100 + k, f"https://mirror.example/{k}", copy) for k in range(20)]
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(20):
        assert got[k] == f"Own words {k} beside it\nStory {k}\nends {k * k}"
        assert got[100 + k] == "The same story\ntwice"  # whole pages repeat: nothing to tell notices by
    assert got[50].startswith("Own words 50 beside it\nSame on every page")  # a host of one page


def test_op10_pages(spark):
    import re
    from html import unescape
    for r in registry.op10_extract(spark, SMALL).join(table(spark, SMALL, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        want = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "<br>" in p else "", p)).split()) for p in parts]
        assert r["text"] == "\n".join(filter(None, want))
