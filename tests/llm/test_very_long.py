"""One text of some million characters, and deep or wide pages."""

import time

import pytest
from tests.llm.test_duplicates_and_search import brute_fingerprint

from tidegrid.llm import byte_bpe, html_extract, packing, quality_rules, simhash, token_store
from tidegrid.llm.html_blocks import blocks

LONG = " ".join(f"Word{i % 50_021} of\n{i % 7}" for i in range(160_000))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, LONG, "x", 1), (2, "short", "x", 2), (None, None, None, 3)], "doc_id long, text string, decoded string, shard int")


def test_fingerprint(docs):
    found = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    assert found[1] == f"{brute_fingerprint(LONG):016x}"


def test_statistics(docs):
    rows = {r.doc_id: r for r in quality_rules.judged(docs, None).collect()}
    assert [rows[1][k] for k in quality_rules.BASE][:3] == [len(LONG.split()), sum(map(len, LONG.split())), 0]


def test_bpe(docs):
    back = byte_bpe.decode(byte_bpe.encode(docs))
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {1: LONG, 2: "short", None: ""}
    again = byte_bpe.decode(back)
    assert again.columns == back.columns and again.count() == 3


def test_store_and_packing(spark, docs):
    store, keys = token_store.write(docs)
    n = {r.doc_id: r.n_tokens for r in token_store.read_back(spark, store, keys).collect()}
    rows = packing.packed(docs).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == n[1] == len(store.get(1)) and sum(r.doc_id == 1 for r in rows) == -(-n[1] // 4096)


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "<p>deep text.</p>", "<div class='a'><p>text." * 25_000, "<p>one.</p>" * 50_000, "<li><div>" + "<center>" * 20_000 + "<li>x" * 20_000, "<div>" * 20_000 + "</section>" * 20_000, f"<article><p>{'long text, ' * 200_000}</p></article>"], ids=["deep", "unclosed", "wide", "items", "ends", "long"])
def test_pages(page):
    began = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - began < 6


def test_heads_and_unnamed_comments():
    """Pages of another hand than the generator's."""
    body = "".join(f"<p>The {k} paragraph tells, at some length, what happened on the day in question, and why.</p>" for k in ("first", "second", "third", "fourth"))
    page = f"""<html><body><header><a href=/>Site</a></header><div class="post-header"><h1>What happened on the day</h1></div><div class="post-content">{body}</div>
        <div class="reader-opinions">{"".join(f'<div class="opinion"><b>{n}</b><p>I do not think so, {n} said.</p></div>' for n in ("Ann", "Bo", "Cy", "Di"))}</div><footer>&copy; Site</footer></body></html>"""
    text = html_extract.main_text(page).split("\n")
    assert text[0] == "What happened on the day" and len(text) == 5, text
    assert [b.text for b in blocks("a<p>b<p>c")] == ["a", "b", "c"]
