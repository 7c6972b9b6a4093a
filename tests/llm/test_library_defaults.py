import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidegrid.llm import packing, token_store, words

TEXTS = ["<|endoftext|>", "One <|endoftext|>Two<|startoftext|> \u00c9t\u00e9", "<|ENDOFTEXT|> is ordinary", "cut <|endoftext| off", "<|endoftext|><|endoftext|>", "plain words", "", None, "long " * 5000 + "<|startoftext|>"]


@pytest.fixture(scope="module")
def library():
    """As the file has it, nothing set."""
    return Tokenizer.from_file(words.vocabulary())


def coded(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_words(library):
    of, plain = words.WordEncoder(words.vocabulary(), special=True), words.WordEncoder(words.vocabulary())
    for text in TEXTS:
        assert [*of.ids(text).tolist(), 1] == coded(library, text).tolist(), text
    assert 49407 in of.ids("a <|endoftext|>") and 49407 not in plain.ids("a <|endoftext|>")


def test_store_and_packing(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = {i: (len(coded(library, t)), zlib.crc32(coded(library, t))) for i, t in enumerate(TEXTS)}
    store, keys = token_store.write(docs, special=True)
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.read_back(spark, store, keys).collect()} == want
    rows = packing.packed(docs, special=True, capacity=1 << 14).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == want


def read(spark, library, rows, docs):
    """Reads a store back and holds it against ids one after the other in order of doc_id."""
    store, keys = token_store.write(docs)
    found = sorted(token_store.read_back(spark, store, keys).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    mark = lambda t: (len(coded(library, t)), zlib.crc32(coded(library, t)))
    marks = {t: mark(t) for t in {t for _, t in rows}}
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((i, *marks[t]) for i, t in rows)
    assert Counter(r.copy for r in keys.where("doc_id = 5").collect()) == Counter(range(sum(i == 5 for i, _ in rows)))
    return store


def test_large_ids_and_nulls(spark, library, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_ROWS", 20)
    rows = [((1 << 60) + i, f"text {i}") for i in range(150)] + [(None, f"nobody {i % 7}") for i in range(60)] + [(-(1 << 62), "first")]
    store = read(spark, library, rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    for i in (0, 77, 149):
        assert store.get((1 << 60) + i).tolist() == coded(library, f"text {i}").tolist()


def test_one_id_repeated(spark, library, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_ROWS", 6_000)
    rows = [(5, ("same", "same", f"odd {i}")[i % 3]) for i in range(100_000)] + [(i, "other") for i in range(10, 2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    read(spark, library, rows, docs)
    ids = docs.select("doc_id", "text")
    nameless, edges = token_store.ends(ids, len(rows), 16)
    assert nameless == 0 and Counter(edges.tolist())[5] >= 12  # the id has many shards of its own


def test_missing_key_stops(spark):
    store, _ = token_store.write(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    with pytest.raises(Exception, match="not stored"):
        token_store.read_back(spark, store, spark.createDataFrame([(2, 0)], "doc_id long, copy int")).collect()


def test_few_large_pieces_are_planned():
    assert len({s + i for _, _, n, s, _ in packing.plan({60: 2, 40: 2, 35: 3, 30: 2, 5: 3}, 100) for i in range(n)}) == 4
