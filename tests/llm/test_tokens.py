import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegrid.llm import byte_bpe, packing, token_store, words
from tidegrid.llm.mph import PerfectHash

DOCS = "doc_id long, text string, ids string, length int, rank double"
ODD = ["", None, "Hello, World's  end!! 12345\n\tÀÉ İstanbul ΣΑΣ œ", "é x", "a b " * 300, "x" * 3000, "<|endoftext|> <|startoftext|>", "中文 字　詞", "\x1c\x85\xa0 q", "ab%%% cd*** | e'll 'tis can't ½ ªº"]


def documents(spark, texts, ids=None):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i if ids is None else ids[i], t, "x", 7, None) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(words.vocabulary())
    out.encode_special_tokens = True
    return out


def noise(seed, n, size):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab 'sre\n\t  .éÉß%中1\x1cİΣ") for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_words_as_the_library(library):
    of = words.WordEncoder(words.vocabulary())
    for text in (*ODD, *noise(3, 200, 120)):
        assert of.ids(text).tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_words_forget(library, monkeypatch):
    monkeypatch.setattr(words, "REMEMBERED", 5)
    of = words.WordEncoder(words.vocabulary())
    text = " ".join(f"word{i} w{'abcdefgh'[i % 8]}" for i in range(50))
    assert of.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(of) <= 5


@pytest.mark.parametrize(("chunk", "overlap"), [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (60, 20), (200, 40)])
def test_byte_bpe(spark, chunk, overlap):
    of = byte_bpe.encoding(byte_bpe.rank_file(), public_tokenizers.PATTERN)
    texts = [*ODD, *noise(5, 40, 900), ODD[2], ODD[2]]
    ids = [*range(len(texts) - 2), 2, None]  # a row that repeats, and one without id
    found = byte_bpe.decode(byte_bpe.encode(documents(spark, texts, ids), chunk=chunk, overlap=overlap)).collect()
    want = sorted((str(i), of.encode_ordinary(t or ""), (t or "").encode()) for i, t in zip(ids, texts, strict=True))
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in found) == want


def test_byte_bpe_digests(spark):
    row = byte_bpe.digests(documents(spark, ["Hello you"])).first()
    ids = byte_bpe.encoding(byte_bpe.rank_file(), public_tokenizers.PATTERN).encode_ordinary("Hello you")
    assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert row.decoded_sha256 == hashlib.sha256(b"Hello you").hexdigest()
    assert byte_bpe.digests(documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(-(1 << 63), 1 << 63, n)
    made = PerfectHash.build(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(n))
    again, end = PerfectHash.loaded(b"xx" + made.dumped(), 2)
    assert end == 2 + len(made.dumped()) and (again.slots(keys) == made.slots(keys)).all()
    assert (made.slots(keys + 1) < max(n, 1)).all()


@pytest.mark.parametrize("rows", [token_store.SHARD_ROWS, 7])
def test_token_store(spark, library, monkeypatch, rows):
    monkeypatch.setattr(token_store, "SHARD_ROWS", rows)
    monkeypatch.setattr(token_store, "PART_KEYS", 2 * rows)
    texts = [*ODD, *noise(9, 30, 200), "again", "again", "other", "nobody"]
    ids = [*(3 * i - 20 for i in range(len(texts) - 4)), 1000, 1000, 1000, None]
    docs = documents(spark, texts, ids)
    store, keys = token_store.write(docs)
    found = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_back(spark, store, keys).collect()), key=lambda r: r[2])
    coded = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, coded(x[1]).astype("<u2").tobytes()))
    at, want = 0, []
    for i, t in order:
        want.append((i is not None, i or 0, at, len(coded(t)), zlib.crc32(coded(t))))
        at += len(coded(t))
    assert found == want
    assert store.get(ids[2]).tolist() == coded(texts[2]).tolist()
    assert store.get(999_999) is None


def test_empty_token_store(spark):
    store, keys = token_store.write(documents(spark, []))
    assert token_store.read_back(spark, store, keys).count() == 0


def packed_well(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("tasks", [1, 7])
def test_packing(spark, library, tasks):
    texts = [*ODD, *noise(13, 60, 300), *["same text here"] * 40]
    ids = [*range(len(texts) - 1), None]
    rows = packing.packed(documents(spark, texts, ids).repartition(tasks), capacity=64).collect()
    assert packed_well(rows, 64) <= 1.05 * sum(r.length for r in rows) / 64 + 2
    want = []
    for i, t in zip(ids, texts, strict=True):
        own = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(i), k, s, len(own[s : s + 64]), zlib.crc32(own[s : s + 64])) for k, s in enumerate(range(0, len(own), 64))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert packing.packed(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice((10, 100, 1000))
    lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.choice((capacity // 3 + 1, capacity // 2 + 1)) for _ in range(rng.choice((0, 3, 500, 3000)))]
    histogram = {k: lengths.count(k) for k in set(lengths)}
    runs, ranks, places = packing.plan(histogram, capacity), defaultdict(list), defaultdict(list)
    for length, first, n, sequence, offset in runs:
        ranks[length] += range(first, first + n)
        for i in range(n):
            places[sequence + i].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    bins = []  # best fit in descending order, piece by piece
    for k in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(bins) if room >= k]
        if fit:
            i = min(fit, key=bins.__getitem__)
            bins[i] -= k
        else:
            bins.append(capacity - k)
    assert len(places) <= 1.03 * len(bins) + 2
