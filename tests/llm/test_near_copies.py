import random

import numpy as np
import pytest

import corpus_pipeline
from tidegrid.llm import near_copies, simhash

SF = "/root/testdata/sf0.1"


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or bool(a | b) and len(a & b) / len(a | b) >= 0.8


def brute_groups(texts):
    """The first position reachable from each, over all pairs that are alike."""
    sets, low = [brute_set(t) for t in texts], list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    before = None
    while before != low:
        before = list(low)
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    return low


def test_stage_drops_near_copies(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(("ka", "lo", "ren", "ti", "su", "mon", "ar", "vel")) for _ in range(3))
    texts = ["", None, "One two", "one  TWO"]
    for _ in range(12):
        words = [word() for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(words))
        for edits in (1, 2, 8, 40):
            other = list(words)
            for at in rng.sample(range(len(words)), min(edits, len(words) // 2)):
                other[at] = word()
            texts.append(" ".join(other))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_groups(texts)))
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(300):
        other = list(words)
        other[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(other))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.doc_id for r in near_copies.one_of_each(docs).collect()] == [0]


@pytest.mark.parametrize("one_of_each", [near_copies.one_of_each, simhash.one_of_each])
def test_nameless_rows(spark, one_of_each):
    rows = [(5, "x y z"), (5, "x y z"), (None, "x y z"), (None, "X y  z"), (None, "quite another text"), (None, "quite another  text"), (None, "Quite another text"), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in one_of_each(docs).collect()]
    assert sorted(kept, key=str)[:2] == [(5, "x y z"), (7, "")] and len(kept) == 3
    assert kept[[i for i, _ in kept].index(None)][1].lower().split() == ["quite", "another", "text"]


@pytest.mark.parametrize("block", [near_copies.BLOCK, 7])
def test_no_link_of_a_loose_group_is_lost(spark, monkeypatch, block):
    """Texts around one base, most less alike than 0.8 to most others: what bands put together is compared whole."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(160):
        other = list(words)
        for at in rng.sample(range(120), rng.randint(1, 5)):
            other[at] = f"x{rng.randrange(400)}"
        texts.append(" ".join(other))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == sorted(set(brute_groups(texts)))


def test_links_across_roots():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 3_000, dtype=np.uint64)
    found = [np.unique(np.concatenate((base[rng.random(3_000) < 0.93], rng.integers(0, 1 << 60, 90, dtype=np.uint64)))) for _ in range(40)]
    roots = rng.integers(0, 9, 40)
    for sides in (np.zeros(40, int), rng.integers(0, 2, 40)):
        low = roots.tolist()
        pairs = [(i, j) for i in range(40) for j in range(i) if (not sides.any() or sides[i] != sides[j]) and near_copies.jaccard(found[i], found[j]) >= 0.8]
        got = near_copies.across(found, roots, sides, 0.8)
        assert {(max(p), min(p)) for p in got} <= set(pairs)
        assert joined(low, pairs) == joined(low, got)


def joined(labels, pairs):
    out = list(labels)
    for a, b in pairs:
        out = [out[a] if x == out[b] else x for x in out]
    return [out.index(x) for x in out]


def test_long_near_copies_are_not_passed_on_with_every_pair(spark):
    """what is shuffled follows the texts, not the pairs of a large group of long ones that are all nearly alike."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4_000)]
    texts = []
    for i in range(150):
        other = list(words)
        for at in rng.sample(range(4_000), rng.randint(30, 160)):
            other[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(other))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = shuffled()
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == sorted(set(brute_groups(texts)))
    assert shuffled() - before < 2 * sum(map(len, texts))
