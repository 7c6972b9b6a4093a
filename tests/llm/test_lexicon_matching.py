import random
import time

import pytest

from tidegrid.llm import quality_rules, toxicity

TERMS = {"idiot": 2.0, "trash": 1.0, "zorn*": 1.5, "zornig": 3.0, "ab": 0.5, "abcd*": 0.7}


def naive(lexicon, words):
    """Word by word, phrase by phrase."""
    spared = set()
    for phrase in lexicon.exceptions:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                spared |= set(range(i, i + len(parts)))
    found = []
    for i, word in enumerate(words):
        fits = [w for t, w in lexicon.terms.items() if (word.startswith(t[:-1]) if t.endswith("*") else t in (word, toxicity.plain(word)))]
        if fits and i not in spared:
            found.append(max(fits))
    return sum(found), len(found)


@pytest.mark.parametrize("seed", range(5))
def test_automaton_against_naive(seed):
    rng = random.Random(seed)
    lexicon = toxicity.Lexicon(TERMS, 1.0, -3.0)
    automaton = lexicon.automaton()
    pool = ["idiot", "idiöt", "trash", "can", "bin", "zorn", "zornig", "zornige", "ab", "abc", "abcd", "abcde", "idiots", "clown", "fish", "proof", "word"]
    for _ in range(200):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 30))]
        want, got = naive(lexicon, words), lexicon.weighed(automaton, words)
        assert got[1] == want[1] and got[0] == pytest.approx(want[0])


def test_a_million_words():
    lexicon = toxicity.Lexicon(TERMS, 1.0, -3.0)
    words = toxicity.folded("idiot trash can " * 350_000)
    began = time.perf_counter()
    assert lexicon.weighed(lexicon.automaton(), words)[1] == 350_000
    assert time.perf_counter() - began < 20


def test_no_terms_for_one_endless_word(spark):
    docs = spark.createDataFrame([(0, "x" * 200_000), (1, "y " * 10), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    rows = toxicity.scored(docs, toxicity.learn(docs, labels)).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 3] and all(0 <= r.score <= 1 for r in rows)


def test_repeated_ids_dont_swell_samples(spark):
    rows = [(i % 4, f"text {i % 4} number {i}") for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, body string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4)] * 3, "doc_id long, toxic int, quality int")
    found = toxicity.sampled(docs, labels, "toxic", 2, 2, text_col="body").collect()
    assert len(found) <= 4 and len({r.text for r in found}) == len(found)
    toxicity.learn(docs, labels, text_col="body")
    quality_rules.learn(docs, labels, text_col="body")


def test_quality_of_labels_not_learned(spark):
    """Half of the labelled ids teach, the other half is judged."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    trees = quality_rules.learn(docs, labels.where("crc32(cast(doc_id as string)) % 2 = 0"))
    rest = labels.where("crc32(cast(doc_id as string)) % 2 = 1").groupBy("doc_id").agg({"quality": "min"}).withColumnRenamed("min(quality)", "quality").where("quality is not null")
    n = {(r.quality, r.kept): r["count"] for r in quality_rules.judged(docs.join(rest.select("doc_id"), "doc_id", "left_semi"), trees).join(rest, "doc_id").groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 0.03 * (n.get((0, True), 0) + n[0, False])
    assert n.get((1, False), 0) <= 0.05 * (n.get((1, False), 0) + n[1, True])


def test_trees_by_hand(spark):
    """The node arrays, walked row by row in plain Python, give the verdicts."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    trees = quality_rules.learn(docs, labels)

    def margin(x):
        out = trees.base
        for at in trees.roots:
            while trees.feature[at] >= 0:
                at = trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            out += trees.value[at]
        return out

    found = {r.doc_id: r for r in quality_rules.judged(docs, trees).collect()}
    for r in docs.collect():
        base, x = quality_rules.statistics(r.text)
        assert found[r.doc_id].kept == (not quality_rules.base_failed(base) and margin(x) >= 0)
