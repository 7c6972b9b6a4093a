"""The corpus pipeline against plain Python, stage by stage and as a whole."""

import pathlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tests.llm.test_lexicon_matching import naive
from tests.llm.test_near_copies import brute_groups
from tokenizers import Tokenizer

import corpus_pipeline
from tidegrid.llm import quality_rules, toxicity, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _node long, score double, length int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(("ka", "lo", "ren", "ti", "su", "mon", "ar", "vel")) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(260):
        own = [word() for _ in range(rng.randint(40, 160))]
        toxic, bad = i % 6 == 0, i % 5 == 1
        for _ in range(len(own) // 15 if toxic else 0):
            own[rng.randrange(len(own))] = rng.choice(("zargle", "borfin", "kwixa"))
        text = " ".join(w + ("%%%" if bad else "") for w in own)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    clean = [r for r in rows if r[0] % 6 and r[0] % 5 != 1]
    near = lambda t, n: " ".join(word() if k in at else w for at in [set(rng.sample(range(40), n))] for k, w in enumerate(t.split()))
    rows += [(300 + k, near(t, k % 4)) for k, (_, t) in enumerate(clean[:30])]
    rows += [clean[3], clean[3], (None, clean[4][1]), (None, " ".join(word() for _ in range(50))), (400, None), (401, ""), (402, " ".join(word() for _ in range(60_000)))]
    rng.shuffle(rows)
    at = tmp_path_factory.mktemp("documents")
    spark.createDataFrame([(i, t, "en", None, None, 1, 0.5, 7) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return f"{at}", rows


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, folder):
    sf, rows = folder
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    lexicon, trees = toxicity.learn(docs, labels), quality_rules.learn(docs, labels)

    def toxic(text):
        own = toxicity.folded(text)
        return lexicon.score(naive(lexicon, own)[0], len(own)) >= 0.7

    def good(text):
        base, x = quality_rules.statistics(text)
        return not quality_rules.base_failed(base) and trees.probability(np.array([x]))[0] >= 0.5

    one = corpus_pipeline.clean_language(spark, docs, sf)
    want = [r for r in rows if not toxic(r[1])]
    assert one.columns == docs.columns and pairs(one) == sorted(want, key=str) and 30 <= len(rows) - len(want) <= 80
    two = corpus_pipeline.good_quality(spark, one, sf)
    want = [r for r in want if good(r[1])]
    assert two.columns == docs.columns and pairs(two) == sorted(want, key=str) and len(want) > 100
    three = corpus_pipeline.near_duplicates(spark, two, sf)
    of = sorted(want, key=lambda r: (r[0] is None, r[0] or 0))
    kept = sorted(set(brute_groups([t for _, t in of])))  # the first of each group has the smallest id
    assert three.columns == docs.columns and pairs(three) == sorted((of[k] for k in kept), key=str) and len(kept) <= len(of) - 20
    library = Tokenizer.from_file(words.vocabulary())
    pieces, places = [], defaultdict(list)
    for i, t in (of[k] for k in kept):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        pieces += [(str(i), k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096])) for k, s in enumerate(range(0, len(ids), 4096))]
    scratch = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "tidegrid"
    there = set(scratch.iterdir())
    four = corpus_pipeline.run(spark, sf).collect()
    assert [p.name.split("-")[0] for p in set(scratch.iterdir()) - there] == ["best_fit_packing"]  # nothing else is left behind
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in four) == sorted(pieces)
    for r in four:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 4096
    assert len(places) <= 1.1 * sum(r.length for r in four) / 4096 + 2


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}").count() == 0
