import math
import random

import numpy as np
import pyarrow as pa

from tidegrid.llm import ngram_model


def documents(spark, n=400):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(("one", "two", "three", "four")) for _ in range(rng.randint(0, 30))), "en") for i in range(n)]
    return spark.createDataFrame([*rows, (None, None, None), (n, "", "en"), (0, rows[0][1], "en"), (n + 1, "long " * 60_000, "en")], "doc_id long, text string, lang string")


def model_of(docs):
    return ngram_model.counts(ngram_model.packed_texts(docs, "doc_id", "text", "lang"))


def scores(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, round(r.log_p, 6)) for r in rows)


def test_other_order_the_second_time(spark, monkeypatch):
    monkeypatch.setattr(ngram_model, "BLOCK", 3_000)
    docs = documents(spark)
    model = model_of(docs)
    want = scores(ngram_model.scored(docs, model).collect())
    assert len(want) == docs.count() and all(math.isfinite(x[3]) for x in want)
    assert scores(ngram_model.scored(docs.repartition(8), model).collect()) == want

    def shaken_order(batches):
        for batch in batches:
            yield batch.take(pa.array(np.random.default_rng().permutation(batch.num_rows)))

    shaken = docs.mapInArrow(shaken_order, docs.schema)  # another order every time it is made
    assert scores(ngram_model.scored(shaken, model).collect()) == want


def test_empty(spark):
    docs = documents(spark)
    assert ngram_model.scored(docs.limit(0), model_of(docs)).count() == 0
