import random

from tidegrid.llm import toxicity


def test_copies_of_a_long_text_leave_room_for_other_terms(spark):
    rng = random.Random(6)
    word = lambda n=6: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    long = " ".join(word(8) for _ in range(1500))  # some 9,000 words and beginnings
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        text = long if toxic and i % 2 else " ".join(word() for _ in range(30)) + (" zargle borfin" if toxic else "")
        rows.append((i, text))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("zargle".startswith(t.rstrip("*")) for t in lexicon.terms) and any("borfin".startswith(t.rstrip("*")) for t in lexicon.terms)
    found = {r.doc_id: r.predicted for r in toxicity.scored(docs, lexicon).collect()}
    assert all(found[i] for i, toxic in labels if toxic)
