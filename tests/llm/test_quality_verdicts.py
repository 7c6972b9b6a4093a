import random

from tidegrid.llm import ngram_model

SF = "/root/testdata/sf0.1"


def test_verdicts_against_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = labels.where("quality = 1").select("doc_id")
    rng = random.Random(8)
    mixed = []
    for r in docs.join(good, "doc_id").where("length(text) between 300 and 3000").orderBy("doc_id").limit(300).collect():
        words = r.text.split()
        rng.shuffle(words)
        mixed.append((-1 - r.doc_id, " ".join(words), r.lang))
    docs = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(mixed, "doc_id long, text string, lang string"))
    rows = ngram_model.judged(docs, good).join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "kept", "quality").collect()
    share = lambda of: sum(r.kept for r in of) / len(of)
    told = {"bad": share([r for r in rows if r.quality == 0]), "good": share([r for r in rows if r.quality == 1]), "shuffled": share([r for r in rows if r.doc_id < 0])}
    assert told["good"] > 0.97 and told["bad"] < 0.15 and told["shuffled"] < 0.6, told  # 1.5 times the quantile kept 0.2 and all
