import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import boosted_trees, html_extract, license_scan, ngram_model, quality_rules, toxicity
from tidegrid.llm.html_blocks import blocks
from tidegrid.llm.maxflow import minimum_cut

SF = "/root/testdata/sf0.1"


# toxicity


@pytest.mark.parametrize(
    ("text", "hit"),
    [("you IDIOT!", 1), ("an 1d10t here", 1), ("IDІOT".replace("І", "і"), 1), ("іdiоt", 1), ("ｉｄｉｏｔ", 1), ("id​iot", 1), ("ídiöt", 1), ("idiotic", 0), ("trash can", 0), ("trash", 1), ("trash can of trash", 1), ("zornig", 1), ("$$$ idea %%%", 0), ("", 0), (None, 0)],
)
def test_lexicon(text, hit):
    of = toxicity.Lexicon({"idiot": 2.0, "trash": 1.0, "zorn*": 1.0}, 1.0, -3.0)
    assert of.weighed(of.automaton(), toxicity.folded(text))[1] == hit


def test_toxicity(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(("ka", "lo", "ren", "ti", "su", "mon")) for _ in range(3))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = [word() for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(("zarg", "borf", "kwixa", "kwixo", "kwixe")))
        rows.append((i, " ".join(words), 1.0, "x"))
        labels.append((i, int(toxic), 5))
    rows += [(None, "zarg borf"), (400, None), (401, ""), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r[:2], 1.0, "x") for r in rows], "doc_id long, text string, score double, held_out string")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (10**9, 1, 1)], "doc_id long, toxic int, y int")
    lexicon = toxicity.learn(docs, marks)
    found = toxicity.scored(docs, lexicon).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    held = [(r.predicted, labels[r.doc_id][1]) for r in found if r.held_out and r.doc_id < 400]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert {r.predicted for r in found if r.doc_id in (400, 401)} == {0} and all(r.predicted for r in found if r.doc_id is None)
    kept = toxicity.without_toxic(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in found)
    assert toxicity.scored(docs, toxicity.learn(docs, marks.limit(0))).count() == len(rows)
    assert toxicity.scored(docs.limit(0), lexicon).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.scored(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    hits = Counter((r.toxic, r.predicted) for r in rows)
    assert hits[1, 1] / (hits[1, 1] + hits[1, 0]) > 0.85 and hits[1, 1] / (hits[1, 1] + hits[0, 1]) > 0.95


# quality rules


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = Counter(windows)
    covered = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(("a ", "b ", "c ", "a", "é", "\n", "\t", "# ", "\x1c", " ", " | ")) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_statistics():
    for text in (None, "", " \n ", "a b c d e f g h " * 5, "one\none\n one\n\n\n", *texts(3, 300)):
        assert quality_rules.statistics(text)[0] == brute_statistics(text), text


def test_quality_rules(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(("ka", "lo", "ren", "ti", "su", "mon")) for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word() + ("%%%" if i % 4 == 0 else "") for _ in range(rng.randint(25, 90))), True, 1) for i in range(300)]
    rows += [(None, "few words", True, 1), (300, None, True, 1), (301, "", True, 1), (1, rows[1][1], True, 1), (302, "a b c d e f g h " * 20, True, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, chance int")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(250)] + [(None, 0, 0), (5, None, 0)], "doc_id long, quality int, y int")
    trees = quality_rules.learn(docs, labels)
    found = quality_rules.judged(docs, trees).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None and r.doc_id < 300:
            assert r.kept == (r.doc_id % 4 != 0) and not r.base_failed
        else:
            assert r.base_failed and not r.kept
    kept = quality_rules.kept(docs, trees)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)
    assert quality_rules.learn(docs, labels.limit(0)) is None and quality_rules.judged(docs, None).where("kept").count() == 301
    assert quality_rules.judged(docs.limit(0), trees).count() == 0


def test_trees_are_monotone():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1] + np.sin(9 * x[:, 2]))))).astype(float)
    made = boosted_trees.fit(x, y, [1, -1, 0], trees=40)
    at = rng.random((200, 3))
    for j, sign in ((0, 1), (1, -1)):
        steps = np.stack([made.margin(np.where(np.arange(3) == j, v, at)) for v in np.linspace(0, 1, 40)])
        assert (sign * np.diff(steps, axis=0) >= -1e-9).all()
    p = made.probability(x)
    assert -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() < 0.6


# licences


def test_licences(spark):
    rows = [(1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore.", 3, ""), (2, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (3, "Licensed under the Foobar License, version 2."), (4, "Mit der Zeit und with the version of it"), (5, None), (6, ""), (None, "This work is licensed under the GNU General Public License, version 3."), (2, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame([(*r[:2], 3, "") for r in rows], "doc_id long, text string, found int, families string")
    found = sorted((str(r.doc_id), r.n_paragraphs, r.n_notices, r.n_confirmed, r.n_unknown, r.families) for r in license_scan.summary(docs).collect())
    two = ("2", 1, 2, 2, 0, "cc-by-nc,mit")
    assert found == [("1", 1, 1, 1, 0, "apache-2.0"), two, two, ("3", 1, 1, 0, 1, ""), ("4", 1, 0, 0, 0, ""), ("5", 0, 0, 0, 0, ""), ("6", 0, 0, 0, 0, ""), ("None", 1, 1, 1, 0, "gpl-3.0")]
    assert license_scan.summary(docs.limit(0)).count() == 0


def test_licence_classes_of_other_examples():
    model = license_scan.trained()
    made = license_scan.examples(5)[:1500]
    right = sum((f[0][1] if (f := license_scan.findings(t, model)) else "none") == license_scan.CLASSES[k] for t, k in made)
    assert right >= 0.95 * len(made)


def test_licences_in_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = {"cc-by-nc": "Licensed under CC BY-NC 4.0", "gpl-3.0": "GNU General Public License, version 3", "apache-2.0": "Apache License, Version 2.0", "mit": "MIT License"}
    for r in license_scan.summary(docs).join(docs, "doc_id").collect():
        assert r.families == ",".join(sorted(k for k, v in lines.items() if v in r.text))


# pages


def test_extraction_of_other_pages():
    rng, weights, right = random.Random(77), html_extract.trained(), 0
    for _ in range(100):
        page = html_extract.page(rng)
        want = "\n".join(b.text.replace("\ue000", "") for b in blocks(page) if "\ue000" in b.text)
        right += html_extract.main_text(page.replace("\ue000", ""), weights) == want
    assert right >= 97


def test_pages(spark):
    body = "<article><h1>A&amp;B &eacute;</h1><p><b>One  two\n three.<br>Four.<br><p>Five &lt;six&gt; it is, then, for ever.</p></article>"
    page = f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy this.</div>{body}<div id="comments"><p>I like it a lot, said one.</p></div><footer>&copy; me</footer></body></html>'
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "", ""), (None, "v", page), (4, "w", "<p")]
    found = html_extract.extracted(spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, text int, n_chars int")).collect()
    want = "A&B é\nOne two three. Four.\nFive <six> it is, then, for ever."
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in found[:5]] == [(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (3, "", "", 0), (None, "v", want, len(want))]
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_tables(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        got = html_extract.main_text(r.html)
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        import html

        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", inside.replace("<br>", " "))]
        assert got == "\n".join(x for x in want if x)


def test_minimum_cut():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 7)
        source, sink = ([rng.randint(0, 9) for _ in range(n)] for _ in range(2))
        edges = [(a, b, rng.randint(0, 6)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(side):
            return sum(source[i] if not side[i] else sink[i] for i in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])

        assert cost(minimum_cut(source, sink, edges)) == min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))


# the n-gram model


def brute_model(trusted, order):
    """Probabilities of single n-grams, by the definition, over whole byte strings."""
    tables = {order: Counter(t[i - order + 1 : i + 1] for x in trusted for t in [bytes(order - 1) + x + b"\0"] for i in range(order - 1, len(t)))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])

    def discount(k, c):
        n = [sum(v == i for v in tables[k].values()) for i in range(5)]
        d = [0.5, 1.0, 1.5]
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.0), float(i)) for i in (1, 2, 3)]
        return d[min(c, 3) - 1] if c else 0.0

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        mates = [c for h, c in tables[k].items() if h[:-1] == g[:-1]]
        if not mates:
            return p(g[1:])
        c = tables[k][g]
        return (max(c - discount(k, c), 0) + sum(discount(k, m) for m in mates) * p(g[1:])) / sum(mates)

    return p


def test_ngram_model(spark, monkeypatch):
    monkeypatch.setattr(ngram_model, "BLOCK", 60)
    monkeypatch.setattr(ngram_model, "PART", 25)
    words = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "élan", "", None]
    rows = [(i, w, "en" if i % 2 else None, 1) for i, w in enumerate(words)] + [(6, "zzz %%% qqq", "fr", 1), (None, "the cat", "en", 1), (2, words[2], None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, g int")
    trusted = spark.createDataFrame([(0,), (1,), (2,), (2,), (None,), (99,)], "doc_id long")
    for order in (2, 4):
        found = ngram_model.judged(docs, trusted, order=order).collect()
        p = brute_model([w.encode() for w in (words[0], words[1], words[2], words[2])], order)
        want = []
        for i, text, _, _ in rows:
            t = bytes(order - 1) + (text or "").encode() + b"\0"
            logs = [math.log(p(t[j - order + 1 : j + 1])) for j in range(order - 1, len(t))]
            want.append((str(i), len(logs), math.exp(-sum(logs) / len(logs))))
        got = sorted((str(r.doc_id), r.n_bytes, r.perplexity) for r in found)
        assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
        assert np.allclose([x[2] for x in got], [x[2] for x in sorted(want)], rtol=1e-9)
        assert {r.doc_id: r.kept for r in found}[6] is False and {r.doc_id: r.kept for r in found}[0]
    assert ngram_model.judged(docs, trusted.limit(0)).where("kept").count() == len(rows)
    assert ngram_model.judged(docs.limit(0), trusted).count() == 0


def test_ngram_sums():
    p = brute_model([b"abracadabra", b"banana"], 3)
    for h in (b"", b"a", b"ab", b"zz"):
        assert math.isclose(sum(p(h + bytes([w])) for w in range(256)), 1, rel_tol=1e-9)
