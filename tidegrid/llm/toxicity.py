"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded text."""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import dropped, over_batches, parallelism, written
from tidegrid.llm.words import texts

#: Labelled rows of either class that the lexicon and the calibration are learned from, at most.
TOXIC_ROWS, CLEAN_ROWS = 3000, 9000
#: A term must account for at least one in so many toxic rows of the sample, five times each: so there are 5 * LEAST at most.
LEAST = 90
#: Letters of a word's beginnings that are terms: no word that people write as an insult has more.
STEMS = range(4, 33)
THRESHOLD = 0.7
#: Used where no labels are given.
SEED = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting")
#: Phrases in which a term is no insult; matched on folded words.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "idiot proof", "worthless cheque")
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("асԁеһіјӏорԛѕԝхуѵвкмнтгαβεικνορτυχγω", "acdehijlopqswxyvbkmhtraveikvoptuxyw", strict=True))
#: Signs written for letters: between letters, or one before a word.
SIGNS = dict(zip("013457@$!|", "oieastasil", strict=True))


def folding() -> dict[int, str | None]:
    """Full-width forms become ordinary ones, look-alikes Latin; joiners, soft hyphens and combining marks go."""
    wide = {i: unicodedata.normalize("NFKC", chr(i)).lower() for i in range(0xFF01, 0xFF5F)}
    gone = {i: None for i in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370))}
    return wide | gone | {ord(a): b for a, b in LOOKALIKES.items()}


FOLDING = folding()
_SIGNS = re.escape("".join(SIGNS))
SIGN = re.compile(rf"(?<=[^\W\d_])[{_SIGNS}]+(?=[^\W\d_])|(?<![\w{_SIGNS}])[{_SIGNS}](?=[^\W\d_]\w)")
WORD = re.compile(r"[^\W\d_]+")


def folded(text: str | None) -> list[str]:
    """The words of a text, as terms are matched: composed, lower-cased, folded."""
    text = unicodedata.normalize("NFC", text or "").lower()
    if not text.isascii():
        text = text.translate(FOLDING)
    return WORD.findall(SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text))


def plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


class Lexicon:
    """terms: weights of whole words ("word") and of beginnings ("stem*"); a and b calibrate the score."""

    def __init__(self, terms: dict[str, float], a: float, b: float, exceptions: tuple[str, ...] = EXCEPTIONS):
        self.terms, self.a, self.b, self.exceptions = terms, a, b, exceptions

    def __reduce__(self):
        return Lexicon, (self.terms, self.a, self.b, self.exceptions)

    def automaton(self):
        """Finds terms, with their weight and whether they are whole words, and exception phrases, with their length."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            out.add_word(f" {term[:-1]}" if term.endswith("*") else f" {term} ", (weight, not term.endswith("*"), 0))
        for phrase in self.exceptions:
            out.add_word(f" {phrase} ", (0.0, True, len(phrase) + 2))
        if len(out):
            out.make_automaton()
        return out

    def weighed(self, automaton, words: list[str]) -> tuple[float, int]:
        """(sum of weights, hits): of each word the heaviest term counts, and none within an exception phrase."""
        if not words or not len(automaton):
            return 0.0, 0
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        text = f" {' '.join(words)} "
        for end, (weight, whole, phrase) in automaton.iter(text):
            if phrase:
                spared.append((end - phrase + 1, end))
            elif weight:
                at = text.rindex(" ", 0, end if whole else end + 1)  # the blank before the word
                found[at] = max(found.get(at, 0.0), weight)
        if not text.isascii():  # accents put on letters of whole words
            bare = plain(text)
            if len(bare) == len(text):
                for end, (weight, whole, phrase) in automaton.iter(bare):
                    if weight and whole and not phrase:
                        at = bare.rindex(" ", 0, end)
                        found[at] = max(found.get(at, 0.0), weight)
        total, hits, k, reach = 0.0, 0, 0, -1
        spared.sort()
        for at in sorted(found):  # both in order: every phrase that begins at or before a word is passed once
            while k < len(spared) and spared[k][0] <= at:
                reach = max(reach, spared[k][1])
                k += 1
            if at >= reach:
                total, hits = total + found[at], hits + 1
        return total, hits

    def score(self, weight: float, words: int) -> float:
        """0 to 1, rising with the weight found per word."""
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.b + self.a * density(weight, words)))))


def density(weight: float, words: int) -> float:
    """Weight in a thousand words, as a logarithm; every text counts as 60 words longer, so one hit in a short one is no proof."""
    return math.log1p(1000 * weight / (words + 60))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y) of the labelled ids that may be learned from; an id that is labelled repeatedly has its highest label."""
    return labels.where(F.col(id_col).isNotNull() & F.col(column).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.max(column).cast("int").alias("y"))


def sampled(docs: DataFrame, labels: DataFrame, column: str, ones: int, zeros: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of at most so many labelled ids of either class, those that hash lowest; held-out ids never.

    An id that stands in several rows counts once, with the least of its texts, so repeated rows don't swell the sample.
    """
    known = labelled(labels, column, id_col)
    first = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(n)
    chosen = first(1, ones).union(first(0, zeros)).select(F.col(id_col).alias("id"), "y")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    return rows.groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "y")


def terms_of(words: set[str]) -> set[str]:
    return words | {f"{w[:n]}*" for w in words for n in STEMS[: max(0, len(w) - STEMS[0])]}


def learn(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """The lexicon that labels.toxic teaches.

    Terms are whole words and beginnings of words. They are counted by class over a bounded sample, which is written once;
    from the candidates a small set is chosen greedily that accounts five times for every toxic row it can, so words that
    merely repeat along with copies of one toxic text find those rows accounted for. It ends where no term accounts for
    enough rows more. Weights are log odds; the score's two coefficients follow from the same rows by logistic regression,
    set back to the share of toxic rows among all labelled ones. Without labels, or without telling terms, it is SEED.
    """
    rows = written(sampled(docs, labels, "toxic", toxic_rows, clean_rows, id_col, text_col).repartition(parallelism(docs.sparkSession)), "sample")

    def counted(batches):
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["term", "zeros", "ones"])

        for batch in batches:
            for text, y in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for term in terms_of(set(folded(text))):
                    seen[term][y] += 1
                if len(seen) > 300_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    counts = rows.mapInArrow(counted, "term string, zeros long, ones long").groupBy("term").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, zeros_all = sizes.get(1, 0), max(1, sizes.get(0, 0))
    least = max(2, toxic // LEAST)
    # all that could account for enough rows: what worth() adds for long terms is at most 0.4
    telling = counts.where("ones >= 2 and ones >= 4 * zeros").where(F.col("ones") - 3 * F.col("zeros") + 0.4 >= least).orderBy(F.desc("ones"), F.length("term"), "term").collect()
    if not telling:
        dropped(rows)
        return Lexicon(dict.fromkeys(SEED, 1.0), 3.0, -6.0)
    number = {r.term: i for i, r in enumerate(telling)}

    def met(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [sorted(number[t] for t in terms_of(set(folded(text))) if t in number) for text in texts(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], names=["terms"])

    # toxic rows with the same candidates count as one, as often as they stand: copies of a text take no more room than it
    has = rows.where("y = 1").mapInArrow(over_batches(met), "terms array<int>").groupBy("terms").agg(F.count(F.lit(1)).alias("n")).collect()
    holders: dict[int, list[int]] = defaultdict(list)
    for i, r in enumerate(has):
        for t in r.terms:
            holders[t].append(i)
    times, need, terms = [r.n for r in has], [5] * len(has), {}
    worth = lambda t: sum(times[i] for i in holders[t] if need[i] > 0) - 3 * telling[t].zeros - 0.5 * telling[t].term.endswith("*") + 0.01 * min(len(telling[t].term), 40)
    heap = [(-worth(t), t) for t in holders]
    heapq.heapify(heap)
    while heap:
        _, t = heapq.heappop(heap)
        now = worth(t)
        if heap and now < -heap[0][0]:
            if now > 0:
                heapq.heappush(heap, (-now, t))
            continue
        if now < least:
            break
        r = telling[t]
        if any(r.term.startswith(x.rstrip("*")) and x.endswith("*") or x.startswith(r.term.rstrip("*")) and r.term.endswith("*") for x in terms):
            continue  # one of the two accounts for the other's words
        terms[r.term] = math.log((r.ones + 0.5) / (toxic + 1)) - math.log((r.zeros + 1.5) / (zeros_all + 1))
        for i in holders[t]:
            need[i] -= 1
    lexicon = Lexicon(terms or dict.fromkeys(SEED, 1.0), 1.0, 0.0)

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, out = lexicon.automaton(), []
        for text in texts(batch.column(0)):
            words = folded(text)
            out.append(density(lexicon.weighed(automaton, words)[0], len(words)))
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.float64())], names=["y", "x"])

    seen = rows.mapInArrow(over_batches(measured), "y int, x double").collect()
    dropped(rows)
    x, y = np.array([r.x for r in seen]), np.array([r.y for r in seen], float)
    told = (y == 0) | (x > 0)  # what toxic rows without any term say is noise here
    x, y = x[told], y[told]
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    shares = {r.y: r.n for r in labelled(labels, "toxic", id_col).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    shift = math.log(shares[1] / shares[0]) - math.log(y.sum() / (len(y) - y.sum())) if shares.get(0) and 0 < y.sum() < len(y) else 0.0
    return Lexicon(terms, max(float(w[1]), 0.0), float(w[0]) + shift)


def scored(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits) for every row.

    Null and empty texts have no hits and the lowest score; rows that repeat or have a null id are scored like others. Long
    texts are read whole; the score goes by hits for a given number of words, not by their sum. An empty table gives no
    rows; other columns are not looked at.
    """

    def rated(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, scores, hits = lexicon.automaton(), [], []
        for text in texts(batch.column(1)):
            words = folded(text)
            weight, n = lexicon.weighed(automaton, words)
            scores.append(lexicon.score(weight, len(words)))
            hits.append(n)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], names=["doc_id", "score", "n_hits"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(over_batches(rated), "doc_id long, score double, n_hits long")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs less the rows that score the threshold or more, in the columns of docs."""
    at = docs.columns.index(text_col)

    def clean(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            if batch.num_rows:
                keep = []
                for text in texts(batch.column(at)):
                    words = folded(text)
                    keep.append(lexicon.score(lexicon.weighed(automaton, words)[0], len(words)) < threshold)
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)
