"""Quality rules: exact text statistics, base rules, and boosted trees over the statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.boosted_trees import Trees, fit
from tidegrid.llm.common import over_batches
from tidegrid.llm.words import texts

#: Labelled rows of either class that the trees are fitted on, at most.
GOOD_ROWS, BAD_ROWS = 9000, 6000
WINDOW = 8
FEWEST_WORDS, MOST_REPEATED = 20, 30
#: A document goes only if the trees give it less than this chance of being good.
LEAST_CHANCE = 0.5
SPACE = " \t\n\x0b\x0c\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the trees, and how the chance of being good may move as each grows.
FEATURES = {"symbols_a_word": -1, "symbol_words": -1, "dup_lines": -1, "repeat_words": -1, "capital_letters": -1, "top_word": -1, "same_as_next": -1, "letters": 1, "digits": 0, "word_length": 0, "distinct_words": 0, "words_a_line": 0, "log_words": 0, "ended_lines": 0, "exclaimed": -1}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of so many words (a power of two) that the text has twice or more, exactly."""
    if len(words) < window + 1:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) > len(words) - 1:
        return 0
    step = 1
    while step < window:  # numbers of ever longer windows; equal numbers mean equal words
        _, ids = np.unique(ids[:-step] * (len(words) + 1) + ids[step:], return_inverse=True)
        step *= 2
    found = np.bincount(ids)[ids] > 1
    covers = np.zeros(len(words) + 1, np.int64)
    covers[: len(found)] += found
    covers[window : window + len(found)] -= found
    return int((covers.cumsum()[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five base statistics of a text and the features of the trees."""
    text = text or ""
    words = text.encode().split()  # bytes: only \\x20 and \\x09-\\x0d separate
    n = len(words)
    seen: set[str] = set()
    lines = dups = ended = 0
    for line in text.split("\n"):
        bare = line.strip(SPACE)
        if bare:
            lines += 1
            dups += line in seen
            ended += bare[-1] in ".!?;:\"'"
            seen.add(line)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, "#*$%&|<>"))
    repeats = repeated_words(words)
    base = [n, chars, symbols, dups, repeats]
    if not n:
        return base, [0.0] * len(FEATURES)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    capitals = sum(c.isupper() for c in text)
    letters = sum(map(str.isalpha, text))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marked = sum(w[-1] in b"#*$%&|<>" for w in words)
    digits = sum(map(text.count, "0123456789"))
    features = [symbols / n, marked / n, dups / max(lines, 1), repeats / n, capitals / max(letters, 1), max(counts.values()) / n, same / n, letters / max(chars, 1), digits / max(chars, 1), chars / n, len(counts) / n, n / max(lines, 1), np.log1p(n), ended / max(lines, 1), text.count("!") / n]
    return base, [float(x) for x in features]


def base_failed(base: list[int]) -> bool:
    return base[0] < FEWEST_WORDS or 100 * base[4] > MOST_REPEATED * base[0]


def learn(docs: DataFrame, labels: DataFrame, good_rows: int = GOOD_ROWS, bad_rows: int = BAD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees | None:
    """Trees for the chance that labels.quality is 1, from a bounded sample of labelled ids (those that hash lowest).

    An id that stands in several rows counts once, with the least of its texts, so repeated rows don't swell the sample.
    The sample is balanced otherwise than the labels; the trees' base is set back to the labels' own share. None where
    either class is missing: then only the base rules decide.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isin(0, 1)).groupBy(id_col).agg(F.min("quality").cast("int").alias("y"))
    shares = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares.get(0) or not shares.get(1):
        return None
    first = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(n)
    chosen = first(1, good_rows).union(first(0, bad_rows)).select(F.col(id_col).alias("id"), "y")

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([statistics(t)[1] for t in texts(batch.column(0))], pa.list_(pa.float64()))], names=["y", "x"])

    texts_of = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = texts_of.select("text", "y").mapInArrow(over_batches(measured), "y int, x array<double>").collect()
    if len({r.y for r in rows}) < 2:
        return None
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows], float)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    out = fit(x, y, list(FEATURES.values()))
    out.base += float(np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return out


def judged(docs: DataFrame, trees: Trees | None, least: float = LEAST_CHANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, chance) for every row.

    A null text has no words, like an empty one, and fails the base rules. Rows that repeat or have a null id are judged like
    others, an empty table gives no rows. Texts of any length are read whole; other columns are not looked at. chance is the
    trees' (1 where there are none).
    """

    def rated(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(t) for t in texts(batch.column(1))]
        base = [b for b, _ in found]
        chance = np.ones(len(found)) if trees is None else trees.probability(np.array([x for _, x in found]))
        failed = np.array([base_failed(b) for b in base])
        columns = [pa.array([b[i] for b in base], pa.int64()) for i in range(len(BASE))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(failed), pa.array(~failed & (chance >= least)), pa.array(chance)], names=["doc_id", *BASE, "base_failed", "kept", "chance"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(over_batches(rated), f"doc_id long, {' long, '.join(BASE)} long, base_failed boolean, kept boolean, chance double")


def kept(docs: DataFrame, trees: Trees | None, least: float = LEAST_CHANCE, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass the base rules and the trees, in the columns of docs."""
    at = docs.columns.index(text_col)

    def passed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(t) for t in texts(batch.column(at))]
        chance = np.ones(len(found)) if trees is None else trees.probability(np.array([x for _, x in found]))
        return batch.filter(pa.array([bool(c >= least) and not base_failed(b) for (b, _), c in zip(found, chance, strict=True)]))

    return docs.mapInArrow(over_batches(passed), docs.schema)
