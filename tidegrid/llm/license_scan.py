"""Licence scans: a word n-gram classifier of paragraphs, with an unknown class, confirmed by templates."""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import over_batches
from tidegrid.llm.license_templates import NONE, TEMPLATES, UNKNOWN
from tidegrid.llm.words import texts

WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
CLASSES = ("none", "unknown", *TEMPLATES)
#: Templates of a single word: short names of licences.
NAMES = frozenset(t.lower() for v in TEMPLATES.values() for t in v if " " not in t)
GRAMS = 3
#: Invented examples of each class, and the share of them that calibrates instead of training.
EXAMPLES, CALIBRATING = 220, 0.25
#: Share of wrong answers among confident ones that the calibration aims at.
ERROR = 0.01
#: Words of a paragraph that are judged together, and up to which notices of one family in a paragraph are one.
REACH = 64
#: Paragraphs are parted by blank lines.
BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
#: What stands beside a notice is judged by itself from so many words on.
LEAST_WORDS = 4
#: Words right before or after a named licence that may be part of its notice.
BESIDE = 12
#: Shared word trigrams, of the shorter side, that confirm a family.
CONFIRMED = 0.6


def words_of(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def grams(words: list[str], known: set[str] | None = None) -> set[str]:
    """The n-grams of up to three words; of known words only, where those are given."""
    out = set()
    for i, w in enumerate(words):
        if known is not None and w not in known:
            continue
        out.add(w)
        for n in range(2, GRAMS + 1):
            if i + n > len(words) or known is not None and words[i + n - 1] not in known:
                break
            out.add(" ".join(words[i : i + n]))
    return out


def examples(seed: int = 11) -> list[tuple[str, int]]:
    """Invented paragraphs of every class: templates with words left out, put in and around, and sentences of none."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice(("ka", "lo", "ren", "ti", "su", "mon", "ar", "vel")) for _ in range(rng.randint(2, 4)))
    stray = [w for v in (*TEMPLATES.values(), UNKNOWN) for t in v for w in words_of(t)]  # alone they tell nothing
    out = []

    def blurred(text: str) -> str:
        words = text.split()
        if len(words) > 9 and rng.random() < 0.6:
            at = rng.randrange(len(words) - 7)
            words = words[at : at + rng.randint(8, len(words))]
        words = [w for w in words if rng.random() > 0.04]
        if rng.random() < 0.3:
            words = [*(name() for _ in range(rng.randint(1, 6))), *words]
        if rng.random() < 0.3:
            words = ["Copyright", str(rng.randint(1990, 2030)), name(), *words]
        return " ".join(words)

    for k, kind in enumerate(CLASSES):
        for _ in range(EXAMPLES * (8 if kind == "none" else 2 if kind == "unknown" else 1)):
            if kind == "none":
                made, share = rng.random(), rng.choice((0.0, 0.1, 0.3))
                common = lambda: rng.choice(("the", "of", "and", "to", "in", "is", "this", "with", "a", "are", "for", "by", name(), name(), name(), name())) if rng.random() >= share else rng.choice(stray)
                text = blurred(rng.choice(NONE)) if made < 0.3 else " ".join(common() for _ in range(rng.randint(1, 60)))
            elif kind == "unknown":
                text = blurred(rng.choice(UNKNOWN).format(name=name().capitalize(), n=rng.randint(1, 4)))
            else:
                text = blurred(rng.choice(TEMPLATES[kind]))
            out.append((text, k))
    rng.shuffle(out)
    return out


class Model:
    """Weights of every known n-gram for every class, a temperature, and the least confidence in a family."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, bias: np.ndarray, warmth: float, least: float):
        self.index, self.weights, self.bias, self.warmth, self.least = index, weights, bias, warmth, least
        self.known = {w for g in index for w in g.split()}
        self.paired = np.array([" " in g or g in NAMES for g in sorted(index, key=index.get)], bool)

    def logits(self, words: list[str]) -> np.ndarray | None:
        """None without a known pair of words or a licence's short name: other single words tell nothing."""
        at = [self.index[g] for g in grams(words, self.known) if g in self.index]
        if not at or not self.paired[at].any():
            return None
        return self.bias + self.weights[at].sum(axis=0) / np.sqrt(len(at) + sum(w not in self.known for w in words))

    def probabilities(self, words: list[str]) -> np.ndarray:
        z = self.logits(words)
        if z is None:
            return np.eye(len(CLASSES))[0]
        z = z / self.warmth
        e = np.exp(z - z.max())
        return e / e.sum()

    def label(self, words: list[str]) -> tuple[str, float]:
        """A family only where the model is confident; less sure ones that are no plain text are unknown."""
        p = self.probabilities(words)
        k = int(p.argmax())
        if k == 0:
            return "none", float(p[0])
        if k == 1 or p[k] < self.least:
            return "unknown", float(1 - p[0])
        return CLASSES[k], float(p[k])


@cache
def trained(seed: int = 11) -> Model:
    """The classifier, fitted on invented paragraphs by gradient steps of falling size; the same at every call.

    The part of the examples that is kept back sets the temperature (least log loss) and the least confidence at which
    at most ERROR of the families named are wrong.
    """
    made = examples(seed)
    cut = int(len(made) * CALIBRATING)
    rest, train = made[:cut], made[cut:]
    counts: dict[str, int] = {}
    sets = [(grams(words_of(t)), k) for t, k in train]
    for g, _ in sets:
        for x in g:
            counts[x] = counts.get(x, 0) + 1
    index = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n >= 3))}
    known = {w for g in index for w in g.split()}
    rows = [(np.array([index[x] for x in sorted(g) if x in index], np.int64), sum(" " not in x and x not in known for x in g), k) for g, k in sets]
    weights, bias = np.zeros((len(index), len(CLASSES))), np.zeros(len(CLASSES))
    for epoch in range(15):
        rate = 1.5 / (1 + 0.5 * epoch)
        for at, strange, k in rows:
            scale = 1 / np.sqrt(len(at) + strange) if len(at) else 0
            z = bias + weights[at].sum(axis=0) * scale
            p = np.exp(z - z.max())
            p /= p.sum()
            p[k] -= 1
            bias -= rate * 0.1 * p
            weights[at] -= rate * scale * p + rate * 1e-4 * weights[at]
    model = Model(index, weights, bias, 1.0, 0.0)
    told = [(z, k) for t, k in rest if (z := model.logits(words_of(t))) is not None]
    logits, y = np.array([z for z, _ in told]), np.array([k for _, k in told])

    def loss(warmth: float) -> float:
        z = logits / warmth
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    model.warmth = min((0.2 * 1.15**i for i in range(24)), key=loss)
    z = logits / model.warmth
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best, sure = p.argmax(axis=1), p.max(axis=1)
    family = best > 1
    order = np.argsort(-sure[family])
    wrong = np.cumsum(best[family][order] != y[family][order]) / (np.arange(len(order)) + 1)
    fine = np.flatnonzero(wrong <= ERROR)
    model.least = max(0.5, float(sure[family][order][fine[-1]])) if len(fine) else 0.9
    return model


def trigrams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(3, max(1, len(words)))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@cache
def shapes() -> dict[str, list[set[tuple[str, ...]]]]:
    return {k: [trigrams(words_of(t)) for t in v] for k, v in TEMPLATES.items()}


def likeness(words: list[str], family: str) -> float:
    """The largest share of trigrams, of the smaller side, that a paragraph has in common with a template of the family."""
    own = trigrams(words)
    return max((len(own & t) / max(1, min(len(own), len(t))) for t in shapes().get(family, ())), default=0.0)


def matched(words: list[str], family: str) -> tuple[int, int]:
    """From where to where words have trigrams in common with the template of the family that they are most like; all if none."""
    own = trigrams(words)
    shape = max(shapes().get(family, [set()]), key=lambda t: len(own & t) / max(1, min(len(own), len(t))))
    n = min(3, max(1, len(words)))
    at = [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in shape]
    return (at[0], at[-1] + n) if at else (0, len(words))


def notices(words: list[str], model: Model) -> list[tuple[int, int, str, float, float]]:
    """(begin, end, family, probability, likeness) of the notices of a paragraph's words, in order.

    The stretch most like a template is taken with the words that it shares with it, then what stands before and after is
    judged by itself in the same way, so licences that are named next to each other are all found.
    """
    todo, out = [(0, len(words))], []
    while todo:
        a, b = todo.pop()
        best = None
        for at in range(a, max(a + 1, b - REACH // 2), REACH // 2):  # long paragraphs in overlapping stretches
            part = words[at : min(b, at + REACH)]
            family, p = model.label(part)
            if family != "none":
                found = (likeness(part, family), p, family, at, at + len(part))
                best = max(best or (-1.0,), found)
        if not best:
            continue
        alike, p, family, begin, end = best
        if alike >= CONFIRMED:
            x, y = matched(words[begin:end], family)
            begin, end = begin + x, begin + y
        out.append((begin, end, family, p, alike))
        todo += [(x, y) for x, y in ((a, begin), (end, b)) if y - x >= LEAST_WORDS]
    merged: list[tuple[int, int, str, float, float]] = []
    for begin, end, family, p, alike in sorted(out):
        last = merged[-1] if merged else None
        near = last and begin - last[1] < LEAST_WORDS
        # what stands before or after a named licence is part of its notice, if both together still read as that licence
        short = near and "unknown" in (last[2], family) and (last[1] - last[0] if last[2] == "unknown" else end - begin) <= BESIDE
        if short and last[2] != family and model.label(words[last[0] : end])[0] == max(last, (begin, end, family, p, alike), key=lambda x: x[4])[2]:
            family = last[2] if family == "unknown" else family
            last = (*last[:2], family, *last[3:])
        if near and last[2] == family:
            kept = max((last[4], last[3]), (alike, p))
            merged[-1] = (last[0], end, family, kept[1], kept[0])
        else:
            merged.append((begin, end, family, p, alike))
    return merged


def paragraph_notices(paragraph: str, model: Model) -> list[tuple[int, int, str, float, float]]:
    """notices() of a paragraph, whose lines may be parts of one sentence or stand for themselves.

    What the whole has in common with a template, over line ends, is taken first; what is left is judged line by line.
    Notices of one family with no other between them and less than REACH words apart are one.
    """
    lines = [words_of(x) for x in paragraph.split("\n")]
    words = [w for x in lines for w in x]
    if len(lines) == 1:
        found = notices(words, model)
    else:
        found = [x for x in notices(words, model) if x[4] >= CONFIRMED]
        taken = np.zeros(len(words) + 1, bool)
        for begin, end, *_ in found:
            taken[begin:end] = True
        at = 0
        for line in lines:
            begin = at
            while begin < at + len(line):
                if taken[begin]:
                    begin += 1
                    continue
                end = begin
                while end < at + len(line) and not taken[end]:
                    end += 1
                if end - begin == len(line) or end - begin >= LEAST_WORDS:
                    found += [(begin + a, begin + b, *rest) for a, b, *rest in notices(words[begin:end], model)]
                begin = end
            at += len(line)
    merged: list[tuple[int, int, str, float, float]] = []
    for begin, end, family, p, alike in sorted(found):
        last = merged[-1] if merged else None
        if last and last[2] == family and begin - last[1] < REACH:
            kept = max((last[4], last[3]), (alike, p))
            merged[-1] = (last[0], max(end, last[1]), family, kept[1], kept[0])
        else:
            merged.append((begin, end, family, p, alike))
    return merged


def findings(text: str | None, model: Model) -> list[tuple[int, str, float, float, bool]]:
    """(paragraph, family, probability, likeness, confirmed) of every licence notice of a text's paragraphs, in order."""
    return [(i, family, p, alike, alike >= CONFIRMED) for i, paragraph in enumerate(BLANK.split(text or "")) for _, _, family, p, alike in paragraph_notices(paragraph, model)]


FOUND = "array<struct<paragraph: int, family: string, probability: double, likeness: double, confirmed: boolean>>"


def scanned(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, found): for every row its licence notices, by paragraph from 0; blank lines part paragraphs.

    A null or empty text has no notices and no paragraphs; one without blank lines is a single paragraph, read whole however
    long. Rows that repeat or have a null id are scanned like others, other columns are not looked at. An empty table gives
    no rows.
    """
    model = model or trained()
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64()), ("confirmed", pa.bool_())]))
    names = ("paragraph", "family", "probability", "likeness", "confirmed")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(names, x, strict=True)) for x in findings(t, model)] for t in texts(batch.column(1))]
        many = [0 if not t else len(BLANK.split(t)) for t in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(many, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_paragraphs", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(over_batches(read), f"doc_id long, n_paragraphs long, found {FOUND}")


def summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, n_notices, n_confirmed, n_unknown, families): confirmed families sorted, joined by commas."""
    found = scanned(docs)
    of = lambda test: F.size(F.filter("found", test)).cast("long")
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("found").cast("long").alias("n_notices"),
        of(lambda x: x["confirmed"]).alias("n_confirmed"),
        of(lambda x: x["family"] == "unknown").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda x: x["confirmed"]), lambda x: x["family"]))), ",").alias("families"),
    )
