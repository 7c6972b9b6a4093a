"""Main text of HTML pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import math
import random
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import over_batches
from tidegrid.llm.html_blocks import ASIDE, COMMENTS, POOR, REPEATED, RICH, Block, blocks, steps
from tidegrid.llm.maxflow import minimum_cut
from tidegrid.llm.words import texts

#: Capacities are whole numbers: this many make a unit of cost. A block's own cost is at most MOST units.
UNIT, MOST = 1000, 8.0
#: Smoothness between neighbours on the page, and between blocks that follow each other in one element.
NEXT, SIBLING = 0.6, 1.0
#: Each step in the tree between two neighbours divides their smoothness.
STEP = 1.6
#: Blocks so many steps apart have no smoothness left.
FAR = 20
#: Generated pages that the block classifier is trained on.
PAGES, PAGE_SEED = 400, 7
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())


def features(all_blocks: list[Block]) -> np.ndarray:
    """What the classifier sees of each block of a page: where it stands, how much of it is links, how it reads."""
    out = np.zeros((len(all_blocks), 20))
    has_article = any("article" in b.tags or "main" in b.tags for b in all_blocks)
    longest = max((len(b.text) for b in all_blocks), default=1)
    for i, b in enumerate(all_blocks):
        tags, words, tag = b.tags, b.words, b.tag
        inner = "article" in tags
        lower = b.text.lower()
        out[i] = (
            1,
            inner,
            "main" in tags,
            has_article and not inner and "main" not in tags,
            bool(ASIDE & tags),
            "header" in tags and not inner,
            bool(POOR & words - (frozenset(("header", "body", "text")) if inner else frozenset())),
            bool(RICH & words) and not POOR & words,
            bool(COMMENTS & words),
            b.hidden,
            b.linked / len(b.text),
            math.log1p(len(b.text)) / 5,
            len(b.text) / longest,
            tag == "p",
            tag in HEADS,
            tag in ("li", "td", "dd"),
            sum(map(b.text.count, ".,;:!?")) / len(b.text) * 20,
            min(1.0, 40 * (lower.count("\u00a9") + lower.count("copyright")) / len(b.text)),
            REPEATED in words and not inner,
            REPEATED in words and inner,
        )
    return out


def page(rng: random.Random) -> str:
    """An invented page; text of the article is marked by U+E000 so that its blocks are known."""

    def words(low: int, high: int) -> str:
        s = " ".join("".join(rng.choice(("ka", "lo", "ren", "ti", "su", "mon", "e", "ar", "ish")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))
        return s.capitalize()

    def sentences(low: int, high: int) -> str:
        return " ".join(f"{words(4, 14)}." for _ in range(rng.randint(low, high)))

    def link() -> str:
        return f'<a href="/{rng.randint(1, 999)}">{words(1, 4)}</a>'

    def links() -> str:
        return f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(rng.randint(2, 9)))}</ul>" if rng.random() < 0.8 else " | ".join(link() for _ in range(rng.randint(2, 6)))

    def boxed(tag: str, names: tuple[str, ...], inside: str) -> str:
        return f"<{tag}>{inside}</{tag}>" if rng.random() < 0.6 else f'<div class="{rng.choice(names)}">{inside}</div>'

    def paragraph(mark: str) -> str:
        kind = rng.random()
        text = sentences(1, 6) if kind < 0.8 else words(2, 8)
        if rng.random() < 0.2:
            text += f" {link()} {words(2, 6)}."
        if kind > 0.93:
            return f"<ul>{''.join(f'<li>{mark}{words(3, 15)}</li>' for _ in range(rng.randint(2, 5)))}</ul>"
        if kind > 0.88:
            return f"<h2>{mark}{words(2, 7)}</h2>"
        if kind > 0.85:
            return f"<blockquote>{mark}{text}</blockquote>"
        return f"<p>{mark}{text}" + ("</p>" if rng.random() < 0.8 else "")

    advert = lambda: rng.choice((f'<div class="{rng.choice(("ad", "ads", "advert", "sponsored", "promo-box"))}">{rng.choice((sentences(1, 2), words(3, 9), link()))}</div>', ""))
    bare = lambda inside: rng.choice((inside, f"<div>{inside}</div>"))
    menu = boxed("nav", ("nav", "menu", "main-menu", "breadcrumb"), links()) if rng.random() < 0.85 else bare(links())
    header = boxed("header", ("header", "masthead", "site-header"), f"<div>{words(1, 4)}</div>{links() if rng.random() < 0.5 else ''}<p>{words(2, 8)}</p>") if rng.random() < 0.5 else ""
    side = boxed("aside", ("sidebar", "widget", "related"), f"<h3>{words(1, 3)}</h3>{rng.choice((links(), f'<p>{sentences(1, 3)}</p>'))}") if rng.random() < 0.5 else ""
    notice = f'<div class="{rng.choice(("cookie-banner", "cookie-notice", "notice", "consent", "newsletter"))}"><p>{sentences(1, 2)}</p></div>' if rng.random() < 0.4 else ""
    form = f"<form><label>{words(1, 3)}</label><input><p>{words(2, 8)}</p></form>" if rng.random() < 0.4 else ""
    odd = lambda: "-".join("".join(rng.choice(("zu", "pem", "ral", "oki", "vex")) for _ in range(2)) for _ in range(rng.randint(1, 2)))
    one, many = odd(), rng.randint(2, 5)
    reader = lambda: rng.choice((f'<span>{words(1, 2)}</span><p>{sentences(1, 4)}</p>', f'<p>{sentences(1, 4)}</p>', f'<h4>{words(1, 2)}</h4><div>{sentences(1, 3)}</div>'))
    unnamed = f'<div class="{odd()}">{"".join(f"<div class={chr(34)}{one}{chr(34)}>{reader()}</div>" for _ in range(many))}</div>' if rng.random() < 0.3 else ""
    comments = f'<{"section" if rng.random() < 0.5 else "div"} {rng.choice(("class", "id"))}="comments"><h3>{words(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{sentences(1, 4)}</p></div>' for _ in range(rng.randint(1, 5))) + "</section></div>" if rng.random() < 0.5 else ""
    rights = lambda: rng.choice((f"&copy; {words(1, 3)} &middot; {rng.choice((sentences(1, 2), links()))}", f"Copyright {rng.randint(1990, 2030)} {words(1, 3)}. {rng.choice(('All rights reserved.', ''))}"))
    footer = boxed("footer", ("footer", "site-footer"), rights()) if rng.random() < 0.85 else bare(f"<p>{rights()}</p>")
    mark = "\ue000"
    head = f"<h1>{mark}{words(2, 10)}</h1>"
    if rng.random() < 0.3:
        head = f'<div class="{rng.choice(("post-header", "entry-header", "article-header", "title", odd()))}">{head}{f"<h2>{mark}{words(3, 9)}</h2>" if rng.random() < 0.3 else ""}</div>'
    own, form_of = odd(), rng.random()

    def wrapped(text: str) -> str:
        """Paragraphs of one class, sections of one class, or plain ones, the same way all over a page."""
        if form_of < 0.1:
            return f'<div class="{own}">{mark}{sentences(1, 6)}</div>'
        if form_of < 0.2:
            return f'<p class="{own}">{mark}{sentences(1, 6)}</p>'
        if form_of < 0.3:
            return f'<{rng.choice(("div", "section"))} class="{own}">{f"<h2>{mark}{words(2, 7)}</h2>" if rng.random() < 0.5 else ""}<p>{mark}{sentences(2, 6)}</p></div></section>'
        return text

    inside = head + "".join(wrapped(paragraph(mark)) + (advert() if rng.random() < 0.15 else "") for _ in range(rng.randint(1, 9)))
    if rng.random() < 0.15:
        inside += side + form
    if rng.random() < 0.2:
        inside += comments
        comments = ""
    shape = rng.random()
    if shape < 0.5:
        body = f"<article>{inside}</article>"
    elif shape < 0.65:
        body = f"<main>{inside}</main>"
    elif shape < 0.85:
        body = f'<div class="{rng.choice(("content", "post", "entry-content", "article-body", "story"))}">{inside}</div>'
    else:
        body = f"<div>{inside}</div>"
    parts = [header, menu, notice, advert(), body, advert(), side, form, comments, unnamed, footer]
    if rng.random() < 0.3:
        parts[0], parts[1] = parts[1], parts[0]
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{''.join(parts)}</body></html>"


@cache
def trained(pages: int = PAGES, seed: int = PAGE_SEED) -> tuple[float, ...]:
    """Weights of a logistic block classifier, fitted on generated pages; the same at every call."""
    rng = random.Random(seed)
    rows, marks = [], []
    for _ in range(pages):
        found = blocks(page(rng))
        marks += ["\ue000" in b.text for b in found]
        for b in found:
            b.text = b.text.replace("\ue000", "") or " "
        rows.append(features(found))
    x, y = np.concatenate(rows), np.array(marks, float)
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w)), x.T @ (y - p) - 0.3 * w)
        w += np.clip(step, -1, 1)
        if abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def labelled(found: list[Block], weights: tuple[float, ...]) -> list[bool]:
    """Which blocks are main text: the cheapest labelling by the classifier's costs and the smoothness between blocks."""
    if not found:
        return []
    margin = np.clip(features(found) @ np.array(weights), -30, 30)
    content = np.minimum(np.logaddexp(0, -margin), MOST)  # cost of calling it main text
    rest = np.minimum(np.logaddexp(0, margin), MOST)
    edges, last = [], {}
    for j, b in enumerate(found):
        if j:
            edges.append((j - 1, j, int(UNIT * NEXT / STEP ** steps(found[j - 1].inside, b.inside, FAR))))
        around = b.inside.above if b.inside else None
        if around is not None:
            if id(around) in last:
                edges.append((last[id(around)], j, int(UNIT * SIBLING / STEP)))
            last[id(around)] = j
    return minimum_cut((UNIT * rest).astype(int).tolist(), (UNIT * content).astype(int).tolist(), edges)


def main_text(markup: str | None, weights: tuple[float, ...] | None = None) -> str:
    found = blocks(markup)
    return "\n".join(b.text for b, keep in zip(found, labelled(found, weights or trained()), strict=True) if keep)


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    A null page, an empty one and one without main text have the empty text. Rows that repeat or have null ids or urls are
    extracted like others; text of any length is kept whole, elements may be nested to any depth. An empty
    table gives no rows; other columns are not looked at. n_chars counts code points.
    """
    weights = trained()

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [main_text(x, weights) for x in texts(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string"), F.col(html_col).alias("html"))
    return rows.mapInArrow(over_batches(read), "page_id long, url string, text string, n_chars long")
