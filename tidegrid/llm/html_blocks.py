"""Text blocks of HTML pages with what surrounds them, from one pass over the tags."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements whose content is no text of the page.
DROPPED = frozenset("script style template noscript title iframe object svg math canvas audio video select textarea button datalist".split())
#: Of these, whose content is raw text: without an end tag they reach to the end of the page.
RAW = frozenset("script style title textarea iframe".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key closes an open element of these first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where that search for an open element ends.
KEPT = frozenset("ul ol dl table body article section div nav aside main".split())
#: Words of class, id and role that tell what an element holds.
POOR = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot colophon sidebar side aside widget related recommended recommendations more trending popular cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search share sharing social comment comments respond reply replies discussion disqus toc pagination pager tags copyright legal skip contentinfo complementary toolbar outbrain taboola".split())
RICH = frozenset("article content main post entry story body text articlebody blog".split())
COMMENTS = frozenset("comment comments respond reply replies discussion disqus".split())
ASIDE = frozenset("nav footer aside form dialog menu search".split())
#: Stands among an element's words where it is one of several alike.
REPEATED = "*"
PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")


#: Of the elements around a block those that tell what it is, and the words of class, id and role that do.
TELLING_TAGS = frozenset("article main header".split()) | ASIDE
TELLING = POOR | RICH
#: A name that joins one of these to "header" is the head of an article, no site's: post-header, entry-header.
OWN = frozenset("post entry article story".split())


@dataclass(slots=True)
class Element:
    """An open or closed element; tags, words and hidden also hold what its ancestors have."""

    tag: str
    above: Element | None
    depth: int
    tags: frozenset[str]
    words: frozenset[str]
    hidden: bool
    look: str | None
    looks: dict[str, int]
    holds: int = 0


@dataclass(slots=True)
class Block:
    """A text block in its innermost element; None where it stands outside of all."""

    text: str
    inside: Element | None
    linked: int

    @property
    def tag(self) -> str:
        return self.inside.tag if self.inside else ""

    @property
    def tags(self) -> frozenset[str]:
        return self.inside.tags if self.inside else frozenset()

    @property
    def words(self) -> frozenset[str]:
        return self.inside.words if self.inside else frozenset()

    @property
    def hidden(self) -> bool:
        return self.inside is not None and self.inside.hidden


def steps(a: Element | None, b: Element | None, most: int) -> int:
    """Steps in the tree from one element to the other, or most, if there are as many."""
    n = 0
    while a is not b and n < most:
        if b is None or a is not None and a.depth >= b.depth:
            a = a.above
        else:
            b = b.above
        n += 1
    return n


def named_words(named: dict[str, str]) -> frozenset[str]:
    """The telling words of an element's class, id and role."""
    out: set[str] = set()
    for name in " ".join(named.get(k, "") for k in ("class", "id", "role")).split():
        words = set(PART.findall(CAMEL.sub(r"\1 \2", name).lower()))
        out |= words - {"header"} if words & OWN else words
    return frozenset(out & TELLING)


def closed(page: str) -> dict[int, int]:
    """Where the end tags begin of the elements of DROPPED that are no raw text and have one, by where their start tags end."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    at = 0
    while m := TAG.search(page, at):
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if tag not in DROPPED or (m[3] or m[6] or "").endswith("/"):
            continue
        if (m[1] or m[4]) == "/":
            if opened.get(tag):
                ends[opened[tag].pop()] = m.start()
        elif tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else len(page)
        else:
            opened.setdefault(tag, []).append(at)
    return ends


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page that have text, in page order: character references decoded, white space within them one blank.

    Comments, declarations, scripts and other elements without text of the page are left out. An element that is not
    closed ends with the one around it; an end tag without a start tag does nothing. Of an element without text of the
    page that is not closed only the tag is left out, unless its content is raw text (scripts, styles), which nothing else ends.
    """
    page = page or ""
    found: list[Block] = []
    stack: list[Element] = []
    opened: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are
    top: dict[str, int] = {}
    parts: list[str] = []
    at, links, linked = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, stack[-1] if stack else None, min(linked, len(text))))
            parts.clear()
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    def last(tags: frozenset[str] | set[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    def end(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop().tag].pop()

    lower, ends = "", None
    while m := TAG.search(page, at):
        said(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in DROPPED:
            if not closing and tag not in RAW:
                if not attributes.endswith("/"):
                    ends = closed(page) if ends is None else ends
                    at = ends.get(at, at)
                parts.append(" ")
            elif not closing and not attributes.endswith("/"):
                lower = lower or page.lower()
                to = lower.find(f"</{tag}", at) if len(lower) == len(page) else next((x.start() for x in re.compile(f"</{tag}", re.I).finditer(page, at)), -1)
                at = len(page) if to < 0 else to
                parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if opened.get(tag):
                end(opened[tag][-1])
            continue
        if stack and stack[-1].tag == "p":
            end(len(stack) - 1)
        if tag in CLOSES and (k := last(CLOSES[tag])) > last(KEPT):
            end(k)
        words, hidden, look = frozenset(), False, ""
        if attributes:
            named = {a.lower(): v.strip("\"'") for a, v in NAMED.findall(attributes)}
            if named:
                words = named_words(named)
                hidden = "hidden" in named and "aria-hidden" not in named or "display:none" in named.get("style", "").lower().replace(" ", "")
                look = f"{tag} {named['class']}" if named.get("class") else ""
        above = stack[-1] if stack else None
        if above:
            above.holds += 1
        around = (above.tags, above.words, above.hidden) if above else (frozenset(), frozenset(), False)
        tags = around[0] | {tag} if tag in TELLING_TAGS and tag not in around[0] else around[0]
        if look:
            looks = above.looks if above else top
            looks[look] = looks.get(look, 0) + 1
        opened.setdefault(tag, []).append(len(stack))
        stack.append(Element(tag, above, len(stack), tags, around[1] | words if not words <= around[1] else around[1], around[2] or hidden, look, {}))
    said(page[at:])
    flush()
    for e in {id(b.inside): b.inside for b in found if b.inside}.values():
        mark(e, top)
    return found


def mark(e: Element, top: dict[str, int]) -> None:
    """Puts REPEATED among the words of an element if it, or one around it, is one of several alike: of one tag and class
    within one element, with other elements inside. So are comments, cards and teasers, whatever they are called."""
    path = []
    while e is not None and e.look is not None:
        path.append(e)
        e = e.above
    repeated = e is not None and REPEATED in e.words
    for x in reversed(path):
        looks = x.above.looks if x.above else top
        repeated = repeated or bool(x.look) and x.holds > 0 and looks[x.look] > 1
        if repeated:
            x.words = x.words | {REPEATED}
        x.look = None  # done
