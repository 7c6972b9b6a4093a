"""Pages that the operator's own generator has not made."""

import pyarrow.parquet as pq
import pytest

from tidegrid.llm.html_blocks import blocks
from tidegrid.llm.html_extract import main_text

PARTS = [f"The {k} paragraph tells, at some length, what happened on that day, and why it did." for k in ("first", "second", "third", "fourth", "fifth")]
BODY = "".join(f"<p>{x}</p>" for x in PARTS)
LINKS = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>About us</a></li></ul>"
TEXT = "\n".join(["A head line here", *PARTS])
PAGES = {
    "divs": (f"<html><body><div id=nav>{LINKS}</div><div id=content><h1>A head line here</h1>{BODY}</div><div id=footer>&copy; 2020 Site</div></body></html>", TEXT),
    "no names": (f"<html><body>{LINKS}<div><h1>A head line here</h1>{BODY}</div><div>Copyright 2020 Some Site. All rights reserved.</div></body></html>", TEXT),
    "aside": (f"<body><header><h1>Site name</h1></header><main><h1>A head line here</h1>{BODY}</main><aside><h3>Related</h3>{LINKS}</aside><div class='newsletter'><p>Subscribe to our letter today.</p><form><input></form></div></body>", TEXT),
    "comments": (f"<body><article><h1>A head line here</h1>{BODY}<section id=comments><h2>Comments</h2><div class=comment><p>I like this a lot, thanks.</p></div><div class=comment><p>Me too.</p></div></section></article></body>", TEXT),
    "advert": (f"<body><article><h1>A head line here</h1><p>{PARTS[0]}</p><div class=ad>Buy now, cheap things for you.</div>{BODY.replace(f'<p>{PARTS[0]}</p>', '')}</article></body>", TEXT),
    "list and table": (f"<body><nav>{LINKS}</nav><article><h1>A head line here</h1>{BODY}<ul><li>One thing to know</li><li>Another thing to know</li></ul><table><tr><td>One</td><td>Two</td></tr></table></article></body>", f"{TEXT}\nOne thing to know\nAnother thing to know\nOne\nTwo"),
    "short": (f"<body><nav>{LINKS}</nav><article><h1>Short</h1><p>Yes.</p></article><footer>x</footer></body>", "Short\nYes."),
    "one class": (f"<body><article>{''.join(f'<div class=para>{x}</div>' for x in PARTS)}</article></body>", "\n".join(PARTS)),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    assert main_text(PAGES[name][0]) == PAGES[name][1]


def test_given_pages():
    """What stands in the article of the given pages, all of it and nothing else."""
    for r in pq.read_table("/root/testdata/sf0.1/pages.parquet").to_pylist():
        assert main_text(r["html"]) == "\n".join(b.text for b in blocks(r["html"]) if "article" in b.tags), r["page_id"]
