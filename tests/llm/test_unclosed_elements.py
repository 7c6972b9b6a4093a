import pytest

from tidegrid.llm.html_blocks import DROPPED, RAW, blocks


def words(page):
    return " ".join(b.text for b in blocks(page)).split()


@pytest.mark.parametrize("tag", sorted(DROPPED - RAW))
def test_unclosed_elements_drop_nothing_else(tag):
    article = "<article><p>The whole article.</p></article>"
    assert words(f"<div><{tag}></div>{article}") == ["The", "whole", "article."]
    assert words(f"<div><{tag} class=x></div>{article}<{tag}>gone</{tag}><p>End</p>") == ["The", "whole", "article.", "End"]
    assert words(f"<{tag}>gone <b>too</b></{tag}>{article}") == ["The", "whole", "article."]
    assert words(f"<{tag}/>{article}") == ["The", "whole", "article."]


def test_raw_text_reaches_to_the_end():
    assert words("<p>Here</p><script>var a = '<p>no</p>'") == ["Here"]
    assert words("<button>gone<script>'</button>'</script> too</button><p>Here</p>") == ["Here"]
