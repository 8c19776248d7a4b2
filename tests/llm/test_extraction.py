import html as entities
import re
import time

import pytest

from quillspark.llm import extraction
from quillspark.llm.common import table

LONG = "The one of the and it is a long enough paragraph of the text to be decided by its stop words."


def test_articles_of_the_pages(spark):
    """On generated pages the text is the article, block by block."""
    for row in table(spark, "/root/testdata/sf0.01", "pages").collect():
        m = re.search(r"<article>(.*?)(?:</article>|$)", row.html, re.S)
        parts = re.split(r"</?(?:p|h1)>", m[1] if m else "")
        texts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>|<[^>]*$", "", p.replace("<br>", " ")))).strip() for p in parts]
        assert extraction.main_text(row.html) == "\n".join(t for t in texts if t)


def test_what_is_not_text_goes():
    page = f"""<body><header><div>Site</div></header><nav><ul><li><a href=x>Menu</a></ul></nav><div id="cookieNotice">We use cookies, and {LONG}</div>
    <div class="side-bar widget">{LONG}</div><main><article class="post"><header class="entry-header"><h1>A&nbsp;title &amp; more</h1></header><p>Short.
    <p>{LONG}<div class="share">Share this</div><p>End.</p><form><p>{LONG}</p></form><script>var x = "</p><p>no";</script></article>
    <section class="comments"><p>{LONG}</p></section></main><aside>{LONG}</aside><footer><p>{LONG}</p></footer>"""
    assert extraction.main_text(page) == f"A title & more\nShort.\n{LONG}\nEnd."


def test_short_blocks_take_their_neighbours_label():
    page = f"<body><div><p>{LONG}</p><p>So.</p><p>{LONG}</p></div><div><p><a href=a>One link here</a></p><p>Hm</p><p><a href=b>Another link here</a></p></div></body>"
    assert extraction.main_text(page) == f"{LONG}\nSo.\n{LONG}"


def test_link_density():
    assert extraction.main_text(f"<article><p>{LONG}</p><p><a href=x>{LONG}</a></p></article>") == LONG


def test_anchors_round_blocks():
    page = f"<article><p>{LONG}</p><a href=x><div>{LONG}</div><p>{LONG}</p></a><p>{LONG} End.</p></article>"
    assert extraction.main_text(page) == f"{LONG}\n{LONG} End."
    # an anchor that isn't closed ends with what it is in
    page = f"<article><p>{LONG}</p><div><p>See <a href=x>this</p></div><p>{LONG} End.</p></article>"
    assert extraction.main_text(page) == f"{LONG}\nSee this\n{LONG} End."
    page = f"<article><p>{LONG}</p><section><a href=x>More</section><p>{LONG} End.</p></article>"
    assert extraction.main_text(page).endswith("End.")


@pytest.mark.parametrize("name", ["div", "article", "section", "blockquote", "a", "b"])
def test_deep_pages(name):
    n = 100_000
    page = f"<{name}>" * n + f"<p>{LONG}</p>" + f"</{name}>" * n + "</td>" * n + f"<p>{LONG} End.</p>"
    began = time.time()
    got = extraction.main_text(page)
    assert time.time() - began < 20 and got.endswith(f"{LONG} End.")


def test_edges(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, "<article><p>" + "a &am", "u"), (4, "<p>" + "<b>" * 20_000 + LONG, "u"), (5, "just text", "u"), (5, '<a href="x', "u")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    out = {(r.page_id, r.n_chars): r.text for r in extraction.extracted(pages).collect()}
    assert len(out) == 6
    assert out[1, 0] == out[2, 0] == "" and out[3, 5] == "a &am" and out[4, len(LONG)] == LONG and out[5, 9] == "just text"
    assert extraction.extracted(pages.where("false")).count() == 0


def test_svg_and_math_in_an_article():
    page = f'<article><p>{LONG}</p><svg class="i" viewBox="0 0 1 1"/><p>{LONG} So is <math><mi>x</mi></math> too.</p><svg><text>no</text></svg><math/><p>{LONG} End.</p></article>'
    assert [b.text for b in extraction.blocks(page)] == [LONG, f"{LONG} So is x too.", f"{LONG} End."]
