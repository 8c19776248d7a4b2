"""Layouts that the generated pages don't have: wrappers, comments, sidebars, other languages, labelled by hand."""

import pytest

from quillspark.llm import extraction

EN = "The one of the and it is a long enough paragraph of the text to be decided by its stop words, as it is in a book."
EN2 = "It was in the morning that she came to the house by the sea, and there was not a sound from the rooms of it."
RU = "Утром она пришла в дом у моря, и в комнатах не было слышно ни звука, как это бывает летом, когда все уходят."
ZH = "清晨她来到海边的房子，屋里静悄悄的，没有一点声音，就像夏天大家都出门以后那样。她在窗前站了很久，看着远处的船慢慢地驶过。"
JA = "朝早く、彼女は海辺の家に着いた。部屋の中は静かで、夏に誰もいなくなったあとのようだった。窓の前に長いあいだ立っていた。"
IT = "La mattina arrivò alla casa sul mare, e nelle stanze non si sentiva alcun rumore, come d'estate quando tutti escono insieme."
PL = "Rano przyszła do domu nad morzem, a w pokojach nie było słychać żadnego dźwięku, jak latem, kiedy wszyscy wychodzą z domu."
FI = "Aamulla hän tuli merenrannan taloon, eikä huoneista kuulunut ääntäkään, aivan kuten kesällä, kun kaikki lähtevät ulos."
AD = "This is the offer of the day for all of you who want to buy it now and not to wait for the end of the year."
NAV = '<ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li><li><a href="/c">Contact</a></li></ul>'
TEASER = f"<article><h3>Other story</h3><p>{AD}</p></article>"


def body(*parts):
    return "<html><head><title>T</title></head><body>" + "".join(parts) + "</body></html>"


def page(inner, before="", after=""):
    return body(f"<nav>{NAV}</nav>", before, inner, after, "<footer><p>© 2024 The company and all of the rights that it has in the text of the pages.</p></footer>")


TEXT = f"<h1>A headline</h1><p>{EN}</p><p>Short one.</p><p>{EN2}</p>"
WANT = f"A headline\n{EN}\nShort one.\n{EN2}"

LAYOUTS = {
    # reader comments and sidebars keep apart what is in them
    "comments after the article": (page(f"<article>{TEXT}</article>", after=f'<section id="comments"><article><p>{AD}</p></article><article><p>{EN2}</p></article></section>'), WANT),
    "comments in the article": (page(f'<article>{TEXT}<section class="comments"><article class="c"><p>{AD}</p></article></section></article>'), WANT),
    "comments longer than the article": (page(f"<article>{TEXT}</article>", after=f'<div class="comment-list">{f"<p>{AD}</p>" * 30}</div>'), WANT),
    "comments without an article": (page(f"<div>{TEXT}</div>", after=f'<div id="disqus_thread">{f"<p>{AD}</p>" * 9}</div>'), WANT),
    "replies in main": (page(f'<main>{TEXT}<div id="respond"><h3>Leave a reply</h3><p>{AD}</p></div></main>'), WANT),
    "sidebar with an article": (page(f"<article>{TEXT}</article>", before=f'<div class="sidebar">{TEASER}</div>'), WANT),
    "related in aside": (page(f'<article>{TEXT}<aside class="related">{TEASER}{TEASER}</aside></article>'), WANT),
    "related in main": (page(f'<main><article>{TEXT}</article><div class="related-posts">{TEASER * 5}</div></main>'), WANT),
    "article named as an advert": (page(f"<article>{TEXT}</article>", after=f'<article class="ad sponsored"><p>{AD}</p></article>'), WANT),
    "sidebar longer than the article": (page(f"<div><h1>A headline</h1><p>{EN}</p></div>", after=f'<div class="sidebar">{f"<p>{AD}</p>" * 20}</div>'), f"A headline\n{EN}"),
    "newsletter in the article": (page(f'<article><h1>A headline</h1><p>{EN}</p><div class="newsletter-signup"><p>{AD}</p></div><p>Short one.</p><p>{EN2}</p></article>'), WANT),
    "hidden parts": (page(f'<article>{TEXT}<div hidden><p>{AD}</p></div><div style="display: none"><p>{AD}</p></div></article>'), WANT),
    "parts named as containers": (page(f'<div class="main-wrapper"><article>{TEXT}</article><div class="sidebar-wrapper"><p>{AD}</p></div><div class="ad-container"><p>{AD}</p></div><div class="comments-container"><p>{AD}</p></div></div>'), WANT),
    "parts named as containers, without an article": (page(f'<div class="page-wrap">{TEXT}<div class="related-grid"><p>{AD}</p></div><div class="cookie-container"><p>{AD}</p></div></div>'), WANT),
    # wrappers with the names of parts
    "content with-sidebar": (page(f'<div class="content with-sidebar">{TEXT}</div>'), WANT),
    "layout of two columns": (page(f'<div class="layout sidebar-right"><div class="col">{TEXT}</div><div class="sidebar"><p>{AD}</p></div></div>'), WANT),
    "article with a state": (page(f'<article class="post comments-open menu-closed">{TEXT}</article>'), WANT),
    "layout by sidebar": (page(f'<div class="sidebar-layout"><div class="column">{TEXT}</div><div class="sidebar"><p>{AD}</p></div></div>'), WANT),
    "page has-banner": (page(f'<div id="page" class="has-banner"><div class="banner"><p>{AD}</p></div><main>{TEXT}</main></div>'), WANT),
    "widget round an article": (page(f'<div class="widget widget-article"><article>{TEXT}</article></div>'), WANT),
    "social wrapper": (page(f'<div class="social"><div class="inner">{TEXT}</div></div>'), WANT),
    "promo round all without a headline": (page(f'<div class="promo"><p>{EN}</p><p>{EN2}</p></div>'), f"{EN}\n{EN2}"),
    "a form round the page": (body(f'<form id="aspnetForm"><div class="menu">{NAV}</div><div>{TEXT}</div><label>Name</label><select><option>x</select></form>'), WANT),
    "a form round main": (body(f'<form method="post"><nav>{NAV}</nav><main>{TEXT}</main><footer><p>{AD}</p></footer></form>'), WANT),
    "a form below the text": (page(f"<div>{TEXT}</div>", after=f"<form><p>{AD}</p><label>Your name</label><button>Send</button></form>"), WANT),
    "aside round the text": (page(f'<aside><div>{TEXT}</div></aside>'), WANT),
    "a footer that holds the article": (body(f'<div class="footer-bottom page"><article>{TEXT}</article></div>'), WANT),
    # no article element
    "plain divs": (page(f'<div id="c"><div>{TEXT}</div></div>'), WANT),
    "a table": (page(f"<table><tr><td>{NAV}</td><td>{TEXT}</td></tr></table>"), WANT),
    "line breaks": (page(f"<div>{EN}<br><br>{EN2}</div>"), f"{EN} {EN2}"),
    "short paragraphs only": (body("<div><h1>Haiku</h1><p>An old pond.</p><p>A frog jumps in.</p></div>"), "Haiku\nAn old pond.\nA frog jumps in."),
    "a cookie notice": (page(f"<div>{TEXT}</div>", before=f'<div id="cookie-consent" role="dialog"><p>{AD}</p></div>'), WANT),
    "rights at the end": (body(f"<div>{TEXT}</div><div>© 2024 Someone</div>"), WANT),
    # other languages
    "Russian": (page(f"<div><h1>Дом</h1><p>{RU}</p><p>Да.</p></div>"), f"Дом\n{RU}\nДа."),
    "Chinese": (page(f"<div><h1>海边</h1><p>{ZH}</p><p>是。</p></div>"), f"海边\n{ZH}\n是。"),
    "Japanese": (page(f'<div class="content with-sidebar"><p>{JA}</p></div>'), JA),
    "Italian": (page(f"<div><p>{IT}</p><p>Sì.</p></div>"), f"{IT}\nSì."),
    "Polish": (page(f"<div><p>{PL}</p></div>"), PL),
    "Finnish, of which no word is listed": (page(f"<div><p>{FI}</p></div>"), FI),
    "Chinese with comments": (page(f'<div><p>{ZH}</p></div><div id="comments"><p>{ZH}</p></div>'), ZH),
    "a thread of replies only": (body(f'<div class="reply"><p>{EN}</p></div><div class="reply"><p>{EN2}</p></div>'), f"{EN}\n{EN2}"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    html, want = LAYOUTS[name]
    assert extraction.main_text(html) == want


def test_long_chains_of_marked_elements_take_linear_time():
    import time

    n = 60_000
    html = '<div class="ad"><form>' * n + f"<h1>x</h1><p>{EN}</p>" + f"<p>{EN2}</p>" * 2000
    began = time.process_time()
    assert extraction.main_text(html).endswith(EN2)
    assert time.process_time() - began < 20
