"""Operator 9 on hand-labelled pages: wrappers, marks, links, broken markup, long pages."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from marketlens.llm import html_text

P = [" ".join(f"{w}{i}" for i in range(n)) + "." for w, n in (("alpha", 40), ("beta", 55), ("gamma", 30))]
BODY = "".join(f"<p>{p}</p>" for p in P)
MAIN = "\n".join(P)
NAV = "<nav><ul>" + "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(6)) + "</ul></nav>"
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Other story number {i} today</a></li>" for i in range(5)) + "</ul>"
FOOT = "<footer>Copyright someone, all rights reserved</footer>"

#: name: (html, main text)
PAGES = {
    # wrappers whose class names something else than what they hold
    "has-sidebar wrapper": (f'{NAV}<div class="content has-sidebar"><article><h1>Title</h1>{BODY}</article></div>{FOOT}', f"Title\n{MAIN}"),
    "no-sidebar wrapper": (f'<div id="page" class="site no-sidebar"><main><h1>Title</h1>{BODY}</main></div>', f"Title\n{MAIN}"),
    "wrapper with a whole word": (f'<div class="sidebar content"><article>{BODY}</article></div>', MAIN),
    "widget wrapper without article": (f'{NAV}<div class="widget"><h1>Title</h1>{BODY}</div>{FOOT}', f"Title\n{MAIN}"),
    "page in a form": (f"<form action=/x><div>{NAV}<article>{BODY}</article></div></form>", MAIN),
    "page in a form without article": (f"<form action=/x>{NAV}<div>{BODY}</div></form>", MAIN),
    "form in the article": (f"<article>{BODY}<form>Your mail <input> <p>Send it now</p></form></article>", MAIN),
    "page in a form in main": (f"<main><form action=/x>{BODY}</form></main>", MAIN),
    "header holds the article": (f"<header><article>{BODY}</article></header>", MAIN),
    "several articles": (f"<article>{BODY}</article><article><p>{P[0]}</p></article>", f"{MAIN}\n{P[0]}"),
    "article inside main": (f"<main><article><h1>T</h1>{BODY}</article></main>", f"T\n{MAIN}"),
    # inside the article
    "post-header": (f'<article><div class="post-header"><h1>Title of it</h1></div>{BODY}</article>', f"Title of it\n{MAIN}"),
    "header in the article": (f"<article><header><h1>Title</h1></header>{BODY}</article>", f"Title\n{MAIN}"),
    "entry header by class": (f'<article><div class="header"><h1>Title</h1></div>{BODY}</article>', f"Title\n{MAIN}"),
    "alert-level": (f'<article>{BODY}<p class="alert-level">The level is now raised to three.</p></article>', f"{MAIN}\nThe level is now raised to three."),
    "share-holders": (f'<article><p class="share-holders">Holders met on Monday.</p>{BODY}</article>', f"Holders met on Monday.\n{MAIN}"),
    "share-holders section": (f'<article>{BODY}<div class="share-holders"><p>{P[0]}</p></div></article>', f"{MAIN}\n{P[0]}"),
    "linked paragraph": (f"<article>{BODY}<p><a href=/x>Read the whole paper here</a></p></article>", f"{MAIN}\nRead the whole paper here"),
    "one-word paragraph": (f"<article><p>Why?</p>{BODY}</article>", f"Why?\n{MAIN}"),
    "lists and quotes": (f"<article>{BODY}<ul><li>one<li>two</ul><blockquote>said so</blockquote></article>", f"{MAIN}\none\ntwo\nsaid so"),
    "related posts inside": (f'<article>{BODY}<div class="related-posts"><h3>More</h3>{LINKS}</div></article>', MAIN),
    "advert inside": (f'<article><p>{P[0]}</p><div class="ad">Buy this now, it is cheap and good for you</div><p>{P[1]}</p></article>', f"{P[0]}\n{P[1]}"),
    "aside and footer inside": (f"<article>{BODY}<aside>By the way</aside><footer>Filed under x</footer></article>", MAIN),
    "share buttons": (f'<article>{BODY}<div class="share-buttons">Share this on a network</div></article>', MAIN),
    "unclosed item in a list": (f'<article><ul><li class="ad">Buy it<li>kept item</ul>{BODY}</article>', f"kept item\n{MAIN}"),
    # comments
    "comments below": (f'<article>{BODY}</article><section id="comments"><article class="comment"><p>{P[0]}</p></article></section>', MAIN),
    "longer comments": (f'<article><p>{P[2]}</p></article><div class="comments-area"><ol class="comment-list"><li><article class="comment-body"><p>{P[0]}</p><p>{P[1]}</p></article></ol></div>', P[2]),
    "comments without article": (f'<div><h1>T</h1>{BODY}</div><div class="comments"><p>{P[0]}</p><p>{P[1]}</p><p>{P[0]}</p><p>{P[1]}</p></div>', f"T\n{MAIN}"),
    "comment inside the article": (f'<article>{BODY}<div class="post-comments"><p>{P[1]}</p></div></article>', MAIN),
    # links
    "block link": (f"<div>{BODY}</div><a href=x><div>{P[0]}</div></a>{FOOT}", MAIN),
    "block link with two blocks": (f"{BODY}<a href=x><div>{P[0]}</div><div>{P[1]}</div></a>", MAIN),
    "unclosed link": (f"<p><a href=x>A</p><div>{BODY}</div>", f"{MAIN}"),
    "anchor without target": (f"<div><a name=top><p>{P[0]}</p></a><p>{P[1]}</p></div>", f"{P[0]}\n{P[1]}"),
    "link lists around": (f"{LINKS}<h1>Title here</h1>{BODY}{LINKS}", f"Title here\n{MAIN}"),
    "teaser articles": (f'<div>{BODY}</div><article class="x"><a href=/1>Other thing</a></article><article><p>Small one</p></article>', MAIN),
    # markup
    "lone quote": ("<article><p data-x=don't>first</p><p title=\"a\"b\">second</p></article>", "first\nsecond"),
    "quote without an end": (f'<article><p title="x>{P[0]}</p><p>{P[1]}</p></article>', f"{P[0]}\n{P[1]}"),
    "bracket in a value": ("<article><p title='a>b' id=\"c>d\">text</p></article>", "text"),
    "comment forms": ("<article><!--><p>one</p><!-- <p>no</p> --!><p>two</p><!doctype x></article>", "one\ntwo"),
    "references": ("<article><p>a&nbsp;&lt;b&gt; &amp;amp; &#233;\n  c</p></article>", "a <b> &amp; é c"),
    "script with markup": ("<article><script>if (a<b) '</p>'</script><p>text</p><style>p{}</style></article>", "text"),
    "unclosed svg": (f"<article><svg><p>{P[0]}</p></article>", P[0]),
    "less-than as text": ("<article><p>1 < 2 and 3<4</p></article>", "1 < 2 and 3<4"),
    "second body": (f"<body><article><p>{P[0]}</p><body><p>{P[1]}</p></article>", f"{P[0]}\n{P[1]}"),
    "stray end tags": (f"</div></p><article></ul><p>{P[0]}</p></section></article>", P[0]),
    "upper case": (f"<ARTICLE><P>{P[0]}</P></ARTICLE><FOOTER>no</FOOTER>", P[0]),
    # little text
    "one short paragraph": ("<html><body><p>Gone fishing.</p></body></html>", "Gone fishing."),
    "short paragraph with a menu": (f"{NAV}<p>Gone fishing.</p>{FOOT}", "Gone fishing."),
    "only a menu": (f"{NAV}{FOOT}", ""),
    "hidden": (f'<p hidden>{P[0]}</p><div style="display: none">{P[0]}</div><div aria-hidden=true>{P[1]}</div><div><p>{P[2]}</p></div>', P[2]),
    "cookie notice": (f'<div id="cookie-banner"><p>We use cookies to make this better for you and us.</p></div><article>{BODY}</article>', MAIN),
}


@pytest.fixture(scope="module")
def tree():
    return html_text.grow(html_text.labelled_table())


@pytest.mark.parametrize("name", PAGES)
def test_page(name, tree):
    page, want = PAGES[name]
    assert html_text.main_text(page, tree) == want


def test_the_tree_reads_neighbours(tree):
    def columns(node):
        return set() if node.column < 0 else {html_text.COLUMNS[node.column]} | columns(node.left) | columns(node.right)

    assert columns(tree) >= {"words", "links", "words_before", "links_before", "words_after", "links_after"}
    none = dict.fromkeys(html_text.COLUMNS, 0.0)
    ask = lambda **x: html_text.decide(tree, tuple((none | x).values()))
    assert ask(words=20, words_before=60, words_after=50) == 1
    assert ask(words=20, words_before=5, links_before=1.0, words_after=6, links_after=1.0) == 0
    assert ask(words=3, words_before=60, words_after=50) == 1 and ask(words=3, words_before=3, links_before=1.0, words_after=3) == 0


@pytest.mark.parametrize(
    "page",
    ["<div>" * 90_000 + "</p>" * 120_000, "<div>" * 200_000, "<li>" * 250_000, "<svg>" * 200_000, "<a href=x>" * 100_000, "<p a='" * 150_000 + ">x", '<span class="ad">' * 60_000,
     "<article>" * 100_000 + "text", "<ul><li><div>" * 75_000, "<" * 1_000_000, "<a" * 500_000, "<!--" * 250_000, "<table><td><div>" * 60_000, "&" * 1_000_000, "<div class=a><p>x</p>" * 48_000],
    ids=lambda p: p[:16],
)
def test_a_megabyte_of_unclosed_tags(page, tree):
    start = time.process_time()
    html_text.main_text(page, tree)
    assert time.process_time() - start < 4  # about 0.5 s on an idle machine


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, "u", PAGES["post-header"][0], "t"), (1, "u", PAGES["post-header"][0], "t"), (None, None, None, None), (2, None, "", "x"), (3, "v", " \n ", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    clash = pages.select("*", *(F.lit("y").alias(c) for c in ("n_chars", "words", "links", "marked", "kept")))
    want = PAGES["post-header"][1]
    got = sorted(map(tuple, html_text.report(clash).collect()), key=str)
    assert got == sorted([(1, "u", want, len(want))] * 2 + [(None, None, "", 0), (2, None, "", 0), (3, "v", "", 0)], key=str)
    assert html_text.report(clash).columns == ["page_id", "url", "text", "n_chars"]
