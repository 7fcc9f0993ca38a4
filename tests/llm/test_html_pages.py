"""Main text of pages, expected texts written by hand."""

import time

import pytest

from denseblocks.llm import html_main

PAGES = {
    # wrappers whose class only contains a listed word
    '<div class="layout has-sidebar"><article><p>Kept text.</p></article></div>': "Kept text.",
    '<div class="with-comments content"><article><p>Kept text.</p></article></div>': "Kept text.",
    '<div class="no-ads"><p>Kept text.</p></div>': "Kept text.",
    '<main><div class="post share-enabled"><p>Kept text.</p></div></main>': "Kept text.",
    '<article><p>One.</p><div class="related-work">Two.</div><figure class="article-header-image">Three.</figure></article>': "One. Two. Three.",
    # what holds the articles stays, whatever it is called
    '<form><article>In a form.</article></form>': "In a form.",
    '<div class="sidebar"><article>All there is on this page.</article></div>': "All there is on this page.",
    '<aside><main>All there is on this page.</main></aside>': "All there is on this page.",
    # what is no main text goes
    '<article>Text.<div class="share">Tell a friend</div><div class="ad">Buy</div></article><div class="related"><article>Read on</article></div>': "Text.",
    '<div class="cookie-bar">We use cookies</div><p>Text of the page.</p><div id="site-footer">Imprint</div>': "Text of the page.",
    '<p>Text of the page.</p><div class="comments"><p>' + "I think so too. " * 20 + "</p></div>": "Text of the page.",
    '<nav>' + "<a>link</a> " * 50 + "</nav><p>Short text.</p>": "Short text.",
    '<article class="post">Text.</article><article class="comment">First!</article>': "Text.",
    '<article><header><h1>Title</h1></header>Text.</article><header>Bar</header>': "Title Text.",
    '<div hidden>No</div><div style="display: none">No</div><div aria-hidden="true">No</div>Yes': "Yes",
    # blocks, inline elements, references
    "<main><p>a<br>b &lt; c<p>one <i>t</i>wo<ul><li>x<li>y</ul><table><tr><td>1<td>2</table></main>": "a b < c one two x y 1 2",
    "<div>a</b></i></div></div>b</p><p>c": "a b c",
    "": "",
}


@pytest.mark.parametrize("html", PAGES)
def test_page(html):
    assert html_main.main_text(html) == PAGES[html]


@pytest.mark.parametrize("depth", [400, 2000, 50_000])
def test_any_depth(depth):
    html = "<article>" + "<div>" * depth + "Deep." + "</div>" * depth + "<p>After.</p></article><div>" + "<div>" * depth + "<nav>Menu</nav>" + "</div>" * depth + "</div>"
    start = time.time()
    assert html_main.main_text(html) == "Deep. After."
    assert html_main.main_text("<div>" * depth + "<p>Never closed") == "Never closed"
    root = html_main.parse("<div>w " * depth)
    assert len({h for _, h in html_main._candidates(root)}) == int(depth * html_main.MOST_SHARE)
    assert time.time() - start < 30


def pages_of(host, n, page):
    return [(f"http://{host}.example/{i}", page(i), f"A text number {i} of {host}, most of what its page says, and longer than the rest of it.") for i in range(n)]


def page(i, host="small"):
    text = f"A text number {i} of {host}, most of what its page says, and longer than the rest of it."
    return f"<body><div>Welcome to us</div><article><p>{text}</p><div>See you soon</div></article><div>Made with care</div></body>"


def test_templates_of_hosts(spark):
    """Four pages are enough to tell what a host repeats; two are not; on a host of many
    pages a part of three of them is no template."""
    rows = pages_of("small", 4, page)
    rows += [(u, p, t + " See you soon") for u, p, t in pages_of("two", 2, lambda i: page(i, "two"))]
    for i, (u, p, t) in enumerate(pages_of("large", 100, lambda i: page(i, "large"))):
        extra = "<div>Series of three</div>" if i < 3 else "<div>Series of ten</div>" if i < 13 else ""
        rows.append((u, p.replace("</article>", extra + "</article>"), t + (" Series of three" if i < 3 else "")))
    df = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_main.extract(df).collect()}
    assert [got[i] for i in range(len(rows))] == [t for _, _, t in rows]
