import random
from html.parser import HTMLParser

from sparktrail.llm import html

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>x</article>";</script></head><body>
<nav class=main><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, please accept them all.</p></div>
<div class="ad">Buy now!</div><!-- <article>no</article> --><article><h1>Title &amp; more</h1><p><b>First   para&nbsp;graph &#233;.<br>next<p>Second <a href=x>link</a>.</p>
<div class="comments"><p>Reader says no.</p></div><form><p>Sign up</p><input></form><p>1 &lt; 2 < 3</p></article>
<aside><p>Elsewhere in the news.</p></aside><footer>&copy; me</footer></body></html>"""


def test_article():
    assert html.main_text(ARTICLE) == "Title & more\nFirst para graph é. next\nSecond link.\n1 < 2 < 3"


def test_surge_and_dive_without_article():
    long = "A sentence that is long enough to belong to the running text of the page, surely. "
    page = "<body><div id=menu><a>One</a></div><ul>" + "<li><a href=x>menu entry</a></li>" * 9 + "</ul>" + f"<div><p>{long}</p><p>{long * 2}</p><p>short</p><p>{long}</p></div>" + "<p><a href=y>another page</a></p>" * 5 + "<p>tiny note</p></body>"
    assert html.main_text(page).split("\n") == [" ".join(x.split()) for x in (long, long * 2, "short", long)]
    assert html.stretches([0, 0, 50, 60, 0, 70, 0, 0, 0, 5], 80) == [(2, 6)]


PROSE = " ".join(f"word{i} and more of the running text," for i in range(12))


def test_classes_never_erase_an_article_or_a_wrapper():
    for page in (
        f'<main class="has-sidebar"><p>{PROSE}</p></main>',
        f'<article class="hentry comments-open"><p>{PROSE}</p></article>',
        f'<div class="page sticky-header"><p>{PROSE}</p></div>',
        f'<div class="site-header"><article><p>{PROSE}</p></article></div>',
        f'<form id="login"><div><p>{PROSE}</p></div></form>',
        f'<nav><a href="/">Home</a></nav><article><div class="social-history"><p>{PROSE}</p></div></article>',
        f'<article><div class="notice-of-death"><p>{PROSE}</p></div></article>',
        f'<article><ul class="menu-items"><li>{PROSE}</li></ul></article>',
        f'<article><p><span class="social-distance">{PROSE}</span></p></article>',
    ):
        assert html.main_text(page) == PROSE, page
    assert html.main_text(f"<article><header><h1>A title</h1></header><p>{PROSE}</p></article>") == f"A title\n{PROSE}"
    assert html.main_text(f"<article><p>A short teaser.</p></article><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div>") == "\n".join([PROSE] * 3)
    short = [f"Short line {i}." for i in range(12)]
    assert html.main_text("<body><div>" + "".join(f"<p>{x}</p>" for x in short) + "</div></body>") == "\n".join(short)
    assert html.main_text("<article><p>Be.</p></article>") == "Be."


def test_no_text_of_the_article_is_lost():
    inside = f'<article><p>{PROSE}</p><section class="search"><p>{PROSE}</p></section><div class="promotion"><p>He got a promotion in May.</p></div></article>'
    assert html.main_text(inside) == f"{PROSE}\n{PROSE}\nHe got a promotion in May."
    assert html.main_text(f'<article><p>{PROSE}</p><div class="search"><p>Find it</p><input></div><div class="related"><a href=x>More</a></div><p>End.</p></article>') == f"{PROSE}\nEnd."
    figures = "<figure><img src=x></figure>" * 3
    for end in ("The end is a short conclusion of it all.", PROSE[:160].strip()):
        for wrapper in ("article", "div"):
            page = f"<{wrapper}><h1>Head</h1>{'<div></div>' * 3}" + f"<p>{PROSE}</p>" * 3 + f"{figures}<p>{end}</p></{wrapper}>"
            assert html.main_text(page) == "\n".join(["Head", *[PROSE] * 3, end]), (wrapper, end)
    for wrapper in ("article", "div"):
        page = f"<{wrapper}><p>{PROSE}</p><p><a href=x>One long link as a paragraph</a></p><p>{PROSE}</p></{wrapper}>"
        assert html.main_text(page) == f"{PROSE}\nOne long link as a paragraph\n{PROSE}"
    adverts = '<div class="ad"><p>Buy this now</p></div>' * 4
    assert html.main_text(f"<article><p>{PROSE}</p>{adverts}<p>Short end.</p></article>") == f"{PROSE}\nShort end."


class Plain(HTMLParser):
    """Text of the blocks that the generator marked as its own, by a parser that knows nothing of weights."""

    def __init__(self, page):
        super().__init__()
        self.depth, self.held, self.out, self.raw = [], [], [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.raw += tag in ("script", "style")
        if tag in ("p", "h1", "li"):
            self.depth.append(dict(attrs).get("data-own"))
            self.held = []
        if tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style")
        if tag in ("p", "h1", "li") and self.depth:
            if self.depth.pop():
                self.out.append(" ".join("".join(self.held).split()))
            self.held = []

    def handle_data(self, data):
        if not self.raw:
            self.held.append(data)


def pages(seed, wrapper):
    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(n))
    for _ in range(150):
        body = f"<h1 data-own=1>{words(6)}</h1>"
        for _ in range(rng.randint(1, 9)):
            body += f"<p data-own=1>{words(rng.choice([1, 3, 30, 80]))}{rng.choice(['', ' &amp; ', '<br>', ' &eacute;', '<b>x</b>', '<a href=u>a link</a>'])} {words(4)}</p>"
            if rng.random() < 0.2:
                body += rng.choice(["<script>var a='<p>no</p>'</script>", '<div class="ad"><p>Buy this now</p></div>', "<aside><p>elsewhere</p></aside>"])
        boiler = ["<nav><ul>" + "".join(f"<li><a href=/{k}>entry {k}</a></li>" for k in range(6)) + "</ul></nav>", '<div class="cookie-notice"><p>We use cookies here.</p></div>', "<header><p>The site of all sites</p></header>", '<div class="ad">' + words(6) + "</div>"]
        rng.shuffle(boiler)
        comments = '<div id="comments"><p>' + words(20) + "</p></div>" if rng.random() < 0.5 else ""
        yield "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>" + "".join(boiler[: rng.randint(0, 4)]) + f"<{wrapper}>{body}</{wrapper.split()[0]}>" + comments + "<footer><p>&copy; " + words(3) + "</p></footer></body></html>"


def test_against_a_plain_parser():
    """Generated pages whose own blocks are known; with and without an article element."""
    for wrapper in ("article", "main", "div", 'div class="content"'):
        same = [html.main_text(p).split("\n") == Plain(p).out for p in pages(len(wrapper), wrapper)]
        assert sum(same) == 150, (wrapper, sum(same))


def test_the_distribution_decides():
    """Every page of the tables: text comes from stretches of dense windows, and all of it but lines of no weight lies there."""
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        weights = [w or 0.0 for _, w in html.weighed(page)]
        top = max(sum(weights[i : i + html.WINDOW]) for i in range(len(weights)))
        found = html.stretches(weights, min(html.LOOSE, top / 4))
        assert top >= html.LOOSE and found and weights[found[0][0]] > 0 and sum(weights[found[-1][1] :]) < html.LOOSE
        assert html.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>")) == html.main_text(page)


def test_broken_pages():
    for page in ("", "<", "<p", "text only", "<article><p>cut <b", "<article><p>a &am", "<script>never ends", "<!-- open", "<a href='x>quote", "</p></div>", "<article>" + "<div>" * 5000 + "deep"):
        html.main_text(page)
    assert html.main_text("<article><p>a &am") == "a &am" and html.main_text("<article><p>cut <b") == "cut"


def test_rows(spark):
    rows = [(1, "u", ARTICLE, "clash"), (2, None, None, None), (None, "u", "<article><p>" + "long " * 50_000, "x"), (1, "u", ARTICLE, "clash")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.n_chars for r in got}[2] == 0 and {r.page_id: r.n_chars for r in got}[None] == 249_999
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
