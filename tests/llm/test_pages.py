from __future__ import annotations

import time

import pytest

from souk.llm import pages

SITE = """<!DOCTYPE html><html><head><title>t</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><div class="cookie-notice">We use cookies, really a lot of them, so accept</div>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="wrap"><div class="sidebar"><p>Side text, long enough to look good, and longer still</p></div>
<div class="post-%d entry"><h2>Title &amp; more</h2><p>%s <b>bold</b>,<br>next
 line<p>Second&nbsp;para<div class="ad">Buy</div><form><input><p>sub</p></form><ul><li>one<li>two</ul></div>
<div id="comments"><p>%s</p></div></div><footer>&copy; 2020</footer></body></html>"""


def site(n, body="Hello there,   all", comment="First!"):
    return SITE % (n, body, comment)


WANT = "Title & more\n\n{}bold, next line\n\nSecond para\n\none\n\ntwo"


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, extra int")
    return {r["page_id"]: r for r in pages.extract(df).collect()}


def test_main_text_without_the_rest(spark):
    got = run(spark, [(i, f"https://www.a.org/{i}", site(i), 1) for i in range(3)])
    assert {r["__text"] for r in got.values()} == {WANT.format("Hello there, all ")}
    assert got[0].asDict().keys() == {"page_id", "url", "extra", "__text"}


def test_host_consensus_outvotes_a_misleading_page(spark):
    odd = ("<body><div class='wrap'><div class='links'><p>%s</p></div><div class='post-9 entry'><p>Short news.</p>"
           "</div></div></body>" % ("a long list of other things to read here " * 12))
    rows = [(i, f"http://a.org/{i}", site(i, "word " * 60), 1) for i in range(6)]
    got = run(spark, [*rows, (9, "HTTP://user@A.org:80/9", odd, 1), (10, "http://b.org/", odd, 1)])
    assert got[9]["__text"] == "Short news." and got[10]["__text"].startswith("a long list")


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("plain <3 text &amp; more", "plain <3 text & more"), ("<p>a<p>b", "a\n\nb"),
    ("<body><article><p>x<!-- no --> y</p><script>1<2</script></article></body>", "x y"),
    ("<article><header><h1>T</h1><span>by me</span></header><p>b</p><aside>s</aside></article>", "T\n\nb"),
    ("<form><article><p>all in a form</p></article></form>", "all in a form"),
    ("<div hidden>no</div><div aria-hidden='true'>no</div><div>yes</div>", "yes"),
    ("<div role=navigation>no</div><div><p>yes</div>", "yes"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\n\nb\n\nc"),
    ("<p>1 &lt; 2 &#x41; &eacute;</p>", "1 < 2 A é"), ("<div class=article-comments>c</div>", ""),
])
def test_small_pages(html, want):
    assert pages.main_text(pages.read(html), None) == want


STORY = "<h1>Title</h1><p>The first paragraph of a story.</p><p>And the second one.</p>"
TOLD = "Title\n\nThe first paragraph of a story.\n\nAnd the second one."
SIDE = "<p>About this site, and how to write to us.</p>"


@pytest.mark.parametrize("html, want", [
    (f'<div class="right-sidebar"><article>{STORY}</article></div>', TOLD),
    (f'<div class="sidebar-right"><main>{STORY}</main><div class="sidebar">{SIDE}</div></div>', TOLD),
    (f'<div class="page-with-menu">{STORY}</div>', TOLD),
    (f'<div id="ads-wrapper"><div class="widget">{SIDE}</div><div class="post">{STORY}</div></div>', TOLD),
    ('<article><div class="post-header"><h1>Title</h1><p>Lead.</p></div><div class="post-body"><p>Body text, longer.</p>'
     "</div></article>", "Title\n\nLead.\n\nBody text, longer."),
    ('<div class="post"><div class="entry-header"><h1>Title</h1></div><p>Body text, longer.</p></div>', "Title\n\nBody text, longer."),
    (f'<article>{STORY}</article><div class="related"><article><h1>Other</h1><p>Teaser.</p></article></div>', TOLD),
    (f'<article>{STORY}</article><div id="comments"><article class="c"><p>{"I disagree. " * 40}</p></article></div>', TOLD),
    (f'<div class="sidebar-right">{SIDE}</div><div><p>{STORY}</p></div>', TOLD),
    ('<div class="cookie-notice"><p>We use cookies.</p></div>', ""),
])
def test_class_words_do_not_drop_the_article(html, want):
    assert pages.main_text(pages.read(f"<body>{html}</body>"), None) == want


def test_urls_with_white_space_vote_and_read_alike(spark):
    odd = ("<body><div class='wrap'><div class='links'><p>%s</p></div><div class='post-9 entry'><p>Short news.</p>"
           "</div></div></body>" % ("a long list of other things to read here " * 12))
    rows = [(i, f"\thttp://a.org/{i}", site(i, "word " * 60), 1) for i in range(6)]
    got = run(spark, [*rows, (9, "\n http://a.org/9", odd, 1), (10, "http://a.org/9", odd, 1)])
    assert got[9]["__text"] == got[10]["__text"] == "Short news."


def test_repeated_urls_and_tied_paths(spark):
    """Two layouts with as many votes: the choice is the same however the rows come."""
    rows = [(i, "http://a.org/", f"<body><div class={'xy'[i % 2]}><p>{LONG}</p></div></body>", 1) for i in range(8)]
    first, second = run(spark, rows), run(spark, rows[::-1])
    assert {r["__text"] for r in first.values()} == {LONG.strip()}
    assert {k: r["__text"] for k, r in first.items()} == {k: r["__text"] for k, r in second.items()}


def test_long_deep_and_broken_pages():
    deep = "<div>" * 3000 + "text" + "</div>" * 10
    assert pages.main_text(pages.read(deep), None) == "text"
    assert pages.main_text(pages.read("<p>" + "w " * 200_000), None) == ("w " * 200_000).strip()
    assert pages.main_text(pages.read("<p title='a\">b <i c=\"'>text</p>" * 50), None)


def test_odd_rows_and_empty_table(spark):
    got = run(spark, [(None, None, None, 1), (1, None, "<p>x</p>", 1), (1, "no url", "<p>x</p>", 2)])
    assert len(got) == 2
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.extract(df).collect() == []


@pytest.mark.parametrize("url, host", [("http://a.org", "a.org"), ("//x.y/z", "x.y"), ("https://U:p@B.C:8/q?r", "b.c"),
                                       (None, ""), ("a.org/x", "")])
def test_hosts(url, host):
    assert pages.host_of(url) == host


LONG = "A long paragraph of the article, with many words in it. " * 8


@pytest.mark.parametrize("inner, want", [
    ("<article><h1>Title</h1><p>Lead</p><div class='entry-body'><p>{}</p></div></article>", "Title\n\nLead\n\n{}"),
    ("<article><section class=a><p>Short one.</p></section><section id=b><p>{}</p></section></article>",
     "Short one.\n\n{}"),
    ("<div class=post><h2><a href=/>Title</a></h2><div class=lead><p>Lead</p></div><div class=text><p>{}</p></div>"
     "<div class=tags><a>x</a></div></div>", "Title\n\nLead\n\n{}"),
    ("<main><h1>T</h1><ul><li><a>Home</a></ul><div><div><p>{}</p></div></div></main>", "T\n\n{}"),
    ("<div class=page><div class=left><p>About us</p></div><div class=text><p>{}</p></div></div>", "{}"),
])
def test_text_around_the_winning_container(spark, inner, want):
    html = f"<body>{inner}<p>outside</p></body>".replace("{}", LONG)
    want = want.replace("{}", LONG.strip())
    assert pages.main_text(pages.read(html), None) == want
    got = run(spark, [(i, f"http://a.org/{i}", html, 1) for i in range(3)])
    assert {r["__text"] for r in got.values()} == {want}


def test_sections_right_in_body_and_pages_of_another_layout(spark):
    two = f"<body><div class=x><p>{LONG}</p></div><div class=y><p>{LONG[:285]}</p></div></body>"
    other = f"<body><div class=x><p>Hi.</p></div><div class=story><p>{LONG}</p><p>More.</p></div></body>"
    got = run(spark, [*((i, f"http://a.org/{i}", two, 1) for i in range(5)), (9, "http://a.org/9", other, 1)])
    assert got[0]["__text"] == f"{LONG.strip()}\n\n{LONG[:285].strip()}"
    assert got[9]["__text"] == f"{LONG.strip()}\n\nMore."


@pytest.mark.parametrize("quote", ["'", '"'])
def test_long_attribute_values(quote):
    inner = "<b class=nav hidden>junk</b> more > tail " * 500
    value = quote + inner.replace('"', "") + quote
    want = "all of it"
    assert pages.main_text(pages.read(f"<div data-x={value}><p title = {value}>all <i data-y={value}/>of it</div>"),
                           None) == want
    assert pages.main_text(pages.read(f"<article style={quote}overflow:hidden{quote}><p>{want}</article>"), None) == want


def test_stray_and_unclosed_quotes():
    assert pages.main_text(pages.read("<p title='x''>a</p><p alt=don't>b</p><p id='c>c</p>"), None) == "a\n\nb\n\nc"
    started = time.perf_counter()
    for text in ("<a t='>' " * 100_000, "<a t='x> " * 100_000, "<a t='\">y " * 100_000, "<a t=" * 100_000):
        pages.read(text + "<p>")
    assert time.perf_counter() - started < 20
