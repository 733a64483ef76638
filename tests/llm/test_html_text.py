import re

import pyarrow as pa
import pytest

from mailsieve.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="post post-17"><h1>Big &amp; small</h1><p>First   line<br>goes on. <b>Bold</b><p>Second &#233;</p><!-- x > y -->
<div class=ad>Buy</div><ul><li>one<li>two</ul><script>var a = "</p>";</script><form><input value=">">Name</form></div>
<aside>Side</aside><section id=comments><p>I am a reader and I write at great length, at much greater length than the article itself does, on and on.</p></section>
<footer>(c)</footer>"""


def test_article_alone():
    path = H.best_path(PAGE)
    assert path == "body>div.post.post-"
    assert H.extract_with(PAGE, [path]) == "Big & small\n\nFirst line goes on. Bold\n\nSecond é\n\none\n\ntwo"


@pytest.mark.parametrize(
    ("page", "text"),
    [("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\n\nb"), ("<div><p>unclosed <b>bold", "unclosed bold"), ("<", "<"), ("a < b", "a < b"),
     ("<script>x", ""), ("<!-- open", ""), ("</p></div>x", "x"), ('<p class="a>b">q</p>', "q"), ("<td>1<td>2", "1\n\n2"), ("&lt;p&gt; &nbsp;x", "<p> x")],
)
def test_broken_pages(page, text):
    assert H.extract_with(page, []) == text


def test_long_broken_pages_stay_linear():
    for page in ("<" * 50_000, '<a "' * 20_000, "<div>" * 3_000 + "x", "<p>" * 20_000, "<!--" * 20_000):
        H.extract_with(page, [])


def test_hosts_vote(spark):
    good = '<body><div class="main-1"><p>' + "A long article text here. " * 9 + "</p></div><div class=teaser><p>{}</p></div>"
    pages = [(i, f"https://User@Host.example:80/{i}", good.format("short")) for i in range(5)]
    pages += [(9, "http://host.example/x", good.format("A teaser that is longer than the article. " * 12)), (10, None, good.format("x")), (11, "no url", None), (None, "", "")]
    df = spark.createDataFrame([(*p, "c", "d") for p in pages], "page_id long, url string, html string, host string, paths string")
    paths = H.winning_paths(df).collect()
    assert [(r.host, r.paths[0]) for r in paths] == [("host.example", "body>div.main-")]
    found = {r.page_id: r.text for r in H.extract(df).collect()}
    article = ("A long article text here. " * 9).strip()
    assert len(found) == len(pages) and {found[i] for i in (0, 1, 2, 3, 4, 9, 10)} == {article}
    assert found[11] == found[None] == ""
    assert H.extract(df.where("false")).count() == 0


BODY, PART = "Running text of the body. " * 40, "A shorter part."
WHOLE = f"Title\n\nLead\n\n{BODY.strip()}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1>Title</h1><p>Lead</p><div class=entry-content><p>{BODY}</div></article>", WHOLE),
        (f"<article><h1>Title</h1><p>Lead</p><div class=row><div class=text><p>{BODY}</div></div></article>", WHOLE),
        (f"<div class=wrap><h1>Title</h1><p>Lead</p><div class=text>{BODY}</div></div><div class=teaser>{PART}</div>", WHOLE),
        (f"<h1>Title</h1><p>Lead</p><div class=text>{BODY}</div><div class=teaser>{PART}</div>", WHOLE),
        (f"<article><div class=a>{BODY}</div><div class=b>{PART}</div></article><div class=teaser>{PART}</div>", f"{BODY.strip()}\n\n{PART}"),
        (f"<div id=w><div class=a>{PART}</div><div class=b>{BODY}</div></div>", f"{PART}\n\n{BODY.strip()}"),
        (f"<div id=w><div class=a>{BODY}</div><div class=b><a href=/>One</a> <a href=/>Two</a></div></div>", BODY.strip()),
        (f"<main><article>{BODY}</article><div class=b><a href=/>{PART}</a></div></main>", BODY.strip()),
    ],
)
def test_whole_article_around_the_best_container(spark, page, text):
    page = f"<body><nav>Home</nav>{page}</body>"
    assert H.extract_with(page, []) == text
    pages = spark.createDataFrame([(i, f"http://one.example/{i}", page) for i in range(3)], "page_id long, url string, html string")
    assert [r.text for r in H.extract(pages).collect()] == [text] * 3


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        ("<h2 id=search>Part</h2>", True), ("<h2 class=related>Part</h2>", True), ("<p class=notice>Part</p>", True), ("<p>A <span class=alert>Part</span></p>", True),
        (f"<section id=discussion><p>Part {BODY}</section>", True), ("<section id=discussion><p>Part</section>", False),
        ("<div class='content social-science'>Part</div>", True), ("<div class='story banner'>Part</div>", True),
        (f"<div class=related><a href=/>Part {BODY}</a></div>", False), (f"<div class=post-comments>Part {BODY}</div>", False),
        (f"<div class='post comments'>Part {BODY}</div>", False), (f"<div class='post comments-open'>Part {BODY}</div>", True),
        ("<div class=ad>Part</div>", False), (f"<div id=cookie-notice>Part {BODY}</div>", False), ("<ul class=share><li>Part</ul>", False),
        (f"<div class=widget><div class=related>Part</div>{BODY}</div>", False), ("<div class=entry-header>Part</div>", True),
    ],
)
def test_names_are_evidence(part, kept):
    found = H.extract_with(f"<body><article><h1>Title</h1><p>{BODY}</p>{part}<p>End</article>", [])
    assert found.startswith("Title") and found.endswith("End") and ("Part" in found) == kept


def test_driver_pages_give_their_article(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    found = {r.page_id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = (" ".join(H.html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        assert found[r.page_id] == "\n\n".join(p for p in parts if p)


def test_few_pages_are_held_at_once(spark, monkeypatch):
    """However many pages a batch holds, both passes turn only some of them into Python objects before they give results."""
    one = {"key": 1, "url": "http://a.example/x", "host": "a.example", "html": PAGE, "paths": None}
    pages = spark.createDataFrame([(1, one["url"], PAGE)], "page_id long, url string, html string")
    passes, map_in_arrow = [], type(pages).mapInArrow
    monkeypatch.setattr(type(pages), "mapInArrow", lambda df, f, *a: passes.append(f) or map_in_arrow(df, f, *a))
    H.extract(pages)
    assert len(passes) == 2
    for f in passes:
        sizes = [b.num_rows for b in f(iter([pa.RecordBatch.from_pylist([one] * 1_050)]))]
        assert sum(sizes) == 1_050 and max(sizes) <= 100
