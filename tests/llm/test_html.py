import html
import math
import random
import re
import time

import pytest

from auditflow.llm import html_text
from auditflow.llm import queries as Q
from auditflow.llm.html_text import extract, main_text

SF = "/root/testdata/sf0.01"
P = "".join(f"<p>Sentence {k} tells, in some words, a story of its own that goes on for a while.</p>" for k in range(6))
PLAIN = " ".join(f"Sentence {k} tells, in some words, a story of its own that goes on for a while." for k in range(6))


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("Just text &amp; more &lt;b&gt;, 5 < 6", "Just text & more <b>, 5 < 6"),
    ("<div><p>Hello <b>wor<i>ld</i>\n\n twice<p>Second", "Hello world twice Second"),
    ("<body><script>if(a<b){'</p>'}</script><p>Text stays.</p><style>p{}</style><!-- no -->", "Text stays."),
    ("<p>caf&eacute; &#233; &#xe9; &amp;amp; &nbsp; x</p>", "café é é &amp; x"),
    ("<p>cut here <a href='x", "cut here"), ("<p>a</div></p></span>b", "a b"),
    (f"<div class=nav><a href=1>Home</a></div><div id=content><h1>Title</h1>{P}<p>Short.</p></div><div class='sidebar'><p>Beside, with a longer text than usual for it, really.</p></div>"
     f"<div id=comments>{P}{P}</div><footer>foot</footer>", f"Title {PLAIN} Short."),
    (f"<div class='cookie-notice'><p>We use cookies, please accept.</p></div><main>{P}<form><p>Your mail</p></form><aside>beside</aside></main>", PLAIN),
    (f"<body class='has-sidebar'><header><h1>Site</h1><nav>x</nav></header><article><h1>Title</h1>{P}<ul><li>one<li>two</ul></article>", f"Title {PLAIN} one two"),
    (f"<body><div hidden>gone</div><div style='display: none'>gone</div><div><div>{P}</div></div>", PLAIN),
])
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<body><div class='page has-sidebar'>{P}</div>", PLAIN), (f"<body><div class='layout no-footer'>{P}</div>", PLAIN),
    (f"<body><form id=aspnetForm action='/x'><div>{P}</div></form>", PLAIN), (f"<body><div class='banner'><div>{P}</div></div>", PLAIN),
    (f"<body><div>{P}<section id='discussion'>{P}</section></div>", f"{PLAIN} {PLAIN}"),
    (f"<body><div><h2 id='related-work'>Related work</h2>{P}</div>", f"Related work {PLAIN}"),
    (f'<body><div><p>See <a href="x"">this</a> and more words here.</p>{P}</div>', f"See this and more words here. {PLAIN}"),
    (f"<body><div><p title=don't>One that stays in the text.</p>{P}</div>", f"One that stays in the text. {PLAIN}"),
    (f"<body><div><p class='a'b\" = >Stays.</p>{P}<p id=x/y title='a > b'>Last.</p></div>", f"Stays. {PLAIN} Last."),
    (f"<body><div>{P}</div><div class='sidebar'>{P[:100]}</p></div><form><p>Search</p></form>", PLAIN),
])
def test_common_markup_loses_no_text(page, text):
    assert main_text(page) == text


Q1, Q2, Q3 = (P.replace("Sentence", w) for w in ("First", "Second", "Third"))
ONE, TWO, THREE = (PLAIN.replace("Sentence", w) for w in ("First", "Second", "Third"))


@pytest.mark.parametrize("page, text", [
    (f"<body><div class=nav>x</div><div><article>{Q1}</article><article>{Q2}</article><article>{Q3}{Q3}</article></div><footer>f</footer>", f"{ONE} {TWO} {THREE} {THREE}"),
    (f"<body><nav>n</nav><main><article>{Q1}</article><article>{Q2}</article></main>", f"{ONE} {TWO}"),
    (f"<body><article>{Q1}{Q2}{Q3}</article><article><h2>More</h2>{Q2}</article>", f"{ONE} {TWO} {THREE} More {TWO}"),
    (f"<body><div><article><p>A teaser.</p></article>{Q1}{Q2}</div>", f"A teaser. {ONE} {TWO}"),
    (f"<body><article><header><h1>Title</h1></header><div>{Q1}</div></article>", f"Title {ONE}"),
    (f"<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Sport</a></div><div><h1>Title</h1>{Q1}</div><div><a href=4>Terms</a></div>", f"Title {ONE}"),
    (f"<body><div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><section><h2>Title</h2>{Q1}{Q2}</section><section><h2>Other</h2>{Q3}</section>", f"Title {ONE} {TWO} Other {THREE}"),
])
def test_density_chooses_and_every_article_stays(page, text):
    assert main_text(page) == text


def test_stray_and_deep_tags_stay_linear():
    assert main_text("<div>" * 3000 + "deep" + "</span>" * 50_000 + "</div>" * 3000) == "deep"
    assert main_text("<b>" * 20_000 + "<p>x</p>" * 2000).startswith("x x")
    assert main_text("<a \"" * 20_000) == ""


def test_query_gives_the_articles(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = Q.QUERIES["op2_html_text"](spark, SF)
    assert found.columns == ["page_id", "url", "text", "n_chars"] and found.count() == len(pages)
    for r in found.collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", pages[r["page_id"]]["html"], re.S)[1]
        body = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br|li|ul)\b[^>]*>", " ", body))
        assert r["text"] == " ".join(html.unescape(body).split()) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_cases(spark):
    rows = [(1, "u", None, "x"), (None, None, f"<article>{P}</article>", "x"), (2, "u", "", "x"), (2, "u", "", "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == [("1", "", 0), ("2", "", 0), ("2", "", 0), ("None", PLAIN, len(PLAIN))]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page, text", [
    (f"<body><div><h1>My Title</h1><div class=content>{Q1}</div></div>", f"My Title {ONE}"),
    (f"<body><div class=nav><a href=1>x</a></div><div><h1>My Title</h1><p>A lead.</p><div class=content>{Q1}</div><p>The end.</p></div><footer>f</footer>", f"My Title A lead. {ONE} The end."),
    (f"<body><div><section><p>First.</p></section><section>{Q1}{Q2}</section><section><p>Last.</p></section></div>", f"First. {ONE} {TWO} Last."),
    (f"<body><article>{Q1}<p class='share'>Share of the market rose.</p>{Q2}<p class=share><a href=1>Share</a> this.</p></article>", f"{ONE} Share of the market rose. {TWO}"),
    (f"<body><h1>My Title</h1><article>{Q1}</article>", f"My Title {ONE}"),
    (f"<body><h1>Site</h1><article><h1>Title</h1>{Q1}</article><p>Rights.</p>", f"Title {ONE}"),
    (f"<body><div>{Q1}</div><div><p><a href=1>Terms</a> <a href=2>Mail</a></p></div>", ONE),
])
def test_titles_leads_and_short_parts_stay(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page", [
    "<li><div>" + "<i>" * 50_000 + "</li>" * 50_000 + "x", "<div>" * 50_000 + "x", "<div class=ad>" * 50_000 + "x", "<div><p>y</p>" * 25_000,
    "<p>" + "<b>" * 50_000 + "<p>" * 50_000 + "x", "<table><tr><td>" * 15_000 + "x", "<li>x" * 50_000 + "</ul>" * 50_000,
])
def test_pages_take_linear_time(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 4


def _density(node, share):
    """Composite text density straight from its definition: characters, tags, link characters, link tags, density."""
    below = [_density(c, share) for c in node.children]
    chars = node.own + sum(b[0] for b in below)
    tags = node.own_tags + sum(b[1] + 1 for b in below)
    link = node.tag == "a"
    links = chars if link else sum(b[2] for b in below)
    link_tags = (1 if link else 0) + sum(b[3] for b in below)
    if not chars:
        return chars, tags, links, link_tags, 0.0
    base = math.log(chars / max(chars - links, 1) * links + share * chars + math.e)
    return chars, tags, links, link_tags, chars / max(tags, 1) * max(math.log(chars / max(links, 1) * max(tags, 1) / max(link_tags, 1), max(base, 1 + 1e-9)), 0.0)


class Plain:
    def __init__(self, tag, own, own_tags, children):
        self.tag, self.own, self.own_tags, self.children = tag, own, own_tags, children


def test_densities_equal_their_definition():
    draw = random.Random(3)

    def tree(depth):
        tag = draw.choice(["div", "section", "span", "b", "a"])
        words = "w" * draw.randrange(1, 40)
        return Plain(tag, len(words), 0, [tree(depth - 1) for _ in range(draw.randrange(0, 4))] if depth and tag != "a" else [])

    def markup(t):
        return f"<{t.tag}>{'w' * t.own}{''.join(map(markup, t.children))}</{t.tag}>"

    for _ in range(60):
        top = Plain("body", 3, 0, [tree(3) for _ in range(3)])
        body, pieces = html_text.parse(f"<body>www{''.join(map(markup, top.children))}")
        body.last = len(pieces)
        found = html_text._measure(body, pieces)
        chars, _, links, _, _ = _density(top, 0.0)
        want, stack = [], [top]
        while stack:
            t = stack.pop()
            want.append(_density(t, links / max(chars, 1)))
            stack.extend(reversed(t.children))
        assert [(n.chars, n.link_chars) for n in found] == [(w[0], w[2]) for w in want]
        assert [n.density for n in found] == pytest.approx([w[4] for w in want])
