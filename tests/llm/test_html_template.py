"""Main text by host templates."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import html_template
from graphloom.llm.html_template import Page, Walk

SCHEMA = "page_id long, url string, html string"


def page(body, head="<title>t</title><script>var a='</p><article>no</article>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def texts(spark, rows):
    return {r.page_id: r.text for r in html_template.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


FURNITURE = {
    "nav": "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></nav>",
    "header": "<header><h2>Site</h2></header>",
    "ad": "<div class='ad'>Buy now</div>",
    "notice": "<div id='cookie-notice'><p>We use cookies</p></div>",
    "aside": "<aside><p>Related things</p></aside>",
    "sidebar": "<div class=\"left-sidebar\"><p>Side</p></div>",
    "form": "<form><p>Name</p><input value='x'><button>Go</button></form>",
    "comments": "<section class='comments'><article><p>First!</p></article></section>",
    "role": "<div role=navigation>Menu</div>",
    "footer": "<footer>&copy; site</footer>",
    "style": "<style>p{}</style><noscript>Enable scripts</noscript><!-- <p>hidden</p> -->",
}


@pytest.mark.parametrize("inside", [False, True])
def test_furniture_goes_and_the_article_stays(spark, inside):
    body = "<h1>Title &amp; more</h1><p>One <b>bold</b>\n word<br>next<p>Two &lt;3&#33;</p><ul><li>item one<li>item two</ul>"
    wanted = "Title & more\nOne bold word next\nTwo <3!\nitem one\nitem two"
    rows = []
    for i, (name, part) in enumerate(FURNITURE.items()):
        if inside and name != "header":
            rows.append((i, f"http://h{i}.org/x", page(f"<article>{body}{part}</article>")))
        elif not inside:
            rows.append((i, f"http://h{i}.org/x", page(f"{part}<main class='with-sidebar'>{body}</main>{part}")))
    assert set(texts(spark, rows).values()) == {wanted}


def test_pages_without_an_article(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    said = {i: f"{word()} {word()} {word()}" for i in range(8)}
    menu = lambda: "".join(f"<span><a href='/{w}'>{w}</a></span>" for w in (word(), word()))
    rows = [(i, f"https://one.org/{i}", page(f"<div id='q1'><div>{menu()}</div></div><div id='q2'>Send this to a friend</div><div id='q3'><p>{said[i]}</p><p>{i} more</p></div>")) for i in said]
    # What all pages share and what is all links goes; what is left differs from page to page.
    assert texts(spark, rows) == {i: f"{said[i]}\n{i} more" for i in said}
    # Two pages tell nothing apart.
    few = texts(spark, rows[:2])
    assert all("Send this to a friend" in t and said[i] in t for i, t in few.items())


def test_frequent_words_are_no_template(spark):
    rng = random.Random(2)
    common = ["the", "of", "and", "end"]
    body = lambda i: "".join(f"<p>{' '.join(rng.choices(common, k=rng.randint(3, 9)))} x{i}{j}</p>" for j in range(6)) + "<p>the end</p>" * (i % 3)
    rows = [(i, f"http://words.org/{i}", page(f"<div id='b'>{body(i)}</div>")) for i in range(12)]
    got = texts(spark, rows)
    assert all(got[i].count("\n") == 5 + i % 3 for i in got)


def test_teasers_and_wrappers(spark):
    article = "<article><p>Main text.</p></article>"
    bodies = [
        f"<div class='sidebar-layout'>{article}</div>", f"<main>{article}<div class='related'><article><p>Teaser</p></article></div></main>", f"{article}<div class='share-links'><p>Send</p></div>",
        f"<div class='pageHeader'><p>Top</p></div>{article}", f"<aside>{article.replace('Main', 'Side')}</aside>{article}", f"<article><header><h1>Main text.</h1></header></article><div class=menuBar>m</div>",
    ]
    got = texts(spark, [(i, f"http://w{i}.org/", page(b)) for i, b in enumerate(bodies)])
    assert set(got.values()) == {"Main text."}


def test_copies_on_one_host_keep_their_text(spark):
    rows = [(i, "http://copies.org/a", page("<nav><a>x</a></nav><article><h1>Same</h1><p>All of it.</p></article><footer>f</footer>")) for i in range(12)]
    assert set(texts(spark, rows).values()) == {"Same\nAll of it."}


def test_hard_rows(spark):
    long = "word " * 200_000
    rows = [
        (1, "http://a.org/", None), (2, "http://a.org/", ""), (3, None, "<article><p>no url"), (4, "nothing", "plain &amp text"), (5, "http://a.org/", "<article><p>open <b>tags<p>two"),
        (6, "http://a.org/", "<article>a<!-- never closed"), (7, "http://a.org/", "<article>a<script>if (a < b) {"), (8, "http://a.org/", "<article>1 < 2 &amp;&#x26;<p title='>'>q</p></article"),
        (9, "http://a.org/", f"<article><p>{long}</p></article>"), (10, "http://a.org/", "<article>" + "<div>" * 20_000 + "deep"), (11, "http://a.org/", "<article>a &am<b>p; b</article>"), (11, "http://a.org/", "<article>a &am<b>p; b</article>"),
        (12, "http://a.org/", "<"), (13, "http://a.org/", "<article>x</"),
    ]
    got = html_template.main_text(spark.createDataFrame(rows, SCHEMA))
    found = {r.page_id: r.text for r in got.collect()}
    assert found == {
        1: "", 2: "", 3: "no url", 4: "plain & text", 5: "open tags\ntwo", 6: "a", 7: "a", 8: "1 < 2 &&\nq", 9: long.strip(), 10: "deep", 11: "a &amp; b", 12: "<", 13: "x",
    }
    assert got.count() == len(rows) and got.where("n_chars <> length(text)").count() == 0
    assert html_template.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns(spark):
    given = spark.createDataFrame([(1, "http://a.org/", "<p>x", 7, "t", "h", "r")], "page_id long, url string, html string, n_chars int, text string, host_ string, row_ string").withColumn("classes_", F.lit("c"))
    got = html_template.main_text(given)
    assert got.columns == ["page_id", "url", "host_", "row_", "classes_", "text", "n_chars"]
    assert tuple(got.first()) == (1, "http://a.org/", "h", "r", "c", "x", 1)


def test_salts_and_small_bounds(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3 and 1}.org/{i}", page(f"<nav>n{i}</nav><article><p>text {i}</p></article>")) for i in range(60)]
    wanted = {i: f"text {i}" for i in range(60)}
    monkeypatch.setattr(html_template, "MOST_BROADCAST", 0)
    monkeypatch.setattr("graphloom.llm.skew.PER_TASK", 5)
    assert texts(spark, rows) == wanted


def test_classes_against_all_vectors(spark):
    """Classes of one host are the groups of tokens with equal counts on every page."""
    rng = random.Random(6)
    pages = ["".join(rng.choice(["<ul><li>a</ul>", "<div class=x><p>b</div>", "<p>c", "<h2>d</h2>"]) for _ in range(rng.randint(1, 6))) for _ in range(6)]
    read = [Page(p) for p in pages]
    rows = [("h", i, p.tokens) for i, p in enumerate(read)]
    table = spark.createDataFrame(rows, "host_ string, row_ long, tokens_ array<long>")
    sizes = spark.createDataFrame([("h", len(rows))], "host_ string, pages_ long")
    got = {frozenset(r["class"].tokens) for r in html_template.classes(table, sizes).collect()}
    vectors = {}
    for token in {t for p in read for t in p.tokens}:
        vectors.setdefault(tuple(p.tokens.count(token) for p in read), set()).add(token)
    assert got == {frozenset(t) for v, t in vectors.items() if sum(n > 0 for n in v) >= len(read) / 2}


def test_validity():
    outer, inner, crossing = ({"on": 3, "size": 2, "id": 1, "tokens": [1, 9]}, {"on": 2, "size": 2, "id": 2, "tokens": [2, 3]}, {"on": 1, "size": 2, "id": 3, "tokens": [4, 5]})
    walk = Walk([outer, inner, crossing])
    assert walk.broken([1, 2, 3, 2, 3, 9]) == [] and walk.broken([1, 3, 2, 9]) == [2]
    assert walk.broken([1, 2, 4, 3, 5, 9]) == [3] and walk.broken([1, 4, 9, 5]) == [3]
    assert walk.broken([1, 2, 9]) == [2]
    a, b, c = walk.slots([1, 2, 3, 9], [0, 1, 2])
    assert a == 0 and len({a, b, c}) == 3
