"""Template deduction: classes against brute force, templates without telling names, copies, broken and deep pages."""

import time
from collections import Counter, defaultdict

import pytest

from docloom.llm import html_extract

SCHEMA = "page_id long, url string, html string, host string, known long, tokens string"
NEUTRAL = (
    '<body><{1}><div class="x1"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></div><h1>Story {0}</h1>{2}<div class="x3">Imprint <b>Contact</b></div></{1}></body>'
)


def run(spark, rows):
    return {r.page_id: r for r in html_extract.extract(spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)).collect()}


def story(i, k):
    return "".join(f"<p>Paragraph {j} of story {i} tells it</p>" for j in range(k))


@pytest.mark.parametrize("region", ["article", "main", "div"])
def test_neutral_menu_and_footer_go(spark, region):
    """Without a telling name: what stands in every page is template, a line of some pages isn't."""
    rows = [(i, f"http://n.example/{i}", NEUTRAL.format(i, region, story(i, i % 4 + 1) + "<p>All rights reserved</p>" * (i % 3 > 0))) for i in range(12)]
    out = run(spark, rows)
    for i in range(12):
        want = [f"Story {i}", *(f"Paragraph {j} of story {i} tells it" for j in range(i % 4 + 1)), *["All rights reserved"] * (i % 3 > 0)]
        assert out[i].text == "\n\n".join(want) and out[i].template_texts == 4
    alone = html_extract.Page(rows[3][2]).extract(set(), set(), set())[0]
    assert alone.startswith("Home") and alone.endswith("Imprint Contact")


def test_classes_equal_brute_force(spark):
    """Tokens of small hosts grouped by their whole occurrence vectors."""
    pages = [(i, f"http://h{i % 2}.example/{i}", NEUTRAL.format(i, "article", story(i, i % 3 + 1)) + "<section><i>b</i><u>c</u></section>" * (i % 4 == 0)) for i in range(24)]
    vectors = defaultdict(Counter)
    for i, _, source in pages:
        page = html_extract.Page(source)
        for key in [e.role for e in page.tags] + [k for k in page.keys() if k]:
            vectors[f"h{i % 2}.example", key][i] += 1
    tags = {e.role for _, _, s in pages for e in html_extract.Page(s).tags}
    want = defaultdict(set)
    for (host, key), v in vectors.items():
        want[host, tuple(sorted(v.items()))].add(key)
    want = {
        (host, frozenset(k for k in keys if k in tags or len(v) >= html_extract.CONSTANT_PAGES))
        for (host, v), keys in want.items()
        if len(v) >= 3 and keys & tags and (len(v) >= 6 or len(keys & tags) >= html_extract.LEAST_TAGS)
    }
    found = html_extract.classes(html_extract.occurrences(spark.createDataFrame(pages, "page_id long, url string, html string")))
    got = defaultdict(set)
    for r in found.collect():
        for x in r.tokens:
            got[r.host, x.cls].add(x.key)
    assert {(host, frozenset(keys)) for (host, _), keys in got.items()} == want


RECIPE = "<body><{1}><h1>Recipe {0}</h1><h2>Ingredients</h2>{2}<h2>Method</h2><p>mix item {0} with step {0}</p></{1}></body>"


@pytest.mark.parametrize("region", ["article", "main", "section"])
@pytest.mark.parametrize("pages", [4, 40])
def test_recurring_headings_stay(spark, region, pages):
    """Headings that all articles of a host share stand between what changes: whole texts as written."""
    items = lambda i: [f"flour {i} {j}" for j in range(i % 3 + 1)]
    rows = [(i, f"http://r.example/{i}", RECIPE.format(i, region, "<ul>" + "".join(f"<li>{x}</li>" for x in items(i)) + "</ul>")) for i in range(pages)]
    out = run(spark, rows)
    for i in range(pages):
        assert out[i].text == "\n\n".join([f"Recipe {i}", "Ingredients", *items(i), "Method", f"mix item {i} with step {i}"])


def test_first_heading_stays_and_labels_of_menus_go(spark):
    page = '<body><div class="x"><h2>Site of all</h2></div><article><h2>Overview</h2><p>about {0} only</p></article></body>'
    out = run(spark, [(i, f"http://f.example/{i}", page.format(i)) for i in range(20)])
    assert out[3].text == "Overview\n\nabout 3 only"
    page = '<body><div class="b"><p>first words of {0}</p><div class="l"><p>Sections</p></div><div class="m"><a href="/a">One</a><a href="/b">Two</a></div><p>Method</p><p>last words of {0} here</p></div></body>'
    out = run(spark, [(i, f"http://f.example/{i}", page.format(i)) for i in range(20)])
    assert out[3].text == "first words of 3\n\nMethod\n\nlast words of 3 here"


def test_near_copies_keep_their_common_texts(spark):
    """Short pages that differ in one paragraph: all paragraphs stay, a footer of its own goes."""
    paragraphs = [f"the common paragraph {j} with some words" for j in range(5)]
    page = '<body><div class="t">' + "".join(f"<p>{p}</p>" for p in paragraphs[:2]) + "<p>page {0}</p>" + "".join(f"<p>{p}</p>" for p in paragraphs[2:]) + '</div><div class="z"><p>Imprint</p></div></body>'
    out = run(spark, [(i, f"http://c.example/{i}", page.format(i)) for i in range(20)])
    assert out[7].text == "\n\n".join([*paragraphs[:2], "page 7", *paragraphs[2:]])


def test_unordered_tags_are_no_template(spark):
    pages = [(i, f"http://o.example/{i}", "<body>" + ("<b>Top</b><i>Low</i>" if i % 2 else "<i>Low</i><b>Top</b>") + f"<p>text {i}</p></body>") for i in range(10)]
    assert run(spark, pages)[3].text == "TopLow\n\ntext 3"


def test_copies_are_no_template(spark):
    page = NEUTRAL.format(7, "article", "<p>the same words all over</p>" * 3)
    assert "Story 7" in run(spark, [(i, f"http://n.example/{i}", page) for i in range(12)])[2].text
    rare = "<article><h1>T</h1><p>one copied text</p><p>another copied text</p><table><tr><td>cell</td></tr></table><p>end of it</p></article>"
    out = run(spark, [(i, f"http://n.example/{i}", rare if i < 7 else f"<article><h1>Story {i}</h1><p>text {i} is here</p></article>") for i in range(20)])
    assert out[2].text == "T\n\none copied text\n\nanother copied text\n\ncell\n\nend of it" and out[9].text == "Story 9\n\ntext 9 is here"


def test_template_takes_texts_of_the_table(spark):
    """Menus of the table's pages go by the template, with all names taken away too."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert sum(r.template_texts > 0 for r in want.values()) > 100
    rows = []
    for r in pages.collect():
        s = r.html
        for k, tag in enumerate(("nav", "footer", "article")):
            s = s.replace(f"<{tag}>", f'<div class="x{k}">').replace(f"</{tag}>", "</div>")
        rows.append((r.page_id, r.url, s))
    plain = {r[0]: html_extract.Page(r[2]).extract(set(), set(), set())[0] for r in rows}
    out = run(spark, rows)
    hosts = [i for i in out if out[i].template_slots]
    assert sum(out[i].text != plain[i] for i in hosts) == len(hosts) > 100
    assert all(want[i].text in out[i].text for i in hosts)


@pytest.mark.parametrize(
    "source",
    [
        "<div>" * 50_000 + "x", "<div>a" * 50_000, '<a "' * 50_000, '<a x="' * 50_001, "<a " * 100_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000, "<div>" * 50_000 + "</p>" * 50_000,
        "<ul><li>" * 30_000, "<table><tr><td>" * 20_000, "<!--" * 100_000, "&amp" * 100_000, "< " * 200_000, "<a =" * 100_000, "".join(f'<p class="a{i}">x' for i in range(50_000)), "<![CDATA[" * 50_000,
    ],
    ids=lambda s: s[:8],
)
def test_time_is_linear(source):
    began = time.perf_counter()
    html_extract.Page(source).extract({1}, {2}, {3})
    assert time.perf_counter() - began < 5


def test_odd_pages(spark):
    deep = "<div>" * 20_000 + "deep"
    rows = [(1, "http://d.example/1", deep), (1, "http://d.example/1", deep), (None, None, "<p>x</p>"), (3, "http://d.example/3", None), (4, "odd url", "")]
    rows += [(5, "http://d.example/5", "<main>see <math><mi>x</mi></math> <select><option>o</select> a < b &amp; c <noscript>n</noscript><object>d</object></main>")]
    rows += [(6, "http://d.example/6", '<p title="a>b">one</p><p x="open>two</p><p>three</p>'), (7, "http://d.example/7", "<p>begun <!-- never ended"), (8, "http://d.example/8", "<p>cut off <a hre")]
    out = html_extract.extract(spark.createDataFrame([(*r, "", 0, "") for r in rows], SCHEMA)).collect()
    assert len(out) == len(rows) and sum(r.text == "deep" for r in out) == 2
    text = {r.page_id: r.text for r in out}
    assert text[None] == "x" and text[3] == text[4] == "" and text[5] == "see x o a < b & c nd" and text[6] == "one\n\ntwo\n\nthree" and text[7] == "begun" and text[8] == "cut off"
