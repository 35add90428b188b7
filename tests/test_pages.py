"""Pages to trees, Markdown, links and warnings: literal cases, broken markup, hostile pages."""

import time
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lectern.operators import course_pages, pages
from lectern.operators.course_pages import page_rows
from lectern.operators.pages import resolve
from lectern.sources.html import Node, parse

SITE = "https://campus.example.org"

CASES = [
    ("<h3>Soil</h3><h5>Acid</h5><h6>Peat</h6>", {"min_heading": 2}, "## Soil\n\n#### Acid\n\n##### Peat"), ("<h3>Soil</h3><h5>Acid</h5>", {"min_heading": 6}, "###### Soil\n\n**Acid**"),
    ("<p>moss <strong>and</strong> <cite>fern</cite> <del>ash</del></p>", {}, "moss **and** *fern* ~~ash~~"), ('<p>key: <a href="k.html?x=1#top">the  key</a>', {}, f"key: [the key]({SITE}/mod/page/k.html?x=1#top)"),
    ("<ul><li>oak<ol><li>bark<li>leaf</ol><li>elm</ul>", {}, "- oak\n  1. bark\n  2. leaf\n- elm"),
    ("<table><tr><th>Tree<th>Age</tr><tr><td>Yew|Taxus<td>900 <b>y</b></tr><tr><td>short</tr></table>", {}, "| Tree | Age |\n| --- | --- |\n| Yew\\|Taxus | 900 **y** |\n| short |  |"),
    ("<blockquote>outer<blockquote><p>inner</blockquote></blockquote>", {}, "> outer\n>\n> > inner"), ("<pre>if a &lt; b:\n\treturn</pre>", {}, "```\nif a < b:\n\treturn\n```"),
    ('<div style="margin:1px;color:#c81e1e">Wear boots</div>', {}, "> ⚠️ Wear boots"), ("<p>Erratum — leaf 9</p>", {}, "> ⚠️ Erratum — leaf 9"), ("<p>erratums</p>", {}, "erratums"), ('<p>a <font color="#d00">b b b b b b</font></p>', {}, "> ⚠️ a b b b b b b"),
    ('<p>see the <b style="color:rgb(200, 10, 20)">red</b> list, it is long</p>', {}, "see the ⚠️ **red** list, it is long"), ('<p style="color: rgb(149,0,0)">not red</p>', {}, "not red"),
    ('<iframe src="https://www.youtube.com/embed/k"></iframe>', {}, "🎥 Video: https://www.youtube.com/embed/k"), ('<iframe src="https://h5p.org/e/1"></iframe>', {}, "🧩 Embedded: https://h5p.org/e/1"), ('<audio src="/a.mp3"></audio>', {}, f"🔊 Audio: {SITE}/a.mp3"),
    ("""<video data-setup-lazy='{"sources":[{"src":"https://www.youtube.com/watch?v=z"}]}'></video>""", {}, "🎥 Video: https://www.youtube.com/watch?v=z"), ("<video data-setup='{bad' src='/v.mp4'></video>", {}, f"🎥 Video: {SITE}/v.mp4"),
    ('<div class="mediaplugin"><iframe src="https://x.org/1"></iframe></div>', {}, "🎥 Video: https://x.org/1"),
    ('<script>f()</script><style>p{}</style><button>Go</button><span class="accesshide">hid</span><p>shown</p><p hidden>no</p>', {}, "shown"),
    (f'<img src="{SITE}/pluginfile.php/1/a b.png" alt="pic">', {"paths": {f"{SITE}/pluginfile.php/1/a b.png": "files/S/a b.png"}}, "![pic](<files/S/a b.png>)"), ('<img src="data:image/png;base64,x" alt="[inline]">', {}, "[image: inline]"),
    ("<p><b>x<p><b>y<p><b>z", {}, "**x**\n\n**y**\n\n**z**"), ("text<li>item</li>more", {}, "text\n- item\nmore"), ('<a href="/f/a%20b.pdf"></a>', {}, f"[a b.pdf]({SITE}/f/a%20b.pdf)"), ("<label>name</label>after", {}, "name\n\nafter"),
    ("<b><p>x</p><p>y</p></b>", {}, "**x\n\ny**"), ("<p>a<br><br><br>b</p>", {}, "a\n\nb"), ("<ul><li>a<table><tr><td>1</td></tr></table></li></ul>", {}, "- a\n  | 1 |\n  | --- |"), ("x < 5 &amp; y", {}, "x < 5 & y"), ("H<sup>2</sup>O <code>a`b</code>", {}, "H^2O `a'b`"),
    ('<script>var t="</p>"</script><ol start="3"><li>c</ol><hr>', {}, "3. c\n\n---"), ("<p>never <!-- ended", {}, "never"), ("", {}, ""), (None, {}, ""),
]


@pytest.mark.parametrize(("page", "options", "want"), CASES)
def test_markdown(page, options, want):
    assert pages.Markdown(f"{SITE}/mod/page/view.php?id=4", **options)(parse(page)) == want


# broken markup and the tree that the public parsing rules give
TREES = [
    ("<a href=/a>one<a href=/b>two</a>", '<a href="/a">one</a><a href="/b">two</a>'), ('<a href="a">a<table><a href="b">b</table>x', '<a href="a">a<a href="b">b</a><table></table></a><a href="b">x</a>'),
    ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"), ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"), ("<a><div><div>x</a>y", "<a></a><div><a></a><div><a>x</a>y</div></div>"), ("<font><p>a</font>b", "<font></font><p><font>a</font>b</p>"),
    ("<table><b>x</b><tr><td>1</td></tr>after</table>end", "<b>x</b>after<table><tr><td>1</td></tr></table>end"), ("<table>x<td>1", "x<table><tr><td>1</td></tr></table>"), ("<table> <tr> <td>a<tr><td>b</table>c", "<table> <tr> <td>a</td></tr><tr><td>b</td></tr></table>c"),
    ("<table><tr><td><table><tr><td>in</table>out</table>", "<table><tr><td><table><tr><td>in</td></tr></table>out</td></tr></table>"), ("<table><table>x", "<table></table>x<table></table>"), ("<b><table><tr><td><i>a</td><td>b</table>c", "<b><table><tr><td><i>a</i></td><td>b</td></tr></table>c</b>"),
    ("<table><caption>t<tr><td>x</table>", "<table><caption>t</caption><tr><td>x</td></tr></table>"), ("<td>x</td>y", "xy"), ("<p>a<table><tr><td>x</table>", "<p>a</p><table><tr><td>x</td></tr></table>"), ("<table><tr><p>x<td>y</table>", "<p>x</p><table><tr><td>y</td></tr></table>"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"), ("<li>a<div><li>b", "<li>a<div></div></li><li>b</li>"), ("<li>a<section><li>b", "<li>a<section><li>b</li></section></li>"), ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"), ("<h1>a<h2>b</h3>c", "<h1>a</h1><h2>b</h2>c"),
    ("<button>a<button>b", "<button>a</button><button>b</button>"), ("</p>x", "<p></p>x"), ("x</br>y", "x<br>y"), ("<p><b>x<p>y</b>z", "<p><b>x</b></p><p><b>y</b>z</p>"), ("<b><b><b><b><p>x", "<b><b><b><b><p>x</p></b></b></b></b>"),
    ("<head><title>t</title><p>x", "<head><title>t</title></head><p>x</p>"), ("<html><body class=a>x</body>y</html>z", '<html><body class="a">xyz</body></html>'), ("<object><b>x</object>y", "<object><b>x</b></object>y"),
]


@pytest.mark.parametrize(("page", "want"), TREES)
def test_tree(page, want):
    assert parse(page).markup().removeprefix("<root>").removesuffix("</root>") == want


HOSTILE = {
    "deep": "<div>" * 100_000 + "x", "spans": "<span>" * 1200 + "x", "formats": "<p><b>x" * 10_000, "red": "<font color=red>" * 3000 + "x", "quotes": "<blockquote>x" * 2000, "lists": "<ul><li>x" * 5000, "tables": "<table><tr><td>x" * 3000,
    "open tags": "<a " * 50_000, "open values": "<a href='" * 20_000, "comments": "<!-- x " * 50_000, "faces": "".join(f"<p><font size={i}>x" for i in range(5000)), "entities": "&" * 100_000 + "&#" + "9" * 5000 + ";", "right": "<div>a b" * 20_000, "overlap": "<b><p>x</b>" * 5000, "anchors": "<a href=x><div>" * 5000, "fosters": "<table>" + "<b>x<tr>" * 10_000, "crossed": "<b><i><u><p>x</b></i></u>" * 2000, "cells": "<table><tr>" + "<td><b>x" * 5000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_seconds(name):
    began = time.perf_counter()
    root = parse(HOSTILE[name])
    pages.Markdown(SITE)(root)
    assert len(list(pages.linked(root, SITE))) >= 0
    assert all(list(f(root)) is not None for f in (course_pages.course_rows, course_pages.course_facts)) and list(course_pages.page_rows(root, f"{SITE}/mod/page/view.php?id=1"))
    assert time.perf_counter() - began < 20


def test_a_page_that_cannot_be_read_is_a_row(spark, monkeypatch):
    def fails(root, base=None):
        if root.text() == "bad":
            raise RuntimeError("no")
        return [(0, root.text())]

    df = spark.createDataFrame([(1, "<p>good</p>"), (2, "bad"), (3, None)], "k int, html string")
    got = pages.page_rows(df, ["k"], "html", F.lit("x"), {"ord": "int", "text": "string"}, fails).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "good", None), (2, None, None, "RuntimeError: no"), (3, 0, "", None)]
    assert pages.extract_warnings(df, "k").columns == ["k", "ord", "text", "error"] and pages.extract_links(df.withColumn("url", F.lit("x")), "k").columns[-1] == "error"


def test_one_bad_page_is_a_row(spark, monkeypatch):
    rows = [(1, "<p>fine</p>", SITE), (2, None, None), (1, "<p>again</p>", SITE)]
    df = spark.createDataFrame(rows, "k int, html string, url string")
    got = sorted((r.k, r.md, r.n_chars, r.error) for r in pages.pages_to_markdown(df, "k").collect())
    assert got == [(1, "again", 5, None), (1, "fine", 4, None), (2, "", 0, None)]
    assert pages.pages_to_markdown(df.limit(0), "k").count() == pages.extract_links(df.limit(0), "k").count() == 0
    links = spark.createDataFrame([(1, '<a href="x">a</a><object data="/o"></object><frame src="/f"><video><source src="v.mp4"></video><a href="mailto:m">m</a>', f"{SITE}/p/"), (1, '<a href="y">a</a><embed src="e">', f"{SITE}/q/")], "k int, html string, url string")
    found = sorted(((r.tag, r.url, r.player) for r in pages.extract_links(links, "k").collect()), key=repr)
    assert found == sorted([("a", f"{SITE}/p/x", None), ("object", f"{SITE}/o", None), ("frame", f"{SITE}/f", None), ("source", f"{SITE}/p/v.mp4", "video"), ("a", None, None), ("a", f"{SITE}/q/y", None), ("embed", f"{SITE}/q/e", None)], key=repr)


def test_pages_made_of_rows_are_dealt_and_parsed_once(spark):
    """A table of one split is many pages: they are dealt over all tasks, and what is read of them is kept."""
    from lectern.jobs import course_jobs

    rows = spark.range(40).coalesce(1)
    parts = course_jobs.parts_of(rows, course_jobs.address("quiz", "id"), course_jobs.activity_page("<div class='quizinfo'><p>a</p></div>"))
    assert parts.where("kind = 'info'").count() == 40 and len(parts.inputFiles()) == 4
    assert "MapInPandas" not in parts._jdf.queryExecution().toString()


def test_rows_of_pages_leave_in_slices(spark, monkeypatch):
    """A task holds the rows of a few pages, not those of a whole batch; keys and order of the rows stay."""
    import pyarrow as pa

    from lectern.operators import course_pages

    monkeypatch.setattr(course_pages, "SLICE", 3)
    df = spark.createDataFrame([(str(i), f"https://c/mod/book/view.php?id={i}", "".join(f'<div class="book_chapter">n{i}.{k}</div>' for k in range(i))) for i in range(1, 9)], "course_id string, url string, html string")
    made = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema: made.append(fn))
    course_pages.parse_pages(df)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in df.orderBy("course_id").collect()])
    out = list(made[0](iter([batch])))
    assert [len(set(b.column("course_id").to_pylist())) for b in out] == [3, 3, 2]
    rows = [(r["course_id"], r["ord"]) for b in out for r in b.to_pylist()]
    assert rows == [(str(i), k) for i in range(1, 9) for k in range(i)]


@pytest.mark.parametrize("kind", ["lesson", "assign", "page", "folder", "quiz"])
def test_a_page_is_walked_once_for_all_its_parts(monkeypatch, kind):
    """Each kind of part looks at the elements as a list; the tree is walked for all, for the main part, and inside what was found."""
    root = parse('<html><body><section id="region-main"><div role="main">' + '<p>x <a href="/a?b=1">y</a></p>' * 50 + "</div></section></body></html>")
    seen = []
    walk = Node.walk
    monkeypatch.setattr(Node, "walk", lambda self: (seen.append(n) or n for n in walk(self)))
    list(page_rows(root, f"https://c.example.org/mod/{kind}/view.php?id=1"))
    assert len(seen) <= 2 * (4 + 100)


@pytest.mark.parametrize("base", ["https://c.example.org/mod/x?y#z", "http://h:80", "http://h?x", "https://H/x", "ftp://h/x", "", "https://u@h/x", "http://h\n"])
def test_plain_addresses_are_joined_as_others(base):
    for href in ("/a/b.php?x=1&y=2", "/a/../b", "/a/./b", "//h/x", "/a;b", "/a?", "/a..b/c.d", "/é", "/%2e/x", "/a?b=/c", "/.x", "/", "a/b", "?x"):
        assert resolve(href, base) == urljoin(base, href)
