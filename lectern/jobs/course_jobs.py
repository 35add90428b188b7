"""Queries of the page and course jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.jobs.registry import query
from lectern.jobs.sources import read
from lectern.operators import course, course_export, pages
from lectern.operators.stored import dealt, shared_folder, stored
from lectern.sources.files import write_named

SITE = "https://campus.example.org"


def activity_page(body, header="", crumbs=None, after=""):
    """A page of the platform around a column or text."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    trail = F.lit("") if crumbs is None else F.concat(F.lit('<div id="page-navbar"><ol class="breadcrumb">'), crumbs, F.lit("</ol></div>"))
    return F.concat(F.lit("<html><body>"), trail, F.lit('<section id="region-main"><div class="activity-header">'), lit(header), F.lit('</div><div role="main">'), lit(body), F.lit("</div></section>"), lit(after), F.lit("</body></html>"))


def parts_of(df, url, html):
    """Parsed parts of pages built from a table, whose rows are dealt out first: each is a page to parse. Kept for all that read them."""
    return stored(course.parse_pages(dealt(df).select(F.lit("c").alias("course_id"), url.alias("url"), html.alias("html"))), "parts")


def address(kind, key, more=""):
    return F.concat(F.lit(f"{SITE}/mod/{kind}/view.php?id="), F.col(key).cast("string"), F.lit(more))


@query("select page_id from pages where page_id % 3 = 0")
def r01_html_pages(spark, d):
    third = F.col("page_id") % 3
    c = read(spark, d, "pages").select("page_id", F.when(third == 2, "https://c/pluginfile.php/1/a.html").otherwise(F.col("url")).alias("url"), F.lit(None).cast("string").alias("final_url"), F.when(third == 1, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"))
    return pages.html_pages(c).select("page_id")


@query(r"""select page_id, md, length(md) as n_chars from (select page_id, array_to_string(list_concat(['### ' || replace(head, '**', '')], list_transform(texts, lambda x: '**' || x || '**')), chr(10) || chr(10)) as body, ad,
 ad || chr(10) || chr(10) || body as md from (select page_id, clean[1] as ad, clean[2] as head, list_filter(clean[3:], lambda x: x <> '') as texts from (select page_id,
 list_transform(list_concat([regexp_extract(html, '<div class="ad">([^<]*)', 1), regexp_extract(html, '<h1>([^<]*)', 1)], regexp_extract_all(html, '<(?:p>(?:<b>)?|footer>)([^<]*)', 1)),
 lambda x: regexp_replace(list_reduce([trim(regexp_replace(x, '\s+', ' ', 'g')), '&copy;©', '&middot;·', '&quot;"', '&lt;<', '&gt;>', '&#x27;'''], lambda a, e: replace(a, e[:-2], e[-1])), '&amp;?', '&', 'g')) as clean from pages)))""")
def p01_pages_to_markdown(spark, d):
    """Real pages, whose first <b> never ends: all later paragraphs are bold."""
    return pages.pages_to_markdown(read(spark, d, "pages"), "page_id").drop("error")


@query("""select doc_id, '### H ' || doc_id || chr(10) || chr(10) || '**b' || doc_id || '** ' || w || ' [l](https://campus.example.org/' || doc_id || ')' || chr(10) || chr(10) || '3. ' || w || chr(10) || '   - x' || chr(10) || '4. *y*' || chr(10) || chr(10) || '| A | ' || w || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | p \\| q |' || chr(10) || chr(10) || '> ⚠️ red ' || doc_id || chr(10) || chr(10) || '> ' || w
 || chr(10) || chr(10) || '```' || chr(10) || 'a  < b' || chr(10) || '```' || chr(10) || chr(10) || '🎥 Video: https://youtu.be/' || doc_id || chr(10) || chr(10) || '**one**' || chr(10) || chr(10) || '**two**' as md, null as error from (select doc_id, coalesce(regexp_extract(text, '[A-Za-z]+'), '') as w from documents) where w <> ''""")
def p01_markdown_of_built_pages(spark, d):
    """Every kind of block, composed from a document's id and first word; the words come back as Markdown."""
    docs = read(spark, d, "documents").select("doc_id", F.coalesce(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("")).alias("w")).where("w <> ''")
    k, w, lit = F.col("doc_id").cast("string"), F.col("w"), F.lit
    html = F.concat(
        lit("<nav>gone</nav><script>var t='</p>'</script><h2>H "), k, lit("</h2><p><b>b"), k, lit("</b>  "), w, lit('\n<a href="/'), k, lit('">l</a> <span class="accesshide">hid</span></p><ol start=3><li>'), w, lit("<ul><li>x</ul><li><em>y</em></ol><table><tr><th>A<th>"), w,
        lit('<tr><td>1<td>p | q</table><p style="color:#e00">red '), k, lit("</p><blockquote><p>"), w, lit("</p></blockquote><pre>a  &lt; b</pre><div class=mediaplugin><iframe src='https://youtu.be/"), k, lit("'></iframe></div><p><b>one<p>two"),
    )
    return pages.pages_to_markdown(docs.select("doc_id", html.alias("html"), F.lit(f"{SITE}/c").alias("url")), "doc_id").select("doc_id", "md", "error")


@query("""select doc_id, '[one](' || s || '/a' || doc_id || ') [two](' || s || '/b' || doc_id || ') before ' || doc_id || 'after' || p || '| 1 | **b** |' || chr(10) || '| --- | --- |' || p || 'x**y*z****w*' || p || 'u' || p || '**v**t' || p || '[in](' || s || '/c) [out](' || s || '/d)' || p || '| k |' || chr(10) || '| --- |' as md
 from (select doc_id, 'https://campus.example.org' as s, chr(10) || chr(10) as p from documents)""")
def p01_broken_markup(spark, d):
    """Anchors in anchors, text in tables outside cells, formatting that overlaps blocks, as browsers mend them."""
    k = F.col("doc_id").cast("string")
    html = F.concat(
        F.lit("<a href=/a"), k, F.lit(">one<a href=/b"), k, F.lit(">two</a><table>before "), k, F.lit("<tr><td>1<td><b>b</td></tr>after</table><p>x<b>y<i>z</b>w</i></p><div>u<b><p>v</b>t</p></div>"),
        F.lit("<table><tr><a href=/c>in<td>k</td></a></tr><a href=/d>out</table>"),
    )
    docs = read(spark, d, "documents").select("doc_id", html.alias("html"), F.lit(f"{SITE}/c").alias("url"))
    return pages.pages_to_markdown(docs, "doc_id").select("doc_id", "md")


@query("select page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) as href from pages")
def p02_extract_links(spark, d):
    return pages.extract_links(read(spark, d, "pages"), "page_id").where("tag = 'a'").select("page_id", "href")


@query("select page_id, k from (select page_id, unnest([1, 3]) as k from pages)")
def p03_select_assets(spark, d):
    o = "https://campus.example.org"
    kinds = [(1, "a", f"{o}/pluginfile.php/1/x.pdf", None), (2, "a", f"{o}/pluginfile.php/1/x.mp4", None), (3, "a", f"{o}/mod/resource/view.php?id=4", None), (4, "video", f"{o}/pluginfile.php/1/x.mp4", "video"), (5, "a", "https://other/x.pdf", None)]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("tag"), F.lit(u).alias("url"), F.lit(p).cast("string").alias("player")) for k, t, u, p in kinds)))
    return pages.select_assets(read(spark, d, "pages").select("page_id", each.alias("x")).select("page_id", "x.*")).select("page_id", "k")


@query("select page_id, '[f](files/' || page_id || '.pdf) [g](https://campus.example.org/pluginfile.php/2/g.pdf)' as md from pages")
def p04_local_links(spark, d):
    o = "https://campus.example.org/pluginfile.php"
    p = read(spark, d, "pages").select("page_id", F.lit("https://campus.example.org/c").alias("url"), F.concat(F.lit(f'<p><a href="{o}/1/'), "page_id", F.lit(f'/f.pdf?forcedownload=1">f</a> <a href="{o}/2/g.pdf">g</a></p>')).alias("html"))
    assets = p.select(F.concat(F.lit(f"{o}/1/"), "page_id", F.lit("/f.pdf")).alias("key"), F.concat(F.lit("files/"), "page_id", F.lit(".pdf")).alias("path"))
    paths = pages.asset_map(pages.extract_links(p, "page_id"), assets, "page_id")
    return pages.pages_to_markdown(p.join(paths, "page_id", "left"), "page_id", url_map="paths").select("page_id", "md")


@query("select page_id, case page_id % 4 when 0 then 'all red ' || page_id when 1 then 'Erratum: x' else 'mostly red text a' end as text from pages where page_id % 4 < 3")
def p05_extract_warnings(spark, d):
    html = F.element_at(F.array(F.concat(F.lit('<div style="margin:0; color: #e00">all red <b>'), "page_id", F.lit("</b></div>")), F.lit("<p>Erratum: x</p>"), F.lit('<p><font color="red">mostly red text</font> a</p>'), F.lit("<p>plain</p>")), (F.col("page_id") % 4 + 1).cast("int"))
    return pages.extract_warnings(read(spark, d, "pages").select("page_id", html.alias("html")), "page_id").select("page_id", "text")


def tree(spark, d):
    """region, nation, customer as sections of one course."""
    r = read(spark, d, "region").select(F.lit("c").alias("course_id"), F.concat(F.lit("r"), "r_regionkey").alias("section_id"), F.lit(None).cast("string").alias("parent_section_id"), F.col("r_name").alias("title"))
    n = read(spark, d, "nation").select(F.lit("c").alias("course_id"), F.concat(F.lit("n"), "n_nationkey").alias("section_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_section_id"), F.col("n_name").alias("title"))
    c = read(spark, d, "customer").select(F.lit("c").alias("course_id"), F.concat(F.lit("k"), "c_custkey").alias("section_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_section_id"), F.col("c_name").alias("title"))
    return r.unionByName(n).unionByName(c)


COURSE_HTML = """<html><body class="course-{k}"><header><h1>Course {k}</h1></header><div class="courseindex"><ul><li class="section" data-id="999"></li></ul></div><div id="region-main"><ul class="topics"><li class="section" data-id="1" data-number="5"><h3 class="sectionname"></h3><h4>One {k}<span class="sr-only">x</span></h4><div class="summarytext">About {k}</div>
<ul class="section"><li class="activity modtype_quiz" data-id="7"><a class="aalink" href="/mod/quiz/view.php?id=7"><span class="instancename">Quiz <span class="accesshide">q</span></span></a><div class="completion-info">Done</div><div class="activity-dates"><div>Due: {k}</div></div></li><li class="activity modtype_label" id="module-8"><div class="description">Some text</div></li>
<li class="activity modtype_subsection" data-id="9"><div data-activityname="Inner"><div data-for="section" data-id="4"><ul data-for="cmlist"><li class="activity modtype_page" data-id="11">Deep</li></ul></div></div></li></ul></li>
<li class="section" data-id="2" data-number="8"></li></ul></div></body></html>"""
REMOTE_HTML = """<div id="region-main"><ul><li class="section" data-id="2" data-number="8"><ul data-for="cmlist"><li class="activity modtype_url" data-id="12"><span class="activityname">Away</span></li></ul></li></ul></div>"""


def course_pages(spark, d):
    p = read(spark, d, "pages").select(F.col("page_id").cast("string").alias("course_id"))
    main = p.select("course_id", F.lit(f"{SITE}/course/view.php?id=1").alias("url"), F.replace(F.lit(COURSE_HTML), F.lit("{k}"), F.col("course_id")).alias("html"))
    return course.parse_course(main.unionByName(p.select("course_id", F.lit(f"{SITE}/course/section.php?id=2").alias("url"), F.lit(REMOTE_HTML).alias("html"))))


@query("""select cast(page_id as varchar) as course_id, v.* from pages, lateral (values ('1', null, 'One ' || page_id, true, 'view'), ('4', '1', 'Section', true, 'view'), ('2', null, 'Section 8', false, 'view'), ('2', null, 'Section 8', true, 'section')) v(section_id, parent, title, has_content, page)""")
def c01_parse_sections(spark, d):
    page = F.regexp_extract("url", r"/course/(\w+)", 1).alias("page")
    return course.parse_sections(course_pages(spark, d)).select("course_id", "section_id", F.col("parent_section_id").alias("parent"), "title", "has_content", page)


@query("""select cast(page_id as varchar) as course_id, v.* from pages, lateral (values ('1', null, 'One ' || page_id, 'quiz,label,subsection'), ('4', '1', 'Inner', 'page'), ('2', null, 'Section 8', 'url')) v(section_id, parent, title, activities)""")
def c02_attach_remote(spark, d):
    """A section without content takes it from its own page; an inline subsection takes its activity's title. The parsed rows are kept: six steps read them."""
    rows = stored(course_pages(spark, d), "rows")
    sections, acts = course.attach_remote_sections(course.parse_sections(rows), course.parse_activities(rows), F.col("url").contains("/course/view.php"))
    held = acts.groupBy("course_id", "section_id").agg(F.array_join(course.in_order(F.col("ord"), F.col("type")), ",").alias("activities"))
    return sections.join(held, ["course_id", "section_id"], "left").select("course_id", "section_id", F.col("parent_section_id").alias("parent"), "title", "activities")


@query("""select 'r' || r_regionkey as section_id, 2 as level, r_name as path from region union all select 'n' || n_nationkey, 3, r_name || '/' || n_name from nation join region on n_regionkey = r_regionkey
 union all select 'k' || c_custkey, 4, r_name || '/' || n_name || '/' || c_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def c03_section_paths(spark, d):
    return course.section_paths(tree(spark, d)).select("section_id", "level", F.array_join("path", "/").alias("path"))


@query("select l_orderkey as course_id, l_linenumber as cmid, min(l_partkey * 1000 + l_suppkey) as ord from lineitem group by all")
def c04_dedupe_activities(spark, d):
    a = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("course_id"), F.col("l_linenumber").alias("cmid"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ord"))
    return course.dedupe_activities(a)


@query("""select cast(page_id as varchar) as course_id, v.* from pages, lateral (values ('7', 'quiz', 'Quiz', '1', 'Done', 'Due: ' || page_id), ('8', 'label', 'Some text', '1', '', ''), ('9', 'subsection', 'Inner', '1', '', ''), ('11', 'page', 'Deep', '4', '', ''), ('12', 'url', 'Away', '2', '', '')) v(cmid, type, title, section_id, completion, dates)""")
def c04_parse_activities(spark, d):
    return course.parse_activities(course_pages(spark, d)).select("course_id", "cmid", "type", "title", "section_id", "completion", F.array_join("dates", "|").alias("dates"))


@query("select page_id, min(page_id) over (partition by split_part(url, '#', 1)) as asset from pages")
def c05_dedupe_assets(spark, d):
    p = read(spark, d, "pages").select(F.lit("c").alias("course_id"), F.regexp_replace("url", "([?#].*)?$", "").alias("u"), "url", "page_id")
    return course.dedupe_assets(p.select("course_id", "url", F.lit(None).cast("string").alias("final_url"), "page_id"), ["page_id"]).select("page_id", F.col("asset.page_id").alias("asset"))


@query("""select doc_id, case when n = 1 then 'files/' || source || '/a' || h || '.pdf' else 'files/' || source || '/a' || h || ' (' || n || ').pdf' end as path from (select *, row_number() over (partition by source, h order by doc_id) as n from (select doc_id, source, doc_id % 3 as h from documents))""")
def c06_place_assets(spark, d):
    rows = read(spark, d, "documents").select(F.lit("c").alias("course_id"), F.array("source").alias("parts"), F.concat(F.lit('attachment; filename="a'), (F.col("doc_id") % 3).cast("string"), F.lit('.pdf"')).alias("disposition"), F.concat(F.lit("https://c/f/"), "doc_id").alias("url"), F.lit("application/pdf").alias("mime"), F.col("doc_id").alias("ord"))
    return course.place_assets(rows).select(F.col("ord").alias("doc_id"), "path")


@query("""select p_partkey, case when p_size % 2 = 0 then 'Home / ' || p_name else '' end as breadcrumb, case when p_size % 2 = 0 then p_partkey % 2 = 1 else false end as mismatch, case when p_size % 2 = 0 then 'd0|Opened: ' || p_partkey else 'd0' end as dates, case when p_size % 2 = 0 then 'To do' else '' end as completion from part""")
def c07_page_common(spark, d):
    p = read(spark, d, "part")
    title = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise("zzz")
    a = p.select("p_partkey", F.lit("c").alias("course_id"), F.col("p_partkey").cast("string").alias("cmid"), F.lit("page").alias("type"), title.alias("section_title"), F.lit("").alias("completion_raw"), F.array(F.lit("d0")).alias("dates"))
    header = F.concat(F.lit('<div class="completion-info">To  do</div><div data-region="activity-dates"><div>d0</div><div>Opened: '), "p_partkey", F.lit("</div></div>"))
    html = activity_page("text", header, F.concat(F.lit("<li>Home</li><li> </li><li> "), "p_name", F.lit("</li>")))
    out = course.page_common(a, parts_of(p.where("p_size % 2 = 0"), address("page", "p_partkey"), html))
    return out.select("p_partkey", "breadcrumb", F.col("breadcrumb_mismatch").alias("mismatch"), F.array_join("dates", "|").alias("dates"), "completion")


@query("select o_orderkey, 'Attempts allowed: ' || o_custkey || '|plain|Feedback: f ' || o_orderkey as lines, cast(o_custkey as varchar) as attempts from orders")
def c08_quiz_facts(spark, d):
    """Different info lines in order, the feedback, and the meta map, from quiz pages."""
    body = F.concat(F.lit('<div class="quizinfo"><p>Attempts allowed: '), "o_custkey", F.lit("</p><p>plain</p><p>Attempts  allowed: "), "o_custkey", F.lit('</p></div><div id="feedback">f\n'), "o_orderkey", F.lit("</div>"))
    lines, meta = course.quiz_facts(parts_of(read(spark, d, "orders"), address("quiz", "o_orderkey"), activity_page(body)))
    joined = lines.groupBy("course_id", "cmid").agg(F.array_join(course.in_order(F.col("ord"), F.col("line")), "|").alias("lines"))
    return joined.join(meta, ["course_id", "cmid"]).select(F.col("cmid").cast("bigint").alias("o_orderkey"), "lines", F.col("meta")["attempts"].alias("attempts"))


@query("select l_orderkey, count(distinct l_linenumber) as n_lines, max(case when l_linenumber = 1 then 'v' else '' end) as attempts from lineitem group by 1")
def c08_line_facts(spark, d):
    label = F.when(F.col("l_linenumber") == 1, "Attempts allowed : v").otherwise(F.concat(F.lit("line "), "l_linenumber"))
    lines, meta = course.line_facts(read(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("ord"), label.alias("line")), ["l_orderkey"])
    n = lines.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    return n.join(meta, "l_orderkey", "left").select("l_orderkey", "n_lines", F.coalesce(F.try_element_at("meta", F.lit("attempts")), F.lit("")).alias("attempts"))


@query("select o_orderkey, case when o_custkey % 2 = 0 then 'none ' || o_custkey else '' end as status, strftime(o_orderdate, '%Y-%m-%d') as due, 'https://campus.example.org/pluginfile.php/' || o_orderkey || '/a.pdf' as attached from orders")
def c09_assign_facts(spark, d):
    o = read(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    row = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("<tr><th>Submission status</th><td>none "), "o_custkey", F.lit("</td></tr>"))).otherwise(F.lit("<tr><td>lone</td></tr>"))
    body = F.concat(F.lit('<div class="submissionstatustable"><table>'), row, F.lit("<tr><th>Due date</th><td> "), "day", F.lit("</td></tr><tr><th>Due again</th><td>later</td></tr></table></div>"))
    header = F.concat(F.lit('<div data-region="intro-attachments"><a href="/pluginfile.php/'), "o_orderkey", F.lit('/a.pdf">a</a></div>'))
    parts = parts_of(o, address("assign", "o_orderkey"), activity_page(body, header))
    files = course.own_parts(parts).where("role = 'attachment'").select("course_id", "cmid", F.col("link").alias("attached"))
    get = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit(""))
    return course.assign_facts(parts).join(files, ["course_id", "cmid"]).select(F.col("cmid").cast("bigint").alias("o_orderkey"), get("submissionStatus").alias("status"), get("due").alias("due"), "attached")


@query("""select conv_id, turn, 'S' || conv_id || '.' || turn as subject, turn % 3 > 0 as found from (select *, row_number() over (partition by conv_id order by turn) as n from (select distinct conv_id, turn from conversations)) where n <= 10""")
def c10_forum_posts(spark, d):
    """The first ten discussions of a forum page by their number d, each linked twice, and the first posts that were captured."""
    t = read(spark, d, "conversations").select("conv_id", "turn").distinct()
    link = F.concat(F.lit(f'<a href="{SITE}/mod/forum/discuss.php?d='), "conv_id", F.lit("x"), "turn", F.lit('&amp;p=1">S'), "conv_id", F.lit("."), "turn", F.lit("</a>"))
    forum = t.groupBy("conv_id").agg(F.array_join(course.in_order(F.col("turn"), F.concat(link, F.replace(link, F.lit("p=1"), F.lit("p=2")))), "").alias("body"))
    post = F.concat(F.lit('<article data-region="post"><header><h3>S'), "conv_id", F.lit("."), "turn", F.lit("</h3></header></article>"))
    lists = parts_of(forum, address("forum", "conv_id"), activity_page(F.col("body")))
    posts = parts_of(t.where("turn % 3 > 0"), F.concat(F.lit(f"{SITE}/mod/forum/discuss.php?d="), "conv_id", F.lit("x"), "turn"), activity_page(post))
    out = course.forum_posts(lists.unionByName(posts))
    return out.select(F.col("cmid").cast("bigint").alias("conv_id"), F.split_part("d", F.lit("x"), F.lit(2)).cast("bigint").alias("turn"), "subject", "found")


@query("""select o_orderkey, '1. A|B ' || o_custkey as outline, case when o_custkey % 3 < 2 then 'https://campus.example.org/export/lesson.php?k=' || o_custkey || case o_custkey % 3 when 0 then '&t=pdf' else '&sesskey=pdf' end else 'https://campus.example.org/export/lesson.php?k=html' end as url, o_custkey % 3 = 1 as fallback from orders""")
def c11_lesson_plan(spark, d):
    """A PDF by its address is preferred; a link that may not be asked for leaves the menu's pages."""
    better = F.when(F.col("o_custkey") % 3 < 2, F.concat(F.lit('<a href="/export/lesson.php?k='), "o_custkey", F.get(F.array(F.lit("&amp;t=pdf"), F.lit("&amp;sesskey=pdf")), (F.col("o_custkey") % 3).cast("int")), F.lit('">x</a>'))).otherwise("")
    body = F.concat(F.lit('<a href="/export/lesson.php?k=html">As pdf</a>'), better)
    after = F.concat(F.lit('<div class="menuwrapper"><ul><li>1. A</li><li> </li><li><a href="/mod/lesson/view.php?id=1&amp;pageid=2">B '), "o_custkey", F.lit("</a></li></ul></div>"))
    plan = course.lesson_plan(parts_of(read(spark, d, "orders"), address("lesson", "o_orderkey"), activity_page(body, after=after)))
    return plan.select(F.col("cmid").cast("bigint").alias("o_orderkey"), F.array_join("outline", "|").alias("outline"), "url", "fallback")


@query("""select page_id, case page_id % 4 when 0 then 'https://h5p.example.net/e' when 1 then 'https://out.example.net/' || page_id when 2 then 'https://work.example.net/' || page_id else '(could not determine — open the activity''s link)' end as external from pages""")
def c12_external_url(spark, d):
    """The workaround link, else a frame or object, else the first address off the site, else a message."""
    out = F.concat(F.lit('<a href="https://out.example.net/'), "page_id", F.lit('">x</a>'))
    body = F.element_at(F.array(F.concat(out, F.lit('<object data="https://h5p.example.net/e"></object>')), out, F.concat(out, F.lit('<iframe src="https://h5p.example.net/e"></iframe><div class="urlworkaround"><a href="https://work.example.net/'), "page_id", F.lit('">y</a></div>')), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    parts = parts_of(read(spark, d, "pages").drop("url", "html"), address("url", "page_id", "&forceview=1"), activity_page(F.concat(F.lit('<a href="/in">in</a>'), body)))
    return course.page_external(parts).select(F.col("cmid").cast("bigint").alias("page_id"), "external")


@query("""select o_custkey, o_orderkey, o_custkey % 2 = 0 as whole from orders where o_custkey % 2 = 0 union all select o_custkey, 0, false from orders where o_custkey % 2 = 1 group by 1""")
def c13_book_chapters(spark, d):
    """All chapters of a captured print page, else the book's own page."""
    o = read(spark, d, "orders")
    chapters = o.groupBy("o_custkey").agg(F.array_join(course.in_order(F.col("o_orderkey"), F.concat(F.lit('<div class="book_chapter">n'), "o_orderkey", F.lit("</div>"))), "").alias("body"))
    printed = parts_of(chapters.where("o_custkey % 2 = 0"), F.concat(F.lit(f"{SITE}/mod/book/tool/print/index.php?id="), "o_custkey"), F.concat(F.lit("<body>"), "body", F.lit("</body>")))
    plain = parts_of(o.select("o_custkey").distinct(), address("book", "o_custkey"), activity_page("n0"))
    out = course.book_chapters(printed.unionByName(plain))
    return out.select(F.col("cmid").cast("bigint").alias("o_custkey"), F.regexp_extract("html", r"n(\d+)<", 1).cast("bigint").alias("o_orderkey"), "whole")


@query("""select o_orderkey, case when o_custkey % 2 = 0 then 'a b' else 'c' end as sub, 'https://campus.example.org/pluginfile.php/9/mod_folder/content/0/' || case when o_custkey % 2 = 0 then 'a%20b' else 'c' end || '/' || o_orderkey || '.pdf' as url from orders""")
def c14_folder_files(spark, d):
    """Links of the best tier, each once, with their sub-folders."""
    file = lambda sub: F.concat(F.lit(f'<a href="/pluginfile.php/9/mod_folder/content/0/{sub}/'), "o_orderkey", F.lit('.pdf">f</a>'))
    body = F.concat(file("c"), file("c"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit('<div class="foldertree">'), file("a%20b"), file("a%20b"), F.lit("</div>"))).otherwise(""))
    out = course.page_folder_files(parts_of(read(spark, d, "orders"), address("folder", "o_orderkey"), activity_page(body)))
    return out.select(F.col("cmid").cast("bigint").alias("o_orderkey"), F.array_join("sub", "/").alias("sub"), "url")


@query("""select o_orderkey, 'https://campus.example.org/pluginfile.php/' || case o_custkey % 3 when 0 then 'w' when 1 then 'o' else 'a' end || o_orderkey as url from orders""")
def c15_resource_link(spark, d):
    """The workaround link, else an embedded file, else a link outside the header."""
    rank = F.col("o_custkey") % 3
    link = lambda kind: F.concat(F.lit(f"/pluginfile.php/{kind}"), F.col("o_orderkey").cast("string"))
    body = F.concat(
        F.lit('<a href="'), link("a"), F.lit('">a</a>'), F.when(rank < 2, F.concat(F.lit('<object data="'), link("o"), F.lit('"></object>'))).otherwise(""), F.when(rank == 0, F.concat(F.lit('<div class="resourceworkaround"><a href="'), link("w"), F.lit('">w</a></div>'))).otherwise(""),
    )
    parts = parts_of(read(spark, d, "orders"), address("resource", "o_orderkey"), activity_page(body, '<a href="/pluginfile.php/intro">i</a>'))
    return course.resource_link(parts).select(F.col("cmid").cast("bigint").alias("o_orderkey"), "url")


@query("""with s as (select n_nationkey, n_name from nation), a as (select c_nationkey, string_agg('### 📃 ' || c_name || chr(10) || chr(10) || '- Type: `page` · Link: https://campus.example.org/mod/page/view.php?id=' || c_custkey || chr(10) || '- Files:' || chr(10) || '  - [f ' || c_custkey || '.pdf](<files/Part/' || c_name || '/f ' || c_custkey || '.pdf>)' || chr(10) || chr(10) || 'Text **' || c_custkey || '** [f](<files/Part/' || c_name || '/f ' || c_custkey || '.pdf>)', chr(10) || chr(10) order by c_custkey) as t, count(*) as n from customer group by 1)
 select cast(n_nationkey as varchar) as course_id, '# ' || n_name || chr(10) || chr(10) || '- URL: https://campus.example.org/course/view.php?id=' || n_nationkey || chr(10) || '- Scraped: 2025-01-02T00:00:00' || chr(10) || '- Activities: ' || coalesce(n, 0) || ' · Files: ' || coalesce(n, 0) || chr(10) || chr(10) || '## Deadlines & evaluations' || chr(10) || chr(10) || '_No quizzes, assignments or lessons found._' || chr(10) || chr(10) || '## Part' || coalesce(chr(10) || chr(10) || t, '') as text from s left join a on n_nationkey = c_nationkey""")
def c17_course_export(spark, d):
    """A course for each nation and a page for each customer: captures to documents."""
    n, k = read(spark, d, "nation"), read(spark, d, "customer")
    item = F.concat(F.lit('<li class="activity modtype_page" data-id="'), "c_custkey", F.lit('"><a class="aalink" href="/mod/page/view.php?id='), "c_custkey", F.lit('"><span class="instancename">'), "c_name", F.lit("</span></a></li>"))
    items = k.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_join(course.in_order(F.col("c_custkey"), item), "").alias("items"))
    main = F.concat(F.lit("<body class='course-"), "n_nationkey", F.lit("'><h1>"), "n_name", F.lit('</h1><div id="region-main"><ul><li class="section" data-for="section" data-id="1"><h3 class="sectionname">Part</h3><ul data-for="cmlist">'), F.coalesce("items", F.lit("")), F.lit("</ul></li></ul></div>"))
    none, html = F.lit(None).cast("string"), F.lit("text/html")
    capture = lambda df, key, url, kind, disposition, text: df.select(F.col(key).cast("string").alias("course_id"), url.alias("url"), none.alias("final_url"), F.lit(200).alias("status"), kind.alias("content_type"), disposition.alias("disposition"), text.alias("html"), F.lit(None).cast("binary").alias("content"))
    body = F.concat(F.lit('<div class="box generalbox">Text <b>'), "c_custkey", F.lit(f'</b> <a href="{SITE}/pluginfile.php/1/f%20'), "c_custkey", F.lit('.pdf">f</a></div>'))
    captures = (
        capture(n.join(items, "n_nationkey", "left"), "n_nationkey", F.lit(f"{SITE}/course/view.php?id=1"), html, none, main).unionByName(capture(k, "c_nationkey", address("page", "c_custkey"), html, none, activity_page(body)))
        .unionByName(capture(k, "c_nationkey", F.concat(F.lit(f"{SITE}/pluginfile.php/1/f%20"), "c_custkey", F.lit(".pdf")), F.lit("application/pdf"), none, none))
    )
    out = course_export.course_export(captures, F.lit("2025-01-02 00:00:00").cast("timestamp_ntz"))["documents"]
    return out.select("course_id", F.regexp_replace("text", r"\n$", "").alias("text"))


@query("""select o_custkey as course_id, count(distinct o_orderkey) as n_activities, (select count(*) from lineitem join orders p on l_orderkey = p.o_orderkey where p.o_custkey = o.o_custkey and l_linenumber <> 1) as n_files,
 coalesce((select bool_or(l_linenumber = 1) from lineitem join orders p on l_orderkey = p.o_orderkey where p.o_custkey = o.o_custkey), false) as has_skipped_media, bool_or(o_orderstatus = 'F') as has_issues from orders o group by 1""")
def c16_course_summary(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_custkey", "course_id")
    assets = read(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("course_id", F.when(F.col("l_linenumber") == 1, "video").alias("media"), F.lit(False).alias("converted"))
    return course.course_summary(o.select("course_id").distinct(), o, assets, o.where("o_orderstatus = 'F'")).select("course_id", "n_activities", "n_files", "has_skipped_media", "has_issues")


@query("""select o_custkey as course_id, string_agg('### 📝 A' || o_orderkey || '\n\n- Type: `quiz` · Link: u' || o_orderkey || '\n- Completion: **Done** — Terminé\n- Dates: d1 · d2\n- Files:\n  - f' || o_orderkey || '\n\nbody', '\n\n' order by o_orderstatus, o_orderkey) || '\n' as text from orders group by 1""")
def c17_render_course(spark, d):
    e, none = F.lit(""), F.array().cast("array<string>")
    o = read(spark, d, "orders").select(
        F.col("o_custkey").alias("course_id"), F.col("o_orderstatus").alias("section_ord"), F.col("o_orderkey").alias("ord"), F.lit(3).alias("level"), F.lit("quiz").alias("type"), F.concat(F.lit("A"), "o_orderkey").alias("title"), F.concat(F.lit("u"), "o_orderkey").alias("url"),
        e.alias("breadcrumb"), F.lit(False).alias("breadcrumb_mismatch"), F.lit("Done").alias("completion"), F.lit("Terminé").alias("completion_raw"), F.array(F.lit("d1"), F.lit("d2")).alias("dates"), e.alias("restrictions"), e.alias("external_url"), none.alias("info_lines"),
        F.array(F.concat(F.lit("f"), "o_orderkey")).alias("files"), e.alias("intro_md"), F.lit("body").alias("desc_md"), F.array(e).alias("blocks"),
    )
    return course.render_course(course.activity_text(o))


@query("select '- ❌ e' || n_nationkey as line from nation union all select '- ⚠️ w' || n_nationkey from nation")
def c18_issues(spark, d):
    n = read(spark, d, "nation")
    rows = lambda p: n.select(F.lit("s").alias("source"), F.concat(F.lit(p), "n_nationkey").alias("message"), F.lit("u").alias("url"))
    return course.issues_report(rows("e"), rows("w").unionByName(rows("w"))).select("line")


@query("select c_nationkey as course_id, string_agg(c_name, '\n\n' order by c_custkey) || '\n' as text from customer group by 1")
def w01_course_markdown(spark, d):
    """Documents written, one folder a course, and read again as whole files."""
    made = course.render_course(read(spark, d, "customer").select(F.col("c_nationkey").alias("course_id"), F.lit(0).alias("section_ord"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("text")))
    path = f"{shared_folder(spark)}/lectern/{uuid.uuid4().hex}/courses"
    course.write_course_markdown(made, path)
    return spark.read.text(path, wholetext=True).select("course_id", F.col("value").alias("text"))


@query("select page_id % 3 as kind, count(*) as n from pages group by 1")
def r01_read_captures(spark, d):
    """Captures written and read with their schema; pages and files are told apart."""
    third, none = F.col("page_id") % 3, F.lit(None).cast("string")
    c = read(spark, d, "pages").select(
        F.lit("c").alias("course_id"), F.when(third == 2, "https://c/pluginfile.php/1/a.html").otherwise(F.col("url")).alias("url"), none.alias("final_url"), F.lit(200).alias("status"),
        F.when(third == 1, "application/pdf").otherwise("text/HTML; charset=utf-8").alias("content_type"), none.alias("disposition"), F.when(third != 1, F.col("html")).alias("html"), F.lit(None).cast("binary").alias("content"),
    )
    path = f"{shared_folder(spark)}/lectern/{uuid.uuid4().hex}/captures"
    c.write.parquet(path)
    got = pages.read_captures(spark, path)
    kind = F.when(F.col("content_type") == "application/pdf", 1).otherwise(2)
    return pages.html_pages(got).select(F.lit(0).alias("kind")).unionByName(pages.file_captures(got).select(kind.alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("""select url, md5(html) as html, cast(octet_length(encode(html)) as integer) as n_bytes, null as message from pages where page_id % 5 < 4
 union all select null, null, null, m from (select unnest(['not a capture', 'no file gone.html']) as m) union all select null, null, null, 'no file p' || page_id || '.html' from pages where page_id % 5 = 4""")
def r01_capture_folder(spark, d):
    """Pages as files and their manifest, written and read: a line cut off, files that aren't there."""
    folder = f"{shared_folder(spark)}/lectern/{uuid.uuid4().hex}/captures"
    p = read(spark, d, "pages").select("page_id", "url", "html", F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("file"))
    write_named(p.where("page_id % 5 < 4").select("file", F.col("html").alias("body")), folder)
    line = F.to_json(F.struct(F.lit("c").alias("course_id"), "url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), "file"))
    lines = p.select("page_id", line.alias("body")).unionByName(spark.createDataFrame([(-1, '{"url": "cut o'), (-2, '{"url": "u", "content_type": "text/html", "file": "gone.html"}')], "page_id long, body string"))
    write_named(lines.select(F.lit("manifest.jsonl").alias("file"), "page_id", F.concat("body", F.lit("\n")).alias("body")), folder, ["page_id"], join=True)
    found, issues = pages.read_capture_folder(spark, folder)
    none = F.lit(None)
    rows = found.select("url", F.md5("html").alias("html"), F.octet_length("content").alias("n_bytes"), none.cast("string").alias("message"))
    return rows.unionByName(issues.select(none.cast("string").alias("url"), none.cast("string").alias("html"), none.cast("int").alias("n_bytes"), "message"))
