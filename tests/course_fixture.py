"""A botany course made up for these tests: subsections inside subsections, a section that lies on another page,
one file asked for in several ways, two files of one name, a module listed twice, pages that were never captured."""

SITE = "https://campus.example.org"
HTML = "text/html; charset=utf-8"


def tag(name, inner="", **attrs):
    given = "".join(f' {k.rstrip("_").replace("_", "-")}="{v}"' for k, v in attrs.items())
    return f"<{name}{given}>{inner}</{name}>"


def item(cmid, kind, name, extra=""):
    """A module's entry in a section."""
    shown = "" if kind == "label" else tag("div", tag("a", tag("span", name + tag("span", f" ({kind})", class_="accesshide"), class_="instancename"), class_="aalink", href=f"{SITE}/mod/{kind}/view.php?id={cmid}"), class_="activityname")
    return tag("li", tag("div", shown + extra, data_activityname=name), class_=f"activity {kind} modtype_{kind}", id=f"module-{cmid}", data_for="cmitem", data_id=cmid)


def block(section_id, number, title, *items, summary="", name="li"):
    """A section with its list of modules."""
    head = tag("div", tag("h3", title, class_="sectionname"), data_for="section_title") if title else ""
    about = tag("div", summary, class_="summarytext") if summary else ""
    return tag(name, head + about + (tag("ul", "".join(items), data_for="cmlist") if items else ""), class_="section main", data_for="section", data_id=section_id, data_number=number)


def inner(cmid, name, section):
    return item(cmid, "subsection", name, section)


def activity_page(main, header="", trail=(), rest=""):
    way = tag("div", tag("ol", "".join(tag("li", x, class_="breadcrumb-item") for x in trail), class_="breadcrumb"), id="page-navbar")
    region = tag("section", tag("div", header, class_="activity-header") + tag("div", main, role="main"), id="region-main")
    return tag("html", tag("body", way + region + rest))


def dates(**lines):
    return tag("div", "".join(tag("div", tag("strong", f"{k.title()}:") + f" {v}") for k, v in lines.items()), data_region="activity-dates")


def file(path):
    return f"{SITE}/pluginfile.php/{path}"


PINES = block(6020, 2, "Pines", item(9106, "quiz", "Needles", dates(opens="1 March 2030, 09:00", closes="8 March 2030, 17:30")), name="div")
CONIFERS = block(6010, 1, "Conifers", inner(9105, "Pines", PINES), item(9107, "assign", "Survey"), name="div")

COURSE = tag(
    "html",
    tag("head", tag("title", "Course: Field Botany | Campus"))
    + '<body class="path-course course-7031">'
    + tag("div", tag("ul", tag("li", "in the index only", class_="section", data_for="section", data_id=4444)), id="courseindex")
    + tag("header", tag("h1", "Field Botany"))
    + tag("div", tag("ul",
        block(5010, 0, "Welcome", item(9101, "url", "Herbarium"), item(9102, "page", "Rules"), summary="<p>Read <em>this</em> first, then <a href='%s'>the plan</a></p>" % file("31/course/section/5010/plan.pdf"))
        + block(5020, 1, "Trees", item(9103, "resource", "Tree key", tag("div", "<p>How to tell trees apart</p>", class_="activity-altcontent") + tag("div", "<button>Done</button>", class_="completion-info")), inner(9104, "Conifers", CONIFERS))
        + block(5030, 2, "", item(9108, "folder", "Photos"), item(9109, "label", "Note", tag("div", f"<p>Same key: <a href='{file('32/mod_resource/content/2/tree%20key.pdf')}?forcedownload=1'>here</a>; another <a href='{file('33/mod_label/intro/tree%20key.pdf')}'>tree key</a></p>", class_="activity-altcontent")), item(9103, "resource", "Tree key"))
        + block(5040, 3, "Late"),
    ), id="region-main")
    + "</body>",
)

LATE = activity_page(tag("ul", block(5040, 3, "Late", item(9110, "forum", "Finds"), item(9111, "lesson", "Walk"), item(9112, "wiki", "Pool"), item(9113, "book", "Flora"))))

QUIZ = activity_page(
    tag("div", "<p>Attempts allowed: 3</p><p>Time limit: 20 mins</p><p>Attempts allowed: 3</p><p>Open book</p>", class_="quizinfo") + tag("table", "<tr><th>Try</th><th>Mark</th></tr><tr><td>A</td><td>7|10</td></tr>", class_="quizattemptsummary"),
    tag("div", "<p>Look at the <b>needles</b></p>", id="intro"), ("BOT", "Trees", "Conifers", "Pines", "Needles"),
)
ASSIGN = activity_page(
    tag("div", tag("table", "<tr><th>Submission status</th><td>Draft</td></tr><tr><th>Time remaining</th><td>2 days</td></tr>"), class_="submissionstatustable"),
    dates(due="2 February 2030, 12:00") + tag("div", "<p>Count the trees</p>" + tag("div", f"<a href='{file('34/mod_assign/introattachment/0/form.odt')}?forcedownload=1'>form.odt</a>", data_region="intro-attachments"), id="intro"), ("BOT", "Elsewhere"),
)
RULES = activity_page(tag("div", "<h4>Outdoors</h4><p style='color:#c00'>Erratum: bring water</p><ul><li>hat<li>boots</ul><a href=/one>first<a href=/two>second</a>" + f"<img src='{file('35/mod_page/content/1/map.png')}' alt='map'>", class_="box generalbox"), tag("div", "<p>Short rules</p>", class_="activity-description", id="intro"), ("BOT", "Welcome", "Rules"))
FOLDER = activity_page("".join(tag("span", tag("a", n, href=f"{file('36/mod_folder/content/0/' + p)}?forcedownload=1"), class_="fp-filename-icon") for p, n in (("oak.jpg", "oak.jpg"), ("May%20trip/oak.jpg", "oak.jpg"), ("oak.jpg", "oak.jpg"), ("song.ogg", "song.ogg"))))
LINK = activity_page("<a href='https://flora.example.net/index'>elsewhere</a>" + tag("object", "", data="https://herbarium.example.net/sheet/9"))
FORUM = activity_page("".join(f"<a href='{SITE}/mod/forum/discuss.php?d={d}'>Find {d}</a><a href='{SITE}/mod/forum/discuss.php?d={d}&amp;parent=2'>last post</a>" for d in range(8801, 8814)))
LESSON = activity_page(tag("div", "<p>Start at the gate</p>", class_="box contents"), rest=tag("div", tag("ul", "<li>1. Gate</li>" + tag("li", f"<a href='{SITE}/mod/lesson/view.php?id=9111&amp;pageid=77001'>Pond</a>")), class_="menuwrapper"))


def discussion(d):
    return tag("html", tag("body", tag("article", tag("header", tag("h3", f"Seen {d}") + tag("div", "by B, <time>4 May</time>", class_="mb-3")) + tag("div", f"<p>Orchid no. {d}</p>", class_="post-content-container"), data_region="post")))


PAGES = {
    "/course/view.php?id=7031": COURSE, "/course/section.php?id=5040": LATE, "/mod/quiz/view.php?id=9106": QUIZ, "/mod/assign/view.php?id=9107": ASSIGN, "/mod/page/view.php?id=9102": RULES, "/mod/folder/view.php?id=9108": FOLDER,
    "/mod/url/view.php?id=9101&forceview=1": LINK, "/mod/forum/view.php?id=9110": FORUM, "/mod/lesson/view.php?id=9111": LESSON, "/mod/lesson/view.php?id=9111&pageid=77001": activity_page(tag("div", "<p>Newts live here</p>", class_="box contents")),
    "/mod/book/view.php?id=9113": activity_page("<h2>Ferns</h2><p>spores</p>"), **{f"/mod/forum/discuss.php?d={d}": discussion(d) for d in (8801, 8802, 8811)},
}
#: address, address it was answered from, kind, header with a name
FILES = [
    ("/mod/resource/view.php?id=9103&redirect=1", "/pluginfile.php/32/mod_resource/content/2/tree%20key.pdf", "application/pdf", 'inline; filename="tree key.pdf"'),
    ("/pluginfile.php/31/course/section/5010/plan.pdf", None, "application/pdf", ""), ("/pluginfile.php/33/mod_label/intro/tree%20key.pdf", None, "application/pdf", ""), ("/pluginfile.php/35/mod_page/content/1/map.png", None, "image/png", ""),
    ("/pluginfile.php/36/mod_folder/content/0/oak.jpg?forcedownload=1", None, "image/jpeg", ""), ("/pluginfile.php/36/mod_folder/content/0/May%20trip/oak.jpg?forcedownload=1", None, "image/jpeg", "attachment; filename*=UTF-8''oak.jpg"),
]


def captures():
    """(url, final_url, content_type, disposition, html) of all that was captured."""
    return [(SITE + u, None, HTML, "", h) for u, h in PAGES.items()] + [(SITE + u, f and SITE + f, t, d, None) for u, f, t, d in FILES]
