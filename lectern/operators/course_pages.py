"""Course and activity pages read into tagged rows: each captured page is parsed once, all else is relational.

Fixed values: the classes, ids and data attributes by which pages of the platform mark their parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.operators.pages import resolve
from lectern.sources.html import Node, clean, parse

Test = Callable[[Node], bool]
#: Pages, and characters of pages, whose rows leave a task together.
SLICE, SLICE_CHARS = 200, 4 << 20


def cls(*names: str) -> Test:
    wanted = frozenset(names)
    return lambda n: "class" in n.attrs and not wanted.isdisjoint(n.classes())


def data(key: str, *values: str) -> Test:
    return lambda n: n.attrs.get(key) in values


def either(*tests: Test) -> Test:
    def holds(n: Node) -> bool:
        for t in tests:  # no generator: it is asked for each element of each page
            if t(n):
                return True
        return False

    return holds


def within(around: Test, test: Test) -> Test:
    return lambda n: test(n) and n.nearest(around) is not None


def link_to(*parts: str) -> Test:
    return lambda n: n.tag == "a" and all(p in n.attrs.get("href", "") for p in parts)


SECTION = either(lambda n: n.tag == "li" and "section" in n.classes(), data("data-for", "section"))
ACTIVITY = either(lambda n: n.tag == "li" and "activity" in n.classes(), data("data-for", "cmitem"))
IGNORED = either(data("id", "courseindex"), cls("courseindex", "drawer"), data("data-region", "blocks-column", "drawer"))
CONTENT = either(data("id", "region-main"), cls("course-content"))
TITLES = (cls("sectionname"), lambda n: n.tag in ("h3", "h4"), data("data-for", "section_title"))
SUMMARY = either(cls("summarytext", "section_summary"), data("data-for", "sectionsummary"))
LIST = either(data("data-for", "cmlist"), lambda n: n.tag == "ul" and "section" in n.classes())
NAME = cls("instancename", "activityname")
LINK = either(lambda n: n.tag == "a" and "aalink" in n.classes(), within(cls("activityname", "activity-instance"), lambda n: n.tag == "a"), link_to("/mod/"))
DESCRIPTION = cls("activity-altcontent", "contentafterlink", "description")
COMPLETION = either(data("data-region", "completionrequirements", "completion-info"), cls("completion-info", "activity-completion"))
DATES = either(data("data-region", "activity-dates"), cls("activity-dates"))
RESTRICTIONS = either(cls("availabilityinfo"), data("data-region", "availabilityinfo"))
UI = either(cls("sr-only", "visually-hidden", "accesshide", "bulkselect", "icons-collapse-expand"), lambda n: n.tag in ("button", "input", "label", "script", "style"), data("role", "button"))

CRUMB = either(within(data("id", "page-navbar"), cls("breadcrumb-item")), within(lambda n: n.tag == "ol" and "breadcrumb" in n.classes(), lambda n: n.tag == "li"))
MAIN = either(data("id", "region-main"), data("role", "main"))
INTRO = either(cls("activity-description"), data("id", "intro"))
HEADER = either(cls("activity-header", "activity-description"), data("data-region", "activity-information"))
BOX = lambda n: {"box", "generalbox"} <= n.classes()
CENTERED = lambda n: {"box", "generalbox", "center"} <= n.classes()
MENU = either(cls("menuwrapper", "lessonmenu", "block_lesson_menu"), data("data-block", "lesson_menu"))
CONTENTS, ATTEMPT, EXPORT = cls("contents"), cls("quizattempt"), either(link_to("lessonexport"), link_to("export", "lesson"))
FOLDER = within(either(cls("foldertree", "fp-filename-icon"), data("id", "folder_tree0")), link_to("pluginfile.php"))
QUIZ_INFO = either(cls("quizinfo"), within(cls("quizinfo"), lambda n: n.tag == "p"))
ATTEMPTS = lambda n: n.tag == "table" and ("quizattemptsummary" in n.classes() or n.nearest(cls("quizattemptsummary")) is not None)
FEEDBACK = either(data("id", "feedback"), cls("quizgradefeedback"))
STATUS = lambda n: n.tag == "table" and ("submissionsummarytable" in n.classes() or n.nearest(cls("submissionstatustable", "submissionsummarytable")) is not None)
ATTACHED = within(either(data("data-region", "intro-attachments"), cls("intro-attachments")), link_to("pluginfile.php"))
WORKAROUND = within(cls("urlworkaround", "resourceworkaround"), lambda n: n.tag == "a" and bool(n.attrs.get("href")))
POST = either(data("data-region", "post"), cls("forumpost"))
SUBJECT = either(data("data-region-content", "forum-post-core-subject"), cls("subject"), lambda n: n.tag in ("h3", "h4"))
POST_META = either(within(lambda n: n.tag == "header", cls("mb-3")), cls("author"), lambda n: n.tag == "time")
POST_CONTENT = either(cls("post-content-container", "posting", "content"), data("data-region-content", "forum-post-core-content"))


def visible(n: Node) -> str:
    """Text without controls and hidden parts."""
    return clean(n.text(UI))


def _lines(box: Node | None) -> list[str]:
    if not box:
        return []
    kids = [k for k in box.kids if isinstance(k, Node)]
    return list(dict.fromkeys(x for x in (clean(t) for t in ([k.text() for k in kids] if kids else box.text().split("\n"))) if x))


def _section_id(n: Node) -> str:
    return n.attrs.get("data-id") or re.sub(r"^section-", "", n.attrs.get("id", ""))


def course_rows(root: Node) -> Iterator[dict]:
    """Sections and activities of a page in document order, each below its nearest section."""
    main = root.first(CONTENT) or root
    ignored, above = set(), {}
    for n in root.walk():
        if n.up in ignored or IGNORED(n):
            ignored.add(n)
    own: dict[Node | None, list[Node]] = {}
    nodes = [n for n in main.walk() if n not in ignored]
    for n in nodes:  # nearest section and activity around each element
        s, a = above.get(n.up, (None, None))
        own.setdefault(s, []).append(n)
        above[n] = (n if SECTION(n) else s, n if ACTIVITY(n) else a)
    for i, n in enumerate(nodes):
        around, holder = above.get(n.up, (None, None))
        if SECTION(n):
            mine = own.get(n, [])
            heads = (visible(k) for t in TITLES for k in mine if t(k) and not (above[k][1] and not holder))
            summary = next((k for k in mine if SUMMARY(k)), None)
            yield {
                "kind": "section", "ord": i, "section_id": _section_id(n), "parent": _section_id(around) if around else None, "number": n.attrs.get("data-number", ""),
                "title": next((t for t in heads if t), ""), "holder": holder.attrs.get("data-id") if holder else None, "has_content": any(LIST(k) or ACTIVITY(k) for k in mine), "html": summary.markup() if summary else None,
            }
        elif ACTIVITY(n):
            inside = list(n.walk())
            first = lambda test: next((k for k in inside if test(k)), None)  # noqa: B023, E731
            link, name, desc, done, rules = map(first, (LINK, NAME, DESCRIPTION, COMPLETION, RESTRICTIONS))
            named = next((k.attrs["data-activityname"] for k in [n, *inside] if k.attrs.get("data-activityname")), "")
            yield {
                "kind": "activity", "ord": i, "section_id": _section_id(around) if around else None, "class": n.attrs.get("class"), "data_id": n.attrs.get("data-id"), "id": n.attrs.get("id"),
                "title": clean(named) or (visible(name) if name else "") or clean((desc or n).text())[:60], "href": link.attrs.get("href") if link else None,
                "completion": clean(done.text())[:200] if done else "", "restrictions": clean(rules.text()) if rules else "", "dates": _lines(first(DATES)), "html": desc.markup() if desc else None,
            }


COURSE_ROW = {
    "kind": "string", "ord": "int", "section_id": "string", "parent": "string", "number": "string", "title": "string", "holder": "string", "has_content": "boolean", "class": "string", "data_id": "string",
    "id": "string", "href": "string", "completion": "string", "restrictions": "string", "dates": "array<string>", "html": "string",
}


def course_facts(root: Node) -> Iterator[dict]:
    """One row with the course's id and title, if the page says them."""
    body = root.first(lambda n: n.tag == "body")
    found = re.search(r"\bcourse-(\d+)\b", body.attrs.get("class", "")) if body else None
    heads = root.every(lambda n: n.tag == "h1")
    best = next((h for h in heads if h.nearest(either(cls("page-header-headings"), data("id", "page-header"), lambda n: n.tag == "header"))), heads[0] if heads else None)
    title = root.first(lambda n: n.tag == "title")
    named = re.sub(r"(?i)^(cours|course)\s*:\s*", "", title.text().split("|")[0].strip()) if title else ""
    yield {"kind": "course", "ord": -1, "data_id": found[1] if found else None, "title": (clean(best.text()) if best else "") or clean(named)}


PART = {"kind": "string", "ord": "int", "role": "string", "text": "string", "link": "string", "html": "string"}


def page_rows(root: Node, base: str) -> Iterator[dict]:
    """Parts of an activity's page: breadcrumbs, dates, fact lines, links by role, fragments to be rendered."""
    everything = list(root.walk())
    first = lambda nodes, test: next(filter(test, nodes), None)
    main = first(everything, MAIN) or first(everything, lambda n: n.tag == "body") or root
    inner = everything if main is root else list(main.walk())
    kind = re.search(r"/mod/(\w+)/", base)
    kind = kind[1] if kind else ""

    def to(n: Node, attr: str = "href") -> str | None:
        return resolve(n.attrs.get(attr), base)

    def links(nodes: list[Node], test: Test, role: str, attr: str = "href") -> Iterator[dict]:
        for n in filter(test, nodes):
            if url := to(n, attr):
                yield {"kind": "link", "role": role, "text": clean(n.text()), "link": url}

    def fragment(role: str, n: Node | None, skip: Test = lambda n: False, text: str | None = None) -> Iterator[dict]:
        if n is not None:
            yield {"kind": "fragment", "role": role, "text": text, "html": n.markup(skip)}

    for n in filter(CRUMB, everything):
        if t := clean(n.text()):
            yield {"kind": "crumb", "text": t}
    yield from ({"kind": "date", "text": t} for t in _lines(first(everything, DATES)))
    if done := first(everything, COMPLETION):
        yield {"kind": "completion", "text": clean(done.text())[:200]}
    if kind != "book" and "discuss.php" not in base:
        yield from fragment("intro", first(inner, INTRO))
    if kind == "page":
        kept = lambda test: first(inner, lambda n: test(n) and not HEADER(n) and not n.nearest(HEADER))
        yield from fragment("content", kept(CENTERED) or kept(either(BOX, cls("no-overflow"))) or main, HEADER)
    elif kind == "url":
        yield from links(inner, WORKAROUND, "workaround")
        for n in filter(lambda n: n.tag in ("frame", "iframe", "object"), everything):
            if url := to(n, "data" if n.tag == "object" else "src"):
                yield {"kind": "link", "role": "frame", "link": url}
        yield from links(inner, lambda n: n.tag == "a", "anchor")
    elif kind == "resource":
        yield from links(inner, within(cls("resourceworkaround"), link_to("pluginfile.php")), "file0")
        for tag, attr in (("object", "data"), ("iframe", "src"), ("embed", "src")):
            yield from links(inner, lambda n: n.tag == tag and "pluginfile.php" in n.attrs.get(attr, ""), "file1", attr)  # noqa: B023
        free = lambda n: not n.nearest(HEADER)
        for n in main.every(lambda n: n.tag in ("a", "img") and "pluginfile.php" in n.attrs.get("href" if n.tag == "a" else "src", "") and free(n)):
            if url := to(n, "href" if n.tag == "a" else "src"):
                yield {"kind": "link", "role": "file2", "link": url}
    elif kind == "folder":
        yield from links(inner, FOLDER, "folder1")
        yield from links(inner, link_to("pluginfile.php", "mod_folder"), "folder2")
    elif kind == "lesson":
        if menu := first(everything, MENU):
            yield {"kind": "menu"}
            for n in menu.every(lambda n: n.tag == "li"):
                if t := clean(n.text()):
                    at = n.first(link_to("pageid="))
                    yield {"kind": "outline", "text": t, "link": to(at) if at else None}
        yield from links(everything, EXPORT, "export")
        yield from fragment("lesson", first(inner, CONTENTS) or main)
    elif kind == "quiz":
        for n in filter(QUIZ_INFO, inner):
            if not n.first(lambda k: k.tag == "p") and (t := clean(n.text())):
                yield {"kind": "info", "text": t}
        yield from fragment("attempts", first(inner, ATTEMPTS))
        said = first(inner, FEEDBACK)
        if said and clean(said.text()):
            yield {"kind": "feedback", "text": clean(said.text())}
        yield from fragment("attempt", first(inner, ATTEMPT))
    elif kind == "assign":
        yield from links(inner, ATTACHED, "attachment")
        if table := first(inner, STATUS):
            for r in table.every(lambda n: n.tag == "tr"):
                cells = [k for k in r.kids if isinstance(k, Node)]
                if len(cells) >= 2:
                    yield {"kind": "status", "text": clean(cells[0].text()), "link": clean(cells[1].text())}
            yield from fragment("status", table)
    elif kind == "forum" and "discuss.php" in base:
        if post := first(everything, POST):
            subject, meta = post.first(SUBJECT), post.first(POST_META)
            content = post.first(POST_CONTENT)
            yield {"kind": "post", "text": clean(subject.text()) if subject else "", "link": clean(meta.text()) if meta else ""}
            yield from fragment("post", content or post)
            if content:
                yield from links(list(post.walk()), lambda n: link_to("pluginfile.php")(n) and content not in n.above(), "post")
    elif kind == "forum":
        yield from links(inner, link_to("/mod/forum/discuss.php?d="), "discussion")
    elif kind == "book":
        chapters = root.every(cls("book_chapter"))
        for n in chapters:
            yield from fragment("chapter", n)
        if not chapters:
            yield from fragment("chapter", (root.first(lambda n: n.tag == "body") or root) if "/print/" in base else main)


def tagged(pages: DataFrame, keys: list[str], fields: dict[str, str], read: Callable[[Node, str], Iterator[dict]]) -> DataFrame:
    """(keys, url, fields): the rows that ``read`` makes of each page's tree; pages: (keys, url, html).

    A page that can't be read gives a row of kind 'issue' with the error in its last text column.
    """
    source = pages.select(*keys, "url", "html")
    said = "text" if "text" in fields else "title"
    types = dict(source.dtypes)
    out = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "url string", *(f"`{f}` {t}" for f, t in fields.items())])
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}

    def rows(page: str | None, url: str | None) -> list[dict]:
        try:
            return [{"ord": i, **r} for i, r in enumerate(read(parse(page), url or ""))]
        except Exception as e:  # one bad page doesn't end the job
            return [{"kind": "issue", "ord": 0, said: f"{type(e).__name__}: {e}"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[dict] = []
            size = start = 0

            def made() -> pa.RecordBatch:
                n = pa.array([len(r) for r in held], pa.int32())  # noqa: B023
                flat = [r for page in held for r in page]  # noqa: B023
                at = pa.array(np.repeat(np.arange(start, start + len(n)), n))  # noqa: B023
                columns = [b.column(k).take(at) for k in (*keys, "url")] + [pa.array([r.get(f) for r in flat], kinds[t]) for f, t in fields.items()]  # noqa: B023
                return pa.RecordBatch.from_arrays(columns, [*keys, "url", *fields])

            for i, (url, html) in enumerate(zip(b.column("url"), b.column("html"), strict=True)):
                page = html.as_py()
                held.append(rows(page, url.as_py()))
                size += len(page or "")
                if len(held) >= SLICE or size > SLICE_CHARS:
                    yield made()
                    held, size, start = [], 0, i + 1
            if held:
                yield made()

    return source.mapInArrow(run, out)


def parse_course(pages: DataFrame) -> DataFrame:
    """Sections, activities and course facts of captured course and section pages (course_id, url, html)."""
    return tagged(pages, ["course_id"], COURSE_ROW, lambda root, url: (r for f in (course_facts, course_rows) for r in f(root)))


def parse_pages(pages: DataFrame) -> DataFrame:
    """Parts of captured activity pages (course_id, url, html)."""
    return tagged(pages, ["course_id"], PART, page_rows)
