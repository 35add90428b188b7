"""From captured pages and files to one Markdown document for each course, its tables and its issues.

Pages are parsed once, all that follows is joins on the course and the module, and aggregates in document order. Tables that
several steps read are written to the shared folder, so plans stay small and nothing is worked out twice. The place of everything is an array of numbers from the root of
the course down, so one sort puts nested sections, activities and notes in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import SiteConfig
from lectern.functions import naming, urls
from lectern.functions.text import clean, file_link, present
from lectern.operators import course as c
from lectern.operators import pages as p
from lectern.operators.deadlines import collect_meta, deadlines, lesson_fix
from lectern.operators.relational import first_wins, joined_text
from lectern.operators.stored import dealt, stored

KEYS = ["course_id", "owner"]
#: fixed values: the deadlines table's columns
DEADLINES = ["Activity", "Type", "Section", "Opens", "Due / Closes", "Cut-off", "Attempts", "Grade to pass", "Completion", "Status"]
META = ["opens", "closes", "due", "cutoff", "attempts", "gradeToPass"]


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def course_tree(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections with their paths, activities with theirs, and notes for subsections that weren't captured.

    rows: parse_course of the course, section and subsection pages.
    """
    sections, activities = c.attach_remote_sections(c.parse_sections(rows), c.parse_activities(rows), F.col("url").contains("/course/view.php"))
    sections = stored(sections, "sections")
    tree = stored(sections.join(c.section_paths(sections), ["course_id", "section_id"]).withColumn("owner", F.concat(F.lit("section "), "section_id")), "tree")
    around = tree.where("reached").select("course_id", "section_id", F.col("level").alias("_level"), F.col("path").alias("_path"), "titles", F.col("place").alias("_place"))
    placed = activities.join(around, ["course_id", "section_id"]).select(
        "*", F.concat("_place", F.array("ord")).alias("place"), F.least(F.lit(6), F.col("_level") + 1).alias("level"), F.concat("_path", F.array(naming.sanitize(F.col("title")))).alias("parts"), F.element_at("titles", -1).alias("section_title"),
    ).drop("_level", "_path", "_place")
    placed = c.dedupe_activities(stored(placed, "placed"), ("place",))
    # a module has one place; one without an id is known by its place
    placed = placed.withColumn("owner", F.coalesce("cmid", F.concat(F.lit("at "), F.array_join(F.col("place").cast("array<string>"), "."))))
    inside = tree.where("reached and parent_section_id is not null").select("course_id", F.col("parent_section_id").alias("section_id"), F.slice("place", -1, 1)[0].alias("_at"), F.col("title").alias("_t"))
    placed = stored(placed, "modules")
    subs = placed.where("type = 'subsection'")
    read = subs.join(inside, ["course_id", "section_id"]).where("_at = ord or _t = title").select("course_id", "owner").distinct()
    notes = subs.join(read, KEYS, "left_anti").select("course_id", "place", F.concat(F.lit('> ❌ Subsection "'), "title", F.lit('" could not be read.')).alias("text"))
    return tree, placed.where("type <> 'subsection'"), notes


def _fragments(tree: DataFrame, acts: DataFrame, parts: DataFrame, forum: DataFrame, plan: DataFrame) -> DataFrame:
    """(course_id, owner, role, ord, url, html, heading, text, priority, place, parts): all HTML that is rendered."""
    of = lambda df, role, level: df.select("course_id", "owner", F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), "ord", "url", "html", level.cast("int").alias("heading"), "text", "priority", "place", "parts")
    level = F.col("level")
    known = acts.select("course_id", "owner", "type", "cmid", "level", "place", "parts", F.when(F.col("type").isin("resource", "folder"), 0).otherwise(1).alias("priority"))
    own = c.own_parts(parts).where("kind = 'fragment'").select("course_id", "type", "cmid", "page", "url", "role", "ord", "html", "text")
    desc = acts.where("desc_html is not null").select("course_id", "owner", "ord", F.col("page_url").alias("url"), F.col("desc_html").alias("html"), F.when(F.col("type") == "label", level).otherwise(level + 1).alias("h"), _null().alias("text"), F.when(F.col("type").isin("resource", "folder"), 0).otherwise(1).alias("priority"), "place", "parts")
    summary = tree.where("reached and summary_html is not null").select("course_id", "owner", F.lit(0).alias("ord"), F.col("page_url").alias("url"), F.col("summary_html").alias("html"), (level + 1).alias("h"), _null().alias("text"), F.lit(2).alias("priority"), "place", F.col("path").alias("parts"))
    shown = own.where("page in ('view', 'print') and type not in ('book') and role <> 'lesson'").join(known, ["course_id", "type", "cmid"])
    fixed = F.when(F.col("role").isin("attempts", "status", "attempt"), F.lit(3)).otherwise(level + 1)
    books = c.book_chapters(parts).withColumn("type", F.lit("book")).join(known, ["course_id", "type", "cmid"]).withColumn("text", _null())
    # a lesson's own page and the pages of its menu, where there is no export
    lessons = known.where("type = 'lesson'").join(plan.where("fallback").select("course_id", "cmid"), ["course_id", "cmid"])
    menu = c.lesson_pages(parts).join(lessons, ["course_id", "cmid"])
    page = own.where("role = 'lesson'").select("course_id", "cmid", "page", "url", "html")
    here = menu.where("url is null").drop("url").join(page.where("page = 'view'").drop("page"), ["course_id", "cmid"])
    there = menu.where("url is not null").join(first_wins(page.drop("page", "cmid"), ["course_id", "url"], ["html"]), ["course_id", "url"])
    lesson = _union(here.select(*there.columns), there).withColumns({"ord": F.col("rank"), "text": F.col("title")})
    posts = own.where("page = 'discussion'").withColumnRenamed("cmid", "d").select("course_id", "d", "url", "html").join(forum.select("course_id", "cmid", "d", "rank", "subject"), ["course_id", "d"]).withColumn("type", F.lit("forum"))
    posts = posts.join(known, ["course_id", "type", "cmid"]).withColumns({"ord": F.col("rank"), "text": F.col("d"), "parts": F.concat("parts", F.array(naming.sanitize(F.col("subject"), 60)))})
    h = F.least(F.lit(6), level + 1)
    return _union(
        of(desc, "desc", F.col("h")), of(summary, "summary", F.col("h")), of(shown, F.col("role"), fixed), of(books, "chapter", level + 1), of(lesson, "lesson", h + 1), of(posts, "post", h + 1),
    ).withColumn("fid", F.concat_ws("|", "owner", "role", "ord", "url"))


def _requests(acts: DataFrame, parts: DataFrame, forum: DataFrame, plan: DataFrame, links: DataFrame, cfg: SiteConfig) -> DataFrame:
    """(course_id, owner, priority, place, ord, url, parts, hint): all files asked for."""
    known = acts.select("course_id", "owner", "type", "cmid", "place", "parts", "title")
    row = lambda df, priority: df.select("course_id", "owner", F.lit(priority).alias("priority") if isinstance(priority, int) else priority.alias("priority"), "place", F.col("ord").cast("int").alias("ord"), "url", "parts", F.col("hint"))
    own = c.own_parts(parts)
    resource = known.where("type = 'resource' and cmid is not null").select("*", F.lit(0).alias("ord"), F.concat(F.lit(f"{cfg.origin}/mod/resource/view.php?id="), "cmid").alias("url"), F.col("title").alias("hint"))
    folder = c.page_folder_files(parts).withColumn("type", F.lit("folder")).join(known, ["course_id", "type", "cmid"]).withColumns({"parts": F.concat("parts", "sub"), "hint": _null()})
    attached = own.where("role = 'attachment'").select("course_id", "type", "cmid", "ord", F.col("link").alias("url")).join(known, ["course_id", "type", "cmid"]).withColumn("hint", _null())
    posted = own.where("role = 'post' and kind = 'link'").select("course_id", F.col("cmid").alias("d"), "ord", F.col("link").alias("url")).join(forum.select("course_id", "cmid", "d", "subject"), ["course_id", "d"]).withColumn("type", F.lit("forum"))
    posted = posted.join(known, ["course_id", "type", "cmid"]).withColumns({"parts": F.concat("parts", F.array(naming.sanitize(F.col("subject"), 60))), "hint": _null()})
    export = plan.where("not fallback").select("course_id", "cmid", "url").withColumn("type", F.lit("lesson")).join(known, ["course_id", "type", "cmid"]).select("*", F.lit(0).alias("ord"), F.concat("title", F.lit(".pdf")).alias("hint"))
    inline = p.select_assets(links, cfg).withColumn("hint", _null())
    return _union(row(resource, 0), row(folder, 0), row(attached, 1), row(posted, 1), row(export, 1), row(inline, F.col("priority")))


def placed_files(requests: DataFrame, files: DataFrame, wrappers: DataFrame, converted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assets with their paths, the requests with their asset's line, and issues for files that weren't captured.

    files: (course_id, url, final_url, disposition, content_type); wrappers: resource_link of captured wrapper pages.
    """
    key = urls.norm_url(F.col("url"))
    got = first_wins(files.select("course_id", key.alias("_k"), F.coalesce("final_url", "url").alias("final_url"), "disposition", F.col("content_type").alias("mime")), ["course_id", "_k"], ["final_url"])
    inner = wrappers.select("course_id", F.concat(F.lit("resource:"), "cmid").alias("_w"), urls.norm_url(F.col("url")).alias("_k")).join(got, ["course_id", "_k"]).select("course_id", F.col("_w").alias("_k"), "final_url", "disposition", "mime")
    got = first_wins(_union(got, inner), ["course_id", "_k"], ["final_url"])
    # an address that another capture ended at is captured as well
    ended = got.withColumn("_k", urls.norm_url(F.col("final_url")))
    got = first_wins(_union(got.withColumn("_own", F.lit(0)), ended.withColumn("_own", F.lit(1))), ["course_id", "_k"], ["_own", "final_url"]).drop("_own")
    asked = stored(requests.withColumn("_k", key).join(got, ["course_id", "_k"], "left").withColumn("_skip", urls.skipped_media(F.col("url"))), "asked")
    lost = asked.where("final_url is null and _skip is null").select(
        "course_id", F.lit("download").alias("source"), F.concat(F.lit('Download "'), F.coalesce("hint", present(naming.name_from_url(F.col("url"))), "url"), F.lit('": not captured ('), "url", F.lit(")")).alias("message"), "url",
    ).distinct()
    found = asked.where("final_url is not null or _skip is not null").drop("_k", "_skip")
    order = ["priority", "place", "ord", "owner", "url"]
    keyed = stored(c.dedupe_assets(found, order), "requests")
    whole = F.struct(*order)
    firsts = first_wins(keyed.where(whole == F.col("asset")).select("course_id", "key", "asset", "parts", "disposition", F.coalesce("final_url", "url").alias("url"), "mime"), ["course_id", "asset"], ["key"])
    firsts = stored(firsts.withColumn("ord", F.row_number().over(Window.partitionBy("course_id").orderBy("asset"))), "firsts")
    assets = c.place_assets(dealt(firsts.drop("asset", "key"))).join(firsts.select("course_id", "ord", "asset"), ["course_id", "ord"])
    if converted is not None:
        assets = assets.join(converted.select("course_id", "path", "md_path"), ["course_id", "path"], "left")
    else:
        assets = assets.withColumn("md_path", _null())
    assets = stored(assets, "assets")
    lines = c.asset_line(assets).select("course_id", "asset", "name", "path", "media", "md_path", "line")
    return assets, keyed.join(lines, ["course_id", "asset"]), lost


def course_export(captures: DataFrame, now: Column, cfg: SiteConfig = SiteConfig(), converted: DataFrame | None = None) -> dict[str, DataFrame]:
    """documents (course_id, text), activities, sections, assets and issues of captured courses.

    captures: read_captures; now: the moment that deadlines are compared with, as TIMESTAMP_NTZ; converted:
    (course_id, path, md_path) of files that were converted to Markdown.
    """
    allowed, refused = urls.split_guarded(captures.withColumn("_u", F.coalesce("final_url", "url")), "_u", cfg)
    pages = p.html_pages(allowed).select("course_id", F.col("_u").alias("url"), "html")
    # small pages are dealt out wherever they are parsed: a split or a coalesced partition holds too many of them
    outline = F.col("url").rlike(r"/course/(view|section)\.php|/mod/subsection/")
    rows, parts = stored(c.parse_course(dealt(pages.where(outline))), "rows"), stored(c.parse_pages(dealt(pages.where(~outline & F.col("url").contains("/mod/")))), "parts")
    tree, acts, notes = course_tree(rows)
    forum, plan = stored(c.forum_posts(parts), "forum"), stored(c.lesson_plan(parts, cfg), "plan")
    acts = stored(c.page_common(acts, parts), "activities")
    fragments = stored(dealt(_fragments(tree, acts, parts, forum, plan)), "fragments")
    links = stored(p.extract_links(fragments, ["course_id", "fid"]).join(fragments.select("course_id", "fid", "owner", "priority", "place", "parts"), ["course_id", "fid"]), "links")
    assets, files, lost = placed_files(_requests(acts, parts, forum, plan, links, cfg), p.file_captures(allowed), c.resource_link(parts), converted)
    files = stored(files, "files")
    local = first_wins(files.select("course_id", urls.norm_url(F.col("url")).alias("key"), "path").where("path is not null"), ["course_id", "key"], ["path"])
    mapped = fragments.join(p.asset_map(links.drop("owner", "place", "parts"), local, ["course_id", "fid"]), ["course_id", "fid"], "left")
    md = p.pages_to_markdown(dealt(mapped), ["course_id", "fid"], min_heading="heading", url_map="paths").select("course_id", "fid", "md", "error")
    made = stored(fragments.drop("html").join(md, ["course_id", "fid"]), "markdown")

    lines, meta = _facts(acts, parts, made, plan, forum, files)
    own_files = first_wins(files.select(*KEYS, F.coalesce("path", "url").alias("_f"), "line", F.struct("priority", "place", "ord").alias("_o")), [*KEYS, "_f"], ["_o"])
    listed = own_files.groupBy(*KEYS).agg(c.in_order(F.col("_o"), F.col("line")).alias("files"))
    texts = made.where("role in ('desc', 'intro')").groupBy(*KEYS).agg(F.min_by("md", F.when(F.col("role") == "desc", F.col("ord"))).alias("desc_md"), F.min_by("md", F.when(F.col("role") == "intro", F.col("ord"))).alias("intro_md"))
    external = c.page_external(parts, cfg).withColumnRenamed("cmid", "owner").withColumnRenamed("external", "external_url")
    whole = acts
    for extra in (lines, listed, texts, _blocks(acts, made, plan, forum, parts), external, meta):
        whole = whole.join(extra, KEYS, "left")
    empty = F.array().cast("array<string>")
    whole = whole.withColumns({k: F.coalesce(k, empty) for k in ("info_lines", "files", "blocks")}).withColumn("meta", lesson_fix(F.col("type"), F.coalesce("meta", F.create_map().cast("map<string,string>"))))
    whole = stored(whole.withColumns({k: F.try_element_at("meta", F.lit(k)) for k in META}), "whole")
    errors = _union(lost, made.where("error is not null").select("course_id", F.lit("page").alias("source"), F.col("error").alias("message"), "url"), rows.where("kind = 'issue'").select("course_id", F.lit("page").alias("source"), F.col("title").alias("message"), "url"), parts.where("kind = 'issue'").select("course_id", F.lit("page").alias("source"), F.col("text").alias("message"), "url"))
    warned = captures.select("course_id", F.coalesce("final_url", "url").alias("url")).join(refused, "url").select("course_id", "source", "message", "url")
    astray = tree.where("not reached or problem is not null").select("course_id", F.lit("section").alias("source"), F.concat(F.lit('Section "'), "title", F.lit('" hangs on no other section')).alias("message"), F.col("page_url").alias("url"))
    issues = stored(c.issues_report(errors, _union(warned, astray)), "issues")
    documents = _documents(rows, tree, whole, notes, made, assets, issues, now, cfg)
    return {"documents": documents, "activities": whole, "sections": tree, "assets": assets, "issues": issues}


def _facts(acts: DataFrame, parts: DataFrame, made: DataFrame, plan: DataFrame, forum: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(course_id, owner, info_lines) and (course_id, owner, meta) of the activities."""
    quiz, _ = c.quiz_facts(parts)
    own = c.own_parts(parts)
    said = lambda df, o, line, ord_=F.lit(0): df.select("course_id", F.col("cmid").alias("owner"), F.lit(o).alias("o"), ord_.alias("ord"), line.alias("line"))
    status = made.where("role = 'attempt' and trim(md) <> ''").withColumn("cmid", F.col("owner"))
    exported = files.join(plan.where("not fallback").select("course_id", F.col("cmid").alias("owner"), "url"), [*KEYS, "url"]).withColumn("cmid", F.col("owner"))
    empty_folder = own.where("type = 'folder' and page = 'view'").groupBy("course_id", "cmid").agg(F.count_if(F.col("role").isin("folder1", "folder2")).alias("n")).where("n = 0")
    silent = own.where("type = 'forum' and page = 'view'").select("course_id", "cmid").distinct().join(forum.select("course_id", "cmid"), ["course_id", "cmid"], "left_anti")
    cut = c.book_chapters(parts).where("not whole").select("course_id", "cmid").distinct()
    bare = plan.where("not coalesce(has_menu, false)")
    rows = _union(
        said(quiz, 1, F.col("line"), F.col("ord")), said(status, 2, F.concat(F.lit("Attempt status: "), clean(F.col("md")))), said(bare, 0, F.lit("Lesson menu not found.")),
        said(plan.where("url is null"), 1, F.lit('No "Export as PDF" link found — content pages converted from the Lesson menu instead.')), said(exported, 1, F.concat(F.lit("Exported PDF: "), "name")),
        said(empty_folder, 0, F.lit("Folder is empty (or files not found).")), said(silent, 0, F.lit("No discussions found.")), said(cut, 0, F.lit("Print view unavailable — only the first chapter was captured.")),
    )
    order = F.struct("o", "ord")
    info = rows.groupBy(*KEYS).agg(c.in_order(order, F.col("line")).alias("info_lines"))
    dated = acts.where("cmid is not null").select("course_id", F.col("cmid").alias("owner"), F.lit(0).alias("o"), F.posexplode("dates").alias("ord", "line"))
    pairs = _union(dated, rows.where("o = 1").select(*dated.columns)).select(*KEYS, "o", "ord", c.split_meta_line(F.col("line")).alias("m")).select(*KEYS, "o", "ord", "m.label", "m.value").where("label is not null")
    table = own.where("type = 'assign' and kind = 'status'").select("course_id", F.col("cmid").alias("owner"), F.lit(2).alias("o"), "ord", F.col("text").alias("label"), F.col("link").alias("value"))
    return info, collect_meta(_union(pairs, table.select(*pairs.columns)).withColumn("at", order), KEYS, "at")


def _blocks(acts: DataFrame, made: DataFrame, plan: DataFrame, forum: DataFrame, parts: DataFrame) -> DataFrame:
    """(course_id, owner, blocks): what follows an activity's facts, in order."""
    level = acts.select(*KEYS, F.least(F.lit(6), F.col("level") + 1).alias("_h"))
    row = lambda df, o, text: df.select(*KEYS, F.lit(o).alias("o"), "ord", text.alias("text"))
    numbered = F.transform("outline", lambda t, i: F.when(t.rlike(r"^\d+[.)]"), F.concat(F.lit("- "), t)).otherwise(F.concat((i + 1).cast("string"), F.lit(". "), t)))
    outline = plan.where("has_menu").select("course_id", F.col("cmid").alias("owner"), F.lit(0).alias("ord"), F.concat(F.lit("**Lesson outline (Lesson menu):**\n\n"), F.array_join(numbered, "\n")).alias("t"))
    tagged = made.join(level, KEYS)
    title = lambda t: F.concat(F.repeat(F.lit("#"), F.col("_h")), F.lit(" "), t)
    some = F.coalesce(present(F.col("md")), F.lit("_(empty page)_"))
    lesson = tagged.where("role = 'lesson'").join(acts.select(*KEYS, "title"), KEYS)
    post = forum.select("course_id", F.col("cmid").alias("owner"), F.col("d").alias("text"), "rank", "title", "subject", "meta", "found").join(level, KEYS).join(made.where("role = 'post'").select(*KEYS, "text", "md"), [*KEYS, "text"], "left")
    # a discussion's address is the platform's own, without other parameters
    site = c.own_parts(parts).where("page = 'view' and role = 'discussion'").select("course_id", F.col("cmid").alias("owner"), F.regexp_extract("link", r"^(https?://[^/]+)", 1).alias("_site")).distinct()
    site = first_wins(site, KEYS, ["_site"])
    link = F.concat("_site", F.lit("/mod/forum/discuss.php?d="), "text")
    shown = F.when(F.col("found"), F.concat(title(F.col("subject")), F.lit("\n\n_"), "meta", F.lit("_ — "), link, F.lit("\n\n"), F.coalesce("md", F.lit("")))).otherwise(F.concat(title(F.col("title")), F.lit("\n\n_(first post not found)_ — "), link))
    posts = post.join(site, KEYS).groupBy(*KEYS).agg(F.lit(0).alias("ord"), F.concat(F.lit("**"), F.count("*").cast("string"), F.lit(" most recent discussions:**\n\n"), joined_text(F.col("rank"), shown, "\n\n")).alias("t"))
    rows = _union(
        row(outline, 0, F.col("t")), row(lesson, 1, F.concat(title(F.coalesce("text", "title")), F.lit("\n\n"), some)), row(made.where("role in ('content', 'chapter')"), 1, F.col("md")),
        row(made.where("role = 'attempts'"), 1, F.concat(F.lit("**Your attempts:**\n\n"), "md")), row(made.where("role = 'status'"), 1, F.concat(F.lit("**Submission status:**\n\n"), "md")), row(posts, 1, F.col("t")),
    )
    return rows.groupBy(*KEYS).agg(c.in_order(F.struct("o", "ord"), present(F.col("text"))).alias("blocks"))


def _documents(rows: DataFrame, tree: DataFrame, acts: DataFrame, notes: DataFrame, made: DataFrame, assets: DataFrame, issues: DataFrame, now: Column, cfg: SiteConfig) -> DataFrame:
    heads = first_wins(rows.where("kind = 'course'").select("course_id", F.coalesce("data_id", "course_id").alias("id"), present(F.col("title")).alias("title"), F.when(F.col("url").contains("/course/view.php"), 0).otherwise(1).alias("o"), "url"), ["course_id"], ["o", "url"])
    facts = c.course_summary(heads.select("course_id", "id", F.coalesce("title", F.concat(F.lit("course-"), "id")).alias("title")), acts, assets.withColumn("converted", F.col("md_path").isNotNull()), issues)
    top = F.concat(
        F.lit("# "), "title", F.lit(f"\n\n- URL: {cfg.origin}/course/view.php?id="), "id", F.lit("\n- Scraped: "), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("\n- Activities: "), F.col("n_activities").cast("string"), F.lit(" · Files: "), F.col("n_files").cast("string"),
    )
    dated = deadlines(acts.select("course_id", F.col("place").alias("ord"), "type", "title", F.col("titles").alias("section_titles"), "completion", *META), now)
    head = "| " + " | ".join(DEADLINES) + " |\n|" + " --- |" * len(DEADLINES) + "\n"
    table = dated.groupBy("course_id").agg(F.concat(F.lit("## Deadlines & evaluations\n\n" + head), joined_text(F.col("rank"), F.col("line")), F.lit('\n\n_Status is computed relative to the scrape date; "?" means the date text could not be parsed (raw text kept)._')).alias("t"))
    none = F.lit("## Deadlines & evaluations\n\n_No quizzes, assignments or lessons found._")
    fragment = lambda df, part, at, text: df.select("course_id", F.lit(part).alias("part"), at.alias("at"), text.alias("text"))
    start = F.array().cast("array<int>")
    summary = made.where("role = 'summary'").select("course_id", "owner", "md")
    section = tree.where("reached").join(summary, KEYS, "left").select("course_id", "place", F.concat_ws("\n\n", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "title"), present(F.col("md"))).alias("text"))
    told = issues.groupBy("course_id").agg(F.concat(F.lit("## Scrape errors\n\n"), joined_text(F.struct("severity", "message", "url"), F.col("line"))).alias("t"))
    # a top section and what it holds are joined first
    fragments = _union(
        fragment(facts, 0, start, top), fragment(heads.join(table, "course_id", "left"), 1, start, F.coalesce("t", none)), fragment(section, 2, F.col("place"), F.col("text")),
        fragment(c.activity_text(acts), 2, F.col("place"), F.col("text")), fragment(notes, 2, F.col("place"), F.col("text")), fragment(told, 3, start, F.col("t")),
    )
    return c.render_course(fragments.select("course_id", F.struct("part", F.get("at", F.lit(0)).alias("first")).alias("section_ord"), F.col("at").alias("ord"), "text"))
