"""Course jobs: sections, activities, assets, facts and the course document. Every key begins with the course."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import SiteConfig
from lectern.functions import naming, urls
from lectern.functions.text import clean, file_link, present
from lectern.operators.course_pages import parse_course, parse_pages
from lectern.operators.deadlines import collect_meta, completion_status, split_meta_line
from lectern.operators.pages import external_url
from lectern.operators.relational import first_wins, joined_text, worked_out
from lectern.operators.stored import stored

__all__ = ["external_url", "parse_course", "parse_pages"]

#: fixed values: icon of each kind of activity
ICONS = {"resource": "📄", "folder": "📁", "page": "📃", "url": "🔗", "quiz": "📝", "assign": "📌", "lesson": "🎓", "forum": "💬", "book": "📘"}
NO_TARGET = "(could not determine — open the activity's link)"


def in_order(order: Column, value: Column) -> Column:
    """Aggregate: the group's values in order, nulls left out."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))), lambda r: r["v"])


def parse_sections(rows: DataFrame) -> DataFrame:
    """Sections of every page; title falls back to the number the page gives the section."""
    title = F.coalesce(present(F.col("title")), F.trim(F.concat(F.lit("Section "), F.coalesce("number", F.lit("")))))
    return rows.where("kind = 'section'").select(
        "course_id", "url", "section_id", F.col("parent").alias("parent_section_id"), "ord", F.col("number").try_cast("int").alias("number"), title.alias("title"), present(F.col("title")).alias("own_title"), "holder", "has_content", F.col("html").alias("summary_html"),
    )


def parse_activities(rows: DataFrame) -> DataFrame:
    a = rows.where("kind = 'activity'").withColumn("target", urls.abs_url(F.col("href"), F.col("url")))
    kind, cmid = urls.activity_type(F.col("class"), F.col("target")), urls.module_id(F.col("data_id"), F.col("id"), F.col("target"))
    title = F.coalesce(present(F.col("title")), F.trim(F.concat_ws(" ", kind, cmid)))
    return a.select(
        "course_id", F.col("url").alias("page_url"), "section_id", "ord", cmid.alias("cmid"), kind.alias("type"), title.alias("title"), F.col("target").alias("url"), F.col("completion").alias("completion_raw"),
        completion_status(F.col("completion")).alias("completion"), "restrictions", F.coalesce("dates", F.array().cast("array<string>")).alias("dates"), F.col("html").alias("desc_html"),
    )


def dedupe_activities(activities: DataFrame, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The first occurrence of each module of a course; those without an id all stay."""
    kept = first_wins(activities.where("cmid is not null"), ["course_id", "cmid"], list(order))
    return kept.select(activities.columns).unionByName(activities.where("cmid is null"))


def attach_remote_sections(sections: DataFrame, activities: DataFrame, main: Column) -> tuple[DataFrame, DataFrame]:
    """Sections and activities of a course that spreads over several captured pages.

    A section without content takes its content from another page that shows it; a subsection that isn't
    inline takes the first top section of the page its activity leads to, with the activity's title where
    it has none. main: condition on ``url`` for the course's own page. Sections reached from nowhere stay with
    a parent of null and ``reached`` false.
    """
    ranked = sections.withColumn("_main", F.when(main, 0).otherwise(1))
    full = first_wins(ranked.withColumn("_empty", ~F.coalesce("has_content", F.lit(False))), ["course_id", "section_id"], ["_empty", "_main", "url", "ord"])
    place = first_wins(ranked.select("course_id", "section_id", "_main", "url", "ord", "parent_section_id", "holder", "title", "own_title"), ["course_id", "section_id"], ["_main", "url", "ord"])
    place = place.select("course_id", "section_id", F.col("ord").alias("p_ord"), F.col("parent_section_id").alias("p_parent"), F.col("holder").alias("p_holder"), F.col("title").alias("p_title"), F.col("own_title").alias("p_own"), (F.col("_main") == 0).alias("p_main"))
    tops = first_wins(ranked.where("parent_section_id is null and _main = 1").select("course_id", "url", "section_id", "ord"), ["course_id", "url"], ["ord"]).select("course_id", F.col("url"), "section_id")
    subs = activities.where("type = 'subsection'")
    led = first_wins(subs.join(tops.withColumnRenamed("section_id", "_s"), ["course_id", "url"]).select("course_id", F.col("_s").alias("section_id"), F.col("section_id").alias("l_parent"), F.col("ord").alias("l_ord"), F.col("title").alias("l_title")), ["course_id", "section_id"], ["l_parent", "l_ord"])
    held = first_wins(subs.where("cmid is not null").select("course_id", F.col("cmid").alias("p_holder"), F.col("title").alias("h_title"), F.col("ord").alias("h_ord")), ["course_id", "p_holder"], ["h_ord"])
    joined = full.join(place, ["course_id", "section_id"]).join(led, ["course_id", "section_id"], "left").join(held, ["course_id", "p_holder"], "left")
    inner = F.col("p_parent").isNotNull() | F.col("p_main")
    title = F.coalesce("own_title", "p_own", "h_title", F.when(~inner, F.col("l_title")), "p_title")
    made = joined.select(
        "course_id", "section_id", F.when(inner, F.col("p_parent")).otherwise(F.col("l_parent")).alias("parent_section_id"), F.when(inner, F.col("p_ord")).otherwise(F.coalesce("l_ord", "p_ord")).alias("ord"), title.alias("title"),
        "summary_html", F.col("url").alias("page_url"), "has_content", (inner | F.col("l_parent").isNotNull()).alias("reached"),
    )
    mine = activities.join(made.select("course_id", "section_id", "page_url"), ["course_id", "section_id", "page_url"])
    return made, mine


def section_paths(sections: DataFrame) -> DataFrame:
    """(course_id, section_id, depth, level, path, titles, place, problem): names, titles and places from the root.

    Paths double in each round, so sections of any depth take the logarithm of the depth in joins. Sections whose parent
    isn't there start a tree of their own, with problem 'orphan'; those on a circle stand alone, with 'cycle'.
    """
    ord_ = F.col("ord") if "ord" in sections.columns else F.lit(0)
    base = sections.select("course_id", "section_id", "parent_section_id", "title", ord_.cast("int").alias("ord")).withColumn("name", naming.sanitize(F.col("title")))
    ids = base.select("course_id", F.col("section_id").alias("parent_section_id"), F.lit(True).alias("_there"))
    orphan = F.col("parent_section_id").isNotNull() & F.col("_there").isNull()
    cur = stored(base.join(ids, ["course_id", "parent_section_id"], "left").select(
        "course_id", "section_id", F.when(~orphan, F.col("parent_section_id")).alias("up"), F.array("name").alias("path"), F.array("title").alias("titles"), F.array("ord").alias("place"), F.when(orphan, "orphan").alias("problem"),
    ), "paths")
    open_, rounds, most = cur.where("up is not null").count(), 0, cur.count().bit_length() + 1
    while open_ and rounds < most:
        above = cur.select("course_id", F.col("section_id").alias("up"), F.col("up").alias("_up"), *(F.col(k).alias(f"_{k}") for k in ("path", "titles", "place", "problem")))
        longer = lambda k: F.when(F.col(f"_{k}").isNotNull(), F.concat(f"_{k}", k)).otherwise(F.col(k)).alias(k)
        step = cur.join(above, ["course_id", "up"], "left").select("course_id", "section_id", F.col("_up").alias("up"), longer("path"), longer("titles"), longer("place"), F.coalesce("problem", "_problem").alias("problem"))
        cur, rounds = stored(step, "paths"), rounds + 1
        left = cur.where("up is not null").count()
        if left == open_ and rounds > 20:  # only circles are left
            break
        open_ = left
    round_ = F.col("up").isNotNull()
    one = lambda k: F.when(round_, F.slice(k, -1, 1)).otherwise(F.col(k)).alias(k)
    out = cur.select("course_id", "section_id", one("path"), one("titles"), one("place"), F.when(round_, "cycle").otherwise(F.col("problem")).alias("problem"))
    depth = F.size("path") - 1
    return out.withColumns({"depth": depth, "level": F.least(F.lit(6), depth + 2)})


def dedupe_assets(requests: DataFrame, order: list[str]) -> DataFrame:
    """Adds asset, the place of the request whose file is used: the first with the same key, or an earlier
    one that ended at this key. requests: (course_id, url, final_url, order columns). Aggregates combine map-side."""
    at = F.struct(*order)
    keyed = requests.withColumns({"key": urls.norm_url(F.col("url")), "final_key": urls.norm_url(F.coalesce("final_url", "url")), "_at": at})
    first = keyed.groupBy("course_id", "key").agg(F.min("_at").alias("_own"), F.min_by("final_key", "_at").alias("_end"))
    ends = first.groupBy("course_id", F.col("_end").alias("key")).agg(F.min("_own").alias("_other"))
    best = first.join(ends, ["course_id", "key"], "left").select("course_id", "key", F.least("_own", F.coalesce("_other", "_own")).alias("asset"))
    return keyed.join(best, ["course_id", "key"]).drop("_at", "final_key")


def place_assets(assets: DataFrame, order: str = "ord", video: bool = False, audio: bool = False) -> DataFrame:
    """Adds name, path and media; assets: (course_id, parts, disposition, url, mime, ord). Unwanted media get no path.

    Names are worked out once and stored, as numbering them reads them several times.
    """
    media = F.coalesce(urls.skipped_media(F.col("url"), video, audio), urls.skipped_media(F.coalesce("mime", F.lit("")), video, audio))
    rows = stored(assets.withColumns({"dir": naming.zip_dir(F.col("parts")), "name": naming.filename_for(F.col("disposition"), F.col("url"), F.col("mime")), "media": media}), "named")
    kept = naming.unique_names(rows.where("media is null"), ["course_id", "dir"], "name", order)
    return kept.withColumn("path", F.concat("dir", F.lit("/"), "unique_name")).drop("unique_name").unionByName(rows.where("media is not null").withColumn("path", F.lit(None).cast("string")))


def own_parts(parts: DataFrame) -> DataFrame:
    """parts with the module they belong to: type, cmid (d for a discussion) and page: view, print, discussion or lesson."""
    page = (
        F.when(F.col("url").contains("/discuss.php"), "discussion").when(F.col("url").contains("/print/"), "print")
        .when(urls.query_param(F.col("url"), "pageid").isNotNull(), "lesson").otherwise("view")
    )
    kind = present(F.regexp_extract("url", r"/mod/(\w+)/", 1))
    return parts.withColumns({"type": kind, "page": page, "cmid": F.coalesce(F.when(page == "discussion", urls.query_param(F.col("url"), "d")), urls.query_param(F.col("url"), "id"))})


def page_common(activities: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds breadcrumb and its mismatch with the section's title; completion and dates also from the activity's own page.

    activities: (course_id, cmid, type, section_title, completion_raw, dates …); parts: parse_pages of their pages.
    """
    of = lambda kind: F.when(F.col("kind") == kind, F.col("text"))
    own = own_parts(parts).where("page = 'view' and cmid is not null and kind in ('crumb', 'date', 'completion')")
    common = own.groupBy("course_id", "type", "cmid").agg(
        joined_text(F.col("ord"), of("crumb"), " / ").alias("breadcrumb"), in_order(F.col("ord"), of("date")).alias("_dates"), F.min_by(of("completion"), F.when(F.col("kind") == "completion", F.col("ord"))).alias("_completion"),
    )
    j = activities.join(common, ["course_id", "type", "cmid"], "left").withColumn("breadcrumb", F.coalesce("breadcrumb", F.lit("")))
    differs = (F.col("breadcrumb") != "") & (F.coalesce("section_title", F.lit("")) != "") & ~F.contains(F.lower("breadcrumb"), F.lower(F.coalesce("section_title", F.lit(""))))
    raw = F.coalesce(present(F.col("completion_raw")), F.col("_completion"), F.lit(""))
    dates = F.array_distinct(F.concat("dates", F.coalesce("_dates", F.array().cast("array<string>"))))
    return j.withColumns({"breadcrumb_mismatch": differs, "completion_raw": raw, "dates": dates}).withColumn("completion", completion_status(F.col("completion_raw"))).drop("_dates", "_completion")


def line_facts(lines: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Different fact lines in order, and the meta map they give; lines: (keys, ord, line)."""
    cleaned = worked_out(lines.select(*keys, "ord", F.col("line").alias("_raw")), {"line": clean(F.col("_raw"))})
    once = first_wins(cleaned.where("line <> ''").select(*keys, "line", "ord"), [*keys, "line"], ["ord"])
    # only a line with a colon has a label; this test goes below the aggregate
    pairs = worked_out(once.where(F.col("line").contains(":")), {"_m": split_meta_line(F.col("line"))}).select(*keys, "ord", "_m.label", "_m.value").where("label is not null")
    return once.select(*keys, "ord", "line"), collect_meta(pairs, keys)


def quiz_facts(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(course_id, cmid, ord, line) of quiz pages, different and in order, with the feedback; and the meta map of the lines."""
    quiz = own_parts(parts).where("type = 'quiz' and page = 'view'")
    lines, meta = line_facts(quiz.where("kind = 'info'").select("course_id", "cmid", "ord", F.col("text").alias("line")), ["course_id", "cmid"])
    said = quiz.where("kind = 'feedback'").select("course_id", "cmid", "ord", F.concat(F.lit("Feedback: "), "text").alias("line"))
    return lines.unionByName(said), meta


def assign_facts(parts: DataFrame) -> DataFrame:
    """(course_id, cmid, meta) of the status tables of assignments."""
    rows = own_parts(parts).where("type = 'assign' and kind = 'status'").select("course_id", "cmid", "ord", F.col("text").alias("label"), F.col("link").alias("value"))
    return collect_meta(rows, ["course_id", "cmid"])


def forum_posts(parts: DataFrame, n: int = 10) -> DataFrame:
    """(course_id, cmid, rank, d, title, subject, meta, found) of the first n different discussions of each forum in page order."""
    own = own_parts(parts)
    links = own.where("page = 'view' and role = 'discussion'").select("course_id", "cmid", "ord", F.col("text").alias("title"), urls.query_param(F.col("link"), "d").alias("d")).where("d is not null")
    once = first_wins(links, ["course_id", "cmid", "d"], ["ord"])
    rank = F.row_number().over(Window.partitionBy("course_id", "cmid").orderBy("ord"))
    kept = once.withColumn("rank", rank).where(F.col("rank") <= n)
    posts = first_wins(own.where("page = 'discussion' and kind = 'post'").select("course_id", F.col("cmid").alias("d"), "url", F.col("text").alias("_subject"), F.col("link").alias("meta")), ["course_id", "d"], ["url"])
    j = kept.join(posts.drop("url"), ["course_id", "d"], "left")
    return j.select("course_id", "cmid", "rank", "d", "title", F.coalesce(present(F.col("_subject")), F.col("title")).alias("subject"), F.coalesce("meta", F.lit("")).alias("meta"), F.col("meta").isNotNull().alias("found"))


def preferred_link(links: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """For each key the link of the lowest rank, the first on the page among equals."""
    return links.withColumn("_r", rank).where("_r is not null").groupBy(*keys).agg(F.min_by("url", F.struct("_r", "ord")).alias("url"))


def lesson_plan(parts: DataFrame, cfg: SiteConfig = SiteConfig()) -> DataFrame:
    """(course_id, cmid, outline, url, fallback): a lesson's outline, its export link (a PDF before others), and whether
    its pages must be read instead: where there is no link, or one that may not be asked for."""
    own = own_parts(parts).where("type = 'lesson' and page = 'view'")
    best = preferred_link(own.where("role = 'export'").select("course_id", "cmid", "ord", F.col("link").alias("url")), ["course_id", "cmid"], F.when(F.lower("url").contains("pdf"), 0).otherwise(1))
    lines = own.groupBy("course_id", "cmid").agg(in_order(F.col("ord"), F.when(F.col("kind") == "outline", F.col("text"))).alias("outline"), F.bool_or(F.col("kind") == "menu").alias("has_menu"))
    return lines.join(best, ["course_id", "cmid"], "left").withColumn("fallback", F.col("url").isNull() | urls.is_forbidden(F.col("url"), cfg))


def lesson_pages(parts: DataFrame) -> DataFrame:
    """(course_id, cmid, rank, title, url): the pages a lesson's menu lists, url null for the page that is shown."""
    own = own_parts(parts).where("type = 'lesson' and page = 'view'")
    listed = own.where("kind = 'outline'").select("course_id", "cmid", F.col("ord").alias("rank"), F.col("text").alias("title"), F.col("link").alias("url"))
    bare = own.groupBy("course_id", "cmid").agg(F.bool_or(F.col("kind") == "menu").alias("m")).where("not m")
    return listed.unionByName(bare.select("course_id", "cmid", F.lit(0).alias("rank"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("url")))


def folder_files(links: DataFrame, keys: list[str]) -> DataFrame:
    """Links of the best selector tier of each folder, each once, in order, with their sub-folders."""
    w = Window.partitionBy(*keys)
    best = links.withColumn("_best", F.min("tier").over(w)).where("tier = _best").drop("_best")
    once = first_wins(best.select(*keys, "url", "ord"), [*keys, "url"], ["ord"])
    return once.withColumn("sub", naming.folder_subpath(F.col("url")))


def page_folder_files(parts: DataFrame) -> DataFrame:
    """(course_id, cmid, url, ord, sub) of folder pages."""
    own = own_parts(parts).where("type = 'folder' and role in ('folder1', 'folder2')")
    return folder_files(own.select("course_id", "cmid", F.col("link").alias("url"), "ord", F.col("role").alias("tier")), ["course_id", "cmid"]).drop("tier")


def resource_link(parts: DataFrame) -> DataFrame:
    """(course_id, cmid, url): the file behind a resource's wrapper page."""
    own = own_parts(parts).where("type = 'resource' and kind = 'link' and role like 'file%'")
    return preferred_link(own.select("course_id", "cmid", F.col("link").alias("url"), "ord", "role"), ["course_id", "cmid"], F.col("role"))


def page_external(parts: DataFrame, cfg: SiteConfig = SiteConfig()) -> DataFrame:
    """(course_id, cmid, external): where a link activity leads; a message where its page doesn't say."""
    own = own_parts(parts).where("type = 'url' and page = 'view'")
    links = own.where("kind = 'link'").select("course_id", "cmid", "ord", F.col("link").alias("url"), F.when(F.col("role") == "frame", "iframe").otherwise("a").alias("tag"), "role")
    found = external_url(links, ["course_id", "cmid"], cfg)
    return own.select("course_id", "cmid").distinct().join(found, ["course_id", "cmid"], "left").withColumn("external", F.coalesce("external", F.lit(NO_TARGET)))


def book_chapters(parts: DataFrame) -> DataFrame:
    """(course_id, cmid, ord, html, whole): chapters of the print page in order, or the first page of the book where none was captured."""
    own = own_parts(parts).where("type = 'book' and kind = 'fragment' and role = 'chapter'")
    best = own.groupBy("course_id", "cmid").agg(F.bool_or(F.col("page") == "print").alias("whole"))
    return own.join(best, ["course_id", "cmid"]).where((F.col("page") == "print") == F.col("whole")).select("course_id", "cmid", "ord", "url", "html", "whole")


def course_summary(courses: DataFrame, activities: DataFrame, assets: DataFrame, issues: DataFrame) -> DataFrame:
    a = activities.groupBy("course_id").agg(F.count("*").alias("n_activities"))
    f = assets.groupBy("course_id").agg(F.count_if(F.col("media").isNull()).alias("n_files"), F.count_if("converted").alias("n_converted"), F.bool_or(F.col("media").isNotNull()).alias("has_skipped_media"))
    i = issues.groupBy("course_id").agg((F.count("*") > 0).alias("has_issues"))
    out = courses
    for x in (a, f, i):
        out = out.join(x, "course_id", "left")
    zero = {k: 0 for k in ("n_activities", "n_files", "n_converted")}
    return out.fillna(zero).fillna({"has_skipped_media": False, "has_issues": False})


def activity_text(rows: DataFrame) -> DataFrame:
    """Adds text, the activity's Markdown; rows: (level, type, title, url, breadcrumb, breadcrumb_mismatch, completion,
    completion_raw, dates, restrictions, external_url, info_lines, files as lines, intro_md, desc_md, blocks)."""
    col = F.col
    some = lambda c, text: F.when(F.coalesce(c, F.lit("")) != "", text)
    icon = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ICONS.items() for x in kv)), col("type")), F.lit("▫️"))
    files = F.array_join(F.transform("files", lambda f: F.concat(F.lit("  - "), f)), "\n")
    facts = F.concat_ws(
        "\n", F.concat(F.lit("- Type: `"), "type", F.lit("`"), F.coalesce(F.concat(F.lit(" · Link: "), present(col("url"))), F.lit(""))),
        some(col("breadcrumb"), F.concat(F.lit("- Breadcrumb: "), "breadcrumb", F.when(col("breadcrumb_mismatch"), " ⚠️ (differs from course-page placement)").otherwise(""))),
        some(col("completion_raw"), F.concat(F.lit("- Completion: "), F.when(col("completion") != "", F.concat(F.lit("**"), "completion", F.lit("** — "))).otherwise(""), "completion_raw")),
        F.when(F.size("dates") > 0, F.concat(F.lit("- Dates: "), F.array_join("dates", " · "))), some(col("restrictions"), F.concat(F.lit("- Restrictions: "), "restrictions")),
        some(col("external_url"), F.concat(F.lit("- External URL: "), "external_url")), F.when(F.size("info_lines") > 0, F.array_join(F.transform("info_lines", lambda x: F.concat(F.lit("- "), x)), "\n")),
        F.when(F.size("files") > 0, F.concat(F.lit("- Files:\n"), files)),
    )
    body = F.coalesce(present(col("intro_md")), present(col("desc_md")))
    blocks = F.array_join(F.filter("blocks", lambda b: b != ""), "\n\n")
    full = F.concat_ws("\n\n", F.concat(F.repeat(F.lit("#"), col("level")), F.lit(" "), icon, F.lit(" "), "title"), facts, body, present(blocks))
    label = F.concat_ws("\n\n", present(col("desc_md")), F.when(F.size("files") > 0, F.array_join(F.transform("files", lambda f: F.concat(F.lit("- 📎 "), f)), "\n")))
    return rows.withColumn("text", F.when(col("type") == "label", label).otherwise(full))


def render_course(fragments: DataFrame) -> DataFrame:
    """(course_id, text): one document for each course; fragments: (course_id, section_ord, ord, text).

    Sections are joined first, so no task holds more than a section before the course's own join.
    """
    by_section = fragments.where("text is not null and text <> ''").groupBy("course_id", "section_ord").agg(joined_text(F.col("ord"), F.col("text"), "\n\n").alias("text"))
    return by_section.groupBy("course_id").agg(F.concat(joined_text(F.col("section_ord"), F.col("text"), "\n\n"), F.lit("\n")).alias("text"))


def write_course_markdown(documents: DataFrame, path: str) -> None:
    """One folder for each course, its text in one file."""
    documents.select("course_id", F.regexp_replace("text", "\n$", "").alias("value")).write.partitionBy("course_id").text(path)


def issues_report(errors: DataFrame, warnings: DataFrame) -> DataFrame:
    """Issues once each, errors before warnings; both (source, message, url)."""
    both = errors.withColumn("severity", F.lit("error")).unionByName(warnings.withColumn("severity", F.lit("warning"))).dropDuplicates(["severity", "source", "message", "url"])
    line = F.concat(F.when(F.col("severity") == "error", F.lit("- ❌ ")).otherwise(F.lit("- ⚠️ ")), "message")
    return both.withColumn("line", line)


def asset_line(rows: DataFrame) -> DataFrame:
    return rows.withColumn("line", file_link(F.col("name"), F.col("path"), F.col("media"), F.col("url"), F.col("md_path")))
