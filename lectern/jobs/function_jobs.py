"""Queries of the column functions: text, addresses, names, dates, deadlines."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from lectern.config import SiteConfig
from lectern.functions import dates, naming, text, urls
from lectern.jobs.registry import query
from lectern.jobs.sources import read
from lectern.operators import deadlines, relational
from lectern.operators.stored import dealt, stored

WS = "[\\x{9}\\x{A}\\x{B}\\x{C}\\x{D} \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


@query(f"select doc_id, trim(regexp_replace(text, '{WS}+', ' ', 'g')) as cleaned from documents")
def u07_clean(spark, d):
    return read(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("""select doc_id, replace(replace(replace(replace(replace(text, '\\', '\\\\'), ';', '\\;'), ',', '\\,'), chr(13) || chr(10), '\\n'), chr(10), '\\n') as escaped from documents""")
def x02_ics_escape(spark, d):
    return read(spark, d, "documents").select("doc_id", text.ics_escape(F.col("text")).alias("escaped"))


@query("""select doc_id, case when contains(text, '"') or contains(text, ',') or contains(text, ';') or contains(text, chr(10)) or contains(text, chr(13)) then '"' || replace(text, '"', '""') || '"' else coalesce(text, '') end as cell from documents""")
def x03_csv_cell(spark, d):
    return read(spark, d, "documents").select("doc_id", text.csv_cell(F.col("text")).alias("cell"))


@query(f"""select doc_id, replace(replace(replace(coalesce(text, ''), '|', '\\|'), chr(13) || chr(10), chr(10)), chr(10), '<br>') as md,
 coalesce(nullif(replace(trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g')), '|', '\\|'), ''), '—') as course from documents""")
def x04_md_cells(spark, d):
    return read(spark, d, "documents").select("doc_id", text.md_cell(F.col("text")).alias("md"), text.course_cell(F.col("text")).alias("course"))


@query("select doc_id, replace(text, chr(10), ' ') as line, true as short from documents where text is not null")
def x05_fold_line(spark, d):
    folded = read(spark, d, "documents").where("text is not null").select("doc_id", text.fold_line(F.replace(F.col("text"), F.lit("\n"), F.lit(" "))).alias("x"))
    return folded.select("doc_id", F.replace("x", F.lit("\r\n "), F.lit("")).alias("line"), F.forall(F.split("x", "\r\n"), lambda l: F.octet_length(l) <= 75).alias("short"))


@query("""select p_partkey, p_name || ' & <' || chr(cast(200 + p_partkey % 50 as integer)) || '> "' || p_brand || '"' as plain from part""")
def x01_decode_html(spark, d):
    raw = F.concat(F.lit("<p>"), "p_name", F.lit(" <b>&amp;</b>\n &lt;&#"), (200 + F.col("p_partkey") % 50).cast("string"), F.lit(";&gt; &quot;"), "p_brand", F.lit("&quot;</p>"))
    return read(spark, d, "part").select("p_partkey", text.decode_html(raw).alias("plain"))


@query("select p_partkey, case when p_size % 2 = 0 then '<a b/' || p_partkey || '>' else 'a/' || p_partkey end as link, case when p_size % 3 = 0 then '🎥 ' || p_name || ' (not downloaded): http://x/' || p_partkey when p_size % 2 = 0 then '[' || p_name || '](<a b/' || p_partkey || '>) · 📝 [as Markdown](m.md)' else '[' || p_name || '](a/' || p_partkey || ') · 📝 [as Markdown](m.md)' end as file from part")
def x07_links(spark, d):
    path = F.concat(F.when(F.col("p_size") % 2 == 0, "a b/").otherwise("a/"), "p_partkey")
    media = F.when(F.col("p_size") % 3 == 0, "video")
    link = text.file_link(F.col("p_name"), path, media, F.concat(F.lit("http://x/"), "p_partkey"), F.lit("m.md"))
    return read(spark, d, "part").select("p_partkey", text.md_link(path).alias("link"), link.alias("file"))


@query("select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/x/' || page_id as abs, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '[^/]*$', '') || 'y.html' as rel from pages")
def u01_abs_url(spark, d):
    p = read(spark, d, "pages").withColumn("base", F.regexp_replace("url", "[?#].*$", ""))
    bad = urls.abs_url(F.lit("mailto:x@y"), F.col("base"))
    return p.select("page_id", urls.abs_url(F.concat(F.lit("/x/"), "page_id"), F.col("base")).alias("abs"), F.coalesce(bad, urls.abs_url(F.lit("y.html"), F.col("base"))).alias("rel"))


@query("select page_id, split_part(url, '#', 1) as key, 'resource:' || page_id as res, split_part(url, '#', 1) as back from pages")
def u02_norm_url(spark, d):
    u = F.col("url")
    bare = F.regexp_replace(u, "#.*$", "")
    more = F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit("forcedownload=1&redirect=1#frag"))
    res = F.concat(F.lit("https://c.example.org/mod/resource/view.php?id="), "page_id", F.lit("&redirect=1#x"))
    return read(spark, d, "pages").select("page_id", urls.norm_url(u).alias("key"), urls.norm_url(res).alias("res"), urls.norm_url(more).alias("back"))


@query("""select page_id, (page_id % 4 = 0) as allowed, case when page_id % 4 = 0 then null else u end as refused from
 (select page_id, case page_id % 4 when 0 then 'https://campus.example.org/p/' when 1 then 'https://other.example.org/p/' when 2 then 'https://campus.example.org/startattempt/' else 'https://campus.example.org/x?sesskey=' end || page_id as u from pages)""")
def u03_split_guarded(spark, d):
    head = F.element_at(F.array(*map(F.lit, ("https://campus.example.org/p/", "https://other.example.org/p/", "https://campus.example.org/startattempt/", "https://campus.example.org/x?sesskey="))), (F.col("page_id") % 4 + 1).cast("int"))
    p = read(spark, d, "pages").select("page_id", F.concat(head, "page_id").alias("u"))
    allowed, issues = urls.split_guarded(p.unionByName(p), "u", SiteConfig())
    yes = allowed.select("page_id").distinct().withColumn("a", F.lit(True))
    return p.join(yes, "page_id", "left").join(issues.select(F.col("url").alias("refused")), F.col("u") == F.col("refused"), "left").select("page_id", F.coalesce("a", F.lit(False)).alias("allowed"), "refused")


@query("""select page_id, (select count(*) from pages where page_id % 5 < 2) as allowed, (select count(*) from pages where page_id % 5 in (2, 3)) as refused, (select count(*) from pages where page_id % 5 = 4) as unparsable from pages where page_id % 5 < 2""")
def u03_guard_counts(spark, d):
    """What the guard lets through, and how many rows it refused, counted in the pass that writes the others."""
    head = F.element_at(F.array(*map(F.lit, ("https://campus.example.org/p/", "https://campus.example.org/q?x=", "https://other.example.org/p/", "https://campus.example.org/x?sesskey=", "no address "))), (F.col("page_id") % 5 + 1).cast("int"))
    seen = Observation(f"guard-{uuid.uuid4().hex}")
    allowed = stored(urls.guarded(read(spark, d, "pages").select("page_id", F.concat(head, "page_id").alias("u")), "u", seen, SiteConfig()), "allowed")
    return allowed.select("page_id", *(F.lit(n).cast("bigint").alias(k) for k, n in seen.get.items()))


@query("select page_id, 'https://c.example.org/a?id=' || page_id || '&redirect=1' as added, 'https://c.example.org/a?id=9&x=1#f' as replaced from pages")
def u04_set_param(spark, d):
    base = F.concat(F.lit("https://c.example.org/a?id="), "page_id")
    return read(spark, d, "pages").select("page_id", urls.set_param(base, "redirect", F.lit("1")).alias("added"), urls.set_param(F.concat(base, F.lit("&x=1#f")), "id", F.lit("9")).alias("replaced"))


@query("select p_partkey, case p_size % 4 when 0 then 'video' when 1 then 'audio' when 2 then 'video' end as kind, case p_size % 4 when 1 then 'audio' end as skipped from part")
def u05_media_kind(spark, d):
    x = F.element_at(F.array(*map(F.lit, ("http://x/a.MP4?f=1", "http://x/a.mp3", "video/quicktime", "http://x/a.pdf"))), (F.col("p_size") % 4 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", urls.media_kind(x).alias("kind"), urls.skipped_media(x, video=True).alias("skipped"))


@query("select p_partkey, case p_size % 3 when 0 then 'quiz' when 1 then 'page' else 'unknown' end as kind, case p_size % 3 when 2 then 'd' || p_partkey else cast(p_partkey as varchar) end as id from part")
def u06_activity(spark, d):
    third = F.col("p_size") % 3
    url = F.when(third == 1, F.concat(F.lit("https://c/mod/page/view.php?x=1&id="), "p_partkey"))
    cls, data = F.when(third == 0, "activity quiz modtype_quiz").otherwise("activity"), F.when(third == 2, F.concat(F.lit("d"), "p_partkey")).otherwise("")
    return read(spark, d, "part").select("p_partkey", urls.activity_type(cls, url).alias("kind"), urls.module_id(data, F.when(third == 0, F.concat(F.lit("module-"), "p_partkey")), url).alias("id"))


@query("select p_partkey, case p_size % 4 when 0 then '🎥 Video' when 1 then '🎥 Video' when 2 then '🔊 Audio' else '🧩 Embedded' end as kind from part")
def u08_embed_kind(spark, d):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_size") % 4 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", urls.embed_kind(pick("iframe", "video", "audio", "iframe"), pick("https://youtu.be/x", "http://x/y", "http://x/y", "https://h5p.example.org/e")).alias("kind"))


@query("select p_partkey, r >= 150 and g <= 90 and b <= 90 as red, r >= 150 and g <= 90 and b <= 90 as red_rgb from (select p_partkey, p_partkey % 256 as r, (p_partkey * 7) % 256 as g, (p_partkey * 11) % 256 as b from part)")
def u09_is_red(spark, d):
    ch = [((F.col("p_partkey") * m) % 256).cast("int") for m in (1, 7, 11)]
    hex_ = F.concat(F.lit("#"), *(F.lpad(F.hex(x), 2, "0") for x in ch))
    return read(spark, d, "part").select("p_partkey", urls.is_red_color(hex_).alias("red"), urls.is_red_color(F.format_string(" RGB(%d, %d,%d)", *ch)).alias("red_rgb"))


@query("select p_partkey, case p_size % 4 when 0 then 'To do' when 1 then 'Done' when 2 then 'To do' else '' end as status from part")
def u10_completion(spark, d):
    x = F.element_at(F.array(*map(F.lit, ("Marquer comme terminé", "Terminé : vu", "À faire : rendre un devoir fait", "n/a"))), (F.col("p_size") % 4 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", deadlines.completion_status(x).alias("status"))


@query(rf"""select doc_id, coalesce(nullif(case when length(n) > 80 then regexp_replace(substr(n, 1, 80 - length(e)), '[ ]+$', '') || e else n end, ''), 'untitled') as name, '_nul.txt' as reserved
 from (select doc_id, n, regexp_extract(n, '[.][A-Za-z0-9]{{1,8}}$') as e from (select doc_id, case when regexp_matches(lower(t), '^(con|prn|aux|nul|com[0-9]|lpt[0-9])([.].*)?$') then '_' else '' end || t as n
 from (select doc_id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\x00-\x1f\x7f]', '', 'g'), '[<>:"/\\|?*]', '_', 'g'), '{WS}+', ' ', 'g')), '[. ]+$', '') as t from documents)))""")
def f01_sanitize(spark, d):
    """Whole texts as names: most are longer than a name may be."""
    return read(spark, d, "documents").select("doc_id", naming.sanitize(F.col("text")).alias("name"), naming.sanitize(F.lit("nul.txt")).alias("reserved"))


@query("select n_nationkey, n_name || ' é à' as name, n_name as plain from nation")
def f02_fix_mojibake(spark, d):
    bad = F.decode(F.encode(F.concat("n_name", F.lit(" é à")), "UTF-8"), "ISO-8859-1")
    return read(spark, d, "nation").select("n_nationkey", naming.fix_mojibake(bad).alias("name"), naming.fix_mojibake(F.col("n_name")).alias("plain"))


@query("select p_partkey, case p_size % 4 when 0 then 'é ' || p_partkey || '.pdf' when 1 then 'a+b ' || p_partkey || '.pdf' when 2 then 'n' || p_partkey || '.doc' end as name from part")
def f03_disposition(spark, d):
    k = F.col("p_partkey").cast("string")
    cd = F.element_at(F.array(F.concat(F.lit("attachment; filename=\"x\"; filename*=UTF-8''%C3%A9%20"), k, F.lit(".pdf")), F.concat(F.lit('inline; filename="a+b%20'), k, F.lit('.pdf"')), F.concat(F.lit("attachment; filename=n"), k, F.lit(".doc")), F.lit("inline")), (F.col("p_size") % 4 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", naming.filename_from_disposition(cd).alias("name"))


@query("select page_id, regexp_extract(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', ''), '([^/]*)$', 1) as name, 'é x.pdf' as coded from pages")
def f04_name_from_url(spark, d):
    return read(spark, d, "pages").select("page_id", naming.name_from_url(F.col("url")).alias("name"), naming.name_from_url(F.lit("https://x/a/%C3%A9%20x.pdf?b=1")).alias("coded"))


@query("select p_partkey, case p_size % 3 when 0 then 'd' || p_partkey || '.pdf' when 1 then 'u' || p_partkey || '.docx' else 'file' end as name from part")
def f05_filename_for(spark, d):
    third = F.col("p_size") % 3
    cd = F.when(third == 0, F.concat(F.lit('filename="d'), "p_partkey", F.lit('"'))).otherwise("")
    url = F.when(third == 1, F.concat(F.lit("https://x/f/u"), "p_partkey", F.lit("?f=1"))).otherwise("https://x/")
    mime = F.element_at(F.array(F.lit("application/pdf; q"), F.lit("application/vnd.openxmlformats-officedocument.wordprocessingml.document"), F.lit("x/y")), (third + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", naming.filename_for(cd, url, mime).alias("name"))


@query("""select p_partkey, case when p_size % 2 = 0 then 'files/' || p_name || '/leaf' else 'files/' || rtrim(substr(repeat('abcdefg ', 10), 1, 40)) || '/' || rtrim(substr(repeat('hijklmn ', 10), 1, 40)) || '/leaf' end as dir from part""")
def f06_zip_dir(spark, d):
    long = F.array(*(F.trim(F.repeat(F.lit(x), 10)) for x in ("abcdefg ", "hijklmn ")), F.lit("leaf"))
    return dealt(read(spark, d, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", naming.zip_dir(F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_name"), F.lit("leaf"))).otherwise(long)).alias("dir"))


@query("""select doc_id, case when n = 1 then w || '.txt' else w || ' (' || n || ').txt' end as name from (select doc_id, w, row_number() over (partition by source, lower(w) order by doc_id) as n
 from (select doc_id, source, 'n' || substr(coalesce(text, ''), 1, 1) as w from documents where regexp_matches(coalesce(text, ''), '^[A-Za-z]')))""")
def f07_unique_names(spark, d):
    rows = read(spark, d, "documents").where(F.coalesce("text", F.lit("")).rlike("^[A-Za-z]")).select("doc_id", "source", F.concat(F.lit("n"), F.substring("text", 1, 1), F.lit(".txt")).alias("name"))
    return naming.unique_names(rows, ["source"], "name", "doc_id").select("doc_id", F.col("unique_name").alias("name"))


@query("select s_suppkey, 'Week ' || s_suppkey || '|sub é' as sub from supplier")
def f08_folder_subpath(spark, d):
    url = F.concat(F.lit("https://c/pluginfile.php/9/mod_folder/content/3/Week%20"), "s_suppkey", F.lit("/sub%20%C3%A9/file%20a.pdf?forcedownload=1"))
    return read(spark, d, "supplier").select("s_suppkey", F.array_join(naming.folder_subpath(url), "|").alias("sub"))


FR = "list_extract(['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre'], month(o_orderdate))"


def prose():
    fr = F.element_at(F.array(*(F.lit(names.split()[0]) for names in dates.MONTHS.values())), F.month("o_orderdate"))
    en = F.date_format("o_orderdate", "MMMM d, yyyy")
    day = F.dayofmonth("o_orderdate").cast("string")
    year = F.year("o_orderdate").cast("string")
    return F.element_at(F.array(F.concat(F.lit("Fermé le lundi "), day, F.lit(" "), fr, F.lit(" "), year, F.lit(", 08:05")), F.concat(en, F.lit(" 2:30 PM")), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("bientôt")), (F.col("o_orderkey") % 4 + 1).cast("int"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d 08:05') when 1 then strftime(o_orderdate, '%Y-%m-%d 14:30') when 2 then strftime(o_orderdate, '%Y-%m-%d 23:59') end as at from orders")
def d01_parse_date(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.date_format(dates.parse_date(prose()), "yyyy-MM-dd HH:mm").alias("at"))


LABELS_SEEN = [("Date limite", "cutoff"), ("À remettre avant", "due"), ("Closes", "closes"), ("Ouvert le", "opens"), ("Attempts allowed", "attempts"), ("Note de passage", "gradeToPass"), ("Time limit", "timeLimit"), ("Submission status", "submissionStatus"), ("Grading status", "gradingStatus"), ("Temps restant", "timeRemaining"), ("Autre", None)]


@query("select p_partkey, case p_partkey % 11 " + " ".join(f"when {i} then '{k}'" for i, (_, k) in enumerate(LABELS_SEEN) if k) + " end as key from part")
def d02_meta_key(spark, d):
    label = F.element_at(F.array(*(F.lit(x) for x, _ in LABELS_SEEN)), (F.col("p_partkey") % 11 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", deadlines.meta_key(label).alias("key"))


@query("select p_partkey, case when p_size % 2 = 0 then p_name end as label, case when p_size % 2 = 0 then p_brand || ': ' || p_type end as value from part")
def d03_split_meta_line(spark, d):
    line = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_name", F.lit("  :  "), "p_brand", F.lit(":  "), "p_type")).otherwise(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", deadlines.split_meta_line(line).alias("m")).select("p_partkey", "m.*")


@query("""select l_orderkey, coalesce(min(case when k = 1 then v end), '') as cutoff, coalesce(min(case when k = 2 then v end), '') as due from (select l_orderkey, l_linenumber % 3 as k, 'v' || l_partkey as v, row_number() over (partition by l_orderkey, l_linenumber % 3 order by l_partkey, l_suppkey, l_extendedprice) as n from lineitem) where n = 1 and k > 0 group by 1""")
def d04_collect_meta(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("ord"), F.element_at(F.array(F.lit("Autre"), F.lit("Date limite"), F.lit("Due date")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("label"), F.concat(F.lit("v"), "l_partkey").alias("value"))
    meta = deadlines.collect_meta(lines, ["l_orderkey"])
    return meta.select("l_orderkey", *(F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit("")).alias(k) for k in ("cutoff", "due")))


NOW = "1998-06-15 12:00:00"


def activities(spark, d):
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    k = F.col("o_orderkey") % 6
    return read(spark, d, "orders").select(
        (F.col("o_custkey") % 50).alias("course_id"), F.col("o_orderkey").alias("ord"), F.when(k == 5, "page").otherwise("quiz").alias("type"), F.concat(F.lit("A"), "o_orderkey").alias("title"), F.array(F.lit("S1"), F.lit("S2")).alias("section_titles"),
        F.when(k == 0, day).otherwise("").alias("opens"), F.when(k == 1, day).otherwise("").alias("closes"), F.when(k == 2, day).otherwise("").alias("due"),
        F.when(k == 3, day).when((k == 2) & (F.col("o_custkey") % 2 == 0), "01/01/2030").when(k == 4, "plus tard").when((k == 1) & (F.col("o_custkey") % 2 == 0), day).otherwise("").alias("cutoff"), F.lit("").alias("attempts"), F.lit("a|b").alias("gradeToPass"), F.lit("").alias("completion"),
    )


STATUS_SQL = """case when k = 5 then 'no dates' when k = 4 then '?' when k = 0 then case when o_orderdate + interval 1439 minute > timestamp '1998-06-15 12:00' then 'upcoming' else 'open' end
 when e < timestamp '1998-06-15 12:00' then case when k = 2 and o_custkey % 2 = 0 then 'overdue (cut-off later)' else 'closed' end else 'open' end"""
STATUS_FROM = "(select *, o_orderkey % 6 as k, o_orderdate + interval 1439 minute as e from orders)"


@query(f"select o_orderkey as ord, {STATUS_SQL} as status from {STATUS_FROM}")
def d05_deadline_status(spark, d):
    return activities(spark, d).select("ord", deadlines.deadline_status(*(F.col(x) for x in ("opens", "closes", "due", "cutoff")), F.lit(NOW).cast("timestamp_ntz")).alias("status"))


@query(f"""select course_id, ord, row_number() over (partition by course_id order by at_ nulls last, ord) as rank,
 '| A' || ord || ' | quiz | S1 › S2 | ' || case when k = 0 then dm else '—' end || ' | ' || case when k in (1, 2) then dm else '—' end || ' | ' || case when k = 3 then dm when k = 2 and o_custkey % 2 = 0 then '01/01/2030' when k = 4 then 'plus tard' else '—' end || ' | — | a\\|b | — | ' || status || ' |' as line
 from (select o_custkey % 50 as course_id, o_orderkey as ord, k, o_custkey, strftime(o_orderdate, '%d/%m/%Y') as dm, case when k in (1, 2, 3) then e end as at_, {STATUS_SQL} as status from {STATUS_FROM} where k <> 5)""")
def d06_deadlines(spark, d):
    return deadlines.deadlines(activities(spark, d), F.lit(NOW).cast("timestamp_ntz")).select("course_id", "ord", "rank", "line")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'c' when o_orderkey % 3 = 1 and o_orderstatus = 'F' then 'cut' end as closes from orders")
def d07_lesson_fix(spark, d):
    k = F.col("o_orderkey") % 3
    meta = F.when(k == 0, F.create_map(F.lit("closes"), F.lit("c"), F.lit("cutoff"), F.lit("cut"))).when(k == 1, F.create_map(F.lit("cutoff"), F.lit("cut"))).otherwise(F.create_map(F.lit("due"), F.lit("d")))
    kind = F.when(F.col("o_orderstatus") == "F", "lesson").otherwise("quiz")
    return read(spark, d, "orders").select("o_orderkey", F.try_element_at(deadlines.lesson_fix(kind, meta), F.lit("closes")).alias("closes"))


@query("""select o_orderkey, strftime(case o_orderkey % 3 when 0 then date_trunc('week', o_orderdate) when 1 then date_trunc('month', o_orderdate) else make_date(cast(year(o_orderdate) - case when month(o_orderdate) >= 8 then 0 else 1 end as integer), 9, 1) end, '%Y-%m-%d') as a,
 strftime(case o_orderkey % 3 when 0 then date_trunc('week', o_orderdate) + interval 6 day when 1 then last_day(o_orderdate) else make_date(cast(year(o_orderdate) + case when month(o_orderdate) >= 8 then 1 else 0 end as integer), 8, 31) end, '%Y-%m-%d') as b from orders""")
def d08_compute_range(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("week", "month", "year"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    r = dates.compute_range(kind, F.to_date("o_orderdate"))
    return read(spark, d, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", F.date_format("r.start", "yyyy-MM-dd").alias("a"), F.date_format("r.end", "yyyy-MM-dd").alias("b"))


@query("""select o_orderkey, strftime(o_orderdate + to_days(cast(184 * i as integer)), '%Y-%m-%d') as a, strftime(least(o_orderdate + to_days(cast(184 * i + 183 as integer)), o_orderdate + interval 400 day), '%Y-%m-%d') as b from orders, (values (0), (1), (2)) t(i)""")
def d09_date_chunks(spark, d):
    day = F.to_date("o_orderdate")
    w = read(spark, d, "orders").select("o_orderkey", F.explode(dates.date_chunks(day, F.date_add(day, 400))).alias("w"))
    return w.select("o_orderkey", F.date_format("w.start", "yyyy-MM-dd").alias("a"), F.date_format("w.end", "yyyy-MM-dd").alias("b"))


@query("select user_id, event_type, min(event_id) as event_id from events group by all")
def n01_first_wins(spark, d):
    return relational.first_wins(read(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("select conv_id, turn, rank from (select conv_id, turn, row_number() over (partition by conv_id order by turn, role, text) as rank from conversations) where rank <= 3")
def n02_top_n(spark, d):
    return relational.top_n(read(spark, d, "conversations"), ["conv_id"], ["turn", "role", "text"], 3).select("conv_id", "turn", F.col("rank").cast("bigint").alias("rank"))


@query("select event_id, last_value(case when event_type = 'error' then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as filled from events")
def n03_forward_fill(spark, d):
    e = read(spark, d, "events").withColumn("x", F.when(F.col("event_type") == "error", F.col("value")))
    return relational.forward_filled(e, ["user_id"], ["event_id"], "x", "filled").select("event_id", "filled")


@query("select event_id, last_value(case when event_type = 'error' then value end ignore nulls) over (order by event_id rows between unbounded preceding and current row) as filled from events")
def n03_forward_fill_of_one_key(spark, d):
    """All events are one key, filled range by range."""
    e = read(spark, d, "events").select("event_id", F.lit("all").alias("key"), F.when(F.col("event_type") == "error", F.col("value")).alias("x"))
    return relational.forward_filled_by_ranges(e, ["key"], ["event_id"], {"filled": F.col("x")}).select("event_id", "filled")


@query("select event_id, coalesce(event_type <> lag(event_type) over (order by event_id), true) as new_type, coalesce(user_id <> lag(user_id) over (order by event_id), true) as new_user from events")
def n04_first_of_group_of_one_key(spark, d):
    """All events are one key; two kinds of groups, each range looking at the last row of the one before."""
    e = read(spark, d, "events").select("event_id", F.lit("all").alias("key"), "event_type", "user_id")
    return relational.first_of_group_by_ranges(e, ["key"], ["event_id"], {"new_type": F.col("event_type"), "new_user": F.col("user_id")}).select("event_id", "new_type", "new_user")


@query("select event_id, row_number() over (order by value desc nulls last, event_id) as rank, row_number() over (partition by event_type order by ts, event_id) as rank_of_type from events")
def n02_rank_of_all_rows(spark, d):
    """Ranks over the whole table and over its few types, by a range-partitioned sort."""
    e = read(spark, d, "events").select("event_id", "event_type", "ts", "value")
    return relational.ranked(relational.ranked(e, [F.col("value").desc_nulls_last(), "event_id"], "rank"), ["ts", "event_id"], "rank_of_type", ["event_type"]).select("event_id", "rank", "rank_of_type")


@query("select o_custkey as course_id, count(*) as n_orders, count_if(o_orderstatus = 'F') as n_done, bool_or(o_orderpriority = '1-URGENT') as has_urgent from orders group by 1")
def a07_counts_and_flags(spark, d):
    """A course's counts and flags in one aggregate."""
    flags = {"has_urgent": F.col("o_orderpriority") == "1-URGENT"}
    o = read(spark, d, "orders").withColumnRenamed("o_custkey", "course_id")
    return relational.counts_and_flags(o, ["course_id"], {"n_orders": F.lit(True), "n_done": F.col("o_orderstatus") == "F"}, flags)


@query("select event_id, coalesce(event_type <> lag(event_type) over (partition by user_id order by event_id), true) as first from events")
def n04_first_of_group(spark, d):
    return relational.first_of_group(read(spark, d, "events"), ["user_id"], ["event_id"], F.col("event_type"), "first").select("event_id", "first")


@query("select conv_id, coalesce(string_agg(role || ': ' || text, '\n' order by turn, role, text), '') as text from conversations group by 1")
def a05_joined_text(spark, d):
    t = read(spark, d, "conversations")
    return t.groupBy("conv_id").agg(relational.joined_text(F.struct("turn", "role", "text"), F.concat("role", F.lit(": "), "text")).alias("text"))


@query("select l_orderkey, string_agg(f, '|' order by p) as flags from (select l_orderkey, l_returnflag as f, min(l_partkey * 100000 + l_suppkey * 10 + l_linenumber) as p from lineitem group by 1, 2) group by 1")
def a06_distinct_in_order(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("p"), "l_returnflag"))).alias("x"))
    return rows.select("l_orderkey", F.array_join(relational.distinct_in_order(F.transform("x", lambda r: r["l_returnflag"])), "|").alias("flags"))
