"""Timetable events: reading, first-wins dedupe, details, normalisation, titles and fields.

Details stay inside their row (an array of elements), so filling, classifying and collecting need no
shuffle; ``fill_labels`` and ``collect_exploded`` are the forms for one element a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import ExportPrefs
from lectern.functions.text import bound, clean, decode_html, decode_many, present, trimmed
from lectern.operators.relational import distinct_in_order, first_wins, forward_filled, ranked
from lectern.sources.captures import json_files

EVENT = (
    "struct<id:string,start:string,`end`:string,allDay:boolean,description:string,backgroundColor:string,textColor:string,department:string,"
    "faculty:string,eventCategory:string,sites:array<string>,modules:array<string>,registerStatus:int,studentMark:int,custom1:string,custom2:string,custom3:string>"
)
ELEMENT = "struct<label:string,content:string,federationId:string,entityType:int,assignmentContext:string,containsHyperlinks:boolean,isNotes:boolean,isStudentSpecific:boolean>"
#: Kinds of detail values, in the order of their rules.
KINDS = ("links", "modules", "staff", "rooms", "groups", "notes", "name", "extra")


def parse_calendar(raw: DataFrame, body: str = "body", issue: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Events of JSON arrays with their place (pos), and issues for bodies that are none; raw keeps its other columns.

    Issues name the column ``issue`` (a path), else the body's first characters.
    """
    return _parsed(raw, body, EVENT, "calendar", "not an array of events", issue)


def parse_details(raw: DataFrame, body: str = "body", issue: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(raw's other columns, elements) of JSON detail objects, and issues for bodies that are none."""
    others = [c for c in raw.columns if c != body]
    parsed = raw.withColumn("_d", F.from_json(body, f"struct<elements:array<{ELEMENT}>>"))
    good = F.coalesce(F.col("_d.elements").isNotNull() & F.col(body).rlike(r"^\s*\{"), F.lit(False))
    return parsed.where(good).select(*others, F.col("_d.elements").alias("elements")), _unread(parsed.where(~good), issue or body, "details", "no elements")


def _parsed(raw: DataFrame, body: str, kind: str, source: str, message: str, issue: str | None) -> tuple[DataFrame, DataFrame]:
    others = [c for c in raw.columns if c != body]
    parsed = raw.withColumn("_events", F.from_json(body, f"array<{kind}>"))
    good = F.coalesce(F.col("_events").isNotNull() & F.col(body).rlike(r"^\s*\["), F.lit(False))
    events = parsed.where(good).select(*others, F.posexplode("_events").alias("pos", "_e")).select(*others, "pos", "_e.*")
    return events, _unread(parsed.where(~good), issue or body, source, message)


def _unread(rows: DataFrame, said: str, source: str, message: str) -> DataFrame:
    return rows.select(F.lit(source).alias("source"), F.lit("error").alias("severity"), F.lit(message).alias("message"), (F.col(said) if said == "path" else F.substring(said, 1, 80)).alias("url"))


#: Captured responses: one row each, with the calendar and chunk, or the calendar and event, they answer.
CHUNKS, RESPONSES = "calendar string, chunk int, body string", "calendar string, event_id string, body string"


def read_calendar(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw events of captured chunk responses (Parquet of CHUNKS) and issues."""
    return parse_calendar(spark.read.schema(CHUNKS).parquet(path))


def read_details(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(calendar, event_id, elements) of captured detail responses (Parquet of RESPONSES) and issues."""
    return parse_details(spark.read.schema(RESPONSES).parquet(path))


def read_calendar_files(spark: SparkSession, folder: str, pattern: str = r"([^/]+)_(\d+)\.json$") -> tuple[DataFrame, DataFrame]:
    """Raw events of a folder of captured chunk responses (calendar_chunk.json) with chunk, pos and path, and issues by path."""
    found, issues = json_files(spark, folder, pattern, ["calendar", "chunk"])
    events, unread = parse_calendar(found.withColumn("chunk", F.col("chunk").try_cast("int")).select("calendar", "chunk", "path", "body"), issue="path")
    return events, issues.unionByName(unread)


def read_details_files(spark: SparkSession, folder: str, pattern: str = r"([^/]+)_([^/_]+)\.json$") -> tuple[DataFrame, DataFrame]:
    """(calendar, event_id, path, elements) of a folder of captured detail responses (calendar_event.json), and issues by path."""
    found, issues = json_files(spark, folder, pattern, ["calendar", "event_id"])
    details, unread = parse_details(found.select("calendar", "event_id", "path", "body"), issue="path")
    return details, issues.unionByName(unread)


def dedupe_events(events: DataFrame, order: list[str], scope: list[str] = ["calendar"]) -> DataFrame:  # noqa: B006
    """The first capture of each id over overlapping chunks; rows without an id go."""
    return first_wins(events.where("id is not null"), [*scope, "id"], order)


def in_range(events: DataFrame, start: str, end: str) -> DataFrame:
    return events.where(F.substring("start", 1, 10).between(start, end))


def parse_description(desc: Column) -> Column:
    """struct(rawTitle, name, groups, rooms) of the description's blocks, markup and entities decoded."""
    # line ends and breaks become private-use characters before anything is decoded, so what entities say is text
    desc = F.coalesce(desc, F.lit(""))
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(desc, "[\ue000\ue001]", ""), "\r?\n", "\ue000"), r"(?i)<br\s*/?>", "\ue001")
    blocks = F.split(decode_html(trimmed(kept)), f"\ue000[\ue000\\s]*\ue001[\\s]*\ue000")
    values = F.transform(blocks, lambda b: F.filter(F.transform(F.split(b, "\ue001"), lambda v: clean(F.replace(v, F.lit("\ue000"), F.lit(" ")))), lambda x: x != ""))
    return bound(values, _described)


def _described(values: Column) -> Column:
    n = F.size(values)
    empty = F.array().cast("array<string>")
    middle = F.flatten(F.slice(values, 2, F.greatest(F.lit(0), n - 3)))
    name = F.when(n == 1, F.array_join(F.slice(values[0], 2, F.greatest(F.lit(0), F.size(values[0]) - 1)), " ")).when(n == 2, F.lit("")).otherwise(F.array_join(middle, " — "))
    return F.struct(
        F.coalesce(F.try_element_at(values[0], F.lit(1)), F.lit("")).alias("rawTitle"), name.alias("name"),
        F.when(n == 1, empty).when(n == 2, F.try_element_at(values, F.lit(2))).otherwise(F.try_element_at(values, F.lit(-2))).alias("groups"),
        F.when(n >= 3, F.try_element_at(values, F.lit(-1))).otherwise(empty).alias("rooms"),
    )


def split_title(raw: Column) -> Column:
    """struct(code, subject) of "CODE [Subject]"; all of it is the subject otherwise."""
    pattern = r"^(\S+)\s*\[(.+)\]\s*$"
    raw = F.coalesce(raw, F.lit(""))
    fits = raw.rlike(pattern)
    return F.struct(
        F.when(fits, F.regexp_extract(raw, pattern, 1)).otherwise("").alias("code"),
        trimmed(F.when(fits, F.regexp_extract(raw, pattern, 2)).otherwise(raw)).alias("subject"),
    )


def hrefs_in(content: Column) -> Column:
    """http(s) targets of anchors; a plain http(s) address counts where there is none."""
    quoted = F.regexp_extract_all(content, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    unescaped = F.transform(quoted, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))
    plain = F.when(trimmed(content).rlike(r"^https?://\S+$"), F.array(trimmed(content))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.when(F.size(quoted) > 0, unescaped).otherwise(plain), lambda h: h.rlike("(?i)^https?://"))


def element_kind(label: Column, content: Column, text: Column, kind: Column, links: Column, notes: Column) -> Column:
    """Kind of a detail value by ordered rules; null if it is skipped. label: after filling; text: content without markup."""
    lab = F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(content.isNull() | (content == ""), F.lit(None))
        .when(F.coalesce(links, F.lit(False)) | lab.rlike("lien|link|web|url"), "links")
        .when((text == "") | lab.rlike("^date"), F.lit(None))
        .when((kind == 100) | lab.rlike("^modul"), "modules").when((kind == 101) | lab.rlike("staff|enseignant|teacher|prof|personnel"), "staff")
        .when((kind == 102) | lab.rlike("room|salle|local"), "rooms").when((kind == 103) | lab.rlike("group"), "groups")
        .when(F.coalesce(notes, F.lit(False)) | lab.rlike("^note|remarque"), "notes").when(lab.rlike("^(name|nom)"), "name").otherwise("extra")
    )


def fill_labels(elements: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Adds filled: the last label that isn't null, in element order (an empty label is a label)."""
    return forward_filled(elements.withColumn("_l", trimmed(F.col("label"))), keys, [pos], "_l", "filled").drop("_l")


def collect_exploded(classified: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(keys, one array for each kind) of rows (keys, pos, kind, value), values in order."""
    return (
        classified.where("kind is not null").groupBy(*keys).pivot("kind", list(KINDS))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "value"))), lambda x: x["value"]))
        .select(*keys, *(F.coalesce(F.col(k), F.array().cast("array<string>")).alias(k) for k in KINDS))
    )


def collect_details(elements: Column, plain: Column) -> Column:
    """struct of one array for each kind, inside the row; plain: the elements' contents as texts."""
    def fill(acc: Column, e: Column) -> Column:
        label = F.when(e["label"].isNotNull(), trimmed(e["label"])).otherwise(acc["last"])
        return F.struct(label.alias("last"), F.concat(acc["out"], F.array(F.struct(label.alias("l"), e.alias("e")))).alias("out"))

    start = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast(f"array<struct<l:string,e:{ELEMENT}>>").alias("out"))
    filled = F.aggregate(F.coalesce(elements, F.array().cast(f"array<{ELEMENT}>")), start, fill, lambda a: a["out"])
    def rated(x: Column, i: Column) -> Column:
        e, t = x["e"], F.get(plain, i)
        kind = element_kind(x["l"], e["content"], t, e["entityType"], e["containsHyperlinks"], e["isNotes"])
        return F.struct(kind.alias("k"), x["l"].alias("l"), e["content"].alias("v"), t.alias("t"))

    return bound(F.transform(filled, rated), _by_kind)


def _by_kind(kinds: Column) -> Column:
    of = lambda kind: F.filter(kinds, lambda x: x["k"] == kind)
    texts = lambda kind: F.transform(of(kind), lambda x: x["t"])
    label = lambda x: F.coalesce(present(x["l"]), F.lit("Info"))
    extra = bound(of("extra"), lambda own: F.transform(
        F.array_distinct(F.transform(own, label)),
        lambda l: F.concat(l, F.lit(": "), F.array_join(F.transform(F.filter(own, lambda x: label(x) == l), lambda x: x["t"]), ", ")),
    ))
    return F.struct(F.flatten(F.transform(of("links"), lambda x: hrefs_in(x["v"]))).alias("links"), *(texts(k).alias(k) for k in KINDS[1:-1]), extra.alias("extra"))


def join_details(events: DataFrame, details: DataFrame, scope: list[str] = ["calendar"]) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """Events with their details (null where missing), and a warning for each timed event without."""
    own = details.withColumnRenamed("event_id", "id").withColumn("_has", F.lit(True))
    joined = events.join(own, [*scope, "id"], "left")
    issues = joined.where(F.col("_has").isNull() & ~F.coalesce("allDay", F.lit(False))).select(F.lit("details").alias("source"), F.lit("warning").alias("severity"), F.lit("no details; the event is kept").alias("message"), F.col("id").alias("url"))
    return joined.drop("_has"), issues


def normalize(joined: DataFrame, scope: list[str] = ["calendar"]) -> DataFrame:  # noqa: B006
    """Export model of joined events: details win over the description where they have values."""
    none = F.array().cast("array<string>")
    joined = joined.withColumn("_plain", decode_many(F.transform("elements", lambda e: e["content"])))
    rows = joined.withColumn("_d", parse_description(F.col("description"))).withColumn("_s", F.when(F.col("elements").isNotNull(), collect_details(F.col("elements"), F.col("_plain"))))
    detail = lambda k: F.coalesce(F.col(f"_s.{k}"), none)
    pick = lambda k: F.when(F.size(detail(k)) > 0, distinct_in_order(detail(k))).otherwise(distinct_in_order(F.col(f"_d.{k}")))
    rows = rows.withColumn("rawTitle", F.coalesce(present(F.try_element_at(detail("modules"), F.lit(1))), F.col("_d.rawTitle"))).withColumn("_t", split_title(F.col("rawTitle")))
    all_day = F.coalesce("allDay", F.lit(False))
    cut = lambda c: F.when(all_day, F.substring(c, 1, 10)).otherwise(F.substring(c, 1, 19))
    rows = rows.withColumns({"allDay": all_day, "_from": cut("start"), "_to": F.when(present(F.col("end")).isNotNull(), cut("end"))})
    next_day = F.date_format(F.date_add(F.try_to_date(F.col("_from"), "yyyy-MM-dd"), 1), "yyyy-MM-dd")
    end = F.when(F.col("allDay"), F.when(F.col("_to") > F.col("_from"), F.col("_to")).otherwise(next_day)).otherwise(F.coalesce("_to", "_from"))
    custom = F.filter(F.array("custom1", "custom2", "custom3"), lambda x: x.isNotNull() & x.rlike("(?i)^https?://"))
    return rows.select(
        *scope, F.col("id").alias("uid"), F.col("_from").alias("start"), end.alias("end"), "allDay", "rawTitle",
        F.coalesce(present(F.col("_t.code")), F.try_element_at("modules", F.lit(1)), F.lit("")).alias("code"), F.col("_t.subject").alias("subject"),
        F.when(F.size(detail("name")) > 0, F.array_join(detail("name"), " — ")).otherwise(F.col("_d.name")).alias("name"),
        pick("groups").alias("groups"), pick("rooms").alias("rooms"), distinct_in_order(detail("staff")).alias("staff"),
        F.coalesce("eventCategory", F.lit("")).alias("category"), F.coalesce("department", F.lit("")).alias("department"),
        distinct_in_order(F.coalesce("sites", none)).alias("sites"), F.array_join(detail("notes"), "\n").alias("notes"),
        distinct_in_order(F.concat(detail("links"), custom)).alias("links"), detail("extra").alias("extra"), F.coalesce("backgroundColor", F.lit("")).alias("color"),
    )


def sort_events(events: DataFrame) -> DataFrame:
    return events.orderBy("start", "uid")


def numbered_events(events: DataFrame, into: str, scope: list[str] = ["calendar"]) -> DataFrame:  # noqa: B006
    """The events with their place in their calendar's sort, from 1; a calendar of any size is many ranges."""
    return ranked(events, ["start", "uid"], into, scope)


def title_of(template: str) -> Column:
    code_subject = present(F.concat_ws(" ", present(F.col("code")), present(F.col("subject"))))
    raw, subject, name = (present(F.col(k)) for k in ("rawTitle", "subject", "name"))
    order = {"raw": (raw, subject, name), "code-subject": (code_subject, raw, name)}.get(template, (subject, name, raw))
    return F.coalesce(*order, F.lit(""))


def value_text(key: str) -> Column:
    return F.array_join(key, ", ") if key in ("groups", "rooms", "staff", "sites", "links", "extra") else F.coalesce(F.col(key), F.lit(""))


def detail_lines(prefs: ExportPrefs, skip: tuple[str, ...] = ()) -> Column:
    """Array of "Label: value" of the selected fields that have one."""
    lines = []
    for key, label in prefs.selected():
        if key != "color" and key not in skip:
            text = F.array_join("extra", "\n") if key == "extra" else F.concat(F.lit(f"{label}: "), value_text(key))
            lines.append(F.when(value_text(key) != "", text))
    return F.array_compact(F.array(*lines)) if lines else F.array().cast("array<string>")


def selection_from_url(url: Column) -> Column:
    """struct(type, ids): kind of resource, and the ids fid0, fid1 … up to the first gap."""
    # fixed values: resource kinds of a timetable address
    kinds = {"module": 100, "staff": 101, "room": 102, "group": 103}
    table = F.create_map(*(x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))))
    pairs = F.transform(F.regexp_extract_all(url, F.lit(r"[?&](fid\d+=[^&#]*)"), F.lit(1)), lambda p: F.struct(F.regexp_extract(p, r"fid(\d+)", 1).cast("int").alias("n"), F.regexp_extract(p, "=(.*)$", 1).alias("id")))
    numbers = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["n"])))
    run = F.size(F.filter(F.transform(numbers, lambda n, i: n == i), lambda x: x))
    ids = F.transform(F.filter(F.array_sort(pairs), lambda p: p["n"] < run), lambda p: p["id"])
    return F.struct(F.try_element_at(table, F.lower(F.regexp_extract(url, r"[?&]et=([^&#]*)", 1))).alias("type"), F.filter(ids, lambda x: x != "").alias("ids"))
