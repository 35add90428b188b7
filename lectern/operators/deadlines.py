"""Labels, deadlines and completion of activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import DONE, LABELS, TODO
from lectern.functions.dates import parse_date
from lectern.functions.text import bound, clean, course_cell, md_row, present
from lectern.operators.relational import first_wins, worked_out

DEADLINE_TYPES = ("quiz", "assign", "lesson")


def meta_key(label: Column) -> Column:
    def known(x: Column) -> Column:
        out = None
        for key, pattern in LABELS.items():
            out = F.when(x.rlike(pattern), key) if out is None else out.when(x.rlike(pattern), key)
        return out

    return bound(label, known)


def split_meta_line(line: Column) -> Column:
    """struct(label, value) of a line "label : value", fields null if it isn't one."""
    pattern = r"^([^:]{2,60}?)\s*:\s*(.+)$"
    get = lambda x, i: present(F.regexp_extract(x, pattern, i))
    return bound(clean(line), lambda x: F.struct(get(x, 1).alias("label"), get(x, 2).alias("value")))


def collect_meta(lines: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """(keys, meta): the first value of each meta key; lines: (keys, ord, label, value)."""
    found = worked_out(lines.select(*keys, order, "label", F.col("value").alias("_said")), {"key": meta_key(clean(F.col("label"))), "value": present(clean(F.col("_said")))})
    rows = found.select(*keys, order, "key", "value").where("key is not null and value is not null")
    one = first_wins(rows, [*keys, "key"], [order])
    return one.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("meta"))


def lesson_fix(kind: Column, meta: Column) -> Column:
    """A lesson's cut-off closes it, where nothing else does."""
    missing = present(F.try_element_at(meta, F.lit("closes"))).isNull() & present(F.try_element_at(meta, F.lit("cutoff"))).isNotNull()
    kept = F.map_filter(meta, lambda k, _: k != "closes")
    return F.when((kind == "lesson") & missing, F.map_concat(kept, F.create_map(F.lit("closes"), meta["cutoff"]))).otherwise(meta)


def deadline_status(opens: Column, closes: Column, due: Column, cutoff: Column, now: Column) -> Column:
    raw = F.coalesce(present(opens), present(closes), present(due), present(cutoff))
    return _status(raw, parse_date(opens), parse_date(F.coalesce(present(closes), due)), parse_date(cutoff), now)


def _status(raw: Column, o: Column, c: Column, cut: Column, now: Column) -> Column:
    """Status by the texts (any of them) and the parsed opening, closing and cut-off."""
    end = F.coalesce(c, cut)
    return (
        F.when(raw.isNull(), "no dates").when((c < now) & (cut > now), "overdue (cut-off later)").when(end < now, "closed")
        .when(o > now, "upcoming").when(end.isNotNull() | o.isNotNull(), "open").otherwise("?")
    )


def completion_status(text: Column) -> Column:
    return F.when(text.rlike(TODO), "To do").when(text.rlike(DONE), "Done").otherwise("")


def deadlines(activities: DataFrame, now: Column) -> DataFrame:
    """Rows of the deadlines table, ranked by course; activities: (course_id, ord, type, title, section_titles, completion, opens … gradeToPass)."""
    ends = F.coalesce(present(F.col("closes")), present(F.col("due")))
    cut = F.when(F.col("cutoff").eqNullSafe(ends), F.lit("")).otherwise(F.col("cutoff"))
    rows = activities.where(F.col("type").isin(*DEADLINE_TYPES) | present(F.col("due")).isNotNull() | present(F.col("closes")).isNotNull() | present(F.col("cutoff")).isNotNull())
    # each date is parsed once
    rows = rows.withColumns({"_o": parse_date(F.col("opens")), "_c": parse_date(F.coalesce(ends, F.lit(""))), "_cut": parse_date(F.col("cutoff"))})
    raw = F.coalesce(*(present(F.col(k)) for k in ("opens", "closes", "due", "cutoff")))
    rows = rows.withColumns({"at": F.when(ends.isNotNull(), F.col("_c")).otherwise(F.col("_cut")), "status": _status(raw, F.col("_o"), F.col("_c"), F.col("_cut"), now)}).drop("_o", "_c", "_cut")
    cells = [course_cell(F.col("title")), F.col("type"), course_cell(F.array_join("section_titles", " › ")), course_cell(F.col("opens")), course_cell(ends), course_cell(cut), course_cell(F.col("attempts")), course_cell(F.col("gradeToPass")), course_cell(F.col("completion")), F.col("status")]
    return rows.withColumn("line", md_row(cells)).withColumn("rank", F.row_number().over(Window.partitionBy("course_id").orderBy(F.col("at").asc_nulls_last(), "ord")))
