"""Text columns: white space, escapes for CSV, calendars and Markdown, entities, folding."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space as the reference's language has it; neither engine's \s is the same set.
SPACE = r"[\t\n\x0B\f\r\x20\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

_BLANK = r"\x20"
#: Runs that clean() changes: two or more, or one that is no blank.
_UNCLEAN = f"{SPACE}{{2,}}|{SPACE.replace(_BLANK, '')}"


def present(x: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(x, F.lit(""))


def bound(x: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of x where fn names its argument more than once: x is worked out once."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def clean(s: Column) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), _UNCLEAN, " "))


def ics_escape(s: Column) -> Column:
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def csv_cell(s: Column) -> Column:
    s = F.coalesce(s, F.lit(""))
    return F.when(s.rlike(r'[",\r\n;]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_row(cells: list[Column]) -> Column:
    return F.concat_ws(",", *map(csv_cell, cells))


def md_cell(s: Column) -> Column:
    s = F.replace(F.coalesce(s, F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("<br>"))


def course_cell(s: Column) -> Column:
    s = F.replace(clean(s), F.lit("|"), F.lit("\\|"))
    return F.when(s == "", F.lit("—")).otherwise(s)


def md_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def md_link(href: Column) -> Column:
    return F.when(href.rlike(SPACE), F.concat(F.lit("<"), href, F.lit(">"))).otherwise(href)


def file_link(name: Column, path: Column, media: Column, url: Column, md_path: Column) -> Column:
    kept = F.concat(F.lit("["), name, F.lit("]("), md_link(path), F.lit(")"), F.coalesce(F.concat(F.lit(" · 📝 [as Markdown]("), md_link(md_path), F.lit(")")), F.lit("")))
    icon = F.when(media == "audio", F.lit("🔊")).otherwise(F.lit("🎥"))
    return F.when(media.isNotNull(), F.concat(icon, F.lit(" "), name, F.lit(" (not downloaded): "), url)).otherwise(kept)


def ics_local(s: Column) -> Column:
    return F.substring(F.regexp_replace(s, "[-:]", ""), 1, 15)


def ics_date(s: Column) -> Column:
    return F.substring(F.replace(s, F.lit("-"), F.lit("")), 1, 8)


def utc_stamp(ts: Column) -> Column:
    """UTC stamp of a moment; a timestamp without zone is taken as UTC. The session's zone doesn't matter."""
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_seconds(ts.cast("timestamp")).cast("decimal(18,6)"))
    moment = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + seconds
    utc = F.when(F.typeof(ts) == "timestamp_ntz", ts.cast("timestamp_ntz")).otherwise(moment)
    return F.date_format(utc, "yyyyMMdd'T'HHmmss'Z'")


#: A tag begins with a letter, a slash or a mark; a bare < is text. What isn't closed goes on to the end.
TAG = r"<[A-Za-z/!?][^>]*>?"
_TAG = re.compile(TAG)
_WHITE = re.compile(r"\s+")


def _plain(x: str | None) -> str | None:
    return None if x is None else _WHITE.sub(" ", html.unescape(_TAG.sub("", x)).replace("\ufeff", " ")).strip()


@F.pandas_udf(StringType())
def _decoded(s: pd.Series) -> pd.Series:
    return s.map(_plain)


@F.pandas_udf(ArrayType(StringType()))
def _decoded_each(s: pd.Series) -> pd.Series:
    return s.map(lambda values: None if values is None else [_plain(x) for x in values])


def decode_html(s: Column) -> Column:
    """Fragment to text: tags dropped, entities decoded, spaces collapsed; Python only where there is markup."""
    s = F.coalesce(s, F.lit(""))
    return F.when(s.rlike("[&<]"), _decoded(F.when(s.rlike("[&<]"), s))).otherwise(clean(s))


def decode_many(values: Column) -> Column:
    """Fragments of an array to texts, null to the empty string; Python only for rows with entities."""
    whole = F.transform(values, lambda v: F.coalesce(v, F.lit("")))
    entities = F.exists(whole, lambda v: v.contains("&"))
    plain = F.transform(whole, lambda v: clean(F.when(v.contains("<"), F.regexp_replace(v, TAG, "")).otherwise(v)))
    return F.when(entities, _decoded_each(F.when(entities, whole))).otherwise(plain)


def _fold(line: str | None) -> str | None:
    if line is None:
        return None
    out, cur, size, limit = [], [], 0, 75
    for ch in line:
        b = len(ch.encode("utf-8", "surrogatepass"))
        if size + b > limit:
            out.append("".join(cur))
            cur, size, limit = [], 0, 74
        cur.append(ch)
        size += b
    return "\r\n ".join([*out, "".join(cur)])


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(_fold)


def fold_line(s: Column) -> Column:
    """Calendar lines over 75 octets go on in further lines after a space; characters stay whole."""
    long = F.octet_length(s) > 75
    return F.when(long, _folded(F.when(long, s))).otherwise(s)


@F.pandas_udf(ArrayType(StringType()))
def _folded_each(s: pd.Series) -> pd.Series:
    return s.map(lambda lines: None if lines is None else [_fold(x) for x in lines])


def fold_lines(lines: Column) -> Column:
    """fold_line of each line of an array without nulls; Python only where a long array holds more than ASCII."""
    wide = F.exists(lines, lambda x: F.octet_length(x) > 75) & F.exists(lines, lambda x: F.octet_length(x) != F.length(x))
    rest = lambda x: F.regexp_replace(F.substr(x, F.lit(76)), "(?s).{1,74}", "\r\n $0")
    plain = F.transform(lines, lambda x: F.when(F.octet_length(x) <= 75, x).otherwise(F.concat(F.substring(x, 1, 75), rest(x))))
    return F.when(wide, _folded_each(F.when(wide, lines))).otherwise(plain)
