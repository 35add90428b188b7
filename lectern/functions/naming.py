"""File names: portable names, names from headers and addresses, folders that fit, unique names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions.text import SPACE, bound, present

# Extension of a media type.
EXTENSIONS = {
    "application/pdf": "pdf", "image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/svg+xml": "svg",
    "application/zip": "zip", "text/plain": "txt", "text/html": "html",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/msword": "doc", "application/vnd.ms-powerpoint": "ppt", "application/vnd.ms-excel": "xls",
}
_EXT = r"\.[A-Za-z0-9]{1,8}$"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(s: Column) -> Column:
    """Composed form; plain ASCII skips Python."""
    other = s.rlike(r"[^\x00-\x7F]")
    return F.when(other, _nfc(F.when(other, s))).otherwise(s)


def capped(n: Column, most: int | Column) -> Column:
    """Cut to ``most`` characters before the extension, which stays."""
    most = F.lit(most) if isinstance(most, int) else most
    ext = F.regexp_extract(n, f"({_EXT})", 1)
    # a name that is nothing but an extension is a stem of no characters
    stem = F.substr(n, F.lit(1), F.length(n) - F.length(ext))
    cut = F.regexp_replace(F.substr(stem, F.lit(1), F.greatest(F.lit(0), most - F.length(ext))), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(F.length(n) > most, F.concat(cut, ext)).otherwise(n)


def sanitize(s: Column, most: int | Column = 80, composed: bool = True) -> Column:
    """Portable file name of at most ``most`` code points. composed=False if the input is in NFC already."""
    n = F.coalesce(s, F.lit(""))
    n = nfc(n) if composed else n
    n = F.regexp_replace(n, r"[\x00-\x1f\x7f]", "")
    n = F.regexp_replace(n, r'[<>:"/\\|?*]', "_")
    n = F.trim(F.regexp_replace(n, f"{SPACE}+", " "))
    n = F.regexp_replace(n, r"[. ]+$", "")
    n = bound(n, lambda x: F.when(x.rlike(r"(?i)^(con|prn|aux|nul|com\d|lpt\d)(\..*)?$"), F.concat(F.lit("_"), x)).otherwise(x))
    return F.coalesce(present(bound(n, lambda x: capped(x, most))), F.lit("untitled"))


def fix_mojibake(s: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; other text stays."""
    odd = s.rlike("[ÃÂ][\\x{80}-¿]") & s.rlike("^[\\x{0}-\\x{ff}]*$")
    raw = F.encode(F.when(odd, s), "ISO-8859-1")
    return F.when(odd & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(s)


def url_decoded(s: Column) -> Column:
    """Percent sequences decoded, plus signs kept; null if a sequence is bad."""
    return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def filename_from_disposition(cd: Column) -> Column:
    star = present(F.trim(F.regexp_extract(cd, r"(?i)filename\*\s*=\s*[^']*'[^']*'([^;]+)", 1)))
    quoted = present(F.trim(F.regexp_extract(cd, r'(?i)filename\s*=\s*"([^"]+)"', 1)))
    bare = present(F.trim(F.regexp_extract(cd, r"(?i)filename\s*=\s*([^;]+)", 1)))
    raw = F.coalesce(quoted, bare)
    return F.coalesce(url_decoded(F.regexp_replace(star, '^"|"$', "")), fix_mojibake(F.coalesce(url_decoded(raw), raw)))


def name_from_url(u: Column) -> Column:
    path = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.coalesce(url_decoded(F.try_element_at(segments, F.lit(-1))), F.lit(""))


def filename_for(cd: Column, url: Column, mime: Column) -> Column:
    n = F.coalesce(present(filename_from_disposition(cd)), present(name_from_url(url)), F.lit("file"))
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    ext = F.try_element_at(table, F.trim(F.element_at(F.split(F.coalesce(mime, F.lit("")), ";"), 1)))
    return sanitize(bound(n, lambda x: F.when(~x.rlike(_EXT) & ext.isNotNull(), F.concat(x, F.lit("."), ext)).otherwise(x)), 120)


def zip_dir(parts: Column) -> Column:
    """files/<parents>/<leaf> in 150 characters: parents shortened alike until they fit in 120, then the leaf."""
    parents = F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))
    leaf = F.try_element_at(parts, F.lit(-1))
    join = lambda p: F.concat_ws("/", F.lit("files"), p)

    def fitting(limits: tuple[int, ...]) -> Column:
        """The parents' path by the first limit that makes it fit, else by the last; each is worked out only if it is needed, and once."""
        shorter = join(F.transform(parents, lambda p: sanitize(p, limits[0], composed=False)))
        if len(limits) == 1:
            return shorter
        return bound(shorter, lambda t: F.when(F.length(t) <= 120, t).otherwise(fitting(limits[1:])))

    def whole(prefix: Column) -> Column:
        room = 149 - F.length(prefix)
        cut = sanitize(leaf, F.greatest(F.lit(12), room), composed=False)
        return F.when(leaf.isNull(), prefix).otherwise(F.concat(prefix, F.lit("/"), F.when(F.length(leaf) > room, cut).otherwise(leaf)))

    return bound(bound(join(parents), lambda t: F.when(F.length(t) <= 120, t).otherwise(fitting((40, 33, 26, 19, 12)))), whole)


def folder_subpath(url: Column) -> Column:
    """Folders between the content id and the file name of a folder activity's file."""
    path = F.coalesce(url_decoded(F.regexp_replace(url, "[?#].*$", "")), url)
    inner = F.regexp_extract(path, r"/mod_folder/content/\d+/(.*)/[^/]+$", 1)
    return F.transform(F.filter(F.split(inner, "/"), lambda p: p != ""), lambda p: sanitize(p, composed=False))


def _numbered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact sequence in one folder: each name takes the first free number."""
    taken: set[str] = set()
    after: dict[str, int] = {}
    out = []
    for name in pdf.sort_values("ord")["name"]:
        stem, ext = re.match(r"^(.*?)(\.[A-Za-z0-9]{1,8})?$", name, re.S).groups()
        got, i = name, after.get(name.lower(), 2)
        while got.lower() in taken:
            got, i = f"{stem} ({i}){ext or ''}", i + 1
        after[name.lower()] = i
        taken.add(got.lower())
        out.append(got)
    return pdf.sort_values("ord").assign(unique_name=out)


def unique_names(df: DataFrame, folder: list[str], name: str = "name", order: str = "ord") -> DataFrame:
    """Adds unique_name: (2), (3) … before the extension for later equal names of a folder, case ignored.

    One window over (folder, name) does it, unless a numbered name equals another name of the folder;
    only names of such a stem are numbered again, in sequence.
    """
    lower = F.lower(name)
    key = [*folder, "_lower"]
    ranked = df.withColumn("_lower", lower).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    ext = F.regexp_extract(F.col(name), f"({_EXT})", 1)
    stem = F.substr(F.col(name), F.lit(1), F.length(name) - F.length(ext))
    made = ranked.withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), ext)))
    # a family: names that differ by numbers in brackets only, so none of its names meets another family's
    made = made.withColumn("_family", F.lower(F.concat(F.regexp_replace(stem, r"(?: \(\d+\))+$", ""), ext)))
    clash = (
        made.groupBy(*folder, "_family", F.lower("unique_name").alias("_u")).agg(F.count("*").alias("_k")).where("_k > 1")
        .select(*folder, "_family").distinct().withColumn("_clash", F.lit(True))
    )
    made = made.join(clash, [*folder, "_family"], "left")
    plain = made.where(F.col("_clash").isNull()).select(*df.columns, "unique_name")
    fields = [f"`{k}` {t}" for k, t in df.dtypes]
    out, rename, back = [*df.columns, "unique_name"], {name: "name", order: "ord"}, {"name": name, "ord": order}

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        return _numbered(pdf.rename(columns=rename)).rename(columns=back)[out]

    fixed = made.where(F.col("_clash")).groupBy(*folder, "_family").applyInPandas(repair, ", ".join([*fields, "unique_name string"]))
    return plain.unionByName(fixed)
