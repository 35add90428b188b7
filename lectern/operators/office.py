"""Office jobs: classify and read packages, then resolve headings, list numbers, formulas and grids relationally."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions.naming import unique_names
from lectern.functions.text import clean, present
from lectern.operators.relational import forward_filled_by_ranges, joined_text, ranked
from lectern.operators.stored import gathered, stored
from lectern.sources.office import FIELDS, SLICE, read_package

MAX_BYTES = 80 * 1024 * 1024
GRID_ROWS, GRID_COLUMNS = 300, 30
#: Bytes of pictures after which a task's rows leave.
PICTURES = 16 << 20
#: fixed values: kinds of Office files, and the old binary ones that aren't read
KINDS = {"pptx": "slides", "odp": "slides", "docx": "docs", "odt": "docs", "xlsx": "sheets", "ods": "sheets"}
LEGACY = ("ppt", "doc", "xls")
MAX_HOPS = 6


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def office_kind(name: Column) -> Column:
    """slides, docs, sheets; legacy for old binary files; else null."""
    table = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    ext = extension(name)
    return F.when(ext.isin(*LEGACY), "legacy").otherwise(F.try_element_at(table, ext))


def read_office(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to read, and issues for old or too large ones; files: (path, length, …) as binaryFile gives them.

    Length and name are tested first, so the bytes of other files are never read.
    """
    f = files.withColumn("office", office_kind(F.col("path"))).where("office is not null")
    bad = (F.col("office") == "legacy") | (F.col("length") > MAX_BYTES)
    reason = F.when(F.col("office") == "legacy", "old binary format").otherwise("too large")
    issues = f.where(bad).select(F.lit("office").alias("source"), F.lit("warning").alias("severity"), reason.alias("message"), F.col("path").alias("url"))
    return f.where(~bad), issues


def package_rows(files: DataFrame) -> DataFrame:
    """Tagged rows of each package; files: (path, content) as the binaryFile reader gives them.

    The reader deals files to partitions by their length, so a batch, which is at most a partition, holds no more
    bytes than a partition and one file. Packages are read one after the other; rows of small ones leave together,
    those of sheets while their part is read. Packages made or kept as rows of a table should be dealt out by their
    number first (``stored.dealt``): one takes milliseconds, and a table's bytes don't tell how many there are.
    """
    return files.select("path", "content").mapInArrow(package_batches, FIELDS)


def package_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of packages (path, content), many packages together, up to SLICE rows or PICTURES bytes of pictures."""
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(name, types[kind]) for name, kind in map(str.split, FIELDS.split(", "))])
    held: list[dict] = []
    size = 0
    for b in batches:
        for path, data in zip(b.column("path"), b.column("content"), strict=True):
            name = path.as_py()
            for rows in read_package(name, name.rsplit(".", 1)[-1].lower(), data.as_py()):
                held += rows
                size += sum(len(r["data"] or b"") for r in rows)
                if len(held) >= SLICE or size > PICTURES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def office_slides(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'slide'").select("path", F.col("no").alias("slide_no"), F.col("name").alias("title"), "hidden", F.col("formula").alias("notes"), F.split("text", "\n").alias("lines"))


def office_blocks(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'block'").select("path", "ord", F.coalesce("row", F.lit(0)).alias("sub"), F.col("name").alias("kind"), F.col("style").alias("style_id"), "num_id", "ilvl", F.col("col").alias("outline"), "text")


def office_cells(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'cell'").select("path", F.col("no").alias("sheet_no"), F.col("name").alias("sheet"), "hidden", "row", "col", F.col("text").alias("value"), "formula", "si")


def heading_levels(styles: DataFrame) -> DataFrame:
    """(path, style_id, level): by name in French, English or German, or outline level, or the style it is based on.

    styles: (path, style_id, name, based_on, outline). At most MAX_HOPS joins; the nearest answer wins.
    """
    by_name = F.regexp_extract("name", r"(?iu)^(?:heading|titre|überschrift)\s*([0-9])$", 1).try_cast("int")
    by_id = F.regexp_extract("style_id", r"(?iu)^(?:heading|titre)([0-9])$", 1).try_cast("int")
    own = F.coalesce(by_name, by_id, F.when(F.lower("name").isin("title", "titre", "titel"), 1), F.when(F.col("outline").between(0, 5), F.col("outline") + 1))
    base = styles.select("path", "style_id", "based_on", own.alias("own"))
    seen = base.select("path", "style_id", F.col("based_on").alias("next"), F.col("own").alias("level"))
    up = base.select("path", F.col("style_id").alias("next"), F.col("based_on").alias("_b"), F.col("own").alias("_o"))
    for _ in range(MAX_HOPS):
        seen = seen.join(up, ["path", "next"], "left").select("path", "style_id", F.when(F.col("level").isNull(), F.col("_b")).alias("next"), F.coalesce("level", "_o").alias("level"))
    return seen.select("path", "style_id", "level")


def number_lists(blocks: DataFrame, levels: int = 8) -> DataFrame:
    """Adds number to ordered items: counted in (path, num_id, ilvl), anew after an ordered item of a shallower level.

    blocks: (path, num_id, ilvl, ordered, ord). One running maximum for each level gives the last reset.
    """
    blocks = gathered(blocks, "path")  # a num_id that is a literal would drop out of the windows' keys, but not of these
    w = Window.partitionBy("path", "num_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    resets = [F.lit(-1)] + [F.coalesce(F.max(F.when(F.col("ordered") & (F.col("ilvl") < k), F.col("ord"))).over(w), F.lit(-1)) for k in range(1, levels + 1)]
    marked = blocks.withColumn("_reset", F.element_at(F.array(*resets), F.least(F.col("ilvl"), F.lit(levels)) + 1))
    run = Window.partitionBy("path", "num_id", "ilvl", "_reset", "ordered").orderBy("ord")
    return marked.withColumn("number", F.when(F.col("ordered"), F.row_number().over(run))).drop("_reset")


def number_lists_by_ranges(blocks: DataFrame, levels: int = 8) -> DataFrame:
    """``number_lists`` for files of any size: the last resets and the numbers are carried from range to range."""
    resets = {f"_reset{k}": F.when(F.col("ordered") & (F.col("ilvl") < k), F.col("ord")) for k in range(1, levels + 1)}
    # an item's own level never is one of its resets, so the row itself can be looked at too
    marked = forward_filled_by_ranges(blocks, ["path", "num_id"], ["ord"], resets)
    reset = F.element_at(F.array(F.lit(-1).cast("bigint"), *(F.coalesce(F.col(k).cast("bigint"), F.lit(-1)) for k in resets)), F.least(F.col("ilvl"), F.lit(levels)) + 1)
    marked = marked.withColumn("_reset", F.when(F.col("ordered"), reset)).drop(*resets)
    numbered = ranked(marked.where("ordered"), ["ord"], "number", ["path", "num_id", "ilvl", "_reset"])
    return numbered.unionByName(marked.where("not coalesce(ordered, false)").withColumn("number", F.lit(None).cast("bigint"))).drop("_reset")


_REF = re.compile(r"\"[^\"]*\"|'[^']*'|(?<![A-Za-z0-9_.$])(\$?)([A-Z]{1,3})(\$?)([0-9]+)(?![A-Za-z0-9_(.])")


def _letters(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def shifted(formula: str, rows: int, cols: int) -> str:
    """A formula's relative references moved; quoted parts, fixed parts and function names stay."""
    def move(m: re.Match) -> str:
        if m[2] is None:
            return m[0]
        col = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(m[2])))
        return f"{m[1]}{m[2] if m[1] else _letters(col + cols)}{m[3]}{m[4] if m[3] else int(m[4]) + rows}"

    return _REF.sub(move, formula)


@F.pandas_udf(StringType())
def shift_formula(formula: pd.Series, rows: pd.Series, cols: pd.Series) -> pd.Series:
    return pd.Series([None if f is None or pd.isna(r) else shifted(f, int(r), int(k)) for f, r, k in zip(formula, rows, cols, strict=True)], dtype=object)


def fill_shared_formulas(cells: DataFrame) -> DataFrame:
    """Followers of a shared formula take the last one defined before them, its references moved."""
    w = Window.partitionBy("path", "sheet_no", "si").orderBy("row", "col").rowsBetween(Window.unboundedPreceding, 0)
    master = F.last(F.when(present(F.col("formula")).isNotNull(), F.struct("formula", "row", "col")), ignorenulls=True).over(w)
    m = cells.withColumn("_m", F.when(F.col("si").isNotNull(), master))
    follows = F.col("si").isNotNull() & present(F.col("formula")).isNull() & F.col("_m").isNotNull()
    moved = shift_formula(F.when(follows, F.col("_m.formula")), F.col("row") - F.col("_m.row"), F.col("col") - F.col("_m.col"))
    return m.withColumn("formula", F.when(follows, moved).otherwise(F.col("formula"))).drop("_m")


def column_letters(n: Column) -> Column:
    """Letters of a column number up to 702."""
    return F.concat(F.when(n > 26, F.char(64 + F.floor((n - 1) / 26))).otherwise(F.lit("")), F.char(65 + (n - 1) % 26))


def sheet_markdown(cells: DataFrame) -> DataFrame:
    """(path, sheet_no, n_rows, n_cols, md): a grid of all rows and columns up to the largest, capped with a note.

    Cells without text count for nothing. Extents come from all others; only cells within the cap are gathered, so a sheet's row is bounded.
    """
    keys = ["path", "sheet_no"]
    told = F.when(present(F.col("formula")).isNotNull(), F.concat(F.lit(" (="), clean(F.regexp_replace("formula", "^=", "")), F.lit(")"))).otherwise("")
    cells = cells.withColumn("_t", F.replace(F.concat(clean(F.col("value")), told), F.lit("|"), F.lit("\\|"))).where("_t <> ''")
    size = cells.groupBy(*keys).agg(F.max("row").alias("n_rows"), F.max("col").alias("n_cols"))
    near = cells.where((F.col("row") <= GRID_ROWS) & (F.col("col") <= GRID_COLUMNS))
    lines = near.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.col("_t").alias("t")))).alias("m"))
    sheets = lines.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("row", "m"))).alias("rows")).join(size, keys)
    width = F.sequence(F.lit(1), F.least("n_cols", F.lit(GRID_COLUMNS)))
    cell = lambda r: F.transform(width, lambda k: F.coalesce(F.try_element_at(F.try_element_at(F.col("rows"), r), k), F.lit("")))
    body = F.transform(F.sequence(F.lit(1), F.least("n_rows", F.lit(GRID_ROWS))), lambda r: F.concat(F.lit("| "), r.cast("string"), F.lit(" | "), F.array_join(cell(r), " | "), F.lit(" |")))
    head = F.concat(F.lit("|  | "), F.array_join(F.transform(width, column_letters), " | "), F.lit(" |\n"), F.repeat(F.lit("| --- "), F.size(width) + 1), F.lit("|\n"))
    cut = (F.col("n_rows") > GRID_ROWS) | (F.col("n_cols") > GRID_COLUMNS)
    note = F.when(cut, F.concat(F.lit("\n\n_Truncated: showing "), F.least("n_rows", F.lit(GRID_ROWS)), F.lit(" of "), "n_rows", F.lit(" rows and "), F.least("n_cols", F.lit(GRID_COLUMNS)), F.lit(" of "), "n_cols", F.lit(" columns — see the original file._"))).otherwise("")
    return sheets.select(*keys, "n_rows", "n_cols", F.concat(head, F.array_join(body, "\n"), note).alias("md"))


def office_images(rows: DataFrame, folder: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One row for each picture part with a unique name in its file's folder, and a warning for vector pictures.

    Names are numbered without the pictures' bytes, which are joined last; pictures are kept for that, so packages are read once.
    """
    images = stored(rows.where("kind = 'image'").select("path", F.col("text").alias("part"), "name", "data"), "pictures")
    named = unique_names(images.drop("data"), ["path"], "name", "part").join(images.select("path", "part", "data"), ["path", "part"])
    vector = images.where(F.lower("name").rlike(r"\.(emf|wmf)$")).select(F.lit("office").alias("source"), F.lit("warning").alias("severity"), F.concat(F.lit("vector picture may not show: "), "name").alias("message"), F.col("path").alias("url"))
    return named, vector


def slide_lines(rows: DataFrame) -> DataFrame:
    """(path, ord, text, is_list) of presentations: a heading, the lines and the notes of each slide."""
    head = F.concat(F.lit("## Slide "), F.col("no").cast("string"), F.coalesce(F.concat(F.lit(" — "), present(F.col("name"))), F.lit("")), F.when(F.col("hidden"), " _(hidden slide)_").otherwise(""))
    notes = F.concat(F.lit("> 🗒️ Notes: "), present(F.col("formula")))
    return rows.where("kind = 'slide'").select("path", F.col("no").cast("bigint").alias("ord"), F.concat_ws("\n\n", head, present(F.col("text")), notes).alias("text"), F.lit(False).alias("is_list"))


def block_lines(rows: DataFrame) -> DataFrame:
    """(path, ord, text, is_list) of text documents: headings by style, numbered and plain items, tables, footnotes at the end."""
    level = heading_levels(rows.where("kind = 'style'").select("path", F.col("style").alias("style_id"), "name", F.col("text").alias("based_on"), F.col("ilvl").alias("outline")))
    formats = rows.where("kind = 'num'").select("path", "num_id", F.col("style").alias("a")).join(rows.where("kind = 'level'").select("path", F.col("style").alias("a"), "ilvl", F.col("text").alias("format")), ["path", "a"]).drop("a")
    bare = F.regexp_extract("style_id", r"(?iu)^(?:heading|titre|überschrift)\s*([0-9])$", 1).try_cast("int")
    b = office_blocks(rows).join(level, ["path", "style_id"], "left").join(formats, ["path", "num_id", "ilvl"], "left")
    b = b.withColumn("level", F.coalesce("level", bare, F.col("outline") + 1)).withColumn("heading", F.coalesce(F.col("level").between(1, 8), F.lit(False)))
    b = b.withColumn("item", ~F.col("heading") & F.coalesce(F.col("num_id") != "0", F.lit(False)))
    ordered = F.col("item") & F.coalesce(~F.col("format").isin("bullet", "none"), F.lit(False))
    items = number_lists(b.where("item").withColumn("ordered", ordered))
    other = b.where("not item").withColumns({"ordered": F.lit(False), "number": F.lit(None).cast("int")})
    whole = items.unionByName(other)
    marker = F.when(F.col("ordered"), F.concat(F.col("number").cast("string"), F.lit("."))).otherwise("-")
    text = (
        F.when(F.col("heading"), F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.col("level") + 1)), F.lit(" "), F.replace("text", F.lit("**"), F.lit(""))))
        .when(F.col("item"), F.concat(F.repeat(F.lit("   "), F.col("ilvl")), marker, F.lit(" "), "text")).otherwise(F.col("text"))
    )
    notes = rows.where("kind = 'footnote'").groupBy("path").agg(joined_text(F.col("ord"), F.concat(F.lit("[^"), "style", F.lit("]: "), "text")).alias("text"))
    last = notes.select("path", F.lit((1 << 31) - 1).cast("bigint").alias("ord"), "text", F.lit(False).alias("is_list"))
    return whole.select("path", F.col("ord").cast("bigint").alias("ord"), text.alias("text"), F.col("item").alias("is_list")).unionByName(last)


def sheet_lines(rows: DataFrame) -> DataFrame:
    """(path, ord, text, is_list) of workbooks: a heading and the grid of each sheet."""
    grids = sheet_markdown(fill_shared_formulas(office_cells(rows))).select("path", "sheet_no", "md")
    sheets = rows.where("kind = 'sheet'").select("path", F.col("no").alias("sheet_no"), "name", "hidden").join(grids, ["path", "sheet_no"], "left")
    head = F.concat(F.lit("## Sheet: "), F.coalesce("name", F.col("sheet_no").cast("string")), F.when(F.col("hidden"), " _(hidden)_").otherwise(""), F.lit("\n\n"))
    return sheets.select("path", F.col("sheet_no").cast("bigint").alias("ord"), F.concat(head, F.coalesce("md", F.lit("_(empty)_"))).alias("text"), F.lit(False).alias("is_list"))


#: fixed values: what a converted file is called, and what is counted in it
LABELS = {"slides": ("presentation", "slides"), "docs": ("document", "blocks"), "sheets": ("spreadsheet", "sheets")}


def office_documents(rows: DataFrame) -> DataFrame:
    """(path, kind, n, text): every file converted, from its tagged rows. Damaged files have an issue row and no text."""
    parts = [slide_lines(rows), block_lines(rows), sheet_lines(rows)]
    lines = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counted = rows.where("kind in ('slide', 'block', 'sheet')").groupBy("path").agg(F.count("*").alias("n"))
    bad = rows.where("kind = 'issue'").select("path").distinct()
    files = rows.select("path").distinct().join(bad, "path", "left_anti").join(counted, "path", "left").withColumn("kind", office_kind(F.col("path")))
    table = F.create_map(*(x for k, (label, unit) in LABELS.items() for x in (F.lit(k), F.struct(F.lit(label).alias("label"), F.lit(unit).alias("unit")))))
    name = F.element_at(F.split("path", "/"), -1)
    about = F.try_element_at(table, F.col("kind"))
    head = F.concat(
        F.lit("# "), name, F.lit("\n\n_Markdown version of the "), about["label"], F.lit(" **"), name, F.lit("** ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" "), about["unit"],
        F.lit("). The original file is kept next to this one; layout is not reproduced — for pictures, equations or diagrams see `"), name, F.lit("_media/` or the original._"),
    )
    made = office_markdown(lines, files.select("path", head.alias("head")))
    return made.join(files.select("path", "kind", F.coalesce("n", F.lit(0)).alias("n")), "path").select("path", "kind", "n", F.concat("text", F.lit("\n")).alias("text"))


def office_markdown(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """(path, text); lines: (path, ord, text, is_list), heads: (path, head). List items follow each other by one line end."""
    before = F.lag("is_list").over(Window.partitionBy("path").orderBy("ord"))
    spaced = lines.withColumn("text", F.concat(F.when(before.isNull(), "").when(before & F.col("is_list"), "\n").otherwise("\n\n"), "text"))
    body = spaced.groupBy("path").agg(joined_text(F.col("ord"), F.col("text"), "").alias("body"))
    return heads.join(body, "path", "left").select("path", F.concat_ws("\n\n", "head", "body").alias("text"))
