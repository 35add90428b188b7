"""Sheets read row by row: cells without addresses, string numbers that lead nowhere, large parts, damage at the end."""

import io
import time
import tracemalloc
import zipfile

import pytest

from lectern.operators import office
from lectern.sources.office import Package, cells, read_package

BOOK = '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>'
RELS = '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>'


def book(sheet, strings=""):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in {"xl/workbook.xml": BOOK, "xl/_rels/workbook.xml.rels": RELS, "xl/sharedStrings.xml": f"<sst>{strings}</sst>", "xl/worksheets/s1.xml": sheet}.items():
            z.writestr(name, text)
    return buffer.getvalue()


def read(sheet, strings=""):
    return [(r["row"], r["col"], r["text"], r["formula"]) for r in cells(Package(book(sheet, strings))) if r["kind"] == "cell"]


def test_rows_and_cells_without_addresses():
    sheet = '<w xmlns="m"><sheetData><row><c><v>1</v></c><c/><c><v>3</v></c></row><row r="5"><c r="D5"><v>4</v></c><c><v>5</v></c><c r="b1"><v>6</v></c></row><row><c><f>A1</f></c></row><row r="x"><c r="AA8"><v>7</v></c></row></sheetData></w>'
    assert read(sheet) == [(1, 1, "1", None), (1, 3, "3", None), (5, 4, "4", None), (5, 5, "5", None), (5, 6, "6", None), (6, 1, None, "A1"), (7, 27, "7", None)]


@pytest.mark.parametrize(("index", "want"), [("0", "zero"), ("1", "rich text"), ("2", ""), ("-1", ""), ("x", ""), ("1.5", ""), ("", "")])
def test_strings_by_number(index, want):
    assert read(f'<w><sheetData><row><c t="s"><v>{index}</v></c><c t="inlineStr"><v>no</v><is><r><t>in</t></r><r><t>line</t></r></is></c><c t="b"><v>0</v></c></row></sheetData></w>', "<si><t>zero</t></si><si><r><t>rich</t></r><r><t> text</t></r></si>") == [(1, 1, want, None), (1, 2, "inline", None), (1, 3, "FALSE", None)]


def test_a_large_part_takes_little_memory():
    row = '<row r="{0}"><c r="A{0}"><v>{0}</v></c><c r="B{0}" t="inlineStr"><is><t>some text of a cell</t></is></c><c r="C{0}"><f>A{0}+1</f><v>1</v></c></row>'
    data = book("<w><sheetData>" + "".join(row.format(i) for i in range(1, 150_001)) + "</sheetData></w>")
    began, n, slices = time.perf_counter(), 0, 0
    tracemalloc.start()
    for rows in read_package("big.xlsx", "xlsx", data):
        n, slices = n + len(rows), slices + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 450_001 and slices > 50 and peak < 40 << 20 and time.perf_counter() - began < 120


@pytest.mark.parametrize("end", ["</w>", "<row><c></w>", "&nothing;</sheetData></w>"])
def test_damage_after_many_rows_is_one_issue(end):
    data = book("<w><sheetData>" + "<row><c><v>1</v></c></row>" * 20_000 + end)
    found = [r for rows in read_package("bad.xlsx", "xlsx", data) for r in rows]
    assert [r["kind"] for r in found] == ["issue"] and found[0]["path"] == "bad.xlsx"


def test_documents_with_sheets(spark):
    good = book("<w><sheetData><row><c><v>1</v></c><c t='s'><v>9</v></c><c><v>2</v></c></row></sheetData></w>")
    rows = office.package_rows(spark.createDataFrame([("a.xlsx", bytearray(good)), ("b.xlsx", bytearray(b"PK"))], "path string, content binary"))
    (doc,) = office.office_documents(rows).collect()
    assert doc.path == "a.xlsx" and "| 1 | 1 |  | 2 |" in doc.text
