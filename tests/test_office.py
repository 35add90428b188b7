"""Office packages of every kind, made here, to their Markdown."""

import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import office
from lectern.sources.office import read_package

DECK = '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>'
RELS = '<Relationships><Relationship Id="{}" Target="{}"/></Relationships>'
MATH = "http://schemas.openxmlformats.org/officeDocument/2006/math"


def package(parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buffer.getvalue()


def shape(paragraphs, kind=None):
    ph = f'<p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr>' if kind else ""
    return f"<p:sp>{ph}<p:txBody>{paragraphs}</p:txBody></p:sp>"


def para(text, props="", run=""):
    return f"<a:p>{props}<a:r>{run}<a:t>{text}</a:t></a:r></a:p>"


def deck():
    mono = '<a:rPr><a:latin typeface="Consolas"/></a:rPr>'
    auto = lambda lvl: f'<a:pPr lvl="{lvl}"><a:buAutoNum/></a:pPr>'
    shapes = (
        shape(para("Title"), "title") + shape(para("9"), "sldNum") + shape(para("one", auto(0)) + para("sub", auto(1)) + para("two", auto(0)) + para("dot") + para("three", auto(0)), "body") + shape(para("plain box"))
        + shape(para("if x:", "", mono) + para("  y = 1", "", mono)) + shape(f'<a:p><a:r><a:rPr b="1"/><a:t>bold</a:t></a:r><a:r><a:rPr b="1"/><a:t> more</a:t></a:r><a:r><a:rPr><a:hlinkClick r:id="h"/></a:rPr><a:t> link</a:t></a:r></a:p>')
        + f'<p:graphicFrame><a:tbl><a:tr><a:tc><p:txBody>{para("A|B")}</p:txBody></a:tc><a:tc/></a:tr></a:tbl></p:graphicFrame><p:graphicFrame><c:chart r:id="c"/></p:graphicFrame><p:graphicFrame><d:relIds r:dm="d"/></p:graphicFrame><p:graphicFrame><p:oleObj progId="Equation.3"/></p:graphicFrame>'
        + '<p:pic><p:nvPicPr><p:cNvPr descr="a [pic]"/></p:nvPicPr><a:blip r:embed="i"/></p:pic><p:pic><p:nvPicPr><p:nvPr><a:videoFile/></p:nvPr></p:nvPicPr><a:blip r:embed="i"/></p:pic>'
        + f'<p:grpSp>{shape(para("grouped"))}</p:grpSp>'
        + f'<mc:AlternateContent><mc:Choice><p:sp><p:txBody><a:p><a14:m xmlns:m="{MATH}"><m:oMath><m:f><m:num><m:r><m:t>a+b</m:t></m:r></m:num><m:den><m:r><m:t>c</m:t></m:r></m:den></m:f><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath></a14:m></a:p></p:txBody></p:sp></mc:Choice><mc:Fallback><p:sp><p:spPr><a:blip r:embed="w"/></p:spPr></p:sp></mc:Fallback></mc:AlternateContent>'
    )
    rels = "".join(f'<Relationship Id="{i}" Target="{t}" {m}/>' for i, t, m in (("h", "https://x.org/a b", 'TargetMode="External"'), ("c", "../charts/c.xml", ""), ("d", "../d.xml", ""), ("i", "../media/pic.png", ""), ("w", "../media/eq.wmf", ""), ("n", "../notesSlides/n.xml", "")))
    return package({
        "ppt/presentation.xml": DECK, "ppt/_rels/presentation.xml.rels": RELS.format("r1", "slides/s.xml"), "ppt/slides/_rels/s.xml.rels": f"<R>{rels}</R>",
        "ppt/slides/s.xml": f'<p:sld show="0" xmlns:p="p" xmlns:a="a" xmlns:r="r" xmlns:c="c" xmlns:d="d" xmlns:mc="mc" xmlns:a14="a14"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>',
        "ppt/charts/c.xml": '<c xmlns:a="a"><title><a:t>Sales</a:t></title></c>', "ppt/d.xml": '<d xmlns:a="a"><pt><a:t>P1</a:t></pt><pt/></d>', "ppt/media/pic.png": "x", "ppt/media/eq.wmf": "x",
        "ppt/notesSlides/n.xml": f'<p:notes xmlns:p="p" xmlns:a="a">{shape(para("say this"), "body")}{shape(para("5"), "sldNum")}</p:notes>',
    })


SLIDE = """## Slide 1 — Title _(hidden slide)_

1. one
  1. sub
2. two
- dot
1. three
plain box
```
if x:
  y = 1
```
**bold more** [link](<https://x.org/a b>)
| A\\|B |  |
| --- | --- |
📊 Chart: Sales
🔷 Diagram (SmartArt):
  - P1
🧮 Equation object (Equation.3)
![a pic](s.pptx_media/pic.png)
🎥 Embedded video (play it in the original file)
grouped
`(a+b)/cx^2`
![equation](s.pptx_media/eq.wmf) ⚠️ EMF/WMF picture (may not display)

> 🗒️ Notes: say this
"""


def letter():
    p = lambda text, props="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    item = lambda text, num, lvl: p(text, f'<w:numPr><w:ilvl w:val="{lvl}"/><w:numId w:val="{num}"/></w:numPr>')
    body = (
        p("Intro", '<w:pStyle w:val="Own"/>') + '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> and </w:t></w:r><w:hyperlink r:id="h"><w:r><w:rPr><w:i/></w:rPr><w:t>link</w:t></w:r></w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r></w:p>'
        + item("a", 1, 0) + item("a1", 1, 1) + item("b", 1, 0) + item("b1", 1, 1) + item("dot", 2, 0) + "<w:sdt><w:sdtContent>" + p("inside") + "</w:sdtContent></w:sdt>"
        + f'<w:p><m:oMathPara xmlns:m="{MATH}"><m:oMath><m:rad><m:deg/><m:e><m:r><m:t>xy</m:t></m:r></m:e></m:rad></m:oMath></m:oMathPara></w:p>'
        + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>nested</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc><w:tc><w:p><w:r><w:t>c|2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        + '<w:p><w:r><w:drawing><wp:docPr descr="pic" xmlns:wp="wp"/><a:blip xmlns:a="a" r:embed="i"/></w:drawing></w:r></w:p>'
    )
    lvl = lambda n, f: f'<w:lvl w:ilvl="{n}"><w:numFmt w:val="{f}"/></w:lvl>'
    return package({
        "word/document.xml": f'<w:document xmlns:w="w" xmlns:r="r"><w:body>{body}</w:body></w:document>', "word/_rels/document.xml.rels": '<R><Relationship Id="h" Target="https://x.org/" TargetMode="External"/><Relationship Id="i" Target="media/a.png"/></R>', "word/media/a.png": "x",
        "word/styles.xml": '<w:styles xmlns:w="w"><w:style w:styleId="Own"><w:name w:val="mine"/><w:basedOn w:val="T"/></w:style><w:style w:styleId="T"><w:name w:val="Titre 1"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering xmlns:w="w"><w:abstractNum w:abstractNumId="0">{lvl(0, "decimal")}{lvl(1, "lowerLetter")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{lvl(0, "bullet")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num></w:numbering>',
        "word/footnotes.xml": '<w:footnotes xmlns:w="w"><w:footnote w:id="0" w:type="separator"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>said there</w:t></w:r></w:p></w:footnote></w:footnotes>',
    })


LETTER = """## Intro

**bold** and [*link*](https://x.org/)[^2]

1. a
   1. a1
2. b
   1. b1
- dot

inside

`√(xy)`

| c1 | c\\|2 |
| --- | --- |

![pic](l.docx_media/a.png)

[^2]: said there
"""


def odt():
    return package({"content.xml": '<o:c xmlns:o="o" xmlns:t="t" xmlns:d="d" xmlns:k="k"><o:body><o:text><t:h t:outline-level="1">Head</t:h><t:p>a<t:s t:c="2"/>b <t:a k:href="https://x.org/">go</t:a><t:note>gone</t:note></t:p><t:list><t:list-item><t:p>x</t:p><t:list><t:list-item><t:p>y</t:p></t:list-item></t:list></t:list-item></t:list><b:table xmlns:b="b"><b:table-row><b:table-cell b:number-columns-repeated="2"><t:p>v</t:p></b:table-cell><b:table-cell b:formula="of:=A1"><t:p>w</t:p></b:table-cell><b:table-cell b:number-columns-repeated="1000"/></b:table-row></b:table><t:p><d:frame><d:image k:href="Pictures/p.png"/></d:frame></t:p></o:text></o:body></o:c>', "Pictures/p.png": "x"})


ODT = "## Head\n\na b [go](https://x.org/)\n\n- x\n\n  - y\n\n| v | v | w (=A1) |\n| --- | --- | --- |\n\n![](o.odt_media/p.png)\n"


@pytest.fixture(scope="module")
def rows(spark):
    files = [("/d/s.pptx", deck()), ("/d/l.docx", letter()), ("/d/o.odt", odt()), ("/d/bad.docx", b"PK nothing"), ("/d/empty.pptx", package({"x": "y"})), ("/d/none.odt", b"")]
    return office.package_rows(spark.createDataFrame(files, "path string, content binary")).cache()


def test_documents(rows):
    got = {r.path: r for r in office.office_documents(rows).collect()}
    body = lambda name: got[f"/d/{name}"].text.split("or the original._\n\n")[1]
    assert body("s.pptx") == SLIDE and body("l.docx") == LETTER and body("o.odt") == ODT
    assert got["/d/l.docx"].text.startswith("# l.docx\n\n_Markdown version of the document **l.docx** (11 blocks).") and set(got) == {"/d/s.pptx", "/d/l.docx", "/d/o.odt"}
    assert {r.path for r in rows.where("kind = 'issue'").collect()} == {"/d/bad.docx", "/d/empty.pptx", "/d/none.odt"}


def test_session_settings_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    office.package_rows(spark.createDataFrame([], "path string, content binary")).count()
    assert spark.conf.get(name) == before


def test_pictures(rows):
    named, warned = office.office_images(rows)
    assert {(r.path, r.unique_name, bytes(r.data)) for r in named.collect()} == {("/d/s.pptx", "pic.png", b"x"), ("/d/s.pptx", "eq.wmf", b"x"), ("/d/l.docx", "a.png", b"x"), ("/d/o.odt", "p.png", b"x")}
    assert [r.url for r in warned.collect()] == ["/d/s.pptx"]


def test_grid_caps(spark):
    cells = spark.createDataFrame([("p", 1, 301, 31, "v", ""), ("p", 1, 1, 1, "a", None)], "path string, sheet_no int, row int, col int, value string, formula string")
    (r,) = office.sheet_markdown(cells).collect()
    lines = r.md.split("\n")
    assert lines[0].endswith("| AC | AD |") and lines[-1] == "_Truncated: showing 300 of 301 rows and 30 of 31 columns — see the original file._" and len(lines) == 304
    assert office.sheet_markdown(cells.withColumn("value", F.lit(" "))).count() == 0


def test_rows_of_small_packages_leave_together(monkeypatch):
    """A package costs no batch of its own; pictures bound a batch."""
    content = package({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>a</w:t></w:r></w:p></w:body></w:document>', "word/media/i.png": "x" * 100})
    files = pa.RecordBatch.from_pydict({"path": [f"{i}.docx" for i in range(40)], "content": [content] * 40})
    (out,) = office.package_batches(iter([files.slice(0, 15), files.slice(15)]))
    assert out.column("path").to_pylist() == [f"{i}.docx" for i in range(40) for _ in range(2)]
    monkeypatch.setattr(office, "PICTURES", 950)
    assert [b.num_rows for b in office.package_batches(iter([files]))] == [20] * 4
    assert list(office.package_batches(iter([files.slice(0, 0)]))) == []


def test_made_packages_are_dealt_over_tasks(spark):
    from lectern.jobs import office_jobs

    assert office_jobs.part(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_small_parts_are_inflated_once(monkeypatch):
    """The look through a package and its reading share one inflation of each small XML part."""
    import io
    import zipfile

    from lectern.sources import office as source

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>a</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/media/i.png", "x")
    opened = []
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, f=zipfile.ZipFile.open, **k: opened.append(getattr(name, "filename", name)) or f(self, name, *a, **k))
    rows = [r for part in source.read_package("f.docx", "docx", buffer.getvalue()) for r in part]
    assert [(r["kind"], r["path"]) for r in rows] == [("block", "f.docx"), ("image", "f.docx")]
    assert sorted(opened) == ["word/document.xml", "word/media/i.png"]


def test_pictures_read_packages_once(spark):
    """Names and bytes of pictures come from one reading of the packages."""
    rows = spark.createDataFrame([("a.docx", "image", "word/media/i.png", "i.png", b"x")], "path string, kind string, text string, name string, data binary")
    reads = rows.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    named, _ = office.office_images(rows.mapInPandas(count, rows.schema))
    assert [(r.path, r.unique_name, bytes(r.data)) for r in named.collect()] == [("a.docx", "i.png", b"x")]
    assert reads.value == 1


def test_open_document_tables_are_whole():
    row = lambda cells, times=1: f'<t:table-row t:number-rows-repeated="{times}">{cells}</t:table-row>'
    cell = lambda x, times=1: f'<t:table-cell t:number-columns-repeated="{times}"><x:p>{x}</x:p></t:table-cell>'
    made = lambda kind, rows: package({"content.xml": f'<o:c xmlns:o="o" xmlns:t="t" xmlns:x="x"><o:body><o:{kind}><t:table t:name="S">{rows}</t:table></o:{kind}></o:body></o:c>'})
    read = lambda name, data: [r for rows in read_package(name, name[-3:], data) for r in rows]
    body = row(cell("a", 40) + cell("", 3) + cell("z") + cell("", 9000), 60) + row(cell("", 16384), 1000) + "".join(row(cell(f"r{i}")) for i in range(310))
    got = [(r["row"], r["col"], r["text"]) for r in read("x.ods", made("spreadsheet", body)) if r["kind"] == "cell"]
    assert got == [(i, k, "a" if k <= 40 else "z") for i in range(1, 61) for k in [*range(1, 41), 44]] + [(61 + i, 1, f"r{i}") for i in range(310)]
    [text] = [r["text"] for r in read("x.odt", made("text", body))]
    wide = "| " + " | ".join(["a"] * 40 + [""] * 3 + ["z"]) + " |"
    assert text.split("\n") == [wide, "|" + " --- |" * 44, *[wide] * 59, *(f"| r{i} |" + "  |" * 43 for i in range(310))]
    # what can't be a row's number or a text is an issue of the file, not a part of it
    assert [(r["kind"], r["text"]) for r in read("x.ods", made("spreadsheet", row(cell("a", 1 << 40))))] == [("issue", "ValueError: more rows or columns than can be numbered")]
    assert [(r["kind"], r["text"]) for r in read("x.odt", made("text", row(cell("a", 20000), 20000)))] == [("issue", "ValueError: a table is too large")]
