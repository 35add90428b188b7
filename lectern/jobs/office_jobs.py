"""Queries of the Office and streaming jobs."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from lectern.jobs.registry import query
from lectern.jobs.sources import read
from lectern.operators import office
from lectern.operators.stored import dealt, gathered, shared_folder, stored
from lectern.streaming.events import dedupe_stream, write_first_wins


@query("select doc_id, case doc_id % 4 when 0 then 'slides' when 1 then 'sheets' when 2 then 'legacy' end as kind, doc_id % 4 < 2 and doc_id % 5 <> 0 as readable from documents")
def r03_read_office(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ("PPTX", "ods", "doc", "txt"))), (F.col("doc_id") % 4 + 1).cast("int"))
    f = read(spark, d, "documents").select("doc_id", F.concat(F.lit("f."), ext).alias("path"), F.when(F.col("doc_id") % 5 == 0, 100 << 20).otherwise(10).alias("length"))
    good, _ = office.read_office(f)
    return f.join(good.select("doc_id", F.lit(True).alias("r")), "doc_id", "left").select("doc_id", office.office_kind(F.col("path")).alias("kind"), F.coalesce("r", F.lit(False)).alias("readable"))


def packages(df, kind: str):
    """Small packages made from rows (k, a, b), one for each row."""
    def xlsx(k, a, b):
        cell = lambda r, t, x: f'<c r="{r}" t="{t}">{x}</c>'
        sheet = f'<worksheet><sheetData><row r="1">{cell("A1", "s", "<v>0</v>")}{cell("B1", "inlineStr", f"<is><t>{b}</t></is>")}</row><row r="3">{cell("A3", "b", "<v>1</v>")}<c r="AB3"><f t="shared" si="0">A1+$B$1</f><v>{k}</v></c></row></sheetData></worksheet>'
        return {"xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>', "xl/sharedStrings.xml": f"<sst><si><t>{a}</t></si></sst>", "xl/worksheets/s1.xml": sheet}

    def docx(k, a, b):
        body = f'<w:p><w:pPr><w:pStyle w:val="T1"/></w:pPr><w:r><w:t>{a}</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="{k}"/></w:numPr></w:pPr><w:r><w:t>{b}</w:t></w:r></w:p>'
        return {"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>', "word/styles.xml": '<w:styles xmlns:w="w"><w:style w:styleId="T1"><w:name w:val="Titre 2"/></w:style></w:styles>', "word/media/i.png": "x"}

    def pptx(k, a, b):
        shape = lambda t, x: f'<p:sp><p:nvPr><p:ph type="{t}"/></p:nvPr><p:txBody><a:p><a:r><a:t>{x}</a:t></a:r></a:p></p:txBody></p:sp>'
        slide = lambda x, y: f'<p:sld xmlns:p="p" xmlns:a="a">{shape("title", x)}{shape("body", y)}</p:sld>'
        return {"ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="r1" Target="slides/s1.xml"/><Relationship Id="r2" Target="slides/s2.xml"/></R>', "ppt/slides/s1.xml": slide("second", b), "ppt/slides/s2.xml": slide(a, b)}

    def ods(k, a, b):
        return {"content.xml": f'<o:content xmlns:o="o" xmlns:t="t" xmlns:x="x"><o:body><o:spreadsheet><t:table t:name="S"><t:table-row><t:table-cell t:number-columns-repeated="2"><x:p>{a}</x:p></t:table-cell><t:table-cell><x:p>{b}</x:p></t:table-cell></t:table-row></t:table></o:spreadsheet></o:body></o:content>'}

    make = {"xlsx": xlsx, "docx": docx, "pptx": pptx, "ods": ods}[kind]

    def run(batches):
        for pdf in batches:
            out = []
            for k, a, b in zip(pdf["k"], pdf["a"], pdf["b"], strict=True):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    for name, text in make(k, a, b).items():
                        z.writestr(name, text)
                out.append((f"{k}.{kind}", buffer.getvalue() if k % 50 else b"damaged"))
            yield pd.DataFrame(out, columns=["path", "content"])

    return office.package_rows(df.mapInPandas(run, "path string, content binary"))


def part(spark, d):
    return dealt(read(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"), F.col("p_brand").alias("b")))


@query("select p_partkey || '.pptx' as path, unnest([1, 2]) as slide_no, unnest([p_name, 'second']) as title, '- ' || p_brand as lines from part where p_partkey % 50 <> 0")
def o01_slides(spark, d):
    return office.office_slides(packages(part(spark, d), "pptx")).select("path", "slide_no", "title", F.array_join("lines", "\n").alias("lines"))


@query("select p_partkey || '.docx' as path, unnest([p_name, p_brand]) as text, unnest(['T1', null]) as style_id, unnest([null, cast(p_partkey as varchar)]) as num_id from part where p_partkey % 50 <> 0")
def o02_blocks(spark, d):
    return office.office_blocks(packages(part(spark, d), "docx")).select("path", "text", "style_id", "num_id")


@query("select 'n' || n_nationkey as style_id, case when n_regionkey = 0 then 2 when n_regionkey = 1 then 4 end as level from nation union all select 'r' || r_regionkey, case r_regionkey when 0 then 2 when 1 then 4 end from region")
def o03_heading_levels(spark, d):
    r = read(spark, d, "region").select(F.lit("p").alias("path"), F.concat(F.lit("r"), "r_regionkey").alias("style_id"), F.when(F.col("r_regionkey") == 0, "Titre 2").otherwise("x").alias("name"), F.lit(None).cast("string").alias("based_on"), F.when(F.col("r_regionkey") == 1, 3).alias("outline"))
    n = read(spark, d, "nation").select(F.lit("p").alias("path"), F.concat(F.lit("n"), "n_nationkey").alias("style_id"), F.lit("n").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("based_on"), F.lit(None).cast("int").alias("outline"))
    return office.heading_levels(r.unionByName(n)).select("style_id", "level")


ITEMS = "select l_orderkey as path, 1 as num_id, (l_linenumber - 1) % 3 as ilvl, l_linenumber <> 7 as ordered, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_extendedprice) as ord from lineitem"


@query(f"""with x as ({ITEMS}), r as (select a.*, (select coalesce(max(b.ord), 0) from x b where b.path = a.path and b.ord < a.ord and b.ordered and b.ilvl < a.ilvl) as reset from x a)
 select path, ord, case when ordered then (select count(*) from x b where b.path = r.path and b.ilvl = r.ilvl and b.ordered and b.ord > r.reset and b.ord <= r.ord) end as number from r""")
def o04_number_lists(spark, d):
    items = gathered(read(spark, d, "lineitem"), "l_orderkey").selectExpr("l_orderkey as path", "1 as num_id", "(l_linenumber - 1) % 3 as ilvl", "l_linenumber <> 7 as ordered", "cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_extendedprice) as bigint) as ord")
    return office.number_lists(items).select("path", "ord", F.col("number").cast("bigint").alias("number"))


@query("select event_id as ord, case when user_id % 5 <> 0 then row_number() over (partition by user_id % 3, reset, user_id % 5 <> 0 order by event_id) end as number from (select *, max(case when user_id % 5 <> 0 and user_id % 3 = 0 then event_id end) over (order by event_id rows between unbounded preceding and 1 preceding) as r0, max(case when user_id % 5 <> 0 and user_id % 3 < 2 then event_id end) over (order by event_id rows between unbounded preceding and 1 preceding) as r1, case user_id % 3 when 0 then -1 when 1 then coalesce(r0, -1) else coalesce(r1, -1) end as reset from events)")
def o04_lists_of_one_file(spark, d):
    """All events as items of one list of one file: resets and numbers are carried from range to range."""
    items = read(spark, d, "events").select(F.lit("f").alias("path"), F.lit(1).alias("num_id"), (F.col("user_id") % 3).cast("int").alias("ilvl"), (F.col("user_id") % 5 != 0).alias("ordered"), F.col("event_id").alias("ord"))
    return office.number_lists_by_ranges(items, 3).select("ord", "number")


@query("select p_partkey || '.xlsx' as path, unnest([1, 1, 3, 3]) as row, unnest([1, 2, 1, 28]) as col, unnest([p_name, p_brand, 'TRUE', cast(p_partkey as varchar)]) as value, unnest([null, null, null, 'A1+$B$1']) as formula from part where p_partkey % 50 <> 0")
def o05_cells(spark, d):
    return office.office_cells(packages(part(spark, d), "xlsx")).select("path", "row", "col", "value", "formula")


@query("""select l_orderkey as path, row, 'A' || row || '+$B$1' as formula from (select l_orderkey, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_extendedprice) as row from lineitem)""")
def o06_shared_formulas(spark, d):
    rows = read(spark, d, "lineitem").selectExpr("l_orderkey as path", "1 as sheet_no", "cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_extendedprice) as bigint) as row", "1 as col", "'0' as si")
    return office.fill_shared_formulas(rows.withColumn("formula", F.when(F.col("row") == 1, "A1+$B$1").otherwise(""))).select("path", "row", "formula")


@query("""select l_orderkey as path, n as n_rows, '|  | A | B |\n| --- | --- | --- |\n' || string_agg('| ' || row || ' | ' || l_partkey || ' | ' || case when row = 1 then 'b \\| c (=A1)' else '' end || ' |', '\n' order by row) as md from
 (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_extendedprice) as row, count(*) over (partition by l_orderkey) as n from lineitem) group by l_orderkey, n""")
def o07_sheet_markdown(spark, d):
    rows = read(spark, d, "lineitem").selectExpr("l_orderkey as path", "1 as sheet_no", "cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_extendedprice) as int) as row", "cast(l_partkey as string) as value", "'' as formula")
    both = rows.withColumn("col", F.lit(1)).unionByName(rows.where("row = 1").withColumns({"col": F.lit(2), "value": F.lit(" b\n| c"), "formula": F.lit("=A1")})).unionByName(rows.where("row = 1").withColumns({"row": F.lit(999), "col": F.lit(99), "value": F.lit(" ")}))
    return office.sheet_markdown(both).select("path", F.col("n_rows").cast("bigint").alias("n_rows"), "md")


@query("select p_partkey || '.ods' as path, unnest([1, 2, 3]) as col, unnest([p_name, p_name, p_brand]) as value from part where p_partkey % 50 <> 0")
def o08_open_document(spark, d):
    return office.office_cells(packages(part(spark, d), "ods")).select("path", "col", "value")


@query("select p_partkey || '.docx' as path, 'i.png' as name from part where p_partkey % 50 <> 0")
def o09_images(spark, d):
    return office.office_images(packages(part(spark, d), "docx"))[0].select("path", F.col("unique_name").alias("name"))


@query("""select path, 'Head ' || path || '\n\n' || string_agg(sep || t, '' order by ord) as text from (select path, ord, t, case when p is null then '' when p and l then '\n' else '\n\n' end as sep from
 (select l_orderkey as path, ord, t, l, lag(l) over (partition by l_orderkey order by ord) as p from (select l_orderkey, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_extendedprice) as ord, 'b' || l_partkey as t, l_linenumber < 5 as l from lineitem))) group by path""")
def o10_office_markdown(spark, d):
    lines = read(spark, d, "lineitem").selectExpr("l_orderkey as path", "row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_extendedprice) as ord", "concat('b', l_partkey) as text", "l_linenumber < 5 as is_list")
    return office.office_markdown(lines, lines.select("path", F.concat(F.lit("Head "), "path").alias("head")).distinct())


ABOUT = "'_Markdown version of the ' || {0} || ' **' || path || '** (2 ' || {1} || '). The original file is kept next to this one; layout is not reproduced — for pictures, equations or diagrams see `' || path || '_media/` or the original._' || chr(10) || chr(10)"


@query(f"""select path, '# ' || path || chr(10) || chr(10) || {ABOUT.format("'document'", "'blocks'")} || '### ' || p_name || chr(10) || chr(10) || '- ' || p_brand || chr(10) as text from (select *, p_partkey || '.docx' as path from part where p_partkey % 50 <> 0)
 union all select path, '# ' || path || chr(10) || chr(10) || {ABOUT.format("'presentation'", "'slides'")} || '## Slide 1 — ' || p_name || chr(10) || chr(10) || '- ' || p_brand || chr(10) || chr(10) || '## Slide 2 — second' || chr(10) || chr(10) || '- ' || p_brand || chr(10) from (select *, p_partkey || '.pptx' as path from part where p_partkey % 50 <> 0)""")
def o10_office_documents(spark, d):
    """Packages to whole Markdown files."""
    rows = packages(part(spark, d), "docx").unionByName(packages(part(spark, d), "pptx"))
    return office.office_documents(stored(rows, "packages")).select("path", "text")


@query("select cast(event_id as varchar) as id, event_type || case when event_id % 2 = 0 then ' 1' else ' 3' end as what from events")
def s01_first_wins(spark, d):
    """Copies of an event that differ, over three runs of a stream from one checkpoint: none with an id, even events, all events."""
    folder = f"{shared_folder(spark)}/lectern/{uuid.uuid4().hex}"
    e = read(spark, d, "events").select(F.lit("c").alias("calendar"), "event_id", F.col("event_id").cast("string").alias("id"), "event_type")
    runs = [e.withColumn("id", F.lit(None).cast("string")), e.where("event_id % 2 = 0"), e]
    for run, rows in enumerate(runs):
        copies = rows.select("*", F.explode(F.array(F.lit(2), F.lit(1))).alias("chunk"))
        what = F.concat("event_type", F.lit(" "), F.col("chunk") + 2 * max(0, run - 1))
        copies.select("calendar", "id", "chunk", what.alias("what")).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("calendar string, id string, chunk int, what string").parquet(f"{folder}/in")
        write_first_wins(stream, f"{folder}/out", f"{folder}/state", ["chunk"]).awaitTermination()
    return spark.read.schema("calendar string, id string, chunk int, what string").parquet(f"{folder}/out").select("id", "what")


@query("select cast(event_id as varchar) as id, event_type from events")
def s01_stream_dedupe(spark, d):
    """The events table as a stream of files, each event twice, against the batch form."""
    folder = shared_folder(spark)
    schema = read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    e = stream.select(F.lit("c").alias("calendar"), F.explode(F.array(F.lit(1), F.lit(2))).alias("chunk"), F.col("event_id").cast("string").alias("id"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = f"{folder}/first_wins_{uuid.uuid4().hex}"
    q = dedupe_stream(e, "ts", "3650 days").select("id", "event_type").writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.parquet(out)
