"""Driver tables shaped as the library's inputs, by expressions that Spark and the checking engine both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.timetable import ELEMENT


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# One detail element for each line of an order; a label is null where it continues.
LINES = [
    "cast(l_orderkey as string) as id",
    "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as pos",
    "case l_linenumber when 1 then 'Module' when 2 then 'Personnel' when 4 then 'Salle' when 6 then 'Groupe' when 7 then 'Remarque' end as label",
    "case when l_linenumber = 5 and l_suppkey % 3 = 0 then '' else 'P' || l_partkey || ' of ' || l_suppkey end as content",
]
LINES_SQL = f"(select {', '.join(LINES)} from lineitem)"
# The same with labels filled and kinds given by plain equality.
KINDS_SQL = f"""(select id, pos, content, label, case filled when 'Module' then 'modules' when 'Personnel' then 'staff' when 'Salle' then 'rooms' when 'Groupe' then 'groups'
 when 'Remarque' then 'notes' else 'extra' end as kind, filled from (select *, last_value(label ignore nulls) over (partition by id order by pos rows between unbounded preceding and current row) as filled from {LINES_SQL}))"""

# An event for each order: timed or all-day, with a description of one to four blocks.
EVENTS = [
    "cast(o_orderkey as string) as id",
    "cast(o_custkey % 5 as string) as calendar",
    "o_orderdate",
    "o_orderkey",
    "o_custkey",
    "o_orderpriority",
    "o_orderstatus = 'F' as allDay",
    "'C' || o_custkey as code0",
    "'Order ' || o_orderkey as subject0",
    "'G' || (o_custkey % 11) as group0",
    "'R' || (o_orderkey % 13) as room0",
    "o_orderkey % 4 as shape",
]


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "orders").selectExpr(*EVENTS)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    title, gap = F.concat("code0", F.lit(" ["), "subject0", F.lit("]")), F.lit("\r\n\r\n<br />\r\n\r\n")
    desc = (
        F.when(F.col("shape") == 0, title).when(F.col("shape") == 1, F.concat(title, gap, "group0", F.lit("<br />"), "group0", F.lit("x")))
        .when(F.col("shape") == 2, F.concat(title, gap, "group0", gap, "room0")).otherwise(F.concat(title, gap, F.lit("caf&#233; &amp; co"), gap, "group0", gap, "room0"))
    )
    return e.select(
        "calendar", "id", F.concat(day, F.lit("T10:30:00")).alias("start"), F.when(F.col("shape") != 3, F.concat(day, F.lit("T12:05:00"))).alias("end"), "allDay",
        desc.alias("description"), F.lit("#ff00aa").alias("backgroundColor"), F.lit(None).cast("string").alias("department"), F.col("o_orderpriority").alias("eventCategory"),
        F.array(F.lit("Site A"), F.lit("Site A")).alias("sites"), F.array("code0").alias("modules"),
        F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("https://meet.example.org/"), "id")).alias("custom1"), F.lit("no link").alias("custom2"), F.lit(None).cast("string").alias("custom3"),
    )


def order_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(calendar, event_id, elements) from the lines of each order."""
    lines = read(spark, sf_dir, "lineitem").selectExpr(*LINES)
    none = F.lit(None)
    e = F.struct("label", "content", none.cast("string").alias("federationId"), none.cast("int").alias("entityType"), none.cast("string").alias("assignmentContext"), F.lit(False).alias("containsHyperlinks"), F.lit(False).alias("isNotes"), F.lit(False).alias("isStudentSpecific"))
    by = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", e.alias("e")))).alias("x"))
    orders = read(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as string) as id", "cast(o_custkey % 5 as string) as calendar")
    return by.join(orders, "id").select("calendar", F.col("id").alias("event_id"), F.transform("x", lambda r: r["e"]).cast(f"array<{ELEMENT}>").alias("elements"))
