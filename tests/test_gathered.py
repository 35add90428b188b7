"""Windows over many small groups run in small tasks, whatever the number of shuffle partitions."""

from pyspark.sql import functions as F

from lectern.operators import office


def test_lists_are_numbered_in_small_tasks(spark):
    """The windows take the rows as they were gathered: with a literal list number too no other shuffle follows."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows = spark.range(9000).selectExpr("id div 3 as path", "cast(id % 3 % 2 as int) as ilvl", "id % 5 <> 0 as ordered", "id as ord")
        for num_id in (F.lit(1), (F.col("ord") % 2).cast("int")):
            made = office.number_lists(rows.withColumn("num_id", num_id))
            sizes = [n for n in made.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect() if n]
            assert len(sizes) > 16 and sum(sizes) == 9000 and max(sizes) < 600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
