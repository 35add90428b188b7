"""Scans and ranks over sorted ranges against the window forms; one key with all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import office
from lectern.operators import relational as R

SCHEMA = "k string, o long, v string, part int, at string, near string, last string"


def table(spark, n=400, keys=(None, "a", "b", "c"), seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(keys), i, rng.choice([None, None, None, "", "x", "y"]), i, "own", "own", "own") for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("keys", [(None, "a", "b", "c"), ("hot",), tuple(map(str, range(300)))])
def test_fill(spark, keys):
    df = table(spark, keys=keys)
    tens = F.when(F.col("o") % 10 == 0, F.col("o"))
    want = R.forward_filled(R.forward_filled(df, ["k"], ["o"], "v", "filled").withColumn("t", tens), ["k"], ["o"], "t", "ten").drop("t")
    assert rows(R.forward_filled_by_ranges(df, ["k"], ["o"], {"filled": F.col("v"), "ten": tens})) == rows(want)


def test_fill_without_values_and_empty(spark):
    df = table(spark).withColumn("v", F.lit(None).cast("string"))
    assert all(r.filled is None for r in R.forward_filled_by_ranges(df, ["k"], ["o"], {"filled": F.col("v")}).collect())
    assert R.forward_filled_by_ranges(df.limit(0), ["k"], ["o"], {"filled": F.col("v")}).count() == 0


@pytest.mark.parametrize("keys", [(None, "a", "b", "c"), ("hot",)])
def test_first_of_group(spark, keys):
    df = table(spark, keys=keys)
    tens, v = F.floor(F.col("o") / 10), F.col("v")
    got = R.first_of_group_by_ranges(df, ["k"], ["o"], {"new_ten": tens, "new_v": v})
    want = R.first_of_group(R.first_of_group(df, ["k"], ["o"], tens, "new_ten"), ["k"], ["o"], v, "new_v")
    assert rows(got) == rows(want)
    assert R.first_of_group_by_ranges(df.limit(0), ["k"], ["o"], {"x": tens}).count() == 0


def test_rank(spark):
    df = table(spark)
    want = df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("k"), "o")).cast("bigint"))
    assert rows(R.ranked(df, [F.desc("k"), F.asc("o")], "rank")) == rows(want)
    assert R.ranked(df.limit(0), ["k"], "rank").count() == R.ranked(df.limit(0), ["o"], "rank", ["k"]).count() == 0


@pytest.mark.parametrize("keys", [(None, "a", "b", "c"), ("hot",), tuple(map(str, range(300)))])
def test_rank_of_keys(spark, keys):
    df = table(spark, keys=keys)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("o"))).cast("bigint"))
    assert rows(R.ranked(df, [F.desc("o")], "rank", ["k"])) == rows(want)


def test_one_key_is_many_ranges(spark):
    """All rows of one key are dealt out to all partitions."""
    df = table(spark, 2000, ("hot",))
    parts = {r._part: r.n for r in R.sorted_parts(df, ["k", "o"], "_part", "_at").groupBy("_part").agg(F.count("*").alias("n")).collect()}
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(parts.values()) < 1200


def test_lists_of_any_size(spark):
    """Numbers of one file's lists, range by range, as by windows."""
    rng = random.Random(8)
    items = [(rng.choice(["one.docx"] * 9 + ["two.docx"]), rng.choice([None, "1", "2"]), rng.choice([0, 0, 1, 1, 2, 3, 11]), rng.random() < 0.8, i) for i in range(600)]
    df = spark.createDataFrame(items, "path string, num_id string, ilvl int, ordered boolean, ord long").repartition(5)
    assert rows(office.number_lists_by_ranges(df)) == rows(office.number_lists(df).withColumn("number", F.col("number").cast("bigint")))
    assert office.number_lists_by_ranges(df.limit(0)).count() == 0


def test_meta_lines_are_worked_out_once(spark):
    """Filters on labels and keys don't repeat the patterns: a copy for each would be tried on each line."""
    from lectern.operators import course

    df = spark.createDataFrame([(1, 0, "Attempts  allowed : 2"), (1, 1, "Attempts allowed : 3"), (1, 2, "plain"), (2, 0, " ")], "k int, ord int, line string")
    lines, meta = course.line_facts(df, ["k"])
    assert sorted((r.k, r.line) for r in lines.collect()) == [(1, "Attempts allowed : 2"), (1, "Attempts allowed : 3"), (1, "plain")]
    assert [(r.k, dict(r.meta)) for r in meta.collect()] == [(1, {"attempts": "2"})]
    plan = meta._jdf.queryExecution().optimizedPlan().toString()
    assert not any("RLIKE" in x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Filter")), plan
