"""The stream that keeps the first capture of each id, against the batch form."""

import json
import os
import time

import pyarrow as pa
import pytest

from lectern.operators.timetable import dedupe_events
from lectern.streaming import events

SCHEMA = "calendar string, id string, chunk int, pos long, what string, tags array<string>, n decimal(20,0), at timestamp_ntz"


class Feed:
    """A folder of arriving rows and the stream's table and checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.batches = spark, str(folder), []

    def run(self, rows):
        full = [(c, i, k, p, w, [w, None], None, None) for c, i, k, p, w in rows]
        df = self.spark.createDataFrame(full, SCHEMA)
        self.batches.append(df)
        df.repartition(3).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.folder}/in")
        q = events.write_first_wins(stream, f"{self.folder}/out", f"{self.folder}/state", ["chunk", "pos"])
        q.awaitTermination()
        assert q.exception() is None
        return q

    def rows(self):
        return sorted(map(tuple, self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/out").collect()), key=repr)

    def whats(self):
        return sorted((r[0], r[1], r[4]) for r in self.rows())


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_first_batches_without_ids_then_copies_that_differ(spark, feed):
    before = spark.conf.get(events.STORE, None)
    feed.run([("c", None, 1, 0, "no id"), ("d", None, None, None, "none")])
    assert feed.rows() == []
    feed.run([("c", "1", 2, 0, "later"), ("c", "1", 1, 9, "first"), ("c", "1", 1, 10, "second"), ("d", "1", 5, 0, "other calendar"), ("c", None, 0, 0, "no id")])
    assert feed.whats() == [("c", "1", "first"), ("d", "1", "other calendar")]
    feed.run([("c", "1", 0, 0, "too late to win"), ("c", "2", 0, 0, "new")])
    feed.run([("c", "2", 0, 0, "again")])
    assert feed.whats() == [("c", "1", "first"), ("c", "2", "new"), ("d", "1", "other calendar")]
    assert feed.rows()[0][5] == ["first", None]  # other columns come through as they are
    assert spark.conf.get(events.STORE, None) == before


def test_one_run_equals_the_batch_form(spark, feed):
    rows = [("c", str(i % 40), i % 7, i, f"w{i}") for i in range(400)] + [(None, "x", None, 1, "null order comes first"), (None, "x", 0, 1, "w"), ("c", "", 1, 1, "empty id is an id")]
    feed.run(rows)
    want = dedupe_events(feed.batches[0], ["chunk", "pos"])
    assert feed.rows() == sorted(map(tuple, want.select("calendar", "id", "chunk", "pos", "what", "tags", "n", "at").collect()), key=repr)


def test_one_hot_id(spark, feed):
    """Copies are dropped before the shuffle, an Arrow batch at a time."""
    feed.run([("c", "hot", 3, i, "x") for i in range(3000, 0, -1)] + [("c", "cold", 1, 1, "y")])
    assert [(r[1], r[3]) for r in feed.rows()] == [("cold", 1), ("hot", 1)]


def test_a_batch_costs_its_own_rows(spark, feed):
    """Later batches read no earlier ids: rows read are those that arrive, and the state is written by its changes."""
    for n in range(4):
        q = feed.run([("c", f"{n}-{i}", 0, i, "x") for i in range(500)])
        assert q.lastProgress.numInputRows == 500
        (state,) = q.lastProgress.stateOperators
        assert state.numRowsTotal == 500 * (n + 1) and state.numRowsUpdated == 500
    assert len(feed.rows()) == 2000


def test_state_with_time_to_live(spark, feed):
    """With a time to live, an id that was forgotten counts as new."""
    feed.run([("c", "1", 1, 0, "first")])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{feed.folder}/in")
    feed.batches[0].coalesce(1).write.mode("append").parquet(f"{feed.folder}/in")
    with events.rocks_store(spark):
        found = events.first_captures(stream, ["chunk", "pos"], ttl_ms=1)
        q = found.writeStream.format("memory").queryName("forgotten").outputMode("append").trigger(processingTime="100 milliseconds").start()
    try:
        end = time.monotonic() + 60
        while time.monotonic() < end and spark.table("forgotten").count() < 2:
            time.sleep(0.5)
        assert spark.table("forgotten").count() == 2
    finally:
        q.stop()


def test_a_run_that_stopped_before_its_commit_is_done_again(spark, feed):
    """Without its commit mark the last batch runs anew from the same state: no row twice, none lost."""
    feed.run([("c", str(i), 0, i, "x") for i in range(10)])
    feed.run([("c", str(i), 1, i, "y") for i in range(5, 15)])
    whole = feed.rows()
    commits = f"{feed.folder}/state/commits"
    last = max(int(x) for x in os.listdir(commits) if x.isdigit())
    for x in (f"{commits}/{last}", f"{commits}/.{last}.crc"):
        os.path.exists(x) and os.remove(x)
    assert json.loads(open(f"{feed.folder}/state/metadata").read())["id"]
    feed.run([("c", "20", 0, 0, "z")])
    assert feed.rows() == sorted([*whole, ("c", "20", 0, 0, "z", ["z", None], None, None)], key=repr)


def test_many_ids_cost_no_call_of_python_each(spark, feed):
    """Spark's own deduplication keeps the state; copies of an id in several tasks and Arrow batches are still put in order."""
    rows = spark.range(60000).selectExpr("'c' calendar", "cast(id % 20000 as string) id", "cast(2 - id div 20000 as int) chunk", "id pos", "cast(id as string) what", "array('t') tags", "cast(id as decimal(20,0)) n", "cast(null as timestamp_ntz) at")
    rows.repartition(5).write.parquet(f"{feed.folder}/in")
    q = feed.run([("c", "0", 9, 0, "late")])
    (state,) = q.lastProgress.stateOperators
    assert (state.operatorName, state.numRowsTotal) == ("dedupe", 20000)
    got = spark.read.schema(SCHEMA).parquet(f"{feed.folder}/out").agg({"chunk": "max", "pos": "min", "*": "count"}).first()
    assert sorted(got.asDict().values()) == [0, 20000, 40000]


def test_buckets_of_one_id_and_of_many_batches():
    """A bucket is cut whenever as many rows came as are held; the first row of each id is left in the end."""
    batch = lambda ids, at: pa.RecordBatch.from_arrays([pa.array([0] * len(ids)), pa.array(ids), pa.array([at] * len(ids), pa.int64())], ["bucket", "id", "at"])
    cut = events._first_of_buckets(["id"], ["at"], pa.schema({"id": pa.string(), "at": pa.int64()}))
    some = [batch([str(i % 7000) for i in range(k, k + 5000)], 9 - k // 5000) for k in range(0, 45000, 5000)]
    got = pa.Table.from_batches(cut(iter([*some, batch(["6999"], None)])))
    firsts = {str(i % 7000): 9 - i // 5000 for i in range(45000)} | {"6999": None}
    assert got.column_names == ["id", "at"] and dict(zip(*got.to_pydict().values())) == firsts and got.num_rows == 7000


def test_times_in_another_zone(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        rows = spark.sql("select 'c' calendar, string(id % 2) id, timestamp'2030-07-01 10:00:00' + make_interval(0, 0, 0, 0, 0, id) at, named_struct('a', 1, 'b', array(id)) s, map('k', id) m, binary('x') b, date'2030-01-01' d from range(10)")
        rows.write.parquet(f"{tmp_path}/in")
        q = events.write_first_wins(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", ["at"])
        q.awaitTermination()
        got = spark.read.schema(rows.schema).parquet(f"{tmp_path}/out").orderBy("id").selectExpr("id", "string(at)", "s.b[0]", "m['k']", "string(b)", "string(d)").collect()
        assert [tuple(r) for r in got] == [("0", "2030-07-01 10:00:00", 0, 0, "x", "2030-01-01"), ("1", "2030-07-01 10:01:00", 1, 1, "x", "2030-01-01")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
