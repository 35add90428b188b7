"""Streaming first-wins dedupe of arriving timetable chunks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lectern.operators.relational import unused

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that a micro-batch's ids are looked at in, many ids together.
BUCKETS = 4096


def dedupe_stream(stream: DataFrame, time: str, watermark: str, scope: list[str] = ["calendar"]) -> DataFrame:  # noqa: B006
    """The first capture of each id that arrives, while the watermark remembers it.

    With a watermark at least as long as the input's span this equals the batch form. Copies of an id in one
    micro-batch have no order; where their contents differ, use ``first_captures``.
    """
    return stream.where("id is not null").withWatermark(time, watermark).dropDuplicatesWithinWatermark([*scope, "id"])


class FirstWins(StatefulProcessor):
    """Of a key that is new, the first row in order; nothing of a key that came before. The state is one flag a key."""

    def __init__(self, order: list[str], ttl_ms: int | None) -> None:
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values: object) -> Iterator[Row]:  # noqa: N802
        if self.seen.exists():
            return
        first = min(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order])
        self.seen.update((True,))
        yield first

    def close(self) -> None:
        pass


def _firsts(batch: pa.RecordBatch | pa.Table, keys: list[str], order: list[str]) -> pa.RecordBatch | pa.Table:
    """The first row in order of each key."""
    if batch.num_rows < 2:
        return batch
    names = [*keys, *order]
    rows = pa.table([batch.column(n) for n in names], [str(i) for i in range(len(names))])
    by = pc.sort_indices(rows, [(n, "ascending") for n in rows.column_names], null_placement="at_start")
    of_key = rows.select(range(len(keys))).take(by).append_column("at", by if isinstance(by, pa.ChunkedArray) else pa.chunked_array([by]))
    first = of_key.group_by(of_key.column_names[:-1], use_threads=False).aggregate([("at", "first")])
    return batch.take(first["at_first"].combine_chunks())


def _first_of_batches(keys: list[str], order: list[str]):
    """Drops rows of an Arrow batch that another row of the same key in it precedes, before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _firsts(batch, keys, order)

    return run


def _first_of_buckets(keys: list[str], order: list[str], schema: pa.Schema):
    """The first row in order of each key of a bucket, in the columns of schema. Rows are looked at whenever as many came
    as are held, so that a bucket's memory is in proportion to its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        known = more = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]).select(schema.names))
            more += batch.num_rows
            if more >= max(known, 10_000):
                held = [_firsts(pa.concat_tables(held).combine_chunks(), keys, order)]
                known, more = held[0].num_rows, 0
        # times arrive in the session's zone and leave in UTC
        yield from _firsts(pa.concat_tables(held).combine_chunks(), keys, order).cast(schema).to_batches()

    return run


def first_captures(stream: DataFrame, order: list[str], scope: list[str] = ["calendar"], ttl_ms: int | None = None) -> DataFrame:  # noqa: B006
    """The first capture of each id, in order inside a micro-batch, by arrival over micro-batches; rows without an id go.

    Ids are remembered by keyed state for good, as the batch form does, or for ``ttl_ms`` of processing time (give such a
    query a processing-time trigger; run until all is read, it would wait for ids to be forgotten). For good, buckets of
    ids are cut to the first rows of the micro-batch and Spark's own deduplication keeps the state; a time to live takes
    a call of Python for each id. The query should have, and with a time to live needs, a state store of column families:
    start it in ``rocks_store`` or with ``write_first_wins``.
    """
    keys = [*scope, "id"]
    known = stream.where("id is not null")
    one = known.mapInArrow(_first_of_batches(keys, order), known.schema)
    if ttl_ms is not None:
        return one.groupBy(*keys).transformWithState(FirstWins(order, ttl_ms), stream.schema, "Append", "ProcessingTime")
    (bucket,) = unused(stream, "bucket")
    by = one.withColumn(bucket, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).groupBy(bucket)
    return by.applyInArrow(_first_of_buckets(keys, order, to_arrow_schema(stream.schema)), stream.schema).dropDuplicates(keys)


@contextmanager
def rocks_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session is left as it was."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before is not None else spark.conf.unset(STORE)


def write_first_wins(stream: DataFrame, path: str, checkpoint: str, order: list[str], scope: list[str] = ["calendar"]) -> StreamingQuery:  # noqa: B006
    """Appends the first captures to a table of Parquet files, each exactly once, over any number of runs.

    A micro-batch reads its own rows and the state of their keys, nothing that was written before.
    """
    with rocks_store(stream.sparkSession):
        found = first_captures(stream, order, scope)
        return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
