"""What the text operators share: words, hashes, chunks of Arrow batches and tables in the shared folder.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``, which is what ``bytes.split()`` cuts at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.stored import stored

#: Text bytes that one vectorised step holds at once; a longer text is a step of its own.
CHUNK_BYTES = 4 << 20
#: Rows of an Arrow batch. Long texts make a default batch of 10,000 rows too large for a worker.
BATCH_ROWS = 1000

U64 = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


store = stored
#: Rows of a stored table of ids and hashes (some 40 bytes each) that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, gone: DataFrame, condition: Column) -> DataFrame:
    """The rows of docs that match none of a stored table of ids, which is broadcast only after it was counted."""
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, condition, "left_anti")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches at BATCH_ROWS rows where the session allows more; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text each, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def split_words(texts: Iterable[bytes | None], lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """All words in a row, and the number of them in each text. Null has none."""
    words: list[bytes] = []
    counts = []
    for t in texts:
        w = (t.translate(_LOWER) if lower else t).split() if t else []
        words += w
        counts.append(len(w))
    return words, np.array(counts, dtype=np.int64)


def number(words: list) -> tuple[np.ndarray, list]:
    """Each word's place in the list of different words, and that list."""
    different = list(dict.fromkeys(words))
    ids = dict(zip(different, range(len(different))))
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), different


def word_hashes(words: list[bytes]) -> np.ndarray:
    at, different = number(words)
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in different), U64, len(different))[at]


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` hashes, in order; shorter by size - 1 than h."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    x = h[:n].copy()
    for k in range(1, size):
        x = (x ^ (x >> U64(32))) * U64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mix(x)


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of the given lengths laid end to end: the row of each element, and its place in the row."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def map_texts(
    df: DataFrame, fn: Callable[[list[bytes | None]], dict], fields: str, keep: tuple[str, ...] = ("doc_id",), most: int = CHUNK_BYTES
) -> DataFrame:
    """Adds what fn makes of a chunk's texts (a dict of columns, in the order of ``fields``) to the ``keep`` columns.

    Only ``keep`` and ``text`` are read, so other columns cannot clash with new names.
    """
    small_batches(df.sparkSession)
    source = df.select(*keep, "text")
    head = ", ".join(f"`{k}` {dict(source.dtypes)[k]}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, most=most):
                made = fn(raw(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *made.values()], [*keep, *made])

    return source.mapInArrow(run, f"{head}, {fields}")


def fold(column: str) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) for nodes of the undirected edges (u, v): the smallest node reachable.

    Alternates large-star and small-star steps. Each step is two keyed aggregates with map-side
    combining and a join on the node; a hub's rows are split by the adaptive skew join. Lineage is
    cut by a written table a step; the driver sees one number a step.
    """
    e = store(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), f"{tag}-0")
    step, before = 0, None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        )
        step += 1
        e = store(small, f"{tag}-{step}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
