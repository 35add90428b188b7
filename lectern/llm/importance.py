"""Target-distribution importance resampling with hashed n-gram features.

Bytes of the Arrow text buffer are classified by a lookup table (word byte or not, capitals to small letters);
words start and end where the class changes or a text begins or ends. A table-driven CRC32 then advances across
all starts at once, byte by byte of the words; words that have ended drop out of the step. An n-gram goes on
from the state of its first words over one space and its next word, so each length costs one more pass. Words of
more than LONG bytes are finished by zlib from the same state, as a step for a few of them would cost as much as
one for all.

Features fall into a fixed number of buckets. What is known of the corpus and of the target is one count a
bucket (BUCKETS longs each, whatever the input): tasks sum their own, Spark adds them up, and the gains of
buckets go to all tasks. A text's weight is the sum of its features' gains; a keyed random term (Gumbel) makes
the largest scores a weighted draw without replacement. Ranks come from a range-partitioned sort with the counts of
the partitions before (`operators.relational.ranked`): no window over all rows.

Null or blank text: no features, weight 0. A null doc_id has no random term: its score is null, it is not counted
among those drawn from and never drawn. Repeated rows are rows of their own; of equal (score, doc_id) each takes
its own rank. Empty documents give no rows; an empty target has no features (T = t = 0) and still draws.
Other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.relational import ranked

from . import common as c

BUCKETS, GRAMS, PERCENT, MIN_WORDS, SEED = 10_000, 1, 10, 20, 2024
#: Bytes of a word that the automaton walks; the rest of longer ones is left to zlib.
LONG = 48


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte: whether it is of a word, its small letter, and the CRC32 step."""
    byte = np.arange(256, dtype=np.uint8)
    small = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
    word = ((small >= 48) & (small <= 57)) | ((small >= 97) & (small <= 122)) | (small >= 128)
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    return word, small, step


WORD, SMALL, STEP = _tables()
_FULL = np.uint32(0xFFFFFFFF)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each text begins and the last one ends. Null is empty."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each word, and the text it is in."""
    inside = WORD[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False  # a word never goes on from one text into the next
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:] & before[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends - starts, np.searchsorted(offsets, starts, side="right") - 1


def advance(state: np.ndarray, small: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC states after the bytes of each run, all runs a byte at a time."""
    order = np.argsort(-lengths, kind="stable")  # those that still run stay in front
    state, starts, lengths = state[order], starts[order], lengths[order]
    going = len(lengths) - np.cumsum(np.bincount(np.minimum(lengths, LONG), minlength=LONG + 1)[: LONG])
    for k in range(min(LONG, int(lengths[0]) if len(lengths) else 0)):
        n = going[k]
        head = state[:n]
        state[:n] = STEP[(head ^ small[starts[:n] + k]) & np.uint32(255)] ^ (head >> np.uint32(8))
    for i in range(int(np.searchsorted(-lengths, -LONG, side="left"))):
        rest = small[starts[i] + LONG : starts[i] + lengths[i]]
        state[i] = zlib.crc32(rest.tobytes(), int(state[i] ^ _FULL)) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def features(texts: pa.Array, grams: int = GRAMS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of each run of 1 to ``grams`` words, and the number of words of each text."""
    data, offsets = buffers(texts)
    starts, lengths, owner = words(data, offsets)
    small = SMALL[data]
    state = advance(np.full(len(starts), _FULL), small, starts, lengths)
    at, who = [(state ^ _FULL) % np.uint32(buckets)], [owner]
    first = np.arange(len(starts))
    for n in range(1, grams):
        ok = first[first + n < len(starts)]
        ok = ok[owner[ok] == owner[ok + n]]
        spaced = STEP[(state[ok] ^ np.uint32(32)) & np.uint32(255)] ^ (state[ok] >> np.uint32(8))
        state = np.full(len(starts), _FULL)
        state[ok] = advance(spaced, small, starts[ok + n], lengths[ok + n])
        at.append((state[ok] ^ _FULL) % np.uint32(buckets))
        who.append(owner[ok])
        first = ok
    return np.concatenate(at).astype(np.int64), np.concatenate(who), np.bincount(owner, minlength=len(texts))


def bucket_counts(docs: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: one sum a task, then one row a bucket."""
    c.small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in c.chunks(batch):
                total += np.bincount(features(part.column("text"), grams, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():  # a row a bucket
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how much likelier a bucket is in the target), with one added to each count."""
    ratio = (target + 1.0) * (float(corpus.sum()) + len(corpus)) / ((corpus + 1.0) * (float(target.sum()) + len(target)))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS) -> DataFrame:
    """(doc_id, n_features, n_words, weight), one row for each row of docs."""
    c.small_batches(docs.sparkSession)
    source = docs.select("doc_id", "text")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.chunks(batch):
                at, owner, n_words = features(part.column("text"), grams, len(gain))
                n = part.num_rows
                total = np.zeros(n, np.int64)
                order = np.argsort(owner, kind="stable")
                held, first = np.unique(owner[order], return_index=True)
                total[held] = np.add.reduceat(gain[at[order]], first) if len(at) else 0
                columns = [part.column("doc_id"), *map(pa.array, (np.bincount(owner, minlength=n), n_words, total))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "n_words", "weight"])

    return source.mapInArrow(weigh, f"doc_id {dict(source.dtypes)['doc_id']}, n_features bigint, n_words bigint, weight bigint")


def gumbel(seed: int) -> Column:
    """floor(1000 x a Gumbel draw) fixed by seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, grams: int = GRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank is null where the row isn't drawn."""
    gain = gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    scored = c.store(weights(docs, gain, grams).withColumn("score", F.col("weight") + gumbel(seed)), "scored")
    able = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    drawn = scored.where(able).count() * percent // 100
    named = ranked(scored.where(able), [F.desc("score"), F.asc("doc_id")], "place")
    columns = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("place") <= drawn, F.col("place")).alias("rank")
    return named.select(*columns, rank).unionByName(scored.where(~able).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(c.read(spark, sf_dir, "documents"), c.read(spark, sf_dir, "benchmark"))
