"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often over the whole corpus.

A text with a leading space is encoded by a byte-level BPE (A) and a BPE of pieces with byte fallback (B). Byte
offsets where a token of both ends cut the tokens into groups; the two tokens that end there are linked.

A text is encoded in segments: it is cut at each single space between characters that are no white space. No token
of either vocabulary spans such a cut (checked when the files are loaded; else whole texts are segments), so ids,
groups and links are those of the whole text, and a task encodes each different short segment once.

1. Encode and count. Texts are encoded once; a row's links are written as packed int64 keys (B id << 32 | A id). A
   task sums the keys of its rows by np.unique and emits one row a different pair.
2. Sort. The partial counts are range-partitioned by key and sorted; a task sums runs of equal keys as they pass by
   and writes its shard, keys and counts as plain int64 files, to the shared folder under a name of its own
   attempt. Only shards of finished tasks are in the table of shards that follows.
3. Look up. Tasks memory-map the shards and find the different keys of their rows by searchsorted. The highest
   count of each B id (as many numbers as B has ids) goes to all tasks; the pair counts never pass the driver.

The shared folder must be one that pyarrow can open. One that isn't mounted is copied shard by shard, as asked for,
to unlinked local files that are mapped. Shards are as many as ``spark.sql.shuffle.partitions``.

Null or empty text, and a text that A or B does not give back byte for byte (for B: U+2581), has no tokens: zeros
and ''. Special tokens' strings are plain text. doc_id is passed through, null too; repeated rows give one row each
and count as often as they stand; an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import base64
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.stored import shared_folder

from . import common as c

A_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
B_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: How A cuts a text before it merges bytes (a fixed value of that vocabulary).
A_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Segments that a task keeps and bytes of their groups; segments that are encoded, bytes of text and keys that are worked on at once.
KEPT, KEPT_BYTES, AT_ONCE, STEP_BYTES, PENDING = 200_000, 32 << 20, 10_000, 1 << 20, 500_000
SPACE = "▁"
#: After a token inside a group, A's last, B's last, and the last of a segment.
MARKS = (",", "|", ";", "\n")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Tokenizers:
    """Both vocabularies, with the bytes of each of their tokens."""

    def __init__(self, a_ranks: str, b_model: str) -> None:
        import sentencepiece
        import tiktoken

        with open(a_ranks, "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=A_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.a_bytes[v] = k
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.names = np.array([f"{i}{mark}" for i in range(max(len(self.a_bytes), len(pieces))) for mark in MARKS], object)
        # a piece with a space after something else could span a cut
        self.cuts = not any(SPACE in p.lstrip(SPACE) for i, p in enumerate(pieces) if not self.b.is_control(i))

    def segments(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Which segments come back byte for byte, and of those, in order, the tokens of A and B and the links, the groups as text, and the keys of all links."""
        a = [self.a.encode_ordinary(" " + s) for s in segments]
        b = self.b.encode(segments, num_threads=1) if segments else []
        get_a, get_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        good = np.array([b"".join(map(get_a, x)) == (" " + s).encode() == b"".join(map(get_b, y)) for s, x, y in zip(segments, a, b)], bool)
        a, b = ([x for x, ok in zip(xs, good) if ok] for xs in (a, b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        # laid end to end, both rows of tokens cover the same bytes
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends, last_a, last_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        links = np.diff(np.searchsorted(ends, end_a[np.cumsum(n_a) - 1], side="right"), prepend=0)
        return good, np.stack([n_a, n_b, links], axis=1), self._groups(a, b, np.searchsorted(ends, end_a), np.searchsorted(ends, end_b), last_a, last_b, np.cumsum(n_b) - 1), b[last_b] << 32 | a[last_a]

    def _groups(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, final: np.ndarray) -> list[str]:
        """Each segment's groups as text. of_a, of_b: the group of each token; last_…: the last tokens of groups; final: of segments."""
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)  # what follows a number, by its place in MARKS
        mark_a[last_a], mark_b[last_b], mark_b[final] = 1, 2, 3
        order = np.argsort(np.concatenate([of_a * 2, of_b * 2 + 1]), kind="stable")
        written = np.concatenate([a * len(MARKS) + mark_a, b * len(MARKS) + mark_b])[order]
        return "".join(self.names[written].tolist()).split(MARKS[3])[:-1]


@lru_cache(maxsize=1)
def _tokenizers(a_ranks: str, b_model: str) -> Tokenizers:
    return Tokenizers(a_ranks, b_model)


class Segments:
    """The different segments that a task has met, numbered: token and link counts, groups and keys of each."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.zeros((0, 3), np.int64)
        self.keys = np.zeros(0, np.int64)
        self.size = 0

    def learn(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each segment of all texts that have tokens, and how many segments each text has; 0 if it has none."""
        if len(self.at) > KEPT or self.size > KEPT_BYTES:
            self.forget()
        segments, counts = [], []
        for t in texts:
            try:
                one = self.tokenizers.segments(t.decode()) if t else []
            except UnicodeDecodeError:
                one = []
            segments += one
            counts.append(len(one))
        new = [s for s in dict.fromkeys(segments) if s not in self.at]
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        for k in range(0, len(new), AT_ONCE):
            part = new[k : k + AT_ONCE]
            numbers, groups = np.full((len(part), 3), -1, np.int64), np.full(len(part), "", object)
            good, of_good, text, keys = self.tokenizers.encode(part)
            numbers[good], groups[good] = of_good, text
            self.size += sum(map(len, text))
            self.groups += groups.tolist()
            self.numbers = np.concatenate([self.numbers, numbers])
            self.keys = np.concatenate([self.keys, keys])
        ids = np.fromiter(map(self.at.__getitem__, segments), np.int64, len(segments))
        counts = np.array(counts, np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        lost = np.bincount(owner[self.numbers[ids, 0] < 0], minlength=len(counts)) > 0
        return ids[~lost[owner]], np.where(lost, 0, counts)

    def first(self) -> np.ndarray:
        """Where the keys of each segment begin."""
        n = np.maximum(self.numbers[:, 2], 0)
        return np.cumsum(n) - n


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def encoded(docs: DataFrame, a_ranks: str = A_RANKS, b_model: str = B_MODEL) -> DataFrame:
    """(doc_id, n_a, n_b, keys, groups) of every row of docs: the packed key of each link in order, and the groups as text."""
    c.small_batches(docs.sparkSession)
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(_tokenizers(a_ranks, b_model))
        for batch in batches:
            for part in c.chunks(batch, most=STEP_BYTES):
                ids, sizes = segments.learn(c.raw(part.column("text")))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                n_a, n_b, links = (np.bincount(owner, weights=x, minlength=len(sizes)).astype(np.int64) for x in segments.numbers[ids].T)
                run, inside = c.places(segments.numbers[ids, 2])
                keys = segments.keys[segments.first()[ids][run] + inside]
                names, ends = [segments.groups[i] for i in ids.tolist()], np.cumsum(sizes).tolist()
                groups = [";".join(names[end - n : end]) for n, end in zip(sizes.tolist(), ends)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_a), pa.array(n_b), c.lists(keys, links, pa.int64()), pa.array(groups, pa.string())], ["doc_id", "n_a", "n_b", "keys", "groups"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, n_a bigint, n_b bigint, keys array<bigint>, groups string")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and how many each has."""
    at = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[at[0] : at[-1]], np.diff(at)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows with about PENDING keys at most, or one row."""
    for batch in batches:
        ends, at = np.cumsum(_flat(batch.column("keys"))[1]), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PENDING, side="right")))
            yield batch.slice(at, to - at)
            at = to


def pair_counts(links: DataFrame) -> DataFrame:
    """(key, n): each task's count of each packed pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, PENDING
        for part in _slices(batches):
            held.append(np.unique(_flat(part.column("keys"))[0], return_counts=True))
            size += len(held[-1][0])
            if size > most:
                held = [summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                most = 2 * size + PENDING  # so that merges stay in proportion to what is read
        if held:
            key, n = summed(*map(np.concatenate, zip(*held)))
            for at in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 100_000]), pa.array(n[at : at + 100_000])], ["key", "n"])

    return links.select("keys").mapInArrow(count, "key bigint, n bigint")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums runs of equal keys of sorted batches; a run that a batch ends with waits for the next batch."""
    key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key, n = summed(*(np.concatenate([x, batch.column(k).to_numpy()]) for k, x in (("key", key), ("n", n))))
        if len(key) > 1:
            yield key[:-1], n[:-1]
            key, n = key[-1:], n[-1:]
    if len(key):
        yield key, n


def shards(counts: DataFrame) -> DataFrame:
    """Writes the summed counts in key order as pairs of int64 files; (low, pairs, path, b, best) of each shard.

    b and best: the B ids of the shard and the highest count of each in it.
    """
    spark = counts.sparkSession
    folder = f"{shared_folder(spark)}/lectern/{uuid.uuid4().hex}/pairs"
    spread = c.store(counts, "pair-counts").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        path, low, pairs, best = f"{base}/{uuid.uuid4().hex}", None, 0, {}
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{path}.keys") as keys, store.open_output_stream(f"{path}.counts") as values:
            for key, n in _runs(batches):
                low = int(key[0]) if low is None else low
                pairs += len(key)
                keys.write(key.tobytes())
                values.write(n.tobytes())
                b, first = np.unique(key >> 32, return_index=True)
                for i, most in zip(b.tolist(), np.maximum.reduceat(n, first).tolist()):
                    best[i] = max(most, best.get(i, 0))
        if pairs:
            columns = [pa.array([low]), pa.array([pairs]), pa.array([path.removeprefix(f"{base}/")]), pa.array([[*best]], pa.list_(pa.int64())), pa.array([[*best.values()]], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["low", "pairs", "path", "b", "best"])
        else:
            for x in ("keys", "counts"):
                store.delete_file(f"{path}.{x}")

    made = c.store(spread.mapInArrow(write, "low bigint, pairs bigint, path string, b array<bigint>, best array<bigint>"), "shards")
    return made.selectExpr("low", "pairs", f"'{folder}/' || path as path", "b", "best")


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _mapped(path: str, size: int) -> np.ndarray:
    """An int64 file, mapped into memory."""
    store, at = _filesystem(path)
    if isinstance(store, fs.LocalFileSystem):
        return np.asarray(np.memmap(at, np.int64, "r", shape=(size,)))
    with tempfile.TemporaryFile() as copy, store.open_input_stream(at) as source:
        while block := source.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.asarray(np.memmap(copy, np.int64, "r", shape=(size,)))  # stays mapped when the file is gone


class Counts:
    """Counts of packed keys, looked up in the shards that hold them."""

    def __init__(self, table: list[tuple[int, int, str]]) -> None:
        self.table = sorted(table)
        self.low = np.array([x[0] for x in self.table], np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        shard = np.searchsorted(self.low, keys, side="right") - 1
        for i in np.unique(shard).tolist():
            if i not in self.open:
                _, size, path = self.table[i]
                self.open[i] = _mapped(f"{path}.keys", size), _mapped(f"{path}.counts", size)
            held, n = self.open[i]
            mine = np.flatnonzero(shard == i)
            out[mine] = n[np.searchsorted(held, keys[mine])]
        return out


def align(docs: DataFrame, a_ranks: str = A_RANKS, b_model: str = B_MODEL, groups: Column | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row of docs.

    n_best: links whose count is the highest of their B id; count_sum: over the links, how often each pair is linked.
    groups: as text, or what a column makes of that text before it is written.
    """
    made = encoded(docs, a_ranks, b_model).withColumn("groups", F.col("groups") if groups is None else groups)
    links = c.store(made, "links", compression="zstd")
    table = shards(pair_counts(links)).collect()  # a row a shard, a number a B id
    best = np.zeros(1 + max((i for r in table for i in r.b), default=0), np.int64)
    for r in table:
        np.maximum.at(best, np.array(r.b, np.int64), np.array(r.best, np.int64))
    where = [(r.low, r.pairs, r.path) for r in table]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(where)
        for part in _slices(batches):
            keys, sizes = _flat(part.column("keys"))
            key, at = np.unique(keys, return_inverse=True)
            n = counts[key]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            n_best = np.bincount(owner[(n == best[key >> 32])[at]], minlength=len(sizes))
            total = np.zeros(len(sizes), np.int64)
            np.add.at(total, owner, n[at])
            held = pa.array(sizes)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("doc_id", "n_a", "n_b")), held, held, pa.array(n_best), pa.array(total), part.column("groups")], NAMES)

    kind = dict(links.dtypes)["doc_id"]
    return links.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} bigint" for n in NAMES[1:-1]), "groups string"]))


def op12_pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return align(c.read(spark, sf_dir, "documents"), groups=digest).withColumnRenamed("groups", "groups_sha256")
