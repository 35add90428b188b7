"""Substring dedup by relative Lempel-Ziv parsing against a corpus index in blocks.

The reference is the whole corpus; a document is parsed against the documents with smaller ids.

* Index: every window of 13 words is an anchor with its place (document, first word). A run of windows with one
  minimizer (the smallest hash of a 4-word gram in the window) goes to the block of that minimizer, so a block
  holds all occurrences of its anchors. The number of blocks follows the bytes of the input (BLOCK_BYTES
  each), up to MOST_BLOCKS. Grams that are frequent in a sample of SAMPLE documents are the last to be chosen as
  minimizers, so a stock phrase doesn't bring all the windows around it to one block; the sample decides on
  blocks, never on results.
* Lookup: in its block an anchor finds its first occurrence in a document with a smaller id: a seed
  (place in the document, reference document, place in the reference).
* Factors: seeds of a document that lie on one diagonal (same reference document, same distance of places) and
  whose words touch or overlap are one factor: its words are the reference's words from one place on.
* Parse: greedily, from the first word on, the factor that reaches furthest is taken. Where it ends, the windows
  that straddle the boundary have been looked up like any other, so the next factor may begin before the
  boundary; no duplicate window is lost between two factors. Factors (all have 13 words or more) are the
  duplicate spans.

Before the shuffle each chunk of documents parses its own repeats: a window that also starts in a smaller id
of the chunk is a seed already and isn't sent, so a passage in a third of all rows costs a block one anchor a chunk.

Windows are compared by 80 bits of hash after words were hashed to 64; equal windows meet in one block only. n
different windows give about n * n / 2 / 2**80 / blocks false hits: 1e-9 for the 5e9 windows of 30 GB, 4e-3 for 100 TB.

Null text: no words. Texts under 13 words lose nothing. Null doc_id: keeps its text and is no reference.
Repeated rows of one doc_id have equal ids, so none is a reference for another; where a doc_id repeats, rows
are told apart by a hash of their text, so each text loses its own spans.

An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

WINDOW, GRAM = 13, 4
#: Text bytes of which a map task parses repeats before the shuffle.
MAP_BYTES = 4 << 20
#: Documents of the sample for frequent grams, least occurrences in a task, and most such grams.
SAMPLE, OFTEN, MOST_GRAMS = 20_000, 3, 1 << 16
#: Anchor bytes of a block, anchor bytes for each byte of text (measured: 1.7 to 2), and most blocks.
BLOCK_BYTES, ANCHOR_SHARE, MOST_BLOCKS = 16 << 20, 2, 1 << 15

_SALT = c.U64(0xD6E8FEB86659FD93)
_ANCHORS = "block int, docs binary, marks binary, counts binary, at binary, size binary, key binary, more binary"
_SEEDS = "shard int, docs binary, marks binary, counts binary, at binary, ref binary, ref_at binary"
_FACTORS = "doc_id bigint, mark bigint, starts array<int>, sizes array<int>, refs array<bigint>, ref_starts array<int>"


def _row_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each run of ``width`` elements."""
    step, done = x, 1
    while done < width:
        by = min(done, width - done)
        step, done = np.minimum(step[: len(step) - by], step[by:]), done + by
    return step


def windows(texts: list[bytes | None], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: row of its text, first word, minimizer, and two hashes."""
    words, counts = c.split_words(texts)
    h = c.word_hashes(words)
    owner, at = c.places(counts)
    full = c.window_hashes(h, WINDOW)
    ok = np.flatnonzero(at[: len(full)] + WINDOW <= counts[owner[: len(full)]])
    if not len(ok):
        return owner[ok], at[ok], full[ok], full[ok], full[ok]
    grams = c.window_hashes(h, GRAM)
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams
        grams = grams >> c.U64(1) | often.astype(c.U64) << c.U64(63)
    return owner[ok], at[ok], _row_min(grams, WINDOW - GRAM + 1)[ok], full[ok], c.window_hashes(c.mix(h ^ _SALT), WINDOW)[ok]


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams that occur OFTEN times or more in a chunk, with their number."""
    for batch in batches:
        for part in c.chunks(batch):
            words, counts = c.split_words(c.raw(part.column("text")))
            h = c.window_hashes(c.word_hashes(words), GRAM)
            owner, at = c.places(counts)
            gram, times = np.unique(h[at[: len(h)] + GRAM <= counts[owner[: len(h)]]], return_counts=True)
            kept = times >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(gram[kept].view(np.int64)), pa.array(times[kept].astype(np.int64))], ["gram", "times"])


def frequent_grams(texts: DataFrame, rows: int) -> np.ndarray:
    """Sorted hashes of at most MOST_GRAMS grams that are frequent in the sample."""
    share = max(1, -(-rows // SAMPLE))
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    found = sample.mapInArrow(_often, "gram bigint, times bigint").groupBy("gram").agg(F.sum("times").alias("times"))
    got = found.orderBy(F.desc("times"), "gram").limit(MOST_GRAMS).select("gram").collect()
    return np.sort(np.array([r.gram for r in got], np.int64).view(c.U64))


def _planes(x: np.ndarray) -> bytes:
    """The numbers byte by byte: all lowest bytes first. High bytes are mostly zero and compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _pack(
    target: np.ndarray, owner: np.ndarray, ids: np.ndarray, marks: np.ndarray, columns: list[np.ndarray], names: str,
    first: np.ndarray | None = None, size: np.ndarray | None = None, wide: tuple[np.ndarray, ...] = (),
) -> pa.RecordBatch:
    """One row for each target with its elements, which are in the order of their owners.

    wide: arrays of which each element has those from ``first`` on, ``size`` of them.
    """
    order = np.argsort(target, kind="stable")
    target, owner = target[order], owner[order]
    ends = np.append(0, np.cumsum(size[order])) if wide else None
    if wide:
        run, inside = c.places(size[order])
        wide = tuple(x[first[order][run] + inside] for x in wide)
    heads = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
    out: list[list] = [[] for _ in range(4 + len(columns) + len(wide))]
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(target)]):
        mine = owner[a:b]
        starts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        who = mine[starts]
        row = [int(target[a]), _planes(ids[who]), _planes(marks[who]), _planes(np.diff(np.append(starts, b - a)).astype(np.uint32))]
        row += [_planes(x[order[a:b]]) for x in columns] + [_planes(x[ends[a] : ends[b]]) for x in wide]
        for into, x in zip(out, row, strict=True):
            into.append(x)
    kinds = [pa.int32()] + [pa.binary()] * (3 + len(columns) + len(wide))
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], [f.split()[0] for f in names.split(", ")])


def _unpack(table: pa.Table, kinds: dict[str, type]) -> tuple[np.ndarray, ...]:
    """Document, mark and the other numbers of every element of the rows."""
    parts: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], *([np.zeros(0, k)] for k in kinds.values())]
    for row in table.select(["docs", "marks", "counts", *kinds]).to_batches(max_chunksize=1):
        got = {k: row.column(k)[0].as_py() for k in row.schema.names}
        times = _numbers(got["counts"], np.uint32)
        parts[0].append(np.repeat(_numbers(got["docs"], np.int64), times))
        parts[1].append(np.repeat(_numbers(got["marks"], np.int64), times))
        for into, (name, kind) in zip(parts[2:], kinds.items(), strict=True):
            into.append(_numbers(got[name], kind))
    return tuple(map(np.concatenate, parts))


def _seeds(doc: np.ndarray, at: np.ndarray, key: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors that also start in a smaller id, and for each of them the first occurrence among the given ones."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = order[np.append(False, same) | np.append(same, False)] if len(order) else order
    twice = twice[np.lexsort((at[twice], doc[twice], more[twice], key[twice]))]
    new = np.ones(len(twice), bool)
    new[1:] = (key[twice][1:] != key[twice][:-1]) | (more[twice][1:] != more[twice][:-1])
    first = twice[new][np.cumsum(new) - 1]
    later = doc[twice] > doc[first]
    return twice[later], first[later]


def _found(hit: np.ndarray, ref: np.ndarray, shards: int, doc: np.ndarray, mark: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Seeds as rows for the shards of their documents."""
    order = np.lexsort((at[hit], mark[hit], doc[hit]))
    hit, ref = hit[order], ref[order]
    new = np.ones(len(hit), bool)
    new[1:] = (doc[hit][1:] != doc[hit][:-1]) | (mark[hit][1:] != mark[hit][:-1])
    heads = hit[new]
    shard = (c.mix(doc[hit].view(c.U64)) % c.U64(shards)).astype(np.int32)
    return _pack(shard, np.cumsum(new) - 1, doc[heads], mark[heads], [at[hit].astype(np.uint32), doc[ref], at[ref].astype(np.uint32)], _SEEDS)


def _chunk(part: pa.Table, blocks: int, frequent: np.ndarray) -> list[pa.RecordBatch]:
    """Anchors of a chunk by block. Seeds inside the chunk have block -1 - shard, and their references as key and more."""
    ids, marks = part.column("doc_id").to_numpy(), part.column("mark").to_numpy()
    owner, at, least, key, more = windows(c.raw(part.column("text").combine_chunks()), frequent)
    doc, check = ids[owner], more.astype(np.uint16)
    hit, ref = _seeds(doc, at, key, check)
    own = _found(hit, ref, blocks, doc, marks[owner], at)
    rest = np.ones(len(owner), bool)
    rest[hit] = False
    owner, at, least, key, check = owner[rest], at[rest], least[rest], key[rest], check[rest]
    new = np.ones(len(at), bool)  # of runs, of at most 250 windows
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (at[1:] % 250 == 0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at))).astype(np.uint8)
    block = (c.mix(least[first]) % c.U64(blocks)).astype(np.int32)
    sent = _pack(block, owner[first], ids, marks, [at[first].astype(np.uint32), size], _ANCHORS, first, size.astype(np.int64), (key, check))
    columns = dict(zip(own.schema.names, own.columns, strict=True))
    blank = pa.nulls(len(own), pa.binary())
    own = pa.RecordBatch.from_arrays([pa.array(-1 - columns["shard"].to_numpy()), *(columns[k] for k in ("docs", "marks", "counts", "at")), blank, columns["ref"], columns["ref_at"]], sent.schema.names)
    return [sent, own]


def _map(blocks: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in c.chunks(batch):
                held.append(part)
                size += part.nbytes
                if size >= MAP_BYTES:
                    yield from _chunk(pa.Table.from_batches(held), blocks, frequent)
                    held, size = [], 0
        if held:
            yield from _chunk(pa.Table.from_batches(held), blocks, frequent)

    return run


def _lookup(table: pa.Table, shards: int) -> pa.Table:
    """Seeds of one block's anchors; seeds found before the shuffle pass."""
    block = table.column("block")[0].as_py()
    if block < 0:
        rows = table.select(["docs", "marks", "counts", "at", "key", "more"])
        return pa.table([pa.array([-1 - block] * len(rows), pa.int32()), *rows.columns], [f.split()[0] for f in _SEEDS.split(", ")])
    doc, mark, start, size = _unpack(table, {"at": np.uint32, "size": np.uint8})
    key, more = (np.concatenate([_numbers(x.as_py(), kind) for x in table.column(name)]) for name, kind in (("key", c.U64), ("more", np.uint16)))
    run, inside = c.places(size.astype(np.int64))
    doc, mark, at = doc[run], mark[run], start[run] + inside
    return pa.Table.from_batches([_found(*_seeds(doc, at, key, more), shards, doc, mark, at)])


def greedy(factors: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The parse: of (start, end, reference, place) sorted by start, those taken. They cover what all cover."""
    out, i, reached = [], 0, -1
    while i < len(factors):
        reached = max(reached, factors[i][0])
        best = None
        while i < len(factors) and factors[i][0] <= reached:
            if factors[i][1] > (best[1] if best else reached):
                best = factors[i]
            i += 1
        if best:
            out.append(best)
            reached = best[1]
    return out


def _parse(table: pa.Table) -> pa.Table:
    """The factors taken for each document of a shard."""
    doc, mark, at, ref, ref_at = _unpack(table, {"at": np.uint32, "ref": np.int64, "ref_at": np.uint32})
    at, ref_at = at.astype(np.int64), ref_at.astype(np.int64)
    order = np.lexsort((at, at - ref_at, ref, mark, doc))
    doc, mark, at, ref, ref_at = (x[order] for x in (doc, mark, at, ref, ref_at))
    new = np.ones(len(doc), bool)
    for x in (doc, mark, ref, at - ref_at):
        new[1:] &= x[1:] == x[:-1]
    new[1:] = ~(new[1:] & (at[1:] - at[:-1] <= WINDOW))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    start, end = at[first], at[last] + WINDOW
    order = np.lexsort((-end, start, mark[first], doc[first]))
    rows: dict[tuple[int, int], list] = {}
    for d, m, *factor in zip(*(x[order].tolist() for x in (doc[first], mark[first], start, end, ref[first], ref_at[first])), strict=True):
        rows.setdefault((d, m), []).append(tuple(factor))
    parsed = [greedy(f) for f in rows.values()]
    lists = [[[f[0] for f in p] for p in parsed], [[f[1] - f[0] for f in p] for p in parsed], [[f[2] for f in p] for p in parsed], [[f[3] for f in p] for p in parsed]]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    columns = [[k[0] for k in rows], [k[1] for k in rows], *lists]
    return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _FACTORS.split(", ")])


def marked(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(doc_id, text, mark), the number of blocks and of documents. The mark tells texts of one doc_id apart; 0 where ids don't repeat."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("doc_id").alias("rows")).agg(F.sum("bytes"), F.max("rows"), F.count("*")).first()
    blocks = min(MOST_BLOCKS, 1 + (size[0] or 0) * ANCHOR_SHARE // BLOCK_BYTES)
    repeats = (size[1] or 0) > 1
    return docs.withColumn("mark", F.xxhash64("text") if repeats else F.lit(0).cast("bigint")), blocks, size[2]


def _factors(docs: DataFrame, blocks: int, rows: int) -> DataFrame:
    c.small_batches(docs.sparkSession)
    texts = docs.where("doc_id is not null and text is not null")
    seeds = texts.mapInArrow(_map(blocks, frequent_grams(texts, rows)), _ANCHORS).repartition(blocks, "block").groupBy("block").applyInArrow(lambda t: _lookup(t, blocks), _SEEDS)
    return seeds.repartition(blocks, "shard").groupBy("shard").applyInArrow(_parse, _FACTORS)


def factors(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, start, size, ref, ref_start): words start to start + size - 1 of the document are the reference's
    words from ref_start on. The greedy parse of each document; documents without factors give no row."""
    rows = _factors(*marked(docs))
    zipped = F.arrays_zip("starts", "sizes", "refs", "ref_starts")
    return rows.select("doc_id", "mark", F.inline(zipped)).toDF("doc_id", "mark", "start", "size", "ref", "ref_start")


def _keep(texts: list[bytes | None], starts: list, sizes: list) -> Iterator[tuple[int, int, list[bytes]]]:
    for t, a, z in zip(texts, starts, sizes, strict=True):
        w = t.split() if t else []
        if not a:
            yield len(w), 0, w
            continue
        gone = np.zeros(len(w) + 1, np.int32)
        a, z = np.array(a), np.array(z)
        np.add.at(gone, a, 1)
        np.add.at(gone, a + z, -1)
        gone = np.cumsum(gone)[:-1] > 0
        yield len(w), int(gone.sum()), [x for x, g in zip(w, gone.tolist(), strict=True) if not g]


def without_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by spaces as text."""
    docs, blocks, rows = marked(docs)
    found = _factors(docs, blocks, rows).select("doc_id", "mark", "starts", "sizes")
    joined = docs.join(found, ["doc_id", "mark"], "left").select("doc_id", "text", "starts", "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in c.chunks(batch):
                rows = list(_keep(c.raw(part.column("text")), part.column("starts").to_pylist(), part.column("sizes").to_pylist()))
                kept = [b" ".join(r[2]) for r in rows]
                cols = [part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols, names = [*cols, pa.array(kept, pa.binary()).cast(pa.string())], [*names, "text"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", text string" * with_text)


def op10_relative_lz(spark, sf_dir: str) -> DataFrame:
    return without_repeats(c.read(spark, sf_dir, "documents"), with_text=False)
