"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its different 5-word shingles (A-Z lower-cased). The sketch is
filled in rounds: in round i < t every shingle falls into one hashed bin with value (i, hash); in round
t + i every shingle falls into bin i, so after 2t rounds every bin is filled. A bin of two sketches
agrees with probability equal to the Jaccard similarity, with the concentration of t independent draws.

Equal sets are one class. Among class representatives:

* Documents that agree on a band of the sketch meet. Only the smallest id of a bucket (its leader) is
  compared with the others, on full sets: as many comparisons as members, never all pairs of a group.
* What may be missed is a link of two members of which one is not linked to the leader. A leader's open
  members (those not linked to it) are compared with its other members: pair by pair where the leader has
  at most SMALL members, else in blocks of BLOCK open members by BLOCK members, each block a task of bounded
  size that counts intersections over one flat array and emits a spanning forest of the links it finds, so
  no more rows than members. Only groups of near copies with open members get there; the comparisons grow
  with open members times members, the rows with members.

The joins that carry sets are hinted to merge; small tables of links and ids are joined as Spark sees fit by size.

Null or blank text: empty set, linked with nothing. Null doc_id: own row, never linked, component_id null,
kept true. Repeated rows of one doc_id give one row each; where their texts differ, each
is linked by its own text. Under five words: the whole sequence is one shingle.

An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.relational import unused

from . import common as c

SHINGLE, BANDS, ROWS = 5, 32, 6
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Members of a leader that are settled pair by pair, and members in a block of a larger group.
SMALL, BLOCK = 32, 2048

_SEEDS = c.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=c.U64) * c.U64(0x9E3779B97F4A7C15))
_FULL = c.U64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted different shingle hashes."""
    words, counts = c.split_words(texts, lower=True)
    h = c.word_hashes(words)
    grams = c.window_hashes(h, size)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(grams[at : at + n - size + 1]))
        elif n:
            out.append(c.mix(c.window_hashes(h[at : at + n], n) + c.U64(n)))
        else:
            out.append(np.zeros(0, c.U64))
        at += n
    return out


def fast_sketch(sets: list[np.ndarray], bins: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``bins`` values per set; an empty set's row holds the filler value."""
    sketch = np.full((len(sets), bins), _FULL, c.U64)
    sizes = np.array([len(s) for s in sets], np.int64)
    live = np.flatnonzero(sizes)
    if not len(live):
        return sketch
    elements, owner = np.concatenate([sets[i] for i in live]), np.repeat(live, sizes[live])
    flat = sketch.reshape(-1)
    for i in range(2 * bins):
        h = c.mix(elements ^ _SEEDS[i])
        b = ((h >> c.U64(32)) * c.U64(bins) >> c.U64(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(flat, owner * bins + b, c.U64(i << 55) | (h >> c.U64(9)))
        open_ = (sketch[live] == _FULL).any(axis=1)
        if not open_.any():
            break
        if open_.sum() <= 0.8 * len(live):
            live = live[open_]
            keep = np.isin(owner, live)
            elements, owner = elements[keep], owner[keep]
    return sketch


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    x = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=c.U64), x.shape[:2]).copy()
    for k in range(rows):
        key = c.mix(key * c.U64(0x9E3779B97F4A7C15) + x[:, :, k])
    return key


def _sketches(texts: list[bytes | None]) -> dict:
    sets = shingle_sets(texts)
    keys = band_keys(fast_sketch(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    ids = _ids(sets)
    return {
        "n_shingles": pa.array(sizes), "set_a": pa.array(ids[:, 0]), "set_b": pa.array(ids[:, 1]),
        "bands": c.lists(keys[sizes > 0].reshape(-1).view(np.int64), np.where(sizes > 0, BANDS, 0), pa.int64()),
    }


def _ids(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits that stand for a set."""
    return np.array([(xxhash.xxh3_64_intdigest(b), xxhash.xxh64_intdigest(b)) for b in (s.tobytes() for s in sets)], c.U64).reshape(-1, 2).view(np.int64)


def _sets(texts: list[bytes | None]) -> dict:
    sets = shingle_sets(texts)
    ids = _ids(sets)
    return {"set_a": pa.array(ids[:, 0]), "set_b": pa.array(ids[:, 1]), "s": c.lists(np.concatenate([*sets, np.zeros(0, c.U64)]).view(np.int64), np.array([len(s) for s in sets]), pa.int64())}


def _judge(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds both sets and the size of their intersection to (lo, doc)."""
    a = sets.select("doc", F.col("s").alias("x"))
    b = sets.select(F.col("doc").alias("lo"), F.col("s").alias("l"))
    return pairs.join(a.hint("merge"), "doc").join(b.hint("merge"), "lo").withColumn("i", F.size(F.array_intersect("x", "l")))


def _linked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("linked", F.lit(100) * F.col("i") >= PERCENT * (F.size("x") + F.size("l") - F.col("i")))


def _compare(table: pa.Table) -> pa.Table:
    """(u, v) of links between a block of open members and a block of members, without those that close a circle."""
    table = table.combine_chunks()
    doc, is_open, tied = (table.column(k).to_numpy() for k in ("doc", "is_open", "linked"))
    sets = table.column("s").combine_chunks()
    first, flat = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy()
    other = np.flatnonzero(~is_open)
    sizes = np.diff(first)
    run, inside = c.places(sizes[other])
    _, at = np.unique(flat, return_inverse=True)
    elements = at[first[other][run] + inside]
    starts = np.cumsum(sizes[other]) - sizes[other]
    has = np.zeros(len(flat) + 1, bool)
    where = {d: i for i, d in enumerate(doc[other].tolist())}
    # tied members hang together by the leader; open members outside this block get labels of their own
    label = np.arange(len(other) + int(is_open.sum()))
    label[: len(other)][tied[other]] = len(label)
    out = []
    for k, x in enumerate(np.flatnonzero(is_open)):
        own = at[first[x] : first[x + 1]]
        has[own] = True
        both = np.add.reduceat(has[elements].astype(np.int64), starts) if len(elements) else np.zeros(0, np.int64)
        has[own] = False
        near = np.flatnonzero(100 * both >= PERCENT * (len(own) + sizes[other] - both))
        me = where.get(int(doc[x]), len(other) + k)
        for y in near:
            if label[y] != label[me] and doc[other[y]] != doc[x]:
                out.append((int(doc[x]), int(doc[other[y]])))
                label[label == label[y]] = label[me]
    return pa.table([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["u", "v"])


def _large(judged: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within groups of more than SMALL members, block by block."""
    rows = (
        judged.join(groups.where(F.col("n") > SMALL).select("lo", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "lo")
        .join(sets.hint("merge"), "doc").withColumn("own", F.pmod(F.xxhash64("doc"), "blocks"))
    )
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1))
    opens = rows.where(~F.col("linked")).select("lo", F.col("own").alias("bx"), every.alias("by"), "doc", F.lit(True).alias("is_open"), "linked", "s")
    others = rows.select("lo", every.alias("bx"), F.col("own").alias("by"), "doc", F.lit(False).alias("is_open"), "linked", "s")
    return opens.unionByName(others).groupBy("lo", "bx", "by").applyInArrow(_compare, "u bigint, v bigint")


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v) of verified links that connect all linked classes.

    classes: (doc = number of the class, rep = its smallest doc_id, n_shingles, set_a, set_b, bands); docs: (doc_id, text).
    """
    members = classes.select(F.explode("bands").alias("key"), "doc", F.col("n_shingles").alias("n"))
    leaders = members.groupBy("key").agg(F.count("*").alias("k"), F.min(F.struct("doc", "n")).alias("lo")).where("k > 1").select("key", "lo")
    # a pair whose sizes differ too much isn't linked, whatever it shares
    near = 100 * F.least("n", "lo.n") >= PERCENT * F.greatest("n", "lo.n")
    pairs = c.store(members.join(leaders.hint("merge"), "key").where("doc <> lo.doc").select(F.col("lo.doc").alias("lo"), "doc", near.alias("near")).distinct(), "pairs")
    wanted = pairs.where("near").select(F.explode(F.array("lo", "doc")).alias("doc")).distinct()
    # those of pairs to be judged, and all members of groups that may have open ones
    far = pairs.where("not near").select("lo").distinct()
    wanted = wanted.unionByName(pairs.join(far, "lo").select(F.explode(F.array("lo", "doc")).alias("doc"))).distinct()
    asked = classes.select("doc", "rep", "set_a", "set_b").join(wanted.hint("merge"), "doc")
    texts = docs.join(asked.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    found = c.map_texts(texts, _sets, "set_a bigint, set_b bigint, s array<bigint>").withColumnRenamed("doc_id", "rep")
    # rows of one doc_id with different texts are different classes; equal rows count once
    sets = c.store(found.join(asked.hint("merge"), ["rep", "set_a", "set_b"]).groupBy("doc").agg(F.first("s").alias("s")), "sets")
    compared = _linked(_judge(pairs.where("near").select("lo", "doc"), sets)).select("lo", "doc", "linked")
    judged = c.store(compared.unionByName(pairs.where("not near").select("lo", "doc", F.lit(False).alias("linked"))), "judged")
    groups = c.store(judged.groupBy("lo").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("far")).where("n > 1 and far > 0"), "groups")
    few = judged.join(groups.where(F.col("n") <= SMALL).select("lo"), "lo")
    other = few.select("lo", F.col("doc").alias("y"), F.col("linked").alias("y_linked"))
    single = (
        few.where(~F.col("linked")).join(other, "lo").where((F.col("doc") < F.col("y")) | (F.col("y_linked") & (F.col("doc") > F.col("y"))))
        .select(F.least("doc", "y").alias("lo"), F.greatest("doc", "y").alias("doc")).distinct()
    )
    as_edge = lambda x: x.where("linked").select(F.col("lo").alias("u"), F.col("doc").alias("v"))
    return as_edge(judged).unionByName(as_edge(_linked(_judge(single, sets)))).unionByName(_large(judged, groups, sets))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketches = c.store(c.map_texts(docs, _sketches, "n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"), "sketches")
    grouped = sketches.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r"))
    # numbered and then written, so that a class keeps its number
    numbered = grouped.select(F.monotonically_increasing_id().alias("doc"), "set_a", "set_b", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n_shingles"), F.col("r.bands").alias("bands"))
    classes = c.store(numbered, "classes")
    comp = c.store(c.components(links(classes, docs.where("doc_id is not null")), "near").select(F.col("node").alias("doc"), F.col("component").alias("group")), "components")
    named = classes.select("set_a", "set_b", "doc", "rep").join(comp, "doc", "left").withColumn("group", F.coalesce("group", "doc"))
    least = named.groupBy("group").agg(F.min("rep").alias("component"))
    by_class = named.join(least, "group").select("set_a", "set_b", "component")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return (
        sketches.drop("bands").join(by_class, ["set_a", "set_b"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op7_fast_sketch_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(c.read(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs of which the document stays, with all their columns; the others go.

    Equal rows of one doc_id stay together. An empty table gives no rows.
    """
    (name,) = unused(docs, "gone")
    gone = c.store(near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct(), "gone")
    return c.without(docs, gone, F.col("doc_id").cast("bigint") == F.col(name))
