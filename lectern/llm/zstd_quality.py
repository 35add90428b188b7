"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A text is cut into blocks; each
block is compressed with either dictionary, so that the dictionary and not the text's own past does the
predicting. The difference of the two total sizes over their sum is the measure; a logistic curve, fitted to
other labelled texts, turns it into the probability of label 1.

Fitting takes a bounded sample of labelled training rows: at most SAMPLE texts of each label, of at most
SAMPLE_CHARS characters, chosen by a hash of the id; two thirds build dictionaries, one third the curve.
Scoring reads every whole text. Empty or null text scores the share of label 1 in the curve's sample.
Without labelled rows of both kinds every score is 0.5. A null doc_id is never in the
sample, so it counts as held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SAMPLE, SAMPLE_CHARS = 1500, 20_000
DICTIONARY, BLOCK, LEVEL = 64 << 10, 512, 3
THRESHOLD = 0.3


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


class Sizes:
    """Compressed sizes of texts under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        kinds = [zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT) for d in (good, bad)]
        for k in kinds:
            k.precompute_compress(level=LEVEL)
        options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.by = [zstd.ZstdCompressor(level=LEVEL, dict_data=k, **options).compress for k in kinds]

    def __call__(self, text: bytes) -> float:
        good, bad = (sum(len(f(b)) for b in blocks(text)) for f in self.by)
        return (bad - good) / (bad + good)


def dictionary(texts: list[bytes]) -> bytes:
    """Blocks from all over the sample, evenly, up to the size of a dictionary."""
    every = [b for t in texts for b in blocks(t)]
    step = max(1, len(every) * BLOCK // DICTIONARY)
    return b"".join(every[::step])[:DICTIONARY] or b"\0" * 8


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the curve by Newton's method with a small ridge."""
    w, z = np.zeros(2), np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-6])
        w = w + np.linalg.solve(h, z.T @ (y - p) - np.array([1e-3, 1e-6]) * w)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """docs: (doc_id, text), labels: (doc_id, quality); both may hold training rows only."""
    own = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    order = F.xxhash64("doc_id")
    texts = docs.select("doc_id", "text").where(f"text is not null and length(text) between 1 and {SAMPLE_CHARS}")
    sample: dict[int, list[bytes]] = {}
    for y in (0, 1):
        # ids first: twice the sample, as some labelled documents are missing or long
        ids = own.where(F.col("y") == y).orderBy(order, "doc_id").limit(4 * SAMPLE)
        rows = texts.join(F.broadcast(ids), "doc_id").orderBy(order, "doc_id").limit(SAMPLE).collect()
        sample[y] = [r.text.encode() for r in rows]
    if min(map(len, sample.values())) < 3:
        return None
    good, bad = (dictionary([t for i, t in enumerate(sample[y]) if i % 3]) for y in (1, 0))
    sizes = Sizes(good, bad)
    x = [np.array([sizes(t) for t in sample[y][::3]]) for y in (0, 1)]
    # the labels' shares in the whole training set weigh the curve's offset
    share = own.join(docs.select("doc_id"), "doc_id", "left_semi").agg(F.avg("y")).first()[0]
    scale = float(np.std(np.concatenate(x))) or 1.0
    slope, offset = logistic(np.concatenate(x) / scale, np.repeat([0.0, 1.0], [len(x[0]), len(x[1])]))
    prior = np.log(share / (1 - share)) - np.log(len(x[1]) / len(x[0]))
    return {"good": good, "bad": bad, "slope": slope / scale, "offset": offset + float(prior), "share": float(share)}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list[Sizes] = []

    def fn(texts: list[bytes | None]) -> dict:
        m = shared.value
        if m is None:
            return {"score": pa.array([0.5] * len(texts))}
        if not made:
            made.append(Sizes(m["good"], m["bad"]))
        p = [1 / (1 + np.exp(-np.clip(m["slope"] * made[0](t) + m["offset"], -30, 30))) if t else m["share"] for t in texts]
        return {"score": pa.array(p, pa.float64())}

    return c.map_texts(docs, fn, "score double")


def op8_zstd_dictionaries(spark, sf_dir: str) -> DataFrame:
    docs, labels = c.read(spark, sf_dir, "documents"), c.read(spark, sf_dir, "labels")
    training = c.fold("doc_id") != 0
    out = score(docs, fit(docs.where(training), labels.where(training)))
    return out.select("doc_id", F.coalesce(c.fold("doc_id") == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
