"""Language identification by word-first backoff.

Training counts, over all labelled training texts, the words and the character n-grams (1 to 5, with word
ends marked) of each language. A word is known if it is at least WORD_SHARE of the words of some language, an n-gram
if it is at least GRAM_SHARE of the n-grams of its length; what is known has its true count in every language.
A text's known words are scored by their log frequency in each language; an unseen word by the longest of its
n-grams that are known: all of one length, or else the next shorter. The language with the largest sum wins;
the score is its share of the likelihood over at most CALIBRATED words.

The shares define the model at every size of the corpus and bound it: at most 1 / WORD_SHARE words and
LONGEST / GRAM_SHARE n-grams for each language, so it goes to the driver and the executors whole.

Letters are those of Unicode with their combining marks; digits, fractions and superscripts aren't letters.
Null text, or no letters: language ``und``, score 0. No training text at all: ``und``. Ties go to the first
language by name. Repeated rows give one row each. A null doc_id is never learned from, so it counts as held out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

LONGEST = 5
#: Least share of a known word among the words of a language, and of a known n-gram among those of its length.
WORD_SHARE, GRAM_SHARE = 1e-6, 1e-5
CALIBRATED = 40
#: Words that a task counts or remembers before it flushes.
HELD = 400_000
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def letters(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace").lower()
    return [w] if w.isalpha() else _LETTERS.findall(w)


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n = 0, gram = word, times)."""
    held: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, raw in held.items():
            words: dict[str, int] = {}
            for w, k in raw.items():
                for x in letters(w):
                    words[x] = words.get(x, 0) + k
            yield _entries(lang, 0, words)
        held.clear()

    for batch in batches:
        for t, lang in zip(c.raw(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(t.split())
        if sum(map(len, held.values())) > HELD:
            yield from flush()
    yield from flush()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, times) of the n-grams of counted words."""
    held: dict[tuple[str, int], dict[str, int]] = {}
    for batch in batches:
        for lang, word, k in zip(*(batch.column(x).to_pylist() for x in ("lang", "gram", "times")), strict=True):
            for n in range(1, LONGEST + 1):
                into = held.setdefault((lang, n), {})
                for g in grams(word, n):
                    into[g] = into.get(g, 0) + k
        if sum(map(len, held.values())) > HELD:
            yield from (_entries(*at, got) for at, got in held.items())
            held = {}
    yield from (_entries(*at, got) for at, got in held.items())


def _entries(lang: str, n: int, got: dict[str, int]) -> pa.RecordBatch:
    size = len(got)
    return pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([n] * size, pa.int32()), pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], ["lang", "n", "gram", "times"])


def train(docs: DataFrame) -> dict:
    """docs: (text, lang). The model: languages, and log frequencies of words and n-grams in each."""
    c.small_batches(docs.sparkSession)
    rows = docs.select("text", "lang").where("text is not null and lang is not null")
    entry, total_of = "lang string, n int, gram string, times bigint", F.sum("times").alias("times")
    words = c.store(rows.mapInArrow(_count_words, entry).groupBy("lang", "n", "gram").agg(total_of), "words")
    counted = words.unionByName(c.store(words.mapInArrow(_count_grams, entry).groupBy("lang", "n", "gram").agg(total_of), "grams"))
    sizes = counted.groupBy("lang", "n").agg(total_of).collect()
    langs = sorted({r.lang for r in sizes})
    total = {(r.lang, r.n): r.times for r in sizes}
    # one row an entry, with its count in every language, if it is known
    share = F.element_at(F.create_map(*(F.lit(x) for (lang, n), t in sorted(total.items()) for x in (f"{lang} {n}", float(t)))), F.concat_ws(" ", "lang", "n")) if total else F.lit(1.0)
    least = F.when(F.col("n") == 0, WORD_SHARE).otherwise(GRAM_SHARE)
    entries = (
        counted.withColumn("known", F.col("times") >= least * share).groupBy("n", "gram")
        .agg(F.bool_or("known").alias("known"), F.map_from_entries(F.collect_list(F.struct("lang", "times"))).alias("counts")).where("known")
    )
    size = [0] * (LONGEST + 1)
    table: list[dict] = [{} for _ in range(LONGEST + 1)]
    for r in entries.select("n", "gram", "counts").toLocalIterator():
        table[r.n][r.gram] = [r.counts.get(lang, 0) for lang in langs]
        size[r.n] += 1
    sums = [np.array([total.get((lang, n), 0) for lang in langs], float) + 0.5 * max(1, size[n]) for n in range(LONGEST + 1)]
    model: dict = {"langs": langs, "at": [], "logs": []}
    for n in range(LONGEST + 1):
        mine = sorted(table[n])
        counts = np.array([table[n][g] for g in mine], float).reshape(len(mine), len(langs))
        model["at"].append(dict(zip(mine, range(len(mine)), strict=True)))
        model["logs"].append(np.log((counts + 0.5) / sums[n]))
    return model


class Scorer:
    def __init__(self, model: dict) -> None:
        self.model, self.zero = model, (0.0,) * len(model["langs"])
        self.logs = [[tuple(x) for x in rows.tolist()] for rows in model["logs"]]
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(self.zero)))
        self.n = np.zeros(0, np.int64)

    def word(self, w: str) -> tuple[float, ...]:
        at, logs = self.model["at"], self.logs
        if w in at[0]:
            return logs[0][at[0][w]]
        for n in range(LONGEST, 0, -1):
            known = [logs[n][at[n][g]] for g in grams(w, n) if g in at[n]]
            if known:
                return tuple(sum(x) / len(known) for x in zip(*known, strict=True))
        return self.zero

    def several(self, parts: list[str]) -> tuple[float, ...]:
        return tuple(map(sum, zip(self.zero, *map(self.word, parts), strict=True)))

    def __call__(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        words, counts = c.split_words(texts)
        if len(self.at) > HELD:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        parts = [letters(w) for w in new]
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.n = np.concatenate([self.n, np.fromiter(map(len, parts), np.int64, len(parts))])
        self.sums = np.concatenate([self.sums, np.array([self.word(p[0]) if len(p) == 1 else self.several(p) for p in parts]).reshape(len(parts), len(self.zero))])
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(counts)), counts)
        n = np.bincount(owner, weights=self.n[at], minlength=len(counts))
        langs = self.model["langs"]
        if not langs:
            return ["und"] * len(counts), np.zeros(len(counts))
        sums = np.stack([np.bincount(owner, weights=self.sums[at, k], minlength=len(counts)) for k in range(len(langs))], axis=1)
        best = sums.argmax(axis=1)
        z = sums / np.maximum(n, 1)[:, None] * np.minimum(n, CALIBRATED)[:, None]
        share = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
        return [langs[b] if k else "und" for b, k in zip(best, n, strict=True)], np.where(n > 0, share, 0.0)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorers: list[Scorer] = []

    def fn(texts: list[bytes | None]) -> dict:
        if not scorers:
            scorers.append(Scorer(shared.value))
        langs, score = scorers[0](texts)
        return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(score, pa.float64())}

    return c.map_texts(docs, fn, "lang_pred string, score double")


def op3_word_first_backoff(spark, sf_dir: str) -> DataFrame:
    docs = c.read(spark, sf_dir, "documents")
    model = train(docs.where(c.fold("doc_id") != 0))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(c.fold("doc_id") == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")
