"""Quality rules by tokeniser fertility, on top of word and line counts.

Each word of a text is encoded by two public vocabularies (one of pieces with byte fallback, one byte-level
BPE). Measured per text: characters per token in each, share of byte-fallback tokens, and entropy in bits: of
all the text's tokens, and the mean over blocks of BLOCK tokens, as many as cover the whole text. The first
grows with the text, the mean of blocks does not. A text is kept if the base rules hold and every measure
(entropy by blocks) lies in its band. Bands hold only for texts of MEASURED tokens or more; shorter texts are
judged by the base rules alone. Different words of a task are encoded once.

Bands come from the whole corpus: of the texts that pass the base rules, those of one script (that of most of
the letters), one value of ``lang`` (if there is such a column) and one class of length (log2 of the tokens)
give the quartiles of each measure, and the band reaches FENCE times their distance (at least SPREAD) beyond
them. A class of fewer than ENOUGH texts takes the band of its script and language over all lengths; if those
are too few as well, the fixed one in BANDS.

Null text: no words (all counts 0, measures null), base_failed true, kept false. A text without letters has
script 'none' and that script's band. Repeated rows give one row each; doc_id is passed through, null too.

An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTES = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
MEASURED = BLOCK = 30
#: Words of which the encoding is kept in a task.
KEPT = 120_000

#: script: lowest and highest code point of its letters (fixed values of the Unicode blocks)
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "indic": [(0x900, 0xDFF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF), (0x20000, 0x2FA1F)],
    "hangul": [(0xAC00, 0xD7AF), (0x1100, 0x11FF)],
    "other": [(0xE00, 0x10FF), (0x1200, 0x1CFF), (0x2C00, 0x2DFF), (0xA000, 0xABFF), (0x10000, 0x1FFFF)],
}
NAMES = [*SCRIPTS, "none"]
FENCE, ENOUGH = 2.0, 100
#: Rows of bands that are broadcast at most (some 150 bytes each).
MOST_BANDS = 100_000
#: Least distance of quartiles of each measure.
SPREAD = (0.1, 0.1, 0.05, 0.006)
#: script: (chars per piece, chars per byte-level token, byte-fallback share, entropy of blocks in bits per log2 of BLOCK)
BANDS = {
    "latin": ((1.5, 12.0), (1.2, 14.0), (0.0, 0.10), (0.85, 1.0)),
    "none": ((0.8, 12.0), (0.8, 14.0), (0.0, 0.30), (0.30, 1.0)),
}
#: Every other script: fewer characters a token, more fallback where the vocabulary lacks its characters.
OTHER_BAND = ((0.3, 12.0), (0.2, 14.0), (0.0, 1.0), (0.30, 1.0))


@lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    table = np.full(0x110000, len(NAMES) - 1, np.uint8)
    for i, blocks in enumerate(SCRIPTS.values()):
        for a, b in blocks:
            table[a : b + 1] = i
    table[[0xD7, 0xF7]] = len(NAMES) - 1
    return table


class Vocabularies:
    """Encodings of the words met by a task."""

    def __init__(self, pieces: str, byte_level: str) -> None:
        import sentencepiece
        import tiktoken

        self.sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.byte0 = next(i for i in range(self.sp.get_piece_size()) if self.sp.is_byte(i))
        with open(byte_level, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # words hold no spaces, so a pattern that takes the whole word with its leading space is enough
        self.bpe = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.n = np.zeros(0, np.int64)
        self.n2 = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        if len(self.at) > KEPT:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        text = [w.decode("utf-8", "replace") for w in new]
        ids = self.sp.encode(text, num_threads=1) if text else []
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.n = np.concatenate([self.n, np.fromiter(map(len, ids), np.int64, len(ids))])
        self.n2 = np.concatenate([self.n2, np.fromiter((len(self.bpe.encode_ordinary(" " + t)) for t in text), np.int64, len(text))])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int64)])

    def measure(self, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces, byte-level tokens, byte-fallback pieces, entropy and mean entropy of blocks of each text."""
        self.learn(words)
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(counts)), counts)
        n = self.n[at]
        run, inside = c.places(n)
        first = (np.cumsum(self.n) - self.n)[at]
        ids = self.ids[first[run] + inside]
        who = owner[run]
        total = np.bincount(who, minlength=len(counts))
        fallback = np.bincount(who[(ids >= self.byte0) & (ids < self.byte0 + 256)], minlength=len(counts))
        pair, times = np.unique(who << 20 | ids, return_counts=True)
        share = times / total[pair >> 20]
        entropy = np.bincount(pair >> 20, weights=-share * np.log2(share), minlength=len(counts))
        return total, np.bincount(owner, weights=self.n2[at], minlength=len(counts)).astype(np.int64), fallback, entropy, block_entropy(ids, total)


def block_entropy(ids: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Mean entropy in bits of blocks of BLOCK tokens that cover each text evenly; nan under BLOCK tokens."""
    blocks = np.where(total >= BLOCK, -(-total // BLOCK), 0)
    owner, at = c.places(blocks)
    starts = (np.cumsum(total) - total)[owner] + (total[owner] - BLOCK) * at // np.maximum(1, blocks[owner] - 1)
    rows = np.sort(ids[starts[:, None] + np.arange(BLOCK)], axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, rows.size))
    bits = np.log2(BLOCK) - np.bincount(owner[first // BLOCK], weights=times * np.log2(times), minlength=len(total)) / BLOCK / np.maximum(1, blocks)
    return np.where(blocks > 0, bits, np.nan)


def repeated_words(words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Words of each text in 8-word windows that the text holds twice or more."""
    h = c.window_hashes(c.word_hashes(words), REPEAT_WINDOW)
    owner, at = c.places(counts)
    ok = np.flatnonzero(at[: len(h)] + REPEAT_WINDOW <= counts[owner[: len(h)]])
    key = c.mix(h[ok] + owner[ok].astype(c.U64) * c.U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.append(False, same) | np.append(same, False) if len(key) else np.zeros(0, bool)
    edge = np.zeros(len(owner) + 1, np.int64)
    starts = ok[order[twice]]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + REPEAT_WINDOW, -1)
    return np.bincount(owner[np.cumsum(edge)[:-1] > 0], minlength=len(counts))


def measures(texts: list[bytes | None], vocabularies: Vocabularies) -> dict[str, np.ndarray]:
    words, counts = c.split_words(texts)
    whole = [t or b"" for t in texts]
    n_chars = np.array([len(t.translate(None, b" \t\n\x0b\x0c\r").decode("utf-8", "replace")) for t in whole], np.int64)
    symbols = np.array([len(t) - len(t.translate(None, b"#*$%&|<>")) for t in whole], np.int64)
    dup = []
    for t in whole:
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    repeat = repeated_words(words, counts)
    total, total2, fallback, entropy, by_block = vocabularies.measure(words, counts)
    table, script = _script_table(), []
    for t in whole:
        got = np.bincount(table[np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)], minlength=len(NAMES))[:-1]
        script.append(int(got.argmax()) if got.any() else len(NAMES) - 1)
    failed = (counts < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * counts)
    return {
        "n_words": counts, "word_chars": n_chars, "n_symbols": symbols, "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": repeat,
        "base_failed": failed, "n_tokens": total, "n_byte_level": total2, "n_fallback": fallback,
        "entropy_bits": np.where(total > 0, entropy, np.nan), "block_bits": by_block, "script": np.array(NAMES, object)[script],
    }


_FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_tokens bigint, n_byte_level bigint, n_fallback bigint, entropy_bits double, block_bits double, script string"
_RESULT = [f.split()[0] for f in _FIELDS.replace("n_tokens", "kept boolean, n_tokens", 1).split(", ")]


#: Text bytes that are measured at once.
CHUNK = 2 << 20


def _values(m: Callable[[str], Column]) -> list[Column]:
    """The measures that have bands, in the order of BANDS; m: a measured field by name."""
    return [F.try_divide(m("word_chars"), m("n_tokens")), F.try_divide(m("word_chars"), m("n_byte_level")), F.try_divide(m("n_fallback"), m("n_tokens")), m("block_bits") / float(np.log2(BLOCK))]


def judged(measured: DataFrame, m: Callable[[str], Column], lang: Column, verdict: str) -> DataFrame:
    """measured and the column ``verdict``: whether each text passes the base rules and the corpus's bands."""
    keys = [m("script").alias("_script"), F.coalesce(lang, F.lit("")).alias("_lang"), F.floor(F.log2(F.greatest(m("n_tokens"), F.lit(1)))).cast("int").alias("_size")]
    used = measured.where(~m("base_failed") & (m("n_tokens") >= MEASURED)).select(*keys, *(v.alias(f"_v{i}") for i, v in enumerate(_values(m))))
    quartiles = [F.percentile_approx(f"_v{i}", [0.25, 0.75], 10_000).alias(f"q{i}") for i in range(4)]

    def bands(level: str, *by: str) -> DataFrame:
        made = used.groupBy(*by).agg(F.count("*").alias("n"), *quartiles).where(F.col("n") >= ENOUGH)
        reach = [F.greatest(F.col(f"q{i}")[1] - F.col(f"q{i}")[0], F.lit(SPREAD[i])) * FENCE for i in range(4)]
        return made.select(*by, *(F.struct((F.col(f"q{i}")[0] - reach[i]).alias("low"), (F.col(f"q{i}")[1] + reach[i]).alias("high")).alias(f"_{level}{i}") for i in range(4)))

    # a row for each script, language and class of length: broadcast if they are as few as that, joined by shuffle else
    whole = measured.select("*", *keys)
    for level, by in (("a", ["_script", "_lang", "_size"]), ("b", ["_script", "_lang"])):
        made = c.store(bands(level, *by), "bands")
        whole = whole.join(F.broadcast(made) if made.count() <= MOST_BANDS else made, by, "left")
    inside = F.lit(True)
    for i, v in enumerate(_values(m)):
        fixed = lambda k: reduce(lambda x, s: x.when(m("script") == s, BANDS[s][i][k]), BANDS, F.when(F.lit(False), 0.0)).otherwise(OTHER_BAND[i][k])  # noqa: B023, E731
        low, high = F.coalesce(f"_a{i}.low", f"_b{i}.low", fixed(0)), F.coalesce(f"_a{i}.high", f"_b{i}.high", fixed(1))
        inside = inside & (v >= low - 1e-9) & (v <= high + 1e-9)
    return whole.select(*(F.col(f"`{k}`") for k in measured.columns), (~m("base_failed") & ((m("n_tokens") < MEASURED) | inside)).alias(verdict))


def quality(docs: DataFrame, pieces: str = PIECES, byte_level: str = BYTES) -> DataFrame:
    """doc_id, the counts, measures and verdict of each text."""
    made: list[Vocabularies] = []  # ends with the task

    def fn(texts: list[bytes | None]) -> dict:
        if not made:
            made.append(Vocabularies(pieces, byte_level))
        return {k: pa.array(v, from_pandas=True) for k, v in measures(texts, made[0]).items()}

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    rows = c.map_texts(docs.select("doc_id", "text", lang.alias("lang")), fn, _FIELDS, keep=("doc_id", "lang"), most=CHUNK)
    return judged(c.store(rows, "measured"), F.col, F.col("lang"), "kept").select("doc_id", *_RESULT)


def kept_only(docs: DataFrame, pieces: str = PIECES, byte_level: str = BYTES) -> DataFrame:
    """The rows of docs whose text passes, with all their columns; what passes the base rules is written once.

    Rows travel in a column of their own, so their names cannot clash with measures. An empty table gives no rows.
    """
    c.small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("m", T.StructType.fromDDL(_FIELDS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabularies(pieces, byte_level)
        for batch in batches:
            for part in c.chunks(batch, most=CHUNK):
                got = {k: pa.array(v, from_pandas=True) for k, v in measures(c.raw(part.column("text")), known).items()}
                row = pa.StructArray.from_arrays(part.columns, part.schema.names)
                whole = pa.RecordBatch.from_arrays([row, pa.StructArray.from_arrays(list(got.values()), list(got))], ["row", "m"])
                yield whole.filter(pc.invert(got["base_failed"]))

    measured = c.store(docs.mapInArrow(run, schema), "measured")
    lang = F.col("row.lang").cast("string") if "lang" in docs.columns else F.lit("")
    return judged(measured, lambda k: F.col(f"m.{k}"), lang, "verdict").where("verdict").select("row.*")


def op2_tokeniser_fertility(spark, sf_dir: str) -> DataFrame:
    return quality(c.read(spark, sf_dir, "documents"))
