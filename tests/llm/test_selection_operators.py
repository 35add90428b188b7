"""Resampling, alignment and exact dedup against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import alignment, exact, importance

from .conftest import prose

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def small(t):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())


def plain_features(t, grams=1):
    w = WORDS.findall(small(t))
    return [b" ".join(w[i : i + n]) for n in range(1, grams + 1) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, grams=1, percent=10, min_words=20, buckets=10_000, seed=2024):
    at = lambda f: zlib.crc32(f) % buckets
    s, t = Counter(at(f) for _, x in rows for f in plain_features(x, grams)), Counter(at(f) for x in target for f in plain_features(x, grams))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out, able = [], []
    for i, x in rows:
        f = plain_features(x, grams)
        weight, score = sum(gain(at(g)) for g in f), None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(plain_features(x)) >= min_words:
                able.append((-score, i))
        out.append((i, len(f), weight, score))
    places = Counter()
    ranks = {}
    for place, key in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        ranks.setdefault(key, []).append(place)
    final = []
    for i, n, w, score in out:
        key = (-score, i) if score is not None else None
        final.append((i, n, w, score, ranks[key].pop(0) if ranks.get(key) else None))
        places[key] += 1
    return final


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("grams", [1, 3])
def test_resample(spark, grams):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 60), rng.choice(["aa", "bb"])) + rng.choice(["", " É漢字 x9", "!A-b_c"])) for i in range(120)] + [(7, "The same " * 20)] * 3 + [(500, None), (501, ""), (None, "a " * 30)]
    target = [prose(rng, 30, "bb") for _ in range(10)] + [None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = importance.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), grams=grams, percent=40)
    same(got.select("doc_id", "n_features", "weight", "score", "rank").collect(), plain_resample(rows, target, grams, 40))


def test_features_at_all_edges():
    """Texts end to end, words at both edges, sliced arrays, nulls, words longer than the automaton walks."""
    rng = random.Random(9)
    texts = [None, "", "abc", "def", "...", "x" * 47, "y" * 48, "z" * 49, "Q" * 1000 + " q", " lead", "trail ", "é", None, "Ünï漢字☃", "a\x00b\x7fc", *("".join(rng.choice("aZ09 .é\n_") for _ in range(rng.randint(0, 90))) for _ in range(300))]
    for kind in (pa.string(), pa.large_string()):
        array = pa.array(["drop me", *texts, "and me"], kind).slice(1, len(texts))
        for grams in (1, 2, 4):
            at, owner, n = importance.features(array, grams)
            want = [sorted(zlib.crc32(f) % 10_000 for f in plain_features(t, grams)) for t in texts]
            assert [sorted(at[owner == i].tolist()) for i in range(len(texts))] == want
            assert n.tolist() == [len(plain_features(t)) for t in texts]
    at, owner, n = importance.features(pa.array([], pa.string()))
    assert not len(at) and not len(n)


def test_resample_odd(odd_docs, spark):
    target = spark.createDataFrame([], "text string")
    got = importance.resample(odd_docs, target).collect()
    same([tuple(r) for r in got], plain_resample([(r.doc_id, r.text) for r in odd_docs.collect()], []))
    assert importance.resample(odd_docs.limit(0), target).count() == 0


def plain_alignment(rows):
    from tokenizers import Tokenizer

    a = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    a.encode_special_tokens = True
    T = alignment.Tokenizers(alignment.A_RANKS, alignment.B_MODEL)
    made, pairs = [], Counter()
    for i, t in rows:
        groups, links, n_a, n_b = [], [], 0, 0
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False).ids, T.b.encode(t)
            bx, by = [T.a_bytes[k] for k in x], [T.b_bytes[k] for k in y]
            if b"".join(bx) == b"".join(by) == (" " + t).encode():
                n_a, n_b = len(x), len(y)
                ends = [list(np.cumsum([len(k) for k in z])) for z in (bx, by)]
                u = v = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
                    groups.append((x[u:p], y[v:q]))
                    links.append((x[p - 1], y[q - 1]))
                    u, v = p, q
        pairs.update(links)
        made.append((i, n_a, n_b, groups, links))
    best = {}
    for (_, b), n in pairs.items():
        best[b] = max(best.get(b, 0), n)
    text = lambda g: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
    return [(i, n_a, n_b, len(g), len(k), sum(pairs[p] == best[p[1]] for p in k), sum(pairs[p] for p in k), text(g)) for i, n_a, n_b, g, k in made]


def texts_to_align():
    rng = random.Random(4)
    odd = ["", None, " ", "  two  spaces ", "x▁y z", "<|endoftext|> <s> <0x41>", "tabs\tand\nlines \n and\r\nmore", "é ﬁ 漢字 ☃ 🎥🎥", "it's they'll we're", "1234567 12 345", "=" * 300, "a" * 500, "a\x00b", "\u0085  x", "don 't  'll", "word.\n\nNext one", " a", "a ", "ha" * 300]
    alphabet = "ab .,'\n\t▁é漢0A-🎥"
    return [*odd, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(150)), *(prose(rng, 30) for _ in range(40))]


def test_alignment(spark, monkeypatch):
    rows = list(enumerate(texts_to_align())) + [(None, "one two"), (3, "one two"), (3, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_alignment(rows)
    assert any(r[1] for r in want) and any(r[7].count(",") for r in want)
    same(alignment.align(df).collect(), want)


def test_alignment_in_small_steps(monkeypatch):
    """Forgotten segments, merged partial counts and runs that go on over batches change nothing."""
    monkeypatch.setattr(alignment, "KEPT", 20)
    T = alignment.Tokenizers(alignment.A_RANKS, alignment.B_MODEL)
    assert T.cuts
    texts, kept, whole = texts_to_align(), alignment.Segments(T), alignment.Tokenizers(alignment.A_RANKS, alignment.B_MODEL)
    whole.cuts = False
    once = alignment.Segments(whole)
    for t in texts:
        raw = None if t is None else t.encode()
        (a, n), (b, m) = kept.learn([raw]), once.learn([raw])
        assert bool(n[0]) == bool(m[0])
        assert ";".join(kept.groups[i] for i in a) == ";".join(once.groups[i] for i in b)
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 50, 1000))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7]), pa.array(np.ones(len(keys[i : i + 7]), np.int64))], ["key", "n"]) for i in range(0, 1000, 7)]
    found = [np.concatenate(x) for x in zip(*alignment._runs(iter(batches)))]
    assert np.array_equal(found, np.unique(keys, return_counts=True))


def test_alignment_odd(odd_docs):
    same(alignment.align(odd_docs).collect(), plain_alignment([(r.doc_id, r.text) for r in odd_docs.collect()]))
    assert alignment.align(odd_docs.limit(0)).count() == 0


def plain_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    size, out, seen = Counter(norm), [], set()
    key = lambda i: (i is None, i or 0)
    least = {}
    for (i, _), t in zip(rows, norm):
        least[t] = min(least.get(t, (True, 1 << 62)), key(i))
    for (i, _), t in zip(rows, norm):
        first = key(i) == least[t] and t not in seen
        seen |= {t} if first else set()
        out.append((i, None if least[t][0] else least[t][1], size[t], first, hashlib.sha256(t.encode()).hexdigest()))
    return out


def exact_rows():
    rng = random.Random(6)
    some = [prose(rng, rng.randint(0, 30)) for _ in range(20)]
    rows = [(i, rng.choice(some).replace(" ", rng.choice([" ", "\n", " \t\r\n", "\x0b", "\x0c "]))) for i in range(200)]
    return [*rows, (300, None), (301, ""), (302, " "), (303, "\n"), (None, "alone"), (None, some[0]), (305, "a b"), (306, "a b"), (7, "x"), (7, "x"), (None, None), (None, "both"), (None, "both"), (400, "hot"), *[(1000 + i, "hot") for i in range(300)]]


@pytest.mark.parametrize("groups", [0, 1_000_000])
def test_exact(spark, groups):
    rows = exact_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(exact.exact_duplicates(df, groups=groups).collect(), plain_exact(rows))


@pytest.mark.parametrize("groups", [0, 1_000_000])
def test_exact_with_colliding_hashes(spark, groups):
    """A hash that many texts share is settled by the bytes of the texts."""
    rows = exact_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    weak = lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1).cast("binary")
    same(exact.exact_duplicates(df, weak, groups).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect(), plain_exact(rows))


def test_exact_odd(odd_docs):
    same(exact.exact_duplicates(odd_docs).collect(), plain_exact([(r.doc_id, r.text) for r in odd_docs.collect()]))
    assert exact.exact_duplicates(odd_docs.limit(0)).count() == 0
