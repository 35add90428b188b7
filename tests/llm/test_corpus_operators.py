"""Operators across documents against brute force, and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import near_dup, rlz, templates

from .conftest import prose


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    base = [prose(rng, 80) for _ in range(8)]
    shared = prose(rng, 55)
    rows = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = prose(rng, 1)
        if i % 9 == 0:
            words[10:10] = shared.split()
        rows.append((i, " ".join(words)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "a b c"), (n + 3, "a b c"), (n + 4, "a b"), (n + 4, "a b")]


def lower(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = lower(t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def check_components(spark, rows):
    want = plain_components(rows)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates(spark):
    check_components(spark, corpus())


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 3)
    check_components(spark, corpus(11))


def test_blocks_find_all_links():
    rng = random.Random(1)
    base, docs = list(range(200)), []
    for _ in range(50):
        s = set(base)
        for _ in range(rng.randint(0, 30)):
            s.discard(rng.choice(base))
            s.add(rng.randint(1000, 1060))
        docs.append(sorted(s))
    import pyarrow as pa

    like = lambda a, b: 100 * len(set(a) & set(b)) >= 85 * len(set(a) | set(b))
    tied = [like(base, d) for d in docs]
    rows = [(i, True) for i in range(50) if not tied[i]] + [(i, False) for i in range(50)]
    table = pa.table([pa.array([i for i, _ in rows], pa.int64()), pa.array([o for _, o in rows]), pa.array([tied[i] for i, _ in rows]), pa.array([docs[i] for i, _ in rows], pa.list_(pa.int64()))], ["doc", "is_open", "linked", "s"])
    found = [(e["u"], e["v"]) for e in near_dup._compare(table).to_pylist()]

    def parts(edges):
        up = list(range(51))
        for a, b in edges:
            x, y = up[a], up[b]
            up = [y if u == x else u for u in up]
        return [up.index(u) for u in up]

    star = [(50, i) for i in range(50) if tied[i]]
    assert parts(star + found) == parts(star + [(i, j) for i in range(50) for j in range(i) if like(docs[i], docs[j])])


def test_rows_of_one_id_with_different_texts(spark):
    """Each row is linked by its own text, and no link is lost."""
    rng = random.Random(21)
    a, b = prose(rng, 200), prose(rng, 210)
    rows = [(5, a), (5, b), (7, a + " one"), (8, "two " + b), (9, b), (3, prose(rng, 100)), (5, a), (10, "two " + b)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == sorted([(5, 5, True)] * 3 + [(i, 5, False) for i in (7, 8, 9, 10)] + [(3, 3, True)])


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.concatenate([a[:300], np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))])
    s = near_dup.fast_sketch([a, b, a[:1], a[:0]])
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15 and (s[2] != near_dup._FULL).all() and (s[3] == near_dup._FULL).all()


def test_odd_rows(odd_docs, spark):
    got = near_dup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[4].component_id == by[5].component_id == 0 and by[14].component_id == 13 and by[1].kept and by[2].n_shingles == 0
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_dup.near_duplicates(odd_docs.limit(0)).count() == 0
    kept = near_dup.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} >= {None, 0, 1, 13}
    check = rlz.without_repeats(odd_docs).collect()
    assert len(check) == odd_docs.count() and all(r.n_removed == 0 for r in check if r.doc_id in (None, 0, 1, 2, 13, 14))
    assert {r.doc_id: r.n_removed for r in check}[4] == 120 and rlz.without_repeats(odd_docs.limit(0)).count() == 0


def test_substring_dedup(spark, monkeypatch):
    rows = [r for r in corpus(3, 80) if r[0] != 84]
    for size in (rlz.MAP_BYTES, 2000):  # one chunk, and many
        monkeypatch.setattr(rlz, "MAP_BYTES", size)
        first, words = {}, {}
        for i, t in sorted(rows):
            w = words[i] = (t or "").encode().split()
            for k in range(len(w) - 12):
                first.setdefault(tuple(w[k : k + 13]), i)
        got = {r.doc_id: r for r in rlz.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
        for i, w in words.items():
            gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
            kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
            assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256, got[i].text) == (len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())


def test_factors_are_one_reference_each(spark, monkeypatch):
    """Every factor is a stretch of one smaller document, word by word, and factors cover all duplicate windows."""
    rng = random.Random(8)
    a, b, d = (prose(rng, 60).split() for _ in range(3))
    rows = [(1, a), (2, b), (3, a[40:] + b[:30]), (4, d + a[5:50] + b[:30]), (5, d[:12] + b[3:40] + d[:13]), (6, a + b + a), (6, d), (7, d[:59] + ["x"] + a[:20])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    for block in (rlz.BLOCK_BYTES, 500):
        monkeypatch.setattr(rlz, "BLOCK_BYTES", block)
        got = rlz.factors(docs.repartition(3)).collect()
        texts = {}
        for i, w in rows:
            texts.setdefault(i, []).append(w)
        covered = {}
        for r in got:
            assert r.ref < r.doc_id and r.size >= rlz.WINDOW
            assert any(w[r.start : r.start + r.size] == v[r.ref_start : r.ref_start + r.size] for w in texts[r.doc_id] for v in texts[r.ref] if len(w) >= r.start + r.size)
            covered.setdefault(r.doc_id, []).append((r.start, r.size, r.ref, r.ref_start))
        words = {i: {k for start, size, *_ in f for k in range(start, start + size)} for i, f in covered.items()}
        assert words[3] == set(range(50)) and words[4] == set(range(60, 135)) and words[5] == set(range(12, 62)) and 1 not in words and 2 not in words
        assert (60, 45, 1, 5) in covered[4] and (0, 59, 4, 0) in covered[7] and (60, 20, 1, 0) in covered[7]
    assert rlz.factors(docs.limit(0)).count() == 0


def test_greedy_parse():
    rng = random.Random(9)
    for _ in range(300):
        found = sorted(((s := rng.randint(0, 40)), s + rng.randint(1, 15), 0, 0) for _ in range(rng.randint(0, 9)))
        found.sort(key=lambda f: (f[0], -f[1]))
        every, taken = ({k for s, e, *_ in x for k in range(s, e)} for x in (found, rlz.greedy(found)))
        assert every == taken


def test_windows_with_equal_keys_differ_by_the_second_hash():
    doc, at = np.array([1, 2, 3]), np.array([0, 0, 0])
    key, more = np.array([7, 7, 7], np.uint64), np.array([1, 2, 1], np.uint16)
    hit, ref = rlz._seeds(doc, at, key, more)
    assert hit.tolist() == [2] and ref.tolist() == [0]


def test_templates(spark, odd_docs):
    items = spark.createDataFrame([(1, "If Anna Smith buys 12 kg of apples for 30 dollars, how many kg does Anna get for 45 dollars today?"), (2, "short one here"), (3, None), (4, "")], "item_id long, text string")
    rows = [
        (1, "So: if Anna Smith buys 12 kg of apples for 30 dollars, how many kg does Anna get for 45 dollars today? fine"), (2, "blah if Bert Jones buys 7 kg of apples for 20 dollars, how many kg does Bert get for 50 dollars today? x"),
        (3, "if Bert Jones buys 7 kg of pears and some other things that no question ever asked about"), (4, "a short one here b"), (5, "short one there"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.exact, r.n_matched, r.n_windows) for r in templates.contaminated(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 2)} and got[1, 1][0] and not got[2, 1][0]
    assert [r.doc_id for r in templates.clean(docs, items).orderBy("doc_id").collect()] == [3, 5]
    assert templates.contaminated(odd_docs, items).count() == 0 and templates.contaminated(docs, items.limit(0)).count() == 0
    assert templates.clean(odd_docs, items).columns == odd_docs.columns and templates.clean(odd_docs, items).count() == odd_docs.count()


def test_inconsistent_slots_are_left_alone(spark):
    items = spark.createDataFrame([(1, "if a train goes 10 and then 10 and then 10 and then 10 it has gone far")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "if a train goes 7 and then 7 and then 7 and then 7 it has gone far"), (2, "if a train goes 7 and then 8 and then 9 and then 6 it has gone far")], "doc_id long, text string")
    assert [r.doc_id for r in templates.contaminated(docs, items).collect()] == [1]


def test_reparameterised_questions(spark):
    """Names at a sentence's start, number words and fractions are slots; two values don't become one; null ids go too."""
    item = "Anna buys twelve kg of apples for 1/2 dollars. Anna sells 30 of the apples to Bert. How many apples are left for Anna?"
    items = spark.createDataFrame([(1, item), (None, "Where do the old rivers of the north begin to flow in spring?")], "item_id long, text string")
    rows = [
        (1, "Carla buys 9 kg of apples for \u00be dollars. Carla sells forty of the apples to Dora. How many apples are left for Carla?"), (2, item.lower().replace("anna", "Anna").replace("bert", "Bert")),
        (3, "Carla buys 9 kg of apples for 3 dollars. Carla sells 9 of the apples to Carla. How many apples are left for Carla?"), (4, "Carla bakes 9 kg of bread from 7 sacks. Dora eats 40 of the loaves with Carla. How much bread is left for Dora?"),
        (None, "clean text of no id " * 5), (None, "x. Where do the old rivers of the north begin to flow in spring? y"), (5, item), (5, "a clean text of the same id"), (6, None), (7, ""), (5, item),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): r for r in templates.contaminated(docs, items).collect()}
    assert {(1, 1), (2, 1), (5, 1), (None, None)} <= set(got) and not {4, 6, 7} & {k for k, _ in got} and got[5, 1].exact and not got[1, 1].exact
    assert (3, 1) not in got or got[3, 1].n_matched < got[3, 1].n_windows
    assert got[1, 1].n_matched >= got[1, 1].n_windows - 1  # one window has few literals and other values
    for size in (templates.BROADCAST_BYTES, 0):  # broadcast and shuffled
        templates.BROADCAST_BYTES, before = size, templates.BROADCAST_BYTES
        left = [(r.doc_id, r.text) for r in templates.clean(docs, items).collect()]
        templates.BROADCAST_BYTES = before
        assert sorted(left, key=repr) == sorted([r for r in rows if r[0] in (4, 6, 7) or (r[0] is None and "clean" in r[1]) or r[1] == "a clean text of the same id" or (r[0] == 3 and (3, 1) not in got)], key=repr)


def plain_template(text):
    import regex

    units, out, last = set(templates.UNITS.replace("?", "").split("|")) | {"mile", "hour", "hr", "minute", "second", "day", "week", "month", "year", "dollar", "euro", "cent", "degree", "miles", "hours"}, [], False
    for w in regex.findall(r"[\p{L}\p{M}]+|[0-9]+", text):
        if w.isdigit() or w.lower() in templates.NUMBERS.split("|"):
            out.append(("#", w.lower()))
        elif last and w.lower() in units:
            out.append(("u", w.lower()))
        elif w[0].isupper() and w[1:] and w[1:].islower() and w not in templates.STARTERS.split("|"):
            out.append(("n", w.lower()))
        else:
            out.append((w.lower(), w.lower()))
        last = out[-1][0] == "#"
    return out


def test_templates_against_plain_version(spark):
    """Contaminated pairs of random questions against a comparison of every window with every window."""
    rng = random.Random(12)
    people, things = ["Anna", "Bert", "Carla"], "apples pears coins books".split()
    ask = lambda: rng.choice([
        "{p} has {a} {t} and gives {b} of the {t} to {q}. How many {t} does {p} have now?", "If {p} walks {a} km in {b} hours, how far does {p} walk in {c} hours with {q}?", "What did {p} pay for {a} {t} when {q} paid {b} dollars for {c} {t} last week?",
    ]).format(p=rng.choice(people), q=rng.choice(people), a=rng.randint(2, 9), b=rng.randint(2, 9), c=rng.randint(2, 9), t=rng.choice(things))
    items = [(i, ask()) for i in range(8)]
    docs = [(i, f"{prose(rng, 6)} {ask()} {prose(rng, 6)}") for i in range(60)]
    want = set()
    for i, text in items:
        forms = [plain_template(text), plain_template(text[0].lower() + text[1:])]
        for d, body in docs:
            w, lines = plain_template(body), {}
            for f in forms:
                for at in range(len(f) - 7):
                    for k in range(len(w) - 7):
                        a, b = f[at : at + 8], w[k : k + 8]
                        few = 2 * sum(x == y for x, y in a) < 8
                        if [x for x, _ in a] == [x for x, _ in b] and (not few or a == b):
                            line = lines.setdefault(k - at, (set(), set()))
                            line[0].add(at)
                            line[1].update((x, y) for x, y in zip(a, b) if x[0] in "#un" and len(x[0]) == 1)
            hit = set().union(*(at for at, slots in lines.values() if len({x for x, _ in slots}) == len(slots) == len({y for _, y in slots})))
            if 100 * len(hit) >= templates.MIN_PERCENT * (len(forms[0]) - 7):
                want.add((d, i))
    got = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and 20 < len(want) < 480


def test_templates_of_few_literals_and_after_a_colon(spark):
    texts = [(1, "What is 12 + 45 * 3?"), (2, "Solve 3x + 5 = 20"), (3, "What is the capital of France?"), (4, "how do plants make sugar"), (4, "why do birds fly south in winter"), (None, "who wrote the longest book")]
    items = spark.createDataFrame(texts, "item_id long, text string")
    rows = [
        (1, "Q: What is 12 + 45 * 3? A: 147"), (2, "solve 3x + 5 = 20 now"), (3, "Question: What is the capital of France?"), (4, "say how do plants make sugar"), (5, "so why do birds fly south in winter"),
        (6, "say who wrote the longest book"), (7, "What is 13 + 45 * 3?"), (8, "the capital of France"), (9, "what is the capital of France?"), (10, "We ask\nWhat is the capital of France?"),
    ]
    got = {(r.doc_id, r.item_id) for r in templates.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, None), (9, 3), (10, 3)}


def test_pipeline(spark):
    """Every stage works on all that the one before kept, and its decisions take effect."""
    import corpus_pipeline
    from lectern.llm import fertility, pieces, pii

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        kept[name] = (docs, corpus_pipeline.common.store(out, name))
        docs = kept[name][1]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = kept["quality_rules"]
    assert ids(after) == ids(fertility.quality(before).where("kept"))
    before, after = kept["near_dedup"]
    groups = near_dup.near_duplicates(before).collect()
    assert ids(after) == sorted({r.component_id for r in groups}) and len(ids(after)) < len(groups)
    before, after = kept["decontamination"]
    bad = {r.doc_id for r in templates.contaminated(before, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert bad and ids(after) == sorted(set(ids(before)) - bad)
    before, after = kept["pseudonyms"]
    old, new = ({r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for df in (before, after))
    counted = {r.doc_id: r.n for r in pii.pseudonymised(before, count="n").collect()}
    assert set(old) == set(new) and any(counted.values()) and all((old[i] == new[i]) == (counted[i] == 0) for i in old)
    encoded = corpus_pipeline.STAGES[-1][1](spark, after, d)
    assert {r.doc_id: r.text for r in pieces.decoded(encoded).collect()} == new
    assert ids(corpus_pipeline.run(spark, d)) == ids(after)


@pytest.mark.parametrize("hashes", [0, 1_000_000])
def test_shuffled_windows_carry_their_own_words(spark, monkeypatch, hashes):
    item = "Anna buys twelve kg of apples and then sells thirty of the apples to Bert near the old bridge of the town."
    rows = [(1, item), (2, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x" for i in range(300)) + " " + item), (3, "nothing of that kind is said in here, not a word " * 9)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    want = sorted(templates.contaminated(docs, items).collect())
    assert [(r.doc_id, r.n_matched) for r in want] == [(1, want[0].n_windows), (2, want[0].n_windows)]
    monkeypatch.setattr(templates, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(templates, "BROADCAST_HASHES", hashes)
    assert sorted(templates.contaminated(docs, items).collect()) == want
    indexed, widths, small = templates._indexed(items)
    cut = docs.select(F.col("doc_id").alias("key"), templates.words(F.col("text")).alias("w"))
    moved = templates._own_words(templates.windows(cut, "key", widths), indexed).select(F.max(F.size("w")).alias("w"), F.max(F.size("f")).alias("f"), F.count("*").alias("n")).first()
    assert not small and moved.w <= templates.WINDOW and moved.f <= templates.WINDOW and (moved.n < 100) == (hashes > 0)
