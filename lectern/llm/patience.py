"""License scan by patience alignment.

Text and license templates are cut into lower-case words. A template is aligned with a text by anchors:
words that occur once in either are paired, the longest increasing subsequence of the pairs is kept, and
the gaps between anchors are aligned in the same way; a gap without anchors gives its common first and
last words. The matched words' share of the template is its coverage. A text carries a license if the
coverage of one of its notices is at least MIN_COVERAGE and the matched words lie close together (the
spread of the match is at most MAX_SPREAD times the notice). Before alignment, the words in common,
counted with repeats, bound the coverage from above, so hopeless pairs are skipped without loss.

A notice may stand anywhere, so it is aligned with single lines, with groups of neighbouring lines and with the
whole text. A group is a run of lines that hold words of the notice (lines without words don't end it), split
where a word that the notice has once would repeat; neighbouring groups of a run are tried in pairs too.
The notices are a parameter; NOTICES holds those of common licenses, short and whole.
Matched words far from the others are left out until the spread is small enough. Null or blank text: no rows of result. A text can carry several licenses: one row each, with
the best notice; of licenses on the same words the one with more of its words matched, then the better covered, then the first by name;
of places with equal coverage the first line. Repeated rows give their results each; a null doc_id is passed on.

An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .notices import NOTICES

MIN_COVERAGE, MAX_SPREAD = 0.8, 2.0

_WORD = re.compile(r"[^\W_]+")


def cut(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first, in which the second rises too."""
    tops: list[int] = []
    last: list[int] = []
    back = []
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tops, b)
        back.append(last[i - 1] if i else -1)
        tops[i : i + 1], last[i : i + 1] = [b], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), rising in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1 and na.get(w) == 1}
        anchors = increasing([(i, at[a[i]]) for i in range(a0, a1) if a[i] in at])
        if not anchors:
            while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
                out.append((a0, b0))
                a0, b0 = a0 + 1, b0 + 1
            while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
                a1, b1 = a1 - 1, b1 - 1
                out.append((a1, b1))
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            work.append((i + 1, k, j + 1, m))
    return sorted(out)


def match(words: list[str], notice: list[str]) -> tuple[float, int, int]:
    """Coverage of the notice, and first and last matched word of the text."""
    pairs = align(words, notice)
    i, j = 0, len(pairs) - 1
    while i < j and pairs[j][0] - pairs[i][0] + 1 > MAX_SPREAD * len(notice):
        if pairs[i + 1][0] - pairs[i][0] >= pairs[j][0] - pairs[j - 1][0]:
            i += 1
        else:
            j -= 1
    if not pairs:
        return 0.0, 0, 0
    return (j - i + 1) / len(notice), pairs[i][0], pairs[j][0]


def groups(cuts: list[list[str]], bag: Counter) -> list[tuple[int, int]]:
    """First line and line after the last of each group of lines, and of each pair of groups of one run."""
    runs: list[list[list[int]]] = []
    seen: set[str] = set()
    open_run = False
    for i, x in enumerate(cuts):
        if not x:
            continue
        if not any(w in bag for w in x):
            open_run = False
            continue
        once = {w for w in x if bag.get(w) == 1}
        if not open_run:
            runs.append([[i, i + 1]])
            seen, open_run = once, True
        elif seen & once:
            runs[-1].append([i, i + 1])
            seen = once
        else:
            runs[-1][-1][1] = i + 1
            seen = seen | once
    return [(a[0], a[1]) for run in runs for a in run] + [(a[0], b[1]) for run in runs for a, b in zip(run, run[1:])]


class Scanner:
    def __init__(self, notices: dict[str, list[str]]) -> None:
        self.notices = [(name, cut(t)) for name, texts in notices.items() for t in texts]
        self.bags = [Counter(w) for _, w in self.notices]
        # words of a notice that common prose lacks most: the longest ones, enough to tell most texts at once
        self.rare = [sorted(b, key=lambda w: (-len(w), w))[: len(n) - int(MIN_COVERAGE * len(n)) + 6] for (_, n), b in zip(self.notices, self.bags, strict=True)]
        self.vocabulary = {w for _, n in self.notices for w in n}
        self.names = list(notices)

    def __call__(self, text: str) -> list[tuple[str, float, int, int, str]]:
        """(license, coverage, first line, number of lines, matched text) of each license found."""
        lines = text.split("\n")
        cuts = [cut(x) for x in lines]
        start = [0]
        for x in cuts:
            start.append(start[-1] + len(x))
        best: dict[str, tuple[int, int, tuple[int, float]]] = {}  # first and last word, matched words and coverage
        some = [sum(w in self.vocabulary for w in x) for x in cuts]
        whole = [w for x in cuts for w in x]
        line_of = [i for i, x in enumerate(cuts) for _ in x]
        everything = Counter(whole)
        for (name, notice), bag, rare in zip(self.notices, self.bags, self.rare, strict=True):
            need = MIN_COVERAGE * len(notice)
            if sum(w in everything for w in rare) < len(rare) - (len(notice) - need):
                continue
            if sum(min(k, everything[w]) for w, k in bag.items()) < need:
                continue
            tries = [(cuts[i], start[i]) for i in range(len(lines)) if some[i] >= need]
            # lines next to each other that hold words of the notice are tried together, so wrapped notices are found
            tries += [(whole[start[i] : start[j]], start[i]) for i, j in groups(cuts, bag) if j - i > 1]
            tries.append((whole, 0))
            for words, at in tries:
                have = Counter(w for w in words if w in bag)
                if sum(min(k, bag[w]) for w, k in have.items()) < need:
                    continue
                coverage, a, b = match(words, notice)
                if coverage >= MIN_COVERAGE and b - a + 1 <= MAX_SPREAD * len(notice) and (round(coverage * len(notice)), coverage) > best.get(name, (0, 0, (0, 0.0)))[2]:
                    best[name] = (at + a, at + b, (round(coverage * len(notice)), coverage))
        out, taken = [], []
        # of notices on the same words the one with most of them matched
        for name, (a, b, (_, coverage)) in sorted(best.items(), key=lambda x: (-x[1][2][0], -x[1][2][1], x[0])):
            if all(b < i or a > j for i, j in taken):
                taken.append((a, b))
                out.append((name, coverage, line_of[a], line_of[b] - line_of[a] + 1, "\n".join(lines[line_of[a] : line_of[b] + 1])))
        return sorted(out)


def scan(docs: DataFrame, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, license, coverage, first_line, n_lines, notice: one row for each license a document carries."""
    made: list[Scanner] = []

    def fn(texts: list[bytes | None]) -> dict:
        if not made:
            made.append(Scanner(notices or NOTICES))
        found = [made[0](t.decode("utf-8", "replace")) if t else [] for t in texts]
        keys = ("license", "coverage", "first_line", "n_lines", "notice")
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_line", pa.int64()), ("n_lines", pa.int64()), ("notice", pa.string())]))
        return {"found": pa.array([[dict(zip(keys, x, strict=True)) for x in f] for f in found], kind)}

    rows = c.map_texts(docs, fn, "found array<struct<license:string,coverage:double,first_line:bigint,n_lines:bigint,notice:string>>")
    return rows.select("doc_id", F.inline("found"))


def op1_patience_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(c.read(spark, sf_dir, "documents"))
