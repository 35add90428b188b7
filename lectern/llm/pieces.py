"""SentencePiece encoding and decoding: N-best segmentation over the piece lattice.

The model file's pieces and scores span a lattice over a text (spaces written as U+2581, one put in front).
A segmentation's score is the sum of its pieces' scores; the best has the largest. A character without a
piece of its own has one edge: its UTF-8 bytes as byte pieces, each scored 10 below the worst piece. So has a
U+2581 of the text itself, which keeps it apart from a space.

Of a BPE model (the default file) the scores are ranks of merges. The best path is that of the largest sum, as the
contract of N-best search asks; it can differ from what the model's own sequence of merges gives.

The lattice falls apart where no piece spans two neighbouring characters, so each text is cut there and
equal segments of a chunk are solved once: a forward Viterbi pass over all of them together, position by
position, gives each node's best score from the left. Backward A* search uses these scores as its heuristic.
They are exact, so the k-th path popped is the k-th best. Of a text's segments only the N - 1 whose second
path loses least can differ from their first path in the N best; those are searched, and their
alternatives are combined best first.

Ties: the shorter last piece wins on the forward pass; equal totals keep the order of segments.
Null text: null results; empty text: no pieces, one segmentation of score 0. Decoding returns the text exactly.

An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
#: Longer segments are solved one by one instead of side by side.
SIDE_BY_SIDE = 48
#: Segments solved at once, and kept in all.
SLICE, KEPT = 8192, 150_000
#: Text bytes that are encoded at once.
CHUNK = 3 << 19
SPACE = "▁"
#: Stands for a U+2581 of the text; no decoded text holds a lone surrogate.
LITERAL = "\udc81"
_LOST = -1e18


class Table:
    """Looks up arrays of positive integers by linear probing."""

    def __init__(self, values: dict[int, int]) -> None:
        self.shift = 64 - (8 * len(values)).bit_length()
        self.keys = np.full((1 << (64 - self.shift)) + 64, -1, np.int64)
        self.values = np.full(len(self.keys), -1, np.int64)
        for k, v in values.items():
            at = int(self._home(np.array([k]))[0])
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.values[at] = k, v

    def _home(self, x: np.ndarray) -> np.ndarray:
        return ((x.astype(c.U64) * c.U64(0x9E3779B97F4A7C15)) >> c.U64(self.shift)).astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The values, or -1."""
        at = self._home(x)
        out = np.where(self.keys[at] == x, self.values[at], -1)
        rest = np.flatnonzero((self.keys[at] != x) & (self.keys[at] >= 0))
        while len(rest):
            at[rest] += 1
            key = self.keys[at[rest]]
            hit = rest[key == x[rest]]
            out[hit] = self.values[at[hit]]
            rest = rest[(key != x[rest]) & (key >= 0)]
        return out


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    byte0: int  # the id of byte 0
    worst: float  # score of a byte of a character without piece
    child: Table  # (node << 21 | character) of the trie: node that it leads to
    piece: np.ndarray  # piece that ends at a node, or -1
    longest: int
    joined: Table  # (character << 21 | next character) that some piece spans

    @property
    def ids(self) -> dict[str, int]:
        return self._ids

    def __post_init__(self) -> None:
        self._ids = {p: i for i, p in enumerate(self.pieces) if i > self.byte0 + 255}


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    scores = np.array([sp.get_score(i) for i in range(n)])
    byte0 = next(i for i in range(n) if sp.is_byte(i))
    edges: dict[int, int] = {}
    piece, joined = [-1], set()
    for i in range(byte0 + 256, n):
        node = 0
        for ch in map(ord, pieces[i]):
            key = node << 21 | ch
            if key not in edges:
                edges[key] = len(piece)
                piece.append(-1)
            node = edges[key]
        piece[node] = i
        joined |= {ord(a) << 21 | ord(b) for a, b in zip(pieces[i], pieces[i][1:])}
    ordinary = scores[byte0 + 256 :]
    return Model(
        pieces, scores, byte0, float(ordinary[ordinary > -1e8].min()) - 10, Table(edges),
        np.array(piece, np.int64), max(map(len, pieces[byte0 + 256 :])), Table(dict.fromkeys(joined, 1)),
    )


def cut(m: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All texts' segments in a row, and how many each text has. No piece spans two segments."""
    marked = [SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE) if t else "" for t in texts]
    whole = "".join(marked)
    if not whole:
        return [], np.zeros(len(texts), np.int64)
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    first = np.append(True, m.joined(code[:-1] << 21 | code[1:]) < 0)
    ends = np.cumsum([len(t) for t in marked])
    first[ends[ends < len(code)]] = True
    starts = np.flatnonzero(first)
    bounds = [*starts.tolist(), len(code)]
    segments = [whole[a:b] for a, b in zip(bounds, bounds[1:])]
    counts = np.diff(np.searchsorted(starts, np.append(0, ends)))
    return segments, counts


def _edges(m: Model, code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, score) of the piece of each length that begins at each character; -1 if none. left: characters to the end."""
    n, most = len(code), min(m.longest, int(left.max(initial=0)))
    piece, score = np.full((most, n), -1, np.int32), np.full((most, n), _LOST)
    node, live = np.zeros(n, np.int64), np.arange(n)
    for k in range(most):
        live = live[left[live] > k]
        to = m.child(node[live] << 21 | code[live + k])
        live, to = live[to >= 0], to[to >= 0]
        node[live] = to
        ends = m.piece[to] >= 0
        at, p = live[ends], m.piece[to[ends]]
        piece[k, at], score[k, at] = p, m.scores[p]
    return piece, score


@dataclass
class Solved:
    best: np.ndarray  # score of the best path
    gap: np.ndarray  # what the second best path loses
    counts: np.ndarray  # number of ids of the best path
    ids: np.ndarray  # the best paths' ids, laid end to end


def solve(m: Model, segments: list[str]) -> Solved:
    """The best path of each segment, found for all of them side by side. segments: the longest first."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    code = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = sizes
    start = np.cumsum(size) - size
    owner, at = c.places(size)
    piece, score = _edges(m, code, size[owner] - at)
    alone = np.flatnonzero(piece[0] < 0)
    n_bytes = 1 + (code[alone] > 0x7F) + (code[alone] > 0x7FF) + (code[alone] > 0xFFFF)
    score[0, alone] = m.worst * n_bytes
    n, most = len(size), int(size.max(initial=0))
    best = np.full(len(code) + n, _LOST)  # of node: segment's start + segment's number + characters so far
    loss = np.full(len(code) + n, np.inf)
    back = np.zeros(len(code) + n, np.int8)
    base = start + np.arange(n)
    best[base] = 0
    for j in range(1, most + 1):
        rows = int(np.searchsorted(-size, -j, side="right"))
        top, second, came = np.full(rows, _LOST), np.full(rows, _LOST), np.zeros(rows, np.int8)
        for k in range(min(j, len(piece))):
            total = best[base[:rows] + j - k - 1] + score[k, start[:rows] + j - k - 1]
            better = total > top
            second = np.where(better, top, np.maximum(second, total))
            came[better] = k + 1
            top = np.where(better, total, top)
        best[base[:rows] + j], back[base[:rows] + j] = top, came
        loss[base[:rows] + j] = np.where(second > _LOST / 2, top - second, np.inf)
    # along the best paths, from the ends
    gap, left, live = np.full(n, np.inf), size.copy(), np.arange(n)
    taken: list[tuple[np.ndarray, ...]] = []
    step = 0
    while len(live):
        node = base[live] + left[live]
        gap[live] = np.minimum(gap[live], loss[node])
        left[live] -= back[node]
        p = start[live] + left[live]
        taken.append((live, np.full(len(live), step), piece[back[node].astype(np.int64) - 1, p], p))
        live, step = live[left[live] > 0], step + 1
    who, when, ids, p = map(np.concatenate, zip(*taken, strict=True))
    o = np.lexsort((-when, who))
    who, ids, p = who[o], ids[o].astype(np.int64), p[o]
    raw = ids < 0
    width = np.ones(len(ids), np.int64)
    width[raw] = 1 + (code[p[raw]] > 0x7F) + (code[p[raw]] > 0x7FF) + (code[p[raw]] > 0xFFFF)
    flat = np.repeat(ids, width)
    if raw.any():
        utf8 = "".join(map(chr, code[p[raw]])).replace(LITERAL, SPACE).encode("utf-8", "surrogatepass")
        flat[np.repeat(raw, width)] = m.byte0 + np.frombuffer(utf8, np.uint8).astype(np.int64)
    counts = np.bincount(who, weights=width, minlength=n).astype(np.int64)
    return Solved(best[base + size], gap, counts, flat)


def forward(m: Model, s: str) -> tuple[list[float], list[list[tuple[int, float, tuple[int, ...]]]]]:
    """Best score of each node from the left, and each node's incoming edges (from, score, ids)."""
    into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(s) + 1)]
    best = [0.0] + [_LOST] * len(s)
    ids = m.ids
    for j in range(1, len(s) + 1):
        for i in range(j - 1, max(-1, j - 1 - m.longest), -1):
            if (p := ids.get(s[i:j])) is not None:
                into[j].append((i, float(m.scores[p]), (p,)))
            elif i == j - 1:
                b = s[i:j].replace(LITERAL, SPACE).encode("utf-8", "surrogatepass")
                into[j].append((i, m.worst * len(b), tuple(m.byte0 + x for x in b)))
        for i, w, _ in into[j]:
            best[j] = max(best[j], best[i] + w)
    return best, into


def a_star(m: Model, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of s, best first: backward search with the forward scores as heuristic.

    Among equal totals the node nearest to the start goes first, so ties don't spread over the lattice; a node that
    was reached n times has its n best ends, and later ones can't be among the n best of s. So a search takes at most
    n steps a node, whatever is repeated in s.
    """
    best, into = forward(m, s)
    heap: list[tuple] = [(-best[len(s)], len(s), 0, 0.0, ())]
    reached = [0] * (len(s) + 1)
    made, out = 1, []
    while heap and len(out) < n:
        f, node, _, done, path = heapq.heappop(heap)
        if node == 0:
            ids: list[int] = []
            while path:
                ids += path[0]
                path = path[1]
            out.append((-f, tuple(ids)))
            continue
        if reached[node] == n:
            continue
        reached[node] += 1
        for i, w, p in into[node]:
            if reached[i] < n:
                heapq.heappush(heap, (-(best[i] + w + done), i, made, w + done, (p, path)))
                made += 1
    return out


def combine(options: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n cheapest ways to take one option of each list (losses, ascending): (total loss, choices)."""
    start = (0.0, (0,) * len(options))
    heap, seen, out = [start], {start[1]}, []
    while heap and len(out) < n:
        loss, at = heapq.heappop(heap)
        out.append((loss, at))
        for i, a in enumerate(at):
            if a + 1 < len(options[i]):
                nxt = (*at[:i], a + 1, *at[i + 1 :])
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (loss - options[i][a] + options[i][a + 1], nxt))
    return out


def decode(m: Model, ids: list[int]) -> str:
    out = bytearray()
    for i in ids:
        out += bytes([i - m.byte0]) if m.byte0 <= i < m.byte0 + 256 else m.pieces[i].replace(SPACE, " ").encode()
    return out.decode("utf-8", "surrogatepass")[1:]


class Encoder:
    """Encodes chunks of texts. Solved segments are kept for the task, up to a bound, then dropped."""

    def __init__(self, path: str, nbest: int) -> None:
        self.m, self.nbest = load(path), nbest
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.known: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self.solved = Solved(np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def learn(self, segments: list[str]) -> None:
        """Solves segments not met before, in slices of like length."""
        if len(self.at) > KEPT:
            self.forget()
        new = sorted((s for s in dict.fromkeys(segments) if s not in self.at), key=len, reverse=True)
        parts, i = [self.solved], 0
        while i < len(new):
            n = 1 if len(new[i]) > SIDE_BY_SIDE else SLICE
            parts.append(solve(self.m, new[i : i + n]))
            i += n
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.solved = Solved(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("best", "gap", "counts", "ids")))

    def searched(self, s: str) -> list[tuple[float, tuple[int, ...]]]:
        if s not in self.known:
            self.known[s] = a_star(self.m, s, self.nbest)
        return self.known[s]

    def __call__(self, raw: list[bytes | None]) -> list[dict | None]:
        segments, counts = cut(self.m, [(t or b"").decode("utf-8", "replace") for t in raw])
        self.learn(segments)
        at = np.fromiter(map(self.at.__getitem__, segments), np.int64, len(segments))
        best, gap, n_ids = self.solved.best[at], self.solved.gap[at], self.solved.counts[at]
        first = (np.cumsum(self.solved.counts) - self.solved.counts)[at]
        run, inside = c.places(n_ids)
        ids = self.solved.ids[first[run] + inside]
        cuts = np.append(0, np.cumsum(n_ids))
        total = np.append(0, np.cumsum(best))
        out: list[dict | None] = []
        end = 0
        for t, n in zip(raw, counts.tolist(), strict=True):
            a, end = end, end + n
            if t is None:
                out.append(None)
                continue
            score, lost = float(total[end] - total[a]), gap[a:end]
            if n >= self.nbest:
                near = np.flatnonzero(lost <= np.partition(lost, self.nbest - 2)[self.nbest - 2])
                near = near[np.argsort(lost[near], kind="stable")][: self.nbest - 1]
            else:
                near = np.argsort(lost, kind="stable")
            near = [i for i in near.tolist() if lost[i] < np.inf]
            ways = [self.searched(segments[a + i]) for i in near]
            ranked = combine([[w[0][0] - x[0] for x in w] for w in ways], self.nbest)
            swaps = [[(i, ways[k][j][1]) for k, (i, j) in enumerate(zip(near, choice, strict=True)) if j] for _, choice in ranked]
            own = cuts[a : end + 1]
            out.append({"ids": ids[own[0] : own[-1]], "scores": [score - loss for loss, _ in ranked], "swaps": swaps, "cuts": own - own[0]})
        return out


def nth_ids(x: dict, k: int) -> np.ndarray:
    """Ids of the k-th best segmentation of an encoded text."""
    parts, at = [], 0
    for i, ids in sorted(x["swaps"][k]):
        parts += [x["ids"][at : x["cuts"][i]], np.array(ids, np.int64)]
        at = x["cuts"][i + 1]
    return np.concatenate([*parts, x["ids"][at:]])


def swaps_decode(m: Model, x: dict) -> bool:
    """Whether all that other segmentations take in place of ids of the best one decodes to the same text."""
    text = lambda ids: decode(m, [m.ids[SPACE], *ids])
    return all(text(ids) == text(x["ids"][x["cuts"][i] : x["cuts"][i + 1]].tolist()) for way in x["swaps"] for i, ids in way)


def _encode(path: str, nbest: int, digest: bool):
    made: list[Encoder] = []  # ends with the task

    def fn(raw: list[bytes | None]) -> dict:
        if not made:
            made.append(Encoder(path, nbest))
        enc = made[0]
        rows = enc(raw)
        n = pa.array([None if r is None else len(r["ids"]) for r in rows], pa.int64())
        scores = pa.array([None if r is None else r["scores"] for r in rows], pa.list_(pa.float64()))
        if not digest:
            every = [None if r is None else [nth_ids(r, k).astype(np.int32) for k in range(len(r["swaps"]))] for r in rows]
            return {"n_pieces": n, "nbest_scores": scores, "nbest_ids": pa.array(every, pa.list_(pa.list_(pa.int32())))}
        exact = [None if r is None else decode(enc.m, r["ids"].tolist()).encode("utf-8", "surrogatepass") == t and swaps_decode(enc.m, r) for r, t in zip(rows, raw, strict=True)]
        every = [None if r is None else [hashlib.sha256(nth_ids(r, k).astype("<i4").tobytes()).hexdigest() for k in range(len(r["swaps"]))] for r in rows]
        sha = [None if x is None else x[0] for x in every]
        return {"n_pieces": n, "nbest_scores": scores, "ids_sha256": pa.array(sha, pa.string()), "nbest_sha256": pa.array(every, pa.list_(pa.string())), "exact": pa.array(exact, pa.bool_())}

    return fn


def encode(docs: DataFrame, model: str = MODEL, nbest: int = NBEST) -> DataFrame:
    """doc_id, n_pieces, nbest_scores (array, best first), nbest_ids (array of arrays of piece ids)."""
    return c.map_texts(docs, _encode(model, nbest, False), "n_pieces bigint, nbest_scores array<double>, nbest_ids array<array<int>>", most=CHUNK)


def decoded(encoded: DataFrame, ids: str = "nbest_ids", model: str = MODEL) -> DataFrame:
    """doc_id and the text of the first segmentation of column ids."""

    def run(batches):
        m = load(model)
        for b in batches:
            texts = [None if x is None else decode(m, x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col(ids)[0].alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def op4_nbest_pieces(spark, sf_dir: str) -> DataFrame:
    """Digest of each document's encoding: number of pieces; scores and hashes of the ids of the 4 best; exact round trip of all four."""
    return c.map_texts(
        c.read(spark, sf_dir, "documents"), _encode(MODEL, NBEST, True),
        "n_pieces bigint, nbest_scores array<double>, ids_sha256 string, nbest_sha256 array<string>, exact boolean", most=CHUNK,
    )
