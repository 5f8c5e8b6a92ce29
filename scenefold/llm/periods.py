"""Periodic runs of words: longest common extensions by suffix trees, Lyndon roots as candidates.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and at least ``least`` words and ``exponent`` periods, which no neighbouring
word extends. Every run holds an occurrence of a Lyndon root, under the order of the
words or under its reverse, as the longest Lyndon word from some place on; so the
longest Lyndon word of each place, extended to both sides, gives all runs.

* Each stretch gets two suffix trees by Ukkonen's algorithm, of itself and of its
  reversal. A depth-first tour leaves the depth of the lowest common ancestor between
  neighbouring leaves; a sparse table of these minima answers any two leaves, i.e. the
  common extension of two places, in constant time. Right extensions come from the
  first tree, left ones from the second.
* Before that, stretches without a run are cut off: in a run of four periods each word
  stands four times. Words that are rarer in their stretch part it, until none is left
  that does. This loses no run.

Every document is whole in one task; tables are not shuffled. A null or empty text has
no words and no runs. Rows are judged one by one, so repeated ids or texts give
repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, utf8, with_workers

#: Fewest words and fewest periods of a run.
LEAST, EXPONENT = 6, 4
#: Rounds in which rare words part their stretch; what is left then goes to the trees as it is.
ROUNDS = 40


def suffix_tree(symbols: list[int], width: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's tree of ``symbols``, whose last one stands nowhere else.

    ``go[node * width + symbol]`` is the child on that symbol, node 0 the root. Edges
    are ``symbols[begin[node]:end[node]]``; a leaf's end is -1, and leaves are made in
    the order of their suffixes.
    """
    go: dict[int, int] = {}
    begin, end, link = [0], [0], [0]
    node = edge = matched = pending = 0
    for place, symbol in enumerate(symbols):
        pending += 1
        inner = 0  # the inner node made last in this step, whose suffix link is still open
        while pending:
            if not matched:
                edge = place
            key = node * width + symbols[edge]
            child = go.get(key)
            if child is None:
                go[key] = len(begin)
                begin.append(place)
                end.append(-1)
                link.append(0)
                if inner:
                    link[inner] = node
                    inner = 0
            else:
                first, last = begin[child], end[child]
                span = (last if last >= 0 else place + 1) - first
                if matched >= span:
                    edge += span
                    matched -= span
                    node = child
                    continue
                if symbols[first + matched] == symbol:
                    matched += 1
                    if inner:
                        link[inner] = node
                    break
                fork = len(begin)
                begin += (first, place)
                end += (first + matched, -1)
                link += (0, 0)
                go[key] = fork
                begin[child] = first + matched
                go[fork * width + symbols[first + matched]] = child
                go[fork * width + symbol] = fork + 1
                if inner:
                    link[inner] = fork
                inner = fork
            pending -= 1
            if node:
                node = link[node]
            elif matched:
                matched -= 1
                edge = place - pending + 1
    return go, begin, end


class Extensions:
    """Common extensions of any two places of ``symbols`` (numbers from 1 to ``width`` - 1)."""

    def __init__(self, symbols: list[int], width: int) -> None:
        self.n, self.width = len(symbols), width
        go, begin, end = suffix_tree([*symbols, 0], width)
        self._keys = np.fromiter(go.keys(), dtype=np.int64, count=len(go))
        self._below = np.fromiter(go.values(), dtype=np.int64, count=len(go))
        ends = np.array(end)
        self._leaf = np.where(ends < 0, np.cumsum(ends < 0) - 1, -1)
        self._leaf[0] = -1
        self._spans = (ends - np.array(begin)).tolist()
        self.rank, depths = self._tour(reverse=False)
        self._levels = [depths]
        step = 1
        while 2 * step <= len(depths):
            last = self._levels[-1]
            self._levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def _tour(self, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each suffix and the depth of the ancestor between neighbours in rank.

        Children are met in the order of their symbols, or in the reverse one; the
        end of the text comes first in both.
        """
        parent, symbol = self._keys // self.width, self._keys % self.width
        if reverse:
            symbol = (self.width - symbol) % self.width
        order = np.lexsort((-symbol, parent))
        parent, below = parent[order], self._below[order].tolist()
        bounds = np.searchsorted(parent, np.arange(len(self._leaf) + 1)).tolist()
        leaf, spans = self._leaf.tolist(), self._spans
        suffixes: list[int] = []
        between: list[int] = []
        stack = below[bounds[0] : bounds[1]]
        above = [0] * len(stack)
        fresh = False  # whether the last node met was a leaf
        while stack:
            node, up = stack.pop(), above.pop()
            if fresh:
                between.append(up)
            suffix = leaf[node]
            fresh = suffix >= 0
            if fresh:
                suffixes.append(suffix)
            else:
                here = up + spans[node]
                children = below[bounds[node] : bounds[node + 1]]
                stack += children
                above += [here] * len(children)
        rank = np.empty(self.n + 1, dtype=np.int64)
        rank[suffixes] = np.arange(self.n + 1)
        return rank, np.array(between, dtype=np.int32)

    def reverse_rank(self) -> np.ndarray:
        return self._tour(reverse=True)[0]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from the places ``a`` and ``b`` (different ones) on."""
        low, high = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        level = np.frexp(np.maximum(high - low, 1))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level):
            here = level == k
            table = self._levels[k]
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << int(k))])
        return out


def _lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word from each place on: up to the next smaller suffix."""
    ranks = rank.tolist()
    n = len(ranks) - 1
    following = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j, own = i + 1, ranks[i]
        while ranks[j] > own:
            j = following[j]
        following[i] = j
    return np.array(following[:n]) - np.arange(n)


def find_runs(codes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of numbers, by start and period.

    ``exponent`` must be 2 or more.
    """
    none = np.empty((0, 3), dtype=np.int64)
    if len(codes) < max(least, exponent):
        return none
    alphabet, symbols = np.unique(codes, return_inverse=True)
    n, width = len(codes), len(alphabet) + 1
    listed = (symbols + 1).tolist()
    right = Extensions(listed, width)
    starts, roots = [], []
    for rank in (right.rank, right.reverse_rank()):
        length = _lyndon_lengths(rank)
        start = np.flatnonzero(length * exponent <= n)
        starts.append(start)
        roots.append(length[start])
    i, q = np.concatenate(starts), np.concatenate(roots)
    after = np.zeros(len(i), dtype=np.int64)
    inside = i + q < n
    after[inside] = right.common(i[inside], (i + q)[inside])
    # A root at the front of its run is followed by at least the rest of the periods but two.
    some = after >= (exponent - 2) * q
    i, q, after = i[some], q[some], after[some]
    if not len(i):
        return none
    left = Extensions(listed[::-1], width)
    before = np.zeros(len(i), dtype=np.int64)
    inner = i > 0
    before[inner] = left.common((n - i)[inner], (n - i - q)[inner])
    start, length = i - before, before + q + after
    good = length >= np.maximum(least, exponent * q)
    return np.unique(np.stack([start, length, q], axis=1)[good], axis=0) if good.any() else none


def _stretches(codes: np.ndarray, sizes: np.ndarray, least: int, exponent: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the stretches of consecutive words that can hold a run."""
    at = np.arange(len(codes))
    part = np.repeat(np.arange(len(sizes)), sizes)
    width = int(codes.max(initial=0)) + 1
    done: list[np.ndarray] = []
    for _ in range(ROUNDS):
        if not len(at):
            break
        # Stretches as short as this hold no run.
        head = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1)])
        length = np.diff(np.r_[head, len(at)])
        part = np.repeat(np.arange(len(head)), length)
        wide = np.repeat(length >= max(least, exponent), length)
        at, part = at[wide], part[wide]
        if not len(at):
            break
        _, inverse, count = np.unique(part * width + codes[at], return_inverse=True, return_counts=True)
        often = count[inverse] >= exponent
        parts = part[-1] + 1
        touched = np.zeros(parts, dtype=bool)
        touched[part[~often]] = True
        settled = ~touched[part]
        done.append(at[settled])
        goes_on = often & ~settled
        at, part = at[goes_on], part[goes_on]
    done.append(at)
    left = np.sort(np.concatenate(done))
    if not len(left):
        return
    owner = np.searchsorted(np.cumsum(sizes), left, side="right")
    cut = np.flatnonzero(np.r_[True, (left[1:] != left[:-1] + 1) | (owner[1:] != owner[:-1])])
    for a, b in zip(cut.tolist(), np.r_[cut[1:], len(left)].tolist(), strict=True):
        yield int(left[a]), int(left[b - 1]) + 1


def batch_runs(listed: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """The runs of each list of words."""
    sizes = np.array([len(x) for x in listed], dtype=np.int64)
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [w for x in listed for w in x]
    found: list[list[np.ndarray]] = [[] for _ in listed]
    if len(flat):
        codes = pd.factorize(flat)[0].astype(np.int64)
        ends = np.cumsum(sizes)
        for first, end in _stretches(codes, sizes, least, exponent):
            runs = find_runs(codes[first:end], least, exponent)
            if len(runs):
                owner = int(np.searchsorted(ends, first, side="right"))
                found[owner].append(runs + np.array([first - (ends[owner] - sizes[owner]), 0, 0]))
    none = np.empty((0, 3), dtype=np.int64)
    out = []
    for one in found:
        runs = np.concatenate(one) if one else none
        out.append(runs[np.lexsort((runs[:, 2], runs[:, 0]))])
    return out


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """``words`` without those that stand in a run after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _repeat_tail(words: list[bytes], h: int | None) -> list[bytes]:
    """For every tenth hash the words from a place on become repeats of a stretch there."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * (-(-(n - a) // p)))[: n - a]


def _over(make: Callable[[pa.RecordBatch, list[list[bytes]], list[np.ndarray]], pa.RecordBatch], least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                listed = [t.split() if t is not None else [] for t in utf8(part.column("text"))]
                if "_h" in part.schema.names:
                    listed = [_repeat_tail(w, h) for w, h in zip(listed, part.column("_h").to_pylist(), strict=True)]
                yield make(part, listed, batch_runs(listed, least, exponent))

    return run


def _digests(part: pa.RecordBatch, listed: list[list[bytes]], found: list[np.ndarray]) -> pa.RecordBatch:
    rows = []
    for words, runs in zip(listed, found, strict=True):
        best = [None] * 4
        if len(runs):
            start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
            best = [start, length, period, 1000 * length // period]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
        rows.append([len(runs), *best, sha256(lines.encode()).hexdigest(), sha256(b" ".join(kept_words(words, runs))).hexdigest()])
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", *_REPORT])


_REPORT = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def run_report(docs: DataFrame, repeat_tails: bool = True) -> DataFrame:
    """Per document: number of runs, the longest one, digests of all runs and of the text without repeats.

    With ``repeat_tails`` the words of every tenth document (by the CRC of its id) are
    first made periodic from a place on; a null id leaves its text as it is.
    ``start``, ``length``, ``period`` and ``exponent_milli`` are null without a run.
    """
    h = [F.crc32(F.col("doc_id").cast("string")).alias("_h")] if repeat_tails else []
    rows = with_workers(docs.select("doc_id", "text", *h))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return rows.mapInArrow(_over(_digests, LEAST, EXPONENT), shape)


def _spans(part: pa.RecordBatch, listed: list[list[bytes]], found: list[np.ndarray]) -> pa.RecordBatch:
    owner = np.repeat(np.arange(len(found)), [len(r) for r in found])
    runs = np.concatenate(found) if len(owner) else np.empty((0, 3), dtype=np.int64)
    roots = [b" ".join(listed[o][s : s + q]) for o, (s, _, q) in zip(owner.tolist(), runs.tolist(), strict=True)]
    made = [pa.array(runs[:, k], pa.int64()) for k in range(3)]
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id").take(pa.array(owner, pa.int64())), *made, pa.array(roots, pa.binary()).cast(pa.string())],
        ["doc_id", "start", "length", "period", "root"],
    )


def runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row per run: doc_id, start (word number), length, period and the words of its first period."""
    rows = with_workers(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_over(_spans, least, exponent), f"doc_id {kind}, start long, length long, period long, root string")


def collapse(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with ``n_runs`` and ``collapsed``, the text with one period of each run left.

    A text without runs stays as it is, white space included; a null text stays null.
    Input columns of these names are replaced.
    """
    rows = with_workers(docs.drop("n_runs", "collapsed"))

    def make(part: pa.RecordBatch, listed: list[list[bytes]], found: list[np.ndarray]) -> pa.RecordBatch:
        texts = utf8(part.column("text"))
        left = [t if not len(r) else b" ".join(kept_words(w, r)) for t, w, r in zip(texts, listed, found, strict=True)]
        counts = pa.array([len(r) for r in found], pa.int64())
        return pa.RecordBatch.from_arrays([*part.columns, counts, pa.array(left, pa.binary()).cast(pa.string())], [*part.schema.names, "n_runs", "collapsed"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_over(make, least, exponent), f"{shape}, n_runs long, collapsed string")
