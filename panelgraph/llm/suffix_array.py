"""Suffix arrays by induced sorting, and permuted common prefixes.

The text of a shard is sorted level by level: suffixes are classified as S (smaller than the next
one) or L, the leftmost S suffixes (LMS) are put in buckets, an L pass and an S pass induce the
order of LMS substrings, their ranks form a shorter text that is sorted recursively, and a second
pair of passes induces the whole array. On the byte level a pass handles each bucket at once in
numpy; the shorter texts have wide alphabets and use lists. All of it takes linear time.
"""

from __future__ import annotations

import numpy as np


def _is_s(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one after them; the last is S."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(np.diff(t.astype(np.int32)))
    step[-1] = 1
    nxt = np.where(step != 0, np.arange(n), n - 1)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    return step[nxt] > 0


class _Piles:
    """For each symbol the positions pushed to it, in order."""

    def __init__(self, t: np.ndarray, size: int) -> None:
        self.t, self.of = t, [[] for _ in range(size)]

    def push(self, at: np.ndarray) -> None:
        if not len(at):
            return
        c = self.t[at]
        order = np.argsort(c, kind="stable")
        at, c = at[order], c[order]
        cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
        ends = [*cuts.tolist(), len(at)]
        start = 0
        for end in ends:
            self.of[int(c[start])].append(at[start:end])
            start = end

    def take(self, c: int) -> np.ndarray:
        out = self.of[c]
        self.of[c] = []
        return np.concatenate(out) if out else np.empty(0, np.int64)


def _induce(t: np.ndarray, s: np.ndarray, size: int, lms: np.ndarray) -> np.ndarray:
    """The suffix array that sorted LMS suffixes induce (or the order of LMS substrings, from unsorted ones)."""
    seeds, piles, left = _Piles(t, size), _Piles(t, size), []
    seeds.push(lms)
    for c in range(size):
        cur, done = piles.take(c), []
        while len(cur):
            done.append(cur)
            pred = cur[cur > 0] - 1
            pred = pred[~s[pred]]
            same = t[pred] == c
            piles.push(pred[~same])
            cur = pred[same]
        seed = seeds.take(c)
        piles.push(seed[seed > 0] - 1)
        left.append(np.concatenate(done) if done else np.empty(0, np.int64))
    out: list[np.ndarray] = [np.empty(0, np.int64)] * size
    piles = _Piles(t, size)
    piles.of[0].append(np.array([len(t) - 1]))
    for c in range(size - 1, -1, -1):
        cur, done = piles.take(c), []
        while len(cur):
            done.append(cur)
            pred = cur[cur > 0] - 1
            pred = pred[s[pred]]
            same = t[pred] == c
            piles.push(pred[~same])
            cur = pred[same]
        back = left[c][::-1]
        pred = back[back > 0] - 1
        piles.push(pred[s[pred]])
        out[c] = np.concatenate([left[c], np.concatenate(done)[::-1]]) if done else left[c]
    return np.concatenate(out)


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings, in text order; equal substrings share a rank."""
    n = len(t)
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = t[a[live] + k] == t[b[live] + k]
        same[live[~equal]] = False
        live = live[equal]
        k += 1
        live = live[length[a[live]] > k]
    rank = np.zeros(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(~same)])
    return rank[lms]


def _by_lists(t: list[int], size: int) -> list[int]:
    """The suffix array of integers below size, whose last is the only 0."""
    n = len(t)
    if n == 1:
        return [0]
    s = bytearray(n)
    s[-1] = 1
    for i in range(n - 2, -1, -1):
        s[i] = t[i] < t[i + 1] or (t[i] == t[i + 1] and s[i + 1])
    count = [0] * (size + 1)
    for c in t:
        count[c + 1] += 1
    for c in range(size):
        count[c + 1] += count[c]
    lms = [i for i in range(1, n) if s[i] and not s[i - 1]]

    def induce(seed: list[int]) -> list[int]:
        sa, tail = [-1] * n, count[1:]
        for i in reversed(seed):
            tail[t[i]] -= 1
            sa[tail[t[i]]] = i
        head = count[:-1]
        for k in range(n):
            j = sa[k] - 1
            if j >= 0 and not s[j]:
                sa[head[t[j]]] = j
                head[t[j]] += 1
        tail = count[1:]
        for k in range(n - 1, -1, -1):
            j = sa[k] - 1
            if j >= 0 and s[j]:
                tail[t[j]] -= 1
                sa[tail[t[j]]] = j
        return sa

    first = [i for i in induce(lms) if i > 0 and s[i] and not s[i - 1]]
    end = dict(zip(lms, [*lms[1:], n - 1], strict=True))
    rank, name, last = {}, -1, None
    for i in first:
        cut = t[i : end[i] + 1]
        if cut != last:
            name, last = name + 1, cut
        rank[i] = name
    if name + 1 < len(lms):
        lms = [lms[i] for i in _by_lists([rank[i] for i in lms], name + 1)]
    else:
        lms = first
    return induce(lms)


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """The suffix array of symbols below size; the last symbol must be the only 0."""
    s = _is_s(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(lms) == 0:
        return np.arange(len(t))[::-1]
    order = _induce(t, s, size, lms)
    mark = np.zeros(len(t), bool)
    mark[lms] = True
    order = order[mark[order]]
    names = _names(t, lms, order)
    if names.max() + 1 < len(lms):
        order = lms[np.array(_by_lists(names.tolist(), int(names.max()) + 1))]
    return _induce(t, s, size, order)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position the prefix it shares with its predecessor in sa, up to most.

    Kept in text order (permuted). Where position and predecessor both follow a matching pair,
    the length is one less than before it; only the other, irreducible ones are compared.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    follows = np.zeros(n, bool)
    follows[1:] = (phi[1:] == phi[:-1] + 1) & (phi[:-1] >= 0)
    follows[1:] &= t[i[:-1]] == t[np.maximum(phi[:-1], 0)]
    heads = np.flatnonzero(~follows)
    # The common prefix at a head, to the end: a run of reducible positions takes off one each.
    runs = np.diff(np.append(heads, n))
    padded = np.concatenate([t, np.zeros(8, t.dtype)])
    bound = most + runs
    length = np.zeros(len(heads), np.int64)
    live = np.flatnonzero(phi[heads] >= 0)
    k = 0
    while len(live):
        a, b = heads[live] + k, phi[heads[live]] + k
        ok = (a < n) & (b < n)
        equal = np.zeros(len(live), bool)
        equal[ok] = padded[a[ok]] == padded[b[ok]]
        length[live[equal]] += 1
        k += 1
        live = live[equal]
        live = live[bound[live] > k]
    lcp = np.repeat(length, runs) - (i - np.repeat(heads, runs))
    return np.maximum(lcp, 0)
