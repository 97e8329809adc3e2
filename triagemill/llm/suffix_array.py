"""Suffix arrays by induced sorting and their permuted common prefixes, over whole arrays at once.

A scan of the array induces in batches: as many entries as can be read before one of them places a suffix among them. A batch is some
array operations; in text a few hundred batches do for millions of suffixes.
"""

from __future__ import annotations

import numpy as np

#: Entries that a scan looks at together, at most and at least.
MOST, LEAST = 1 << 17, 64
_ZERO = np.zeros(1, np.int64)


def narrow(alphabet: int) -> type:
    """The type of symbols below `alphabet`: numpy sorts those of 16 bits by counting."""
    return np.uint16 if alphabet <= 1 << 16 else np.int32


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Of each suffix whether it is smaller than the one after it (type S); the last symbol is a sentinel, less than all others."""
    turns = np.flatnonzero(t[:-1] != t[1:])
    s = np.ones(len(t), bool)
    s[:-1] = np.repeat(t[turns] < t[turns + 1], np.diff(turns, prepend=-1))
    return s


def _place(sa: np.ndarray, at: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Put suffixes one after another at the pointers of their symbols, which move by `step`."""
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    first = np.concatenate((_ZERO, (symbols[1:] != symbols[:-1]).nonzero()[0] + 1))
    many = np.concatenate((first[1:], [len(symbols)])) - first
    within = np.arange(len(symbols)) - np.repeat(first, many)
    sa[at[symbols] + step * within] = suffixes[order]
    at[symbols[first]] += step * many


def induce(t: np.ndarray, s: np.ndarray, buckets: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes from the leftmost-smaller ones in order: larger ones by a scan from the left, smaller ones by one from the right."""
    n = len(t)
    sa = np.full(n, -1, np.int32)
    ends = np.cumsum(buckets)
    seeds = t[lms]
    per = np.bincount(seeds, minlength=len(buckets))
    tails = ends - per
    _place(sa, tails, seeds, lms, 1)
    seeded = np.flatnonzero(sa >= 0)
    heads = ends - buckets
    p, look = 0, LEAST
    while p < n:
        q = min(n, p + look)
        before = sa[p:q] - 1
        at = (before >= 0).nonzero()[0]
        pred = before[at]
        larger = ~s[pred]
        pred, at = pred[larger], at[larger]
        if len(pred):
            symbols = t[pred]
            safe = int(heads[symbols].min())
            if safe < q:
                q = safe
                upto = int(np.searchsorted(at, q - p))
                pred, symbols = pred[:upto], symbols[:upto]
            if len(pred):
                _place(sa, heads, symbols, pred, 1)
        look = min(MOST, 2 * look) if q - p >= look else max(LEAST, 2 * (q - p))
        p = q
    # The sentinel alone is a smaller suffix that nothing induces.
    sa[seeded[seeded > 0]] = -1
    tails = ends - 1
    p, look = n, LEAST
    while p > 0:
        q = max(0, p - look)
        before = sa[q:p] - 1
        at = (before >= 0).nonzero()[0]
        pred = before[at]
        smaller = s[pred]
        pred, at = pred[smaller], at[smaller]
        if len(pred):
            symbols = t[pred]
            safe = int(tails[symbols].max()) + 1
            if safe > q:
                upto = int(np.searchsorted(at, safe - q))
                q = safe
                pred, symbols = pred[upto:], symbols[upto:]
            if len(pred):
                _place(sa, tails, symbols[::-1], pred[::-1], -1)
        look = min(MOST, 2 * look) if p - q >= look else max(LEAST, 2 * (p - q))
        p = q
    return sa


def _names(t: np.ndarray, lms: np.ndarray, length: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each leftmost-smaller substring, by its place in `order`; equal ones share one."""
    a, b = order[:-1], order[1:]
    size = length[a]
    same = size == length[b]
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        equal = t[a[open_] + k] == t[b[open_] + k]
        same[open_[~equal]] = False
        k += 1
        open_ = open_[equal]
        open_ = open_[size[open_] > k]
    distinct = int(len(order) - same.sum())
    number = np.empty(len(t), narrow(distinct))
    number[order] = np.concatenate(([0], np.cumsum(~same)))
    return number[lms], distinct


def suffix_array(t: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffixes of `t` in order. Its last symbol is 0 and stands nowhere else; all are below `alphabet`."""
    if len(t) == 1:
        return np.zeros(1, np.int32)
    s = smaller_than_next(t)
    lms = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)
    buckets = np.bincount(t, minlength=alphabet)
    # Sort the leftmost-smaller substrings: their first symbols seed the buckets.
    sorted_by_substring = induce(t, s, buckets, lms)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    order = sorted_by_substring[is_lms[sorted_by_substring]]
    length = np.zeros(len(t), np.int32)
    length[lms] = np.diff(lms, append=len(t) - 1) + 1
    named, distinct = _names(t, lms, length, order)
    if distinct < len(lms):
        order = lms[suffix_array(named, distinct)]
    return induce(t, s, buckets, order)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, barrier: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix, in text order: the one before it in the array (its own place for the first), and how many symbols they share before a
    symbol of at most `barrier`.

    Where both are preceded by the same symbol, the value is one less than that of the suffix to the left; only others are compared."""
    n = len(t)
    phi = np.empty(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = sa[0]
    at = np.arange(n, dtype=np.int32)
    follows = np.zeros(n, bool)
    follows[1:] = (phi[1:] > 0) & (t[:-1] > barrier) & (t[phi[1:] - 1] == t[:-1]) & (phi[1:] != at[1:])
    start = np.flatnonzero(~follows).astype(np.int32)
    shared = np.zeros(len(start), np.int32)
    open_ = np.flatnonzero(phi[start] != start)
    k = 0
    while len(open_):
        left, right = t[start[open_] + k], t[phi[start[open_]] + k]
        open_ = open_[(left == right) & (left > barrier)]
        shared[open_] += 1
        k += 1
    since = np.repeat(start, np.diff(start, append=n))
    return phi, np.maximum(np.repeat(shared, np.diff(start, append=n)) - (at - since), 0)
