"""Suffix arrays by induced sorting, a bucket of suffixes at a time, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def _types(t):
    """True where a suffix is smaller than its successor; the last symbol is a sentinel smaller than all."""
    d = np.sign(np.diff(t))
    at = np.where(d != 0, np.arange(len(d)), len(d))
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(len(t), bool)
    known = nxt < len(d)
    out[:-1][known] = d[nxt[known]] > 0
    return out


def _groups(ch):
    """Stable order by symbol, the symbols, their counts and each element's place in its group."""
    order = np.argsort(ch, kind="stable")
    c = ch[order]
    cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    n = np.diff(np.append(cut, len(c)))
    return order, c[cut], n, np.arange(len(c)) - np.repeat(cut, n)


def _induce(t, small, lms, k):
    """The suffix array (to the depth that the order of lms gives) by one scan up and one scan down over the buckets."""
    count = np.bincount(t, minlength=k)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(len(t), -1, np.int64)
    order, c, n, place = _groups(t[lms])
    first = end.copy()
    first[c] = end[c] - n
    sa[np.repeat(first[c], n) + place] = lms[order]
    ptr = start.copy()

    def up(w):
        p = w[w > 0] - 1
        p = p[~small[p]]
        if len(p):
            o, c, n, place = _groups(t[p])
            sa[np.repeat(ptr[c], n) + place] = p[o]
            ptr[c] += n

    live = np.flatnonzero(count)
    for b in live:
        i = start[b]
        while i < ptr[b]:
            j = ptr[b]
            up(sa[i:j])
            i = j
        if first[b] < end[b]:
            up(sa[first[b] : end[b]])
    top = ptr.copy()  # where the larger-type suffixes of a bucket end
    ptr = end.copy()

    def down(w):
        w = w[::-1]
        p = w[w > 0] - 1
        p = p[small[p]]
        if len(p):
            o, c, n, place = _groups(t[p])
            sa[np.repeat(ptr[c], n) - 1 - place] = p[o]
            ptr[c] -= n

    for b in live[::-1]:
        i = end[b]
        if b == 0:  # the sentinel is in place
            ptr[0] = min(ptr[0], end[0] - 1) if ptr[0] == end[0] else ptr[0]
        while i > ptr[b]:
            j = ptr[b]
            down(sa[j:i])
            i = j
        if start[b] < top[b]:
            down(sa[start[b] : top[b]])
    return sa


def _doubling(r, depth):
    """Order of the suffixes of r, equal to at least ``depth`` symbols, by sorting pairs of ranks."""
    n, k = len(r), 1
    _, rank = np.unique(r, return_inverse=True)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] + 1
        key = rank.astype(np.int64) * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if new[-1] == n - 1 or k >= min(depth, n):
            return order


def suffix_array(t, depth: int = 512, wide: int = 1024):
    """Suffix array of an integer array that ends in its only smallest symbol, 0; to ``depth`` symbols at least.

    Suffixes are classified as smaller or larger than their successors; leftmost-smaller substrings are sorted by
    induction and named; the string of names is sorted the same way, or by doubling once it has over ``wide`` names; then
    all suffixes are induced from it.
    """
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable")
    k = int(t.max()) + 1
    small = _types(t)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) > 1:
        sa = _induce(t, small, lms, k)
        by = sa[is_lms[sa]]
        length = np.empty(n, np.int64)
        length[lms] = np.append(np.diff(lms), 0) + 1
        a, b = by[:-1], by[1:]
        same = length[a] == length[b]
        live, i = np.flatnonzero(same), 0
        while len(live):
            live = live[length[a[live]] > i]
            if not len(live):
                break
            eq = t[a[live] + i] == t[b[live] + i]
            same[live[~eq]] = False
            live = live[eq]
            i += 1
        name = np.empty(n, np.int64)
        name[by] = np.concatenate([[0], np.cumsum(~same)])
        r = name[lms]
        names = int(r.max()) + 1
        if names < len(r):
            lms = lms[suffix_array(r, depth, wide) if names <= wide else _doubling(r, depth)]
        else:
            lms = lms[np.argsort(r, kind="stable")]
    return _induce(t, small, lms, k)


def repeated(t, need: int):
    """Mask of the positions of t (bytes with 0 between and after texts as symbol 0, others shifted up by one) whose next
    ``need`` symbols, all of one text, also start elsewhere in t."""
    n = len(t)
    out = np.zeros(n, bool)
    if n < need:
        return out
    s = np.append(t + 1, 0)
    sa = suffix_array(s, depth=n + 1)  # common prefixes need the whole order
    phi = np.full(n + 1, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n + 1)
    # a common prefix ends where a text ends; it is irreducible if it is not that of the position before, less one
    prev_same = np.zeros(n + 1, bool)
    ok = (i > 0) & (phi > 0)
    prev_same[ok] = (s[i[ok] - 1] == s[phi[ok] - 1]) & (s[i[ok] - 1] > 1)
    live = np.flatnonzero(~prev_same & (phi >= 0))
    lcp, depth = np.zeros(n + 1, np.int64), 0
    text = np.where(s > 1, s, -1)
    other = np.where(s > 1, s, -2)
    while len(live):
        live = live[text[live + depth] == other[phi[live] + depth]]
        depth += 1
        lcp[live] = depth
    lcp = np.maximum.accumulate(np.where(prev_same, 0, lcp + i)) - i
    good = np.flatnonzero((lcp >= need) & (phi >= 0))
    end = np.append(np.flatnonzero(t == 0), n)
    left = end[np.searchsorted(end, np.arange(n))] - np.arange(n)
    good = good[good < n]
    good = good[left[good] >= need]
    out[good] = True
    out[phi[good]] = True
    return out
