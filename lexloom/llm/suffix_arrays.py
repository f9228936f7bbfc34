"""Linear suffix arrays by induced sorting, and permuted longest common prefixes.

`suffix_array` classifies suffixes as smaller (S) or larger (L) than their
right neighbour, sorts the leftmost-smaller (LMS) substrings by induction,
names them, sorts the string of names (by recursion while names repeat) and
induces the whole array from the order of the LMS suffixes. On bytes, an
induction goes bucket by bucket and handles each bucket's entries as numpy
batches; the strings of names have large alphabets and are induced entry by
entry.
"""

from __future__ import annotations

import numpy as np


def smaller(s: np.ndarray) -> np.ndarray:
    """S-type flags; the last position is S."""
    n = len(s)
    ends = np.append(np.flatnonzero(s[1:] != s[:-1]), n - 1)  # the last position of each run
    run = np.searchsorted(ends, np.arange(n))
    nxt = np.minimum(ends[run] + 1, n - 1)
    out = s < s[nxt]
    out[ends[-1] if len(ends) == 1 else ends[-2] + 1 :] = True  # the last run: only the end follows
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of symbols >= 1, followed by one 0 at the end."""
    s = np.asarray(s, np.int64)
    if len(s) < 3:
        return np.arange(len(s))[::-1]
    is_s = smaller(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    largest = int(s.max())
    induce = _by_bucket if largest <= 1 << 10 and len(s) > 16 * largest else _by_entry
    first = induce(s, is_s, lms[np.argsort(s[lms], kind="stable")])
    mark = np.zeros(len(s), bool)
    mark[lms] = True
    order = first[mark[first]]
    names = np.empty(len(s), np.int64)
    names[order] = _named(s, is_s, lms, order)
    reduced = names[lms]  # the end mark is the last and smallest LMS suffix, so this string has an end mark, too
    if reduced.max() + 1 < len(lms):
        at = suffix_array(reduced)
    else:
        at = np.empty(len(lms), np.int64)
        at[reduced] = np.arange(len(lms))
    return induce(s, is_s, lms[at])


def _named(s, is_s, lms, order) -> np.ndarray:
    """Names of the sorted LMS substrings: equal neighbours share one."""
    end = np.append(lms[1:], len(s) - 1)  # the next LMS position, inclusive
    length = np.zeros(len(s), np.int64)
    length[lms] = end - lms + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        ok = (s[x] == s[y]) & (is_s[x] == is_s[y])
        same[live[~ok]] = False
        live = live[ok]
        k += 1
        live = live[length[a[live]] > k]
    return np.concatenate([[0], np.cumsum(~same)])


def _by_bucket(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Induce the array from LMS suffixes in order (by first symbol, then as given)."""
    k = int(s.max()) + 1
    larger: list[list[np.ndarray]] = [[] for _ in range(k)]
    lists_s: list[list[np.ndarray]] = [[] for _ in range(k)]
    cut = np.searchsorted(s[lms], np.arange(k + 1))

    def deal(x: np.ndarray, lists, want_s: bool, c: int):
        """Predecessors of the wanted type to their buckets, in order; returns those of bucket c."""
        p = x[x > 0] - 1
        p = p[is_s[p] == want_s]
        if not len(p):
            return p
        sym = s[p]
        own = p[sym == c]
        rest = sym != c
        p, sym = p[rest], sym[rest]
        if len(p):
            o = np.argsort(sym, kind="stable")
            p, sym = p[o], sym[o]
            edges = np.flatnonzero(np.r_[True, sym[1:] != sym[:-1]])
            for a, b in zip(edges, [*edges[1:], len(p)], strict=True):
                lists[sym[a]].append(p[a:b])
        return own

    for c in range(k):  # larger suffixes, from the front
        batch = np.concatenate(larger[c]) if larger[c] else lms[:0]
        done = [batch]
        while len(batch):
            batch = deal(batch, larger, False, c)
            done.append(batch)
        larger[c] = [np.concatenate(done)]
        if cut[c] < cut[c + 1]:
            deal(lms[cut[c] : cut[c + 1]], larger, False, c)
    for c in range(k - 1, -1, -1):  # smaller suffixes, from the back; lists are in falling order
        batch = np.concatenate(lists_s[c]) if lists_s[c] else lms[:0]
        done = [batch]
        while len(batch):
            batch = deal(batch, lists_s, True, c)
            done.append(batch)
        lists_s[c] = [np.concatenate(done)]
        if len(larger[c][0]):
            deal(larger[c][0][::-1], lists_s, True, c)
    lists_s[0] = [np.array([len(s) - 1], np.int64)]  # the end mark
    return np.concatenate([x for c in range(k) for x in (larger[c][0], lists_s[c][0][::-1])])


def _by_entry(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same, entry by entry."""
    ends = np.cumsum(np.bincount(s))
    text, small, n = s.tolist(), is_s.tolist(), len(s)
    sa, tail = [-1] * n, ends.tolist()
    for i in reversed(lms.tolist()):
        c = text[i]
        tail[c] -= 1
        sa[tail[c]] = i
    head = [0, *ends[:-1].tolist()]
    for j in range(n):
        i = sa[j] - 1
        if i >= 0 and not small[i]:
            c = text[i]
            sa[head[c]] = i
            head[c] += 1
    tail = ends.tolist()
    for j in range(n - 1, -1, -1):
        i = sa[j] - 1
        if i >= 0 and small[i]:
            c = text[i]
            tail[c] -= 1
            sa[tail[c]] = i
    sa[0] = n - 1
    return np.array(sa, np.int64)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each text position, the common prefix with the suffix before it in the array.

    Only irreducible values (those whose left symbols differ) are compared
    symbol by symbol; along the text each other one is one less than its left
    neighbour's.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    left = (i > 0) & (phi > 0)
    bound = phi < 0
    same_left = left.copy()
    same_left[left] = s[i[left] - 1] == s[phi[left] - 1]
    plcp = np.zeros(n, np.int64)
    start = np.flatnonzero(~same_left)
    live = start[~bound[start]]
    k = 0
    while len(live):
        x, y = live + k, phi[live] + k
        ok = (x < n) & (y < n)
        ok[ok] = s[x[ok]] == s[y[ok]]
        plcp[live[~ok]] = k
        live = live[ok]
        k += 1
    at = np.maximum.accumulate(np.where(same_left, 0, i))
    return np.where(bound, 0, np.maximum(plcp[at] - (i - at), 0))
