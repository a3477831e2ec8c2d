"""Suffix arrays by induced sorting and permuted common prefixes.

A text of bytes is induced a bucket at a time with numpy, a string of names in all buckets at once.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes: smaller than the suffix that follows. t ends with a unique least symbol."""
    n = len(t)
    s = np.zeros(n, bool)
    s[-1] = True
    if n > 1:
        change = np.flatnonzero(t[1:] != t[:-1])  # the last place of each run of equal symbols
        rising = t[change] < t[change + 1]
        runs = np.diff(np.concatenate(([-1], change)))
        s[: change[-1] + 1] = np.repeat(rising, runs)
    return s


def _induce(t: np.ndarray, s: np.ndarray, heads: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that the order of the given leftmost-S suffixes induces.

    One pass over the buckets upwards places the L-type suffixes, one downwards the S-type ones;
    all that a bucket induces is dealt to its targets at once by a stable sort of their symbols.
    """
    n, k = len(t), len(heads) - 1
    sa = np.full(n, -1, np.int32)
    of = np.searchsorted  # lms comes sorted by symbol
    symbol = t[lms]
    order = np.argsort(symbol, kind="stable")
    lms = lms[order]
    edges = of(symbol[order], np.arange(k + 1))
    fill = heads[:-1].copy()

    def deal(found: np.ndarray, up: bool, ends: np.ndarray | None = None) -> None:
        sym = t[found]
        order = np.argsort(sym, kind="stable")
        found, sym = found[order], sym[order]
        cut = np.flatnonzero(np.concatenate(([True], sym[1:] != sym[:-1], [True])))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            c = sym[a]
            if up:
                sa[fill[c] : fill[c] + b - a] = found[a:b]
                fill[c] += b - a
            else:
                sa[ends[c] - (b - a) : ends[c]] = found[a:b][::-1]
                ends[c] -= b - a

    present = np.flatnonzero(np.diff(heads)).tolist()
    for c in present:
        lo = heads[c]
        while lo < fill[c]:  # L-type suffixes of this bucket may induce further ones in it
            hi = fill[c]
            j = sa[lo:hi] - 1
            own = j[(j >= 0)]
            own = own[(t[own] == c) & ~s[own]]
            sa[fill[c] : fill[c] + len(own)] = own
            fill[c] += len(own)
            lo = hi
        mine = np.concatenate((sa[heads[c] : fill[c]], lms[edges[c] : edges[c + 1]]))
        j = mine - 1
        j = j[j >= 0]
        j = j[(t[j] > c) & ~s[j]]
        if len(j):
            deal(j, True)
    ends = heads[1:].copy()
    limit = fill.copy()  # L-type suffixes stand below
    for c in reversed(present):
        hi = heads[c + 1]
        while ends[c] < hi:  # S-type suffixes of this bucket, from its end
            lo = ends[c]
            j = sa[lo:hi][::-1] - 1
            own = j[j >= 0]
            own = own[(t[own] == c) & s[own]]
            sa[ends[c] - len(own) : ends[c]] = own[::-1]
            ends[c] -= len(own)
            hi = lo
        mine = np.concatenate((sa[heads[c] : limit[c]], sa[ends[c] : heads[c + 1]]))[::-1]
        j = mine - 1
        j = j[j >= 0]
        j = j[(t[j] < c) & s[j]]
        if len(j):
            deal(j, False, ends)
    sa[0] = n - 1
    return sa


def _named(t: np.ndarray, order: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each leftmost-S substring, in sorted order, differs from the one before; end: their last places."""
    a, b = order[:-1], order[1:]
    size = end[order] - order
    differs = np.ones(len(order), bool)
    alive = np.flatnonzero(size[:-1] == size[1:])
    k = 0
    while len(alive):
        same = t[a[alive] + k] == t[b[alive] + k]
        alive = alive[same]
        done = size[alive] == k
        differs[alive[done] + 1] = False
        alive = alive[~done]
        k += 1
    return differs


def _refined(rank: np.ndarray, size: int, look, rounds: int | None = None) -> np.ndarray:
    """Ranks with ties broken by look(round, tied places), round by round until none is left or all say the same.

    A rank is the number of lesser places, so breaking a tie changes no other rank. look gives None at the end.
    """
    tied = np.flatnonzero(np.bincount(rank, minlength=size)[rank] > 1)
    k = 0
    while len(tied) and (more := look(k, tied)) is not None:
        order = np.argsort(rank[tied] * (int(more.max()) + 1) + more)  # both are under twice the number of places
        tied, more = tied[order], more[order]
        old = rank[tied]
        group = np.concatenate(([True], old[1:] != old[:-1]))
        new = group | np.concatenate(([True], more[1:] != more[:-1]))
        at = np.arange(len(tied))
        start = np.maximum.accumulate(np.where(group, at, 0))
        first = np.maximum.accumulate(np.where(new, at, 0))
        rank[tied] = old + first - start
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        k += 1
    return rank


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    found = key[order]
    cut = np.concatenate(([True], found[1:] != found[:-1]))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.maximum.accumulate(np.where(cut, np.arange(len(key)), 0))
    return rank


def _chained(key: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranks of places by the keys from each on, up to the first place of `end`; keys of ends differ from all others."""
    n = len(key)
    rank = _ranked(key)
    jump = np.where(end, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))

    def look(k: int, tied: np.ndarray) -> np.ndarray | None:
        nonlocal jump
        if k:
            jump = jump[jump]
        to = rank[jump[tied]]
        return to if k < 64 and not (end[tied].all()) else None

    return _refined(rank, n, look)


def _induced(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As _induce, for alphabets so large that most buckets are tiny: all buckets at once.

    An L-type suffix is told by its symbols down to the leftmost-S suffix that they end in, an
    S-type one by its symbols up to an L-type suffix; both are ranked by doubling their chains.
    """
    n = len(t)
    place = np.zeros(n, np.int64)
    place[lms] = np.arange(1, len(lms) + 1)  # ends: after the L-type suffixes of their symbol, in their order
    base = t.astype(np.int64) * (2 * n + 2)
    large = np.flatnonzero(~s | (place > 0))
    inside = np.full(n, -1)
    inside[large] = np.arange(len(large))
    rank = np.full(n, -1)
    rank[large] = _chained(base[large] + place[large], s[large])
    follows = np.concatenate(([False], s[:-1])) & ~s
    small = np.flatnonzero(s | follows)
    key = base[small] + np.where(s[small], n + 1, rank[small])
    rank[small] = np.where(s[small], _chained(key, ~s[small] | (small == n - 1)), rank[small])
    return np.argsort((t.astype(np.int64) * 2 + s) * n + rank)


def _names(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The names of the leftmost-S substrings, in text order, from 0 on."""
    u = np.append(t.astype(np.int64) * 2 + s, 0)
    longest = int(np.diff(lms, append=len(t)).max())

    def look(k: int, tied: np.ndarray) -> np.ndarray | None:
        return u[np.minimum(lms[tied] + k + 2, len(t))] if k < longest else None

    rank = _refined(_ranked(u[lms] * (2 * int(t.max()) + 2) + u[lms + 1]), len(lms), look)
    return np.unique(rank, return_inverse=True)[1].astype(np.int32)


def _sorted(t: np.ndarray, depth: int | None) -> np.ndarray:
    """The suffix array of t, symbols from 0 on of which the last is the only 0."""
    n, k = len(t), int(t.max()) + 1
    if n == 1 or depth is not None and depth <= 1:
        return np.argsort(t, kind="stable")
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    small = k <= 1 << 10
    if small:
        heads = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=k))))
        sa = _induce(t, s, heads, lms)
        is_lms, end, name = np.zeros(n, bool), np.zeros(n, np.int32), np.zeros(n, np.int32)
        is_lms[lms] = True
        order = sa[is_lms[sa]]
        end[lms] = np.append(lms[1:], n - 1)
        name[order] = np.cumsum(_named(t, order, end)) - 1
        names = name[lms]  # in text order; the end is the only 0
        del name, end, is_lms, sa, order
    else:
        names = _names(t, s, lms)
    order = np.argsort(names) if names.max() + 1 == len(lms) else _sorted(names, None if depth is None else depth // 2 + 1)
    lms = lms[order]  # a leftmost-S substring takes two symbols at least
    return _induce(t, s, heads, lms) if small else _induced(t, s, lms)


def suffix_array(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The suffix array of data (unsigned bytes) followed by an end that is less than all.

    The leftmost-S substrings are sorted by induction and named; where names repeat, the string
    of names is sorted in the same way, recursively, and its array puts the leftmost-S suffixes
    in order, which then induce all others. With `depth`, suffixes that agree in their first
    `depth` bytes may stand in any order. Place 0 of the result is the end itself.
    """
    return _sorted(np.append(data.astype(np.uint16) + np.uint16(1), np.uint16(0)), depth)  # small symbols sort by radix


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """plcp[i]: the common prefix of suffix i and the one before it in sa, `most` at most."""
    n = len(data)
    before = np.full(n + 1, n, np.int32)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate((data, np.zeros(most + 16, np.uint8)))
    words = np.zeros(n + most + 8, np.uint64)  # the eight bytes from each place on
    for k in range(8):
        words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(8 * k)
    plcp, alive = np.zeros(n, np.int32), np.arange(n, dtype=np.int32)
    for k in range(0, most, 8):
        i, j = alive + k, before[alive] + k
        apart = words[i] ^ words[j]
        same = apart == 0
        dead = ~same
        low = apart[dead]
        plcp[alive[dead]] = k + sum(((low & np.uint64((1 << 8 * b) - 1)) == 0).astype(np.int64) for b in range(1, 8))
        alive = alive[same]
        plcp[alive] = k + 8
        if not len(alive):
            break
    return np.minimum(plcp, np.minimum(n - np.maximum(np.arange(n), before[:n]), most))
