"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are smaller (S) or larger (L) than the one after them; the leftmost S of each run are sorted by their substrings, ranked
recursively where those are alike, and the order of all others follows by induction from the smallest bucket to the largest and back. Where buckets
are few and large, as for bytes, all entries of a bucket are placed at once; where they are many and small, as for the names
of substrings, entries are placed one after another. Either way the work is in proportion to the length.

The common prefix of a suffix with the one before it in order is one less than that of its left neighbour in the text, unless
the two are preceded by different symbols (irreducible); only irreducible ones are compared, and their sum is small (Kärkkäinen,
Manzini and Puglisi 2009).
"""

from __future__ import annotations

import numpy as np

#: Symbols in a bucket on average, from which buckets are placed at once.
LARGE_BUCKETS = 256


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last is."""
    n = len(s)
    step = np.flatnonzero(s[:-1] != s[1:])
    out = np.ones(n, bool)
    if len(step):
        after = np.searchsorted(step, np.arange(n - 1))
        run = step[np.minimum(after, len(step) - 1)]
        out[:-1] = s[run] < s[run + 1]
        out[:-1][after == len(step)] = True
    return out


def _place(sa: np.ndarray, at: np.ndarray, new: np.ndarray, keys: np.ndarray, step: int) -> None:
    """Puts new into its keys' buckets in order, from at, which moves by step."""
    order = np.argsort(keys, kind="stable")
    new, keys = new[order], keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(first, len(keys)))
    within = np.arange(len(keys)) - np.repeat(first, sizes)
    sa[at[keys] + step * within] = new
    at[keys[first]] += step * sizes


def _induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the seeds, leftmost S suffixes in their order. ends: of the buckets."""
    n, sigma = len(s), len(ends)
    heads = np.concatenate(([0], ends[:-1]))
    sa = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    tails = ends - 1
    _place(sa, tails.copy(), seeds[::-1], s[seeds[::-1]], -1)
    seeded = np.bincount(s[seeds], minlength=sigma)
    at = heads.copy()
    for c in range(sigma):  # larger suffixes, from the smallest bucket up
        done = heads[c]
        while done < at[c]:
            now, done = sa[done : at[c]], at[c]
            before = now[now > 0] - 1
            before = before[~small[before]]
            if len(before):
                _place(sa, at, before, s[before], 1)
        if seeded[c]:
            now = sa[ends[c] - seeded[c] : ends[c]]
            before = now[now > 0] - 1
            before = before[~small[before]]
            if len(before):
                _place(sa, at, before, s[before], 1)
    larger = at
    at = tails.copy()
    for c in range(sigma - 1, -1, -1):  # smaller suffixes, from the largest bucket down
        done = tails[c]
        while done > at[c]:
            now, done = sa[at[c] + 1 : done + 1][::-1], at[c]
            before = now[now > 0] - 1
            before = before[small[before]]
            if len(before):
                _place(sa, at, before, s[before], -1)
        if larger[c] > heads[c]:
            now = sa[heads[c] : larger[c]][::-1]
            before = now[now > 0] - 1
            before = before[small[before]]
            if len(before):
                _place(sa, at, before, s[before], -1)
    return sa


def _induce_singly(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same as _induce, one suffix after another."""
    n = len(s)
    before = np.append(np.append(-1, s[:-1]), -1).astype(np.int64)  # the symbol before, if it has its place yet to find; n stands for none
    after_small = np.append(np.append(False, small[:-1]), False)
    text, large_before, small_before = s.tolist(), np.where(after_small, -1, before).tolist(), np.where(after_small, before, -1).tolist()
    sa = [n] * n
    tails = ends.tolist()
    for i in seeds[::-1].tolist():
        c = text[i]
        tails[c] -= 1
        sa[tails[c]] = i
    heads = [0, *ends[:-1].tolist()]
    for i in sa:  # sees what is placed on the way
        c = large_before[i]
        if c >= 0:
            sa[heads[c]] = i - 1
            heads[c] += 1
    tails = ends.tolist()
    for at in range(n - 1, -1, -1):
        i = sa[at]
        c = small_before[i]
        if c >= 0:
            tails[c] -= 1
            sa[tails[c]] = i - 1
    return np.array(sa)


def _sorted_substrings(s: np.ndarray, small: np.ndarray, left: np.ndarray, rounds: int = 64) -> tuple[np.ndarray, np.ndarray] | None:
    """(leftmost S suffixes in order of their substrings, names), a symbol at a time of those still alike; None if that takes too long."""
    key = s.astype(np.int64) * 2 + small  # of equal symbols, those that begin larger suffixes come first
    size = np.append(left[1:], len(s) - 1) - left
    rank, active, wide = np.zeros(len(left), np.int64), np.arange(len(left)), int(key.max()) + 1
    for o in range(rounds):
        both = rank[active] * wide + key[left[active] + o]
        order = np.argsort(both, kind="stable")
        active, both = active[order], both[order]
        new = np.ones(len(active), bool)
        new[1:] = both[1:] != both[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        old = rank[active]
        begin = np.ones(len(active), bool)
        begin[1:] = old[1:] != old[:-1]
        base = np.flatnonzero(begin)[np.cumsum(begin) - 1]  # where the wider group began among the active
        rank[active] = old + first[group] - base
        alone = np.diff(np.append(first, len(active)))[group] == 1
        active = active[~alone & (size[active] > o)]
        if not len(active):
            order = np.argsort(rank, kind="stable")
            return left[order], np.cumsum(np.concatenate(([0], rank[order][1:] != rank[order][:-1])))
    return None


def suffix_array(s: np.ndarray, sigma: int, large: int = LARGE_BUCKETS) -> np.ndarray:
    """Suffix array of s, whose values are below sigma and whose last value is 0 and occurs nowhere else."""
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable") if n < 2 or s[0] != s[1] else np.arange(n)[::-1]
    if sigma <= 1 << 16:
        s = s.astype(np.uint16)  # numpy sorts numbers of 16 bits by radix
    small = _types(s)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(s, minlength=sigma))
    singly = sigma * large > n
    induce = _induce_singly if singly else _induce
    found = _sorted_substrings(s, small, left) if singly else None
    if found:
        order, names = found
    else:
        sa = induce(s, small, left, ends)
        is_left = np.zeros(n, bool)
        is_left[left] = True
        order = sa[is_left[sa]]
        names = _names(s, left, order)
    if names[-1] + 1 == len(order):
        return induce(s, small, order, ends)
    rank_of = np.empty(n, np.int64)
    rank_of[order] = names
    order = left[suffix_array(rank_of[left], int(names[-1]) + 1, large)]
    return induce(s, small, order, ends)


def _names(s: np.ndarray, left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For the leftmost S suffixes in order: equal numbers for equal substrings up to the next of them."""
    stop = np.append(left[1:], len(s) - 1)
    length_of = np.zeros(len(s), np.int64)
    length_of[left] = stop - left + 1
    a, b = order[:-1], order[1:]
    same = length_of[a] == length_of[b]
    open_, o = np.flatnonzero(same), 0
    while len(open_):
        x, y = a[open_], b[open_]
        differ = s[np.minimum(x + o, len(s) - 1)] != s[np.minimum(y + o, len(s) - 1)]
        same[open_[differ]] = False
        o += 1
        open_ = open_[~differ & (length_of[x] > o)]
    return np.concatenate(([0], np.cumsum(~same)))


def words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every position but the last seven, as numbers."""
    raw = np.ascontiguousarray(raw)
    return np.ndarray(max(0, len(raw) - 7), "<u8", raw.data, strides=(1,)).copy() if len(raw) > 7 else np.zeros(0, np.uint64)


def common_prefixes(raw: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix of raw, in the order of the text, how many symbols it shares with the one before it in sa (0 for the first)."""
    n = len(raw)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    irreducible = np.ones(n, bool)
    here = np.arange(1, n)
    irreducible[1:] = (phi[1:] <= 0) | (phi[:-1] < 0) | (raw[here - 1] != raw[phi[1:] - 1])
    at = np.flatnonzero(irreducible & (phi >= 0))
    other, shared = phi[at], np.zeros(len(at), np.int64)
    eight = words_at(np.concatenate((raw, np.zeros(16, np.uint8))))
    open_ = np.arange(len(at))
    while len(open_) > 64:  # eight bytes of all at a time
        a, b = at[open_] + shared[open_], other[open_] + shared[open_]
        differ = eight[a] ^ eight[b]
        bits = differ & (~differ + np.uint64(1))  # the lowest bit in which they differ
        same = np.where(differ == 0, 8, np.log2(np.maximum(bits, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        same = np.minimum(same, n - np.maximum(a, b))
        shared[open_] += same
        open_ = open_[same == 8]
    for k in open_.tolist():  # the few long ones, in stretches that grow
        a, b, step = int(at[k] + shared[k]), int(other[k] + shared[k]), 64
        while True:
            x, y = raw[a : a + step], raw[b : b + step]
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            shared[k] += differ[0] if len(differ) else m
            if len(differ) or m < step:
                break
            a, b, step = a + m, b + m, min(step * 2, 1 << 16)
    last = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    value = np.zeros(n, np.int64)
    value[at] = shared
    return np.maximum(value[last] - (np.arange(n) - last), 0)


def repeats(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, class) of every stretch of so many bytes within a text; equal stretches share a class."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # no UTF-8 text holds that byte
    s = np.empty(len(raw) + 1, np.uint16)
    s[:-1] = raw
    s[:-1] += 2
    s[:-1][begins + sizes - 1] = 1
    s[-1] = 0
    sa = suffix_array(s, 258)[1:]
    kind = np.cumsum(common_prefixes(raw, sa)[sa] < length)
    owner = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(raw)) - begins[owner]
    whole = (offset + length <= sizes[owner] - 1)[sa]
    return owner[sa[whole]], offset[sa[whole]], kind[whole]
