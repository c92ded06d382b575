"""Suffix arrays by induced sorting and permuted common prefixes, on whole NumPy arrays.

Suffixes are classed as smaller (S) or larger (L) than their successor; the leftmost smaller ones (LMS) are
sorted by their substrings, which one induction orders and names; names that repeat are sorted by the suffixes
of the string of names; a second induction spreads that order to all suffixes in linear time. An induction
walks through the buckets of the alphabet; what one bucket induces is placed as an array, in scan order.

The string of names is sorted in the same way again while its alphabet is small. With a large one, where most buckets
would hold one suffix and a walk through buckets would no longer work on arrays, its ranks are doubled, by counting
sorts of 16-bit digits. With a given `depth`, as all callers here have it, that takes about log2(depth) rounds of a
fixed number of counting sorts, so that this step is linear in the text, too.
"""

from __future__ import annotations

import numpy as np

#: A string of names with more symbols than this is sorted by doubling: most buckets would hold one suffix.
MOST_BUCKETS = 2048


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last suffix is."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.r_[change, n - 1]
    rising = np.r_[text[change] < text[change + 1], True]
    return np.repeat(rising, np.diff(np.r_[-1, ends]))


def _place(sa: np.ndarray, at: np.ndarray, chars: np.ndarray, where: np.ndarray, step: int) -> None:
    """Append `where` to the buckets of `chars` at their pointers `at`, in order, upward or downward."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    size = np.diff(np.r_[first, len(c)])
    rank = np.arange(len(c)) - np.repeat(first, size)
    sa[at[c] + step * rank] = where[order]
    at[c[first]] += step * size


def _induce(text: np.ndarray, smaller: np.ndarray, starts: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that the given order of LMS suffixes induces; buckets are starts[c]..ends[c] - 1."""
    sa = np.full(len(text), -1, np.int32)
    tail = ends - 1
    _place(sa, tail, text[lms[::-1]], lms[::-1], -1)
    lms_from, head = tail + 1, starts.copy()
    for c in range(len(starts)):
        scan = starts[c]
        while True:
            stop = head[c]
            if scan < stop:
                batch, scan = sa[scan:stop], stop
            elif scan != ends[c] and lms_from[c] < ends[c]:
                batch, scan = sa[lms_from[c] : ends[c]], ends[c]
            else:
                break
            prev = batch[batch > 0] - 1
            prev = prev[~smaller[prev]]
            if len(prev):
                _place(sa, head, text[prev], prev, 1)
            if scan == ends[c]:
                break
    tail = ends - 1
    for c in range(len(starts) - 1, -1, -1):
        scan = ends[c] - 1
        while True:
            stop = tail[c]
            if scan > stop:
                batch, scan = sa[stop + 1 : scan + 1][::-1], stop
            else:
                break
            prev = batch[batch > 0] - 1
            prev = prev[smaller[prev]]
            if len(prev):
                _place(sa, tail, text[prev], prev, -1)
        larger = sa[starts[c] : head[c]][::-1]
        prev = larger[larger > 0] - 1
        prev = prev[smaller[prev]]
        if len(prev):
            _place(sa, tail, text[prev], prev, -1)
    return sa


def _counting_order(*keys: tuple[np.ndarray, int]) -> np.ndarray:
    """Stable order by several (key, greatest value), the first one leading: counting sorts of 16-bit digits."""
    order = None
    for key, most in reversed(keys):
        for shift in range(0, max(1, int(most).bit_length()), 16):
            digit = (key >> shift).astype(np.uint16)
            step = np.argsort(digit if order is None else digit[order], kind="stable")
            order = step if order is None else order[step]
    return order


def _doubling(names: np.ndarray, depth: int | None) -> np.ndarray:
    """Suffix order of a string of names by doubling ranks, over at least `depth` names if given."""
    n, rank, k = len(names), names.astype(np.int32), 1
    while True:
        nxt = np.zeros(n, np.int32)
        nxt[: n - k] = rank[k:] + 1
        order = _counting_order((rank, n), (nxt, n))
        same = (rank[order][1:] == rank[order][:-1]) & (nxt[order][1:] == nxt[order][:-1])
        rank = np.empty(n, np.int32)
        rank[order] = np.r_[0, np.cumsum(~same)]
        k *= 2
        if not same.any() or k >= n or depth is not None and k >= depth:
            return order


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of non-negative integers whose last one is the only 0... or any string: a sentinel is added.

    With `depth`, suffixes that agree in their first `depth` symbols may stand in any order.
    """
    whole = np.r_[text.astype(np.int32) + 1, np.int32(0)].astype(np.int32)
    return _sorted(whole, depth)[1:]


def _sorted(text: np.ndarray, depth: int | None) -> np.ndarray:
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    counts = np.bincount(text)
    ends = np.cumsum(counts)
    starts = ends - counts
    smaller = _types(text)
    is_lms = np.r_[False, smaller[1:] & ~smaller[:-1]]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    sa = _induce(text, smaller, starts, ends, lms)
    by_substring = sa[is_lms[sa]]
    m = len(lms)
    length = np.empty(n, np.int32)
    length[lms] = np.r_[np.diff(lms) + 1, 1]
    a, b = by_substring[:-1], by_substring[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        differs = text[a[live] + k] != text[b[live] + k]
        same[live[differs]] = False
        live = live[~differs]
        k += 1
        live = live[length[a[live]] > k]
    name = np.empty(n, np.int32)
    name[by_substring] = np.r_[0, np.cumsum(~same)]
    names = name[lms]
    alphabet = int(names.max()) + 1
    if alphabet == m:
        order = np.argsort(names)
    elif alphabet <= MOST_BUCKETS:
        # The last name stands for the sentinel: it is the only 0.
        order = _sorted(names, None if depth is None else depth // 2 + 1)
    else:
        order = _doubling(names, None if depth is None else depth // 2 + 1)
    return _induce(text, smaller, starts, ends, lms[order])


def permuted_lcp(text: np.ndarray, sa: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp) in text order: each suffix's predecessor in the suffix array (-1: none), and their common prefix.

    room: how far each position may be compared. Only irreducible positions are compared: where both
    suffixes follow a matching pair, the common prefix is one shorter than the pair's.
    """
    n = len(text)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    before = np.r_[-1, phi[:-1]]
    matched = (before >= 0) & (np.r_[0, room[:-1]] > 0) & (room[before] > 0)
    matched[1:] &= text[:-1] == text[before[1:]]
    reducible = matched & (phi == before + 1)
    plcp = np.zeros(n, np.int32)
    at = np.flatnonzero(~reducible & (phi >= 0))
    most = np.minimum(room[at], room[phi[at]])
    padded = np.r_[text.astype(np.uint64), np.zeros(4, np.uint64)]
    words = padded[:n] | padded[1 : n + 1] << np.uint64(16) | padded[2 : n + 2] << np.uint64(32) | padded[3 : n + 3] << np.uint64(48)
    common, live, k = np.zeros(len(at), np.int32), np.arange(len(at)), 0
    while len(live := live[most[live] > k]):
        x = words[at[live] + k] ^ words[phi[at[live]] + k]
        equal = x == 0
        lanes = np.where(x & np.uint64(0xFFFF), 0, np.where(x & np.uint64(0xFFFFFFFF), 1, np.where(x & np.uint64(0xFFFFFFFFFFFF), 2, 3)))
        common[live] = k + np.where(equal, 4, lanes)
        live = live[equal]
        k += 4
    plcp[at] = np.minimum(common, most)
    place = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(reducible, np.int32(-1), place))
    return phi, np.maximum(0, plcp[last] - (place - last))


def repeated_windows(segments: list[bytes], width: int) -> list[np.ndarray]:
    """For each segment, a mask of the window starts whose `width` bytes also start anywhere else in any segment."""
    sizes = np.array([len(s) for s in segments])
    text = np.zeros(int((sizes + 1).sum()), np.uint16)
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    room = np.zeros(len(text), np.int32)
    for s, at in zip(segments, starts, strict=True):
        text[at : at + len(s)] = np.frombuffer(s, np.uint8).astype(np.uint16) + 1
        room[at : at + len(s)] = np.arange(len(s), 0, -1)
    phi, plcp = permuted_lcp(text, suffix_array(text, width), room)
    twice = np.zeros(len(text), bool)
    found = np.flatnonzero(plcp >= width)
    twice[found] = True
    twice[phi[found]] = True
    return [twice[at : at + max(0, n - width + 1)] for at, n in zip(starts, sizes, strict=True)]
