"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller or larger than the one behind them. The leftmost smaller ones
(the marks) are sorted by their substrings, which get names; the string of names is sorted by the
same steps, and so on until all names differ. Two passes over the buckets then induce the whole
array from the sorted marks. Where buckets are large (bytes) a pass takes a bucket's entries at
once; in strings of names, whose buckets hold a few entries each, it goes entry by entry.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket, larger ones entry by entry.
FEW_SYMBOLS = 1024


def _small_types(s: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one behind them; equal symbols take the next type."""
    n = len(s)
    differ = np.flatnonzero(s[1:] != s[:-1])
    ahead = differ[np.minimum(np.searchsorted(differ, np.arange(n - 1)), len(differ) - 1)]
    return np.append(s[ahead] < s[ahead + 1], True)  # the end mark is the smallest


def _induce_buckets(s: np.ndarray, small: np.ndarray, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the marks in order, a bucket's entries at once."""
    ends = np.cumsum(sizes)
    heads, tails = ends - sizes, ends.copy()
    sa = np.full(len(s), -1, np.int32)
    count = np.bincount(s[marks], minlength=len(sizes))
    order = np.argsort(s[marks], kind="stable")
    sa[(ends - np.cumsum(count))[s[marks[order]]] + np.arange(len(marks))] = marks[order]
    present = np.flatnonzero(sizes).tolist()

    def ahead_of(batch: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The neighbours before a batch that are of the wanted type, grouped by symbol."""
        before = batch[batch > 0] - 1
        before = before[wanted[before]]
        if not len(before):
            return None
        symbols = s[before]
        order = np.argsort(symbols, kind="stable")
        return before[order], symbols[order], np.bincount(symbols, minlength=len(sizes))

    large = ~small

    def larger(batch: np.ndarray) -> None:
        if found := ahead_of(batch, large):
            before, symbols, sums = found
            sa[(heads - (np.cumsum(sums) - sums))[symbols] + np.arange(len(before))] = before
            heads.__iadd__(sums)

    def smaller(batch: np.ndarray) -> None:
        if found := ahead_of(batch, small):
            before, symbols, sums = found
            sa[(tails + (np.cumsum(sums) - sums) - 1)[symbols] - np.arange(len(before))] = before
            tails.__isub__(sums)

    for c in present:
        begin = ends[c] - sizes[c]
        while begin < heads[c]:
            stop = heads[c]
            larger(sa[begin:stop])
            begin = stop
        if count[c]:
            larger(sa[ends[c] - count[c] : ends[c]])
    # The marks are put again by the same rule from behind; only the end mark stays.
    for c in present:
        sa[max(heads[c], ends[c] - count[c]) : ends[c]] = -1
    sa[0] = len(s) - 1
    for c in reversed(present):
        stop = ends[c]
        while stop > tails[c]:
            begin = tails[c]
            smaller(sa[begin:stop][::-1])
            stop = begin
        smaller(sa[ends[c] - sizes[c] : heads[c]][::-1])
    return sa


def _induce_entries(s: np.ndarray, small: np.ndarray, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same, entry by entry. A list's iterator sees what the loop writes ahead of it."""
    ends = np.cumsum(sizes)
    heads, tails = (ends - sizes).tolist(), ends.tolist()
    count = np.bincount(s[marks], minlength=len(sizes))
    order = np.argsort(s[marks], kind="stable")
    start = np.full(len(s), -1, np.int64)
    start[(ends - np.cumsum(count))[s[marks[order]]] + np.arange(len(marks))] = marks[order]
    # The symbol before each suffix, where that neighbour is of the wanted type; else -1.
    ahead, of_before = np.append(s[-1:], s[:-1]).astype(np.int64), np.append(True, small[:-1])
    # One more at the end stands for the places that are still empty (-1).
    large_before = [*np.where(of_before, -1, ahead).tolist(), -1]
    of_before[0] = False
    small_before = [*np.where(of_before, ahead, -1).tolist(), -1]
    sa = start.tolist()
    for i in sa:
        if (c := large_before[i]) >= 0:
            at = heads[c]
            sa[at] = i - 1
            heads[c] = at + 1
    for i in reversed(sa):
        if (c := small_before[i]) >= 0:
            at = tails[c] - 1
            sa[at] = i - 1
            tails[c] = at
    sa[0] = len(s) - 1
    return np.array(sa, np.int32)


def _sorted(s: np.ndarray) -> np.ndarray:
    """Of a string of symbols whose last, 0, occurs there alone."""
    if len(s) == 1:
        return np.zeros(1, np.int32)
    sizes = np.bincount(s)
    s = s.astype(np.uint16 if len(sizes) <= 1 << 16 else np.int32)
    induce = _induce_buckets if len(sizes) <= FEW_SYMBOLS else _induce_entries
    small = _small_types(s)
    marks = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = induce(s, small, marks, sizes)
    is_mark = np.zeros(len(s), bool)
    is_mark[marks] = True
    ordered = sa[is_mark[sa]]
    # A substring runs from its mark to the next one; equal neighbours in order share a name.
    until = np.full(len(s), len(s) - 1, np.int32)
    until[marks[:-1]] = marks[1:]
    a, b = ordered[:-1], ordered[1:]
    length = until[a] - a
    same = length == until[b] - b
    alive, off = np.flatnonzero(same), 0
    while len(alive):
        differ = s[a[alive] + off] != s[b[alive] + off]
        same[alive[differ]] = False
        alive = alive[~differ & (length[alive] > off)]
        off += 1
    name = np.cumsum(np.append(0, ~same))
    if name[-1] + 1 < len(marks):
        names = np.zeros(len(s), np.int32)
        names[ordered] = name
        ordered = marks[_sorted(names[marks])]
    return induce(s, small, ordered, sizes)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a string of positive symbols."""
    if not len(symbols):
        return np.empty(0, np.int32)
    return _sorted(np.append(symbols, 0))[1:]


def common_prefixes(symbols: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By place in the text: the length of the common prefix with the suffix before it in ``sa``.

    Where the symbols before the two agree, it is one less than that of the place before; only
    the other places are compared, four symbols (uint16) a step, so that all takes linear time but
    for a logarithmic factor at worst."""
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (symbols[:-1] == symbols[before[1:] - 1])
    x = np.append(symbols, np.zeros(7, np.uint16)).astype(np.uint64)
    for step in (1, 2):
        x = x[:-step] | x[step:] << np.uint64(16 * step)
    length = np.zeros(n, np.int64)
    at, off = np.flatnonzero(~follows & (before >= 0)), 0
    while len(at):
        differ = x[np.minimum(at + off, n)] ^ x[np.minimum(before[at] + off, n)]
        ends = differ != 0
        low = differ[ends]
        length[at[ends]] = off + ((low & np.uint64(0xFFFF)) == 0) + ((low & np.uint64(0xFFFFFFFF)) == 0) + ((low & np.uint64(0xFFFFFFFFFFFF)) == 0)
        at, off = at[~ends], off + 4
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(follows, 0, place))
    return length[last] + last - place
