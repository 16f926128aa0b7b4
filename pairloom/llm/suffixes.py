"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

`suffix_array` classifies suffixes as smaller or larger than their successor, sorts the
leftmost-smaller (LMS) substrings by one induction, names them, ranks the reduced string, and
induces the order of all suffixes from it. Induction goes bucket by bucket; what a bucket
induces is placed at once. The reduced string has as many symbols as places, so there are no
buckets to go through; it is ranked by doubling, up to a depth the caller can bound.
"""

from __future__ import annotations

import numpy as np


def smaller_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is the sentinel."""
    last = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    smaller = np.ones(len(last), dtype=bool)
    smaller[:-1] = text[last[:-1]] < text[last[:-1] + 1]
    return np.repeat(smaller, np.diff(np.concatenate([[-1], last])))


def _induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All suffixes in an order that follows the order of `lms`, sorted by first symbol."""
    n, symbols = len(text), len(bounds) - 1
    order = np.full(n, -1, dtype=np.int32)
    starts, ends = bounds[:-1], bounds[1:]
    first = text[lms]
    counts = np.bincount(first, minlength=symbols)
    places = np.arange(len(lms)) - (np.cumsum(counts) - counts)[first] + (ends - counts)[first]
    order[places] = lms
    present = np.flatnonzero(ends > starts)

    def before(block: np.ndarray, want_smaller: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predecessors of the block of the wanted type, grouped by symbol in block order."""
        found = block[block > 0] - 1
        found = found[smaller[found] == want_smaller]
        symbol = text[found]
        by_symbol = np.argsort(symbol, kind="stable")
        return found[by_symbol], symbol[by_symbol], np.bincount(symbol, minlength=symbols)

    head = starts.copy()

    def larger_from(block: np.ndarray) -> None:
        found, symbol, count = before(block, False)
        if len(found):
            rank = np.arange(len(found)) - (np.cumsum(count) - count)[symbol]
            order[head[symbol] + rank] = found
            np.add(head, count, out=head)

    for c in present.tolist():
        low = int(starts[c])
        while low < head[c]:
            low, block = int(head[c]), order[low : head[c]]
            larger_from(block)
        if counts[c]:
            larger_from(order[ends[c] - counts[c] : ends[c]])

    tail = ends.copy()

    def smaller_from(block: np.ndarray) -> None:
        found, symbol, count = before(block, True)
        if len(found):
            rank = np.arange(len(found)) - (np.cumsum(count) - count)[symbol]
            order[tail[symbol] - 1 - rank] = found
            np.subtract(tail, count, out=tail)

    order[0] = n - 1
    tail[text[n - 1]] -= 1
    for c in present[::-1].tolist():
        high = int(ends[c])
        while high > tail[c]:
            high, block = int(tail[c]), order[tail[c] : high][::-1]
            smaller_from(block)
        if head[c] > starts[c]:
            smaller_from(order[starts[c] : head[c]][::-1])
    return order


def _names(text: np.ndarray, ordered: np.ndarray, length_at: np.ndarray) -> np.ndarray:
    """Numbers of the sorted LMS substrings; equal ones share a number."""
    a, b = ordered[:-1], ordered[1:]
    size = length_at[a]
    differs = size != length_at[b]
    active, at = np.flatnonzero(~differs), 0
    while len(active):
        active = active[at < size[active]]
        other = text[a[active] + at] != text[b[active] + at]
        differs[active[other]] = True
        active = active[~other]
        at += 1
    return np.concatenate([[0], np.cumsum(differs)])


def _rank(names: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of suffixes of `names`, compared up to about `depth` symbols.

    Only suffixes that are not yet told apart are sorted again.
    """
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    ordered = names[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group
    step = 1
    tied = np.flatnonzero(~new | ~np.append(new[1:], True))
    while len(tied) and step < depth:
        who = order[tied]
        follow = rank[np.minimum(who + step, n)]
        key = rank[who] * np.int64(n + 1) + follow + 1
        by_key = np.argsort(key, kind="stable")
        who, key = who[by_key], key[by_key]
        order[tied] = who
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[who] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~new | ~np.append(new[1:], True)]
        step *= 2
    return order


def suffix_array(text: np.ndarray, depth: int = 1 << 62) -> np.ndarray:
    """Suffixes of `text` in order; its last symbol is 0 and occurs nowhere else.

    With `depth`, suffixes that agree in at least `depth` symbols may be in any order.
    """
    smaller = smaller_types(text)
    is_lms = np.zeros(len(text), dtype=bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text))])
    if len(lms) < 2:
        return _induce(text, smaller, lms, bounds)
    by_symbol = lms[np.argsort(text[lms], kind="stable")]
    ordered = _induce(text, smaller, by_symbol, bounds)
    ordered = ordered[is_lms[ordered]]
    length_at = np.zeros(len(text), dtype=np.int64)
    length_at[lms] = np.append(np.diff(lms) + 1, 1)
    named = _names(text, ordered, length_at)
    names = np.empty(len(text), dtype=np.int64)
    names[ordered] = named
    if named[-1] + 1 < len(lms):
        ordered = lms[_rank(names[lms], depth)]
    return _induce(text, smaller, ordered, bounds)


def common_prefixes(
    text: np.ndarray, order: np.ndarray, at_starts: np.ndarray, most: int
) -> np.ndarray:
    """For each place the length its suffix shares with the one before it in `order`.

    Lengths are found at the places where the two suffixes have different symbols before
    them, and at `at_starts`; from a place to the next one the length drops by one at most.
    They are exact as far as `most` symbols from the last such place.
    """
    n = len(text)
    before = np.empty(n, dtype=np.int64)
    before[order[0]] = n - 1
    before[order[1:]] = order[:-1]
    eight = np.zeros(n + most + 16, dtype=np.uint64)
    padded = np.concatenate([text, np.zeros(most + 24, dtype=text.dtype)]).astype(np.uint64)
    for i in range(8):
        eight |= padded[i : i + len(eight)] << np.uint64(8 * i)
    starts = np.ones(n, dtype=bool)
    starts[1:] = (before[1:] == 0) | (text[:-1] != text[before[1:] - 1])
    starts[at_starts] = True
    places = np.flatnonzero(starts)
    other = before[places]
    lengths = np.full(len(places), most, dtype=np.int64)
    active = np.arange(len(places))
    for at in range(0, most, 8):
        apart = eight[places[active] + at] ^ eight[other[active] + at]
        ended = apart != 0
        lowest = apart[ended] & (~apart[ended] + np.uint64(1))
        lengths[active[ended]] = at + (np.log2(lowest.astype(np.float64)) // 8).astype(np.int64)
        active = active[~ended]
        if not len(active):
            break
    reach = np.zeros(n, dtype=np.int64)
    reach[places] = places + np.minimum(lengths, most)
    shared = np.maximum.accumulate(reach) - np.arange(n)
    shared[order[0]] = 0
    return np.maximum(shared, 0)
