"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The passes of induced sorting are run bucket by bucket: everything that a
bucket induces goes to its target buckets in one stable distribution, and what
it induces into itself makes another round of the same bucket.  The reduced
string, whose alphabet is as large as itself, is ranked by doubling, to the
depth that the caller asks for.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last counts as smaller)."""
    n = len(text)
    step = np.ones(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
    decided = np.where(step != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(decided[::-1])[::-1]
    return step[following] > 0


def _deal(lists: list[list], items: np.ndarray, chars: np.ndarray) -> None:
    """Append the items, in order, to the lists of their characters."""
    order = np.argsort(chars, kind="stable")
    items, chars = items[order], chars[order]
    cuts = np.flatnonzero(np.diff(chars)) + 1
    starts = np.concatenate(([0], cuts))
    ends = np.append(cuts, len(items))
    for c, a, b in zip(chars[starts].tolist(), starts.tolist(), ends.tolist()):
        lists[c].append(items[a:b])


def _join(parts: list) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """Order of all suffixes of a text with an end mark, given the leftmost-smaller ones in order."""
    ends: list[list] = [[] for _ in range(letters)]
    larger: list[list] = [[] for _ in range(letters)]
    _deal(ends, lms, text[lms])
    done_l = []
    for c in range(letters):
        rounds = []
        while larger[c]:
            found = _join(larger[c])
            larger[c] = []
            rounds.append(found)
            before = found[found > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _deal(larger, before, text[before])
        done_l.append(_join(rounds))
        found = _join(ends[c])
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            _deal(larger, before, text[before])
    order: list = []
    small: list[list] = [[] for _ in range(letters)]
    for c in range(letters - 1, -1, -1):
        rounds = []
        while small[c]:
            found = _join(small[c])
            small[c] = []
            rounds.append(found)
            before = found[found > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _deal(small, before, text[before])
        found = done_l[c][::-1]
        before = found[found > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _deal(small, before, text[before])
        order.append(found)
        order.append(_join(rounds))
    # Kept from the largest suffix down: within a letter first the smaller-type suffixes, then the others.
    whole = []
    for k in range(0, len(order), 2):
        whole += [order[k + 1], order[k]]
    # Nothing induces the end mark, the smallest of all.
    return np.concatenate((np.array([len(text) - 1], np.int32), _join([x for x in whole if len(x)])[::-1]))


def _names(text: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Names, from 0 in order, of the leftmost-smaller substrings at ``ranked`` (sorted)."""
    following = np.full(len(text), len(text) - 1, np.int32)
    following[lms[:-1]] = lms[1:]
    size = following[ranked] - ranked
    a, b = ranked[:-1], ranked[1:]
    same = size[1:] == size[:-1]
    live = np.flatnonzero(same)
    o = 0
    while len(live):
        equal = text[np.minimum(a[live] + o, len(text) - 1)] == text[np.minimum(b[live] + o, len(text) - 1)]
        same[live[~equal]] = False
        live = live[equal & (size[live] > o)]
        o += 1
    return np.concatenate(([0], np.cumsum(~same)))


def _rank(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by their first ``depth`` names at least."""
    rank, k, n = names.astype(np.int64), 1, len(names)
    top = int(rank.max()) + 1
    while top < n and k < depth:
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:] + 1
        key = rank * (top + 1) + after
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        top, k = int(rank.max()) + 1, 2 * k
    return np.argsort(rank)


def suffix_array(text: np.ndarray, letters: int, depth: int | None = None) -> np.ndarray:
    """Start positions of the suffixes in order, over letters 0..letters-1.

    With ``depth``, suffixes with equal first ``depth`` letters may stand in any order.
    """
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    text = np.concatenate((text.astype(np.uint16) + np.uint16(1), np.zeros(1, np.uint16)))  # an end smaller than all
    letters += 1
    smaller = classify(text)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    # Substrings: leftmost-smaller suffixes in text order induce the order of the substrings.
    first = induce(text, smaller, lms, letters)
    ranked = first[is_lms[first]]
    names = np.empty(n + 1, np.int32)
    names[ranked] = _names(text, lms, ranked)
    reduced = names[lms]
    order = lms[_rank(reduced, n if depth is None else depth // 2 + 2)]
    return induce(text, smaller, order, letters)[1:]


def permuted_prefixes(raw: np.ndarray, array: np.ndarray, most: int, among: np.ndarray | None = None) -> np.ndarray:
    """For each position, the common prefix, up to ``most``, with the suffix before it in the array.

    Compared in text order, eight bytes at a time.  ``raw``: the bytes.  With
    ``among``, a mask, other positions count as having nothing in common.
    """
    n = len(raw)
    previous = np.full(n, -1, np.int64)
    previous[array[1:]] = array[:-1]
    padded = np.concatenate((raw, np.zeros(most + 8, np.uint8)))
    words = np.ndarray((n + most,), np.uint64, padded, strides=(1,))
    out = np.zeros(n, np.int32)
    live = np.flatnonzero(previous >= 0 if among is None else among & (previous >= 0) & among[previous])
    for o in range(0, most, 8):
        a, b = live + o, previous[live] + o
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        differ = words[a] ^ words[b]
        equal = differ == 0
        out[live[equal]] += 8
        part = differ[~equal]
        low = part & (~part + np.uint64(1))
        out[live[~equal]] += (np.log2(low.astype(np.float64)) // 8).astype(np.int32)
        live = live[equal]
    ends = np.minimum(n - np.arange(n), n - np.maximum(previous, 0))
    return np.minimum(np.minimum(out, most), ends).astype(np.int32)
