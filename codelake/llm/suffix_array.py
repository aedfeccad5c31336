"""Suffix arrays of a shard by induced sorting, and permuted common prefixes, in numpy.

A shard is some byte strings, each closed by a separator.  Separators are smaller than all
bytes and, by their places, different from one another, so no comparison runs on into the
next string.  The scans of induced sorting go bucket by bucket: what a bucket holds is
dealt out at once, in order, to the buckets of the suffixes one place to the left.
"""

from __future__ import annotations

import numpy as np

from codelake.llm.common import _powers, mix

SEPARATOR = 0
_LETTERS = 257
_VALUE = mix(np.arange(1, _LETTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def closed(strings: list[bytes]) -> np.ndarray:
    """The strings' bytes plus one, each string followed by a separator; none may be empty."""
    data = np.frombuffer(b"\x00".join([*strings, b""]), np.uint8).astype(np.int16) + 1
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    data[ends] = SEPARATOR
    return data


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last, a separator, counts as smaller."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:] - text[:-1])
    step[-1] = 1
    # equal neighbours are of the next unequal pair's type
    at = np.where(step != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from that of the seeds, which come grouped by their first letter."""
    count = np.bincount(text, minlength=_LETTERS)
    end = np.cumsum(count)
    start = end - count
    larger = np.bincount(text[~small], minlength=_LETTERS)
    bounds = np.searchsorted(text[seeds], np.arange(_LETTERS + 1))
    order = np.empty(len(text), np.int64)

    head = start.copy()
    for c in np.flatnonzero(count):
        done = start[c]
        while True:
            before = order[done : head[c]] if done < head[c] else None
            if before is None:
                break
            done = head[c]
            _deal(text, order, head, before - 1, ~small)
        own = seeds[bounds[c] : bounds[c + 1]]
        if len(own):
            _deal(text, order, head, own - 1, ~small)

    tail = end.copy()
    for c in np.flatnonzero(count)[::-1]:
        if c == SEPARATOR:
            continue
        done = end[c]
        while tail[c] < done:
            behind = order[tail[c] : done][::-1]
            done = tail[c]
            _deal_back(text, order, tail, behind - 1, small)
        if larger[c]:
            _deal_back(text, order, tail, order[start[c] : start[c] + larger[c]][::-1] - 1, small)
    order[: count[SEPARATOR]] = seeds[: bounds[SEPARATOR + 1]]
    return order


def _deal(text, order, head, left, wanted) -> None:
    left = left[left >= 0]
    left = left[wanted[left]]
    if not len(left):
        return
    letters = text[left]
    by = np.argsort(letters, kind="stable")
    left, letters = left[by], letters[by]
    n = np.bincount(letters, minlength=_LETTERS)
    order[(head - np.cumsum(n) + n)[letters] + np.arange(len(left))] = left
    head += n


def _deal_back(text, order, tail, left, wanted) -> None:
    left = left[left >= 0]
    left = left[wanted[left] & (text[left] != SEPARATOR)]
    if not len(left):
        return
    letters = text[left]
    by = np.argsort(letters, kind="stable")
    left, letters = left[by], letters[by]
    n = np.bincount(letters, minlength=_LETTERS)
    order[(tail - 1 + np.cumsum(n) - n)[letters] - np.arange(len(left))] = left
    tail -= n


def _prefix_sums(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_VALUE[text] * power[: len(text)], out=sums[1:])
    return sums, inverse


def _order_names(names: np.ndarray) -> np.ndarray:
    """The suffix order of a string of names: only names that still tie are looked at again, each time twice as far."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    rank = np.empty(m, np.int64)
    size = np.diff(np.append(first, m))
    rank[order] = np.repeat(first, size)
    tied = order[np.repeat(size > 1, size)]
    reach = 1
    while len(tied):
        ahead = tied + reach
        key = np.where(ahead < m, rank[np.minimum(ahead, m - 1)], -1)
        by = np.lexsort((key, rank[tied]))
        tied, key = tied[by], key[by]
        old = rank[tied]
        new_group = np.diff(old, prepend=-1) != 0
        split = new_group | (np.diff(key, prepend=-2) != 0)
        at = np.arange(len(tied))
        group_at = np.maximum.accumulate(np.where(new_group, at, 0))
        split_at = np.maximum.accumulate(np.where(split, at, 0))
        rank[tied] = old + split_at - group_at
        size = np.diff(np.append(np.flatnonzero(split), len(tied)))
        tied = tied[np.repeat(size > 1, size)]
        reach *= 2
    out = np.empty(m, np.int64)
    out[rank] = np.arange(m)
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of a closed text, in order."""
    small = smaller_types(text)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    is_leftmost = np.zeros(len(text), bool)
    is_leftmost[leftmost] = True
    seeds = leftmost[np.argsort(text[leftmost], kind="stable")]
    order = _induce(text, small, seeds)
    order = order[is_leftmost[order]]
    parts = int(np.count_nonzero(text[order] == SEPARATOR))
    order[:parts] = np.sort(order[:parts])
    # a name for each leftmost-smaller substring: it reaches to the next one's first letter
    following = np.append(leftmost[1:], len(text) - 1) + 1
    sums, inverse = _prefix_sums(text)
    hashed = mix((sums[following] - sums[leftmost]) * inverse[leftmost] + (following - leftmost).astype(np.uint64))
    number = np.empty(len(text), np.int64)
    number[leftmost] = np.arange(len(leftmost))
    ordered = hashed[number[order]]
    differs = np.append(True, ordered[1:] != ordered[:-1])
    differs[:parts] = True
    names = np.empty(len(leftmost), np.int64)
    names[number[order]] = np.cumsum(differs) - 1
    if not differs.all():
        order = leftmost[_order_names(names)]
    return _induce(text, small, order)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the text, the common prefix of its suffix with the one before it in order.

    A prefix that the place to the left extends is one shorter than that place's; only the
    others are measured, by halving over hashes of ranges.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    reducible = np.zeros(n, bool)
    reducible[1:] = (before[1:] > 0) & (text[:-1] == text[np.maximum(before[1:] - 1, 0)]) & (text[:-1] != SEPARATOR)
    start = np.flatnonzero(~reducible)
    start = start[before[start] >= 0]
    other = before[start]
    ends = np.flatnonzero(text == SEPARATOR)
    room = np.minimum(ends[np.searchsorted(ends, start)] - start, ends[np.searchsorted(ends, other)] - other)
    sums, inverse = _prefix_sums(text)
    length = np.zeros(len(start), np.int64)
    step = 1 << int(max(1, room.max(initial=0))).bit_length()
    while step:
        wider = length + step
        fits = np.flatnonzero(wider <= room)
        a, b, w = start[fits], other[fits], wider[fits]
        same = (sums[a + w] - sums[a]) * inverse[a] == (sums[b + w] - sums[b]) * inverse[b]
        length[fits[same]] = w[same]
        step >>= 1
    out = np.zeros(n, np.int64)
    out[start] = length
    last = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.where(reducible, out[last] - (at - last), out)
