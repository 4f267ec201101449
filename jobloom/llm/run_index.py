"""A run-length index of repetitive text, in numpy.

The Burrows-Wheeler transform of a text is kept as its runs, with the text positions at which
each run begins and ends. From those samples alone the text's matching statistics stream in
text order: inside a run the lexicographic predecessor of position i + 1 is that of i moved on
by one, and the match is one shorter, so both change course only at sampled positions.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Ends each fragment; no UTF-8 text has it.
STOP = 0xFF
#: Pairs of suffixes up to which each is compared by itself.
FEW = 64


class RunIndex(NamedTuple):
    """Runs of the transform in suffix order, with samples."""

    length: int
    heads: np.ndarray  # a byte for each run
    sizes: np.ndarray
    begins: np.ndarray  # text position of the suffix at each run's start
    ends: np.ndarray  # and at its end


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in lexicographic order, by tripling of what isn't settled yet."""
    n = len(text)
    code = np.cumsum(np.bincount(text, minlength=256) > 0).astype(np.uint64)  # 0 stands for the end
    bits = max(1, int(code[-1]).bit_length())
    h = 64 // bits
    key, width = np.zeros(n + h, np.uint64), 1
    key[:n] = code[text]
    wide = key
    for step in bin(h)[3:]:  # so many symbols of each suffix in one number
        key = key[:-width] << np.uint64(width * bits) | key[width:]
        width *= 2
        if step == "1":
            key = key[:-1] << np.uint64(bits) | wide[width : len(key) - 1 + width]
            width += 1
    order = np.argsort(key[:n])
    first, size = _runs_of_equal(key[order])
    del key, wide
    order = order.astype(np.int32)
    group = np.repeat(first, size)
    rank = np.zeros(n + 1, np.int32)  # from 1; the end's is 0
    rank[order] = group + 1
    place = np.flatnonzero(np.repeat(size, size) > 1).astype(np.int32)  # places in suffix order whose suffixes aren't told apart
    group, at = group[place], order[place]
    times = 3 if (n + 1) ** 3 < 1 << 63 else 2
    while len(place):
        both = group.astype(np.int64)
        for k in range(1, times):
            both *= n + 1
            both += rank[np.minimum(at + np.int64(k * h), n)]
        by = np.argsort(both)
        at = at[by]
        order[place] = at
        first, size = _runs_of_equal(both[by])
        group = np.repeat(place[first], size)
        rank[at] = group + 1
        keep = np.flatnonzero(np.repeat(size, size) > 1)
        place, group, at = place[keep], group[keep], at[keep]
        h *= times
    return order


def _runs_of_equal(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])).astype(np.int32)
    return first, np.diff(np.append(first, np.int32(len(ordered))))


def build(text: np.ndarray) -> RunIndex:
    """The index of some bytes."""
    order = suffix_order(text)
    left = np.where(order > 0, text[order - 1], STOP).astype(np.uint8)
    n = len(text)
    cut = np.ones(n, bool)
    cut[1:] = left[1:] != left[:-1]
    # the suffix without a left neighbour continues nothing
    whole = np.flatnonzero(order == 0)
    cut[whole] = True
    cut[whole[whole + 1 < n] + 1] = True
    # positions after a STOP begin a fragment; matches don't continue across it
    first = np.flatnonzero(cut)
    last = np.append(first[1:], n) - 1
    return RunIndex(n, left[first], last - first + 1, order[first], order[last])


def common_length(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and at b, pair by pair."""
    n = len(text)
    length = np.zeros(len(a), np.int64)
    if not n:
        return length
    # eight bytes from each position on, the first one lowest
    words = np.ndarray(n, "<u8", np.concatenate([text, np.zeros(7, np.uint8)]), strides=(1,)).copy()
    live = np.flatnonzero((a < n) & (b < n))
    x, y = a[live].astype(np.int64), b[live].astype(np.int64)
    while len(live) > FEW:
        apart = words[x] ^ words[y]
        run = np.minimum(np.bitwise_count((apart & -apart) - np.uint64(1)) >> 3, n - np.maximum(x, y))
        length[live] += run
        on = np.flatnonzero((run == 8) & (np.maximum(x, y) + 8 < n))
        live, x, y = live[on], x[on] + 8, y[on] + 8
    for k, i, j in zip(live.tolist(), x.tolist(), y.tolist(), strict=True):
        room, done, step = n - max(i, j), 0, 64
        while done < room:
            apart = text[i + done : i + min(done + step, room)] != text[j + done : j + min(done + step, room)]
            first = int(apart.argmax())
            if apart[first]:
                done += first
                break
            done += len(apart)
            step *= 2
        length[k] += done
    return length


def matching_statistics(index: RunIndex, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(source, length) for each text position, from the index's samples.

    source is the suffix just before the position's own in suffix order (-1 for the first), and
    length how far the two agree.
    """
    sample = index.begins
    before = np.concatenate([[-1], index.ends[:-1]])
    by = np.argsort(sample)
    sample, before = sample[by], before[by]
    length = np.zeros(len(sample), np.int64)
    real = before >= 0
    length[real] = common_length(text, sample[real], before[real])
    gap = np.diff(np.append(sample, index.length))
    step = np.arange(index.length) - np.repeat(sample, gap)
    source = np.repeat(before, gap) + step
    source[np.repeat(~real, gap)] = -1
    return source, np.maximum(np.repeat(length, gap) - step, 0)


def earlier_copies(text: np.ndarray, ends: np.ndarray, key: np.ndarray, least: int) -> np.ndarray:
    """For each position: does its string of least bytes also start at a smaller key?

    ends gives where each position's fragment ends; strings that don't fit in don't count.
    """
    n = len(text)
    source, length = matching_statistics(build(text), text)
    at = np.arange(n)
    # positions with the same string are linked one to the next in suffix order
    root = np.where((length >= least) & (source >= 0), source, at)
    while True:
        up = root[root]
        if np.array_equal(up, root):
            break
        root = up
    fits = at + least <= ends
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, root[fits], key[fits])
    return fits & (key > low[root])
