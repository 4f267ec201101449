"""Word shingles of whole texts as 64-bit hashes, from Arrow's text buffers at once."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mixed, text_buffer

#: Bytes of text that are hashed at a time (one document at least).
SLICE_BYTES = 1 << 17
#: Words of more bytes are hashed one by one, with a cryptographic function.
LONG_WORD = 64
#: A-Z become a-z.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: Keeps the first k bytes of eight.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
TURN = np.uint64(0xD6E8FEB86659FD93)
#: The constants that SipHash's state starts from.
SIP_START = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)

Key = tuple[int, int]


def new_key() -> Key:
    """A key for the hashes of one run: without it nobody can make words that collide."""
    return secrets.randbits(64), secrets.randbits(64)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _sip_round(v: list[np.ndarray]) -> None:
    a, b, c, d = v
    a = a + b
    b = _turned(b, 13) ^ a
    a = _turned(a, 32)
    c = c + d
    d = _turned(d, 16) ^ c
    a = a + d
    d = _turned(d, 21) ^ a
    c = c + b
    b = _turned(b, 17) ^ c
    v[:] = a, b, _turned(c, 32), d


def word_hashes(data: np.ndarray, at: np.ndarray, key: Key) -> tuple[np.ndarray, np.ndarray]:
    """SipHash-1-3 of each word of some texts, A-Z lower-cased, and the text that it is of."""
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins = ~space.copy()
    begins[1:] &= space[:-1] | edge[1:-1]
    ends = ~space
    ends[:-1] &= space[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    size = end + 1 - begin
    low = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(low, 8)

    def block(which: np.ndarray, done: np.ndarray | int) -> np.ndarray:
        return np.ascontiguousarray(eight[begin[which] + done]).view("<u8").ravel()

    state = [np.full(len(size), c ^ key[i % 2], np.uint64) for i, c in enumerate(SIP_START)]
    done = 0
    live = np.flatnonzero((size >= 8) & (size <= LONG_WORD))
    while len(live):
        m = block(live, done)
        own = [v[live] for v in state]
        own[3] ^= m
        _sip_round(own)
        own[0] ^= m
        for v, x in zip(state, own, strict=True):
            v[live] = x
        done += 8
        live = live[size[live] >= done + 8]
    rest = size & 7
    m = block(np.arange(len(size)), np.minimum(size - rest, LONG_WORD) * (size <= LONG_WORD)) & FIRST_BYTES[rest] | size.astype(np.uint64) << np.uint64(56)
    state[3] ^= m
    _sip_round(state)
    state[0] ^= m
    state[2] ^= np.uint64(0xFF)
    for _ in range(3):
        _sip_round(state)
    words = state[0] ^ state[1] ^ state[2] ^ state[3]
    secret = key[0].to_bytes(8) + key[1].to_bytes(8)
    for i in np.flatnonzero(size > LONG_WORD):
        words[i] = int.from_bytes(hashlib.blake2b(low[begin[i] : end[i] + 1].tobytes(), digest_size=8, key=secret).digest())
    return words, np.searchsorted(at, begin, "right") - 1


def _chained(words: list[np.ndarray]) -> np.ndarray:
    """Hash of sequences of words, whose own hashes nobody knows: place by place, each step mixed anew."""
    h = mixed(words[0] + np.uint64(len(words)))
    for w in words[1:]:
        h = mixed((h ^ w) * TURN)
    return h


def shingle_sets(column: pa.Array, n: int, key: Key) -> Iterator[np.ndarray]:
    """For each text of a column its sorted distinct shingles of n words, hashed under a key.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    data, at = text_buffer(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, "right")) - 1)
        part, offset = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        words, text = word_hashes(part, offset, key)
        count = np.bincount(text, minlength=hi - lo)
        first = np.concatenate([[0], np.cumsum(count)])
        if len(words) >= n:
            grams = _chained([words[k : len(words) - n + 1 + k] for k in range(n)])
        for i in range(hi - lo):
            if count[i] >= n:
                found = np.sort(grams[first[i] : first[i + 1] - n + 1])
                yield found[np.append(True, found[1:] != found[:-1])]
            elif count[i]:
                yield _chained([words[first[i] + k : first[i] + k + 1] for k in range(count[i])])
            else:
                yield np.empty(0, np.uint64)
        lo = hi
