"""Words and shingles of whole batches of texts as numpy arrays: byte positions, 64-bit hashes, distinct sets.

The hashes depend on the bytes alone, so they agree between processes and machines.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import offsets_of

C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes inside a word. ALNUM: [0-9A-Za-z] and everything beyond ASCII; SPACED: all but space and \\t \\n \\v \\f \\r.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes that can stand in a letter-only token: letters and everything beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
#: Keeps the first n bytes of a little-endian 8-byte block.
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
LONG_WORD = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * C2
    h = (h ^ (h >> np.uint64(27))) * C3
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    data: np.ndarray  # bytes of the batch, A-Z lowered
    start: np.ndarray  # byte positions, end exclusive
    end: np.ndarray
    first: np.ndarray  # per row: index of its first word; one more entry at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(array: pa.Array, inside: np.ndarray) -> Words:
    """Maximal runs of the bytes ``inside``, row by row. ``array`` holds strings without nulls."""
    offsets = offsets_of(array)
    base = int(offsets[0])
    raw = array.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[base : int(offsets[-1])] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - base
    data = LOWER[data]
    here = inside[data]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = here[:-1]
    before[heads] = False
    start = np.flatnonzero(here & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = here[1:]
    after[heads[heads > 0] - 1] = False
    end = np.flatnonzero(here & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte slices, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = length.astype(np.uint64) * C1
    short = length <= LONG_WORD
    todo = np.flatnonzero(short) if not short.all() else slice(None)
    at, left = start[todo], length[todo]
    part = h[todo]
    part = mix(part ^ (blocks[at] & MASKS[np.minimum(left, 8)])) if len(at) else part
    more = np.flatnonzero(left > 8)
    step = 8
    while len(more):
        part[more] = mix(part[more] * C1 ^ (blocks[at[more] + step] & MASKS[np.minimum(left[more] - step, 8)]))
        step += 8
        more = more[left[more] > step]
    h[todo] = part
    for i in np.flatnonzero(~short):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + length[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(words: Words) -> np.ndarray:
    return hashes(words.data, words.start, words.end - words.start)


def prefix_hashes(words: Words, size: int) -> np.ndarray:
    """Hash of the first ``size`` bytes of each word (of the whole word if it is no longer)."""
    return hashes(words.data, words.start, np.minimum(words.end - words.start, size))


def chained(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive entries; entry i stands for the run that starts there."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    for j in range(size):
        out = mix(out * C1 ^ h[j : j + n])
    return out


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its word runs of ``size``; a shorter row is one run; no words, no entries."""
    h = word_hashes(words)
    runs = chained(h, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            s = np.sort(runs[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(chained(h[a:b], b - a) if b > a else h[:0])
    return out


def find_in(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in a sorted table, -1 where it is absent. Most absent ones are told by their leading 16 bits."""
    out = np.full(len(h), -1, dtype=np.int64)
    if len(table):
        lead = np.zeros(1 << 16, dtype=bool)
        lead[(table >> np.uint64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(lead[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(table, h[maybe]), len(table) - 1)
        out[maybe] = np.where(table[at] == h[maybe], at, -1)
    return out
