"""Words and word shingles of whole texts as 64-bit hashes, by array operations on the texts' bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes handled at once; a longer text is taken in slices cut between words.
SLICE = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + _U(1)
_LOWER[65:91] += _U(32)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, SLICE + 1)
        _POWERS[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(b), dtype=np.uint64)]), dtype=np.uint64)
                      for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, hash) of each word of a byte string, A-Z taken as a-z: the differences of one running polynomial."""
    inside = ~_SPACES[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(data) + 1)
    run = np.concatenate([[_U(0)], np.cumsum(_LOWER[data] * power[:len(data)], dtype=np.uint64)])
    return ends, mix((run[ends] - run[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64))


def _batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[int]]]:
    """(first row, last row, bytes, row ends) of runs of rows of about SLICE bytes; NULL rows are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
        yield first, last, data[offsets[first]:offsets[last]], (offsets[first:last + 1] - offsets[first]).tolist()
        first = last


def _words(data: np.ndarray, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words of consecutive rows."""
    if len(bounds) == 2 and len(data) > 2 * SLICE:
        parts, at = [], 0
        while at < len(data):
            cut = min(at + SLICE, len(data))
            while cut < len(data) and not _SPACES[data[cut]]:
                cut += 1
            parts.append(word_hashes(data[at:cut])[1])
            at = cut
        held = np.concatenate(parts)
        return np.zeros(len(held), dtype=np.int64), held
    # A row's end parts words, too: a space is put there.
    ends = np.array(bounds[1:])
    spaced = np.insert(data, ends, 0x20)
    word_ends, hashes = word_hashes(spaced)
    return np.searchsorted(ends + np.arange(1, len(ends) + 1), word_ends, side="right"), hashes


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, set boundaries, hashes) of runs of rows: row first + i has the sorted distinct shingles
    hashes[bounds[i]:bounds[i + 1]].

    A shingle is `width` words in a row; a text of fewer words has one, all of them; one without words has none.
    """
    factor = mix(np.arange(1, width + 2, dtype=np.uint64) * _U(_BASE)) | _U(1)
    for first, last, data, bounds in _batches(column):
        row, word = _words(data, bounds)
        counts = np.bincount(row, minlength=last - first)
        n = max(len(word) - width + 1, 0)
        whole = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            whole += word[j:j + n] * factor[j]
        same = row[:n] == row[width - 1:width - 1 + n]
        owner, value = row[:n][same], mix(whole[same])
        few = np.flatnonzero((counts > 0) & (counts < width))
        if len(few):
            begin = np.concatenate([[0], np.cumsum(counts)])[few]
            short = counts[few].astype(np.uint64) * factor[width]
            for j in range(width - 1):
                has = counts[few] > j
                short[has] += word[begin[has] + j] * factor[j]
            owner, value = np.concatenate([owner, few]), np.concatenate([value, mix(short)])
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        if len(value):
            keep = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
            owner, value = owner[keep], value[keep]
        yield first, np.searchsorted(owner, np.arange(last - first + 1)), value
