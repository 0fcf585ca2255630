"""Hashed n-grams of many texts at once, from the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[*range(9, 14), 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(0, dtype=np.uint64)] * 2


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers = [np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(size - 1, x, dtype=np.uint64), dtype=np.uint64)]) for x in (_BASE, _INVERSE)]
    return _powers


def slices(column: pa.Array, lower: bool = True, latin: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, lower-cased bytes, offsets of the rows in them) for slices of a string column; null counts as empty.

    Lower-casing takes A-Z and, with latin, the Latin-1 letters; without lower nothing is changed."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        text = data[offsets[first] : offsets[last]]
        if lower:
            text = _LOWER[text]
        if lower and latin:
            text = _lower_latin(text)
        yield first, text, offsets[first : last + 1] - offsets[first]
        first = last


def _lower_latin(text: np.ndarray) -> np.ndarray:
    upper = np.flatnonzero((text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[1:] != 0x97)) + 1
    text[upper] += 0x20
    return text


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def spans(text: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, ends and 64-bit hashes of all words. A word is a run of bytes of the kind within a row."""
    inside = np.zeros(len(text) + 2, dtype=bool)
    inside[1:-1] = kind[text]
    change = inside[1:] != inside[:-1]
    cuts = offsets[1:-1]
    both = cuts[inside[cuts] & inside[cuts + 1]]  # two rows that touch within a word
    starts = np.flatnonzero(change & inside[1:])
    ends = np.flatnonzero(change & inside[:-1])
    if len(both):
        both = np.unique(both)
        starts, ends = np.sort(np.concatenate([starts, both])), np.sort(np.concatenate([ends, both]))
    up, down = powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
    return starts, ends, mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: np.ndarray, offsets: np.ndarray, kind: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the row of each."""
    starts, _, hashes = spans(text, offsets, kind)
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def word_features(hashes: np.ndarray, rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and rows of words, pairs of neighbours and pairs with one word between."""
    kinds, owners = [hashes], [rows]
    for gap, factor in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        if len(hashes) > gap:
            same = rows[gap:] == rows[:-gap]
            kinds.append(mixed(hashes[:-gap] * np.uint64(factor) + hashes[gap:])[same])
            owners.append(rows[gap:][same])
    return (np.concatenate(kinds) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


def byte_features(text: np.ndarray, offsets: np.ndarray, bits: int, orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and rows of the runs of bytes of each order that lie within a row; other than word bytes count as blank."""
    plain = np.where(_WORD[text], text, 32).astype(np.uint32)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n in orders:
        if len(plain) < n:
            continue
        code = np.zeros(len(plain) - n + 1, dtype=np.uint32)
        for k in range(n):
            code = code * np.uint32(257) + plain[k : len(plain) - n + 1 + k]
        code = (code + np.uint32(n)) * np.uint32(2654435769)
        within = rows[: len(code)] == rows[n - 1 :]
        yield (code >> np.uint32(32 - bits)).astype(np.int64)[within], rows[: len(code)][within]
