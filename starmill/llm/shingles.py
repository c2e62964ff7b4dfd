"""Words and word shingles of many texts at once, by numpy over the texts' bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
PART = 1 << 20
U = np.uint64
_STEP = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > PART * 2:
        return tuple(np.cumprod(np.full(n, b, U)) for b in (U(_STEP), U(pow(_STEP, -1, 1 << 64))))
    if not _POWERS:
        _POWERS["up"], _POWERS["down"] = (np.cumprod(np.full(PART * 2, b, U)) for b in (U(_STEP), U(pow(_STEP, -1, 1 << 64))))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of a text column, PART bytes or one row each; nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def byte_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over the bytes for slice_hashes(), and the factors that free a slice from its place."""
    up, down = _powers(max(1, len(data)))
    return np.r_[U(0), np.cumsum(_BYTES[data] * up[: len(data)])], down


def slice_hashes(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings from start to end."""
    return mix((sums[end] - sums[start]) * down[np.minimum(start, len(down) - 1)] + (end - start).astype(U))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word: a difference of prefix sums over the bytes, freed from the word's place."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    inside = ~_BLANK[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    start = np.flatnonzero(inside & (first | np.r_[True, ~inside[:-1]]))
    after = np.r_[~inside[1:] | first[1:], True]
    end = np.flatnonzero(inside & after) + 1
    return slice_hashes(*byte_sums(data), start, end), np.searchsorted(offsets, start, "right") - 1


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of `size` words; a text of fewer words gives one, of all of them."""
    keys = mix(np.arange(1, size + 1, dtype=U))
    count = np.bincount(rows, minlength=n_rows)
    out, of = np.zeros(0, U), np.zeros(0, np.int64)
    if len(words) >= size:
        total = np.zeros(len(words) - size + 1, U)
        for k in range(size):
            total += mix(words[k : len(words) - size + 1 + k] ^ keys[k])
        same = rows[: len(total)] == rows[size - 1 :]
        out, of = mix(total[same]), rows[: len(total)][same]
    begin = np.r_[0, np.cumsum(count)]
    short = np.flatnonzero((count > 0) & (count < size))
    some = [mix(mix(words[begin[r] : begin[r + 1]] ^ keys[: count[r]]).sum(keepdims=True) + U(count[r])) for r in short]
    return (np.r_[out, np.concatenate(some)], np.r_[of, short]) if some else (out, of)


def sequence_tags(words: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """A hash of each row's words in their order."""
    begin = np.r_[0, np.cumsum(np.bincount(rows, minlength=n_rows))]
    place = np.arange(len(words)) - begin[rows]
    sums = np.r_[U(0), np.cumsum(mix(words ^ mix(place.astype(U))))]
    return mix(sums[begin[1:]] - sums[begin[:-1]] + np.diff(begin).astype(U))


def counted(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in order, and how often each stands there."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[new], r[new], np.diff(np.r_[new, len(h)])


def by_runs(batches: Iterator[pa.RecordBatch], least: int = 1) -> Iterator[pa.Table]:
    """Tables of `least` rows or more (but the last) that never part rows of the same first column, in whose order the rows come."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) >= least:
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            full = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if full:
                yield table.slice(0, full)
            held = table.slice(full).to_batches()
    if held:
        yield pa.Table.from_batches(held)
