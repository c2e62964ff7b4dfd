"""Words of many texts at once, found on their bytes: what operators 11 and 12 cut texts with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD, BLANK, BREAK = 0, 1, 2


def byte_classes(blanks: bytes, breaks: bytes = b"") -> np.ndarray:
    """The class of each byte. Only ASCII bytes may be blanks or breaks, so no character is cut."""
    out = np.full(256, WORD, np.uint8)
    out[list(blanks)] = BLANK
    out[list(breaks)] = BREAK
    return out


def slices(texts: pa.StringArray, classes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of texts and the offsets of their ends, about `most` bytes a time: whole texts, or parts of a long one between two breaks or blanks that end a word.

    A text of more than `most` bytes is cut behind the first byte of the class of largest number there is, wherever that comes: where no break follows, the text stays whole.
    """
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        lo, hi = offsets[first], offsets[last]
        if last == first + 1 and hi - lo > most:
            cut = classes.max()
            while lo < hi:
                found = np.flatnonzero(classes[data[lo + most : hi]] == cut)[:1] if hi - lo > most else []
                end = lo + most + int(found[0]) + 1 if len(found) else hi
                yield data[lo:end], np.array([end - lo])
                lo = end
        else:
            yield data[lo:hi], offsets[first + 1 : last + 1] - lo
        first = last


def words(data: np.ndarray, ends: np.ndarray, classes: np.ndarray, cuts: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words (binary), each word's number among them, and where the words start. ends: where the texts end; cuts: whether a word ends between each byte and the next."""
    is_word = classes[data] == WORD
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = edge[0] = edge[-1] = True
    if cuts is not None:
        edge[1:-1] |= cuts
    begins, stops = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1] | edge[1:-1]
    stops[:-1] &= ~is_word[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(stops) + 1 - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[is_word])])
    coded = pc.dictionary_encode(flat)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), starts
