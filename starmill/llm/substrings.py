"""Exact substring dedup with suffix arrays (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starmill.llm.common import kept, read, text_key
from starmill.llm.shingles import U, by_runs, byte_sums, mix, parts, slice_hashes
from starmill.llm.suffixes import narrow, suffix_arrays

#: Bytes of a match and of an anchor.
LENGTH, ANCHOR = 50, 16
#: Rows that a task looks at at once, and symbols that it takes to suffix arrays at once. An anchor with more occurrences than FREQUENT is dealt by whole windows; of such anchors so many are broadcast.
ROWS, SYMBOLS, FREQUENT, BROADCAST = 1 << 16, 1 << 20, 100_000, 100_000
#: Bits of an anchor that its own text can do without, and parts over which the rows of an anchor known to be shared are spread.
BRIEF, SALTS = 17, 1 << 12


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of each run of windows (strings of `length` bytes) with the same least k-byte hash: that hash, the text, the first and last window's start, the place of the hash.

    Which k bytes are least, and the first of equals, depends on a window's bytes alone. So equal windows, wherever
    they are, have one hash and lie at one distance from it.
    """
    n, w = len(data), length - k + 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = np.arange(n - k + 1)
    bits = max(1, int(n).bit_length())
    hashes = slice_hashes(*byte_sums(data), at, at + k)
    least = (hashes >> U(bits) << U(bits)) | at.astype(U)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: n - length + 1], least[w - span : w - span + n - length + 1])
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    whole = np.arange(len(least)) + length <= offsets[1:][text]
    start, text, spot = np.flatnonzero(whole), text[whole], (least[whole] & U((1 << bits) - 1)).astype(np.int64)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    first = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[first[1:], len(start)] - 1
    spot = spot[first]
    # 48 bits tell anchors apart well enough: a wrong meeting costs a comparison, no result
    value = (hashes[spot] >> U(16)).astype(np.int64)
    return value, text[first], start[first], start[last], spot


def with_anchors(texts: DataFrame, length: int) -> DataFrame:
    """to, tag, mark: the anchors of texts (key, tag, text), each once a text. A text that a task has met before is passed over.

    An anchor of several texts of one part of the input needs no look at other parts to be shared: of these texts one speaks for it
    elsewhere. That row, and that of an anchor of one text alone, has the anchor as `to` and in `mark` how often it occurs, times two, plus one
    if several texts have it. The rows of the others have a negative `to` with the anchor's brief form and mark 0. So no anchor brings
    more rows to one place than there are parts.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            new = [k not in met and not met.add(k) for k in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(new))
            for at, data, offsets in parts(batch.column(2)):
                h, text, *_ = anchors(data, offsets, length)
                if not len(h):
                    continue
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                own = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
                times = np.diff(np.r_[own, len(h)])
                h, text = h[own], text[own]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                mark = np.zeros(len(h), np.int64)
                mark[first] = 2 * np.add.reduceat(times, first) + (np.diff(np.r_[first, len(h)]) > 1)
                to = np.where(mark > 0, h, -1 - ((h >> BRIEF) | (text % SALTS << (48 - BRIEF))))
                by_text = np.argsort(narrow(text), kind="stable")  # tags in a row take little room
                tags = batch.column(1).slice(at, len(offsets) - 1).take(pa.array(text[by_text]))
                yield pa.RecordBatch.from_arrays([pa.array(to[by_text]), tags, pa.array(mark[by_text].astype(np.int32))], ["to", "tag", "mark"])

    return texts.mapInArrow(work, "to long, tag long, mark int")


def shared_anchors(texts: DataFrame, length: int) -> DataFrame:
    """tag, brief, times: the anchors that several texts have; times (occurrences) stands in one row of each at least."""
    w = W.partitionBy("to")
    rows = with_anchors(texts, length).select("to", "tag", "mark", F.min("tag").over(w).alias("low"), F.max("tag").over(w).alias("high"), F.max(F.col("mark") % 2).over(w).alias("many"), F.sum(F.floor(F.col("mark") / 2)).over(w).alias("times"))
    of = F.when(F.col("to") < 0, (-1 - F.col("to")).bitwiseAND((1 << (48 - BRIEF)) - 1)).otherwise(F.shiftright("to", BRIEF))
    return rows.where("to < 0 OR many > 0 OR low <> high").select("tag", of.cast("int").alias("brief"), F.when(F.col("to") >= 0, F.col("times")).alias("times"))


def bytes_at(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of slices of data, one behind the other."""
    ends = np.cumsum(size)
    return data[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def leaders(content: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of slices of data whose hashes are `content`: one of each kind, and each slice's place among these. Equal hashes are checked byte by byte."""
    while True:
        _, lead, back = np.unique(content, return_index=True, return_inverse=True)
        of = lead[back]
        other = np.flatnonzero((of != np.arange(len(of))) & (size == size[of]))
        differs = bytes_at(data, begin[other], size[other]) != bytes_at(data, begin[of[other]], size[other])
        wrong = size != size[of]
        wrong[np.repeat(other, size[other])[differs]] = True
        if not wrong.any():
            return lead, back
        content = np.where(wrong, mix(content + U(1)), content)


def keys_of(lists: pa.Array) -> np.ndarray:
    """Hashes of each list's row and its elements: brief anchors, told apart by text."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    return mix(values.view(U) + mix(of.astype(U)))


def contexts(docs: DataFrame, length: int) -> DataFrame:
    """h, doc, which, starts, spot, piece: for each anchor of a text (doc, which, text, shared, frequent) that is in its array `shared`, the bytes of its windows, their start and the anchor's distance.

    Of equal pieces in one part of the input the least doc's go on, as one with all its starts. What another doc has of them is known then to be removed: a negative h,
    no bytes, and its length as spot. Pieces of anchors in the array `frequent` have a negative h too, so that they are dealt anywhere.
    """
    names = ["h", "doc", "which", "starts", "spot", "piece"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(3).is_valid())
            for at, data, offsets in parts(batch.column(2)):
                n = len(offsets) - 1
                shared = batch.column(3).slice(at, n)
                h, text, first, last, spot = anchors(data, offsets, length)
                key = mix((h >> BRIEF).view(U) + mix(text.astype(U)))
                take = np.flatnonzero(np.isin(key, keys_of(shared)))
                if not len(take):
                    continue
                often = np.isin(key[take], keys_of(batch.column(4).slice(at, n)))
                h, text, first, last, spot = (x[take] for x in (h, text, first, last, spot))
                size = last - first + length
                content = mix(slice_hashes(*byte_sums(data), first, first + size) ^ mix(h.view(U) + mix((spot - first).astype(U))))
                doc = batch.column(0).slice(at, n).to_numpy()[text]
                lead, back = leaders(content, data, first, size)
                least = np.full(len(lead), np.iinfo(np.int64).max)
                np.minimum.at(least, back, doc)
                start = first - offsets[text]
                gone, own = np.flatnonzero(doc > least[back]), np.flatnonzero(doc == least[back])
                own = own[np.lexsort((text[own], back[own]))]
                new = np.flatnonzero(np.r_[True, (back[own][1:] != back[own][:-1]) | (text[own][1:] != text[own][:-1])])
                go = own[new]
                row = np.r_[gone, go]
                spread = -1 - (mix(mix(doc[row].view(U)) + first[row].astype(U)) >> U(2)).astype(np.int64)
                to = np.where((np.arange(len(row)) < len(gone)) | often[row], spread, h[row])
                starts = pa.ListArray.from_arrays(pa.array(np.r_[np.arange(len(gone)), len(gone) + np.r_[new, len(own)]].astype(np.int32)), pa.array(np.r_[start[gone], start[own]]))
                ends = np.r_[np.zeros(len(gone) + 1, np.int64), np.cumsum(size[go])]
                pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bytes_at(data, first[go], size[go])))]).cast(pa.binary())
                which = batch.column(1).slice(at, n).take(pa.array(text[row]))
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(doc[row]), which, starts, pa.array(np.r_[size[gone], (spot - first)[go]].astype(np.int32)), pieces], names)

    return docs.mapInArrow(work, "h long, doc long, which long, starts array<long>, spot int, piece binary")


def first_owners(data: np.ndarray, begin: np.ndarray, group: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each window of the pieces: the least owner of a piece of its group with the same window, by one suffix array per group.

    Pieces lie in the order of their groups; a piece of b bytes has b - length + 1 windows. The suffixes of a group's pieces, a mark behind
    each piece, are sorted; windows that are equal are then neighbours.
    """
    size = np.diff(begin)
    ends = begin[1:] + np.arange(1, len(size) + 1)
    symbols = np.zeros(len(data) + len(size), np.uint16)
    fill = np.ones(len(symbols), bool)
    fill[ends - 1] = False
    symbols[fill] = data.astype(np.uint16) + 1
    piece = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    starts = np.r_[0, ends[:-1]]
    sa = suffix_arrays(symbols, np.r_[starts[head], len(symbols)])
    sa = sa[sa + length < ends[piece[sa]]]
    windows = np.lib.stride_tricks.sliding_window_view(symbols, length)
    same = np.zeros(len(sa), bool)
    for a in range(1, len(sa), 1 << 14):
        x, y = sa[a - 1 : a - 1 + (1 << 14)], sa[a : a + (1 << 14)]
        same[a : a + len(y)] = (windows[x[: len(y)]] == windows[y]).all(1) & (group[piece[x[: len(y)]]] == group[piece[y]])
    run = np.flatnonzero(~same)
    least = np.minimum.reduceat(owner[piece[sa]], run) if len(run) else np.zeros(0, owner.dtype)
    out = np.zeros(len(symbols), owner.dtype)
    out[sa] = np.repeat(least, np.diff(np.r_[run, len(sa)]))
    valid = np.arange(len(symbols)) + length < ends[piece]
    return out[valid]


def common(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray, step: int) -> np.ndarray:
    """How many bytes from `start` on (up to `end`; step -1: back from before start, down to end) a slice shares with another of its group, at most: its neighbours in order tell."""
    size = (end - start) * step
    width = int(size.max()) if len(size) else 0
    if not width:
        return size
    k = np.arange(width)
    at = start[:, None] + (k if step > 0 else -1 - k)
    # 0xFF stands in no UTF-8 text
    rows = np.where(k < size[:, None], data[np.clip(at, 0, len(data) - 1)], np.uint8(0xFF)).astype(np.uint8)
    words = np.full((len(rows), -(-width // 8) * 8), 0xFF, np.uint8)
    words[:, :width] = rows
    order = np.lexsort((*words.view(">u8").T[::-1], group))
    sorted_rows, g = rows[order], group[order]
    differs = sorted_rows[1:] != sorted_rows[:-1]
    equal = np.where(differs.any(1), differs.argmax(1), width)
    equal = np.minimum(equal, np.minimum(size[order][1:], size[order][:-1])) * (g[1:] == g[:-1])
    out = np.zeros(len(size), np.int64)
    out[order] = np.maximum(np.r_[equal, 0], np.r_[0, equal])
    return out


def owned(h: np.ndarray, doc: np.ndarray, spot: np.ndarray, data: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Least document of each window of the pieces, and where each piece's windows begin. h is sorted.

    Equal pieces of an anchor are one. A piece is cut into the windows that reach far to its anchor's right and those that
    reach to its left; the bytes that all of these share with the anchor decide which parts can have a window in common, and
    only where there are several different parts has a suffix array to tell.
    """
    sums = byte_sums(data)
    content = mix(slice_hashes(*sums, begin[:-1], begin[1:]) ^ mix(h.view(U) + mix(spot.astype(U))))
    lead, back = leaders(content, data, begin[:-1], np.diff(begin))
    least = np.full(len(lead), np.iinfo(np.int64).max)
    np.minimum.at(least, back, doc)
    b, e, s = begin[:-1][lead], begin[1:][lead], begin[:-1][lead] + spot[lead]
    reach = (length - ANCHOR) // 2
    left = reach + 1  # what the other windows hold of the bytes ahead of the anchor, at least
    last = e - length  # the last window's start
    cut = np.clip(s - reach, b, last + 1)  # windows from here on reach `reach` bytes beyond the anchor
    side = np.repeat([0, 1], len(lead))
    pb, pl = np.r_[b, cut], np.r_[cut - 1, last]  # first and last start of each part
    key_from = np.r_[np.maximum(s - left, b), s]
    key_to = np.r_[s + ANCHOR, s + ANCHOR + reach]
    who, of = np.r_[least, least], np.r_[np.arange(len(lead)), np.arange(len(lead))]
    some = pl >= pb
    side, pb, pl, who, of, key_from, key_to = (x[some] for x in (side, pb, pl, who, of, key_from, key_to))
    key = mix(slice_hashes(*sums, key_from, np.minimum(key_to, len(data))) ^ mix(h[lead][of].view(U) + side.astype(U)))
    order = np.argsort(key, kind="stable")
    side, pb, pl, who, of, key, key_from, key_to = (x[order] for x in (side, pb, pl, who, of, key, key_from, key_to))
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    group = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(key)]))
    alone = np.bincount(group)[group] == 1
    count = pl - pb + 1
    at_lead = np.r_[0, np.cumsum(last - b + 1)]
    result = np.zeros(at_lead[-1], np.int64)
    to = at_lead[of] + pb - b[of]  # where a part's windows lie in the result
    where = lambda x: np.repeat(to[x] - np.r_[0, np.cumsum(count[x])[:-1]], count[x]) + np.arange(count[x].sum())
    one, many = np.flatnonzero(alone), np.flatnonzero(~alone)
    if len(one):
        result[where(one)] = np.repeat(who[one], count[one])
    if len(many):
        result[where(many)] = np.repeat(who[many], count[many])
        # what no other part of the group goes on with, before the shared bytes or behind them, can't be equal to anything
        low = key_from[many] - common(data, key_from[many], pb[many], group[many], -1)
        high = key_to[many] + common(data, key_to[many], pl[many] + length, group[many], 1)
        some = high - low >= length
        many, low, high = many[some], low[some], high[some]
    if len(many):
        size, of_group = high - low, group[many]
        content = mix(slice_hashes(*sums, low, high) ^ mix(of_group.astype(U) + mix((key_from[many] - low).astype(U))))
        kind, same = leaders(content, data, low, size)
        first_who = np.full(len(kind), np.iinfo(np.int64).max)
        np.minimum.at(first_who, same, who[many])
        order = np.argsort(of_group[kind], kind="stable")
        kind, first_who, same = kind[order], first_who[order], np.argsort(order)[same]
        windows = size[kind] - length + 1
        begins = np.r_[0, np.cumsum(windows)]
        found = np.repeat(first_who, windows)
        # groups of several kinds to suffix arrays: whole ones, as many at once as have SYMBOLS bytes
        kinds = np.flatnonzero(np.bincount(of_group[kind])[of_group[kind]] > 1)
        turn = np.cumsum(size[kind[kinds]]) // SYMBOLS
        lead_of = np.flatnonzero(np.r_[True, of_group[kind[kinds]][1:] != of_group[kind[kinds]][:-1]][: len(kinds)])
        cuts = lead_of[np.flatnonzero(np.r_[True, turn[lead_of][1:] != turn[lead_of][:-1]][: len(lead_of)])]
        for a, b in zip(cuts, np.r_[cuts[1:], len(kinds)].astype(np.int64)[: len(cuts)], strict=True):
            k = kinds[a:b]
            owner = first_owners(bytes_at(data, low[kind[k]], size[kind[k]]), np.r_[0, np.cumsum(size[kind[k]])], of_group[kind[k]], first_who[k], length)
            found[np.repeat(begins[k] - (np.cumsum(windows[k]) - windows[k]), windows[k]) + np.arange(windows[k].sum())] = owner
        n = windows[same]
        at = np.repeat(np.cumsum(n) - n, n)
        inner = np.arange(n.sum()) - at
        result[np.repeat(to[many] + low - pb[many], n) + inner] = found[np.repeat(begins[same], n) + inner]
    return result, np.c_[at_lead[:-1], at_lead[1:]][back]


def removed_runs(pieces: DataFrame, length: int) -> DataFrame:
    """doc, which, low, high: byte ranges that a smaller doc's windows cover. pieces: the rows of contexts(), those of one h together."""
    names = ["doc", "which", "low", "high"]

    def solve(rows: pa.Table) -> pa.RecordBatch:
        h, doc, which, spot = (rows.column(c).to_numpy() for c in ("h", "doc", "which", "spot"))
        column = rows.column("piece").combine_chunks().cast(pa.large_binary())
        begin = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[begin[0] : begin[-1]]
        least, span = owned(h, doc, spot.astype(np.int64), data, begin - begin[0], length)
        count = span[:, 1] - span[:, 0]
        row = np.repeat(np.arange(len(h)), count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        gone = least[span[row, 0] + inner] < doc[row]
        row, inner = row[gone], inner[gone]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1)][: len(row)])
        last = np.r_[new[1:], len(row)][: len(new)] - 1
        # each run once for each start of its piece
        starts = rows.column("starts").combine_chunks()
        many = starts.value_lengths().to_numpy()
        begins, at = np.cumsum(many) - many, row[new]
        times = many[at]
        of = np.repeat(np.arange(len(at)), times)
        start = starts.flatten().to_numpy()[np.repeat(begins[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        at, low, high = at[of], inner[new][of], inner[last][of]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[at], which[at], start + low, start + high + length)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_runs(batches, ROWS):
            h = table.column("h").to_numpy()
            below = int(np.searchsorted(h, 0))
            if below:
                known = table.slice(0, below)
                known = known.filter(pc.equal(pc.binary_length(known.column("piece")), 0))
                doc, which, size = (known.column(c).to_numpy() for c in ("doc", "which", "spot"))
                start = known.column("starts").combine_chunks().flatten().to_numpy()  # one each
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, which, start, start + size)], names)
            if below < len(h):
                yield solve(table.slice(below))

    return pieces.mapInArrow(work, "doc long, which long, low long, high long")


def frequent_runs(pieces: DataFrame, length: int) -> DataFrame:
    """As removed_runs(), for the pieces of frequent anchors, of any number: every window is a row, and equal ones meet in a window that is sorted, and spilled if need be. A part of the input sends equal pieces once."""
    names = ["doc", "which", "low", "window"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pc.and_(pc.less(batch.column(0), 0), pc.greater(pc.binary_length(batch.column(5)), 0)))
            rows = [
                (doc, which, start + k, piece[k : k + length])
                for doc, which, starts, piece in zip(*(some.column(k).to_pylist() for k in (1, 2, 3, 5)), strict=True) for k in range(len(piece) - length + 1) for start in starts
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names)

    windows = pieces.mapInArrow(work, "doc long, which long, low long, window binary")
    least = F.min("doc").over(W.partitionBy("window"))
    return windows.withColumn("least", least).where("least < doc").select("doc", "which", "low", (F.col("low") + length).alias("high"))


def cut(texts: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept of rows (doc_id, text, lows, highs): the text without the ranges, which rise by their low ends."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in parts(batch.column(1)):
                n = len(offsets) - 1
                low, high = (batch.column(c).slice(at, n) for c in (2, 3))
                row = np.repeat(np.arange(n), low.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                low, high = (offsets[row] + x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (low, high))
                top = np.maximum.accumulate(high) if len(high) else high
                # a new span begins beyond all ranges before it, or in a new text
                new = np.flatnonzero(np.r_[True, (low[1:] > top[:-1]) | (row[1:] != row[:-1])][: len(row)])
                end = top[np.r_[new[1:], len(row)][: len(new)] - 1]
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, low[new], 1)
                np.add.at(edge, end, -1)
                left = np.cumsum(edge[:-1]) == 0
                ends = np.r_[0, np.cumsum(left)][offsets]
                spans = np.bincount(row[new], minlength=n)
                size = np.diff(offsets)
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[left]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(size), pa.array(size - np.diff(ends)), pa.array(spans.astype(np.int64)), kept], names)

    return texts.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) of every row of docs.

    A byte goes if a string of `length` bytes over it also starts in a document with a smaller doc_id. Texts are taken
    as UTF-8, whole, and as they come; matches stay within a document. Only anchors that several texts have are looked at again: with
    the bytes around, all equal strings meet in one place, where suffix arrays find the equal ones. A copy of a whole text needs none
    of that: each of its strings starts in the first copy.

    A null text is empty. Rows with a null doc_id are neither cut nor a reason to cut. Rows with one doc_id don't cut each other,
    whether their texts differ or not; each is compared with the documents of smaller ids. An empty table gives no rows. Other columns are not read.
    """
    if length < ANCHOR + 2:
        raise ValueError(f"length must be {ANCHOR + 2} or more")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    named = rows.where(F.col("doc_id").isNotNull()).select("doc_id", text_key(F.col("text")).alias("key"), "text")
    keys = named.select(F.col("doc_id").alias("doc"), "key", F.xxhash64("text").alias("tag"))
    firsts = keys.groupBy("key").agg(F.min("doc").alias("first"), F.min("tag").alias("tag"))
    # the anchors need no text beside them: only hashes are dealt out to find those of several texts
    long = F.octet_length("text") >= length
    shared = kept(shared_anchors(named.where(long).select("key", F.xxhash64("text").alias("tag"), "text"), length), "anchors")
    many = kept(shared.where(F.col("times") > frequent).select("brief").distinct(), "frequent")
    few = many.limit(BROADCAST + 1).count() <= BROADCAST
    shared = shared.join(F.broadcast(many.withColumn("often", F.col("brief"))) if few else many.withColumn("often", F.col("brief")), "brief", "left")
    of_tag = shared.groupBy("tag").agg(F.collect_set("brief").alias("shared"), F.collect_set("often").alias("frequent"))
    # of copies the first one is compared; docs of several texts have a number for each beside their id
    several = keys.groupBy("doc").agg((F.min("key") != F.max("key")).alias("several"))
    copied = keys.distinct().join(several, "doc").join(firsts.select("key", "first"), "key")
    known = copied.join(of_tag, (copied["tag"] == of_tag["tag"]) & (F.col("doc") == F.col("first")), "left")
    known = kept(known.select("doc", "key", F.when(F.col("several"), copied["tag"]).otherwise(F.lit(0)).alias("which"), (F.col("first") < F.col("doc")).alias("copy"), "shared", "frequent"), "shared")
    # one exchange of the texts serves the comparison and the cutting
    at = known.withColumnsRenamed({"doc": "doc_id"})
    marked = named.join(at, ["doc_id", "key"]).select("doc_id", "which", "text", "shared", "frequent")
    pieces = contexts(marked.withColumnRenamed("doc_id", "doc"), length).repartition("h")
    runs = removed_runs(pieces.sortWithinPartitions("h"), length)
    if not many.isEmpty():
        runs = runs.union(frequent_runs(pieces, length))
    runs = runs.groupBy("doc", "which").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("runs"))
    runs = at.select("doc_id", "key", "which", "copy").join(runs.withColumnRenamed("doc", "doc_id"), ["doc_id", "which"], "left").select("doc_id", "key", "copy", "runs")
    joined = named.join(runs, ["doc_id", "key"])
    whole = F.col("copy") & (F.octet_length("text") >= length)
    lows, highs = (F.when(whole, F.array(end.cast("long"))).otherwise(F.col("runs")[name]) for name, end in (("low", F.lit(0)), ("high", F.octet_length("text"))))
    none = F.lit(None).cast("array<long>")
    nameless = rows.where(F.col("doc_id").isNull()).select("doc_id", "text", none.alias("lows"), none.alias("highs"))
    return cut(joined.select("doc_id", "text", lows.alias("lows"), highs.alias("highs"))).unionByName(cut(nameless))


def op2_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
