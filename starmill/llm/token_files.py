"""Token ids of texts in Arrow files of equal-length sequences (operator 12)."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starmill.llm.common import kept, new_folder, read
from starmill.llm.spans import byte_classes, slices, words

#: Ids of a sequence, sequences of a record batch, documents of a file, and the id that ends a document.
LENGTH, BATCH, FILE_ROWS, END_ID = 1024, 256, 16384, 1
#: Blanks that no token of the vocabulary crosses.
BLANKS = byte_classes(b" \t\n\x0c\r")
#: ASCII letters, and the marks that the vocabulary's pattern always parts from letters beside them.
LETTERS = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
MARKS = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"))
#: Bytes of text that are cut into words at once; runs, and characters of runs, that a worker remembers; runs that are encoded as one text.
SLICE, REMEMBERED, CHARACTERS, JOINED = 8 << 20, 1 << 19, 64 << 20, 64

_encoders: dict[int, Encoder] = {}


class Encoder:
    """Ids of texts by a public vocabulary that drops white space, so that each run of other characters has its own ids, wherever it stands. Ids of runs are remembered."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        suffix = json.loads(vocabulary)["model"].get("end_of_word_suffix")
        self.ends_word = np.zeros(size, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends_word[k] = bool(suffix) and token.endswith(suffix)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.sizes, self.begins, self.characters = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for k in range(0, len(texts), 256) for e in self.tokenizer.encode_batch_fast(texts[k : k + 256], add_special_tokens=False)]

    def _joined(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of runs of ASCII letters, and how many each has, from texts of many runs: the vocabulary marks the last id of a word. None if it doesn't."""
        ids = np.concatenate([np.zeros(0, self.kind), *self._encode([" ".join(runs[k : k + JOINED]) for k in range(0, len(runs), JOINED)])])
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) != len(runs) or len(runs) and stops[-1] != len(ids):
            return None
        return ids, np.diff(stops, prepend=0)

    def places(self, runs: list[str]) -> np.ndarray:
        """Where the runs' ids stand among those that are known, which the new ones join."""
        if len(self.known) > REMEMBERED or self.characters > CHARACTERS:
            self._forget()
        at = np.fromiter((self.known.get(r, -1) for r in runs), np.int64, len(runs))
        new = [runs[k] for k in np.flatnonzero(at < 0)]
        if new:
            plain = [r for r in new if r.isalpha() and r.isascii()]
            other = [r for r in new if not (r.isalpha() and r.isascii())]
            together = self._joined(plain)
            if together is None:
                plain, other, together = [], new, (np.zeros(0, self.kind), np.zeros(0, np.int64))
            alone = self._encode(other)
            sizes = np.concatenate([together[1], np.array([len(x) for x in alone], np.int64)])
            first = len(self.sizes)
            self.known.update(zip([*plain, *other], range(first, first + len(new)), strict=True))
            self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, together[0], *alone])
            self.characters += sum(map(len, new))
            at[at < 0] = [self.known[r] for r in new]
        return at

    def ids(self, texts: pa.StringArray, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of the texts in order, each with `end` behind it, and the places of those ends, some texts or parts of a text a time."""
        for data, stops, whole in _parts(texts):
            letter, mark = LETTERS[data], MARKS[data]
            distinct, number, starts = words(data, stops, BLANKS, letter[:-1] & mark[1:] | mark[:-1] & letter[1:])
            at = self.places(distinct.cast(pa.large_string()).to_pylist())[number]
            n = self.sizes[at]
            upto = np.cumsum(n)
            spread = self.flat[np.repeat(self.begins[at] - (upto - n), n) + np.arange(upto[-1])] if len(upto) else np.zeros(0, self.kind)
            if not whole:
                yield spread, np.zeros(0, np.int64)
                continue
            # words before each text's end
            before = np.searchsorted(starts, stops, "left")
            last = np.concatenate([[0], upto])[before]
            yield np.insert(spread, last, end), last + np.arange(len(last))


def _parts(texts: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """slices(), and whether the texts end with their slice: a long text comes in parts, of which only the last is its end."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    at = met = 0
    for data, stops in slices(texts, BLANKS, SLICE):
        met += int(stops[-1]) if len(stops) == 1 else 0
        whole = len(stops) > 1 or met == sizes[at]
        if whole:
            at, met = at + len(stops), 0
        yield data, stops, whole


def schema(length: int, kind: np.dtype) -> pa.Schema:
    """ids and mask of a sequence (the mask is false in the padding), and of the documents that end in it the doc_ids and the places of their last ids."""
    return pa.schema([pa.field("ids", pa.list_(pa.from_numpy_dtype(kind), length), False), pa.field("mask", pa.list_(pa.bool_(), length), False), pa.field("doc_ids", pa.list_(pa.int64()), False), pa.field("ends", pa.list_(pa.int32()), False)])


class SequenceWriter:
    """Writes ids into an Arrow file as they come: record batches of BATCH sequences (the last one of fewer), so any sequence is found by its number."""

    def __init__(self, sink: pa.NativeFile, length: int, kind: np.dtype):
        self.length, self.kind = length, kind
        self.file = pa.ipc.new_file(sink, schema(length, kind))
        self.ids, self.ends, self.docs = np.zeros(0, kind), np.zeros(0, np.int64), []

    def add(self, ids: np.ndarray, ends: np.ndarray, docs: list[int | None]) -> None:
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, ends + len(self.ids)])
        self.docs += docs
        step, at = BATCH * self.length, 0
        while len(self.ids) - at >= step:
            self._write(self.ids[at : at + step], np.ones(step, bool), at)
            at += step
        self.ids, self.ends = self.ids[at:], self.ends - at

    def _write(self, ids: np.ndarray, mask: np.ndarray, first: int) -> None:
        n = int(np.searchsorted(self.ends, first + len(ids)))
        ends, self.ends = self.ends[:n] - first, self.ends[n:]
        docs, self.docs = self.docs[:n], self.docs[n:]
        offsets = pa.array(np.searchsorted(ends, np.arange(0, len(ids) + 1, self.length)), pa.int32())
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        more = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(docs, pa.int64()), pa.array(ends % self.length, pa.int32()))]
        self.file.write_batch(pa.RecordBatch.from_arrays([*lists, *more], schema=schema(self.length, self.kind)))

    def close(self) -> None:
        if len(self.ids):
            more = -len(self.ids) % self.length
            self._write(np.append(self.ids, np.zeros(more, self.kind)), np.arange(len(self.ids) + more) < len(self.ids), 0)
        self.file.close()


class Sequences:
    """A file of sequences: any of them by its number, without a copy where the file is mapped into memory."""

    def __init__(self, path: str):
        files, at = fs.FileSystem.from_uri(path)
        self.source = pa.memory_map(at) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(at)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        batches = self.file.num_record_batches
        self.size = (batches - 1) * BATCH + self.file.get_batch(batches - 1).num_rows if batches else 0

    def __len__(self) -> int:
        return self.size

    def _row(self, column: str, k: int) -> pa.Array:
        if not 0 <= k < self.size:
            raise IndexError(k)
        return self.file.get_batch(k // BATCH).column(column).values.slice(k % BATCH * self.length, self.length)

    def ids(self, k: int) -> np.ndarray:
        return self._row("ids", k).to_numpy()

    def mask(self, k: int) -> pa.BooleanArray:
        """A bit per place, as the file has them."""
        return self._row("mask", k)

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """doc_id and ids (in pieces) of each document, in the file's order."""
        open_pieces: list[np.ndarray] = []
        for b in range(self.file.num_record_batches):
            batch = self.file.get_batch(b)
            ids, ends = batch.column("ids").values.to_numpy(), batch.column("ends")
            rows = np.repeat(np.arange(len(batch)), pc.list_value_length(ends).to_numpy(zero_copy_only=False))
            start = 0
            for name, end in zip(batch.column("doc_ids").values.to_pylist(), (rows * self.length + ends.values.to_numpy() + 1).tolist(), strict=True):
                yield name, [*open_pieces, ids[start:end]]
                open_pieces, start = [], end
            rest = ids[start : pc.sum(batch.column("mask").values).as_py()]
            if len(rest):
                open_pieces.append(rest)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end: int = END_ID, length: int = LENGTH, file_rows: int = FILE_ROWS) -> DataFrame:
    """Writes the documents' ids in ascending doc_id order, and returns the files: part (their order), path, documents, tokens, start (ids in the files before it).

    vocabulary: the text of a tokenizers file. Each text's ids are followed by `end`, which may be an id of words too: `ends` tells
    where documents end. A file has the documents of one range of doc_id, cut into sequences of `length`, of which the last is padded.

    Nulls: a null text is empty and has the end id alone; null doc_ids come first. Repeated rows and rows of one doc_id are
    documents each, in the order of their texts' hashes; they are dealt by their place in the input too, so they may be any share of
    all. An empty table writes no file. Other columns are not read. A task that runs again writes another file, and only files of tasks that Spark has accepted are listed.
    """
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    files = max(1, -(-some.count() // file_rows))
    key = ["doc_id", "salt", "row"]
    some = some.withColumn("salt", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoders.get(hash(vocabulary))
        if coder is None:
            coder = _encoders[hash(vocabulary)] = Encoder(vocabulary)
        store, at = fs.FileSystem.from_uri(folder)
        name, part = f"part-{uuid.uuid4().hex}.arrow", TaskContext.get().partitionId()
        writer, documents, tokens = None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                store.create_dir(at)
                sink = store.open_output_stream(f"{at}/{name}")
                writer = SequenceWriter(sink, length, coder.kind)
            done = 0
            names = batch.column("doc_id").to_pylist()
            for ids, ends in coder.ids(batch.column("text"), end):
                writer.add(ids, ends, names[done : done + len(ends)])
                done, tokens = done + len(ends), tokens + len(ids)
            documents += done
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([documents], pa.int64()), pa.array([tokens], pa.int64())], ["part", "path", "documents", "tokens"])

    dealt = some.repartitionByRange(files, *key).sortWithinPartitions(*key).select("doc_id", "text")
    listed = kept(dealt.mapInArrow(write, "part long, path string, documents long, tokens long"), "token-files")
    # a row per file
    return listed.withColumn("start", F.coalesce(F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))


def read_token_files(files: DataFrame) -> DataFrame:
    """What the files hold: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                out: list[tuple] = []
                for name, pieces in Sequences(path).documents():
                    crc = 0
                    for x in pieces:
                        crc = zlib.crc32(x.astype("<u4").tobytes(), crc)
                    n = sum(map(len, pieces))
                    out.append((name, start, n, crc))
                    start += n
                    if len(out) == 8192:
                        yield _listed(out)
                        out = []
                yield _listed(out)

    n = max(1, files.count())
    return files.select("path", "start").repartition(n).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op12_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    return read_token_files(write_token_files(read(spark, sf_dir, "documents"), new_folder(spark, "tokens"), vocabulary))
