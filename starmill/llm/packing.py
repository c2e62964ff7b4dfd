"""Conflict-constrained best-fit packing (operator 7)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.llm.common import kept, read, word_count

#: Words of a bin, and documents that are packed together.
CAPACITY, SHARD_ROWS = 2048, 8192
SCHEMA = "doc_id long, source string, cluster long, n_words long, piece long, start long, piece_words long, bin_id long, bin_offset long"


class Bins:
    """Open bins by residual room, each with bitmaps of the sources and duplicate clusters in it."""

    def __init__(self, capacity: int):
        self.rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0  # bit r: some bin has room r
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.capacity = capacity

    def add(self, need: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a piece: the tightest bin without its source and cluster, or a new one.

        The search goes from the successor of `need` among the rooms in use to the next one, until a bin fits.
        """
        above = self.open >> need
        room = need
        while above:
            step = (above & -above).bit_length() - 1
            room += step
            for at, b in enumerate(self.rooms[room]):
                if not self.sources[b] & source and not self.clusters[b] & cluster:
                    del self.rooms[room][at]
                    return self._put(b, room, need, source, cluster)
            above >>= step + 1
            room += 1
        self.sources.append(0)
        self.clusters.append(0)
        return self._put(len(self.sources) - 1, self.capacity, need, source, cluster)

    def _put(self, b: int, room: int, need: int, source: int, cluster: int) -> tuple[int, int]:
        if not self.rooms[room]:
            self.open &= ~(1 << room)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        left = room - need
        if left:
            self.rooms[left].append(b)
            self.open |= 1 << left
        return b, self.capacity - room


def pack_shard(shard: int, rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pieces of the rows (doc_id, source, cluster, n_words), largest first; ties by doc_id, cluster and source, nulls last."""
    rows = rows.sort_values(["n_words", "doc_id", "cluster", "source"], ascending=[False, True, True, True], kind="stable")
    # a null source conflicts with none; a cluster of one document can't conflict
    of_source = {s: 1 << i for i, s in enumerate(rows["source"].dropna().unique())}
    many = rows["cluster"].value_counts()
    of_cluster = {c: 1 << i for i, c in enumerate(many.index[many > 1])}
    bins, out, rest = Bins(capacity), [], []
    full = 0
    for row in rows.itertuples(index=False):
        n, whole = row.n_words, row.n_words // capacity
        for k in range(whole):
            out.append((*row, k, k * capacity, capacity, -1 - full, 0))
            full += 1
        if n - whole * capacity:
            rest.append((row, whole, n - whole * capacity))
        elif not n:
            out.append((*row, 0, 0, 0, None, 0))
    for row, whole, left in sorted(rest, key=lambda x: -x[2]):
        b, at = bins.add(left, of_source.get(row.source, 0), of_cluster.get(row.cluster, 0))
        out.append((*row, whole, whole * capacity, left, b, at))
    frame = pd.DataFrame(out, columns=["doc_id", "source", "cluster", "n_words", "piece", "start", "piece_words", "bin_id", "bin_offset"])
    # bins that hold one piece of `capacity` words come after the others
    opened = len(bins.sources)
    at = frame["bin_id"].astype("Int64")
    frame["bin_id"] = at.where(at.isna() | (at >= 0), opened - 1 - at) + (shard << 32)
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Bins of `capacity` words: one row per piece of a document, with its bin and its offset there.

    A document of more than `capacity` words gives full pieces, which are bins of their own, and the rest. No bin
    holds two pieces of one source or of one duplicate cluster (documents of the same text). The documents are dealt
    by a hash into shards of about `shard_rows`, so neither a source nor a cluster nor repeated rows decide where a row goes, and each
    shard is packed by itself.

    Nulls: a null text has no words, a null source conflicts with none, a null doc_id is kept. A document without
    words has one row, of 0 words and with a null bin_id. Repeated rows are packed each on its own. An empty table gives no
    rows. Other columns are not read.
    """
    some = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("cluster"), word_count(F.col("text")).alias("n_words"))
    some = kept(some, "lengths")
    shards = max(1, -(-some.count() // shard_rows))
    # repeated rows are told apart by a number each, dealt out in chunks: they may be any share of all
    columns = ["doc_id", "source", "cluster", "n_words"]
    chunks = some.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / shard_rows).cast("int"))))
    chunks = chunks.repartition("doc_id", "cluster", "chunk").withColumn("copy", F.explode(F.sequence(F.col("chunk") * F.lit(shard_rows).cast("long"), F.least(F.col("n"), (F.col("chunk") + 1) * F.lit(shard_rows).cast("long")) - 1)))
    dealt = chunks.select(*columns, F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(shards)).cast("long").alias("shard"))

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(int(key[0]), rows.drop(columns="shard"), capacity)

    return dealt.groupBy("shard").applyInPandas(packed, SCHEMA)


def op7_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
