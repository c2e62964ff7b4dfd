"""Phrase collocations from counting quotient filters (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starmill.llm.common import kept, read
from starmill.llm.quotient import Packing, counted, read_filter, write_filter
from starmill.llm.spans import BREAK, byte_classes, slices, words
from starmill.operators.tables import row_ids

#: What parts words and pieces.
CLASSES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
LONGEST, LEAST, SHOWN = 4, 30, 2000
#: Bytes of a shard's texts, words for which there is one part of the filters, bits of the parts of a round, filters that are merged at once.
SHARD_BYTES, PART_WORDS, ROUND_BITS, FAN = 32 << 20, 1 << 20, 10, 1024


def shards(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """Rows of one language and about shard_bytes of text: shard, lang, words and counts of the shard's own dictionary, the commonest first, and its words in order as places there (0 is a break, the first word 1), low and high bytes apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, langs = pc.ascii_lower(pc.fill_null(batch.column("text"), "")), pc.fill_null(batch.column("lang"), "und")
            for lang in pc.unique(langs).to_pylist():
                for data, ends in slices(texts.filter(pc.equal(langs, lang)), CLASSES, shard_bytes):
                    distinct, ids, starts = words(data, ends, CLASSES)
                    if not len(ids):
                        continue
                    breaks = np.union1d(np.flatnonzero(CLASSES[data] == BREAK), ends)
                    piece = np.searchsorted(breaks, starts, "right")
                    counts = np.bincount(ids)
                    order = np.argsort(-counts, kind="stable")
                    place = np.empty(len(order), np.int64)
                    place[order] = np.arange(1, len(order) + 1)
                    at = np.flatnonzero(np.diff(piece)) + 1
                    flat = np.insert(place[ids], at, 0)
                    parts = [(flat >> s & 0xFF).astype(np.uint8).tobytes() for s in (0, 8, 16, 24)]
                    listed = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), distinct.take(pa.array(order)).cast(pa.binary()).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), listed, pa.array([counts[order]], pa.list_(pa.int64())), pa.array([parts], pa.list_(pa.binary()))], ["shard", "lang", "words", "counts", "places"])
                    number += 1

    return docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(cut, "shard long, lang string, words array<string>, counts array<long>, places array<binary>")


def split(keys: tuple, counts: np.ndarray, packing: Packing, part_bits: int) -> Iterator[tuple[int, bytes]]:
    """A filter for each part that has keys."""
    part = packing.part(keys, part_bits)
    ends = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield int(part[a]), write_filter((keys[0][a:b], keys[1][a:b]), counts[a:b], packing, part_bits)


def shard_filters(coded: DataFrame, bits: int, part_bits: int) -> DataFrame:
    """Each shard's filters of its n-grams of 1 to LONGEST words that are all frequent: n, part, shard, filter. coded: shard, places and the words' ids by place (pairs)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, parts, pairs in zip(*(batch.column(c) for c in ("shard", "places", "pairs")), strict=True):
                low = [np.frombuffer(x, np.uint8).astype(np.int64) for x in parts.as_py()]
                flat = low[0] | low[1] << 8 | low[2] << 16 | low[3] << 24
                place, own = (x.to_numpy() for x in pairs.values.flatten())
                to = np.zeros(max(int(flat.max()), int(place.max())) + 1, np.int64)
                to[place] = own
                ids = to[flat]
                for n in range(2, LONGEST + 1):
                    windows = max(0, len(ids) - n + 1)
                    whole = np.ones(windows, bool)
                    for k in range(n):
                        whole &= ids[k : windows + k] > 0
                    packing, at = Packing(n, bits), np.flatnonzero(whole)
                    keys, counts = counted(packing.pack([ids[at + k] for k in range(n)]))
                    made = list(split(keys, counts, packing, part_bits))
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array([n] * len(made), pa.int32()), pa.array([m[0] for m in made], pa.int64()), pa.array([shard.as_py()] * len(made), pa.int64()), pa.array([m[1] for m in made], pa.binary())], ["n", "part", "shard", "filter"])

    return coded.mapInArrow(count, "n int, part long, shard long, filter binary")


def merged_filters(rows: pd.DataFrame, packing: Packing, part: int, part_bits: int) -> tuple[tuple, np.ndarray]:
    """One filter's keys and counts from many of one part: sorted lists that are merged."""
    some = [read_filter(x, packing, part, part_bits) for x in rows["filter"]]
    return counted(tuple(np.concatenate([k[i] for k, _ in some]) for i in (0, 1)), np.concatenate([c for _, c in some]))


def finer(filters: DataFrame, bits: int, part_bits: int, next_bits: int, groups: int) -> DataFrame:
    """A round of merging: the shards fall into groups, of whose filters of a part one is made, which is split into parts of more bits. shard is then the group."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packing = Packing(int(key[0]), bits)
        made = list(split(*merged_filters(rows, packing, int(key[1]), part_bits), packing, next_bits))
        return pd.DataFrame({"n": key[0], "part": [m[0] for m in made], "shard": key[2], "filter": [m[1] for m in made]})

    return filters.groupBy("n", "part", F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("shard")).applyInPandas(merge, "n int, part long, shard long, filter binary")


def frequent(filters: DataFrame, bits: int, part_bits: int, least: int) -> DataFrame:
    """n-grams of at least `least` occurrences, from the merged filters: ids, f."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packing = Packing(int(key[0]), bits)
        keys, counts = merged_filters(rows, packing, int(key[1]), part_bits)
        many = np.flatnonzero(counts >= least)
        ids = packing.unpack((keys[0][many], keys[1][many]))
        return pd.DataFrame({"ids": pd.Series(list(np.stack(ids, 1)), dtype=object), "f": counts[many]})

    return filters.groupBy("n", "part").applyInPandas(merge, "ids array<long>, f long")


def phrase_counts(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD_BYTES, part_words: int = PART_WORDS, round_bits: int = ROUND_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (ids, f) of 1 to LONGEST words, frequent words (lang, word, id, f), and words per language (lang, n).

    Shards count on their own; what they know of a word goes to the others by a join on the shards' dictionaries, never as
    a whole vocabulary to each. A phrase of `least` occurrences has words of as many, so only those get ids, from 1.
    """
    made = kept(shards(docs, shard_bytes), "phrase-shards")
    own = made.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("shard", "lang", (F.col("place") + 1).alias("place"), F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    # how often a lang's words occur: from the shards' sums, a row each
    totals = kept(made.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")), "phrase-totals")
    known = own.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    vocabulary = kept(row_ids(kept(known, "phrase-words"), ["lang", "word"], "id").select("lang", "word", (F.col("id") + 1).alias("id"), "f"), "phrase-ids")
    bits = max(1, int(vocabulary.count()).bit_length())
    pairs = own.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "id")).alias("pairs"))
    coded = made.select("shard", "places").join(pairs, "shard")
    if bits > 31:
        raise ValueError("more than 2**31 frequent words")
    total = totals.agg(F.sum("n")).first()[0] or 0
    wanted = max(3, (total // part_words).bit_length())
    part_bits = min(wanted, round_bits)
    filters = shard_filters(coded, bits, part_bits)
    groups = made.count() if part_bits < wanted else 0
    while part_bits < wanted:
        after, groups = min(wanted, part_bits + round_bits), -(-groups // FAN)
        filters, part_bits = finer(filters, bits, part_bits, after, groups), after
    phrases = frequent(filters, bits, part_bits, least)
    return kept(phrases.unionByName(vocabulary.select(F.array("id").alias("ids"), "f")), "phrases"), vocabulary, totals


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates (ids, a, l, r, score) of two words and more that no longer phrase explains.

    Of the cuts of a candidate the one of the lowest score counts, of the smallest first part on ties.
    """
    known = phrases.select("ids", F.col("f").alias("a"))
    some = known.where(F.size("ids") > 1)
    cuts = some.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("rest"))
    of = lambda name, count: known.select(F.col("ids").alias(name), F.col("a").alias(count))
    # any multiple of a count may pass 64 bits
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(20,0)) + r) AS BIGINT)")
    cuts = cuts.join(of("first", "l"), "first").join(of("rest", "r"), "rest").withColumn("score", score)
    best = cuts.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # contiguous parts of a longer candidate, of two words at least
    inner = some.where(F.size("ids") > 2).select("a", F.col("ids").alias("long"), F.explode(F.sequence(F.lit(2), F.size("ids") - 1)).alias("n"))
    inner = inner.select("a", "n", "long", F.explode(F.sequence(F.lit(1), F.size("long") - F.col("n") + 1)).alias("at")).select(F.slice("long", F.col("at"), F.col("n")).alias("ids"), "a")
    within = inner.groupBy("ids").agg(F.max("a").alias("longest"))
    hundred = lambda x, by: F.lit(by).cast("decimal(3,0)") * F.col(x).cast("decimal(19,0)")
    free = best.join(within, "ids", "left").where(F.col("longest").isNull() | (hundred("longest", 100) < hundred("a", 80)))
    return free.select("ids", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))


def collocations(docs: DataFrame, least: int = LEAST, shown: int = SHOWN, **sizes: int) -> DataFrame:
    """Each language's first phrases of 2 to 4 words by score: lang, rank, phrase, a, l, r, n, score.

    A phrase lies within a piece: texts are cut at sentence marks and line breaks. Its score is twice its count a over the
    counts of its two parts, in millionths, at its worst cut. Phrases of fewer than `least` occurrences aren't candidates, nor
    are those that occur four times in five or more within one longer candidate. Ties by a, then by the phrase's bytes.

    Nulls: a null text is empty, a null lang is `und`. A text without words, and an empty table, give nothing. Repeated rows
    and rows of one doc_id count each. Other columns are not read. A language may hold any share of the rows: no task sees a
    language's words, only a shard's or a part's of the filters.
    """
    phrases, vocabulary, totals = phrase_counts(docs, least, **sizes)
    found = scored(phrases)
    # the first word tells the language
    lang = vocabulary.select(F.col("id").alias("first"), "lang")
    found = found.withColumn("first", F.get("ids", F.lit(0))).join(lang, "first").drop("first")
    ahead = found.withColumn("place", F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= shown).drop("place")
    spelt = ahead.select("*", F.posexplode("ids").alias("at", "id")).join(vocabulary.select("id", "word"), "id")
    spelt = spelt.groupBy("ids", "lang", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= shown)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_quotient_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), g AS (SELECT lang, w, i, unnest(range(1, 5)) AS n FROM i),
f AS (SELECT lang, n, w[i:i+n-1] AS ids, count(*) AS f FROM g WHERE i + n - 1 <= len(w) GROUP BY ALL), t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE n = 1 GROUP BY lang),
c AS (SELECT lang, n, ids, f AS a FROM f WHERE n > 1 AND f >= 30), k AS (SELECT *, unnest(range(1, n)) AS k FROM c),
s AS (SELECT k.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS score FROM k JOIN f x ON x.lang = k.lang AND x.ids = k.ids[1:k] JOIN f y ON y.lang = k.lang AND y.ids = k.ids[k+1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ids ORDER BY score, k) = 1),
m AS (SELECT lang, ids, a, n, unnest(range(2, n)) AS m FROM c WHERE n > 2), j AS (SELECT lang, ids, a, m, unnest(range(1, n - m + 2)) AS o FROM m), e AS (SELECT lang, ids[o:o+m-1] AS ids, max(a) AS longest FROM j GROUP BY ALL),
z AS (SELECT b.lang, array_to_string(b.ids, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM b LEFT JOIN e ON e.lang = b.lang AND e.ids = b.ids WHERE longest IS NULL OR 100 * longest < 80 * a)
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score FROM z JOIN t ON t.lang = z.lang QUALIFY rank <= 2000
"""
