"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starmill.llm.common import kept, key_text, read, word_count

WEIGHTS = (5, 2, 1)
#: Words of a block, words and rows of a shard, and how often a source may be repeated at most.
BLOCK, SHARD, SHARD_ROWS, REPEATS = 32, 1 << 22, 1 << 17, 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: its rank by code point (null last), words, weight and target words.

    The targets share the words of all sources by weight. One that would be above `repeats` times its source's size
    stays there and the others share the rest by weight, until none is above: in the order of size per weight, the
    sources before some place are the full ones, so running sums find the level at which the others meet.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    filling = W.orderBy(F.col("full") / F.col("weight"), "source_rank")
    before, onward = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(0, W.unboundedFollowing)
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")).withColumn("source_rank", F.row_number().over(by_name))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    named = named.withColumn("weight", F.get(cycle, (F.col("source_rank") - 1) % len(weights)).cast("long")).withColumn("full", F.lit(repeats) * F.col("source_size"))
    filled = named.select("*", (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("full").over(before), F.lit(0))).alias("rest"), F.sum("weight").over(onward).alias("open_weight"))
    filled = filled.withColumn("is_full", F.col("full").cast("double") * F.col("open_weight") <= F.col("weight").cast("double") * F.col("rest"))
    first = F.min(F.when(~F.col("is_full"), F.col("full") / F.col("weight"))).over(W.partitionBy())
    filled = filled.withColumn("first_open", first)
    shared = F.max(F.when(F.col("full") / F.col("weight") == F.col("first_open"), F.col("rest") / F.col("open_weight"))).over(W.partitionBy())
    return filled.withColumn("level", shared).select(
        "source", "source_rank", "source_size", "source_rows", F.when(F.col("is_full"), F.col("full").cast("double")).otherwise(F.least(F.col("full").cast("double"), F.col("weight") * F.col("level"))).alias("target")
    )


def sainte_lague(votes: DataFrame, group: list[str], key: str, seats: str, weight: str) -> DataFrame:
    """Adds `quota`: the seats of each group dealt by highest quotients weight / (2 * quota + 1).

    No loop over seats: with the divisor V / (seats - n / 2) every key has its final quota or less, and the rest,
    n seats at most, goes to the highest of the few quotients that each key can still win. Ties go to the smaller
    key; weights of 0 or null win nothing.
    """
    w = W.partitionBy(*group)
    some = votes.where(F.col(weight) > 0).select("*", F.count(F.lit(1)).over(w).alias("n_keys"), F.sum(weight).over(w).alias("sum_weight"))
    base = F.when(F.col(seats) > F.col("n_keys") / 2, F.floor(F.col(weight) * (F.col(seats) - F.col("n_keys") / 2) / F.col("sum_weight") + 0.5)).otherwise(F.lit(0)).cast("long")
    some = some.withColumn("base", base)
    some = some.withColumn("left", F.col(seats) - F.sum("base").over(w))
    tries = some.select(*group, key, "base", "left", F.col(weight), F.explode(F.sequence(F.lit(0), F.ceil(F.col(weight) * F.col("n_keys") / F.col("sum_weight")).cast("int") + 1)).alias("more"))
    order = W.partitionBy(*group).orderBy((F.col(weight) / (2 * (F.col("base") + F.col("more")) + 1)).desc(), key)
    won = tries.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("left")).groupBy(*group, key).agg(F.count(F.lit(1)).alias("extra"))
    dealt = some.join(won, [*group, key], "left").select(*group, key, (F.col("base") + F.coalesce("extra", F.lit(0))).alias("quota"))
    return votes.join(dealt, [*group, key], "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, block: int = BLOCK, shard: int = SHARD, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """Words that the mix takes from each document: doc_id, size, source_size, target, taken.

    The targets are made of blocks of `block` words. Highest quotients give each source a whole number of blocks and
    each of its shards (documents dealt by a hash, about `shard` words or SHARD_ROWS rows each) a part of them. In a shard the documents
    lie in a seeded order; the mix takes the shard whole as often as its quota holds it, then the blocks from its
    start, so the last document may be cut.

    Nulls: a null text has size 0, a null source is a source of its own and the last, a null doc_id is a value like
    others. Repeated rows are taken each on its own. An empty table gives no rows. Other columns are not read.
    """
    md5 = F.md5(F.concat(F.lit(f"{seed}:"), key_text(F.col("doc_id"))))
    sizes = kept(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), md5.alias("seeded")), "sizes")
    sources = kept(source_targets(sizes, weights, repeats), "sources")
    blocks = F.round(F.sum("source_size").over(W.partitionBy()) / block).cast("long")
    quotas = sainte_lague(sources.select("source", "source_rank", "source_size", "source_rows", "target", blocks.alias("seats"), F.lit(0).alias("all")), ["all"], "source_rank", "seats", "target")
    quotas = quotas.select("source", "source_rank", "source_size", "target", F.col("quota").alias("seats"), F.greatest(F.ceil(F.col("source_size") / shard), F.ceil(F.col("source_rows") / SHARD_ROWS), F.lit(1)).cast("long").alias("n_shards"))
    placed = sizes.join(quotas.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).withColumn("shard", F.conv(F.substring("seeded", 1, 8), 16, 10).cast("long") % F.col("n_shards"))
    shards = placed.groupBy("source_rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"))
    shards = sainte_lague(shards.withColumn("votes", F.col("shard_size").cast("double")), ["source_rank"], "shard", "seats", "votes")
    shards = shards.select("source_rank", "shard", "shard_size", F.least(F.col("quota") * block, repeats * F.col("shard_size")).alias("words"))
    laid = W.partitionBy("source_rank", "shard").orderBy("seeded", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    ends = placed.select("doc_id", "size", "source_size", "target", "source_rank", "shard", F.sum("size").over(laid).alias("end"))
    both = ends.join(shards, ["source_rank", "shard"])
    rest = F.col("words") % F.col("shard_size")
    cut = F.greatest(F.least(F.col("end"), rest) - (F.col("end") - F.col("size")), F.lit(0))
    taken = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size")) * F.col("size") + cut).otherwise(F.lit(0))
    return both.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, to the nearest whole number (half up).

    Rows of one doc_id get the rounded mean of what the mix takes of them; those with a null doc_id stay once. Columns are those of docs.
    """
    taken = mix(docs, **how).groupBy(F.col("doc_id").alias("mixed_id")).agg(F.sum("taken").alias("words_taken"), F.sum("size").alias("words_held"))
    times = F.when(F.col("words_held") > 0, F.floor(F.col("words_taken") / F.col("words_held") + 0.5)).otherwise(F.lit(0)).cast("int")
    taken = taken.select("mixed_id", times.alias("times_mixed")).where("times_mixed > 0")
    joined = docs.join(taken, F.col("doc_id") == F.col("mixed_id"), "left")
    times = F.when(docs["doc_id"].isNull(), F.lit(1)).otherwise(F.coalesce("times_mixed", F.lit(0)))
    return joined.withColumn("copy_mixed", F.explode(F.array_repeat(F.lit(1), times))).select(*[docs[c] for c in docs.columns])


def op6_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


SQL = f"""
WITH sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS seeded FROM documents),
named AS (SELECT source, sum(size) AS source_size, count(*) AS source_rows, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_rank FROM sizes GROUP BY source),
weighed AS (SELECT *, CASE (source_rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, {REPEATS} * source_size AS fill FROM named),
filled AS (SELECT *, (SELECT sum(size) FROM sizes) - coalesce(sum(fill) OVER (ORDER BY fill / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY fill / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM weighed),
told AS (SELECT *, CAST(fill AS DOUBLE) * open_weight <= CAST(weight AS DOUBLE) * rest AS is_full FROM filled),
lev AS (SELECT arg_min(CAST(rest AS DOUBLE) / open_weight, row(CAST(fill AS DOUBLE) / weight, source_rank)) FILTER (WHERE NOT is_full) AS level FROM told),
src AS (SELECT source, source_rank, source_rows, CAST(source_size AS BIGINT) AS source_size, CASE WHEN is_full THEN CAST(fill AS DOUBLE) ELSE least(CAST(fill AS DOUBLE), weight * level) END AS target FROM told, lev),
seats AS (SELECT CAST(round((SELECT sum(size) FROM sizes) / {BLOCK}.0) AS BIGINT) AS n, (SELECT count(*) FROM src WHERE target > 0) AS k, (SELECT sum(target) FROM src WHERE target > 0) AS v),
q1 AS (SELECT source_rank, target, unnest(range(0, CAST(ceil(target / v * n) AS BIGINT) + k + 3)) AS j FROM src, seats WHERE target > 0),
w1 AS (SELECT source_rank, count(*) AS quota FROM (SELECT source_rank, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, source_rank) AS place FROM q1) p, seats WHERE place <= n GROUP BY source_rank),
s AS (SELECT src.*, coalesce(quota, 0) AS quota, greatest(CAST(ceil(source_size / {SHARD}.0) AS BIGINT), CAST(ceil(source_rows / {SHARD_ROWS}.0) AS BIGINT), 1) AS n_shards FROM src LEFT JOIN w1 USING (source_rank)),
placed AS (SELECT doc_id, size, seeded, s.source_rank, s.source_size, s.target, s.quota, CAST('0x' || substr(seeded, 1, 8) AS BIGINT) % n_shards AS shard FROM sizes JOIN s ON sizes.source IS NOT DISTINCT FROM s.source),
sh AS (SELECT source_rank, shard, sum(size) AS shard_size, first(quota) AS quota, sum(sum(size)) OVER (PARTITION BY source_rank) AS v, count(*) FILTER (WHERE sum(size) > 0) OVER (PARTITION BY source_rank) AS k FROM placed GROUP BY source_rank, shard),
q2 AS (SELECT source_rank, shard, shard_size, quota, unnest(range(0, CAST(ceil(shard_size * 1.0 / v * quota) AS BIGINT) + k + 3)) AS j FROM sh WHERE shard_size > 0),
w2 AS (SELECT source_rank, shard, count(*) AS won FROM (SELECT *, row_number() OVER (PARTITION BY source_rank ORDER BY CAST(shard_size AS DOUBLE) / (2 * j + 1) DESC, shard) AS place FROM q2) p WHERE place <= quota GROUP BY source_rank, shard),
words AS (SELECT sh.source_rank, sh.shard, CAST(shard_size AS BIGINT) AS shard_size, CAST(least(coalesce(won, 0) * {BLOCK}, {REPEATS} * shard_size) AS BIGINT) AS words FROM sh LEFT JOIN w2 USING (source_rank, shard)),
ends AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source_rank, shard ORDER BY seeded, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e FROM placed)
SELECT doc_id, size, source_size, target, CASE WHEN shard_size > 0 THEN words // shard_size * size + greatest(least(e, words % shard_size) - (e - size), 0) ELSE 0 END AS taken
FROM ends JOIN words USING (source_rank, shard)
"""
