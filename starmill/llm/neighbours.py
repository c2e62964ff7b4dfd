"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starmill.llm.common import kept, read
from starmill.llm.shingles import by_runs

#: Neighbours of a node; texts of a first block and how often blocks are dealt; rounds of neighbours of neighbours at most.
DEGREE, BLOCK, DEALS, ROUNDS = 40, 384, 4, 3
#: Of each node that two others meet at, one takes so many of the others at most. A round that adds less to the mean similarity is the last.
TAKEN, LEAST_GAIN = 6, 1e-4
#: Nodes that a search keeps.
BEAM = 96
#: Digits by which vectors have one direction, and parts in which a direction's members are ranked first.
DIGITS, PARTS = 12, 64
NAMES = ["u", "v", "s"]


def sound(rows: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the vectors that take part: one per vec_id (the least), without nulls, not all zero, finite, of the most common length."""
    vec = F.col("embedding").cast("array<double>")
    ok = (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    some = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    some = some.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("vec_id", vec.alias("vec"))
    length = some.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), "length").limit(1)
    return some.join(F.broadcast(length), F.size("vec") == F.col("length")).select("vec_id", "vec")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def small(vectors: DataFrame, deals: int, bits: int) -> DataFrame:
    """vec_id, code (a byte for each component of the direction) and for each deal the signs of its random projections, as one number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1))
            x = x / np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            planes = np.random.default_rng(5).standard_normal((x.shape[1], deals * bits))
            signs = ((x @ planes) > 0).reshape(len(x), deals, bits) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(x), deals), np.int64)
            codes = np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * deals)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(signs.astype(np.int64).ravel()))], ["vec_id", "code", "signs"])

    return vectors.mapInArrow(work, "vec_id long, code binary, signs array<long>")


def directions(codes: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def one_per_direction(vectors: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(rep, vec_id) of every vector, where rep is the least vec_id of its direction, and of the `most` smallest vec_ids of each direction.

    Members are ranked in parts first, so no task holds all of a large group.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(1))
                x = x / np.abs(x).max(1, keepdims=True)
                x = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), DIGITS) + 0.0  # no -0.0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "way"])

    ways = vectors.mapInArrow(work, "vec_id long, way binary").select("vec_id", F.md5("way").alias("way"))
    ways = kept(ways, "directions")
    reps = ways.groupBy("way").agg(F.min("vec_id").alias("rep"))
    placed = ways.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)))
    for keys in (["way", "part"], ["way"]):
        placed = placed.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("vec_id"))).where(F.col("place") <= most)
    members = kept(placed.join(reps, "way").select("rep", "vec_id"), "members")
    return ways.join(reps, "way").select("rep", "vec_id"), members


def best(edges: DataFrame, degree: int) -> DataFrame:
    """u and near, its `degree` best (s, v), best first and ties by the smaller v: from rows (u, v, s), of which some may repeat."""
    near = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("s")).alias("far"), "v"))), 1, degree)
    return edges.groupBy("u").agg(F.transform(near, lambda e: F.struct((-e["far"]).alias("s"), e["v"].alias("v"))).alias("near"))


def first_graph(codes: DataFrame, n: int, degree: int, block: int, deals: int) -> DataFrame:
    """Each node's best of the blocks it was dealt to: nodes of the same signs, by a hash so many that a block has about `block` nodes."""
    dealt = codes.select("vec_id", "code", F.posexplode("signs").alias("deal", "sign"))
    sizes = dealt.groupBy("deal", "sign").agg(F.count(F.lit(1)).alias("members"))
    dealt = dealt.join(sizes, ["deal", "sign"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "deal"), F.ceil(F.col("members") / block).cast("long")))

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")  # a stable order then takes the smaller of tied ids
        ids, x = rows["vec_id"].to_numpy(), directions(list(rows["code"]))
        if len(ids) < 2:
            return pd.DataFrame({"u": ids[:0], "v": ids[:0], "s": np.zeros(0, np.float32)})
        s = np.round(x @ x.T, 5)
        np.fill_diagonal(s, -2)
        k = min(degree, len(ids) - 1)
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"u": np.repeat(ids, k), "v": ids[top].ravel(), "s": np.take_along_axis(s, top, 1).ravel()})

    return best(dealt.groupBy("deal", "sign", "part").applyInPandas(near, "u long, v long, s float"), degree)


def neighbours_of_neighbours(graph: DataFrame, codes: DataFrame, degree: int) -> DataFrame:
    """Rows (u, v, s): what a round finds. At each node its neighbours and, as many, the nodes it is a neighbour of meet; each takes the nearest of them that beat its own last neighbour."""
    edges = graph.select("u", F.explode("near").alias("e")).select("u", F.col("e.v").alias("v"))
    back = edges.withColumn("rank", F.row_number().over(W.partitionBy("v").orderBy(F.xxhash64("u", "v")))).where(F.col("rank") <= degree)
    meets = edges.select(F.col("u").alias("at"), F.col("v").alias("x")).union(back.select(F.col("v").alias("at"), F.col("u").alias("x"))).distinct()
    last = graph.select(F.col("u").alias("x"), F.when(F.size("near") >= degree, F.element_at("near", -1)["s"]).otherwise(F.lit(-2.0).cast("float")).alias("last"), F.element_at("near", -1)["v"].alias("last_v"))
    nodes = last.join(codes.select(F.col("vec_id").alias("x"), "code"), "x")
    rows = meets.join(nodes, "x").select("at", "x", "last", "last_v", "code").repartition("at").sortWithinPartitions("at", "x")

    def solve(table: pa.Table) -> pa.RecordBatch:
        at, x, last, last_v = (table.column(c).to_numpy() for c in ("at", "x", "last", "last_v"))
        d = directions(table.column("code").to_pylist())
        out = []
        ends = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a < 2:
                continue
            s = np.round(d[a:b] @ d[a:b].T, 5)
            np.fill_diagonal(s, -3)
            k = min(TAKEN, b - a - 1)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(s, top, 1)
            i, j = np.nonzero((value > last[a:b, None]) | ((value == last[a:b, None]) & (x[a:b][top] < last_v[a:b, None])))
            out.append((x[a + i], x[a + top[i, j]], value[i, j]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.float32))], NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_runs(batches):
            yield solve(table)

    return rows.mapInArrow(work, "u long, v long, s float")


def build(vectors: DataFrame, degree: int = DEGREE, block: int = BLOCK, deals: int = DEALS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The neighbour graph (u, near) over all vectors, and their codes."""
    n = vectors.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n) / block))))
    codes = kept(small(vectors, deals, bits), "codes")
    graph = kept(first_graph(codes, n, degree, block, deals), "graph-0")
    before = 0.0
    for k in range(rounds):
        edges = graph.select("u", F.explode("near").alias("e")).select("u", F.col("e.v").alias("v"), F.col("e.s").alias("s"))
        graph = kept(best(edges.union(neighbours_of_neighbours(graph, codes, degree)), degree), f"graph-{k + 1}")
        mean = graph.select(F.avg(F.aggregate("near", F.lit(0.0), lambda a, e: a + e["s"]) / degree)).first()[0] or 0.0
        if mean - before < LEAST_GAIN:
            break
        before = mean
    return graph, codes


def search(starts: DataFrame, graph: DataFrame, codes: DataFrame, beam: int = BEAM) -> DataFrame:
    """q and v: the `beam` nearest found from the nodes of starts (q, code of q, v) by walking the graph.

    Each step opens every node of a query's beam that is not open yet, scores the new ones among its neighbours and
    keeps the best; it ends when no beam has a node to open.
    """
    queries = kept(starts.select("q", F.col("code").alias("q_code")).distinct(), "queries")

    def score(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(codes.select(F.col("vec_id").alias("v"), "code"), "v").join(queries, "q").select("q", "v", "code", "q_code")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    s = (directions(batch.column(2).to_pylist()) * directions(batch.column(3).to_pylist())).sum(1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.astype(np.float32))], ["q", "v", "s"])

        return rows.mapInArrow(work, "q long, v long, s float")

    top = W.partitionBy("q").orderBy(F.desc("s"), "v")
    cut = lambda rows: rows.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= beam).drop("rank")
    held = kept(cut(score(starts.select("q", "v").where("q <> v").distinct()).withColumn("open", F.lit(False))), "beam-0")
    k = 0
    while True:
        k += 1
        opened = held.where(~F.col("open")).select("q", F.col("v").alias("u"))
        new = opened.join(graph, "u").select("q", F.explode("near").alias("e")).select("q", F.col("e.v").alias("v")).where("q <> v").distinct().join(held.select("q", "v"), ["q", "v"], "left_anti")
        held = kept(cut(held.withColumn("open", F.lit(True)).unionByName(score(new).withColumn("open", F.lit(False)))), f"beam-{k}")
        if held.where(~F.col("open")).isEmpty():
            return held.select("q", "v")


def cosines(pairs: DataFrame, vectors: DataFrame, one: str, two: str) -> DataFrame:
    """Pairs of vec_ids (columns one and two) and `score`, the cosine of their vectors in double precision."""
    side = lambda c, vec: vectors.select(F.col("vec_id").alias(c), F.col("vec").alias(vec))
    both = pairs.select(one, two).join(side(two, "b"), two).join(side(one, "a"), one).select(one, two, "a", "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (matrix(batch.column(c)) for c in (2, 3))
                scale = np.abs(a).max(1), np.abs(b).max(1)
                a, b = a / scale[0][:, None], b / scale[1][:, None]  # no square over- or underflows
                s = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], [one, two, "score"])

    return both.mapInArrow(exact, f"{one} long, {two} long, score double")


def nearest(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every` its k nearest other vectors by cosine, nearest first, ties to the smaller vec_id.

    The graph holds one vector of each direction, the one of least vec_id; what is found stands for the k + 1 smallest ids of its direction, and these are enough. A query starts at the neighbours of its own node. What the walk has found is ranked by the cosine of the
    original vectors in double precision. Vectors that are null, zero, empty or hold null or non-finite components, and
    those of another length than most, take no part; of rows with one vec_id the least vector does. With fewer than k
    candidates all come. An empty table gives no rows. Other columns are not read.
    """
    vectors = kept(sound(rows), "vectors")
    all_of, members = one_per_direction(vectors, k + 1)
    graph, codes = build(vectors.join(members.where("rep = vec_id").select("vec_id"), "vec_id", "left_semi"))
    queries = kept(all_of.where(F.pmod("vec_id", F.lit(every)) == 0).select("rep", F.col("vec_id").alias("query_id")), "asked")
    asked = codes.join(queries.select(F.col("rep").alias("vec_id")).distinct(), "vec_id").select(F.col("vec_id").alias("q"), "code")
    starts = asked.join(graph.withColumnRenamed("u", "q"), "q").select("q", "code", F.explode("near").alias("e")).select("q", "code", F.col("e.v").alias("v"))
    found = search(starts, graph, codes).unionByName(asked.select("q", F.col("q").alias("v")))
    scored = cosines(found, vectors, "q", "v")
    named = members.select(F.col("rep").alias("v"), "vec_id")
    # of a query's directions k + 1 are enough, as each holds a vector
    near = scored.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "v"))).where(F.col("rank") <= k + 1).drop("rank")
    members_of = near.join(named, "v").join(queries.withColumnRenamed("rep", "q"), "q").where(F.col("vec_id") != F.col("query_id"))
    # a direction's members differ by rounding: each pair that may come out is measured on its own vectors
    scored = cosines(members_of, vectors, "query_id", "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
