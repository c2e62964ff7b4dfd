"""Near-duplicate classes by DartMinHash signatures and banded joins (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.llm.common import forget, kept, read
from starmill.llm.graph import components
from starmill.llm.shingles import U, by_runs, counted, mix, parts, sequence_tags, shingle_hashes, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Coordinates of a signature, in bands of ROWS: two texts of similarity 0.8 share no band once in 2e7 pairs.
COORDINATES, ROWS = 128, 4
#: Bytes of two signatures that have to agree for a second look: 0.8 gives fewer once in 1e6 pairs. Texts in a block.
AGREE, BLOCK = 80, 512
#: Parts to which the pairs of one hub are dealt.
PARTS = 32
#: Texts of other classes that a text may be compared with in each bucket and round, and forests of pairs of a block that are, before all that are left are.
CLOSEST = 3
#: Rounds of such pairs, at most: what later ones found on check_h (3 links of 3759) the last step finds as well.
ROUNDS = 2


def signatures(hashes: np.ndarray, rows: np.ndarray, counts: np.ndarray, n_rows: int, k: int = COORDINATES) -> np.ndarray:
    """DartMinHash: n_rows x k ids of the earliest darts, 0 for rows without elements.

    Each element has a stream of hashed darts for each of its weight regions [0, 1), [1, 2), [2, 4), ...: ranks rise by
    exponential steps at the region's width as rate, so streams don't depend on the text. A text takes the darts that hit
    below its element's count and up to a rank that brings it about k (ln k + 5) of them in all; each dart falls on one
    coordinate by its hash, and the one of lowest rank stays. Rows with a coordinate left empty throw on to twice the rank.
    Two texts agree in a coordinate with the probability of their weighted Jaccard similarity.
    """
    out = np.zeros((n_rows, k), U)
    total = np.bincount(rows, counts, n_rows)
    todo, reach = np.flatnonzero(total), k * (np.log(k) + 5)
    while len(todo):
        limit = np.zeros(n_rows)
        limit[todo] = reach / total[todo]
        use = limit[rows] > 0
        ids, ranks, keys = [], [], []
        h, r, c = hashes[use], rows[use], counts[use]
        region = 0
        while len(h):
            low, rate = (0, 1.0) if region == 0 else (1 << (region - 1), float(1 << (region - 1)))
            more = c > low
            h, r, c = h[more], r[more], c[more]
            seed, rank, at, room = mix(h + U(region * 0x9E3779B9 + 1)), np.zeros(len(h)), np.arange(len(h)), limit[r]
            step = 0
            while len(at):
                step += 1
                dart = mix(seed[at] + U(step * 0xD1B54A32D192ED03 % (1 << 64)))
                rank[at] -= np.log(((dart >> U(11)).astype(float) + 0.5) * 2.0**-53) / rate
                at_in = rank[at] < room[at]
                at, dart = at[at_in], dart[at_in]
                other = mix(dart ^ U(0xA0761D6478BD642F))
                hit = low + (other >> U(40)).astype(float) * 2.0**-24 * rate < c[at]
                ids.append(other[hit])
                ranks.append(rank[at][hit])
                keys.append(r[at][hit] * k + (other[hit] % U(k)).astype(np.int64))
            region += 1
        rank, key, ident = np.concatenate(ranks), np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(-rank, kind="stable")
        flat = np.zeros(n_rows * k, U)
        flat[key[order]] = ident[order] | U(1)
        got = flat.reshape(n_rows, k)[todo]
        full = (got != 0).all(1)
        out[todo[full]] = got[full]
        todo, reach = todo[~full], reach * 2
    return out


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, tag and check (hashes of the words in order), bands and signature (a byte of each coordinate) of each text with a word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in parts(batch.column(2)):
                n = len(offsets) - 1
                words, rows = word_hashes(data, offsets)
                some = np.bincount(rows, minlength=n) > 0
                tags, checks = sequence_tags(words, rows, n), sequence_tags(mix(words + U(1)), rows, n)
                sig = signatures(*counted(*shingle_hashes(words, rows, n, SHINGLE)), n)[some]
                bands = np.zeros((len(sig), COORDINATES // ROWS), U)
                for j in range(ROWS):
                    bands = mix(bands + sig[:, j::ROWS])
                bands = mix(bands + np.arange(bands.shape[1], dtype=U))
                ends = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * bands.shape[1])
                small = (sig >> U(32)).astype(np.uint8)
                ids = [batch.column(k).slice(at, n).filter(pa.array(some)) for k in (0, 1)]
                cols = [*ids, *[pa.array(x[some].view(np.int64)) for x in (tags, checks)], pa.ListArray.from_arrays(ends, pa.array(bands.ravel().view(np.int64))), pa.array([x.tobytes() for x in small], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "tag", "check", "bands", "signature"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(work, "doc_id long, text_hash long, tag long, check long, bands array<long>, signature binary")


def told_apart(signed: DataFrame) -> DataFrame:
    """The rows of sign(), where texts of one tag and other words (another check) get a tag of their own."""
    shared = signed.groupBy("tag").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("tag", "low")
    shared = kept(shared, "collisions")
    if shared.isEmpty():
        return signed
    joined = signed.join(shared, "tag", "left").withColumn("tag", F.when(F.col("check") == F.coalesce("low", "check"), F.col("tag")).otherwise(F.xxhash64("tag", "check")))
    return kept(joined.select(signed.columns), "signatures")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """tag, shingles (sorted hashes) and counts of each row's text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in parts(batch.column(1)):
                n = len(offsets) - 1
                words, rows = word_hashes(data, offsets)
                h, r, c = counted(*shingle_hashes(words, rows, n, SHINGLE))
                ends = pa.array(np.searchsorted(r, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h.view(np.int64), c.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *lists], ["tag", "shingles", "counts"])

    return docs.select("tag", "text").mapInArrow(work, "tag long, shingles array<long>, counts array<int>")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity, from all their shingles, is `least` or more."""
    one, two = (sets.select(F.col("tag").alias(x), F.col("shingles").alias(f"{x}_shingles"), F.col("counts").alias(f"{x}_counts")) for x in "ab")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(k) for k in range(2, 6)]
            keep = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                ha, ca, hb, cb = (x[i].values.to_numpy(zero_copy_only=False) for x in lists)
                low, high = sorted((int(ca.sum()), int(cb.sum())))
                if low >= least * high:
                    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
                    both = int(np.minimum(ca[ia], cb[ib]).sum())
                    keep[i] = both >= least * (low + high - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    # a hub may be the b of any share of the pairs: they are dealt to parts, and its shingles copied to those that have some
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(PARTS)).cast("int").alias("part"))
    hubs = two.join(dealt.select("b", "part").distinct(), "b")
    joined = dealt.join(one, "a").join(hubs, ["b", "part"]).select("a", "b", "a_shingles", "a_counts", "b_shingles", "b_counts")
    return joined.mapInArrow(work, "a long, b long")


def runs(buckets: DataFrame) -> DataFrame:
    """at, place, tag, root, signature, bands: the rows of `buckets` (band, place of the band in the signature, tag, root, signature, bands) in the groups in which they meet.

    Of a bucket's largest class the texts don't meet each other. Both they and the others are cut into blocks of about BLOCK texts; each block
    meets each block of the others in a group of their own, so no group grows with the bucket, and a bucket that is almost one class stays cheap.
    """
    classes = buckets.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = classes.groupBy("band").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("members"))
    count = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    sizes = sizes.select("band", F.col("main.root").alias("main"), count(F.col("main.n")).alias("main_blocks"), count(F.col("members") - F.col("main.n")).alias("blocks"))
    dealt = buckets.join(sizes, "band").withColumn("is_main", F.col("root") == F.col("main"))
    own = F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("blocks"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("tag"), own).cast("int"))
    # the others' blocks count from 0 on, those of the largest class from -1 down
    met = F.when(F.col("is_main"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.concat(F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(-1), -F.col("main_blocks"), F.lit(-1))))
    block = F.when(F.col("is_main"), -1 - F.col("block")).otherwise(F.col("block"))
    meets = dealt.select("band", "place", "tag", "root", "signature", "bands", block.alias("block"), F.explode(met).alias("other"))
    return meets.select(F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other")).alias("at"), "place", "tag", "root", "signature", "bands")


def candidates(rows: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each row i of a table of whole groups of runs(): i, the first row of its group, and how many signature bytes agree with each row of the group.

    0 stands at rows of the same class and where this is not the first band that the two texts share. Bands are shared if
    their hashes are, since bytes of a signature also agree by chance.
    """
    at, place, root = (rows.column(c).to_numpy() for c in ("at", "place", "root"))
    sig = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(len(at), -1)
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(at), -1)
    ends = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)]
    for x, y in zip(ends[:-1], ends[1:], strict=True):
        if (root[x:y] == root[x]).all():
            continue
        for i in range(x, y):
            agree = (sig[x:y] == sig[i]).sum(1)
            agree[root[x:y] == root[i]] = 0
            agree[(bands[x:y] == bands[i]).argmax(1) != place[x]] = 0
            yield i, x, agree


def find(parent: dict[int, int], x: int) -> int:
    """The root of x in a union-find forest."""
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def forests(edges: set[tuple[int, int, int]], root: list[int], best: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of edges (-agreeing bytes, i, j) between classes: a spanning forest of the most agreeing ones, one of what that leaves, and so on, `best` of them."""
    out, edges = [], sorted(edges)
    for _ in range(best):
        parent: dict[int, int] = {}
        rest = []
        for edge in edges:
            a, b = find(parent, root[edge[1]]), find(parent, root[edge[2]])
            if a == b:
                rest.append(edge)
            else:
                parent[a] = b
                out.append(edge[1:])
        edges = rest
    return out


def across(buckets: DataFrame, best: int, step: int = 0) -> DataFrame:
    """Pairs (a, b) of one bucket and of different classes, by agreeing signature bytes: `best` forests of its classes.

    A bucket is cut into blocks of about BLOCK texts, others in each step, and each text stands in one of them. A block gives less than
    `best` pairs per class in it, so neither rows nor pairs grow faster than the buckets. Two texts that share several bands are compared in the first of them only.
    """
    sizes = buckets.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    at = F.xxhash64("band", F.pmod(F.xxhash64("tag", F.lit(step)), F.col("blocks")))
    dealt = buckets.join(sizes, "band").select(at.alias("at"), "place", "tag", "root", "signature", "bands")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_runs(batches):
            tag, root, edges = table.column("tag").to_numpy(), table.column("root").to_pylist(), {}
            for i, x, agree in candidates(table):
                for j in np.argsort(-agree, kind="stable")[:best]:
                    if agree[j] >= AGREE:
                        edges.setdefault(x, set()).add((-int(agree[j]), min(i, x + j), max(i, x + j)))
            out = {tuple(sorted((tag[i], tag[j]))) for some in edges.values() for i, j in forests(some, root, best)}
            pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return dealt.repartition("at").sortWithinPartitions("at").mapInArrow(work, "a long, b long").distinct()


def remaining(buckets: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The links (a, b) among all pairs of one bucket, of different classes and with AGREE bytes: none of them is left out.

    Two steps, so that no row is made per pair: the texts that have such a pair in a group, then the same groups of these texts with their
    whole shingle sets. Within a group, pairs that its links connect already are not compared again.
    """
    schema = "at long, place int, tag long, root long, signature binary, bands array<long>"

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_runs(batches):
            keep = np.zeros(len(table), bool)
            for i, _, agree in candidates(table):
                keep[i] = (agree >= AGREE).any()
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_runs(batches):
            tag, roots = table.column("tag").to_numpy(), table.column("root").to_pylist()
            hashes, counts = (table.column(c).combine_chunks() for c in ("shingles", "counts"))
            ends = hashes.offsets.to_numpy()
            ends = ends - ends[0]
            hashes, counts = (c.flatten().to_numpy(zero_copy_only=False) for c in (hashes, counts))
            total = np.add.reduceat(counts, ends[:-1]) if len(counts) else np.zeros(len(tag), int)
            parent: dict[int, int] = {}
            links, group = [], -1
            for i, x, agree in candidates(table):
                if x != group:
                    parent, group = {}, x
                for j in np.flatnonzero(agree >= AGREE) + x:
                    low, high = sorted((int(total[i]), int(total[j])))
                    if j <= i or low < least * high or find(parent, roots[i]) == find(parent, roots[j]):
                        continue
                    p, q = slice(ends[i], ends[i + 1]), slice(ends[j], ends[j + 1])
                    _, ia, ib = np.intersect1d(hashes[p], hashes[q], assume_unique=True, return_indices=True)
                    both = int(np.minimum(counts[p][ia], counts[q][ib]).sum())
                    if both >= least * (low + high - both):
                        parent[find(parent, roots[i])] = find(parent, roots[j])
                        links.append((tag[i], tag[j]))
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1, initial=np.iinfo(np.int64).max)), pa.array(pairs.max(1, initial=np.iinfo(np.int64).min))], ["a", "b"])

    meets = kept(runs(buckets).repartition("at").sortWithinPartitions("at").mapInArrow(some, schema), "open")
    full = meets.join(sets, "tag").select("at", "place", "tag", "root", "signature", "bands", "shingles", "counts")
    return full.repartition("at").sortWithinPartitions("at").mapInArrow(check, "a long, b long").distinct()


def near_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its class, of every row of docs.

    A class is connected by links: pairs of texts whose weighted Jaccard similarity over runs of five words, weighted by their
    counts, is `least` or more. Texts of the same words are one from the start. Texts that share a band meet through the bucket's most central text; a
    pair is a link only if its whole shingle sets say so. Buckets that still hold several classes then compare all their
    texts by signature, in blocks; the most agreeing pairs that would join their classes are checked in the same way, in ROUNDS rounds or until one finds no link.
    Then all the pairs of different classes that share a bucket and have AGREE bytes in common are checked, so the rounds spare work and decide nothing.

    A text of fewer than five words has one shingle, all its words. Texts without words (null, empty, blank) are classes of
    their own. Rows of one doc_id are told apart by their text and get the least class_id of them; a null doc_id has a null class_id.
    An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = told_apart(kept(sign(docs.where(F.col("doc_id").isNotNull())), "signatures"))
    first = signed.groupBy("tag").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("tag", "first.*")
    single = kept(signed.join(first, ["tag", "doc_id", "text_hash"], "left_semi").dropDuplicates(["tag"]), "texts")
    bands = single.select("tag", "doc_id", F.posexplode_outer("bands").alias("place", "band"))
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = kept(bands.join(sizes, "band"), "shared")
    # a text that copies were made from shares more bands with them than they do with each other
    central = shared.join(shared.groupBy("tag").agg(F.sum("members").alias("weight")), "tag")
    hubs = central.groupBy("band").agg(F.min(F.struct((-F.col("weight")).alias("order"), "doc_id", "tag")).alias("hub")).select("band", F.col("hub.doc_id").alias("hub_id"), F.col("hub.tag").alias("hub"))
    met = kept(shared.join(hubs, "band").select("band", "place", "tag", "hub", "hub_id"), "met")
    stars = met.where("tag <> hub").groupBy("tag", "hub").agg(F.count(F.lit(1)).alias("shared"), F.min("hub_id").alias("hub_id"))
    stars = kept(stars, "stars")
    needed = met.select("tag").distinct()
    wanted = kept(single.join(needed, "tag", "left_semi").select("tag", "doc_id", "text_hash"), "needed")
    # merged, not broadcast, at every size: `wanted` grows with the corpus
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(wanted.hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("tag", "text")
    sets = kept(shingle_sets(texts), "shingles")
    nearest = stars.groupBy("tag").agg(F.max_by("hub", F.struct("shared", -F.col("hub_id"))).alias("hub"))
    links = kept(similar(nearest.select(F.col("tag").alias("a"), F.col("hub").alias("b")), sets, least), "links-0")
    tried = kept(nearest.select(F.least("tag", "hub").alias("a"), F.greatest("tag", "hub").alias("b")), "tried-0")
    spent = [links, tried]

    def still_open(roots: DataFrame) -> DataFrame:
        at = met.select("band", "place", "tag").join(roots.withColumnRenamed("node", "tag"), "tag", "left").withColumn("root", F.coalesce("root", "tag"))
        open_bands = at.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
        return at.join(open_bands, "band", "left_semi").join(single.select("tag", "signature", "bands"), "tag").select("band", "place", "tag", "root", "signature", "bands")

    roots = components(links)
    for step in range(1, ROUNDS + 1):
        pairs = kept(across(still_open(roots), CLOSEST, step).join(tried, ["a", "b"], "left_anti"), f"pairs-{step}")
        more = kept(similar(pairs, sets, least), f"links-{step}")
        spent += [pairs, more]
        if more.isEmpty():
            break
        links, tried = links.unionByName(more), tried.unionByName(pairs)
        forget(roots)
        roots = components(links)
    rest = kept(remaining(still_open(roots), sets, least), "rest")
    if not rest.isEmpty():
        forget(roots)
        roots = components(links.unionByName(rest))
    forget(shared, met, stars, wanted, sets, rest, *spent)
    roots = roots.withColumnRenamed("node", "tag")
    of_text = single.select("tag", "doc_id").join(roots, "tag", "left").withColumn("root", F.coalesce("root", "tag"))
    named = of_text.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    of_text = of_text.join(named, "root").select("tag", "class_id")
    of_doc = signed.select("doc_id", "tag").join(of_text, "tag").groupBy(F.col("doc_id").alias("classed_id")).agg(F.min("class_id").alias("class_id"))
    out = docs.select("doc_id").join(of_doc, F.col("doc_id") == F.col("classed_id"), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def first_of_class(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stand for their class: those whose doc_id is the class_id, and those with a null doc_id."""
    gone = near_classes(docs, least).where("doc_id <> class_id").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents"))
