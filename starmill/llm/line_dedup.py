"""Line dedup by pairwise alignment (operator 5)."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.llm.common import forget, kept, read, spread_join, text_key, word_count
from starmill.llm.shingles import U, mix
from starmill.operators.tables import row_ids

#: A common block goes if its lines have so many characters together.
LEAST_CHARS = 60
#: Parts to which the holders of a line, and the partners of a document, are dealt.
PARTS = 32
_STEP = 0x9E3779B97F4A7C15


class Runs:
    """Hashes of the runs of neighbouring lines of a text, from hashes and lengths of its lines."""

    def __init__(self, lines: list[int] | np.ndarray, chars: list[int] | np.ndarray) -> None:
        n = len(lines)
        up, self.down = (np.cumprod(np.r_[U(1), np.full(n, x, U)]) for x in (U(_STEP), U(pow(_STEP, -1, 1 << 64))))
        self.sums = np.r_[U(0), np.cumsum(mix(np.asarray(lines, np.int64).view(U)) * up[:n])]
        self.chars = np.r_[0, np.cumsum(np.asarray(chars, np.int64))]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))

    def reach(self, i: int, m: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the shortest run of `least` characters or more from each line between i and m that has one."""
        start = np.arange(i, m)
        end = np.searchsorted(self.chars, self.chars[i:m] + least)
        return start[end <= m], np.maximum(end, start + 1)[end <= m]

    def reach_back(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the shortest run of `least` characters or more up to each line that has one."""
        end = np.arange(1, len(self.chars))
        start = np.searchsorted(self.chars, self.chars[1:] - least, "right") - 1
        return np.minimum(start, end - 1)[start >= 0], end[start >= 0]


def longest(a: Runs, b: Runs, i: int, m: int, j: int, n: int, least: int) -> tuple[int, int, int] | None:
    """Place in a, place in b and lines of the common run of most characters, `least` or more, between i and m, j and n."""
    found, low, high = None, least, int(min(a.chars[m] - a.chars[i], b.chars[n] - b.chars[j]))
    want = low
    while low <= high:
        (x, xe), (y, ye) = a.reach(i, m, want), b.reach(j, n, want)
        _, p, q = np.intersect1d(a.hashes(x, xe), b.hashes(y, ye), return_indices=True)
        if len(p):
            k = int(np.argmin(q))
            found, low = (int(x[p[k]]), int(y[q[k]]), int(xe[p[k]] - x[p[k]])), want + 1
        else:
            high = want - 1
        want = (low + high + 1) // 2
    return found


def aligned(a: list[int], b: list[int], chars: list[int] | None = None, least: int = 1) -> list[tuple[int, int]]:
    """Patience diff: pairs of places of equal lines, rising in both.

    Common starts and ends are taken first. Between them the lines found once in either side and in the longest
    rising chain are anchors, and the parts between anchors are aligned in the same way. In a part without any the common run of most
    characters (chars: of the lines of b; 1 each by default) is taken and the parts beside it are aligned, until none of `least` is left.
    """
    chars = [1] * len(b) if chars is None else chars
    of_line = dict(zip(b, chars, strict=True))
    runs: list[Runs] = []
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i == m or j == n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        place = {x: k for k, x in enumerate(a[i:m], i) if in_a[x] == 1 and in_b.get(x) == 1}
        both = [(place[x], k) for k, x in enumerate(b[j:n], j) if x in place]
        if not both:
            if not in_a.keys() & in_b.keys():
                continue
            runs = runs or [Runs(a, [of_line.get(x, 1) for x in a]), Runs(b, chars)]
            run = longest(*runs, i, m, j, n, least)
            if run and a[run[0] : run[0] + run[2]] == b[run[1] : run[1] + run[2]]:
                x, y, k = run
                found += [(x + t, y + t) for t in range(k)]
                todo += [(i, x, j, y), (x + k, m, y + k, n)]
            continue
        ends: list[int] = []
        last: list[int] = []
        back: list[int] = []
        for k, (x, _) in enumerate(both):
            at = bisect_left(ends, x)
            back.append(last[at - 1] if at else -1)
            if at == len(ends):
                ends.append(x)
                last.append(k)
            else:
                ends[at], last[at] = x, k
        k, chain = last[-1], []
        while k >= 0:
            chain.append(both[k])
            k = back[k]
        for x, y in reversed(chain):
            todo.append((i, x, j, y))
            found.append((x, y))
            i, j = x + 1, y + 1
        todo.append((i, m, j, n))
    return sorted(found)


def common_lines(a: list[int], b: list[int], chars: list[int], least: int) -> list[int]:
    """Places in b of the aligned blocks (runs of neighbours in both) of `least` characters or more."""
    out: list[int] = []
    run: list[int] = []
    before = (-2, -2)
    for x, y in [*aligned(a, b, chars, least), (-9, -9)]:
        if (x - 1, y - 1) != before:
            if sum(chars[k] for k in run) >= least:
                out += run
            run = []
        run.append(y)
        before = (x, y)
    return out


def line_arrays(docs: DataFrame) -> DataFrame:
    """doc_id, tag (of the text), hashes and lengths of the lines; a line counts without blanks at its ends, and an empty one hashes to 0."""
    text = F.coalesce("text", F.lit(""))
    one = docs.select("doc_id", text_key(text).alias("tag"), F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)).alias("rows"))
    return one.select("doc_id", "tag", F.transform("rows", lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("hashes"), F.transform("rows", lambda x: F.length(x)).alias("chars"))


def with_runs(arrays: DataFrame, least: int) -> DataFrame:
    """doc_id, tag, line: hashes of each text's lines (0: empty), and of its shortest runs of two lines or more that reach `least` characters from a line on or up to one.

    A common block of `least` characters lies in both texts and is covered by such runs inside it; runs of a single line are lines.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for hashes, chars in zip(batch.column(2), batch.column(3), strict=True):
                h, c = (x.values.to_numpy(zero_copy_only=False) for x in (hashes, chars))
                runs = Runs(h, c)
                spans = [np.r_[x, y] for x, y in zip(runs.reach(0, len(h), least), runs.reach_back(least), strict=True)]
                start, end = (x[spans[1] - spans[0] > 1] for x in spans)
                lists.append(np.unique(np.r_[h, runs.hashes(start, end).view(np.int64)]))
            ends = pa.array(np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32))
            values = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, values)], ["doc_id", "tag", "lines"])

    told = arrays.select(F.col("doc_id").cast("long").alias("doc_id"), "tag", "hashes", "chars").mapInArrow(work, "doc_id long, tag binary, lines array<long>")
    return told.select("doc_id", "tag", F.explode("lines").alias("line"))


def left_runs(arrays: DataFrame, least: int) -> DataFrame:
    """doc_id, tag, line: of texts with the places `removed` (null: none) the lines and shortest runs of `least` characters or more of which no occurrence has gone whole."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for hashes, chars, removed in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                h, c = (x.values.to_numpy(zero_copy_only=False) for x in (hashes, chars))
                gone = np.zeros(len(h) + 1, np.int64)
                if removed.is_valid:
                    gone[removed.values.to_numpy(zero_copy_only=False) + 1] = 1
                gone = np.cumsum(gone)
                runs = Runs(h, c)
                start, end = (np.r_[x, y] for x, y in zip(runs.reach(0, len(h), least), runs.reach_back(least), strict=True))
                long = end - start > 1
                hashed = np.where(long, runs.hashes(start, end).view(np.int64), h[np.minimum(start, max(len(h) - 1, 0))] if len(h) else 0)
                whole = gone[end] - gone[start] == end - start
                lists.append(np.setdiff1d(hashed[~whole], hashed[whole]))
            ends = pa.array(np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32))
            values = pa.array(np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, values)], ["doc_id", "tag", "lines"])

    told = arrays.select(F.col("doc_id").cast("long").alias("doc_id"), "tag", "hashes", "chars", "removed").mapInArrow(work, "doc_id long, tag binary, lines array<long>")
    return told.select("doc_id", "tag", F.explode("lines").alias("line")).where("line <> 0")


def overlaps(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (later_id, later_tag, first_id, first_tag): for each line of a text and each of its runs (see with_runs), the first document that holds it; and the lines of several holders with their first.

    What a document shares leads to the holders; each occurrence gives one pair at most, so the pairs never
    exceed the lines and runs (two for each line at most), however many documents share one. What is held once drops out before the join. The
    runs bring a block to a document that holds it where its lines stand earlier elsewhere, one by one.
    """
    # any share of the documents may hold one line: they are dealt to parts, and its first holder is told to those that have some
    first = kept(lines.groupBy("line").agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.count(F.lit(1)).alias("holders"), F.collect_set("part").alias("parts")).where("holders > 1"), "firsts")
    pairs = lines.join(first.select("line", "first", F.explode("parts").alias("part")), ["line", "part"]).where(F.struct("doc_id", "tag") != F.col("first")).select("doc_id", "tag", "first").distinct()
    return kept(pairs.select(F.col("doc_id").alias("later_id"), F.col("tag").alias("later_tag"), F.col("first.doc_id").alias("first_id"), F.col("first.tag").alias("first_tag")), "pairs"), first


def aligned_pairs(texts: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """tag, removed: the places of a text's lines that alignments with its partners delete."""
    # which is `later` follows from the order of ids; the pairs get both line arrays, not the texts
    firsts = texts.select(F.col("doc_id").alias("first_id"), F.col("tag").alias("first_tag"), F.col("hashes").alias("first_hashes"))
    laters = texts.select(F.col("doc_id").alias("later_id"), F.col("tag").alias("later_tag"), "hashes", "chars")
    both = spread_join(pairs, firsts, ["first_id", "first_tag"], ["later_id"], PARTS).join(laters, ["later_id", "later_tag"]).select("later_id", "later_tag", "first_hashes", "hashes", "chars")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (2, 3, 4)]
            gone = [common_lines(a, b, chars, least) for a, b, chars in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "tag", "removed"])

    cut = both.mapInArrow(align, "doc_id long, tag binary, removed array<int>").where(F.size("removed") > 0)
    return together(cut)


def together(cut: DataFrame) -> DataFrame:
    return cut.groupBy("tag").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))


def further(texts: DataFrame, lines: DataFrame, first: DataFrame, pairs: DataFrame, cut: DataFrame, least: int) -> DataFrame:
    """aligned_pairs() with the further holders of what the first ones have left (where blocks cross, an alignment keeps one of them).

    Runs of `least` characters that stay are brought to their other holders in the order of ids: to the second, then to as many again as have been tried,
    until each run has gone or has no holder that comes before its document. Rounds are few, and most runs go with the first holder of the same order.
    """
    of_text = lambda cut: texts.join(cut, "tag", "left")
    # only texts that have a partner before them hold lines that somebody else does
    later = pairs.select(F.col("later_id").alias("doc_id"), F.col("later_tag").alias("tag")).distinct()
    stay = kept(left_runs(of_text(cut).join(later, ["doc_id", "tag"], "left_semi"), least), "left")
    rest = spread_join(stay, first.where("holders > 2").select("line", "first"), ["line"], ["doc_id"], PARTS)
    rest = kept(rest.where(F.struct("doc_id", "tag") > F.col("first")).select("doc_id", "tag", "line"), "left")
    forget(stay)
    if rest.isEmpty():
        forget(rest)
        return cut
    some = kept(lines.select("line", "doc_id", "tag").join(rest.select("line").distinct(), "line", "left_semi"), "held")
    places = kept(row_ids(some, ["line", "doc_id", "tag"], "place"), "places")
    begin = places.groupBy("line").agg(F.min("place").alias("begin"))
    own = rest.join(places.withColumnRenamed("place", "own"), ["line", "doc_id", "tag"])
    spent = [rest, some]
    rest = kept(spread_join(own, begin, ["line"], ["doc_id"], PARTS).where("own - begin > 1"), "left")
    tried, a, b = pairs, 1, 2
    while not rest.isEmpty():
        at = F.explode(F.sequence(F.col("begin") + a, F.least(F.col("begin") + b, F.col("own")) - 1))
        targets = rest.select(F.col("doc_id").alias("later_id"), F.col("tag").alias("later_tag"), at.alias("place"))
        found = targets.join(places.select("place", F.col("doc_id").alias("first_id"), F.col("tag").alias("first_tag")), "place").drop("place").distinct()
        new = kept(found.join(tried, ["later_id", "later_tag", "first_id", "first_tag"], "left_anti"), "pairs")
        spent += [rest, new]
        if not new.isEmpty():
            spent.append(cut)
            cut = kept(together(cut.unionByName(aligned_pairs(texts, new, least))), "cut")
            tried = tried.unionByName(new)
        a, b = b, 2 * b
        # what is left of the runs that have more holders
        more = rest.where(F.col("begin") + a < F.col("own"))
        rest = kept(more.join(left_runs(of_text(cut).join(more.select("doc_id", "tag").distinct(), ["doc_id", "tag"], "left_semi"), least), ["doc_id", "tag", "line"], "left_semi"), "left")
    forget(rest, places, *spent)
    return cut


def repeated_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, tag, removed (places of the lines to delete, sorted), one row per text of an id that loses lines."""
    arrays = kept(line_arrays(docs.where(F.col("doc_id").isNotNull())), "lines")
    texts = arrays.groupBy("tag").agg(F.min("doc_id").alias("doc_id"))
    single = kept(arrays.join(texts, ["tag", "doc_id"], "left_semi").dropDuplicates(["tag", "doc_id"]), "texts")
    lines = kept(with_runs(single, least).where("line <> 0").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")), "runs")
    pairs, first = overlaps(lines)
    cut = further(single, lines, first, pairs, kept(aligned_pairs(single, pairs, least), "cut"), least)
    forget(lines, first, pairs)
    # copies of an earlier text are aligned with it from end to end
    sizes = arrays.select("doc_id", "tag", F.size("chars").alias("n_lines"), F.aggregate("chars", F.lit(0), lambda a, c: a + c).alias("n_chars")).where(F.col("n_chars") >= least).distinct()
    copies = spread_join(sizes, texts.withColumnRenamed("doc_id", "first_id"), ["tag"], ["doc_id"], PARTS).where("doc_id > first_id")
    return copies.select("doc_id", "tag", F.sequence(F.lit(0), F.col("n_lines") - 1).alias("removed")).unionByName(texts.join(cut, "tag").select("doc_id", "tag", "removed"))


def drop_lines(text: Column, removed: Column) -> Column:
    """A text without the lines at the places in `removed` (null: none)."""
    lines = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(removed, i))
    return F.when(removed.isNull(), text).otherwise(F.array_join(lines, "\n"))


def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """The rows of docs without the lines that an earlier document holds, and `n_removed_lines` beside.

    Documents that share a line, or a run of lines of `least` characters, meet through the first document with it, and through the further ones while the run stays; a patience diff aligns them, and the blocks
    in common of `least` characters or more are deleted from the later document (the greater doc_id). All is judged on the texts
    as they come. A copy of a whole text loses every line; its text is then empty.

    Null and empty texts stay as they are, rows with a null doc_id too. Rows of one doc_id and text get the same result; those of
    one doc_id with other texts are ordered by a hash. An empty table gives no rows. A column `n_removed_lines` of docs is replaced.
    """
    lost = repeated_lines(docs, least).select(F.col("doc_id").alias("lost_id"), F.col("tag").alias("lost_tag"), F.col("removed").alias("lost_lines"))
    tag = text_key(F.coalesce("text", F.lit("")))
    joined = docs.join(lost, (F.col("doc_id") == F.col("lost_id")) & (tag == F.col("lost_tag")), "left")
    columns = [drop_lines(docs["text"], F.col("lost_lines")).alias("text") if c == "text" else docs[c] for c in docs.columns if c != "n_removed_lines"]
    return joined.select(*columns, F.coalesce(F.array_size("lost_lines"), F.lit(0)).cast("long").alias("n_removed_lines"))


def without_repeats(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """dedup_lines() with the columns of docs alone; a document that lost lines and has no word left goes, others stay."""
    done = dedup_lines(docs, least)
    return done.where((F.col("n_removed_lines") == 0) | (word_count(F.col("text")) > 0)).select(*docs.columns)


def op5_patience_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_removed_lines", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
