"""Quality rules and a hashed n-gram log-likelihood ratio (operator 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.llm.common import WORD, constant_array, read

SYMBOLS = "#*$%&|<>"
#: Buckets of the multinomials, added to each count, and the least mean log ratio of a kept document.
BUCKETS, SMOOTHING, THRESHOLD = 1 << 13, 1.0, -0.25
#: Documents that the trusted target is fitted on, at most.
TRUSTED = 20_000
#: A token is a run of letters, digits and _ or a run of other characters that are not blank.
TOKEN = r"[a-z0-9_\p{L}\p{N}]+|[^a-z0-9_\p{L}\p{N}\s]+"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30


def neighbours(hashes: str, apart: int) -> Column:
    """The hash of each element with the one `apart` places on, of a column of hashes."""
    some = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), some), F.slice(hashes, F.lit(apart + 1), some), lambda x, y: F.xxhash64(x, y))


def with_windows(df: DataFrame, words: str, to: str, window: int = WINDOW) -> DataFrame:
    """Adds the hashes of all runs of `window` words (a power of two): of twos by hashes of words, of fours by twos, and on."""
    df = df.withColumn(to, F.transform(words, lambda w: F.xxhash64(w)))
    apart = 1
    while apart < window:
        df, apart = df.withColumn(to, neighbours(to, apart)), apart * 2
    return df


def with_starts(df: DataFrame, hashes: str, to: str) -> DataFrame:
    """Adds the sorted places whose hash occurs again; null without any. Each array that a lambda looks into is a column first, so it is made once a row."""
    some = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("pairs_of", some)
    pairs = F.col("pairs_of")
    twice = F.filter(pairs, lambda p, k: F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False)))
    return df.withColumn(to, F.array_sort(F.transform(twice, lambda p: p["i"]))).drop("pairs_of")


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, text and the counts of the base rules, one row per row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select("doc_id", text.alias("text"))
    one = one.select("doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    one = one.select(
        "doc_id", "text", "words", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    rest = [c for c in one.columns if c != "words"]
    one = with_starts(with_windows(one, "words", "hashes").select(*rest, "hashes"), "hashes", "starts").select(*rest, "starts")
    span = F.aggregate("starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(WINDOW))).alias("n"), i.alias("last")))["n"]
    one = one.select(*rest, F.coalesce(span, F.lit(0)).cast("long").alias("n_repeat_words"))
    return one.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def with_ngrams(df: DataFrame) -> DataFrame:
    """Adds hashes of the tokens of the column text, in lower case, and of the pairs of neighbours: `singles` and `pairs`."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    return df.withColumn("singles", F.transform(tokens, lambda t: F.xxhash64(t))).withColumn("pairs", neighbours("singles", 1))


def bucket(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, most: int = TRUSTED) -> DataFrame:
    """One row with the array `ratios`: log of a bucket's probability in the trusted target over that in the raw corpus.

    The raw multinomial counts every n-gram of every document. The target is fitted on documents labelled quality 1 and not
    toxic, the `most` of them with the least hashes of their ids: so many ids, and no more, go to every executor, and one pass over the
    texts counts both. Without any of them all ratios are 0. The array has `buckets` doubles, whatever the corpus.
    """
    trusted = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("trusted_id")).distinct()
    trusted = trusted.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(most)
    told = docs.select("doc_id", "text").join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted_id"), "left")
    told = told.select("text", F.col("trusted_id").isNotNull().cast("int").alias("is_target"))
    # explode() would add a filter on its array, and that is the tokenising anew, below it
    grams = with_ngrams(told).select("is_target", F.explode_outer(F.concat("singles", "pairs")).alias("gram"))
    grams = grams.where(F.col("gram").isNotNull()).select("is_target", bucket(F.col("gram"), buckets).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_raw"), F.sum("is_target").alias("n_target"))
    both = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    added = float(buckets * smoothing)
    told = both.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n_raw", "n_target"))), lambda b: F.struct(b["n_raw"].alias("r"), b["n_target"].alias("t"))).alias("b"), F.sum("n_raw").alias("raw"), F.sum("n_target").alias("target"))
    ratio = lambda b: F.when(F.col("target") > 0, F.log((b["t"] + smoothing) / (F.col("target") + added)) - F.log((b["r"] + smoothing) / (F.col("raw") + added))).otherwise(F.lit(0.0))
    return told.select(F.transform("b", ratio).alias("ratios"))  # to the driver: `buckets` numbers


def score_quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: the base rules' counts, log_ratio (mean over its n-grams, 0 without any), base_failed and kept.

    kept: the base rules hold and log_ratio >= threshold. Null texts are empty and fail. Repeated rows get a row
    each; labels of unknown or null doc_ids are not used. Empty tables give no rows. Other columns are not read.
    """
    ratios = constant_array(log_ratios(docs, labels, buckets, smoothing).first()["ratios"])
    scored = with_ngrams(base_rules(docs))
    total = lambda grams, start: F.aggregate(grams, start, lambda a, g: a + F.get(ratios, bucket(g, buckets)))
    n_grams = F.size("singles") + F.size("pairs")
    scored = scored.withColumn("log_ratio", F.when(n_grams > 0, total("pairs", total("singles", F.lit(0.0))) / n_grams).otherwise(F.lit(0.0)))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("log_ratio") >= threshold)).alias("kept"), "log_ratio")


def op1_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
