"""A quality classifier: regularised quadratic discriminant over document statistics (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.llm.common import WORD, kept, read

FEATURES = ("log_words", "word_length", "symbols", "capitals", "marks", "digits", "distinct", "lines", "repeats")
#: Share of the pooled diagonal in each class covariance, and what each variance gets added.
SHRINKAGE, RIDGE = 0.1, 1e-3
#: Log odds beyond this are cut, so scores stay apart from 0 and 1.
MOST_ODDS = 30.0


def nameless(docs: DataFrame) -> Column:
    """A hash of the text of rows with a null doc_id, by which they are told apart; null for others."""
    return F.when(docs["doc_id"].isNull(), F.xxhash64(F.coalesce(docs["text"], F.lit(""))))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, tag (see nameless) and the transformed statistics of each whole text (null: empty), one row per row of docs."""
    one = docs.select("doc_id", nameless(docs).alias("tag"), F.coalesce("text", F.lit("")).alias("text"))
    one = one.select("doc_id", "tag", "text", F.lower("text").alias("low"), F.split("text", "\n", -1).alias("rows"))
    one = one.select("doc_id", "tag", "text", "rows", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)).alias("words"))
    chars = F.length("text").cast("double")
    without = lambda pattern: chars - F.length(F.regexp_replace("text", pattern, ""))
    share = lambda n: F.log((n + 0.5) / (F.col("chars") + 1.0))
    one = one.select(
        "doc_id", "tag", F.size("words").cast("double").alias("n"), chars.alias("chars"), (chars - F.length(F.translate("text", "#*$%&|<>", ""))).alias("symbols"), without(r"\p{Lu}+").alias("capitals"),
        without(r"[.,;:!?]+").alias("marks"), without(r"\p{N}+").alias("digits"), without(r"[\x20\x09-\x0D]+").alias("blanks"), F.size(F.array_distinct("words")).cast("double").alias("distinct"),
        F.size("rows").cast("double").alias("rows"), F.size(F.array_distinct("rows")).cast("double").alias("own_rows"),
    )
    return one.select(
        "doc_id", "tag", F.log1p("n").alias("log_words"), F.log1p(F.when(F.col("n") > 0, (F.col("chars") - F.col("blanks")) / F.col("n")).otherwise(0.0)).alias("word_length"),
        *[share(F.col(c)).alias(c) for c in ("symbols", "capitals", "marks", "digits")], F.log((F.col("distinct") + 1.0) / (F.col("n") + 1.0)).alias("distinct"), F.log(F.col("rows") / (F.col("n") + 1.0)).alias("lines"),
        F.log((F.col("own_rows") + 1.0) / (F.col("rows") + 1.0)).alias("repeats"),
    )


@dataclass(frozen=True)
class Discriminant:
    """Per class 0 and 1: mean, inverse of the covariance's Cholesky factor, half its log determinant, log prior."""

    means: np.ndarray
    whiteners: np.ndarray
    half_log_dets: np.ndarray
    log_priors: np.ndarray

    def log_odds(self, x: list[Column]) -> Column:
        """Log density difference by squared Mahalanobis distances: z = inverse factor times (x - mean)."""
        parts = []
        for mean, w, half, prior in zip(self.means, self.whiteners, self.half_log_dets, self.log_priors, strict=True):
            off = [c - float(m) for c, m in zip(x, mean, strict=True)]
            z = [sum((off[j] * float(w[i, j]) for j in range(i + 1)), F.lit(0.0)) for i in range(len(x))]
            parts.append(sum((c * c for c in z), F.lit(0.0)) * -0.5 + float(prior - half))
        return parts[1] - parts[0]


def fit(rows: DataFrame, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Discriminant | float:
    """From rows of the features and label 0 or 1: one aggregation of means and covariances over all of them.

    Each class covariance is moved by `shrinkage` to the diagonal of the pooled one; its Cholesky factor is made once. Where a class
    is missing there is nothing to tell apart: the result is then the share of label 1 (0.5 without labels).
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    told = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(FEATURES)], *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i, j in pairs])
    by = {r["label"]: r for r in told.collect()}  # two rows at most
    n = np.array([by[k]["n"] if k in by else 0 for k in (0, 1)], float)
    if not n.all():
        return float(n[1] / n.sum()) if n.sum() else 0.5
    means = np.array([[by[k][f"m{i}"] for i in range(d)] for k in (0, 1)])
    covs = np.zeros((2, d, d))
    for k in (0, 1):
        for i, j in pairs:
            covs[k, i, j] = covs[k, j, i] = by[k][f"c{i}_{j}"]
    pooled = np.diag(np.einsum("k,kii->i", n / n.sum(), covs))
    factors = np.linalg.cholesky((1 - shrinkage) * covs + shrinkage * pooled + ridge * np.eye(d))
    return Discriminant(means, np.linalg.inv(factors), np.log(np.einsum("kii->ki", factors)).sum(1), np.log(n / n.sum()))


def held_out(doc_id: Column) -> Column:
    """Documents that a fit never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of classify() and their tag (see nameless)."""
    stats = kept(statistics(docs), "statistics")
    taught = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("taught_id")).agg(F.max("quality").alias("label"))
    model = fit(stats.where(~held_out(F.col("doc_id"))).join(taught, F.col("doc_id") == F.col("taught_id")))
    if isinstance(model, float):
        score = F.lit(model)
    else:
        odds = model.log_odds([F.col(c) for c in FEATURES])
        score = 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(MOST_ODDS)), F.lit(-MOST_ODDS))))
    scored = stats.select("doc_id", "tag", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every row of docs.

    All labelled rows that are not held out teach; of several labels of a doc_id the highest counts; null labels
    and ids teach nothing. Null and empty texts get a score as others do. Repeated rows get a row each. Empty
    tables give no rows, and no labels a score of 0.5. Other columns are not read.
    """
    return judged(docs, labels).drop("tag")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier takes for good; an id whose rows differ stays if one of them is good, rows with a null id are judged by their own text."""
    good = judged(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("good_id"), F.col("tag").alias("good_tag")).distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(F.col("good_id")) & nameless(docs).eqNullSafe(F.col("good_tag")), "left_semi")


def op8_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
