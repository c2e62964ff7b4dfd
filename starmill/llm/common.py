"""What the corpus operators share: words, sizes and tables kept between steps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset a local session gets a folder of its own under /tmp/checkpoints; a cluster has to set it.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


_written: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder, which goes at the end of cleaned_up()."""
    path = f"{shared_dir(spark)}/starmill-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: later steps don't compute them again.

    The result may be read long after, so the folder stays; forget() or the end of cleaned_up() delete it.
    """
    path = f"{shared_dir(df.sparkSession)}/starmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _written:
        _written.remove(path)


def forget(*tables: DataFrame) -> None:
    """Deletes results of kept() that nothing will read any more."""
    for table in tables:
        _delete(table.sparkSession, table.kept_at)


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what kept() wrote inside, whatever happened: for callers that have read or written their results by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [x for x in _written if x not in before]:
            _delete(spark, path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """kept(make()), without the tables that make() has kept on its way."""
    before = set(_written)
    out = kept(make(), name)
    for path in [x for x in _written if x not in before and x != out.kept_at]:
        _delete(out.sparkSession, path)
    return out


def spread_join(many: DataFrame, one: DataFrame, key: list[str], by: list[str], parts: int = 32) -> DataFrame:
    """many.join(one, key), where one key may have any share of the rows of `many` and `one` has a row for each key.

    The rows of a key are dealt to `parts` parts by a hash of the columns `by`, and its row of `one` is copied to those that have some.
    """
    dealt = many.withColumn("dealt_to", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
    present = dealt.select(*key, "dealt_to").distinct()
    return dealt.join(one.join(present, key), [*key, "dealt_to"]).drop("dealt_to")


def text_key(text: Column) -> Column:
    """16 bytes that tell texts apart, however many there are."""
    return F.unhex(F.md5(text))


def key_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("null"))


def constant_array(values: Iterable[float], digits: int = 4) -> Column:
    """A model's parameters as one constant of a plan, rounded to `digits`: a subquery can't stand in a lambda. Their number has to be fixed."""
    return F.split(F.lit(",".join(f"{v:.{digits}f}" for v in values)), ",").cast("array<double>")
