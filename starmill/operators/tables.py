"""Table verbs: columns by pattern, joins with postfixes, runs, duplicates and statistics."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from starmill.operators.percentiles import grouped_percentiles


def names_like(df: DataFrame, fields: str | Sequence[str], full: bool = False) -> list[str]:
    """Columns whose names a pattern matches, case ignored: from their start, or as a whole; several patterns by comma or blank."""
    wanted = re.split(r"[,\s]+", fields.strip()) if isinstance(fields, str) else list(fields)
    if "*" in wanted:
        return df.columns
    match = re.fullmatch if full else re.match
    return [c for c in df.columns if any(match(p, c, re.IGNORECASE) for p in wanted)]


def select(df: DataFrame, fields: str | Sequence[str], full: bool = False) -> DataFrame:
    return df.select(*names_like(df, fields, full))


def where(df: DataFrame, condition: str, **values: object) -> DataFrame:
    """Rows that meet an expression; :name stands for a bound value."""
    return df.sparkSession.sql(f"SELECT * FROM {{df}} WHERE {condition}", args=values, df=df)


def select_where(df: DataFrame, fields: str | Sequence[str], condition: str, **values: object) -> DataFrame:
    return select(where(df, condition, **values), fields)


def evaluate(df: DataFrame, name: str, expression: str, unit: str = "", description: str = "") -> DataFrame:
    """Adds a column by an expression, with unit and description as metadata."""
    return df.withColumn(name, F.expr(expression)).withMetadata(name, {"unit": unit, "description": description})


def take(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is in the one column of ids."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def aliases(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed: {alias: name}."""
    return df.withColumnsRenamed({v: k for k, v in names.items()})


def join_by(left: DataFrame, right: DataFrame, key: str, how: str = "inner", postfixes: tuple[str, str] = ("1", "2"), defaults: dict[str, object] | None = None) -> DataFrame:
    """Equi-join; columns of both sides but the key get the postfixes, and what a side lacks its defaults."""
    clash = {c for c in left.columns if c in right.columns and c != key}
    a, b = (d.withColumnsRenamed({c: c + p for c in clash}) for d, p in ((left, postfixes[0]), (right, postfixes[1])))
    out = a.join(b, key, {"outer": "full", "leftouter": "left"}.get(how, how))
    return out.fillna(defaults) if defaults else out


def match(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """All pairs (left_id, right_id) of equal key."""
    return left.select(F.col(left_id).alias("left_id"), key).join(right.select(F.col(right_id).alias("right_id"), key), key).select("left_id", "right_id")


def runs(df: DataFrame, key: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """run, first and last place and rows of each run of equal keys in an order (within `by`)."""
    w = W.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = df.withColumn("place", F.row_number().over(w)).withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return rows.groupBy(*by, "run", key).agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n"))


def find_duplicates(df: DataFrame, columns: Sequence[str], position: str) -> DataFrame:
    """Rows of `columns` that occur again, once, with their first position."""
    return df.groupBy(*columns).agg(F.min(position).alias(position), F.count(F.lit(1)).alias("n")).where("n > 1")


def stats(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row per field: mean, std (population), min, max, p16, p50, p84 without NaN, and has_nan."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])).alias("e")).select("e.*")
    some = long.withColumn("q", F.when(~F.isnan("x"), F.col("x")))
    moments = [F.avg("q").alias("mean"), F.stddev_pop("q").alias("std"), F.min("q").alias("min"), F.max("q").alias("max"), F.bool_or(F.coalesce(F.isnan("x"), F.lit(False))).alias("has_nan")]
    return grouped_percentiles(some, ["field"], "q", {"p16": 0.16, "p50": 0.5, "p84": 0.84}, *moments).select("field", "mean", "std", "min", "max", "p16", "p50", "p84", "has_nan")


def difference_metrics(df: DataFrame, keys: Sequence[str], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per field: least, largest, median and mean of the absolute steps from row to row within `by`."""
    w = W.partitionBy(*by).orderBy(*order)
    steps = df.select(*[F.abs(F.col(k) - F.lag(k).over(w)).alias(k) for k in keys])
    long = steps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("double").alias("d")) for k in keys])).alias("e")).select("e.*").where("d IS NOT NULL")
    return grouped_percentiles(long, ["field"], "d", {"median": 0.5}, F.min("d").alias("min"), F.max("d").alias("max"), F.avg("d").alias("mean"))


def stack(tables: Sequence[DataFrame], defaults: dict[str, object] | None = None) -> DataFrame:
    """Union by name; what a table lacks is null, or the default."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.fillna(defaults) if defaults else out


def sort_keys(order: Sequence[str]) -> list[Column]:
    """Sort columns of an order: names, with - ahead for descending ones (nulls last there)."""
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]


def in_ranges(df: DataFrame, order: Sequence[str], rows_per_part: int = 1 << 20, most: int = 256) -> DataFrame:
    """Adds `part_of`: the number of a row's range of the order (see sort_keys), from 0 up; as many ranges of nearly equal size as hold `rows_per_part` rows, up to `most`.

    The ranges' ends are fixed numbers of the plan, drawn by a hash from the rows (a hundred a range at most come to the driver): every use of the result has the same ranges.
    A descending column that is no number ends the part of the order that the ranges follow.
    """
    n = df.count()
    parts = max(1, min(most, -(-n // rows_per_part)))
    keys: list[Column] = []
    for c in order:
        if not c.startswith("-"):
            keys.append(F.col(c))
        elif isinstance(df.schema[c[1:]].dataType, NumericType):
            keys += [F.col(c[1:]).isNull(), -F.col(c[1:])]
        else:
            break
    if parts == 1 or not keys:
        return df.withColumn("part_of", F.lit(0))
    share = min(1.0, 50 * parts / n)
    names = [f"k{i}" for i in range(len(keys))]
    some = df.select(*[k.alias(c) for k, c in zip(keys, names, strict=True)])
    # a share that follows n, in steps fine enough for any n; of more keys than expected those of the least hash, wherever they lie in the order
    by_hash = F.pmod(F.xxhash64(*names), F.lit(1 << 48))
    drawn = some.where(by_hash < int(share * (1 << 48)) + 1).distinct().orderBy(by_hash, *names).limit(100 * parts).orderBy(*names).collect()
    ends = [drawn[len(drawn) * k // parts] for k in range(1, parts)] if drawn else []
    key = F.struct(*[k.alias(c) for k, c in zip(keys, names, strict=True)])
    ends = [F.struct(*[F.lit(v).cast(some.schema[c].dataType).alias(c) for c, v in zip(names, e, strict=True)]) for e in ends]

    def at(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < ends[mid], at(low, mid)).otherwise(at(mid + 1, high))

    return df.withColumn("part_of", at(0, len(ends)))


def row_ids(df: DataFrame, order: Sequence[str], name: str = "row_id", rows_per_part: int = 1 << 20) -> DataFrame:
    """Consecutive numbers from 0 in an order (see sort_keys), by two levels: ranges of the order are numbered each by itself and shifted by what lies before."""
    placed = in_ranges(df, order, rows_per_part)
    inner = placed.withColumn("place_in", F.row_number().over(W.partitionBy("part_of").orderBy(*sort_keys(order))))
    before = placed.groupBy("part_of").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("part_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(F.broadcast(before.select("part_of", "before")), "part_of").withColumn(name, F.col("before") + F.col("place_in") - 1).drop("part_of", "place_in", "before")


def unique_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """q: the distinct values of several columns together."""
    return df.select(F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("q")).distinct()


def without(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the used ones."""
    return df.join(used.select(key), key, "left_anti")


def callables(df: DataFrame, functions: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The grid after each of a caller's functions, in their order: each takes a grid and gives it back with what it adds."""
    for f in functions:
        df = df.transform(f)
    return df


def elementwise(f: Callable[[pd.Series], pd.Series], returns: str = "double") -> Callable[[Column], Column]:
    """A column function from one of numpy arrays or pandas Series, for what columns can't say; a batch at a time."""

    def batch(values: pd.Series) -> pd.Series:
        return pd.Series(f(values))

    return F.pandas_udf(batch, returns)


# Names that expressions know from numpy, and what Spark calls them.
NUMPY_NAMES = {"log10": "log10", "log": "ln", "exp": "exp", "sqrt": "sqrt", "abs": "abs", "absolute": "abs", "power": "power", "where": "if", "maximum": "greatest", "minimum": "least", "sin": "sin", "cos": "cos", "tan": "tan", "arcsin": "asin", "arccos": "acos", "arctan": "atan", "arctan2": "atan2", "isnan": "isnan", "floor": "floor", "ceil": "ceil", "sign": "signum", "deg2rad": "radians", "rad2deg": "degrees"}


def expression(text: str, **values: float | str) -> Column:
    """An expression over columns with numpy's names of functions (np. ahead or not), & | ~ ** == between terms, and bound values by :name."""
    out = re.sub(r"\b(?:np|numpy)\.", "", text)
    out = re.sub(r"\b(" + "|".join(NUMPY_NAMES) + r")\s*\(", lambda m: NUMPY_NAMES[m[1]] + "(", out)
    out = out.replace("==", "=").replace("&", " AND ").replace("|", " OR ").replace("~", " NOT ")
    while (cut := re.sub(r"(\w*\([^()]*\)|[\w.]+)\s*\*\*\s*(-?[\w.]+|\([^()]*\))", r"power(\1, \2)", out)) != out:
        out = cut
    for name, value in values.items():
        quoted = "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)
        out = re.sub(rf":{name}\b", lambda _, q=quoted: q, out)
    return F.expr(out)
