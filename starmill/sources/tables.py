"""Reading and writing grids, catalogues and fit products as Parquet and CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, ORC, JSON, CSV or blank-separated text, by the path's extension. CSV without a schema is read as strings with a header."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "orc"):
        return getattr(spark.read, kind)(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "json":
        return reader.json(path)
    return reader.csv(path, header=True, sep="," if kind == "csv" else " ", comment="#", ignoreLeadingWhiteSpace=True)


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    writer = df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)
    {"orc": writer.orc, "json": writer.json}.get(kind, writer.parquet)(path) if kind != "csv" else writer.csv(path, header=True)


def write_grid(models: DataFrame, bands: DataFrame, path: str) -> None:
    """A model grid: models by subgrid where they have one, and the bands' wavelengths."""
    write_table(models, f"{path}/models.parquet", ["subgrid"] if "subgrid" in models.columns else ())
    write_table(bands, f"{path}/bands.parquet")


def read_grid(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Models (only the columns asked for) and bands."""
    models = spark.read.parquet(f"{path}/models.parquet")
    return models.select(*columns) if columns else models, spark.read.parquet(f"{path}/bands.parquet")


def save_bucketed(df: DataFrame, name: str, buckets: int, key: str = "model_id", path: str | None = None) -> DataFrame:
    """A table of the catalogue in sorted buckets of a key. Tables of as many buckets (a grid, its noise, its likelihoods) are joined by that key without an exchange."""
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer if path is None else writer.option("path", path)).saveAsTable(name)
    return df.sparkSession.table(name)


def read_noise(spark: SparkSession, path: str, needed: Sequence[str] = ("bias", "error", "completeness")) -> DataFrame:
    """A noise model; an error where one of the needed columns is missing."""
    df = spark.read.parquet(path)
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    return df


def read_observations(df: DataFrame, filters: Sequence[str], names: dict[str, str] | None = None) -> DataFrame:
    """star_id, ra, decl and flux (an array in the order of the filters) of a catalogue; names: {filter: column}, else <filter>_rate."""
    names = names or {}
    return df.select("star_id", "ra", "decl", F.array(*[F.col(names.get(f, f"{f.lower()}_rate")) for f in filters]).alias("flux"))


def band_lookup(bands: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of a band table for names in the order asked, pos beside; unknown names give nulls."""
    asked = bands.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("pos", "name"))
    return asked.join(bands, "name", "left")


def append_rows(table: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Rows of `more` whose key is new, behind those of the table."""
    return table.unionByName(more.join(table.select(key), key, "left_anti"))


def import_tracks(df: DataFrame, file: str, order: str, mass: str) -> DataFrame:
    """Track rows with eep (place in the file) and m_ini (largest mass of the file)."""
    from pyspark.sql import Window as W

    return df.withColumn("eep", F.row_number().over(W.partitionBy(file).orderBy(order)) - 1).withColumn("m_ini", F.max(mass).over(W.partitionBy(file)))


def region_lines(df: DataFrame, ra: str, dec: str, flag: str, radius: float = 0.5) -> DataFrame:
    """One region line per row, green or, where flag is set, red."""
    colour = F.when(F.col(flag) != 0, "red").otherwise("green")
    return df.select(F.format_string(f"fk5;circle(%.6f,%.6f,{radius}\") # color=%s", F.col(ra).cast("double"), F.col(dec).cast("double"), colour).alias("value"))


def tracks_in_range(tracks: DataFrame, feh: str, low: float, high: float) -> DataFrame:
    """Tracks with a metallicity in the range, and those of its neighbour on either side. The list of metallicities is short; with files by metallicity only these are read."""
    from pyspark.sql import Window as W

    w = W.orderBy(feh)
    values = tracks.select(feh).distinct().select(feh, F.lag(feh).over(w).alias("before"), F.lead(feh).over(w).alias("after"))
    near = values.where(F.col(feh).between(low, high) | F.col("before").between(low, high) | F.col("after").between(low, high))
    return tracks.join(F.broadcast(near.select(feh)), feh, "left_semi")


def write_fit(products: dict[str, DataFrame], path: str, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """The tables of fit() side by side: <path>/stats.parquet, pdf1d.parquet, pdf2d.parquet and lnp.parquet; by: columns such as sd_bin and sub that part each."""
    for name, df in products.items():
        write_table(df, f"{path}/{name}.parquet", [c for c in by if c in df.columns], mode)


def read_fit(spark: SparkSession, path: str, names: Sequence[str] = ("stats", "pdf1d", "pdf2d", "lnp")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}


def read_sed_data(models: DataFrame, columns: Sequence[str] | None = None) -> DataFrame | list[str]:
    """The named parameters of a grid and no others; without names, the list of those it has."""
    return models.columns if columns is None else models.select(*columns)


def read_noise_data(noise: DataFrame, params: Sequence[str] = ("bias", "error", "completeness"), band: int | None = None) -> DataFrame:
    """model_id and the arrays of a noise model, or of each array the element of one band (from 0)."""
    return noise.select("model_id", *[F.col(p) if band is None else F.get(p, F.lit(band)).alias(p) for p in params])


def flat_catalogue(df: DataFrame, blocks: dict[str, Sequence[str]], key: str) -> DataFrame:
    """A catalogue of array blocks as flat columns with upper-case names: blocks has the names of each array's elements."""
    return df.select(key, *[F.get(b, F.lit(k)).alias(n.upper()) for b, names in blocks.items() for k, n in enumerate(names)])


def load_isochrones(df: DataFrame, age: str = "log_a", metal: str = "z", digits: int = 6) -> DataFrame:
    """The distinct ages and metallicities, rounded, of the rows with a finite age."""
    finite = F.col(age).isNotNull() & ~F.isnan(age) & (F.abs(age) < float("inf"))
    return df.where(finite).select(F.round(age, digits).alias(age), F.round(metal, digits).alias(metal)).distinct()


def read_described(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """Blank-separated text whose comment lines describe it: `# alias NAME = COLUMN`, `## COLUMN UNIT DESCRIPTION`; the first other line of each file names the columns, in all files the same.

    Gives the table, all columns as strings with unit and comment in their metadata, and the aliases. The comment lines come to the driver, a header's worth, and a row per file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    head = [r.value for r in lines.where(F.col("value").startswith("#")).select("value").collect()]
    aliases = {a.strip(): b.strip() for x in head if x.startswith("# alias ") for a, b in [x.removeprefix("# alias ").split("=", 1)]}
    told = {w[0]: (w[1] if len(w) > 1 else "", " ".join(w[2:])) for x in head if x.startswith("##") and (w := x[2:].split())}
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    first = rows.groupBy("file").agg(F.min(F.struct("start", "line", "value")).alias("f")).select("file", F.col("f.line").alias("named"), F.col("f.value").alias("names"))
    names = {tuple(r.names.split()) for r in first.select("names").distinct().collect()}
    if len(names) > 1:
        raise ValueError(f"the files of {path} name other columns each")
    columns = list(names.pop()) if names else []
    words = F.split(F.trim("value"), r"\s+")
    out = rows.join(first.select("file", "named"), "file").where("line <> named").select(words.alias("w"))
    out = out.select(*[F.get("w", F.lit(k)).alias(c) for k, c in enumerate(columns)])
    for c in columns:
        if c in told:
            out = out.withMetadata(c, {"unit": told[c][0], "comment": told[c][1]})
    return out, aliases
