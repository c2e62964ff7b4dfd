"""Synthetic photometric tables over the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: view: (table, columns). Literals with e0 are doubles in either engine.
VIEWS = {
    "fx_models": ("part", [
        "p_partkey AS model_id", "0.25e0 * (p_size % 9) AS av", "2e0 + 0.5e0 * (p_partkey % 7) AS rv", "6e0 + 0.5e0 * (p_partkey % 9) AS log_a", "0.5e0 + 0.5e0 * (p_partkey % 41) AS m_ini",
        "CASE p_partkey % 4 WHEN 0 THEN 0.004e0 WHEN 1 THEN 0.008e0 WHEN 2 THEN 0.019e0 ELSE 0.03e0 END AS z",
        "10e0 + (p_partkey % 151) / 10e0 + p_retailprice / 1000e0 AS f0", "8e0 + (p_partkey % 151) / 15e0 + 0.1e0 * (p_size % 9) AS f1",
        "6e0 + (p_partkey % 151) / 20e0 + 0.05e0 * (p_partkey % 7) + p_retailprice / 3000e0 AS f2", "1e0 + (p_partkey % 5) AS weight",
    ]),
    "fx_noise": ("fx_models", [
        "model_id", "0.01e0 * f0 AS b0", "-0.005e0 * f1 AS b1", "0e0 * f2 AS b2", "0.5e0 + 0.02e0 * f0 AS e0", "0.4e0 + 0.02e0 * f1 AS e1", "0.3e0 + 0.02e0 * f2 AS e2",
        "CASE WHEN model_id % 97 = 0 THEN 0e0 ELSE 0.9e0 END AS c0", "0.8e0 AS c1", "0.7e0 AS c2",
    ]),
    "fx_stars": ("supplier", [
        "s_suppkey AS star_id", "80e0 + 0.001e0 * (s_suppkey % 100) AS ra", "-69e0 + 0.001e0 * (s_suppkey % 37) AS decl", "12e0 + abs(s_acctbal) / 700e0 AS f0", "10e0 + abs(s_acctbal) / 1000e0 AS f1", "7.5e0 + abs(s_acctbal) / 1400e0 AS f2",
    ]),
    "fx_asts": ("lineitem", [
        "l_orderkey * 10 + l_linenumber AS ast_id", "20e0 + 0.5e0 * (l_partkey % 13) + l_quantity / 100e0 AS mag_in",
        "power(10e0, -0.4e0 * (20e0 + 0.5e0 * (l_partkey % 13) + l_quantity / 100e0)) * (1e0 + (l_discount - 0.05e0) * 4e0) AS rate_out",
        "CASE WHEN l_returnflag = 'R' AND l_tax > 0.04e0 THEN 1 ELSE 0 END AS cut_flag",
    ]),
    "fx_catalog": ("customer", [
        "c_custkey AS star_id", "80e0 + 0.0005e0 * (c_custkey % 211) AS ra", "-69e0 + 0.0005e0 * (c_custkey % 173) AS decl", "CASE WHEN c_custkey % 11 = 0 THEN 0e0 ELSE c_acctbal / 100e0 END AS f475w_rate",
        "CASE WHEN c_custkey % 13 = 0 THEN 0e0 ELSE c_acctbal / 150e0 END AS f814w_rate", "CASE WHEN c_acctbal > 0 THEN 30e0 - 2.5e0 * log10(c_acctbal) ELSE 99.999e0 END AS f475w_vega",
    ]),
    "fx_tracks": ("part", [
        "p_partkey AS track_row", "p_partkey % 4 AS z_id", "p_partkey % 20 AS mass_id", "CAST(floor(p_partkey / 20e0) AS BIGINT) AS eep", "5e0 + 0.05e0 * floor(p_partkey / 20e0) AS log_a", "3.5e0 + 0.01e0 * p_size AS log_t",
        "0.1e0 * (p_partkey % 20) + 0.02e0 * p_size AS log_l",
    ]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    table, columns = VIEWS[name]
    return view(spark, sf_dir, table).selectExpr(*columns)


def with_views(sql: str) -> str:
    """The SQL with the views that it names as common tables ahead of its own."""
    named = [n for n in VIEWS if n in sql or n == "fx_models" and "fx_noise" in sql]
    ahead = ", ".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in named)
    body = sql.strip()
    if not ahead:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{ahead}, {body[len(start):]}"
    return f"WITH {ahead} {body}"


def unit_sql(seed: int, *keys: str) -> str:
    """samples.unit() in SQL."""
    text = ", ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"((CAST('0x' || substr(md5(concat_ws(':', {text})), 1, 13) AS BIGINT)+0.5e0)/4503599627370496e0)"
