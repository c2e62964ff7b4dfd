"""Fitting a catalogue as its parts arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from starmill.operators.fit import StarFit
from starmill.operators.merge import merge_stats


def fit_stream(spark: SparkSession, stars_dir: str, schema: str, models: DataFrame, params: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Each new file of stars is fitted with all models and its stats are appended to `out`; the checkpoint is where a restart goes on. A batch that is run again replaces its own folder."""

    def batch(stars: DataFrame, number: int) -> None:
        StarFit(stars, models, params).stats().write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(stars_dir)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(stats: DataFrame, params: Sequence[str], n_parts: int) -> DataFrame:
    """Merged stats of the stars that every subgrid has fitted so far."""
    return merge_stats(stats.where(F.col("pmax").isNotNull()), params, n_parts)


def merge_stream(parts: DataFrame, params: Sequence[str], n_parts: int) -> DataFrame:
    """Merged stats of each star as soon as its last part has come: a stream of merge_stats() over a stream of the parts' stats (star_id, subgrid, total_log_norm, pmax, chi2min, <param>_best, <param>_exp).

    A star's state is what its parts come to so far: which those are, the running log-sum-exp of their norms, weighted expectations and best values; it goes when the star comes out. A part
    that comes again before that is left out, so each star's parts may come late, in any order and after a restart.
    """
    star = parts.schema["star_id"].dataType.simpleString()
    sums, bests = [f"{p}_exp" for p in params], [f"{p}_best" for p in params]
    state = "seen array<int>, top double, w double, pmax double, part int, chi2min double, best array<double>, moments array<double>"
    out = f"star_id {star}, pmax double, chi2min double, total_log_norm double, best_gridsub_tag int, {', '.join(f'`{b}` double' for b in bests)}, {', '.join(f'`{e}` double' for e in sums)}"

    def merged(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        seen, top, w, pmax, part, chi2min, best, moments = held.get if held.exists else ([], -np.inf, 0.0, -np.inf, 0, np.inf, [np.nan] * len(params), [0.0] * len(params))
        seen, best, moments = list(seen), list(best), np.array(moments, float)
        for f in frames:
            for row in f.to_dict("records"):
                if row["subgrid"] in seen:
                    continue
                seen.append(int(row["subgrid"]))
                new = max(top, row["total_log_norm"])
                old_w, own_w = w * np.exp(top - new) if w else 0.0, np.exp(row["total_log_norm"] - new)
                moments = (moments * old_w + own_w * np.array([row[e] for e in sums], float)) / (old_w + own_w) if old_w + own_w else moments
                top, w, chi2min = new, old_w + own_w, min(chi2min, row["chi2min"])
                if (row["pmax"], -row["subgrid"]) > (pmax, -part):
                    pmax, part, best = float(row["pmax"]), int(row["subgrid"]), [float(row[b]) for b in bests]
        if len(seen) < n_parts:
            held.update((seen, float(top), float(w), pmax, part, float(chi2min), best, moments.tolist()))
            return
        if held.exists:
            held.remove()
        yield pd.DataFrame([(*key, pmax, chi2min, top + np.log(w), part, *best, *moments)], columns=["star_id", "pmax", "chi2min", "total_log_norm", "best_gridsub_tag", *bests, *sums])

    wanted = parts.select("star_id", F.col("subgrid").cast("int").alias("subgrid"), *[F.col(c).cast("double").alias(c) for c in ("total_log_norm", "pmax", "chi2min", *bests, *sums)])
    return wanted.groupBy("star_id").applyInPandasWithState(merged, out, state, "append", GroupStateTimeout.NoTimeout)
