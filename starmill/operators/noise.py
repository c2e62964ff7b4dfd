"""Noise models from artificial-star tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starmill.operators.covariances import trunchen_noise
from starmill.operators.fit import MODEL_BLOCK, in_blocks, morton
from starmill.operators.percentiles import grouped_percentiles

#: Nodes that go to every executor at most, nodes of a block, and models that look for their nearest together.
BROADCAST_NODES, NODE_BLOCK, LEAF = 100_000, 64, 32


def toothpick_bins(asts: DataFrame, by: Sequence[str] = (), bins: int = 50, ratio: float = 2.0, least: int = 10, robust: bool = True) -> DataFrame:
    """Per bin of log input flux (and per `by`, such as band): n, compl, bias, sigma (relative) and flux_in, the bin's centre.

    asts: mag_in, rate_out, cut_flag. An output counts as lost (0) where cut_flag is set or it is more than `ratio` times the input.
    robust: median and half the 16-84 range of (out - in) / in of the recovered; else mean and population deviation. Bins with `least` recovered or fewer are left out.
    """
    f_in = F.pow(F.lit(10.0), -0.4 * F.col("mag_in"))
    a = asts.select(*by, f_in.alias("f_in"), F.when((F.col("cut_flag") > 0) | (F.col("rate_out") / f_in > ratio), 0.0).otherwise(F.col("rate_out")).alias("f_out"))
    limits = a.groupBy(*by).agg(F.log10(F.min("f_in")).alias("lo"), F.log10(F.max("f_in") * 1.000001).alias("hi"))
    a = a.join(F.broadcast(limits), list(by)) if by else a.crossJoin(F.broadcast(limits))
    width = (F.col("hi") - F.col("lo")) / bins
    a = a.select(*by, F.floor((F.log10("f_in") - F.col("lo")) / width).cast("int").alias("bin"), F.pow(F.lit(10.0), F.col("lo") + width * (F.floor((F.log10("f_in") - F.col("lo")) / width) + 0.5)).alias("flux_in"), F.when(F.col("f_out") != 0, (F.col("f_out") - F.col("f_in")) / F.col("f_in")).alias("d"))
    counts = [F.count(F.lit(1)).alias("n"), F.count("d").alias("found"), F.max("flux_in").alias("flux_in")]
    if robust:
        out = grouped_percentiles(a, [*by, "bin"], "d", {"p16": 0.16, "bias": 0.5, "p84": 0.84}, *counts).withColumn("sigma", (F.col("p84") - F.col("p16")) / 2)
    else:
        out = a.groupBy(*by, "bin").agg(*counts, F.avg("d").alias("bias"), F.stddev_pop("d").alias("sigma"))
    return out.where(F.col("found") > least).select(*by, "bin", "n", "flux_in", (F.col("found") / F.col("n")).alias("compl"), "bias", "sigma")


def interp_join(rows: DataFrame, x: str, knots: DataFrame, at: str, values: Sequence[str], fill: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Linear interpolation of `values` in the table of knots at column x; outside, the fill values or null. Knots are a bounded table (one row per bin).

    Each pair of neighbours is a segment; a range join with the segments brackets every row.
    """
    order = W.orderBy(at)
    seg = knots.select(F.col(at).alias("k0"), *[F.col(v).alias(f"{v}_0") for v in values], F.lead(at).over(order).alias("k1"), *[F.lead(v).over(order).alias(f"{v}_1") for v in values], F.row_number().over(W.orderBy(F.desc(at))).alias("from_end"))
    inner = seg.where("k1 IS NOT NULL")
    both = rows.join(F.broadcast(inner), (F.col(x) >= F.col("k0")) & ((F.col(x) < F.col("k1")) | ((F.col("from_end") == 2) & (F.col(x) == F.col("k1")))), "left")
    t = (F.col(x) - F.col("k0")) / (F.col("k1") - F.col("k0"))
    low, high = knots.agg(F.min(at).alias("m")).scalar(), knots.agg(F.max(at).alias("m")).scalar()
    cols = []
    for v in values:
        y = F.col(f"{v}_0") + (F.col(f"{v}_1") - F.col(f"{v}_0")) * t
        if fill and v in fill:
            y = F.when(F.col(x) < low, F.lit(fill[v][0])).when(F.col(x) > high, F.lit(fill[v][1])).otherwise(y)
        cols.append(y.alias(v))
    return both.select(*rows.columns, *cols)


def toothpick_noise(models: DataFrame, knots: DataFrame, flux: str, absflux: float = 0.0) -> DataFrame:
    """model_id, bias, error, completeness and rel_error (of the flux) of one band: knots at each model's flux, constant beyond; errors have the calibration term in squares and are negative where completeness is 0.

    The knots (a row per bin) are worked out once. A relative error doesn't depend on the flux, so it holds where that, or its square, is too small for a number.
    """
    knots = knots.sparkSession.createDataFrame(knots.collect(), knots.schema)  # as few as bins
    ends = {v: (F.min_by(v, "flux_in"), F.max_by(v, "flux_in")) for v in ("bias", "sigma", "compl")}
    edge = knots.agg(*[c.alias(f"{v}_{k}") for v, cs in ends.items() for k, c in enumerate(cs)]).first()
    near = interp_join(models.select("model_id", F.col(flux).alias("flux")), "flux", knots, "flux_in", ["bias", "sigma", "compl"], {v: (edge[f"{v}_0"], edge[f"{v}_1"]) if v != "compl" else (0.0, edge["compl_1"]) for v in ends})
    rel = F.sqrt(F.pow("sigma", 2) + absflux**2)
    rel = F.when(F.col("compl") <= 0, -rel).otherwise(rel)
    return near.select("model_id", (F.col("bias") * F.col("flux")).alias("bias"), (rel * F.abs("flux")).alias("error"), F.col("compl").alias("completeness"), rel.alias("rel_error"))


def splinter_noise(models: DataFrame, fluxes: Sequence[str], fraction: float, absflux: float = 0.0) -> DataFrame:
    """Bias 0, error a fraction of the flux (and the calibration term), completeness 1."""
    scale = (fraction**2 + absflux**2) ** 0.5
    return models.select("model_id", *[F.lit(0.0).alias(f"bias_{k}") for k in range(len(fluxes))], *[(F.col(f) * scale).alias(f"error_{k}") for k, f in enumerate(fluxes)], *[F.lit(1.0).alias(f"compl_{k}") for k in range(len(fluxes))])


def ast_covariance(asts: DataFrame, key: str, inputs: Sequence[str], outputs: Sequence[str], mags: Sequence[str], least: int = 5) -> DataFrame:
    """Per input model of the tests: n, compl, bias_i, cov_i_j and corr_i_j (i <= j, sample; of bands that don't vary 1 with themselves and 0 with others) of out - in over the detected (any mag below 90), where more than `least` are.

    in_i is the input itself, and least_i and most_i are the ends of the detected outputs.
    """
    seen = F.expr(" OR ".join(f"{m} < 90" for m in mags))
    d = [F.when(seen, F.col(o) - F.col(i)) for i, o in zip(inputs, outputs, strict=True)]
    pairs = [(i, j) for i in range(len(d)) for j in range(i, len(d))]
    ends = [f(F.when(seen, F.col(o))).alias(f"{name}_{k}") for k, o in enumerate(outputs) for name, f in (("least", F.min), ("most", F.max))]
    agg = asts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(seen, 1)).alias("found"), *[F.avg(x).alias(f"bias_{k}") for k, x in enumerate(d)], *[F.covar_samp(d[i], d[j]).alias(f"cov_{i}_{j}") for i, j in pairs],
        *ends, *[F.avg(F.col(i)).alias(f"in_{k}") for k, i in enumerate(inputs)],
    )
    scale = lambda i, j: F.sqrt(F.col(f"cov_{i}_{i}") * F.col(f"cov_{j}_{j}"))
    corr = {f"corr_{i}_{j}": F.lit(1.0) if i == j else F.when(scale(i, j) > 0, F.col(f"cov_{i}_{j}") / scale(i, j)).otherwise(0.0) for i, j in pairs}
    return agg.where(F.col("found") > least).withColumn("compl", F.col("found") / F.col("n")).withColumns(corr)


def leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of up to `size` neighbours each: halves along the widest side."""
    todo, out = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        wide = points[at, np.ptp(points[at], axis=0).argmax()]
        order = at[np.argpartition(wide, len(at) // 2)]
        todo += [order[: len(at) // 2], order[len(at) // 2 :]]
    return out


def first_nearest(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least distances of each row, the first columns on ties."""
    limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    less, same = d < limit, d == limit
    taken = less | same & (np.cumsum(same, axis=1) <= k - less.sum(1, keepdims=True))
    at, clear = np.empty((len(d), k), np.int64), taken.sum(1) == k
    at[clear] = np.nonzero(taken[clear])[1].reshape(-1, k)
    at[~clear] = np.argsort(d[~clear], axis=1, kind="stable")[:, :k]  # distances that are no numbers
    return at


def knn_blend(models: DataFrame, nodes: DataFrame, fluxes: Sequence[str], values: Sequence[str], k: int = 10, keep: Sequence[str] = ()) -> DataFrame:
    """model_id, each value blended over the k nearest nodes in log10 flux by 1 / max(distance, 0.01) (the smaller node_id on ties), and the model's own columns in keep.

    Models and nodes (the distinct inputs of the tests) lie in blocks along a Z-curve. From the boxes of the nodes' blocks follows how far the k nearest of any model of a block can be,
    and only blocks of nodes that come as near as that meet it. Inside the task, leaves of a few models look for theirs in the same way. Up to BROADCAST_NODES nodes (counted first) go to every executor; of more each
    model gets its nearest from every part of them, and the nearest of those.
    """
    dims, n = [f"l_{i}" for i in range(len(fluxes))], len(values)
    model = models.selectExpr("model_id AS id", *[f"log10(`{f}`) AS l_{i}" for i, f in enumerate(fluxes)], *[f"`{c}` AS z_{j}" for j, c in enumerate(keep)])
    node = nodes.selectExpr("node_id AS id", *[f"log10(`{f}`) AS l_{i}" for i, f in enumerate(fluxes)], *[f"`{c}` AS v_{j}" for j, c in enumerate(values)])
    # each side has a curve through its own range: models aside of all nodes would share a place on the nodes' one
    spans = ["count(*) AS n", *[f"{f}({d}) AS {f}_{d}" for d in dims for f in ("min", "max")]]
    ends, own_ends = node.selectExpr(*spans).first(), model.selectExpr(*spans).first()
    few, session = ends.n <= BROADCAST_NODES, models.sparkSession
    curve, own_curve = (morton(dims, [e[f"min_{d}"] or 0.0 for d in dims], [e[f"max_{d}"] or 0.0 for d in dims]) for e in (ends, own_ends))
    cores = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    there = in_blocks(node, curve, max(1, ends.n // (NODE_BLOCK * 256)), NODE_BLOCK, dims, ahead="n_")
    here = in_blocks(model, own_curve, 2 * cores, MODEL_BLOCK, dims)
    # how far away the k nearest may be: boxes by their farthest distance, until they have k nodes
    boxes = there.selectExpr("array_sort(collect_list(struct(size(n_id) AS c, " + ", ".join(f"n_lo_{d} AS lo_{d}, n_hi_{d} AS hi_{d}" for d in dims) + "))) AS boxes")
    far = " + ".join(f"pow(greatest(abs(hi_{d} - b.lo_{d}), abs(b.hi_{d} - lo_{d})), 2)" for d in dims)
    reach = f"aggregate(array_sort(transform(boxes, b -> struct({far} AS f, b.c AS c))), struct(0L AS n, CAST(0 AS DOUBLE) AS f), (s, x) -> struct(s.n + x.c AS n, CASE WHEN s.n >= {k} THEN s.f ELSE x.f END AS f)).f"
    gaps = [f"greatest(lo_{d} - n_hi_{d}, n_lo_{d} - hi_{d}, 0D)" for d in dims]
    here = here.crossJoin(F.broadcast(boxes)).selectExpr("*", f"{reach} AS reach").drop("boxes")
    pairs = here.join(F.broadcast(there) if few else there, F.expr(" + ".join(f"{g} * {g}" for g in gaps) + " <= reach * (1 + 1e-9D) + 1e-12D"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((models, "model_id"), (nodes, "node_id"))]
    schema = ", ".join([f"id {kinds[0]}", *[f"z_{j} double" for j in range(len(keep))], "d array<double>", f"node array<{kinds[1]}>", *[f"v_{j} array<double>" for j in range(n)]])
    names = [part.split()[0] for part in schema.split(", ")]
    mine, theirs = ["id", *dims, *[f"z_{j}" for j in range(len(keep))]], ["n_id", *[f"n_{d}" for d in dims], *[f"n_v_{j}" for j in range(n)]]

    def nearest(own: dict, pieces: list[dict]) -> pa.RecordBatch:
        found = {c: np.concatenate([p[c] for p in pieces]) for c in theirs}
        order = np.argsort(found["n_id"], kind="stable")
        found = {c: x[order] for c, x in found.items()}
        piece = np.repeat(np.arange(len(pieces)), [len(p["n_id"]) for p in pieces])[order]
        points = np.stack([own[c] for c in dims], 1)
        most, whole = min(k, len(order)), np.isnan(points).any() or any(np.isnan(found[f"n_{c}"]).any() for c in dims)
        at, far = np.empty((len(points), most), np.int64), np.empty((len(points), most))
        low, high = (np.array([[f(p[f"n_{c}"]) for c in dims] for p in pieces]) for f in (np.min, np.max))
        sizes = np.bincount(piece)
        for leaf in leaves(points, len(points) if whole else LEAF):
            some = slice(None)
            if not whole:
                a, b = points[leaf].min(0), points[leaf].max(0)
                reach = (np.maximum(np.abs(high - a), np.abs(b - low)) ** 2).sum(1)
                by = np.argsort(reach)
                reach = reach[by[np.searchsorted(np.cumsum(sizes[by]), most)]]
                gap = (np.maximum(np.maximum(a - high, low - b), 0) ** 2).sum(1)
                some = np.flatnonzero((gap <= reach * (1 + 1e-9) + 1e-12)[piece])
            d = np.sqrt(sum((points[leaf, i][:, None] - found[f"n_{c}"][some]) ** 2 for i, c in enumerate(dims)))
            first = first_nearest(d, most)
            far[leaf] = np.take_along_axis(d, first, 1)
            at[leaf] = first if whole else some[first]
        offsets = pa.array(np.arange(len(points) + 1) * most, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1))) for x in (far, found["n_id"][at], *[found[f"n_v_{j}"][at] for j in range(n)])]
        return pa.RecordBatch.from_arrays([pa.array(own["id"]), *[pa.array(own[f"z_{j}"]) for j in range(len(keep))], *lists], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pieces = None, []  # a block of models meets its blocks of nodes one after the other
        for batch in batches:
            for r in range(len(batch)):
                of = lambda c, r=r, batch=batch: batch.column(c)[r].values.to_numpy(zero_copy_only=False)
                ids = of("id")
                if own is None or ids[0] != own["id"][0] or len(ids) != len(own["id"]):
                    if own is not None:
                        yield nearest(own, pieces)
                    own, pieces = {c: of(c) for c in mine}, []
                pieces.append({c: of(c) for c in theirs})
        if own is not None:
            yield nearest(own, pieces)

    found = pairs.select(*mine, *theirs).mapInArrow(work, schema)
    zipped = "arrays_zip(d, node, " + ", ".join(f"v_{j}" for j in range(n)) + ")"
    own = [f"z_{j}" for j in range(len(keep))]
    top = found.selectExpr("id", *own, f"{zipped} AS top") if few else found.groupBy("id", *own).agg(F.expr(f"slice(array_sort(flatten(collect_list({zipped}))), 1, {k}) AS top"))
    blend = [f"aggregate(top, 0D, (s, e) -> s + e.v_{j} / greatest(e.d, 0.01D)) / aggregate(top, 0D, (s, e) -> s + 1 / greatest(e.d, 0.01D)) AS `{v}`" for j, v in enumerate(values)]
    return top.selectExpr("id AS model_id", *blend, *[f"z_{j} AS `{c}`" for j, c in enumerate(keep)])


def blended_noise(models: DataFrame, nodes: DataFrame, fluxes: Sequence[str], absflux: float = 0.0, k: int = 10) -> DataFrame:
    """The full noise of each model from ast_covariance() of the tests: model_id, bias_i, compl, icov_diag, icov_off, q_norm.

    Biases, completeness and covariances are blended over the k nearest inputs, the calibration term of the model's own fluxes comes on top, and then the matrices are inverted. nodes: a row per input with in_i, bias_i, compl and cov_i_j.
    """
    n = len(fluxes)
    covs = [f"cov_{i}_{j}" for i in range(n) for j in range(i, n)]
    biases = [f"bias_{i}" for i in range(n)]
    own = models.selectExpr("model_id", *[f"`{f}` AS flux_{i}" for i, f in enumerate(fluxes)])
    inputs = nodes.selectExpr("node_id", *[f"in_{i} AS flux_{i}" for i in range(n)], "compl", *biases, *covs)
    rows = knn_blend(own, inputs, [f"flux_{i}" for i in range(n)], ["compl", *biases, *covs], k, [f"flux_{i}" for i in range(n)])
    return trunchen_noise(rows, n, absflux, ["compl", *biases])


#: Noise models by name: functions of models and what they are fitted on, giving model_id with bias, error and completeness.
MODELS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def put(f: Callable) -> Callable:
        MODELS[name] = f
        return f

    return put


@register("toothpick")
def toothpick(models: DataFrame, asts: DataFrame, flux: str, absflux: float = 0.0, **how: object) -> DataFrame:
    """A band's noise from bins of artificial-star tests."""
    return toothpick_noise(models, toothpick_bins(asts, **how), flux, absflux).drop("rel_error")


@register("splinter")
def splinter(models: DataFrame, asts: DataFrame | None, flux: str, absflux: float = 0.0, fraction: float = 0.1) -> DataFrame:
    """A band's noise as a fraction of the flux; takes no tests."""
    return splinter_noise(models, [flux], fraction, absflux).select("model_id", F.col("bias_0").alias("bias"), F.col("error_0").alias("error"), F.col("compl_0").alias("completeness"))


def noise_model(name: str, models: DataFrame, asts: DataFrame | None, flux: str, **how: object) -> DataFrame:
    """The noise of one band by a registered model."""
    if name not in MODELS:
        raise ValueError(f"no noise model {name}; there are {', '.join(sorted(MODELS))}")
    return MODELS[name](models, asts, flux, **how)
