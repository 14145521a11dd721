"""Sources ``(log_id, idx, src, x, y, z, q, start, stop, u)`` seen by receptors ``(receptor, x, y, z[, t])``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.functions.numeric import log_phi
from drawlake.operators.pairing import paired, returned
from drawlake.operators.predict import pooled_quantiles, predict_log_prob, predict_mean


@dataclass
class Flow:
    """Widths across the flow grow as a * d / sqrt(1 + b * d), in y and in z."""

    ay: float = 0.1
    by: float = 0.0
    az: float = 0.1
    bz: float = 0.0


def plume(xd: Column, yd: Column, zs: Column, zr: Column, u: Column, flow: Flow) -> Column:
    """Steady plume with ground reflection; ``xd`` and ``yd`` are source minus receptor, and 0 comes from xd <= 0."""
    sy = flow.ay * xd / F.sqrt(1 + flow.by * xd)
    sz = flow.az * xd / F.sqrt(1 + flow.bz * xd)
    side = F.exp(log_phi(yd / sy)) / sy
    up = (F.exp(log_phi((zs - zr) / sz)) + F.exp(log_phi((zs + zr) / sz))) / sz
    return F.when(xd > 0, side * up / u).otherwise(0.0)


def active(xd: Column, u: Column, t: Column, start: Column, stop: Column) -> Column:
    """Whether what passes at time t was released from start to stop, both included."""
    return (t - xd / u).between(start, stop)


def _spots(receptors: DataFrame, timed: bool = False) -> DataFrame:
    """Receptors with their place (and time) as ``rx, ry, rz[, t]``."""
    return receptors.select("receptor", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"), *(["t"] if timed else []))


def _reached(flow: Flow) -> Column:
    return plume(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"), F.col("z"), F.col("rz"), F.col("u"), flow)


def source_plume(sources: DataFrame, receptors: DataFrame, flow: Flow) -> DataFrame:
    """``(src, total, peak)``: sum and largest of a unit source's values over all receptors.

    Each pair of different places is evaluated once, and counts for as many receptors as stand there.
    """
    spots = _spots(receptors).groupBy("rx", "ry", "rz").agg(F.count("*").alias("_n"))
    where = ["x", "y", "z", "u"]
    values = paired(spots, sources.select(where).distinct()).withColumn("_v", _reached(flow))
    found = values.groupBy(where).agg(F.sum(F.col("_v") * F.col("_n")).alias("total"), F.max("_v").alias("peak"))
    return returned(sources.select("src", *where), found, where).select("src", "total", "peak")


def receptor_total(sources: DataFrame, receptors: DataFrame, flow: Flow, power: float = 1.0, timed: bool = False, draws: DataFrame | None = None) -> DataFrame:
    """``(log_id, idx, receptor, total)``: sum over sources of kernel times q^(1/power), for every draw and receptor.

    Receptors that no source reaches get 0. ``draws(log_id, idx)`` adds draws that have no source at all. Receptors at one
    place (and time) have the same totals, and a draw's sources of one place and span are summed before: each pair of
    different ones is evaluated once.
    """
    r = _spots(receptors, timed)
    where = ["rx", "ry", "rz", *(["t"] if timed else [])]
    spots = r.select(where).distinct()
    own = ["log_id", "idx", "x", "y", "z", "u", *(["start", "stop"] if timed else [])]
    released = sources.groupBy(own).agg(F.sum(F.pow(F.col("q"), F.lit(1 / power))).alias("_q"))
    value = _reached(flow) * F.col("_q")
    if timed:
        value = F.when(active(F.col("x") - F.col("rx"), F.col("u"), F.col("t"), F.col("start"), F.col("stop")), value).otherwise(0.0)
    out = paired(spots, released).select("log_id", "idx", *where, value.alias("v"))
    if draws is not None:
        out = out.unionByName(paired(spots, draws.select("log_id", "idx").distinct()).withColumn("v", F.lit(0.0)))
    out = returned(r, out.groupBy("log_id", "idx", *where).agg(F.sum("v").alias("total")), where)
    dealt = r.select("receptor").repartition(1 + r.count() // 100_000, "receptor")
    if not dealt.groupBy("receptor").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return out.groupBy("log_id", "idx", "receptor").agg(F.sum("total").alias("total"))
    return out.select("log_id", "idx", "receptor", "total")


def detector_prediction(totals: DataFrame, draws: DataFrame, observed: DataFrame) -> DataFrame:
    """``(receptor, mean, log_prob, median, q10, ...)`` over draws ``(log_id, idx, log_width[, w])``.

    The log probability is that of ``observed(receptor, value)`` with Gaussian noise of width exp(log_width),
    null where nothing was observed. Quantiles are of the pooled predictive points and need equal weights.
    """
    weighted = "w" in draws.columns
    rows = totals.join(draws.select("log_id", "idx", F.exp("log_width").alias("sd"), *(["w"] if weighted else [])), ["log_id", "idx"])
    w = F.col("w") if weighted else F.lit(1.0)
    out = predict_mean(rows, ["receptor"], F.col("total"), w)
    seen = rows.join(observed.where("value is not null").select("receptor", "value"), "receptor")
    log_prob = log_phi((F.col("value") - F.col("total")) / F.col("sd")) - F.log("sd")
    out = out.join(predict_log_prob(seen, ["receptor"], log_prob, w), "receptor", "left")
    return out if weighted else out.join(pooled_quantiles(rows, ["receptor"], F.col("total"), F.col("sd")), "receptor")


def overlap(start: Column, stop: Column, low: Column, high: Column) -> Column:
    """Share of the time cell low..high that lies within start..stop."""
    missed = F.greatest(start - low, F.lit(0.0)) + F.greatest(high - stop, F.lit(0.0))
    return F.greatest(1 - missed / (high - low), F.lit(0.0))


def intensity_grid(sources: DataFrame, weights: DataFrame, dims: dict[str, tuple[float, float, int]], times: tuple[float, int] | None = None) -> DataFrame:
    """Weighted expected intensity by cell of the ``dims`` (low, high, number) and of ``times`` (latest time, number).

    An upper edge belongs to the last cell. A source counts in a time cell by the share of the cell in which
    it is active. Cells without sources are shown.
    """
    rows = sources.join(weights, ["log_id", "idx"]).withColumn("_v", F.col("w") * F.col("q"))
    cells = sources.sparkSession.range(1).select()
    for c, (low, high, n) in dims.items():
        b = F.when(F.col(c) == high, n - 1).otherwise(F.floor(n * (F.col(c) - low) / (high - low)))
        rows = rows.where(F.col(c).between(low, high)).withColumn(f"{c}_cell", b.cast("int"))
        cells = cells.withColumn(f"{c}_cell", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    keys = [f"{c}_cell" for c in dims]
    if times:
        latest, n = times
        cell = F.col("t_cell")
        every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        rows, cells, keys = rows.withColumn("t_cell", every), cells.withColumn("t_cell", every), [*keys, "t_cell"]
        if n > 1:
            rows = rows.withColumn("_v", F.col("_v") * overlap(F.col("start"), F.col("stop"), cell * (latest / n), (cell + 1) * (latest / n)))
    total = weights.agg(F.sum("w").alias("_t"))
    sums = rows.groupBy(*keys).agg(F.sum("_v").alias("_s"))
    return cells.join(sums, keys, "left").crossJoin(F.broadcast(total)).select(*keys, (F.coalesce("_s", F.lit(0.0)) / F.col("_t")).alias("intensity"))


def source_quantities(sources: DataFrame, power: float = 1.0) -> DataFrame:
    """By draw: count, total and largest intensity q^(1/power), intensities in decreasing order, released amount, mean duration."""
    duration = F.col("stop") - F.col("start")
    q = F.pow(F.col("q"), F.lit(1 / power)) if power != 1 else F.col("q")
    return sources.groupBy("log_id", "idx").agg(F.count("*").alias("n"), F.sum(q).alias("total_q"), F.max(q).alias("max_q"), F.sort_array(F.collect_list(q), asc=False).alias("sorted_q"), F.sum(q * duration).alias("released"), F.avg(duration).alias("mean_duration"))
