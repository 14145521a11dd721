"""Many draws evaluated on many cases, and their reduction to predictions and scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions.numeric import HALF_LOG_2PI, log_sum_exp_by, stratified_normal
from drawlake.operators.network import Network
from drawlake.operators.pairing import paired
from drawlake.operators.selection import SALTS, selected
from drawlake.sources.tables import written

#: Most draws that are broadcast at once.
MOST_DRAWS = 10_000
#: Most draws of a case that meet in one row for quantiles.
MOST_GATHERED = 1024


def cross(cases: DataFrame, draws: DataFrame) -> DataFrame:
    """Every draw on every case. Few draws are broadcast and cases not shuffled; more come in blocks of ``MOST_DRAWS``."""
    return paired(cases, draws, most=MOST_DRAWS)


def weight(draws: DataFrame) -> DataFrame:
    """Add ``w`` = exp(log_weight - max)."""
    top = draws.agg(F.max("log_weight").alias("_top"))
    return draws.crossJoin(F.broadcast(top)).withColumn("w", F.exp(F.col("log_weight") - F.col("_top"))).drop("_top")


def predict_mean(rows: DataFrame, keys: list[str], value: Column, w: Column) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(w * value) / F.sum(w)).alias("mean"))


def predict_log_prob(rows: DataFrame, keys: list[str], log_prob: Column, w: Column) -> DataFrame:
    """log of the weighted mean likelihood."""
    out = log_sum_exp_by(rows, keys, log_prob + F.log(w), "_l", _w=w)
    return out.select(*keys, (F.col("_l") - F.log("_w")).alias("log_prob"))


def predict_mode(means: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """The class with the largest mean probability, the lowest of equals."""
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("p"), F.lit(-i).alias("k")) for i, c in enumerate(classes)]))
    return means.select(*keys, *classes, (-best["k"]).alias("mode"))


def binary_mode(p: Column, target: Column | None = None) -> dict[str, Column]:
    """The guess 1 if the mean probability exceeds 0.5, else 0; with a target also whether it is wrong."""
    guess = (p > 0.5).cast("int")
    return {"mode": guess} if target is None else {"mode": guess, "wrong": (guess != target).cast("int")}


def class_scores(means: list[Column], target: Column) -> dict[str, Column]:
    """Of each case: whether the class of largest mean probability (the lowest of equals) is wrong, its squared error
    against the 0/1 vector, and the log probability of the target."""
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-i).alias("k")) for i, p in enumerate(means)]))
    squared = sum(((p - (target == i).cast("double")) ** 2 for i, p in enumerate(means)), F.lit(0.0))
    return {"wrong": (-best["k"] != target).cast("double"), "squared": squared, "log_prob": F.log(F.get(F.array(*means), target.cast("int")))}


def pooled_quantiles(rows: DataFrame, keys: list[str], mean: Column, sd: Column, points: int = 101, shares: tuple[float, ...] = (0.1, 0.01), w: Column | None = None, gathered: int = MOST_GATHERED) -> DataFrame:
    """Median and lower/upper quantiles of the pooled predictive points, ``points`` normal quantiles per draw.

    For even n the median is the mean of the two in the middle; a quantile is sorted[int(0.5 + f n)] and its mirror.
    Two numbers per draw and case are written once. If no case has more than ``gathered`` draws, these meet by case and the
    points are formed and sorted in Arrow batches; else the places are found by counts (``selection.selected``), and
    no case's draws meet. Both give the same values. Points of null or NaN
    means or deviations stand above all numbers; a place that falls on one is null.
    Weighted draws are refused: with ``w`` given, weights that differ are an error.
    """
    if w is not None:
        ends = rows.agg(F.min(w).alias("a"), F.max(w).alias("b")).first()
        if ends["a"] != ends["b"]:
            raise ValueError("quantiles of weighted draws are not defined")
    z = np.array(stratified_normal(points))
    names = ["median", *(n for f in shares for n in (f"q{round(f * 100):02d}", f"q{round(100 - f * 100)}"))]
    pool = written(rows.select(*keys, mean.cast("double").alias("_m"), sd.cast("double").alias("_s")), "pool")
    counts = pool.groupBy(*keys).agg((F.count("*") * points).alias("_n"))
    if (counts.agg(F.max("_n")).first()[0] or 0) > gathered * points:
        return _selected_quantiles(pool, counts, keys, z, shares, names)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def quantiles(mean: pd.Series, sd: pd.Series) -> pd.DataFrame:
        out = np.full((len(mean), len(names)), np.nan)
        for i, (m, s) in enumerate(zip(mean, sd)):
            v = (np.asarray(m, np.float64)[:, None] + np.asarray(s, np.float64)[:, None] * z).ravel()
            n = len(v)
            at = [n // 2, (n - 1) // 2]
            for f in shares:
                low = int(0.5 + f * n)
                at += [low, n - 1 - low]
            v = np.partition(v, sorted({*at}))[at]
            out[i] = [(v[0] + v[1]) / 2, *v[2:]]
        return pd.DataFrame(out, columns=names)

    met = pool.groupBy(*keys).agg(F.collect_list(F.struct("_m", "_s")).alias("_v"))
    return met.select(*keys, quantiles("_v._m", "_v._s").alias("_q")).select(*keys, "_q.*")


def _selected_quantiles(pool: DataFrame, counts: DataFrame, keys: list[str], z: np.ndarray, shares: tuple[float, ...], names: list[str]) -> DataFrame:
    n = F.col("_n")
    low = [F.floor(0.5 + f * n) for f in shares]
    places = [F.floor(n / 2), F.floor((n - 1) / 2), *(p for x in low for p in (x, n - 1 - x))]
    wanted = counts.select(*keys, F.posexplode(F.array(*places)).alias("_p", "_rank"))
    pool = pool.withColumn("_salt", F.pmod(F.col("_metadata.row_index"), F.lit(SALTS)).cast("int"))
    found = selected(pool, keys, z, wanted)
    at = lambda i: F.max(F.when(F.col("_p") == i, F.col("value")))
    middle = F.nullif((at(0) + at(1)) / 2, F.lit(float("nan")))
    return found.groupBy(*keys).agg(middle.alias(names[0]), *[at(i).alias(name) for i, name in enumerate(names[1:], 2)])


def mean_of_medians(rows: DataFrame, keys: list[str], median: Column, w: Column) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(w * median) / F.sum(w)).alias("mean_of_medians"))


def score(df: DataFrame, columns: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Average and standard error sqrt((E[x^2] - E[x]^2) / (N - 1)) of each column, of all rows or by target."""
    out = []
    for name, x in columns.items():
        out += [F.avg(x).alias(name), F.sqrt(F.greatest(F.avg(x * x) - F.avg(x) ** 2, F.lit(0.0)) / (F.count(x) - 1)).alias(f"{name}_se")]
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *out)


def target_scores(rows: DataFrame, error: Column, case: str = "case_id", target: str = "j") -> DataFrame:
    """Average squared and absolute errors with standard errors, for each target and (null target) summed over a case's targets."""
    errors = rows.select(case, target, (error * error).alias("squared"), F.abs(error).alias("absolute"))
    columns = {"squared": F.col("squared"), "absolute": F.col("absolute")}
    sums = errors.groupBy(case).agg(F.sum("squared").alias("squared"), F.sum("absolute").alias("absolute"))
    total = score(sums, columns).withColumn(target, F.lit(None).cast(rows.schema[target].dataType))
    return score(errors, columns, [target]).unionByName(total)


def expected_class_losses(p: Column) -> dict[str, Column]:
    """Expected error and entropy of a case, from the array of its class probabilities."""
    entropy = F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return {"class_error": 1 - F.array_max(p), "entropy": entropy}


def expected_binary_scores(p: Column) -> dict[str, Column]:
    """Expected log probability, error and squared error if the model is right."""
    log0 = F.when(p < 1, (1 - p) * F.log(1 - p)).otherwise(0.0)
    log1 = F.when(p > 0, p * F.log(p)).otherwise(0.0)
    return {"log_prob": log0 + log1, "wrong": F.when(p > 0.5, 1 - p).otherwise(p), "squared": p * (1 - p)}


def raw_scale(mean: Column, variance: Column, spec: tuple[bool, float, float]) -> Column:
    """Mean on the original scale; a logged target gains exp(variance / (2 scale^2))."""
    log, shift, scale = spec
    out = mean / scale - shift
    return F.exp(out + variance / (2 * scale * scale)) if log else out


def raw_log_prob(log_prob: Column, raw: Column, spec: tuple[bool, float, float]) -> Column:
    log, _, scale = spec
    out = log_prob + F.log(F.lit(float(scale)))
    return out - F.log(raw) if log else out


#: Most bytes of packed draws that are broadcast at once.
BLOCK_BYTES = 64 << 20


def draw_blocks(draws: list[tuple[str, int, dict]]) -> list[list[tuple[str, int, dict]]]:
    """``draws`` cut so that the arrays of a block have at most ``BLOCK_BYTES`` (or belong to one draw)."""
    out, held = [[]], 0
    for draw in draws:
        size = sum(np.asarray(x).nbytes for v in draw[2].values() if v is not None for x in (v if isinstance(v, list) else [v]) if x is not None)
        if out[-1] and held + size > BLOCK_BYTES:
            out.append([])
            held = 0
        out[-1].append(draw)
        held += size
    return out


def _each_block(cases: DataFrame, draws: list[tuple[str, int, dict]], make, schema: str) -> DataFrame:
    """The results of ``make(broadcast draws)`` over all blocks; cases are read once for each."""
    parts = [cases.mapInPandas(make(cases.sparkSession.sparkContext.broadcast(block)), schema) for block in draw_blocks(draws)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def net_forward(cases: DataFrame, key: str, inputs: list[str], draws: list[tuple[str, int, dict]], network: Network, keep: list[str] | None = None) -> DataFrame:
    """``(key, log_id, idx, j, o)`` and the inputs in ``keep``: outputs of every draw on every case, cases in Arrow batches, draws packed once."""
    kept = keep or []

    def make(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = batch[inputs].to_numpy(np.float64)
                for log_id, idx, draw in shared.value:
                    o = network.output(x, draw)
                    n, k = o.shape
                    yield pd.DataFrame({**{c: np.repeat(batch[c].to_numpy(), k) for c in (key, *kept)}, "log_id": log_id, "idx": idx, "j": np.tile(np.arange(k), n), "o": o.ravel()})

        return run

    kinds = "".join(f"{c} double, " for c in kept)
    read = cases.select(key, *[F.col(c).cast("double") for c in inputs])
    return _each_block(read, draws, make, f"{key} long, {kinds}log_id string, idx long, j int, o double")


def net_predict(cases: DataFrame, key: str, inputs: list[str], draws: list[tuple[str, int, dict]], network: Network, log_weight: list[float] | None = None, targets: list[str] | None = None, noise: list[float] | None = None) -> DataFrame:
    """``(key, j, mean[, log_prob])``: weighted mean outputs of all draws, and the log of the weighted mean density of the targets.

    ``log_weight`` and ``noise`` (the standard deviation of normal targets) have a number for each draw; draws count
    alike without weights. A task keeps, for each case and output of a batch, the sum of weights, of weighted outputs, and of weighted
    densities with their largest exponent; so a row for each case, output and block of draws leaves it, never one for
    each draw. Blocks merge by key. A case with a null target has a mean, and a log probability of 0.
    """
    weights = np.zeros(len(draws)) if log_weight is None else np.asarray(log_weight, np.float64)
    weights = weights - weights.max(initial=-np.inf) if len(draws) else weights
    packed = [(log_id, idx, {**draw, "_w": np.array([w]), "_sd": np.array([s])}) for (log_id, idx, draw), w, s in zip(draws, weights, noise or [1.0] * len(draws))]

    def make(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = batch[inputs].to_numpy(np.float64)
                t = batch[targets].to_numpy(np.float64) if targets else None
                mass, total, top, held = 0.0, 0.0, -np.inf, 0.0
                for _, _, draw in shared.value:
                    o, lw = network.output(x, draw), draw["_w"][0]
                    mass, total = mass + np.exp(lw), total + np.exp(lw) * o
                    if targets:
                        z = np.clip((t - o) / draw["_sd"][0], -1e10, 1e10)
                        one = np.where(np.isnan(t), lw, lw - z * z / 2 - np.log(draw["_sd"][0]) - HALF_LOG_2PI)
                        new = np.maximum(top, one)
                        top, held = new, held * np.exp(np.where(np.isneginf(top), 0.0, top - new)) + np.exp(one - new)
                n, k = total.shape
                state = {key: np.repeat(batch[key].to_numpy(), k), "j": np.tile(np.arange(k), n), "mass": mass, "total": total.ravel()}
                yield pd.DataFrame(state | ({"part": (top + np.log(held)).ravel()} if targets else {"part": 0.0}))

        return run

    read = cases.select(key, *[F.col(c).cast("double") for c in (*inputs, *(targets or []))])
    parts = _each_block(read, packed, make, f"{key} long, j int, mass double, total double, part double")
    sums = log_sum_exp_by(parts, [key, "j"], F.col("part"), "_l", mass=F.col("mass"), total=F.col("total"))
    mean = (F.col("total") / F.col("mass")).alias("mean")
    return sums.select(key, "j", mean, *([(F.col("_l") - F.log("mass")).alias("log_prob")] if targets else []))


def hidden_spread(cases: DataFrame, inputs: list[str], draws: list[tuple[str, int, dict]], network: Network) -> DataFrame:
    """Population standard deviation over cases of each unit: partial sums per batch, then one small aggregate."""

    def make(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = batch[inputs].to_numpy(np.float64)
                for log_id, idx, draw in shared.value:
                    for layer, h in enumerate(network.hidden(x, draw)):
                        yield pd.DataFrame({"log_id": log_id, "idx": idx, "layer": layer, "unit": np.arange(h.shape[1]), "n": len(h), "s": h.sum(0), "s2": (h * h).sum(0)})

        return run

    parts = _each_block(cases.select(*inputs), draws, make, "log_id string, idx long, layer int, unit int, n long, s double, s2 double")
    mean = F.sum("s") / F.sum("n")
    return parts.groupBy("log_id", "idx", "layer", "unit").agg(F.sqrt(F.greatest(F.sum("s2") / F.sum("n") - mean * mean, F.lit(0.0))).alias("sd"))


def hidden_spread_scalar(spread: DataFrame) -> DataFrame:
    """One number for each layer of ``hidden_spread``: the root of the summed variances of its units, over their number."""
    return spread.groupBy("log_id", "idx", "layer").agg((F.sqrt(F.sum(F.col("sd") ** 2)) / F.count("*")).alias("spread"))


def difference_variance(points: DataFrame, inputs: list[str], moved: str, widths: list[float], draws: list[tuple[str, int, dict]], network: Network) -> DataFrame:
    """Mean squared change of the outputs between ``moved`` - w/2 and + w/2, by draw and width."""
    at = inputs.index(moved)

    def make(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = batch[inputs].to_numpy(np.float64)
                for log_id, idx, draw in shared.value:
                    for width in widths:
                        step = np.zeros(len(inputs))
                        step[at] = width / 2
                        d = network.output(x + step, draw) - network.output(x - step, draw)
                        yield pd.DataFrame({"log_id": [log_id], "idx": [idx], "width": [width], "n": [d.size], "s": [float((d * d).sum())]})

        return run

    parts = _each_block(points.select(*inputs), draws, make, "log_id string, idx long, width double, n long, s double")
    return parts.groupBy("log_id", "idx", "width").agg((F.sum("s") / F.sum("n")).alias("mean_square"))


def parameter_rms(draws: DataFrame, keys: list[str], group: Column, value: Column) -> DataFrame:
    return draws.groupBy(*keys, group.alias("group")).agg(F.sqrt(F.avg(value * value)).alias("rms"))


def gradient_fit(cases: DataFrame, inputs: list[str], target: str, steps: int = 5, step: float = 0.5, prior: float = 0.0) -> list[tuple[int, float, list[float]]]:
    """Full-batch gradient descent of a linear regression: per step one pass of partial gradients over the cases.

    Steps are divided by N + 1. Returns (step, mean squared error before it, weights with the bias last).
    """
    cases = cases.select(*inputs, target).persist()  # one read serves all steps
    n = cases.count()
    w = np.zeros(len(inputs) + 1)
    trace = []
    for t in range(steps):
        o = sum((F.col(c) * float(w[i]) for i, c in enumerate(inputs)), F.lit(float(w[-1])))
        e = o - F.col(target)
        row = cases.agg(F.avg(e * e).alias("loss"), *[F.sum(e * F.col(c)).alias(f"g{i}") for i, c in enumerate(inputs)], F.sum(e).alias("gb")).first()
        trace.append((t, row["loss"], w.tolist()))
        g = np.array([*(row[f"g{i}"] for i in range(len(inputs))), row["gb"]]) + prior * w
        w = w - step / (n + 1) * g
    cases.unpersist()
    return trace


def class_from_joint(rows: DataFrame, keys: list[str], label: str, log_density: str) -> DataFrame:
    """Class probabilities from joint log densities with each class filled in."""
    w = Window.partitionBy(*keys)
    p = F.exp(F.col(log_density) - F.max(log_density).over(w))
    return rows.withColumn("_p", p).withColumn("p", F.col("_p") / F.sum("_p").over(w)).select(*keys, label, "p")
