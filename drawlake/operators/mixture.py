"""Mixture state: assignments ``(log_id, idx, case_id, comp)`` and components ``(log_id, idx, comp, target, offset, sd)``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions.numeric import array_log_sum_exp, lgamma, log_sum_exp, log_sum_exp_by, stratified_normal
from drawlake.operators.pairing import MOST_BYTES, MOST_ROWS, measured, paired

DRAW = ["log_id", "idx"]
#: Most rows of cases met with components that one task holds.
ROWS_OF_TASK = 500_000


def frequencies(assign: DataFrame) -> DataFrame:
    return assign.groupBy(*DRAW, "comp").agg(F.count("*").alias("n"))


def relabel(freq: DataFrame) -> DataFrame:
    """New numbers from 1 by decreasing frequency, ties in the old order."""
    w = Window.partitionBy(*DRAW).orderBy(F.desc("n"), "comp")
    return freq.withColumn("new_comp", F.row_number().over(w))


def relabel_rows(df: DataFrame, names: DataFrame) -> DataFrame:
    return df.join(names.select(*DRAW, "comp", "new_comp"), [*DRAW, "comp"])


def shares(names: DataFrame) -> DataFrame:
    """Share of each component and of the first n together."""
    w = Window.partitionBy(*DRAW)
    upto = w.orderBy("new_comp").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(w)
    return names.select(*DRAW, "new_comp", (F.col("n") / total).alias("share"), (F.sum("n").over(upto) / total).alias("cumulative"))


def components_needed(names: DataFrame, percent: float) -> DataFrame:
    """How many components hold all but ``percent`` of the cases."""
    return shares(names).where(F.col("cumulative") >= 1 - percent / 100 - 1e-12).groupBy(*DRAW).agg(F.min("new_comp").alias("needed"))


def case_values(assign: DataFrame, comps: DataFrame, freq: DataFrame) -> DataFrame:
    """Each case's own offset and the size of its component."""
    return assign.join(comps, [*DRAW, "comp"]).join(freq, [*DRAW, "comp"]).select(*DRAW, "case_id", "target", "offset", "n")


def weights(freq: DataFrame, concentration: float, finite: int | None = None, scaled: bool = True) -> DataFrame:
    """(n + c) / total by component; with no fixed number the new component (0) has the concentration."""
    c = (concentration / finite if scaled else concentration) if finite else 0.0
    total = F.sum("n").over(Window.partitionBy(*DRAW)) + (c * finite if finite else concentration)
    out = freq.withColumn("_t", total).select(*DRAW, "comp", ((F.col("n") + c) / F.col("_t")).alias("weight"))
    rest = freq.groupBy(*DRAW).agg(F.sum("n").alias("s"), F.count("*").alias("k"))
    if finite:
        left = rest.where(F.col("k") < finite).select(*DRAW, F.lit(0).cast("long").alias("comp"), ((finite - F.col("k")) * c / (F.col("s") + c * finite)).alias("weight"))
    else:
        left = rest.select(*DRAW, F.lit(0).cast("long").alias("comp"), (concentration / (F.col("s") + concentration)).alias("weight"))
    return out.withColumn("comp", F.col("comp").cast("long")).unionByName(left)


def log_normal(t: Column, mean: Column, sd: Column) -> Column:
    return -((t - mean) ** 2) / (2 * sd * sd) - F.log(sd) - 0.5 * math.log(2 * math.pi)


def log_logistic(t: Column, offset: Column) -> Column:
    """Log probability of a 0/1 target whose log odds are ``offset``."""
    s = F.when(t == 0, -offset).otherwise(offset)
    return F.least(s, F.lit(0.0)) - F.log1p(F.exp(-F.abs(s)))


def _target_log_density(kind: str, t: Column, offset: Column, sd: Column | None) -> Column:
    one = log_normal(t, offset, sd) if kind == "real" else log_logistic(t, offset)
    return F.when(t.isNotNull(), one).otherwise(0.0)


def _met(cases: DataFrame, right: DataFrame, cost: int = 1) -> DataFrame:
    """The rows of ``cases`` and ``right`` of equal targets; each takes ``cost`` times what a row usually does.

    Where ``right`` is broadcast, the rows of a case are dealt to one of as many partitions as keep a task's rows
    bounded, so that sums and windows by case and anything else need no shuffle of pairs.
    """
    on, (n, size) = F.col("target") == F.col("_target"), measured(right)
    if n > MOST_ROWS or size > MOST_BYTES:
        return paired(cases, right, on)
    return cases.repartition(max(1, -(-cases.count() * n * cost // ROWS_OF_TASK)), "case_id").join(F.broadcast(right), on)


def component_log_density(cases: DataFrame, comps: DataFrame, kind: str = "real") -> DataFrame:
    """log density of each case (case_id, target, t) under each component, for real or binary targets; missing targets count nothing."""
    names = [*DRAW, "comp", F.col("target").alias("_target"), "offset", *(["sd"] if kind == "real" else [])]
    rows = _met(cases, comps.select(names))
    value = _target_log_density(kind, F.col("t"), F.col("offset"), F.col("sd") if kind == "real" else None)
    return rows.groupBy("case_id", *DRAW, "comp").agg(F.sum(value).alias("log_density"))


def _student_log_density(t: Column, offset: Column, sd: Column, alpha: Column, const: Column) -> Column:
    z = (t - offset) / sd
    return const - F.log(sd) - (alpha + 1) / 2 * F.log1p(z * z / alpha)


def new_component_log_density(cases: DataFrame, hypers: DataFrame, kind: str = "real", points: int = 100) -> DataFrame:
    """log density of each case under a component that holds no case yet, as component 0.

    ``hypers(log_id, idx, target, mean, sd[, noise[, alpha]])`` give the distribution of its offsets. Each target's
    density is averaged over ``points`` fixed normal quantiles, and the averages of the targets are multiplied. The noise
    of a real target is ``noise`` itself where ``alpha`` is missing, null or 0. Otherwise its precision is a gamma
    variable of shape alpha / 2 and mean 1 / noise**2, of which the average is exact: a Student density.
    """
    varied = kind == "real" and "alpha" in hypers.columns
    if varied:
        a = F.when(F.col("alpha") > 0, F.col("alpha").cast("double"))
        # once for each row of the hyperparameters, not for each case
        hypers = hypers.withColumn("_alpha", a).withColumn("_const", lgamma((a + 1) / 2) - lgamma(a / 2) - 0.5 * F.log(math.pi * a))
    names = [*DRAW, F.col("target").alias("_target"), "mean", "sd", *(["noise"] if kind == "real" else []), *(["_alpha", "_const"] if varied else [])]
    rows = _met(cases, hypers.select(names), max(1, points // 20))

    def density(q: Column) -> Column:
        offset = F.col("mean") + F.col("sd") * q
        one = _target_log_density(kind, F.col("t"), offset, F.col("noise") if kind == "real" else None)
        if not varied:
            return one
        return F.when(F.col("_alpha").isNull() | F.col("t").isNull(), one).otherwise(_student_log_density(F.col("t"), offset, F.col("noise"), F.col("_alpha"), F.col("_const")))

    each = F.transform(F.array(*[F.lit(q) for q in stratified_normal(points)]), density)
    rows = rows.withColumn("_l", array_log_sum_exp(each) - math.log(points))
    return rows.groupBy("case_id", *DRAW).agg(F.sum("_l").alias("log_density")).withColumn("comp", F.lit(0).cast("long")).select("case_id", *DRAW, "comp", "log_density")


def responsibilities(density: DataFrame, weight: DataFrame) -> DataFrame:
    rows = density.join(weight, [*DRAW, "comp"]).withColumn("_l", F.col("log_density") + F.log("weight"))
    return _softmax(rows, "_l")


def _softmax(rows: DataFrame, value: str) -> DataFrame:
    w = Window.partitionBy(*DRAW, "case_id")
    p = F.exp(F.col(value) - F.max(value).over(w))
    return rows.withColumn("_p", p).select("case_id", *DRAW, "comp", (F.col("_p") / F.sum("_p").over(w)).alias("p"))


def left_out_responsibilities(density: DataFrame, freq: DataFrame, assign: DataFrame, share: float = 0.0) -> DataFrame:
    """Responsibilities in proportion to (n + share) * density, each case's own component counted without it.

    ``share`` is the concentration that one component has. A case that is alone in its component stays there
    only if ``share`` is positive.
    """
    own = assign.select(*DRAW, "case_id", F.col("comp").alias("_own"))
    n, draws = freq.agg(F.count("*"), F.count_distinct(*DRAW)).first()
    parts = max(1, -(-own.count() * n // (max(1, draws) * ROWS_OF_TASK)))
    dealt = lambda df: df.repartition(parts, *DRAW, "case_id")
    rows = dealt(density.join(freq, [*DRAW, "comp"])).hint("merge").join(dealt(own), [*DRAW, "case_id"])
    n = F.col("n") - F.when(F.col("comp") == F.col("_own"), 1).otherwise(0) + share
    return _softmax(rows.where(n > 0).withColumn("_l", F.log(n) + F.col("log_density")), "_l")


def mixture_log_prob(density: DataFrame, weight: DataFrame, draw_weight: DataFrame | None = None, new: DataFrame | None = None) -> DataFrame:
    """Predictive log probability of each case: components within draws, then the weighted mean over draws, in one sum.

    ``draw_weight(log_id, idx, w)`` weighs draws, which count alike without it. Where a new component (0) has positive
    weight, ``new`` has to be its density (see ``new_component_log_density``); otherwise this is an error.
    """
    if new is None and not weight.where("comp = 0 and weight > 0").isEmpty():
        raise ValueError("the new component has weight but no density")
    density = density if new is None else density.unionByName(new)
    draws = weight.select(*DRAW).distinct() if draw_weight is None else draw_weight
    draws = draws.select(*DRAW, (F.lit(1.0) if draw_weight is None else F.col("w")).alias("_w"))
    total = draws.agg(F.sum("_w").alias("_t"))
    rows = density.join(weight, [*DRAW, "comp"]).join(draws, DRAW).where("weight > 0 and _w > 0")
    out = log_sum_exp_by(rows, ["case_id"], F.col("log_density") + F.log("weight") + F.log("_w"), "_l")
    return out.crossJoin(F.broadcast(total)).select("case_id", (F.col("_l") - F.log("_t")).alias("log_prob"))


def component_stats(assign: DataFrame, cases: DataFrame, prior_mean: float, prior_sd: float, noise: float) -> DataFrame:
    """Counts, means and the conditional mean and variance of each component's offset given the noise."""
    s = assign.join(cases, "case_id").groupBy(*DRAW, "comp", "target").agg(F.count("t").alias("n"), F.sum("t").alias("s"), F.sum(F.col("t") ** 2).alias("s2"))
    precision = 1 / prior_sd**2 + F.col("n") / noise**2
    return s.select(*DRAW, "comp", "target", "n", (F.col("s") / F.col("n")).alias("mean"), ((prior_mean / prior_sd**2 + F.col("s") / noise**2) / precision).alias("offset_mean"), (1 / precision).alias("offset_variance"))


def pooled_noise(assign: DataFrame, cases: DataFrame, comps: DataFrame, shape: float, width: float) -> DataFrame:
    """By draw, over all targets and cases: number and sum of squared residuals about the components' offsets, and the
    shape and mean of the noise precision's conditional gamma under a prior of this shape and width."""
    rows = assign.join(cases, "case_id").join(comps.select(*DRAW, "comp", "target", "offset"), [*DRAW, "comp", "target"])
    s = rows.where("t is not null").groupBy(*DRAW).agg(F.count("*").alias("n"), F.sum((F.col("t") - F.col("offset")) ** 2).alias("squares"))
    return s.select(*DRAW, "n", "squares", (shape + F.col("n")).alias("shape"), ((shape + F.col("n")) / (shape * width**2 + F.col("squares"))).alias("precision"))


def bernoulli_mixture_log_prob(cases: DataFrame, bits: list[str], table: list[tuple[float, list[float]]]) -> DataFrame:
    """log probability of 0/1 rows under a known mixture of product Bernoulli distributions."""
    parts = []
    for w, ps in table:
        total = F.lit(math.log(w))
        for b, p in zip(bits, ps):
            total = total + F.when(F.col(b) == 1, math.log(p)).otherwise(math.log(1 - p))
        parts.append(total)
    return cases.withColumn("log_prob", log_sum_exp(*parts))
