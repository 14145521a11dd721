"""Selecting, copying and comparing draws: rows keyed by log_id and idx."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.operators.ordered import grouped_number
from drawlake.sources.tables import numbered

#: Indexes in one range of an as-of join.
RANGE = 65_536


def parse_range(text: str) -> tuple[int, int | None, int, int | None]:
    """``low:high%mod`` or ``low:high+num`` as (low, high, mod, num); low is 1 if left out, a single number stands alone."""
    m = re.fullmatch(r"(-?\d+)?(:(-?\d+)?)?(?:%(\d+)|\+(\d+))?", text)
    if not m:
        raise ValueError(f"bad range {text}")
    low = int(m[1]) if m[1] else 1
    high = int(m[3]) if m[3] else (None if m[2] or not m[1] else low)
    return low, high, int(m[4] or 1), int(m[5]) if m[5] else None


def select_range(df: DataFrame, text: str, anchor: str = "zero", index: str = "idx") -> DataFrame:
    """Rows of an index range; the modulus counts from zero, or from low with ``anchor='low'``."""
    low, high, mod, _ = parse_range(text)
    i = F.col(index)
    df = df.where(i >= low) if high is None else df.where(i.between(low, high))
    return df.where((i if anchor == "zero" else i - low) % mod == 0) if mod > 1 else df


def select_evenly(df: DataFrame, low: int, high: int, num: int, log: str = "log_id") -> DataFrame:
    """The first index at or after each of ``num`` evenly spaced targets, per log.

    The last target at or before an index is found by arithmetic, however many targets there are.
    """
    num = min(num, high - low + 1)
    step = (high - low) / max(num - 1, 1)
    target = lambda i: (low + i * step + 0.5).cast("long")
    near = F.floor((F.col("idx") - low) / step) if step else F.lit(0)
    tries = [near + k for k in (-1, 0, 1)]
    at = F.greatest(*[F.when((i >= 0) & (i < num) & (target(i) <= F.col("idx")), i) for i in tries])
    cells = df.where(F.col("idx").between(low, high)).withColumn("_t", target(at.cast("double")))
    chosen = cells.groupBy(log, "_t").agg(F.min("idx").alias("idx")).drop("_t").distinct()
    return df.join(chosen, [log, "idx"], "left_semi")


def select_time(df: DataFrame, lo: float, hi: float, time: str = "time_ms", log: str = "log_id") -> DataFrame:
    """Draws from the first whose cpu time reaches lo minutes to the last within hi minutes."""
    t = F.col(time) / 60000.0
    ends = df.groupBy(log).agg(F.min(F.when(t >= lo, F.col("idx"))).alias("_a"), F.max(F.when(t <= hi, F.col("idx"))).alias("_b"))
    return df.join(ends, log).where(F.col("idx").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def union_logs(*logs: tuple[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in logs:
        df = df.withColumn("log_id", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def at_temperature(df: DataFrame, inv_temp: float = 1.0, also_highest: bool = False) -> DataFrame:
    """Draws at an inverse temperature (and at the smallest one present), renumbered from 1 within each log."""
    keep = F.col("inv_temp") == inv_temp
    if also_highest:
        low = df.groupBy("log_id").agg(F.min("inv_temp").alias("_low"))
        df = df.join(low, "log_id")
        keep = keep | (F.col("inv_temp") == F.col("_low"))
    return grouped_number(df.where(keep).drop("_low"), "log_id", "idx", "new_idx")


def state_as_of(records: DataFrame, index: int) -> DataFrame:
    """The latest record of each type at or before ``index``."""
    rest = [c for c in records.columns if c not in ("log_id", "type")]
    return records.where(F.col("idx") <= index).groupBy("log_id", "type").agg(F.max_by(F.struct(*rest), "idx").alias("_r")).select("log_id", "type", "_r.*")


def states_as_of(records: DataFrame, indexes: DataFrame) -> DataFrame:
    """``(log_id, at, type, ...)``: for each index ``at`` of ``indexes(log_id, at)``, the latest record of each type at or before it.

    An as-of join: indexes, once for each type of their log, stand among the records in ranges of ``RANGE`` indexes, and take
    the last record of their range; where it holds none yet, the last one of the ranges before, of which each
    log and type keeps one row a range. So a log of any length spreads over its ranges, and records shuffle once.
    Repeated indexes count once; of records of equal index and type the one with the largest further columns counts;
    rows with null log, type or index take no part, and types without a record up to ``at`` give no row.
    """
    rest = [c for c in records.columns if c not in ("log_id", "type")]
    kept = records.where("log_id is not null and type is not null and idx is not null")
    one = F.struct("idx", *[c for c in rest if c != "idx"])
    kind = kept.select(one.alias("_r")).schema["_r"].dataType
    types = kept.select("log_id", "type").distinct()
    asked = indexes.select("log_id", "at").where("at is not null").distinct().join(types, "log_id")
    both = kept.select("log_id", "type", F.col("idx").alias("at"), one.alias("_r")).unionByName(asked.withColumn("_r", F.lit(None).cast(kind)))
    both = both.withColumn("_range", F.floor(F.col("at") / RANGE))
    ranges = ["log_id", "type", "_range"]
    upto = Window.partitionBy(*ranges).orderBy("at", F.col("_r").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("log_id", "type").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*ranges).agg(F.max("_r").alias("_r")).select(*ranges, F.max("_r").over(before).alias("_old"))
    own = both.withColumn("_own", F.last("_r", ignorenulls=True).over(upto)).where("_r is null").join(carried, ranges)
    out = own.withColumn("_r", F.coalesce("_own", "_old")).where("_r is not null")
    return out.select("log_id", "at", "type", *[F.col(f"_r.{c}").alias(c) for c in rest])


def reweight(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Add ``extra(log_id, idx, add)`` to the log weights."""
    return df.join(extra, ["log_id", "idx"]).withColumn("log_weight", F.col("log_weight") + F.col("add")).drop("add")


def require_complete(df: DataFrame, *needed: DataFrame) -> DataFrame:
    """Draws that all the needed tables have."""
    for other in needed:
        df = df.join(other, ["log_id", "idx"], "left_semi")
    return df


def incomplete_counts(df: DataFrame, *needed: DataFrame) -> DataFrame:
    """``(log_id, kept, dropped)``: how many draws ``require_complete`` keeps and drops, by log."""
    full = require_complete(df.select("log_id", "idx").distinct(), *needed).withColumn("_has", F.lit(1))
    both = df.select("log_id", "idx").distinct().join(full, ["log_id", "idx"], "left")
    return both.groupBy("log_id").agg(F.count("_has").alias("kept"), (F.count("*") - F.count("_has")).alias("dropped"))


def _order(indexes: DataFrame) -> DataFrame:
    """``(idx, new)``: distinct indexes numbered from 1, by a range sort and partition sizes."""
    return numbered(indexes.select("idx").distinct().orderBy("idx"), "new")


def append_draws(target: DataFrame, source: DataFrame, chosen: str | None = None, at_last: bool = False) -> DataFrame:
    """``target`` with the source draws in the range ``chosen`` after its last index, numbered on in their order.

    With ``at_last`` numbering starts at the last index itself, which so gets further records.
    """
    source = source if chosen is None else select_range(source, chosen)
    last = target.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("last"))
    moved = source.join(_order(source), "idx").crossJoin(F.broadcast(last))
    moved = moved.withColumn("idx", F.col("last") + F.col("new") - (1 if at_last else 0)).select(*target.columns)
    return target.unionByName(moved)


def copy_draws(source: DataFrame, low: int, step: int, ignore: tuple[str, ...] = (), chosen: str | None = None) -> DataFrame:
    """Draws in the range ``chosen``, renumbered low, low + step, ...; records of ignored types go, those at negative
    index stay as they are."""
    kept = source.where(~F.col("type").isin(*ignore)) if ignore else source
    if chosen is not None:
        kept = kept.where("idx < 0").unionByName(select_range(kept.where("idx >= 0"), chosen))
    numbers = _order(kept.where("idx >= 0")).withColumn("new", low + step * (F.col("new") - 1))
    return kept.join(numbers, "idx", "left").withColumn("idx", F.coalesce(F.col("new").cast("long"), F.col("idx"))).select(*source.columns)


def list_records(records: DataFrame) -> DataFrame:
    return records.groupBy("log_id", "idx").agg(F.array_sort(F.collect_list(F.struct("type", "size"))).alias("records"))


def last_index(records: DataFrame) -> DataFrame:
    return records.groupBy("log_id").agg(F.max("idx").alias("last"))


def differing_records(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Types whose payloads differ or that only one side has; draws are equal if no row comes back."""
    a, b = (x.where(~F.col("type").isin(*ignore)) if ignore else x for x in (a, b))
    both = a.select("type", F.col("payload").alias("p"), F.lit(True).alias("l")).join(b.select("type", F.col("payload").alias("q"), F.lit(True).alias("r")), "type", "full")
    return both.where(F.col("l").isNull() | F.col("r").isNull() | ~F.col("p").eqNullSafe(F.col("q"))).select("type")


def run_quantity(letter: str, columns: dict[str, Column], n: int | None = None) -> Column:
    """One quantity of iteration records by its letter and modifier.

    r: share of proposals rejected; e: slice evaluations per call; k: minutes of cpu time. Q: weight, Q0: log weight,
    Qn: log weight, at least -n. D: delta, at most n (1000 if left out). C0: proposals accepted in a row;
    C1: rejected in a row, Cn: the same passed through n^2 c (1 - exp(-0.6 c - c^2)) with c its n-th part.
    """
    c = columns
    if letter == "r":
        return F.when(c["proposals"] > 0, c["rejects"] / c["proposals"])
    if letter == "e":
        return F.when(c["slice_calls"] > 0, c["slice_evals"] / c["slice_calls"])
    if letter == "k":
        return c["time_ms"] / 60000.0
    if letter == "Q":
        w = c["log_weight"]
        return F.exp(w) if n is None else w if n == 0 else F.greatest(w, F.lit(-float(n)))
    if letter == "D":
        return F.least(c["delta"], F.lit(1000.0 if n is None else float(n)))
    if letter == "C":
        run = c["consecutive_accepts"]
        if n == 0:
            return F.greatest(run, F.lit(0)).cast("double")
        back = F.greatest(-run, F.lit(0)).cast("double")
        part = back / (n or 1)
        return n * n * part * (1 - F.exp(-0.6 * part - part * part)) if n and n > 1 else back
    raise ValueError(f"no quantity {letter}")


def temperature_quantities(df: DataFrame, schedule: DataFrame) -> DataFrame:
    """Add ``temp_index`` (place in the schedule, null if it has no such temperature) and ``upper_end`` (the larger of that
    and the place next in the direction ``temp_dir``) to draws with ``inv_temp`` and ``temp_dir``."""
    out = df.join(schedule.select("temp_index", "inv_temp"), "inv_temp", "left")
    return out.withColumn("upper_end", F.greatest(F.col("temp_index"), F.col("temp_index") + F.col("temp_dir")))
