"""Joins between intervals and points of one key. The key is always part of the join, so no plan is a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _renamed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys))


def binned(df: DataFrame, t0: Column, t1: Column, width: float) -> DataFrame:
    """Each row once for each bin of ``width`` that its interval touches, as _bin, with its first bin as _bin0.

    An interval without an end, or one that ends before it starts, touches none and stays once, with null bins.
    """
    lo, hi = F.floor(t0 / F.lit(float(width))), F.floor(t1 / F.lit(float(width)))
    some = t1 >= t0
    return df.withColumn("_bin0", F.when(some, lo)).withColumn("_bin", F.explode(F.when(some, F.sequence(lo, hi)).otherwise(F.array(F.lit(None).cast("long")))))


def mean_length(*sides: DataFrame, t0: str = "t0", t1: str = "t1", slack: float = 0.0) -> float:
    """A bin width for intervals: twice their mean length, so that they touch two bins at most on average; one small job a side."""
    found = [d.agg(F.avg(F.col(t1) - F.col(t0))).first()[0] for d in sides]
    return max(2 * max((x for x in found if x), default=0.0) + 2 * slack, 1e-9)


def _pairs(a: DataFrame, b: DataFrame, keys: list[str], width: float, how: str, slack: float = 0.0) -> DataFrame:
    """a by bins joined with b by bins, a pair at its first common bin only; b's keys are named _k_."""
    left = binned(a, F.col("t0") - slack, F.col("t1") + slack, width)
    r = binned(_renamed(b, keys, "b_").withColumnsRenamed({k: f"_k_{k}" for k in keys}), F.col("b_t0"), F.col("b_t1"), width)
    r = r.withColumnsRenamed({"_bin": "_b_bin", "_bin0": "_b_bin0"})
    on = (left["_bin"] == r["_b_bin"]) & (F.greatest("_bin0", "_b_bin0") == F.col("_bin")) & (r["b_t1"] >= left["t0"] - slack) & (r["b_t0"] <= left["t1"] + slack)
    for k in keys:
        on = on & (left[k] == r[f"_k_{k}"])
    return left.join(r, on, how)


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", slack: float = 0.0, width: float | None = None) -> DataFrame:
    """Pairs of closed intervals [t0, t1] of one key that share a point; b's columns get the prefix b_. how: inner, left, left_semi, left_anti.

    Intervals meet in bins of ``width`` (by default from their mean length), so a key's intervals are not all paired. For
    the outer, semi and anti join an interval's bins are looked at together again: repeated rows stay as often as they came.
    """
    w = mean_length(a, b, slack=slack) if width is None else width
    gone = ["_bin", "_bin0", "_b_bin", "_b_bin0", *(f"_k_{k}" for k in keys)]
    if how == "inner":
        return _pairs(a, b, keys, w, "inner", slack).drop(*gone)
    row = Window.partitionBy(*(F.col(f"`{c}`") for c in a.columns))
    if how == "left_semi":
        met = _pairs(a, b, keys, w, "left_semi", slack)
        return met.withColumn("_least", F.min("_bin").over(row)).where(F.col("_bin") == F.col("_least")).select(*a.columns)
    every = _pairs(a, b, keys, w, "left", slack).withColumn("_hits", F.count("_b_bin").over(row))
    alone = (F.col("_hits") == 0) & F.col("_bin").eqNullSafe(F.col("_bin0"))
    if how == "left_anti":
        return every.where(alone).select(*a.columns)
    if how != "left":
        raise ValueError(f"no {how} join of intervals")
    return every.where(F.col("_b_bin").isNotNull() | alone).drop("_hits", *gone)


def best_overlap(a: DataFrame, b: DataFrame, keys: list[str], a_id: list[str], b_pos: str, width: float | None = None) -> DataFrame:
    """Each row of a with the row of b of greatest positive overlap, the earliest ``b_pos`` of equals; null if none."""
    w = mean_length(a, b) if width is None else width
    pairs = _pairs(a, b, keys, w, "left").drop("_bin", "_bin0", "_b_bin", "_b_bin0", *(f"_k_{k}" for k in keys))
    overlap = F.least("t1", "b_t1") - F.greatest("t0", "b_t0")
    scored = pairs.withColumn("overlap", F.when(F.col("b_t0").isNotNull() & (overlap > 0), overlap))
    order = Window.partitionBy(*keys, *a_id).orderBy(F.col("overlap").desc_nulls_last(), f"b_{b_pos}")
    best = scored.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    gone = [F.when(F.col("overlap").isNotNull(), F.col(c)).alias(c) for c in best.columns if c.startswith("b_")]
    return best.select(*(c for c in best.columns if not c.startswith("b_")), *gone)


def argmin_join(a: DataFrame, b: DataFrame, keys: list[str], a_id: list[str], on: Column, order: list[Column]) -> DataFrame:
    """Each row of a with the first row of b, by ``order``, among those that ``on`` allows."""
    r = b.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    cond = on
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    w = Window.partitionBy(*keys, *a_id).orderBy(*order)
    return a.join(r, cond, "left").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", *(f"_k_{k}" for k in keys))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str, tie: str, out: str | None = None) -> DataFrame:
    """The last value of right at or before each row of left, else the key's first value; one shuffle on the key.

    left: keys, t, others; right: keys, t, value, and ``tie`` to order equal times.
    """
    name = out or value
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast("struct<v:" + right.schema[value].dataType.simpleString() + ">")).withColumn("_tie", F.lit(None).cast(right.schema[tie].dataType))
    b = right.select(*keys, t, F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_v"), F.col(tie).alias("_tie"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(t, "_side", "_tie")
    prior = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.withColumn(name, F.coalesce(prior, first)["v"]).where("_side = 1").select(*left.columns, name)


def nearest_frame(windows: DataFrame, frames: DataFrame, keys: list[str], ts: str = "ts", frame: str = "frame") -> DataFrame:
    """For windows [t0, t1]: the frame nearest to either end; of equally near ones the earliest, then the least.

    Both ends and the frames are sorted together once for each key, and an end sees the last frame at or before it and the
    first after it. Repeated windows give one row; a window of a key without frames gives null.
    """
    kind = frames.schema[frame].dataType.simpleString()
    when = frames.schema[ts].dataType.simpleString()
    marks = frames.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.min(frame).alias(frame))  # one a time
    marks = marks.select(*keys, F.col(ts).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(ts).alias("ts"), F.col(frame).alias("frame")).alias("_f"))
    one = windows.distinct()
    ends = one.select(*one.columns, F.explode(F.array("t0", "t1")).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(f"struct<ts:{when},frame:{kind}>").alias("_f"))
    both = ends.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_side")
    before = F.last("_f", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_f", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumn("_before", before).withColumn("_after", after).where("_side = 1")
    gap = lambda f: F.least(F.abs(f["ts"] - F.col("t0")), F.abs(f["ts"] - F.col("t1")))
    ranked = lambda f: F.when(F.col(f).isNotNull(), F.struct(gap(F.col(f)).alias("gap"), F.col(f)["ts"].alias("ts"), F.col(f)["frame"].alias("frame")))
    least = seen.groupBy(*one.columns).agg(F.min(F.least(ranked("_before"), ranked("_after"))).alias("_best"))
    return least.select(*one.columns, F.col("_best.frame").alias("nearest"))


def frame_at(t: Column, dur: Column, n: Column) -> Column:
    """Time to frame index: round(t / dur * (n - 1)), half to even, clamped to the frames."""
    return F.least(F.greatest(F.bround(t / F.nullif(dur, F.lit(0.0)) * (n - 1), 0), F.lit(0.0)), n - 1).cast("int")


def suppress(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Greedy: rows of one key in order; a row stays if its closed interval meets no row kept before.

    A key's rows are first cut where no interval reaches across, as rows on either side cannot meet; only the rows of one
    such stretch are folded together. An interval without an end meets none and stays.
    """
    fields = [c for c in df.columns if c not in keys]
    rest = [c for c in fields if c not in order]
    row = F.struct(*order, *rest)
    by_start = Window.partitionBy(*keys).orderBy("t0", "t1")
    reached = F.max("t1").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    apart = df.withColumn("_cut", F.coalesce(F.col("t0") > reached, F.lit(False)).cast("int"))
    stretches = apart.withColumn("_stretch", F.sum("_cut").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = stretches.groupBy(*keys, "_stretch").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    kind = grouped.schema["_rows"].dataType.simpleString()
    kept = F.aggregate(
        "_rows",
        F.array().cast(kind),
        lambda acc, x: F.when(F.exists(acc, lambda k: (k["t1"] >= x["t0"]) & (k["t0"] <= x["t1"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return grouped.select(*keys, F.inline(kept)).select(*df.columns)


def consume(free: DataFrame, taken: DataFrame, keys: list[str], width: float | None = None) -> DataFrame:
    """The intervals of ``free`` that meet none of ``taken``."""
    return overlap_join(free, taken, keys, "left_anti", width=width)
