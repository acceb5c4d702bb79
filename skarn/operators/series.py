"""Operators on ordered series: one window a key, ordered by a time column and a tie-break."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators import intervals, ranking


def _w(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def runs(df: DataFrame, keys: list[str], order: list[str], mask: Column, t: str, min_sec: float = 0.0, min_rows: int = 1) -> DataFrame:
    """Maximal runs of true rows as (keys, t0, t1, n); a run ends at its last true row and must last ``min_sec``."""
    hit = F.coalesce(mask, F.lit(False))
    marked = df.withColumn("_hit", hit).withColumn("_run", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(_w(keys, order)))
    found = marked.where("_hit").groupBy(*keys, "_run").agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count(F.lit(1)).alias("n"))
    return found.where((F.col("t1") - F.col("t0") >= min_sec) & (F.col("n") >= min_rows)).drop("_run")


def hits(df: DataFrame, keys: list[str], order: list[str], masks: dict[str, Column], carry: list[str]) -> DataFrame:
    """(keys, carry, kind, run): each row once for each mask that is true of it; rows of one kind and run are a maximal run.

    The masks share one sort, and only true rows are multiplied.
    """
    flags = {k: F.coalesce(m, F.lit(False)) for k, m in masks.items()}
    marked = df.select(
        *keys,
        *carry,
        *(f.alias(f"_hit_{k}") for k, f in flags.items()),
        *(F.sum(F.when(f, 0).otherwise(1)).over(_w(keys, order)).alias(f"_run_{k}") for k, f in flags.items()),
    )
    each = F.array(*(F.when(F.col(f"_hit_{k}"), F.struct(F.lit(k).alias("kind"), F.col(f"_run_{k}").alias("run"))) for k in masks))
    return marked.select(*keys, *carry, F.inline(F.array_compact(each)))


def merge(df: DataFrame, keys: list[str], gap: float, t0: str = "t0", t1: str = "t1", carry: list[str] = (), order: list[str] = ()) -> DataFrame:
    """Intervals of one key merged while the next starts at most ``gap`` after all before ended; the first's other fields stay."""
    by = [t0, *(order or [t1])]
    before = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col(t0) - F.max(t1).over(before) <= gap, 0).otherwise(1)
    grouped = df.withColumn("_new", new).withColumn("_g", F.sum("_new").over(_w(keys, by)))
    first = [F.min_by(c, F.struct(*by)).alias(c) for c in carry]
    return grouped.groupBy(*keys, "_g").agg(F.min(t0).alias(t0), F.max(t1).alias(t1), F.count(F.lit(1)).alias("n_merged"), *first).drop("_g")


def episodes(df: DataFrame, keys: list[str], gap: float, kind: str = "kind", t0: str = "t0", t1: str = "t1", tie: list[str] = ()) -> DataFrame:
    """Events of any kind joined into episodes, the kinds in order of start, duplicates kept."""
    by = [t0, *tie, kind]
    before = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col(t0) <= F.max(t1).over(before) + gap, 0).otherwise(1)
    grouped = df.withColumn("_new", new).withColumn("ep", F.sum("_new").over(_w(keys, by)) - 1)
    kinds = F.transform(F.array_sort(F.collect_list(F.struct(*by))), lambda x: x[kind])
    return grouped.groupBy(*keys, "ep").agg(F.min(t0).alias(t0), F.max(t1).alias(t1), F.min(t0).alias("onset"), kinds.alias("kinds"))


def gaps(df: DataFrame, keys: list[str], spans: DataFrame, lo: str = "lo", hi: str = "hi", t0: str = "t0", t1: str = "t1") -> DataFrame:
    """The complement of the union of intervals inside each key's span [lo, hi]; keys without intervals give the span."""
    inside = df.join(spans, keys).select(*keys, F.greatest(t0, lo).alias("a"), F.least(t1, hi).alias("b"), lo, hi).where("a <= b")
    ends = spans.select(*keys, F.col(hi).alias("a"), F.col(hi).alias("b"), lo, hi)
    before = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    held = inside.unionByName(ends).withColumn("from", F.coalesce(F.max("b").over(before), F.col(lo)))
    return held.where(F.col("from") < F.col("a")).select(*keys, F.col("from").alias("t0"), F.col("a").alias("t1"))


def baseline_fill(df: DataFrame, keys: list[str], spans: DataFrame, min_sec: float, kind: str = "lane_keep") -> DataFrame:
    """The events with a baseline event in each gap of at least ``min_sec``."""
    idle = gaps(df, keys, spans).where(F.col("t1") - F.col("t0") >= min_sec).withColumn("kind", F.lit(kind))
    return df.select(*keys, "t0", "t1", "kind").unionByName(idle)


def sliding_windows(df: DataFrame, keys: list[str], dur: str, size: float, stride: float) -> DataFrame:
    """Windows of ``size`` every ``stride`` seconds; the first that reaches the end is cut there and is the last."""
    n = F.greatest(F.ceil((F.col(dur) - size) / stride), F.lit(0)).cast("int")
    w = df.where(F.col(dur) > 0).select(*keys, dur, F.explode(F.sequence(F.lit(0), n)).alias("i"))
    return w.select(*keys, "i", (F.col("i") * F.lit(stride)).alias("w0"), F.least(F.col("i") * F.lit(stride) + size, F.col(dur)).alias("w1"))


def gradient(df: DataFrame, keys: list[str], order: list[str], y: str, t: str, out: str, min_dt: float = 1e-6) -> DataFrame:
    """Central difference of y over that of t, one-sided at the ends; a zero step counts as ``min_dt``; a lone row has no slope."""
    w = _w(keys, order)
    d = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    dt = d(t)
    alone = F.lead(t).over(w).isNull() & F.lag(t).over(w).isNull()
    return df.withColumn(out, F.when(~alone, d(y) / F.when(dt == 0, F.lit(min_dt)).otherwise(dt)))


def unwrap(df: DataFrame, keys: list[str], order: list[str], angle: str, out: str) -> DataFrame:
    """Angles without jumps over pi: each step is taken modulo 2 pi into (-pi, pi], and pi for a step of +pi."""
    w = _w(keys, order)
    step = F.coalesce(F.col(angle) - F.lag(angle).over(w), F.lit(0.0))
    turns = F.ceil((step - math.pi) / (2 * math.pi))
    turns = F.when((step < 0) & (step - 2 * math.pi * turns == math.pi), turns + 1).otherwise(turns)
    return df.withColumn("_fix", -2 * math.pi * turns).withColumn(out, F.col(angle) + F.sum("_fix").over(w)).drop("_fix")


def trapezoid(df: DataFrame, keys: list[str], order: list[str], y: str, t: str, out: str = "area") -> DataFrame:
    """The integral of y over t for each key."""
    w = _w(keys, order)
    part = (F.col(t) - F.lag(t).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("_part", F.coalesce(part, F.lit(0.0))).groupBy(*keys).agg(F.sum("_part").alias(out))


def changes(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "n_changes") -> DataFrame:
    """How often a value differs from the one before; rows without a value are left out first."""
    seen = df.where(F.col(value).isNotNull()).withColumn("_c", (F.col(value) != F.lag(value).over(_w(keys, order))).cast("long"))
    return seen.groupBy(*keys).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias(out))


def previous_consecutive(df: DataFrame, keys: list[str], index: str, value: str, most: int, out: str = "previous") -> DataFrame:
    """Up to ``most`` values of the indexes right before, nearest first, ended by the first missing index."""
    run = df.withColumn("_run", F.col(index) - F.row_number().over(_w(keys, [index])))
    w = Window.partitionBy(*keys, "_run").orderBy(index).rowsBetween(-most, -1)
    return run.withColumn(out, F.reverse(F.collect_list(value).over(w))).drop("_run")


def deltas(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Differences to the row before; the first row of a key gives 0."""
    w = _w(keys, order)
    return df.select("*", *(F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)).alias(f"d_{c}") for c in columns))


def velocity(df: DataFrame, keys: list[str], order: list[str], x: str, t: str, max_dt: float, out: str = "velocity") -> DataFrame:
    """Centred where both neighbours exist within twice ``max_dt``, else forward or backward within ``max_dt``, else null."""
    w = _w(keys, order)
    px, nx, pt, nt = F.lag(x).over(w), F.lead(x).over(w), F.lag(t).over(w), F.lead(t).over(w)
    both, fwd, back = nt - pt, nt - F.col(t), F.col(t) - pt
    value = (
        F.when(both.isNotNull(), F.when((both <= 2 * max_dt) & (both > 0), (nx - px) / both))
        .when(fwd.isNotNull(), F.when((fwd <= max_dt) & (fwd > 0), (nx - F.col(x)) / fwd))
        .when(back.isNotNull(), F.when((back <= max_dt) & (back > 0), (F.col(x) - px) / back))
    )
    return df.withColumn(out, value)


def rising(df: DataFrame, keys: list[str], order: list[str], value: str, margin: float, out: str = "rising") -> DataFrame:
    """Whether the mean of the last third exceeds that of the first by more than ``margin`` (thirds of n // 3 rows, one at least)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rn = F.row_number().over(_w(keys, order))
    third = F.greatest(F.floor(n / 3), F.lit(1))
    marked = df.select(*keys, value, rn.alias("_rn"), n.alias("_n"), third.alias("_k"))
    head, tail = F.when(F.col("_rn") <= F.col("_k"), F.col(value)), F.when(F.col("_rn") > F.col("_n") - F.col("_k"), F.col(value))
    return marked.groupBy(*keys).agg((F.avg(tail) > F.avg(head) + margin).alias(out))


def head_tail(df: DataFrame, keys: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """Means over the first and the last k rows."""
    a = F.row_number().over(_w(keys, order))
    b = F.count(F.lit(1)).over(Window.partitionBy(*keys)) - a + 1  # from the end, by the same sort
    m = df.select(*keys, value, a.alias("_a"), b.alias("_b"))
    return m.groupBy(*keys).agg(F.avg(F.when(F.col("_a") <= k, F.col(value))).alias("head"), F.avg(F.when(F.col("_b") <= k, F.col(value))).alias("tail"))


def first_seen_id(df: DataFrame, value: str, order: list[str], out: str = "dense_id") -> DataFrame:
    """(value, dense id from 0) in order of first appearance."""
    firsts = df.groupBy(value).agg(F.min(F.struct(*order, F.col(value).alias("_value"))).alias("_first"))
    return ranking.numbered_all(firsts, "_first", out).select(value, out)


def entered_from_side(df: DataFrame, keys: list[str], order: list[str], state: str, sustain: int = 3, out: str = "side") -> DataFrame:
    """(keys, out): from which side, L or R, a track came in to stay, by its states in order (L, R, in, ?); null if it did not.

    The ``sustain`` states right before the first "in" are one side, at least so many are "in", the other side is not seen
    after, and the last is "in". An unknown state counts as any other and so breaks a row of equal ones.
    """
    seen = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(state).alias("_state")))), lambda x: x["_state"]).alias("_s"))
    first = F.array_position("_s", "in").cast("int")
    head = F.slice("_s", F.greatest(first - sustain, F.lit(1)), F.least(F.greatest(first - 1, F.lit(0)), F.lit(sustain)))
    after = F.slice("_s", F.greatest(first, F.lit(1)), F.size("_s"))
    side = F.get(head, F.lit(0))
    came = (
        (F.size(F.filter("_s", lambda x: x == "in")) >= sustain) & (F.size(head) == sustain) & F.forall(head, lambda x: x == side) & side.isin("L", "R")
        & ~F.array_contains(after, F.when(side == "L", "R").otherwise("L")) & (F.element_at("_s", -1) == "in")
    )
    return seen.select(*keys, F.when(came, side).alias(out))


def straight(ranges: DataFrame, turns: DataFrame, log: DataFrame, keys: list[str], t: str, yaw: str, most: float, out: str = "straight", width: float | None = None) -> DataFrame:
    """Ranges [t0, t1] that meet none of ``turns`` and inside which the heading spans less than ``most``; fewer than two samples span nothing.

    Only (keys, t0, t1) decide, so ranges with null attributes and repeated ones keep their rows.
    """
    spans = ranges.select(*keys, "t0", "t1").distinct()
    w = intervals.mean_length(spans) if width is None else width
    samples = log.select(*keys, F.col(t).alias("t0"), F.col(t).alias("t1"), F.col(yaw).alias("yaw"))
    inside = intervals.overlap_join(spans, samples, keys, width=w).groupBy(*keys, "t0", "t1")
    moved = inside.agg(F.count(F.lit(1)).alias("_n"), (F.max("b_yaw") - F.min("b_yaw")).alias("_span")).where((F.col("_n") >= 2) & (F.coalesce("_span", F.lit(0.0)) >= most))
    turned = intervals.overlap_join(spans, turns.select(*keys, "t0", "t1"), keys, "left_semi", width=w)
    bent = moved.select(*keys, "t0", "t1").unionByName(turned).distinct()
    by = {c: f"_b{i}" for i, c in enumerate([*keys, "t0", "t1"])}
    bent = bent.select(*(F.col(c).alias(n) for c, n in by.items()), F.lit(True).alias("_bent"))
    on = [ranges[c].eqNullSafe(bent[n]) for c, n in by.items()]
    return ranges.join(bent, on, "left").select(*(ranges[c] for c in ranges.columns), F.col("_bent").isNull().alias(out))
