"""Grouped scores and statistics, all with partial aggregation before their one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _any(cond: Column) -> Column:
    return F.max(F.when(cond, 1).otherwise(0))


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def ego_score(df: DataFrame, keys: list[str], kind: str, ax: Column) -> DataFrame:
    """2 turn + 2 lane change + stop + 1.5 min(harsh, 3) + 0.4 decelerations, harsh = max(0, -min(ax) - 3)."""
    k = F.col(kind)
    g = df.groupBy(*keys).agg(
        _any(k.startswith("turn_")).alias("turn"),
        _any(k.startswith("lane_change")).alias("lane_change"),
        _any(k == "stop").alias("stop"),
        _n(k == "decelerate").alias("n_decel"),
        F.min(ax).alias("min_ax"),
    )
    harsh = F.least(F.greatest(-F.col("min_ax") - 3, F.lit(0.0)), F.lit(3.0))
    return g.withColumn("score", 2.0 * F.col("turn") + 2.0 * F.col("lane_change") + F.col("stop") + 1.5 * harsh + 0.4 * F.col("n_decel"))


def reactivity(kinds: Column, min_ax: Column) -> Column:
    """2.5 min(harsh, 4) + min(decelerations, 4) + 0.8 stop-and-go + stop + lane change + 0.6 turn, from an array of kinds."""
    has = lambda name: F.array_contains(kinds, name).cast("int")
    harsh = F.least(F.greatest(-F.coalesce(min_ax, F.lit(0.0)) - 3, F.lit(0.0)), F.lit(4.0))
    decel = F.least(F.size(F.filter(kinds, lambda x: x == "decelerate")), F.lit(4))
    lane = F.exists(kinds, lambda x: x.startswith("lane_change")).cast("int")
    turn = F.exists(kinds, lambda x: x.startswith("turn_")).cast("int")
    return 2.5 * harsh + decel + 0.8 * (has("stop") * has("accelerate")) + has("stop") + lane + 0.6 * turn


def with_running_sums(df: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, Column]) -> DataFrame:
    """df with the values' sums so far in order, and each row's place _nth: a sum in order does not follow the way rows come in."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *(F.sum(v).over(upto).alias(n) for n, v in values.items()), F.row_number().over(w).alias("_nth"))


def last_mean(total: str, value: Column) -> Column:
    """The mean of a group from its running sums; null where there are no values."""
    return F.max_by(total, "_nth") / F.nullif(F.count(value), F.lit(0))


def range_stats(ranges: DataFrame, series: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """For each range [t0, t1]: min, mean and net change (last less first) of a series of the same key; the mean is summed in order of time."""
    s = series.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(t).alias("_t"), F.col(value).alias("_v"))
    on = (F.col("_t") >= F.col("t0")) & (F.col("_t") <= F.col("t1"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    met = with_running_sums(ranges.join(s, on, "left"), ranges.columns, ["_t", "_v"], {"_sum": F.col("_v")})
    return met.groupBy(*ranges.columns).agg(
        F.min("_v").alias("min_value"), last_mean("_sum", F.col("_v")).alias("mean_value"), (F.max_by("_v", "_t") - F.min_by("_v", "_t")).alias("net_value")
    )


def votes(df: DataFrame, keys: list[str], vote: str, n: int) -> DataFrame:
    """The share of n votes that a key got, to two places."""
    return df.groupBy(*keys).agg(F.round(F.count_distinct(vote) / F.lit(n), 2).alias("vote_fraction"))


def best_with_bonus(df: DataFrame, keys: list[str], score: str, order: list[Column], bonus: float) -> DataFrame:
    """The best row's score and ``bonus`` for each further one; the first of equals is the best."""
    w = Window.partitionBy(*keys)
    best = df.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.col(score).desc(), *order)))
    return best.where("_rn = 1").drop("_rn").withColumn("clip_score", F.col(score) + F.lit(bonus) * (F.col("n") - 1))


def histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, null being a group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def pivot_counts(df: DataFrame, key: str, on: str, values: list[str]) -> DataFrame:
    """A count for each given value; the values are given, so no pass looks for them."""
    return df.groupBy(key).agg(*(_n(F.col(on) == v).alias(f"n_{v}") for v in values))


def coverage(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The share of rows in which each field has a value."""
    return df.groupBy(*keys).agg(*((F.count(f) / F.count(F.lit(1))).alias(f"cov_{f}") for f in fields))


def corroboration(df: DataFrame, keys: list[str], state: str) -> DataFrame:
    """confirmed / (all - unavailable), null where nothing is available."""
    n, yes, gone = F.count(F.lit(1)), _n(F.col(state) == "confirmed"), _n(F.col(state) == "unavailable")
    return df.groupBy(*keys).agg(n.alias("n"), yes.alias("confirmed"), gone.alias("unavailable"), (yes / F.nullif(n - gone, F.lit(0))).alias("rate"))


def peak_to_peak(value: Column) -> Column:
    """An aggregate: the greatest value less the least."""
    return F.max(value) - F.min(value)


def point_stats(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """min, max, mean and population deviation of each column."""
    out = []
    for c in columns:
        out += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return df.groupBy(*keys).agg(*out) if keys else df.agg(*out)


def normalised(df: DataFrame, keys: list[str], value: str, method: str, out: str) -> DataFrame:
    """zscore, minmax or robust (median and quartile range); a spread of zero counts as 1.

    The statistics are aggregated and joined back, so no window gathers a group's rows.
    """
    stats = {
        "zscore": (F.avg(value), F.stddev_pop(value)),
        "minmax": (F.min(value), F.max(value) - F.min(value)),
        "robust": (F.median(value), F.percentile(value, 0.75) - F.percentile(value, 0.25)),
    }[method]
    agg = [stats[0].alias("_at"), stats[1].alias("_by")]
    if keys:
        held = df.join(df.groupBy(*keys).agg(*agg), keys)
    else:  # one row of two figures
        at = df.agg(*agg).select(F.struct("_at", "_by").alias("s"))
        held = df.withColumn("_s", at.scalar()).withColumns({"_at": F.col("_s._at"), "_by": F.col("_s._by")}).drop("_s")
    return held.withColumn(out, (F.col(value) - F.col("_at")) / F.coalesce(F.nullif(F.col("_by"), F.lit(0.0)), F.lit(1.0))).drop("_at", "_by")


def latency(df: DataFrame, keys: list[str], sec: str) -> DataFrame:
    q = F.percentile(sec, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    g = df.groupBy(*keys).agg(F.avg(sec).alias("mean"), F.stddev_pop(sec).alias("std"), F.min(sec).alias("min"), F.max(sec).alias("max"), q.alias("_q"))
    return g.select(
        *keys, "mean", "std", "min", "max", F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p95"), F.col("_q")[2].alias("p99"), (1 / F.nullif("mean", F.lit(0.0))).alias("fps")
    )


def epoch_times(df: DataFrame, keys: list[str], epoch: str, it: str, time: str, with_first: bool = False) -> DataFrame:
    """Mean time an epoch, and over epochs the slowest, the fastest and the deviation; the first iteration is left out."""
    w = Window.partitionBy(*keys, epoch).orderBy(it)
    rows = df if with_first else df.withColumn("_rn", F.row_number().over(w)).where("_rn > 1")
    each = rows.groupBy(*keys, epoch).agg(F.avg(time).alias("m"))
    return each.groupBy(*keys).agg(
        F.max_by(epoch, F.struct("m", -F.col(epoch))).alias("slowest"),
        F.max("m").alias("slowest_time"),
        F.min_by(epoch, F.struct("m", epoch)).alias("fastest"),
        F.min("m").alias("fastest_time"),
        F.stddev_pop("m").alias("std"),
    )


def frame_meta(df: DataFrame, keys: list[str], ts_us: str) -> DataFrame:
    """Frames, seconds, and mean frame rate from the mean gap."""
    n, span = F.count(F.lit(1)), F.max(ts_us) - F.min(ts_us)
    return df.groupBy(*keys).agg(n.alias("n_frames"), (span / 1e6).alias("duration"), (1e6 * (n - 1) / F.nullif(span, F.lit(0))).alias("fps"))


def weighted_error(df: DataFrame, keys: list[str], error: str, weight: str) -> DataFrame:
    """sum(w e) / sum(w), 0 without weight."""
    w = F.sum(weight)
    return df.groupBy(*keys).agg(F.coalesce(F.sum(F.col(weight) * F.col(error)) / F.nullif(w, F.lit(0.0)), F.lit(0.0)).alias("error"))


def psnr(df: DataFrame, keys: list[str], a: str, b: str, peak: float) -> DataFrame:
    """10 log10(peak^2 / mse); infinite for equal images."""
    mse = F.avg(F.pow(F.col(a) - F.col(b), 2))
    return df.groupBy(*keys).agg(mse.alias("mse")).withColumn(
        "psnr", F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) / F.nullif("mse", F.lit(0.0))))
    )
