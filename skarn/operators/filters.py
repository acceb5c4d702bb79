"""Predicates and keyed filters. A group's condition is aggregated and joined back, so no group meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_clip(df: DataFrame, keys: list[str], t: str, spans: DataFrame, lo: str = "lo", hi: str = "hi", min_rows: int = 3) -> DataFrame:
    """Rows inside their key's span, both ends included; keys left with fewer than ``min_rows`` go."""
    inside = df.join(spans.select(*keys, lo, hi), keys).where(F.col(t).between(F.col(lo), F.col(hi))).drop(lo, hi)
    return enough(inside, keys, min_rows)


def enough(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of the keys that have at least n."""
    held = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).drop("_n")
    return df.join(held, keys, "left_semi")


def in_ranges(df: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float]], min_points: int = 0) -> DataFrame:
    """Points inside all closed ranges; keys left with fewer than ``min_points`` go."""
    for c, (lo, hi) in ranges.items():
        df = df.where(F.col(c).between(lo, hi))
    return enough(df, keys, min_points) if min_points > 1 else df


def in_corridor(x: Column, y: Column, half: float = 2.5, ahead: float = 45.0) -> Column:
    return (F.abs(y) < half) & (x > 0) & (x < ahead)


def clean_frames(frames: DataFrame, pixels: DataFrame, keys: list[str], dynamic: Column, threshold: float) -> DataFrame:
    """Frames whose share of dynamic pixels is below the threshold; a frame without a mask is clean."""
    share = pixels.groupBy(*keys).agg(F.avg(dynamic.cast("double")).alias("_share"))
    return frames.join(share, keys, "left").where(F.coalesce(F.col("_share") < threshold, F.lit(True))).drop("_share")


def by_token(df: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(tokens.select(*keys), keys, "left_semi")


def in_several_views(df: DataFrame, keys: list[str], view: str, more_than: int = 1) -> DataFrame:
    """(keys, n_views) of the boxes that more than so many cameras see."""
    return df.groupBy(*keys).agg(F.count_distinct(view).alias("n_views")).where(F.col("n_views") > more_than)


def usable_annotation(points: Column, category: Column, seen: Column, min_points: int = 1, min_seen: float = 0.2) -> Column:
    """Enough lidar points, a category, and enough of the box inside the image."""
    return F.coalesce((points >= min_points) & category.isNotNull() & (seen >= min_seen), F.lit(False))


def missing_fields(fields: list[str]) -> Column:
    """The names, in order, of the required fields that are null."""
    return F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)))


def with_default(value: Column, **fields) -> Column:
    """A struct or, where it is null, the default struct of these literal fields."""
    return F.coalesce(value, F.struct(*(F.lit(v).alias(k) for k, v in fields.items())))


def in_class_radius(cls: Column, x: Column, y: Column, radius: dict[str, float]) -> Column:
    """Within its class's radius; classes without one are out."""
    limit = F.element_at(F.create_map(*(F.lit(v) for p in radius.items() for v in p)), cls)
    return F.coalesce(F.hypot(x, y) <= limit, F.lit(False))


def has_single(annotations: Column, crowd: str = "iscrowd") -> Column:
    """Whether any annotation is not a crowd; a missing flag is none."""
    return F.exists(annotations, lambda a: F.coalesce(a[crowd], F.lit(0)) == 0)


def kept_unless_denied(df: DataFrame, verdicts: DataFrame, keys: list[str], verdict: str) -> DataFrame:
    """Rows whose verdict is true or missing."""
    said = verdicts.groupBy(*keys).agg(F.bool_and(verdict).alias("_said"))
    return df.join(said, keys, "left").where(F.coalesce("_said", F.lit(True))).drop("_said")


def active(df: DataFrame, t: Column, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Intervals that hold the time ``t``, ends included."""
    return df.where((t >= F.col(t0)) & (t <= F.col(t1)))


def classes(df: DataFrame, cls: str, keep: list) -> DataFrame:
    """Rows of the classes that move."""
    return df.where(F.col(cls).isin(*keep))


def vocabulary_problems(df: DataFrame, code: str, ref: str, prefix: str) -> DataFrame:
    """(problem, key, n): codes there more than once, references to no code, and prefixes that several codes share."""
    many = lambda c, name: df.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(name).alias("problem"), "key", "n")
    known = df.select(F.col(code).alias("key")).distinct()
    lost = df.where(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("key")).agg(F.count(F.lit(1)).alias("n")).join(known, "key", "left_anti")
    return many(prefix, "prefix").unionByName(many(code, "duplicate")).unionByName(lost.select(F.lit("dangling").alias("problem"), "key", "n"))


def run_summary(df: DataFrame, keys: list[str], ok: str) -> DataFrame:
    """How many items of a run there were, passed and failed, and the share that passed."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ok)).alias("n_ok"), F.count_if(~F.col(ok)).alias("n_failed"))
    return g.withColumn("share", F.col("n_ok") / F.col("n"))


def outside_pool(df: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Rows whose key the pool does not hold; a null key is in no pool. Only the pool's different keys are shuffled."""
    return df.join(pool.select(key).distinct(), key, "left_anti")
