"""Checkpoints as tables of (checkpoint, key, index, value), robust lines, and positional comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.tables import materialise


def average(df: DataFrame, at: list[str], value: str, checkpoint: str) -> DataFrame:
    """(at, value, n): each parameter's mean over the checkpoints that have it."""
    return df.groupBy(*at).agg(F.avg(value).alias(value), F.count_distinct(checkpoint).alias("n"))


def difference(a: DataFrame, b: DataFrame, at: list[str], value: str) -> DataFrame:
    """(at, side, diff): both checkpoints' parameters; side is both, only_a or only_b, diff is b less a or null."""
    left, right = a.select(*at, F.col(value).alias("_a")), b.select(*at, F.col(value).alias("_b"))
    side = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("both")
    return left.join(right, at, "full").select(*at, side.alias("side"), (F.col("_b") - F.col("_a")).alias("diff"))


def pair_errors(a: DataFrame, b: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """(keys, pos, error): the i-th of a against the i-th of b in order, Euclidean; what has no partner is left out."""
    number = lambda d, p: d.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).select(*keys, "pos", *(F.col(c).alias(f"{p}{c}") for c in columns))
    square = lambda c: F.pow(F.col(f"_a{c}") - F.col(f"_b{c}"), 2)
    total = sum((square(c) for c in columns[1:]), square(columns[0]))
    return number(a, "_a").join(number(b, "_b"), [*keys, "pos"]).select(*keys, "pos", F.sqrt(total).alias("error"))


def robust_line(df: DataFrame, keys: list[str], id_col: str, x: str, y: str, tolerance: float, trials: int = 24, seed: int = 42) -> DataFrame:
    """(keys, slope, intercept, n_inliers): the line through a random pair that most points lie near, refitted on those.

    Pairs are the rows of least hash of id, seed and trial, so the draw is repeatable. Drawing, counting and fitting are
    hash aggregates of plain numbers, so no task sorts or holds its rows. Lines and counts, a row a key, are written, so that
    their joins go by their true size. Keys whose pairs all have one x give no row.
    """
    have = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    draw = lambda j: F.xxhash64(F.col(id_col), F.lit(seed), F.lit(j))
    ends = [F.min_by(F.col(c).cast("double"), draw(j)).alias(f"_{n}{j}") for j in range(2 * trials) for n, c in (("x", x), ("y", y))]  # both of one row
    drawn = have.groupBy(*keys).agg(*ends)

    def line(j: int) -> Column:
        p, q = 2 * j, 2 * j + 1
        slope = (F.col(f"_y{q}") - F.col(f"_y{p}")) / F.nullif(F.col(f"_x{q}") - F.col(f"_x{p}"), F.lit(0.0))
        return F.struct(slope.alias("s"), (F.col(f"_y{p}") - slope * F.col(f"_x{p}")).alias("b"))

    lines = materialise(drawn.select(*keys, F.filter(F.array(*(line(j) for j in range(trials))), lambda v: v["s"].isNotNull()).alias("_lines")), "lines")
    near = lambda v: F.abs(F.col(y) - (v["s"] * F.col(x) + v["b"])) <= tolerance
    counted = have.join(lines, keys).groupBy(*keys).agg(*(F.count_if(near(F.get("_lines", F.lit(j)))).alias(f"_n{j}") for j in range(trials)))
    score = F.array(*(F.struct(F.col(f"_n{j}").alias("n"), F.lit(-j).alias("j")) for j in range(trials)))
    best = counted.join(lines, keys).select(*keys, F.get("_lines", -F.array_max(score)["j"]).alias("_best")).where("_best is not null")
    best = materialise(best, "best")
    inliers = have.join(best, keys).where(near(F.col("_best")))
    return inliers.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n_inliers"))


def temporal_queue(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, drop: Column | None = None, seed: int = 0, out: str = "queue") -> DataFrame:
    """The n values before each row without the one at place ``drop`` (a hash of the row by default), then its own, in order.

    A row with fewer than n before it keeps all of them.
    """
    at = F.pmod(F.xxhash64(*(F.col(c) for c in (*keys, *order)), F.lit(seed)), F.lit(n)) if drop is None else drop
    before = F.collect_list(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1))
    held = F.filter(F.col("_q"), lambda v, i: (F.size("_q") < n) | (i != at))
    return df.withColumn("_q", before).withColumn(out, F.concat(held, F.array(value))).drop("_q")


def flat_top_k(df: DataFrame, keys: list[str], query: str, scores: list[str], k: int) -> DataFrame:
    """(keys, query, label, score, rank): the k best of all queries and classes together."""
    every = df.select(*keys, query, F.posexplode(F.array(*scores)).alias("label", "score"))
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), query, "label")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall_at(df: DataFrame, keys: list[str], order: list[Column], relevant: str, ks: list[int]) -> DataFrame:
    """(keys, k, recall): the share of the relevant rows among the first k; null where none is relevant."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    hit = lambda k: F.count_if(F.col(relevant) & (F.col("_r") <= k)) / F.nullif(F.count_if(relevant), F.lit(0))
    wide = ranked.groupBy(*keys).agg(*(hit(k).alias(f"_k{k}") for k in ks))
    return wide.select(*keys, F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_k{k}").alias("recall")) for k in ks))))


def distance_ap(df: DataFrame, keys: list[str], score: str, distance: str, thresholds: list[float], excluded: Column | None = None) -> DataFrame:
    """(keys, threshold, ap) of scored predictions with their distance to the truth (null: none); excluded keys give null."""
    from skarn.operators.matching import average_precision

    each = df.select(*keys, score, distance, F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    ap = average_precision(each.withColumn("_hit", F.coalesce(F.col(distance) < F.col("threshold"), F.lit(False))), [*keys, "threshold"], score, "_hit")
    return ap if excluded is None else ap.withColumn("ap", F.when(~excluded, F.col("ap")))
