"""Exact nearest neighbours of points, by growing rings of grid cells, and the outlier rule that rests on them.

Points at one place are one position with a weight, so copies make no pairs. A position searches the cells around its own,
at a cell width of its own: where a cell holds many positions its width is halved until it does not, and where the k-th
neighbour lies beyond the ring of adjoining cells the width is doubled and the position searches again. A search is an
equi-join on cells and ends for a position when its k-th distance is below the ring's edge, or when all points of its
key have been met. No step sees all points of a key, and the answer does not depend on the first width.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.tables import materialise, release

#: Positions that one cell may hold before its width is halved, and the most halvings of the first width.
CELL_POSITIONS, FINEST = 64, 60
#: A ring's edge counts as this much nearer than it is, as cells are computed in floating point.
EDGE = 1 - 1e-9


def _cells(coordinates: list[str], width: Column) -> list[Column]:
    return [F.floor(F.col(c) / width) for c in coordinates]


def _width(cell: float, level: Column) -> Column:
    """The cell width at a level; a level up doubles it."""
    return F.lit(float(cell)) * F.pow(F.lit(2.0), level.cast("double"))


def positions(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, _x0.., m): the places of points with how many are there; points without a coordinate are left out."""
    at = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]
    whole = reduce(Column.__and__, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns))
    return df.where(whole).select(*keys, *at).groupBy(*keys, *(f"_x{i}" for i in range(len(columns)))).agg(F.count(F.lit(1)).alias("m"))


def levelled(places: DataFrame, keys: list[str], coordinates: list[str], cell: float) -> DataFrame:
    """Positions with the level of their cell width: 0, or lower where cells of that width hold too many positions."""
    done, left = [], places
    for level in range(0, -FINEST - 1, -1):
        cells = [c.alias(f"_c{i}") for i, c in enumerate(_cells(coordinates, _width(cell, F.lit(level))))]
        placed = left.select(*places.columns, *cells)
        names = [f"_c{i}" for i in range(len(coordinates))]
        full = placed.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CELL_POSITIONS).select(*keys, *names)
        on = [placed[c].eqNullSafe(full[c]) for c in [*keys, *names]]
        done.append(placed.join(full, on, "left_anti").select(*places.columns, F.lit(level).alias("level")))
        if level == -FINEST:
            done[-1] = placed.select(*places.columns, F.lit(level).alias("level"))
            break
        left = materialise(placed.join(full, on, "left_semi").select(*places.columns), "dense")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def nearest_distances(df: DataFrame, keys: list[str], columns: list[str], k: int, cell: float) -> DataFrame:
    """(keys, _x0.., m, found, total): for each place, the number and the summed distance of the nearest k points, itself included.

    Fewer than k only where the key has fewer points. Distances are Euclidean, ``cell`` is where the search begins. Keys may be null.
    """
    xs = [f"_x{i}" for i in range(len(columns))]
    places = materialise(positions(df, keys, columns), "places")
    weights = places.groupBy(*keys).agg(F.sum("m").alias("_all")) if keys else places.agg(F.sum("m").alias("_all"))
    by_key = {c: f"_k{i}" for i, c in enumerate(keys)}
    weights = materialise(weights.withColumnsRenamed(by_key), "weights")
    levels = levelled(places, keys, xs, cell)
    known = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(n)) for c, n in by_key.items()), F.lit(True))
    todo = materialise(levels.join(weights, known).drop(*by_key.values()), "searches")
    done = []
    while not todo.isEmpty():
        used = sorted(r["level"] for r in todo.select("level").distinct().collect())  # some tens at most
        own = F.explode(F.array(*(F.lit(v) for v in used))).alias("level")
        b = places.select(*(F.col(c).alias(f"b{c}") for c in [*keys, *xs, "m"]), own)
        b = b.select("*", *(c.alias(f"b_c{i}") for i, c in enumerate(_cells([f"b{x}" for x in xs], _width(cell, F.col("level")))))).withColumnRenamed("level", "b_level")
        a = todo
        for i, c in enumerate(_cells(xs, _width(cell, F.col("level")))):
            ring = F.sequence(F.lit(-1), F.lit(1))
            a = a.withColumn("_d", F.explode(ring)).withColumn(f"_c{i}", c + F.col("_d")).drop("_d")
        on = [a["level"] == b["b_level"], *(a[f"_c{i}"] == b[f"b_c{i}"] for i in range(len(xs))), *(a[c].eqNullSafe(b[f"b{c}"]) for c in keys)]
        square = reduce(Column.__add__, ((F.col(x) - F.col(f"b{x}")) * (F.col(x) - F.col(f"b{x}")) for x in xs))
        pairs = a.join(b, on).select(*todo.columns, F.sqrt(square).alias("_d"), F.col("bm").alias("_m"))
        by = [*keys, *xs]
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("_d"))
        top = pairs.withColumn("_r", rank).where(F.col("_r") <= k)  # each place has a point at least
        upto = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        top = top.withColumn("_take", F.greatest(F.least(F.col("_m"), F.lit(k) - (F.sum("_m").over(upto) - F.col("_m"))), F.lit(0)))
        one = lambda c: F.first(c).alias(c)  # noqa: E731 - the same in all rows of a place
        got = top.groupBy(*by).agg(
            one("m"), one("level"), one("_all"), F.sum("_take").alias("found"), F.sum(F.col("_take") * F.col("_d")).alias("total"), F.max(F.when(F.col("_take") > 0, F.col("_d"))).alias("_last")
        )
        got = materialise(got, "nearest")
        settled = (F.col("found") == F.col("_all")) | ((F.col("found") >= k) & (F.col("_last") <= _width(cell, F.col("level")) * EDGE))
        done.append(got.where(settled).select(*by, "m", "found", "total"))
        before, todo = todo, materialise(got.where(~settled).select(*by, "m", (F.col("level") + 1).alias("level"), "_all"), "searches")
        release(before)
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema if f.name != "m")
    return reduce(DataFrame.unionByName, done) if done else df.sparkSession.createDataFrame([], f"{made}, m long, found long, total double")


def outliers_removed(df: DataFrame, keys: list[str], columns: list[str], cell: float, k: int = 20, sigma: float = 2.0) -> DataFrame:
    """Points whose mean distance to the nearest k, themselves among them, lies below the mean of these means plus ``sigma`` of their deviations.

    Means of 0 (a lone point, or k points and more at one place) count in the number of means but not in their sums, and
    their points go; the deviation is that of a sample, so a single point goes too. Points without a coordinate go; every other
    column passes; points at one place share their fate and stay as often as they came.
    """
    xs = [f"_x{i}" for i in range(len(columns))]
    near = nearest_distances(df, keys, columns, k, cell).withColumn("_mean", F.col("total") / F.col("found"))
    some = F.col("_mean") > 0
    weighed = near.select(*keys, "m", "_mean")
    sums = weighed.groupBy(*keys).agg(F.sum("m").alias("_n"), F.sum(F.when(some, F.col("m") * F.col("_mean")).otherwise(0.0)).alias("_s")) if keys else weighed.agg(F.sum("m").alias("_n"), F.sum(F.when(some, F.col("m") * F.col("_mean")).otherwise(0.0)).alias("_s"))
    named = {c: f"_k{i}" for i, c in enumerate(keys)}
    centre = sums.select(*(F.col(c).alias(n) for c, n in named.items()), "_n", (F.col("_s") / F.nullif("_n", F.lit(0))).alias("_centre"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(n)) for c, n in named.items()), F.lit(True))
    away = near.join(centre, same)
    square = F.when(some, F.col("m") * (F.col("_mean") - F.col("_centre")) * (F.col("_mean") - F.col("_centre"))).otherwise(0.0)
    spread = away.groupBy(*named.values()).agg(F.sum(square).alias("_sq"), F.first("_n").alias("_n"), F.first("_centre").alias("_centre")) if keys else away.agg(F.sum(square).alias("_sq"), F.first("_n").alias("_n"), F.first("_centre").alias("_centre"))
    limit = spread.select(*named.values(), (F.col("_centre") + sigma * F.sqrt(F.col("_sq") / F.nullif(F.col("_n") - 1, F.lit(0)))).alias("_limit"))
    fine = near.join(limit, same).where(some & (F.col("_mean") < F.col("_limit"))).select(*(F.col(c).alias(f"f{c}") for c in [*keys, *xs]))
    on = [df[c].eqNullSafe(fine[f"f{c}"]) for c in keys] + [df[c].cast("double") == fine[f"f{x}"] for c, x in zip(columns, xs, strict=True)]
    return df.join(fine, on, "left_semi")
