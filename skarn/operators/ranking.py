"""Orders, top-k, samples, splits and shards; every order ends in a unique tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.tables import materialise


def normalise_max(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """value over the group's maximum; a maximum of 0 counts as 1. The maxima are aggregated and joined back, so no task holds a group."""
    named = {c: f"_by{i}" for i, c in enumerate(by)}
    top = df.groupBy(*by).agg(F.max(value).alias("_top")).withColumnsRenamed(named) if by else df.agg(F.max(value).alias("_top"))
    same = F.lit(True)
    for c, n in named.items():
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(n))
    scaled = F.col(value) / F.coalesce(F.nullif("_top", F.lit(0.0)), F.lit(1.0))
    return df.join(top, same, "left").withColumn(out, scaled).drop("_top", *named.values())


def fuse(a: Column, b: Column) -> Column:
    """max + 0.3 min."""
    return F.greatest(a, b) + F.lit(0.3) * F.least(a, b)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int | None = None, out: str = "rank") -> DataFrame:
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(out) <= k)


def rank_all(df: DataFrame, order: list[Column], k: int | None = None) -> DataFrame:
    """The whole table in order, or its first k: Spark keeps k rows a task and merges those."""
    return df.orderBy(*order) if k is None else df.orderBy(*order).limit(k)


def kth_with_ties(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """Rows whose value is at least the k-th largest; ties of it all stay."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).desc()))).where(F.col("rank") <= k)


def draw(id_col: str, seed: int) -> Column:
    """A row's place in a draw: a hash of id and seed that every engine has, as hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary"))


#: Rows that one task may sort for a sample.
SORTED_AT_ONCE = 100_000


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, those of least draw.

    A large sample is cut by counts of the draws' first four digits: whole cells below the cut stay, and only the cell
    that the cut runs through is sorted.
    """
    order = draw(id_col, seed)
    if n <= SORTED_AT_ONCE:
        return df.orderBy(order, id_col).limit(n)
    cell = F.substring(order, 1, 4)
    left, cut = n, "g"  # behind all digits
    for r in sorted(df.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["c"]):  # 65,536 rows at most
        if left < r["n"]:
            cut = r["c"]
            break
        left -= r["n"]
    whole = df.where(cell < cut)
    return whole if cut == "g" else whole.unionByName(df.where(cell == cut).orderBy(order, id_col).limit(left))


def numbered(df: DataFrame, by: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """Positions from 0 within ``by``."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def numbered_all(df: DataFrame, key: str | list[str | Column], out: str = "pos") -> DataFrame:
    """Positions from 0 over the whole table in order of a key, or of several columns; rows alike in them have no order that shows.

    A range exchange sorts, and the sorted ranges are written with each row's range and place in it, so that the counts
    and the rows read the same ranges. Each range's count (one row a range) gives its first position. No task sees all
    rows, and none is shuffled twice.
    """
    at = "_at"
    while at in df.columns:
        at = f"_{at}"
    order = [key] if isinstance(key, str) else key
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    held = materialise(ranged, "ranges")
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))  # as monotonically_increasing_id lays them out
    sizes = held.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    joined = held.join(F.broadcast(before), part == before["_p"])
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c != out), (F.col("_before") + place).alias(out))


def interval_split(df: DataFrame, by: list[str], order: list[str], k: int, out: str = "split") -> DataFrame:
    """Every k-th row, the first included, is validation."""
    return numbered(df, by, order, "_i").withColumn(out, F.when(F.pmod("_i", F.lit(k)) == 0, "val").otherwise("train")).drop("_i")


def ratio_split(df: DataFrame, by: list[str], order: list[str], ratio: float, out: str = "split") -> DataFrame:
    """The first int(n * ratio) rows train."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return numbered(df, by, order, "_i").withColumn(out, F.when(F.col("_i") < F.floor(n * F.lit(ratio)), "train").otherwise("val")).drop("_i")


def uniform_pick(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """k of n rows at evenly spaced rounded places; fewer if places meet, all if n is at most k."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = numbered(df, by, order, "_i").withColumn("_n", n)
    if k == 1:
        return rows.where("_i = 0").drop("_i", "_n")
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("_n") - 1) / F.lit(k - 1), 0).cast("long"))
    return rows.where((F.col("_n") <= k) | F.array_contains(places, F.col("_i"))).drop("_i", "_n")


def stride(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    return numbered(df, by, order, "_i").where(F.pmod("_i", F.lit(k)) == 0).drop("_i")


def slice_rows(df: DataFrame, order: list[str | Column], start: int, limit: int = 0) -> DataFrame:
    """Rows from ``start`` in order; a limit of 0 means all. Places come from sorted ranges, so neither a task nor the driver sees all rows before them."""
    at = "_place"
    while at in df.columns:
        at = f"_{at}"
    placed = numbered_all(df, order, at)
    inside = (F.col(at) >= start) & (F.col(at) < start + limit) if limit else F.col(at) >= start
    return placed.where(inside).drop(at)


def contiguous_shards(df: DataFrame, key: str, ranks: int) -> DataFrame:
    """(row, rank, place): equal contiguous shares of the order; the last is filled by wrapping around."""
    n = df.count()
    each = -(-n // ranks) if n else 0
    placed = numbered_all(df, key, "place")
    wrapped = placed.where(F.col("place") < each * ranks - n).withColumn("place", F.col("place") + n)
    return placed.unionByName(wrapped).withColumn("rank", F.floor(F.col("place") / F.lit(max(each, 1))).cast("int"))


#: Cells that a group's draws are counted in: the first so many hexadecimal digits.
CELL_DIGITS = 3


def drawn_places(df: DataFrame, group: str, id_col: str, seed: int) -> DataFrame:
    """df with _i, a row's place from 0 in its group by hash order (then id), and _n, the group's rows.

    The draws' first digits deal a group into thousands of cells; a cell's first place is the sum of the counts before it, and
    only a cell's rows are sorted. So a group of any size is many tasks, and what is summed in order has one row a cell.
    """
    at = df.withColumn("_draw", draw(id_col, seed)).withColumn("_cell", F.coalesce(F.substring("_draw", 1, CELL_DIGITS), F.lit("")))
    counts = at.groupBy(F.col(group).alias("_group"), F.col("_cell").alias("_of")).agg(F.count(F.lit(1)).alias("_k"))
    every = Window.partitionBy("_group")
    before = counts.select("_group", "_of", (F.sum("_k").over(every.orderBy("_of")) - F.col("_k")).alias("_before"), F.sum("_k").over(every).alias("_n"))
    ranked = at.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_cell").orderBy("_draw", id_col)) - 1)
    joined = ranked.join(before, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_cell") == F.col("_of")))
    return joined.withColumn("_i", F.col("_before") + F.col("_r")).drop("_draw", "_cell", "_group", "_of", "_before", "_r")


def group_padded(df: DataFrame, group: str, id_col: str, batch: int, ranks: int, seed: int) -> DataFrame:
    """Rows in hash order within each group, padded by repetition to a multiple of batch * ranks, dealt in batches."""
    sized = drawn_places(df, group, id_col, seed)
    total = F.ceil(F.col("_n") / F.lit(batch * ranks)) * F.lit(batch * ranks)
    copies = F.sequence(F.lit(0), (F.floor((total - 1 - F.col("_i")) / F.col("_n"))).cast("int"))
    out = sized.withColumn("_c", F.explode(copies)).withColumn("place", F.col("_i") + F.col("_c") * F.col("_n"))
    return out.withColumn("batch", F.floor(F.col("place") / F.lit(batch))).withColumn("rank", F.pmod("batch", F.lit(ranks)).cast("int")).drop("_i", "_n", "_c")


def drop_share(df: DataFrame, id_col: str, ratio: float, seed: int) -> DataFrame:
    """int(n (1 - ratio)) rows by hash order."""
    return seeded_sample(df, id_col, int(df.count() * (1 - ratio)), seed)
