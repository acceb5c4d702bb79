"""Writers of the formats the engine gives out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def canonical(df: DataFrame, columns: list[str]) -> Column:
    """A row as JSON with keys in alphabetical order, nulls written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """One canonical JSON object a line, in folders by the partition columns."""
    body = [c for c in df.columns if c not in partition_by]
    df.select(*partition_by, canonical(df, body).alias("value")).write.mode("overwrite").partitionBy(*partition_by).text(path)


def write_sorted(df: DataFrame, path: str, by: list[str]) -> None:
    df.orderBy(*by).write.mode("overwrite").json(path)


def pending(df: DataFrame, done: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """The rows whose output does not exist yet."""
    return df if overwrite else df.join(done.select(key).distinct(), key, "left_anti")


def manifest(frames: DataFrame, meta: dict[str, str], split: str, order: list[str]) -> DataFrame:
    """(split, doc): per split one JSON of meta and ordered frames."""
    body = [c for c in frames.columns if c != split]
    rows = F.array_sort(F.collect_list(F.struct(*order, *(c for c in body if c not in order))))
    head = F.struct(*(F.lit(v).alias(k) for k, v in sorted(meta.items())))
    return frames.groupBy(split).agg(F.to_json(F.struct(rows.alias("frames"), head.alias("meta"))).alias("doc"))


def colmap_images(df: DataFrame, image_id: str, camera_id: str, name: str, quaternion: list[str], shift: list[str]) -> DataFrame:
    """Lines "id qw qx qy qz tx ty tz camera name" and an empty line of points."""
    fmt = "%d " + " ".join(["%.9f"] * 7) + " %d %s\n"
    return df.select(F.format_string(fmt, F.col(image_id), *(F.col(c) for c in [*quaternion, *shift]), F.col(camera_id), F.col(name)).alias("value"))


def colmap_cameras(df: DataFrame, camera_id: str, width: str, height: str, intrinsics: str) -> DataFrame:
    """Lines "id FULL_OPENCV width height" and twelve parameters: fx fy cx cy k1 k2 p1 p2 k3 and three zeros; missing ones are zero."""
    given = [F.coalesce(F.get(intrinsics, F.lit(i)), F.lit(0.0)) for i in range(9)]
    fmt = "%d FULL_OPENCV %d %d " + " ".join(["%.9f"] * 12)
    return df.select(F.format_string(fmt, F.col(camera_id), F.col(width), F.col(height), *given, *(F.lit(0.0) for _ in range(3))).alias("value"))


def kitti_line(df: DataFrame, precision: int = 4, keep: tuple[str, ...] = ("image",)) -> DataFrame:
    """Result lines; missing fields take their defaults. Columns of ``keep`` stay."""
    number = f"%.{precision}f"
    d = lambda c, v: F.format_string(number, F.coalesce(F.col(c).cast("double"), F.lit(v))) if c in df.columns else F.lit(number % v)
    array = lambda c, n, v: [F.format_string(number, F.coalesce(F.get(c, F.lit(i)), F.lit(v))) for i in range(n)]
    length, height, width = array("dimensions", 3, -1.0)
    parts = [F.col("name"), d("truncated", -1.0), F.coalesce(F.col("occluded"), F.lit(-1)).cast("string"), d("alpha", -10.0), *array("bbox", 4, -1.0), height, width, length, *array("location", 3, -1000.0), d("rotation_y", -10.0), d("score", 0.0)]
    return df.select(*[c for c in df.columns if c in keep], F.concat_ws(" ", *parts).alias("value"))


def label_files(df: DataFrame, image: str, line: str, pos: str) -> DataFrame:
    """(image, body): one file's lines in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(pos, line))), lambda x: x[line])
    return df.groupBy(image).agg(F.array_join(lines, "\n").alias("body"))


def markdown_table(df: DataFrame, order: list[str]) -> DataFrame:
    """(pos, line): the rows, which should be few, as a Markdown table in order; pipes are escaped, nulls are empty."""
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    cells = [F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    rows = df.select((F.row_number().over(Window.orderBy(*order)) + 1).cast("long").alias("pos"), bar(cells).alias("line"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "-|" * len(df.columns))], "pos long, line string")
    return head.unionByName(rows)


def combine(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The rows of several result files as one table."""
    return spark.read.schema(schema).json(paths)
