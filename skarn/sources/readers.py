"""Readers of the formats the engine takes in; every path may be in any store Spark reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.operators import ranking
from skarn.sources.binary import framed_records, ply_points, points  # noqa: F401 - part of the readers


def id_lines(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a split file: trimmed lines, blank ones dropped."""
    return spark.read.text(path).select(F.trim("value").alias("clip_id")).where("clip_id <> ''")


def ordered_ids(df: DataFrame, id_col: str, pos: str) -> DataFrame:
    """Distinct ids with the place of their first appearance."""
    return df.groupBy(id_col).agg(F.min(pos).alias("pos"))


def resolve(df: DataFrame, *names: str) -> Column:
    """The first of several column names that a table has."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    raise ValueError(f"none of {names} in {df.columns}")


def tracks(spark: SparkSession, path: str, min_points: int = 4) -> DataFrame:
    """(clip_id, track_id, class_name, frame_idx, x, y, yaw): observed points with a box, of tracks that have enough."""
    t = spark.read.parquet(path)
    seen = F.col("is_observed") if "is_observed" in t.columns else F.transform("frame_indices", lambda _: F.lit(True))
    zipped = F.arrays_zip(F.col("frame_indices").alias("f"), F.col("boxes_3d").alias("b"), seen.alias("o"))
    rows = t.select("clip_id", "track_id", "class_name", F.explode(zipped).alias("p")).where("coalesce(p.o, true) and p.b is not null")
    points = rows.select("clip_id", "track_id", "class_name", F.col("p.f").alias("frame_idx"), F.col("p.b")[0].alias("x"), F.col("p.b")[1].alias("y"), F.get("p.b", F.lit(6)).alias("yaw"))
    enough = points.groupBy("clip_id", "track_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points)
    return points.join(enough.drop("n"), ["clip_id", "track_id"], "left_semi")


def frame_objects(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, frame_idx, track_id, cls, x, y) from list columns."""
    t = spark.read.parquet(path)
    zipped = F.arrays_zip(F.col("obj_ids").alias("i"), F.col("classes").alias("c"), F.col("boxes_3d").alias("b"))
    rows = t.select("clip_id", "frame_idx", F.explode(zipped).alias("o"))
    return rows.select("clip_id", "frame_idx", F.col("o.i").alias("track_id"), F.col("o.c").alias("cls"), F.col("o.b")[0].alias("x"), F.col("o.b")[1].alias("y"))


def polylines(df: DataFrame, column: str = "divider_polylines") -> DataFrame:
    """(…, line, points array<struct<x,y,z>>): flat lists whose length is a positive multiple of three."""
    rest = [c for c in df.columns if c != column]
    lines = df.select(*rest, F.posexplode(column).alias("line", "flat")).where("size(flat) > 0 and size(flat) % 3 = 0")
    at = F.sequence(F.lit(0), F.size("flat") - 1, F.lit(3))
    points = F.transform(at, lambda i: F.struct(F.get("flat", i).alias("x"), F.get("flat", i + 1).alias("y"), F.get("flat", i + 2).alias("z")))
    return lines.select(*rest, "line", points.alias("points"))


def frame_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("clip_id", "frame_idx")


def layout(ids: DataFrame, index: DataFrame, key: str = "clip_id") -> DataFrame:
    """Whether each id has an index: "gallery" or "video"."""
    return ids.join(index.select(key).distinct().withColumn("_g", F.lit("gallery")), key, "left").withColumn("layout", F.coalesce("_g", F.lit("video"))).drop("_g")


def first_source(sources: list[DataFrame], key: str, out: str = "source") -> DataFrame:
    """Each key's rows from the first of the sources, all of one schema, that has any; ``out`` is that source's place."""
    tagged = [s.withColumn(out, F.lit(i)) for i, s in enumerate(sources)]
    every = reduce(DataFrame.unionByName, tagged)
    first = reduce(DataFrame.unionByName, (t.select(key, out) for t in tagged)).groupBy(key).agg(F.min(out).alias("_first"))
    return every.join(first, key).where(F.col(out) == F.col("_first")).drop("_first")


def folder_groups(paths: DataFrame, path: str = "path") -> DataFrame:
    """(condition, clip_id) from paths .../condition/clip.ext."""
    parts = F.split(F.col(path), "/")
    return paths.select(F.element_at(parts, -2).alias("condition"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("clip_id"))


def clip_path(root: str, clip_id: Column, leaf: str) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), clip_id, F.lit(leaf))


def kitti_labels(lines: DataFrame, image: str = "image", line: str = "value", pos: str = "pos") -> DataFrame:
    """Labels of 15 or 16 fields; sizes h w l become l, h, w; the index counts what is cared for, -1 for the rest."""
    f = F.split(F.trim(line), r"\s+")
    d = lambda i: F.get(f, F.lit(i)).cast("double")
    out = lines.where(F.size(f) >= 15).select(
        image,
        pos,
        F.get(f, F.lit(0)).alias("name"),
        d(1).alias("truncated"),
        d(2).cast("int").alias("occluded"),
        d(3).alias("alpha"),
        F.array(*(d(i) for i in range(4, 8))).alias("bbox"),
        F.array(d(10), d(8), d(9)).alias("dimensions"),
        F.array(*(d(i) for i in range(11, 14))).alias("location"),
        d(14).alias("rotation_y"),
        F.coalesce(d(15), F.lit(0.0)).alias("score"),
    )
    cared = F.sum(F.when(F.col("name") != "DontCare", 1).otherwise(0)).over(Window.partitionBy(image).orderBy(pos))
    return out.withColumn("index", F.when(F.col("name") == "DontCare", -1).otherwise(cared - 1).cast("int"))


def kitti_calibration(lines: DataFrame, image: str = "image", line: str = "value") -> DataFrame:
    """(image, name, values array<double>) of "name: v v v" lines."""
    kv = F.split(line, ":", 2)
    values = F.transform(F.split(F.trim(F.get(kv, F.lit(1))), r"\s+"), lambda x: x.cast("double"))
    return lines.where(F.col(line).contains(":")).select(image, F.trim(F.get(kv, F.lit(0))).alias("name"), values.alias("values"))


POSE = (
    "frame_idx int, timestamp double, ego_velocity struct<linear:array<double>,angular:array<double>>, "
    "cameras map<string, struct<img_path:string,width:int,height:int,intrinsics:array<double>,pose:array<double>,"
    "rolling_shutter:struct<duration:double,trigger_time:double>>>"
)


def pose_frames(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row a frame and camera; a missing velocity is zero, a missing shutter (0.033, 0.0)."""
    raw = spark.read.schema(POSE).option("multiLine", multi_line).json(path)
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    rows = raw.select("frame_idx", "timestamp", "ego_velocity", F.explode("cameras").alias("camera", "c"))
    return rows.select(
        "frame_idx", "timestamp", "camera", "c.img_path", "c.width", "c.height", "c.intrinsics", "c.pose",
        F.coalesce("ego_velocity.linear", zero).alias("linear"), F.coalesce("ego_velocity.angular", zero).alias("angular"),
        F.coalesce("c.rolling_shutter.duration", F.lit(0.033)).alias("shutter"), F.coalesce("c.rolling_shutter.trigger_time", F.lit(0.0)).alias("trigger"),
    )


def epoch_logs(spark: SparkSession, path: str, schema: str = "epoch int, iter int, mode string, time double, loss double") -> DataFrame:
    """Training log lines; those without an epoch are headers."""
    return spark.read.schema(schema).json(path).where("epoch is not null")


def complete_items(df: DataFrame, item: str, part: str, n: int) -> DataFrame:
    """Items that have all n parts."""
    return df.groupBy(item).agg(F.count_distinct(part).alias("n_parts")).where(F.col("n_parts") == n).select(item)


def image_key(name: Column, cameras: list[str]) -> Column:
    """(base, camera) of a stem that ends in a known camera's name, the longest that fits."""
    pattern = "|".join(sorted(cameras, key=len, reverse=True))
    return F.struct(F.regexp_extract(name, f"^(.*)_({pattern})$", 1).alias("base"), F.regexp_extract(name, f"^(.*)_({pattern})$", 2).alias("camera"))


def image_join(names: DataFrame, stem: str, cameras: list[str], poses: DataFrame) -> DataFrame:
    """Image names with their frame's camera from ``poses`` (base, camera, others); what names no known camera is left out."""
    keyed = names.withColumn("_k", image_key(F.col(stem), cameras)).where("_k.camera <> ''")
    return keyed.select("*", F.col("_k.base").alias("base"), F.col("_k.camera").alias("camera")).drop("_k").join(poses, ["base", "camera"])


def scene_items(scenes: DataFrame, samples: DataFrame, images: DataFrame, cameras: list[str], every: int = 1) -> DataFrame:
    """(item, scene, sample_idx, sample, camera, image, missing): the samples of the scenes in order, times the wanted cameras.

    scenes (pos, scene, n_samples), in the split's order; samples (scene, sample_idx, sample), idx from 0; images (sample, camera,
    image). Only idx below n_samples and divisible by ``every`` count. An item numbers what is there, from 0, by (pos, idx, place of
    the camera in ``cameras``); a camera that a sample lacks gives a row without a number, marked missing. A scene named twice counts twice.
    """
    wanted = samples.join(scenes, "scene").where((F.col("sample_idx") < F.col("n_samples")) & (F.pmod("sample_idx", F.lit(every)) == 0))
    grid = wanted.select("*", F.posexplode(F.array(*(F.lit(c) for c in cameras))).alias("_camera", "camera"))
    found = grid.join(images, ["sample", "camera"], "left").withColumn("missing", F.col("image").isNull())
    there = ranking.numbered_all(found.where("not missing").withColumn("_key", F.struct("pos", "sample_idx", "_camera", "image")), "_key", "item")
    fields = ["item", "scene", "sample_idx", "sample", "camera", "image", "missing"]
    return there.select(*fields).unionByName(found.where("missing").withColumn("item", F.lit(None).cast("long")).select(*fields))


def frame_infos(frames: DataFrame, parts: dict[str, DataFrame], key: str = "idx", cloud: str = "cloud", most: int = 5) -> DataFrame:
    """One row a frame: its own columns, those of each part as a struct named like the part, and sweeps, the clouds right before it.

    frames (key long, cloud: struct of what a sweep tells, null where a frame has none, others); parts (key, others), one row a
    frame at most; a part that a frame lacks is null and named in ``absent``. sweeps has up to ``most`` clouds of the keys before,
    nearest first, ended by the first key that has none. Each cloud is sent to the keys behind it: no order of all frames is needed.
    """
    sent = frames.where(F.col(cloud).isNotNull()).select(F.col(key).alias("_k"), F.col(cloud).alias("_c"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("_j"))
    got = sent.select((F.col("_k") + F.col("_j")).alias(key), "_j", "_c").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_j", "_c"))).alias("_s"))
    unbroken = F.filter("_s", lambda x, i: x["_j"] == i + 1)
    out = frames.join(got.select(key, F.transform(unbroken, lambda x: x["_c"]).alias("sweeps")), key, "left")
    out = out.withColumn("sweeps", F.coalesce("sweeps", F.array().cast(out.schema["sweeps"].dataType)))
    for name, part in parts.items():
        packed = part.select(key, F.struct(*(c for c in part.columns if c != key)).alias(name))
        out = out.join(packed, key, "left")
    return out.withColumn("absent", F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in parts))))


def repeated(df: DataFrame, times: int, out: str = "epoch_part") -> DataFrame:
    """Every row ``times`` times, with the number of the repetition: a data set that is gone through several times an epoch."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
