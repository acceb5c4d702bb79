"""Transforms, projections and per-cell reductions as expressions and keyed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matmul(a: Column, b: Column, n: int = 4) -> Column:
    """Product of two row-major n x n arrays."""
    cell = lambda i, j: sum((a[i * n + k] * b[k * n + j] for k in range(1, n)), a[i * n] * b[j])
    return F.array(*(cell(i, j) for i in range(n) for j in range(n)))


def rigid_inverse(m: Column) -> Column:
    """Inverse of a row-major rigid 4 x 4 transform: transposed rotation, and the shift turned back."""
    rows = []
    for i in range(3):
        rows += [m[i], m[4 + i], m[8 + i], -(m[i] * m[3] + m[4 + i] * m[7] + m[8 + i] * m[11])]
    return F.array(*rows, *(F.lit(float(x)) for x in (0, 0, 0, 1)))


def transform_point(m: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(*((m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3]).alias(c) for i, c in enumerate("xyz")))


def relative_to_first(df: DataFrame, keys: list[str], order: list[str], pose: str, out: str) -> DataFrame:
    """Poses in the frame of the key's first pose."""
    first = F.first(pose).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_f", first).withColumn("_i", rigid_inverse(F.col("_f"))).withColumn(out, matmul(F.col("_i"), F.col(pose))).drop("_f", "_i")


def box_corners(df: DataFrame, x: Column, y: Column, z: Column, length: Column, width: Column, height: Column, yaw: Column) -> DataFrame:
    """Eight rows a box: its corners turned by yaw, with the place 0..7."""
    signs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (1, -1) for b in (1, -1) for c in (1, -1)))
    out = df.select("*", F.posexplode(signs).alias("corner", "_s"))
    dx, dy = F.col("_s.a") * length / 2, F.col("_s.b") * width / 2
    return out.select(
        *df.columns,
        "corner",
        (x + F.cos(yaw) * dx - F.sin(yaw) * dy).alias("cx"),
        (y + F.sin(yaw) * dx + F.cos(yaw) * dy).alias("cy"),
        (z + F.col("_s.c") * height / 2).alias("cz"),
    ).drop("_s")


def project(x: Column, y: Column, z: Column, fx, fy, cx, cy, k=(0.0, 0.0, 0.0, 0.0, 0.0), min_z: float = 0.1) -> Column:
    """Pinhole with radial (k1, k2, k3) and tangential (p1, p2) distortion given as (k1, k2, p1, p2, k3); null behind ``min_z``."""
    k1, k2, p1, p2, k3 = (F.lit(v) for v in k)
    a, b = x / F.nullif(z, F.lit(0.0)), y / F.nullif(z, F.lit(0.0))
    r2 = a * a + b * b
    radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    u = a * radial + 2 * p1 * a * b + p2 * (r2 + 2 * a * a)
    v = b * radial + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b
    return F.when(z > min_z, F.struct((F.lit(fx) * u + F.lit(cx)).alias("u"), (F.lit(fy) * v + F.lit(cy)).alias("v"), z.alias("depth")))


def back_project(u: Column, v: Column, z: Column, fx, fy, cx, cy) -> Column:
    return F.struct(((u - cx) * z / fx).alias("x"), ((v - cy) * z / fy).alias("y"), z.alias("z"))


def in_image(u: Column, v: Column, width, height) -> Column:
    return (u >= 0) & (u < width) & (v >= 0) & (v < height)


def range_to_xyz(r: Column, azimuth: Column, inclination: Column) -> Column:
    """Spherical range image cells to points; ranges of 0 or less give null."""
    flat = r * F.cos(inclination)
    return F.when(r > 0, F.struct((flat * F.cos(azimuth)).alias("x"), (flat * F.sin(azimuth)).alias("y"), (r * F.sin(inclination)).alias("z")))


def pixel_mean(df: DataFrame, keys: list[str], u: Column, v: Column, depth: str) -> DataFrame:
    """Mean depth of the points on each pixel."""
    return df.withColumns({"u": F.floor(u), "v": F.floor(v)}).groupBy(*keys, "u", "v").agg(F.avg(depth).alias("depth"), F.count(F.lit(1)).alias("n"))


def z_buffer(df: DataFrame, keys: list[str], u: Column, v: Column, depth: str, carry: str, tie: str) -> DataFrame:
    """The nearest point of each pixel with its carried value."""
    return df.withColumns({"u": F.floor(u), "v": F.floor(v)}).groupBy(*keys, "u", "v").agg(F.min(depth).alias("depth"), F.min_by(carry, F.struct(depth, tie)).alias(carry))


def depth_mm(meters: Column) -> Column:
    """Metres to unsigned 16-bit millimetres, clipped."""
    return F.least(F.greatest(F.floor(meters * 1000), F.lit(0)), F.lit(65535)).cast("int")


def voxel_mean(df: DataFrame, keys: list[str], columns: list[str], size: float) -> DataFrame:
    cells = {f"v_{c}": F.floor(F.col(c) / F.lit(size)) for c in columns}
    return df.withColumns(cells).groupBy(*keys, *cells).agg(*(F.avg(c).alias(c) for c in columns), F.count(F.lit(1)).alias("n"))


def merged_depth(lidar: Column, zbuf: Column, zbuf_lidar: Column, guide: Column, method: Column, hole: Column) -> Column:
    """Depth by priority: lidar, a z-buffer that comes from lidar, a guide of a known method outside holes; clipped to 16 bits."""
    guided = F.when(method.isin("mono_lidar", "mono_only", "ransac") & (F.coalesce(hole, F.lit(0)) == 0), guide)
    some = F.coalesce(F.when(lidar > 0, lidar), F.when((zbuf > 0) & zbuf_lidar, zbuf), guided, F.lit(0))
    return F.least(F.greatest(some, F.lit(0)), F.lit(65535))


def confidence_map(dynamic: Column, filled: Column, from_lidar: Column, method: Column, ai: Column) -> Column:
    """255 static; 224 or 32 filled by accumulation; 160, 128, 96, 0 by method; at most 64 where generated."""
    by_method = F.when(method == "mono_lidar", 160).when(method == "mono_only", 128).when(method == "ransac", 96).otherwise(0)
    own = F.when(~dynamic, 255).when(filled, F.when(from_lidar, 224).otherwise(32)).otherwise(by_method)
    return F.when(ai, F.least(own, F.lit(64))).otherwise(own)
