"""Scalar functions of the domain as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def yaw(qw: Column, qx: Column, qy: Column, qz: Column) -> Column:
    return F.atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))


def wrap(angle: Column) -> Column:
    """Into [-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def heading_wrapped(angle: Column) -> Column:
    """Into [-pi, pi) by remainder."""
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def quaternion_to_matrix(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Row-major 3 x 3 rotation of a unit quaternion."""
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def matrix_to_quaternion(m: Column) -> Column:
    """(w, x, y, z) with w >= 0 of a row-major 3 x 3 rotation, magnitudes from the diagonal, signs from the rest."""
    half = lambda v: F.sqrt(F.greatest(v, F.lit(0.0))) / 2
    sign = lambda v: F.when(v < 0, -1.0).otherwise(1.0)
    w = half(1 + m[0] + m[4] + m[8])
    x = half(1 + m[0] - m[4] - m[8]) * sign(m[7] - m[5])
    y = half(1 - m[0] + m[4] - m[8]) * sign(m[2] - m[6])
    z = half(1 - m[0] - m[4] + m[8]) * sign(m[3] - m[1])
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def interpolated_y(points: Column, x: Column | float, reach: float = 6.0, slack: float = 1.5) -> Column:
    """y of a polyline (array of x, y structs) at x, linear, from points within ``reach``, held at its ends within ``slack``."""
    x = x if isinstance(x, Column) else F.lit(float(x))

    def at(near: Column) -> Column:
        lo, hi = F.array_max(F.filter(near, lambda p: p["x"] <= x)), F.array_min(F.filter(near, lambda p: p["x"] > x))
        inside = lo["y"] + (hi["y"] - lo["y"]) * (x - lo["x"]) / (hi["x"] - lo["x"])
        reached = (F.size(near) >= 2) & (F.array_min(near)["x"] - slack <= x) & (F.array_max(near)["x"] + slack >= x)
        return F.when(reached, F.when(lo.isNotNull() & hi.isNotNull(), inside).otherwise(F.coalesce(lo["y"], hi["y"])))

    return F.get(F.transform(F.array(F.filter(points, lambda p: F.abs(p["x"] - x) < reach)), at), F.lit(0))


def lane_width(ys: Column, reach: float = 6.0) -> Column:
    """Least positive less greatest negative y within ``reach``; null without both."""
    return F.array_min(F.filter(ys, lambda y: (y > 0) & (y < reach))) - F.array_max(F.filter(ys, lambda y: (y < 0) & (y > -reach)))


def lane_offset(y: Column, lines: Column) -> Column:
    """How many lines lie strictly between 0 and y; positive to the left."""
    left = F.size(F.filter(lines, lambda v: (v > 0) & (v < y)))
    return F.when(y >= 0, left).otherwise(-F.size(F.filter(lines, lambda v: (v < 0) & (v > y))))


def box_encode(cx: Column, cy: Column, cz: Column, w: Column, length: Column, h: Column, rot: Column) -> Column:
    return F.array(cx, cy, F.ln(w), F.ln(length), cz, F.ln(h), F.sin(rot), F.cos(rot))


def box_decode(b: Column) -> Column:
    return F.array(b[0], b[1], b[4], F.exp(b[2]), F.exp(b[3]), F.exp(b[5]), F.atan2(b[6], b[7]))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def smooth_l1(a: Column, b: Column, beta: float) -> Column:
    one = lambda d: F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)
    return F.aggregate(F.zip_with(a, b, lambda x, y: one(F.abs(x - y))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def rodrigues(rx: Column, ry: Column, rz: Column, t: Column) -> Column:
    """Row-major rotation after time t at the angular velocity (rx, ry, rz)."""
    n = F.sqrt(rx * rx + ry * ry + rz * rz)
    s = F.coalesce(F.nullif(n, F.lit(0.0)), F.lit(1.0))
    x, y, z, a = rx / s, ry / s, rz / s, n * t
    c, d, v = F.cos(a), F.sin(a), 1 - F.cos(a)
    return F.array(
        c + x * x * v, x * y * v - z * d, x * z * v + y * d,
        y * x * v + z * d, c + y * y * v, y * z * v - x * d,
        z * x * v - y * d, z * y * v + x * d, c + z * z * v,
    )


def first_keyword(text: Column, groups: dict[str, list[str]], prefix: str) -> Column:
    """The first group, in order, one of whose patterns the lower-cased text matches."""
    out = F.lit(None).cast("string")
    for code, patterns in reversed(groups.items()):
        out = F.when(F.lower(text).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(f"{prefix}:{code}")).otherwise(out)
    return out


def has_cjk(text: Column) -> Column:
    """Kana or unified ideographs."""
    return F.coalesce(text, F.lit("")).rlike("[\\u3040-\\u30ff\\u4e00-\\u9fff]")


def answer_of(text: Column) -> Column:
    """What stands between answer tags, else after the last thinking end tag, else all; trimmed."""
    tagged = F.regexp_extract(text, r"(?s)<answer>(.*?)</answer>", 1)
    rest = F.regexp_replace(text, r"(?s)^.*</think>", "")
    return F.trim(F.when(tagged != "", tagged).otherwise(rest))


def parsed(text: Column, schema: T.StructType | str) -> Column:
    """JSON or null."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def content_hash(*fields: Column) -> Column:
    """sha256 of the fields as JSON in the given, fixed order."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def ambiguous(detail: Column, marks: tuple[float, ...] = (45.0, 22.0), margin: float = 10.0) -> Column:
    """Whether the raw figure in a detail lies within ``margin`` of a mark."""
    raw = F.try_to_number(F.nullif(F.regexp_extract(detail, r"raw=(-?\d+)", 1), F.lit("")), F.lit("S999999999"))
    near = F.lit(False)
    for m in marks:
        near = near | (F.abs(F.abs(raw.cast("double")) - m) <= margin)
    return F.coalesce(near, F.lit(False))


def scaled_intrinsics(k: Column, scale: float) -> Column:
    """Focal lengths and centre (fx, fy, cx, cy) of a scaled image; the distortion that follows them stays."""
    return F.transform(k, lambda x, i: F.when(i < 4, x * F.lit(scale)).otherwise(x))


def rotate2d(x: Column, y: Column, angle: Column) -> Column:
    return F.struct((x * F.cos(angle) - y * F.sin(angle)).alias("x"), (x * F.sin(angle) + y * F.cos(angle)).alias("y"))


def seeded_uniform(id_col: Column, seed: int, lo: float, hi: float) -> Column:
    """A repeatable draw from [lo, hi) for each id, by a hash that every engine has."""
    digits = F.substring(F.md5(F.concat_ws(":", id_col.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8)
    return F.lit(float(lo)) + F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32)) * F.lit(float(hi - lo))


def augmented(x: Column, y: Column, z: Column, flip_x: Column, flip_y: Column, angle: Column, scale: Column, shift: tuple[Column, Column, Column]) -> Column:
    """A point mirrored (flip_x negates x, flip_y negates y), then turned about the vertical, scaled and moved."""
    turned = rotate2d(F.when(flip_x, -x).otherwise(x), F.when(flip_y, -y).otherwise(y), angle)
    return F.struct(*((v * scale + s).alias(n) for n, v, s in zip("xyz", (turned["x"], turned["y"], z), shift, strict=True)))


def seconds(us: Column, origin: Column) -> Column:
    return (us - origin) / F.lit(1e6)
