"""Lanes from a map's boundary lines, frame by frame: road curvature, lane crossings, and agents that come in or go out.

A frame holds the boundary lines around the ego vehicle at one time, each a list of points ahead. Where a line is needed at
a distance, its lateral place is interpolated there. What a frame says is worked out once a frame; runs and tracks then
look it up by the number of their frame, with equi-joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.config import DEFAULT, Thresholds
from skarn.operators import series
from skarn.tables import materialise

K = ["clip_id"]
TRACK = ["clip_id", "track_id"]


def frames(df: DataFrame, column: str = "divider_polylines") -> DataFrame:
    """(clip_id, frame_idx, lines array<array<double>>): flat lists x, y, z, ...; a list whose length is no positive multiple of three is no line."""
    return df.select("clip_id", "frame_idx", F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType)).alias("lines"))


#: Pairs of a place ahead and a line that are gone through at once.
PAIRS = 1 << 19


def _counts(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _sorted_points(lines: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, whether y is known, first point of each line and the number of points): a line's points by x, then y; those without x are no points."""
    counts, points = _counts(lines), lines.flatten()
    if pa.types.is_struct(points.type):
        fields = {points.type.field(i).name: c for i, c in enumerate(points.flatten())}
        x, y = (fields[c].to_numpy(zero_copy_only=False).astype(float) for c in "xy")
        known = pc.is_valid(fields["y"]).to_numpy(zero_copy_only=False)
    else:  # flat lists
        whole = counts % 3 == 0
        v, valid = points.to_numpy(zero_copy_only=False).astype(float), pc.is_valid(points).to_numpy(zero_copy_only=False)
        if not whole.all():
            kept = np.repeat(whole, counts)
            v, valid = v[kept], valid[kept]
        counts = np.where(whole, counts // 3, 0)
        x, y, known = v[0::3], v[1::3], valid[1::3]
    line = np.repeat(np.arange(len(counts)), counts)
    some = ~np.isnan(x)
    if not some.all():
        x, y, known, line = x[some], y[some], known[some], line[some]
        counts = np.bincount(line, minlength=len(counts))
    if ((line[1:] == line[:-1]) & ~(x[1:] > x[:-1])).any():
        order = np.lexsort((y, known, x, line))
        x, y, known = x[order], y[order], known[order]
    return x, y, known, _starts(counts)


def _interpolated(px: np.ndarray, py: np.ndarray, known: np.ndarray, start: np.ndarray, stop: np.ndarray, x: np.ndarray, reach: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(y, whether the line reaches x) for each x and the line of points [start, stop), as ``scalar.interpolated_y`` has it; by bisection."""
    lo, hi, last = start.copy(), stop.copy(), max(len(px) - 1, 0)
    if not len(px):
        return np.zeros(len(x)), np.zeros(len(x), bool)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        up = (lo < hi) & (px[np.minimum(mid, last)] <= x)
        lo, hi = np.where(up, mid + 1, lo), np.where(up, hi, np.minimum(hi, mid))
    at = lambda i: np.clip(i, 0, last)
    a, b = at(lo - 1), at(lo)
    below, above = (lo > start) & (x - px[a] < reach), (lo < stop) & (px[b] - x < reach)
    more = ((lo - 1 > start) & (x - px[at(lo - 2)] < reach)) | ((lo + 1 < stop) & (px[at(lo + 1)] - x < reach))
    held = (below | (above & (px[b] - slack <= x))) & (above | (below & (px[a] + slack >= x))) & ((below & above) | more)
    between = py[a] + (py[b] - py[a]) * (x - px[a]) / (px[b] - px[a])
    y = np.where(below & above, between, np.where(below, py[a], py[b]))
    return y, held & (~below | known[a]) & (~above | known[b])


def _met(lines: pa.ListArray, x: np.ndarray, n_x: np.ndarray, reach: float = 6.0, slack: float = 1.5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the x, place) of the lines that reach the places ahead x, of which row i has n_x[i]; by x, a row's lines in order; some at a time."""
    n_lines = _counts(lines)
    px, py, known, first = _sorted_points(lines.flatten())
    row = np.repeat(np.arange(len(n_x)), n_x)
    each, line0 = n_lines[row], _starts(n_lines)[row]
    upto, at = _starts(each), 0
    with np.errstate(all="ignore"):
        while at < len(x):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
            q = np.repeat(np.arange(at, end), each[at:end])
            of = line0[q] + np.arange(len(q)) - (upto[q] - upto[at])
            y, fine = _interpolated(px, py, known, first[of], first[of + 1], x[q], reach, slack)
            yield q[fine], y[fine]
            at = end


def _add(counts: np.ndarray, q: np.ndarray, flags: np.ndarray | None = None) -> None:
    """Count the rising numbers q, or those with a flag, where they stand."""
    if len(q):
        counts[q[0] : q[-1] + 1] += np.bincount(q - q[0], flags).astype(np.int64)


def _places(lines: pa.ListArray, xs: pa.ListArray) -> pa.ListArray:
    """Of each row and each of its x the places of the row's lines that reach it, in the lines' order."""
    n_x, x = _counts(xs), xs.flatten().to_numpy(zero_copy_only=False).astype(float)
    ys, found = [np.zeros(0)], np.zeros(len(x), np.int64)
    for q, y in _met(lines, x, n_x):
        ys.append(y)
        _add(found, q)
    inner = pa.ListArray.from_arrays(pa.array(_starts(found), pa.int32()), pa.array(np.concatenate(ys)))
    return pa.ListArray.from_arrays(pa.array(_starts(n_x), pa.int32()), inner)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def places(lines: pa.Array, xs: pa.Array) -> pa.Array:
    """For each of the distances xs the lateral places of the lines there, in the lines' order; lines that do not reach it are left out."""
    return _places(lines, xs)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def offsets(lines: pa.Array, points: pa.Array) -> pa.Array:
    """Of a row's points (x, y) that meet lines, in order, the lane offset by the lines' places there, as ``scalar.lane_offset`` has it."""
    n_x, p = _counts(points), points.flatten()
    fields = {p.type.field(i).name: c for i, c in enumerate(p.flatten())}
    x, y = (fields[c].to_numpy(zero_copy_only=False).astype(float) for c in "xy")
    y = np.where(np.isnan(y) & pc.is_valid(fields["y"]).to_numpy(zero_copy_only=False), np.inf, y)
    found, left, right = (np.zeros(len(x), np.int64) for _ in range(3))
    for q, v in _met(lines, x, n_x):
        _add(found, q)
        _add(left, q, (v > 0) & (v < y[q]))
        _add(right, q, (v < 0) & (v > y[q]))
    met = found > 0
    n = np.bincount(np.repeat(np.arange(len(n_x)), n_x)[met], minlength=len(n_x))
    return pa.ListArray.from_arrays(pa.array(_starts(n), pa.int32()), pa.array(np.where(y >= 0, left, -right)[met], pa.int32()))


def _facts(lines: pa.ListArray, at: list[float], reach: float) -> list[pa.Array]:
    """Of each row, at the first distance the nearest line within reach to the left and to the right and the number of lines not to the left, then the lines nearest the middle at the two others."""
    n, k = len(lines), len(at)
    left, right, count, some = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    mid, seen = np.zeros((n, k)), np.zeros((n, k), bool)
    for q, y in _met(lines, np.tile(np.array(at), n), np.full(n, k)):
        row, of = q // k, q % k
        here, r, v = of == 0, row[of == 0], y[of == 0]
        some[r] = True
        np.add.at(count, r, v <= 0)
        for side, fine, pick in ((left, (v > 0) & (v < reach), np.minimum), (right, (v < 0) & (v > -reach), np.maximum)):
            pick.at(side, r[fine], v[fine])
        q, y = q[~here], y[~here]
        order = np.lexsort((np.where(np.isnan(y), np.inf, np.abs(y)), q))  # the first line of equals
        q, y = q[order], y[order]
        best = np.concatenate([[True], q[1:] != q[:-1]])[: len(q)]
        mid[q[best] // k, q[best] % k], seen[q[best] // k, q[best] % k] = y[best], True
    known = [(left, np.isfinite(left)), (right, np.isfinite(right)), (count, some), *((mid[:, i], seen[:, i]) for i in range(1, k))]
    return [pa.array(v, mask=~fine) for v, fine in known]


def described(fr: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """(clip_id, frame_idx, width, tangent, right): the ego lane's width, the road's angle, and how many lines lie to the right (null without any line)."""
    at = [float(x) for x in (th.lane_ref_ahead, th.tangent_near, th.tangent_far)]
    names = ["_left", "_right", "right", "_near", "_far"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_facts(b.column(2), at, th.lane_reach)], names=["clip_id", "frame_idx", *names])

    slim = fr.select("clip_id", "frame_idx", "lines")
    made = [T.StructField(c, T.LongType() if c == "right" else T.DoubleType()) for c in names]
    there = slim.mapInArrow(run, T.StructType([*slim.schema.fields[:2], *made]))
    angle = F.degrees(F.atan2(F.col("_far") - F.col("_near"), F.lit(th.tangent_far - th.tangent_near)))  # of the line nearest the middle at either distance
    return there.select("clip_id", "frame_idx", (F.col("_left") - F.col("_right")).alias("width"), angle.alias("tangent"), F.col("right").cast("int").alias("right"))


def clips(seen: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """(clip_id, n_frames, map_valid, valid_share): a map is good where enough frames show an ego lane of likely width."""
    fine = F.count(F.when(F.col("width").between(th.lane_width_min, th.lane_width_max), 1))
    g = seen.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_frames"), fine.alias("_fine"))
    share = F.col("_fine") / F.col("n_frames")
    return g.select("clip_id", "n_frames", (share >= th.lane_valid_share).alias("map_valid"), share.alias("valid_share"))


def frame_of(t: Column, dur: Column, n: Column) -> Column:
    """The frame at a time: frames are spread evenly over the clip, half to even, held at both ends."""
    place = F.bround(t / F.greatest(dur, F.lit(1e-6)) * (n - 1), 0)
    return F.least(F.greatest(place, F.lit(0.0)), (n - 1).cast("double")).cast("int")


def road(spans: DataFrame, fr: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """(spans' keys, road_deg, lane_crossings) for spans (clip_id, kind, run, t0, t1, dur).

    road_deg is the road's angle at the last frame less that at the first; null without a good map or an angle. Crossings
    are the changes, from frame to frame that shows lines, in how many lie to the right; null without a good map. Changes
    are summed up along a clip once, so a span reads its two end frames, however long it is. Frames, clips and spans are
    shuffled, never broadcast: written frames are a few bytes each on disk and some hundred in a driver's table.
    """
    seen = materialise(described(fr, th), "frames")  # read for the clips and for the spans
    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    before = F.last("right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    change = F.coalesce((F.col("right") != before).cast("long"), F.lit(0))
    upto = seen.withColumn("_change", change).withColumn("upto", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    after = F.first(F.when(F.col("right").isNotNull(), F.col("upto")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    facts = upto.select("clip_id", "frame_idx", "tangent", "upto", after.alias("since")).hint("merge")
    known = spans.join(clips(seen, th).where("map_valid").hint("merge"), K)  # others have neither
    n = F.col("n_frames")
    placed = known.select("clip_id", "kind", "run", frame_of(F.col("t0"), F.col("dur"), n).alias("f0"), frame_of(F.col("t1"), F.col("dur"), n).alias("f1"))
    start = facts.select("clip_id", F.col("frame_idx").alias("f0"), F.col("tangent").alias("a0"), "since")
    end = facts.select("clip_id", F.col("frame_idx").alias("f1"), F.col("tangent").alias("a1"), "upto")
    both = placed.join(start, ["clip_id", "f0"], "left").join(end, ["clip_id", "f1"], "left")
    crossed = F.when(F.col("f1") <= F.col("f0"), 0).otherwise(F.greatest(F.coalesce(F.col("upto") - F.col("since"), F.lit(0)), F.lit(0)))
    return both.select("clip_id", "kind", "run", (F.col("a1") - F.col("a0")).alias("road_deg"), crossed.cast("long").alias("lane_crossings"))


def _on_frames(points: DataFrame, fr: DataFrame, durations: DataFrame, th: Thresholds) -> DataFrame:
    """Points with the lines' places _ys at their distance in the frame at their time; none where the clip has no such frame.

    A frame's points of some seconds meet its lines as one row, and lines are shuffled, never broadcast: their size on disk says little.
    """
    n = fr.groupBy("clip_id").agg(F.count(F.lit(1)).alias("_n"))
    placed = points.join(durations.select("clip_id", F.col("dur").alias("_dur")), K, "left").join(n, K, "left")
    placed = placed.withColumn("_frame", frame_of(F.col("t"), F.col("_dur"), F.col("_n")))
    own = placed.groupBy("clip_id", "_frame", F.floor(F.col("t") / th.window_sec).alias("_span")).agg(F.collect_list(F.struct(*points.columns)).alias("_p"))
    at = fr.select("clip_id", F.col("frame_idx").alias("_frame"), "lines").hint("merge")
    met = own.join(at, ["clip_id", "_frame"], "left").select("_p", places(F.col("lines"), F.transform("_p", lambda p: p["x"])).alias("_ys"))
    return met.select(F.explode(F.arrays_zip("_p", "_ys")).alias("_z")).select("_z._p.*", "_z._ys")


def side_states(points: DataFrame, fr: DataFrame, durations: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """points (clip_id, track_id, t, x, y) with state: L or R beyond the ego lane's lines by a margin, in on the ego path, else ?."""
    ys, y = F.col("_ys"), F.col("y")
    held = _on_frames(points, fr, durations, th)
    left = F.array_min(F.filter(ys, lambda v: (v > 0) & (v < th.lane_reach)))
    right = F.array_max(F.filter(ys, lambda v: (v < 0) & (v > -th.lane_reach)))
    state = (
        F.when(left.isNull() | right.isNull(), "?").when(y > left + th.crossed_margin, "L").when(y < right - th.crossed_margin, "R")
        .when((y > right) & (y < left) & (F.abs(y) < th.path_half), "in").otherwise("?")
    )
    return held.select(*points.columns, state.alias("state"))


def _straight_tracks(ahead: DataFrame, turns: DataFrame, log: DataFrame, least: int, th: Thresholds) -> DataFrame:
    """Tracks of enough points during which the ego vehicle neither turns nor changes lanes."""
    spans = ahead.groupBy(*TRACK).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    bends = turns.where(F.col("kind").isin("turn_left", "turn_right", "lane_change_left", "lane_change_right")).select("clip_id", "t0", "t1")
    degrees = log.select("clip_id", "t", F.degrees("yaw").alias("yaw"))
    return series.straight(spans, bends, degrees, K, "t", "yaw", th.straight_deg, width=th.window_sec).where("straight").select(*TRACK)


def cut_ins(points: DataFrame, fr: DataFrame, durations: DataFrame, turns: DataFrame, log: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """(clip_id, track_id, side): tracks that cross a line of the ego lane into it and stay, while the ego vehicle drives straight.

    points (clip_id, track_id, t, x, y); durations (clip_id, dur); turns: ego events; log (clip_id, t, yaw). Only tracks that do are given.
    """
    ahead = points.where((F.col("x") > 0) & (F.col("x") < th.cut_in_ahead))
    sides = series.entered_from_side(side_states(ahead, fr, durations, th), TRACK, ["t", "x", "y"], "state", th.sustain).where("side is not null")
    return sides.join(_straight_tracks(ahead, turns, log, 2 * th.sustain, th), TRACK, "left_semi")


def corridor_cut_ins(points: DataFrame, turns: DataFrame, log: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """(clip_id, track_id, side): the same without a map. The mean of the first places is beside, that of the last inside, none beyond the other side."""
    ahead = points.where((F.col("x") > 0) & (F.col("x") < th.corridor_cut_ahead))
    ends = series.head_tail(ahead, TRACK, ["t", "x", "y"], "y", th.sustain)
    reach = ahead.groupBy(*TRACK).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    a, b = F.col("head"), F.col("tail")
    inside = F.abs(b) < th.corridor_entered
    left = (a > th.corridor_adjacent) & inside & (F.col("lo") > -th.corridor_entered) & (a - b > th.corridor_approach)
    right = (a < -th.corridor_adjacent) & inside & (F.col("hi") < th.corridor_entered) & (b - a > th.corridor_approach)
    found = ends.join(reach, TRACK).withColumn("side", F.when(left, "L").when(right, "R")).where("side is not null").select(*TRACK, "side")
    return found.join(_straight_tracks(ahead, turns, log, 2 * th.sustain, th), TRACK, "left_semi")


def lane_changes(points: DataFrame, fr: DataFrame, refs: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """(clip_id, track_id, change): cut_in or cut_out by the lane offsets that one reference frame's lines give a track's points.

    refs (clip_id, ref_frame; the last frame if beyond it). Of the points ahead that meet lines there are enough, the first are all one lane beside
    (or all in the ego lane), the last all in the ego lane (or all one lane beside), and none is farther than one lane.
    """
    last = fr.groupBy("clip_id").agg((F.count(F.lit(1)) - 1).alias("_last"))
    chosen = refs.join(last, K).select("clip_id", F.least(F.col("ref_frame").cast("long"), F.col("_last")).cast("int").alias("frame_idx"))
    lines = fr.join(chosen, ["clip_id", "frame_idx"], "left_semi").select("clip_id", "lines")  # so frames are chosen before lines are made
    ahead = points.where((F.col("x") > 0) & (F.col("x") <= th.offset_ahead))
    tracks = ahead.groupBy(*TRACK).agg(F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("_p"))
    g = tracks.join(lines.hint("merge"), K).select(*TRACK, offsets("lines", "_p").alias("os"))
    g = g.where(F.size("os") >= 2 * th.sustain).select(*TRACK, F.slice("os", 1, th.sustain).alias("head"), F.slice("os", -th.sustain, th.sustain).alias("tail"), F.array_max(F.transform("os", lambda v: F.abs(v))).alias("span"))
    steady = lambda c: F.forall(c, lambda v: v == F.get(c, F.lit(0))) & (F.abs(F.get(c, F.lit(0))) == 1)
    inside = lambda c: F.forall(c, lambda v: v == 0)
    change = F.when(steady(F.col("head")) & inside(F.col("tail")), "cut_in").when(inside(F.col("head")) & steady(F.col("tail")), "cut_out")
    return g.where("span = 1").select(*TRACK, change.alias("change")).where("change is not null")
