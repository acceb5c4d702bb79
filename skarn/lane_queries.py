"""Queries of lane geometry, cut-ins and causes over carriers in which each branch occurs; their SQL follows the rules' text, not the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.config import Thresholds
from skarn.more_queries import EGO, EGO_NET, LOG, _ego, _log
from skarn.operators import series
from skarn.plans import lanes, scenario
from skarn.queries import EV, U, events, query, r6

# --- carriers: a frame of lines for each row of the log, and nine kinds of track ------------------------------------

BASES, AHEAD = [5.25, 1.75, -1.75, -5.25], [-2.0, 3.0, 6.0, 9.0, 12.0, 16.0, 19.0, 23.0, 26.0, 29.0, 33.0, 37.0]


def _map_frames(spark: SparkSession, d: str) -> DataFrame:
    """Lines that shift in some clips, so that they are crossed, bend in others, or are too far apart; a short line, one that is none, frames and clips without."""
    log, i, u = _log(spark, d), F.col("i"), F.col("user_id")
    shift = F.when(u % 5 == 1, (i % 12) * F.lit(0.4)).otherwise(0.0)
    bend = F.when(u % 2 == 0, (i % 9 - 4) * F.lit(0.002)).otherwise(0.0)
    apart = F.when(u % 4 == 3, 2.0).otherwise(1.0)
    line = lambda base, at: F.array(*(v for x in at for v in (F.lit(x), F.lit(base) * apart - shift + bend * F.lit(x * x), F.lit(0.0))))
    lines = F.array(*(line(b, AHEAD) for b in BASES), line(0.4, [3.0, 6.0]), F.array(*(F.lit(float(v)) for v in (1, 2, 3, 4))))
    shown = log.where(u % 11 > 0).select("clip_id", i.alias("frame_idx"), F.when(i % 10 == 7, F.array().cast("array<array<double>>")).otherwise(lines).alias("divider_polylines"))
    return lanes.frames(shown)


#: The same as points of lines; a line has its points' distances px and places py.
LINES = f"""fr AS (SELECT clip_id, user_id, i FROM log WHERE user_id % 11 > 0),
 ln AS (SELECT *, CASE WHEN user_id % 5 = 1 THEN (i % 12) * 0.4::DOUBLE ELSE 0 END AS sh, CASE WHEN user_id % 2 = 0 THEN (i % 9 - 4) * 0.002::DOUBLE ELSE 0 END AS c,
 CASE WHEN user_id % 4 = 3 THEN 2.0 ELSE 1.0 END::DOUBLE AS apart FROM fr WHERE i % 10 <> 7),
 pts AS (SELECT clip_id, i, l, px, b * apart - sh + c * px * px AS py FROM ln, (SELECT unnest({BASES})::DOUBLE AS b, unnest([0, 1, 2, 3]) AS l), (SELECT unnest({AHEAD})::DOUBLE AS px)
 UNION ALL SELECT clip_id, i, 4, px, 0.4::DOUBLE * apart - sh + c * px * px FROM ln, (VALUES (3.0::DOUBLE), (6.0::DOUBLE)) x(px)),
 n AS (SELECT clip_id, count(*) AS n FROM fr GROUP BY clip_id)"""


def _at(name: str, source: str, key: str) -> str:
    """SQL of the lines' places: ``source`` has clip_id, frame and a distance x; key names its row."""
    return f"""{name} AS (SELECT {key}, s.x AS x, l, CASE WHEN count(*) FILTER (px <= s.x) = 0 THEN arg_min(py, px) WHEN count(*) FILTER (px > s.x) = 0 THEN arg_max(py, px)
 ELSE arg_max(py, px) FILTER (px <= s.x) + (arg_min(py, px) FILTER (px > s.x) - arg_max(py, px) FILTER (px <= s.x)) * (s.x - max(px) FILTER (px <= s.x)) / (min(px) FILTER (px > s.x) - max(px) FILTER (px <= s.x)) END AS y
 FROM {source} s JOIN pts ON pts.clip_id = s.clip_id AND pts.i = s.frame AND abs(px - s.x) < 6 GROUP BY {key}, s.x, l HAVING count(*) >= 2 AND min(px) - 1.5 <= s.x AND max(px) + 1.5 >= s.x)"""


#: What each frame says: the lane's width, the road's angle, and how many lines lie to the right.
FACTS = f"""{LINES}, ask AS (SELECT clip_id, i AS frame, unnest([5.0, 8.0, 30.0])::DOUBLE AS x FROM fr), {_at("ys", "ask", "s.clip_id, s.frame")},
 facts AS (SELECT fr.clip_id, fr.i, min(y) FILTER (x = 8 AND y > 0 AND y < 6) - max(y) FILTER (x = 8 AND y < 0 AND y > -6) AS width,
 degrees(atan2(arg_min(y, (abs(y), l)) FILTER (x = 30) - arg_min(y, (abs(y), l)) FILTER (x = 5), 25)) AS tangent,
 CASE WHEN count(*) FILTER (x = 8) > 0 THEN count(*) FILTER (x = 8 AND y <= 0) END AS r FROM fr LEFT JOIN ys ON ys.clip_id = fr.clip_id AND ys.frame = fr.i GROUP BY 1, 2),
 good AS (SELECT clip_id, count(*) AS n, count(*) FILTER (width BETWEEN 2.5 AND 4.5) / count(*) AS share FROM facts GROUP BY clip_id)"""


@query(f"WITH {LOG}, {FACTS} SELECT clip_id, i AS frame_idx, round(width, 6) AS width, round(tangent, 6) + 0.0 AS tangent, r AS n_right FROM facts")
def lane_frames(spark: SparkSession, d: str) -> DataFrame:
    seen = lanes.described(_map_frames(spark, d))
    return seen.select("clip_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.round("width", 6).alias("width"), r6("tangent"), F.col("right").cast("long").alias("n_right"))


@query(f"WITH {LOG}, {FACTS} SELECT clip_id, n AS n_frames, share >= 0.5 AS map_valid, round(share, 4) AS share FROM good")
def lane_maps(spark: SparkSession, d: str) -> DataFrame:
    c = lanes.clips(lanes.described(_map_frames(spark, d)))
    return c.select("clip_id", "n_frames", "map_valid", F.round("valid_share", 4).alias("share"))


@query(f"""WITH {EGO_NET}, {FACTS}, spans AS (SELECT net.*, n, round_even(t0 / greatest(dur, 1e-6) * (n - 1), 0)::INT AS f0, round_even(t1 / greatest(dur, 1e-6) * (n - 1), 0)::INT AS f1
 FROM net JOIN (SELECT clip_id, max(dur) AS dur FROM ego GROUP BY 1) USING (clip_id) LEFT JOIN good ON good.clip_id = net.clip_id AND share >= 0.5),
 inside AS (SELECT s.clip_id, s.t0, r <> lag(r) OVER (PARTITION BY s.clip_id, s.t0 ORDER BY i) AS c FROM spans s JOIN facts f ON f.clip_id = s.clip_id AND f.i BETWEEN s.f0 AND s.f1 WHERE r IS NOT NULL),
 crossed AS (SELECT clip_id, t0, count(*) FILTER (c) AS n_crossed FROM inside GROUP BY 1, 2),
 bent AS (SELECT s.*, b.tangent - a.tangent AS road, CASE WHEN n IS NOT NULL THEN CASE WHEN f1 <= f0 THEN 0 ELSE coalesce(n_crossed, 0) END END AS lane_crossings
 FROM spans s LEFT JOIN facts a ON a.clip_id = s.clip_id AND a.i = s.f0 LEFT JOIN facts b ON b.clip_id = s.clip_id AND b.i = s.f1 LEFT JOIN crossed c ON c.clip_id = s.clip_id AND c.t0 = s.t0),
 fixed AS (SELECT *, net - coalesce(road, 0) AS left_over, CASE WHEN road IS NULL THEN 'none' ELSE 'map' END AS source FROM bent),
 found AS (SELECT clip_id, kind, t0, t1, NULL::VARCHAR AS source, NULL::BIGINT AS lane_crossings FROM runs WHERE kind <> 'turn' UNION ALL SELECT * FROM (
 SELECT clip_id, CASE WHEN left_over >= 45 THEN 'turn_left' WHEN left_over <= -45 THEN 'turn_right' WHEN abs(left_over) <= 22 AND lat BETWEEN 1.8 AND 6 THEN 'lane_change_left'
 WHEN abs(left_over) <= 22 AND lat BETWEEN -6 AND -1.8 THEN 'lane_change_right' END AS kind, t0, t1, source, lane_crossings FROM fixed) WHERE kind IS NOT NULL),
 steps AS (SELECT *, CASE WHEN t0 - max(t1) OVER (PARTITION BY clip_id, kind ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0.6 THEN 0 ELSE 1 END AS new FROM found),
 grouped AS (SELECT *, sum(new) OVER (PARTITION BY clip_id, kind ORDER BY t0, t1) AS g FROM steps)
 SELECT clip_id, kind, round_even(min(t0), 2) AS t0, round_even(max(t1), 2) AS t1, round_even((min(t0) + max(t1)) / 2, 2) AS center,
 first(source ORDER BY t0, t1) AS curvature_correction_source, first(lane_crossings ORDER BY t0, t1) AS lane_crossings FROM grouped GROUP BY clip_id, kind, g""")
def ego_map_chain(spark: SparkSession, d: str) -> DataFrame:
    """Ego events with the road's part taken off, where the map is good."""
    return scenario.ego_events(_ego(spark, d), frames=_map_frames(spark, d))


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    """Three tracks a clip, four points a log row: in from either side, with a blind spot, through to the other side, out, too late, too far, or never."""
    log, q, u = _log(spark, d), F.col("q"), F.col("user_id")
    p = log.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    p = p.withColumn("q", F.col("i") * 4 + F.col("j")).withColumn("kind", F.pmod(u + F.col("k"), F.lit(9)))
    side: dict[int, Column] = {
        0: F.when(q < 5, 3.5).when(q < 7, 1.9).otherwise(0.5),
        1: F.when(q < 6, 3.5).otherwise(0.5),
        2: F.when(q < 6, -3.5).otherwise(-0.5),
        3: F.when(q < 6, 3.5).when(q < 13, 0.5).otherwise(-3.5),
        4: F.lit(0.0),
        5: F.when((q < 6) | (q % 5 == 0), 3.5).otherwise(0.5),
        6: F.when(q < 2, 3.5).otherwise(0.5),
        7: F.when(q < 6, 0.2).otherwise(-3.5),
        8: F.when(q < 6, 7.0).otherwise(0.5),
    }
    y = F.lit(None).cast("double")
    for k, v in side.items():
        y = F.when(F.col("kind") == k, v.cast("double")).otherwise(y)
    return p.select("clip_id", F.concat(F.lit("t"), F.col("k").cast("string")).alias("track_id"), (F.col("t") + F.col("j") * F.lit(0.125)).alias("t"), (5 + F.col("value") % 42).alias("x"), y.alias("y"))


TRACKS = """tr AS (SELECT clip_id, 't' || k AS track_id, t + j * 0.125::DOUBLE AS t, 5 + value % 42 AS x, (CASE (user_id + k) % 9
 WHEN 0 THEN CASE WHEN i * 4 + j < 5 THEN 3.5 WHEN i * 4 + j < 7 THEN 1.9 ELSE 0.5 END WHEN 1 THEN CASE WHEN i * 4 + j < 6 THEN 3.5 ELSE 0.5 END WHEN 2 THEN CASE WHEN i * 4 + j < 6 THEN -3.5 ELSE -0.5 END
 WHEN 3 THEN CASE WHEN i * 4 + j < 6 THEN 3.5 WHEN i * 4 + j < 13 THEN 0.5 ELSE -3.5 END WHEN 4 THEN 0.0 WHEN 5 THEN CASE WHEN i * 4 + j < 6 OR (i * 4 + j) % 5 = 0 THEN 3.5 ELSE 0.5 END
 WHEN 6 THEN CASE WHEN i * 4 + j < 2 THEN 3.5 ELSE 0.5 END WHEN 7 THEN CASE WHEN i * 4 + j < 6 THEN 0.2 ELSE -3.5 END ELSE CASE WHEN i * 4 + j < 6 THEN 7.0 ELSE 0.5 END END)::DOUBLE AS y
 FROM log, range(0, 4) a(j), range(0, 3) b(k))"""
#: Whether the ego vehicle drives straight between two times: no turn or lane change meets them, and the heading spans less than 8 degrees.
STRAIGHT = """NOT EXISTS (SELECT 1 FROM ego_ev e WHERE e.clip_id = s.clip_id AND (e.kind LIKE 'turn%' OR e.kind LIKE 'lane_change%') AND NOT (round_even(e.t1, 2) < s.a OR round_even(e.t0, 2) > s.b))
 AND coalesce((SELECT CASE WHEN count(*) < 2 THEN true ELSE max(degrees(yaw)) - min(degrees(yaw)) < 8 END FROM ego g WHERE g.clip_id = s.clip_id AND g.t BETWEEN s.a AND s.b), true)"""


@query(f"""WITH {EGO}, {LINES}, {TRACKS}, fwd AS (SELECT tr.*, row_number() OVER () AS id FROM tr WHERE x > 0 AND x < 45),
 placed AS (SELECT fwd.*, least(greatest(round_even(t / greatest(dur, 1e-6) * (n - 1), 0), 0), n - 1)::INT AS frame FROM fwd JOIN (SELECT clip_id, max(t) AS dur FROM log GROUP BY 1) USING (clip_id) JOIN n USING (clip_id)),
 {_at("ys", "placed", "s.id")}, sides AS (SELECT p.clip_id, track_id, t, p.x, p.y, min(ys.y) FILTER (ys.y > 0 AND ys.y < 6) AS yl, max(ys.y) FILTER (ys.y < 0 AND ys.y > -6) AS yr
 FROM placed p LEFT JOIN ys ON ys.id = p.id GROUP BY p.id, 1, 2, 3, 4, 5),
 st AS (SELECT clip_id, track_id, list(CASE WHEN yl IS NULL OR yr IS NULL THEN '?' WHEN y > yl + 0.4 THEN 'L' WHEN y < yr - 0.4 THEN 'R' WHEN yr < y AND y < yl AND abs(y) < 1.6 THEN 'in' ELSE '?' END ORDER BY t, x, y) AS s,
 min(t) AS a, max(t) AS b FROM sides GROUP BY 1, 2 HAVING count(*) >= 6),
 h AS (SELECT *, list_position(s, 'in') AS f FROM st WHERE len(list_filter(s, lambda v: v = 'in')) >= 3)
 SELECT clip_id, track_id, s.s[f - 1] AS side FROM h s WHERE f > 3 AND s.s[f - 1] IN ('L', 'R') AND s.s[f - 2] = s.s[f - 1] AND s.s[f - 3] = s.s[f - 1]
 AND NOT list_contains(s.s[f:], CASE s.s[f - 1] WHEN 'L' THEN 'R' ELSE 'L' END) AND s.s[len(s.s)] = 'in' AND {STRAIGHT}""")
def map_cut_in(spark: SparkSession, d: str) -> DataFrame:
    ego = _ego(spark, d)
    dur = _log(spark, d).groupBy("clip_id").agg(F.max("t").alias("dur"))
    return lanes.cut_ins(_tracks(spark, d), _map_frames(spark, d), dur, scenario.ego_events(ego), ego)


@query(f"""WITH {EGO}, {TRACKS}, o AS (SELECT *, row_number() OVER w AS i0, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY t DESC, x DESC, y DESC) AS i1 FROM tr WHERE x > 0 AND x < 40 WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY t, x, y)),
 g AS (SELECT clip_id, track_id, min(t) AS a, max(t) AS b, avg(y) FILTER (i0 <= 3) AS y0, avg(y) FILTER (i1 <= 3) AS y1, min(y) AS lo, max(y) AS hi FROM o GROUP BY 1, 2 HAVING count(*) >= 6)
 SELECT clip_id, track_id, CASE WHEN y0 > 0 THEN 'L' ELSE 'R' END AS side FROM g s WHERE (y0 > 3 AND abs(y1) < 1.5 AND lo > -1.5 AND y0 - y1 > 1.5 OR y0 < -3 AND abs(y1) < 1.5 AND hi < 1.5 AND y1 - y0 > 1.5) AND {STRAIGHT}""")
def corridor_cut_in(spark: SparkSession, d: str) -> DataFrame:
    ego = _ego(spark, d)
    return lanes.corridor_cut_ins(_tracks(spark, d), scenario.ego_events(ego), ego)


@query(f"""WITH {LOG}, {LINES}, {TRACKS}, refs AS (SELECT clip_id, least(CASE WHEN user_id % 3 = 0 THEN 1000000 ELSE user_id % 5 END, n - 1) AS frame FROM (SELECT DISTINCT clip_id, user_id FROM fr) JOIN n USING (clip_id)),
 fwd AS (SELECT tr.*, frame, row_number() OVER () AS id FROM tr JOIN refs USING (clip_id) WHERE x > 0 AND x <= 35), {_at("ys", "fwd", "s.id")},
 o AS (SELECT f.clip_id, track_id, t, f.x, f.y, CASE WHEN f.y >= 0 THEN count(*) FILTER (ys.y > 0 AND ys.y < f.y) ELSE -count(*) FILTER (ys.y < 0 AND ys.y > f.y) END AS o FROM fwd f JOIN ys ON ys.id = f.id GROUP BY f.id, 1, 2, 3, 4, 5),
 g AS (SELECT clip_id, track_id, list(o ORDER BY t, x, y) AS s, max(abs(o)) AS span FROM o GROUP BY 1, 2 HAVING count(*) >= 6),
 e AS (SELECT *, s[1:3] AS head, s[len(s) - 2:] AS tail FROM g WHERE span = 1)
 SELECT clip_id, track_id, CASE WHEN tail = [0, 0, 0] THEN 'cut_in' ELSE 'cut_out' END AS change FROM e WHERE head IN ([1, 1, 1], [-1, -1, -1]) AND tail = [0, 0, 0] OR head = [0, 0, 0] AND tail IN ([1, 1, 1], [-1, -1, -1])""")
def lane_transitions(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    refs = _log(spark, d).select("clip_id", F.when(u % 3 == 0, 1_000_000).otherwise(u % 5).alias("ref_frame")).distinct()
    return lanes.lane_changes(_tracks(spark, d), _map_frames(spark, d), refs)


@query(f"""WITH {LOG}, o AS (SELECT *, i % 2 AS track, i // 2 AS k FROM log), st AS (SELECT user_id, track, k, CASE WHEN user_id % 6 = 5 AND k = 1 THEN '?' WHEN k < 1 + user_id % 5 THEN CASE WHEN user_id % 2 = 0 THEN 'L' ELSE 'R' END
 WHEN user_id % 7 = 0 AND k = 6 THEN CASE WHEN user_id % 2 = 0 THEN 'R' ELSE 'L' END WHEN value > 440 THEN '?' ELSE 'in' END AS state FROM o),
 q AS (SELECT user_id, track, list(state ORDER BY k) AS s FROM st GROUP BY 1, 2), h AS (SELECT *, list_position(s, 'in') AS f FROM q)
 SELECT user_id, track, CASE WHEN len(list_filter(s, lambda v: v = 'in')) >= 3 AND f > 3 AND s[f - 1] IN ('L', 'R') AND s[f - 2] = s[f - 1] AND s[f - 3] = s[f - 1]
 AND NOT list_contains(s[f:], CASE s[f - 1] WHEN 'L' THEN 'R' ELSE 'L' END) AND s[len(s)] = 'in' THEN s[f - 1] END AS side FROM h""")
def state_sequence(spark: SparkSession, d: str) -> DataFrame:
    """States of a track: a side, perhaps unseen or the other side in between, then in."""
    k, u = F.col("k"), F.col("user_id")
    own, other = F.when(u % 2 == 0, "L").otherwise("R"), F.when(u % 2 == 0, "R").otherwise("L")
    o = _log(spark, d).withColumn("track", F.col("i") % 2).withColumn("k", F.floor(F.col("i") / 2))
    state = F.when((u % 6 == 5) & (k == 1), "?").when(k < 1 + u % 5, own).when((u % 7 == 0) & (k == 6), other).when(F.col("value") > 440, "?").otherwise("in")
    return series.entered_from_side(o.withColumn("state", state), ["user_id", "track"], ["k"], "state").select("user_id", "track", "side")


@query(f"""WITH {EV}, r AS (SELECT user_id, event_id, t0, t1 + 86400 AS t1, CASE WHEN event_id % 2 = 0 THEN 'n' END AS note FROM ev WHERE event_type = 'signup' UNION ALL SELECT user_id, event_id, t0 + 1, t0 + 2, NULL FROM ev WHERE event_type = 'view'),
 turn AS (SELECT user_id, t0, t1 FROM ev WHERE event_type = 'error')
 SELECT event_id, note, (SELECT CASE WHEN count(*) < 2 THEN true ELSE max(e.value) - min(e.value) < 60 END FROM ev e WHERE e.user_id = r.user_id AND e.t BETWEEN r.t0 AND r.t1)
 AND NOT EXISTS (SELECT 1 FROM turn WHERE turn.user_id = r.user_id AND NOT (turn.t1 < r.t0 OR turn.t0 > r.t1)) AS straight FROM r""")
def straight_driving(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of a day and of a second, in which no sample lies; half of the first have no note."""
    e = events(spark, d)
    day = e.where("event_type = 'signup'").select("user_id", "event_id", "t0", (F.col("t1") + 86400).alias("t1"), F.when(F.col("event_id") % 2 == 0, "n").alias("note"))
    second = e.where("event_type = 'view'").select("user_id", "event_id", (F.col("t0") + 1).alias("t0"), (F.col("t0") + 2).alias("t1"), F.lit(None).cast("string").alias("note"))
    turns = e.where("event_type = 'error'").select("user_id", "t0", "t1")
    return series.straight(day.unionByName(second), turns, e, U, "t", "value", 60.0, width=86_400.0).select("event_id", "note", "straight")


@query(f"""WITH {LOG}, eps AS (SELECT clip_id, i // 7 AS ep, t AS t0, t + 3 AS t1, t AS onset FROM log WHERE i % 7 = 0),
 ag AS (SELECT clip_id, CASE i % 4 WHEN 0 THEN 'crossing' WHEN 1 THEN 'preceding_vehicle' WHEN 2 THEN 'adjust' ELSE 'crossing' END AS role, 'o' || (i % 3) AS object_type, value % 45 AS min_dist,
 t - value % 2 AS t0, t + value % 3 AS t1 FROM log), able AS (SELECT *, CASE WHEN role = 'crossing' AND min_dist < 15 THEN 0 WHEN role = 'preceding_vehicle' AND min_dist < 30 THEN 1 END AS r FROM ag),
 c AS (SELECT e.clip_id, ep, arg_min(struct_pack(k := able.object_type, ro := role, d := min_dist), (r, min_dist, able.t0, able.t1, able.object_type, role)) AS a FROM eps e JOIN able ON able.clip_id = e.clip_id
 WHERE r IS NOT NULL AND NOT (able.t1 < onset - 1e-6 OR able.t0 > e.t1 + 1e-6) AND able.t0 <= onset + 1.0 AND able.t1 >= onset - 1.5 GROUP BY 1, 2)
 SELECT clip_id, ep, a.k AS object_type, a.ro AS role, a.d AS min_dist FROM eps LEFT JOIN c USING (clip_id, ep)""")
def causal_gate(spark: SparkSession, d: str) -> DataFrame:
    """Episodes each seven rows; agents that cross, go ahead or cut in, near and far, some too early or too late."""
    log, i = _log(spark, d), F.col("i")
    eps = log.where(i % 7 == 0).select("clip_id", F.floor(i / 7).alias("ep"), F.col("t").alias("t0"), (F.col("t") + 3).alias("t1"), F.col("t").alias("onset"))
    role = F.when(i % 4 == 1, "preceding_vehicle").when(i % 4 == 2, "adjust").otherwise("crossing")
    agents = log.select(
        "clip_id", role.alias("role"), F.concat(F.lit("o"), (i % 3).cast("string")).alias("object_type"), (F.col("value") % 45).alias("min_dist"),
        (F.col("t") - F.col("value") % 2).alias("t0"), (F.col("t") + F.col("value") % 3).alias("t1"),
    )
    return scenario.causal_agent(eps, agents, Thresholds()).select("clip_id", "ep", F.col("a_object_type").alias("object_type"), F.col("a_role").alias("role"), F.col("a_min_dist").alias("min_dist"))
