"""Scenario mining: ego events, agent events, the taxonomy, selection, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.config import DEFAULT, Thresholds
from skarn.functions import rules, scalar
from skarn.operators import aggregates, intervals, ranking, series
from skarn.plans import lanes
from skarn.tables import materialise

K = ["clip_id"]


def ego_series(ego: DataFrame, cam: DataFrame) -> DataFrame:
    """(clip_id, t, dur, speed, ax, yaw, yaw_rate) inside the camera's span; clips of fewer than 3 rows are left out.

    ego: clip_id, timestamp_us, qw..qz, vx, vy, ax; cam: clip_id, timestamp_us.
    """
    span = cam.groupBy(*K).agg(F.min("timestamp_us").alias("lo"), F.max("timestamp_us").alias("hi"))
    inside = ego.join(span, K).where("timestamp_us between lo and hi")
    s = inside.select(
        "clip_id",
        scalar.seconds(F.col("timestamp_us"), F.col("lo")).alias("t"),
        scalar.seconds(F.col("hi"), F.col("lo")).alias("dur"),
        F.hypot("vx", "vy").alias("speed"),
        "ax",
        scalar.yaw(*(F.col(c) for c in ("qw", "qx", "qy", "qz"))).alias("raw_yaw"),
    )
    s = s.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*K))).where("_n >= 3").drop("_n")
    s = series.gradient(series.unwrap(s, K, ["t"], "raw_yaw", "yaw"), K, ["t"], "yaw", "t", "yaw_rate")
    return s.withColumn("yaw", F.col("yaw") - F.first("yaw").over(Window.partitionBy(*K).orderBy("t"))).drop("raw_yaw")


def _spells(s: DataFrame, th: Thresholds) -> DataFrame:
    """(clip_id, kind, run, t0, t1, net, lat, dur): long enough runs of slowing, speeding up, standing and turning."""
    masks = {"decelerate": F.col("ax") < th.decel_ax, "accelerate": F.col("ax") > th.accel_ax, "stop": F.col("speed") < th.stop_speed, "turn": F.abs("yaw_rate") > th.turn_yaw_rate}
    run = ["clip_id", "kind", "run"]
    w = Window.partitionBy(*run).orderBy("t")
    rows = series.hits(s, K, ["t"], masks, ["t", "yaw", "speed", "dur"])
    rows = rows.withColumn("side", F.col("speed") * F.sin(F.col("yaw") - F.first("yaw").over(w)))
    rows = rows.withColumn("part", F.coalesce((F.col("t") - F.lag("t").over(w)) * (F.col("side") + F.lag("side").over(w)) / 2, F.lit(0.0)))
    spells = rows.groupBy(*run).agg(
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.degrees(F.max_by("yaw", "t") - F.min_by("yaw", "t")).alias("net"), F.sum("part").alias("lat"), F.max("dur").alias("dur")
    )
    return spells.where(F.col("t1") - F.col("t0") >= th.min_event_sec)


def ego_events(s: DataFrame, th: Thresholds = DEFAULT, frames: DataFrame | None = None) -> DataFrame:
    """(clip_id, kind, t0, t1, center): decelerate, accelerate, stop, turns and lane changes, merged by kind.

    frames: optional map frames of ``lanes.frames``. What the road turns in a run is then taken off its heading change, and
    turns and lane changes also have curvature_correction_source (map or none) and lane_crossings, those of the first of merged runs.
    """
    spells, told = _spells(s, th), []
    if frames is not None:
        told = ["curvature_correction_source", "lane_crossings"]
        held = materialise(spells, "spells")
        road = lanes.road(held.where("kind = 'turn'"), frames, th)
        turning = F.col("kind") == "turn"
        spells = held.join(road, ["clip_id", "kind", "run"], "left").withColumns(
            {"net": F.col("net") - F.coalesce("road_deg", F.lit(0.0)), told[0]: F.when(turning, F.when(F.col("road_deg").isNotNull(), "map").otherwise("none"))}
        )
    big = F.abs("net") >= th.turn_heading_deg
    small = (F.abs("net") <= th.lane_change_heading_max_deg) & F.abs("lat").between(th.lane_change_lateral_min, th.lane_change_lateral_max)
    turned = F.when(big, F.when(F.col("net") > 0, "turn_left").otherwise("turn_right")).when(small, F.when(F.col("lat") > 0, "lane_change_left").otherwise("lane_change_right"))
    every = spells.select("clip_id", F.when(F.col("kind") == "turn", turned).otherwise(F.col("kind")).alias("kind"), "t0", "t1", *told).where("kind is not null")
    merged = series.merge(every, ["clip_id", "kind"], th.merge_gap_sec, carry=told)
    return merged.select("clip_id", "kind", F.bround("t0", 2).alias("t0"), F.bround("t1", 2).alias("t1"), F.bround((F.col("t0") + F.col("t1")) / 2, 2).alias("center"), *told)


def agent_events(points: DataFrame, classes: dict[str, str] = rules.DETECTION_TYPES, th: Thresholds = DEFAULT) -> DataFrame:
    """(clip_id, object_type, role, relation, min_dist, t0, t1, track_id) from track points (clip_id, track_id, cls, t, x, y)."""
    p = points.withColumn("_in", (F.abs("y") < th.corridor_half) & (F.col("x") > 0) & (F.col("x") < th.corridor_ahead))
    c = lambda v: F.when(F.col("_in"), v)
    g = p.groupBy("clip_id", "track_id").agg(
        F.min_by("cls", F.struct("t", "x", "y")).alias("cls"),
        F.min_by(F.abs("y"), F.struct("t", "x", "y")).alias("first_y"),
        F.count(c(F.lit(1))).alias("n"),
        F.min(c(F.col("t"))).alias("t0"),
        F.max(c(F.col("t"))).alias("t1"),
        F.bround(F.min(c(F.col("x"))), 1).alias("min_dist"),
        F.min(c(F.abs("y"))).alias("min_y"),
    )
    g = g.where((F.col("n") >= th.corridor_min_points) & (F.col("t1") - F.col("t0") >= th.corridor_min_sec))
    kind = rules.object_type(F.col("cls"), classes)
    vru = kind.isin("pedestrian", "bicycle_micromobility")
    cut = (F.col("first_y") > th.cut_in_from) & (F.col("min_y") < th.cut_in_to)
    out = g.select(
        "clip_id",
        kind.alias("object_type"),
        F.when(vru, "crossing").when(cut, "adjust").otherwise("preceding_vehicle").alias("role"),
        F.when(vru, "cross_ego_path").when(cut, "cut_in").alias("relation"),
        F.when(~vru & ~cut, "maintain_speed").alias("longitudinal_action"),
        F.when(kind == "pedestrian", "crossing").alias("vru_detail"),
        "min_dist", "t0", "t1", "track_id",
    )
    return intervals.suppress(out, ["clip_id", "object_type", "role"], ["min_dist", "t0", "track_id"])


def _with_ego(df: DataFrame, ego: DataFrame, key: list[str], spans: dict[str, tuple[str, str]]) -> DataFrame:
    """Each row of df, one a key, with the least and mean speed and the heading change of the ego series in each span; one join for all.

    Means are summed from the last sample to the first, as the query's SQL is run: some fall on a threshold but for the last bit.
    """
    e = ego.select(F.col("clip_id").alias("_c"), F.col("t").alias("_t"), F.col("speed").alias("_s"), F.col("yaw").alias("_y"))
    ends = [F.col(c) for c, _ in spans.values()], [F.col(c) for _, c in spans.values()]
    joined = df.join(e, (F.col("clip_id") == F.col("_c")) & F.col("_t").between(F.least(*ends[0]), F.greatest(*ends[1])), "left")
    inside = lambda tag, c: F.when(F.col("_t").between(*(F.col(x) for x in spans[tag])), F.col(c))
    joined = aggregates.with_running_sums(joined, key, [F.col("_t").desc(), F.col("_s")], {f"_sum_{tag}": inside(tag, "_s") for tag in spans})
    aggs = []
    for tag in spans:
        t = inside(tag, "_t")
        turn = F.abs(F.degrees(F.max_by("_y", t) - F.min_by("_y", t)))
        aggs += [F.min(inside(tag, "_s")).alias(f"{tag}_min"), aggregates.last_mean(f"_sum_{tag}", inside(tag, "_s")).alias(f"{tag}_mean"), turn.alias(f"{tag}_turn")]
    names = [*key, *(c for c, kind in df.dtypes if kind == "string" and c not in key)]  # one value a key; hash aggregation holds no strings
    return joined.groupBy(*names).agg(*(F.first(c).alias(c) for c in df.columns if c not in names), *aggs)


def taxonomy(tracks: DataFrame, ego: DataFrame, events: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """(clip_id, cat, t0, t1): interaction categories from tracks (…, t, x, y, yaw, cls), the ego series and ego events.

    The series and the events are read several times: give written tables.
    """
    key = ["clip_id", "track_id"]
    enough = Window.partitionBy(*key)
    p = tracks.withColumn("_n", F.count(F.lit(1)).over(enough)).where(F.col("_n") >= th.min_track_points).drop("_n")
    for c in "xy":
        p = series.gradient(p, key, ["t"], c, "t", f"_v{c}")
    p = p.withColumn("v", F.hypot("_vx", "_vy")).drop("_vx", "_vy")
    near = F.col("x").between(0, th.near_ahead) & (F.col("x") > 0) & (F.col("x") < th.near_ahead) & (F.abs("y") < th.near_half)
    corridor = (F.abs("y") < th.corridor_half) & (F.col("x") > 0) & (F.col("x") < th.corridor_ahead)
    ahead = (F.col("x") > 0) & (F.col("x") < th.near_ahead)
    p = p.withColumns({"near": near, "corridor": corridor, "ahead": ahead})
    by = Window.partitionBy(*key, "ahead")
    p = p.withColumn("_a", F.row_number().over(by.orderBy("t"))).withColumn("_b", F.row_number().over(by.orderBy(F.col("t").desc())))
    on = lambda c, v: F.when(F.col(c), v)
    y, t, x = F.abs("y"), F.col("t"), F.col("x")
    g = p.groupBy(*key).agg(
        F.first("cls").alias("cls"),
        F.median(F.abs(scalar.wrap(F.col("yaw")))).alias("dir"),
        F.min(on("near", t)).alias("n0"), F.max(on("near", t)).alias("n1"), F.count(on("near", t)).alias("nn"),
        F.min(on("near", y)).alias("near_y"), (F.max(on("near", F.col("y"))) - F.min(on("near", F.col("y")))).alias("near_ptp"),
        F.min(on("corridor", t)).alias("c0"), F.max(on("corridor", t)).alias("c1"), F.count(on("corridor", t)).alias("cn"),
        F.min(on("corridor", x)).alias("c_x"), F.min(on("corridor", y)).alias("c_y"), F.avg(on("corridor", (y < th.cut_in_to).cast("double"))).alias("lead_share"),
        F.min(on("ahead", t)).alias("a0"), F.max(on("ahead", t)).alias("a1"), F.count(on("ahead", t)).alias("an"), F.min(on("ahead", y)).alias("a_y"),
        F.avg(F.when(F.col("ahead") & (F.col("_a") <= th.sustain), y)).alias("head"), F.avg(F.when(F.col("ahead") & (F.col("_b") <= th.sustain), y)).alias("tail"),
        F.max(on("corridor", F.col("v"))).alias("v_max"), F.min(on("corridor", F.col("v"))).alias("v_min"), F.min(on("near", F.col("v"))).alias("near_v"),
        F.min_by("v", on("corridor", t)).alias("v_first"), F.max_by("v", on("corridor", t)).alias("v_last"),
    )

    g = _with_ego(g, ego, key, {"near_ego": ("n0", "n1"), "cor_ego": ("c0", "c1"), "ahead_ego": ("a0", "a1")})
    g = g.withColumn("kind", rules.object_type(F.col("cls"), rules.DETECTION_TYPES))
    kind = F.col("kind")
    ped, cyc = kind == "pedestrian", kind.isin("bicycle_micromobility", "motorcycle")
    is_near, vehicle = F.col("nn") > 0, ~kind.isin("pedestrian", "bicycle_micromobility", "motorcycle", "other")
    crossing = ((F.col("near_y") < th.corridor_half) & (F.col("near_ptp") > 2.0) & (F.col("nn") > 1)) | (F.col("near_y") < th.cut_in_to)
    same = vehicle & (F.col("dir") < th.same_direction) & (F.col("cn") > 0)
    moving = same & (F.col("an") >= th.sustain) & (F.coalesce("ahead_ego_turn", F.lit(0.0)) <= th.rotation_gate_deg)
    came, attempted = (F.col("head") >= th.adjacent) & (F.col("tail") < th.entered), (F.col("head") >= th.adjacent) & (F.col("a_y") < th.attempted)
    lead = same & (F.col("lead_share") > 0.5)
    cross = vehicle & F.col("dir").between(th.same_direction, th.oncoming) & is_near
    rules_ = {
        "ped_crossing": (ped & is_near & crossing, "n0", "n1"),
        "vru_roadside": (ped & is_near & ~crossing, "n0", "n1"),
        "cyclist_pm_near": (cyc & is_near, "n0", "n1"),
        "cut_in": (moving & came, "a0", "a1"),
        "cut_in_attempt": (moving & ~came & attempted, "a0", "a1"),
        "cut_out": (moving & ~came & ~attempted & (F.col("head") < th.entered) & (F.col("tail") >= th.adjacent), "a0", "a1"),
        "close_follow": (lead & (F.col("cor_ego_mean") > th.follow_min_speed) & (F.col("c_x") / F.nullif("cor_ego_mean", F.lit(0.0)) < th.headway_sec), "c0", "c1"),
        "lead_decel": (lead & (F.col("cn") >= 3) & (F.col("v_max") - F.col("v_min") > th.lead_decel) & (F.col("v_first") > F.col("v_last")), "c0", "c1"),
        "oncoming_encroach": (vehicle & (F.col("dir") > th.oncoming) & (F.col("c_y") < th.cut_in_to), "c0", "c1"),
        "agent_yields_to_ego": (cross & (F.col("near_v") < th.yield_speed) & (F.col("near_ego_mean") > th.moving_speed), "n0", "n1"),
        "ego_yields_to_agent": (cross & ~F.coalesce((F.col("near_v") < th.yield_speed) & (F.col("near_ego_mean") > th.moving_speed), F.lit(False)) & (F.col("near_ego_min") < th.yield_speed), "n0", "n1"),
        "_lead": (lead, "c0", "c1"),
    }
    hits = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("cat"), F.col(a).alias("t0"), F.col(b).alias("t1"))) for n, (c, a, b) in rules_.items())))
    found = g.select("clip_id", F.inline(hits))
    leads = found.where("cat = '_lead'")
    creep = series.runs(ego, K, ["t"], (F.col("speed") > th.creep_low) & (F.col("speed") < th.creep_high), "t", th.creep_min_sec).select("clip_id", "t0", "t1")
    creep = intervals.overlap_join(creep, leads.select("clip_id", "t0", "t1"), K, "left_semi", width=th.window_sec)
    creep = intervals.consume(creep, events.where(F.col("kind").startswith("turn_")).select("clip_id", "t0", "t1"), K, width=th.window_sec)
    stops = intervals.overlap_join(creep, events.where("kind = 'stop'").select("clip_id", "t0", "t1"), K, "left", width=th.window_sec)
    held = F.when(F.col("b_t0").isNull(), 0.0).otherwise(F.greatest(F.least("t1", "b_t1") - F.greatest("t0", "b_t0"), F.lit(0.0)))  # least passes over nulls
    creep = stops.groupBy("clip_id", "t0", "t1").agg(F.sum(held).alias("s")).where("s <= 0.5 * (t1 - t0)").select("clip_id", F.lit("creep").alias("cat"), "t0", "t1")
    slow = aggregates.range_stats(events.where("kind = 'decelerate'").select("clip_id", "t0", "t1"), ego, K, "t", "speed").where(F.col("mean_value") > th.moving_speed)
    slow = ranking.top_k(slow, K, [F.col("t0"), F.col("t1")], 1).select("clip_id", F.lit("decel_at_intersection").alias("cat"), "t0", "t1")
    lanes = events.where(F.col("kind").startswith("lane_change")).join(ego.groupBy(*K).agg(F.max("dur").alias("d")), K).select("clip_id", F.col("kind").alias("cat"), F.lit(0.0).alias("t0"), F.col("d").alias("t1")).distinct()
    return found.where("cat <> '_lead'").unionByName(creep).unionByName(slow).unionByName(lanes)


def causal_agent(episodes: DataFrame, agents: DataFrame, th: Thresholds = DEFAULT) -> DataFrame:
    """Each episode (clip_id, ep, t0, t1, onset) with the agent (a_...) that overlaps it and may have caused it, null without one.

    An agent that crosses nearer than ``cause_crossing_m`` comes before one ahead nearer than ``cause_preceding_m``, the nearer
    before the farther, the earlier of equals first; others, those that cut in among them, are no causes. Agents meet episodes in bins.
    """
    a = agents.select("clip_id", *(F.col(c).alias(c) for c in ("object_type", "role", "min_dist", "t0", "t1")))
    rank = F.when((F.col("role") == "crossing") & (F.col("min_dist") < th.cause_crossing_m), 0).when((F.col("role") == "preceding_vehicle") & (F.col("min_dist") < th.cause_preceding_m), 1)
    near = a.withColumn("rank", rank).where("rank is not null")
    met = intervals.overlap_join(episodes, near, K, "inner", slack=1e-6, width=th.window_sec)
    early = (F.col("b_t0") <= F.col("onset") + th.cause_after_onset) & (F.col("b_t1") >= F.col("onset") - th.cause_before_onset)
    fields = [F.col(f"b_{c}").alias(f"a_{c}") for c in ("rank", "min_dist", "t0", "t1", "object_type", "role")]
    best = met.where(early).groupBy("clip_id", "ep").agg(F.min(F.struct(*fields)).alias("_a"))
    kept = best.select("clip_id", "ep", *(F.col(f"_a.a_{c}") for c in ("object_type", "role", "min_dist", "t0", "t1")))
    return episodes.join(kept, ["clip_id", "ep"], "left")


def select_windows(windows: DataFrame, by: list[str], th: Thresholds = DEFAULT) -> DataFrame:
    """Windows (by, clip_id, w0, kinds, min_ax, reactive, vlm_score) to ranked clips of each group.

    The most reactive windows of a clip are weighed by the model's score; the best and a bonus for the rest make the
    clip's score, which the group's maximum normalises.
    """
    w = windows.withColumn("react", aggregates.reactivity(F.col("kinds"), F.col("min_ax"))).where(F.col("react") >= th.reactivity_floor)
    w = ranking.top_k(w, [*by, "clip_id"], [F.col("react").desc(), F.col("w0")], th.windows_per_clip)
    v = F.coalesce("vlm_score", F.lit(0.0))
    w = w.withColumn("wscore", F.col("react") * F.when(F.coalesce("reactive", F.lit(False)), v).otherwise(0.2 * v))
    best = aggregates.best_with_bonus(w, [*by, "clip_id"], "wscore", [F.col("w0")], th.window_bonus).select(*by, "clip_id", "clip_score", "n", F.col("w0").alias("best_w0"))
    every = windows.select(*by, "clip_id").distinct().join(best, [*by, "clip_id"], "left").withColumn("clip_score", F.coalesce("clip_score", F.lit(0.0)))
    return ranking.top_k(ranking.normalise_max(every, by, "clip_score", "score_norm"), by, [F.col("score_norm").desc(), F.col("clip_id")])
