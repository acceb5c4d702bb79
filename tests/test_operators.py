"""Hand-computed cases, and brute force where SQL has no counterpart."""

import itertools
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.functions import rules, scalar
from skarn.operators import aggregates, filters, fusion, geometry, intervals, matching, parameters, ranking, series
from skarn.plans import scenario
from skarn.sources import binary, readers, writers


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_runs_keep_last_true_sample(spark):
    df = spark.createDataFrame([("c", 0.0, True), ("c", 0.2, True), ("c", 0.4, True), ("c", 0.6, False), ("c", 0.8, True)], "k string, t double, m boolean")
    assert got(series.runs(df, ["k"], ["t"], F.col("m"), "t", 0.4), "t0") == [("c", 0.0, 0.4, 3)]


def test_merge_bounds_and_first_fields(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0, "x"), ("a", 1.5, 2.0, "y"), ("a", 2.75, 3.0, "z"), ("a", 2.76, 2.8, "w")], "k string, t0 double, t1 double, f string")
    assert got(series.merge(df, ["k"], 0.5, carry=["f"]), "t0") == [("a", 0.0, 2.0, 2, "x"), ("a", 2.75, 3.0, 2, "z")]


def test_episodes(spark):
    df = spark.createDataFrame([("c", 0.0, 1.0, "stop"), ("c", 3.0, 4.0, "accelerate"), ("c", 6.5, 7.0, "stop")], "k string, t0 double, t1 double, kind string")
    assert [(r.t0, r.t1, r.kinds) for r in series.episodes(df, ["k"], 2.0).orderBy("t0").collect()] == [(0.0, 4.0, ["stop", "accelerate"]), (6.5, 7.0, ["stop"])]


def test_gaps(spark):
    iv = spark.createDataFrame([("c", 1.0, 2.0), ("c", 1.5, 4.0)], "k string, t0 double, t1 double")
    span = spark.createDataFrame([("c", 0.0, 10.0), ("d", 0.0, 5.0)], "k string, lo double, hi double")
    assert got(series.gaps(iv, ["k"], span), "k", "t0") == [("c", 0.0, 1.0), ("c", 4.0, 10.0), ("d", 0.0, 5.0)]


def test_sliding_windows(spark):
    df = spark.createDataFrame([("c", 20.0), ("d", 0.0)], "k string, dur double")
    assert [(r.w0, r.w1) for r in series.sliding_windows(df, ["k"], "dur", 6.0, 5.0).orderBy("w0").collect()] == [(0, 6), (5, 11), (10, 16), (15, 20)]


def test_unwrap_and_gradient_as_numpy(spark):
    rng = np.random.default_rng(3)
    t, yaw = np.cumsum(rng.uniform(0.05, 0.2, 300)), np.cumsum(rng.normal(0, 1.2, 300))
    raw = np.arctan2(np.sin(yaw), np.cos(yaw))
    df = spark.createDataFrame([("c", float(a), float(b)) for a, b in zip(t, raw)], "k string, t double, a double")
    out = series.gradient(series.unwrap(df, ["k"], ["t"], "a", "u"), ["k"], ["t"], "u", "t", "r").orderBy("t").toPandas()
    u = np.unwrap(raw)
    d = lambda v: np.concatenate([[v[1] - v[0]], v[2:] - v[:-2], [v[-1] - v[-2]]])
    assert np.allclose(out.u, u) and np.allclose(out.r, d(u) / d(t))


def test_suppression(spark):
    df = spark.createDataFrame([("v", 3.0, 1.0, 3.0), ("v", 5.0, 0.0, 2.0), ("v", 9.0, 4.0, 5.0)], "k string, d double, t0 double, t1 double")
    assert got(intervals.suppress(df, ["k"], ["d"]), "d") == [("v", 3.0, 1.0, 3.0), ("v", 9.0, 4.0, 5.0)]


def test_suppression_brute_force(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.randint(0, 40) / 2, (a := rng.randint(0, 60) / 2), a + rng.randint(1, 8) / 2, i) for i in range(120)]
    kept = []
    for r in sorted(data, key=lambda r: (r[0], r[1], r[4])):
        if not any(k[0] == r[0] and k[3] >= r[2] and k[2] <= r[3] for k in kept):
            kept.append(r)
    out = intervals.suppress(spark.createDataFrame(data, "k string, d double, t0 double, t1 double, i int"), ["k"], ["d", "i"])
    assert sorted(tuple(r) for r in out.collect()) == sorted(kept)


def test_suppression_over_stretches_and_open_intervals(spark):
    data = [("a", 1.0, 0.0, 1.0), ("a", 2.0, 1.0, 2.0), ("a", 3.0, 5.0, 6.0), ("a", 4.0, None, None), ("a", 5.0, 3.0, None), ("a", 6.0, 5.5, 9.0), ("b", 1.0, 0.5, 0.7)]
    out = intervals.suppress(spark.createDataFrame(data, "k string, d double, t0 double, t1 double"), ["k"], ["d"])
    assert sorted((r.k, r.d) for r in out.collect()) == [("a", 1.0), ("a", 3.0), ("a", 4.0), ("a", 5.0), ("b", 1.0)]


def test_best_overlap_takes_first_of_equals_and_null(spark):
    gold = spark.createDataFrame([("c", 0, 0.0, 4.0), ("c", 1, 9.0, 10.0), ("c", 2, 4.0, 5.0)], "k string, g int, t0 double, t1 double")
    pred = spark.createDataFrame([("c", "A", 0, 0.0, 2.0), ("c", "B", 1, 2.0, 4.0)], "k string, n string, pos int, t0 double, t1 double")
    assert [(r.g, r.b_n) for r in intervals.best_overlap(gold, pred, ["k"], ["g"], "pos").orderBy("g").collect()] == [(0, "A"), (1, None), (2, None)]


def test_asof_falls_back_to_first(spark):
    left = spark.createDataFrame([("s", 1), ("s", 5), ("none", 3)], "k string, t long")
    right = spark.createDataFrame([("s", 2, "p2", 0), ("s", 4, "p4", 1)], "k string, t long, v string, i int")
    assert got(intervals.asof_join(left, right, ["k"], "t", "v", "i"), "k", "t") == [("none", 3, None), ("s", 1, "p2"), ("s", 5, "p4")]


def test_previous_consecutive_stops_at_gap(spark):
    df = spark.createDataFrame([("s", i, f"f{i}") for i in (0, 1, 2, 4, 5)], "k string, i int, f string")
    assert [r.previous for r in series.previous_consecutive(df, ["k"], "i", "f", 5).orderBy("i").collect()] == [[], ["f0"], ["f1", "f0"], [], ["f4"]]


def test_scores(spark):
    one = spark.range(1)
    v = one.select(
        ranking.fuse(F.lit(0.9), F.lit(0.5)).alias("f"),
        fusion.confidence(F.array(F.lit("ego"), F.lit("vlm")), F.lit(0.4)).alias("a"),
        fusion.confidence(F.array(F.lit("ego"), F.lit("vlm"), F.lit("gt")), F.lit(1.0)).alias("b"),
        matching.iou_center([F.lit(x) for x in (0.0, 0.0, 2.0, 2.0)], [F.lit(x) for x in (1.0, 0.0, 2.0, 2.0)]).alias("iou"),
    ).first()
    assert v.f == pytest.approx(1.05) and (v.a, v.b) == (0.9, 1.0) and v.iou == pytest.approx(1 / 3)
    df = spark.createDataFrame([("c", k, ax) for k, ax in (("turn_left", 0.0), ("stop", -5.0), ("decelerate", -1.0), ("decelerate", -1.0))], "c string, kind string, ax double")
    assert aggregates.ego_score(df, ["c"], "kind", F.col("ax")).first().score == pytest.approx(6.8)


def test_confirm_scene(spark):
    a = lambda *x: F.array(*(F.lit(v) for v in x)) if x else F.array().cast("array<string>")
    r = spark.range(1).select(
        fusion.confirm_scene(a("cut_in", "creep"), a("cut_in", "ped_crossing", "night")).alias("x"),
        fusion.confirm_scene(a("decel_at_intersection"), a("intersection_signalized")).alias("y"),
        fusion.confirm_scene(a(), a()).alias("z"),
    ).first()
    assert r.x == ["creep", "cut_in", "night"] and r.y == ["decel_at_intersection", "intersection_signalized"] and r.z == []


def boxes(spark, n, seed, score):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), i, [rng.uniform(0, 6), rng.uniform(0, 6), 2.0, 2.0], rng.randint(0, 5) / 5) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, id long, box array<double>, score double")
    return rows, df if score else df.drop("score")


def iou(a, b):
    w = min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2)
    h = min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2)
    i = max(w, 0) * max(h, 0)
    return i / (a[2] * a[3] + b[2] * b[3] - i + 1e-8)


def test_greedy_match_brute_force(spark):
    p, pd = boxes(spark, 40, 1, True)
    t, td = boxes(spark, 30, 2, False)
    want, taken = {}, set()
    for r in sorted(p, key=lambda r: (-r[3], r[1])):
        best, at = 0.0, None
        for q in t:
            if q[0] == r[0] and q[1] not in taken and iou(r[2], q[2]) > best:
                best, at = iou(r[2], q[2]), q[1]
        hit = at is not None and best >= 0.3
        taken |= {at} if hit else set()
        want[r[1]] = at if hit else None
    assert {r.pred_id: r.truth_id for r in matching.greedy_match(pd, td, ["k"], 0.3).collect()} == want


def test_nms_brute_force(spark):
    p, pd = boxes(spark, 60, 4, True)
    kept = []
    for r in sorted(p, key=lambda r: (-r[3], r[1])):
        if all(k[0] != r[0] or iou(k[2], r[2]) <= 0.2 for k in kept):
            kept.append(r)
    assert {r.id for r in matching.nms(pd, ["k"], 0.2).collect()} == {r[1] for r in kept}


def test_nms_keeps_the_best_of_a_frame(spark):
    rng = random.Random(8)
    data = [(f, c, i, rng.randint(0, 20) / 20, [rng.uniform(0, 8), rng.uniform(0, 8), rng.uniform(1, 4), rng.uniform(1, 4)]) for i, (f, c) in enumerate((f, c) for f in "ab" for c in range(2) for _ in range(25))]
    kept = []
    for f in "ab":
        for c in range(2):
            left, one = sorted((r for r in data if r[0] == f and r[1] == c and r[3] > 0.2), key=lambda r: (-r[3], r[2]))[:15], []
            for r in left:
                if all(iou(k[4], r[4]) <= 0.1 for k in one):
                    one.append(r)
            kept += one
    want = {r[2] for f in "ab" for r in sorted((k for k in kept if k[0] == f), key=lambda r: (-r[3], r[2]))[:5]}
    df = spark.createDataFrame(data, "frame string, cls int, id long, score double, box array<double>")
    assert {r.id for r in matching.nms(df, ["frame", "cls"], 0.1, most=5, frame=["frame"], floor=0.2, before=15).collect()} == want


@pytest.mark.parametrize("cell", [0.5, 3.0, 100.0])
def test_meeting_boxes_brute_force(spark, cell):
    rng = random.Random(9)
    data = [(rng.choice("ab"), i, float(rng.randint(-9, 9)), rng.uniform(-9, 9), float(rng.choice([1, 2, 3, 30])), rng.uniform(0.1, 3)) for i in range(60)]
    data += [("a", 60, 0.0, 0.0, 0.0, 1.0), ("a", 61, None, 0.0, 1.0, 1.0)]
    want = {(a[0], a[1], b[1]) for a in data for b in data if a[0] == b[0] and a[1] < b[1] < 60 and iou(a[2:], b[2:]) > 0}
    got = matching.meeting_boxes(spark.createDataFrame(data, "k string, id long, x double, y double, w double, h double"), ["k"], "id", cell).collect()
    assert len(got) == len(want) and {(r.k, r.a, r.b) for r in got} == want


@pytest.mark.parametrize("n,m", [(1, 1), (3, 5), (5, 3), (4, 4)])
def test_assignment_is_optimal(n, m):
    rng = np.random.default_rng(n * 10 + m)
    for _ in range(20):
        c = rng.integers(0, 9, (n, m)).astype(float)
        pairs = matching.assignment(c)
        small, large = sorted((n, m))
        turned = c if n <= m else c.T
        best = min(sum(turned[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(pairs) == small and sum(c[i, j] for i, j in pairs) == best


def test_rigid_inverse_and_quaternions(spark):
    w, x, y, z = np.array([0.8, 0.2, -0.4, 0.4]) / np.linalg.norm([0.8, 0.2, -0.4, 0.4])
    m = scalar.quaternion_to_matrix(*(F.lit(float(v)) for v in (w, x, y, z)))
    r = spark.range(1).select(m.alias("m")).select("m", scalar.matrix_to_quaternion(F.col("m")).alias("q")).first()
    assert np.allclose(tuple(r.q), (w, x, y, z))
    pose = np.eye(4)
    pose[:3, :3], pose[:3, 3] = np.array(r.m).reshape(3, 3), (1, 2, 3)
    p = F.array(*(F.lit(float(v)) for v in pose.ravel()))
    out = spark.range(1).select(p.alias("p")).select(geometry.matmul(geometry.rigid_inverse(F.col("p")), F.col("p")).alias("i")).first().i
    assert np.allclose(np.array(out).reshape(4, 4), np.eye(4))


def test_ground_and_axes(spark):
    a = lambda *x: F.array(*(F.lit(v) for v in x))
    r = spark.range(1).select(
        rules.grounded_action(F.lit("ego_u_turn"), a("turn_left")).alias("a"),
        rules.grounded_action(F.lit("ego_turn_left"), a("stop")).alias("b"),
        rules.axes(a("decelerate", "turn_left", "stop")).alias("c"),
        rules.auto_tags(a("stop", "turn_left")).alias("d"),
        rules.difficulty(F.lit(41), F.lit(0), F.lit(0.1)).alias("e"),
        rules.difficulty(F.lit(25), F.lit(0), F.lit(0.1)).alias("f"),
    ).first()
    assert (r.a, r.b, r.d, r.e, r.f) == ("ego_u_turn", "ego_stop", ["turn_left", "stop"], 0, -1)
    assert tuple(r.c) == ("decelerate", "stop", "turn_left", False)


def test_ego_events_from_a_drive(spark):
    """Ten seconds: braking to a stop, standing, and a left turn of about 90 degrees."""
    rows, yaw = [], 0.0
    for i in range(200):
        t = i * 0.1
        ax = -2.0 if 2 <= t < 4 else 0.0
        speed = 5.0 if t < 4 else 0.5 if t < 6 else 4.0
        yaw += 0.1 * (math.pi / 4 if 10 <= t < 12 else 0.0)
        rows.append(("c", int(t * 1e6), math.cos(yaw / 2), 0.0, 0.0, math.sin(yaw / 2), speed, 0.0, ax))
    ego = spark.createDataFrame(rows, "clip_id string, timestamp_us long, qw double, qx double, qy double, qz double, vx double, vy double, ax double")
    cam = ego.select("clip_id", "timestamp_us")
    s = scenario.ego_series(ego, cam)
    found = {r.kind: (r.t0, r.t1) for r in scenario.ego_events(s).collect()}
    assert set(found) == {"decelerate", "stop", "turn_left"}
    assert found["decelerate"] == (2.0, 3.9) and found["stop"] == (4.0, 5.9)
    points = [("c", "p1", "pedestrian::pedestrian", i * 0.5, 10.0 - i, 0.5, 0.0) for i in range(5)]
    points += [("c", "v1", "vehicle::car", i * 0.5, 12.0, 3.0 - 0.6 * i, 0.0) for i in range(6)]
    tracks = spark.createDataFrame(points, "clip_id string, track_id string, cls string, t double, x double, y double, yaw double")
    agents = {r.track_id: (r.object_type, r.role) for r in scenario.agent_events(tracks).collect()}
    assert agents == {"p1": ("pedestrian", "crossing"), "v1": ("vehicle", "adjust")}
    cats = {(r.cat) for r in scenario.taxonomy(tracks, s, scenario.ego_events(s)).collect()}
    assert "ped_crossing" in cats and "decel_at_intersection" in cats


def test_hits_are_the_rows_of_all_runs(spark):
    df = spark.createDataFrame([("a", 0, 1, 9), ("a", 1, 1, 0), ("a", 2, None, 9), ("a", 3, 1, 9), ("b", 0, 0, 0)], "k string, t int, x int, y int")
    found = series.hits(df, ["k"], ["t"], {"one": F.col("x") == 1, "nine": F.col("y") == 9}, ["t"])
    runs = found.groupBy("k", "kind", "run").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"))
    assert sorted((r.k, r.kind, r.t0, r.t1, r.n) for r in runs.collect()) == [("a", "nine", 0, 0, 1), ("a", "nine", 2, 3, 2), ("a", "one", 0, 1, 2), ("a", "one", 3, 3, 1)]


def test_window_selection(spark):
    w = spark.createDataFrame(
        [("x", "c1", 0.0, ["stop", "decelerate"], -5.0, True, 0.5), ("x", "c1", 5.0, ["turn_left", "stop"], 0.0, False, 0.5), ("x", "c2", 0.0, [], 0.0, False, None)],
        "cond string, clip_id string, w0 double, kinds array<string>, min_ax double, reactive boolean, vlm_score double",
    )
    out = {r.clip_id: (round(r.clip_score, 4), r.n, r.rank) for r in scenario.select_windows(w, ["cond"]).collect()}
    assert out == {"c1": (round((2.5 * 2 + 1 + 1) * 0.5 + 0.15, 4), 2, 1), "c2": (0.0, None, 2)}


def test_kitti_round_trip(spark):
    lines = spark.createDataFrame([("i", 0, "Car 0.00 0 1.5 1 2 3 4 1.5 1.6 3.9 1 2 3 0.1"), ("i", 1, "DontCare -1 -1 -10 1 2 3 4 -1 -1 -1 -1000 -1000 -1000 -10")], "image string, pos int, value string")
    rows = readers.kitti_labels(lines).orderBy("pos").collect()
    assert rows[0].dimensions == [3.9, 1.5, 1.6] and [r["index"] for r in rows] == [0, -1]
    line = writers.kitti_line(readers.kitti_labels(lines).where("pos = 0")).first().value.split(" ")
    assert line[0] == "Car" and [float(x) for x in line[8:11]] == [1.5, 1.6, 3.9]


def test_files(spark, tmp_path):
    import struct

    (tmp_path / "ids.txt").write_text(" a \n\n b\n")
    assert [r.clip_id for r in readers.id_lines(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]
    body = b"".join(struct.pack("<QI", len(x), 0) + x + struct.pack("<I", 0) for x in (b"one", b"three")) + b"\x09\x00"
    (tmp_path / "x.rec").write_bytes(body)
    assert [bytes(r.record) for r in readers.framed_records(spark, str(tmp_path / "x.rec")).orderBy("n").collect()] == [b"one", b"three"]
    np.arange(6, dtype="<f4").tofile(tmp_path / "p.bin")
    assert [(r.x, r.y, r.z) for r in readers.points(spark, str(tmp_path / "p.bin")).collect()] == [(0, 1, 2), (3, 4, 5)]
    (tmp_path / "m.ply").write_text("ply\nend_header\n1 2 3\n4 5 6 7 8 9\n")
    assert [(r.x, r.r) for r in readers.ply_points(spark, str(tmp_path / "m.ply")).orderBy("x").collect()] == [(1.0, 128), (4.0, 7)]
    writers.write_json(spark.createDataFrame([("e", 1, None)], "exp string, b int, a string"), str(tmp_path / "out"), ["exp"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":null,"b":1}']


def test_records_leave_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "BATCH_BYTES", 40)
    data = [bytes([65 + i]) * (7 * i) for i in range(12)]
    (tmp_path / "many.rec").write_bytes(b"".join(struct.pack("<Q", len(x)) + b"0000" + x + b"0000" for x in data) + struct.pack("<Q", 99) + b"cut")
    (tmp_path / "none.rec").write_bytes(b"")
    rows = readers.framed_records(spark, f"{tmp_path}/*.rec").orderBy("n").collect()
    assert [(r.n, bytes(r.record)) for r in rows] == list(enumerate(data))


def test_first_source(spark):
    a, b = spark.createDataFrame([("x", 1), ("x", 2)], "k string, v int"), spark.createDataFrame([("x", 3), ("y", 4), (None, 5)], "k string, v int")
    assert sorted(tuple(r) for r in readers.first_source([a, b], "k").select("k", "v", "source").collect()) == [("x", 1, 0), ("x", 2, 0), ("y", 4, 1)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, t0 double, t1 double, d double")
    assert intervals.suppress(e, ["k"], ["d"]).count() == 0 and series.merge(e, ["k"], 1.0).count() == 0
    assert ranking.contiguous_shards(e.select("d"), "d", 3).count() == 0


def test_stream_sessions(spark, tmp_path):
    from skarn.streaming import sessions

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    s = sessions.session_episodes(sessions.event_stream(spark, str(tmp_path / "in"), schema), "user_id", "event_type", "ts", "1 hour")
    q = s.writeStream.outputMode("append").format("memory").queryName("sessions_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sessions_out").count() > 0


def test_filters_keep_groups_whole(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.0, 1.0), ("a", 2.0, 9.0), ("b", 0.5, 1.0), ("c", None, None)]
    df = spark.createDataFrame(rows, "k string, t double, x double")
    spans = spark.createDataFrame([("a", 0.0, 2.0), ("b", 0.0, 2.0)], "k string, lo double, hi double")
    assert sorted(r.t for r in filters.time_clip(df, ["k"], "t", spans).collect()) == [0.0, 1.0, 2.0]
    assert sorted((r.k, r.t) for r in filters.in_ranges(df, ["k"], {"x": (0.0, 5.0)}, 2).collect()) == [("a", 0.0), ("a", 1.0)]
    clean = filters.clean_frames(spans.select("k"), df, ["k"], F.col("x") > 5, 0.3)
    assert [r.k for r in clean.collect()] == ["b"]
    said = spark.createDataFrame([("a", False), ("a", True), ("b", None)], "k string, ok boolean")
    assert sorted(r.k for r in filters.kept_unless_denied(df.select("k").distinct(), said, ["k"], "ok").collect()) == ["b", "c"]


def test_robust_line_ignores_outliers(spark):
    rows = [(i, float(i % 40), 2.0 * (i % 40) + 1.0 if i % 5 else 500.0 - i) for i in range(200)]
    df = spark.createDataFrame([("a", *r) for r in rows] + [("b", 1, 3.0, 1.0), ("b", 2, 3.0, 2.0), ("c", 1, None, 1.0)], "k string, id long, x double, y double")
    (got,) = parameters.robust_line(df, ["k"], "id", "x", "y", 0.5).collect()
    assert got.k == "a" and abs(got.slope - 2) < 1e-9 and abs(got.intercept - 1) < 1e-9 and got.n_inliers >= 160


def test_temporal_queue_and_flat_top_k(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)], "k string, i int")
    q = parameters.temporal_queue(df, ["k"], ["i"], "i", 3, F.lit(1)).orderBy("i").collect()
    assert [r.queue for r in q] == [[0], [0, 1], [0, 1, 2], [0, 2, 3], [1, 3, 4]]
    hashed = parameters.temporal_queue(df, ["k"], ["i"], "i", 3, seed=7).orderBy("i").collect()
    assert [len(r.queue) for r in hashed] == [1, 2, 3, 3, 3]
    s = spark.createDataFrame([("a", 0, 0.5, 0.9), ("a", 1, 0.9, 0.1)], "k string, q int, s0 double, s1 double")
    assert [(r.q, r.label) for r in parameters.flat_top_k(s, ["k"], "q", ["s0", "s1"], 3).orderBy("rank").collect()] == [(0, 1), (1, 0), (0, 0)]


def test_parameter_tables(spark):
    a = spark.createDataFrame([("w", 0, 1.0), ("w", 1, 2.0)], "k string, i int, v double")
    b = spark.createDataFrame([("w", 0, 4.0), ("u", 0, 5.0)], "k string, i int, v double")
    assert {(r.k, r.i): (r.side, r.diff) for r in parameters.difference(a, b, ["k", "i"], "v").collect()} == {("w", 0): ("both", 3.0), ("w", 1): ("only_a", None), ("u", 0): ("only_b", None)}
    every = a.withColumn("c", F.lit(1)).unionByName(b.withColumn("c", F.lit(2)))
    assert {(r.k, r.i): (r.v, r.n) for r in parameters.average(every, ["k", "i"], "v", "c").collect()} == {("w", 0): (2.5, 2), ("w", 1): (2.0, 1), ("u", 0): (5.0, 1)}


def test_grounded_components(spark):
    kind = "array<struct<object_type:string,relation:string>>"
    rows = [([("car", "x"), ("car", None), ("bus", None), (None, None)], [("car", "lead"), ("car", "cut"), ("dog", "cross"), ("dog", None)]), (None, None), ([("car", None)], [])]
    df = spark.createDataFrame(rows, f"c {kind}, o {kind}")
    got = [r.r for r in df.select(rules.grounded_components(F.col("c"), F.col("o")).alias("r")).collect()]
    assert [tuple(x) for x in got[0].components] == [("gt", "car", "cut"), ("model", None, None), ("model", None, None), ("model", None, None), ("gt_injected", "dog", "cross"), ("gt_injected", "dog", None)]
    assert [x.covered_by_model for x in got[0].consistency] == [True, True, False, False]
    assert got[1].components == [] and [tuple(x) for x in got[2].components] == [("model", None, None)]


def test_card_problems(spark):
    good = "가설: a\n대조 조건: b\n등록 시각: 2024\n변경 축: lr"
    df = spark.createDataFrame([(0, good), (1, None), (2, good.replace("lr", "lr, wd")), (3, "가설: a")], "i int, t string")
    got = [r.p for r in df.orderBy("i").select(rules.card_problems(F.col("t")).alias("p")).collect()]
    assert got == [[], ["no card"], ["several: 변경 축"], ["missing: 대조 조건", "missing: 사전 등록 시각", "missing: 변경 축"]]


def test_optimal_match_is_least(spark):
    from itertools import permutations

    from skarn.operators.matching import optimal_match

    rng = np.random.default_rng(3)
    p, t = rng.random((5, 4)), rng.random((4, 4))
    pd_ = spark.createDataFrame([("a", i, [float(v) for v in b], [0.5]) for i, b in enumerate(p)], "k string, id long, box array<double>, probs array<double>")
    td = spark.createDataFrame([("a", i, [float(v) for v in b], 0) for i, b in enumerate(t)], "k string, id long, box array<double>, label int")
    got = optimal_match(pd_, td, ["k"]).collect()
    cost = np.abs(p[:, None] - t[None]).sum(-1) - 0.5
    want = min(sum(cost[i, j] for j, i in enumerate(perm)) for perm in permutations(range(5), 4))
    assert len(got) == 4 and abs(sum(r.cost for r in got) - want) < 1e-9


def test_draws_by_hash(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(50)], "id long, g string")
    a, b = ([r.id for r in ranking.seeded_sample(df, "id", 20, seed).collect()] for seed in (1, 2))
    assert len(set(a)) == len(set(b)) == 20 and a != b and a == [r.id for r in ranking.seeded_sample(df.repartition(7), "id", 20, 1).collect()]
    padded = ranking.group_padded(df, "g", "id", 4, 2, 7).collect()
    for g, n in (("a", 33), ("b", 17)):
        mine = [r for r in padded if r.g == g]
        assert sorted(r.place for r in mine) == list(range(-(-n // 8) * 8)) and len({r.id for r in mine}) == n
        assert all(r.batch == r.place // 4 and r["rank"] == r.batch % 2 for r in mine)
    assert ranking.drop_share(df, "id", 0.3, 5).count() == 35


def test_select_windows_brute_force(spark):
    from skarn.config import DEFAULT as th

    rng = random.Random(5)
    names = ["decelerate", "accelerate", "stop", "turn_left", "lane_change_right"]
    rows = [(c % 2, f"c{c}", float(w), rng.choices(names, k=rng.randint(0, 6)), rng.uniform(-8, 0), rng.choice([True, False, None]), rng.choice([None, rng.random()])) for c in range(12) for w in range(5)]
    df = spark.createDataFrame(rows, "cond int, clip_id string, w0 double, kinds array<string>, min_ax double, reactive boolean, vlm_score double")
    clips = {}
    for cond, clip, w0, ks, ax, re, v in rows:
        r = 2.5 * min(max(0, -ax - 3), 4) + min(ks.count("decelerate"), 4) + 0.8 * ("stop" in ks and "accelerate" in ks) + ("stop" in ks) + ("lane_change_right" in ks) + 0.6 * ("turn_left" in ks)
        clips.setdefault((cond, clip), [])
        if r >= th.reactivity_floor:
            clips[cond, clip].append((r, w0, (v or 0.0) * (1 if re else 0.2)))
    want = {}
    for key, ws in clips.items():
        best = sorted(ws, key=lambda w: (-w[0], w[1]))[: th.windows_per_clip]
        want[key] = max(r * v for r, _, v in best) + th.window_bonus * (len(best) - 1) if best else 0.0
    out = scenario.select_windows(df, ["cond"]).collect()
    assert {(r.cond, r.clip_id): pytest.approx(r.clip_score) for r in out} == want
    for cond in (0, 1):
        mine = sorted((r for r in out if r.cond == cond), key=lambda r: r["rank"])
        top = max(want[k] for k in want if k[0] == cond) or 1.0
        assert [r["rank"] for r in mine] == list(range(1, 7)) and all(abs(r.score_norm - want[cond, r.clip_id] / top) < 1e-9 for r in mine)
        assert [r.score_norm for r in mine] == sorted((r.score_norm for r in mine), reverse=True)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_positions_of_wide_rows(spark, adaptive):
    """Every row once, in its place, whatever other columns there are and whoever reads which."""
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 30_000
        df = spark.range(n).select((n - F.col("id")).alias("k"), F.repeat(F.lit("wide text "), 20).alias("text"), F.lit(1).alias("_at"))
        got = ranking.contiguous_shards(df.repartition(7), "k", 7)
        assert got.count() == -(-n // 7) * 7
        assert got.where((F.col("place") % n) != F.col("k") - 1).count() == 0
        assert got.select("rank").distinct().count() == 7 and got.select("text", "place").where("place < 30000").distinct().count() == n
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_large_samples_are_cut_by_counts(spark, monkeypatch):
    df = spark.range(5000)
    whole = [r.id for r in ranking.seeded_sample(df, "id", 5000, 3).collect()]
    monkeypatch.setattr(ranking, "SORTED_AT_ONCE", 10)
    for n in (0, 11, 700, 4999, 5000, 6000):
        assert sorted(r.id for r in ranking.seeded_sample(df, "id", n, 3).collect()) == sorted(whole[:n])
    assert ranking.drop_share(df, "id", 0.25, 3).count() == 3750
