"""Neighbours, binned interval joins, lanes, binary files, places in groups and streams with state, by brute force and by their plans."""

import collections
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.functions import rules, scalar
from skarn.operators import intervals, neighbours, ranking, series
from skarn.plans import lanes, scenario
from skarn.sources import binary, readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- nearest neighbours ---------------------------------------------------------------------------------------------


def brute_outliers(points, k, sigma):
    """Of each cloud: mean distances to the nearest k, itself included; kept if above 0 and below centre + sigma * sample deviation."""
    keep = []
    for cloud in {c for _, c, *_ in points}:
        own = [(i, p) for i, c, *p in points if c == cloud and None not in p]
        means = {}
        for i, p in own:
            d = sorted(math.dist(p, q) for _, q in own)[:k]
            means[i] = sum(d) / len(d)
        n = len(own)
        if not n:
            continue
        centre = sum(m for m in means.values() if m > 0) / n
        spread = math.sqrt(sum((m - centre) ** 2 for m in means.values() if m > 0) / (n - 1)) if n > 1 else float("nan")
        keep += [i for i, m in means.items() if 0 < m < centre + sigma * spread]
    return sorted(keep)


@pytest.fixture(scope="module")
def clouds():
    rng = random.Random(9)
    rows = [(i, "a", *(rng.gauss(0, 1) for _ in range(3))) for i in range(150)]
    rows += [(200 + i, "a", 30.0 + i, 0.0, 0.0) for i in range(2)]  # far out
    rows += [(300 + i, "a", 0.5, 0.5, 0.5) for i in range(30)]  # more than k at one place
    rows += [(400, "b", 1.0, 2.0, 3.0)]  # a point alone
    rows += [(500 + i, "c", float(i), 0.0, 0.0) for i in range(4)]  # fewer than k
    rows += [(600 + i, None, rng.random(), rng.random(), 0.0) for i in range(40)] + [(700, "a", None, 0.0, 0.0)]
    return rows


@pytest.mark.parametrize("cell", [0.05, 1.0, 40.0])
def test_outliers_for_any_cell(spark, clouds, cell):
    df = spark.createDataFrame(clouds, "id long, cloud string, x double, y double, z double").repartition(3)
    got = neighbours.outliers_removed(df, ["cloud"], ["x", "y", "z"], cell, 20, 2.0)
    assert sorted(r.id for r in got.collect()) == brute_outliers(clouds, 20, 2.0) and got.columns == df.columns


def test_neighbours_of_copies_make_no_pairs(spark):
    """A place that a third of all points share is one position; without a key too."""
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") * 0.01).alias("x"))
    near = neighbours.nearest_distances(df, [], ["x"], 5, 0.02).collect()
    assert len(near) == 4001 and {(r._x0, r.found, r.total) for r in near if r._x0 == 0} == {(0.0, 5, 0.0)}
    at = sorted([0.0] * 2000 + [i * 0.01 for i in range(6000) if i % 3])
    for r in near[::397]:
        assert math.isclose(r.total, sum(sorted(abs(r._x0 - v) for v in at)[:5]), abs_tol=1e-9)
    assert neighbours.outliers_removed(df.where("1 = 0"), [], ["x"], 1.0).count() == 0


def test_levels_follow_the_crowd(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2900, F.col("id") * 1e-6).otherwise(F.col("id") * 1.0).alias("_x0"), F.lit(1).alias("m"))
    levels = collections.Counter(r.level for r in neighbours.levelled(df, [], ["_x0"], 10.0).collect())
    assert levels[0] == 100 and min(levels) < -10 and sum(levels.values()) == 3000


# --- intervals ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [None, 0.3, 5.0, 1000.0])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_overlaps_by_bins(spark, width, how):
    rng = random.Random(5)
    mk = lambda n: [(rng.choice("pq"), i, t, t + rng.choice([0.0, 0.5, 2.0, 30.0])) for i in range(n) for t in [round(rng.uniform(-20, 60), 1)]]
    a, b = mk(60), mk(40)
    a += [("p", 900, None, 3.0), ("p", 901, 5.0, None), ("q", 902, 8.0, 7.0), a[0], ("z", 903, 0.0, 1.0)]
    schema = "k string, i int, t0 double, t1 double"
    got = intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], how, 0.25, width)
    meets = lambda x, y: None not in x and x[0] == y[0] and y[3] >= x[2] - 0.25 and y[2] <= x[3] + 0.25 and x[3] + 0.25 >= x[2] - 0.25
    pairs = [(x, y) for x in a for y in b if meets(x, y)]
    rows = collections.Counter(tuple(r) for r in got.collect())
    if how in ("inner", "left"):
        want = [(*x, *y[1:]) for x, y in pairs] + ([(*x, None, None, None) for x in a if not any(meets(x, y) for y in b)] if how == "left" else [])
    else:
        want = [x for x in a if any(meets(x, y) for y in b) == (how == "left_semi")]
    assert rows == collections.Counter(want)


def test_many_intervals_of_one_key_are_not_all_paired(spark):
    """10^5 intervals of one key: the join's rows stay near the number of hits."""
    n = 100_000
    a = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("i"), (F.col("id") * 1.0).alias("t0"), (F.col("id") + 1.5).alias("t1"))
    hit = intervals.overlap_join(a, a, ["k"], width=3.0)
    assert hit.count() == 3 * n - 2  # itself and a neighbour on either side
    candidates = intervals.binned(a, F.col("t0"), F.col("t1"), 3.0).groupBy("_bin").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert candidates < 10 * n


def test_best_overlap_and_nearest_frame(spark):
    rng = random.Random(8)
    a = [("k", i, t, t + 5.0) for i in range(30) for t in [rng.uniform(0, 100)]] + [("none", 77, 0.0, 1.0)]
    b = [("k", i, t, t + rng.choice([1.0, 9.0])) for i in range(20) for t in [float(rng.randint(0, 100))]]
    da, db = spark.createDataFrame(a, "k string, i int, t0 double, t1 double"), spark.createDataFrame(b, "k string, pos int, t0 double, t1 double")
    got = {r.i: r.b_pos for r in intervals.best_overlap(da, db, ["k"], ["i"], "pos").collect()}
    for k, i, t0, t1 in a:
        over = [(-(min(t1, y1) - max(t0, y0)), p) for kk, p, y0, y1 in b if kk == k and min(t1, y1) - max(t0, y0) > 0]
        assert got[i] == (min(over)[1] if over else None)
    frames = [("k", float(rng.randint(0, 50)), i) for i in range(40)]
    near = {(r.t0, r.t1): r.nearest for r in intervals.nearest_frame(da.select("k", "t0", "t1"), spark.createDataFrame(frames, "k string, ts double, frame int"), ["k"]).collect()}
    for k, _, t0, t1 in a:
        best = min(((min(abs(ts - t0), abs(ts - t1)), ts, f) for kk, ts, f in frames if kk == k), default=(0, 0, None))
        assert near[t0, t1] == best[2]


# --- rules of lanes and causes --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "states, side",
    [
        ("L L L in in in", "L"), ("R L L L in in in", "L"), ("R R R in ? in in", "R"),
        ("L in R in", None), ("L in", None), ("L L ? L in in in", None), ("L L L in in in R in", None), ("L L L in in in L", None),
        ("L L in in in", None), ("? ? ? in in in", None), ("in in in", None), ("L L L", None), ("L L L in in ? in L in", "L"),
    ],
)
def test_entered_from_side(spark, states, side):
    rows = [(1, i, s) for i, s in enumerate(states.split())]
    got = series.entered_from_side(spark.createDataFrame(rows, "k int, t int, s string"), ["k"], ["t"], "s").collect()
    assert [r.side for r in got] == [side]


def test_straight_by_rule(spark):
    log = spark.createDataFrame([("a", float(t), 0.1 * t) for t in range(100)] + [("a", 200.0, 9.0)], "k string, t double, yaw double")
    turns = spark.createDataFrame([("a", 5.0, 6.0), ("a", 60.0, 60.0)], "k string, t0 double, t1 double")
    rows = [("a", 0.0, 4.0, "x"), ("a", 0.0, 5.0, None), ("a", 0.0, 5.0, "n"), ("a", 10.0, 50.0, None), ("a", 10.1, 10.2, None), ("a", 70.0, 71.0, None), ("a", 70.0, 71.0, None), ("b", 0.0, 9.0, None)]
    ranges = spark.createDataFrame(rows, "k string, t0 double, t1 double, note string")
    got = sorted(map(tuple, series.straight(ranges, turns, log, ["k"], "t", "yaw", 2.0).collect()), key=str)
    want = [True, False, False, False, True, True, True, True]
    assert got == sorted(((*r, w) for r, w in zip(rows, want)), key=str)


def test_causal_agent(spark):
    eps = spark.createDataFrame([("c", i, float(20 * i), 20.0 * i + 4, 20.0 * i) for i in range(6)], "clip_id string, ep int, t0 double, t1 double, onset double")
    agents = [
        ("adj", "adjust", 5.0, 0.0, 4.0),  # never a cause
        ("far", "crossing", 40.0, 20.0, 24.0), ("lead", "preceding_vehicle", 29.9, 20.0, 24.0),
        ("near", "crossing", 14.0, 40.0, 44.0), ("nearer lead", "preceding_vehicle", 3.0, 40.0, 44.0),
        ("late", "crossing", 1.0, 61.5, 64.0), ("edge", "crossing", 15.0, 60.0, 64.0),
        ("lead 30", "preceding_vehicle", 30.0, 80.0, 84.0), ("onset +1", "crossing", 2.0, 81.0, 84.0),
    ]
    a = spark.createDataFrame([("c", *x) for x in agents], "clip_id string, object_type string, role string, min_dist double, t0 double, t1 double")
    got = {r.ep: r.a_object_type for r in scenario.causal_agent(eps, a).collect()}
    assert got == {0: None, 1: "lead", 2: "near", 3: None, 4: "onset +1", 5: None}


def test_interpolation_like_numpy(spark):
    rng = random.Random(3)
    lines = [[(round(rng.uniform(-3, 40), 2), round(rng.uniform(-4, 4), 2), 0.0) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, p array<struct<x:double,y:double,z:double>>")
    for x in (5.0, 8.0, 30.0):
        got = {r.i: r.y for r in df.select("i", scalar.interpolated_y(F.col("p"), x).alias("y")).collect()}
        for i, line in enumerate(lines):
            near = sorted(p for p in line if x - 6 < p[0] < x + 6)
            if len(near) < 2 or x < near[0][0] - 1.5 or x > near[-1][0] + 1.5:
                assert got[i] is None
            else:
                assert math.isclose(got[i], float(np.interp(x, [p[0] for p in near], [p[1] for p in near])), abs_tol=1e-9)


def test_crossings_count_changes_between_frames_with_lines(spark):
    """The prefix sums against a walk over the frames of each span."""
    rng = random.Random(2)
    right = [rng.choice([1, 1, 2, 3, None]) for _ in range(40)]
    line = lambda y: [float(v) for x in (2, 6, 9, 12) for v in (x, y, 0)]
    ys = lambda r: [] if r is None else [line(1.75), line(5.25), *[line(-1.75 - 0.1 * k) for k in range(r)]]
    fr = lanes.frames(spark.createDataFrame([("c", i, ys(r)) for i, r in enumerate(right)], "clip_id string, frame_idx int, divider_polylines array<array<double>>"))
    spans = [(a, b) for a in range(0, 40, 3) for b in range(a, 40, 5)]
    rows = [("c", "turn", i, float(a), float(b), 39.0) for i, (a, b) in enumerate(spans)]
    got = {r.run: r.lane_crossings for r in lanes.road(spark.createDataFrame(rows, "clip_id string, kind string, run int, t0 double, t1 double, dur double"), fr).collect()}
    for i, (a, b) in enumerate(spans):
        seen = [r for r in right[a : b + 1] if r is not None]
        assert got[i] == (sum(x != y for x, y in zip(seen, seen[1:])) if b > a else 0)


def test_rules_on_missing_values(spark):
    df = spark.createDataFrame([("agent", None, None)], "subject string, kind string, role string")
    f = {"ego_action": F.lit(None).cast("string"), "object_type": F.col("kind"), "longitudinal_action": F.lit("x"), "relation": F.lit("y"), "vru_detail": F.lit("z")}
    got = df.select(*(v.alias(k) for k, v in rules.cleaned(F.col("subject"), F.col("role"), f, ["ego_stop"], {"a": "b"}).items())).first()
    assert (got.object_type, got.longitudinal_action, got.relation, got.vru_detail) == (None, "x", "y", None)
    empty = df.select(rules.search_tags(F.lit("a"), F.lit(None).cast("array<string>"), F.col("kind"), F.lit(None).cast(rules.COMPONENTS)).alias("t")).first()
    assert empty.t == ["cause:None", "ego_action:a"]


# --- binary files ---------------------------------------------------------------------------------------------------


def framed(records):
    return b"".join(struct.pack("<QI", len(r), 7) + r + b"abcd" for r in records)


def test_framed_records_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "LOOK_BYTES", 64)
    rng = random.Random(1)
    data = [rng.randbytes(rng.choice([0, 1, 9, 200, 3000])) for _ in range(120)]
    (tmp_path / "a b.rec").write_bytes(framed(data) + struct.pack("<QI", 99, 0) + b"cut short")
    (tmp_path / "c.rec").write_bytes(framed(data[:3])[:-2])  # the last check is cut
    (tmp_path / "empty.rec").write_bytes(b"")
    df = readers.framed_records(spark, f"{tmp_path}/*.rec", 1000)
    rows = df.collect()
    got = {name: sorted((r.n, bytes(r.record)) for r in rows if r.path.endswith(name)) for name in ("b.rec", "c.rec")}
    assert got == {"b.rec": list(enumerate(data)), "c.rec": list(enumerate(data[:2]))}
    ranges = binary._ranges(binary.listed(spark, f"{tmp_path}/a*.rec"), binary._frames, 1000).collect()
    assert len(ranges) > 5 and df.rdd.getNumPartitions() >= len(ranges) // 2
    edges = sorted((r.start, r.stop) for r in ranges)
    assert edges[0][0] == 0 and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))


def test_a_file_above_two_gigabytes(spark, tmp_path):
    """A sparse file of 2.5 GB: records of 100 MB of zeros, and the last one short; only what is read costs."""
    path = tmp_path / "large.rec"
    size = 100_000_000
    with open(path, "wb") as f:
        for _ in range(25):
            f.write(struct.pack("<QI", size, 0))
            f.seek(size + 4, 1)
        f.write(struct.pack("<QI", 3, 0) + b"end" + b"0000")
    assert path.stat().st_size > 2 << 30
    ranges = sorted(map(tuple, binary._ranges(binary.listed(spark, str(path)), binary._frames, binary.RANGE_BYTES).select("start", "stop", "first").collect()))
    assert len(ranges) == 13 and ranges[-1][1] == path.stat().st_size and ranges[-1][2] == 24
    # the tail's range, as its task reads it
    with binary.opened(str(path))[0].open_input_file(str(path)) as f:
        f.seek(25 * (size + 16))
        assert f.read(12)[:8] == struct.pack("<Q", 3)


def test_points_in_ranges(spark, tmp_path):
    a = np.arange(3000, dtype="<f4")
    (tmp_path / "p.bin").write_bytes(a.tobytes() + b"\1\2\3")
    df = readers.points(spark, f"{tmp_path}/p.bin", range_bytes=1 << 10)
    got = sorted((r.n, r.x, r.y, r.z) for r in df.collect())
    assert got == [(i, *row) for i, row in enumerate(a.reshape(-1, 3).tolist())] and df.rdd.getNumPartitions() >= 12


def test_ply_headers(spark, tmp_path):
    """Other properties between, other orders, an element with lists before the vertices, faces behind, colours as numbers or none."""
    head = b"ply\nformat binary_big_endian 1.0\ncomment x\nelement face 2\nproperty list uchar int vertex_indices\nelement vertex 2\nproperty float x\nproperty double nx\nproperty float y\nproperty short z\nproperty uchar green\nproperty uchar red\nproperty uchar blue\nend_header\n"
    faces = struct.pack(">BiiiBi", 3, 0, 1, 1, 1, 0)
    (tmp_path / "a.ply").write_bytes(head + faces + struct.pack(">fdfhBBB", 1.5, 9, 2.5, -3, 20, 10, 30) + struct.pack(">fdfhBBB", 4, 9, 5, 6, 2, 1, 3))
    (tmp_path / "b.ply").write_bytes(b"ply\r\nformat ascii 1.0\r\nelement vertex 2\r\nproperty float y\r\nproperty float x\r\nproperty float z\r\nelement face 1\r\nproperty list uchar int vertex_indices\r\nend_header\r\n2 1 3\r\n5 4 6\r\n3 0 1 1\r\n")
    (tmp_path / "c.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + struct.pack("<6f", 1, 2, 3, 4, 5, 6) + b"\0\0")
    got = sorted((r.path[-5], r.n, r.x, r.y, r.z, r.r, r.g, r.b) for r in readers.ply_points(spark, f"{tmp_path}/*.ply").collect())
    assert got == [
        ("a", 0, 1.5, 2.5, -3.0, 10, 20, 30), ("a", 1, 4.0, 5.0, 6.0, 1, 2, 3),
        ("b", 0, 1.0, 2.0, 3.0, 128, 128, 128), ("b", 1, 4.0, 5.0, 6.0, 128, 128, 128),
        ("c", 0, 1.0, 2.0, 3.0, 128, 128, 128), ("c", 1, 4.0, 5.0, 6.0, 128, 128, 128),
    ]


# --- places without a task that holds a group -----------------------------------------------------------------------


def test_places_in_groups(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").alias("g"))
    got = collections.defaultdict(list)
    for r in ranking.drawn_places(df, "g", "id", 3).withColumn("d", ranking.draw("id", 3)).collect():
        got[r.g].append((r._i, r.d, r.id, r._n))
    assert set(got) == {"big", "mid", None}
    for rows in got.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows))) and [r[1:3] for r in rows] == sorted(r[1:3] for r in rows) and {r[3] for r in rows} == {len(rows)}
    text = plan(ranking.drawn_places(df, "g", "id", 3))
    assert "windowspecdefinition(g" not in text.replace("windowspecdefinition(g#", "windowspecdefinition(g") or "_cell" in text


def test_slices_and_maxima_by_plan(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id") * 1.0).alias("v"))
    sliced = ranking.slice_rows(df, ["g", F.col("id").desc()], 400, 37)
    want = sorted(range(1000), key=lambda i: (i % 7, -i))[400:437]
    assert sorted(r.id for r in sliced.collect()) == sorted(want)
    assert "TakeOrdered" not in plan(sliced) and "CollectLimit" not in plan(sliced) and "SinglePartition" not in plan(sliced.where("1 = 1")).split("BroadcastExchange")[0]
    assert ranking.slice_rows(df, ["id"], 990).count() == 10 and ranking.slice_rows(df, ["id"], 2000).count() == 0
    scaled = ranking.normalise_max(df.withColumn("g", F.when(F.col("g") > 0, F.col("g"))), ["g"], "v", "n")
    assert "Window" not in plan(scaled) and scaled.count() == 1000 and scaled.agg(F.max("n")).first()[0] == 1.0 and scaled.where("g is null and n is not null").count() > 0


# --- streams --------------------------------------------------------------------------------------------------------


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_stream_merges_intervals_like_a_table(rocks, tmp_path):
    """Files in order of start, rows out of order within the watermark, one too late, one that bridges two open episodes."""
    from skarn.streaming import sessions

    spark = rocks
    ts = lambda m: F.timestamp_seconds(F.lit(1_700_000_000) + m * 60)
    files = [
        [("a", "x", 0, 5), ("a", "y", 12, 14), ("b", "x", 3, 90)],
        [("a", "z", 4, 11), ("b", "y", 40, 41), ("a", "x", 60, 61)],  # 4 to 11 bridges 0-5 and 12-14
        [("a", "x", 200, 201), ("b", "x", 95, 96)],
        [("a", "late", 2, 3), ("a", "x", 203, 204)],  # starts before the watermark
        [("end", "end", 100_000, 100_001)],
    ]
    schema = "k string, kind string, a long, b long"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).select("k", "kind", ts(F.col("a")).alias("t0"), ts(F.col("b")).alias("t1")).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    import os
    import time

    now = time.time()
    os.makedirs(tmp_path / "flat")
    for i in range(len(files)):
        (part,) = (p for p in os.listdir(tmp_path / "in" / f"f{i}") if p.startswith("part"))
        os.rename(tmp_path / "in" / f"f{i}" / part, tmp_path / "flat" / f"{i}.parquet")
        os.utime(tmp_path / "flat" / f"{i}.parquet", (now - 100 + i * 10,) * 2)
    stream = spark.readStream.schema("k string, kind string, t0 timestamp, t1 timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flat").withWatermark("t0", "30 minutes")
    merged = sessions.merged_episodes(stream, "k", "kind", "t0", "t1", 120.0)
    q = merged.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    got = sorted((r.k, (r.t0.timestamp() - 1_700_000_000) / 60, (r.t1.timestamp() - 1_700_000_000) / 60, r.n, r.kinds) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = [("a", 0.0, 14.0, 3, ["x", "y", "z"]), ("a", 60.0, 61.0, 1, ["x"]), ("a", 200.0, 204.0, 2, ["x"]), ("b", 3.0, 90.0, 2, ["x", "y"]), ("b", 95.0, 96.0, 1, ["x"])]
    assert got == want
    table = spark.createDataFrame([r for f in files[:3] for r in f] + [files[3][1]], schema).select("k", "kind", (F.col("a") * 60.0).alias("t0"), (F.col("b") * 60.0).alias("t1"))
    batch = series.episodes(table, ["k"], 120.0)
    assert sorted((r.k, r.t0 / 60, r.t1 / 60, len(r.kinds)) for r in batch.collect()) == [(k, a, b, n) for k, a, b, n, _ in want]


def test_stream_deduplication(spark, tmp_path):
    from skarn.streaming import sessions

    rows = [(i % 7, f"2024-01-01 00:{i % 60:02d}:00") for i in range(200)]
    df = spark.createDataFrame(rows, "k int, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = sessions.event_stream(spark, f"{tmp_path}/in", "k int, ts timestamp", delay="10 days")
    sessions.deduplicated(stream, ["k"]).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(7))
