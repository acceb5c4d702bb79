"""Queries against their whole input, and steps whose cost must follow the rows."""

import io
import random
import re
import struct

import pandas as pd
from pyspark.sql import functions as F

from skarn import file_queries, item_queries, lane_queries, more_queries  # noqa: F401 - add to QUERIES
from skarn.functions import scalar
from skarn.operators import aggregates, matching, parameters, series
from skarn.plans import lanes, scenario
from skarn.queries import KIND, QUERIES
from skarn.sources import binary, readers
from skarn.streaming import sessions

DATA = "/root/testdata/sf0.001"


def given(name):
    return pd.read_parquet(f"{DATA}/{name}.parquet")


def test_pool_anti_looks_at_all_orders(spark):
    want = set(given("customer").c_custkey) - set(given("orders").o_custkey)
    assert {r.c_custkey for r in QUERIES["pool_anti"](spark, DATA).collect()} == want


def test_action_axes_see_all_events_of_a_user(spark):
    e = given("events").sort_values(["ts", "event_id"])
    kinds = e.assign(kind=e.event_type.map(KIND)).groupby("user_id").kind.apply(list)
    lon = {u: [k for k in ks if k in ("decelerate", "accelerate", "stop")] for u, ks in kinds.items()}
    got = {r.user_id: (r.first_lon, r.last_lon) for r in QUERIES["action_axes"](spark, DATA).collect()}
    assert got == {u: (ks[0], ks[-1]) if ks else (None, None) for u, ks in lon.items()}


def test_small_ranges_share_a_task(spark, tmp_path):
    binary.write_points(spark.range(20_000).select(*(F.col("id").cast("float").alias(c) for c in "xyz")).repartition(2), str(tmp_path))
    got = readers.points(spark, str(tmp_path), range_bytes=120)  # some 2,000 ranges
    assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r.x for r in got.collect()) == [float(i) for i in range(20_000)] and got.groupBy("path", "n").count().where("count > 1").isEmpty()


def test_small_ranges_of_framed_records_share_a_task(spark, tmp_path):
    binary.write_framed(spark.range(2_000).select(F.col("id").cast("string").cast("binary").alias("r")).repartition(2), str(tmp_path), "r")
    got = readers.framed_records(spark, str(tmp_path), 40)  # some 1,000 ranges
    assert got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(int(r.record) for r in got.collect()) == list(range(2_000))


def test_framed_records_are_read_by_blocks(monkeypatch):
    class Counted(io.BytesIO):
        reads = 0

        def read(self, n=-1):
            self.reads += 1
            return super().read(n)

    monkeypatch.setattr(binary, "LOOK_BYTES", 1000)
    rng = random.Random(3)
    data = [rng.randbytes(rng.choice([0, 1, 9, 20, 3000])) for _ in range(400)]
    body = b"".join(struct.pack("<QI", len(r), 7) + r + b"abcd" for r in data)
    f = Counted(body + b"of the next range")
    got = [r for b in binary._records(f, {"path": "p", "start": 0, "stop": len(body), "first": 5}) for r in b.to_pylist()]
    assert [r["record"] for r in got] == data and [r["n"] for r in got] == list(range(5, 405))
    assert f.reads <= 2 * len(body) / 1000 + 1


def test_boxes_of_a_full_cell_meet_in_many_groups(spark):
    rng = random.Random(4)
    boxes = [(k, i, rng.uniform(0, 2), rng.uniform(0, 2), rng.uniform(0.1, 1), rng.uniform(0.1, 1)) for i, k in enumerate(rng.choices("aab", k=300))]
    df = spark.createDataFrame([*boxes, ("a", None, 1.0, 1.0, 1.0, 1.0)], "k string, id long, x double, y double, w double, h double")
    whole, split = (matching.meeting_boxes(df, ["k"], "id", 1.0, n) for n in (1000, 20))
    near = lambda a, b, c: abs(a[c] - b[c]) < (a[c + 2] + b[c + 2]) / 2
    want = sorted((a[0], a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and near(a, b, 2) and near(a, b, 3))
    rows = sorted(map(tuple, split.collect()))
    assert [r[:3] for r in rows] == want and rows == sorted(map(tuple, whole.collect()))


def test_places_as_the_expression_has_them(spark):
    rng = random.Random(5)
    some = lambda lo, hi: None if rng.random() < 0.05 else round(rng.uniform(lo, hi) * 2) / 2  # noqa: E731 - ties in x
    line = lambda: None if rng.random() < 0.05 else [(some(-3, 40), some(-5, 5), 0.0) if rng.random() > 0.03 else None for _ in range(rng.randint(0, 9))]
    rows = [(i, None if i == 3 else [line() for _ in range(rng.randint(0, 4))], [some(-5, 45) for _ in range(rng.randint(0, 5))]) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, lines array<array<struct<x:double,y:double,z:double>>>, xs array<double>")
    by_hand = F.transform("xs", lambda x: F.filter(F.transform(F.coalesce("lines", F.array()), lambda p: scalar.interpolated_y(p, x)), lambda y: y.isNotNull()))
    got = df.select("i", lanes.places("lines", "xs").alias("a"), by_hand.alias("b")).collect()
    assert len(got) == 400 and all(r.a == r.b for r in got)


def test_lines_are_not_broadcast(spark):
    found = QUERIES["map_cut_in"](spark, DATA)._jdf.queryExecution()
    assert all("lines" not in side for side in re.findall(r"BroadcastExchange.*?\n.*\n", found.executedPlan().toString()))
    assert "rightHint=(strategy=merge)" in found.analyzed().toString() or "strategy=merge" in found.optimizedPlan().toString()


def test_robust_line_sorts_no_rows(spark, monkeypatch):
    plans, held = [], parameters.materialise
    monkeypatch.setattr(parameters, "materialise", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or held(df, tag))
    df = spark.range(500).select((F.col("id") % 2).alias("k"), "id", F.col("id").cast("double").alias("x"), (F.col("id") * 3 + 1.0).alias("y"))
    got = {r.k: (round(r.slope, 6), round(r.intercept, 6), r.n_inliers) for r in parameters.robust_line(df, ["k"], "id", "x", "y", 0.5).collect()}
    assert got == {0: (3.0, 1.0, 250), 1: (3.0, 1.0, 250)}
    assert len(plans) == 2 and not any("SortAggregate" in p or "ObjectHashAggregate" in p for p in plans)


def test_head_and_tail_share_a_sort(spark):
    df = spark.range(30).select((F.col("id") % 3).alias("k"), "id", F.col("id").cast("double").alias("v"))
    found = series.head_tail(df, ["k"], ["id"], "v", 2)
    assert found._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert sorted((r.k, r.head, r.tail) for r in found.collect()) == [(k, k + 1.5, k + 25.5) for k in range(3)]


def test_ply_files_do_not_number_the_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(file_queries, "folder", lambda spark, tag: str(tmp_path / tag))
    assert QUERIES["ply_file"](spark, DATA).count() == len(given("embeddings"))
    assert len(list((tmp_path / "ply").rglob("*.txt"))) == len({(v // 1000, v % 2) for v in given("embeddings").vec_id})


def test_equal_clips_rank_by_id(spark, tmp_path):
    rng, us = random.Random(3), pd.Timestamp("2024-01-01").value // 1000
    day = [(us + i * 1_000_000, k, v) for i, (k, v) in enumerate([("click", 0.1), ("error", 450.7), ("view", 0.3), ("signup", 77.77), ("click", 1e-3)] * 3)]
    rows = [(u * 100 + i, t, u, k, v) for u in range(0, 160, 4) for i, (t, k, v) in enumerate(day)]
    rng.shuffle(rows)  # sums come in another order for each user
    df = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double").repartition(7)
    df.select("event_id", F.timestamp_micros("us").alias("ts"), "user_id", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["window_selection"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r.clip_id for r in got] == sorted(str(u) for u in range(0, 160, 4))


def test_means_are_summed_in_order_of_time(spark):
    rng, values = random.Random(7), [1.7, 0.1, 450.7, 0.3, 77.77, 1e-3, 2.9, 3.3]
    up, down = 0.0, 0.0
    for v, w in zip(values, values[::-1], strict=True):
        up, down = up + v, down + w
    rows = [(str(k), float(i), v) for k in range(40) for i, v in enumerate(values)]
    rng.shuffle(rows)
    series_ = spark.createDataFrame(rows, "clip_id string, t double, speed double").withColumn("yaw", F.lit(0.0)).repartition(3)
    spans = spark.createDataFrame([(str(k), "a", 0.0, 7.0) for k in range(41)], "clip_id string, track_id string, t0 double, t1 double")
    means = {r.clip_id: r.mean_value for r in aggregates.range_stats(spans, series_, ["clip_id"], "t", "speed").collect()}
    assert up != down and means == {**{str(k): up / 8 for k in range(40)}, "40": None}
    met = scenario._with_ego(spans, series_, ["clip_id", "track_id"], {"e": ("t0", "t1"), "f": ("t0", "t0")})
    assert {r.clip_id: r.e_mean for r in met.collect()} == {**{str(k): down / 8 for k in range(40)}, "40": None}  # from the last to the first


def test_offsets_of_flat_lines(spark):
    rng = random.Random(6)
    some = lambda lo, hi: None if rng.random() < 0.05 else round(rng.uniform(lo, hi) * 2) / 2
    line = lambda: [v for _ in range(rng.randint(0, 7)) for v in (some(-3, 40), some(-5, 5), 0.0)] + [1.0] * (rng.random() < 0.1)
    rows = [(i, [line() for _ in range(rng.randint(0, 4))], [(float(j), round(rng.uniform(-5, 45), 1), some(-6, 6)) for j in range(rng.randint(0, 6))]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, lines array<array<double>>, p array<struct<t:double,x:double,y:double>>")
    point = lambda v, i: F.struct(F.get(v, i).alias("x"), F.get(v, i + 1).alias("y"), F.get(v, i + 2).alias("z"))
    whole = F.filter("lines", lambda v: (F.size(v) > 0) & (F.size(v) % 3 == 0))
    apart = F.transform(whole, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(3)), lambda i: point(v, i)))
    at = F.transform("p", lambda p: F.struct(p["y"].alias("y"), F.filter(F.transform(apart, lambda q: scalar.interpolated_y(q, p["x"])), lambda y: y.isNotNull()).alias("ys")))
    by_hand = F.transform(F.filter(at, lambda z: F.size(z["ys"]) > 0), lambda z: scalar.lane_offset(z["y"], z["ys"]))
    got = df.select(lanes.offsets("lines", "p").alias("a"), by_hand.alias("b")).collect()
    assert len(got) == 300 and all(r.a == r.b for r in got)


def test_frames_are_described_once(spark, monkeypatch):
    held, tags = lanes.materialise, []
    monkeypatch.setattr(lanes, "materialise", lambda df, tag: tags.append(tag) or held(df, tag))
    found = QUERIES["ego_map_chain"](spark, DATA)
    assert tags == ["frames"] and "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_frames_clips_and_spans_are_shuffled(spark):
    """Written frames are so small on disk that Spark would gather them all in the driver."""
    line = lambda y: [v for x in (4.0, 6.0, 9.0, 29.0, 31.0) for v in (x, y, 0.0)]
    fr = spark.createDataFrame([(str(c), i, [line(1.75 + c / 8), line(-1.75 + c / 8)]) for c in range(3) for i in range(4)], "clip_id string, frame_idx int, lines array<array<double>>")
    spans = spark.createDataFrame([(str(c), "turn", 0, 0.0, 1.5, 1.5) for c in range(4)], "clip_id string, kind string, run long, t0 double, t1 double, dur double")
    found = lanes.road(spans, fr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Broadcast" not in plan
    assert sorted(map(tuple, found.collect())) == [(str(c), "turn", 0, 0.0, 0) for c in range(3)]


def test_motion_and_its_events_are_shuffled(spark):
    found = QUERIES["taxonomy_chain"](spark, DATA)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_clip_of_many_rows_has_its_motion(spark, tmp_path):
    """At half a second a row, microseconds of more than 4,294 rows are no 32-bit integers."""
    df = spark.range(4_400).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), F.lit(3).cast("long").alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") % 500).cast("double").alias("value"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    got = more_queries._ego(spark, str(tmp_path)).agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t"), F.max("dur").alias("dur")).first()
    assert tuple(got) == (4_400, 2199.5, 2199.5)


def test_a_stream_settles_many_keys_in_one_call(spark, tmp_path):
    """Keys of one bucket, a null key among them, do not touch each other; several rows of state a bucket."""
    rng = random.Random(2)
    rows = [(f"one {i}", "x", 0, 1) for i in range(3 * sessions.CHUNK)]
    rows += [(rng.choice(["a", "b", "c", None, *map(str, range(20))]), rng.choice("xyz"), m, m + rng.randint(0, 30)) for m in sorted(rng.randint(0, 600) for _ in range(300))]
    want, by_key = set(), {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    for key, its in by_key.items():
        spans = []
        for _, kind, a, b in its:
            if spans and a <= spans[-1][1] + 5:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]), spans[-1][2] + 1, spans[-1][3] | {kind})
            else:
                spans.append((a, b, 1, {kind}))
        want |= {(key, a, b, n, "".join(sorted(kinds))) for a, b, n, kinds in spans}
    ts = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(c) * 60)
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in (rows[:-150], rows[-150:], [("end", "end", 90_000, 90_000)]):  # the stream goes on from its checkpoint
        spark.createDataFrame(part, "k string, kind string, a long, b long").select("k", "kind", ts("a").alias("t0"), ts("b").alias("t1")).write.mode("append").parquet(f"{tmp_path}/in")
        stream = own.readStream.schema("k string, kind string, t0 timestamp, t1 timestamp").parquet(f"{tmp_path}/in").withWatermark("t0", "1 minute")
        merged = sessions.merged_episodes(stream, "k", "kind", "t0", "t1", 300.0, buckets=2)
        merged.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = [(r.k, round((r.t0.timestamp() - 1_700_000_000) / 60), round((r.t1.timestamp() - 1_700_000_000) / 60), r.n, "".join(r.kinds)) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(want) and set(got) == want
