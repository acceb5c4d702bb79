"""Queries of exact neighbours, binary files, enumeration, streams with state, and record rules; their SQL follows the rules' text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.functions import rules, scalar
from skarn.operators import geometry, neighbours, ranking
from skarn.queries import EV, events, query, r6, table
from skarn.sources import binary, readers, writers
from skarn.streaming import sessions
from skarn.tables import folder, materialise

# --- neighbours -----------------------------------------------------------------------------------------------------


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as points on a coarse grid, so that some share a place, in clouds by label; in each, a few lie far out."""
    v = F.col("embedding")
    at = [(F.round(v[i].cast("double") * 6) + F.when((i == 0) & (F.col("vec_id") % 37 == 0), 40.0).otherwise(0.0)).alias(c) for i, c in enumerate("xyz")]
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cloud"), *at)


PLACES = """p AS (SELECT vec_id, label AS cloud, round(embedding[1]::DOUBLE * 6) + CASE WHEN vec_id % 37 = 0 THEN 40 ELSE 0 END AS x, round(embedding[2]::DOUBLE * 6) AS y, round(embedding[3]::DOUBLE * 6) AS z FROM embeddings),
 d AS (SELECT a.vec_id, a.cloud, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM p a JOIN p b ON a.cloud = b.cloud),
 k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d) <= {k}),
 m AS (SELECT vec_id, cloud, avg(d) AS mean FROM k GROUP BY 1, 2)"""


@query(f"WITH {PLACES.format(k=5)} SELECT vec_id, round(mean, 6) AS mean FROM m")
def neighbour_distance(spark: SparkSession, d: str) -> DataFrame:
    """The mean distance to the nearest five points of the cloud, the point itself among them."""
    p = _places(spark, d)
    near = neighbours.nearest_distances(p, ["cloud"], ["x", "y", "z"], 5, 0.7)
    on = [p["cloud"].eqNullSafe(near["cloud"]), *(p[c] == near[f"_x{i}"] for i, c in enumerate("xyz"))]
    return p.join(near, on).select("vec_id", r6(F.col("total") / F.col("found"), "mean"))


@query(f"""WITH {PLACES.format(k=20)}, c AS (SELECT cloud, sum(CASE WHEN mean > 0 THEN mean ELSE 0 END) / count(*) AS centre, count(*) AS n FROM m GROUP BY 1),
 s AS (SELECT cloud, any_value(centre) + 2 * sqrt(sum(CASE WHEN mean > 0 THEN (mean - centre) ** 2 ELSE 0 END) / (any_value(n) - 1)) AS top FROM m JOIN c USING (cloud) GROUP BY 1)
 SELECT vec_id FROM m JOIN s USING (cloud) WHERE mean > 0 AND mean < top""")
def outlier_points(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.outliers_removed(_places(spark, d), ["cloud"], ["x", "y", "z"], 1.0).select("vec_id")


# --- binary files ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, md5(coalesce(text, '')) AS digest FROM documents")
def framed_file(spark: SparkSession, d: str) -> DataFrame:
    """Documents as framed records, read back by ranges of 64 KB: each record is its id, a tab and its text."""
    path = folder(spark, "framed")
    body = F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.coalesce("text", F.lit(""))).cast("binary")
    binary.write_framed(table(spark, d, "documents").select(body.alias("record")), path, "record")
    text = F.col("record").cast("string")
    at = F.locate("\t", text)
    back = readers.framed_records(spark, path, 1 << 16).select(F.substr(text, F.lit(1), at - 1).cast("long").alias("doc_id"), F.substr(text, at + 1).alias("text"))
    return back.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT vec_id::FLOAT AS x, embedding[2]::FLOAT AS y, embedding[3]::FLOAT AS z FROM embeddings UNION ALL SELECT l_orderkey::FLOAT, l_quantity::FLOAT, l_discount::FLOAT FROM lineitem")
def point_file(spark: SparkSession, d: str) -> DataFrame:
    """Flat points of two tables, in two folders, read back by ranges of 16 KB."""
    path = folder(spark, "points")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("x"), F.col("embedding")[1].alias("y"), F.col("embedding")[2].alias("z"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("x"), F.col("l_quantity").alias("y"), F.col("l_discount").alias("z"))
    binary.write_points(e, f"{path}/a")
    binary.write_points(li, f"{path}/b")
    return readers.points(spark, f"{path}/*/*.bin", range_bytes=1 << 14).select("x", "y", "z")


@query("""SELECT kind, vec_id::DOUBLE AS x, embedding[2]::DOUBLE AS y, -embedding[3]::DOUBLE AS z, (vec_id % 256)::INT AS r, (vec_id * 7 % 256)::INT AS g, 3 AS b
 FROM embeddings, (VALUES ('ascii'), ('binary_big_endian'), ('binary_little_endian')) k(kind)""")
def ply_formats(spark: SparkSession, d: str) -> DataFrame:
    """One cloud in each of the three formats; all three give the same rows."""
    path, v = folder(spark, "clouds"), F.col("vec_id")
    e = table(spark, d, "embeddings").select(v.alias("x"), F.col("embedding")[1].cast("double").alias("y"), (-F.col("embedding")[2].cast("double")).alias("z"), (v % 256).alias("r"), (v * 7 % 256).alias("g"), F.lit(3).alias("b"))
    for kind in ("ascii", "binary_big_endian", "binary_little_endian"):
        binary.write_ply(e, f"{path}/kind={kind}", kind)
    got = readers.ply_points(spark, f"{path}/*/*.ply", range_bytes=1 << 12)
    return got.select(F.regexp_extract("path", r"kind=(\w+)", 1).alias("kind"), "x", "y", "z", "r", "g", "b")


# --- enumeration ----------------------------------------------------------------------------------------------------


@query("""WITH scenes AS (SELECT n_nationkey AS scene, row_number() OVER (ORDER BY n_name) - 1 AS pos, 40 + n_regionkey AS n FROM nation WHERE n_nationkey % 3 > 0),
 samples AS (SELECT c_nationkey AS scene, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx, c_custkey AS sample FROM customer),
 g AS (SELECT pos, scene, idx, sample, cam, k FROM samples JOIN scenes USING (scene), (VALUES (0, 'front'), (1, 'left'), (2, 'rear')) c(k, cam) WHERE idx < n AND idx % 8 = 0),
 f AS (SELECT *, NOT (cam = 'front' OR cam = 'left' AND sample % 3 > 0 OR cam = 'rear' AND sample % 5 = 0) AS missing FROM g)
 SELECT CASE WHEN NOT missing THEN row_number() OVER (PARTITION BY missing ORDER BY pos, idx, k) - 1 END AS item, scene, idx AS sample_idx, sample, cam AS camera, missing FROM f""")
def scene_enumeration(spark: SparkSession, d: str) -> DataFrame:
    """Every eighth sample of the scenes of a split, for three cameras, some of which are missing."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    pos = F.row_number().over(Window.orderBy("n_name")) - 1  # a split's few names
    scenes = n.where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("scene"), pos.alias("pos"), (F.col("n_regionkey") + 40).alias("n_samples"))
    idx = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    samples = c.select(F.col("c_nationkey").alias("scene"), idx.alias("sample_idx"), F.col("c_custkey").alias("sample"))
    k = F.col("c_custkey")
    have = F.array_compact(F.array(F.lit("front"), F.when(k % 3 > 0, "left"), F.when(k % 5 == 0, "rear"), F.lit("roof")))
    images = c.select(k.alias("sample"), F.explode(have).alias("camera")).withColumn("image", F.concat_ws("/", "camera", F.col("sample").cast("string")))
    return readers.scene_items(scenes, samples, images, ["front", "left", "rear"], 8).select("item", "scene", F.col("sample_idx").cast("long").alias("sample_idx"), "sample", "camera", "missing")


@query("""WITH f AS (SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS ts FROM orders),
 far AS (SELECT a.idx, max(g.idx) AS gap FROM f a JOIN (SELECT DISTINCT i AS idx FROM (SELECT unnest(range(min(idx) - 6, max(idx) + 1)) AS i FROM f) WHERE i NOT IN (SELECT idx FROM f WHERE ts IS NOT NULL)) g ON g.idx < a.idx AND g.idx >= a.idx - 6 GROUP BY 1),
 s AS (SELECT a.idx, string_agg(b.ts::VARCHAR, ',' ORDER BY b.idx DESC) AS sweeps FROM f a LEFT JOIN far USING (idx) JOIN f b ON b.idx < a.idx AND b.idx >= a.idx - 5 AND b.idx > coalesce(gap, -100) AND b.ts IS NOT NULL GROUP BY 1),
 l AS (SELECT l_orderkey AS idx, count(*) AS n FROM lineitem WHERE l_orderkey % 4 > 0 GROUP BY 1), c AS (SELECT o_orderkey AS idx, o_orderstatus AS cal FROM orders WHERE o_orderkey % 10 > 2)
 SELECT f.idx, ts, coalesce(sweeps, '') AS sweeps, l.n AS labels, cal, CASE WHEN l.n IS NULL THEN 'label' ELSE '' END || CASE WHEN l.n IS NULL AND cal IS NULL THEN ',' ELSE '' END || CASE WHEN cal IS NULL THEN 'calib' ELSE '' END AS absent
 FROM f LEFT JOIN s USING (idx) LEFT JOIN l USING (idx) LEFT JOIN c USING (idx)""")
def frame_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Frames with their labels, calibration and up to five sweeps before them; clouds, labels and calibrations are missing here and there."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    frames = o.select(k.alias("idx"), F.when(k % 7 > 0, F.struct(F.col("o_custkey").alias("ts"))).alias("cloud"))
    labels = table(spark, d, "lineitem").where("l_orderkey % 4 > 0").groupBy(F.col("l_orderkey").alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    calib = o.where("o_orderkey % 10 > 2").select(k.alias("idx"), F.col("o_orderstatus").alias("cal"))
    got = readers.frame_infos(frames, {"label": labels, "calib": calib})
    sweeps = F.array_join(F.transform("sweeps", lambda s: s["ts"].cast("string")), ",")
    return got.select("idx", F.col("cloud.ts").alias("ts"), sweeps.alias("sweeps"), F.col("label.n").alias("labels"), "calib.cal", F.array_join("absent", ",").alias("absent"))


@query(f"""WITH {EV}, n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM ev) SELECT event_id, part::INT AS part FROM n, range(0, 2) r(part) WHERE i % 5 = 0""")
def repeated_frames(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth frame, gone through twice an epoch."""
    return readers.repeated(ranking.stride(events(spark, d), ["user_id"], ["t", "event_id"], 5).select("event_id"), 2, "part")


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':9'), o_orderkey LIMIT (SELECT floor(count(*) * (1 - 0.3::DOUBLE))::BIGINT FROM orders)")
def dropped_share(spark: SparkSession, d: str) -> DataFrame:
    return ranking.drop_share(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.3, 9)


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_totalprice, o_orderkey OFFSET (SELECT count(*) // 3 FROM orders)")
def slice_to_end(spark: SparkSession, d: str) -> DataFrame:
    """All rows but the first third of an order by several columns."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return ranking.slice_rows(o, [F.col("o_orderdate").desc(), F.col("o_totalprice"), F.col("o_orderkey")], o.count() // 3)


# --- streams with state ---------------------------------------------------------------------------------------------


@query(f"""WITH {EV}, n AS (SELECT *, CASE WHEN t0 <= max(t1) OVER w + 3600 THEN 0 ELSE 1 END AS new FROM (SELECT user_id, event_type, t0, t0 + 600 + event_id % 5 * 1800 AS t1 FROM ev)
 WINDOW w AS (PARTITION BY user_id ORDER BY t0, t1, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t0, t1, event_type) AS ep FROM n)
 SELECT user_id::VARCHAR AS user_id, epoch_us(make_timestamp((min(t0) * 1000000)::BIGINT)) AS t0, (max(t1) * 1000000)::BIGINT AS t1, count(*) AS n, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM g GROUP BY user_id, ep""")
def stream_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Intervals with length that come as a stream in order of start, merged in state and given out by timers.

    Each part of the days is written by many tasks, and the stream goes on from its checkpoint with the files that are new. A row far in the future, of a key of its own, moves the watermark past all others in the end.
    """
    path = folder(spark, "stream")
    ts = lambda c: F.timestamp_micros((c * 1_000_000).cast("long"))
    e = events(spark, d).select("user_id", "event_type", ts(F.col("t0")).alias("t0"), ts(F.col("t0") + 600 + F.col("event_id") % 5 * 1800).alias("t1"))
    last = e.agg((F.max("t0") + F.expr("INTERVAL 400 DAYS")).alias("t0")).select(F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), "t0", F.col("t0").alias("t1"))
    part = F.ntile(4).over(Window.orderBy(F.col("day")))  # of a few days
    days = materialise(e.select(F.to_date("t0").alias("day")).distinct().withColumn("part", part), "days")
    own = spark.newSession()  # so that the caller's settings stay as they are
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for rows in (*(e.join(days.where(F.col("part") == k), F.to_date("t0") == F.col("day")).select(*e.columns) for k in (1, 2, 3, 4)), last):
        rows.write.mode("append").parquet(f"{path}/in")
        stream = own.readStream.schema(e.schema).parquet(f"{path}/in").withWatermark("t0", "1 hour")
        merged = sessions.merged_episodes(stream, "user_id", "event_type", "t0", "t1", 3600.0)
        merged.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    got = spark.read.schema(f"user_id string, {sessions.EPISODE}").parquet(f"{path}/out").where("user_id <> '-1'")
    return got.select("user_id", F.unix_micros("t0").alias("t0"), F.unix_micros("t1").alias("t1"), "n", F.array_join("kinds", ",").alias("kinds"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The first of each user's events of a kind, kept by a stream within its watermark, which spans the table."""
    path = folder(spark, "dedup")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    e.repartition(3, "event_id").write.parquet(f"{path}/in")
    stream = sessions.event_stream(spark, f"{path}/in", "event_id long, user_id long, event_type string, ts timestamp", delay="400 days")
    first = sessions.deduplicated(stream, ["user_id", "event_type"])
    first.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema("event_id long, user_id long, event_type string, ts timestamp").parquet(f"{path}/out").select("user_id", "event_type")


# --- rules on records -----------------------------------------------------------------------------------------------

MOVES = {"car": {"object_type": "vehicle"}, "light": {"cause": "signal"}, "slow": {"longitudinal_action": "decelerate"}, "pushes in": {"relation": "cut_in"}}
ROLES = {"cut_in": "adjust", "cross_ego_path": "crossing", "decelerate": "preceding_vehicle"}
_PICK = lambda values, k: F.get(F.array(*(F.lit(v) for v in values)), F.pmod(k, F.lit(len(values))).cast("int"))
KINDS_, LON, REL = ["car", "light", "pedestrian", None, "slow"], ["decelerate", "pushes in", None, "glide"], ["cut_in", None, "cross_ego_path", "slow", "odd", None, "light"]
CAUSES = ["agent", "signal", "agent", "other", None, "agent"]


def _sql(values: list, k: str) -> str:
    return f"({[v if v is not None else 'NULL' for v in values]!r})[({k}) % {len(values)} + 1]".replace("'NULL'", "NULL")


def _move(fields: dict[str, str], field: str) -> dict[str, str]:
    """One look-up of a field's value in the moves, as SQL of all fields."""
    out, seen = dict(fields), fields[field]
    for other in fields:
        cases = [f"WHEN {seen} = '{v}' THEN '{to[other]}'" for v, to in MOVES.items() if other in to]
        if other == field:
            cases += [f"WHEN {seen} = '{v}' THEN NULL" for v, to in MOVES.items() if field not in to]
        if cases:
            out[other] = f"CASE {' '.join(cases)} ELSE {fields[other]} END"
    return out


def _steps() -> str:
    names = ["cause", "object_type", "longitudinal_action", "relation"]
    sql, at = [], "r"
    for i, f in enumerate(names[1:]):
        moved = _move({n: n for n in names}, f)
        sql.append(f"m{i} AS (SELECT id, vru_attr, {', '.join(f'{v} AS {n}' for n, v in moved.items())} FROM {at})")
        at = f"m{i}"
    return ", ".join(sql)


@query(f"""WITH r AS (SELECT o_orderkey AS id, 'tall' AS vru_attr, {_sql(CAUSES, "o_orderkey")} AS cause, {_sql(KINDS_, "o_custkey")} AS object_type, {_sql(LON, "o_orderkey // 2")} AS longitudinal_action, {_sql(REL, "o_orderkey // 3")} AS relation FROM orders),
 {_steps()}, e AS (SELECT *, longitudinal_action IS NOT NULL AND relation IS NOT NULL AS pair, longitudinal_action IN ('decelerate') AND relation NOT IN ('cut_in', 'cross_ego_path') AS lon_only FROM m2),
 x AS (SELECT *, CASE WHEN NOT (pair AND NOT lon_only) THEN longitudinal_action END AS lon, CASE WHEN NOT (pair AND lon_only) THEN relation END AS rel, coalesce(cause = 'agent', false) AS agent FROM e)
 SELECT id, cause, CASE WHEN agent THEN object_type END AS object_type, CASE WHEN agent THEN vru_attr END AS vru_attr, CASE WHEN agent THEN lon END AS longitudinal_action, CASE WHEN agent THEN rel END AS relation, NULL::VARCHAR AS signal_state,
 CASE WHEN agent THEN coalesce(CASE rel WHEN 'cut_in' THEN 'adjust' WHEN 'cross_ego_path' THEN 'crossing' END, CASE lon WHEN 'decelerate' THEN 'preceding_vehicle' END) END AS role FROM x""")
def record_assembly(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    text = F.lit(None).cast("string")
    r = {
        "cause": _PICK(CAUSES, k), "object_type": _PICK(KINDS_, F.col("o_custkey")), "longitudinal_action": _PICK(LON, F.floor(k / 2)), "relation": _PICK(REL, F.floor(k / 3)),
        "vru_attr": F.lit("tall"), "occlusion": text, "vru_state": text, "signal_state": F.lit("red"),
    }
    got = rules.assembled(r, MOVES, ["decelerate"], ["cut_in", "cross_ego_path"], ROLES)
    return o.select(k.alias("id"), *(got[c].alias(c) for c in ("cause", "object_type", "vru_attr", "longitudinal_action", "relation", "signal_state", "role")))


@query(f"""WITH o AS (SELECT o_orderkey AS id, {_sql(["ego_stop", None, "ego_turn_left"], "o_orderkey")} AS action, {_sql(CAUSES, "o_custkey")} AS cause, o_orderkey % 3 AS a, o_orderkey % 5 AS b, o_orderkey % 2 AS c FROM orders)
 SELECT id, array_to_string(list_sort(list_distinct(list_filter(['ego_action:' || coalesce(action, 'None'), 'cause:' || coalesce(cause, 'None'), CASE WHEN a > 0 THEN 'arc:stop' END, CASE WHEN a > 1 THEN 'arc:turn_left' END,
 CASE WHEN b IN (1, 2) THEN 'object_type:vehicle' END, CASE WHEN b IN (2, 3) THEN 'vru:crossing' END, CASE WHEN b > 0 THEN 'object_type:pedestrian' END,
 CASE WHEN b = 2 THEN 'relation:cut_in' WHEN b > 0 AND c = 1 THEN 'relation:cross_ego_path' END, CASE WHEN b = 4 THEN 'flag:model_missed_gt' END], lambda x: x IS NOT NULL))), ' ') AS tags FROM o""")
def flat_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of records of none to two components: measured, named by the model, or put in as missed."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    a, b, c = k % 3, k % 5, k % 2
    text = F.lit(None).cast("string")
    ref = F.when(b <= 3, F.struct(F.when(b.isin(1, 2), "vehicle").otherwise("").alias("object_type"), F.when(b == 2, "cut_in").alias("relation"), F.when(b.isin(2, 3), "crossing").alias("vru_state")))
    first = F.struct(ref.alias("ref"), F.array().cast("array<string>").alias("tags"), F.when(b == 4, "gt_injected").otherwise("model").alias("source"))
    named = F.array_compact(F.array(F.lit("object_type:pedestrian"), F.lit("colour:red"), F.when(c == 1, "relation:cross_ego_path"), F.when(c == 1, "relation:cut_in")))
    second = F.struct(F.lit(None).cast("struct<object_type:string,relation:string,vru_state:string>").alias("ref"), named.alias("tags"), text.alias("source"))
    parts = F.when(b > 0, F.array(first, second)).otherwise(F.when(a > 0, F.array().cast(rules.COMPONENTS)))
    arc = F.when(a == 0, F.array().cast("array<string>")).when(a == 1, F.array(F.lit("stop"))).otherwise(F.array(F.lit("turn_left"), F.lit("stop"), F.lit("turn_left")))
    tags = rules.search_tags(_PICK(["ego_stop", None, "ego_turn_left"], k), arc, _PICK(CAUSES, F.col("o_custkey")), parts.cast(rules.COMPONENTS))
    return o.select(k.alias("id"), F.array_join(tags, " ").alias("tags"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'ego_stop' WHEN 'click' THEN 'ego_turn_left' WHEN 'view' THEN 'ego_turn_right' WHEN 'signup' THEN 'ego_evade' ELSE 'ego_lane_keep' END AS action FROM events""")
def anchored_actions(spark: SparkSession, d: str) -> DataFrame:
    kind = rules.lookup(F.col("event_type"), {"error": "stop", "click": "turn_left", "view": "turn_right", "signup": "evade", "purchase": "accelerate"})
    return table(spark, d, "events").select("event_id", rules.anchor_action(kind).alias("action"))


SUBJECTS, AGENT_ROLES, AGENT_KINDS, EGO_ACTS = ["ego", "agent", "agent", None], ["preceding_vehicle", "adjust", "crossing", None, "other"], ["pedestrian", "auto", None, "vehicle"], ["ego_stop", "ego_fly", None]


@query(f"""WITH o AS (SELECT o_orderkey AS id, {_sql(SUBJECTS, "o_orderkey")} AS s, {_sql(AGENT_ROLES, "o_custkey")} AS r, {_sql(AGENT_KINDS, "o_orderkey // 3")} AS k, {_sql(EGO_ACTS, "o_orderkey // 5")} AS e FROM orders),
 b AS (SELECT *, s IS NOT DISTINCT FROM 'ego' AS ego, s IS NOT DISTINCT FROM 'agent' AS agent, CASE WHEN s = 'agent' AND k = 'auto' THEN 'vehicle' ELSE k END AS k2 FROM o)
 SELECT id, CASE WHEN ego THEN CASE WHEN e = 'ego_stop' THEN e ELSE 'ego_lane_keep' END WHEN NOT agent THEN e END AS ego_action, CASE WHEN NOT ego THEN k2 END AS object_type, CASE WHEN NOT ego THEN r END AS role,
 CASE WHEN NOT (ego OR agent AND coalesce(r IN ('adjust', 'crossing'), false)) THEN 'decelerate' END AS longitudinal_action, CASE WHEN NOT (ego OR agent AND coalesce(r = 'preceding_vehicle', false)) THEN 'cut_in' END AS relation,
 CASE WHEN NOT (ego OR agent AND k2 IS DISTINCT FROM 'pedestrian') THEN 'crossing' END AS vru_detail FROM b""")
def cleaned_behaviours(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    f = {"ego_action": _PICK(EGO_ACTS, F.floor(k / 5)), "object_type": _PICK(AGENT_KINDS, F.floor(k / 3)), "longitudinal_action": F.lit("decelerate"), "relation": F.lit("cut_in"), "vru_detail": F.lit("crossing")}
    got = rules.cleaned(_PICK(SUBJECTS, k), _PICK(AGENT_ROLES, F.col("o_custkey")), f, ["ego_stop"], {"auto": "vehicle"})
    return o.select(k.alias("id"), *(v.alias(c) for c, v in got.items()))


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderkey % 4 AS n, o_custkey % 3 AS k FROM orders), g AS (SELECT id, n, k, list_transform(range(0, n), lambda i: (i + 1) || ') ' || CASE WHEN i = 1 THEN 'None' ELSE 'vehicle' END || ' (' ||
 CASE WHEN k = 0 THEN 'None' ELSE 'crossing' END || ', ' || CASE WHEN i = 2 THEN '' ELSE 'cut_in' END || ' ' || (i + 0.5)::DECIMAL(9, 1) || 'm ahead)') AS l FROM a)
 SELECT id, 'GT: ego maneuver arc = [' || CASE k WHEN 0 THEN '' WHEN 1 THEN 'stop → turn left' ELSE 'evasive maneuver → drift' END || '].' ||
 CASE WHEN n = 0 THEN ' No GT in-path objects.' ELSE ' GT-detected in-path objects (you MUST address each; do not omit): ' || array_to_string(l, '; ') || '.' END AS hint FROM g""")
def episode_hints(spark: SparkSession, d: str) -> DataFrame:
    o, n, k = table(spark, d, "orders"), F.col("o_orderkey") % 4, F.col("o_custkey") % 3
    one = lambda i: F.struct(F.when(i != 1, "vehicle").alias("object_type"), F.when(k != 0, "crossing").alias("role"), F.when(i != 2, "cut_in").alias("relation"), (i + F.lit(0.5)).alias("min_dist"))
    agents = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i < n, one(i))), lambda x: x.isNotNull())
    kinds = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("stop"), F.lit("turn_left"))).otherwise(F.array(F.lit("evade"), F.lit("drift")))
    return o.select(F.col("o_orderkey").alias("id"), rules.hint(kinds, agents).alias("hint"))


@query("""SELECT vec_id, round((embedding[1] * 100 - 5) * (abs(embedding[3]) + 1) / 50, 6) AS x, round((embedding[2] * 100 - 4) * (abs(embedding[3]) + 1) / 40, 6) AS y, round(abs(embedding[3]) + 1, 6) AS z FROM
 (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS embedding FROM embeddings)""")
def back_projection(spark: SparkSession, d: str) -> DataFrame:
    v = [F.col("embedding")[i].cast("double") for i in range(3)]
    p = geometry.back_project(v[0] * 100, v[1] * 100, F.abs(v[2]) + 1, 50.0, 40.0, 5.0, 4.0)
    return table(spark, d, "embeddings").select("vec_id", p.alias("p")).select("vec_id", *(r6(f"p.{c}", c) for c in "xyz"))


@query("SELECT vec_id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE * {0.5 if i < 4 else 1.0}, 6) AS k{i}" for i in range(6)) + " FROM embeddings")
def intrinsics_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Halved focal lengths and centres; the distortion behind them stays."""
    k = scalar.scaled_intrinsics(F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double")), 0.5)
    return table(spark, d, "embeddings").select("vec_id", k.alias("k")).select("vec_id", *(r6(F.col("k")[i], f"k{i}") for i in range(6)))


@query("""SELECT printf('%d FULL_OPENCV %d %d %.9f %.9f %.9f %.9f %.9f %.9f %.9f %.9f %.9f %.9f %.9f %.9f', s_suppkey, 1920, 1280, s_suppkey / 8, s_suppkey / 8, 960.0, 640.0, 0.25, -0.5, 0.0,
 CASE WHEN s_suppkey % 2 = 0 THEN 0.125 ELSE 0.0 END, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey / 4 ELSE 0.0 END, 0.0, 0.0, 0.0) AS value FROM supplier""")
def camera_file(spark: SparkSession, d: str) -> DataFrame:
    """Cameras of nine numbers, or of seven, whose last two are then zero."""
    k = F.col("s_suppkey")
    full = [k / 8, k / 8, *(F.lit(v) for v in (960.0, 640.0, 0.25, -0.5, 0.0, 0.125)), F.col("s_nationkey") / 4]
    s = table(spark, d, "supplier").select("s_suppkey", F.lit(1920).alias("w"), F.lit(1280).alias("h"), F.when(k % 2 == 0, F.array(*full)).otherwise(F.array(*full[:7])).alias("i"))
    return writers.colmap_cameras(s, "s_suppkey", "w", "h", "i")
