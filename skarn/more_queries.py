"""Queries of filters, small joins, parameter tables, geometry expressions and record rules, with their SQL counterparts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.functions import rules, scalar
from skarn.operators import aggregates, filters, fusion, geometry, matching, parameters, ranking, series
from skarn.plans import scenario
from skarn.queries import EV, KIND, U, VEC, _kinds, _vecs, events, query, r6, table
from skarn.sources import readers, writers
from skarn.tables import materialise

#: The same kinds in SQL.
KINDS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND.items()) + " END"

# --- filters --------------------------------------------------------------------------------------------------------


@query(f"""WITH {EV}, s AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM ev WHERE event_type = 'view' GROUP BY 1),
 i AS (SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n FROM ev JOIN s USING (user_id) WHERE t BETWEEN lo AND hi) SELECT event_id FROM i WHERE n >= 3""")
def time_clip(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    spans = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return filters.time_clip(e, U, "t", spans).select("event_id")


@query("""SELECT event_id, value / 100 - 2 < -1.0 AS decel, value / 100 - 2 > 1.0 AS accel, value < 1.5 AS slow, abs(value / 100 - 2) > 0.15 AS turning FROM events""")
def threshold_masks(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("value") / 100 - 2
    return table(spark, d, "events").select("event_id", (a < -1.0).alias("decel"), (a > 1.0).alias("accel"), (F.col("value") < 1.5).alias("slow"), (F.abs(a) > 0.15).alias("turning"))


@query(f"WITH {VEC} SELECT vec_id FROM v WHERE abs(e1 * 20) < 2.5 AND e0 * 200 > 0 AND e0 * 200 < 45")
def corridor_filter(spark: SparkSession, d: str) -> DataFrame:
    return _vecs(spark, d).where(filters.in_corridor(F.col("e0") * 200, F.col("e1") * 20)).select("vec_id")


@query(f"""WITH {VEC}, i AS (SELECT vec_id, count(*) OVER (PARTITION BY label) AS n FROM v WHERE e0 BETWEEN -0.1 AND 0.1 AND e1 BETWEEN -0.1 AND 0.1) SELECT vec_id FROM i WHERE n >= 5""")
def point_range_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.in_ranges(_vecs(spark, d), ["label"], {"e0": (-0.1, 0.1), "e1": (-0.1, 0.1)}, 5).select("vec_id")


@query("""SELECT event_id, abs(abs(floor(value) - 245) - 45) <= 10 OR abs(abs(floor(value) - 245) - 22) <= 10 AS ambiguous FROM events""")
def ambiguous_curves(spark: SparkSession, d: str) -> DataFrame:
    detail = F.concat(F.lit("turn raw="), (F.floor("value") - 245).cast("string"), F.lit(" deg"))
    return table(spark, d, "events").select("event_id", scalar.ambiguous(detail).alias("ambiguous"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def unless_denied(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "labels").select("doc_id", (F.col("quality") != 0).alias("ok"))
    return filters.kept_unless_denied(table(spark, d, "documents").select("doc_id"), said, ["doc_id"], "ok")


@query("""SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, avg((l_quantity < 10)::INT) AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(r < 0.3, true)""")
def clean_frames(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity")
    return filters.clean_frames(o, li, ["k"], F.col("l_quantity") < 10, 0.3).select(F.col("k").alias("o_orderkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def token_filter(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return filters.by_token(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), tokens, ["l_orderkey"])


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_views FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def several_views(spark: SparkSession, d: str) -> DataFrame:
    return filters.in_several_views(table(spark, d, "lineitem"), ["l_partkey"], "l_suppkey")


@query(f"""WITH {VEC}, p AS (SELECT vec_id, abs(e2) * 10 AS z, 100 * e0 * 10 / (abs(e2) * 10) + 50 AS u, 100 * e1 * 10 / (abs(e2) * 10) + 50 AS w FROM v WHERE abs(e2) * 10 > 0.1)
 SELECT vec_id, round(z, 6) AS depth FROM p WHERE u >= 0 AND u < 100 AND w >= 0 AND w < 100""")
def image_filter(spark: SparkSession, d: str) -> DataFrame:
    p = geometry.project(F.col("e0") * 10, F.col("e1") * 10, F.abs("e2") * 10, 100.0, 100.0, 50.0, 50.0)
    return _vecs(spark, d).select("vec_id", p.alias("p")).where(geometry.in_image(F.col("p.u"), F.col("p.v"), 100, 100)).select("vec_id", r6(F.col("p.depth"), "depth"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 5 AND l_returnflag IS NOT NULL AND l_discount * 10 >= 0.2")
def usable_annotations(spark: SparkSession, d: str) -> DataFrame:
    ok = filters.usable_annotation(F.col("l_quantity"), F.col("l_returnflag"), F.col("l_discount") * 10, 5)
    return table(spark, d, "lineitem").where(ok).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH t AS (SELECT l_orderkey, max(l_discount) + 0.0003 AS top FROM lineitem GROUP BY 1),
 x AS (SELECT l_orderkey, list_filter(list_transform(range(0, 80), lambda k: 0.3::DOUBLE * pow(0.9::DOUBLE, k)), lambda v: top > v)[1] AS v FROM t)
 SELECT l_orderkey, round(CASE WHEN v >= 0.01 THEN v ELSE 0 END, 9) AS threshold FROM x""")
def relaxed_threshold(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.max("l_discount") + 0.0003).alias("top"))
    return t.select("l_orderkey", F.round(matching.relaxed_threshold(F.col("top"), 0.3), 9).alias("threshold"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'lang' END, CASE WHEN doc_id % 4 = 0 OR source IS NULL THEN 'source' END, CASE WHEN text IS NULL THEN 'text' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents""")
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    gone = table(spark, d, "documents").withColumns({"lang": F.when(k % 3 > 0, F.col("lang")), "source": F.when(k % 4 > 0, F.col("source"))})
    return gone.select("doc_id", F.array_join(filters.missing_fields(["lang", "source", "text"]), ",").alias("missing"))


@query("""SELECT d.doc_id, coalesce(q, -1) AS quality, coalesce(x, 0) AS toxic FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS q, max(toxic) AS x FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id""")
def default_structs(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "labels").groupBy("doc_id").agg(F.struct(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).alias("s"))
    j = table(spark, d, "documents").select("doc_id").join(per, "doc_id", "left")
    return j.select("doc_id", filters.with_default(F.col("s"), quality=-1, toxic=0).alias("s")).select("doc_id", "s.quality", "s.toxic")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE sqrt(l_quantity ** 2 + l_linenumber ** 2) <= CASE l_returnflag WHEN 'A' THEN 20.3 WHEN 'N' THEN 30.3 END""")
def class_radius(spark: SparkSession, d: str) -> DataFrame:
    near = filters.in_class_radius(F.col("l_returnflag"), F.col("l_quantity"), F.col("l_linenumber"), {"A": 20.3, "N": 30.3})
    return table(spark, d, "lineitem").where(near).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(coalesce((l_returnflag = 'R')::INT, 0) = 0)")
def crowd_filter(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_returnflag") == "R").cast("int").alias("iscrowd"))).alias("a"))
    return a.where(filters.has_single(F.col("a"))).select("l_orderkey")


# --- joins ----------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer), s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier)
 SELECT pos, c_custkey, s_suppkey FROM c JOIN s USING (pos)""")
def zip_join(spark: SparkSession, d: str) -> DataFrame:
    c = ranking.numbered_all(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    s = ranking.numbered_all(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")
    return c.join(s, "pos").select("pos", "c_custkey", "s_suppkey")


@query(f"WITH {VEC} SELECT label, thr, count(*) FILTER (abs(e0) < thr) AS n FROM v, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) t(thr) GROUP BY 1, 2")
def class_thresholds(spark: SparkSession, d: str) -> DataFrame:
    v = _vecs(spark, d).select("label", "e0", F.explode(F.array(*(F.lit(x) for x in (0.05, 0.1, 0.2)))).alias("thr"))
    return v.groupBy("label", "thr").agg(F.count_if(F.abs("e0") < F.col("thr")).alias("n"))


@query("SELECT c_custkey, s AS signal FROM customer LEFT JOIN (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def clip_existence(spark: SparkSession, d: str) -> DataFrame:
    any_of = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("signal"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(any_of, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "signal")


# --- aggregates -----------------------------------------------------------------------------------------------------


@query(f"""WITH {EV} SELECT user_id, floor(t / 86400)::BIGINT AS day, round(2.5 * least(greatest(max(value) / 100 - 3, 0), 4) + least(count(*) FILTER (event_type = 'click'), 4)
 + 0.8 * (bool_or(event_type = 'error') AND bool_or(event_type = 'view'))::INT + bool_or(event_type = 'error')::INT
 + bool_or(event_type = 'signup')::INT + 0.6 * bool_or(event_type = 'purchase')::INT, 6) AS react FROM ev GROUP BY 1, 2""")
def window_react(spark: SparkSession, d: str) -> DataFrame:
    g = _kinds(spark, d).groupBy("user_id", F.floor(F.col("t") / 86400).alias("day")).agg(F.collect_list("kind").alias("kinds"), F.min("ax").alias("min_ax"))
    return g.select("user_id", "day", r6(aggregates.reactivity(F.col("kinds"), F.col("min_ax")), "react"))


@query(f"""WITH {EV} SELECT user_id, event_type, count(*) AS n, min(t) AS t0, max(t) AS t1, min(value) AS lowest, arg_min(value, (t, event_id)) AS first FROM ev
 GROUP BY 1, 2 HAVING count(*) >= 3 AND max(t) - min(t) >= 1.0""")
def track_stats(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("value").alias("lowest"), F.min_by("value", F.struct("t", "event_id")).alias("first")
    )
    return g.where((F.col("n") >= 3) & (F.col("t1") - F.col("t0") >= 1.0))


@query(f"WITH {VEC} SELECT label, round(median(abs(atan2(sin(e0 * 40), cos(e0 * 40)))), 6) AS direction, round(max(e1) - min(e1), 6) AS ptp, round(avg((e2 > 0)::INT), 6) AS share FROM v GROUP BY 1")
def direction_stats(spark: SparkSession, d: str) -> DataFrame:
    ptp, share = F.max("e1") - F.min("e1"), F.avg((F.col("e2") > 0).cast("int"))
    return _vecs(spark, d).groupBy("label").agg(r6(F.median(F.abs(scalar.wrap(F.col("e0") * 40))), "direction"), r6(ptp, "ptp"), r6(share, "share"))


@query("SELECT round(avg(h::INT), 6) AS base_rate, count(*) AS n FROM (SELECT user_id, bool_or(event_type = 'signup' AND value > 400) AS h FROM events GROUP BY 1)")
def base_rate(spark: SparkSession, d: str) -> DataFrame:
    hit = F.bool_or((F.col("event_type") == "signup") & (F.col("value") > 400))
    return table(spark, d, "events").groupBy("user_id").agg(hit.alias("h")).agg(r6(F.avg(F.col("h").cast("int")), "base_rate"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey, count(DISTINCT CASE WHEN l_quantity < 10 THEN l_partkey END) AS n FROM lineitem GROUP BY 1")
def tracks_in_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct(F.when(F.col("l_quantity") < 10, F.col("l_partkey"))).alias("n"))


@query("""SELECT lang, round(count(*) FILTER (n_chars BETWEEN 500 AND 3000) / count(*), 6) AS valid, median(n_chars) FILTER (n_chars BETWEEN 500 AND 3000) AS width FROM documents GROUP BY 1""")
def valid_fraction(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("n_chars").between(500, 3000)
    return table(spark, d, "documents").groupBy("lang").agg(r6(F.count_if(ok) / F.count(F.lit(1)), "valid"), F.median(F.when(ok, F.col("n_chars"))).alias("width"))


@query("""SELECT lang, max(n_chars) - min(n_chars) AS spread, max(n_chars) FILTER (n_chars < 1000) - min(n_chars) FILTER (n_chars < 1000) AS short_spread FROM documents GROUP BY 1""")
def peak_to_peak(spark: SparkSession, d: str) -> DataFrame:
    n, short = F.col("n_chars"), F.when(F.col("n_chars") < 1000, F.col("n_chars"))
    return table(spark, d, "documents").groupBy("lang").agg(aggregates.peak_to_peak(n).alias("spread"), aggregates.peak_to_peak(short).alias("short_spread"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type FROM events), cam AS (SELECT user_id, us FROM e WHERE event_type = 'purchase' AND user_id % 3 > 0),
 idx AS (SELECT user_id, us FROM e WHERE event_type = 'view' AND user_id % 5 > 0)
 SELECT user_id, 0 AS source, min(us) AS first, max(us) AS last, count(*) AS n FROM cam GROUP BY 1
 UNION ALL SELECT user_id, 1, min(us), max(us), count(*) FROM idx WHERE user_id NOT IN (SELECT user_id FROM cam) GROUP BY 1""")
def fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    """Times from the camera's table, or else from the frame index, for each user that either knows."""
    e = table(spark, d, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    cam, idx = e.where("event_type = 'purchase' AND user_id % 3 > 0"), e.where("event_type = 'view' AND user_id % 5 > 0")
    rows = readers.first_source([cam.drop("event_type"), idx.drop("event_type")], "user_id")
    return rows.groupBy("user_id", "source").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT vec_id, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1, embedding[3]::DOUBLE AS e2, [('0x' || substr(md5(vec_id::VARCHAR || ':' || s), 1, 8))::BIGINT / 4294967296.0::DOUBLE FOR s IN range(1, 8)] AS u FROM embeddings),
 p AS (SELECT vec_id, CASE WHEN u[1] > 0.5 THEN -e0 ELSE e0 END AS x, CASE WHEN u[2] > 0.5 THEN -e1 ELSE e1 END AS y, e2 AS z, -pi() + u[3] * 2 * pi() AS a, 0.95 + u[4] * 0.1 AS k, u FROM r)
 SELECT vec_id, round((x * cos(a) - y * sin(a)) * k - 0.2 + u[5] * 0.4, 6) AS x, round((x * sin(a) + y * cos(a)) * k - 0.2 + u[6] * 0.4, 6) AS y, round(z * k - 0.2 + u[7] * 0.4, 6) AS z FROM p""")
def augmented_points(spark: SparkSession, d: str) -> DataFrame:
    """Points mirrored, turned, scaled and moved by draws of their own."""
    e = table(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(3)))
    draw = lambda seed, lo, hi: scalar.seeded_uniform(F.col("vec_id"), seed, lo, hi)
    shift = (draw(5, -0.2, 0.2), draw(6, -0.2, 0.2), draw(7, -0.2, 0.2))
    p = scalar.augmented(F.col("e0"), F.col("e1"), F.col("e2"), draw(1, 0, 1) > 0.5, draw(2, 0, 1) > 0.5, draw(3, -math.pi, math.pi), draw(4, 0.95, 1.05), shift)
    return e.select("vec_id", p.alias("p")).select("vec_id", *(r6(F.col(f"p.{c}"), c) for c in "xyz"))


@query("""SELECT l_returnflag, round(count(*) FILTER (l_discount > 0.05 AND l_quantity < 25) / nullif(count(*) FILTER (l_quantity < 25), 0), 6) AS coverage FROM lineitem GROUP BY 1""")
def fill_coverage(spark: SparkSession, d: str) -> DataFrame:
    hole = F.col("l_quantity") < 25
    share = F.count_if(hole & (F.col("l_discount") > 0.05)) / F.nullif(F.count_if(hole), F.lit(0))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(share, "coverage"))


@query("""WITH x AS (SELECT l_returnflag AS k, thr, l_discount AS s, (l_tax < thr)::INT AS h FROM lineitem, (VALUES (0.025::DOUBLE), (0.045::DOUBLE), (0.065::DOUBLE)) t(thr)),
 g AS (SELECT k, thr, s, sum(h) AS t, count(*) AS n FROM x GROUP BY 1, 2, 3),
 c AS (SELECT *, sum(t) OVER w / sum(n) OVER w AS p, sum(t) OVER (PARTITION BY k, thr) AS a FROM g WINDOW w AS (PARTITION BY k, thr ORDER BY s DESC))
 SELECT k, thr AS threshold, CASE WHEN k <> 'R' THEN round(sum(coalesce(t / nullif(a, 0), 0) * p), 6) END AS ap FROM c GROUP BY 1, 2""")
def distance_ap(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), "l_discount", "l_tax")
    return parameters.distance_ap(li, ["k"], "l_discount", "l_tax", [0.025, 0.045, 0.065], F.col("k") == "R").select("k", "threshold", r6("ap"))


@query(f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) - 1 AS pos FROM ev)
 SELECT a.user_id, a.pos::INTEGER AS pos, round(sqrt((a.value - b.value) ** 2 + (a.t - b.t) ** 2), 3) AS error FROM n a JOIN n b ON a.user_id = b.user_id AND a.pos = b.pos AND a.event_type = 'click' AND b.event_type = 'view'""")
def pair_errors(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    a, b = (e.where(F.col("event_type") == k) for k in ("click", "view"))
    return parameters.pair_errors(a, b, U, ["t", "event_id"], ["value", "t"]).select("user_id", "pos", F.round("error", 3).alias("error"))


PARAMS = "p AS (SELECT l_returnflag AS c, l_linestatus AS k, l_linenumber AS i, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"


def _params(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("c"), F.col("l_linestatus").alias("k"), F.col("l_linenumber").alias("i")).agg(F.avg("l_quantity").alias("v"))


@query(f"WITH {PARAMS} SELECT k, i, round(avg(v), 6) AS v, count(DISTINCT c) AS n FROM p GROUP BY 1, 2")
def checkpoint_average(spark: SparkSession, d: str) -> DataFrame:
    return parameters.average(_params(spark, d), ["k", "i"], "v", "c").select("k", "i", r6("v"), "n")


@query(f"""WITH {PARAMS}, a AS (SELECT * FROM p WHERE c = 'A'), b AS (SELECT * FROM p WHERE c = 'N' AND i > 1)
 SELECT coalesce(a.k, b.k) AS k, coalesce(a.i, b.i) AS i, CASE WHEN a.v IS NULL THEN 'only_b' WHEN b.v IS NULL THEN 'only_a' ELSE 'both' END AS side, round(b.v - a.v, 6) AS diff FROM a FULL JOIN b ON a.k = b.k AND a.i = b.i""")
def checkpoint_diff(spark: SparkSession, d: str) -> DataFrame:
    p = _params(spark, d)
    return parameters.difference(p.where("c = 'A'"), p.where("c = 'N' AND i > 1"), ["k", "i"], "v").select("k", "i", "side", r6("diff"))


@query("""SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) = list_sort(list_distinct(list(CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'R' END))) AS same_set,
 list_sort(list(l_returnflag)) = list_sort(list(CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'R' END)) AS same_bag FROM lineitem GROUP BY 1""")
def arc_equality(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.col("l_linestatus") == "O", "N").otherwise("R")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("a"), F.collect_list(other).alias("b"))
    return g.select("l_orderkey", fusion.set_equal(F.col("a"), F.col("b")).alias("same_set"), (F.array_sort("a") == F.array_sort("b")).alias("same_bag"))


@query()
def robust_line(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice")
    return parameters.robust_line(li, ["l_returnflag"], "id", "l_quantity", "l_extendedprice", 5000.0)


# --- sequences and ranking ------------------------------------------------------------------------------------------


@query(f"""WITH {EV}, n AS (SELECT *, CASE WHEN t0 - max(t1) OVER w <= 7200 THEN 0 ELSE 1 END AS new FROM ev
 WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t0, t1, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY t0, t1, event_id) AS grp FROM n),
 m AS (SELECT user_id, event_type, min(t0) AS t0, max(t1) AS t1, max(value) AS difficulty FROM g GROUP BY user_id, event_type, grp)
 SELECT user_id, event_type, t0, t1, difficulty, (row_number() OVER (PARTITION BY user_id ORDER BY t0, event_type) - 1) AS seg FROM m""")
def segment_merge(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    m = series.merge(e, ["user_id", "event_type"], 7200.0, order=["t1", "event_id"])
    hardest = m.join(e.select("user_id", "event_type", F.col("t0").alias("at"), "value"), ["user_id", "event_type"]).where("at >= t0 AND at <= t1")
    s = hardest.groupBy("user_id", "event_type", "t0", "t1").agg(F.max("value").alias("difficulty"))
    return ranking.numbered(s, U, ["t0", "event_type"], "seg")


@query(f"""WITH {EV}, n AS (SELECT event_id, value, event_id % 7 AS y, t, coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t) AS dt,
 coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value) AS dx, coalesce(lead(event_id % 7) OVER w, event_id % 7) - coalesce(lag(event_id % 7) OVER w, event_id % 7) AS dy
 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
 SELECT event_id, round(sqrt((dx / dt) ** 2 + (dy / dt) ** 2), 6) AS speed FROM n WHERE dt > 0""")
def agent_speed(spark: SparkSession, d: str) -> DataFrame:
    e, o = events(spark, d).withColumn("y", F.col("event_id") % 7), ["t", "event_id"]
    g = series.gradient(series.gradient(e, U, o, "value", "t", "vx"), U, o, "y", "t", "vy")
    moving = series.gradient(g, U, o, "t", "t", "step").where("step = 1")
    return moving.select("event_id", r6(F.hypot("vx", "vy"), "speed"))


@query(f"""WITH {EV}, n AS (SELECT event_id, list(event_id) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS q FROM ev)
 SELECT event_id, array_to_string(list_append(CASE WHEN q IS NULL THEN [] WHEN len(q) < 3 THEN q ELSE list_concat(q[1:(event_id % 3)], q[(event_id % 3) + 2:3]) END, event_id), ',') AS queue FROM n""")
def temporal_queue(spark: SparkSession, d: str) -> DataFrame:
    q = parameters.temporal_queue(events(spark, d), U, ["t", "event_id"], "event_id", 3, F.col("event_id") % 3)
    return q.select("event_id", F.array_join(F.transform("queue", lambda v: v.cast("string")), ",").alias("queue"))


@query(f"""WITH {EV}, p AS (SELECT event_id, value / 100 AS a, value AS x, event_id % 50 AS y, first_value(value / 100) OVER w AS a0, first_value(value) OVER w AS x0, first_value(event_id % 50) OVER w AS y0
 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
 SELECT event_id, round(cos(a0) * (x - x0) + sin(a0) * (y - y0), 4) + 0.0 AS x, round(-sin(a0) * (x - x0) + cos(a0) * (y - y0), 4) + 0.0 AS y, round(cos(a - a0), 6) + 0.0 AS c FROM p""")
def relative_pose(spark: SparkSession, d: str) -> DataFrame:
    a, z = F.col("value") / 100, F.lit(0.0)
    one = F.lit(1.0)
    pose = F.array(F.cos(a), -F.sin(a), z, F.col("value"), F.sin(a), F.cos(a), z, (F.col("event_id") % 50).cast("double"), z, z, one, z, z, z, z, one)
    r = geometry.relative_to_first(events(spark, d).withColumn("pose", pose), U, ["t", "event_id"], "pose", "rel")
    r4 = lambda i, n: (F.round(F.col("rel")[i], 4) + F.lit(0.0)).alias(n)
    return r.select("event_id", r4(3, "x"), r4(7, "y"), r6(F.col("rel")[0], "c"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_orderkey - 1) * (SELECT max(l_linenumber) FROM lineitem) + l_linenumber AS step FROM lineitem")
def iteration_axis(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    iters = li.agg(F.max("l_linenumber")).scalar()
    return li.withColumn("step", (F.col("l_orderkey") - 1) * iters + F.col("l_linenumber"))


@query("""WITH s AS (SELECT l_orderkey, l_partkey, l_linenumber - 1 AS q, unnest([l_discount, l_tax, l_quantity / 500]) AS score, unnest([0, 1, 2]) AS label FROM lineitem),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, q * 10000000 + l_partkey, label) AS rank FROM s) SELECT l_orderkey, q * 10000000 + l_partkey AS query, label, round(score, 6) AS score, rank FROM r WHERE rank <= 4""")
def flat_top_k(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("query", (F.col("l_linenumber") - 1) * 10000000 + F.col("l_partkey")).withColumn("share", F.col("l_quantity") / 500)
    return parameters.flat_top_k(li, ["l_orderkey"], "query", ["l_discount", "l_tax", "share"], 4).withColumn("score", F.round("score", 6))


@query("""WITH r AS (SELECT lang, quality = 1 AS good, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))
 SELECT lang, k, round(count(*) FILTER (good AND r <= k) / nullif(count(*) FILTER (good), 0), 6) AS recall FROM r, (VALUES (10), (50)) t(k) GROUP BY 1, 2""")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    j = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(good, "doc_id")
    return parameters.recall_at(j, ["lang"], [F.col("n_chars").desc(), F.col("doc_id")], "good", [10, 50]).select("lang", "k", r6("recall"))


@query("""SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents WHERE NOT contains(text, '|') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 5""")
def first_clean(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where(~F.col("text").contains("|")).select("lang", "doc_id")
    return ranking.numbered(fusion.first_k_of(x, ["lang"], [F.col("doc_id")], 5), ["lang"], ["doc_id"])


# --- geometry and scalars -------------------------------------------------------------------------------------------


@query(f"WITH {VEC} SELECT vec_id, round(atan2(2 * (e0 * e3 + e1 * e2), 1 - 2 * (e2 * e2 + e3 * e3)), 6) + 0.0 AS yaw, round((e4 * 99 + pi()) - 2 * pi() * floor((e4 * 99 + pi()) / (2 * pi())) - pi(), 6) + 0.0 AS heading FROM v")
def yaw_heading(spark: SparkSession, d: str) -> DataFrame:
    q = scalar.yaw(*(F.col(f"e{i}") for i in range(4)))
    return _vecs(spark, d).select("vec_id", r6(q, "yaw"), r6(scalar.heading_wrapped(F.col("e4") * 99), "heading"))


@query("""WITH p AS (SELECT l_orderkey AS k, l_linenumber::DOUBLE AS x, max(l_quantity) AS y FROM lineitem GROUP BY 1, 2),
 b AS (SELECT k, count(*) AS n, min(x) AS x0, max(x) AS x1, max(x) FILTER (x <= 2.5) AS xl, arg_max(y, x) FILTER (x <= 2.5) AS yl, min(x) FILTER (x > 2.5) AS xh, arg_min(y, x) FILTER (x > 2.5) AS yh FROM p GROUP BY 1)
 SELECT k, round(CASE WHEN n >= 2 AND x0 - 1.5 <= 2.5 AND x1 + 1.5 >= 2.5 THEN CASE WHEN xl IS NOT NULL AND xh IS NOT NULL THEN yl + (yh - yl) * (2.5 - xl) / (xh - xl) ELSE coalesce(yl, yh) END END, 6) AS y FROM b""")
def line_at(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("double").alias("x")).agg(F.max("l_quantity").alias("y"))
    return p.groupBy("k").agg(F.collect_list(F.struct("x", "y")).alias("p")).select("k", r6(scalar.interpolated_y(F.col("p"), 2.5), "y"))


@query("""WITH p AS (SELECT l_orderkey AS k, l_discount * 100 - 5 AS y FROM lineitem) SELECT k, round(min(y) FILTER (y > 0.001) - max(y) FILTER (y < -0.001), 6) AS width, count(*) FILTER (y > 0.001 AND y < 3.5)::INTEGER AS lanes FROM p GROUP BY 1""")
def lane_lines(spark: SparkSession, d: str) -> DataFrame:
    y = F.round(F.col("l_discount") * 100 - 5, 3)
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(y).alias("ys"))
    return g.select("k", r6(scalar.lane_width(F.col("ys")), "width"), scalar.lane_offset(F.lit(3.5), F.col("ys")).alias("lanes"))


@query(f"WITH {VEC} SELECT vec_id, round(e0 * cos(e2) * cos(e1), 6) + 0.0 AS x, round(e0 * cos(e2) * sin(e1), 6) + 0.0 AS y, round(e0 * sin(e2), 6) + 0.0 AS z FROM v WHERE e0 > 0")
def range_points(spark: SparkSession, d: str) -> DataFrame:
    p = _vecs(spark, d).select("vec_id", geometry.range_to_xyz(F.col("e0"), F.col("e1"), F.col("e2")).alias("p")).where("p is not null")
    return p.select("vec_id", *(r6(F.col(f"p.{c}"), c) for c in "xyz"))


@query(f"""WITH {VEC}, n AS (SELECT *, sqrt(e0 * e0 + e1 * e1 + e2 * e2 + e3 * e3) * CASE WHEN e0 < 0 THEN -1 ELSE 1 END AS s FROM v)
 SELECT vec_id, round(e0 / s, 5) + 0.0 AS w, round(e1 / s, 5) + 0.0 AS x, round(e2 / s, 5) + 0.0 AS y, round(e3 / s, 5) + 0.0 AS z FROM n""")
def quaternion_cycle(spark: SparkSession, d: str) -> DataFrame:
    q = [F.col(f"e{i}") for i in range(4)]
    s = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    back = _vecs(spark, d).select("vec_id", scalar.matrix_to_quaternion(scalar.quaternion_to_matrix(*(c / s for c in q))).alias("q"))
    return back.select("vec_id", *((F.round(F.col(f"q.{c}"), 5) + F.lit(0.0)).alias(c) for c in "wxyz"))


@query(f"WITH {VEC} SELECT vec_id, round(e0, 6) + 0.0 AS cx, round(abs(e2) + 0.05, 6) AS w, round(atan2(sin(e4 * 40), cos(e4 * 40)), 6) + 0.0 AS rot FROM v")
def box_codec(spark: SparkSession, d: str) -> DataFrame:
    v = [F.col(f"e{i}") for i in range(5)]
    b = scalar.box_encode(v[0], v[1], v[1], F.abs(v[2]) + 0.05, F.lit(1.0), F.lit(2.0), v[4] * 40)
    o = _vecs(spark, d).select("vec_id", scalar.box_decode(b).alias("o"))
    return o.select("vec_id", r6(F.col("o")[0], "cx"), r6(F.col("o")[3], "w"), r6(F.col("o")[6], "rot"))


@query(f"""WITH {VEC}, b AS (SELECT vec_id, e0 AS x, e1 AS y, abs(e2) + 0.1 AS w, abs(e3) + 0.1 AS h FROM v),
 i AS (SELECT *, greatest(w - 0.05, 0) * greatest(h - 0.02, 0) AS inter FROM b) SELECT vec_id, round(inter / (2 * w * h - inter), 5) AS iou FROM i""")
def corner_iou(spark: SparkSession, d: str) -> DataFrame:
    x, y, w, h = F.col("e0"), F.col("e1"), F.abs("e2") + 0.1, F.abs("e3") + 0.1
    iou = matching.iou_corner([x, y, x + w, y + h], [x + 0.05, y + 0.02, x + w + 0.05, y + h + 0.02])
    return _vecs(spark, d).select("vec_id", F.round(iou, 5).alias("iou"))


@query(f"""WITH {VEC}, a AS (SELECT vec_id, abs(e0 - e2) AS a, abs(e1 - e3) AS b FROM v) SELECT vec_id, round(a + b, 6) AS l1,
 round(CASE WHEN a < 0.1 THEN 0.5 * a * a / 0.1 ELSE a - 0.05 END + CASE WHEN b < 0.1 THEN 0.5 * b * b / 0.1 ELSE b - 0.05 END, 6) AS smooth FROM a""")
def box_distances(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.array("e0", "e1"), F.array("e2", "e3")
    return _vecs(spark, d).select("vec_id", r6(scalar.l1(a, b), "l1"), r6(scalar.smooth_l1(a, b, 0.1), "smooth"))


@query(f"WITH {VEC} SELECT vec_id, round(cos(e0 * e1 * 100), 6) + 0.0 AS c, round(sin(e0 * e1 * 100), 6) + 0.0 AS s FROM v")
def row_pose(spark: SparkSession, d: str) -> DataFrame:
    m = _vecs(spark, d).select("vec_id", scalar.rodrigues(F.lit(0.0), F.lit(0.0), F.col("e0") * 100, F.col("e1")).alias("m"))
    return m.select("vec_id", r6(F.col("m")[0], "c"), r6(F.col("m")[3], "s"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def utc_stamps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


# --- records --------------------------------------------------------------------------------------------------------

KSETS = f"{EV}, k AS (SELECT user_id, list({KINDS} ORDER BY t, event_id) AS ks FROM ev GROUP BY 1)"


def _arcs(spark: SparkSession, d: str) -> DataFrame:
    k = _kinds(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "kind"))).alias("s"))
    return k.select("user_id", F.transform("s", lambda s: s["kind"]).alias("ks"))


@query(f"""WITH {KSETS}, a AS (SELECT user_id, ks, list_filter(ks, lambda x: x IN ('decelerate', 'accelerate', 'stop')) AS lon, list_filter(ks, lambda x: x IN ('turn_left', 'turn_right', 'lane_change_left', 'lane_change_right')) AS lat FROM k)
 SELECT user_id, lon[1] AS first_lon, lon[-1] AS last_lon, lat[1] AS first_lat, array_to_string(list_filter(['u_turn', 'turn_left', 'turn_right', 'stop'], lambda x: list_contains(ks, x)), ',') AS tags FROM a""")
def action_axes(spark: SparkSession, d: str) -> DataFrame:
    a = _arcs(spark, d).select("user_id", "ks", rules.axes(F.col("ks")).alias("a"))
    tags = F.array_join(rules.auto_tags(F.col("ks")), ",").alias("tags")
    return a.select("user_id", F.col("a.lon_transition").alias("first_lon"), F.col("a.lon_state").alias("last_lon"), F.col("a.lat_transition").alias("first_lat"), tags)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 = 0 THEN m WHEN o_orderstatus = 'F' THEN 'ego_turn_left' WHEN o_orderstatus = 'O' THEN 'ego_turn_right'
 WHEN o_custkey % 3 = 0 THEN 'ego_stop' ELSE m END AS action FROM (SELECT *, CASE o_custkey % 3 WHEN 0 THEN 'ego_u_turn' ELSE 'ego_evade' END AS m FROM orders)""")
def grounded_action(spark: SparkSession, d: str) -> DataFrame:
    arc = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("turn_left"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("turn_right"))).otherwise(F.array(F.lit("stop")))
    model = F.when(F.col("o_custkey") % 3 == 0, "ego_u_turn").otherwise("ego_evade")
    return table(spark, d, "orders").select("o_orderkey", rules.grounded_action(model, arc).alias("action"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' AND l_linestatus IN ('F') THEN l_linestatus WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'O' WHEN l_returnflag = 'A' THEN 'moving' WHEN l_returnflag = 'N' THEN 'parked' END AS attribute FROM lineitem""")
def legal_attributes(spark: SparkSession, d: str) -> DataFrame:
    a = rules.legal_or_default(F.col("l_returnflag"), F.col("l_linestatus"), {"A": ["F"], "N": ["O"]}, {"A": "moving", "N": "parked"})
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", a.alias("attribute"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus = 'F' THEN 'mono_lidar' WHEN o_custkey % 2 = 0 THEN 'mono_only' WHEN o_totalprice > 100000 THEN 'ransac' ELSE 'none' END AS method FROM orders""")
def depth_routing(spark: SparkSession, d: str) -> DataFrame:
    m = rules.depth_method(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000)
    return table(spark, d, "orders").select("o_orderkey", m.alias("method"))


@query("""SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE o_orderstatus WHEN 'F' THEN 'night' WHEN 'O' THEN 'day' END, CASE WHEN o_custkey % 4 = 0 THEN 'rain' WHEN o_custkey % 4 = 1 THEN 'clear_weather' END,
 CASE WHEN o_custkey % 2 = 0 THEN 'wet_road' END, CASE WHEN o_totalprice > 200000 THEN 'glare' END], lambda x: x IS NOT NULL)), ',') AS env FROM orders""")
def environment_tags(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("o_custkey") % 4
    light = F.when(F.col("o_orderstatus") == "F", "night").when(F.col("o_orderstatus") == "O", "day").otherwise("dusk")
    sky, road = F.when(m == 0, "rain").when(m == 1, "clear").otherwise("haze"), F.when(F.col("o_custkey") % 2 == 0, "wet")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(rules.environment(light, sky, road, {"glare": F.col("o_totalprice") > 200000}), ",").alias("env"))


@query("""WITH c AS (SELECT l_orderkey AS k, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag) AS m FROM lineitem GROUP BY 1),
 j AS (SELECT k, m, CASE o_orderstatus WHEN 'F' THEN ['R', 'X'] WHEN 'O' THEN ['N'] ELSE ['A', 'A'] END AS g FROM c JOIN orders ON o_orderkey = k)
 SELECT k, array_to_string(list_concat(list_transform(m, lambda x, i: CASE WHEN list_position(m, x) = i AND list_contains(g, x) THEN 'gt:' || x ELSE 'model:' END),
 list_transform(list_filter(g, lambda x: NOT list_contains(m, x)), lambda x: 'gt_injected:' || x)), ',') AS components, len(list_filter(g, lambda x: list_contains(m, x)))::INTEGER AS covered FROM j""")
def component_injection(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string").alias("relation")
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("s"))
    objects = lambda *xs: F.array(*(F.struct(F.lit(x).alias("object_type"), none) for x in xs))
    seen = F.when(F.col("o_orderstatus") == "F", objects("R", "X")).when(F.col("o_orderstatus") == "O", objects("N")).otherwise(objects("A", "A"))
    j = li.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), seen.alias("seen")), "k")
    named = F.transform("s", lambda s: F.struct(s["l_returnflag"].alias("object_type"), none))
    r = j.select("k", rules.grounded_components(named, F.col("seen")).alias("r"))
    text = F.transform("r.components", lambda c: F.concat(c["source"], F.lit(":"), F.coalesce(c["object_type"], F.lit(""))))
    return r.select("k", F.array_join(text, ",").alias("components"), F.size(F.filter("r.consistency", lambda c: c["covered_by_model"])).alias("covered"))


@query("""SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'no card' ELSE array_to_string(list_filter([CASE WHEN NOT regexp_matches(text, '[?]') THEN 'missing: question' END, CASE WHEN NOT regexp_matches(text, '[0-9]') THEN 'missing: number' END,
 CASE WHEN len(regexp_extract_all(text, '(?:with|for) ([a-z, ]+)', 1)) = 0 THEN 'missing: axis' WHEN len(list_filter(regexp_extract_all(text, '(?:with|for) ([a-z, ]+)', 1), lambda a: regexp_matches(a, '[,·+]'))) > 0 THEN 'several: axis' END], lambda x: x IS NOT NULL), ';') END AS problems FROM conversations""")
def card_problems(spark: SparkSession, d: str) -> DataFrame:
    p = rules.card_problems(F.col("text"), {"question": "[?]", "number": "[0-9]"}, "(?:with|for) ([a-z, ]+)", "axis")
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(p, ";").alias("problems"))


@query("""WITH r AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) + 1 AS pos, '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation)
 SELECT pos, line FROM r UNION ALL SELECT 0, '| n_nationkey | n_name |' UNION ALL SELECT 1, '|-|-|'""")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    return writers.markdown_table(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


# --- scenario chains ------------------------------------------------------------------------------------------------


def _log(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as a log of one row each half second: a user is a clip, i the row's place."""
    e = events(spark, d)
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1
    return e.select(F.col("user_id").cast("string").alias("clip_id"), "user_id", "value", i.alias("i"), (i * 0.5).alias("t"))


#: The same in SQL.
LOG = f"""{EV}, log AS (SELECT user_id::VARCHAR AS clip_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i,
 (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1) * 0.5::DOUBLE AS t FROM ev)"""


def _ego(spark: SparkSession, d: str) -> DataFrame:
    """The log as motion: users swing by much, a little or hardly, so that they turn, change lanes or keep on."""
    log = _log(spark, d)
    swing = F.when(F.col("user_id") % 3 == 0, 1.5).when(F.col("user_id") % 3 == 1, 0.25).otherwise(0.02)
    half = swing * F.sin(F.col("i") * 0.35) / 2
    us = (F.col("i").cast("long") * 500_000).alias("timestamp_us")
    ego = log.select("clip_id", us, F.cos(half).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.when(F.col("user_id") % 5 == 0, F.col("value") % 1 + 1.5).otherwise(F.col("value") / 5).alias("vx"), F.lit(0.0).alias("vy"), (F.col("value") % 5 - 2.5).alias("ax"))
    return scenario.ego_series(ego, log.select("clip_id", us))


EGO_NET = f"""{LOG}, y0 AS (SELECT clip_id, t, CASE WHEN user_id % 5 = 0 THEN value % 1 + 1.5 ELSE value / 5 END AS speed, value % 5 - 2.5 AS ax, (CASE user_id % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 0.25 ELSE 0.02 END)::DOUBLE * sin(i * 0.35::DOUBLE) AS raw,
 count(*) OVER (PARTITION BY clip_id) AS n, max(t) OVER (PARTITION BY clip_id) AS dur FROM log),
 y1 AS (SELECT *, raw - first_value(raw) OVER (PARTITION BY clip_id ORDER BY t) AS yaw FROM y0 WHERE n >= 3),
 ego AS (SELECT clip_id, t, dur, speed, ax, yaw, (coalesce(lead(yaw) OVER w, yaw) - coalesce(lag(yaw) OVER w, yaw)) / (coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t)) AS rate
 FROM y1 WINDOW w AS (PARTITION BY clip_id ORDER BY t)),
 masks AS (SELECT clip_id, t, yaw, speed, unnest(['decelerate', 'accelerate', 'stop', 'turn']) AS kind, unnest([ax < -1, ax > 1, speed < 1.5, abs(rate) > 0.15]) AS hit FROM ego),
 islands AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id, kind ORDER BY t) AS run FROM masks),
 runs AS (SELECT clip_id, kind, run, min(t) AS t0, max(t) AS t1 FROM islands WHERE hit GROUP BY 1, 2, 3 HAVING max(t) - min(t) >= 0.4),
 side AS (SELECT r.clip_id, r.t0, r.t1, e.t, e.yaw, e.speed * sin(e.yaw - first_value(e.yaw) OVER (PARTITION BY r.clip_id, r.t0 ORDER BY e.t)) AS s FROM runs r JOIN ego e ON e.clip_id = r.clip_id AND e.t BETWEEN r.t0 AND r.t1 WHERE r.kind = 'turn'),
 parts AS (SELECT *, coalesce((t - lag(t) OVER w) * (s + lag(s) OVER w) / 2, 0.0) AS part FROM side WINDOW w AS (PARTITION BY clip_id, t0 ORDER BY t)),
 net AS (SELECT clip_id, t0, t1, degrees(arg_max(yaw, t) - arg_min(yaw, t)) AS net, sum(part) AS lat FROM parts GROUP BY 1, 2, 3)"""

EGO = f"""{EGO_NET},
 found AS (SELECT clip_id, kind, t0, t1 FROM runs WHERE kind <> 'turn' UNION ALL SELECT * FROM (SELECT clip_id, CASE WHEN net >= 45 THEN 'turn_left' WHEN net <= -45 THEN 'turn_right'
 WHEN abs(net) <= 22 AND lat BETWEEN 1.8 AND 6 THEN 'lane_change_left' WHEN abs(net) <= 22 AND lat BETWEEN -6 AND -1.8 THEN 'lane_change_right' END AS kind, t0, t1 FROM net) WHERE kind IS NOT NULL),
 steps AS (SELECT *, CASE WHEN t0 - max(t1) OVER (PARTITION BY clip_id, kind ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0.6 THEN 0 ELSE 1 END AS new FROM found),
 grouped AS (SELECT *, sum(new) OVER (PARTITION BY clip_id, kind ORDER BY t0, t1) AS g FROM steps),
 ego_ev AS (SELECT clip_id, kind, min(t0) AS t0, max(t1) AS t1 FROM grouped GROUP BY clip_id, kind, g)"""


@query(f"WITH {EGO} SELECT clip_id, kind, round_even(t0, 2) AS t0, round_even(t1, 2) AS t1, round_even((t0 + t1) / 2, 2) AS center FROM ego_ev")
def ego_event_chain(spark: SparkSession, d: str) -> DataFrame:
    return scenario.ego_events(_ego(spark, d))


TRACK_CLASSES = ["vehicle::car", "pedestrian::pedestrian", "vehicle::truck", "twowheeler::bicycle", "vehicle::car"]


def _points(spark: SparkSession, d: str) -> DataFrame:
    """The log as five tracks a clip: some keep their lane, some drift into it or out of it, some come towards it."""
    log, k, i = _log(spark, d), F.pmod("i", F.lit(5)), F.col("i")
    lane = F.when(k == 0, 0.4).when((k == 1) & (F.col("user_id") % 4 == 1), 4.0).when(k == 1, 3 - i * 0.04).when(k == 2, F.greatest(3 - i * 0.06, F.lit(0.2))).when(k == 3, F.lit(1.0)).otherwise(F.least(0.3 + i * 0.05, F.lit(4.0)))
    yaw = F.when((k == 0) & (F.col("user_id") % 4 == 0), 3.0).when((k == 4) & (F.col("user_id") % 2 == 0), 1.5).otherwise(F.col("value") % 1 / 2)
    cls = F.get(F.array(*(F.lit(c) for c in TRACK_CLASSES)), k.cast("int"))
    return log.select("clip_id", F.concat(F.lit("track"), k.cast("string")).alias("track_id"), cls.alias("cls"), "t", F.when((k == 4) & (F.col("user_id") % 4 == 0), 12.0).otherwise(F.col("value") % 60).alias("x"), (lane + F.col("value") % 1 / 10).cast("double").alias("y"), yaw.cast("double").alias("yaw"))


POINTS = f"""p AS (SELECT clip_id, 'track' || (i % 5) AS track_id, ({TRACK_CLASSES!r})[i % 5 + 1] AS cls, t, CASE WHEN i % 5 = 4 AND user_id % 4 = 0 THEN 12.0 ELSE value % 60 END::DOUBLE AS x,
 ((CASE i % 5 WHEN 0 THEN 0.4 WHEN 1 THEN CASE WHEN user_id % 4 = 1 THEN 4.0 ELSE 3 - i * 0.04 END WHEN 2 THEN greatest(3 - i * 0.06, 0.2) WHEN 3 THEN 1.0 ELSE least(0.3 + i * 0.05, 4.0) END)::DOUBLE + value % 1 / 10)::DOUBLE AS y,
 (CASE WHEN i % 5 = 0 AND user_id % 4 = 0 THEN 3.0 WHEN i % 5 = 4 AND user_id % 2 = 0 THEN 1.5 ELSE value % 1 / 2 END)::DOUBLE AS yaw FROM log),
 kinds(cls, kind) AS (VALUES ('vehicle::car', 'vehicle'), ('vehicle::truck', 'large_vehicle'), ('pedestrian::pedestrian', 'pedestrian'), ('twowheeler::bicycle', 'bicycle_micromobility'))"""


@query(f"""WITH RECURSIVE {LOG}, {POINTS}, c AS (SELECT *, abs(y) < 2.5 AND x > 0 AND x < 45 AS inn FROM p JOIN kinds USING (cls)),
 g AS (SELECT clip_id, track_id, arg_min(kind, (t, x, y)) AS object_type, arg_min(abs(y), (t, x, y)) AS first_y, min(t) FILTER (inn) AS t0, max(t) FILTER (inn) AS t1, round_even(min(x) FILTER (inn), 1) AS min_dist,
 min(abs(y)) FILTER (inn) AS min_y FROM c GROUP BY 1, 2 HAVING count(*) FILTER (inn) >= 3 AND max(t) FILTER (inn) - min(t) FILTER (inn) >= 1),
 v AS (SELECT *, object_type IN ('pedestrian', 'bicycle_micromobility') AS vru, first_y > 2.8 AND min_y < 1.5 AS cut FROM g),
 a AS (SELECT *, CASE WHEN vru THEN 'crossing' WHEN cut THEN 'adjust' ELSE 'preceding_vehicle' END AS role, CASE WHEN vru THEN 'cross_ego_path' WHEN cut THEN 'cut_in' END AS relation FROM v),
 o AS (SELECT *, row_number() OVER (PARTITION BY clip_id, object_type, role ORDER BY min_dist, t0, track_id) AS i FROM a),
 k AS (SELECT clip_id, object_type, role, i, true AS hit, [{{'a': t0, 'b': t1}}] AS kept FROM o WHERE i = 1
 UNION ALL SELECT clip_id, object_type, role, i, hit, CASE WHEN hit THEN list_append(kept, {{'a': t0, 'b': t1}}) ELSE kept END FROM (
 SELECT o.*, k.kept, len(list_filter(k.kept, lambda z: z.b >= o.t0 AND z.a <= o.t1)) = 0 AS hit FROM k JOIN o ON o.clip_id = k.clip_id AND o.object_type = k.object_type AND o.role = k.role AND o.i = k.i + 1))
 SELECT clip_id, object_type, role, relation, CASE WHEN NOT vru AND NOT cut THEN 'maintain_speed' END AS longitudinal_action, CASE WHEN object_type = 'pedestrian' THEN 'crossing' END AS vru_detail,
 min_dist, t0, t1, track_id FROM k JOIN o USING (clip_id, object_type, role, i) WHERE hit""")
def agent_event_chain(spark: SparkSession, d: str) -> DataFrame:
    return scenario.agent_events(_points(spark, d))


@query(f"""WITH {EGO}, {POINTS}, s AS (SELECT clip_id, track_id, kind, t, x, abs(y) AS y, y AS side, yaw, count(*) OVER (PARTITION BY clip_id, track_id) AS n, coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t) AS dt,
 coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM p JOIN kinds USING (cls) WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY t)),
 f AS (SELECT *, sqrt((dx / dt) ** 2 + (dy / dt) ** 2) AS v, x > 0 AND x < 25 AND y < 5.5 AS near, y < 2.5 AND x > 0 AND x < 45 AS inc, x > 0 AND x < 25 AS fwd FROM s WHERE n >= 4),
 r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, track_id, fwd ORDER BY t) AS a, row_number() OVER (PARTITION BY clip_id, track_id, fwd ORDER BY t DESC) AS b FROM f),
 g AS (SELECT clip_id, track_id, kind, median(abs(atan2(sin(yaw), cos(yaw)))) AS dir, min(t) FILTER (near) AS n0, max(t) FILTER (near) AS n1, count(*) FILTER (near) AS nn, min(y) FILTER (near) AS near_y,
 max(side) FILTER (near) - min(side) FILTER (near) AS ptp, min(v) FILTER (near) AS near_v, min(t) FILTER (inc) AS c0, max(t) FILTER (inc) AS c1, count(*) FILTER (inc) AS cn, min(x) FILTER (inc) AS c_x, min(y) FILTER (inc) AS c_y,
 avg((y < 1.5)::INT) FILTER (inc) AS share, max(v) FILTER (inc) - min(v) FILTER (inc) AS v_span, arg_min(v, t) FILTER (inc) > arg_max(v, t) FILTER (inc) AS slower, min(t) FILTER (fwd) AS a0, max(t) FILTER (fwd) AS a1,
 count(*) FILTER (fwd) AS an, min(y) FILTER (fwd) AS a_y, avg(y) FILTER (fwd AND a <= 3) AS head, avg(y) FILTER (fwd AND b <= 3) AS tail FROM r GROUP BY 1, 2, 3),
 es AS (SELECT g.clip_id, g.track_id, avg(speed) FILTER (e.t BETWEEN n0 AND n1) AS near_mean, min(speed) FILTER (e.t BETWEEN n0 AND n1) AS near_min, avg(speed) FILTER (e.t BETWEEN c0 AND c1) AS cor_mean,
 abs(degrees(arg_max(yaw, e.t) FILTER (e.t BETWEEN a0 AND a1) - arg_min(yaw, e.t) FILTER (e.t BETWEEN a0 AND a1))) AS turn FROM g JOIN ego e ON e.clip_id = g.clip_id GROUP BY 1, 2),
 h AS (SELECT *, kind = 'pedestrian' AS ped, kind IN ('vehicle', 'large_vehicle') AS car FROM g LEFT JOIN es USING (clip_id, track_id)),
 m AS (SELECT *, car AND dir < 0.7 AND cn > 0 AS same, car AND dir BETWEEN 0.7 AND 2.4 AND nn > 0 AS crossing, (near_y < 2.5 AND ptp > 2 AND nn > 1) OR near_y < 1.5 AS walks FROM h),
 q AS (SELECT *, same AND an >= 3 AND coalesce(turn, 0) <= 25 AS moving, same AND share > 0.5 AS lead, coalesce(near_v < 1 AND near_mean > 2, false) AS waits FROM m),
 leads AS (SELECT clip_id, c0 AS t0, c1 AS t1 FROM q WHERE lead),
 crawl AS (SELECT clip_id, t, speed > 1 AND speed < 3 AS hit FROM ego), cr AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY t) AS run FROM crawl),
 creeps AS (SELECT clip_id, min(t) AS t0, max(t) AS t1 FROM cr WHERE hit GROUP BY clip_id, run HAVING max(t) - min(t) >= 3),
 slow AS (SELECT v.clip_id, v.t0, v.t1, avg(e.speed) AS mean FROM ego_ev v JOIN ego e ON e.clip_id = v.clip_id AND e.t BETWEEN v.t0 AND v.t1 WHERE v.kind = 'decelerate' GROUP BY 1, 2, 3)
 SELECT clip_id, 'ped_crossing' AS cat, n0 AS t0, n1 AS t1 FROM q WHERE ped AND nn > 0 AND walks UNION ALL SELECT clip_id, 'vru_roadside', n0, n1 FROM q WHERE ped AND nn > 0 AND NOT walks
 UNION ALL SELECT clip_id, 'cyclist_pm_near', n0, n1 FROM q WHERE kind = 'bicycle_micromobility' AND nn > 0
 UNION ALL SELECT clip_id, CASE WHEN head >= 2.5 AND tail < 1.2 THEN 'cut_in' WHEN head >= 2.5 THEN 'cut_in_attempt' ELSE 'cut_out' END, a0, a1 FROM q
 WHERE moving AND ((head >= 2.5 AND (tail < 1.2 OR a_y < 2.2)) OR (head < 1.2 AND tail >= 2.5))
 UNION ALL SELECT clip_id, 'close_follow', c0, c1 FROM q WHERE lead AND cor_mean > 8 AND c_x / cor_mean < 0.6 UNION ALL SELECT clip_id, 'lead_decel', c0, c1 FROM q WHERE lead AND cn >= 3 AND v_span > 1.5 AND slower
 UNION ALL SELECT clip_id, 'oncoming_encroach', c0, c1 FROM q WHERE car AND dir > 2.4 AND c_y < 1.5 UNION ALL SELECT clip_id, 'agent_yields_to_ego', n0, n1 FROM q WHERE crossing AND waits
 UNION ALL SELECT clip_id, 'ego_yields_to_agent', n0, n1 FROM q WHERE crossing AND NOT waits AND near_min < 1
 UNION ALL SELECT clip_id, 'creep', t0, t1 FROM creeps c WHERE EXISTS (SELECT 1 FROM leads l WHERE l.clip_id = c.clip_id AND l.t1 >= c.t0 AND l.t0 <= c.t1)
 AND NOT EXISTS (SELECT 1 FROM ego_ev v WHERE v.kind LIKE 'turn_%' AND v.clip_id = c.clip_id AND v.t1 >= c.t0 AND v.t0 <= c.t1)
 AND coalesce((SELECT sum(greatest(least(v.t1, c.t1) - greatest(v.t0, c.t0), 0)) FROM ego_ev v WHERE v.kind = 'stop' AND v.clip_id = c.clip_id), 0) <= 0.5 * (c.t1 - c.t0)
 UNION ALL SELECT clip_id, 'decel_at_intersection', t0, t1 FROM (SELECT * FROM slow WHERE mean > 2 QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY t0, t1) = 1)
 UNION ALL SELECT DISTINCT v.clip_id, v.kind, 0.0, e.dur FROM ego_ev v JOIN ego e USING (clip_id) WHERE v.kind LIKE 'lane_change%'""")
def taxonomy_chain(spark: SparkSession, d: str) -> DataFrame:
    ego = materialise(_ego(spark, d), "ego").hint("merge")  # here and below: small on disk, many rows in a driver's table
    return scenario.taxonomy(_points(spark, d), ego, materialise(scenario.ego_events(ego), "ego_events").hint("merge"))
