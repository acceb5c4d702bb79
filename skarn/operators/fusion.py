"""Evidence channels: union with provenance, confirmation, confidence, the search index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: interaction categories, context categories and kinematic categories of confirmation
INTERACTION = (
    "cut_in cut_in_attempt cut_out lead_decel close_follow ped_crossing vru_roadside cyclist_pm_near oncoming_encroach agent_yields_to_ego ego_yields_to_agent".split()
)
CONTEXT = (
    "road_highway road_urban_arterial road_backstreet road_rural road_tunnel road_bridge road_parking intersection_signalized "
    "intersection_unsignalized roundabout merge_onramp construction_cones toll_gate red_light_stop signal_go day twilight night clear_weather "
    "rain snow fog dry_road wet_road glare crosswalk_present traffic_light_present undivided_road"
).split()
KINEMATIC = ["close_follow", "creep", "vru_roadside"]
# fixed values: category to cause
CAUSES = {
    "agent": "cut_in cut_in_attempt cut_out lead_decel close_follow ped_crossing vru_roadside cyclist_pm_near oncoming_encroach agent_yields_to_ego ego_yields_to_agent".split(),
    "signal": "red_light_stop signal_go intersection_signalized".split(),
    "road_geometry": "intersection_unsignalized roundabout merge_onramp turn_left turn_right u_turn".split(),
}
# fixed values: categories that are searched as one
MERGED = {"road_urban_arterial": "road_surface", "road_backstreet": "road_surface"}


def lookup(value: Column, pairs: dict[str, str], default: Column | None = None) -> Column:
    """A small mapping as an expression; what it lacks keeps its own value, or the default."""
    kept = value if default is None else default
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in pairs.items() for x in p)), value), kept) if pairs else kept


def union_channels(channels: dict[str, DataFrame], keys: list[str], cat: str, yields: tuple[str, str] | None = None) -> DataFrame:
    """(keys, cat, channels, multi) over all channels; of ``yields`` (a, b), a is dropped where b has the category."""
    tagged = {n: d.select(*keys, cat).distinct().withColumn("channel", F.lit(n)) for n, d in channels.items()}
    if yields:
        a, b = yields
        tagged[a] = tagged[a].join(tagged[b].select(*keys, cat), [*keys, cat], "left_anti")
    every = reduce(DataFrame.unionByName, tagged.values())
    return every.groupBy(*keys, cat).agg(F.array_sort(F.collect_set("channel")).alias("channels")).withColumn("multi", F.size("channels") >= 2)


def confirm(gt: Column, vlm: Column, semantic: list[str], context: list[str], kinematic: list[str]) -> Column:
    """(V & SEM & G) | (V & CTX) | (G & KIN), sorted."""
    lit = lambda xs: F.array(*(F.lit(x) for x in xs))
    both = F.array_intersect(F.array_intersect(vlm, lit(semantic)), gt)
    return F.array_sort(F.array_union(F.array_union(both, F.array_intersect(vlm, lit(context))), F.array_intersect(gt, lit(kinematic))))


def confirm_scene(gt: Column, vlm: Column) -> Column:
    """Confirmation with the fixed categories; a deceleration at an intersection needs both channels."""
    crossing = F.arrays_overlap(vlm, F.array(F.lit("intersection_signalized"), F.lit("intersection_unsignalized")))
    extra = F.when(F.array_contains(gt, "decel_at_intersection") & crossing, F.array(F.lit("decel_at_intersection"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(confirm(gt, vlm, INTERACTION, CONTEXT, KINEMATIC), extra))


def ground_signals(cats: Column, n: Column, min_speed: Column, rising: Column) -> Column:
    """red_light_stop needs a stop in the window, signal_go a stop and a rise; fewer than two samples change nothing."""
    stopped = min_speed < 1.5
    ok = lambda c: F.when(c == "red_light_stop", stopped).when(c == "signal_go", stopped & rising).otherwise(F.lit(True))
    return F.when(F.coalesce(n, F.lit(0)) < 2, cats).otherwise(F.filter(cats, lambda c: F.coalesce(ok(c), F.lit(False))))


def confidence(channels: Column, vote_fraction: Column) -> Column:
    """ego .45, gt .40, vlm .50 of its votes, .25 for two channels; at most 1, to two places."""
    has = lambda c: F.array_contains(channels, c)
    score = (
        F.when(has("ego"), 0.45).otherwise(0.0)
        + F.when(has("gt"), 0.40).otherwise(0.0)
        + F.when(has("vlm"), 0.50 * F.coalesce(vote_fraction, F.lit(0.0))).otherwise(0.0)
        + F.when(F.size(channels) >= 2, 0.25).otherwise(0.0)
    )
    return F.round(F.least(score, F.lit(1.0)), 2)


def index(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tags): candidates (keys, cat, channels, vote_fraction) merged by search tag, sorted by confidence and name."""
    tag = lookup(F.col("cat"), MERGED)
    merged = candidates.withColumn("tag", tag).groupBy(*keys, "tag").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("channels"),
        F.max("vote_fraction").alias("vote_fraction"),
        F.array_sort(F.collect_set(F.when(F.col("cat") != F.col("tag"), F.col("cat")))).alias("subs"),
    )
    scored = merged.withColumn("confidence", confidence(F.col("channels"), F.col("vote_fraction")))
    row = F.struct((-F.col("confidence")).alias("o"), "tag", "confidence", "channels", "vote_fraction", "subs")
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: F.struct(*(r[c].alias(c) for c in ("tag", "confidence", "channels", "vote_fraction", "subs"))))
    return scored.groupBy(*keys).agg(rows.alias("tags"))


def causes(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cause, vote_fraction, channels, cats): candidates rolled up by cause; a key without any gets "other"."""
    pairs = {c: k for k, cs in CAUSES.items() for c in cs}
    held = candidates.withColumn("cause", lookup(F.col("cat"), pairs, F.lit(None).cast("string")))
    rolled = held.where(F.col("cause").isNotNull()).groupBy(*keys, "cause").agg(
        F.max("vote_fraction").alias("vote_fraction"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("channels"),
        F.array_sort(F.collect_set("cat")).alias("cats"),
    )
    none = F.array().cast("array<string>")
    other = candidates.select(*keys).distinct().join(rolled, keys, "left_anti").select(*keys, F.lit("other").alias("cause"), F.lit(0.0).alias("vote_fraction"), none.alias("channels"), none.alias("cats"))
    return rolled.unionByName(other)


def gold_score(gold: DataFrame, keys: list[str], human: str = "human", pred: str = "pred", derivable: list[str] = ()) -> DataFrame:
    """Per row tp, fn, fp and the missed tags with their error class.

    A null prediction: the stage failed (FACT_MAP). ``matched`` false: no episode there (ANCHOR). Else FACT where the tag
    is derivable, VISUAL where it is not.
    """
    p = F.coalesce(F.col(pred), F.array().cast("array<string>"))
    known = F.array(*(F.lit(x) for x in derivable)) if derivable else F.array().cast("array<string>")
    why = lambda t: (
        F.when(F.col(pred).isNull(), "FACT_MAP").when(~F.col("matched"), "ANCHOR").when(F.array_contains(known, t), "FACT").otherwise("VISUAL")
    )
    missed = F.array_except(human, p)
    return gold.select(
        *keys,
        F.size(F.array_intersect(human, p)).cast("long").alias("tp"),
        F.size(missed).cast("long").alias("fn"),
        F.size(F.array_except(p, F.col(human))).cast("long").alias("fp"),
        F.transform(missed, lambda t: F.struct(t.alias("tag"), why(t).alias("error"))).alias("errors"),
    )


def micro(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Recall and the lower bound of precision over rows of ``gold_score``."""
    tp, fn, fp = F.sum("tp"), F.sum("fn"), F.sum("fp")
    aggs = (tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), F.round(tp / F.nullif(tp + fn, F.lit(0)), 3).alias("recall"), F.round(tp / F.nullif(tp + fp, F.lit(0)), 3).alias("precision_lower"))
    return scored.groupBy(*keys).agg(*aggs) if keys else scored.agg(*aggs)


def gate(records: DataFrame, near: float = 45.0) -> DataFrame:
    """Physical checks as rows (keys, check, verdict): fail or undetermined, never pass.

    records: cause, distances array<double>, arc array<string>, has_index boolean, signal_in_clip boolean.
    """
    turns = F.array(*(F.lit(x) for x in ("turn_left", "turn_right", "u_turn", "lane_change_left", "lane_change_right")))
    reachable = F.when(F.col("cause") != "agent", None).when(~F.exists("distances", lambda d: d <= near), "fail").otherwise("undetermined")
    direction = (
        F.when((F.col("cause") == "road_geometry") & ~F.arrays_overlap("arc", turns), "fail")
        .when((F.col("cause") == "signal") & F.col("has_index") & ~F.col("signal_in_clip"), "fail")
        .otherwise("undetermined")
    )
    checks = F.array(
        *(F.struct(F.lit(n).alias("check"), F.lit("undetermined").alias("verdict")) for n in ("precedes", "observable", "reaction_delay")),
        F.struct(F.lit("reachable").alias("check"), reachable.alias("verdict")),
        F.struct(F.lit("direction_consistent").alias("check"), direction.alias("verdict")),
    )
    return records.select("*", F.inline(checks)).where(F.col("verdict").isNotNull())


def set_equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def config_diff(df: DataFrame, key: str, value: str, who: str, n: int) -> DataFrame:
    """Keys whose value differs among n owners, a missing value being a value."""
    text = F.coalesce(F.col(value).cast("string"), F.lit("\0null"))
    g = df.groupBy(key).agg(F.count_distinct(text).alias("kinds"), F.count_distinct(who).alias("owners"))
    return g.where((F.col("kinds") > 1) | (F.col("owners") < n)).select(key, "kinds", "owners")


def first_k_of(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")
