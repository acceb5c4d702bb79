"""Rules on records: actions, roles, tags, validation, difficulty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skarn.operators.fusion import lookup

# fixed values: classes of tracks and of detections, as searched object types
OBSTACLE_TYPES = {
    "automobile": "vehicle", "car": "vehicle", "van": "vehicle", "heavy_truck": "large_vehicle", "truck": "large_vehicle",
    "trailer": "large_vehicle", "bus": "large_vehicle", "person": "pedestrian", "pedestrian": "pedestrian",
    "rider": "bicycle_micromobility", "cyclist": "bicycle_micromobility", "motorcycle": "motorcycle",
    "protruding_object": "other", "stroller": "other",
}
DETECTION_TYPES = {
    "vehicle::car": "vehicle", "vehicle::truck": "large_vehicle", "vehicle::bus": "large_vehicle", "vehicle::trailer": "large_vehicle",
    "vehicle::construction_vehicle": "large_vehicle", "pedestrian::pedestrian": "pedestrian", "twowheeler::bicycle": "bicycle_micromobility",
    "twowheeler::twowheeler": "bicycle_micromobility", "twowheeler::motorcycle": "motorcycle", "object::traffic_cone": "other", "object::bollard": "other",
}
LEFT_ACTIONS = ["ego_turn_left", "ego_unprotected_left", "ego_u_turn"]
#: What search_tags reads of a record's components.
COMPONENTS = "array<struct<ref:struct<object_type:string,relation:string,vru_state:string>,tags:array<string>,source:string>>"
# fixed values: how a hint words the kinds of ego events
ARC_WORDS = {
    "stop": "stop", "decelerate": "decelerate", "accelerate": "accelerate", "turn_left": "turn left", "turn_right": "turn right", "evade": "evasive maneuver"
}
LONGITUDINAL = ["decelerate", "accelerate", "stop"]
LATERAL = ["turn_left", "turn_right", "lane_change_left", "lane_change_right"]


def object_type(cls: Column, table: dict[str, str]) -> Column:
    return lookup(cls, table, F.lit("other"))


def dominant_action(kinds: Column) -> Column:
    """stop, evade, turn_left, turn_right in this order, else lane keeping."""
    has = lambda k: F.array_contains(kinds, k)
    return F.when(has("stop"), "ego_stop").when(has("evade"), "ego_evade").when(has("turn_left"), "ego_turn_left").when(has("turn_right"), "ego_turn_right").otherwise("ego_lane_keep")


def anchor_action(kind: Column) -> Column:
    return lookup(kind, {"stop": "ego_stop", "turn_left": "ego_turn_left", "turn_right": "ego_turn_right", "evade": "ego_evade"}, F.lit("ego_lane_keep"))


def axes(kinds: Column) -> Column:
    """First and last longitudinal kind, first lateral kind (unresolved)."""
    of = lambda names: F.filter(kinds, lambda k: k.isin(*names))
    lon, lat = of(LONGITUDINAL), of(LATERAL)
    return F.struct(
        F.get(lon, F.lit(0)).alias("lon_transition"),
        F.get(lon, F.size(lon) - 1).alias("lon_state"),
        F.get(lat, F.lit(0)).alias("lat_transition"),
        F.lit(False).alias("lat_resolved"),
    )


def auto_tags(kinds: Column) -> Column:
    """Turns and stops among the kinds, in this fixed order."""
    return F.filter(F.array(*(F.lit(k) for k in ("u_turn", "turn_left", "turn_right", "stop"))), lambda k: F.array_contains(kinds, k))


def grounded_action(model: Column, arc: Column) -> Column:
    """The model's action kept only where the measured turns allow it."""
    left, right, stop = (F.array_contains(arc, k) for k in ("turn_left", "turn_right", "stop"))
    turns = model.isin(*LEFT_ACTIONS)
    return (
        F.when(left & ~right, F.when(turns, model).otherwise("ego_turn_left"))
        .when(right & ~left, F.lit("ego_turn_right"))
        .when(left & right, F.when(turns | (model == "ego_turn_right"), model).otherwise("ego_turn_left"))
        .when(turns | (model == "ego_turn_right"), F.when(stop, "ego_stop").otherwise("ego_lane_keep"))
        .otherwise(model)
    )


def role_of(relation: Column, longitudinal: Column, table: dict[str, str]) -> Column:
    """The relation decides before the longitudinal action; what the table lacks decides nothing."""
    none = F.lit(None).cast("string")
    return F.coalesce(lookup(relation, table, none), lookup(longitudinal, table, none))


def assembled(r: dict[str, Column], moves: dict[str, dict[str, str]], lon_codes: list[str], rel_codes: list[str], roles: dict[str, str]) -> dict[str, Column]:
    """A record's fields after all rules, in their order.

    moves: value to {field: new value}, looked up once for each of object_type, longitudinal_action and relation in turn; what
    moves to another field empties the first. Of an action and a relation one stays: the action only if it alone is legal.
    The descriptive fields and the role stand for agents alone; a signal's state is never kept.
    """
    none = F.lit(None).cast("string")
    out = dict(r)
    targets = sorted({f for to in moves.values() for f in to})
    kind = "struct<" + ",".join(f"{f}:string" for f in targets) + ">"
    table = F.create_map(*(x for value, to in moves.items() for x in (F.lit(value), F.struct(*(F.lit(to.get(f)).alias(f) for f in targets)).cast(kind)))) if moves else None
    for field in ("object_type", "longitudinal_action", "relation") if moves else ():
        seen = out[field]
        to = F.element_at(table, seen)
        for other in targets:
            if other != field:
                out[other] = F.coalesce(to[other], out[other])
        out[field] = F.when(to.isNull(), seen).otherwise(to[field] if field in targets else none)
    lon, rel = out["longitudinal_action"], out["relation"]
    both = lon.isNotNull() & rel.isNotNull()
    keep_lon = lon.isin(*lon_codes) & ~rel.isin(*rel_codes)
    out["longitudinal_action"] = F.when(both & ~keep_lon, none).otherwise(lon)
    out["relation"] = F.when(both & keep_lon, none).otherwise(rel)
    agent = F.coalesce(out["cause"] == "agent", F.lit(False))
    for field in ("object_type", "vru_attr", "occlusion", "longitudinal_action", "relation", "vru_state"):
        out[field] = F.when(agent, out[field])
    out["signal_state"] = none
    out["role"] = F.when(agent, role_of(out["relation"], out["longitudinal_action"], roles))
    return out


def warnings(enums: dict[str, list[str]], required: list[str] = (), exclusive: list[tuple[str, str]] = (), lengths: dict[str, tuple[int, int]] | None = None) -> Column:
    """What breaks the schema, as an array of texts: a violation warns, it drops nothing."""
    checks = [F.when(F.col(f).isNotNull() & ~F.col(f).isin(*codes), F.concat(F.lit(f"{f}: unknown "), F.col(f))) for f, codes in enums.items()]
    checks += [F.when(F.col(f).isNull(), F.lit(f"{f}: missing")) for f in required]
    checks += [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.lit(f"{a} and {b}: both set")) for a, b in exclusive]
    sized = [(f, F.length(f), lo, hi) for f, (lo, hi) in (lengths or {}).items()]
    checks += [F.when(~n.between(lo, hi), F.concat(F.lit(f"{f}: length "), n.cast("string"))) for f, n, lo, hi in sized]
    return F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")


def search_tags(action: Column, arc: Column, cause: Column, components: Column) -> Column:
    """Flat sorted tags. components: array<struct<ref: struct<object_type, relation, vru_state>, tags: array<string>, source>>.

    One relation only, the first measured one before the first that the model names. A missing action or cause reads None.
    """
    parts = F.coalesce(components, F.array().cast(COMPONENTS))
    after = lambda p: F.flatten(F.transform(parts, lambda c: F.transform(F.filter(F.coalesce(c["tags"], F.array().cast("array<string>")), lambda t: t.startswith(p)), lambda t: F.substr(t, F.lit(len(p) + 1)))))
    refs = lambda f: F.array_compact(F.transform(parts, lambda c: F.nullif(c["ref"][f], F.lit(""))))
    named = lambda p, xs: F.transform(xs, lambda x: F.concat(F.lit(p), x))
    relation = F.coalesce(F.get(refs("relation"), F.lit(0)), F.get(after("relation:"), F.lit(0)))
    injected = F.exists(parts, lambda c: F.coalesce(c["source"] == "gt_injected", F.lit(False)))
    every = F.concat(
        F.array(F.concat(F.lit("ego_action:"), F.coalesce(action, F.lit("None"))), F.concat(F.lit("cause:"), F.coalesce(cause, F.lit("None")))),
        named("arc:", F.coalesce(arc, F.array().cast("array<string>"))),
        named("object_type:", F.concat(refs("object_type"), after("object_type:"))),
        named("vru:", refs("vru_state")),
        F.array_compact(F.array(F.concat(F.lit("relation:"), relation), F.when(injected, F.lit("flag:model_missed_gt")))),
    )
    return F.array_sort(F.array_distinct(every))


def hint(kinds: Column, agents: Column) -> Column:
    """What is known of an episode, in words: its arc, then its agents (array<struct<object_type, role, relation, min_dist>>), numbered."""
    arc = F.array_join(F.transform(kinds, lambda k: lookup(k, ARC_WORDS, k)), " → ")
    word = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    line = lambda a, i: F.concat((i + 1).cast("string"), F.lit(") "), word(a["object_type"]), F.lit(" ("), word(a["role"]), F.lit(", "), F.coalesce(a["relation"], F.lit("")), F.lit(" "), word(a["min_dist"]), F.lit("m ahead)"))
    listed = F.concat(F.lit(" GT-detected in-path objects (you MUST address each; do not omit): "), F.array_join(F.transform(agents, line), "; "), F.lit("."))
    return F.concat(F.lit("GT: ego maneuver arc = ["), arc, F.lit("]."), F.when(F.coalesce(F.size(agents), F.lit(0)) > 0, listed).otherwise(" No GT in-path objects."))


def environment(lighting: Column, weather: Column, surface: Column, flags: dict[str, Column]) -> Column:
    """Static environment categories; unknown values give none."""
    none = F.lit(None).cast("string")
    light = lookup(lighting, {"day": "day", "twilight": "twilight", "night": "night"}, none)
    sky = lookup(weather, {"clear": "clear_weather", "rain": "rain", "snow": "snow", "fog": "fog"}, none)
    road = lookup(surface, {"dry": "dry_road", "wet": "wet_road"}, none)
    return F.array_sort(F.array_compact(F.array(light, sky, road, *(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in flags.items()))))


def cleaned(subject: Column, role: Column, f: dict[str, Column], ego_codes: list[str], synonyms: dict[str, str]) -> dict[str, Column]:
    """Fields that a subject or role may not have become null; unknown object types are mapped by synonym. Another subject's, or a missing one's, stay."""
    is_ = lambda c, *values: F.coalesce(c.isin(*values), F.lit(False))
    ego, agent = is_(subject, "ego"), is_(subject, "agent")
    kind = F.when(agent, lookup(f["object_type"], synonyms)).when(~ego, f["object_type"])
    return {
        "ego_action": F.when(ego, F.when(f["ego_action"].isin(*ego_codes), f["ego_action"]).otherwise("ego_lane_keep")).when(~agent, f["ego_action"]),
        "object_type": kind,
        "role": F.when(~ego, role),
        "longitudinal_action": F.when(~ego & ~(agent & is_(role, "adjust", "crossing")), f["longitudinal_action"]),
        "relation": F.when(~ego & ~(agent & is_(role, "preceding_vehicle")), f["relation"]),
        "vru_detail": F.when(~ego & ~(agent & ~is_(kind, "pedestrian")), f["vru_detail"]),
    }


def difficulty(height: Column, occluded: Column, truncated: Column) -> Column:
    """0 easy, 1 moderate, 2 hard, -1 none."""
    fine = lambda h, o, t: (height > h) & (occluded <= o) & (truncated <= t)
    return F.when(fine(40, 0, 0.15), 0).when(fine(25, 1, 0.3), 1).when(fine(25, 2, 0.5), 2).otherwise(-1)


def legal_or_default(cls: Column, value: Column, legal: dict[str, list[str]], default: dict[str, str]) -> Column:
    """The value where the class allows it, else the class's default."""
    ok = F.lit(False)
    for c, vs in legal.items():
        ok = ok | ((cls == c) & value.isin(*vs))
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(lookup(cls, default, F.lit(None).cast("string")))


def placement(field: Column, table: dict[str, str]) -> Column:
    return lookup(field, table, F.lit("gt_before"))


def depth_method(has_mono: Column, has_lidar: Column, has_plane: Column) -> Column:
    """How a frame's depth is filled, by what there is."""
    return F.when(has_mono & has_lidar, "mono_lidar").when(has_mono, "mono_only").when(has_plane, "ransac").otherwise("none")


def grounded_components(components: Column, objects: Column) -> Column:
    """Struct of components and consistency: what a model named, held against measured objects.

    components, objects: array<struct<object_type: string, relation: string>>. The first component of an object's type
    takes the (last) object's type and relation and the source "gt"; other components keep neither and stay "model". Each
    object whose type no component has is added as "gt_injected". consistency: every object's type, and whether the model
    had it. Null arrays count as empty.
    """
    kind = "array<struct<object_type:string,relation:string>>"
    named, seen = (F.coalesce(a, F.array().cast(kind)) for a in (components, objects))
    types = F.transform(named, lambda c: c["object_type"])
    row = lambda source, o: F.struct(source.alias("source"), o["object_type"].alias("object_type"), o["relation"].alias("relation"))

    def own(c: Column, i: Column) -> Column:
        found = F.coalesce((F.array_position(types, c["object_type"]) == i + 1) & F.exists(seen, lambda o: o["object_type"] == c["object_type"]), F.lit(False))
        o = F.when(found, F.try_element_at(F.filter(seen, lambda o: o["object_type"] == c["object_type"]), F.lit(-1)))
        return row(F.when(found, "gt").otherwise("model"), o)

    lacks = lambda o: ~F.coalesce(F.array_contains(types, o["object_type"]), F.lit(False))
    added = F.transform(F.filter(seen, lacks), lambda o: row(F.lit("gt_injected"), o))
    consistency = F.transform(seen, lambda o: F.struct(o["object_type"].alias("object_type"), (~lacks(o)).alias("covered_by_model")))
    return F.struct(F.concat(F.transform(named, own), added).alias("components"), consistency.alias("consistency"))


# fixed values: what an experiment card must state, and its changed axis
CARD_NEEDS = {"가설": r"가설\s*[:：]", "대조 조건": r"대조\s*조건\s*[:：]", "사전 등록 시각": r"등록\s*시각\s*[:：]\s*\d"}
CARD_AXIS = r"변경\s*축\s*[:：]\s*(.+)"
CARD_AXIS_NAME = "변경 축"


def card_problems(text: Column, needs: dict[str, str] = CARD_NEEDS, axis: str = CARD_AXIS, axis_name: str = CARD_AXIS_NAME) -> Column:
    """What keeps an experiment's card from being valid, in order: no card (null), missing statements, no or several axes."""
    axes_named = F.regexp_extract_all(text, F.lit(axis), F.lit(1))
    several = F.exists(axes_named, lambda a: a.rlike("[,·+]"))
    found = [F.when(~text.rlike(p), F.lit(f"missing: {k}")) for k, p in needs.items()]
    found.append(F.when(F.size(axes_named) == 0, F.lit(f"missing: {axis_name}")).when(several, F.lit(f"several: {axis_name}")))
    return F.when(text.isNull(), F.array(F.lit("no card"))).otherwise(F.array_compact(F.array(*found)))
