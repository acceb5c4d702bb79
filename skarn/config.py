"""Thresholds of the domain rules, as one parameter object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # fixed values: ego events
    decel_ax: float = -1.0
    accel_ax: float = 1.0
    stop_speed: float = 1.5
    turn_yaw_rate: float = 0.15
    turn_heading_deg: float = 45.0
    lane_change_heading_max_deg: float = 22.0
    lane_change_lateral_min: float = 1.8
    lane_change_lateral_max: float = 6.0
    min_event_sec: float = 0.4
    merge_gap_sec: float = 0.6
    episode_gap_sec: float = 2.0
    baseline_min_sec: float = 1.5
    segment_gap_sec: float = 1.5
    lead_in_sec: float = 3.0
    lead_out_sec: float = 1.0
    window_sec: float = 6.0
    window_stride_sec: float = 5.0
    # fixed values: agents in the corridor
    corridor_half: float = 2.5
    corridor_ahead: float = 45.0
    corridor_min_sec: float = 1.0
    corridor_min_points: int = 3
    cut_in_from: float = 2.8
    cut_in_to: float = 1.5
    # fixed values: taxonomy
    min_track_points: int = 4
    near_ahead: float = 25.0
    near_half: float = 5.5
    same_direction: float = 0.7
    oncoming: float = 2.4
    adjacent: float = 2.5
    entered: float = 1.2
    attempted: float = 2.2
    rotation_gate_deg: float = 25.0
    sustain: int = 3
    headway_sec: float = 0.6
    follow_min_speed: float = 8.0
    lead_decel: float = 1.5
    yield_speed: float = 1.0
    moving_speed: float = 2.0
    creep_low: float = 1.0
    creep_high: float = 3.0
    creep_min_sec: float = 3.0
    # fixed values: causes, gate, lanes, selection
    cause_after_onset: float = 1.0
    cause_before_onset: float = 1.5
    cause_crossing_m: float = 15.0
    cause_preceding_m: float = 30.0
    gate_proximity_m: float = 45.0
    lane_width_min: float = 2.5
    lane_width_max: float = 4.5
    lane_valid_share: float = 0.5
    lane_ref_ahead: float = 8.0
    lane_reach: float = 6.0
    tangent_near: float = 5.0
    tangent_far: float = 30.0
    cut_in_ahead: float = 45.0
    crossed_margin: float = 0.4
    path_half: float = 1.6
    straight_deg: float = 8.0
    corridor_cut_ahead: float = 40.0
    corridor_adjacent: float = 3.0
    corridor_entered: float = 1.5
    corridor_approach: float = 1.5
    offset_ahead: float = 35.0
    reactivity_floor: float = 1.0
    windows_per_clip: int = 3
    window_bonus: float = 0.15


DEFAULT = Thresholds()
