"""Thresholds of the planning jobs, in whole milliseconds unless named otherwise."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CutParams:
    cue_floor_ms: int = 200
    group_gap_ms: int = 2400
    group_span_ms: int = 18000
    group_min_ms: int = 2000
    pre_roll_ms: int = 350
    post_roll_ms: int = 850
    excerpt_chars: int = 500
    summary_chars: int = 140
    reason_chars: int = 80
    reason_people: int = 3
    intro_ms: int = 3600
    outro_ms: int = 2800
    title_ms: int = 2600
    overshoot_pct: int = 118
    min_target_s: int = 360
    min_content_s: int = 60
    default_minutes: int = 40
    frame_points: tuple[int, ...] = (18, 50, 82)


DEFAULTS = CutParams()
