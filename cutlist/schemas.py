"""Row types of the tables the jobs read and write.

A brief, a taxonomy and a probe record are one document each, so they are one row each with nested
fields; everything that grows with the footage is flat.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

TEXT, INT, LONG, FLAG = StringType(), IntegerType(), LongType(), BooleanType()
TEXTS = ArrayType(TEXT)


def row(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


def rows(**fields: DataType) -> ArrayType:
    return ArrayType(row(**fields))


RULES = rows(pattern=TEXT, replacement=TEXT)

BRIEF = row(
    project_id=LONG,
    version=TEXT,
    project=row(description=TEXT, default_timezone=TEXT),
    people=rows(id=TEXT, name=TEXT, aliases=TEXTS, role=TEXT, importance=TEXT),
    places=rows(id=TEXT, name=TEXT, kind=TEXT, timezone=TEXT, aliases=TEXTS, description=TEXT),
    editorial_brief=row(
        summary=TEXT,
        tone=TEXT,
        must_include=TEXTS,
        avoid=TEXTS,
        story_goals=TEXTS,
        target_runtime=TEXT,
        meal_guidance=TEXT,
        pacing_guidance=TEXT,
        opener_guidance=TEXT,
        closer_guidance=TEXT,
        text=TEXT,
    ),
    time_anchors=rows(starts_at=TEXT, ends_at=TEXT, timezone=TEXT, location_id=TEXT, story_anchor_id=TEXT, label=TEXT),
    story_anchors=rows(id=TEXT, label=TEXT, keywords=TEXTS),
    transcription=row(prompt_terms=TEXTS, replacement_rules=RULES),
    render=row(preview_presets=TEXTS, selected_preset=TEXT, final_render_mode=TEXT, final_feedback=TEXTS),
)

TAXONOMY = row(
    project_id=LONG,
    context=TEXT,
    prompt_terms=TEXTS,
    terms=rows(canonical=TEXT, category=TEXT, aliases=TEXTS),
    replacement_rules=RULES,
)

PROBE_DOCUMENT = row(
    streams=rows(
        codec_type=TEXT,
        width=INT,
        height=INT,
        avg_frame_rate=TEXT,
        r_frame_rate=TEXT,
        duration=TEXT,
        tags=row(rotate=TEXT),
        side_data_list=rows(rotation=INT),
    ),
    format=row(duration=TEXT, size=TEXT, tags=row(creation_time=TEXT)),
)

CLIP_RESULT = row(
    project_id=LONG,
    clip_path=TEXT,
    filename=TEXT,
    provider=TEXT,
    transcription_model=TEXT,
    speech_locale=TEXT,
    taxonomy_signature=TEXT,
    transcript_status=TEXT,
    transcript=rows(start=TEXT, end=TEXT, text=TEXT),
    updated_at=TEXT,
)

CLIP_COLUMNS = (
    "project_id", "clip_path", "filename", "start_utc", "start_local", "timezone_name", "duration_ms", "width",
    "height", "fps", "has_audio", "size_bytes", "bitrate_mbps", "date_key", "location_id", "route_phase",
    "route_label", "is_vertical",
)

SELECTION = row(
    project_id=LONG,
    travel_day=LONG,
    date_key=TEXT,
    day_label=TEXT,
    candidate_id=TEXT,
    clip_path=TEXT,
    start_ms=LONG,
    end_ms=LONG,
    sequence_index=LONG,
    enabled=FLAG,
    role=TEXT,
    reason=TEXT,
)

TIMELINE_ITEM = row(
    project_id=LONG,
    pos=LONG,
    kind=TEXT,
    travel_day=LONG,
    label=TEXT,
    clip_path=TEXT,
    candidate_id=TEXT,
    start_ms=LONG,
    end_ms=LONG,
    duration_ms=LONG,
    cursor_ms=LONG,
    has_audio=FLAG,
    role=TEXT,
    filename=TEXT,
    source_local=TimestampNTZType(),
    location_id=TEXT,
    route_phase=TEXT,
    route_label=TEXT,
    reason=TEXT,
)
