"""Fields of a probe record as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutlist.functions.text import filled_field

# Fixed values.
DEFAULT_FPS = 30.0
EMPTY_PROJECT_FPS = 29.97
QUARTER_TURNS = (90, 270, -90, -270)


def frame_rate(text: Column) -> Column:
    """``a/b`` or a plain number; ``0/0`` and a zero denominator give 30."""
    parts = F.split(text, "/", 2)
    left, right = parts[0].try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return (
        F.when(F.coalesce(text, F.lit("")).isin("", "0/0"), F.lit(DEFAULT_FPS))
        .when(F.contains(text, F.lit("/")), F.when(right == 0, F.lit(DEFAULT_FPS)).otherwise(left / F.nullif(right, F.lit(0.0))))
        .otherwise(text.try_cast("double"))
    )


def has_stream(streams: Column, kind: str) -> Column:
    return F.coalesce(F.array_contains(streams["codec_type"], kind), F.lit(False))


def first_stream(streams: Column, kind: str) -> Column:
    """The first stream of a kind, or null; found by position, as filters of arrays are not compiled."""
    return F.get(streams, F.array_position(streams["codec_type"], kind).cast("int") - 1)


def rotation(video: Column) -> Column:
    """Rotation of the first side data that has one, else the tag, else 0."""
    sides = video["side_data_list"]
    side = F.when(F.size(sides) > 0, F.get(F.filter(sides, lambda d: d["rotation"].isNotNull()), F.lit(0))["rotation"])
    # A cast that fails is dear, and one without a digit always does.
    tag = F.when(F.rlike(video["tags"]["rotate"], F.lit("[0-9]")), video["tags"]["rotate"].try_cast("int"))
    return F.coalesce(side, tag, F.lit(0))


def display_size(width: Column, height: Column, turned: Column) -> Column:
    width, height = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    swap = turned.isin(*QUARTER_TURNS)
    return F.struct(
        F.when(swap, height).otherwise(width).alias("width"), F.when(swap, width).otherwise(height).alias("height")
    )


def duration_ms(container: Column, video: Column) -> Column:
    """Container length, else the video stream's, else 0 (P5)."""
    seconds = F.coalesce(filled_field(container), filled_field(video), F.lit("0")).try_cast("double")
    return F.round(seconds * 1000).cast("bigint")


def bitrate_kbps(size_bytes: Column, length_ms: Column) -> Column:
    """Bits per millisecond, rounded half up; a missing length counts as one millisecond."""
    length = F.greatest(length_ms, F.lit(1).cast("bigint"))
    return F.floor((size_bytes * 16 + length) / (length * 2))
