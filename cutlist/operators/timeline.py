"""Timelines, chapters, chunks and edit lists from validated selections.

Days are aggregated first, so windows per project see one row per day; windows over segments run in
buckets of the segment's position. No film is ever held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutlist.functions.text import clock, filled, padded, slug, span_text, title_parts
from cutlist.lexicon import WORDING, Wording
from cutlist.operators.ordered import staged, with_running
from cutlist.params import DEFAULTS, CutParams
from cutlist.schemas import TIMELINE_ITEM

# Fixed values.
INTRO_CHAPTER = "Intro"
OUTRO_CHAPTER = "Outro"
DEFAULT_CHUNK = "Timeline"
PRELUDE = "Prelude"
COLD_OPEN = "Cold Open"


def missing_clips(selections: DataFrame, clips: DataFrame) -> DataFrame:
    """Selections whose clip is not in the catalog."""
    return selections.join(clips.select("project_id", "clip_path"), ["project_id", "clip_path"], "left_anti")


def plan_faults(selections: DataFrame, violations: DataFrame, clips: DataFrame, titles: DataFrame) -> DataFrame:
    """Everything that keeps a project from having a film, one row per fault.

    Beside the violations of the selection these are selections without their clip (J9) and projects without a
    title row (T1).
    """
    report = ["project_id", "travel_day", "candidate_id", "rule", "detail"]
    lost = missing_clips(selections, clips).select(
        "project_id", "travel_day", "candidate_id", F.lit("J9").alias("rule"), F.col("clip_path").alias("detail")
    )
    untitled = selections.select("project_id").distinct().join(titles.select("project_id"), "project_id", "left_anti")
    untitled = untitled.select(
        "project_id", F.lit(0).cast("bigint").alias("travel_day"), F.lit("").alias("candidate_id"),
        F.lit("T1").alias("rule"), F.lit("").alias("detail"),
    )
    return violations.select(*report).unionByName(lost).unionByName(untitled)


def sound_selections(selections: DataFrame, faults: DataFrame) -> DataFrame:
    """Selections of the projects without any fault: a film is complete or is not made."""
    return selections.join(faults.select("project_id").distinct(), "project_id", "left_anti")


#: What a clip says about its place and story; catalogs without these leave them empty.
_PLACE = ("location_id", "route_phase", "route_label")


def _placed(selections: DataFrame, clips: DataFrame, params: CutParams) -> tuple[DataFrame, DataFrame]:
    """Segments with their place in the day, and days with their place in the film."""
    places = [F.col(c) if c in clips.columns else F.lit("").alias(c) for c in _PLACE]
    facts = clips.select("project_id", "clip_path", "filename", "start_local", "has_audio", *places)
    rows = selections.join(facts, ["project_id", "clip_path"]).withColumn(
        "duration_ms", F.greatest(F.lit(0).cast("bigint"), F.col("end_ms") - F.col("start_ms"))
    )
    key = ["project_id", "travel_day"]
    # Segments, day cards and both ends of the film are built from these rows, so they are computed once.
    rows = staged(
        with_running(
            rows, key, "sequence_index", sums={"place": F.lit(1).cast("bigint"), "upto_ms": F.col("duration_ms")}
        )
    )
    earlier = Window.partitionBy("project_id").orderBy("travel_day").rowsBetween(Window.unboundedPreceding, -1)
    days = (
        rows.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("duration_ms").alias("total_ms"),
            F.min_by(F.col("day_label"), F.col("sequence_index")).alias("day_label"),
            F.min(F.to_date("start_local")).alias("first_date"),
            F.max(F.to_date("start_local")).alias("last_date"),
        )
        .withColumn("day_pos", 2 + F.coalesce(F.sum(F.col("n") + 1).over(earlier), F.lit(0)))
        .withColumn(
            "day_ms",
            F.lit(params.intro_ms) + F.coalesce(F.sum(F.col("total_ms") + params.title_ms).over(earlier), F.lit(0)),
        )
        .withColumn(
            "day_label",
            F.coalesce(filled(F.col("day_label")), F.concat(F.lit("Day "), F.col("travel_day").cast("string"))),
        )
    )
    return rows, days


def build_timeline(
    selections: DataFrame,
    clips: DataFrame,
    titles: DataFrame,
    params: CutParams = DEFAULTS,
    wording: Wording = WORDING,
) -> DataFrame:
    """Intro, a card per day, the segments and the outro, with position and cursor.

    ``titles`` has ``project_id``, ``title`` and optionally ``date_span``, which otherwise comes from the
    selected clips.
    """
    rows, days = _placed(selections, clips, params)
    key = ["project_id", "travel_day"]
    zero = F.lit(0).cast("bigint")
    none = F.lit("")
    segments = rows.join(days.select(*key, "day_pos", "day_ms"), key).select(
        "project_id",
        (F.col("day_pos") + F.col("place")).alias("pos"),
        F.lit("segment").alias("kind"),
        "travel_day",
        F.concat_ws(" · ", "role", "filename").alias("label"),
        "clip_path",
        "candidate_id",
        "start_ms",
        "end_ms",
        "duration_ms",
        (F.col("day_ms") + params.title_ms + F.col("upto_ms") - F.col("duration_ms")).alias("cursor_ms"),
        "has_audio",
        "role",
        "filename",
        F.col("start_local").alias("source_local"),
        *_PLACE,
        "reason",
    )
    span = F.coalesce(filled(F.col("date_span")), span_text(F.col("first_date"), F.col("last_date")))
    films = (
        days.groupBy("project_id")
        .agg(
            F.sum(F.col("n") + 1).alias("inner_items"),
            F.sum(F.col("total_ms") + params.title_ms).alias("inner_ms"),
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
        )
        .join(titles if "date_span" in titles.columns else titles.withColumn("date_span", F.lit("")), "project_id")
        .withColumn("span", span)
    )

    def card(source: DataFrame, pos, day, label, length: int, cursor) -> DataFrame:
        return source.select(
            "project_id",
            pos.cast("bigint").alias("pos"),
            F.lit("title").alias("kind"),
            day.cast("bigint").alias("travel_day"),
            label.alias("label"),
            none.alias("clip_path"),
            none.alias("candidate_id"),
            zero.alias("start_ms"),
            F.lit(length).cast("bigint").alias("end_ms"),
            F.lit(length).cast("bigint").alias("duration_ms"),
            cursor.cast("bigint").alias("cursor_ms"),
            F.lit(False).alias("has_audio"),
            none.alias("role"),
            none.alias("filename"),
            F.lit(None).cast("timestamp_ntz").alias("source_local"),
            *[none.alias(c) for c in (*_PLACE, "reason")],
        )

    opening = card(films, F.lit(1), F.lit(0), F.concat_ws(" · ", "title", "span"), params.intro_ms, F.lit(0))
    per_day = card(days, F.col("day_pos"), F.col("travel_day"), F.col("day_label"), params.title_ms, F.col("day_ms"))
    left, right = wording.outro.split("{title}")
    closing = card(
        films,
        F.col("inner_items") + 2,
        F.lit(0),
        F.concat(F.lit(left), F.col("title"), F.lit(right)),
        params.outro_ms,
        F.lit(params.intro_ms) + F.col("inner_ms"),
    )
    items = opening.unionByName(per_day).unionByName(segments).unionByName(closing)
    return items.select(*TIMELINE_ITEM.fieldNames())


def timeline_summary(items: DataFrame) -> DataFrame:
    """Length, item and segment counts per project."""
    return items.groupBy("project_id").agg(
        F.sum("duration_ms").alias("target_ms"),
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("kind") == "segment").alias("n_segments"),
    )


def chapters(items: DataFrame) -> DataFrame:
    """A chapter per title card, named Intro and Outro at the ends."""
    ends = items.groupBy("project_id").agg(F.max("pos").alias("_last"))
    label = (
        F.when(F.col("pos") == 1, F.lit(INTRO_CHAPTER))
        .when(F.col("pos") == F.col("_last"), F.lit(OUTRO_CHAPTER))
        .otherwise(F.col("label"))
    )
    return (
        items.filter("kind = 'title'")
        .join(ends, "project_id")
        .select("project_id", "pos", clock(F.col("cursor_ms")).alias("timecode"), label.alias("label"))
    )


def item_length():
    """An item's own duration, else end minus start, never below 0."""
    return F.coalesce(
        F.col("duration_ms"),
        F.greatest(
            F.lit(0).cast("bigint"),
            F.coalesce("end_ms", "start_ms", F.lit(0)) - F.coalesce("start_ms", F.lit(0)),
        ),
    )


def number_chunks(items: DataFrame) -> DataFrame:
    """Count the title cards up to each item; 0 is what comes before the first."""
    title = F.when(F.col("kind") == "title", F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return with_running(items, ["project_id"], "pos", sums={"chunk_no": title})


def chunk_timeline(items: DataFrame, titles: DataFrame) -> DataFrame:
    """Chunks cut at title cards, with label, slug and length."""
    chunks = (
        number_chunks(items)
        .groupBy("project_id", "chunk_no")
        .agg(
            F.min("pos").alias("first_pos"),
            F.count(F.lit(1)).alias("n_items"),
            F.sum(item_length()).alias("target_ms"),
            F.min_by(F.coalesce("label", F.lit("")), "pos").alias("_label"),
        )
    )
    whole = chunks.groupBy("project_id").agg(F.min("chunk_no").alias("_low"), F.max("chunk_no").alias("_high"))
    number = F.col("chunk_no").cast("string")
    no_titles, prelude = F.col("_high") == 0, F.col("chunk_no") == 0
    label = (
        F.when(no_titles, filled(F.col("title"), DEFAULT_CHUNK))
        .when(prelude, F.when(filled(F.col("_label")).startswith(COLD_OPEN), F.lit(COLD_OPEN)).otherwise(F.lit(PRELUDE)))
        .otherwise(filled(F.col("_label"), F.concat(F.lit("Chapter "), number)))
    )
    spare = (
        F.when(no_titles, F.lit("timeline")).when(prelude, F.lit("prelude")).otherwise(F.concat(F.lit("chapter-"), number))
    )
    return (
        chunks.join(whole, "project_id")
        .join(titles.select("project_id", "title"), "project_id", "left")
        .withColumn("label", label)
        .withColumn("_parts", title_parts(F.col("label")))
        .select(
            "project_id",
            (F.col("chunk_no") - F.col("_low") + 1).alias("chunk_index"),
            "chunk_no",
            "label",
            slug(F.col("label"), spare).alias("slug"),
            F.concat_ws(" · ", "title", "label").alias("chunk_title"),
            F.col("_parts.title").alias("card_title"),
            F.col("_parts.subtitle").alias("card_subtitle"),
            "first_pos",
            "n_items",
            "target_ms",
        )
    )


def edit_list(items: DataFrame) -> DataFrame:
    """Input numbers, fades and audio source of each item."""
    source = F.when(
        F.col("kind") == "title", F.concat(F.lit("title_"), padded(F.col("pos") - 1, 3))
    ).otherwise(F.col("clip_path"))
    rows = items.withColumn("duration_ms", item_length()).withColumn("input", source)
    first = rows.groupBy("project_id", "input").agg(F.min("pos").alias("_first"))
    inputs = with_running(first, ["project_id"], "_first", sums={"_n": F.lit(1).cast("bigint")})
    spoken = (F.col("kind") != "title") & F.coalesce("has_audio", F.lit(False))
    live = rows.groupBy("project_id").agg(F.bool_or(spoken).alias("has_live_audio"))
    fade = lambda top, per_mille: F.least(
        F.lit(top), F.greatest(F.lit(100), F.floor((F.col("duration_ms") * per_mille + 500) / 1000))
    ).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return (
        rows.join(inputs.select("project_id", "input", (F.col("_n") - 1).alias("input_index")), ["project_id", "input"])
        .join(live, "project_id")
        .withColumn("video_fade_ms", fade(240, 75))
        .withColumn("audio_fade_ms", F.when(spoken, fade(200, 90)).otherwise(zero))
        .select(
            "project_id",
            "pos",
            "input",
            "input_index",
            "start_ms",
            "end_ms",
            "duration_ms",
            "video_fade_ms",
            F.greatest(zero, F.col("duration_ms") - F.col("video_fade_ms")).alias("video_fade_out_ms"),
            F.when(F.col("kind") == "title", F.lit("title"))
            .when(spoken, F.lit("clip"))
            .otherwise(F.lit("silence"))
            .alias("audio"),
            "audio_fade_ms",
            F.when(spoken, F.greatest(zero, F.col("duration_ms") - F.col("audio_fade_ms")))
            .otherwise(zero)
            .alias("audio_fade_out_ms"),
            "has_live_audio",
        )
    )
