"""From timed cues to candidate segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlist.functions.text import padded, result_key, segment_digest, strip
from cutlist.operators.ordered import staged, with_order, with_running
from cutlist.operators.sessions import CLIP, sessionize
from cutlist.params import DEFAULTS, CutParams

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def milliseconds(seconds: Column) -> Column:
    """Whole milliseconds of seconds held as number or text; null for what is no number or fits no long."""
    text = seconds.cast("string")
    value = F.when(text.rlike(_NUMBER), F.btrim(text).try_cast("double"))
    return F.round(value * 1000).try_cast("bigint")


def explode_transcripts(results: DataFrame) -> DataFrame:
    """One raw cue per row from stored results.

    A cue without a start begins at 0 and one without an end has no length, so it falls to the length floor.
    A start or end that is present but no number drops the cue; ``rejected_cues`` has these.
    """
    return _timed(results).filter("start_ms is not null and end_ms is not null")


def rejected_cues(results: DataFrame) -> DataFrame:
    """The cues that ``explode_transcripts`` leaves out, each with its start and end as given."""
    return (
        _timed(results, F.col("cue.start").alias("start"), F.col("cue.end").alias("end"))
        .filter("start_ms is null or end_ms is null")
        .drop("start_ms", "end_ms")
    )


def _timed(results: DataFrame, *more: Column) -> DataFrame:
    cue = F.col("cue")
    start = F.when(cue["start"].isNull(), F.lit(0)).otherwise(milliseconds(cue["start"]))
    return (
        results.select("project_id", "clip_path", F.posexplode("transcript").alias("cue_no", "cue"))
        .withColumn("start_ms", start.cast("bigint"))
        .select(
            "project_id",
            "clip_path",
            F.col("cue_no").cast("bigint").alias("cue_no"),
            "start_ms",
            F.when(cue["end"].isNull(), F.col("start_ms")).otherwise(milliseconds(cue["end"])).alias("end_ms"),
            cue["text"].alias("text"),
            *more,
        )
    )


def normalize_cues(cues: DataFrame, params: CutParams = DEFAULTS) -> DataFrame:
    """Stripped, non-empty cues of at least the floor length, never before 0.

    Deviations: lengths are compared in whole milliseconds, a null text is dropped rather than read as a
    word, and a cue that lies wholly before 0 is dropped rather than kept with its end before its start.
    """
    return (
        cues.withColumn("text", strip(F.col("text")))
        .filter(F.col("text") != "")
        .filter(F.col("end_ms") - F.col("start_ms") >= params.cue_floor_ms)
        .filter(F.col("end_ms") > 0)
        .withColumn("start_ms", F.greatest(F.col("start_ms"), F.lit(0).cast("bigint")))
    )


def _first_chars(pieces: Column, chars: int) -> Column:
    return F.substring(F.array_join(F.transform(F.array_sort(pieces), lambda x: x["text"]), " "), 1, chars)


def session_groups(cues: DataFrame, params: CutParams = DEFAULTS, slices: int | None = None) -> DataFrame:
    """One row per session of normalized cues, before short ones are folded (A2).

    The excerpt is the first ``excerpt_chars`` characters of the joined texts. Every text has a character
    and a blank follows it, so one cue more than half as many as characters always fills it.
    """
    chars = params.excerpt_chars
    piece = F.when(F.col("place") <= chars // 2, F.struct("cue_ordinal", "text"))
    # No more of a text can reach an excerpt, so no more of it is staged and passed on.
    cut = cues.withColumn("text", F.substring("text", 1, chars))
    return (
        sessionize(cut, params, slices)
        .groupBy(*CLIP, "session_no")
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max_by("end_ms", "cue_ordinal").alias("end_ms"),
            F.count(F.lit(1)).alias("n_cues"),
            F.collect_list(piece).alias("_pieces"),
        )
        .withColumn("excerpt", _first_chars(F.col("_pieces"), chars))
        .drop("_pieces")
    )


def merge_short(groups: DataFrame, params: CutParams = DEFAULTS) -> DataFrame:
    """Fold each session shorter than the minimum into the kept one before it; the first is always kept."""
    keep = (F.col("session_no") == 1) | (F.col("end_ms") - F.col("start_ms") >= params.group_min_ms)
    chars = params.excerpt_chars
    numbered = with_running(
        groups,
        CLIP,
        "session_no",
        sums={"group_index": keep.cast("bigint")},
        maxima={"_kept": F.when(keep, F.col("session_no"))},
    )
    piece = F.when(
        F.col("session_no") - F.col("_kept") <= chars // 2, F.struct("session_no", F.col("excerpt").alias("text"))
    )
    return (
        numbered.groupBy(*CLIP, "group_index")
        .agg(
            F.min_by("start_ms", "session_no").alias("start_ms"),
            F.max_by("end_ms", "session_no").alias("end_ms"),
            F.sum("n_cues").alias("n_cues"),
            F.collect_list(piece).alias("_pieces"),
        )
        .withColumn("excerpt", strip(_first_chars(F.col("_pieces"), chars)))
        .drop("_pieces")
    )


def cue_groups(cues: DataFrame, params: CutParams = DEFAULTS, slices: int | None = None) -> DataFrame:
    """Merged groups of raw cues: normalization, sessions, short-group folding.

    Folding reads the sessions twice; they are staged so that the cues are read in order only once.
    """
    return merge_short(staged(session_groups(normalize_cues(cues, params), params, slices)), params)


def segment_bounds(groups: DataFrame, clips: DataFrame, params: CutParams = DEFAULTS) -> DataFrame:
    """Pad each group, keep it inside its clip and stretch it to the minimum length.

    Groups without a clip are dropped. A clip shorter than the minimum, or a cue past the clip's end, still
    yields a short or even inverted segment; nothing is filtered here.
    """
    start = F.greatest(F.col("start_ms") - params.pre_roll_ms, F.lit(0).cast("bigint"))
    end = F.least(F.col("clip_ms"), F.col("end_ms") + params.post_roll_ms)
    least_end = F.least(F.col("clip_ms"), F.col("seg_start") + params.group_min_ms)
    short = F.col("seg_end") - F.col("seg_start") < params.group_min_ms
    return (
        groups.join(clips.withColumnRenamed("duration_ms", "clip_ms"), list(CLIP), "inner")
        .withColumn("seg_start", start)
        .withColumn("seg_end", end)
        .withColumn("start_ms", F.col("seg_start"))
        .withColumn("end_ms", F.when(short, least_end).otherwise(F.col("seg_end")))
        .withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
        .drop("seg_start", "seg_end", "clip_ms")
    )


def candidate_ids(segments: DataFrame, slices: int | None = None) -> DataFrame:
    """Number the segments of a project in file order and derive their ids.

    Clips of equal file names go by the names of their stored results.
    Only one row per clip is ordered; a segment's number is its clip's offset plus its index in the clip.
    """
    per_clip = segments.groupBy(*CLIP, "filename").agg(F.count(F.lit(1)).alias("_n"))
    offsets = with_order(
        per_clip, ["project_id"], [F.col("filename"), result_key(F.col("clip_path")), F.col("clip_path")], "_clip_no", {"_upto": F.col("_n")}, slices
    ).select(*CLIP, (F.col("_upto") - F.col("_n")).alias("_before"))
    digest = segment_digest(F.col("clip_path"), F.col("start_ms"), F.col("end_ms"))
    return (
        segments.join(offsets, list(CLIP))
        .withColumn("ordinal", F.col("_before") + F.col("group_index"))
        .withColumn("digest", digest)
        .withColumn("candidate_id", F.concat_ws("-", F.lit("seg"), padded(F.col("ordinal"), 3), F.col("digest")))
        .drop("_before")
    )


def frame_plan(segments: DataFrame, params: CutParams = DEFAULTS) -> DataFrame:
    """Sample times of each segment, as whole milliseconds from the clip's start."""
    points = F.array(*[F.lit(x) for x in params.frame_points])
    length = F.col("duration_ms")
    at = F.greatest(F.lit(0).cast("bigint"), F.least(length, F.floor((length * F.col("point") + 50) / 100)))
    return segments.select("*", F.posexplode(points).alias("_pos", "point")).select(
        *segments.columns,
        (F.col("_pos") + 1).cast("bigint").alias("frame_no"),
        (F.greatest(F.lit(0).cast("bigint"), F.col("start_ms") + at)).alias("at_ms"),
    )
