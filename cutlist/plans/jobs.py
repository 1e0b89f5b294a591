"""The jobs a user calls. Tables that several steps read are staged on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlist.functions import prompts as P
from cutlist.functions.briefs import editorial_text
from cutlist.functions.text import filled
from cutlist.lexicon import DEFAULT_LEXICON, WORDING, Lexicon, Wording
from cutlist.operators.catalog import build_clips, date_spans, dominant_fps, travel_days
from cutlist.operators.cues import candidate_ids, cue_groups, explode_transcripts, segment_bounds
from cutlist.operators.ordered import staged
from cutlist.operators.scoring import score_candidates
from cutlist.operators.selection import select_segments
from cutlist.operators.timeline import (
    build_timeline,
    chapters,
    chunk_timeline,
    edit_list,
    plan_faults,
    sound_selections,
    timeline_summary,
)
from cutlist.operators.transcripts import (
    curate_results,
    merge_taxonomy,
    taxonomies_with_default,
    transcript_report,
)
from cutlist.operators.validate import raise_first, validate_selection
from cutlist.params import DEFAULTS, CutParams

_CLIP_FACTS = (
    "project_id", "clip_path", "filename", "duration_ms", "date_key", "location_id", "route_phase", "route_label",
    "has_audio", "start_utc",
)


def story_labels(clips: DataFrame, briefs: DataFrame) -> DataFrame:
    """Label of each clip's story anchor, else its route label; the last of equal ids counts."""
    anchors = briefs.select("project_id", F.col("story_anchors").alias("_stories"))
    found = F.filter("_stories", lambda s: filled(s["id"]) == filled(F.col("route_phase")))
    label = F.get(found, F.size(found) - 1)["label"]
    return (
        clips.join(anchors, "project_id", "left")
        .withColumn("story_anchor_label", F.coalesce(filled(label), F.col("route_label"), F.lit("")))
        .drop("_stories")
    )


def build_segments(
    clips: DataFrame, cues: DataFrame, briefs: DataFrame, params: CutParams = DEFAULTS, slices: int | None = None
) -> DataFrame:
    """Unscored candidates: grouped cues inside their clips, numbered per project."""
    facts = story_labels(clips.select(*_CLIP_FACTS), briefs)
    # Numbering, day ranking and scoring all read the segments, which are few next to the cues.
    segments = staged(segment_bounds(cue_groups(cues, params, slices), facts, params))
    return candidate_ids(segments.withColumnRenamed("start_utc", "source_utc"), slices)


def build_candidates(
    clips: DataFrame,
    cues: DataFrame,
    briefs: DataFrame,
    day_mode: str = "ranked",
    lexicon: Lexicon = DEFAULT_LEXICON,
    params: CutParams = DEFAULTS,
    wording: Wording = WORDING,
    slices: int | None = None,
) -> DataFrame:
    """Scored candidates.

    ``day_mode="ranked"`` numbers the days of a project by date before scoring. ``"as_given"`` takes the
    clips' own ``travel_day`` (0 where the catalog has none), so every clip scores as on day 1.
    """
    segments = build_segments(clips, cues, briefs, params, slices)
    if day_mode == "ranked":
        return score_candidates(segments, briefs, travel_days(segments), lexicon, params, wording)
    if day_mode != "as_given":
        raise ValueError(f"unknown day_mode: {day_mode}")
    given = F.coalesce(F.col("travel_day"), F.lit(0)) if "travel_day" in clips.columns else F.lit(0)
    days = clips.select("project_id", "clip_path", given.cast("bigint").alias("travel_day"))
    return score_candidates(segments.join(days, ["project_id", "clip_path"]), briefs, None, lexicon, params, wording)


def target_lengths(briefs: DataFrame, params: CutParams = DEFAULTS) -> DataFrame:
    """Wanted film length of each project in seconds."""
    editorial = editorial_text(F.col("editorial_brief"))
    return briefs.select(
        "project_id",
        P.target_seconds(F.col("editorial_brief.target_runtime"), editorial, params.default_minutes).alias("target_s"),
    )


def prompt_features(prompts: DataFrame, dates: DataFrame | None = None, params: CutParams = DEFAULTS) -> DataFrame:
    """Tone, pacing, runtime, dates and title of each prompt.

    ``prompts`` has ``project_id`` and ``prompt``, and optionally ``summary``, ``tone``, ``target_runtime``,
    ``pacing_guidance`` and ``description`` as set before. ``dates`` has the project's ``first_date`` and
    ``last_date`` (``date_spans``).
    """
    given = lambda c: F.col(c) if c in prompts.columns else F.lit("")
    rows = prompts
    if dates is None:
        rows = rows.withColumn("first_date", F.lit(None).cast("date")).withColumn("last_date", F.lit(None).cast("date"))
    else:
        rows = rows.join(dates.select("project_id", "first_date", "last_date"), "project_id", "left")
    prompt, before = F.col("_prompt"), F.col("_summary")
    # Whole texts are stripped and searched, so each result is a column before the next step reads it.
    found = rows.withColumns(
        {"_prompt": filled(F.col("prompt"), ""), "_summary": filled(given("summary"), "")}
    ).withColumns({"_hint": filled(given("target_runtime"), P.runtime_phrase(prompt)), "_text": P.summary(prompt, before)})
    return found.select(
        "project_id",
        F.col("_text").alias("summary"),
        F.coalesce(P.tone(prompt, given("tone")), F.lit("")).alias("tone"),
        F.coalesce(P.pacing(prompt, given("pacing_guidance")), F.lit("")).alias("pacing_guidance"),
        F.col("_hint").alias("target_runtime"),
        P.target_seconds(F.col("_hint"), F.col("_text"), params.default_minutes).alias("target_s"),
        P.prompt_date_span(P.prompt_dates(prompt, F.col("first_date"), F.col("last_date"))).alias("date_span"),
        P.video_title(prompt, before, given("description")).alias("title"),
    )


def prompted_briefs(briefs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Briefs with summary, tone, runtime and pacing filled from the project's prompt where unset."""
    mine = prompts.select("project_id", filled(F.col("prompt")).alias("_prompt"))
    brief = F.col("editorial_brief")
    prompt = F.col("_prompt")
    phrase = F.nullif(P.runtime_phrase(prompt), F.lit(""))
    changed = F.struct(
        *[brief[f.name].alias(f.name) if f.name not in _PROMPTED else value.alias(f.name)
          for f in briefs.schema["editorial_brief"].dataType.fields
          for value in [{
              "summary": P.summary(prompt, brief["summary"]),
              "tone": P.tone(prompt, brief["tone"]),
              "target_runtime": F.coalesce(filled(brief["target_runtime"]), phrase),
              "pacing_guidance": P.pacing(prompt, brief["pacing_guidance"]),
          }.get(f.name)]]
    )
    return (
        briefs.join(mine, "project_id", "left")
        .withColumn("editorial_brief", F.when(prompt.isNull(), brief).otherwise(changed))
        .select(*briefs.columns)
    )


_PROMPTED = ("summary", "tone", "target_runtime", "pacing_guidance")


def film_titles(briefs: DataFrame, prompts: DataFrame, clips: DataFrame) -> DataFrame:
    """Title and date span of each project's film."""
    rows = briefs.select(
        "project_id",
        F.col("editorial_brief.summary").alias("summary"),
        F.col("project.description").alias("description"),
    ).join(prompts.select("project_id", "prompt"), "project_id", "left")
    return prompt_features(rows, date_spans(clips)).select("project_id", "title", "date_span")


def plan(
    probes: DataFrame,
    results: DataFrame,
    briefs: DataFrame,
    prompts: DataFrame,
    taxonomies: DataFrame | None = None,
    day_start_hour: Column | int = 0,
    lexicon: Lexicon = DEFAULT_LEXICON,
    params: CutParams = DEFAULTS,
    wording: Wording = WORDING,
    fail_fast: bool = False,
    slices: int | None = None,
) -> dict[str, DataFrame]:
    """From probe records, stored transcripts, briefs and prompts to timelines, for all projects at once.

    Clips, corrected results, candidates, selections, faults and the timeline are staged, since several steps read
    them. ``faults`` has the violations of the selection, missing clips and missing titles; a project with any has no
    timeline. With ``fail_fast`` they raise instead. ``slices`` is the number of pieces that ordered scans cut their
    rows into: about the input's bytes over 64 MB, or the session's shuffle partitions by default.
    """
    briefs = prompted_briefs(briefs, prompts)
    clips = staged(build_clips(probes, briefs, day_start_hour))
    if taxonomies is not None:
        own = merge_taxonomy(taxonomies_with_default(briefs, taxonomies), briefs)
        results = staged(curate_results(results, own))
    candidates = staged(
        build_candidates(clips, explode_transcripts(results), briefs, "ranked", lexicon, params, wording, slices)
    )
    selections = staged(select_segments(candidates, target_lengths(briefs, params), params, lexicon, wording, slices))
    valid, violations = validate_selection(selections, candidates, briefs)
    titles = film_titles(briefs, prompts, clips)
    faults = staged(plan_faults(valid, violations, clips, titles))
    if fail_fast:
        raise_first(faults)
    items = staged(build_timeline(sound_selections(valid, faults), clips, titles, params, wording))
    return {
        "clips": clips,
        "fps": dominant_fps(clips, briefs),
        "transcript_report": transcript_report(results),
        "candidates": candidates,
        "selections": selections,
        "violations": violations,
        "faults": faults,
        "titles": titles,
        "timeline": items,
        "timeline_summary": timeline_summary(items),
        "chapters": chapters(items),
        "chunks": chunk_timeline(items, titles),
        "edit_list": edit_list(items),
    }
