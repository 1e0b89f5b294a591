"""Sinks. Every table is written flat, one directory per project.

The documents of a project are not nested into one row: a project may hold most of all rows. Their
header fields are a table of their own and their entries are lines in document order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlist.operators.catalog import travel_days
from cutlist.operators.ordered import with_order
from cutlist.operators.transcripts import DEFAULT_PROVIDER, transcript_report
from cutlist.sources.sink import flat_lines, nested_lines, write_lines

MANIFEST_ORDER = ("start_utc", "filename")

SELECTION_ORDER = ("travel_day", "sequence_index")
TIMELINE_ORDER = ("pos",)


def write_table(df: DataFrame, path: str, order: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write ``df`` partitioned by project, in ``order`` within and across the files of a project.

    Range partitioning spreads a large project over many files. With ``spark.sql.sources.partitionOverwriteMode``
    set to dynamic only the projects present in ``df`` are replaced.
    """
    keys = ["project_id", *order]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).partitionBy("project_id").format(fmt).save(path)


def write_clip_manifest(clips: DataFrame, settings: DataFrame, path: str) -> None:
    """Clip rows, and a header per project with its clip count."""
    counts = clips.groupBy("project_id").agg(F.count(F.lit(1)).alias("clip_count"))
    header = settings.join(counts, "project_id", "left").withColumn("clip_count", F.coalesce("clip_count", F.lit(0)))
    write_table(clips, f"{path}/clips", MANIFEST_ORDER, "json")
    write_table(header, f"{path}/header", (), "json")


def write_transcripts(results: DataFrame, report: DataFrame, path: str) -> None:
    """Transcript of each clip (S10) and the report per project."""
    rows = results.select("project_id", "clip_path", "filename", "transcript")
    write_table(rows, f"{path}/clips", ("filename", "clip_path"), "json")
    write_table(report, f"{path}/report", (), "json")


TRANSCRIPT_HEADER = ("project", "speech_locale", "provider", "model")


def write_transcript_documents(results: DataFrame, settings: DataFrame, path: str, slices: int | None = None) -> None:
    """One document per project: project, locale, providers and model, then its clips in file order.

    ``settings`` has ``project_id``, ``project``, ``speech_locale``, ``model`` and ``taxonomy_signature`` of the run; the
    providers are those of the stored results.
    """
    header = settings.join(transcript_report(results).select("project_id", "provider"), "project_id", "left")
    header = header.withColumn("provider", F.coalesce("provider", F.lit(DEFAULT_PROVIDER)))
    fields = F.struct(*TRANSCRIPT_HEADER)
    clips = with_order(
        results.select("project_id", "clip_path", "filename", F.coalesce("transcript", F.array()).alias("transcript")),
        ["project_id"], [F.col("filename"), F.col("clip_path")], "_no", slices=slices,
    )
    entry = F.struct("clip_path", "filename", "transcript")
    write_lines(flat_lines(header, fields, clips, [F.col("_no"), F.lit(0)], entry, "clips"), path, slices)


def transcript_summary(results: DataFrame, settings: DataFrame) -> DataFrame:
    """The report of a run: counts and providers, with model, locale and taxonomy signature."""
    counts = transcript_report(results)
    run = settings.select("project_id", "model", "speech_locale", "taxonomy_signature")
    return counts.join(run, "project_id", "left").select(
        "project_id", "provider", "model", "speech_locale", "taxonomy_signature", "clip_count", "transcribed_clip_count",
        "empty_transcript_count",
    )


def write_selection_documents(selections: DataFrame, titles: DataFrame, path: str, mode: str = "auto", slices: int | None = None) -> None:
    """One document per project: title and mode, then its days with their selections in order.

    Times are seconds; ``titles`` has ``project_id`` and ``title``. Projects without a title get an empty one.
    """
    projects = selections.select("project_id").distinct().join(titles.select("project_id", "title"), "project_id", "left")
    fields = F.struct(F.coalesce("title", F.lit("")).alias("project_title"), F.lit(mode).alias("selection_mode"))
    days = selections.groupBy("project_id", "travel_day").agg(
        F.min_by("day_label", "sequence_index").alias("label"), F.min_by(F.col("date_key").cast("string"), "sequence_index").alias("date_key")
    )
    group = F.struct("travel_day", "label", "date_key")
    seconds = lambda c: (F.col(c) / 1000).alias(c.removesuffix("_ms"))
    entry = F.struct(
        "candidate_id", "clip_path", seconds("start_ms"), seconds("end_ms"), "sequence_index", "enabled", "role", "reason"
    )
    names, order = ("days", "selections"), ("travel_day", "sequence_index")
    write_lines(nested_lines(projects, fields, days, group, selections, entry, names, order), path, slices)


def write_candidates(candidates: DataFrame, header: DataFrame, path: str) -> None:
    """Candidate rows and a header per project with title, brief text and candidate count."""
    counts = candidates.groupBy("project_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    write_table(candidates, f"{path}/candidates", ("ordinal",))
    write_table(header.join(counts, "project_id"), f"{path}/header", ())


def cue_analysis(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Days with number, label and cue count, and the candidates with their day.

    A day lists its candidates by falling score, then time, then id; ``write_cue_analysis`` writes that order.
    """
    days = travel_days(candidates)
    counts = candidates.groupBy("project_id", "date_key").agg(F.count(F.lit(1)).alias("cue_count"))
    label = F.concat(F.lit("Day "), F.col("travel_day").cast("string"), F.lit(" · "), F.col("date_key").cast("string"))
    numbered = days.join(counts, ["project_id", "date_key"]).withColumn("label", label)
    cues = candidates.drop("travel_day", "total_days").join(
        days.select("project_id", "date_key", "travel_day"), ["project_id", "date_key"]
    )
    return numbered, cues


def write_cue_analysis(candidates: DataFrame, path: str) -> None:
    days, cues = cue_analysis(candidates)
    ordered = cues.withColumn("_by", -F.col("overall")).select(
        "project_id", "travel_day", "_by", "source_utc", "candidate_id", "clip_path", "start_ms", "end_ms",
        "duration_ms", "excerpt", "event_type", "people", "summary", "features", "overall",
    )
    write_table(days, f"{path}/days", ("travel_day",), "json")
    keys = ["project_id", "travel_day", "_by", "source_utc", "candidate_id"]
    ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_by").write.mode("overwrite").partitionBy(
        "project_id"
    ).json(f"{path}/cues")


def write_selection(selections: DataFrame, path: str) -> None:
    """Selection rows in day and sequence order."""
    write_table(selections, path, SELECTION_ORDER)


def write_timeline(items: DataFrame, path: str) -> None:
    write_table(items, path, TIMELINE_ORDER)


def write_chapters(chapters: DataFrame, path: str) -> None:
    """``timecode label`` lines."""
    lines = chapters.select("project_id", "pos", F.concat_ws(" ", "timecode", "label").alias("value"))
    keys = ["project_id", "pos"]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("pos").write.mode("overwrite").partitionBy(
        "project_id"
    ).text(path)
