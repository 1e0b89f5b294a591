"""Checks of a selection against its candidates, one report row per fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlist.functions.text import filled

TOLERANCE_MS = 10


class SelectionError(ValueError):
    """Raised by ``fail_fast`` with the first faults."""


def _fault(test: Column, rule: str, detail: Column) -> Column:
    return F.when(test, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))


def _text(column: str) -> Column:
    return F.coalesce(filled(F.col(column)), F.lit(""))


def validate_selection(
    selections: DataFrame, candidates: DataFrame, projects: DataFrame | None = None, fail_fast: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Enabled selections that pass every rule, and the violations.

    ``start_ms``, ``end_ms`` and ``sequence_index`` may hold text or doubles; what is no number is reported. Rows of a
    day whose numbering is reported do not count as valid. ``enabled``
    is a strict boolean and a missing one counts as enabled (deviation: no truthiness of texts). With
    ``projects``, a project without candidates or without an enabled selection is reported too.
    """
    known = candidates.select(
        "project_id",
        "candidate_id",
        F.col("clip_path").alias("_clip"),
        F.col("date_key").cast("string").alias("_date"),
        F.col("start_ms").alias("_from"),
        F.col("end_ms").alias("_to"),
    ).withColumn("_known", F.lit(True))
    # Text, whole numbers and doubles alike; what is no number or fits no long becomes null, as does a part of an index.
    exact = lambda c: F.col(c).cast("string").try_cast("decimal(38,6)")
    number = lambda c: F.round(exact(c)).try_cast("bigint")
    index = F.when(exact("sequence_index") == F.round(exact("sequence_index")), number("sequence_index"))
    rows = (
        selections.filter(F.coalesce("enabled", F.lit(True)))
        .withColumn("date_key", _text("date_key"))
        .withColumn("start_ms", number("start_ms"))
        .withColumn("end_ms", number("end_ms"))
        .withColumn("sequence_index", index)
        .withColumn("travel_day", F.coalesce("travel_day", F.lit(0)).cast("bigint"))
        .join(known, ["project_id", "candidate_id"], "left")
    )
    found = F.col("_known").isNotNull()
    numeric = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & F.col("sequence_index").isNotNull()
    outside = (
        (F.col("start_ms") < F.col("_from") - TOLERANCE_MS)
        | (F.col("end_ms") > F.col("_to") + TOLERANCE_MS)
        | (F.col("end_ms") <= F.col("start_ms"))
    )
    bounds = F.concat_ws("-", F.col("start_ms").cast("string"), F.col("end_ms").cast("string"))
    faults = F.array_compact(
        F.array(
            _fault(~found, "V2", F.coalesce("candidate_id", F.lit(""))),
            _fault(found & (_text("clip_path") != F.coalesce(F.col("_clip"), F.lit(""))), "V3", _text("clip_path")),
            _fault(
                found & (F.col("date_key") != "") & (F.coalesce(F.col("_date"), F.lit("")) != "") & (F.col("date_key") != F.col("_date")),
                "V4",
                F.col("date_key"),
            ),
            _fault(~numeric, "V5", bounds),
            _fault(found & numeric & outside, "V6", bounds),
            _fault((_text("role") == "") | (_text("reason") == ""), "V7", _text("role")),
        )
    )
    checked = rows.withColumn("_faults", faults)
    report = ["project_id", "travel_day", "candidate_id", "rule", "detail"]
    by_row = checked.select("project_id", "travel_day", "candidate_id", F.explode("_faults").alias("_f")).select(
        "project_id", "travel_day", "candidate_id", "_f.rule", "_f.detail"
    )
    bad_days = (
        rows.filter("sequence_index is not null")
        .groupBy("project_id", "travel_day", "date_key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("sequence_index").alias("low"),
            F.max("sequence_index").alias("high"),
            F.count_distinct("sequence_index").alias("kinds"),
        )
        .filter("low <> 1 or high <> n or kinds <> n")
    )
    in_day = bad_days.select(
        "project_id",
        "travel_day",
        F.lit("").alias("candidate_id"),
        F.lit("V8").alias("rule"),
        F.concat_ws("/", "low", "high", "kinds", "n").alias("detail"),
    )
    violations = by_row.select(*report).unionByName(in_day)
    if projects is not None:
        ids = projects.select("project_id").distinct()
        for rule, present in (("V11", candidates), ("V9", rows)):
            violations = violations.unionByName(
                ids.join(present.select("project_id"), "project_id", "left_anti").select(
                    "project_id",
                    F.lit(0).cast("bigint").alias("travel_day"),
                    F.lit("").alias("candidate_id"),
                    F.lit(rule).alias("rule"),
                    F.lit("").alias("detail"),
                )
            )
    label = F.coalesce(filled(F.col("day_label")), F.concat(F.lit("Day "), F.col("travel_day").cast("string")))
    whole_days = checked.filter(F.size("_faults") == 0).join(bad_days, ["project_id", "travel_day", "date_key"], "left_anti")
    valid = whole_days.withColumn("day_label", label).select(*selections.columns)
    if fail_fast:
        raise_first(violations)
    return valid, violations


def raise_first(violations: DataFrame) -> None:
    """Raise if there are any violations, naming a few."""
    first = violations.limit(5).collect()
    if first:
        raise SelectionError("; ".join(f"{r.rule} {r.project_id}/{r.travel_day}/{r.candidate_id}: {r.detail}" for r in first))


def structure_rejects(rejects: DataFrame) -> DataFrame:
    """Selection documents of another shape as report rows.

    ``rejects`` is the last frame of ``sources.documents.selection_documents``; the detail names reason and path.
    """
    return rejects.select(
        "project_id", "travel_day", F.lit("").alias("candidate_id"), F.lit("V10").alias("rule"),
        F.concat_ws(": ", "reason", "path").alias("detail"),
    )
