"""Accessors of a project brief as column expressions on its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlist.functions.text import cleaned, filled

# Fixed values.
EDITORIAL_LINES = (
    "summary", "tone", "target_runtime", "meal_guidance", "pacing_guidance", "opener_guidance", "closer_guidance",
)
EDITORIAL_LISTS = ("must_include", "avoid", "story_goals")
DEFAULT_PRESETS = ("warm_family_vlog",)
DEFAULT_RENDER_MODE = "chunked_direct_mp4"


def must_include_terms(terms: Column) -> Column:
    """Stripped, lowered, non-empty terms."""
    return F.coalesce(F.transform(cleaned(terms), F.lower), F.array().cast("array<string>"))


def editorial_text(editorial: Column) -> Column:
    """``key: value`` lines, then ``key: a; b`` lists; empty ones are left out (P25). A plain text is itself."""
    lines = [F.concat(F.lit(f"{key}: "), filled(editorial[key])) for key in EDITORIAL_LINES]
    for key in EDITORIAL_LISTS:
        items = cleaned(editorial[key])
        lines.append(F.when(F.size(items) > 0, F.concat(F.lit(f"{key}: "), F.array_join(items, "; "))))
    return F.coalesce(filled(editorial["text"]), F.concat_ws("\n", *lines))


def people_terms(people: Column) -> Column:
    """Named people with their cleaned aliases, in list order."""
    named = F.filter(people, lambda p: filled(p["name"]).isNotNull())
    term = lambda p: F.struct(
        filled(p["name"]).alias("canonical"),
        F.lit("person").alias("category"),
        F.coalesce(cleaned(p["aliases"]), F.array().cast("array<string>")).alias("aliases"),
    )
    empty = F.array().cast("array<struct<canonical:string,category:string,aliases:array<string>>>")
    return F.coalesce(F.transform(named, term), empty)


def prompt_terms(brief: DataFrame) -> Column:
    """Names, aliases, place names, labels, keywords and own terms, each once, first use first."""
    named = lambda items, name, extra: F.flatten(
        F.transform(
            items,
            lambda x: F.concat(F.array(x[name]), F.coalesce(x[extra], F.array().cast("array<string>"))),
        )
    )
    people = F.filter(brief["people"], lambda p: filled(p["name"]).isNotNull())
    parts = [
        named(people, "name", "aliases"),
        named(brief["places"], "name", "aliases"),
        named(brief["story_anchors"], "label", "keywords"),
        brief["transcription.prompt_terms"],
    ]
    empty = F.array().cast("array<string>")
    return F.array_distinct(cleaned(F.concat(*[F.coalesce(p, empty) for p in parts])))


def brief_settings(briefs: DataFrame) -> DataFrame:
    """Defaults for zone and render settings."""
    presets = cleaned(F.col("render.preview_presets"))
    presets = F.when(F.size(presets) > 0, presets).otherwise(F.array(*[F.lit(p) for p in DEFAULT_PRESETS]))
    return briefs.select(
        "project_id",
        filled(F.col("project.default_timezone")).alias("default_timezone"),
        presets.alias("preview_presets"),
        filled(F.col("render.selected_preset"), presets[0]).alias("selected_preset"),
        filled(F.col("render.final_render_mode"), DEFAULT_RENDER_MODE).alias("final_render_mode"),
        F.coalesce(cleaned(F.col("render.final_feedback")), F.array().cast("array<string>")).alias("final_feedback"),
    )


def brief_dimension(briefs: DataFrame, name: str) -> DataFrame:
    """One row per entry of ``people``, ``places``, ``time_anchors`` or ``story_anchors`` with its list position."""
    rows = briefs.select("project_id", F.posexplode(name).alias("ordinal", "_entry"))
    rows = rows.filter("_entry is not null")
    if name == "people":
        rows = rows.filter(filled(F.col("_entry.name")).isNotNull())
    return rows.select("project_id", "ordinal", "_entry.*")


def replacement_rules(briefs: DataFrame) -> DataFrame:
    """One row per replacement rule with its list position."""
    return briefs.select(
        "project_id", F.posexplode("transcription.replacement_rules").alias("ordinal", "_rule")
    ).select("project_id", "ordinal", "_rule.*")


def place_zones(briefs: DataFrame) -> DataFrame:
    """Zone of each place that names one; the last of equal ids counts."""
    rows = brief_dimension(briefs, "places")
    return (
        rows.select("project_id", "ordinal", filled(F.col("id")).alias("place_id"), filled(F.col("timezone")).alias("tz"))
        .filter("place_id is not null and tz is not null")
        .groupBy("project_id", "place_id")
        .agg(F.max_by("tz", "ordinal").alias("tz"))
    )
