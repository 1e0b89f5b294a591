"""Look presets: alias resolution and the per-project lookup report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlist.functions.briefs import brief_settings

# Fixed values.
PRESETS = (
    ("warm_family_vlog", "Warm Family Vlog", "preview+final"),
    ("bright_resort", "Bright Resort Travel", "preview+final"),
    ("refined_travel", "Refined Travel Film", "preview+final"),
    ("shortform_bold", "Shortform Bold", "preview+final"),
    ("teal_orange_cinematic", "Teal Orange Cinematic", "preview-only"),
)
ALIASES = {
    "warm_travel_film": "warm_family_vlog",
    "warm": "warm_family_vlog",
    "resort": "bright_resort",
    "refined": "refined_travel",
    "shortform": "shortform_bold",
    "teal_orange": "teal_orange_cinematic",
}


def presets_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRESETS), "preset_id string, label string, category string")


def resolve_preset(name: Column) -> Column:
    key = F.btrim(name)
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def resolve_presets(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known presets of each project once, in order of first mention, and the unknown names.

    ``wanted`` has ``project_id``, ``ordinal`` and ``name``. The preset table is the fixed list above.
    """
    presets = presets_table(wanted.sparkSession)
    resolved = wanted.withColumn("preset_id", resolve_preset(F.col("name")))
    first = resolved.groupBy("project_id", "preset_id").agg(F.min("ordinal").alias("ordinal"))
    known = first.join(F.broadcast(presets), "preset_id").select("project_id", "ordinal", "preset_id", "label", "category")
    unknown = resolved.join(F.broadcast(presets), "preset_id", "left_anti").select("project_id", "ordinal", "name")
    return known, unknown


def preset_report(briefs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preview presets of each brief with the selected one marked, and the unknown names."""
    settings = brief_settings(briefs)
    wanted = settings.select("project_id", F.posexplode("preview_presets").alias("ordinal", "name"))
    known, unknown = resolve_presets(wanted)
    chosen = settings.select("project_id", resolve_preset(F.col("selected_preset")).alias("_selected"))
    marked = known.join(chosen, "project_id").withColumn("is_selected", F.col("preset_id") == F.col("_selected"))
    return marked.drop("_selected"), unknown
