"""Selection and candidate documents, whose shape is looked at part by part.

A document is a JSON text with its path. It is parsed once, as a variant, and each part is taken as what it is: a part of
another shape than the rules ask for rejects the document and is told with its path, entries that are no objects are
passed over, and fields that are missing or of another type are null. Nothing depends on an inferred schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlist.functions.text import filled
from cutlist.operators.cues import milliseconds

NO_DOCUMENT, NO_DAYS, NO_SELECTIONS, NO_CANDIDATES = (
    "no object", "days is no array", "selections is no array", "candidates is no array",
)


def read_texts(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Documents as ``path`` and ``value``: one per file, or one per line with ``multiline=False``."""
    texts = spark.read.text(path, wholetext=multiline).filter(F.btrim("value") != "")
    return texts.select(F.col("_metadata.file_path").alias("path"), "value")


def _get(value: Column, field: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{field}", kind)


def _object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _list_of(value: Column, fields: Column, field: str) -> Column:
    """The entries of an array; of a missing field none; null if it is anything else."""
    missing = ~F.coalesce(F.map_contains_key(fields, F.lit(field)), F.lit(False))
    return F.when(missing, F.array().cast("array<variant>")).otherwise(_get(value, field, "array<variant>"))


def _text(value: Column, field: str) -> Column:
    return filled(_get(value, field, "string"), "")


def _parsed(documents: DataFrame) -> DataFrame:
    """Documents with ``_v``, their fields in ``_o`` (null if they are no objects) and ``project_id``."""
    parsed = documents.withColumn("_v", F.try_parse_json("value"))
    return parsed.withColumn("_o", _object(F.col("_v"))).withColumn("project_id", _get(F.col("_v"), "project_id", "bigint"))


def _objects(entries: Column) -> Column:
    return F.filter(entries, lambda e: _object(e).isNotNull())


def selection_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers, selection rows and rejects of selection documents.

    A row has the columns of a selection, its times in milliseconds, ``day_no`` and ``item_no`` as its places, and
    ``path``. ``start_ms``, ``end_ms`` and ``sequence_index`` are null where they are no numbers; ``validate_selection``
    tells these. A document is rejected whole, with ``path``, ``travel_day`` (0 if the fault lies outside the days) and
    ``reason``, if it is no object, if ``days`` is no array or if any day's ``selections`` is none.
    """
    parsed = _parsed(documents).withColumn("_days", _list_of(F.col("_v"), F.col("_o"), "days"))
    days = F.transform(
        _objects(F.col("_days")),
        lambda d: F.struct(
            F.coalesce(_get(d, "travel_day", "bigint"), F.lit(0).cast("bigint")).alias("travel_day"),
            _text(d, "date_key").alias("date_key"),
            _text(d, "label").alias("day_label"),
            _list_of(d, _object(d), "selections").alias("items"),
        ),
    )
    parsed = parsed.withColumn("_days", days)
    faulty_day = F.get(F.filter("_days", lambda d: d["items"].isNull()), F.lit(0))
    parsed = parsed.withColumn("_bad", faulty_day["travel_day"]).withColumn(
        "reason",
        F.when(F.col("_o").isNull(), NO_DOCUMENT).when(F.col("_days").isNull(), NO_DAYS).when(F.col("_bad").isNotNull(), NO_SELECTIONS),
    )
    rejects = parsed.filter("reason is not null").select(
        "project_id", "path", F.coalesce("_bad", F.lit(0).cast("bigint")).alias("travel_day"), "reason"
    )
    good = parsed.filter("reason is null")
    headers = good.select(
        "project_id", "path", _text(F.col("_v"), "project_title").alias("project_title"),
        _text(F.col("_v"), "selection_mode").alias("selection_mode"), F.size("_days").cast("bigint").alias("n_days"),
    )
    each_day = good.select("project_id", "path", F.posexplode("_days").alias("day_no", "_d"))
    items = each_day.select(
        "project_id", "path", "day_no", "_d.travel_day", "_d.date_key", "_d.day_label", F.posexplode(_objects(F.col("_d.items"))).alias("item_no", "_i"),
    )
    item = F.col("_i")
    rows = items.select(
        "project_id", "travel_day", "date_key", "day_label",
        _text(item, "candidate_id").alias("candidate_id"), _text(item, "clip_path").alias("clip_path"),
        milliseconds(_get(item, "start", "string")).alias("start_ms"), milliseconds(_get(item, "end", "string")).alias("end_ms"),
        _get(item, "sequence_index", "string").alias("sequence_index"), _get(item, "enabled", "boolean").alias("enabled"),
        _text(item, "role").alias("role"), _text(item, "reason").alias("reason"),
        F.col("day_no").cast("bigint").alias("day_no"), F.col("item_no").cast("bigint").alias("item_no"), "path",
    )
    return headers, rows, rejects


def candidate_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers, candidate rows and rejects of candidate documents.

    Of entries with the same id in a document the last one counts; those without an id are passed over. A document is
    rejected if it is no object or if ``candidates`` is no array.
    """
    parsed = _parsed(documents).withColumn("_all", _list_of(F.col("_v"), F.col("_o"), "candidates"))
    reason = F.when(F.col("_o").isNull(), NO_DOCUMENT).when(F.col("_all").isNull(), NO_CANDIDATES)
    parsed = parsed.withColumn("reason", reason)
    good = parsed.filter("reason is null")
    headers = good.select(
        "project_id", "path", _text(F.col("_v"), "project_title").alias("project_title"),
        _text(F.col("_v"), "editorial_brief").alias("editorial_brief"), _get(F.col("_v"), "candidate_count", "bigint").alias("candidate_count"),
    )
    entries = good.select("project_id", "path", F.posexplode(_objects(F.col("_all"))).alias("ordinal", "_c"))
    entry = F.col("_c")
    rows = entries.select(
        "project_id", "path", F.col("ordinal").cast("bigint").alias("ordinal"), _text(entry, "candidate_id").alias("candidate_id"),
        _text(entry, "clip_path").alias("clip_path"), _text(entry, "date_key").alias("date_key"),
        F.coalesce(milliseconds(_get(entry, "start", "string")), F.lit(0).cast("bigint")).alias("start_ms"),
        milliseconds(_get(entry, "end", "string")).alias("end_ms"), _text(entry, "source_time").alias("source_time"),
        _text(entry, "excerpt").alias("excerpt"), _get(entry, "priority", "bigint").alias("priority"),
    ).filter("candidate_id <> ''").withColumn("end_ms", F.coalesce("end_ms", "start_ms"))
    fields = [c for c in rows.columns if c not in ("project_id", "path", "candidate_id")]
    last = rows.groupBy("project_id", "path", "candidate_id").agg(F.max_by(F.struct(*fields), "ordinal").alias("_r"))
    return headers, last.select("project_id", "path", "candidate_id", *[f"_r.{c}" for c in fields]), parsed.filter("reason is not null").select("project_id", "path", "reason")


def read_selection_documents(spark: SparkSession, path: str, multiline: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    return selection_documents(read_texts(spark, path, multiline))


def read_candidate_documents(spark: SparkSession, path: str, multiline: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    return candidate_documents(read_texts(spark, path, multiline))
