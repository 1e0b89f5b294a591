"""Readers with explicit schemas; what does not fit goes to a rejects frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from cutlist.functions.text import filled
from cutlist.functions.timekeys import utc_of
from cutlist.schemas import BRIEF, CLIP_RESULT, LONG, PROBE_DOCUMENT, TAXONOMY, TEXT, row

# Fixed values.
MEDIA_GLOB = "*.{mp4,MP4,mov,MOV,m4v,M4V}"
BRIEF_VERSION = "3"

CORRUPT = "_corrupt_record"


def read_documents(spark: SparkSession, path: str, schema: StructType, multiline: bool = True) -> DataFrame:
    """JSON documents with a ``_corrupt_record`` column for those that do not fit ``schema``.

    One file per document, or one line per document with ``multiline=False``, which Spark can split. The text
    is parsed against the whole schema, so which columns a query reads does not change what is corrupt.
    """
    shape = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    texts = spark.read.text(path, wholetext=multiline).filter(F.btrim("value") != "")
    return texts.select(F.from_json("value", shape, options).alias("_d")).select("_d.*")


def accepted(documents: DataFrame) -> DataFrame:
    """Documents that fit; a document that is no object has no field set and is left out too."""
    fields = [F.col(c).isNotNull() for c in documents.columns if c != CORRUPT]
    some = fields[0]
    for f in fields[1:]:
        some = some | f
    return documents.filter(F.col(CORRUPT).isNull() & some).drop(CORRUPT)


def rejected_documents(spark: SparkSession, path: str, schema: StructType, multiline: bool = True) -> DataFrame:
    """The documents that ``accepted`` leaves out, by ``path`` and ``reason``, with their ``value``."""
    shape = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    texts = spark.read.text(path, wholetext=multiline).filter(F.btrim("value") != "")
    parsed = texts.select(F.col("_metadata.file_path").alias("path"), "value", F.from_json("value", shape, options).alias("_d"))
    some = F.coalesce(*[F.col(f"_d.{f.name}").isNotNull() | F.lit(None) for f in schema], F.lit(False))
    fields = F.from_json("value", "map<string,string>")
    reason = (
        F.when(fields.isNull(), F.lit("no object"))
        .when(F.col(f"_d.{CORRUPT}").isNotNull(), F.lit("a field does not fit"))
        .when(~some, F.lit("no known field"))
    )
    return parsed.withColumn("reason", reason).filter("reason is not null").select("path", "reason", "value")


#: What ``read_probes`` expects of a document.
PROBE_RECORD = StructType([*row(project_id=LONG, path=TEXT, mtime=TEXT, length=LONG).fields, *PROBE_DOCUMENT.fields])


def list_media(spark: SparkSession, directory: str) -> DataFrame:
    """Media files directly in ``directory``, without their contents.

    The order is left to the reader of the frame: sort by ``path`` where it matters.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", MEDIA_GLOB).load(directory)
    return files.select("path", utc_of(F.col("modificationTime")).alias("mtime_utc"), "length")


def read_probes(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Probe records, each with its project, path and file facts."""
    rows = accepted(read_documents(spark, path, PROBE_RECORD, multiline))
    return rows.withColumn("mtime_utc", F.col("mtime").try_cast("timestamp_ntz")).drop("mtime")


def read_clip_results(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Stored clip results (S3); ``rejected_documents`` with ``CLIP_RESULT`` has the documents that are left out."""
    return accepted(read_documents(spark, path, CLIP_RESULT, multiline))


def _lenient(text: Column, kind: DataType) -> Column:
    """A JSON text as ``kind``, part by part: what does not fit is null, and list entries that are no objects go."""
    if isinstance(kind, StructType):
        fields = F.from_json(text, "map<string,string>")
        made = F.struct(*[_lenient(fields[f.name], f.dataType).alias(f.name) for f in kind])
        return F.when(fields.isNotNull(), made)
    if isinstance(kind, ArrayType):
        entries = F.transform(F.from_json(text, "array<string>"), lambda e: _lenient(e, kind.elementType))
        return F.filter(entries, lambda e: e.isNotNull())
    return text if isinstance(kind, StringType) else text.try_cast(kind)


def _parsed(spark: SparkSession, path: str, schema: StructType, multiline: bool) -> DataFrame:
    """Documents with ``_path``, ``_value`` and ``_fields``, null where the text is no object, and the parts of ``schema``."""
    texts = spark.read.text(path, wholetext=multiline).filter(F.btrim("value") != "")
    known = texts.select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("value").alias("_value"),
        F.from_json("value", "map<string,string>").alias("_fields"),
    )
    return known.select("*", *[_lenient(F.col("_fields")[f.name], f.dataType).alias(f.name) for f in schema])


def read_briefs(spark: SparkSession, path: str, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """Briefs of the supported version, and all other documents with id, path and reason.

    A brief is read part by part: an odd list entry or field is left out and the rest counts. ``editorial_brief`` may
    be a plain text.
    """
    documents = _parsed(spark, path, BRIEF, multiline)
    editorial = F.col("_fields")["editorial_brief"]
    kind = BRIEF["editorial_brief"].dataType
    plain = F.struct(*[(editorial if f.name == "text" else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind])
    documents = documents.withColumn("editorial_brief", F.coalesce("editorial_brief", F.when(filled(editorial).isNotNull(), plain)))
    reason = (
        F.when(F.col("_fields").isNull(), F.lit("not a brief"))
        .when(
            ~F.coalesce(F.regexp_extract("version", r"^0*(\d+)$", 1) == BRIEF_VERSION, F.lit(False)),
            F.concat(F.lit("version "), F.coalesce("version", F.lit(""))),
        )
        .when(F.col("project_id").isNull(), F.lit("no project_id"))
    )
    judged = documents.withColumn("_reason", reason)
    briefs = judged.filter("_reason is null").select(*BRIEF.fieldNames())
    return briefs, judged.filter("_reason is not null").select("project_id", F.col("_path").alias("path"), F.col("_reason").alias("reason"))


def read_taxonomies(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Project taxonomies, part by part like briefs (S7; ``taxonomies_with_default`` fills the gaps)."""
    documents = _parsed(spark, path, TAXONOMY, multiline)
    return documents.filter(F.size("_fields") > 0).select(*TAXONOMY.fieldNames())


def rejected_taxonomies(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """The documents that ``read_taxonomies`` leaves out: those that are no objects or have no field."""
    documents = _parsed(spark, path, TAXONOMY, multiline)
    left = documents.filter(~F.coalesce(F.size("_fields") > 0, F.lit(False)))
    return left.select(F.col("_path").alias("path"), F.lit("no object with fields").alias("reason"), F.col("_value").alias("value"))


def read_table(spark: SparkSession, path: str, projects: Column | None = None) -> DataFrame:
    """A table written by ``sources.writers`` (S8); a filter on ``project_id`` prunes its directories."""
    rows = spark.read.parquet(path)
    return rows.filter(projects) if projects is not None else rows
