"""Helpers that several operators share: staged tables, row numbers and whole-text words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one makes its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="staged-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs the tasks it ran, and every reader sees the
    same rows. ``drop_staged`` removes what this application has written once its results are saved.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Remove this application's staged tables; results that still read them must be saved before."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/staged-{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept(df: DataFrame, keep: Sequence[str] | None, added: Sequence[str]) -> list[str]:
    """The columns to pass through: ``keep`` or all, without those that the added ones replace in any case."""
    replaced = {a.lower() for a in added}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in replaced]


def carried(columns: Sequence[str]) -> list[Column]:
    """Columns under names that no operator uses itself; ``restored`` gives them their own back."""
    return [quoted(c).alias(f"_carried{i}") for i, c in enumerate(columns)]


def restored(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"_carried{i}").alias(c) for i, c in enumerate(columns)]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale and whatever other letters there are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
