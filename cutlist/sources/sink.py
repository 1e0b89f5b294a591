"""One ordered JSON document per project, written by many tasks: a Python data source.

Rows are lines of documents in order, range-partitioned, so a project may lie in any number of partitions. A task
writes one file for each project that it meets, under a name of its own; the commit, on the driver, gives the files of
tasks that count their numbers and puts files with a comma between those that need one. The files of a project's folder one
after the other, by name, are its document: header first, then its entries. No row, task or commit holds a project, and
a task that fails or runs twice leaves nothing behind under a final name.

Files are written by pyarrow's file systems: a path that the driver and all executors share.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

# Travels to the workers with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "project_documents"
#: A line: its document, its order, its text, whether it is one of several siblings, and whether it leaves a list open.
LINE = "project_id bigint, first bigint, second bigint, text string, item boolean, opens boolean"
LAST = (1 << 63) - 1


@dataclass
class Fragment:
    """One task's part of a document, and what stands at its ends."""

    project: str
    part: int
    path: str
    item: bool
    opens: bool


@dataclass
class Written(WriterCommitMessage):
    fragments: list[Fragment]


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str]:
        # Hadoop writes local paths with one slash.
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", self.path))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = self._folder()
        part, made, file, before = TaskContext.get().partitionId(), [], None, False
        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in ("project_id", "text", "item", "opens")]
            for project, text, item, opens in zip(*columns):
                if not made or made[-1].project != str(project):
                    if file:
                        file.close()
                    folder = f"{root}/_run-{self.run}"
                    system.create_dir(folder, recursive=True)
                    name = f"{folder}/{uuid.uuid4().hex}"
                    made.append(Fragment(str(project), part, name, item, opens))
                    file = system.open_output_stream(name)
                elif item and not before:
                    file.write(b",\n")
                file.write(text.encode() + (b"\n" if opens else b""))
                made[-1].opens = before = opens
        if file:
            file.close()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._folder()
        last: Fragment | None = None
        number, cleared = 0, set()
        for f in sorted((f for m in messages if m for f in m.fragments), key=lambda f: (int(f.project), f.part)):
            folder = f"{root}/project_id={f.project}"
            if f.project not in cleared:
                cleared.add(f.project)
                # Documents of the projects written now are replaced, all others stay.
                if system.get_file_info(folder).type != fs.FileType.NotFound:
                    system.delete_dir(folder)
                system.create_dir(folder, recursive=True)
                number, last = 0, None
            if last and f.item and not last.opens:
                with system.open_output_stream(f"{folder}/{number:08d}.json") as between:
                    between.write(b",\n")
                number += 1
            system.move(f.path, f"{folder}/{number:08d}.json")
            number, last = number + 1, f
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._folder())

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_run-{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_run-{self.run}")


class ProjectDocuments(DataSource):
    """``lines.write.format("project_documents").save(path)``; ``lines`` are ordered and have the columns of ``LINE``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def _line(first: Column, second: Column, text: Column, item: bool, opens: bool) -> list[Column]:
    return [
        F.col("project_id").cast("bigint").alias("project_id"), first.cast("bigint").alias("first"),
        second.cast("bigint").alias("second"), text.alias("text"), F.lit(item).alias("item"), F.lit(opens).alias("opens"),
    ]


def _opened(fields: Column, name: str) -> Column:
    """An object of these fields whose last one, a list, is left open."""
    text = F.to_json(fields, {"ignoreNullFields": "false"})
    comma = F.when(text == "{}", F.lit("")).otherwise(F.lit(","))
    return F.concat(F.substring(text, F.lit(1), F.length(text) - 1), comma, F.lit(f'"{name}":['))


def flat_lines(header: DataFrame, fields: Column, entries: DataFrame, order: list[Column], entry: Column, name: str) -> DataFrame:
    """Documents of a header and one list: ``order`` has two whole numbers that order a project's entries."""
    low, high = F.lit(0), F.lit(LAST)
    return (
        header.select(*_line(F.lit(-LAST), low, _opened(fields, name), False, True))
        .unionByName(entries.select(*_line(*order, F.to_json(entry), True, False)))
        .unionByName(header.select(*_line(high, low, F.lit("]}\n"), False, False)))
    )


def nested_lines(
    header: DataFrame, fields: Column, groups: DataFrame, group: Column, entries: DataFrame, entry: Column, names: tuple[str, str],
    order: tuple[str, str],
) -> DataFrame:
    """Documents of a header and a list of groups with a list each; ``order`` names the group's and the entry's number."""
    first, second = F.col(order[0]), F.col(order[1])
    return (
        header.select(*_line(F.lit(-LAST), F.lit(0), _opened(fields, names[0]), False, True))
        .unionByName(groups.select(*_line(first, F.lit(-LAST), _opened(group, names[1]), True, True)))
        .unionByName(entries.select(*_line(first, second, F.to_json(entry), True, False)))
        .unionByName(groups.select(*_line(first, F.lit(LAST), F.lit("]}"), False, False)))
        .unionByName(header.select(*_line(F.lit(LAST), F.lit(0), F.lit("]}\n"), False, False)))
    )


def write_lines(lines: DataFrame, path: str, parts: int | None = None) -> None:
    """Write the documents of ``lines``; those of other projects at ``path`` stay."""
    lines.sparkSession.dataSource.register(ProjectDocuments)
    keys = ["project_id", "first", "second"]
    ranged = lines.repartitionByRange(parts, *keys) if parts else lines.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.format(FORMAT).mode("append").save(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of written documents, a row each without their commas, with ``project_id`` and ``file``; in no order."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"project_id=(-?\d+)", 1).cast("bigint").alias("project_id"),
        F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.json$", 1).alias("file"),
        F.regexp_replace("value", r",$", "").alias("text"),
    )
    return lines.filter("text <> ''")


def read_headers(spark: SparkSession, path: str, schema: str, name: str) -> DataFrame:
    """The headers of written documents, up to their list ``name``."""
    lines = read_lines(spark, path).filter(F.col("file") == "00000000").filter(F.col("text").endswith(f'"{name}":['))
    closed = F.concat("text", F.lit("]}"))
    return lines.select("project_id", F.from_json(closed, schema).alias("_h")).filter("_h is not null").select("project_id", "_h.*")
