"""Token ids of a corpus as wavelet matrix files in document order, and what can be read from them.

``write`` puts documents in the order of their key, over range partitions, and encodes each partition in that order; every
``SHARD`` ids or more, at the end of a document, a file is closed (``wavelet`` has the format). Files have names of
their own, so a task that is run again leaves the first one's files alone; the manifest, a staged table with a row per
file, names those that count. ``read`` gives back documents with their ids, ``count`` and ``find`` look ids up without
decoding the files.

Files are written and read by pyarrow's file systems, at a path that the driver and all executors share: a local or
mounted path, or an address that they know (hdfs, s3, gs).

Words between blanks are looked up once while a worker's cache holds them. That is exact for tokenizers whose tokens never
cover a blank, as those that drop white space before they merge; for others set ``words`` to false, and whole texts are
encoded. Only time depends on the cache, whose size is bounded. New words of plain letters skip the steps of normalization
that leave them as they are.

Defined cases: a null text counts as empty, and a document without ids has the end id alone. Null keys come first; rows with
equal keys are ordered by a hash of their texts, and equal rows are interchangeable, so the ids of the corpus depend on
rows only. A key that many rows share is spread over partitions. Keys may have any type that Spark orders; other columns
are not written. An empty table gives no files and no rows. A text of any length is encoded whole, and its document lies in
one file, whatever its size.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutlist.llm import wavelet
from cutlist.llm.common import quoted, shared_folder, staged
from cutlist.llm.spans import chunks

WORD_TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
#: Ids from which a file is closed.
SHARD = 1 << 22
#: Words that a worker keeps, their longest in bytes, and the words of one text when new ones are encoded.
CACHED = 600_000
CACHED_LENGTH = 48
GROUP = 2000
#: Such texts that are encoded at once, which bounds what the library holds.
GROUPS = 16
#: Words that this normalizer turns into their lower case and that this pattern takes whole, but for one mark after them.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?$"
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Bytes of text that are encoded together.
TEXT_BLOCK = 8 << 20
#: Partitions whose files one window of the manifest takes.
PARTS = 4096

_MANIFEST = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("number", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("n_documents", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
    ]
)


def _gathered(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``values`` one after the other, and their sizes."""
    starts, each = (np.cumsum(sizes) - sizes)[which], sizes[which]
    ends = np.cumsum(each)
    return values[np.repeat(starts - (ends - each), each) + np.arange(int(each.sum()))], each


class WordIds:
    """Ids of whole texts, by the ids of their words."""

    def __init__(self, definition: str, words: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer, self._words = Tokenizer.from_str(definition), words
        self.largest = max(self._tokenizer.get_vocab(with_added_tokens=True).values())
        self._plain, self._ends = self._reduced(definition)
        self._known = pa.array([], pa.large_string())
        self._values, self._sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    @staticmethod
    def _reduced(definition: str):
        """The tokenizer without what has no effect on plain words, and which ids end a unit; nothing if it works otherwise."""
        from tokenizers import Tokenizer, pre_tokenizers

        shape = json.loads(definition)
        suffix = shape["model"].get("end_of_word_suffix")
        if not suffix or (shape["normalizer"], shape["pre_tokenizer"]) != (NORMALIZER, PRE_TOKENIZER):
            return None, None
        plain = Tokenizer.from_str(definition)
        plain.normalizer = None
        bytes_ = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Punctuation(), bytes_])
        vocabulary = plain.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for name, i in vocabulary.items() if name.endswith(suffix)]] = True
        return plain, ends

    def _keep(self, words: pa.Array, values: np.ndarray, sizes: np.ndarray, used: np.ndarray) -> None:
        """Cache all ``words``, or those just ``used`` and the newest ones, but no long ones."""
        rows = np.arange(len(words))
        if len(words) > CACHED:
            rows = np.union1d(used, rows[len(words) - CACHED // 2 :])[-CACHED:]
        rows = rows[pc.binary_length(words.take(pa.array(rows))).to_numpy(zero_copy_only=False) <= CACHED_LENGTH]
        if len(rows) < len(words):
            words, (values, sizes) = words.take(pa.array(rows)), _gathered(values, sizes, rows)
        self._known, self._values, self._sizes = words, values, sizes

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, the plain ones by themselves."""
        if self._plain is None:
            return self._by_offsets(words.to_pylist())
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        coded = pc.utf8_lower(words.filter(pa.array(plain))).dictionary_encode()
        values, sizes = self._by_ends(coded.dictionary)
        values, sizes = _gathered(values, sizes, coded.indices.to_numpy(zero_copy_only=False))
        more_values, more_sizes = self._by_offsets(words.filter(pa.array(~plain)).to_pylist())
        order = np.empty(len(words), np.int64)
        order[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(words))
        return _gathered(np.concatenate([values, more_values]), np.concatenate([sizes, more_sizes]), order)

    def _by_ends(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words in lower case: many are encoded as one text, and ids that end a unit tell whose they are."""
        units = pc.match_substring_regex(words, "[.,;:!?]$").to_numpy(zero_copy_only=False)
        units = np.where(units, 2, 1)
        values, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), GROUPS * GROUP):
            some = words.slice(at, GROUPS * GROUP).to_pylist()
            texts = [" ".join(some[n : n + GROUP]) for n in range(0, len(some), GROUP)]
            made = self._plain.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in made])
            ends = self._ends[ids]
            whose = np.repeat(np.arange(len(some)), units[at : at + len(some)])[np.cumsum(ends) - ends]
            values.append(ids)
            sizes.append(np.bincount(whose, minlength=len(some)))
        return np.concatenate(values), np.concatenate(sizes)

    def _by_offsets(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words: many are encoded as one text, and offsets tell whose they are."""
        values, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), GROUPS * GROUP):
            groups = [words[n : n + GROUP] for n in range(at, min(at + GROUPS * GROUP, len(words)), GROUP)]
            made = self._tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
            for group, one in zip(groups, made):
                lengths = np.fromiter(map(len, group), np.int64, len(group)) + 1
                starts = np.fromiter((a for a, _ in one.offsets), np.int64, len(one.ids))
                whose = np.searchsorted(np.cumsum(lengths), starts, side="right")
                values.append(np.array(one.ids, np.uint32))
                sizes.append(np.bincount(whose, minlength=len(group)))
        return np.concatenate(values), np.concatenate(sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and how many each has; a null text has none."""
        if not self._words:
            made = [e.ids for e in self._tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in made for i in ids], np.uint32), np.array([len(ids) for ids in made], np.int64)
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        at = pc.fill_null(pc.index_in(distinct, value_set=self._known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        fresh = distinct.take(pa.array(new))
        values, sizes = self._encoded(fresh)
        at[new] = len(self._known) + np.arange(len(new))
        all_values, all_sizes = np.concatenate([self._values, values]), np.concatenate([self._sizes, sizes])
        self._keep(pa.concat_arrays([self._known, fresh]), all_values, all_sizes, at)
        ids, each = _gathered(all_values, all_sizes, at[codes])
        edges = np.concatenate([[0], np.cumsum(each)])
        offsets = split.offsets.to_numpy()
        return ids, np.diff(edges[offsets - offsets[0]])


_LOADED: dict[tuple[str, bool], WordIds] = {}


def loaded(definition: str, words: bool) -> WordIds:
    """This worker's tokenizer, with the words that later tasks find cached."""
    if (definition, words) not in _LOADED:
        _LOADED.clear()
        _LOADED[definition, words] = WordIds(definition, words)
    return _LOADED[definition, words]


def read_tokenizer(path: str) -> str:
    """A tokenizer's definition, read by the driver and sent to tasks by value; a few megabytes."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    # Hadoop writes local paths with one slash, and has a name of its own for s3.
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", re.sub("^s3a:", "s3:", path)))


def write(
    docs: DataFrame,
    definition: str,
    end_id: int,
    folder: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    words: bool = True,
    shard: int = SHARD,
) -> DataFrame:
    """Write the ids of ``docs`` as files in ``folder`` (one of its own in the shared folder) and return the manifest.

    ``part`` and ``number`` order the files; ``path``, ``n_documents``, ``n_tokens`` and ``n_bytes`` describe them.
    """
    spark = docs.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark)}/staged-{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    system, place = _opened(folder)
    system.create_dir(place, recursive=True)
    model = spark.sparkContext.broadcast(definition)
    # Ties are put apart by the texts, and equal rows, which are interchangeable, by their places.
    order = [F.col("_key").asc_nulls_first(), F.xxhash64("_text"), F.col("_row")]
    inner = docs.select(quoted(key).alias("_key"), quoted(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    inner = inner.repartitionByRange(*order).sortWithinPartitions(*order)
    inner = inner.select(F.spark_partition_id().cast("bigint").alias("_part"), "_key", "_text")
    arrow = to_arrow_schema(_MANIFEST)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(model.value, words)
        levels = wavelet.levels_for(max(encoder.largest, end_id))
        system, place = _opened(folder)
        keys: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        number = 0

        def closed(part: int) -> pa.RecordBatch:
            nonlocal keys, sizes, held, number
            ids, each = np.concatenate(held), np.concatenate(sizes)
            name = f"{place}/part-{part:05d}-{number:05d}-{uuid.uuid4().hex}.wvm"
            rows = pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(each)], names=["key", "size"])
            with system.open_output_stream(name) as file:
                n_bytes = wavelet.write(file, ids, levels, rows)
            row = [part, number, f"{folder}/{name.rsplit('/', 1)[1]}", len(each), len(ids), n_bytes]
            keys, sizes, held, number = [], [], [], number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        part = 0
        for batch in batches:
            for block in chunks(batch, 2, TEXT_BLOCK):
                part = block.column(0)[0].as_py()
                ids, each = encoder.encode(block.column(2))
                ends = np.cumsum(each)
                ids, each = np.insert(ids, ends, end_id), each + 1
                ends = np.cumsum(each)
                first = 0
                while first < len(each):
                    # As many documents as fill the shard, or all.
                    room = shard - sum(map(len, held)) + (int(ends[first - 1]) if first else 0)
                    last = min(int(np.searchsorted(ends, room)) + 1, len(each))
                    keys.append(block.column(1).slice(first, last - first))
                    sizes.append(each[first:last])
                    held.append(ids[(ends[first - 1] if first else 0) : ends[last - 1]])
                    first = last
                    if sum(map(len, held)) >= shard:
                        yield closed(part)
        if keys:
            yield closed(part)

    return staged(inner.mapInArrow(task, _MANIFEST))


def located(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids of all files before each one.

    A window sees the files of ``PARTS`` partitions, and the one above them a row for so many.
    """
    run = F.floor(F.col("part") / PARTS)
    rows = manifest.withColumn("_run", run)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("_run").agg(F.sum("n_tokens").alias("_n"))
    runs = runs.select("_run", F.coalesce(F.sum("_n").over(before.orderBy("_run")), F.lit(0)).alias("_runs"))
    inside = F.coalesce(F.sum("n_tokens").over(before.partitionBy("_run").orderBy("part", "number")), F.lit(0))
    return (
        rows.withColumn("_inside", inside)
        .join(runs, "_run")
        .withColumn("start", F.col("_runs") + F.col("_inside"))
        .drop("_run", "_runs", "_inside")
    )


def _spread(manifest: DataFrame) -> DataFrame:
    """A partition for each file, up to a bound: rows are small but stand for much work."""
    files = manifest.count()
    return manifest.repartition(max(1, min(files, 50_000)), "path")


def _open(path: str) -> pa.NativeFile:
    system, place = _opened(path)
    return system.open_input_file(place)


def read(manifest: DataFrame, key_type: T.DataType, key: str = "doc_id") -> DataFrame:
    """The documents of the files: ``key``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids``.

    ``ids`` are packed as little-endian unsigned 32-bit integers. A file is decoded whole and given on by blocks.
    """
    schema = T.StructType(
        [
            T.StructField("_key", key_type),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(path) as file:
                    shard = wavelet.Wavelet(file)
                    ids, documents = shard.ids(), shard.documents()
                keys, sizes = documents.column(0), documents.column(1).to_numpy()
                ends = np.cumsum(sizes)
                cuts = np.flatnonzero(np.diff(ends // (1 << 20))) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
                    low, high = int(ends[a] - sizes[a]), int(ends[b - 1])
                    data = ids[low:high].astype("<u4").tobytes()
                    offsets = np.concatenate([[0], np.cumsum(sizes[a:b])]).astype(np.int32) * 4
                    packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                    starts = pa.array(ends[a:b] - sizes[a:b] + start, pa.int64())
                    columns = [keys.slice(a, b - a).cast(arrow.field(0).type), starts, pa.array(sizes[a:b], pa.int64()), packed]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    files = _spread(located(manifest)).select("path", "start")
    return files.mapInArrow(task, schema).withColumnRenamed("_key", key)


def count(manifest: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """How often each of ``tokens`` occurs in the corpus: ``token`` and ``n``, by rank alone."""
    wanted = [int(t) for t in dict.fromkeys(tokens)]
    arrow = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path) as file:
                    shard = wavelet.Wavelet(file)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(wanted, pa.int64()), pa.array([shard.rank(t) for t in wanted], pa.int64())], schema=arrow
                    )

    found = _spread(manifest).select("path").mapInArrow(task, "token bigint, n bigint")
    every = manifest.sparkSession.createDataFrame([(t, 0) for t in wanted], "token bigint, n bigint")
    return found.unionByName(every).groupBy("token").agg(F.sum("n").alias("n"))


def find(manifest: DataFrame, tokens: Sequence[int], key_type: T.DataType, key: str = "doc_id") -> DataFrame:
    """Every occurrence of ``tokens``: ``token``, its ``place`` in the corpus, its document and the place in there."""
    wanted = [int(t) for t in dict.fromkeys(tokens)]
    fields = [T.StructField(c, T.LongType()) for c in ("token", "place", "at")]
    schema = T.StructType([*fields, T.StructField("_key", key_type)])
    arrow = to_arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(path) as file:
                    shard = wavelet.Wavelet(file)
                    documents = shard.documents()
                    ends = np.cumsum(documents.column(1).to_numpy())
                    for token in wanted:
                        number, every = 0, shard.rank(token)
                        while number < every:
                            places = shard.select(token, np.arange(number, min(every, number + (1 << 16))))
                            number += len(places)
                            whose = np.searchsorted(ends, places, side="right")
                            at = places - np.concatenate([[0], ends])[whose]
                            columns = [pa.array(np.full(len(places), token)), pa.array(places + start), pa.array(at)]
                            yield pa.RecordBatch.from_arrays(
                                [*columns, documents.column(0).take(pa.array(whose)).cast(arrow.field(3).type)], schema=arrow
                            )

    files = _spread(located(manifest)).select("path", "start")
    return files.mapInArrow(task, schema).withColumnRenamed("_key", key)
