"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in few bits mostly share long runs of high bits, and in Gray order neighbours differ in
one bit. Sorted by Gray rank, the distinct fingerprints are cut into blocks; a block's root keeps the bits that all
its members share (a mask and a pattern). Inside a block the same is done for groups of groups: every node holds
the bits shared below it that its ancestors have not settled yet. A search walks down with its accumulated
number of differing bits and leaves a whole group as soon as that exceeds the limit. No pair within the limit is
lost: the bits on a path are disjoint, so what is accumulated never exceeds the true distance.

1. One fingerprint per text; equal fingerprints are grouped with partial sums, so copies cost nothing further.
2. Distinct fingerprints are range-partitioned by Gray rank and cut into blocks of at most ``block`` members. There
   are no ties, so ranges are even whatever the data. The roots are the one thing that is broadcast: blocks grow
   with the table such that there are at most ``ROOTS`` of them and one per partition more.
3. Every fingerprint goes to its own block and to those later blocks whose root it does not exclude, packed by
   batch and block. Each block's task links members and visitors, and returns a spanning forest of what it found:
   at most one edge per member or visitor, never all pairs.
4. Connected components of these edges by alternating large-star and small-star steps over stored tables.

Defined cases: a null text or one without words has fingerprint zero and is linked like any other. Shorter texts than
three words are one shingle. Rows with equal or null ids are separate rows; a component's id is its smallest
non-null id, null if it has none. Columns of other names pass through ``near_duplicates``; those named like the
added ones are replaced. An empty table gives an empty table. Texts are read in blocks, whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlist.llm.common import carried, kept, quoted, restored, staged

#: Fingerprints that differ in at most this many bits are linked.
DISTANCE = 2
SHINGLE = 3
SEED = 42
#: Members of a block, and the most roots before blocks grow.
BLOCK = 2048
ROOTS = 1 << 16
#: Children of a node.
FANOUT = 16
#: Bytes of a text that are split into words at a time.
TEXT_BLOCK = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")
ADDED = ("fingerprint", "component_id")


# Fingerprints


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, by blocks that end at a blank."""
    at = 0
    while at < len(text):
        blank = BLANK.search(text, at + TEXT_BLOCK)
        stop = blank.start() if blank else len(text)
        yield text[at:stop].split()
        at = stop


def fingerprint(text: str | bytes | None) -> int:
    """The text's 64 bits: bit i is set if it is set in over half of the shingles' hashes."""
    raw = (text.encode() if isinstance(text, str) else text or b"").lower()
    ones, total, before = np.zeros(64, np.int64), 0, []
    for words in _word_lists(raw):
        words = before + words
        if len(words) >= SHINGLE:
            shingles = zip(*(words[i:] for i in range(SHINGLE)))
            hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles], np.uint64)
            for part in range(0, len(hashes), 1 << 16):
                bits = np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
                ones += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
        before = words[-(SHINGLE - 1) :]
    if not total and before:
        return xxhash.xxh64_intdigest(b" ".join(before), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        prints = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], names=[*batch.schema.names[:-1], "_print"])


def fingerprints(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` with ``_print``, the fingerprint as a signed long."""
    chosen = docs.select(*keep, text.alias("_text"))
    schema = chosen.drop("_text").schema.add("_print", "long")
    return chosen.mapInArrow(_fingerprints, schema)


def gray_rank(code: Column) -> Column:
    """Position of a code word in the reflected Gray sequence, moved so that signed order is unsigned order."""
    rank = reduce(lambda r, s: r.bitwiseXOR(F.shiftrightunsigned(r, s)), (1, 2, 4, 8, 16, 32), code)
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


# The index


def _shared(codes: np.ndarray, mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask and pattern of the bits that all of each group share, among those its members share."""
    ones = np.bitwise_and.reduceat(codes & mask, cuts)
    zeros = np.bitwise_and.reduceat(~codes & mask, cuts)
    return ones | zeros, ones


class GrayTree:
    """A hierarchy over codes, each known on the bits of its mask, in Gray order."""

    def __init__(self, codes: np.ndarray, masks: np.ndarray | None = None):
        full = np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF)) if masks is None else masks
        self.size = len(codes)
        levels = [(full, codes)]
        while len(levels[-1][0]) > 1:
            mask, code = levels[-1]
            levels.append(_shared(code, mask, np.arange(0, len(code), FANOUT)))
        # From the root down; each node keeps the bits that its parent does not share.
        self.levels = []
        above = None
        for mask, code in reversed(levels):
            rest = mask if above is None else mask & ~np.repeat(above, FANOUT)[: len(mask)]
            self.levels.append((rest, code & rest))
            above = mask

    def search(self, queries: np.ndarray, limit: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) index pairs whose known bits differ in at most ``limit`` places."""
        if not self.size or not len(queries):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        spent = np.zeros(len(queries), np.uint8)
        for depth, (mask, code) in enumerate(self.levels):
            if depth:
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                who, spent = np.repeat(who, FANOUT), np.repeat(spent, FANOUT)
                there = node < len(code)
                who, node, spent = who[there], node[there], spent[there]
            spent = spent + np.bitwise_count((queries[who] ^ code[node]) & mask[node])
            near = spent <= limit
            who, node, spent = who[near], node[near], spent[near]
        return who, node


def _batches(codes: np.ndarray, size: int = 1024) -> Iterator[np.ndarray]:
    for at in range(0, len(codes), size):
        yield codes[at : at + size]


def _cut(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one sorted partition: partition, number, packed members, shared mask and pattern."""
    held = np.zeros(0, np.int64)
    part, number = 0, 0

    def packed(codes: np.ndarray, part: int, number: int) -> pa.RecordBatch:
        mask, pattern = _shared(codes.view(np.uint64), np.full(len(codes), ~np.uint64(0)), np.zeros(1, np.int64))
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([(part << 32) + number], pa.int64()),
                "codes": pa.array([codes.tobytes()], pa.binary()),
                "mask": pa.array(mask.view(np.int64)),
                "pattern": pa.array(pattern.view(np.int64)),
            }
        )

    for batch in batches:
        part = batch.column(1)[0].as_py() if batch.num_rows else part
        held = np.concatenate([held, batch.column(0).to_numpy()])
        while len(held) >= 2 * block:
            yield packed(held[:block], part, number)
            held, number = held[block:], number + 1
    if len(held) > block:
        half = len(held) // 2
        yield packed(held[:half], part, number)
        held, number = held[half:], number + 1
    if len(held):
        yield packed(held, part, number)


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the smallest index that each node reaches, after edges (a, b) have come in."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new)  # a tree's root follows its lowest node
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _link(table: pa.Table) -> pa.Table:
    """A spanning forest of the links between one block's members, and of visitors to members."""
    own = pc.equal(table.column("own"), True)
    members = np.frombuffer(b"".join(table.filter(own).column("codes").to_pylist()), np.uint64)
    visitors = np.frombuffer(b"".join(table.filter(pc.invert(own)).column("codes").to_pylist()), np.uint64)
    tree, everyone = GrayTree(members), np.concatenate([members, visitors])
    label, done = np.arange(len(everyone)), 0
    for part in _batches(everyone):
        # Links are folded into the forest batch by batch: a dense block never holds all of its pairs.
        who, leaf = tree.search(part)
        label = _joined(label, who + done, leaf)
        done += len(part)
    bound = label != np.arange(len(everyone))
    codes = everyone.view(np.int64)
    return pa.table({"a": pa.array(codes[bound]), "b": pa.array(codes[label[bound]])})


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints in the column ``_print``: the same components as all near pairs."""
    spark = prints.sparkSession
    many = prints.count()
    block = max(block, math.ceil(many / ROOTS))
    parts = max(1, math.ceil(many / (16 * block)))
    ranked = (
        prints.select("_print", gray_rank(F.col("_print")).alias("rank"))
        .repartitionByRange(parts, "rank")
        .sortWithinPartitions("rank")
        .select("_print", F.spark_partition_id().cast("long").alias("part"))
    )
    blocks = staged(ranked.mapInArrow(lambda x: _cut(x, block), "block long, codes binary, mask long, pattern long"))
    top = blocks.select("block", "mask", "pattern").orderBy("block").toPandas()
    ids = top["block"].to_numpy(np.int64)
    masks, patterns = top["mask"].to_numpy(np.int64).view(np.uint64), top["pattern"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast((ids, masks, patterns))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, masks, patterns = shared.value
        tree = GrayTree(patterns, masks)
        for batch in batches:
            for home, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = np.frombuffer(packed, np.int64)
                rows = [(home, True, packed)]
                where = np.searchsorted(ids, home)
                for part in _batches(codes):
                    who, leaf = tree.search(part.view(np.uint64))
                    later = leaf > where
                    who, leaf = who[later], leaf[later]
                    order = np.argsort(leaf, kind="stable")
                    who, leaf = who[order], leaf[order]
                    cuts = np.flatnonzero(np.diff(leaf)) + 1
                    for w, x in zip(np.split(who, cuts), np.split(leaf, cuts)):
                        if len(w):
                            rows.append((int(ids[x[0]]), False, part[w].tobytes()))
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([r[0] for r in rows], pa.int64()),
                        "own": pa.array([r[1] for r in rows]),
                        "codes": pa.array([r[2] for r in rows], pa.binary()),
                    }
                )

    routed = blocks.select("block", "codes").mapInArrow(visit, "block long, own boolean, codes binary")
    return routed.groupBy("block").applyInArrow(_link, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node of its component.

    Large-star joins every larger neighbour of a node to the smallest one, small-star every smaller neighbour;
    repeated, every component becomes a star. Both keep at most one row per edge and combine on the map side.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(rounds):
        if _stars(edges):
            of_leaf = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return of_leaf.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        both = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(low, "a").select(F.explode(both).alias("e"))
        edges = staged(small.select("e.a", "e.b").where("a <> b").distinct())
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and that one has none."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    known = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not known.where((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).limit(1).count()


def _grouped(rows: DataFrame, order: Column) -> DataFrame:
    """(_key, _first) per distinct fingerprint of ``rows``: the least ``order`` in its component."""
    distinct = staged(rows.groupBy("_print").agg(F.min(order).alias("_least")))
    tree = staged(components(links(distinct)))
    named = distinct.join(tree, F.col("_print") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_print"))
    first = named.groupBy("_root").agg(F.min("_least").alias("_first"))
    return staged(named.select(F.col("_print").alias("_key"), "_root").join(first, "_root").select("_key", "_first"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, by default) of ``docs`` with ``fingerprint`` and ``component_id``."""
    columns = kept(docs, keep, ADDED)
    rows = staged(fingerprints(docs, quoted(text), [*carried(columns), quoted(doc_id).alias("_id")]))
    joined = rows.join(_grouped(rows, F.col("_id")), F.col("_print") == F.col("_key"))
    shown = F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint")
    return joined.select(*restored(columns), shown, F.col("_first").alias("component_id"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component: the one with the smallest non-null id, of equal ones the first as stored."""
    columns = docs.columns
    of = dict(zip(columns, range(len(columns))))
    numbered = staged(docs.select(*carried(columns), F.monotonically_increasing_id().alias("_row")))
    value, name = F.col(f"_carried{of[text]}"), F.col(f"_carried{of[doc_id]}")
    rows = staged(fingerprints(numbered, value, [name.alias("_id"), F.col("_row")]))
    order = F.struct(F.col("_id").isNull().alias("unknown"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    others = rows.join(_grouped(rows, order), F.col("_print") == F.col("_key")).where(F.col("_row") != F.col("_first.row"))
    return numbered.join(staged(others.select("_row")), "_row", "left_anti").select(*restored(columns))
