"""Approximate nearest neighbours by cosine through shifted space-filling curves.

Each of ``ORDERINGS`` orderings rotates the unit vectors at random, keeps ``AXES`` coordinates, makes each even by its
quantiles, shifts them by a random offset and puts the points in the order of a Hilbert curve. Near vectors are near
in some of the orders. The orders are range-partitioned and cut into buckets by place, whatever the density, of ``BUCKET``
vectors or as many more as it takes for the windows of all orderings to add up to ``SHARE`` of the table; a query is compared with its own bucket and both neighbours, so about a bucket's vectors to either
side, and the best of all orderings are merged. Scores are cosines of the original vectors in double precision.

Equal vectors are one point of the index: any number of copies takes one place, and no answer can hold more than
the smallest ``k + 1`` ids of a point, which are kept with it. So copies crowd no bucket, and lose no result.

The quantiles are fitted on ``SAMPLE`` vectors chosen by hash; the index holds every vector. A bucket is a row of
packed vectors, and only a bucket's queries are sent to its neighbours. Work grows with queries times ``SHARE`` of the
vectors once that exceeds the least windows: in near-uniform vectors fewer comparisons lose neighbours.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows with
a null id. Vectors of different lengths are indexes of their own. Rows with equal ids are separate rows. With fewer
candidates than k a query has what there is, without any it has no row. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlist.llm.common import staged
from cutlist.llm.vectors import matrices, usable

ORDERINGS = 12
AXES = 8
BITS = 4
BUCKET = 2048
#: Windows of all orderings, overlaps counted, as a share of the vectors.
SHARE = 1.0
#: Scores that are held at once.
SCORES = 1 << 22
SAMPLE = 4096
SEED = 10
#: Rows of one vector that are ranked in one task before they are merged.
SPREAD = 1 << 16


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with whole coordinates below ``2**bits``.

    From the top bit down, the curve's orientation in the cell reached so far turns the lower bits: where an axis has
    the bit, the first axis is mirrored, elsewhere the two are exchanged. What is left is a Gray code of the place.
    """
    axes = [np.array(c, np.uint32) for c in cells.T]
    for bit in range(bits - 1, 0, -1):
        lower = np.uint32((1 << bit) - 1)
        for i in range(len(axes)):
            there = (axes[i] >> np.uint32(bit)) & np.uint32(1) == 1
            swap = np.where(there, np.uint32(0), (axes[0] ^ axes[i]) & lower)
            axes[0] = np.where(there, axes[0] ^ lower, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(len(cells), np.uint32)
    for bit in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] >> np.uint32(bit)) & np.uint32(1) == 1, turn ^ np.uint32((1 << bit) - 1), turn)
    place = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            place = place << 1 | (((axis ^ turn) >> np.uint32(bit)) & np.uint32(1)).astype(np.int64)
    return place


class Orderings:
    """Rotations, quantiles and shifts for vectors of one length."""

    def __init__(self, sample: np.ndarray, orderings: int = ORDERINGS, axes: int = AXES, bits: int = BITS, seed: int = SEED):
        size = sample.shape[1]
        axes = min(axes, size)
        random = np.random.default_rng([seed, size])
        self.bits, self.turns, self.cuts, self.shifts = bits, [], [], []
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        for _ in range(orderings):
            turn, _ = np.linalg.qr(random.normal(size=(size, size)))
            self.turns.append(turn[:, :axes])
            self.cuts.append(np.quantile(unit @ turn[:, :axes], np.linspace(0, 1, 65), axis=0))
            self.shifts.append(random.random(axes))

    def places(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        """The place of every vector in each ordering."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        for turn, cuts, shift in zip(self.turns, self.cuts, self.shifts):
            flat = unit @ turn
            even = np.stack([np.interp(flat[:, i], cuts[:, i], np.linspace(0, 1, 65)) for i in range(flat.shape[1])], axis=1)
            cells = np.minimum((even + shift) / 2 * (1 << self.bits), (1 << self.bits) - 1)
            yield hilbert(cells.astype(np.uint32), self.bits)


def points(table: DataFrame, queries: Column, k: int, vector: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """(_row, _id, _point) per row that takes part, and per point its vector, whether it is asked, and k + 1 members."""
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = staged(
        table.where(usable(F.col(vector)) & F.col(row_id).isNotNull())
        .where(squares > 0)
        .select(
            F.monotonically_increasing_id().alias("_row"), F.col(row_id).cast("long").alias("_id"),
            F.coalesce(queries, F.lit(False)).alias("_query"), F.col(vector).alias("_vector"),
        )
    )
    parts = max(1, rows.count() // SPREAD)
    # A vector's rows are ranked in parts first, so that none has to be ranked as a whole.
    keyed = rows.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)))
    in_part = Window.partitionBy("_vector", "_part").orderBy("_id", "_row")
    some = keyed.withColumn("_n", F.row_number().over(in_part)).where(F.col("_n") <= k + 1)
    in_all = Window.partitionBy("_vector").orderBy("_id", "_row")
    few = some.withColumn("_n", F.row_number().over(in_all)).where(F.col("_n") <= k + 1)
    members = few.groupBy("_vector").agg(F.sort_array(F.collect_list(F.struct("_id", "_row"))).alias("members"))
    asked = rows.groupBy("_vector").agg(F.max("_query").alias("asked"))
    made = members.join(asked, "_vector").withColumn("_point", F.col("members")[0]["_row"])
    return rows, staged(made)


def _ordered(batches: Iterator[pa.RecordBatch], index: dict[int, Orderings]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for where, matrix in matrices(batch.column(2)):
            chosen = batch.take(pa.array(where))
            for n, place in enumerate(index[matrix.shape[1]].places(matrix.astype(np.float64))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(where), matrix.shape[1], np.int32)), pa.array(np.full(len(where), n, np.int32)),
                     pa.array(place), *chosen.columns],
                    names=["size", "ordering", "place", "_point", "asked", "_vector"],
                )


def _bucketed(batches: Iterator[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
    """Buckets of one sorted partition, as packed rows; an ordering's last two share what is left evenly."""
    names = ["size", "ordering", "part", "number", "ids", "matrix", "asked"]
    held: list[tuple] = []
    state, number = None, 0

    def packed(count: int) -> pa.RecordBatch:
        nonlocal held, number
        ids, asked, matrix = (np.concatenate([h[i] for h in held]) for i in range(3))
        held = [(ids[count:], asked[count:], matrix[count:])] if count < len(ids) else []
        number += 1
        values = [state[0], state[1], state[2], number, ids[:count].tobytes(), matrix[:count].tobytes(), asked[:count].tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

    def drained(least: int) -> Iterator[pa.RecordBatch]:
        while (many := sum(len(h[0]) for h in held)) >= max(1, least):
            yield packed(bucket if many >= 2 * bucket else -(-many // 2) if many > bucket else many)

    for batch in batches:
        heads = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
        cuts = [0, *(np.flatnonzero((np.diff(heads) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            run = batch.slice(a, b - a)
            new = tuple(run.column(i)[0].as_py() for i in (0, 1, 5))
            if state is not None and new != state:
                yield from drained(1)
            state = new
            matrix = next(matrices(run.column(4)))[1]
            held.append((run.column(2).to_numpy(), run.column(3).to_numpy(zero_copy_only=False), matrix))
            yield from drained(2 * bucket)
    if state is not None:
        yield from drained(1)


def _ask(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """A bucket's own queries, for itself and both neighbours."""
    names = ["size", "ordering", "nth", "q_ids", "q_matrix"]
    for batch in batches:
        rows = []
        for size, ordering, nth, ids, matrix, asked in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.flatnonzero(np.frombuffer(asked, bool))
            if len(own):
                q_ids = np.frombuffer(ids, np.int64)[own].tobytes()
                q_matrix = np.frombuffer(matrix, kind).reshape(-1, size)[own].tobytes()
                rows += [(size, ordering, nth + d, q_ids, q_matrix) for d in (-1, 0, 1)]
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _nearest(batches: Iterator[pa.RecordBatch], k: int, kind: str) -> Iterator[pa.RecordBatch]:
    """The k + 1 best points of a bucket for each query, its own point among them."""
    for batch in batches:
        for size, q_ids, q_matrix, ids, matrix in zip(*(c.to_pylist() for c in batch.columns)):
            q, c = (np.frombuffer(x, kind).reshape(-1, size).astype(np.float64) for x in (q_matrix, matrix))
            q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
            lengths, count, step = np.linalg.norm(c, axis=1), min(k + 1, len(ids)), max(1, SCORES // len(ids))
            for part in range(0, len(q), step):
                some = q[part : part + step]
                cosine = (some @ c.T) / (np.linalg.norm(some, axis=1)[:, None] * lengths[None, :])
                edge = np.partition(cosine, -count, axis=1)[:, -count]
                query, at = np.nonzero(cosine >= edge[:, None])  # ties at the edge stay: ids decide later
                yield pa.RecordBatch.from_pydict({"_asked": q_ids[part + query], "_point": ids[at], "score": cosine[query, at]})


def nearest(
    table: DataFrame, queries: Column, k: int = 5, vector: str = "embedding", row_id: str = "vec_id",
    orderings: int = ORDERINGS, sample: int = SAMPLE, share: float = SHARE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query among all other rows of ``table``.

    ``queries`` is a condition over the id column that says which rows are queries.
    """
    sc = table.sparkSession.sparkContext
    # Packed as they are stored; scores are computed in double precision.
    kind = {"float": "float32", "double": "float64"}.get(table.schema[vector].dataType.elementType.simpleString())
    if kind is None:
        table, kind = table.withColumn(vector, F.col(vector).cast("array<double>")), "float64"
    rows, stored = points(table, queries, k, vector, row_id)
    lengths = [r[0] for r in stored.select(F.size("_vector")).distinct().collect()]  # one row per length
    index = {}
    for size in lengths:
        chosen = stored.where(F.size("_vector") == size).orderBy(F.xxhash64("_point")).limit(sample)
        index[size] = Orderings(np.array([r[0] for r in chosen.select("_vector").collect()], np.float64), orderings)
    shared = sc.broadcast(index)
    count = stored.count()
    bucket, many = max(BUCKET, math.ceil(share * count / (3 * orderings))), count * orderings
    placed = stored.select("_point", "asked", "_vector").mapInArrow(
        lambda batches: _ordered(batches, shared.value),
        stored.select(
            F.lit(0).alias("size"), F.lit(0).alias("ordering"), F.lit(0).cast("long").alias("place"), "_point", "asked", "_vector"
        ).schema,
    )
    keys = ("size", "ordering", "place", "_point")
    ranged = placed.repartitionByRange(max(1, many // (16 * bucket)), *keys).sortWithinPartitions(*keys)
    buckets = staged(
        ranged.select("size", "ordering", "_point", "asked", "_vector", F.spark_partition_id().alias("part")).mapInArrow(
            lambda batches: _bucketed(batches, bucket), "size int, ordering int, part int, number long, ids binary, matrix binary, asked binary"
        )
    )
    # A row per bucket: partitions follow each other in order, and so do the numbers in each.
    nth = Window.partitionBy("size", "ordering").orderBy("part", "number")
    order = staged(
        buckets.select("size", "ordering", "part", "number").withColumn("nth", F.row_number().over(nth).cast("long"))
    )
    numbered = buckets.join(order, ["size", "ordering", "part", "number"])
    asked = numbered.select("size", "ordering", "nth", "ids", "matrix", "asked").mapInArrow(
        lambda batches: _ask(batches, kind), "size int, ordering int, nth long, q_ids binary, q_matrix binary"
    )
    pairs = asked.join(numbered.select("size", "ordering", "nth", "ids", "matrix"), ["size", "ordering", "nth"])
    found = pairs.select("size", "q_ids", "q_matrix", "ids", "matrix").mapInArrow(
        lambda batches: _nearest(batches, k, kind), "_asked long, _point long, score double"
    )
    merged = found.groupBy("_asked", "_point").agg(F.max("score").alias("score"))
    by_point = Window.partitionBy("_asked").orderBy(F.col("score").desc())
    best = merged.withColumn("_n", F.rank().over(by_point)).where(F.col("_n") <= k + 1)
    answers = best.join(stored.select("_point", "members"), "_point").select(
        "_asked", "score", F.explode("members").alias("m")
    )
    # A point's answers are the same for all rows that share it, but for the row itself.
    ranked = Window.partitionBy("_asked").orderBy(F.col("score").desc(), "m._id", "m._row")
    listed = answers.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= k + 1)
    asking = rows.where("_query").join(
        stored.select("_point", "_vector"), "_vector"
    ).select(F.col("_row").alias("_q_row"), F.col("_id").alias("query_id"), F.col("_point").alias("_asked"))
    final = Window.partitionBy("_q_row").orderBy(F.col("score").desc(), "m._id", "m._row")
    return (
        asking.join(listed, "_asked")
        .where(F.col("_q_row") != F.col("m._row"))
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("m._id").alias("vec_id"), "score")
    )
