"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector, block against block. A scoring pass does not return scores but, for each
query, how many fall into each of ``BINS`` equal bins of the range that is still open. The sums over all blocks show
in which bin the kth best score lies; that bin is the next pass's range, until it is a single score or holds few
enough. The last pass returns what reaches the threshold found, and ties are broken by id.

A block reports its upper bins only, down to the one that holds its own kth best: the kth best of all is at least as
good, so every bin that matters is reported by all blocks. For the same reason a block returns at most k of its rows
above the threshold for a query. Neither loses a result.

Pairs of blocks come from a join of the stated query set with all rows, in packed blocks of ``BLOCK`` vectors;
its output is a row per pair of blocks. Nothing is broadcast or collected but the number of open queries.

Components become floor(scale * x) in double precision, as long integers. Scores are exact while they fit a long.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part, as query or candidate.
Vectors of another length than the query's are no candidates. Rows with equal ids are separate rows: each is a candidate
for the other. Rows with a null id take no part. With fewer candidates than k a query has that many results, with none
it has no row. Other columns are not looked at. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutlist.llm.common import staged
from cutlist.llm.vectors import matrices, usable

BINS = 64
BLOCK = 1024
#: A bin that leaves at most this many times k results is not refined further.
ENOUGH = 4
_KINDS = ("int8", "int16", "int32", "int64")


def _packed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of (_vector, long columns...) with the smallest integer type that holds the components."""
    for batch in batches:
        out: dict[str, list] = {name: [] for name in schema.names}
        for where, matrix in matrices(batch.column(0)):
            for at in range(0, len(where), BLOCK):
                part, own = matrix[at : at + BLOCK], where[at : at + BLOCK]
                most = max(-int(part.min()), int(part.max()))
                kind = next((k for k in _KINDS if most < np.iinfo(k).max), "int64")
                out["matrix"].append(part.astype(kind).tobytes())
                out["size"].append(part.shape[1])
                out["kind"].append(kind)
                for name, column in zip(schema.names[3:], batch.columns[1:]):
                    out[name].append(column.to_numpy()[own].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def pack(rows: DataFrame, *longs: str, prefix: str = "") -> DataFrame:
    """Blocks of ``_vector`` and the named long columns."""
    schema = T.StructType().add(f"{prefix}matrix", "binary").add(f"{prefix}size", "integer").add(f"{prefix}kind", "string")
    for name in longs:
        schema = schema.add(f"{prefix}{name.lstrip('_')}", "binary")
    arrow = to_arrow_schema(schema)
    plain = pa.schema([f.with_name(f.name.removeprefix(prefix)) for f in arrow])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in _packed(batches, plain):
            yield pa.RecordBatch.from_arrays(made.columns, schema=arrow)

    return rows.select("_vector", *longs).mapInArrow(task, schema)


def _scores(pair: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, query ids, candidate rows, candidate ids and the matrix of scores of a pair of blocks."""
    q = np.frombuffer(pair["q_matrix"], pair["q_kind"]).reshape(-1, pair["q_size"])
    c = np.frombuffer(pair["matrix"], pair["kind"]).reshape(-1, pair["size"])
    bound = q.shape[1] * float(np.abs(q.astype(np.float64)).max()) * float(np.abs(c.astype(np.float64)).max())
    exact = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    scores = (q.astype(exact) @ c.astype(exact).T).astype(np.int64)
    long = lambda name: np.frombuffer(pair[name], np.int64)
    return long("q_row"), long("q_id"), long("row"), long("id"), scores


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            pair = batch.slice(at, 1).to_pylist()[0]
            if pair["q_size"] == pair["size"]:
                yield pair


def _histograms(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for pair in _pairs(batches):
        q_rows, _, rows, _, scores = _scores(pair)
        low, width, above = (np.frombuffer(pair[n], np.int64) for n in ("q_low", "q_width", "q_above"))
        bins = (scores - low[:, None]) // width[:, None]
        outside = (bins < 0) | (bins >= BINS) | (q_rows[:, None] == rows[None, :])
        bins += np.arange(len(q_rows))[:, None] * BINS
        counts = np.bincount(bins[~outside], minlength=len(q_rows) * BINS).reshape(-1, BINS)
        better = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        query, bin_ = np.nonzero((counts > 0) & (better + above[:, None] < k))
        yield pa.RecordBatch.from_pydict({"_row": q_rows[query], "bin": bin_.astype(np.int64), "n": counts[query, bin_].astype(np.int64)})


def _winners(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for pair in _pairs(batches):
        q_rows, q_ids, rows, ids, scores = _scores(pair)
        low = np.frombuffer(pair["q_low"], np.int64)
        good = (scores >= low[:, None]) & (q_rows[:, None] != rows[None, :])
        query, at = np.nonzero(good)
        order = np.lexsort((rows[at], ids[at], -scores[query, at], query))
        query, at = query[order], at[order]
        first = np.searchsorted(query, query)  # rank within the query's own run
        best = np.arange(len(query)) - first < k
        query, at = query[best], at[best]
        yield pa.RecordBatch.from_pydict(
            {"_row": q_rows[query], "query_id": q_ids[query], "_other": rows[at], "vec_id": ids[at], "score": scores[query, at]}
        )


def top_k(table: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of ``table`` but itself.

    ``queries`` is a condition over the id column that says which rows are queries.
    """
    floor = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = staged(
        table.where(usable(F.col(vector)) & F.col(row_id).isNotNull()).select(
            F.monotonically_increasing_id().alias("_row"), F.col(row_id).cast("long").alias("_id"),
            F.coalesce(queries, F.lit(False)).alias("_query"), floor.alias("_vector"),
        )
    )
    candidates = staged(pack(rows, "_row", "_id"))
    asked = rows.where("_query")
    squares = F.aggregate("_vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = rows.agg(F.max(F.sqrt(squares))).first()[0]  # one number

    def pairs(state: DataFrame) -> DataFrame:
        """The stated queries against all rows, a row per pair of blocks."""
        open_ = asked.join(state, "_row")
        return pack(open_, "_row", "_id", "low", "width", "above", prefix="q_").crossJoin(candidates)

    # No score is beyond the product of the two lengths.
    reach = F.least(F.ceil(F.sqrt(squares) * F.lit(longest or 0.0) * (1 + 1e-9)) + 1, F.lit(1 << 61))
    state = staged(
        asked.select(
            "_row", (-reach).cast("long").alias("low"), (F.floor(reach * 2 / BINS) + 1).cast("long").alias("width"),
            F.lit(0).cast("long").alias("above"), F.lit(True).alias("open"),
        )
    )
    for _ in range(math.ceil(math.log(1 << 63, BINS)) + 1):
        if not state.where("open").limit(1).count():
            break
        counted = pairs(state.where("open")).mapInArrow(
            lambda batches: _histograms(batches, k), "_row long, bin long, n long"
        )
        state = staged(_narrowed(state, counted.groupBy("_row", "bin").agg(F.sum("n").alias("n")), k))
    found = pairs(state).mapInArrow(
        lambda batches: _winners(batches, k), "_row long, query_id long, _other long, vec_id long, score long"
    )
    nth = Window.partitionBy("_row").orderBy(F.col("score").desc(), "vec_id", "_other")
    return (
        found.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def _narrowed(state: DataFrame, sums: DataFrame, k: int) -> DataFrame:
    """Each open query's range after a pass: the bin that holds its kth best, or all below if there are fewer."""
    down = Window.partitionBy("_row").orderBy(F.col("bin").desc())
    at = (
        sums.withColumn("upto", F.sum("n").over(down))
        .join(state.select("_row", "above"), "_row")
        .where(F.col("upto") + F.col("above") >= k)
        .groupBy("_row")
        .agg(F.max(F.struct("bin", "n", "upto")).alias("at"))
    )
    new = state.join(at, "_row", "left")
    hit, is_open = F.col("at").isNotNull(), F.col("open")
    few = F.col("above") + F.col("at.upto") <= ENOUGH * k
    refine = (F.col("width") > 1) & ~few
    finer = F.floor((F.col("width") - 1) / BINS) + 1
    # The new range ends where the bin does: what is above it has been counted.
    top = F.col("low") + (F.col("at.bin") + 1) * F.col("width")
    low = F.when(is_open & hit & refine, top - BINS * finer).when(is_open & hit, top - F.col("width")).otherwise(F.col("low"))
    return new.select(
        "_row",
        low.cast("long").alias("low"),
        F.when(is_open & hit & refine, finer).otherwise(F.col("width")).cast("long").alias("width"),
        F.when(is_open & hit, F.col("above") + F.col("at.upto") - F.col("at.n")).otherwise(F.col("above")).alias("above"),
        # A query with fewer candidates than k takes all of them.
        (is_open & hit & refine).alias("open"),
    )
