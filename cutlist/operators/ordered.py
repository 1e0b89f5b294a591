"""Ordered scans that stay exact and balanced when one key holds most of the rows.

A window over ``partitionBy(key)`` puts a whole key into one task. Here a key is cut into contiguous
pieces, as many as ``slices`` or the session's shuffle partitions, each piece is read in order or windowed by itself, and what
the earlier pieces add up to is joined back from a table with one row per piece.
"""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

# Travels to the workers with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE = "_slice"


def staged(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster the files have to
    outlive the executor that wrote them.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="cutlist-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def sliced(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: int | None = None, sort: bool = False
) -> DataFrame:
    """Cut ``df`` into contiguous ranges of (keys, order) and fix the range number as ``_slice``.

    The cut points come from a sample of the rows, so a hot key is spread over many slices. The result
    is staged because every reader has to see the same cut points. ``order`` must be unique per key.
    """
    cols = [F.col(k) for k in keys] + list(order)
    ranged = df.repartitionByRange(slices, *cols) if slices else df.repartitionByRange(*cols)
    if sort:
        ranged = ranged.sortWithinPartitions(*cols)
    return staged(ranged.withColumn(SLICE, F.spark_partition_id()))


def _numbered(keys: Sequence[str], keep: int, values: Sequence[str], schema: pa.Schema):
    """Number the rows of sorted batches by key and add up ``values``; the state is one row's key, number and sums."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, np.zeros(1 + len(values), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(k) for k in keys]
            new = np.zeros(n, bool)
            for c in columns:
                same = pc.equal(c.slice(1), c.slice(0, n - 1)).fill_null(False)
                both = pc.and_(c.slice(1).is_null(), c.slice(0, n - 1).is_null())
                new[1:] |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
            first = [c[0].as_py() for c in columns]
            if first != last:
                new[0], before = True, np.zeros(1 + len(values), np.int64)
            begun = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            added = []
            for i, name in enumerate(("", *values)):
                each = np.ones(n, np.int64) if not i else batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)
                sums = np.concatenate([[0], np.cumsum(each)])
                added.append(sums[1:] - np.where(begun < 0, -before[i], sums[np.maximum(begun, 0)]))
            last, before = [c[n - 1].as_py() for c in columns], np.array([a[-1] for a in added])
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *(pa.array(a, pa.int64()) for a in added)], schema=schema)

    return number


def with_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    ordinal: str,
    sums: Mapping[str, Column] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add a dense 1-based ``ordinal`` per key and inclusive running ``sums`` of whole numbers; keeps ``_slice`` as a salt.

    Rows move once, into ranges, where they are sorted and numbered as they stand. A null counts as 0 in a sum.
    """
    sums = dict(sums or {})
    cut = df.select("*", *[v.cast("bigint").alias(f"_v_{k}") for k, v in sums.items()])
    cut = sliced(cut, keys, order, slices, sort=True).select(*df.columns, SLICE, *[f"_v_{k}" for k in sums])
    values = {ordinal: F.lit(1).cast("bigint"), **{k: F.col(f"_v_{k}") for k in sums}}
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # A slice continues at most one key, its first, so this has no more rows than there are slices.
    carried = (
        cut.groupBy(*keys, SLICE)
        .agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"_c_{k}") for k, v in values.items()])
        .select(*keys, SLICE, *[F.sum(f"_c_{k}").over(earlier).alias(f"_c_{k}") for k in values])
        .filter(F.col(f"_c_{ordinal}").isNotNull())
    )
    kept = len(df.columns) + 1
    shape = StructType(cut.schema.fields[:kept])
    for k in values:
        shape = shape.add(f"_l_{k}", LongType())
    local = cut.mapInArrow(_numbered(keys, kept, [f"_v_{k}" for k in sums], to_arrow_schema(shape)), shape)
    same = [local[k].eqNullSafe(carried[k]) for k in keys] + [local[SLICE] == carried[SLICE]]
    return local.join(F.broadcast(carried), same, "left").select(
        *[local[c] for c in df.columns],
        local[SLICE],
        *[(F.col(f"_l_{k}") + F.coalesce(F.col(f"_c_{k}"), F.lit(0))).alias(k) for k in values],
    )


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    bucket: int = 65536,
) -> DataFrame:
    """Add inclusive running sums and maxima in the order of a dense ``ordinal``.

    A dense ordinal divides evenly, so ``ordinal div bucket`` bounds every window partition. ``df`` is read
    twice, by the windows and by the bucket totals; stage it where it is costly to compute.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    folds = {**{k: (F.sum, v) for k, v in sums.items()}, **{k: (F.max, v) for k, v in maxima.items()}}
    cut = df.select(
        "*",
        F.floor(F.col(ordinal) / bucket).alias("_bucket"),
        *[v.alias(f"_v_{k}") for k, (_, v) in folds.items()],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*keys, "_bucket")
        .agg(*[f(f"_v_{k}").alias(f"_c_{k}") for k, (f, _) in folds.items()], F.min(ordinal).alias("_from"))
        .select(
            *keys,
            "_bucket",
            F.min("_from").over(earlier).alias("_from"),
            *[f(f"_c_{k}").over(earlier).alias(f"_c_{k}") for k, (f, _) in folds.items()],
        )
        .filter(F.col("_from").isNotNull())
        .drop("_from")
    )
    local = cut.select(
        *df.columns, "_bucket", *[f(f"_v_{k}").over(inside).alias(f"_l_{k}") for k, (f, _) in folds.items()]
    )
    joined = local.join(carried, [*keys, "_bucket"], "left")
    out = []
    for k in folds:
        mine, before = F.col(f"_l_{k}"), F.col(f"_c_{k}")
        if k in sums:
            out.append((F.coalesce(mine, F.lit(0)) + F.coalesce(before, F.lit(0))).alias(k))
        else:
            out.append(F.greatest(mine, before).alias(k))
    return joined.select(*df.columns, *out)
