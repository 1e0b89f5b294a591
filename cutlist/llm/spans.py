"""Spans in whole texts: (kind, start, stop) in code points, stop exclusive, ordered by start and then kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]
    )
)
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def span_array(listed: Sequence[Sequence[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in x] for x in listed], _ARROW)


def chunks(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text has a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def replace(text: str, spans: Sequence[tuple[str, int, int]], mark: Callable[[str], str]) -> str:
    """``text`` with spans replaced; of overlapping spans the first one's mark stands for all."""
    parts, done = [], 0
    for kind, start, stop in spans:
        if start >= done:
            parts += [text[done:start], mark(kind)]
        done = max(done, stop)
    return "".join(parts) + text[done:]


def redacted(texts: pa.Array, listed: Sequence[Sequence[tuple[str, int, int]]], mark: Callable[[str], str]) -> pa.Array:
    if not any(listed):
        return texts
    return pa.array([replace(t.as_py(), x, mark) if x else t.as_py() for t, x in zip(texts, listed)], texts.type)


def joined(spans: Column) -> Column:
    """kind:start:stop, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])
    return F.array_join(F.transform(spans, one), ",")


def of_kinds(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(list(kinds)))


def digest(spans: Column, kinds: Sequence[str]) -> dict[str, Column]:
    """n_<kind> for each kind, base_sha256 over these kinds alone, and all spans as text."""
    base = of_kinds(spans, kinds)
    counts = {f"n_{k}": F.size(of_kinds(spans, [k])).cast("long") for k in kinds}
    return {**counts, "base_sha256": F.sha2(joined(base).cast("binary"), 256), "spans": joined(spans)}
