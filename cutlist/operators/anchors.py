"""Which of several intervals is the first, in list order, that holds a point: a table for bisection."""

from __future__ import annotations

import sys
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Travels to the workers with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPEN_START, OPEN_END = -(1 << 63), (1 << 63) - 1


def disjoint(intervals: list[tuple[int | None, int | None, int]]) -> tuple[list[int], list[int]]:
    """From (start, end, place), both inclusive or open, the points where the smallest place that holds changes, and it (or -1)."""
    begun = sorted(
        (OPEN_START if start is None else start, place, OPEN_END if end is None else end)
        for start, end, place in intervals
        if start is None or end is None or start <= end
    )
    points = sorted({start for start, _, _ in begun} | {end + 1 for _, _, end in begun if end < OPEN_END})
    breaks, firsts, holding, at = [], [], [], 0
    for point in points:
        while at < len(begun) and begun[at][0] <= point:
            heappush(holding, begun[at][1:])
            at += 1
        while holding and holding[0][1] < point:
            heappop(holding)
        first = holding[0][0] if holding else -1
        if not firsts or firsts[-1] != first:
            breaks.append(point)
            firsts.append(first)
    return breaks, firsts


def first_holding(rows: pa.Table) -> pa.Table:
    """The table of one project's anchors in one zone."""
    columns = (rows.column(c).to_pylist() for c in ("starts", "ends", "pos"))
    breaks, firsts = disjoint(list(zip(*columns)))
    many = pa.list_(pa.int64())
    return pa.table(
        {
            "project_id": rows.column("project_id").slice(0, 1),
            "zone": rows.column("zone").slice(0, 1),
            "breaks": pa.array([breaks], many),
            "firsts": pa.array([firsts], many),
        }
    )


def first_at_points(rows: pa.Table) -> pa.Table:
    """Of one slice the points (rows without ``_pos``) that an interval holds, and the smallest ``_pos`` that does."""
    asked = pc.is_null(rows.column("_pos"))
    points, intervals = rows.filter(asked), rows.filter(pc.invert(asked))
    breaks, firsts = disjoint(list(zip(*(intervals.column(c).to_pylist() for c in ("_from", "_to", "_pos")))))
    at = np.searchsorted(np.array(breaks, np.int64), points.column("_from").to_numpy(), side="right")
    first = np.array([-1, *firsts], np.int64)[at]
    held = pa.array(first >= 0)
    return pa.table({"project_id": points.column("project_id"), "_at": points.column("_at"), "_pos": pa.array(first)}).filter(held)
