"""Which of many ordered entries a greedy pass with skips can take at all.

A pass takes an entry if what has been taken and its need stay within a limit, and skips it otherwise. What has been
taken never shrinks, so an entry is only taken if every earlier one with no greater need has been, too. Where at most ``most``
are taken, an entry with ``most`` such before it is out. A slice of the entries is thinned out with no more state than the
``most`` smallest needs so far; thinned slices put together may be thinned again, and the pass over what is left
takes the same entries as the pass over all.

What is left grows with the logarithm of the entries where needs come in any order, and is bounded by ``most`` for
each distinct need where they fall all the way.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def reachable(needs: np.ndarray, most: int) -> np.ndarray:
    """Places of the entries that have fewer than ``most`` before them with no greater need."""
    kept, smallest = [], []
    for at, need in enumerate(needs.tolist()):
        if len(smallest) < most:
            heappush(smallest, -need)
        elif need < -smallest[0]:
            heapreplace(smallest, -need)
        else:
            continue
        kept.append(at)
    return np.array(kept, np.int64)


def thinned(order: str, need: str, most: str) -> Callable[[pa.Table], pa.Table]:
    """For groups with these columns: the reachable rows of a group, whose ``most`` is the same in every row."""

    def thin(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        limit = rows.column(most)[0].as_py() if rows.num_rows else 0
        return rows.take(pa.array(reachable(rows.column(need).to_numpy(), limit)))

    return thin
