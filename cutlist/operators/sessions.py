"""Grouping of ordered cues into sessions with a gap limit and a span limit.

Where a session ends depends on where it began, so neither ``lag`` nor ``session_window`` can say it.
The cues are range-partitioned by clip and time, and each slice is read once in order, batch by batch. A slice
reports how the session that enters it would leave it, as a step function of that session's start; a report has
at most one step per millisecond of the span limit, whatever the slice holds. Reports compose: those of some hundred
slices make one of the same bound, these are chained, and their entry states are handed back down. So one
clip may fill any number of slices and still be read in parallel, and nothing holds a slice's times.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlist.operators.ordered import SLICE, sliced, staged
from cutlist.params import DEFAULTS, CutParams

# The functions below travel to the workers with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLIP = ("project_id", "clip_path")
#: Slices whose reports are composed into one.
BLOCK = 256


class _State(NamedTuple):
    """Where reading stands in a clip: the last cue's end, the open session's start, number and first cue."""

    prev_end: int = 0
    cur: int = 0
    session_no: int = 0
    first: int = 0
    seen: int = 0


#: Later than any time; stands for a cue that opens a session whatever the one before.
_ALWAYS = np.iinfo(np.int64).max


def _jumps(starts: np.ndarray, values: np.ndarray, span: int) -> np.ndarray:
    """For a session begun at each cue the next cue that opens one: the first later value past its span, or the end."""
    n = len(starts)
    levels = [values]
    while 2 << (len(levels) - 1) < n:
        size, last = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.maximum(last, np.append(last[size:], np.full(min(size, len(last)), _ALWAYS))))
    at, limit = np.arange(1, n + 1), starts + span
    for level in reversed(range(len(levels))):
        size = 1 << level
        go = (at + size <= n) & (levels[level][np.minimum(at, n - 1)] <= limit)
        at = at + np.where(go, size, 0)
    return at


def _followed(jumps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a session begun at each cue: where the last session begins, and how many have begun until then."""
    n = len(jumps)
    last, more = np.where(jumps < n, jumps, np.arange(n)), (jumps < n).astype(np.int64)
    while (ahead := last[last] != last).any():
        more = more + np.where(ahead, more[last], 0)
        last = last[last]
    return last, more


def _reached(jumps: np.ndarray, first: int) -> np.ndarray:
    """All session starts from the one at ``first`` on."""
    n = len(jumps)
    jump, found = np.append(jumps, n), np.array([first])
    while jump[first] < n:
        found = np.concatenate([found, jump[found]])
        jump = jump[jump]
    return np.sort(found[found < n])


def _first_past(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For each limit the place of the first value beyond it, or their number."""
    return np.searchsorted(np.maximum.accumulate(values), limits, side="right")


class _Report:
    """How an unknown session that enters a run of one clip's cues leaves it; read on, batch by batch.

    ``ends`` rises; a session begun at ``s`` first breaks at the first j with ``ends[j] > s + span``, else
    at ``hard`` if there is one, else not. ``fresh`` is the case that the first cue opens a session. Each case has
    the ordinal (from 0) and start of the cue that opened the last session, and how many sessions followed the break.
    """

    def __init__(self, gap: int, span: int):
        self.gap, self.span = gap, span
        self.rows, self.first_start, self.last_end, self.top, self.open = 0, 0, 0, None, True
        self.ends = np.zeros(0, np.int64)
        #: Columns (at, cur, more): fresh, then hard where there is one, then the steps.
        self.cases = np.zeros((0, 3), np.int64)
        self.has_hard = False

    def read(self, starts: np.ndarray, ends: np.ndarray) -> None:
        if not len(starts):
            return
        hard = np.append(self.rows > 0 and starts[0] - self.last_end > self.gap, starts[1:] - ends[:-1] > self.gap)
        values = np.where(hard, _ALWAYS, ends)
        last, more = _followed(_jumps(starts, values, self.span))

        def begun(at: np.ndarray) -> np.ndarray:
            return np.stack([self.rows + last[at], starts[last[at]], more[at]], axis=1)

        if self.rows:
            at = _first_past(values, self.cases[:, 1] + self.span)
            hit = at < len(starts)
            moved = begun(at[hit])
            moved[:, 2] += self.cases[hit, 2] + 1
            self.cases[hit] = moved
        else:
            self.first_start = int(starts[0])
            self.cases = begun(np.array([0]))
        if self.open:
            until = int(hard.argmax()) if hard.any() else len(starts)
            before = np.append(np.iinfo(np.int64).min if self.top is None else self.top, ends[:until])
            steps = np.flatnonzero(ends[:until] > np.maximum.accumulate(before)[:-1])
            over = np.flatnonzero(ends[steps] > self.first_start + self.span)
            steps = steps[: over[0] + 1] if len(over) else steps
            self.add(ends[steps], begun(steps))
            if self.open and until < len(starts):
                self.close(begun(np.array([until])))
        self.rows, self.last_end = self.rows + len(starts), int(ends[-1])

    def add(self, ends: np.ndarray, cases: np.ndarray) -> None:
        """More steps, up to the first that any entering session breaks at."""
        if len(ends):
            self.ends, self.cases = np.append(self.ends, ends), np.concatenate([self.cases, cases])
            self.top = int(ends[-1])
            self.open = self.top <= self.first_start + self.span

    def close(self, hard: np.ndarray) -> None:
        self.cases, self.has_hard, self.open = np.insert(self.cases, 1, hard, axis=0), True, False

    def apply(self, prev_end: int, cur: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sessions begun at ``cur``: whether they break in this run, and the case they leave it by."""
        if self.first_start - prev_end > self.gap:
            return np.ones(len(cur), bool), np.repeat(self.cases[:1], len(cur), axis=0)
        at = np.searchsorted(self.ends, cur + self.span, side="right")
        steps = self.cases[1 + self.has_hard :]
        broken = (at < len(steps)) | self.has_hard
        return broken, np.where((at < len(steps))[:, None], steps[np.minimum(at, len(steps) - 1)], self.cases[int(self.has_hard)])

    def then(self, after: _Report) -> _Report:
        """This run and the one after it as one."""
        both = _Report(self.gap, self.span)
        both.first_start, both.top, both.open, both.has_hard = self.first_start, self.top, self.open, self.has_hard
        both.rows, both.last_end, both.ends = self.rows + after.rows, after.last_end, self.ends
        shift = np.array([self.rows, 0, 0])
        broken, left = after.apply(self.last_end, self.cases[:, 1])
        moved = left + shift
        moved[:, 2] += self.cases[:, 2] + 1
        both.cases = np.where(broken[:, None], moved, self.cases)
        if self.open:
            # A session that nothing has broken so far meets the other run as it is.
            if after.first_start - self.last_end > self.gap:
                both.close(after.cases[:1] + shift)
                return both
            new = after.ends > self.top
            ends, steps = after.ends[new], after.cases[1 + after.has_hard :][new] + shift
            over = np.flatnonzero(ends > self.first_start + self.span)
            keep = over[0] + 1 if len(over) else len(ends)
            both.add(ends[:keep], steps[:keep])
            if both.open and after.has_hard:
                both.close(after.cases[1:2] + shift)
        return both

    def fields(self) -> dict:
        steps = self.cases[1 + self.has_hard :]
        out = {"first_start": self.first_start, "first_end": self.last_end, "first_rows": self.rows, "step_end": self.ends}
        out.update({f"step_{name}": steps[:, n] for n, name in enumerate(_CASE)})
        hard = self.cases[1].tolist() if self.has_hard else [None] * 3
        out.update({f"hard_{name}": hard[n] for n, name in enumerate(_CASE)})
        out.update({f"fresh_{name}": int(self.cases[0, n]) for n, name in enumerate(_CASE)})
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in out.items()}

    @classmethod
    def of(cls, row, gap: int, span: int) -> _Report:
        self = cls(gap, span)
        self.first_start, self.last_end, self.rows = int(row.first_start), int(row.first_end), int(row.first_rows)
        self.ends = np.array(row.step_end, np.int64)
        self.top = int(self.ends[-1])
        self.has_hard = not pd.isna(row.hard_at)
        self.open = not self.has_hard and self.top <= self.first_start + span
        cases = [[getattr(row, f"{case}_{n}") for n in _CASE] for case in (("fresh", "hard") if self.has_hard else ("fresh",))]
        steps = np.stack([np.array(getattr(row, f"step_{n}"), np.int64) for n in _CASE], axis=1)
        self.cases = np.concatenate([np.array(cases, np.int64), steps])
        return self

    def fresh_state(self) -> _State:
        at, cur, more = self.cases[0].tolist()
        return _State(self.last_end, cur, 1 + more, at + 1, self.rows)

    def state_after(self, state: _State) -> _State:
        """What a clip's state becomes over this run."""
        broken, left = self.apply(state.prev_end, np.array([state.cur]))
        if not broken[0]:
            return state._replace(prev_end=self.last_end, seen=state.seen + self.rows)
        at, cur, more = left[0].tolist()
        return _State(self.last_end, cur, state.session_no + 1 + more, state.seen + at + 1, state.seen + self.rows)


_CASE = ("at", "cur", "more")


def _entry_steps(starts: list[int], ends: list[int], gap: int, span: int, batch: int | None = None) -> dict:
    """The report of a run of cues, read in batches of a size."""
    report = _Report(gap, span)
    size = batch or max(len(starts), 1)
    for at in range(0, len(starts), size):
        report.read(np.array(starts[at : at + size]), np.array(ends[at : at + size]))
    return report.fields()


_EDGE_FIELDS = [
    ("_slice", pa.int64()),
    ("first_key", pa.string()),
    ("last_key", pa.string()),
    ("whole", pa.bool_()),
    ("first_start", pa.int64()),
    ("first_end", pa.int64()),
    ("first_rows", pa.int64()),
    *[(f"last_{name}", pa.int64()) for name in _State._fields],
    *[(name, pa.list_(pa.int64())) for name in ("step_end", "step_at", "step_cur", "step_more")],
    *[(f"{case}_{name}", pa.int64()) for case in ("hard", "fresh") for name in ("at", "cur", "more")],
]
_EDGE_DDL = (
    "_slice bigint, first_key string, last_key string, whole boolean, first_start bigint, first_end bigint, "
    "first_rows bigint, last_prev_end bigint, last_cur bigint, last_session_no bigint, last_first bigint, "
    "last_seen bigint, step_end array<bigint>, step_at array<bigint>, step_cur array<bigint>, "
    "step_more array<bigint>, hard_at bigint, hard_cur bigint, hard_more bigint, fresh_at bigint, "
    "fresh_cur bigint, fresh_more bigint"
)
_CARRY_DDL = "_slice bigint, " + ", ".join(f"in_{name} bigint" for name in _State._fields)


def _columns(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    return batch.column("_key"), batch.column("start_ms").to_numpy(), batch.column("end_ms").to_numpy()


def _changes(keys: pa.Array, last: str | None) -> np.ndarray:
    """True where a row's clip is not the one before."""
    changed = np.ones(len(keys), dtype=bool)
    changed[0] = keys[0].as_py() != last
    changed[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return changed


def _read(new: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: _State, gap: int, span: int):
    """Session number, cue ordinal and place in the session of each cue, and the state after them."""
    n = len(starts)
    hard = new.copy()
    hard[1:] |= starts[1:] - ends[:-1] > gap
    hard[0] |= starts[0] - state.prev_end > gap
    values = np.where(hard, _ALWAYS, ends)
    first = int(_first_past(values, np.array([state.cur + span]))[0])
    opened = _reached(_jumps(starts, values, span), first) if first < n else np.zeros(0, np.int64)
    cur = int(starts[opened[-1]]) if len(opened) else state.cur
    opens = np.zeros(n, dtype=np.int64)
    opens[opened] = 1
    at, total = np.arange(n), np.cumsum(opens)
    clip_at = np.maximum.accumulate(np.where(new, at, -1))
    session_at = np.maximum.accumulate(np.where(opens == 1, at, -1))
    seen = np.where(clip_at < 0, state.seen + at + 1, at - clip_at + 1)
    numbers = total + np.where(clip_at < 0, state.session_no, 1 - total[clip_at])
    places = np.where(session_at < 0, seen - state.first, at - session_at)
    after = _State(int(ends[-1]), cur, int(numbers[-1]), int(seen[-1] - places[-1]), int(seen[-1]))
    return numbers, seen, places, after


def _read_edges(gap: int, span: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_key = key = number = None
        whole, state, report = True, _State(), _Report(gap, span)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, starts, ends = _columns(batch)
            new = _changes(keys, key)
            if first_key is None:
                first_key, number = keys[0].as_py(), batch.column(SLICE)[0].as_py()
                inner = np.flatnonzero(new[1:]) + 1
            else:
                inner = np.flatnonzero(new)
            if whole and not len(inner):
                report.read(starts, ends)
            else:
                # Only the clip that leaves the slice is read through; those that end inside it need no report.
                whole = False
                at = int(inner[-1]) if len(inner) else 0
                state = _read(new[at:], starts[at:], ends[at:], state, gap, span)[-1]
            key = keys[len(keys) - 1].as_py()
        if first_key is not None:
            if whole:
                state = report.fresh_state()
            row = {"_slice": number, "first_key": first_key, "last_key": key, "whole": whole}
            row.update({f"last_{name}": value for name, value in state._asdict().items()})
            yield pa.RecordBatch.from_pylist([row | (report.fields() if whole else {})], schema=pa.schema(_EDGE_FIELDS))

    return read


def _last_state(row) -> _State:
    return _State(*(int(getattr(row, f"last_{name}")) for name in _State._fields))


def _state_after(row, continued: bool, state: _State | None, gap: int, span: int) -> _State:
    """The state that leaves a slice or block, given the one that enters it."""
    return _Report.of(row, gap, span).state_after(state) if continued and row.whole else _last_state(row)


def _composed(gap: int, span: int):
    """One report for a block of consecutive slices."""

    def compose(edges: pd.DataFrame) -> pd.DataFrame:
        first = key = state = report = None
        for e in edges.sort_values("_slice").itertuples(index=False):
            own = _Report.of(e, gap, span) if e.whole else None
            if first is None:
                first, report, state = e, own, _last_state(e)
            elif key != e.first_key or not e.whole:
                report, state = None, _last_state(e)
            else:
                report, state = report and report.then(own), own.state_after(state)
            key = e.last_key
        row = {"_slice": first[0] // BLOCK, "first_key": first.first_key, "last_key": key, "whole": report is not None}
        row.update({f"last_{name}": value for name, value in state._asdict().items()})
        row.update(report.fields() if report else {})
        frame = pd.DataFrame([{name: row.get(name) for name, _ in _EDGE_FIELDS}])
        return frame.astype({name: "Int64" for name, kind in _EDGE_FIELDS if kind == pa.int64()})

    return compose


def _chain(gap: int, span: int):
    """Entry state of every slice or block that continues a clip, from reports in order and the state that enters the first."""

    def chain(edges: pd.DataFrame) -> pd.DataFrame:
        out, key, state = [], None, None
        for e in edges.sort_values("_slice").itertuples(index=False):
            if key is None and not pd.isna(e.in_prev_end):
                key, state = e.first_key, _State(*(int(getattr(e, f"in_{name}")) for name in _State._fields))
            continued = key == e.first_key
            if continued:
                out.append((e[0], *state))
            state, key = _state_after(e, continued, state, gap, span), e.last_key
        return pd.DataFrame(out, columns=["_slice", *[f"in_{name}" for name in _State._fields]]).astype("int64")

    return chain


def _number_cues(gap: int, span: int):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, _State(), False
        for batch in batches:
            kept = [c for c in batch.schema.names if c not in ("_key", SLICE) and not c.startswith("in_")]
            arrays = [batch.column(c) for c in kept]
            if batch.num_rows:
                keys, starts, ends = _columns(batch)
                if not begun:
                    begun = True
                    entry = [batch.column(f"in_{name}")[0].as_py() for name in _State._fields]
                    if entry[0] is not None:
                        key, state = keys[0].as_py(), _State(*entry)
                *numbered, state = _read(_changes(keys, key), starts, ends, state, gap, span)
                key = keys[len(keys) - 1].as_py()
            else:
                numbered = [[], [], []]
            arrays += [pa.array(x, pa.int64()) for x in numbered]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + ["session_no", "cue_ordinal", "place"])

    return number


def sessionize(cues: DataFrame, params: CutParams = DEFAULTS, slices: int | None = None) -> DataFrame:
    """Number the cues of every clip.

    Adds ``session_no`` (from 1 per clip), ``cue_ordinal`` (from 1 per clip) and ``place`` (from 0 within
    the session). A cue opens a session when it starts more than ``group_gap_ms`` after the previous cue's
    end or ends more than ``group_span_ms`` after the session's start.
    """
    limits = (params.group_gap_ms, params.group_span_ms)
    order = [F.col("start_ms"), F.col("end_ms"), F.col("cue_no")]
    cut = sliced(cues, CLIP, order, slices, sort=True).withColumn(SLICE, F.col(SLICE).cast("bigint"))
    keyed = cut.withColumn("_key", F.concat_ws("/", *CLIP))
    # Reports are read twice, by the blocks and by their slices.
    edges = staged(keyed.select(SLICE, "_key", "start_ms", "end_ms").mapInArrow(_read_edges(*limits), _EDGE_DDL))
    block = F.expr(f"{SLICE} div {BLOCK}").alias("_block")
    entry = [F.lit(None).cast("bigint").alias(f"in_{name}") for name in _State._fields]
    blocks = edges.groupBy(block).applyInPandas(_composed(*limits), _EDGE_DDL)
    # One report per block of slices is chained here, whatever they hold.
    entered = blocks.select("*", *entry).groupBy().applyInPandas(_chain(*limits), _CARRY_DDL).withColumnRenamed(SLICE, "_block")
    inside = edges.select("*", block).join(F.broadcast(entered), "_block", "left")
    carried = inside.select(*edges.columns, *[f"in_{name}" for name in _State._fields], "_block").groupBy("_block")
    carried = carried.applyInPandas(_chain(*limits), _CARRY_DDL)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cues.schema)
    return keyed.join(F.broadcast(carried), SLICE, "left").mapInArrow(
        _number_cues(*limits), schema + ", session_no bigint, cue_ordinal bigint, place bigint"
    )
