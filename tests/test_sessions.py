"""Sessions against a plain loop, with boundary gaps and spans and with one clip over many slices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutlist.operators.cues import (
    cue_groups,
    explode_transcripts,
    frame_plan,
    merge_short,
    milliseconds,
    normalize_cues,
    rejected_cues,
    segment_bounds,
    session_groups,
)
from cutlist.operators import sessions
from cutlist.operators.sessions import _entry_steps, _jumps, _Report, _State, sessionize
from cutlist.schemas import CLIP_RESULT

CUE = "project_id bigint, clip_path string, cue_no bigint, start_ms bigint, end_ms bigint, text string"
CLIP = (
    "project_id bigint, clip_path string, filename string, duration_ms bigint"
)


def loop(rows):
    """(clip, cue) to session number, and merged groups per clip."""
    clips = {}
    for r in rows:
        clips.setdefault(r[:2], []).append((r[3], r[4], r[2], r[5]))
    numbers, merged = {}, {}
    for clip, cues in clips.items():
        cues.sort()
        groups = []
        for start, end, no, text in cues:
            if groups and start - groups[-1][1] <= 2400 and end - groups[-1][0] <= 18000:
                groups[-1][1] = end
                groups[-1][2].append(text)
            else:
                groups.append([start, end, [text]])
            numbers[clip, no] = len(groups)
        folded = []
        for start, end, texts in groups:
            if folded and end - start < 2000:
                folded[-1][1] = end
                folded[-1][2] += texts
            else:
                folded.append([start, end, list(texts)])
        merged[clip] = [(s, e, len(t), " ".join(t)[:500].strip()) for s, e, t in folded]
    return numbers, merged


def random_cues(seed):
    rng = random.Random(seed)
    rows = []
    for clip in range(12):
        t = 0
        for i in range(500 if clip == 4 else rng.randint(1, 30)):
            t += rng.choice([0, 0, 300, 700, 1200]) if clip == 4 else rng.choice([0, 100, 900, 2400, 2600, 5000])
            length = rng.choice([200, 1000, 1900, 2000, 19000 if clip % 5 == 0 else 2500])
            rows.append((clip % 3, f"/c{clip}.mp4", i, t, t + length, f"word{clip}_{i}"))
    return rows


@pytest.mark.parametrize("slices", [None, 3, 23])
def test_sessions_equal_loop(spark, slices):
    rows = random_cues(slices or 0)
    numbers, merged = loop(rows)
    cues = spark.createDataFrame(rows, CUE)
    got = sessionize(cues, slices=slices).collect()
    assert {((r.project_id, r.clip_path), r.cue_no): r.session_no for r in got} == numbers
    groups = {}
    for r in sorted(cue_groups(cues, slices=slices).collect(), key=lambda r: r.group_index):
        groups.setdefault((r.project_id, r.clip_path), []).append((r.start_ms, r.end_ms, r.n_cues, r.excerpt))
    assert groups == merged


@pytest.mark.parametrize("slices, batch", [(1, 7), (4, 16), (9, 1)])
def test_state_passes_between_batches(spark, slices, batch):
    """A slice arrives in several Arrow batches, and clips and sessions go on from one to the next."""
    rows = random_cues(40 + batch)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, batch)
        got = sessionize(spark.createDataFrame(rows, CUE), slices=slices).collect()
    finally:
        spark.conf.set(name, before)
    numbers, _ = loop(rows)
    assert {((r.project_id, r.clip_path), r.cue_no): r.session_no for r in got} == numbers
    by_clip = {}
    for r in sorted(got, key=lambda r: (r.start_ms, r.end_ms, r.cue_no)):
        by_clip.setdefault((r.project_id, r.clip_path), []).append(r)
    for cues in by_clip.values():
        assert [r.cue_ordinal for r in cues] == list(range(1, len(cues) + 1))
        opened = {}
        for r in cues:
            opened.setdefault(r.session_no, r.cue_ordinal)
            assert r.place == r.cue_ordinal - opened[r.session_no]


def test_entry_steps_tell_every_exit():
    """The step function gives the exit state for any entering session."""
    rng = random.Random(9)
    for _ in range(200):
        t, starts, ends = 1000, [], []
        for _ in range(rng.randint(1, 25)):
            t += rng.choice([0, 1, 40, 200, 900])
            starts.append(t)
            ends.append(t + rng.choice([3, 50, 100, 300, 700]))
        gap, span = rng.choice([100, 500, 10**9]), rng.choice([150, 400, 1500])
        steps = _entry_steps(starts, ends, gap, span, rng.choice([None, 1, 2, 7]))
        parts = sorted(rng.sample(range(1, len(starts)), rng.randint(0, min(4, len(starts) - 1))))
        reports = []
        for a, b in zip([0, *parts], [*parts, len(starts)]):
            reports.append(_Report(gap, span))
            reports[-1].read(np.array(starts[a:b]), np.array(ends[a:b]))
        while len(reports) > 1:
            # In any order of composing neighbours.
            at = rng.randrange(len(reports) - 1)
            reports[at : at + 2] = [reports[at].then(reports[at + 1])]
        assert reports[0].fields() == steps
        for entry in range(max(0, starts[0] - span - 60), starts[0] + 1, 7):
            cur, number, first, prev_end = entry, 1, 1, starts[0]
            for seen, (start, end) in enumerate(zip(starts, ends), 2):
                if start - prev_end > gap or end - cur > span:
                    cur, number, first = start, number + 1, seen
                prev_end = end
            j = next((j for j, e in enumerate(steps["step_end"]) if e > entry + span), None)
            if j is not None:
                want = (steps["step_cur"][j], 2 + steps["step_more"][j], 2 + steps["step_at"][j])
            elif steps["hard_at"] is not None:
                want = (steps["hard_cur"], 2 + steps["hard_more"], 2 + steps["hard_at"])
            else:
                want = (entry, 1, 1)
            assert (cur, number, first) == want


def test_jumps_equal_a_search():
    rng = random.Random(3)
    for n in range(1, 40):
        starts = np.cumsum([rng.choice([0, 1, 30]) for _ in range(n)])
        values = np.array([s + rng.choice([1, 20, 90, 10**9]) for s in starts])
        want = [next((j for j in range(k + 1, n) if values[j] > starts[k] + 50), n) for k in range(n)]
        assert _jumps(starts, values, 50).tolist() == want


def test_reports_are_bounded_by_the_span():
    """A million cues of one clip, in 1 and in 50 slices: a report has no more steps than milliseconds in the span."""
    pick = np.random.default_rng(5)
    starts = np.cumsum(pick.integers(0, 4, 1_000_000))
    ends = starts + pick.integers(1, 5_000, 1_000_000)
    span, whole = 18_000, None
    for slices in (1, 50):
        reports = []
        for a, b in zip(np.array_split(starts, slices), np.array_split(ends, slices)):
            report = _Report(2400, span)
            for at in range(0, len(a), 10_000):
                report.read(a[at : at + 10_000], b[at : at + 10_000])
                assert len(report.ends) <= span and report.cases.shape == (1 + report.has_hard + len(report.ends), 3)
            reports.append(report)
        one = reports[0]
        for report in reports[1:]:
            one = one.then(report)
            assert len(one.ends) <= span
        whole = whole or one.fields()
        assert one.fields() == whole
        state = _State(int(starts[0]) - 100, int(starts[0]) - 900, 3, 7, 9)
        passed = state
        for report in reports:
            passed = report.state_after(passed)
        assert passed == one.state_after(state)


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_of_slices_hand_states_down(spark, monkeypatch, block):
    rows = random_cues(70 + block)
    numbers, _ = loop(rows)
    monkeypatch.setattr(sessions, "BLOCK", block)
    got = sessionize(spark.createDataFrame(rows, CUE), slices=29).collect()
    assert {((r.project_id, r.clip_path), r.cue_no): r.session_no for r in got} == numbers


def one_clip(spark, spans):
    return spark.createDataFrame([(1, "/a.mp4", i, s, e, f"t{i}") for i, (s, e) in enumerate(spans)], CUE)


def bounds(groups):
    return sorted((r.start_ms, r.end_ms) for r in groups.collect())


@pytest.mark.parametrize(
    "spans, want",
    [
        ([(0, 3000), (5400, 9000)], [(0, 9000)]),  # gap of exactly 2.4 s
        ([(0, 3000), (5401, 9000)], [(0, 3000), (5401, 9000)]),
        ([(0, 9000), (9000, 18000)], [(0, 18000)]),  # span of exactly 18 s
        ([(0, 9000), (9000, 18001)], [(0, 9000), (9000, 18001)]),
        ([(0, 9000), (1000, 4000)], [(0, 4000)]),  # the last cue's end counts, not the latest
        ([(0, 25000), (100, 3000)], [(0, 3000)]),  # one long cue is a session, and a short one may join it
    ],
)
def test_session_limits(spark, spans, want):
    assert bounds(session_groups(one_clip(spark, spans))) == want


def test_short_groups_fold_into_the_one_before(spark):
    cues = one_clip(spark, [(0, 500), (4000, 4500), (8000, 9999), (20000, 22000), (30000, 30500)])
    got = merge_short(session_groups(cues)).orderBy("group_index").collect()
    # The first stays although it is short; 2.0 s is long enough.
    assert [(r.start_ms, r.end_ms, r.n_cues) for r in got] == [(0, 9999, 3), (20000, 30500, 2)]


def test_normalization(spark):
    rows = [
        (0, 199, "a"), (0, 200, "b"), (None, 900, "c"), (300, 900, ""), (300, 900, "  "), (-500, 100, " d "),
        (-900, -200, "e"), (300, 900, None), (500, None, "f"),
    ]
    cues = spark.createDataFrame([(1, "/a", i, s, e, t) for i, (s, e, t) in enumerate(rows)], CUE)
    got = [(r.start_ms, r.end_ms, r.text) for r in normalize_cues(cues).orderBy("text").collect()]
    assert got == [(0, 200, "b"), (0, 100, "d")]


def test_raw_cue_numbers(spark):
    raw = [("1.5", "3"), ("nan", "3"), ("1.0d", "3"), (None, "2"), ("1", None), (" 1e1 ", "12"), ("1_0", "12"), ("inf", "1")]
    result = {
        "project_id": 1, "clip_path": "/a", "transcript": [{"start": s, "end": e, "text": "x"} for s, e in raw],
    }
    cues = explode_transcripts(spark.createDataFrame([result], CLIP_RESULT)).orderBy("cue_no").collect()
    assert [(c.cue_no, c.start_ms, c.end_ms) for c in cues] == [(0, 1500, 3000), (3, 0, 2000), (4, 1000, 1000), (5, 10000, 12000)]
    value = spark.range(1).select(milliseconds(F.lit(float("nan"))).alias("x")).first().x
    assert value is None


def test_late_cues_stay(spark):
    """Any number of seconds that fits counts; what does not fit is told."""
    raw = [("2e12", "2000000000001.5"), ("1e300", "1"), ("5", "inf"), ("3", "4")]
    result = {"project_id": 1, "clip_path": "/a", "transcript": [{"start": s, "end": e, "text": "x"} for s, e in raw]}
    frame = spark.createDataFrame([result], CLIP_RESULT)
    cues = explode_transcripts(frame).orderBy("cue_no").collect()
    assert [(c.cue_no, c.start_ms, c.end_ms) for c in cues] == [(0, 2 * 10**15, 2 * 10**15 + 1500), (3, 3000, 4000)]
    assert [(c.cue_no, c.start, c.end) for c in rejected_cues(frame).orderBy("cue_no").collect()] == [(1, "1e300", "1"), (2, "5", "inf")]


def test_segment_bounds(spark):
    groups = spark.createDataFrame(
        [(1, "/short", 1, 200, 900), (1, "/past", 1, 40000, 41000), (1, "/mid", 1, 5000, 6000), (1, "/gone", 1, 0, 5)],
        "project_id bigint, clip_path string, group_index bigint, start_ms bigint, end_ms bigint",
    )
    clips = spark.createDataFrame(
        [(1, "/short", "s", 1500), (1, "/past", "p", 30000), (1, "/mid", "m", 30000)], CLIP
    )
    got = {r.clip_path: (r.start_ms, r.end_ms, r.duration_ms) for r in segment_bounds(groups, clips).collect()}
    assert got == {"/short": (0, 1500, 1500), "/past": (39650, 30000, -9650), "/mid": (4650, 6850, 2200)}


def test_frame_plan(spark):
    segments = spark.createDataFrame([("a", 1000, 4000), ("b", 500, -20)], "id string, start_ms bigint, duration_ms bigint")
    got = [(r.id, r.frame_no, r.at_ms) for r in frame_plan(segments).orderBy("id", "frame_no").collect()]
    assert got == [("a", 1, 1720), ("a", 2, 3000), ("a", 3, 4280), ("b", 1, 500), ("b", 2, 500), ("b", 3, 500)]


def test_long_session_fills_the_excerpt(spark):
    cues = spark.createDataFrame([(1, "/a", i, i, i + 300, "x") for i in range(700)], CUE)
    (row,) = session_groups(cues, slices=5).collect()
    assert row.n_cues == 700 and row.excerpt == "x " * 250


def test_long_group_fills_the_excerpt(spark):
    cues = spark.createDataFrame([(1, "/a", i, i * 3000, i * 3000 + 300, "x") for i in range(700)], CUE)
    (row,) = cue_groups(cues, slices=5).collect()
    assert row.n_cues == 700 and row.excerpt == ("x " * 250).strip()
