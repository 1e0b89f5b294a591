"""Budgeted selection against a plain loop, roles and reasons."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutlist.operators.greedy import reachable
from cutlist.operators.selection import choose, day_budgets, infer_role, select_segments, selection_reason
from cutlist.params import CutParams

POOL = "project_id bigint, date_key string, candidate_id string, priority bigint, source_utc bigint, start_ms bigint, duration_ms bigint"
BUDGET = "project_id bigint, date_key string, budget_ms bigint"


def loop(rows, budgets, over=118):
    days, out = {}, set()
    for r in rows:
        days.setdefault(r[:2], []).append(r)
    for day, entries in days.items():
        entries.sort(key=lambda r: (-r[3], r[4], r[5], r[2]))
        used = count = 0
        for r in entries:
            length = max(0, r[6])
            if count and (used + length) * 100 > budgets[day] * over:
                continue
            out.add((day, r[2]))
            used, count = used + length, count + 1
            if used >= budgets[day] and count >= (2 if len(entries) >= 3 else 1):
                break
    return out


def chosen(df):
    return {((r.project_id, r.date_key), r.candidate_id) for r in df.collect()}


@pytest.mark.parametrize("slices", [None, 17])
def test_choice_equals_loop(spark, slices):
    rng = random.Random(slices or 0)
    rows, budgets = [], {}
    for d in range(120):
        budget = budgets[d % 7, f"d{d}"] = rng.choice([0, 1000, 5000, 20000, 60000])
        for i in range(rng.randint(1, 40)):
            length = rng.choice([0, 100, 900, 1000, 1180, 3000, 5000, 9000, 24000, budget, budget // 2, -500])
            rows.append((d % 7, f"d{d}", f"c{i}", rng.randint(0, 8), rng.randint(0, 3), i, length))
    pool = spark.createDataFrame(rows, POOL)
    days = spark.createDataFrame([(*k, v) for k, v in budgets.items()], BUDGET)
    assert chosen(choose(pool, days, slices=slices)) == loop(rows, budgets)


@pytest.mark.parametrize("over", [100, 101, 105, 118, 200])
def test_choice_at_other_limits_runs_nothing_by_itself(spark, over, monkeypatch):
    rng = random.Random(over)
    rows, budgets = [], {}
    for d in range(60):
        budget = budgets[d % 7, f"d{d}"] = rng.choice([0, 50, 1000, 20000])
        for i in range(rng.randint(1, 200)):
            length = rng.choice([1, budget // 100 + 1, budget // 20 + 1, budget // 5 + 1, rng.randint(0, 2 * budget + 1)])
            rows.append((d % 7, f"d{d}", f"c{i}", rng.randint(0, 50), rng.randint(0, 3), i, length))
    pool = spark.createDataFrame(rows, POOL)
    days = spark.createDataFrame([(*k, v) for k, v in budgets.items()], BUDGET)
    stages = []
    checkpoint = type(pool).checkpoint
    with monkeypatch.context() as patched:
        for action in ("collect", "count", "isEmpty", "first", "take", "toPandas", "toArrow"):
            patched.setattr(type(pool), action, lambda *a, **b: pytest.fail("an action inside choose"))
        patched.setattr(type(pool), "checkpoint", lambda df, *a, **b: stages.append(df) or checkpoint(df, *a, **b))
        got = choose(pool, days, CutParams(overshoot_pct=over), slices=70)
    assert len(stages) == 2 and chosen(got) == loop(rows, budgets, over)
    with pytest.raises(ValueError):
        choose(pool, days, CutParams(overshoot_pct=99))


def test_only_reachable_entries_stay():
    pick = random.Random(1)
    for most in (1, 3, 6):
        needs = [pick.randint(0, 60) for _ in range(400)]
        left = reachable(np.array(needs), most).tolist()
        assert left == [i for i, n in enumerate(needs) if sum(m <= n for m in needs[:i]) < most]
    assert len(reachable(np.array([pick.random() for _ in range(200_000)]), 6)) < 200
    assert len(reachable(np.zeros(0), 6)) == 0 and len(reachable(np.arange(100_000), 6)) == 6


@pytest.mark.parametrize(
    "budget, lengths, want",
    [
        (20000, [4000, 4000, 4000], {0, 1, 2}),  # follow-ups of lower priority stay
        (10000, [5000, 6800], {0, 1}),  # exactly 118 %
        (10000, [5000, 6801], {0}),
        (1000, [9000, 10, 10], {0}),  # nothing fits after an oversized first one
        (1000, [1000, 100, 100], {0, 1}),  # three entries: at least two picks
        (1000, [1000, 100], {0}),  # two entries: one pick is enough
        (10000, [6000, 9000, 3000, 2800], {0, 2, 3}),  # skipped, not stopped
        (1000, [0, 0, 0], {0, 1, 2}),
    ],
)
def test_budget_limits(spark, budget, lengths, want):
    rows = [(1, "d", str(i), 100 - i, 0, i, ms) for i, ms in enumerate(lengths)]
    got = choose(spark.createDataFrame(rows, POOL), spark.createDataFrame([(1, "d", budget)], BUDGET))
    assert {int(c) for _, c in chosen(got)} == want


def test_budgets(spark):
    rows = [(1, "a", "x", 0, 0, 0, 4000), (1, "b", "y", 0, 0, 0, 9000), (2, "a", "z", 0, 0, 0, 0)]
    targets = spark.createDataFrame([(1, 600), (2, 10)], "project_id bigint, target_s bigint")
    got = {(r.project_id, r.date_key): r for r in day_budgets(spark.createDataFrame(rows, POOL), targets).collect()}
    # 600 s less 3.6 + 2.8 + 2 * 2.6 s of cards, shared 2 : 3; a target under 360 s counts as 360.
    assert got[1, "a"].overhead_s == 12 and got[1, "a"].content_s == 588
    assert (got[1, "a"].budget_ms, got[1, "b"].budget_ms) == (235200, 352800)
    assert (got[2, "a"].weight, got[2, "a"].budget_ms) == (1.0, 351000)


def test_default_target_without_brief(spark):
    rows = spark.createDataFrame([(5, "a", "x", 0, 0, 0, 4000)], POOL)
    none = spark.createDataFrame([], "project_id bigint, target_s bigint")
    assert day_budgets(rows, none).first().content_s == 40 * 60 - 9


def test_empty_pool(spark):
    targets = spark.createDataFrame([(1, 600)], "project_id bigint, target_s bigint")
    pool = spark.createDataFrame([], POOL)
    assert choose(pool, day_budgets(pool, targets)).count() == 0


def test_roles_and_reasons(spark):
    rows = [
        (1, 1, 5, "", "", "", "", [], "", "opener", "Opens the film with the trip's beginning."),
        (3, 5, 5, "", "", "", "", [], "", "closer", "Closes the film on the trip's end."),
        (2, 2, 5, "Family_Meal", "", "", "", [], "", "meal", "Keeps the rhythm of meals and the mood of the trip. (Family_Meal)"),
        (2, 2, 5, "", "Leg", "하하", "", [], "", "reaction", "Shows how the group reacted and felt. (Leg)"),
        (2, 2, 5, "home_return", "", "", "scenery", [], "", "transition", "Key scenery for the brief and the day's flow. (home_return)"),
        (2, 2, 5, "", "", "", "", ["a", "b", "c", "d"], "", "moment", "Shows the people and the mood well. a, b, c"),
        (2, 2, 5, "", "", "", "", [], "sum", "moment", "sum"),
        (2, 2, 5, "", "", "y" * 90, "", [], " ", "moment", "Fits the flow the brief asks for. " + "y" * 80),
    ]
    df = spark.createDataFrame(
        rows,
        "travel_day bigint, sequence_index bigint, n_selected bigint, route_phase string, story_anchor_label string, "
        "excerpt string, event_type string, people array<string>, summary string, want_role string, want string",
    ).withColumns({"total_days": F.lit(3), "location_id": F.lit(""), "filename": F.lit("a.mp4")})
    for r in df.withColumn("role", infer_role()).withColumn("reason", selection_reason()).collect():
        assert (r.role, r.reason) == (r.want_role, r.want)


def test_selection_is_numbered_by_time(spark):
    rows = [(1, "2024-01-01", f"c{i}", i, 100 - i, 0, 2000) for i in range(4)]
    pool = spark.createDataFrame(rows, POOL).withColumns(
        {
            "end_ms": F.col("start_ms") + F.col("duration_ms"),
            "clip_path": F.lit("/a"),
            **{c: F.lit("") for c in ("filename", "excerpt", "route_phase", "story_anchor_label", "location_id", "event_type", "summary")},
            "people": F.array().cast("array<string>"),
        }
    )
    targets = spark.createDataFrame([(1, 600)], "project_id bigint, target_s bigint")
    got = select_segments(pool, targets, CutParams(), slices=3).orderBy("sequence_index").collect()
    assert [r.candidate_id for r in got] == ["c3", "c2", "c1", "c0"]
    assert [r.role for r in got] == ["opener", "moment", "moment", "closer"]
    assert {r.day_label for r in got} == {"Day 1 · 2024-01-01"}
