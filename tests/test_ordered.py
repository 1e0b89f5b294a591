import random

import pytest
from pyspark.sql import functions as F

from cutlist.operators.ordered import staged, with_order, with_running


@pytest.mark.parametrize("slices", [None, 9])
def test_order_and_sums_of_a_hot_key(spark, slices):
    rng = random.Random(1)
    rows = [(0 if i % 3 else rng.randint(1, 20), i, rng.randint(0, 50)) for i in range(900)]
    df = spark.createDataFrame(rows, "k bigint, id bigint, v bigint")
    got = with_order(df, ["k"], [F.col("v").desc(), F.col("id")], "n", {"total": F.col("v")}, slices).collect()
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        want, total = {}, 0
        for n, (_, i, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1])), 1):
            total += v
            want[i] = (n, total)
        assert {r.id: (r.n, r.total) for r in got if r.k == key} == want


def test_null_keys_small_batches_and_wide_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1]), i, rng.choice([None, 2, 3]), [i], {"x": str(i)}) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, j int, id bigint, v int, many array<bigint>, m struct<x: string>")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 7)
        got = with_order(df, ["k", "j"], [F.col("id")], "n", {"s": F.col("v")}, 5).collect()
    finally:
        spark.conf.set(name, before)
    want, state = {}, {}
    for k, j, i, v, *_ in rows:
        n, s = state.get((k, j), (0, 0))
        want[i] = state[k, j] = (n + 1, s + (v or 0))
    assert {r.id: (r.n, r.s) for r in got} == want and all(r.many == [r.id] and r.m.x == str(r.id) for r in got)


def test_rows_move_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = with_order(df, ["k"], [F.col("id")], "n", slices=4)._jdf.queryExecution().executedPlan().toString()
    # The ranges are staged; only the totals of slices are exchanged after that.
    numbering = plan[: plan.index("BroadcastExchange")]
    assert "MapInArrow" in numbering and "Exchange hash" not in numbering and "Window" not in numbering


def test_running_over_buckets(spark):
    df = spark.createDataFrame([(k, i, i * 3 % 7) for k in range(3) for i in range(1, 50)], "k bigint, i bigint, v bigint")
    marked = F.when(F.col("v") > 2, F.col("i"))
    got = with_running(df, ["k"], "i", {"s": F.col("v")}, {"m": marked}, bucket=8).collect()
    for k in range(3):
        total, top = 0, None
        for r in sorted((r for r in got if r.k == k), key=lambda r: r.i):
            total, top = total + r.v, r.i if r.v > 2 else top
            assert (r.s, r.m) == (total, top)


def test_a_hot_key_is_cut_into_slices(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), "id")
    sizes = [r["count"] for r in with_order(df, ["k"], [F.col("id")], "n", slices=10).groupBy("_slice").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 1500


def test_staging_uses_the_named_folder(spark):
    folder = spark.sparkContext.getCheckpointDir()
    assert folder and staged(spark.range(3)).count() == 3
