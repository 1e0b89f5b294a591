import duckdb
import pytest
from cases import SF, documents, odd_documents, odd_frame, words
from pyspark.sql import functions as F

from cutlist.llm import mixing
from cutlist.llm.oracle import ORACLE
from cutlist.llm.queries import QUERIES


def targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight, capped sources' excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        got = {s: most * sizes[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and got[s] > most * sizes[s] + 1e-9}
        if not over:
            return got
        capped |= over


def check(rows, sizes_of):
    sizes, largest = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    goal = targets(sizes)
    taken = {}
    for r in rows:
        assert r.size == sizes_of(r) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goal[r.source], abs=1e-5)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - goal[s]) <= largest[s] / 2 + 1


def test_query(spark):
    text = {r.doc_id: r.text for r in documents(spark).collect()}
    rows = QUERIES["op7_pareto_mixing"](spark, SF).collect()
    assert len(rows) == len(text)
    check(rows, lambda r: len(words(text[r.doc_id])))
    assert sorted(rows) == sorted(QUERIES["op7_pareto_mixing"](spark, SF).collect())


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    result = con.execute(ORACLE["op7_pareto_mixing"])
    names = [d[0] for d in result.description]
    got = QUERIES["op7_pareto_mixing"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())


def test_odd_rows(spark):
    frame = odd_frame(spark)
    mixed = mixing.mixed(frame)
    rows = mixed.collect()
    assert len(rows) == len(odd_documents())
    check(rows, lambda r: len(words(r.text)))
    assert all(r.taken == 0 for r in rows if not r.size)
    assert "a.b" in mixed.columns and mixed.where("_row = 5 and _text = 'tx'").count() == len(rows)
    copies = mixing.expand(mixed)
    assert copies.count() == sum(r.copies for r in rows) and set(copies.columns) == set(frame.columns) - {"size", "copies"}


def test_unequal_inclusion_steadies_totals(spark):
    """Few ranges and one range give the same sample; a source of equal sizes takes its share of documents."""
    frame = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    measured = mixing.measure(frame)
    one = {r.doc_id: r.copies for r in mixing.mix(measured, ranges=1, columns=frame.columns).collect()}
    many = {r.doc_id: r.copies for r in mixing.mix(measured, ranges=64, columns=frame.columns).collect()}
    assert one == many and set(one.values()) >= {0, 1, 2} - {2}
    other = {r.doc_id: r.copies for r in mixing.mix(measured, seed=8, columns=frame.columns).collect()}
    assert other != one


def test_empty_table(spark):
    none = odd_frame(spark).where(F.lit(False))
    assert mixing.mixed(none).count() == 0 and mixing.expand(mixing.mixed(none)).count() == 0
