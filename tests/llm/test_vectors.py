import math
import random

import duckdb
import numpy as np
import pytest
from cases import SF
from pyspark.sql import functions as F

from cutlist.llm import curves, topk
from cutlist.llm.oracle import ORACLE
from cutlist.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, score string, rank string, `_row` long"


def stored(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)


def odd_vectors():
    pick = random.Random(6)
    vectors = [(i, [pick.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    same = [0.5, 0.25, -1.0, 2.0]
    vectors += [(i, same) for i in range(100, 140)] + [(100, same)]
    vectors += [(200, None), (220, []), (240, [1.0, None, 2.0, 3.0]), (260, [1.0, float("nan"), 0.0, 0.0]), (280, [float("inf"), 0.0, 0.0, 0.0])]
    vectors += [(300, [1.0, 2.0]), (301, [2.0, 1.0]), (320, [3.0]), (400, [0.0, 0.0, 0.0, 0.0]), (None, same), (500, [1e3, -1e3, 1e3, 5e2])]
    return [(i, v, "s", "r", 5) for i, v in vectors]


def odd_frame(spark):
    return spark.createDataFrame(odd_vectors(), SCHEMA).repartition(3)


def usable(rows):
    return [(i, v) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]


def best(rows, asked, k, score):
    """(query, rank, id, score) over all pairs of rows of one length, the row itself left out."""
    out = []
    for n, (i, v) in enumerate(rows):
        if asked(i):
            found = sorted((-score(v, w), j) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def inner(v, w):
    return sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v, w))


def test_top_k_equals_all_pairs(spark):
    ids, vectors = stored(spark)
    whole = np.floor(64 * vectors).astype(np.int64)
    got = sorted(map(tuple, QUERIES["op9_histogram_topk"](spark, SF).collect()))
    want = []
    for n in np.flatnonzero(ids % 20 == 0):
        scores = whole @ whole[n]
        order = [m for m in np.lexsort((ids, -scores)) if m != n][:20]
        want += [(int(ids[n]), r + 1, int(ids[m]), int(scores[m])) for r, m in enumerate(order)]
    assert got == sorted(want)


def test_top_k_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    result = con.execute(ORACLE["op9_histogram_topk"])
    names = [d[0] for d in result.description]
    assert sorted(result.fetchall()) == sorted(map(tuple, QUERIES["op9_histogram_topk"](spark, SF).select(*names).collect()))


@pytest.mark.parametrize("k", [1, 20, 500])
def test_top_k_of_odd_rows(spark, k, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "ENOUGH", 1)
    got = sorted(map(tuple, topk.top_k(odd_frame(spark), F.col("vec_id") % 20 == 0, k).collect()))
    assert got == best(usable(odd_vectors()), lambda i: i % 20 == 0, k, inner)


def test_neighbours(spark):
    ids, vectors = stored(spark)
    rows = QUERIES["op10_hilbert_neighbours"](spark, SF).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    at = {int(i): n for n, i in enumerate(ids)}
    asked = [int(i) for i in ids if i % 50 == 0]
    assert sorted({r.query_id for r in rows}) == asked and len(rows) == 5 * len(asked)
    hits = 0
    for i in asked:
        found = sorted((r for r in rows if r.query_id == i), key=lambda r: r.rank)
        cosine = unit @ unit[at[i]]
        assert all(abs(cosine[at[r.vec_id]] - r.score) < 1e-9 and r.vec_id != i for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & {int(ids[m]) for m in np.lexsort((ids, -cosine)) if m != at[i]} & set(nearest(ids, cosine, at[i])))
    assert hits >= 0.9 * len(rows)


def nearest(ids, cosine, own):
    return [int(ids[m]) for m in np.lexsort((ids, -cosine)) if m != own][:5]


def test_recall_with_many_buckets(spark, monkeypatch):
    """Buckets of a fiftieth of clustered vectors, over several partitions."""
    random_ = np.random.default_rng(3)
    centres = random_.normal(size=(40, 16))
    vectors = centres[random_.integers(0, 40, 3000)] + 0.25 * random_.normal(size=(3000, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(curves, "BUCKET", 64)
    rows = curves.nearest(frame, F.col("vec_id") % 50 == 0).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = sum(r.vec_id in nearest(np.arange(3000), unit @ unit[r.query_id], r.query_id) for r in rows)
    assert len(rows) == 300 and hits >= 0.9 * 300


def test_windows_follow_the_table(spark, monkeypatch):
    """Near-uniform vectors, of which buckets of 16 would compare a twentieth: recall holds since buckets grow."""
    vectors = np.random.default_rng(4).normal(size=(12_000, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(curves, "BUCKET", 16)
    rows = curves.nearest(frame, F.col("vec_id") % 100 == 0).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = sum(r.vec_id in nearest(np.arange(12_000), unit @ unit[r.query_id], r.query_id) for r in rows)
    few = curves.nearest(frame, F.col("vec_id") % 100 == 0, share=0.0).collect()
    lost = sum(r.vec_id in nearest(np.arange(12_000), unit @ unit[r.query_id], r.query_id) for r in few)
    print("hits", hits / 600, "without", lost / 600)
    assert len(rows) == 600 and hits >= 0.9 * 600 > lost


def test_neighbours_of_odd_rows(spark, monkeypatch):
    """One bucket compares all: the answers are those of all pairs, copies by their smallest ids."""
    rows = [(i, v) for i, v in usable(odd_vectors()) if any(v)]

    def cosine(v, w):
        return round(sum(a * b for a, b in zip(v, w)) / math.hypot(*v) / math.hypot(*w), 9)

    for spread in (1 << 16, 8):
        monkeypatch.setattr(curves, "SPREAD", spread)
        got = curves.nearest(odd_frame(spark), F.col("vec_id") % 20 == 0).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == best(rows, lambda i: i % 20 == 0, 5, cosine)


def test_hilbert_neighbours_differ_in_one_step():
    side = np.arange(8, dtype=np.uint32)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, 3)
    place = curves.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    path = cells[np.argsort(place)].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_empty_tables(spark):
    none = odd_frame(spark).where(F.lit(False))
    assert topk.top_k(none, F.col("vec_id") % 20 == 0).count() == 0
    assert curves.nearest(none, F.col("vec_id") % 50 == 0).count() == 0
