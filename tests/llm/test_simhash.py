import random

import numpy as np
from cases import classes, documents, fingerprint, odd_documents, odd_frame
from pyspark.sql import functions as F

from cutlist.llm import graygroups
from cutlist.llm.queries import QUERIES


def expected(rows):
    """(fingerprint, component id) per (id, text) row by comparing all pairs."""
    prints = [fingerprint(t) for _, t in rows]
    roots = classes(prints)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots)]


def key(row):
    return [(x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row]


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    got = QUERIES["op1_gray_simhash"](spark, "/root/testdata/sf0.001").select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)


def test_odd_rows(spark):
    got = graygroups.near_duplicates(odd_frame(spark))
    assert set(got.columns) == set(odd_frame(spark).columns) - {"component_id"} | {"fingerprint", "component_id"}
    rows = [(r[0], r[1]) for r in odd_documents()]
    found = [tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(found, key=key) == sorted(expected(rows), key=key)


def test_links_of_dense_groups(spark):
    pick = random.Random(3)
    codes = set()
    for _ in range(12):
        centre = pick.getrandbits(64)
        for _ in range(60):
            code = centre
            for _ in range(pick.choice([1, 1, 2, 5])):
                code ^= 1 << pick.randrange(64)
            codes.add(code)
    codes |= {pick.getrandbits(64) for _ in range(500)} | {0, (1 << 64) - 1}
    codes = sorted(codes)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    edges = graygroups.links(spark.createDataFrame(signed, "_print long"), block=64)
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in graygroups.components(edges).collect()}
    groups = classes(codes)
    mine = [roots.get(c, c) for c in codes]
    assert len(set(zip(mine, groups))) == len(set(mine)) == len(set(groups))


def test_search_finds_all_within_the_limit():
    random_ = np.random.default_rng(5)
    codes = np.unique(random_.integers(0, 1 << 12, 700, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    who, leaf = graygroups.GrayTree(codes).search(codes, 20)
    true = np.argwhere(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 20)
    assert sorted(zip(who.tolist(), leaf.tolist())) == sorted(map(tuple, true.tolist()))


def test_deduplicate_keeps_one_of_each(spark):
    frame = odd_frame(spark)
    got = graygroups.deduplicate(frame)
    assert got.columns == frame.columns
    rows = odd_documents()
    kept = got.select("doc_id", "text").collect()
    assert len(kept) == len(set(classes([fingerprint(r[1]) for r in rows])))
    assert sum(r.doc_id == 7 for r in kept) == 1 and not any(r.doc_id == 8 for r in kept)


def test_empty_table(spark):
    none = odd_frame(spark).where(F.lit(False))
    assert graygroups.near_duplicates(none).count() == 0
    assert graygroups.deduplicate(none).count() == 0


def test_long_texts_are_read_in_blocks(monkeypatch):
    text = "One\ttwo three " * 500 + "x" * 3000 + " four\n five"
    monkeypatch.setattr(graygroups, "TEXT_BLOCK", 64)
    assert graygroups.fingerprint(text) == fingerprint(text)
