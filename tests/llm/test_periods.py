import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest
from cases import SF, documents, odd_documents, odd_frame

from cutlist.llm import periods
from cutlist.llm.queries import QUERIES, periodic_tail

LETTERS = str.maketrans({c: " " for c in "\x09\x0a\x0b\x0c\x0d"})


def plain_words(text):
    return [w for w in (text or "").translate(LETTERS).split(" ") if w]


def plain_runs(words, times=4, least=6):
    """Every period by itself: stretches of words equal to those a period before, smaller periods first."""
    out = []
    for period in range(1, len(words) // times + 1):
        at = period
        while at < len(words):
            if words[at] != words[at - period]:
                at += 1
                continue
            first = at - period
            while at < len(words) and words[at] == words[at - period]:
                at += 1
            size = at - first
            if size >= max(least, times * period) and not any(s <= first and first + size <= s + n for s, n, _ in out):
                out.append((first, size, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(seed):
    """Words with planted runs of many periods, next to and inside each other."""
    pick = random.Random(seed)
    out = []
    while len(out) < 120:
        unit = [pick.choice("abcdefgh") for _ in range(pick.choice([1, 1, 2, 3, 5, 9]))]
        if pick.random() < 0.3:
            unit = unit * pick.choice([2, 4, 5]) + [pick.choice("abz")]
        times = pick.choice([1, 1, 2, 3, 4, 5, 8])
        out += (unit * times)[: len(unit) * times - pick.randrange(len(unit))]
    return out


def test_all_short_lists_of_two_words():
    for size in range(13):
        for words in itertools.product((0, 1), repeat=size):
            assert periods.runs_of(words) == plain_runs(words)


@pytest.mark.parametrize("seed", range(150))
def test_runs_equal_plain_ones(seed):
    words = some_words(seed)
    want = plain_runs(words)
    codes = [ord(w[0]) for w in words]
    assert periods.runs_of(codes) == want
    counts, runs, left = periods.search(pa.array([" ".join(words)]))
    assert (counts.tolist(), runs, left.to_pylist()) == ([len(words)], [want], [collapsed(words, want)])


def test_cubes_are_found_where_asked_for():
    for seed in range(200):
        pick = random.Random(seed)
        words = [pick.choice("ab") for _ in range(40)]
        assert periods.runs_of([ord(w) for w in words], 3, 3) == plain_runs(words, 3, 3)


def test_long_runs_take_little_more_than_linear_time():
    words = [i % 7 for i in range(60_000)] + [8] + [0] * 60_000
    assert periods.runs_of(words) == [(0, 60_000, 7), (60_001, 60_000, 1)]


def test_strongest_prefers_start_then_period():
    runs = [(5, 10, 2), (0, 20, 4), (0, 5, 1), (9, 8, 2)]
    assert periods.strongest(runs) == (0, 5, 1) and periods.strongest([]) is None
    assert periods.strongest([(3, 10, 3), (7, 10, 2), (1, 19, 4)]) == (7, 10, 2)


def test_texts_share_no_runs():
    texts = ["a b a b", "a b a b a b", None, "", " \n ", "x " * 6, " a\tb a b a b\x0ba b ", "A a A a A a A a", " a a"]
    counts, runs, left = periods.search(pa.array(texts))
    assert counts.tolist() == [len(plain_words(t)) for t in texts]
    assert runs == [plain_runs(plain_words(t)) for t in texts]
    assert left.to_pylist() == [collapsed(plain_words(t), r) for t, r in zip(texts, runs)]


def test_odd_rows(spark):
    frame = odd_frame(spark).withColumnRenamed("ids", "runs")
    got = periods.find(frame)
    assert got.columns == [c for c in frame.columns if c != "runs"] + list(periods._ADDED)
    rows = sorted([(r.doc_id or -1, r.text or "", r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()])
    want = []
    for i, text, *_ in odd_documents():
        words = plain_words(text)
        # The long text is made of words drawn at random, whose runs are short.
        runs = plain_runs(words) if len(words) < 2000 else short_runs(words)
        want.append((i or -1, text or "", len(words), runs, collapsed(words, runs)))
    assert rows == sorted(want)
    assert periods.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def short_runs(words, most=12):
    out = []
    for period in range(1, most + 1):
        same = [i >= period and words[i] == words[i - period] for i in range(len(words))] + [False]
        at = 0
        while at < len(words):
            if same[at]:
                stop = same.index(False, at)
                first, size = at - period, stop - at + period
                if size >= max(6, 4 * period) and not any(s <= first and first + size <= s + n for s, n, _ in out):
                    out.append((first, size, period))
                at = stop
            at += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_query_equals_plain_runs(spark):
    """All documents; periods up to a quarter of the words are tried one by one, longest texts excepted from none."""
    rows = documents(spark).select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert set(got) == {r.doc_id for r in rows}
    seen = 0
    for doc_id, text in rows:
        words = plain_words(text)
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
        runs = numpy_runs([codes[w] for w in words])
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        r = got[doc_id]
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == digest(collapsed(words, runs))
        seen += len(runs)
    assert seen > 10


def numpy_runs(codes):
    """``plain_runs`` with the comparison of each period done at once."""
    import numpy as np

    all_codes, out = np.array(codes), []
    for period in range(1, len(codes) // 4 + 1):
        same = np.concatenate([[False], all_codes[period:] == all_codes[:-period], [False]])
        edges = np.flatnonzero(np.diff(same.astype(np.int8)))
        for first, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            size = stop - first + period
            if size >= max(6, 4 * period) and not any(s <= first and first + size <= s + n for s, n, _ in out):
                out.append((first, size, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_view_of_null_ids_and_no_words():
    assert periodic_tail(5, 0) is None and len(periodic_tail(None, 9)) == 9
