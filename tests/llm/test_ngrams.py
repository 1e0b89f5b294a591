import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import SF, documents, odd_documents, odd_frame, words
from pyspark.sql import functions as F

from cutlist.llm import ngrams
from cutlist.llm.queries import QUERIES


def plain(rows, training):
    """(n_tokens, n_known, N, base score) per text; the end token is None."""
    counts = Counter(w for t in training for w in [*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for text in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        out.append((len(tokens), sum(counts[w] > 0 for w in tokens), total, base))
    return out


def test_query_equals_plain_counts(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    want = dict(zip([i for i, _ in docs], plain([t for _, t in docs], [t for i, t in docs if not held[i]])))
    rows = QUERIES["op6_bloom_ngrams"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        size, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], size, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_rare_words_are_joined(spark):
    """With hardly any broadcast words all counts come from the join, and are the same."""
    docs = documents(spark).select("doc_id", "text")
    small, large = (ngrams.score(docs, ngrams.train(docs, head=h), keep=["doc_id"]) for h in (3, 100_000))
    one = {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6)) for r in small.collect()}
    assert one == {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6)) for r in large.collect()}


def test_word_hashes_do_not_depend_on_blocks():
    texts = pa.array(["One two\tthree", "", None, "two", " one  two\n", "x" * 300 + " y" * 50, "é ü é"])
    whole = ngrams.words_of(texts)
    for block in (1, 7, 64):
        parts = ngrams.words_of(texts, block)
        for name in ("hashes", "rows", "begins", "ends"):
            assert (getattr(parts, name) == getattr(whole, name)).all()
    assert np.bincount(whole.rows, minlength=7).tolist() == [3, 0, 0, 1, 2, 51, 3]
    assert len(set(whole.hashes.tolist())) == 7
    assert bytes(whole.raw[whole.begins[2] : whole.ends[2]]) == b"three"


def test_filter_counts_are_never_too_small(spark):
    docs = documents(spark).select("text")
    bloom = ngrams.build_filter(docs, 200_000)
    counts = Counter()
    for r in docs.collect():
        tokens, _, bigrams, _ = ngrams.token_keys(ngrams.words_of(pa.array([r.text])))
        counts.update(ngrams._single(tokens).tolist())
        counts.update(bigrams.tolist())
    keys = np.array(list(counts), np.uint64)
    level, true = bloom.levels(keys), ngrams.level_of(np.array(list(counts.values())))
    assert (level >= true).all() and (level == true).mean() > 0.9
    unseen = np.random.default_rng(1).integers(0, 1 << 48, 20_000, dtype=np.uint64)
    assert (bloom.levels(unseen) > 0).mean() < 0.2 and 0 < bloom.filled < 0.6


def test_levels():
    counts = np.arange(1, 5000)
    level = ngrams.level_of(counts)
    assert (np.diff(level) >= 0).all() and level[0] == 1
    middle = ngrams.count_of(level)
    assert (middle / counts < 1.5).all() and (middle / counts > 0.6).all() and ngrams.count_of(np.array([0]))[0] == 0


def test_odd_rows(spark):
    frame = odd_frame(spark)
    model = ngrams.train(frame)
    rows = ngrams.score(frame, model).collect()
    want = plain([r[1] for r in odd_documents()], [r[1] for r in odd_documents()])
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == sorted((a, b, round(d, 4)) for a, b, _, d in want)
    assert all(r["_row"] == 5 and r["a.b"] == "ab" for r in rows)


def test_no_training_texts(spark):
    frame = odd_frame(spark)
    none = ngrams.train(frame.where(F.lit(False)))
    rows = ngrams.score(frame, none).collect()
    assert len(rows) == len(odd_documents()) and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in rows)
    assert ngrams.score(frame.where(F.lit(False)), none).count() == 0
