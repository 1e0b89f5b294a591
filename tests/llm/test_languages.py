import zlib

import numpy as np
import pyarrow as pa
from cases import SF, documents, odd_documents, odd_frame
from pyspark.sql import functions as F

from cutlist.llm import languages
from cutlist.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in documents(spark).collect()}
    rows = QUERIES["op5_family_language"](spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.95 * len(held)


def test_predictions_need_only_the_text(spark):
    """Other labels, sources and ids of the texts to predict change nothing."""
    docs = documents(spark)
    model = languages.train(docs, per_language=40)
    first = [tuple(r) for r in languages.predict(docs, model, keep=["text"]).collect()]
    odd = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": F.lit(1)})
    assert sorted(first) == sorted(tuple(r) for r in languages.predict(odd, model, keep=["text"]).collect())


def test_vectors_are_unit_and_block_independent(monkeypatch):
    texts = pa.array(["Some words here", "", None, "ab", "élan vital " * 500, "12 !!"])
    whole = languages.vectors(texts)
    norms = np.linalg.norm(whole, axis=1)
    assert np.allclose(norms[[0, 3, 4]][[0, 2]], 1) and norms[1] == norms[2] == norms[5] == 0
    monkeypatch.setattr(languages, "BLOCK", 50)
    assert np.allclose(languages.vectors(texts), whole)


def test_machine_separates():
    random = np.random.default_rng(2)
    x = np.vstack([random.normal(0.4, 1, (200, 20)), random.normal(-0.4, 1, (300, 20))]).astype(np.float32)
    y = np.array([1] * 200 + [-1] * 300)
    w = languages.machine(x, y, rounds=20)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.9


def test_odd_rows(spark):
    frame = odd_frame(spark)
    model = languages.train(frame, per_language=8)
    assert set(model.languages) == {"en", "de", "fr", "ja"}
    rows = languages.predict(frame, model).collect()
    assert len(rows) == len(odd_documents())
    for r in rows:
        blank = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und" and r.score == 0) if blank else r.lang_pred in model.languages
    assert languages.predict(frame, model).where("_row = 5 and `a.b` = 'ab'").count() == len(rows)


def test_few_or_no_labels(spark):
    frame = odd_frame(spark)
    none = languages.train(frame.where("lang is null"))
    assert none.languages == ()
    assert {r.lang_pred for r in languages.predict(frame, none).collect()} == {"und"}
    one = languages.train(frame.where("lang = 'en'"))
    got = languages.predict(frame, one).collect()
    assert {r.lang_pred for r in got} == {"en", "und"} and all(r.score == 1 for r in got if r.lang_pred == "en")
    assert languages.predict(frame.where(F.lit(False)), one).count() == 0
