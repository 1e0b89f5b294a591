import random

import numpy as np
import pytest
from cases import SF, documents, odd_documents, odd_frame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from cutlist.llm import pieces
from cutlist.llm.queries import QUERIES

ODD = ["", " ", "  a ", "é\n\n  x\t", "日本語 テスト", "<s> </s> <0x0A>", "a  b   c", "ﬁ①", "x" * 500, "word\nword word", " 𝔘"]


@pytest.fixture(scope="module")
def proto():
    return pieces.read_model()


@pytest.fixture(scope="module")
def model(proto):
    return pieces.Pieces.load(proto)


def test_without_dropout_it_is_the_models_own_segmentation(spark, proto, model):
    library = SentencePieceProcessor(model_proto=proto)
    texts = ODD + [r.text for r in documents(spark).limit(60).collect()]
    for text in texts:
        assert model.encode(text) == library.encode(text)


@pytest.mark.parametrize("text", ODD + ["▁", "a▁b ▁▁", "▁ ▁"])
def test_lossless(model, text):
    for rate in (0.0, 0.1, 0.9):
        assert model.decode(model.encode(text, rate, 3, 99)) == text


def test_rows_of_arrays_equal_single_agendas(model):
    pick = random.Random(4)
    units = ["".join(pick.choice("▁abehinorst") for _ in range(pick.randrange(1, 30))) for _ in range(400)] + ["é▁x", "日", "▁"]
    variants = [pick.randrange(pieces.VARIANTS) for _ in units]
    for rate in (0.0, 0.1, 0.6):
        many = model.segment_many(units, variants, rate, 5)
        assert [np.frombuffer(m, np.int32).tolist() for m in many] == [model.segment(u, rate, 5, v) for u, v in zip(units, variants)]


def test_dropout_varies_by_seed_document_and_place(model):
    text = "international representation " * 40
    plain, first = model.encode(text), model.encode(text, 0.2, 1, 7)
    assert first == model.encode(text, 0.2, 1, 7) and len(first) > len(plain)
    assert first != model.encode(text, 0.2, 2, 7) and first != model.encode(text, 0.2, 1, 8)


def test_groups_and_cache_do_not_change_ids(model, proto, monkeypatch):
    texts = ["the cat sat on the mat " * 30, None, "", "another text\nwith lines " * 20]
    whole = model.encode_many(texts, 0.1, 8, [1, 2, 3, 4])
    monkeypatch.setattr(pieces, "GROUP", 7)
    monkeypatch.setattr(pieces, "CACHED", 3)
    parts = pieces.Pieces.load(proto).encode_many(texts, 0.1, 8, [1, 2, 3, 4])
    assert parts[1] is None and whole[1] is None
    assert [x.tolist() for x in parts if x is not None] == [x.tolist() for x in whole if x is not None]


def test_query_decodes_every_document(spark, proto):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    library = SentencePieceProcessor(model_proto=proto)
    rows = QUERIES["op8_merge_dropout"](spark, SF).collect()
    assert len(rows) == len(texts) and all(r.lossless and r.n_pieces == len(r.ids) for r in rows)
    assert all(library.decode(list(r.ids)) == texts[r.doc_id] for r in rows)
    assert sum(list(r.ids) != library.encode(texts[r.doc_id]) for r in rows) > len(rows) / 2


def test_odd_rows(spark, proto):
    frame = odd_frame(spark)
    encoded = pieces.encode(frame, proto, check=True)
    rows = encoded.collect()
    assert len(rows) == len(odd_documents())
    for r in rows:
        assert (r.ids is None) == (r.text is None) and r.lossless in ((None,) if r.text is None else (True,))
    back = pieces.decode(encoded.withColumnRenamed("text", "before"), proto)
    assert back.where("not (text <=> before)").count() == 0 and back.where("_row = 5").count() == len(rows)
    assert pieces.encode(frame.where(F.lit(False)), proto).count() == 0


def test_occurrences_have_segmentations_of_their_own(model):
    """A frequent word takes more segmentations than four streams could give it, and as many stay whole as chance says."""
    word, times = " representation", 4000
    plain = tuple(model.encode(word[1:]))
    made = [tuple(model.segment("▁representation", 0.1, 8, int(v))) for v in pieces._spread(7, 0, times)]
    whole = model.encode_many([word[1:] + word * (times - 1)], 0.1, 8, [7])[0].tolist()
    assert whole == [i for ids in made for i in ids] and len(set(made)) > 8
    # Candidates that come up without any skip: as many as merges.
    merges = len(word) - len(plain)
    skipless = (pieces._patterns(pieces._streams(pieces._spread(7, 0, times), 8), np.full(times, merges), pieces._shares(0.1)) == 0).mean()
    assert abs(skipless - 0.9**merges) < 0.03


def test_units_with_more_draws_than_a_pattern_holds(model):
    units, variants = ["▁international"] * 200 + ["abcdefghij" * 6] * 3, list(range(203))
    many = model.segment_many(units, variants, 0.8, 5)
    assert [np.frombuffer(m, np.int32).tolist() for m in many] == [model.segment(u, 0.8, 5, v) for u, v in zip(units, variants)]
    assert model.segment("▁international", 1.0, 5, 1) == [model.id[c] for c in "▁international"]
