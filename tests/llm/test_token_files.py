import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import SF, documents, odd_frame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from cutlist.llm import token_files, wavelet
from cutlist.llm.queries import QUERIES


@pytest.fixture(scope="module")
def definition():
    return token_files.read_tokenizer(token_files.WORD_TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_files.WORD_TOKENIZER)


def packed(ids: np.ndarray, levels: int) -> wavelet.Wavelet:
    file = io.BytesIO()
    assert wavelet.write(file, ids, levels, pa.record_batch({"key": pa.array([1, None])})) == len(file.getvalue())
    return wavelet.Wavelet(file)


@pytest.mark.parametrize("size, levels", [(0, 16), (1, 1), (7, 3), (32768, 2), (32769, 16), (90_000, 5), (70_000, 20)])
def test_planes_answer_like_the_plain_list(size, levels):
    pick = np.random.default_rng(size)
    ids = (pick.zipf(1.2, size) % (1 << levels)).astype(np.uint32)
    ids[size // 2 : size // 2 + size // 4] = 0
    got = packed(ids, levels)
    assert len(got) == size and (got.ids() == ids).all() and got.documents().column(0).to_pylist() == [1, None]
    places = pick.integers(0, max(size, 1), min(size, 40))
    assert (got.access(places) == ids[places]).all()
    for token in {0, 1, (1 << levels) - 1, *ids[:3].tolist()}:
        assert got.rank(token) == (ids == token).sum() and got.rank(token, size // 3) == (ids[: size // 3] == token).sum()
        assert (got.occurrences(token) == np.flatnonzero(ids == token)).all()
    assert got.rank(1 << levels) == 0 and got.rank(-1) == 0
    with pytest.raises(IndexError):
        got.access([size])
    with pytest.raises(IndexError):
        got.select(0, [got.rank(0)])


def test_a_lookup_reads_few_blocks():
    got = packed(np.random.default_rng(1).integers(0, 1 << 16, 400_000), 16)
    got.access([123_456])
    assert got.blocks_read == 16


def test_faulty_files_are_refused():
    for data in (b"", b"short", b"x" * 100):
        with pytest.raises(ValueError):
            wavelet.Wavelet(io.BytesIO(data))
    with pytest.raises(ValueError):
        wavelet.write(io.BytesIO(), np.array([8]), 3, pa.record_batch({"key": pa.array([1])}))


def test_words_equal_whole_texts(definition, library, monkeypatch):
    texts = [None, "", " \t", "Don't  stop it 'S 12x34 é é ́a ΑΣ Σ", "a<|endoftext|>b <|endoftext|>", "日本 ﬁ 𝔘\x00y", "w" * 300]
    texts += ["Ünïted ÀÉ, ÿß! x× ÷y Don’t a.b c.. Straße; wor_d? naïve: ı İ ſ Ā", "A,B A, B. ,A é́,"]
    texts += [f"many words{i} and number{i * 7}" for i in range(300)]
    whole = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most in (5, 600_000):
        monkeypatch.setattr(token_files, "CACHED", most)
        for words in (True, False):
            made = token_files.WordIds(definition, words)
            for _ in range(2):
                ids, each = made.encode(pa.array(texts))
                assert [x.tolist() for x in np.split(ids, np.cumsum(each)[:-1])] == whole
            assert len(made._known) <= most


def plain(rows, library, end):
    out, start = [], 0
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((key, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_odd_rows_ties_and_small_shards(spark, definition, library, tmp_path):
    frame = odd_frame(spark)
    hot = spark.createDataFrame([(50, f"hot {i % 7}") for i in range(400)], "doc_id long, text string")
    frame = frame.select("doc_id", "text").unionByName(hot)
    files = token_files.write(frame, definition, 1, f"file://{tmp_path}/ids", shard=500)
    listed = files.collect()
    assert len(listed) > 4 and len({r.path for r in listed}) == len(listed) == len(list((tmp_path / "ids").iterdir()))
    got = sorted(token_files.read(files, T.LongType()).collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k)) and sum(r.n_documents for r in listed) == len(got)
    count = {}
    for r in frame.collect():
        ids = (r.doc_id, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 1]))
        count[ids] = count.get(ids, 0) + 1
    start = 0
    for r in got:
        ids = tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())
        assert r.start == start and r.n_tokens == len(ids)
        start, count[r.doc_id, ids] = start + len(ids), count[r.doc_id, ids] - 1
    assert not any(count.values())


def test_lookups_equal_a_scan(spark, definition, library):
    docs = documents(spark).select("doc_id", "text")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    files = token_files.write(docs, definition, 1, shard=20_000)
    whole = plain(rows, library, 1)
    every = np.concatenate([np.frombuffer(ids, "<u4") for *_, ids in whole])
    common = np.bincount(every).argsort()[::-1][[0, 5, 300]].tolist()
    wanted = [1, *common, 49_407, 70_000, 1]
    assert {r.token: r.n for r in token_files.count(files, wanted).collect()} == {t: int((every == t).sum()) for t in wanted}
    found = token_files.find(files, common, docs.schema["doc_id"].dataType).collect()
    places = {(r.token, r.place) for r in found}
    assert len(places) == len(found) and places == {(t, int(p)) for t in common for p in np.flatnonzero(every == t)}
    starts = {key: start for key, start, *_ in whole}
    assert all(r.place == starts[r.doc_id] + r.at for r in found)


def test_other_keys_and_clashing_names(spark, definition, library):
    frame = spark.createDataFrame([("b", "two words", 1), (None, "none", 2), ("a", None, 3)], "`a.b` string, `_key` string, size long")
    files = token_files.write(frame, definition, 7, key="a.b", text="_key")
    got = sorted(token_files.read(files, T.StringType(), "ids_of").collect(), key=lambda r: r.start)
    assert [(r.ids_of, r.start, r.n_tokens, bytes(r.ids)) for r in got] == plain([(None, "none"), ("a", None), ("b", "two words")], library, 7)


def test_empty_table(spark, definition):
    files = token_files.write(spark.createDataFrame([], "doc_id long, text string"), definition, 1)
    assert files.count() == 0 and token_files.read(files, T.LongType()).count() == 0
    assert [(r.token, r.n) for r in token_files.count(files, [5]).collect()] == [(5, 0)]
    assert token_files.find(files, [5], T.LongType()).count() == 0


def test_query_equals_plain_encoding(spark, library):
    rows = sorted(documents(spark).select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    got = sorted(map(tuple, QUERIES["op13_wavelet_tokens"](spark, SF).collect()))
    assert got == [(key, start, n, zlib.crc32(ids)) for key, start, n, ids in plain(rows, library, 1)]
