import hashlib
from collections import Counter

import numpy as np
import pytest
from cases import SF, documents, odd_documents, odd_frame
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from cutlist.llm import alignment
from cutlist.llm.queries import QUERIES

ODD = ["a", " ", "  a  b ", "é\n\n  x\t y", "日本語 テスト", "<s> <0x0A> <|endoftext|> </s>", "▁", "a ▁b", "ﬁ① x", "x" * 300, "a b c  d"]
ODD += [" 𝔘 👩‍👩‍👧 z", "don't we'll 12 345", "é ́ x", "tab\t end ", "\x00 \x1c a\x1d b", "\r\n a"]


@pytest.fixture(scope="module")
def models():
    return alignment.read_models()


@pytest.fixture(scope="module")
def aligner(models):
    return alignment.Aligner(*models)


class Plain:
    """Every token's byte range over the whole text, and all pairs of ranges compared."""

    def __init__(self, models):
        self.a, self.b = Tokenizer.from_str(models[0]), SentencePieceProcessor(model_proto=models[1])
        self.a.encode_special_tokens = True
        self.letters = {c: b for b, c in alignment._byte_letters().items()}

    def ranges(self, text):
        if not text:
            return None
        whole = (" " + text).encode()
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        out = []
        for tokens in (a, b):
            if b"".join(t for _, t in tokens) != whole:
                return None
            at, made = 0, []
            for i, t in tokens:
                made.append((i, at, at + len(t)))
                at += len(t)
            out.append(made)
        return out

    def rows(self, texts):
        found = [self.ranges(t) for t in texts]
        links = [[] if f is None else [(i, j) for i, s, e in f[0] for j, p, q in f[1] if s < q and p < e] for f in found]
        count = Counter(pair for mine in links for pair in set(mine))
        top = {}
        for (i, _), n in count.items():
            top[i] = max(top.get(i, 0), n)
        out = []
        for f, mine in zip(found, links):
            if f is None:
                out.append((0, 0, 0, 0, 0, 0, ""))
                continue
            a, b = f
            ends = sorted({e for *_, e in a} & {e for *_, e in b})
            inside = lambda tokens, s, e: ",".join(str(i) for i, p, q in tokens if s <= p and q <= e)
            groups = ";".join(inside(a, s, e) + "|" + inside(b, s, e) for s, e in zip([0, *ends], ends))
            best = sum(count[p] == top[p[0]] for p in mine)
            out.append((len(a), len(b), len(ends), len(mine), best, sum(count[p] for p in mine), groups))
        return out


@pytest.fixture(scope="module")
def plain(models):
    return Plain(models)


def fields(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)


def test_byte_letters_are_the_librarys():
    letters = alignment._byte_letters()
    assert ByteLevel().decode([letters[b] for b in "é 日\n".encode()]) == "é 日\n"


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_equal_plain_ranges(aligner, plain, text):
    counts, groups, links, times = aligner.documents([text, None, ""])
    n_a, n_b, n_groups, n_links, *_, named = plain.rows([text])[0]
    assert (*counts[0], groups[0], int(times[0].sum())) == (n_a, n_b, n_groups, named, n_links)
    assert not counts[1:].any() and groups[1:] == ["", ""] and not len(links[1])


def test_spans_are_cuts_and_sizes_refine_them():
    ends = lambda spans, sizes: alignment.ends_of(*np.array(spans).T, np.array(sizes)).tolist()
    assert ends([(0, 2), (2, 5)], [2, 3]) == [2, 5]
    assert ends([(0, 3), (0, 3), (0, 3), (3, 4)], [1, 1, 1, 1]) == [1, 2, 3, 4]
    assert ends([(0, 2), (2, 2), (2, 2), (2, 5), (5, 6)], [2, 1, 1, 1, 1]) == [2, 3, 4, 5, 6]
    assert ends([(0, 1), (1, 2)], [2, 3]) == [2, 5]


def test_cache_and_units_do_not_change_rows(aligner, monkeypatch):
    texts = [f"one word{i % 7} two words{i}\n three é{i} ▁" if i % 9 == 5 else f" as{i}  日本 word{i % 7} it" for i in range(60)]
    same = lambda x, y: (x[0] == y[0]).all() and x[1] == y[1] and all((p == q).all() for p, q in zip(x[2] + x[3], y[2] + y[3]))
    before = aligner.documents(texts)
    monkeypatch.setattr(alignment, "CACHED", 10)
    monkeypatch.setattr(alignment, "GROUP", 3)
    assert same(before, aligner.documents(texts)) and same(before, aligner.documents(texts))
    monkeypatch.setattr(aligner, "by_units", False)
    monkeypatch.setattr(aligner, "_known", aligner._known[:0])
    monkeypatch.setattr(aligner, "_units", alignment._no_units())
    assert same(before, aligner.documents(texts))


@pytest.mark.parametrize("head", [0, 50, 1 << 18])
def test_odd_rows(spark, models, plain, head):
    rows = [r for r in odd_documents() if len(r[1] or "") < 5000]
    frame = spark.createDataFrame([(i, t) for i, t, *_ in rows] + [(900 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    given = [(r.doc_id, r.text) for r in frame.collect()]
    got = alignment.align(frame, models, keep=["doc_id"], head=head).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, fields(r)) for r in got], key=key) == sorted([(i, x) for (i, _), x in zip(given, plain.rows([t for _, t in given]))], key=key)


def test_files_read_by_one_task_in_any_order(spark, models, plain):
    """Many files of unlike sizes, which one task reads by size and not by row number."""
    texts = [(f"{'é' * (i % 7)} word{i} the the <{i}> " * (1 + i * 13 % 40)).strip() for i in range(120)] + ODD
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40, "doc_id")
    want = plain.rows(texts)
    for head in (50, 1 << 18):
        got = {r.doc_id: fields(r) for r in alignment.align(frame, models, keep=["doc_id"], head=head).collect()}
        assert got == dict(enumerate(want))


def test_clashing_names_long_text_and_empty_table(spark, models):
    frame = odd_frame(spark)
    got = alignment.align(frame.withColumnRenamed("ids", "groups"), models)
    assert got.columns == [c for c in frame.columns if c != "ids"] + list(alignment._ADDED) and got.count() == frame.count()
    assert got.where("doc_id = 6").first().n_a > 60_000
    empty = alignment.align(spark.createDataFrame([], "doc_id long, text string"), models)
    assert empty.count() == 0


def test_query_equals_plain_ranges(spark, plain):
    """Links by a sweep over both lists, which the tests above hold to all pairs of ranges."""
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    want = swept(plain, rows)
    got = {r.doc_id: r for r in QUERIES["op12_token_alignment"](spark, SF).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        *numbers, groups = want[i]
        assert tuple(numbers) == (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def sweep(a, b):
    """Groups and links of two lists of (id, start, stop) by two fingers."""
    groups, links, i, j, first = [], [], 0, 0, (0, 0)
    while i < len(a) and j < len(b):
        links.append((a[i][0], b[j][0]))
        left, right = a[i][2], b[j][2]
        i, j = i + (left <= right), j + (right <= left)
        if left == right:
            groups.append("|".join(",".join(str(x[0]) for x in t[f:k]) for t, f, k in ((a, first[0], i), (b, first[1], j))))
            first = (i, j)
    return groups, links


def swept(plain, rows):
    found = {}
    for i, text in rows:
        f = plain.ranges(text)
        found[i] = None if f is None else (f, *sweep(*f))
    count = Counter(pair for f in found.values() if f for pair in set(f[2]))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = {}
    for i, f in found.items():
        if f is None:
            out[i] = (0, 0, 0, 0, 0, 0, "")
            continue
        (a, b), groups, links = f
        best = sum(count[p] == top[p[0]] for p in links)
        out[i] = (len(a), len(b), len(groups), len(links), best, sum(count[p] for p in links), ";".join(groups))
    return out
