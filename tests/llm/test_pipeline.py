import corpus_pipeline
import duckdb
from cases import SF, classes, documents, fingerprint, odd_documents, odd_frame, words
from pyspark.sql import functions as F

from cutlist.llm import mixing, pieces, secrets
from cutlist.llm.oracle import ORACLE


def plain_secrets(text):
    """Text with the secrets' spans replaced, found by every rule in every text."""
    import re

    found = sorted(
        (a, n, b, r.kind) for n, r in enumerate(secrets.RULES) for a, b in r.spans(re.compile(r.pattern), text)
    )
    out, done = [], 0
    for a, _, b, kind in found:
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def test_run_equals_plain_stages(spark):
    """Given documents, of which none is in no language: dedup by all pairs, plain rules, the mix by SQL, one encoding each."""
    rows = documents(spark).collect()
    assert all(any(c.isalpha() for c in r.text) for r in rows)
    groups, kept = classes([fingerprint(r.text) for r in rows]), {}
    for r, g in zip(rows, groups):
        kept[g] = min(kept.get(g, r), r, key=lambda x: x.doc_id)
    clean = [(r.doc_id, plain_secrets(r.text), r.source) for r in kept.values()]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", clean)
    copies = {d[0]: d[1] for d in con.execute(f"select doc_id, copies from ({ORACLE['op7_pareto_mixing']})").fetchall()}
    model = pieces.Pieces.load(pieces.read_model())
    texts = {i: t for i, t, _ in clean}
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, n in copies.items() for _ in range(n))
    assert all(model.decode(list(r.ids)) == texts[r.doc_id] for r in got)


def test_stages_on_odd_rows(spark):
    frame = odd_frame(spark)
    docs = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == frame.columns, name
        docs = made
        rows = docs.collect()
        if name == "language_id":
            lettered = [r for r in odd_documents() if r[1] and any(c.isalpha() for c in r[1])]
            assert len(rows) == len(lettered) and all(r.lang for r in rows)
        elif name == "simhash_near_dedup":
            assert len(rows) == len(set(classes([fingerprint(r[1]) for r in lettered])))
        elif name == "secret_scan":
            assert [r.text for r in rows if r.doc_id == 12] == ["[assign] mail a@b.co 10.0.0.1"]
            assert all(r.n_chars == len(r.text) for r in rows)
        assert all(r["a.b"] == "ab" and r["size"] == "sz" and r["copies"] == "cp" and r["spans"] == "sp" for r in rows)
    total = sum(len(words(r.text)) for r in rows)
    assert total > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(rows) and last.where("ids is null").count() == 0


def test_stages_on_nothing(spark):
    none = odd_frame(spark).where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_unlabelled_documents_stay(spark):
    docs = odd_frame(spark).withColumn("lang", F.lit(None).cast("string"))
    rows = corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()
    assert len(rows) == sum(bool(r[1]) and any(c.isalpha() for c in r[1]) for r in odd_documents()) and all(r.lang is None for r in rows)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "secret_scan", "source_mix", "piece_encoding"]
    assert corpus_pipeline.ORACLE_SQL is None and mixing.WEIGHTS == (1, 2, 3)
