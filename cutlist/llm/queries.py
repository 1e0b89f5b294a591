"""The queries of this subpackage: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlist.llm import alignment, curves, graygroups, languages, mixing, ngrams, pages, periods, pieces, pii, secrets
from cutlist.llm import spans, token_files, topk
from cutlist.llm.common import remainder, staged, table


def op4_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"), keep=["page_id"])


def op5_family_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = languages.train(docs.where(~held_out))
    return languages.predict(docs, model, keep=["doc_id"]).withColumn("held_out", held_out)


def op6_bloom_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 7) == 2
    model = ngrams.train(docs.where(~held_out))
    return ngrams.score(docs, model, keep=["doc_id"]).withColumn("held_out", held_out)


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    names = ["doc_id", "source"]
    # Texts are read once; what is staged is an id, a source, a size and a digest per document.
    measured = mixing.measure(docs).drop("_carried2")
    return mixing.mix(staged(measured), columns=names).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


def op1_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graygroups.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    own = F.size(spans.of_kinds(F.col("spans"), [pii.GENERAL, pii.REMOVED])).cast("long")
    return found.select("doc_id", own.alias("n_terms"), *[c.alias(n) for n, c in spans.digest(F.col("spans"), pii.KINDS).items()])


def op3_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    kinds = [r.kind for r in secrets.BASE]
    return found.select("doc_id", *[c.alias(n) for n, c in spans.digest(F.col("spans"), kinds).items()])


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.read_model(), keep=["doc_id"], check=True)


def op9_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def periodic_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words of a tenth of the documents, whose words repeat from some place on with some period."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a, places = g % n, np.arange(n)
    period = 1 + (n - a) // (3 + g % 8)
    places[a:] = a + (places[a:] - a) % period
    return places


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periods.find(docs, key="doc_id", keep=["doc_id"], view=periodic_tail)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col(f"strongest.{c}").alias(c) for c in periods.RUN.names],
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, alignment.read_models(), keep=["doc_id"], digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = token_files.write(docs, token_files.read_tokenizer(token_files.WORD_TOKENIZER), end_id=1)
    back = token_files.read(files, docs.schema["doc_id"].dataType)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_gray_simhash": op1_gray_simhash,
    "op2_disclosure_pii": op2_disclosure_pii,
    "op3_trigram_secrets": op3_trigram_secrets,
    "op4_layout_text": op4_layout_text,
    "op5_family_language": op5_family_language,
    "op6_bloom_ngrams": op6_bloom_ngrams,
    "op7_pareto_mixing": op7_pareto_mixing,
    "op8_merge_dropout": op8_merge_dropout,
    "op9_histogram_topk": op9_histogram_topk,
    "op10_hilbert_neighbours": op10_hilbert_neighbours,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_alignment": op12_token_alignment,
    "op13_wavelet_tokens": op13_wavelet_tokens,
}
