"""Corpus pipeline over ``documents``: stages applied one after the other, each on all that the last one kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Columns
that ``docs`` has besides those of documents pass through, whatever their names, up to the last stage.

Defined cases, beyond what the operators state: a null or letterless text is rejected by the first stage, so later
ones see none of their own making; an empty table goes through as an empty table; repeated rows are near-duplicates of
each other, so one of them stays; equal rows that the mix repeats are encoded alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlist.llm import graygroups, languages, mixing, pieces, secrets
from cutlist.llm.common import kept, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts in no language and fill in the language where a document has none.

    The model is learned from the documents' own labels. A text with letters is never dropped, however sure or unsure
    its language is; without any label to learn from, languages stay as they are.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    model = languages.train(docs)
    # Under plain names, so that a column of docs named like an added one stays.
    found = languages.predict(docs.toDF(*names), model, text=at["text"])
    if model.languages:
        found = found.where(F.col("lang_pred") != languages.UNDETERMINED)
        found = found.withColumn(at["lang"], F.coalesce(at["lang"], "lang_pred"))
    else:
        found = found.where(F.col(at["text"]).rlike(r"\p{L}"))
    return found.select(*names).toDF(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the smallest id."""
    return graygroups.deduplicate(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays, and n_chars follows its text."""
    found = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return found
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and thin out documents so that sources come near their target shares."""
    others = kept(docs, None, mixing.ADDED)
    if others == docs.columns:
        return mixing.expand(mixing.mixed(docs))
    # Columns named like the mix's own go through under other names.
    names = [f"_own{i}" if c not in others else c for i, c in enumerate(docs.columns)]
    return mixing.expand(mixing.mixed(docs.toDF(*names))).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document's text."""
    return pieces.encode(docs, pieces.read_model(), keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("simhash_near_dedup", deduplicate),
    ("secret_scan", redact),
    ("source_mix", mix),
    ("piece_encoding", encode),
]

#: The language and piece models cannot be said in SQL: the stages are tested against plain Python versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
