"""Secret scans: rules are verified only in texts that the trigram index cannot rule out.

Each task indexes its batch of whole texts for the trigrams that the rules name, intersects the postings by each
rule's Boolean query and runs the rule's expression on the candidates. Rules without a mandatory trigram scan
every text. Texts never leave their partition, so no source or copy group can pile up anywhere; what a batch
holds beside its texts is bounded by the index's block.

Defined cases: a null text is empty and has no spans; a text of any length is one text and is never cut. Rows
with equal ids are separate rows. Columns of other names pass through ``scan``; of the given columns only those
named like the added ones are replaced. An empty table gives an empty table. Spans are in code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutlist.llm.common import carried, kept, quoted, restored
from cutlist.llm.spans import SPANS, chunks, redacted, span_array
from cutlist.llm.trigrams import EVERY, Index, derive, named

#: Bytes of text that one index covers; a single longer text is indexed alone.
BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """``keep`` accepts or drops a match; a dropped match is not retried."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0

    def spans(self, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# The base rules, in the order in which equal starts are listed.
ASSIGN = Rule(
    "assign",
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    least=6,
    group=2,
)
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", least=20)
#: Equal to dropping short runs of [0-9a-f]+: a run can only match from its first character to its last.
HEX = Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}")
BASE = (ASSIGN, ACCESS, HEX)
#: Formats that name themselves by a prefix, so that ordinary text does not match.
PREFIXED = (
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + PREFIXED


def _scan(batches: Iterator[pa.RecordBatch], rules: Sequence[Rule], column: int, schema: pa.Schema, emit: Callable):
    queries = [derive(r.pattern) for r in rules]
    compiled = [re.compile(r.pattern) for r in rules]
    index = Index(sorted(set().union(*map(named, queries))))
    for whole in batches:
        for batch in chunks(whole, column, BATCH_BYTES):
            text = batch.column(column)
            index.fill(text)
            found: list[list] = [[] for _ in range(batch.num_rows)]
            texts: dict[int, str] = {}
            for order, (rule, query) in enumerate(zip(rules, queries)):
                rows = range(batch.num_rows) if query == EVERY else index.answer(query).tolist()
                for row in rows:
                    if row not in texts:
                        texts[row] = text[row].as_py() or ""
                    found[row] += [(a, order, b) for a, b in rule.spans(compiled[order], texts[row])]
            listed = [[(rules[o].kind, a, b) for a, o, b in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays(emit(batch, listed), schema=schema)


def _run(inner: DataFrame, rules: Sequence[Rule], schema: T.StructType, emit: Callable) -> DataFrame:
    """``inner`` has the texts in its last column."""
    arrow, at = to_arrow_schema(schema), len(inner.columns) - 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scan(batches, rules, at, arrow, emit)

    return inner.mapInArrow(task, schema)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, by default) of ``docs`` with ``spans``: kind, start, stop by start, then rule order."""
    columns = kept(docs, keep, ["spans"])
    inner = docs.select(*carried(columns), quoted(text).alias("_text"))
    schema = T.StructType(inner.drop("_text").schema.fields).add("spans", SPANS)

    def emit(batch: pa.RecordBatch, listed: list[list]) -> list[pa.Array]:
        return [*batch.columns[:-1], span_array(listed)]

    return _run(inner, rules, schema, emit).select(*restored(columns), "spans")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[kind]``; texts without spans, null too, stay as they are."""
    others = [c for c in docs.columns if c != text]
    inner = docs.select(*carried(others), quoted(text).alias("_text"))

    def emit(batch: pa.RecordBatch, listed: list[list]) -> list[pa.Array]:
        return [*batch.columns[:-1], redacted(batch.column(batch.num_columns - 1), listed, lambda kind: f"[{kind}]")]

    made = _run(inner, rules, inner.schema, emit).select(*restored(others), F.col("_text").alias(text))
    return made.select(*[quoted(c) for c in docs.columns])
