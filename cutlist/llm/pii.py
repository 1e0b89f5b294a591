"""Personal data: base patterns, and terms that give the found values away.

A value found by a pattern (an address, a number) is a protected entity. A term that stands near it again and
again, and hardly anywhere else, reveals it even where the value itself has been removed. With probabilities
over the distinct texts of the whole corpus, a term's disclosure of an entity is

    PMI(entity; term) / IC(entity) = log(n(e, t) D / (n(e) n(t))) / log(D / n(e)),

which is 1 for a term that occurs with the entity only. Terms above ``generalise`` are replaced by their class
wherever they occur, terms above ``remove`` by nothing. As evidence a pair needs ``contexts`` different
surroundings, so that copies of one passage, however many, count once.

Only pairs within ``reach`` terms of a mention are counted, so their number grows with the mentions and no
group of texts is paired with itself. Terms are counted over all texts, in Spark, for the terms of such pairs.

Defined cases: a null text is empty. A text of any length is one text. Rows with equal ids or texts are separate
rows with spans of their own; equal texts count once in the statistics. Columns of other names pass through
``find`` untouched except one named like the added ``spans``. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutlist.llm.common import carried, kept, quoted, restored, staged
from cutlist.llm.spans import SPANS, redacted, span_array

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the method's own spans, listed after the base kinds.
GENERAL, REMOVED = "term", "removed_term"

# The base patterns. Each is written so that a failing start is not tried again inside its run.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]+")
#: The same terms in Spark's expressions.
BETWEEN_TERMS = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Disclosure:
    """``generalise`` and ``remove`` are shares of an entity's information that a term gives away."""

    generalise: float = 0.95
    remove: float = 0.999
    contexts: int = 3
    reach: int = 8
    letters: int = 3


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from each @ outward so that long runs cost their length."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((start, match.end()))
            done = match.end()
        at = text.find("@", match.end() if match else at + 1)
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds' spans by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        # A shorter run of characters has too few digits; a longer one than 37 has too many.
        if 14 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def value_of(kind: str, match: str) -> str:
    """One spelling per entity: addresses in lower case, numbers without their separators."""
    return f"{kind}:{match.lower() if kind in ('email', 'ip') else ''.join(c for c in match if c.isdigit())}"


class Cover:
    """Where spans lie, as disjoint ranges in order."""

    def __init__(self, spans: Sequence[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.stops: list[int] = []
        for _, start, stop in spans:
            if self.stops and start < self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], stop)
            else:
                self.starts.append(start)
                self.stops.append(stop)

    def meets(self, start: int, stop: int) -> bool:
        """Whether any span shares a character with [start, stop)."""
        at = bisect_left(self.starts, stop)
        return at > 0 and self.stops[at - 1] > start


def surroundings(text: str, spans: Sequence[tuple[str, int, int]], rule: Disclosure) -> Iterator[tuple[str, list[str]]]:
    """(entity, terms within reach) per mention; terms inside any base span do not count."""
    width, cover = 24 * rule.reach, Cover(spans)
    for kind, start, stop in spans:
        near = []
        for low, high in ((max(0, start - width), start), (stop, min(len(text), stop + width))):
            side = [
                m[0]
                for m in TERM.finditer(text, low, high)
                # Cut terms at the edge of the looked-at part are none.
                if (m.start() > low or low in (0, stop)) and (m.end() < high or high in (len(text), start))
                and len(m[0]) >= rule.letters and not cover.meets(m.start(), m.end())
            ]
            near += side[-rule.reach :] if high == start else side[: rule.reach]
        yield value_of(kind, text[start:stop]), near


def mentions(docs: DataFrame, rule: Disclosure, text: str) -> DataFrame:
    """(digest, entity, terms) per mention in any text."""
    schema = T.StructType(
        [
            T.StructField("digest", T.LongType()),
            T.StructField("entity", T.StringType()),
            T.StructField("terms", T.ArrayType(T.StringType())),
        ]
    )
    arrow = to_arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, value in zip(batch.column(0), batch.column(1)):
                if whole := value.as_py():
                    spans = base_spans(whole)
                    if spans:
                        key = digest.as_py()
                        rows += [(key, e, near) for e, near in surroundings(whole, spans, rule)]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(F.xxhash64(text).alias("digest"), F.col(text).alias("text")).mapInArrow(task, schema)


def disclosing_terms(docs: DataFrame, rule: Disclosure = Disclosure(), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(term, entity, disclosure, kind) for every disclosing term, and (digest, term) for texts that hold one."""
    seen = staged(mentions(docs, rule, text))
    corpus = docs.agg(F.countDistinct(F.xxhash64(text)).alias("corpus"))
    entities = seen.groupBy("entity").agg(F.countDistinct("digest").alias("n_entity"))
    near = staged(
        seen.withColumn("context", F.xxhash64("terms")).select(
            "digest", "entity", "context", F.explode(F.transform("terms", F.lower)).alias("term")
        )
    )
    # Texts with the term near any entity are a lower bound of its texts, and so give an upper bound of what it
    # discloses: common words end here, before they are looked up in the whole corpus.
    least = near.groupBy("term").agg(F.countDistinct("digest").alias("n_least"))
    information = F.log(F.col("corpus") / F.col("n_entity"))

    def disclosure(n_term: str) -> Column:
        mutual = F.log(F.col("n_both") * F.col("corpus") / (F.col("n_entity") * F.col(n_term)))
        return F.when(information > 0, mutual / information).otherwise(0.0)

    pairs = staged(
        near.groupBy("entity", "term")
        .agg(F.countDistinct("digest").alias("n_both"), F.countDistinct("context").alias("contexts"))
        .where(F.col("contexts") >= rule.contexts)
        .join(entities, "entity")
        .join(least, "term")
        .crossJoin(F.broadcast(corpus))  # one row
        .where(disclosure("n_least") >= rule.generalise)
    )
    terms = F.explode(F.array_distinct(F.split(F.lower(text), BETWEEN_TERMS))).alias("term")
    holding = staged(
        docs.select(F.xxhash64(text).alias("digest"), terms)
        .join(staged(pairs.select("term").distinct()), "term", "left_semi")
        .distinct()
    )
    counts = holding.groupBy("term").agg(F.count("*").alias("n_term"))
    scored = pairs.join(counts, "term").withColumn("disclosure", disclosure("n_term")).where(F.col("disclosure") >= rule.generalise)
    best = scored.groupBy("term").agg(
        F.max_by("entity", F.struct("disclosure", "entity")).alias("entity"), F.max("disclosure").alias("disclosure")
    )
    kind = F.when(F.col("disclosure") >= rule.remove, REMOVED).otherwise(GENERAL)
    flagged = staged(best.withColumn("kind", kind))
    return flagged, holding.join(flagged, "term", "left_semi")


def all_spans(text: str, kinds: dict[str, str]) -> list[tuple[str, int, int]]:
    """Base spans, and those of the disclosing terms ``kinds`` outside them."""
    base = base_spans(text)
    if not kinds:
        return base
    cover = Cover(base)
    told = ((kinds.get(m[0].lower()), m.start(), m.end()) for m in TERM.finditer(text))
    own = [(k, a, b) for k, a, b in told if k and not cover.meets(a, b)]
    order = {k: i for i, k in enumerate((*KINDS, GENERAL, REMOVED))}
    return sorted([*base, *own], key=lambda s: (s[1], order[s[0]]))


def _run(docs: DataFrame, rule: Disclosure, text: str, columns: Sequence[str], emit: Callable, last: T.DataType) -> DataFrame:
    """The carried columns and one more, which ``emit`` makes of texts and their spans."""
    inner = docs.select(*carried(columns), quoted(text).alias("_text"), F.xxhash64(quoted(text)).alias("_digest"))
    flagged, holding = disclosing_terms(inner.select("_text"), rule, "_text")
    kinds = F.map_from_entries(F.collect_set(F.struct("term", "kind"))).alias("_kinds")
    by_text = staged(holding.join(flagged, "term").groupBy("digest").agg(kinds))
    # Mostly few texts hold such a term; Spark broadcasts the table only if its measured size allows that.
    told = inner.join(by_text, F.col("_digest") == F.col("digest"), "left").drop("_digest", "digest")
    at = len(columns)
    schema = T.StructType(told.schema.fields[:at]).add("_made", last)
    arrow = to_arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = batch.column(at), batch.column(at + 1)
            listed = [all_spans(t.as_py() or "", dict(k.as_py() or ())) for t, k in zip(texts, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], emit(texts, listed)], schema=arrow)

    return told.mapInArrow(task, schema)


def find(docs: DataFrame, rule: Disclosure = Disclosure(), text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, by default) of ``docs`` with ``spans``: base kinds and disclosing terms."""
    columns = kept(docs, keep, ["spans"])
    made = _run(docs, rule, text, columns, lambda texts, listed: span_array(listed), SPANS)
    return made.select(*restored(columns), F.col("_made").alias("spans"))


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure(), text: str = "text") -> DataFrame:
    """``docs`` with found values and general terms replaced by ``[kind]`` and the most telling terms removed."""
    others = [c for c in docs.columns if c != text]
    mark = lambda kind: "" if kind == REMOVED else f"[{kind}]"
    made = _run(docs, rule, text, others, lambda texts, listed: redacted(texts, listed, mark), T.StringType())
    return made.select(*restored(others), F.col("_made").alias(text)).select(*[quoted(c) for c in docs.columns])
