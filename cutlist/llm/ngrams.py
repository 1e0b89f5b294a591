"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts are kept on a logarithmic scale: an n-gram seen c times is entered with the levels 1 to 1 + floor(log_b c),
and read back by probing level after level until one is missing. A count read back is never too small, and too
large only where a probe hits by chance. Unigrams and bigrams of the training texts share one filter. A token's
probability is interpolated,

    P(w | u) = a c(u w) / c(u) + (1 - a) P(w),    P(w) = (c(w) + 1) / (N + V + 1),

where c(u w) is at most c(u) and c(w), so that chance hits cannot lift a probability above one. The weight a belongs to
the level of c(u): 1 - a is the share of training tokens after such contexts whose bigram occurs once, which is
the Good-Turing estimate of meeting a new one. It is counted over all training texts by probing the finished filter.

Counting packs each block's sorted 48-bit keys by filter segment before they are shuffled; a segment's task merges
them and returns its bits only. Segments grow in number with the tokens, so a task's keys do not. The filter has
8 bits for each training token, and at most ``MOST_BITS``: that is the bound of what is collected and broadcast. Beyond it nothing is
dropped, but chance hits become more frequent (``Filter.filled`` says how full it is).

Exact counts, for the base score, are DataFrame aggregates over the words themselves. The counts of the ``HEAD`` most
frequent words are broadcast under their 64-bit hashes, and all other (text, word) pairs are joined in a shuffle.

Defined cases: a null text is an empty one and has the end token only. Without training texts all counts are 0. Rows
with equal ids are scored separately. Columns of other names pass through ``score``, those named like the added ones
are replaced. An empty table gives an empty table. Texts are scored whole, in blocks that end between words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutlist.llm.common import carried, kept, lower_ascii, quoted, restored, staged
from cutlist.llm.spans import chunks
from cutlist.llm.trigrams import lower_bytes

#: Ratio of neighbouring levels of the logarithmic counts.
BASE = 1.5
LEVELS = 64
PROBES = 3
BITS_PER_TOKEN = 8
MOST_BITS = 1 << 29
#: Words whose exact counts are broadcast, at most.
HEAD = 200_000
#: Tokens that are counted before their keys are passed on, and keys of a segment.
BLOCK_TOKENS = 1_500_000
SEGMENT_TOKENS = 2_000_000
CHUNK = 2 << 20
SPLIT = "[\\x20\\x09-\\x0D]+"
ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")

_U = np.uint64
_MASK = (1 << 64) - 1
_FACTOR, _FACTOR_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
START, END = _U(0x1234567), _U(0x89ABCDE)


def _mixed(x: np.ndarray) -> np.ndarray:
    """An invertible scramble of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(factor: int, size: int) -> np.ndarray:
    powers = np.full(size, _U(factor))
    powers[0] = 1
    return np.multiply.accumulate(powers)


@dataclass(frozen=True)
class Words:
    """All words of a batch of texts: hash, text, and place in ``raw``, the batch's lower-cased bytes."""

    raw: np.ndarray
    texts: int
    hashes: np.ndarray
    rows: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


def words_of(text: pa.Array, block: int = 1 << 20) -> Words:
    """The words of a batch of texts; a word's hash is a polynomial over its bytes, scrambled."""
    raw, starts = lower_bytes(text)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    first = np.zeros(len(raw) + 1, bool)
    first[starts[:-1]] = True  # a text's first byte starts a word of its own
    at = 0
    up = down = np.ones(1, _U)
    while at < len(raw):
        stop = min(len(raw), at + block)
        while stop < len(raw) and not _BLANK[raw[stop]] and not first[stop]:
            rest = np.flatnonzero(_BLANK[raw[stop : stop + block]] | first[stop : stop + len(raw[stop : stop + block])])
            stop = stop + int(rest[0]) if len(rest) else min(len(raw), stop + block)
        part = raw[at:stop]
        if len(part) >= len(up):
            up, down = _powers(_FACTOR, len(part) + 1), _powers(_FACTOR_INVERSE, len(part) + 1)
        word = ~_BLANK[part]
        cut = first[at:stop]
        begins = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]) | word & cut)
        ends = np.flatnonzero(word & np.concatenate([~word[1:] | cut[1:], [True]])) + 1
        sums = np.concatenate([np.zeros(1, _U), np.cumsum((part.astype(_U) + _U(1)) * up[: len(part)], dtype=_U)])
        hashes = _mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(_U) * _U(_FACTOR))
        parts.append((hashes, begins + at, ends + at))
        at = stop
    none = (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    hashes, begins, ends = (np.concatenate(x) for x in zip(none, *parts))
    return Words(raw, len(text), hashes, np.searchsorted(starts, begins, side="right") - 1, begins, ends)


def _single(tokens: np.ndarray) -> np.ndarray:
    """Keys of unigrams."""
    return _mixed(tokens + _U(1)) >> _U(16)


def token_keys(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, whether a text's first, bigram key, row) of all tokens of a batch of texts, the end tokens included."""
    hashes, rows = words.hashes, words.rows
    counts = np.bincount(rows, minlength=words.texts).astype(np.int64)
    last = np.cumsum(counts + 1) - 1
    tokens = np.full(len(hashes) + words.texts, END)
    tokens[np.arange(len(hashes)) + rows] = hashes
    first = np.zeros(len(tokens), bool)
    first[last - counts] = True
    before = np.concatenate([np.zeros(1, _U), tokens[:-1]])
    before[first] = START
    bigrams = _mixed(before * _U(3) + _mixed(tokens)) >> _U(16)
    return tokens, first, bigrams, np.repeat(np.arange(words.texts), counts + 1)


# Counting and the filter


def level_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(np.maximum(count, 1)) / math.log(BASE) + 1e-9), LEVELS).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The mean of a level's counts; 0 for level 0."""
    return np.where(level > 0, (BASE ** (level - 1.0) + np.maximum(BASE**level - 1, BASE ** (level - 1.0))) / 2, 0.0)


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    return _mixed(keys + _U(level * _FACTOR & _MASK))


def _place(x: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Place of a probe: 32 bits of the hash, scaled to the number of bits."""
    return ((x >> _U(32 - 16 * probe)) & _U(0xFFFFFFFF)) * _U(bits) >> _U(32)


@dataclass(frozen=True)
class Filter:
    """``segments`` ranges of the 48-bit keys with ``bits`` bits each."""

    segments: int
    bits: int
    data: np.ndarray

    @property
    def filled(self) -> float:
        return float(np.bitwise_count(self.data).sum()) / max(1, 8 * len(self.data))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Each key's level, by probing until one is missing."""
        level = np.zeros(len(keys), np.int64)
        base = ((keys * _U(self.segments)) >> _U(48)) * _U(self.bits)
        alive = np.arange(len(keys))
        for i in range(1, LEVELS + 1):
            x = _hash(keys, i)
            for probe in range(PROBES):
                place = _place(x, probe, self.bits) + base
                hit = ((self.data[place >> _U(3)] >> (place & _U(7)).astype(np.uint8)) & 1).astype(bool)
                x, keys, base, alive = x[hit], keys[hit], base[hit], alive[hit]
            if not len(alive):
                break
            level[alive] = i
        return level


def _count(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """Per block of tokens and segment: sorted keys in six bytes each, and their counts."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        segment = (keys * _U(segments)) >> _U(48)
        cuts = np.searchsorted(segment, np.arange(segments + 1, dtype=_U))
        six = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :6])
        full = np.flatnonzero(np.diff(cuts))
        counts = counts.astype(np.uint32)
        return pa.RecordBatch.from_pydict(
            {
                "segment": pa.array(full, pa.int64()),
                "keys": pa.array([six[cuts[s] : cuts[s + 1]].tobytes() for s in full], pa.binary()),
                "counts": pa.array([counts[cuts[s] : cuts[s + 1]].tobytes() for s in full], pa.binary()),
            }
        )

    for batch in batches:
        for part in chunks(batch, 0, CHUNK):
            tokens, _, bigrams, _ = token_keys(words_of(part.column(0)))
            # A start for each text: the context of its first token.
            held += [_single(tokens), bigrams, _single(np.full(part.num_rows, START))]
            size += len(tokens)
            if size >= BLOCK_TOKENS:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _segment(table: pa.Table, bits: int) -> pa.Table:
    """One segment's bits from all its packed keys."""
    packed = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint8).reshape(-1, 6)
    keys = np.zeros((len(packed), 8), np.uint8)
    keys[:, :6] = packed
    keys = keys.view(_U).ravel()
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, level = keys[cuts], level_of(np.add.reduceat(counts, cuts))
    on = np.zeros(bits, bool)
    for i in range(1, int(level.max()) + 1):
        x = _hash(keys[level >= i], i)
        for probe in range(PROBES):
            on[_place(x, probe, bits)] = True
    return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})


def build_filter(training: DataFrame, tokens: int, text: str = "text", most_bits: int = MOST_BITS) -> Filter:
    """The filter over the unigrams and bigrams of the training texts, which hold ``tokens`` tokens."""
    segments = min(max(1, math.ceil(tokens / SEGMENT_TOKENS)), (1 << 16) - 1)
    total = min(most_bits, max(1024, BITS_PER_TOKEN * tokens))
    bits = 8 * math.ceil(total / segments / 8)
    packed = training.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(
        lambda batches: _count(batches, segments), "segment long, keys binary, counts binary"
    )
    made = packed.groupBy("segment").applyInArrow(lambda table: _segment(table, bits), "segment long, bits binary")
    data = np.zeros(segments * bits // 8, np.uint8)
    for row in made.toLocalIterator():  # most_bits in all
        data[row["segment"] * bits // 8 : (row["segment"] + 1) * bits // 8] = np.frombuffer(row["bits"], np.uint8)
    return Filter(segments, bits, data)


# Exact counts


def word_counts(training: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all words of the training texts, A-Z lower-cased."""
    words = F.explode(F.split(lower_ascii(F.col(text)), SPLIT)).alias("word")
    return training.select(words).where("word <> ''").groupBy("word").agg(F.count("*").alias("c"))


def _head_from(counts: DataFrame, head: int) -> int:
    """The smallest count whose words, and all more frequent ones, are at most ``head``; by powers of 1.25."""
    step = F.floor(F.log(F.col("c").cast("double")) / F.log(F.lit(1.25)) + 1e-9)
    sizes = {r["step"]: r["n"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    seen, least = 0, max(sizes, default=0) + 1
    for s in sorted(sizes, reverse=True):
        seen += sizes[s]
        if seen > head:
            break
        least = s
    return math.ceil(1.25**least - 1e-6)


@dataclass(frozen=True)
class Model:
    """``tokens``, ``distinct`` and ``texts`` of the training part; ``counts`` is a stored table of exact counts.

    ``head`` has the hashes of words with at least ``head_from`` occurrences, ascending, and log10(c + 1) of each.
    """

    filter: Filter
    weights: np.ndarray
    counts: DataFrame
    head: tuple[np.ndarray, np.ndarray]
    head_from: int
    tokens: int
    distinct: int
    texts: int


def train(training: DataFrame, text: str = "text", head: int = HEAD, most_bits: int = MOST_BITS) -> Model:
    counts = staged(word_counts(training, text))
    texts = training.count()
    row = counts.agg(F.sum("c"), F.count("*")).first()
    tokens, distinct = int(row[0] or 0) + texts, int(row[1]) + (texts > 0)
    least = _head_from(counts, head)
    frequent = counts.where(F.col("c") >= least).toArrow()  # ``head`` words at most
    keys = words_of(frequent.column("word").combine_chunks()).hashes if frequent.num_rows else np.zeros(0, _U)
    order = np.argsort(keys)
    logs = np.log10(frequent.column("c").to_numpy().astype(np.float64) + 1)
    bloom = build_filter(training, tokens, text, most_bits)
    return Model(bloom, fit_weights(training, bloom, text), counts, (keys[order], logs[order]), least, tokens, distinct, texts)


# Scoring


def _counts(words: Words, bloom: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, level of the token, level of its context, level of the bigram) of every token of a batch."""
    tokens, first, bigrams, row = token_keys(words)
    codes, distinct = pd.factorize(tokens)
    own = bloom.levels(_single(distinct))[codes]
    context = np.concatenate([np.zeros(1, np.int64), own[:-1]])
    context[first] = bloom.levels(_single(np.array([START])))[0]
    both = np.zeros(len(tokens), np.int64)
    seen = np.flatnonzero((own > 0) & (context > 0))
    both[seen] = bloom.levels(bigrams[seen])
    return row, own, context, np.minimum(both, np.minimum(own, context))


def fit_weights(training: DataFrame, bloom: Filter, text: str = "text") -> np.ndarray:
    """The bigram's weight for each level of its context."""
    shared = training.sparkSession.sparkContext.broadcast(bloom)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, once = np.zeros(LEVELS + 1, np.int64), np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for part in chunks(batch, 0, CHUNK):
                _, _, context, both = _counts(words_of(part.column(0)), shared.value)
                every += np.bincount(context, minlength=LEVELS + 1)
                once += np.bincount(context[both <= 1], minlength=LEVELS + 1)
        yield pa.RecordBatch.from_pydict({"level": np.arange(LEVELS + 1), "every": every, "once": once})

    texts = training.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = texts.mapInArrow(task, "level long, every long, once long").groupBy("level").agg(F.sum("every"), F.sum("once"))
    weights = np.zeros(LEVELS + 1)
    for level, every, once in found.collect():  # a row per level
        weights[level] = 1 - once / every if every else 0.0
    return weights


def _scores(words: Words, model: tuple) -> np.ndarray:
    """The model's log10 probability of each text."""
    bloom, weights, tokens, distinct = model
    row, own, context, both = _counts(words, bloom)
    alone = np.minimum((count_of(own) + 1) / (tokens + distinct + 1), 1.0)
    a = weights[context]
    p = a * count_of(both) / np.maximum(count_of(context), 1) + (1 - a) * alone
    return np.bincount(row, weights=np.log10(p), minlength=words.texts)


def _known(words: Words, head: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of each text the number of broadcast words and the sum of their logarithms; and all others as (text, word, times)."""
    keys, logs = head
    codes, distinct = pd.factorize(words.hashes)
    at = np.minimum(np.searchsorted(keys, distinct), max(0, len(keys) - 1))
    found = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
    there = found[codes]
    row, size = words.rows, words.texts
    known = np.bincount(row[there], minlength=size)
    total = np.bincount(row[there], weights=logs[at][codes[there]], minlength=size) if len(keys) else np.zeros(size)
    pairs, times = np.unique(row[~there] * (len(distinct) + 1) + codes[~there], return_counts=True)
    who, code = np.divmod(pairs, len(distinct) + 1)
    # One occurrence gives a word's bytes.
    rare = np.flatnonzero(~found)
    where = np.zeros(len(distinct), np.int64)
    where[codes] = np.arange(len(codes))
    raw = words.raw.tobytes()
    spelled = pa.array([raw[a:b] for a, b in zip(words.begins[where[rare]].tolist(), words.ends[where[rare]].tolist())], pa.binary())
    return known, total, who, spelled.take(pa.array(np.searchsorted(rare, code))).cast(pa.string()), times


def score(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, by default) of ``docs`` with n_tokens, n_known, train_tokens, base_score and score."""
    columns = kept(docs, keep, ADDED)
    numbered = docs.select(*carried(columns), quoted(text).alias("_text"), F.monotonically_increasing_id().alias("_id"))
    fields = numbered.schema.fields[: len(columns)]
    schema = T.StructType(
        [*fields]
        + [T.StructField("_row", T.LongType()), T.StructField("_word", T.StringType()), T.StructField("_times", T.LongType())]
        + [T.StructField("_tokens", T.LongType()), T.StructField("_known", T.LongType())]
        + [T.StructField("_base", T.DoubleType()), T.StructField("_score", T.DoubleType())]
    )
    arrow, at = to_arrow_schema(schema), len(columns)
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.head, (model.filter, model.weights, model.tokens, model.distinct), math.log10(model.texts + 1), int(model.texts > 0))
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, bloom, end, end_known = shared.value
        for whole in batches:
            for batch in chunks(whole, at, CHUNK):
                words = words_of(batch.column(at))
                size = np.bincount(words.rows, minlength=words.texts) + 1
                known, base, who, names, times = _known(words, head)
                none = [pa.nulls(len(who), f.type) for f in list(arrow)[:at]]
                texts = [
                    *batch.columns[:at], batch.column(at + 1), pa.nulls(len(size), pa.string()),
                    pa.nulls(len(size), pa.int64()), pa.array(size), pa.array(known + end_known), pa.array(base + end),
                    pa.array(_scores(words, bloom)),
                ]
                yield pa.RecordBatch.from_arrays(texts, schema=arrow)
                if len(who):
                    rest = [pa.nulls(len(who), f.type) for f in list(arrow)[at + 3 :]]
                    ids = batch.column(at + 1).take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([*none, ids, names, pa.array(times), *rest], schema=arrow)

    # One pass over the texts gives a row per text and one per text and rare word; each joins its own kind.
    made = numbered.mapInArrow(task, schema)
    # A text's own row has a key that no word is, so that these rows spread over all partitions.
    made = made.withColumn("_key", F.coalesce("_word", F.concat(F.lit(" "), F.col("_row").cast("string"))))
    rare = model.counts.where(F.col("c") < model.head_from)
    counted = made.join(rare, F.col("_key") == F.col("word"), "left")
    part: Column = F.col("_times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    summed = counted.groupBy("_row").agg(
        *[F.max_by(c, F.col("_tokens").isNotNull()).alias(c) for c in numbered.columns[: len(columns)]],
        F.max("_tokens").alias("n_tokens"),
        (F.max("_known") + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("_times"))), F.lit(0))).alias("n_known"),
        (F.max("_base") + F.coalesce(F.sum(part), F.lit(0.0))).alias("_sum"),
        F.max("_score").alias("score"),
    )
    total = math.log10(model.tokens + model.distinct + 1)
    return summed.select(
        *restored(columns), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("_sum") - F.col("n_tokens") * F.lit(total)).alias("base_score"), "score",
    )
