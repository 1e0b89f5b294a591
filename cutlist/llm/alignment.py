"""Alignment of two tokenizers' ids over the same text, and how often two ids share bytes in a corpus.

A is a byte-level tokenizer of the tokenizers library, B a piece model of sentencepiece. Both see a blank and the text (B
adds its own). The character offsets of A and the byte spans of B's proto (read as its offset mapping; this version of
the library refuses ``immutable_proto``) are coarse cuts. Tokens between two cuts, which share a character or are bytes of
one, are cut further by the bytes they decode to. Groups end where tokens of both end. An A and a B occurrence are
linked if their bytes overlap.

A text is aligned by units, cut before single blanks between other characters. Tokens of A never cover such a place if
it splits texts as byte-level tokenizers do, nor do those of B if no piece has a blank inside; both are looked up, and
otherwise the text is one unit. A unit is aligned once while a worker's cache holds it. Where a unit's bytes do not
come back, the whole text is aligned as one unit.

Counting: a document's distinct links are staged, counted over the corpus, and looked up again. The most frequent
links, at most ``HEAD``, are broadcast; the others are joined, so no hot link is.

Defined cases: a null or empty text, or one whose bytes either tokenizer changes, has no tokens: zeros, and '' for groups.
Strings of special tokens are ordinary text. Rows with equal texts count as so many documents, whatever their ids; null ids are
like any other. Columns of other names pass through, those named like the added ones are replaced. An empty
table gives an empty table. A text of any length is aligned whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutlist.llm.common import carried, kept, quoted, restored, staged
from cutlist.llm.spans import chunks

BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Links whose counts are broadcast.
HEAD = 1 << 18
#: Units that a worker keeps and their longest in bytes, units that are encoded as one text, and such texts at once.
CACHED = 250_000
CACHED_LENGTH = 48
GROUP = 256
ROWS = 32
#: Bytes of text that are aligned together, and links that are counted together.
BLOCK = 2 << 20
LINKS = 1 << 21
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ADDED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


class Units(NamedTuple):
    """Aligned units: three counts and the groups of each (no groups where bytes do not come back), and all links in a row."""

    counts: np.ndarray
    groups: np.ndarray
    links: np.ndarray
    sizes: np.ndarray

    def take(self, which: np.ndarray) -> Units:
        starts, each = (np.cumsum(self.sizes) - self.sizes)[which], self.sizes[which]
        ends = np.cumsum(each)
        links = self.links[np.repeat(starts - (ends - each), each) + np.arange(int(each.sum()))]
        return Units(self.counts[which], self.groups[which], links, each)


def _joined(parts: Sequence[Units]) -> Units:
    return Units(*(np.concatenate(column) for column in zip(*parts)))


def _no_units(size: int = 0) -> Units:
    return Units(np.zeros((size, 3), np.int64), np.full(size, None, object), np.zeros(0, np.int64), np.zeros(size, np.int64))


def ends_of(starts: np.ndarray, stops: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where tokens end in bytes, from their coarse spans in bytes and the sizes that they decode to.

    A cut holds after a token with a span that the next one does not reach into. Tokens between two cuts, such as parts of
    one character or bytes with an empty span before its last one, end by their sizes.
    """
    reach, by_size = np.maximum.accumulate(stops), np.cumsum(sizes)
    cut = (stops > starts) & (np.append(starts[1:], reach[-1:]) >= reach)
    before = np.concatenate([[0], np.flatnonzero(cut[:-1]) + 1])
    run = np.repeat(np.arange(len(before)), np.diff(np.append(before, len(cut))))
    begun = np.where(before > 0, reach[before - 1], 0)
    ends = np.where(cut, reach, begun[run] + by_size - np.concatenate([[0], by_size])[before][run])
    # Bytes have the last word where a library's spans do not fit them.
    return ends if (ends == by_size).all() else by_size


class Aligner:
    """Both tokenizers, the bytes of their ids, and the units aligned so far."""

    def __init__(self, definition: str, proto: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=proto)
        letters = {c: b for b, c in _byte_letters().items()}
        tokens = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=True).items())
        self.a_bytes = [b""] * (tokens[-1][0] + 1)
        for i, t in tokens:
            self.a_bytes[i] = b"".join(bytes([letters[c]]) if c in letters else c.encode() for c in t)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.b_count = len(pieces)
        self._a_size, self._b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self._names = [np.array([f"{i}{mark}" for i in range(n)], object) for n, mark in self._marks()]
        shape = json.loads(definition)
        split = shape["pre_tokenizer"] or {}
        self.by_units = (
            shape["normalizer"] is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not any("▁" in p.lstrip("▁") for p in pieces)
        )
        self._known, self._units = pa.array([], pa.large_string()), _no_units()

    def _marks(self) -> list[tuple[int, str]]:
        return [(n, mark) for n, last in ((len(self.a_bytes), "|"), (self.b_count, ";")) for mark in (",", last)]

    def align(self, texts: Sequence[str]) -> Units:
        """``texts`` as units. Those with no blank at either end are encoded many at a time, as one text."""
        inner = np.array([self.by_units and not (t[0].isspace() or t[-1].isspace()) for t in texts], bool)
        at, alone = np.flatnonzero(inner), np.flatnonzero(~inner)
        rows = [at[n : n + GROUP] for n in range(0, len(at), GROUP)] + [alone[n : n + 1] for n in range(len(alone))]
        parts, order = [_no_units()], [np.zeros(0, np.int64)]
        for n in range(0, len(rows), ROWS):
            some = rows[n : n + ROWS]
            parts.append(self._rows([[texts[i] for i in row] for row in some]))
            order += some
        back = np.empty(len(texts), np.int64)
        back[np.concatenate(order)] = np.arange(len(texts))
        return _joined(parts).take(back)

    def _rows(self, rows: list[list[str]]) -> Units:
        texts = [" ".join(units) for units in rows]
        blank = [" " + t for t in texts]
        data = [t.encode() for t in blank]
        made_a = self.a.encode_batch(blank, add_special_tokens=False)
        made_b = self.b.encode([t[1:] for t in data], num_threads=1, return_type="offset_mapping")
        whole = [
            b"".join([self.a_bytes[i] for i in a.ids]) == d == b"".join([self.b_bytes[i] for i in b["ids"]])
            for a, b, d in zip(made_a, made_b, data)
        ]
        if not all(whole):
            # A unit that does not come back must not cost its neighbours.
            good = iter(self._fitting([(u, t, d, a, b) for u, t, d, a, b, w in zip(rows, blank, data, made_a, made_b, whole) if w]))
            parts = []
            for units, w in zip(rows, whole):
                parts += [next(good)] if w else [_no_units(1)] if len(units) == 1 else [self._rows([[u] for u in units])]
            return _joined(parts)
        return _joined([_no_units(), *self._fitting(list(zip(rows, blank, data, made_a, made_b)))])

    def _fitting(self, rows: list[tuple]) -> list[Units]:
        """The units of each row whose bytes come back, by arrays over all rows, one after the other."""
        if not rows:
            return []
        units, texts, data, made_a, made_b = zip(*rows)
        lengths = np.array([len(d) for d in data], np.int64)
        bases = np.cumsum(lengths) - lengths
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        edges = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF))])
        chars = np.cumsum([0, *map(len, texts)])
        a, b = (np.array([i for m in made for i in m], np.int64) for made in ([x.ids for x in made_a], [x["ids"] for x in made_b]))
        spans_a = np.array([x for m in made_a for x in m.offsets], np.int64).reshape(-1, 2)
        spans_b = np.array([x for m in made_b for x in m["offsets"]], np.int64).reshape(-1, 2)
        spans_a = edges[spans_a + np.repeat(chars[:-1], [len(m.ids) for m in made_a])[:, None]]
        n_b = np.array([len(m["ids"]) for m in made_b], np.int64)
        # B's spans are of the text without the added blank; its first token has that, too.
        spans_b = spans_b + np.repeat(bases + 1, n_b)[:, None]
        spans_b[(np.cumsum(n_b) - n_b)[n_b > 0], 0] = bases[n_b > 0]
        a_ends = ends_of(spans_a[:, 0], spans_a[:, 1], self._a_size[a])
        b_ends = ends_of(spans_b[:, 0], spans_b[:, 1], self._b_size[b])

        group_ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(group_ends, a_ends), np.searchsorted(group_ends, b_ends)
        # Between two ends of either one, there is one token of both.
        every = np.union1d(a_ends, b_ends)
        links = a[np.searchsorted(a_ends, every)] * self.b_count + b[np.searchsorted(b_ends, every)]

        # Names in the order of groups, A's before B's.
        a_last, b_last = np.append(a_group[1:] != a_group[:-1], True), np.append(b_group[1:] != b_group[:-1], True)
        names = np.empty(len(a) + len(b), object)
        a_place = np.arange(len(a)) + np.searchsorted(b_group, a_group)
        b_place = np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")
        names[a_place] = np.where(a_last, self._names[1][a], self._names[0][a])
        names[b_place] = np.where(b_last, self._names[3][b], self._names[2][b])

        unit_ends = np.cumsum([1 + len(u.encode()) for row in units for u in row])
        cuts = [np.searchsorted(x, unit_ends, side="right") for x in (a_ends, b_ends, group_ends, every)]
        counts = np.stack([np.diff(c, prepend=0) for c in cuts], axis=1)
        listed, name_cuts = names.tolist(), [0, *(cuts[0] + cuts[1]).tolist()]
        groups = np.empty(len(unit_ends), object)
        groups[:] = ["".join(listed[x:y])[:-1] for x, y in zip(name_cuts, name_cuts[1:])]
        out, first, link_cuts = [], 0, [0, *cuts[3].tolist()]
        for row in units:
            last = first + len(row)
            out.append(Units(counts[first:last, :3], groups[first:last], links[link_cuts[first] : link_cuts[last]], counts[first:last, 3]))
            first = last
        return out

    def _looked_up(self, units: list[str]) -> tuple[Units, np.ndarray]:
        """The distinct ones of ``units``, and which one each is."""
        coded = pa.array(units, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary
        at = pc.fill_null(pc.index_in(distinct, value_set=self._known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        fresh = distinct.take(pa.array(new))
        at[new] = len(self._known) + np.arange(len(new))
        known, made = pa.concat_arrays([self._known, fresh]), _joined([self._units, self.align(fresh.to_pylist())])
        found = made.take(at)
        rows = np.arange(len(known))
        if len(known) > CACHED:
            rows = np.union1d(at, rows[len(known) - CACHED // 2 :])[-CACHED:]
        rows = rows[pc.binary_length(known.take(pa.array(rows))).to_numpy(zero_copy_only=False) <= CACHED_LENGTH]
        if len(rows) < len(known):
            known, made = known.take(pa.array(rows)), made.take(rows)
        self._known, self._units = known, made
        return found, coded.indices.to_numpy(zero_copy_only=False)

    def documents(self, texts: Sequence[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """Three counts and the groups of each text, and its distinct links with how often it has them."""
        split = [[] if not t else _CUT.split(t) if self.by_units else [t] for t in texts]
        found, codes = self._looked_up([u for units in split for u in units])
        edges = np.cumsum([0, *map(len, split)]).tolist()
        which = [codes[x:y] for x, y in zip(edges, edges[1:])]
        # A text with a unit that does not come back is looked at whole.
        faulty = np.array([g is None for g in found.groups], bool)
        parts, size = [found], len(found.groups)
        for row, units in enumerate(split):
            if units and faulty[which[row]].any():
                whole = self.align([texts[row]])
                parts.append(whole)
                which[row] = np.array([size] if whole.groups[0] is not None else [], np.int64)
                size += 1
        found = _joined(parts)
        starts = np.cumsum(found.sizes) - found.sizes
        counts, groups, links, times = np.zeros((len(texts), 3), np.int64), [], [], []
        for row, mine in enumerate(which):
            counts[row] = found.counts[mine].sum(axis=0)
            groups.append(";".join(found.groups[mine].tolist()))
            each = found.sizes[mine]
            ends = np.cumsum(each)
            held = found.links[np.repeat(starts[mine] - (ends - each), each) + np.arange(int(each.sum()))]
            distinct, often = np.unique(held, return_counts=True)
            links.append(distinct)
            times.append(often)
        return counts, groups, links, times


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + n) for n, b in enumerate(others)}}


_LOADED: dict[tuple[str, bytes], Aligner] = {}


def loaded(definition: str, proto: bytes) -> Aligner:
    """This worker's tokenizers, with the units that later tasks find cached."""
    if (definition, proto) not in _LOADED:
        _LOADED.clear()
        _LOADED[definition, proto] = Aligner(definition, proto)
    return _LOADED[definition, proto]


def read_models(a_path: str = BYTE_TOKENIZER, b_path: str = PIECE_MODEL) -> tuple[str, bytes]:
    """Both model files, read by the driver; about two megabytes, so tasks get them by value."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


def _lists(parts: Sequence[np.ndarray], kind: str) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32) * np.dtype(kind).itemsize
    data = np.concatenate([np.zeros(0, kind), *parts]).astype(kind).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def links(
    docs: DataFrame,
    models: tuple[str, bytes],
    text: str = "text",
    keep: Sequence[str] | None = None,
    digest: bool = False,
) -> DataFrame:
    """The columns ``keep`` (all, by default) with ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups``.

    ``groups`` is the text ``a1,a2|b1;a3|b2,b3`` of decimal ids, or with ``digest`` its SHA-256. The distinct links are
    packed in ``_links`` (A's id times B's vocabulary plus B's id) and ``_times``; ``_row`` numbers the rows.
    """
    columns = kept(docs, keep, _ADDED)
    inner = docs.select(*carried(columns), F.monotonically_increasing_id().alias("_row"), quoted(text).alias("_text"))
    schema = T.StructType(inner.schema.fields[:-1])
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, "long")
    schema = schema.add("groups", "string").add("_links", "binary").add("_times", "binary")
    arrow, at = to_arrow_schema(schema), len(columns) + 1
    model = docs.sparkSession.sparkContext.broadcast(models)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(*model.value)
        for batch in batches:
            for part in chunks(batch, at, BLOCK):
                counts, texts, distinct, times = aligner.documents(part.column(at).to_pylist())
                if digest:
                    texts = [t and hashlib.sha256(t.encode()).hexdigest() for t in texts]
                made = [
                    *(pa.array(column) for column in counts.T.copy()),
                    pa.array([int(t.sum()) for t in times], pa.int64()),
                    pa.array(texts, pa.string()),
                    _lists(distinct, "<u8"),
                    _lists(times, "<u4"),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *made], schema=arrow)

    return inner.mapInArrow(task, schema)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, codes and times of all links in a batch with ``_row``, ``_links`` and ``_times``."""
    codes = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(1)]
    times = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(2)]
    rows = np.repeat(batch.column(0).to_numpy(), [len(c) for c in codes])
    none = np.zeros(0, np.int64)
    return rows, np.concatenate([none, *codes]).astype(np.int64), np.concatenate([none, *times]).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of a task each link is, some millions of links at a time."""
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            held.append(_unpacked(batch.slice(at, 1024))[1])
            if sum(map(len, held)) > LINKS:
                yield flush()
    if held:
        yield flush()


def _frequent(pairs: DataFrame, most: int) -> int:
    """The smallest count from which at most ``most`` links have it, by a histogram of at most some hundred rows."""
    bucket = F.floor(F.log2(F.col("n").cast("double")) * 8)
    total, least = 0, 1 << 62
    for row in pairs.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least")).orderBy(F.desc("_b")).collect():
        total += row.n
        if total > most:
            break
        least = row.least
    return least


def pair_counts(linked: DataFrame, b_count: int) -> DataFrame:
    """Every linked pair: ``code``, ``n`` documents that hold it, and whether no other pair of its A id has more."""
    found = linked.select("_row", "_links", "_times").mapInArrow(_counted, "code bigint, n bigint")
    pairs = found.groupBy("code").agg(F.sum("n").alias("n")).withColumn("_a", F.expr(f"code div {b_count}"))
    pairs = staged(pairs)
    top = pairs.groupBy("_a").agg(F.max("n").alias("_top"))
    return pairs.join(top, "_a").select("code", "n", (F.col("n") == F.col("_top")).alias("best"))


def score(linked: DataFrame, models: tuple[str, bytes], head: int = HEAD) -> DataFrame:
    """Per ``_row`` of staged ``links``: ``n_best``, links whose count is their A id's highest, and ``count_sum`` over links."""
    spark = linked.sparkSession
    pairs = staged(pair_counts(linked, Aligner(*models).b_count))
    least = _frequent(pairs, head)
    frequent = pairs.where(F.col("n") >= least).toArrow().sort_by("code")
    known = spark.sparkContext.broadcast([frequent.column(c).to_numpy() for c in ("code", "n", "best")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_row", "code", "times", "n_best", "count_sum"]
        head_codes, head_n, head_best = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows, codes, times = _unpacked(part)
                places = np.minimum(np.searchsorted(head_codes, codes), max(len(head_codes) - 1, 0))
                hit = head_codes[places] == codes if len(head_codes) else np.zeros(len(codes), bool)
                sums = np.zeros((2, len(codes) + 1), np.int64)
                np.cumsum(np.where(hit, times * head_best[places] if len(head_codes) else 0, 0), out=sums[0, 1:])
                np.cumsum(np.where(hit, times * head_n[places] if len(head_codes) else 0, 0), out=sums[1, 1:])
                own = part.column(0).to_numpy()
                # Rows of several files may follow each other in any order, so they are cut by their sizes, not by number.
                edges = np.concatenate([[0], np.cumsum(pc.binary_length(part.column(1)).to_numpy() // 8)])
                none = pa.nulls(part.num_rows, pa.int64())
                # Codes below zero meet no pair and are spread like any other.
                columns = [pa.array(own), pa.array(-1 - own), none, *(pa.array(np.diff(s[edges])) for s in sums)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                rest = ~hit
                none = pa.nulls(int(rest.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rows[rest]), pa.array(codes[rest]), pa.array(times[rest]), none, none], names=names)

    found = linked.select("_row", "_links", "_times").mapInArrow(
        task, "_row bigint, code bigint, times bigint, n_best bigint, count_sum bigint"
    )
    rare = pairs.where(F.col("n") < least)
    none = F.lit(0).cast("bigint")
    best = F.coalesce("n_best", F.when(F.col("best"), F.col("times")), none)
    counts = F.coalesce("count_sum", F.col("times") * F.col("n"), none)
    return found.join(rare, "code", "left").groupBy("_row").agg(F.sum(best).alias("n_best"), F.sum(counts).alias("count_sum"))


def align(
    docs: DataFrame,
    models: tuple[str, bytes],
    text: str = "text",
    keep: Sequence[str] | None = None,
    digest: bool = False,
    head: int = HEAD,
) -> DataFrame:
    """``links`` with ``n_best`` and ``count_sum``, which depend on all of ``docs``."""
    columns = kept(docs, keep, _ADDED)
    linked = staged(links(docs, models, text, columns, digest))
    scored = linked.drop("_links", "_times").join(score(linked, models, head), "_row")
    return scored.select(*restored(columns), *_ADDED)
