"""Encoding with a public merge-type piece model under seeded merge-dropout, and lossless decoding.

Encoding processes an agenda of candidate merges, best score first. Each candidate that comes up is skipped if
the hash stream of the unit's occurrence, keyed by the seed, says so; skipped ones return to the agenda after the next
merge. An encoding depends on nothing but text, seed, rate and key: any task on any executor makes the same
one again. With rate 0 the result is the model's own segmentation.

Texts are cut into units before blanks, at line feeds and at literal U+2581, none of which lies inside a piece, and
each occurrence of a unit has a hash stream of its own, from the document's key and the occurrence's place. A stream gives
the numbers of merged candidates between skipped ones, and so the pattern of skips; the pattern settles the segmentation.
A segmentation is computed once per unit and pattern while it is in the worker's cache, whose size is bounded; only time
depends on the cache. New units are segmented together, as rows of arrays.

Characters outside the vocabulary become byte pieces, and so does a literal U+2581, which stands for a blank in
pieces. Decoding joins the pieces' bytes, and so returns every text exactly.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids. Rows with equal keys and texts
have equal ids, a null key counts as empty. Columns of other names pass through; those named like the added
ones are replaced. An empty table gives an empty table. No text is cut; a unit of any length is one agenda.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutlist.llm.common import carried, kept, quoted, restored
from cutlist.llm.spans import chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Hash streams: one for every document and place.
VARIANTS = 1 << 64
#: Draws that a pattern of skips covers; units that may take more are segmented by their streams.
PLACES = 43
#: Segmentations that a worker keeps: as many again that were used before the newest ones filled up.
CACHED = 150_000
CACHED_LENGTH = 48
#: Units whose segmentations are looked up together, and of the new ones the rows of one matrix.
GROUP = 400_000
#: Bytes of text that are encoded together.
BLOCK = 2 << 20
ROWS = 8192
#: Longer units have an agenda of their own.
SHORT = 24
NEVER = 1 << 60
_MASK, _STREAM, _STEP = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
UNITS = re.compile(r" *[^ \n▁]+| +|[\n▁]")
_ADDED = ("ids", "n_pieces")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spread(place: int, start: int, size: int) -> np.ndarray:
    """A variant for each place in a document, by a hash of document and place."""
    return _mixed(np.arange(start, start + size, dtype=np.uint64) + np.uint64(place & _MASK))


def _streams(variants: Sequence[int] | np.ndarray, seed: int) -> np.ndarray:
    return _mixed(np.asarray(variants, np.uint64) ^ _mixed(np.array([seed & _MASK], np.uint64) + np.uint64(_STREAM)))


def _shares(rate: float) -> np.ndarray:
    """Ascending: the chances, in 2^-64, that PLACES, ..., 2, 1 draws in a row skip nothing. Whole numbers, so exact anywhere."""
    keep, chance, out = (1 << 64) - min(int(rate * 2**64), 1 << 64), 1 << 64, []
    for _ in range(PLACES):
        chance = chance * keep >> 64
        out.append(min(chance, _MASK))
    return np.array(out[::-1], np.uint64)


def _gaps(streams: np.ndarray, nth: int, shares: np.ndarray) -> np.ndarray:
    """Draws that skip nothing before the next one that skips; PLACES stands for that many and a new gap."""
    with np.errstate(over="ignore"):
        return PLACES - np.searchsorted(shares, _mixed(streams + np.uint64(nth * _STEP & _MASK)), side="right")


def _patterns(streams: np.ndarray, merges: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """A bit for each draw that skips, before at most ``merges`` have merged; -1 where that takes over PLACES draws."""
    pattern, alive = np.zeros(len(streams), np.int64), np.flatnonzero(merges > 0)
    place, left, nth = np.zeros(len(alive), np.int64), merges[alive], 0
    while len(alive):
        nth += 1
        gap = _gaps(streams[alive], nth, shares)
        go = gap < left
        alive, place, left, gap = alive[go], place[go] + gap[go], left[go] - gap[go], gap[go]
        far = place >= PLACES
        pattern[alive[far]] = -1
        near = ~far
        alive, place, left, gap = alive[near], place[near], left[near], gap[near]
        pattern[alive] |= np.int64(1) << place
        place = place + 1
    return pattern


class Pieces:
    """The vocabulary of a merge-type model; ``rank`` orders merges, best first."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: list[int], surface: list[bytes]):
        self.id, self.bytes_, self.surface = ids, byte_ids, surface
        places = {v: n for n, v in enumerate(sorted(set(scores.values())))}
        self.rank = {p: places[v] for p, v in scores.items()}
        self.cache: dict[tuple[str, int], bytes] = {}
        self.older: dict[tuple[str, int], bytes] = {}
        # The same as arrays: pieces of one character by code point, and merges by their two halves.
        self._letter = np.full(1 << 16, -1, np.int64)
        merges = []
        for piece, i in ids.items():
            if len(piece) == 1 and ord(piece) < len(self._letter):
                self._letter[ord(piece)] = i
            halves = ((ids.get(piece[:n]), ids.get(piece[n:])) for n in range(1, len(piece)))
            merges += [(a << 32 | b, self.rank[piece], i) for a, b in halves if a is not None and b is not None]
        table = np.array(sorted(merges), np.int64).reshape(-1, 3)
        self._pairs, self._ranks, self._made = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()

    @classmethod
    def load(cls, proto: bytes) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=proto)
        scores, ids, byte_ids, surface = {}, {}, [0] * 256, []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
                surface.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                surface.append(b"")
            else:
                surface.append(piece.replace("▁", " ").encode())
                if not model.is_unused(i):
                    scores[piece], ids[piece] = -model.get_score(i), i
        return cls(scores, ids, byte_ids, surface)

    # One unit

    def segment(self, unit: str, rate: float, seed: int, variant: int) -> list[int]:
        """Piece ids of one unit, whose blanks are written U+2581, by an agenda that is a heap.

        Entries whose parts have been merged since are passed over.
        """
        rank, shares, stream = self.rank, _shares(rate) if rate else None, _streams([variant], seed)
        nth, merging = 0, 0  # gaps that have been drawn, and draws up to the next skip

        def skips() -> bool:
            nonlocal nth, merging
            while merging == 0:
                nth += 1
                gap = int(_gaps(stream, nth, shares)[0])
                merging = gap if gap == PLACES else -gap - 1
            if merging > 0:
                merging -= 1
                return False
            merging += 1
            return merging == 0

        parts: list[str | None] = list(unit)
        size = len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        agenda: list[tuple[int, int, str, str]] = []

        def propose(i: int, j: int) -> None:
            joined = parts[i] + parts[j]
            if joined in rank:
                heappush(agenda, (rank[joined], i, joined, parts[i]))

        for i in range(size - 1):
            propose(i, i + 1)
        skipped: list[tuple] = []
        while agenda:
            top = heappop(agenda)
            _, i, joined, left = top
            j = after[i]
            if parts[i] != left or j >= size or left + parts[j] != joined:
                continue
            if rate and skips():
                skipped.append(top)
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            for candidate in skipped:
                heappush(agenda, candidate)
            skipped = []
            if after[i] < size:
                before[after[i]] = i
                propose(i, after[i])
            if before[i] >= 0:
                propose(before[i], i)
        ids: list[int] = []
        for part in parts:
            if part is not None:
                ids += [self.id[part]] if part in self.id else [self.bytes_[b] for b in part.encode()]
        return ids

    # Many units

    def _merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of the merge table for each pair of ids, -1 where they do not merge or one is missing."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (self._pairs[at] == pair), at, -1)

    def _agenda(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self._merges(left, right)
        return np.where(at >= 0, self._ranks[at], NEVER)

    def segment_many(self, units: Sequence[str], variants: Sequence[int], rate: float, seed: int) -> list[bytes]:
        """Packed ids of many units, as ``segment`` gives them."""
        merges = np.array([len(u) - 1 for u in units], np.int64)
        streams = _streams(variants, seed)
        patterns = _patterns(streams, merges, _shares(rate)) if rate else np.zeros(len(units), np.int64)
        return self._segmented(units, patterns, variants, rate, seed)

    def _segmented(self, units: Sequence[str], patterns: np.ndarray, variants: Sequence[int], rate: float, seed: int) -> list[bytes]:
        """Packed ids of many units by their patterns of skips: their agendas are the rows of one matrix.

        Every round takes the best entry of each row, leftmost first, and either skips it, which hides it until the
        row's next merge, or merges. Units that are long, hold a character outside the vocabulary or have no pattern go
        one by one; any variant with the same pattern gives the same ids.
        """
        out: list[bytes | None] = [None] * len(units)
        sizes = np.array([len(u) for u in units], np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        letters = np.where(points < len(self._letter), self._letter[np.minimum(points, len(self._letter) - 1)], -1)
        starts = np.cumsum(sizes) - sizes
        unknown = np.add.reduceat(letters < 0, starts) > 0 if len(units) else np.zeros(0, bool)
        single = unknown | (sizes > SHORT) | (patterns < 0)
        for i in np.flatnonzero(single):
            out[i] = np.array(self.segment(units[i], rate, seed, int(variants[i])), np.int32).tobytes()
        plain = np.flatnonzero(~single)
        plain = plain[np.argsort(sizes[plain], kind="stable")]
        for at in range(0, len(plain), ROWS):
            rows = plain[at : at + ROWS]
            width = int(sizes[rows].max())
            cols = np.arange(width)
            ids = np.where(cols < sizes[rows][:, None], letters[np.minimum(starts[rows][:, None] + cols, len(letters) - 1)], -1)
            done = self._merged(ids, patterns[rows])
            held = done >= 0
            cuts = np.concatenate([[0], np.cumsum(held.sum(axis=1))]) * 4
            buffer = done[held].astype(np.int32).tobytes()
            for n, i in enumerate(rows):
                out[i] = buffer[cuts[n] : cuts[n + 1]]
        return out

    def _merged(self, ids: np.ndarray, patterns: np.ndarray) -> np.ndarray:
        """``ids`` after all merges, what is left of a row at its beginning."""
        result = ids.copy()
        if ids.shape[1] < 2:
            return result
        ids = np.concatenate([ids, np.full((len(ids), 1), -1)], axis=1)
        agenda = np.concatenate([self._agenda(ids[:, :-1], ids[:, 1:]), np.full((len(ids), 1), NEVER)], axis=1)
        hidden = np.full_like(agenda, NEVER)
        whose, rest = np.arange(len(ids)), patterns.copy()
        cols = np.arange(ids.shape[1])
        while len(whose):
            at = agenda.argmin(axis=1)
            rows = np.arange(len(whose))
            best = agenda[rows, at]
            ended = best >= NEVER
            if ended.any():
                result[whose[ended]] = ids[ended, :-1]
                go = ~ended
                ids, agenda, hidden, whose, rest = ids[go], agenda[go], hidden[go], whose[go], rest[go]
                at, best, rows = at[go], best[go], np.arange(len(whose))
            skip = (rest & 1).astype(bool)
            rest >>= 1
            if skip.any():
                hidden[rows[skip], at[skip]] = best[skip]
                agenda[rows[skip], at[skip]] = NEVER
            merge = ~skip
            rows, at = rows[merge], at[merge]
            if not len(rows):
                continue
            own = np.minimum(agenda[rows], hidden[rows])
            hidden[rows] = NEVER
            left, right = ids[rows, at], ids[rows, at + 1]
            moved = np.minimum(cols + (cols > at[:, None]), ids.shape[1] - 1)
            new = np.take_along_axis(ids[rows], moved, axis=1)
            new[np.arange(len(rows)), at] = self._made[self._merges(left, right)]
            own = np.take_along_axis(own, moved, axis=1)
            each = np.arange(len(rows))
            own[each, at] = self._agenda(new[each, at], new[each, at + 1])
            inner = np.flatnonzero(at > 0)
            own[inner, at[inner] - 1] = self._agenda(new[inner, at[inner] - 1], new[inner, at[inner]])
            ids[rows], agenda[rows] = new, own
        return result

    # Texts

    def _looked_up(self, units: list[str], variants: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences' ids in a row, and how many each has."""
        codes, distinct = pd.factorize(np.array(units, object))
        patterns = np.zeros(len(codes), np.int64)
        if rate:
            merges = np.array([len(u) - 1 for u in distinct], np.int64)[codes]
            patterns = _patterns(_streams(variants, seed), merges, _shares(rate))
        # Occurrences without a pattern stay apart from all others.
        apart = -1 - np.arange(len(codes))
        _, first, which = np.unique(np.where(patterns < 0, apart, codes << PLACES | patterns), return_index=True, return_inverse=True)
        names = list(zip(distinct[codes[first]].tolist(), patterns[first].tolist()))
        if len(self.cache) >= CACHED:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        found = [cache.get(n) or older.get(n) for n in names]
        # A literal U+2581 is no blank: it is written in bytes.
        bare = np.array([self.bytes_[b] for b in "▁".encode()], np.int32).tobytes()
        new = [i for i, ids in enumerate(found) if ids is None and names[i][0] != "▁"]
        made = self._segmented([names[i][0].replace(" ", "▁") for i in new], patterns[first[new]], variants[first[new]], rate, seed)
        for i, ids in zip(new, made):
            found[i] = ids
        found = [bare if ids is None else ids for ids in found]
        cache.update((n, ids) for n, ids in zip(names, found) if len(n[0]) <= CACHED_LENGTH and n[1] >= 0)
        sizes = np.array([len(ids) // 4 for ids in found], np.int64)
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), np.int32)
        each = sizes[which]
        ends = np.cumsum(each)
        return flat[np.repeat(starts[which] - (ends - each), each) + np.arange(int(each.sum()))], each

    def encode_many(
        self, texts: Sequence[str | None], rate: float, seed: int, places: Sequence[int]
    ) -> list[np.ndarray | None]:
        """Each text's ids; ``places`` stand for the documents."""
        out: list[list[np.ndarray] | None] = [None if t is None else [] for t in texts]
        units: list[str] = []
        variants: list[np.ndarray] = []
        rows: list[tuple[int, int]] = []

        def flush() -> None:
            nonlocal units, variants, rows
            if units:
                ids, each = self._looked_up(units, np.concatenate(variants), rate, seed)
                cuts = np.cumsum([n for _, n in rows])
                for (row, _), part in zip(rows, np.split(ids, np.concatenate([[0], np.cumsum(each)])[cuts[:-1]])):
                    out[row].append(part)
                units, variants, rows = [], [], []

        for row, text in enumerate(texts):
            found, start = (m[0] for m in UNITS.finditer(" " + text)) if text else iter(()), 0
            if text and len(text) <= GROUP:
                found = iter(UNITS.findall(" " + text))
            while some := list(islice(found, GROUP)):
                spread = _spread(places[row], start, len(some)) if rate else np.zeros(len(some), np.uint64)
                units += some
                variants.append(spread)
                rows.append((row, len(some)))
                start += len(some)
                if len(units) >= GROUP:
                    flush()
        flush()
        none = np.zeros(0, np.int32)
        return [None if parts is None else np.concatenate([none, *parts]) for parts in out]

    def encode(self, text: str, rate: float = 0.0, seed: int = 0, place: int = 0) -> list[int]:
        return self.encode_many([text], rate, seed, [place])[0].tolist()

    def decode(self, ids: Sequence[int]) -> str:
        surface = self.surface
        return b"".join([surface[i] for i in ids]).decode()[1:]


_LOADED: dict[bytes, Pieces] = {}


def loaded(proto: bytes) -> Pieces:
    """This worker's vocabulary, with the cache that later tasks find filled."""
    if proto not in _LOADED:
        _LOADED.clear()
        _LOADED[proto] = Pieces.load(proto)
    return _LOADED[proto]


def read_model(path: str = MODEL) -> bytes:
    """The model file, read by the driver; about half a megabyte, so tasks get it by value."""
    with open(path, "rb") as file:
        return file.read()


def encode(
    docs: DataFrame,
    proto: bytes,
    rate: float = 0.1,
    seed: int = 8,
    text: str = "text",
    key: str = "doc_id",
    keep: Sequence[str] | None = None,
    check: bool = False,
) -> DataFrame:
    """The columns ``keep`` (all, by default) of ``docs`` with ``ids`` and ``n_pieces``.

    With ``check`` a column ``lossless`` says whether the ids decode to the text.
    """
    added = [*_ADDED, *(["lossless"] if check else [])]
    columns = kept(docs, keep, added)
    place = F.xxhash64(F.lit(seed), F.coalesce(quoted(key).cast("string"), F.lit("")))
    inner = docs.select(*carried(columns), quoted(text).alias("_text"), place.alias("_place"))
    schema = T.StructType(inner.schema.fields[: len(columns)]).add("ids", T.ArrayType(T.IntegerType())).add("n_pieces", "long")
    schema = schema.add("lossless", "boolean") if check else schema
    arrow, at = to_arrow_schema(schema), len(columns)
    model = docs.sparkSession.sparkContext.broadcast(proto)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model.value)
        for batch in batches:
            for part in chunks(batch, at, BLOCK):
                texts = part.column(at).to_pylist()
                packed = pieces.encode_many(texts, rate, seed, part.column(at + 1).to_pylist())
                sizes = np.array([0 if x is None else len(x) for x in packed], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32())
                values = pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x in packed if x is not None)]))
                none = np.array([x is None for x in packed])
                made = [
                    *part.columns[:at],
                    pa.ListArray.from_arrays(offsets, values, mask=pa.array(none)),
                    pa.array(sizes, mask=none),
                ]
                if check:
                    back = (None if x is None else pieces.decode(x.tolist()) for x in packed)
                    made.append(pa.array([None if t is None else t == b for t, b in zip(texts, back)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return inner.mapInArrow(task, schema).select(*restored(columns), *added)


def decode(encoded: DataFrame, proto: bytes, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the exact ``text`` that its ids stand for."""
    columns = kept(encoded, None, [text])
    inner = encoded.select(*carried(columns), quoted(ids).alias("_ids"))
    schema = T.StructType(inner.drop("_ids").schema.fields).add("_text", "string")
    arrow, at = to_arrow_schema(schema), len(columns)
    model = encoded.sparkSession.sparkContext.broadcast(proto)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model.value)
        for batch in batches:
            texts = [None if x.as_py() is None else pieces.decode(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string())], schema=arrow)

    return inner.mapInArrow(task, schema).select(*restored(columns), F.col("_text").alias(text))
