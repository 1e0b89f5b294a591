"""Runs of words that repeat with a period, by a suffix automaton whose links carry the last occurrences.

Appending a word gives the automaton a state for the new prefix. The path from that state to the root holds all suffixes of
the prefix, longest first, and falls into segments of one last occurrence each. Accessing the path, as in a link-cut tree,
recolours it with the new end: a segment whose last occurrence ended ``d`` words before and whose longest suffix has
``L`` words says that the last ``L + d`` words have period ``d``, a square if ``L >= d``. Where that makes a run, it is
extended over all later words that keep the period. The automaton is built first, so its links are fixed, and the segments
lie as stacks on its heavy paths; an access takes amortized logarithmic time.

Before that, words that can lie in no run are left out, exactly: in a run each three words in a row occur three times or more
inside the run. What is left after counting these, stretch by stretch until nothing changes, is all that is
appended, every stretch by itself; no run reaches over a stretch's end.

A run is a stretch with smallest period ``q`` that no neighbouring word extends keeping that period, of at least ``TIMES``
periods and ``LEAST`` words. Collapsing drops a run's words after its first ``q``; words go that any run drops.

Defined cases: a null or empty text, or one of blanks, has no runs and collapses to an empty text. Words are compared as they are,
whatever their case. Rows with equal texts have equal runs. Columns of other names pass through, those named like the
added ones are replaced. An empty table gives an empty table. A text of any length is searched whole; memory grows
with the longest stretch of one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutlist.llm.common import carried, kept, quoted, restored
from cutlist.llm.spans import chunks

#: Periods and words that a run has at least; fewer of either are not looked for (see ``_stretches``).
TIMES, LEAST = 4, 6
#: Bytes of text that are searched together.
BLOCK = 2 << 20
RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
_ADDED = ("n_words", "runs", "strongest", "collapsed")
Run = tuple[int, int, int]


class Automaton:
    """Suffix automaton of a list of words: transitions, suffix links, longest lengths, and the state of each prefix."""

    def __init__(self, words: Sequence[int]):
        moves: list[dict[int, int]] = [{}]
        link, length, prefixes, last = [-1], [0], [], 0
        for word in words:
            new = len(length)
            length.append(length[last] + 1)
            moves.append({})
            link.append(0)
            state = last
            while state >= 0 and word not in moves[state]:
                moves[state][word] = new
                state = link[state]
            if state >= 0:
                after = moves[state][word]
                if length[after] == length[state] + 1:
                    link[new] = after
                else:
                    clone = len(length)
                    length.append(length[state] + 1)
                    moves.append(moves[after].copy())
                    link.append(link[after])
                    while state >= 0 and moves[state].get(word) == after:
                        moves[state][word] = clone
                        state = link[state]
                    link[after] = link[new] = clone
            prefixes.append(new)
            last = new
        self.link, self.length, self.prefixes = link, length, prefixes


class Segments:
    """Root paths of fixed links, coloured by the last access; a segment is its deepest node and its colour."""

    def __init__(self, link: list[int], length: list[int]):
        size = len(link)
        weight, heavy, best = [1] * size, [-1] * size, [0] * size
        order = np.argsort(np.array(length), kind="stable").tolist()
        for node in reversed(order):
            up = link[node]
            if up >= 0:
                weight[up] += weight[node]
                if weight[node] > best[up]:
                    best[up], heavy[up] = weight[node], node
        head = list(range(size))
        for node in order:
            if heavy[node] >= 0:
                head[heavy[node]] = head[node]
        self._link, self._length, self._head = link, length, head
        #: For each heavy path's head its segments, from the deepest up, as (longest length, colour).
        self._stacks: dict[int, list[tuple[int, int]]] = {}

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from ``node`` to the root; the segments it had, as (longest length, colour)."""
        link, lengths, heads, stacks, seen = self._link, self._length, self._head, self._stacks, []
        while node > 0:
            head, length = heads[node], lengths[node]
            stack = stacks.get(head)
            if stack is None:
                stacks[head] = [(length, colour)]
            else:
                done = 0
                while stack and stack[-1][0] <= length:
                    done = stack[-1][0]
                    seen.append(stack.pop())
                if stack and done < length:
                    seen.append((length, stack[-1][1]))
                stack.append((length, colour))
            node = link[head]
        return seen


def runs_of(words: Sequence[int], times: int = TIMES, least: int = LEAST) -> list[Run]:
    """All runs of a list of words as (start, length, period), by start and then period. ``times`` is 3 at least.

    A run's last words, but for one period, have their nearest earlier occurrence one period before: a nearer one would give
    two periods of them both the shorter period, as they are at least as long as both together.
    """
    automaton = Automaton(words)
    segments = Segments(automaton.link, automaton.length)
    known: dict[int, int] = {}
    found, size = [], len(words)
    for end, state in enumerate(automaton.prefixes):
        for length, before in segments.access(state, end):
            period = end - before
            whole = length + period
            # A run's last words are seen again at each word that goes on with it.
            if whole >= times * period and whole >= least and known.get(period, -1) < end:
                stop = end + 1
                while stop < size and words[stop] == words[stop - period]:
                    stop += 1
                known[period] = stop - 1
                found.append((end - whole + 1, stop - end + whole - 1, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: Sequence[Run]) -> Run | None:
    """The run with the most periods; of equal ones the first, then the one with the smallest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _stretches(codes: np.ndarray, document: np.ndarray) -> np.ndarray:
    """The words that may lie in runs, as [first, last) of each stretch of them.

    A run of four periods and six words or more has each of its triples three times. Triples are counted by a hash, which
    can only add to a count and so only leaves more.
    """
    live, stretch = np.arange(len(codes)), document.astype(np.uint64)
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    while len(live) >= LEAST:
        whole = np.flatnonzero((stretch[:-2] == stretch[2:]) & (live[2:] - live[:-2] == 2))
        at = live[whole]
        triple = (mixed[at] * np.uint64(3) + mixed[at + 1]) * np.uint64(0xD1B54A32D192ED03) + mixed[at + 2]
        triple = (triple ^ triple >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + stretch[whole] * np.uint64(0x94D049BB133111EB)
        _, which, often = np.unique(triple, return_inverse=True, return_counts=True)
        whole = whole[often[which] >= 3]
        covered = np.zeros(len(live), bool)
        for n in range(3):
            covered[whole + n] = True
        if covered.all():
            break
        live, stretch = live[covered], stretch[covered]
        broken = np.append(True, (np.diff(live) > 1) | (stretch[1:] != stretch[:-1])) if len(live) else np.zeros(0, bool)
        stretch = np.cumsum(broken).astype(np.uint64)
    if len(live) < LEAST:
        return np.zeros((0, 2), np.int64)
    first = np.flatnonzero(np.append(True, (np.diff(live) > 1) | (stretch[1:] != stretch[:-1])))
    bounds = np.stack([live[first], live[np.append(first[1:], len(live)) - 1] + 1], axis=1)
    return bounds[bounds[:, 1] - bounds[:, 0] >= LEAST]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All texts' words in a row, as places in the distinct ones, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    # Blanks at either end of a text leave an empty piece there.
    real = pc.not_equal(distinct, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    offsets = split.offsets.to_numpy().astype(np.int64)
    held = np.concatenate([[0], np.cumsum(real)])
    return codes[real], np.diff(held[offsets - offsets[0]]), distinct


View = Callable[[object, int], "np.ndarray | None"]


def search(texts: pa.Array, keys: Sequence[object] = (), view: View | None = None) -> tuple[np.ndarray, list[list[Run]], pa.Array]:
    """Number of words, runs and collapsed text of each text.

    ``view`` takes a key and a number of words and gives the places at which the words are read, none for all in order.
    """
    codes, counts, distinct = _words(texts)
    edges = np.concatenate([[0], np.cumsum(counts)])
    if view is not None:
        places = np.arange(len(codes))
        for row, key in enumerate(keys):
            own = view(key, int(counts[row]))
            if own is not None:
                places[edges[row] : edges[row + 1]] = edges[row] + own
        codes = codes[places]
    document = np.repeat(np.arange(len(counts)), counts)
    runs: list[list[Run]] = [[] for _ in counts]
    dropped = np.zeros(len(codes) + 1, np.int64)
    for first, last in _stretches(codes, document).tolist():
        row = int(document[first])
        for start, length, period in runs_of(codes[first:last].tolist()):
            dropped[first + start + period] += 1
            dropped[first + start + length] -= 1
            runs[row].append((first - int(edges[row]) + start, length, period))
    left = np.cumsum(dropped[:-1]) == 0
    offsets = np.concatenate([[0], np.cumsum(left)])[edges]
    words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), distinct.take(pa.array(codes[left])))
    return counts, [sorted(r, key=lambda x: (x[0], x[2])) for r in runs], pc.binary_join(words, pa.scalar(" ", pa.large_string()))


def find(
    docs: DataFrame, text: str = "text", key: str | None = None, keep: Sequence[str] | None = None, view: View | None = None
) -> DataFrame:
    """The columns ``keep`` (all, by default) of ``docs`` with ``n_words``, ``runs``, the ``strongest`` run and ``collapsed``.

    ``runs`` are (start, length, period) in words, by start and then period; ``collapsed`` is what is left, joined by blanks.
    With a ``view`` (see ``search``) words are read through it, by the column ``key``.
    """
    columns = kept(docs, keep, _ADDED)
    named = quoted(key) if key else F.lit(None).cast("string")
    inner = docs.select(*carried(columns), named.alias("_key"), quoted(text).alias("_text"))
    schema = T.StructType(inner.schema.fields[: len(columns)]).add("n_words", "long").add("runs", T.ArrayType(RUN))
    schema = schema.add("strongest", RUN).add("collapsed", "string")
    arrow, at = to_arrow_schema(schema), len(columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at + 1, BLOCK):
                counts, runs, collapsed = search(part.column(at + 1), part.column(at).to_pylist() if view else (), view)
                dicts = [[dict(zip(RUN.names, r)) for r in mine] for mine in runs]
                best = [None if r is None else dict(zip(RUN.names, r)) for r in map(strongest, runs)]
                made = [pa.array(counts, pa.int64()), pa.array(dicts, arrow.field(at + 1).type), pa.array(best, arrow.field(at + 2).type)]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *made, collapsed.cast(arrow.field(at + 3).type)], schema=arrow)

    return inner.mapInArrow(task, schema).select(*restored(columns), *_ADDED)
