"""Boolean trigram queries derived from regular expressions, and an inverted index to answer them.

A query is a tree of ``("all", parts)`` and ``("any", parts)`` over trigrams (bytes of length three); ``("all", ())``
holds for every text. It follows from the pattern alone: any text with a match satisfies it. The index lists,
for each trigram that some query names, the texts of one batch that hold it. Both sides are lower-cased for
A-Z, so that patterns in either case need no list of case variants.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa

try:
    from re import _constants as ops
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as ops
    import sre_parse as parser

EVERY = ("all", ())
#: Sets of exact strings beyond this many are turned into a query and forgotten: fewer conditions, same matches.
EXACT_LIMIT = 64


def _grams(strings: set[bytes]) -> tuple:
    """The condition that one of ``strings`` occurs; a string under three bytes says nothing."""
    if not strings or any(len(s) < 3 for s in strings):
        return EVERY
    return _any([("all", tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)}))) for s in sorted(strings)])


def _all(parts: Sequence[tuple]) -> tuple:
    # One order for equal conditions, however they came about.
    flat = sorted({x for p in parts for x in (p[1] if p[0] == "all" else (p,))}, key=repr)
    return flat[0] if len(flat) == 1 and isinstance(flat[0], tuple) else ("all", tuple(flat))


def _any(parts: Sequence[tuple]) -> tuple:
    distinct = tuple(sorted(set(parts), key=repr))
    return EVERY if EVERY in distinct else distinct[0] if len(distinct) == 1 else ("any", distinct)


def _letter(code: int, flags: int) -> bytes | None:
    """The character as the index holds it, or None where its other case is no ASCII letter and so is not folded there."""
    char = chr(code)
    if flags & re.IGNORECASE and not flags & re.ASCII and (char in "kKsSiI" or (code > 127 and char.lower() != char.upper())):
        return None
    return char.lower().encode() if code < 128 else char.encode()


def _charset(items, flags: int) -> set[bytes] | None:
    """The characters of a class as byte strings, or None where they are too many to list."""
    found: set[bytes | None] = set()
    for op, value in items:
        if op is ops.LITERAL:
            found.add(_letter(value, flags))
        elif op is ops.RANGE and value[1] - value[0] < 4 and value[1] < 128:
            found |= {_letter(c, flags) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return None if None in found else found


def _walk(tree, flags: int) -> tuple[set[bytes] | None, tuple]:
    """(exact strings or None if not listable, condition) for a parsed sequence."""
    exact: set[bytes] | None = {b""}
    conditions: list[tuple] = []
    whole = True

    def settle() -> None:
        nonlocal exact
        if exact is not None:
            conditions.append(_grams(exact))
        exact = None

    def append(strings: set[bytes] | None) -> None:
        # What has been settled is no part of the exact strings any more, so these are only the end of all.
        nonlocal exact, whole
        if strings is None:
            settle()
            exact, whole = {b""}, False
        elif len(exact) * len(strings) > EXACT_LIMIT:
            settle()
            exact, whole = set(strings), False
        else:
            exact = {a + b for a, b in product(exact, strings)}

    for op, value in tree:
        if op is ops.LITERAL:
            append(_charset([(op, value)], flags))
        elif op is ops.IN:
            append(_charset(value, flags))
        elif op is ops.SUBPATTERN:
            strings, condition = _walk(value[3], (flags | value[1]) & ~value[2])
            conditions.append(condition)
            append(strings)
        elif op is ops.BRANCH:
            sides = [_walk(x, flags) for x in value[1]]
            listed = None if any(s is None for s, _ in sides) else set().union(*(s for s, _ in sides))
            conditions.append(_any([_all([c] if s is None else [c, _grams(s)]) for s, c in sides]))
            append(listed)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            low, high, inner = value
            strings, condition = _walk(inner, flags)
            if low:
                conditions.append(condition)
            if (low, high) == (0, 1) and strings is not None:
                append(strings | {b""})
            elif low == high and strings is not None and low <= 8:
                for _ in range(low):
                    append(strings)
            else:
                # At least `low` times: the first ones are known, what follows is not.
                if strings is not None and len(strings) <= 4:
                    for _ in range(min(low, 8)):
                        append(strings)
                append(None)
        elif op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
            continue
        else:
            append(None)
    if whole and len(exact) <= EXACT_LIMIT:
        return exact, _all(conditions)
    settle()
    return None, _all(conditions)


def derive(pattern: str) -> tuple:
    """The trigram query of a pattern; ``EVERY`` where it has no mandatory trigram."""
    tree = parser.parse(pattern)
    strings, condition = _walk(tree, tree.state.flags)
    return _all([condition] if strings is None else [condition, _grams(strings)])


def named(query: tuple) -> set[bytes]:
    return {g for x in query[1] for g in (named(x) if isinstance(x, tuple) else {x})}


def lower_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, A-Z lower-cased, and the offsets of its rows; nulls are empty."""
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    _, offsets, data = text.buffers()
    starts = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    if data is None or not len(text):
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]]
    return raw | ((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5, starts - starts[0]


class Index:
    """Postings of one batch of texts, for the trigrams that a set of queries names."""

    def __init__(self, grams: Sequence[bytes]):
        self.grams = sorted(grams)
        codes = np.array([int.from_bytes(g, "big") for g in self.grams], np.int64)
        self._known = np.zeros(1 << 24, np.uint16 if len(codes) < 1 << 16 else np.uint32)
        self._known[codes] = np.arange(1, len(codes) + 1)
        self.postings: dict[bytes, np.ndarray] = {}
        self.rows = 0

    def fill(self, text: pa.Array, block: int = 1 << 20) -> None:
        """Index a batch, block by block, so that the memory beside the texts is bounded."""
        raw, starts = lower_bytes(text)
        self.rows = len(text)
        pairs = []
        for begin in range(0, max(0, len(raw) - 2), block):
            part = raw[begin : begin + block + 2]
            code = part[:-2].astype(np.int32) << 16
            code |= part[1:-1].astype(np.int32) << 8
            code |= part[2:]
            hits = self._known[code]
            at = np.flatnonzero(hits)
            row = np.searchsorted(starts, at + begin, side="right") - 1
            inside = at + begin + 3 <= starts[row + 1]  # not across two texts
            pairs.append(np.unique(hits[at][inside].astype(np.int64) * (self.rows + 1) + row[inside]))
        found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        gram, row = np.divmod(found, self.rows + 1)
        cuts = np.searchsorted(gram, np.arange(1, len(self.grams) + 2))
        self.postings = {g: row[cuts[i] : cuts[i + 1]] for i, g in enumerate(self.grams)}

    def answer(self, query: tuple) -> np.ndarray:
        """The rows that satisfy a query, ascending: intersections and unions of postings."""
        kind, parts = query
        lists = [self.answer(p) if isinstance(p, tuple) else self.postings[p] for p in parts]
        if kind == "any":
            return np.unique(np.concatenate(lists))
        rows = np.arange(self.rows)
        for x in sorted(lists, key=len):
            rows = np.intersect1d(rows, x, assume_unique=True)
        return rows
