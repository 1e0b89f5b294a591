"""Aliases and replacement rules, compiled once per task and applied to Arrow batches of texts.

Rules are written in the dialect of Python's ``re`` and applied by it. A task keeps the rule sets it has met,
at most ``KEPT``. Aliases are plain text, replaced one after the other, longest first, so a text that holds none of them is
left alone: one automaton over all of them tells (``pyahocorasick`` where installed, else a search for each).
"""

from __future__ import annotations

import json
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle

# Travels to the workers with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rule sets that a worker keeps compiled.
KEPT = 1000


def compiled(pattern: str, replacement: str):
    """The compiled pattern, or None if it is none or the replacement names groups that it does not have."""
    try:
        made = re.compile(pattern)
        made.sub(replacement, "")
    except (re.error, IndexError, OverflowError, RecursionError):
        return None
    return made


def _applied(pattern: re.Pattern, replacement: str):
    """A rule as a function of a text; plain text in both is replaced as such."""
    if "\\" in replacement or set(pattern.pattern) & set(r".^$*+?{}[]\|()"):
        return lambda text: pattern.sub(replacement, text)
    return lambda text: text.replace(pattern.pattern, replacement)


class Rules:
    """One taxonomy's aliases, in the order of their replacement, and its usable rules."""

    def __init__(self, definition: str):
        given = json.loads(definition)
        self.aliases = [(a["alias"], a["canonical"]) for a in given.get("aliases", [])]
        rules = [(compiled(r["pattern"], r["replacement"]), r["replacement"]) for r in given.get("rules", [])]
        self.rules = [_applied(p, r) for p, r in rules if p]
        self.found = self._finder([a for a, _ in self.aliases])

    @staticmethod
    def _finder(aliases: list[str]):
        if len(aliases) < 8:
            return lambda text: any(a in text for a in aliases)
        try:
            from ahocorasick import Automaton
        except ImportError:
            return lambda text: any(a in text for a in aliases)
        automaton = Automaton()
        for a in aliases:
            automaton.add_word(a, 1)
        automaton.make_automaton()
        return lambda text: next(automaton.iter(text), None) is not None

    def apply(self, text: str) -> str:
        if self.aliases and self.found(text):
            for alias, canonical in self.aliases:
                text = text.replace(alias, canonical)
        for rule in self.rules:
            text = rule(text)
        return text


_KNOWN: dict[str, Rules] = {}


def rules_of(definition: str) -> Rules:
    if definition not in _KNOWN:
        if len(_KNOWN) >= KEPT:
            _KNOWN.clear()
        _KNOWN[definition] = Rules(definition)
    return _KNOWN[definition]


def _sets(definitions: pa.Array) -> tuple[list[Rules | None], list[int | None]]:
    """The rule sets of a batch and which one each row has; each is read once a batch."""
    coded = definitions.dictionary_encode()
    return [rules_of(d) for d in coded.dictionary.to_pylist()], coded.indices.to_pylist()


def correct_texts(texts: pa.Array, definitions: pa.Array) -> pa.Array:
    """Each text by the rule set of its row; a text without one stays."""
    sets, which = _sets(definitions)
    return pa.array([t if t is None or n is None else sets[n].apply(t) for t, n in zip(texts.to_pylist(), which)], pa.string())


def correct_lists(lists: pa.Array, definitions: pa.Array) -> pa.Array:
    """Each list of texts by the rule set of its row."""
    sets, which = _sets(definitions)
    out = [
        x if x is None or n is None else [None if t is None else sets[n].apply(t) for t in x]
        for x, n in zip(lists.to_pylist(), which)
    ]
    return pa.array(out, pa.list_(pa.string()))


def usable(patterns: pa.Array, replacements: pa.Array) -> pa.Array:
    known: dict[tuple[str, str], bool] = {}
    for rule in zip(patterns.to_pylist(), replacements.to_pylist()):
        if rule not in known:
            known[rule] = None not in rule and compiled(*rule) is not None
    return pa.array([known[r] for r in zip(patterns.to_pylist(), replacements.to_pylist())], pa.bool_())
