"""Many user rules at once: an index over their conditions instead of one CASE branch a rule.

Exact texts are looked up in a hash table, beginnings and ends in one table for each of their lengths, and inner
texts by an Aho-Corasick automaton, so a span costs its attributes and their hits, however many rules there are.
The plan holds one function call whatever the number of rules.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = ""  # the key under which a span's name is looked up; attribute keys are never empty
GIVES = {
    "category": "string", "icon": "string", "color": "string", "bar_char": "string", "outcome": "string",
    "is_root": "boolean", "is_leaf": "boolean", "is_marker": "boolean",
}
_MEMO = 1 << 16


def given(rule: dict) -> dict:
    """The hints of a rule, with the defaults of those it leaves out."""
    give = rule.get("hints") or {}
    return {
        "category": give.get("category", ""), "icon": give.get("icon") or "● ", "color": give.get("color", ""),
        "bar_char": give.get("bar_char") or "█", "outcome": give.get("outcome", ""),
        "is_root": bool(give.get("is_root")), "is_leaf": bool(give.get("is_leaf")), "is_marker": bool(give.get("is_marker")),
    }


def conditions(rule: dict) -> list[tuple[str, str]]:
    """(key, pattern) of every condition."""
    match = rule.get("match") or {}
    own = list((match.get("attributes") or {}).items())
    return own + ([(NAME, match["span_name"])] if match.get("span_name") else [])


class _Patterns:
    """Which of a key's patterns a value meets; a pattern stands for the rules that ask for it."""

    def __init__(self) -> None:
        self.any: list[int] = []
        self.exact: dict[str, list[int]] = defaultdict(list)
        self.begin: dict[int, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.end: dict[int, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.inner: dict[str, list[int]] = defaultdict(list)
        self.automaton = None

    def add(self, pattern: str, rule: int) -> None:
        if pattern.strip("*") == "" and pattern:
            self.any.append(rule)
        elif pattern.startswith("*") and pattern.endswith("*"):
            self.inner[pattern[1:-1]].append(rule)
        elif pattern.startswith("*"):
            self.end[len(pattern) - 1][pattern[1:]].append(rule)
        elif pattern.endswith("*"):
            self.begin[len(pattern) - 1][pattern[:-1]].append(rule)
        else:
            self.exact[pattern].append(rule)

    def finish(self) -> None:
        if self.inner:
            self.automaton = ahocorasick.Automaton()
            for text in self.inner:
                self.automaton.add_word(text, text)
            self.automaton.make_automaton()

    def met(self, value: str) -> list[int]:
        out = [*self.any, *self.exact.get(value, ())]
        for size, table in self.begin.items():
            out += table.get(value[:size], ())
        for size, table in self.end.items():
            out += table.get(value[-size:], ())
        if self.automaton is not None:
            for text in {t for _, t in self.automaton.iter(value)}:
                out += self.inner[text]
        return out


class RuleIndex:
    def __init__(self, rules: list[dict]):
        self.rules = [given(r) for r in rules]
        self.wanted = [len(conditions(r)) for r in rules]
        self.keys: dict[str, _Patterns] = defaultdict(_Patterns)
        for number, rule in enumerate(rules):
            for key, pattern in conditions(rule):
                self.keys[key].add(pattern, number)
        for patterns in self.keys.values():
            patterns.finish()
        self.memo: dict[tuple[str, str], list[int]] = {}

    def _met(self, key: str, value: str) -> list[int]:
        found = self.memo.get((key, value))
        if found is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            found = self.memo[key, value] = self.keys[key].met(value)
        return found

    def first(self, name: str | None, attrs: list[tuple[str, str]]) -> int | None:
        """The first rule all of whose conditions hold."""
        hits: Counter[int] = Counter()
        if name is not None and NAME in self.keys:
            hits.update(self._met(NAME, name))
        for key, value in attrs:
            if value is not None and key in self.keys and key != NAME:
                hits.update(self._met(key, value))
        return min((r for r, n in hits.items() if n == self.wanted[r]), default=None)


def matched(name: Column, attrs: Column, rules: list[dict]) -> Column:
    """The hints of the first rule that matches as a struct, null for none."""
    kinds = pa.struct([(n, pa.bool_() if t == "boolean" else pa.string()) for n, t in GIVES.items()])
    held: list[RuleIndex] = []

    def find(names: pa.Array, maps: pa.Array) -> pa.Array:
        if not held:
            held.append(RuleIndex(rules))
        index = held[0]
        found = [index.first(n, m or []) for n, m in zip(names.to_pylist(), maps.to_pylist())]
        return pa.array([None if r is None else index.rules[r] for r in found], kinds)

    return F.arrow_udf(find, ", ".join(f"{n} {t}" for n, t in GIVES.items()))(name, attrs)
