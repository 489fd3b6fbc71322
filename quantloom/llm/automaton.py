"""Regular expressions to minimal deterministic automata over bytes.

Syntax: literals, ``\\xNN`` and ``\\c`` escapes, classes with ranges and negation, groups, ``(?i:...)``,
alternation and the quantifiers ``? * + {m} {m,} {m,n}``.  Matching is leftmost-longest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Nfa:
    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1


class _Parser:
    """Recursive descent to a tree: ('set', bytes), ('cat', parts), ('alt', parts), ('rep', part, low, high)."""

    def __init__(self, pattern: str) -> None:
        self.p, self.i = pattern, 0

    def alternation(self, fold: bool = False):
        parts = [self.sequence(fold)]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            parts.append(self.sequence(fold))
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def sequence(self, fold: bool):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            parts.append(self.quantified(self.atom(fold)))
        return ("cat", parts)

    def quantified(self, node):
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            if c == "{":
                end = self.p.index("}", self.i)
                low, _, high = self.p[self.i + 1 : end].partition(",")
                span = (int(low), (int(high) if high else None) if "," in self.p[self.i : end] else int(low))
                self.i = end + 1
            else:
                span = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
                self.i += 1
            node = ("rep", node, *span)
        return node

    def escape(self) -> int:
        self.i += 1
        if self.p[self.i] == "x":
            self.i += 3
            return int(self.p[self.i - 2 : self.i], 16)
        self.i += 1
        return ord(self.p[self.i - 1])

    def atom(self, fold: bool):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            if self.p.startswith("?i:", self.i):
                self.i, fold = self.i + 3, True
            node = self.alternation(fold)
            self.i += 1
            return node
        if c == "[":
            return ("set", self.cased(self.charset(), fold))
        if c == "\\":
            return ("set", self.cased({self.escape()}, fold))
        self.i += 1
        return ("set", self.cased({ord(c)}, fold))

    def charset(self) -> set[int]:
        self.i += 1
        negated = self.p[self.i] == "^"
        self.i += negated
        found: set[int] = set()
        while self.p[self.i] != "]":
            low = self.escape() if self.p[self.i] == "\\" else ord(self.p[self.i])
            self.i += self.p[self.i - 1] != "\\" and low == ord(self.p[self.i])
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                high = self.escape() if self.p[self.i] == "\\" else ord(self.p[self.i])
                self.i += high == ord(self.p[self.i])
            else:
                high = low
            found |= set(range(low, high + 1))
        self.i += 1
        return set(range(256)) - found if negated else found

    @staticmethod
    def cased(chars: set[int], fold: bool) -> frozenset[int]:
        if fold:
            chars = chars | {c ^ 32 for c in chars if 65 <= (c & 0xDF) <= 90 and c < 128}
        return frozenset(chars)


def _build(nfa: _Nfa, node, start: int) -> int:
    """Add the node's states from ``start``; the state after it."""
    kind = node[0]
    if kind == "set":
        end = nfa.state()
        nfa.step[start] = (node[1], end)
        return end
    if kind == "cat":
        for part in node[1]:
            fresh = nfa.state()
            nfa.eps[start].append(fresh)
            start = _build(nfa, part, fresh)
        return start
    if kind == "alt":
        end = nfa.state()
        for part in node[1]:
            fresh = nfa.state()
            nfa.eps[start].append(fresh)
            nfa.eps[_build(nfa, part, fresh)].append(end)
        return end
    _, part, low, high = node
    for _ in range(low):
        fresh = nfa.state()
        nfa.eps[start].append(fresh)
        start = _build(nfa, part, fresh)
    if high is None:
        loop, end = nfa.state(), nfa.state()
        nfa.eps[start].append(loop)
        fresh = nfa.state()
        nfa.eps[loop] += [fresh, end]
        nfa.eps[_build(nfa, part, fresh)].append(loop)
        return end
    end = nfa.state()
    nfa.eps[start].append(end)
    for _ in range(high - low):
        fresh = nfa.state()
        nfa.eps[start].append(fresh)
        start = _build(nfa, part, fresh)
        nfa.eps[start].append(end)
    return end


@dataclass(frozen=True)
class Automaton:
    """Transition array ``step[state * classes + class_of[byte]]``; bit k of ``accept[state]`` is set where rule k matches. State 0 starts."""

    step: np.ndarray
    class_of: np.ndarray
    accept: np.ndarray
    classes: int
    dead: int

    @property
    def states(self) -> int:
        return len(self.accept)

    def table(self) -> np.ndarray:
        """step[state, byte]."""
        return self.step.reshape(self.states, self.classes)[:, self.class_of]


def compile_rules(patterns: list[str], search: bool = False) -> Automaton:
    """One automaton for all patterns (at most 31) by subset construction and minimisation; with ``search`` a match may start at any byte."""
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for k, pattern in enumerate(patterns):
        parser = _Parser(pattern)
        tree = parser.alternation()
        if parser.i != len(pattern):
            raise ValueError(f"unbalanced pattern {pattern!r}")
        fresh = nfa.state()
        nfa.eps[root].append(fresh)
        ends[_build(nfa, tree, fresh)] = 1 << k

    def closure(states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.step[s] is not None or s in ends)

    # Bytes that no set of the patterns tells apart form one class.
    sets = sorted({s[0] for s in nfa.step if s is not None}, key=sorted)
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {x: k for k, x in enumerate(dict.fromkeys(signature))}
    class_of = np.array([kinds[x] for x in signature], np.int64)
    sample = [int(np.flatnonzero(class_of == k)[0]) for k in range(len(kinds))]

    first = closure(frozenset([root]))
    index, order, rows = {first: 0}, [first], []
    for current in order:
        row = []
        for b in sample:
            after = {s[1] for q in current if (s := nfa.step[q]) is not None and b in s[0]}
            target = closure(frozenset(after)) | (first if search else frozenset())
            if target not in index:
                index[target] = len(order)
                order.append(target)
            row.append(index[target])
        rows.append(row)
    step = np.array(rows, np.int64)
    accept = np.array([sum({ends[q] for q in s if q in ends}) for s in order], np.int64)

    # Moore's partition refinement: states are alike if they accept alike and go to alike states.
    part = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    renumber = np.full(part.max() + 1, -1)
    renumber[part[0]] = 0
    rest = [p for p in range(part.max() + 1) if p != part[0]]
    renumber[rest] = np.arange(1, len(rest) + 1)
    part = renumber[part]
    one = np.zeros(part.max() + 1, np.int64)
    one[part] = np.arange(len(part))
    small = part[step[one]]
    flags = accept[one]
    stuck = np.flatnonzero((small == np.arange(len(one))[:, None]).all(axis=1) & (flags == 0))
    return Automaton(small.ravel(), class_of, flags, len(kinds), int(stuck[0]) if len(stuck) else -1)
