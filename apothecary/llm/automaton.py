"""Several regular expressions as one minimal deterministic automaton over bytes.

Each expression becomes a non-deterministic automaton; subset construction
joins all of them, and partition refinement minimises the result to one
transition array. ``Scanner`` passes it once over the bytes: many stretches
of a buffer advance together, one byte a step, as numpy vectors.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _parser

import numpy as np

#: Between texts; no rule can match it.
SEPARATOR = b"\xff"
_LANES = 4096
_BLOCK = 4 << 20  # bytes whose states are held at a time


@dataclass(frozen=True)
class Rule:
    """A kind of match and its expression: ASCII literals, classes, groups, alternatives and repeats.

    Matches are the leftmost and of those the longest, and don't overlap within
    a kind; those whose group ``group`` is shorter than ``least`` are dropped
    afterwards.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


class _Nfa:
    """Thompson's construction; a set of bytes is an integer of 256 bits."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree: Iterable, at: int, any_case: bool) -> int:
        """Adds the parts of a parsed expression behind a state and gives the state behind them."""
        for op, arg in tree:
            name = str(op)
            if name in ("LITERAL", "IN"):
                end = self.state()
                self.moves[at].append((_bytes_of([(op, arg)] if name == "LITERAL" else arg, any_case), end))
            elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
                end = self.add(arg[3], at, any_case)
            elif name == "BRANCH":
                end = self.state()
                for part in arg[1]:
                    self.free[self.add(part, at, any_case)].append(end)
            elif name == "MAX_REPEAT":
                end = self._repeat(*arg, at, any_case)
            else:
                raise ValueError(f"rules cannot hold {name}")
            at = end
        return at

    def _repeat(self, least: int, most: int, tree: Iterable, at: int, any_case: bool) -> int:
        for _ in range(least):
            at = self.add(tree, at, any_case)
        end = self.state()
        self.free[at].append(end)
        if most == _parser.MAXREPEAT:
            self.free[self.add(tree, end, any_case)].append(end)
            return end
        for _ in range(most - least):
            at = self.add(tree, at, any_case)
            self.free[at].append(end)
        return end

    def closures(self) -> list[int]:
        """Of each state the set of states that it reaches without a byte."""
        out = []
        for state in range(len(self.free)):
            seen, open_ = 1 << state, [state]
            while open_:
                for other in self.free[open_.pop()]:
                    if not seen >> other & 1:
                        seen |= 1 << other
                        open_.append(other)
            out.append(seen)
        return out


def _bytes_of(items: Iterable, any_case: bool) -> int:
    held: set[int] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            held.add(arg)
        elif str(op) == "RANGE":
            held.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"classes cannot hold {op}")
    if max(held) > 127:
        raise ValueError("rules are ASCII")
    if any_case:
        held |= {ord(f(chr(b))) for b in held for f in (str.lower, str.upper)}
    return sum(1 << b for b in held)


def _members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


class Automaton:
    """``table[state, group of the byte]`` is the next state; ``marks[state]`` has bit k where a match of rule k ends.

    State 0 is the start. Unless ``anchored``, matches may begin anywhere and
    state 0 alone says that none is under way; an anchored automaton has a
    state without a way on, ``dead``.
    """

    def __init__(self, rules: Iterable[Rule], anchored: bool = False):
        nfa, first, ends = _Nfa(), 0, {}
        for k, rule in enumerate(rules):
            begin = nfa.state()
            ends[nfa.add(_parser.parse(rule.pattern), begin, rule.any_case)] = 1 << k
            first |= 1 << begin
        masks = sorted({mask for moves in nfa.moves for mask, _ in moves})
        kinds: dict[tuple, int] = {}
        self.groups = np.array([kinds.setdefault(tuple(m >> b & 1 for m in masks), len(kinds)) for b in range(256)], dtype=np.uint8)
        one_of = [int(np.flatnonzero(self.groups == g)[0]) for g in range(len(kinds))]
        closures = nfa.closures()
        first = sum(1 << s for s in {s for f in _members(first) for s in _members(closures[f])})
        steps = []
        for moves in nfa.moves:
            steps.append([0] * len(kinds))
            for g, b in enumerate(one_of):
                for mask, target in moves:
                    if mask >> b & 1:
                        steps[-1][g] |= closures[target]
        table, marks = self._subsets(first, steps, ends, 0 if anchored else first, len(kinds))
        if marks[0]:
            raise ValueError("a rule matches the empty text")
        self.table, self.marks = _minimised(table, marks)
        dead = np.flatnonzero((self.table == np.arange(len(self.table))[:, None]).all(axis=1) & (self.marks == 0))
        self.dead = int(dead[0]) if anchored and len(dead) else -1

    @staticmethod
    def _subsets(first: int, steps: list[list[int]], ends: dict[int, int], again: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        known, rows, at = {first: 0}, [], 0
        sets = [first]
        while at < len(sets):
            members = [steps[s] for s in _members(sets[at])]
            row = []
            for g in range(width):
                found = again
                for step in members:
                    found |= step[g]
                if found not in known:
                    known[found] = len(sets)
                    sets.append(found)
                row.append(known[found])
            rows.append(row)
            at += 1
        marks = [sum(mark for end, mark in ends.items() if s >> end & 1) for s in sets]
        return np.array(rows, dtype=np.int32), np.array(marks, dtype=np.int64)


def _minimised(table: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equivalent states joined by refining the partition; the start stays a class of its own, as state 0."""
    alone = np.arange(len(marks)) == 0
    part = np.unique(np.column_stack([marks, alone]), axis=0, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    _, chosen = np.unique(part, return_index=True)
    order = np.argsort(chosen)  # by first appearance, so the start comes first
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank[part[table[chosen[order]]]], marks[chosen[order]]


class Scanner:
    """Finds the matches of all rules in one pass of their joint automaton over the bytes."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        joint = Automaton(rules)
        self._groups, self.marks = joint.groups, joint.marks
        self._width = 1 << int(joint.table.shape[1] - 1).bit_length()
        wide = np.zeros((len(joint.table), self._width), dtype=np.int32)
        wide[:, : joint.table.shape[1]] = joint.table * self._width  # states are held as places in the flat table
        self._flat = wide.reshape(-1)
        self._ends = joint.marks != 0
        self._alone = []
        for rule in rules:
            own = Automaton((rule,), anchored=True)
            self._alone.append(([row[own.groups].tolist() for row in own.table], (own.marks != 0).tolist(), own.dead, re.compile(rule.pattern.encode(), re.IGNORECASE if rule.any_case else 0)))

    def states(self, data: np.ndarray, entry: int = 0) -> np.ndarray:
        """The joint automaton's state after each byte.

        The bytes are cut into equal stretches that advance together, each
        from the start state. Where the stretch before ended in another state,
        the first bytes are passed again until both ways meet.
        """
        n, groups = len(data), self._groups[data]
        lanes = max(1, min(_LANES, n // 64))
        long = -(-n // lanes)
        grid = np.zeros(lanes * long, dtype=np.uint8)
        grid[:n] = groups
        grid = np.ascontiguousarray(grid.reshape(lanes, long).T)
        out = np.empty((long, lanes), dtype=np.int32)
        state = np.zeros(lanes, dtype=np.int32)
        for k in range(long):
            state = self._flat.take(state + grid[k], out=out[k])
        states = np.ascontiguousarray(out.T).reshape(-1)[:n]
        for at in range(0, n, long):
            true = entry * self._width if at == 0 else int(states[at - 1])
            k = at
            while true and k < min(at + long, n):
                true = int(self._flat[true + int(groups[k])])
                if true == states[k]:
                    break
                states[k] = true
                k += 1
            else:
                if not true and k < min(at + long, n) and k > at:  # fell back to the start: pass on from there
                    self._onward(states, groups, k, min(at + long, n))
        return states // self._width

    def _onward(self, states: np.ndarray, groups: np.ndarray, k: int, end: int) -> None:
        """Passes bytes again from the start state until the states meet those already there."""
        true = 0
        while k < end:
            true = int(self._flat[true + int(groups[k])])
            if true == states[k]:
                return
            states[k] = true
            k += 1

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of every match in bytes, by start and then rule."""
        hits, begins, marks, entry, free = [], [], [], 0, 0
        for low in range(0, len(data), _BLOCK):
            states = self.states(np.frombuffer(data, dtype=np.uint8, count=min(_BLOCK, len(data) - low), offset=low), entry)
            ends = np.flatnonzero(self._ends[states])
            starts = np.flatnonzero(states == 0)
            before = np.searchsorted(starts, ends) - 1
            begins.append(np.where(before < 0, free, (starts[before] if len(starts) else 0) + 1 + low))
            hits.append(ends + 1 + low)
            marks.append(self.marks[states[ends]])
            free, entry = (int(starts[-1]) + 1 + low if len(starts) else free), int(states[-1])
        if not hits:
            return []
        end, begin, mark = (np.concatenate(x) for x in (hits, begins, marks))
        found = []
        for k in range(len(self.rules)):
            own = mark >> k & 1 == 1
            found += self._resolved(data, k, end[own].tolist(), begin[own].tolist())
        return sorted(found, key=lambda f: (f[0], f[2]))

    def _resolved(self, data: bytes, k: int, ends: list[int], begins: list[int]) -> Iterator[tuple[int, int, int]]:
        """The leftmost longest matches of one rule around the ends that the joint automaton marked.

        No match is under way at ``begin``, so starts from there on are tried
        with the rule's own automaton.
        """
        rows, accepts, dead, whole = self._alone[k]
        rule, at = self.rules[k], 0
        for end, begin in zip(ends, begins, strict=True):
            start = max(begin, at)
            while end > at and start < end:
                state, i, last = 0, start, 0
                while i < len(data):
                    state = rows[state][data[i]]
                    if state == dead:
                        break
                    i += 1
                    if accepts[state]:
                        last = i
                if last:
                    at = last
                    if not rule.least or len(whole.fullmatch(data, start, last)[rule.group]) >= rule.least:
                        yield start, last, k
                start += 1
