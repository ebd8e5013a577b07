"""The least cost of every span of a token sequence for every symbol of a grammar, by length, many spans at a time.

Where the chart's search by cost has to look at much, since the sequence is far from what the grammar derives, this way is shorter:
its work depends on the sequence's length (the third power) and on the grammar, but not on the cost.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    from codelattice.llm.syntax.chart import Grammar

#: Bytes of costs above which they are kept in a temporary file.
IN_MEMORY = 200_000_000


def _store(size: int) -> Callable[[np.ndarray], np.ndarray]:
    """What keeps arrays of ``size`` bytes in all: in memory, or mapped from a file that goes with them."""
    if size <= IN_MEMORY:
        return lambda array: array
    with tempfile.TemporaryFile() as file:
        room = np.memmap(file, np.uint8, "w+", shape=(size,))
    used = 0

    def store(array: np.ndarray) -> np.ndarray:
        nonlocal used
        kept = room[used : used + array.nbytes].view(array.dtype).reshape(array.shape)
        kept[:] = array
        used += array.nbytes
        return kept

    return store


def _turns(edges: list[tuple[int, int, int]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Edges (to, from, cost) in turns that hold each target once."""
    turns: list[list[tuple[int, int, int]]] = []
    seen: dict[int, int] = {}
    for edge in edges:
        k = seen[edge[0]] = seen.get(edge[0], -1) + 1
        turns += [[]] if k == len(turns) else []
        turns[k].append(edge)
    return [(np.array([e[0] for e in t]), np.array([e[1] for e in t]), np.array([[e[2]] for e in t])) for t in turns]


class Spans:
    """A grammar's rules from one symbol on, laid out for work on many spans at a time.

    Tokens are deleted right before the next terminal of a rule, or behind the whole. ``states`` are dotted rules, as in the chart.
    """

    def __init__(self, grammar: Grammar, root: int) -> None:
        self.grammar, self.root = grammar, root
        nxt, least, terminals = grammar.next, grammar.least, grammar.terminals
        symbols, states, todo = [root], [], [root]
        self.dot: dict[int, int] = {}
        self.before: dict[int, int] = {}  # the cost of inserting what stands before the dot, and behind it
        self.behind: dict[int, int] = {}
        while todo:
            for first, _ in grammar.starts[todo.pop()]:
                end = first
                while nxt[end] >= 0:
                    if nxt[end] not in terminals and nxt[end] not in symbols:
                        symbols.append(nxt[end])
                        todo.append(nxt[end])
                    end += 1
                rule = range(first, end + 1)
                for s in rule:
                    self.dot[s] = s - first
                    self.before[s] = sum(least[nxt[t]] for t in range(first, s))
                    self.behind[s] = sum(least[nxt[t]] for t in range(s, end))
                states += rule
        joins = [s for s in states if self.dot[s] and nxt[s] >= 0 and nxt[s] not in terminals]  # they come first
        inner = [s for s in states if nxt[s] in terminals]
        self.kept = len(joins) + len(inner)  # states whose costs are kept for all lengths
        self.states = joins + inner + sorted(set(states) - {*joins, *inner})
        self.at = at = {s: i for i, s in enumerate(self.states)}
        self.row = row = {s: i for i, s in enumerate(symbols)}
        self.symbols = symbols
        self.joins = len(joins)
        self.joined = np.array([row[nxt[s]] for s in joins], np.int64)
        self.join_to = np.array([at[s + 1] for s in joins], np.int64)
        waiting = [s for s in self.states if nxt[s] in terminals]
        self.waiting = np.array([at[s] for s in waiting], np.int64)
        self.taken = np.array([at[s + 1] for s in waiting], np.int64)
        self.awaited = [nxt[s] for s in waiting]
        self.fresh = np.array([at[s] for s in waiting if not self.dot[s]], np.int64)
        self.ends = _turns([(row[grammar.lhs[s]], at[s], self.behind[s]) for s in self.states])
        # a symbol that stands for the same span as another, the rest of the rule being inserted
        self.alone: dict[int, dict[int, tuple[int, int]]] = {s: {} for s in symbols}
        for s in self.states:
            if nxt[s] >= 0 and nxt[s] not in terminals:
                uses, cost = self.alone[grammar.lhs[s]], self.before[s] + self.behind[s + 1]
                if nxt[s] not in uses or cost < uses[nxt[s]][0]:
                    uses[nxt[s]] = (cost, s)
        self.edges = _turns([(row[a], row[b], c) for a in symbols for b, (c, _) in self.alone[a].items()])
        self.layers = []
        for d in range(1, max(self.dot.values()) + 1):
            here = [s for s in self.states if self.dot[s] == d]
            over = [s for s in here if nxt[s - 1] not in terminals]
            self.layers.append((
                np.array([at[s] for s in here], np.int64), np.array([at[s - 1] for s in here], np.int64), np.array([[least[nxt[s - 1]]] for s in here]),
                np.array([at[s] for s in over], np.int64), np.array([row[nxt[s - 1]] for s in over], np.int64), np.array([[self.before[s - 1]] for s in over]).reshape(-1, 1),
            ))

    def repair(self, terms: Sequence[frozenset[int]]) -> tuple[int, list[tuple[str, int, int | None]]]:
        """The least cost of the whole sequence, and edits: kind, place and symbol."""
        n, root = len(terms), self.row[self.root]
        small = 2 * n + 2 * max(self.before.values()) + 2 * max(self.behind.values()) < 10_000
        kind, far = (np.int16, 10_000) if small else (np.int32, 10**8)
        ends, edges = [[(to, of, cost.astype(kind)) for to, of, cost in turns] for turns in (self.ends, self.edges)]
        layers = [(a, b, c.astype(kind), d, e, f.astype(kind)) for a, b, c, d, e, f in self.layers]
        rows = {s: np.array([s not in t for t in terms], kind) for s in set(self.awaited)}
        miss = np.array([rows[s] for s in self.awaited], kind).reshape(len(self.awaited), n)
        least = self.grammar.least
        self._terms = terms
        self._costs = [np.repeat(np.array([[least[s]] for s in self.symbols], kind), n + 1, axis=1)]  # by length: symbol, start
        self._parts = [np.repeat(np.array([[self.before[s]] for s in self.states[: self.kept]], kind), n + 1, axis=1)]  # by length: state, start
        self._own = [np.ones((len(self.symbols), n + 1), bool)]  # whether the cost is one of the symbol's own rules, not another's of the span
        begun, joined = [None], [None]  # by length, start first: the states before a join, and what is joined
        store = _store((n + 1) * (n + 2) // 2 * (self.kept + len(self.symbols) + 2 * self.joins) * np.dtype(kind).itemsize)
        for size in range(1, n + 1):
            m = n - size + 1
            last = self._parts[-1]
            part = np.full((len(self.states), m), far, kind)
            part[self.taken] = last[self.waiting, :m] + miss[:, size - 1 : size - 1 + m]
            part[self.waiting] = np.minimum(part[self.waiting], last[self.waiting, :m] + 1)
            part[self.fresh] = size
            if self.joins and size > 1:
                best, got = np.full((m, self.joins), far, kind), np.empty((m, self.joins), kind)
                for a in range(1, size):
                    np.add(begun[a][:m], joined[size - a][a : a + m], out=got)
                    np.minimum(best, got, out=best)
                part[self.join_to] = np.minimum(part[self.join_to], best.T)
            own = np.full((len(self.symbols), m), far, kind)
            for to, of, more in ends:
                own[to] = np.minimum(own[to], part[of] + more)
            cost, old = own.copy(), None
            while old is None or (cost != old).any():
                old = cost.copy()
                for to, of, more in edges:
                    cost[to] = np.minimum(cost[to], cost[of] + more)
            for to, before, insert, over, symbol, prefix in layers:
                part[to] = np.minimum(part[to], part[before] + insert)
                part[over] = np.minimum(part[over], cost[symbol] + prefix)
            np.minimum(part, far, out=part)
            self._parts.append(store(part[: self.kept].copy()))
            self._costs.append(store(cost))
            begun.append(store(np.ascontiguousarray(part[: self.joins].T)))
            joined.append(store(np.ascontiguousarray(cost[self.joined].T)))
            self._own.append(own == cost)
        total, end = min((int(self._costs[j][root, 0]) + n - j, -j) for j in range(n + 1))
        edits = []
        todo = [(self.root, 0, -end), *(("delete", j, None) for j in range(-end, n))]  # spans and edits, from left to right
        while todo:
            piece = todo.pop()
            if isinstance(piece[0], str):
                edits.append(piece)
            else:
                back: list[tuple] = []
                self._explain(*piece, back)
                todo += reversed(back)
        del self._costs, self._parts, self._own, self._terms
        return total, edits[::-1]

    def _insert(self, first: int, end: int, at: int, back: list) -> None:
        for s in range(end - 1, first - 1, -1):
            if self.grammar.least[self.grammar.next[s]]:
                back.append(("insert", at, self.grammar.next[s]))

    def _last(self, s: int) -> int:
        while self.grammar.next[s] >= 0:
            s += 1
        return s

    def _explain(self, symbol: int, i: int, j: int, back: list) -> None:
        """Adds the edits of a symbol's span and the spans within it, from right to left."""
        size = j - i
        if not size:
            if self.grammar.least[symbol]:
                back.append(("insert", i, symbol))
            return
        costs, own = self._costs[size][:, i], self._own[size][:, i]
        came: dict[int, tuple[int, int] | None] = {symbol: None}
        line = [symbol]
        for a in line:  # to the nearest symbol of the span that its own rules explain
            if own[self.row[a]]:
                break
            for b, (cost, s) in self.alone[a].items():
                if b not in came and costs[self.row[a]] == costs[self.row[b]] + cost:
                    came[b] = (a, s)
                    line.append(b)
        uses, b = [], a
        while came[b] is not None:
            b, s = came[b]
            uses.append(s)
        for s in reversed(uses):
            self._insert(s + 1, self._last(s), j, back)
        self._explain_own(a, i, j, int(costs[self.row[a]]), back)
        for s in uses:
            self._insert(s - self.dot[s], s, i, back)

    def _explain_own(self, symbol: int, i: int, j: int, cost: int, back: list) -> None:
        for first, _ in self.grammar.starts[symbol]:
            end = self._last(first)
            for s in range(end, first - 1, -1):
                part: list[tuple] = []
                if self._step(s, i, j, cost - self.behind[s], part):
                    self._insert(s, end, j, back)
                    back += part
                    return
        raise AssertionError("a span without an explanation")

    def _step(self, s: int, i: int, j: int, cost: int, back: list) -> bool:
        """Whether the part of a rule before the dot has the cost on a span by a step from a shorter span; then adds its pieces."""
        size, nxt = j - i, self.grammar.next
        last = self._parts[size - 1][:, i]
        if self.dot[s]:
            sym = nxt[s - 1]
            if sym in self.grammar.terminals:
                miss = sym not in self._terms[j - 1]
                if last[self.at[s - 1]] + miss == cost:
                    if miss:
                        back.append(("replace", j - 1, sym))
                    self._part(s - 1, i, j - 1, back)
                    return True
            elif self.dot[s] > 1:
                p, q = self.at[s - 1], self.row[sym]
                for a in range(1, size):
                    if self._parts[a][p, i] + self._costs[size - a][q, i + a] == cost:
                        back.append((sym, i + a, j))
                        self._part(s - 1, i, i + a, back)
                        return True
        if nxt[s] in self.grammar.terminals and last[self.at[s]] + 1 == cost:
            back.append(("delete", j - 1, None))
            self._part(s, i, j - 1, back)
            return True
        return False

    def _part(self, s: int, i: int, j: int, back: list) -> None:
        """Adds the pieces of the part of a rule before the dot."""
        while True:
            if i == j:
                self._insert(s - self.dot[s], s, i, back)
                return
            if not self.dot[s]:
                back += [("delete", k, None) for k in range(j - 1, i - 1, -1)]
                return
            size = j - i
            cost = int(self._parts[size][self.at[s], i])
            if self._step(s, i, j, cost, back):
                return
            sym = self.grammar.next[s - 1]
            if sym not in self.grammar.terminals and self._costs[size][self.row[sym], i] + self.before[s - 1] == cost:
                back.append((sym, i, j))
                self._insert(s - 1 - self.dot[s - 1], s - 1, i, back)
                return
            self._insert(s - 1, s, j, back)
            s -= 1
