"""A chart parser for context-free grammars that finds derivations of least edit cost.

Items are dotted rules with the place where they began. Cost 1 is charged for a token inserted, deleted or replaced. The chart is
explored in order of cost: ``derives`` explores the part of cost 0, ``repair`` goes on until the cheapest repair is found, whatever its
cost and the sequence's length. An ``Outlook`` tells what the rest of the sequence costs at least, which keeps that search narrow; where
it grows wide all the same, ``Spans`` takes over, which is as exact.

Grammars are written as ``name = alternative | alternative`` with ``'token'`` or ``TOKEN`` for terminals, ``( )`` for groups and
``? * +`` behind a symbol. A token may stand for several terminals (a name that is also a soft keyword, a bracketed group that is
valid as this and as that); ``Grammar.means`` says which.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np

from codelattice.llm.syntax.spans import Spans

#: Above every cost.
_FAR = 10**8


@dataclass(frozen=True)
class Edit:
    """An edit of the token sequence: ``insert`` before, ``delete`` or ``replace`` at the token ``at``."""

    kind: str
    at: int
    token: str


class Grammar:
    def __init__(self, text: str, means: dict[str, Sequence[str]] | None = None) -> None:
        self._ids: dict[str, int] = {}  # symbols; terminals are in self.terminals
        self.terminals: set[int] = set()
        self._rules: list[tuple[int, tuple[int, ...]]] = []
        self._made = 0
        for line in re.split(r"\n(?=\s*\w+\s*=)", text.strip()):
            if line.strip():
                lhs, _, body = line.partition("=")
                self._read(lhs.strip(), body)
        self._sets: dict[str, frozenset[int]] = {}
        self._outlooks: dict[int, Outlook] = {}
        self._spans: dict[int, Spans] = {}
        self._finish()
        for token, names in (means or {}).items():
            self.means(token, names)

    # Reading

    def _id(self, name: str, terminal: bool = False) -> int:
        got = self._ids.setdefault(("'" if terminal else "") + name, len(self._ids))
        if terminal:
            self.terminals.add(got)
        return got

    def _read(self, lhs: str, body: str) -> None:
        tokens = re.findall(r"'[^']+'|[A-Za-z_]\w*|[|()?*+]", body)
        at = 0

        def alternatives() -> list[tuple[int, ...]]:
            nonlocal at
            out, one = [], []
            while at < len(tokens) and tokens[at] != ")":
                t = tokens[at]
                at += 1
                if t == "|":
                    out.append(tuple(one))
                    one = []
                    continue
                if t == "(":
                    inner = alternatives()
                    at += 1
                    sym = inner[0][0] if len(inner) == 1 and len(inner[0]) == 1 else self._new(inner)
                elif t[0] == "'" or t.isupper():
                    sym = self._id(t.strip("'"), True)
                else:
                    sym = self._id(t)
                while at < len(tokens) and tokens[at] in "?*+":
                    op = tokens[at]
                    at += 1
                    if op == "?":
                        sym = self._new([(), (sym,)])
                    else:
                        many = self._new([])
                        self._rules += [(many, (many, sym)), (many, (sym,) if op == "+" else ())]
                        sym = many
                one.append(sym)
            out.append(tuple(one))
            return out

        for alt in alternatives():
            self._rules.append((self._id(lhs), alt))

    def _new(self, alts: Iterable[tuple[int, ...]]) -> int:
        self._made += 1
        sym = self._id(f"_{self._made}")
        self._rules += [(sym, a) for a in alts]
        return sym

    def _finish(self) -> None:
        self._rules.sort(key=lambda r: r[0])
        n = len(self._ids)
        self.starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # of each symbol: (state, rule)
        self.next: list[int] = []  # of each state: the symbol behind the dot, -1 at the end
        self.lhs: list[int] = []
        for k, (lhs, rhs) in enumerate(self._rules):
            self.starts[lhs].append((len(self.next), k))
            self.next += [*rhs, -1]
            self.lhs += [lhs] * (len(rhs) + 1)
        undefined = [s for s, i in self._ids.items() if i not in self.terminals and not self.starts[i]]
        if undefined:
            raise ValueError(f"symbols without rules: {undefined}")
        self.nullable, self.first = [False] * n, [frozenset((i,)) if i in self.terminals else frozenset() for i in range(n)]
        self.least = [1 if i in self.terminals else 10**6 for i in range(n)]  # fewest tokens a symbol can stand for
        changed = True
        while changed:
            changed = False
            for lhs, rhs in self._rules:
                first: frozenset[int] = frozenset()
                for s in rhs:
                    first |= self.first[s]
                    if not self.nullable[s]:
                        break
                new = (self.nullable[lhs] or all(self.nullable[s] for s in rhs), self.first[lhs] | first, min(self.least[lhs], sum(self.least[s] for s in rhs)))
                if new != (self.nullable[lhs], self.first[lhs], self.least[lhs]):
                    self.nullable[lhs], self.first[lhs], self.least[lhs] = new
                    changed = True
        self._rule_first: list[tuple[frozenset[int], bool]] = []
        for _, rhs in self._rules:
            first, empty = frozenset(), True
            for s in rhs:
                first |= self.first[s]
                if not self.nullable[s]:
                    empty = False
                    break
            self._rule_first.append((first, empty))

    def means(self, token: str, names: Sequence[str]) -> str:
        """Lets ``token`` stand for each of the terminals ``names``."""
        self._sets[token] = frozenset(self._ids[x] for x in ("'" + n for n in names) if x in self._ids)
        return token

    def _terms(self, token: str) -> frozenset[int]:
        got = self._sets.get(token)
        if got is None:
            i = self._ids.get("'" + token)
            got = self._sets[token] = frozenset() if i is None else frozenset((i,))
        return got

    def has(self, name: str) -> bool:
        return name in self._ids

    # Parsing

    def derives(self, tokens: Sequence[str], start: str) -> tuple[bool, int]:
        """Whether ``start`` derives the tokens as they are, and how many of them a derivation can begin with."""
        root = self._ids[start]
        nxt, lhs, terminals, nullable = self.next, self.lhs, self.terminals, self.nullable
        waits: list[dict[int, list[tuple[int, int]]]] = []
        terms = [self._terms(t) for t in tokens]
        terms.append(frozenset())
        now: list[tuple[int, int]] = []
        done = False
        for pos, term in enumerate(terms):
            wait: dict[int, list[tuple[int, int]]] = {}
            waits.append(wait)
            later: list[tuple[int, int]] = []
            if pos == 0:
                now = [(s, 0) for s, k in self.starts[root] if self._rule_first[k][1] or self._rule_first[k][0] & term]
            elif not now:
                return False, pos - 1
            seen = set(now)
            done = False
            while now:
                item = now.pop()
                state, origin = item
                sym = nxt[state]
                if sym < 0:
                    head = lhs[state]
                    if origin == 0 and head == root:
                        done = True
                    for s, o in waits[origin].get(head, ()):
                        new = (s + 1, o)
                        if new not in seen:
                            seen.add(new)
                            now.append(new)
                elif sym in terminals:
                    if sym in term:
                        later.append((state + 1, origin))
                else:
                    known = wait.get(sym)
                    if known is None:
                        wait[sym] = [item]
                        for s, k in self.starts[sym]:
                            first, empty = self._rule_first[k]
                            if empty or not first.isdisjoint(term):
                                new = (s, pos)
                                if new not in seen:
                                    seen.add(new)
                                    now.append(new)
                    else:
                        known.append(item)
                    if nullable[sym]:
                        new = (state + 1, origin)
                        if new not in seen:
                            seen.add(new)
                            now.append(new)
            now = later
        return done, len(tokens)

    def repair(self, tokens: Sequence[str], start: str, limit: int | None = None) -> tuple[int, list[Edit]]:
        """The least cost of turning the tokens into a derivation of ``start``, and such edits; with a ``limit``, limit + 1 if it costs more."""
        root, terms = self._ids[start], [self._terms(t) for t in tokens]
        outlook = self._outlooks.get(root)
        if outlook is None:
            outlook = self._outlooks[root] = Outlook(self, root)
        rest = outlook.costs(terms)
        most = int(min(rest[0][outlook.kind[s]] for s, _ in self.starts[root]))
        self._spare = min(100 * (len(tokens) + 1) * (1 + len(tokens) // 30), 200_000 + 5_000 * len(tokens))
        try:
            while limit is None or most <= limit:
                got = self._within(tokens, terms, root, most, outlook.kind, rest)
                if got is not None:
                    return got
                most += 1
        except _Wide:  # computing the cost of every span is less work by now, or takes less memory
            spans = self._spans.get(root)
            if spans is None:
                spans = self._spans[root] = Spans(self, root)
            cost, edits = spans.repair(terms)
            if limit is None or cost <= limit:
                names = {i: s.strip("'") for s, i in self._ids.items()}
                return cost, [Edit(k, at, tokens[at] if sym is None else names[sym]) for k, at, sym in edits]
        return limit + 1, [Edit("replace", self.derives(tokens, start)[1], "")]

    def _within(self, tokens: Sequence[str], terms: list[frozenset[int]], root: int, limit: int, kind: list[int], rest: np.ndarray) -> tuple[int, list[Edit]] | None:
        """The cheapest repair if it costs ``limit`` at most; items whose cost and bound of the rest exceed it are left out."""
        n = len(tokens)
        names = {i: s for s, i in self._ids.items()}
        waits: list[dict[int, dict[tuple[int, int], int]]] = [{} for _ in range(n + 1)]
        base: list[dict[int, int]] = [{} for _ in range(n + 1)]  # the least cost before a symbol that is predicted here
        inside: list[dict[tuple[int, int], int]] = [{} for _ in range(n + 1)]
        back: dict[tuple[int, tuple[int, int]], tuple] = {}
        queue: list[dict[int, list[tuple[tuple[int, int], int]]]] = [{} for _ in range(n + 1)]  # by total cost
        here, ahead = rest[0].tolist(), rest[0].tolist()

        def push(to: int, item: tuple[int, int], cost: int, total: int, how: tuple) -> None:
            if total + (here if to == pos else ahead)[kind[item[0]]] <= limit and cost < inside[to].get(item, limit + 1):
                inside[to][item] = cost
                back[to, item] = how
                queue[to].setdefault(total, []).append((item, cost))

        pos = 0
        base[0][root] = 0
        for s, _ in self.starts[root]:
            push(0, (s, 0), 0, 0, ())
        for pos in range(n + 1):
            term = terms[pos] if pos < n else frozenset()
            here, ahead = ahead, rest[min(pos + 1, n)].tolist()
            while queue[pos]:
                total = min(queue[pos])
                todo = queue[pos][total]
                while todo:
                    item, cost = todo.pop()
                    if inside[pos][item] < cost:
                        continue
                    self._spare -= 1
                    if self._spare < 0:
                        raise _Wide
                    state, origin = item
                    sym = self.next[state]
                    if sym < 0:
                        head = self.lhs[state]
                        if origin < pos:
                            for w, c in waits[origin].get(head, {}).items():
                                self._spare -= 1
                                push(pos, (w[0] + 1, w[1]), c + cost, base[w[1]][self.lhs[w[0]]] + c + cost, ("done", origin, w, item))
                        if pos < n and head == root and origin == 0:
                            push(pos + 1, item, cost + 1, total + 1, ("delete", pos, item))
                        continue
                    after = (state + 1, origin)
                    if sym in self.terminals:
                        if pos < n:
                            if sym in term:
                                push(pos + 1, after, cost, total, ("take", pos, item))
                            else:
                                push(pos + 1, after, cost + 1, total + 1, ("replace", pos, item, sym))
                            push(pos + 1, item, cost + 1, total + 1, ("delete", pos, item))
                        push(pos, after, cost + 1, total + 1, ("insert", pos, item, sym))
                        continue
                    known = waits[pos].setdefault(sym, {})
                    if cost < known.get(item, limit + 1):
                        known[item] = cost
                    if total < base[pos].get(sym, limit + 1):
                        base[pos][sym] = total
                        for s, _ in self.starts[sym]:
                            if inside[pos].get((s, pos)) == 0:  # known, but now from a cheaper side
                                todo.append(((s, pos), 0))
                            push(pos, (s, pos), 0, total, ())
                    push(pos, after, cost + self.least[sym], total + self.least[sym], ("insert", pos, item, sym))
                del queue[pos][total]
        ends = [(c, i) for i, c in inside[n].items() if i[1] == 0 and self.next[i[0]] < 0 and self.lhs[i[0]] == root]
        if not ends:
            return None
        cost, item = min(ends)
        edits: list[Edit] = []
        stack = [(n, item)]
        while stack:
            at = stack.pop()
            how = back.get(at, ())
            if not how:
                continue
            if how[0] == "done":
                stack += [(how[1], how[2]), (at[0], how[3])]
            else:
                if how[0] != "take" and not (how[0] == "insert" and self.least[how[3]] == 0):
                    edits.append(Edit(how[0], how[1], names[how[3]].strip("'") if len(how) > 3 else tokens[how[1]]))
                stack.append((how[1], how[2]))
        return cost, sorted(reversed(edits), key=lambda e: e.at)  # they came from the right


class _Wide(Exception):
    """The search by cost looks at too many items."""


class Outlook:
    """Lower bounds of the cost of a sequence's rest, from each state of the grammar.

    The grammar is read as a finite automaton: a symbol's end goes on behind any use of the symbol. That allows all that the grammar
    allows, so no repair costs less than the bound.
    """

    def __init__(self, grammar: Grammar, root: int) -> None:
        nxt, lhs, starts = grammar.next, grammar.lhs, grammar.starts
        reached, todo = {root}, [root]
        states: list[int] = []
        uses: dict[int, list[int]] = {}  # the states behind a symbol's uses
        while todo:
            for s, _ in starts[todo.pop()]:
                while True:
                    states.append(s)
                    sym = nxt[s]
                    if sym < 0:
                        break
                    uses.setdefault(sym, []).append(s + 1)
                    if sym not in grammar.terminals and sym not in reached:
                        reached.add(sym)
                        todo.append(sym)
                    s += 1
        steps = [s for s in states if nxt[s] in grammar.terminals]
        end = len(steps)  # beside the steps over a terminal, the sequence's end
        masks = [0] * len(nxt)  # of each state: the steps that may come next
        for e, s in enumerate(steps):
            masks[s] = 1 << e
        changed = True
        while changed:
            changed = False
            for s in reversed(states):
                sym, mask = nxt[s], masks[s]
                if sym < 0:
                    for t in uses.get(lhs[s], ()):
                        mask |= masks[t]
                    mask |= (lhs[s] == root) << end
                elif sym not in grammar.terminals:
                    for t, _ in starts[sym]:
                        mask |= masks[t]
                if mask != masks[s]:
                    masks[s] = mask
                    changed = True
        kinds: dict[int, int] = {}
        self.kind = [kinds.setdefault(masks[s], len(kinds)) if masks[s] else -1 for s in range(len(nxt))]
        self._may = np.array([[mask >> e & 1 for e in range(end + 1)] for mask in kinds], bool)
        self._after = np.array([self.kind[s + 1] for s in steps], np.int64)
        self._symbols = [nxt[s] for s in steps]
        # the fewest insertions that lead from one step to another
        self._far = np.full((end + 1, end + 1), _FAR, np.int32)
        now, links = np.eye(end + 1, dtype=np.float32), np.zeros((end + 1, end + 1), np.float32)
        links[:end] = self._may[self._after]
        cost = 0
        while now.any():
            self._far[now > 0] = cost
            now = ((now @ links > 0) & (self._far == _FAR)).astype(np.float32)
            cost += 1

    def costs(self, terms: Sequence[frozenset[int]]) -> np.ndarray:
        """For each place of the sequence and each kind of state the least cost of what is left."""
        n, end = len(terms), len(self._symbols)
        out = np.empty((n + 1, len(self._may)), np.int32)
        misses: dict[frozenset[int], np.ndarray] = {}
        step = np.full(end + 1, _FAR, np.int32)  # the cost of the rest if a step is the next that is not inserted
        step[end] = 0
        for pos in range(n, -1, -1):
            if pos < n:
                term = terms[pos]
                miss = misses.get(term)
                if miss is None:
                    miss = misses[term] = np.array([s not in term for s in self._symbols], np.int32)
                step = at + 1
                step[:end] = np.minimum(step[:end], out[pos + 1][self._after] + miss)
            at = (self._far + step).min(axis=1)
            out[pos] = np.where(self._may, at, _FAR).min(axis=1)
        return out
