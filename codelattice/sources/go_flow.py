"""Control flow of Go functions, from their tokens: basic blocks and the edges between them."""

from __future__ import annotations

from collections import deque


class Flow:
    """The blocks of one body. ``block_of`` gives the block of each token that belongs to a statement or to a head; block 0 is the entry."""

    def __init__(self, tokens, begin: int, end: int) -> None:
        self.t, self.count = tokens, 1
        self.edges: list[tuple[int, int, str]] = []
        self.block_of: dict[int, int] = {}
        self._labels: dict[str, int] = {}
        self._jumps: list[tuple[int, str]] = []
        self._run(begin, end, 0, ())
        self.edges += [(at, self._labels[name], "jump") for at, name in self._jumps if name in self._labels]

    def order(self) -> list[int]:
        """Blocks in the order of a breadth-first walk from the entry; what control never reaches is left out."""
        after: dict[int, list[int]] = {}
        for a, b, _ in self.edges:
            after.setdefault(a, []).append(b)
        seen, todo = [0], deque([0])
        while todo:
            for n in after.get(todo.popleft(), ()):
                if n not in seen:
                    seen.append(n)
                    todo.append(n)
        return seen

    def _block(self) -> int:
        self.count += 1
        return self.count - 1

    def _mark(self, a: int, b: int, at: int) -> None:
        for i in range(a, b):
            self.block_of[i] = at

    def _end(self, i: int, end: int) -> int:
        """Where the statement at i ends: a line end or semicolon outside of brackets."""
        depth = 0
        while i < end:
            w = self.t.words[i]
            if depth == 0 and (self.t.kinds[i] == "nl" or w == ";"):
                return i
            if self.t.kinds[i] == "op":
                depth += (w in "([{") - (w in ")]}")
            i += 1
        return end

    def _body(self, i: int, end: int) -> int:
        """The brace that opens the body behind the head at i; literals of functions and empty types aside."""
        words, literal = self.t.words, False
        while i < end:
            w = words[i]
            if w in ("(", "["):
                i = self.t.close(i)
            elif w == "func":
                literal = True
            elif w == "{":
                if not literal and words[i - 1] not in ("interface", "struct"):
                    return i
                literal = False
                i = self.t.close(i)
            i += 1
        return end

    def _run(self, i: int, end: int, at: int | None, loops: tuple) -> int | None:
        """Lays out the statements from i to end; the block where control goes on, None where it doesn't.

        ``loops``: (label, where ``continue`` goes, where ``break`` goes), innermost last.
        """
        words, label = self.t.words, ""
        while i < end:
            w = words[i]
            if self.t.kinds[i] == "nl" or w == ";":
                i += 1
                continue
            if at is None:
                at = self._block()  # unreachable unless a label makes it known
            if self.t.kinds[i] == "name" and i + 1 < end and words[i + 1] == ":":
                label = w
                new = self._block()
                self.edges.append((at, new, "next"))
                at = self._labels[label] = new
                i += 2
                continue
            if w == "if":
                i, at = self._if(i, end, at, loops)
            elif w == "for":
                i, at = self._for(i, end, at, loops, label)
            elif w in ("switch", "select"):
                i, at = self._switch(i, end, at, loops, label)
            elif w == "{":
                close = self.t.close(i)
                at = self._run(i + 1, close, at, loops)
                i = close + 1
            else:
                stop = self._end(i, end)
                self._mark(i, stop, at)
                if w == "return":
                    at = None
                elif w in ("break", "continue"):
                    name = words[i + 1] if stop > i + 1 else ""
                    k = 2 if w == "break" else 1
                    to = next((x[k] for x in reversed(loops) if x[k] is not None and (not name or x[0] == name)), None)
                    if to is not None:
                        self.edges.append((at, to, "jump"))
                    at = None
                elif w == "goto" and stop > i + 1:
                    self._jumps.append((at, words[i + 1]))
                    at = None
                i = stop
            label = ""
        return at

    def _if(self, i: int, end: int, at: int, loops: tuple) -> tuple[int, int | None]:
        body = self._body(i, end)
        self._mark(i, body, at)
        if body >= end:
            return end, at
        close = self.t.close(body)
        then, after = self._block(), self._block()
        self.edges.append((at, then, "true"))
        ends = [self._run(body + 1, close, then, loops)]
        i = close + 1
        if i < end and self.t.words[i] == "else":
            other = self._block()
            self.edges.append((at, other, "false"))
            self._mark(i, i + 1, other)
            if i + 1 < end and self.t.words[i + 1] == "if":
                i, last = self._if(i + 1, end, other, loops)
            else:
                close = self.t.close(i + 1) if i + 1 < end and self.t.words[i + 1] == "{" else end
                last = self._run(i + 2, close, other, loops)
                i = close + 1
            ends.append(last)
        else:
            self.edges.append((at, after, "false"))
            ends.append(after)
        live = [e for e in ends if e is not None]
        self.edges += [(e, after, "next") for e in live if e != after]
        return i, after if live else None

    def _for(self, i: int, end: int, at: int, loops: tuple, label: str) -> tuple[int, int | None]:
        body = self._body(i, end)
        head, inner, after = self._block(), self._block(), self._block()
        self._mark(i, body, head)
        self.edges += [(at, head, "next"), (head, inner, "true")]
        if body > i + 1:  # ``for`` alone ends by a break only
            self.edges.append((head, after, "false"))
        if body >= end:
            return end, after
        close = self.t.close(body)
        last = self._run(body + 1, close, inner, (*loops, (label, head, after)))
        if last is not None:
            self.edges.append((last, head, "back"))
        return close + 1, after if any(b == after for _, b, _ in self.edges) else None

    def _switch(self, i: int, end: int, at: int, loops: tuple, label: str) -> tuple[int, int | None]:
        words, body = self.t.words, self._body(i, end)
        self._mark(i, body, at)
        if body >= end:
            return end, at
        close, after = self.t.close(body), self._block()
        clauses, k = [], body + 1
        while k < close:
            if words[k] in ("case", "default") and self.t.kinds[k] == "name":
                clauses.append(k)
            k = self.t.close(k) + 1 if words[k] in ("(", "[", "{") else k + 1
        blocks = [self._block() for _ in clauses]
        for n, k in enumerate(clauses):
            colon = k
            while colon < close and words[colon] != ":":
                colon = self.t.close(colon) + 1 if words[colon] in ("(", "[", "{") else colon + 1
            stop = clauses[n + 1] if n + 1 < len(clauses) else close
            self._mark(k, colon, blocks[n] if words[i] == "select" else at)
            self.edges.append((at, blocks[n], "case"))
            last = self._run(colon + 1, stop, blocks[n], (*loops, (label, None, after)))
            if last is not None:
                tail = [x for x in range(colon + 1, stop) if self.t.kinds[x] != "nl" and words[x] != ";"]
                falls = bool(tail) and words[tail[-1]] == "fallthrough" and n + 1 < len(clauses)
                self.edges.append((last, blocks[n + 1] if falls else after, "next"))
        if words[i] == "switch" and not any(words[k] == "default" for k in clauses):
            self.edges.append((at, after, "next"))
        return close + 1, after if any(b == after for _, b, _ in self.edges) else None
