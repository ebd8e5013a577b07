"""What a language's syntax module gives: the units of a file that the chart parser could not derive, and its functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from codelattice.llm.syntax.chart import Edit, Grammar

#: Entries of a table of unit signatures; such tables are emptied when full.
MEMO = 200_000


@dataclass
class Fault:
    """A unit without a derivation: its offset and end in the text, what was tried, and its tokens."""

    start: int
    end: int
    symbol: str
    tokens: tuple[str, ...] = ()
    offsets: tuple[int, ...] = ()


@dataclass
class Outline:
    """What one pass over a file yields."""

    faults: list[Fault] = field(default_factory=list)
    units: int = 0
    #: (offset of the keyword or name, name, offset at which the statement with its modifiers and decorators begins, doc)
    functions: list[tuple[int, str, int, str | None]] = field(default_factory=list)
    #: The offset at which each of the functions ends.
    ends: dict[int, int] = field(default_factory=dict)
    comments: list[tuple[int, int]] = field(default_factory=list)
    open_at_end: bool = False


class Memo:
    """Which symbols derive a token sequence, remembered by the sequence.

    A derivation depends on the sequence alone, so what one file's unit yields serves every other file.
    """

    def __init__(self, grammar: Grammar, symbols: Sequence[str]) -> None:
        self.grammar, self.symbols = grammar, tuple(symbols)
        self._known: dict[tuple[str, ...], frozenset[str]] = {}

    def kinds(self, tokens: tuple[str, ...], symbols: Sequence[str] | None = None) -> frozenset[str]:
        got = self._known.get(tokens)
        if got is None:
            if len(self._known) > MEMO:
                self._known.clear()
            got = self._known[tokens] = frozenset(s for s in symbols or self.symbols if self.grammar.derives(tokens, s)[0])
        return got


def least_repair(grammar: Grammar, fault: Fault) -> tuple[int, list[Edit]]:
    """The cheapest repair of a fault, of any length and cost."""
    return grammar.repair(fault.tokens, fault.symbol)
