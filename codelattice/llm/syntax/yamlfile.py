"""YAML: entries by indentation, flow collections and the order of entries by the chart parser."""

from __future__ import annotations

import re

from codelattice.llm.syntax.chart import Grammar
from codelattice.llm.syntax.tree import Fault, Memo, Outline

_KEY = re.compile(r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\n]|'')*'|(?![-?:](?:\s|$))[^\s#,\[\]{}&*!|>'"%@`][^\n]*?|[*&!]\S+|<<)\s*:(?=\s|$)""")
_PROPERTIES = re.compile(r"(?:[&!]\S*\s*)+")
_FLOW = re.compile(r"""(?P<ws>\s+|(?<=\s)\#[^\n]*)|(?P<str>"(?:[^"\\]|\\[\s\S])*"|'(?:[^']|'')*')|(?P<op>[\[\]{},]|:(?=[\s,\[\]{}"']|$)|(?<=["'\]}]):)|(?P<mark>[&!]\S*)|(?P<plain>(?:[^\s,\[\]{}:\#"'%@`]|:(?![\s,\[\]{}])|(?<=\S)\#)(?:[^,\[\]{}:\#\n]|:(?![\s,\[\]{}]|$)|(?<=\S)\#)*)|(?P<bad>.)""")

FLOW = Grammar(
    """
    flow = sequence | mapping
    sequence = '[' (entry (',' entry)* ','?)? ']'
    mapping = '{' (pair (',' pair)* ','?)? '}'
    entry = node | node ':' node? | MARK+
    pair = node ':' node? | node | MARK+
    node = MARK* (SCALAR | sequence | mapping)
    """
)
ENTRIES = Grammar(
    """
    block = (KEYED | KEY NODE?)+ | (DASHED | DASH NODE?)+ | SCALAR+ | COLLECTION
    file = block?
    """
)
_FLOWS, _BLOCKS = Memo(FLOW, ("flow",)), Memo(ENTRIES, ("block",))


def _flow_end(text: str, at: int) -> tuple[int, tuple[str, ...], tuple[int, ...]]:
    """The end of a flow collection, its tokens and their offsets; end -1 if it doesn't end."""
    depth, tokens, offsets = 0, [], []
    for m in _FLOW.finditer(text, at):
        g = m.lastgroup
        if g == "ws":
            continue
        offsets.append(m.start())
        if g == "op":
            t = m.group()
            tokens.append(t)
            if t in "[{":
                depth += 1
            elif t in "]}":
                depth -= 1
                if depth == 0:
                    return m.end(), tuple(tokens), tuple(offsets)
        elif g == "bad":
            tokens.append("ERR")
            if m.group() in "\"'":
                break
        else:
            tokens.append("MARK" if g == "mark" else "SCALAR")
            if g == "plain" and "\n---" in m.group():
                break
    return -1, tuple(tokens), tuple(offsets)


def outline(text: str) -> Outline:
    out = Outline()
    text = text.lstrip("﻿")
    faults = out.faults
    stack: list[list] = []  # [column, entries, offset]; sequences in line with their key stand half a column deeper
    n, at = len(text), 0
    plain_open = False  # the last entry is a plain scalar that deeper lines continue

    def close(column: float) -> None:
        while stack and stack[-1][0] > column:
            _, entries, begin = stack.pop()
            out.units += 1
            if not _BLOCKS.kinds(tuple(entries)):
                faults.append(Fault(begin, at, "block", tuple(entries)))
            if stack:
                stack[-1][1].append("NODE")

    def entry(column: float, kind: str, offset: int) -> None:
        """Adds an entry to the block at its column."""
        close(column)
        top = stack[-1] if stack else None
        if top is None or column > top[0]:
            stack.append([column, [kind], offset])
        elif column < top[0]:
            faults.append(Fault(offset, offset, "dedent"))
        else:
            entries = top[1]
            if kind in ("KEYED", "DASHED", "SCALAR") and entries[-1:] == [kind]:
                return
            if len(entries) >= 4 and entries[-2:] == [kind, "NODE"] or entries[-3:] == ["NODE", "KEY", "NODE"]:
                del entries[-2:]  # repetition carries no information
            entries.append(kind)

    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        begin = at
        line = text[at:end].rstrip("\r")
        body = line.lstrip(" ")
        at = end + 1
        if not body.strip() or body[0] == "#":
            continue
        if body[0] == "\t":
            faults.append(Fault(begin, end, "tab"))
            continue
        column: float = len(line) - len(body)
        if column == 0 and re.match(r"(?:---|\.\.\.)(?:\s|$)", body) or (column == 0 and body[0] == "%" and not stack):
            close(-1)
            stack.clear()
            plain_open = False
            body = body[3:].strip() if body[0] == "-" else ""
            if not body or body[0] == "#":
                continue
            column = 1
        offset = begin + int(column)
        top = stack[-1] if stack else None
        if plain_open and top and column > int(top[0]) and not _KEY.match(body):
            continue  # a plain scalar goes on
        plain_open = False
        if top and body[0] == "-" and (len(body) == 1 or body[1].isspace()):
            close(column + 0.5)
            top = stack[-1] if stack else None
            if top and (top[0] == column + 0.5 or top[0] == column and top[1][-1] in ("KEY", "NODE") and top[1][0] in ("KEY", "KEYED")):
                column += 0.5
        elif top and top[0] == column + 0.5:
            close(column)
        while body[0] == "-" and (len(body) == 1 or body[1].isspace()):
            inner = body[1:].lstrip()
            if not inner or inner[0] == "#":
                entry(column, "DASH", offset)
                body = ""
                break
            deeper = int(column) + len(body) - len(inner)
            nested = bool(_KEY.match(inner)) or inner[0] == "-" and (len(inner) == 1 or inner[1].isspace())
            entry(column, "DASH" if nested else "DASHED", offset)
            body, offset = inner, begin + deeper
            if not nested:
                at, plain_open = _value(text, offset, int(column), end, out)
                body = ""
                break
            column = deeper
        if not body:
            continue
        m = _KEY.match(body)
        if m:
            rest = body[m.end() :]
            value = rest.strip()
            p = _PROPERTIES.match(value)
            value = value[p.end() :] if p else value
            if not value or value[0] == "#":
                entry(column, "KEY", offset)
            else:
                entry(column, "KEYED", offset)
                at, plain_open = _value(text, offset + m.end() + len(rest) - len(rest.lstrip()) + (p.end() if p else 0), int(column), end, out)
        else:
            kind = "COLLECTION" if body[0] in "[{" else "SCALAR"
            entry(column, kind, offset)
            at, plain_open = _value(text, offset, int(column) - 1, end, out)
    close(-1)
    return out


def _value(text: str, at: int, column: int, end: int, out: Outline) -> tuple[int, bool]:
    """Reads an entry's value: where the next line begins, and whether deeper lines may continue it."""
    n = len(text)
    c = text[at]
    if c in "|>":
        if not re.match(r"[|>][-+0-9]*[ \t]*(?:#[^\n]*)?\r?(?:\n|$)", text[at : end + 1]):
            out.faults.append(Fault(at, end, "scalar", ("ERR",)))
        nxt = end + 1
        while nxt < n:
            stop = text.find("\n", nxt)
            stop = n if stop < 0 else stop
            line = text[nxt:stop]
            if line.strip() and len(line) - len(line.lstrip(" ")) <= column:
                break
            nxt = stop + 1
        return nxt, False
    if c in "[{":
        stop, tokens, offsets = _flow_end(text, at)
        out.units += 1
        if stop < 0:
            out.open_at_end = True
        if stop < 0 or not _FLOWS.kinds(tokens):
            out.faults.append(Fault(at, stop if stop > 0 else n, "flow", tokens, offsets))
            if stop < 0:
                return end + 1, False
        return _rest(text, stop, out), False
    if c in "\"'":
        m = re.compile(r'"(?:[^"\\]|\\[\s\S])*"' if c == '"' else r"'(?:[^']|'')*'").match(text, at)
        if not m:
            out.open_at_end = True
            out.faults.append(Fault(at, n, "scalar", ("ERR",)))
            return end + 1, False
        return _rest(text, m.end(), out), False
    value = re.sub(r"(?:^|\s)#.*", "", text[at:end], flags=re.S)
    if c in "%@`]}," or re.search(r":(?:\s|$)", value.rstrip("\r")) or (c in "&*!" and not re.match(r"[&*!]\S+", value)):
        out.faults.append(Fault(at, end, "scalar", ("ERR",)))
    return end + 1, c not in "*&!"


def _rest(text: str, at: int, out: Outline) -> int:
    """The next line behind a value that has ended; only a comment may stand before it."""
    end = text.find("\n", at)
    end = len(text) if end < 0 else end
    if not re.fullmatch(r"\s*|\s+#.*|\s*,?\s*", text[at:end]) or "," in text[at:end].split("#")[0]:
        out.faults.append(Fault(at, end, "scalar", ("ERR",)))
    return end + 1


def grammar_of(fault: Fault) -> Grammar:
    return FLOW if fault.symbol == "flow" else ENTRIES
