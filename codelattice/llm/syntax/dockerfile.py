"""Dockerfiles: instructions with their arguments by the chart parser, then their order."""

from __future__ import annotations

import json
import re

from codelattice.llm.syntax.chart import Grammar
from codelattice.llm.syntax.tree import Fault, Memo, Outline

# The instructions of the format.
INSTRUCTIONS = frozenset("FROM RUN CMD LABEL MAINTAINER EXPOSE ENV ADD COPY ENTRYPOINT VOLUME USER WORKDIR ARG ONBUILD STOPSIGNAL HEALTHCHECK SHELL".split())
_QUOTED = re.compile(r"""(?:[^\s"'\\]|\\.|"(?:[^"\\]|\\.)*"|'[^']*')+""", re.S)
_HEREDOC = re.compile(r"<<-?\s*([\"']?)([A-Za-z_]\w*)\1")

GRAMMAR = Grammar(
    """
    line = 'FROM' FLAG* word (AS word)? | 'RUN' FLAG* (rest | JSON) | 'CMD' (rest | JSON) | 'ENTRYPOINT' (rest | JSON) | 'LABEL' pair+ | 'LABEL' word word+ | 'MAINTAINER' rest | 'EXPOSE' word+
      | 'ENV' pair+ | 'ENV' plain rest | ('ADD' | 'COPY') FLAG* (word word+ | JSON | HEREDOC+ word) | 'VOLUME' (word+ | JSON) | 'USER' word | 'WORKDIR' rest | 'ARG' (word | pair)+
      | 'ONBUILD' inner | 'STOPSIGNAL' word | 'HEALTHCHECK' (NONE | FLAG* 'CMD' (rest | JSON)) | 'SHELL' JSON
    inner = line
    rest = any+
    any = WORD | PAIR | AS | NONE | FLAG | HEREDOC | 'CMD' | 'RUN' | 'FROM' | 'COPY' | 'ADD' | 'ENV' | 'USER' | 'ARG' | 'LABEL' | 'EXPOSE' | 'VOLUME' | 'SHELL' | 'WORKDIR' | 'ENTRYPOINT' | 'ONBUILD' | 'STOPSIGNAL' | 'HEALTHCHECK' | 'MAINTAINER'
    word = WORD | PAIR | NONE
    plain = WORD | NONE
    pair = PAIR
    """
)
ORDER = Grammar("file = ARG* FROM (FROM | ARG | OTHER)*")
_LINES, _FILES = Memo(GRAMMAR, ("line",)), Memo(ORDER, ("file",))


def _tokens(instruction: str, rest: str) -> tuple[str, ...]:
    out = [instruction]
    rest = rest.strip()
    if instruction == "ONBUILD":
        first, _, more = rest.partition(" ")
        return (instruction, *_tokens(first.upper(), more)) if first else (instruction,)
    if instruction == "HEALTHCHECK":
        m = re.match(r"((?:--\S+\s+)*)(?:(NONE)\s*$|(CMD)\b\s*(.*))", rest, re.S | re.I)
        if not m:
            return (instruction, "ERR")
        return (instruction, *["FLAG"] * len(m.group(1).split()), *(("NONE",) if m.group(2) else _tokens("CMD", m.group(4))))
    while instruction in ("FROM", "RUN", "ADD", "COPY") and (m := re.match(r"--[a-z][\w-]*(?:=\S*)?(?:\s+|$)", rest)):
        out.append("FLAG")
        rest = rest[m.end() :]
    if rest[:1] == "[" and instruction in ("RUN", "CMD", "ENTRYPOINT", "ADD", "COPY", "VOLUME", "SHELL"):
        try:
            got = json.loads(rest)
            if isinstance(got, list) and all(isinstance(x, str) for x in got):
                return (*out, "JSON")
        except ValueError:
            pass
    if instruction in ("ENV", "LABEL", "ARG"):
        words = _QUOTED.findall(rest)
        if len("".join(words)) != len(re.sub(r"\s(?=(?:[^\"']|\"[^\"]*\"|'[^']*')*$)", "", rest)) and re.sub(r"\s", "", "".join(words)) != re.sub(r"\s", "", rest):
            return (*out, "ERR")  # a quote without its end
        return (*out, *("PAIR" if re.match(r"[^\s=\"']+=", w) or re.match(r"\"[^\"]+\"=", w) else "WORD" for w in words))
    for w in rest.split():
        out.append("HEREDOC" if instruction in ("ADD", "COPY") and w.startswith("<<") else "AS" if instruction == "FROM" and w.upper() == "AS" else "WORD")
    return tuple(out)


def _short(tokens: tuple[str, ...]) -> tuple[str, ...]:
    """Runs of a token cut to three, which no rule of the grammar tells from longer ones."""
    return tuple(t for i, t in enumerate(tokens) if i < 3 or not t == tokens[i - 1] == tokens[i - 2] == tokens[i - 3])


def outline(text: str) -> Outline:
    out = Outline()
    lines = text.lstrip("﻿").split("\n")
    escape = "`" if re.match(r"(?:#[^\n]*\n)*#\s*escape\s*=\s*`", text, re.I) else "\\"
    kinds: list[str] = []
    i, offset, n = 0, 0, len(lines)
    while i < n:
        begin, raw = offset, lines[i]
        offset += len(raw) + 1
        i += 1
        line = raw.strip()
        if not line or line[0] == "#":
            continue
        parts = []
        while line.endswith(escape) and i < n:
            parts.append(line[:-1])
            while i < n:
                raw = lines[i]
                offset += len(raw) + 1
                i += 1
                line = raw.strip()
                if line and line[0] != "#":
                    break
                line = ""
            if not line:
                break
        parts.append(line[:-1] if line.endswith(escape) else line)
        whole = " ".join(parts)
        word, _, rest = whole.partition(" ") if " " in whole.split("\t", 1)[0] else whole.partition("\t")
        name = word.upper()
        out.units += 1
        tokens = _short(_tokens(name, rest)) if name in INSTRUCTIONS else ("UNKNOWN",)
        if name in ("RUN", "ADD", "COPY"):
            for m in _HEREDOC.finditer(rest):
                while i < n and lines[i].strip() != m.group(2):
                    offset += len(lines[i]) + 1
                    i += 1
                if i >= n:
                    tokens = (*tokens, "ERR")
                    out.open_at_end = True
                else:
                    offset += len(lines[i]) + 1
                    i += 1
        if not _LINES.kinds(tokens):
            out.faults.append(Fault(begin, offset - 1, "line", tokens, (begin,) * len(tokens)))
            out.open_at_end = out.open_at_end or i >= n
        kinds.append(name if name in ("FROM", "ARG") else "OTHER")
        if len(kinds) > 2 and kinds[-1] == kinds[-2] == kinds[-3]:
            kinds.pop()
    if not _FILES.kinds(tuple(kinds)):
        out.faults.append(Fault(0, len(text), "file", tuple(kinds)))
    return out


def grammar_of(fault: Fault) -> Grammar:
    return ORDER if fault.symbol == "file" else GRAMMAR
