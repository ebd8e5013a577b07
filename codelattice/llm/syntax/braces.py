"""Languages whose statements end with semicolons and whose blocks stand in braces.

A file is a tree of brace groups. Each group is cut into units (statements, members, clauses); a unit's tokens, with the groups
inside it standing as single tokens, go through the chart parser once for each distinct sequence. What a group is valid as
(block, class body, literal and so on) follows from what all its units are valid as, and becomes the token that stands for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from codelattice.llm.syntax.chart import Grammar
from codelattice.llm.syntax.tree import Fault, Memo, Outline


@dataclass(frozen=True)
class Language:
    grammar: Grammar
    memo: Memo
    #: What a group is valid as, by what all of its units must be valid as.
    groups: tuple[tuple[str, str], ...]
    #: Of a group whose units are not all of one kind, the kind that counts for reporting.
    usual: str
    #: Tokens that continue a unit behind a group, and those that open a head in which semicolons belong to the unit.
    continues: frozenset[str]
    heads: frozenset[str]
    ends_after_group: bool
    file: str
    file_kinds: tuple[tuple[str, str], ...]
    files: Memo
    #: Units of a file that don't repeat.
    once: frozenset[str] = frozenset(("P",))


def parse(text: str, codes: Sequence[str], at: Sequence[int], language: Language, out: Outline) -> None:
    """Adds the units that are not derivable to ``out.faults``."""
    n, lang, memo, faults = len(codes), language, language.memo, out.faults
    every = "group:" + "+".join(sorted({g for g, _ in lang.groups}))
    lang.grammar.means(every, [g for g, _ in lang.groups])
    all_kinds = frozenset(k for _, k in lang.groups)
    # A frame: offset of its brace, units' common kinds, whether a unit failed, current unit's tokens and offsets, open brackets
    frames: list[list] = [[0, None, False, [], [], 0, []]]
    file_units: list[str] = []
    i = 0

    def end_unit(frame: list, end: int, semicolon: bool = False) -> None:
        tokens, offsets = tuple(frame[3]), tuple(frame[4])
        frame[3], frame[4], frame[5] = [], [], 0
        frame[6].clear()
        if not tokens:
            return
        out.units += 1
        kinds = memo.kinds(tokens)
        if len(frames) == 1:
            code = next((c for c, k in lang.file_kinds if k in kinds), "")
            if not code:
                faults.append(Fault(offsets[0], end, _nearest(lang, tokens, [k for _, k in lang.file_kinds]), tokens, offsets))
                code = lang.file_kinds[-1][0]
            if code in lang.once or file_units[-1:] != [code]:
                file_units.append(code)
            return
        common = kinds & all_kinds
        if semicolon:  # what a semicolon ends is no list of elements
            common -= {"elements"}
        merged = common if frame[1] is None else frame[1] & common
        if not common or not merged:
            faults.append(Fault(offsets[0], end, lang.usual if common else _nearest(lang, tokens, [lang.usual, *sorted(all_kinds - {lang.usual})]), tokens, offsets))
            frame[2] = True
        else:
            frame[1] = merged

    special = frozenset("{};()[]")
    frame = frames[-1]
    add, add_at = frame[3].append, frame[4].append
    while i < n:
        c = codes[i]
        if c not in special:
            add(c)
            add_at(at[i])
            i += 1
            continue
        if c == "{":
            frame = [at[i], None, False, [], [], 0, []]
            frames.append(frame)
        elif c == "}":
            if len(frames) == 1:
                faults.append(Fault(at[i], at[i] + 1, "unmatched"))
                i += 1
                continue
            if frame[5]:
                faults.append(Fault(frame[6][-1] if frame[6] else at[i], at[i], "unclosed"))
            end_unit(frame, at[i])
            group = frames.pop()
            kinds = all_kinds if group[1] is None else group[1]
            token = every if group[2] else "group:" + "+".join(sorted(g for g, k in lang.groups if k in kinds))
            if token not in lang.grammar._sets:
                lang.grammar.means(token, token[6:].split("+"))
            frame = up = frames[-1]
            up[3].append(token)
            up[4].append(group[0])
            follows = codes[i + 1] if i + 1 < n else ""
            if lang.ends_after_group and up[5] == 0 and follows not in lang.continues:
                tokens = up[3]
                value = "=" in tokens or tokens[0] in ("return", "throw", "yield", "assert", "new") or "new" in tokens or "->" in tokens and tokens[0] != "case" and tokens[0] != "default"
                if follows == ";" and value:
                    pass
                elif follows == "while" and "do" in tokens:
                    pass
                else:
                    end_unit(up, at[i] + 1)
        elif c == ";":
            if frame[5] or (frame[3] and _head_open(frame[3], lang)):
                frame[3].append(c)
                frame[4].append(at[i])
            else:
                if lang.ends_after_group:
                    frame[3].append(c)
                    frame[4].append(at[i])
                    if not (i + 1 < n and codes[i + 1] == "else" or "do" in frame[3] and i + 1 < n and codes[i + 1] == "while"):
                        end_unit(frame, at[i] + 1)
                else:
                    end_unit(frame, at[i], True)
        else:
            if c == "(" or c == "[":
                frame[5] += 1
                frame[6].append(at[i])
            elif (c == ")" or c == "]") and frame[5]:
                frame[5] -= 1
                frame[6].pop()
            frame[3].append(c)
            frame[4].append(at[i])
        add, add_at = frame[3].append, frame[4].append
        i += 1
    while len(frames) > 1:
        out.open_at_end = True
        frame = frames[-1]
        if not faults or faults[-1].symbol != "unclosed":
            faults.append(Fault(frame[0], len(text), "unclosed"))
        end_unit(frame, len(text))
        frames.pop()
    if frames[0][5]:
        out.open_at_end = True
    end_unit(frames[0], len(text))
    if not lang.files.kinds(tuple(file_units)):
        faults.append(Fault(0, len(text), lang.file, tuple(file_units)))


def _nearest(lang: Language, tokens: tuple[str, ...], symbols: list[str]) -> str:
    """Of the symbols the one that the most of the tokens can begin; the first where equal."""
    return max(symbols, key=lambda s: lang.grammar.derives(tokens, s)[1])


def _head_open(tokens: list[str], lang: Language) -> bool:
    """Whether the unit begins with a head, such as a loop's, whose group is still to come."""
    if not lang.heads:
        return False
    for k in range(len(tokens) - 1, -1, -1):
        t = tokens[k]
        if t in lang.heads:
            return True
        if t.startswith("group:"):
            return False
    return False
