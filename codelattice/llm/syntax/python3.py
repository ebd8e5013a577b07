"""Python 3: logical lines by the chart parser, then the blocks they form."""

from __future__ import annotations

import re
import unicodedata

from codelattice.llm.syntax.chart import Grammar
from codelattice.llm.syntax.tree import Fault, Memo, Outline

# The language's keywords and operators.
KEYWORDS = frozenset("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
SOFT = frozenset(("match", "case", "type"))
_CODES = {k: k for k in KEYWORDS} | {k: k for k in SOFT} | {"None": "CONST", "True": "CONST", "False": "CONST"}
_CODES |= {o: "BIN" for o in ("//", "%", "<<", ">>", "&", "^")} | {"/": "SLASH", "|": "BAR"} | {o: "CMP" for o in ("<", ">", "==", ">=", "<=", "!=")} | {"+": "SIGN", "-": "SIGN", "~": "UN", "*": "STAR", "**": "DSTAR", "@": "AT", "...": "NUM", ":=": "WALRUS", "->": "ARROW"}
_CODES |= {o + "=": "AUG" for o in ("+", "-", "*", "/", "//", "%", "@", "&", "|", "^", ">>", "<<", "**")} | {o: o for o in "=.,:;()[]{}"}

_LEX = re.compile(
    r"""(?:(?P<nl>\n)|(?P<cm>\#[^\n]*)|(?P<join>\\\r?\n)"""
    r"""|(?P<fstr>(?:[fF][rR]?|[rR][fF])(?:\"\"\"|'''|"|'))"""
    r"""|(?P<str>(?:[rR][bB]?|[bB][rR]?|[uU])?(?:\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|(?!\"\"\"|''')(?:"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')))"""
    r"""|(?P<open>(?:[rR][bB]?|[bB][rR]?|[uU])?(?:\"\"\"|'''|"|'))"""
    r"""|(?P<name>[^\W\d]\w*)"""
    r"""|(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?P<glued>\w*))"""
    r"""|(?P<op>\.\.\.|\*\*=|//=|>>=|<<=|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%&|^@]=|[-+*/%&|^~<>@=.,:;()\[\]{}])|(?P<bad>\S))[ \t\f\r]*"""
)

LINES = Grammar(
    """
    simples = simple (';' simple)* ';'?
    simple = 'pass' | 'break' | 'continue' | 'return' values? | 'raise' (expr ('from' expr)?)? | 'global' names | 'nonlocal' names
      | 'del' gone | 'assert' expr (',' expr)? | 'import' module (',' module)* | 'from' dots 'import' imported | 'from' dots dotted 'import' imported | 'from' dotted 'import' imported
      | 'type' name typarams? '=' expr | values | yielded | (targets '=')+ right | noted ':' expr ('=' right)? | single AUG right
    names = name (',' name)*
    name = NAME
    dots = ('.' | ELLIPSIS)+
    dotted = name ('.' name)*
    module = dotted ('as' name)?
    imported = STAR | alias (',' alias)* | '(' alias (',' alias)* ','? ')'
    alias = name ('as' name)?
    right = values | yielded
    fexpr = right
    yielded = 'yield' values? | 'yield' 'from' expr
    targets = target (',' target)* ','?
    target = plain | STAR plain
    plain = name | field | '(' targets? ')' | '[' targets? ']'
    field = prim '.' name | prim '[' subs ']'
    single = name | field | '(' single ')'
    noted = name | field | '(' single ')'
    gone = away (',' away)* ','?
    away = name | field | '(' gone? ')' | '[' gone? ']'
    values = value (',' value)* ','?
    value = STAR arith | expr
    stars = star (',' star)* ','?
    star = STAR arith | named
    named = expr | name WALRUS expr
    expr = ops | ops 'if' ops 'else' expr | 'lambda' params? ':' expr
    ops = test (('and' | 'or') test)*
    test = 'not'* arith (compare arith)*
    compare = CMP | 'in' | 'not' 'in' | 'is' | 'is' 'not'
    arith = unary (binary unary)*
    unary = (SIGN | UN)* 'await'? prim
    binary = BIN | SLASH | BAR | STAR | SIGN | DSTAR | AT
    prim = atom | prim '(' args? ')' | prim '(' named loops ')' | prim '[' subs ']' | prim '.' name
    atom = name | NUM | CONST | STR+ | BYTES+ | '(' ')' | '(' named ')' | '(' star ',' stars? ')' | '(' yielded ')' | '(' named loops ')' | '[' stars? ']' | '[' named loops ']' | '{' '}' | '{' stars '}' | '{' named loops '}' | '{' pair (',' pair)* ','? '}' | '{' expr ':' expr loops '}'
    pair = expr ':' expr | DSTAR arith
    loops = loop+
    loop = 'async'? 'for' targets 'in' ops ('if' ops)*
    args = arg (',' arg)* (',' keyed)? ','? | keyed ','?
    arg = named | STAR expr
    keyed = keyone (',' keyone)* (',' keytwo)* | keytwo (',' keytwo)*
    keyone = name '=' expr | STAR expr
    keytwo = name '=' expr | DSTAR expr
    subs = sub (',' sub)* ','?
    sub = named | expr? ':' expr? (':' expr?)? | STAR expr
    params = before (',' behind)? ','? | behind ','?
    before = bare (',' bare)* (',' SLASH (',' bare)* (',' preset)* | (',' preset)+ (',' SLASH (',' preset)*)?)? | preset (',' preset)* (',' SLASH (',' preset)*)?
    bare = name
    preset = name '=' expr
    behind = STAR name (',' (bare | preset))* (',' DSTAR name)? | STAR (',' (bare | preset))+ (',' DSTAR name)? | DSTAR name
    tparams = tbefore (',' tbehind)? ','? | tbehind ','?
    tbefore = tbare (',' tbare)* (',' SLASH (',' tbare)* (',' tpreset)* | (',' tpreset)+ (',' SLASH (',' tpreset)*)?)? | tpreset (',' tpreset)* (',' SLASH (',' tpreset)*)?
    tbare = name (':' expr)?
    tpreset = name (':' expr)? '=' expr
    tbehind = STAR name (':' (STAR arith | expr))? (',' (tbare | tpreset))* (',' DSTAR tbare)? | STAR (',' (tbare | tpreset))+ (',' DSTAR tbare)? | DSTAR tbare
    typarams = '[' typaram (',' typaram)* ','? ']'
    typaram = name (':' expr)? ('=' expr)? | STAR name ('=' (STAR arith | expr))? | DSTAR name ('=' expr)?
    h_if = 'if' named ':'
    h_elif = 'elif' named ':'
    h_else = 'else' ':'
    h_while = 'while' named ':'
    h_for = 'async'? 'for' targets 'in' values ':'
    h_try = 'try' ':'
    h_except = 'except' (STAR? expr ('as' name)?)? ':'
    h_finally = 'finally' ':'
    h_with = 'async'? 'with' (item (',' item)* | '(' item (',' item)* ','? ')') ':'
    item = expr ('as' target)?
    h_def = 'async'? 'def' name typarams? '(' tparams? ')' (ARROW expr)? ':'
    h_class = 'class' name typarams? ('(' args? ')')? ':'
    h_match = 'match' stars ':'
    h_case = 'case' patterns ('if' named)? ':'
    patterns = pattern (',' pattern)* ','?
    pattern = STAR name | choice ('as' name)?
    choice = closed (BAR closed)*
    closed = SIGN? NUM (SIGN NUM)? | STR+ | BYTES+ | CONST | dotted | dotted '(' (caseargs ','?)? ')' | '(' patterns? ')' | '[' patterns? ']' | '{' (casepair (',' casepair)* (',' DSTAR name)? ','? | DSTAR name ','?)? '}'
    caseargs = casearg (',' casearg)* (',' casekey)* | casekey (',' casekey)*
    casearg = choice ('as' name)?
    casekey = name '=' choice ('as' name)?
    casepair = closed ':' pattern
    h_deco = AT named
    """,
    {"match": ("NAME", "match"), "case": ("NAME", "case"), "type": ("NAME", "type")},
)
_HEADS = ("if", "elif", "else", "while", "for", "try", "except", "finally", "with", "def", "class", "match", "case", "deco")
_FIRST = {h: h for h in _HEADS} | {"AT": "deco"}

BLOCKS = Grammar(
    """
    suite = stmt+
    file = stmt*
    cases = (CASE BODY | CASEI)+
    stmt = S | ifs | fors | whiles | tries | WITH BODY | WITHI | DECO* (DEF BODY | DEFI | CLASS BODY | CLASSI) | MATCH CASES
    ifs = (IF BODY | IFI) (ELIF BODY | ELIFI)* other?
    other = ELSE BODY | ELSEI
    fors = (FOR BODY | FORI) other?
    whiles = (WHILE BODY | WHILEI) other?
    tries = (TRY BODY | TRYI) (((EXCEPT BODY | EXCEPTI)+ | (GROUP BODY | GROUPI)+) other? last? | last)
    last = FINALLY BODY | FINALLYI
    """,
    {"both": ("BODY", "CASES"), "body": ("BODY",), "cases": ("CASES",), "any": ("BODY", "CASES")},
)


_FORMATTED = re.compile(r"[rR]?[fFtT][rR]?[\"']")  # such strings are expressions, no documentation


class _Lines:
    """The kind of a logical line, by the sequence of its tokens."""

    def __init__(self) -> None:
        self._known: dict[tuple[str, ...], str] = {}

    def kind(self, tokens: tuple[str, ...]) -> str:
        got = self._known.get(tokens)
        if got is None:
            if len(self._known) > 200_000:
                self._known.clear()
            got = self._known[tokens] = self._find(tokens)
        return got

    @staticmethod
    def _find(tokens: tuple[str, ...]) -> str:
        if "ERR" in tokens:
            return ""
        first = tokens[1] if tokens[0] == "async" and len(tokens) > 1 else tokens[0]
        head = _FIRST.get(first)
        if head == "deco":
            return "DECO" if LINES.derives(tokens, "h_deco")[0] else ""
        if head:
            depth = 0
            symbol = "h_" + head
            name = "GROUP" if head == "except" and tokens[1:2] == ("STAR",) else head.upper()
            for at, t in enumerate(tokens):  # the body begins behind a colon outside of brackets; several may stand there
                if t in "([{":
                    depth += 1
                elif t in ")]}":
                    depth -= 1
                elif t == ":" and depth == 0 and LINES.derives(tokens[: at + 1], symbol)[0]:
                    if at == len(tokens) - 1:
                        return name
                    if head not in ("match",) and LINES.derives(tokens[at + 1 :], "simples")[0]:
                        return name + "I"
            if first not in SOFT:
                return ""
        return "S" if LINES.derives(tokens, "simples")[0] else ""


_lines, _blocks = _Lines(), Memo(BLOCKS, ("suite", "cases"))
_files = Memo(BLOCKS, ("file",))
_fields = Memo(LINES, ("fexpr",))

_ESCAPES = re.compile(r"(?:[^\\]|\\[^xuUN]|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|\\N\{[^{}\n]+\}|\\\Z)*", re.S)
_NAMED = re.compile(r"(?<!\\)(?:\\\\)*\\N\{([^{}\n]+)\}")
_BYTE_ESCAPES = re.compile(r"(?:[^\\]|\\[^x]|\\x[0-9a-fA-F]{2})*", re.S)
_BEHIND_NUMBER = frozenset(("and", "else", "for", "if", "in", "is", "not", "or"))


def _escapes(text: str) -> bool:
    """Whether every escape of a literal's text is one."""
    if "\\" not in text:
        return True
    if not _ESCAPES.fullmatch(text):
        return False
    try:
        return all(unicodedata.lookup(n) for n in _NAMED.findall(text))
    except KeyError:
        return False


def _string_code(literal: str) -> str:
    """``STR``, ``BYTES``, or ``ERR`` for a literal whose escapes or bytes are none."""
    head = literal[: literal.index(literal[-1])].lower()
    if "b" in head:
        return "BYTES" if literal.isascii() and ("r" in head or "\\x" not in literal or _BYTE_ESCAPES.fullmatch(literal)) else "ERR"
    return "STR" if "r" in head or _escapes(literal) else "ERR"


def _plain_of(quote: str, raw: bool, spec: bool) -> re.Pattern[str]:
    """The text of a formatted string up to the next field, end or fault."""
    c = quote[0]
    one = rf"[^{{}}\\\n{c}]" if len(quote) == 1 else rf"[^{{}}\\{c}]|{c}(?!{c}{c})"
    named = "" if raw else r"N\{[^{}\n]+\}|"
    return re.compile(rf"(?:{one}{'' if spec else '|[{][{]|[}][}]'}|\\(?:{named}[^{{}}]|(?=[{{}}])))*")


_PLAIN = {(q, r, x): _plain_of(q, r, x) for q in ("'", '"', "'''", '"""') for r in (False, True) for x in (False, True)}
_BLANK, _DEBUG, _CONVERSION = re.compile(r"[ \t\f\r]*"), re.compile(r"=\s*(?=[!:}])(?!=)"), re.compile(r"![rsa]\s*(?=[:}])")


def _formatted(text: str, at: int, opening: str) -> tuple[int, bool]:
    """The end of the formatted string that opens at ``at``, -1 if it has none, and whether all of it is valid."""
    quote = opening.lstrip("fFrR")
    raw = len(opening) - len(quote) > 1
    pos, good = at + len(opening), True
    while True:
        m = _PLAIN[quote, raw, False].match(text, pos)
        good = good and (raw or _escapes(m.group()))
        pos = m.end()
        if text.startswith(quote, pos):
            return pos + len(quote), good
        if text[pos : pos + 1] == "}":
            pos, good = pos + 1, False
        elif text[pos : pos + 1] == "{":
            pos, valid = _field(text, pos + 1, quote, raw)
            if pos < 0:
                return -1, False
            good = good and valid
        else:
            return -1, False


def _field(text: str, pos: int, quote: str, raw: bool) -> tuple[int, bool]:
    """The end of a replacement field behind its brace, and whether it is an expression with a conversion and a format."""
    codes: list[str] = []
    depth, good = 0, True
    while True:
        pos = _BLANK.match(text, pos).end()
        if depth == 0:
            c = text[pos : pos + 1]
            if c == "=" and (m := _DEBUG.match(text, pos)):
                pos = m.end()
                c = text[pos : pos + 1]
            if c == "!" and (m := _CONVERSION.match(text, pos)):
                pos = m.end()
                c = text[pos : pos + 1]
            if c == ":":
                pos += 1
                while True:
                    pos = _PLAIN[quote, raw, True].match(text, pos).end()
                    if text[pos : pos + 1] != "{":
                        break
                    pos, valid = _field(text, pos + 1, quote, raw)
                    if pos < 0:
                        return -1, False
                    good = good and valid
                c = text[pos : pos + 1]
                if c != "}":
                    return -1, False
            if c == "}":
                return pos + 1, good and bool(codes) and bool(_fields.kinds(tuple(codes)))
        m = _LEX.match(text, pos)
        if m is None:
            return -1, False
        g = m.lastgroup
        pos = m.end(g)
        if g == "op":
            o = m["op"]
            depth += (o in "([{") - (o in ")]}")
            codes.append(_CODES[o])
        elif g == "name":
            codes.append(_CODES.get(m["name"], "NAME"))
        elif g == "fstr":
            pos, valid = _formatted(text, m.start(), m["fstr"])
            if pos < 0:
                return -1, False
            good = good and valid
            codes.append("STR")
        elif g == "str":
            codes.append(_string_code(m["str"]))
        elif g in ("num", "glued"):
            codes += _number_codes(m["num"], m["glued"])
        elif g == "open":
            return -1, False
        elif g == "bad":
            codes.append("ERR")


def _number_codes(num: str, glued: str) -> list[str]:
    if glued and glued not in _BEHIND_NUMBER or re.match(r"0[0-9_]*[1-9][\d_]*$", num):
        return ["ERR"]
    return ["NUM", glued] if glued else ["NUM"]


def outline(text: str) -> Outline:
    """One pass: logical lines, their kinds, and the blocks they form by indentation."""
    out = Outline()
    if text[:1] == "﻿":
        text = " " + text[1:] if text[1:2] in " \t" else text[1:]
    codes: list[str] = []
    at: list[int] = []
    depth = 0
    line_start = 0
    broken = False
    # Open blocks: (column, kinds of the statements in it, offset, the function whose body it is, column if a tab counts one)
    stack: list[tuple[int, list[str], int, int, int]] = [(0, [], 0, -1, 0)]
    lookup, find_kind, faults = _CODES.get, _lines.kind, out.faults
    pending: list[int] = []  # functions whose docstring may be the next line
    last_kind, last_end, deco_at = "", 0, -1

    def close(upto: int, end: int) -> bool:
        """Ends the blocks that are deeper than the column; whether that column is the one of an open block."""
        while len(stack) > 1 and stack[-1][0] > upto:
            _, kinds, begin, function, _ = stack.pop()
            if function >= 0:
                out.ends[function] = last_end
            got = _blocks.kinds(tuple(kinds)) if "?" not in kinds else frozenset()
            out.units += 1
            if not got:
                if "?" not in kinds:  # a line that failed can be anything in its block
                    faults.append(Fault(begin, end, "suite", tuple(kinds)))
                stack[-1][1].append("any")
            else:
                stack[-1][1].append("both" if len(got) == 2 else "body" if "suite" in got else "cases")
        return stack[-1][0] == upto

    def end_line(end: int) -> None:
        nonlocal last_kind, last_end, deco_at, pending
        if not codes:
            return
        start = at[0]
        column = chars = 0
        for c in text[line_start_of_first:start]:
            column, chars = (0, 0) if c == "\f" else ((column // 8 + 1) * 8 if c == "\t" else column + 1, chars + 1)
        tokens = tuple(codes)
        kind = find_kind(tokens)
        out.units += 1
        top = stack[-1]
        if column > top[0]:
            opens = last_kind and last_kind[-1] != "I" and last_kind not in ("S", "DECO", "?")
            if not opens and last_kind != "?":
                faults.append(Fault(start, end, "indent"))
                top[1].append("S") if top[1][-1:] != ["S"] else None
            elif chars <= top[4]:
                faults.append(Fault(start, end, "tabs"))
            stack.append((column, [], start, len(out.functions) - 1 if last_kind == "DEF" else -1, chars))
        else:
            if column < top[0] and not close(column, start):
                faults.append(Fault(start, end, "dedent"))
                stack[-1] = (column, *stack[-1][1:4], chars) if len(stack) > 1 else stack[-1]
            elif chars != stack[-1][4]:
                faults.append(Fault(start, end, "tabs"))
        if not kind:
            faults.append(Fault(start, end, _nearest(tokens), tokens, tuple(at)))
            kind = "?"
        kinds = stack[-1][1]
        if kind == "S":
            if kinds[-1:] != ["S"]:
                kinds.append("S")
            if pending:
                if all(t == "STR" for t in tokens) and not any(_FORMATTED.match(text, a) for a in at):
                    out.functions[pending[0]] = (*out.functions[pending[0]][:3], text[start:end])
                pending = []
        else:
            pending = []
            kinds.append(kind)
            if kind in ("DEF", "DEFI"):
                i = codes.index("def")
                name = text[at[i + 1] : at[i + 2]].strip() if i + 2 < len(at) else ""
                out.functions.append((at[i], name, deco_at if deco_at >= 0 else start, None))
                if kind == "DEF":
                    pending = [len(out.functions) - 1]
                else:
                    out.ends[len(out.functions) - 1] = end
                    body = _inline_doc(text, codes, at)
                    if body:
                        out.functions[-1] = (*out.functions[-1][:3], body)
        if kind == "DECO":
            deco_at = start if deco_at < 0 else deco_at
        else:
            deco_at = -1
        last_kind, last_end = kind, end
        codes.clear()
        at.clear()

    line_start_of_first = 0
    end = 0
    add, add_at, symbols = codes.append, at.append, _CODES
    pos = 0
    while pos >= 0:
        begin, pos = pos, -1
        for m in _LEX.finditer(text, begin):
            g = m.lastgroup
            if g == "name":
                if not codes:
                    line_start_of_first = line_start
                add(lookup(m["name"], "NAME"))
                add_at(m.start())
            elif g == "op":
                if not codes:
                    line_start_of_first = line_start
                o = m["op"]
                if o in "([{":
                    depth += 1
                elif o in ")]}":
                    depth = max(0, depth - 1)
                add("ELLIPSIS" if o == "..." and codes and codes[0] == "from" and "import" not in codes else symbols[o])
                add_at(m.start())
            elif g == "nl":
                if depth == 0:
                    end_line(m.start())
                line_start = m.start() + 1
            elif g == "join":
                continue
            elif g == "cm":
                out.comments.append(m.span("cm"))
            else:
                if not codes:
                    line_start_of_first = line_start
                add_at(m.start())
                if g == "str":
                    add(_string_code(m["str"]))
                    if "\n" in m["str"]:
                        line_start = text.rfind("\n", 0, m.end("str")) + 1
                elif g == "fstr":  # its end depends on its fields, so the lexer starts again behind it
                    pos, good = _formatted(text, m.start(), m["fstr"])
                    add("STR" if good else "ERR")
                    if pos < 0:
                        broken = True
                        stop = text.find("\n", m.end()) if len(m["fstr"].lstrip("fFrR")) == 1 else -1
                        pos = stop if stop >= 0 else len(text)
                        end = len(text)
                    else:
                        end = pos
                    line_start = max(line_start, text.rfind("\n", m.start(), pos) + 1)
                    break
                elif g == "glued" or g == "num":
                    for c in _number_codes(m["num"], m["glued"]):
                        if c in KEYWORDS:
                            add_at(m.start("glued"))
                        add(c)
                else:
                    add("ERR")
                    if g == "open":
                        broken = True
                        end = len(text)
                        if len(m["open"].lstrip("rRbBuU")) == 3:
                            break
            end = m.end(g)
    out.open_at_end = depth > 0 or (broken and end == len(text))
    if codes:
        end_line(len(text))
    opened = last_kind and last_kind[-1] != "I" and last_kind not in ("S", "DECO", "?")
    close(0, len(text))
    kinds = stack[0][1]
    if "?" not in kinds and not _files.kinds(tuple(kinds)):
        faults.append(Fault(0, len(text), "file", tuple(kinds)))
        out.open_at_end = out.open_at_end or bool(opened)
    return out


def _nearest(tokens: tuple[str, ...]) -> str:
    """Of a statement and a head, what the most of the tokens can begin."""
    head = _FIRST.get(tokens[1] if tokens[0] == "async" and len(tokens) > 1 else tokens[0])
    return max(["simples", "h_" + head] if head else ["simples"], key=lambda s: LINES.derives(tokens, s)[1])


def _inline_doc(text: str, codes: list[str], at: list[int]) -> str | None:
    """The docstring of ``def f(): "doc"``."""
    if codes[-1] == "STR" and len(codes) > 1 and codes[-2] == ":":
        return text[at[-1] :].split("\n", 1)[0]
    return None


def grammar_of(fault: Fault) -> Grammar:
    return BLOCKS if fault.symbol in ("suite", "file", "cases") else LINES
