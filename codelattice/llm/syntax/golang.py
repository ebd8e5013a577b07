"""Go: tokens with the semicolons the language inserts, units by the chart parser."""

from __future__ import annotations

import re

from codelattice.llm.syntax.braces import Language, parse
from codelattice.llm.syntax.chart import Grammar
from codelattice.llm.syntax.tree import Memo, Outline

# The language's keywords, operators and the tokens behind which a line end counts as a semicolon.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_CODES = {k: k for k in KEYWORDS}
_CODES |= {o: "BIN" for o in ("/", "%", "<<", ">>", "&^", "|", "&&", "||", "==", "!=", "<", "<=", ">", ">=")} | {"+": "SIGN", "-": "SIGN", "^": "SIGN", "&": "AND", "!": "NOT", "~": "TILDE", "*": "STAR", "<-": "ARROW", "++": "INC", "--": "INC", ":=": "DEFINE", "...": "DOTS"}
_CODES |= {o + "=": "AUG" for o in ("+", "-", "*", "/", "%", "&", "|", "^", "<<", ">>", "&^")} | {o: o for o in "=.,:;()[]{}"}
_ENDERS = frozenset(("NAME", "LIT", "STR", "break", "continue", "fallthrough", "return", "INC", ")", "]", "}"))

_LEX = re.compile(
    r"""(?:(?P<nl>\n)|(?P<line>//[^\n]*)|(?P<block>/\*[\s\S]*?\*/)|(?P<raw>`[^`]*`)|(?P<open>/\*[\s\S]*|`[\s\S]*)|(?P<str>"(?:[^"\\\n]|\\[^\n])*")|(?P<rune>'(?:[^'\\\n]|\\[^\n]{1,9}?)')"""
    r"""|(?P<name>[^\W\d]\w*)|(?P<num>(?:0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?)i?(?P<glued>\w*))"""
    r"""|(?P<op>\.\.\.|<<=|>>=|&\^=|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|<<|>>|&\^|[-+*/%&|^!<>=~.,:;()\[\]{}])|(?P<bad>\S))[ \t\r\f]*"""
)

_ESCAPE = r"\\[abfnrtv\\]|\\[0-3][0-7]{2}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4}"
_TEXT = re.compile(rf'"(?:[^"\\\n]|{_ESCAPE}|\\")*"')
_RUNE = re.compile(rf"'(?:[^'\\\n]|{_ESCAPE}|\\')'")
#: Octal numbers with other digits, and underscores that part no digits.
_WRONG_NUMBER = re.compile(r"0[\d_]*[89][\d_]*|[\d_.]*(?:__|_\.|\._)[\d_.]*|\w*_|0[xXbBoO]")

GRAMMAR = Grammar(
    """
    package = 'package' NAME
    import = 'import' (spec | '(' (spec (';' spec)*)? ';'? ')')
    spec = (NAME | '.')? STR
    decl = vars | types | 'func' receiver? NAME tparams? signature BLOCK?
    receiver = '(' NAME? type ')' | '(' NAME type ',' ')'
    vars = ('var' | 'const') (varspec | '(' (varspec (';' varspec)*)? ';'? ')')
    varspec = names type? ('=' exprs)? 
    names = NAME (',' NAME)*
    types = 'type' (typespec | '(' (typespec (';' typespec)*)? ';'? ')')
    typespec = NAME tparams? '='? type
    tparams = '[' tparam (',' tparam)* ','? ']'
    tparam = names union
    union = TILDE? type (BIN TILDE? type)*
    signature = params result?
    result = type | params
    params = '(' (param (',' param)* ','?)? ')'
    param = NAME? DOTS? type | NAME
    type = qname | STAR type | '[' ']' type | '[' expr ']' type | '[' DOTS ']' type | 'map' '[' type ']' type | 'chan' ARROW? type | ARROW 'chan' type | 'func' signature | 'struct' FIELDS | 'interface' METHODS | '(' type ')'
    qname = NAME ('.' NAME)? ('[' type (',' type)* ','? ']')?
    field = names type STR? | STAR? qname STR?
    method = NAME params result? | union
    exprs = expr (',' expr)*
    expr = prefix* prim (binary prefix* prim)*
    prefix = SIGN | AND | NOT | STAR | ARROW
    binary = BIN | SIGN | AND | STAR
    prim = operand | prim '.' NAME | prim '.' '(' (type | 'type') ')' | prim '[' expr (',' type)* ','? ']' | prim '[' expr? ':' expr? (':' expr)? ']' | prim '(' args? ')' | prim '[' type (',' type)* ','? ']'
    operand = LIT | STR | NAME | '(' expr ')' | '(' type ')' | 'func' signature BLOCK | literal | conversion
    conversion = ('[' ']' type | '[' expr ']' type | 'map' '[' type ']' type | 'chan' type | 'interface' METHODS | 'struct' FIELDS | 'func' signature) '(' args? ')'
    literal = (qname | 'struct' FIELDS | '[' ']' type | '[' (expr | DOTS) ']' type | 'map' '[' type ']' type) ELEMENTS
    called = prim '(' args? ')'
    args = arg (',' arg)* DOTS? ','?
    arg = expr | type
    elements = element (',' element)* ','?
    element = (item ':')? item
    item = expr | ELEMENTS
    stmt = simple | flow | block | vars | types | NAME ':' stmt?
    clause = label+ stmt? | stmt
    label = 'case' caselist ':' | 'default' ':'
    caselist = simple | cases
    cases = (expr | type) (',' (expr | type))*
    simple = expr | exprs '=' exprs | names DEFINE exprs | expr AUG expr | expr INC | expr ARROW expr
    flow = 'return' exprs? | ('break' | 'continue' | 'goto') NAME? | 'fallthrough' | ('go' | 'defer') called
    block = BLOCK | ifs | 'for' loop? BLOCK | 'switch' (simple? ';')? switched? (SWITCH | BLOCK) | 'select' (SWITCH | BLOCK)
    switched = simple
    ifs = 'if' (simple? ';')? expr BLOCK ('else' (ifs | BLOCK))?
    loop = expr | simple? ';' expr? ';' simple? | (exprs '=' | names DEFINE)? 'range' expr
    """,
)
_MEMO = Memo(GRAMMAR, ("package", "import", "decl", "stmt", "clause", "field", "method", "elements"))
_GROUPS = (("BLOCK", "stmt"), ("SWITCH", "clause"), ("FIELDS", "field"), ("METHODS", "method"), ("ELEMENTS", "elements"))
_FILES = Grammar("file = P I* D*")
LANGUAGE = Language(
    GRAMMAR, _MEMO, _GROUPS, "stmt", frozenset(), frozenset(("if", "for", "switch", "select")), False,
    "file", (("P", "package"), ("I", "import"), ("D", "decl")), Memo(_FILES, ("file",)),
)


def outline(text: str) -> Outline:
    """One pass: tokens with inserted semicolons, functions with the comment directly above, units."""
    out = Outline()
    codes: list[str] = []
    at: list[int] = []
    last = ""
    lookup, comments, add, add_at, symbols = _CODES.get, out.comments, codes.append, at.append, _CODES
    for m in _LEX.finditer(text):
        g = m.lastgroup
        if g == "name":
            last = lookup(m["name"], "NAME")
        elif g == "op":
            last = symbols[m["op"]]
        elif g == "nl":
            if last in _ENDERS:
                add(";")
                add_at(m.start())
                last = ""
            continue
        elif g == "line" or g == "block":
            comments.append(m.span(g))
            if g == "block" and last in _ENDERS and "\n" in m["block"]:
                codes.append(";")
                at.append(m.start())
                last = ""
            continue
        elif g == "str":
            last = "STR" if "\\" not in m["str"] or _TEXT.fullmatch(m["str"]) else "ERR"
        elif g == "raw":
            last = "STR"
        elif g == "rune":
            last = "LIT" if _RUNE.fullmatch(m["rune"]) else "ERR"
        elif g == "num" or g == "glued":
            last = "ERR" if m.group("glued") or _WRONG_NUMBER.fullmatch(m["num"]) else "LIT"
        else:
            last = "ERR"
        add(last)
        add_at(m.start())
    if last in _ENDERS:
        codes.append(";")
        at.append(len(text))
    depth = 0
    for i, c in enumerate(codes):
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0 and out.functions:
                out.ends.setdefault(len(out.functions) - 1, at[i] + 1)
        elif c == "func" and depth == 0 and (i == 0 or codes[i - 1] == ";"):
            k = i + 1
            if k < len(codes) and codes[k] == "(":
                level = 0
                while k < len(codes):
                    level += (codes[k] == "(") - (codes[k] == ")")
                    k += 1
                    if level == 0:
                        break
            if k < len(codes) and codes[k] == "NAME":
                out.functions.append((at[i], re.match(r"\w+", text[at[k] :]).group(), at[i], None))
    parse(text, codes, at, LANGUAGE, out)
    return out

