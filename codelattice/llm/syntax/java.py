"""Java: tokens, units by the chart parser."""

from __future__ import annotations

import re

from codelattice.llm.syntax.braces import Language, parse
from codelattice.llm.syntax.chart import Grammar
from codelattice.llm.syntax.tree import Memo, Outline

# The language's keywords (those that are names elsewhere are listed apart) and operators.
KEYWORDS = frozenset("assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface new package return static super switch synchronized this throw throws try void while goto const".split())
MODIFIERS = frozenset("public protected private abstract native strictfp transient volatile".split())
PRIMITIVES = frozenset("boolean byte char short int long float double".split())
SOFT = frozenset("record yield sealed permits when module".split())
_CODES = {k: k for k in KEYWORDS} | {k: "MOD" for k in MODIFIERS} | {k: "PRIM" for k in PRIMITIVES} | {k: k for k in SOFT} | {"true": "LIT", "false": "LIT", "null": "LIT"}
_CODES |= {o: "BIN" for o in ("/", "%", "^", "||", "==", "!=", "<=", ">=", "<<")} | {"|": "BAR", "+": "SIGN", "-": "SIGN", "!": "NOT", "~": "NOT", "++": "INC", "--": "INC", "&&": "BIN", "&": "AND", "*": "STAR", "...": "DOTS"}
_CODES |= {o + "=": "AUG" for o in ("+", "-", "*", "/", "%", "&", "|", "^", "<<", ">>", ">>>")} | {o: o for o in ("=", ".", ",", ":", ";", "(", ")", "[", "]", "{", "}", "<", ">", "?", "@", "->", "::")}

_LEX = re.compile(
    r"""(?:(?P<line>//[^\n]*)|(?P<block>/\*[\s\S]*?\*/)|(?P<text>\"\"\"[ \t\r\f]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\")|(?P<open>/\*[\s\S]*|\"\"\"[\s\S]*)|(?P<str>"(?:[^"\\\n]|\\[^\n])*")|(?P<char>'(?:[^'\\\n]|\\[^\n]{1,6}?)')"""
    r"""|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<num>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*(?:\.(?!\.|[A-Za-z_])[\d_]*)?(?:[eE][+-]?\d+)?)[lLfFdD]?(?P<glued>[\w$]*))"""
    r"""|(?P<op>\.\.\.|>>>=|<<=|>>=|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|<<|[-+*/%&|^!<>=~.,:;?@()\[\]{}])|(?P<bad>\S))\s*"""
)

_ESCAPE = r"\\[btnfrs\"'\\]|\\[0-3]?[0-7]{1,2}|\\u+[0-9a-fA-F]{4}"
_STRING = re.compile(rf'"(?:[^"\\\n]|{_ESCAPE})*"')
_BLOCK = re.compile(rf'"""[\s\S]*?\n(?:[^\\]|{_ESCAPE}|\\\r?\n)*')
_CHAR = re.compile(rf"'(?:[^'\\\n]|{_ESCAPE})'")
#: Octal numbers with other digits, whole numbers beyond their type, and underscores that part no digits.
_WRONG_NUMBER = re.compile(r"0[\d_]*[89][\d_]*[lL]?|[\d_.]*(?:_\.|\._)[\d_.]*|\w*_[lLfFdD]?|0[xX][lL]?")
_ONE_WORD = MODIFIERS | {"static", "final", "default", "synchronized", "sealed"}

GRAMMAR = Grammar(
    """
    package = annotation* 'package' qname ';'
    import = 'import' 'static'? qname ('.' STAR)? ';' | ';'
    typedecl = mod* kind | ';'
    kind = 'class' NAME tparams? ('extends' type)? impls? permit? CLASS | 'interface' NAME tparams? ('extends' types)? permit? CLASS | 'enum' NAME impls? (ENUM | CLASS)
      | 'record' NAME tparams? '(' params? ')' impls? CLASS | '@' 'interface' NAME CLASS
    impls = 'implements' types
    permit = 'permits' types
    types = type (',' type)*
    mod = MOD | 'static' | 'final' | 'default' | 'synchronized' | 'sealed' | NAME SIGN 'sealed' | annotation
    annotation = '@' qname ('(' (avalue | NAME '=' avalue (',' NAME '=' avalue)*)? ')')?
    avalue = expr | ARRAY | annotation
    qname = NAME ('.' NAME)*
    tparams = '<' tparam (',' tparam)* '>'
    tparam = annotation* NAME ('extends' type (AND type)*)?
    type = annotation* (PRIM | ctype) dims
    ctype = NAME targs? ('.' annotation* NAME targs?)*
    dims = (annotation* '[' ']')*
    targs = '<' (targ (',' targ)*)? '>'
    targ = type | annotation* '?' (('extends' | 'super') type)?
    member = mod* (kind | method | fielddecl) | 'static'? BLOCK | ';'
    method = tparams? (type | 'void') NAME '(' params? ')' dims ('throws' types)? (BLOCK | 'default' avalue ';' | ';') | tparams? NAME ('(' params? ')')? ('throws' types)? BLOCK
    fielddecl = type vars ';'
    vars = var (',' var)*
    var = NAME dims ('=' (expr | ARRAY))?
    params = param (',' param)*
    param = pmod* type (DOTS? NAME dims | 'this' | NAME '.' 'this')
    pmod = 'final' | annotation
    enumbody = consts? (',')? ';'? | member
    consts = const (',' const)*
    const = annotation* NAME ('(' args? ')')? CLASS?
    items = item (',' item)* ','? | ','
    item = expr | ARRAY | annotation
    stmt = BLOCK | ';' | pmod* type vars ';' | effect ';' | mod* kind | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
      | 'for' '(' (init? ';' expr? ';' effects? | pmod* type NAME ':' expr) ')' stmt | 'return' expr? ';' | 'throw' expr ';' | ('break' | 'continue') NAME? ';' | 'yield' expr ';'
      | 'try' resources BLOCK catch* ('finally' BLOCK)? | 'try' BLOCK (catch+ ('finally' BLOCK)? | 'finally' BLOCK) | 'switch' '(' expr ')' (SWITCH | BLOCK) | 'synchronized' '(' expr ')' BLOCK
      | 'assert' expr (':' expr)? ';' | NAME ':' stmt
    catch = 'catch' '(' pmod* type (BAR type)* NAME ')' BLOCK
    resources = '(' resource (';' resource)* ';'? ')'
    resource = pmod* type NAME '=' expr | prim
    init = pmod* type vars | effects
    effects = effect (',' effect)*
    effect = prim assign expr | INC+ prim | prim INC+ | called | creation | prim '.' creation
    called = prim '.' targs? NAME '(' args? ')' | NAME '(' args? ')' | (prim '.')? ('this' | 'super') '(' args? ')'
    clause = label+ stmt? | stmt | label* ('case' labels guard? | 'default') '->' (BLOCK | expr ';' | 'throw' expr ';')
    label = 'case' labels guard? ':' | 'default' ':'
    labels = labelone (',' labelone)*
    labelone = cond | 'default' | pattern
    guard = 'when' expr
    pattern = pmod* type NAME | type '(' (pattern (',' pattern)*)? ')' NAME?
    expr = cond | prim assign expr | lambda
    assign = '=' | AUG
    lambda = (NAME | '(' ')' | '(' NAME (',' NAME)* ')' | '(' params ')') '->' (expr | BLOCK)
    cond = ops ('?' expr ':' (cond | lambda))?
    ops = unary (binary unary | 'instanceof' 'final'? (type NAME? | pattern))*
    unary = prefix* prim INC*
    prefix = SIGN | NOT | INC | '(' type (AND type)* ')'
    binary = BIN | BAR | SIGN | STAR | AND | '<' | '>' | '>' '>' | '>' '>' '>'
    prim = LIT | NAME | 'this' | 'super' | '(' expr ')' | prim '.' NAME | prim '.' targs? NAME '(' args? ')' | NAME '(' args? ')' | ('this' | 'super') '(' args? ')' | prim '[' expr ']' | creation | prim '.' creation
      | (prim | type) '::' targs? (NAME | 'new') | (type | 'void') '.' 'class' | prim '.' ('this' | 'super') | 'switch' '(' expr ')' (SWITCH | BLOCK) | '(' lambda ')'
    creation = 'new' annotation* targs? ctype '(' args? ')' CLASS? | 'new' (PRIM | ctype) ('[' expr ']')+ dims | 'new' (PRIM | ctype) ('[' ']')+ ARRAY
    args = expr (',' expr)*
    """,
    {w: ("NAME", w) for w in SOFT} | {">": (">",), "<": ("<",), "PRIM": ("PRIM",)},
)
_MEMO = Memo(GRAMMAR, ("package", "import", "typedecl", "member", "stmt", "clause", "items", "enumbody"))
_GROUPS = (("BLOCK", "stmt"), ("CLASS", "member"), ("SWITCH", "clause"), ("ARRAY", "items"), ("ENUM", "enumbody"))
_FILES = Grammar("file = P? I* T*")
LANGUAGE = Language(
    GRAMMAR, _MEMO, _GROUPS, "member", frozenset(("else", "catch", "finally", ",", ")", "]", ".", "?", ":", "BIN", "BAR", "SIGN", "STAR", "AND", "<", ">", "::", "instanceof")), frozenset(), True,
    "file", (("P", "package"), ("I", "import"), ("T", "typedecl")), Memo(_FILES, ("file",)),
)


def _too_large(num: str) -> bool:
    """Whether a whole decimal number is beyond ``int``, or ``long`` with its letter."""
    digits = num.rstrip("lL").replace("_", "")
    return len(digits) > 9 and digits.isdigit() and digits[0] != "0" and int(digits) > (1 << 63 if num[-1] in "lL" else 1 << 31)


def outline(text: str) -> Outline:
    """One pass: tokens, methods and constructors with their first modifier or annotation, units."""
    out = Outline()
    codes: list[str] = []
    at: list[int] = []
    lookup, comments, add, add_at, symbols = _CODES.get, out.comments, codes.append, at.append, _CODES
    modifiers: set[str] = set()  # those in a row
    for m in _LEX.finditer(text):
        g = m.lastgroup
        if g == "name":
            word = m["name"]
            code = lookup(word, "NAME")
            if word in _ONE_WORD and word != "default":
                code = "ERR" if word in modifiers else code
                modifiers.add(word)
            elif modifiers:
                modifiers.clear()
            add(code)
        elif g == "op":
            if modifiers:
                modifiers.clear()
            add(symbols[m["op"]])
        elif g == "line" or g == "block":
            comments.append(m.span(g))
            continue
        elif g == "num" or g == "glued":
            add("ERR" if m.group("glued") or _WRONG_NUMBER.fullmatch(m.group("num")) or _too_large(m.group("num")) else "LIT")
        elif g == "bad" or g == "open":
            add("ERR")
        else:
            whole = m.group(g)
            add("LIT" if (g != "char" and "\\" not in whole) or {"str": _STRING, "text": _BLOCK, "char": _CHAR}[g].fullmatch(whole) else "ERR")
        add_at(m.start())
    _methods(text, codes, at, out)
    parse(text, codes, at, LANGUAGE, out)
    return out


_BODY_OF = frozenset(("class", "interface", "enum", "record"))


def _methods(text: str, codes: list[str], at: list[int], out: Outline) -> None:
    """Declarations ``name (…)`` that stand directly in the body of a type and end in a body or a semicolon."""
    types: list[bool] = []  # for each open brace, whether it is a type's body
    bodies: list[int] = []  # and the function whose body it is
    waiting = -1
    names: list[str] = []
    begin, depth, typed = 0, 0, ""
    assigned = False
    n = len(codes)
    k = 0
    while k < n:
        c = codes[k]
        if c == "(":
            if depth == 0 and types and types[-1] and not assigned and k and codes[k - 1] in ("NAME", *SOFT) and k > begin and (k < 2 or codes[k - 2] not in ("@", ".", "new")):
                level, e = 0, k
                while e < n:
                    level += (codes[e] == "(") - (codes[e] == ")")
                    e += 1
                    if level == 0:
                        break
                name = re.match(r"[\w$]+", text[at[k - 1] :]).group()
                before = codes[k - 2] if k - 2 >= begin else ""
                plain = before in ("NAME", "PRIM", "void", ">", "]", *SOFT)
                if level == 0 and e < n and codes[e] in ("{", ";", "throws", "[", "default") and (plain or name == names[-1]):
                    out.functions.append((at[k - 1], name, at[begin], None))
                    waiting = len(out.functions) - 1
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif c == "=" and depth == 0:
            assigned = True
        elif c in _BODY_OF and depth == 0 and k + 1 < n and codes[k + 1] == "NAME" and (k == 0 or codes[k - 1] != "."):
            typed = re.match(r"[\w$]+", text[at[k + 1] :]).group()
        elif c == "{":
            types.append(bool(typed) and depth == 0)
            names.append(typed)
            bodies.append(waiting if depth == 0 else -1)
            typed, waiting = "", -1 if depth == 0 else waiting
            begin, assigned = k + 1, False
        elif c == "}":
            if types:
                types.pop()
                names.pop()
                function = bodies.pop()
                if function >= 0:
                    out.ends[function] = at[k] + 1
            begin, assigned = k + 1, False
        elif c == ";" and depth == 0:
            if waiting >= 0:
                out.ends[waiting], waiting = at[k] + 1, -1
            begin, assigned = k + 1, False
        k += 1
