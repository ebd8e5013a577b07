import ast
import glob
import os
import random
import re
import warnings

import pytest

from codelattice.llm.syntax import check, dockerfile, golang, java, python3, yamlfile
from codelattice.llm.syntax.chart import Grammar
from codelattice.llm.syntax.spans import Spans

SMALL = Grammar("s = 'a' x? 'c' | '(' s ')'\nx = 'b'+")


def test_chart():
    assert SMALL.derives("abbc", "s") == (True, 4) and SMALL.derives("(ac)", "s")[0] and not SMALL.derives("ab", "s")[0] and SMALL.derives("acx", "s") == (False, 2)
    for text, cost in (("abc", 0), ("ab", 1), ("abcc", 1), ("axc", 1), ("((ac)", 1), ("bc", 1), ("", 2), (")", 2)):
        assert SMALL.repair(text, "s", 3)[0] == cost, text
    assert [(e.kind, e.at, e.token) for e in SMALL.repair("ab", "s")[1]] in ([("insert", 2, "c")], [("replace", 1, "c")])
    assert [(e.kind, e.at) for e in SMALL.repair("abcc", "s")[1]] in ([("delete", 2)], [("delete", 3)])


def brute_cost(text, limit):
    """Least edits by trying all texts within the limit."""
    seen, now = {text}, {text}
    for cost in range(limit + 1):
        if any(SMALL.derives(t, "s")[0] for t in now):
            return cost
        step = set()
        for t in now:
            for i in range(len(t) + 1):
                step |= {t[:i] + c + t[i:] for c in "abc()"} | ({t[:i] + t[i + 1 :]} | {t[:i] + c + t[i + 1 :] for c in "abc()"} if i < len(t) else set())
        now = step - seen
        seen |= now
    return limit + 1


def test_least_cost_against_brute_force():
    rnd = random.Random(4)
    for _ in range(40):
        t = "".join(rnd.choice("abc()") for _ in range(rnd.randrange(0, 5)))
        assert SMALL.repair(t, "s", 2)[0] == brute_cost(t, 2), t


PYTHON = '''"""Doc."""
from __future__ import annotations
import os, sys as s
from . import (a, b as c,)
x: int = 3; y = z = (yield_ := 4)
a, *b = c[1:2, ..., ::3], d.e
del a[0], b.c
@dec(1)
async def f(a, /, b: "int" = 1, *args, c, **kw) -> dict[str, int]:
    async with open(x) as fh, g() as (p, q):
        await fh.read()
    async for i, j in k: pass
    else:
        return {**a, 'b': [i for i in x if i if j], "c": {i: j for i in x}, 'd': {1, *y}}
    try:
        raise E from None
    except* (A, B) as e: ...
    finally: global z
    while not a < b <= c is not d in e: break
    return lambda *a, k=1, **q: (yield)
class C[T: int](Base, metaclass=M):
    x = f"{a!r:>{width}} {b['c']}" 'more'; v = rb\'\'\'z\'\'\' b''
    if x: y = 1; z = 2
    elif (n := 5) > 3 and not y or z if w else v: pass
    else: z -= 0x1F + 1_000.5e-3j // ~b ** -c @ d
match x, y:
    case [1, -2.5, *rest] | {"a": b, **c} if d: pass
    case Point(x=0, y=None) as p: pass
    case _:
        match = case = type = 1
type A[T] = list[T]
print(*a, **b, sep="")
assert x, "y"; nonlocal_ = 1
with (open(a) as b, open(c)):
    pass
x = [
  1,  # one
  2,
]
if True:
\tpass
x = a if b else \\
  c
'''
BAD_PYTHON = ["def f(:\n", "x = (1\n", "if x\n  y\n", "<<<<<<< HEAD\nx = 1\n", "print 'x'\n", "x = 'abc\n", '"""open\n', "def f():\nx = 1\n", "  x = 1\n", "x = 1\n  y = 2\n", "else:\n  x\n", "try:\n  x\ny\n", "x = 3f9\n", "import\n", "f(a b)\n", "class C\n", "1 = x\n", "f() = 1\n", "x +\n", "@d\nx = 1\n", "if x:\n    a\n  b\n", "for x y: pass\n", "x = {1: 2, 3}\n", "return = 1\n", "x = 'a' b'b'\n", "def f(a, b\n    pass\n", "package main\n", "0123\n"]


def test_python_agrees_with_the_interpreter():
    ast.parse(PYTHON)
    assert not python3.outline(PYTHON).faults and not python3.outline(PYTHON.replace("\n", "\r\n")).faults
    for t in BAD_PYTHON:
        with pytest.raises(SyntaxError):
            ast.parse(t)
        assert python3.outline(t).faults, t
    for t in ("", "\n", "# c", "x", "pass # c\n\n", "if 1:\n  # c\n\n  x\n# d\n  y\n", "\f\nx = 1\n", "class A: pass", "x = 1 if y else 2\n\n\n", "def f():\n    'd'\n"):
        assert not python3.outline(t).faults, t


# Statements on the borders of the grammar, valid and not; the interpreter's parser says which.
BORDERS = [
    'f(a=1, 2)', 'def f(a=1, b): pass', 'lambda x=1, y: 0', 'def f(*): pass', 'def f(a, *, **k): pass', 'f(**a, b)', 'a:=1', 'try:\n  pass\nexcept X, Y:\n  pass', 'try:\n  pass\nexcept* X:\n  pass\nexcept Y:\n  pass', "f'{'",
    "f'}'", "f'{a b}'", "b'é'", "'\\x'", "'\\u12'", 'if a:\n\tb\n        c', 'class A(x for x in y): pass', '5if 1else 2', 'f\'{a["b"]}\'', "f'{a['b']}'", 'f"{x!r:>{w}}"', 'f"{x=}"', 'f"{x = !s}"', 'f"{{}}"', 'f"{{x}"',
    'f"{lambda x: 1}"', 'f"{(lambda x: 1)}"', 'f"{a:%Y-%m}"', 'f"{a!z}"', 'f"{}"', 'f"{*a, b}"', 'f"{yield}"', "f'''{\na\n}'''", 'rf"\\d{x}"', 'f"\\{x}"', 'f"\\N{DASH}"', 'f"\\N{EN DASH}{x}"', 'f"{f\'{f"{1}"}\'}"',
    'f"{x:{y:{z}}}"', 'x = f"{a}" "b" f\'{c}\'', "t'x'", "ur'x'", '(*a)', '*a', '[*a or b]', 'print(*a or b)', 'a + not b', 'a == not b', 'x = a:=1', '(a:=1)', 'f(a:=1)', '[x for x in y if z:=1]', '[x for x in y if (z:=1)]',
    '(a,b): int = 1', '(a): int = 1', '(a,b) += 1', 'del *a', 'with (a as b, c as d,): pass', 'with (a, b): pass', 'with a as (b, c): pass', 'def f(a, /, b=1, *c, d, **e): pass', 'def f(/, a): pass', 'def f(a, /, /): pass',
    'def f(a, /, *): pass', 'lambda a, /, *b, c=1, **d: 0', 'lambda *: 0', 'lambda *a,: 0', 'def f(**k,): pass', 'def f(*a, *b): pass', 'def f(**k, a): pass', 'def f(a: int=1, *, b: str) -> x: pass', 'def f() -> a, b: pass',
    'match x:\n  case [1, *r, {"a": b, **c}] if d: pass\n  case C(1, x=2) ', ' D(): pass\n  case -1 + 2j: pass\n  case _: pass', 'match x:\n  case C(x=1, 2): pass', 'match x:\n  case {**r, "a": 1}: pass',
    'match = 1; case = 2; type = 3', 'type X[T: int, *U, **P] = list[T]', 'class A[T](B, metaclass=C, **d): pass', 'x[a:b, *c, d:=1]', 'x[*a]', 'print >>f, 1', 'print 1', 'exec "x"', 'raise A, B', 'raise A from B',
    'from x import (a, b as c,)', 'from x import a,', 'from . import *', 'import a.b as c, d', 'global a, b', 'nonlocal x = 1',
    'async def f():\n  async with a as b, c: pass\n  async for x in y: pass\n  return [x async for x in y]', 'await x', 'await -x', '-await x', 'not await x', '2 ** -1', 'x if y else z if w else v', 'lambda: (yield)',
    'x = yield', 'x = yield from y', 'return', 'return *a, b', 'yield a, *b', 'assert x, y', 'assert (x, y)', 'del (a, b), [c], d.e, f[0]', 'del f()', 'f() = 1', 'f().x = 1', '*a, b = c', '(a, [b, *c]) = d',
    'for *a, b in c: pass', 'for f() in c: pass', 'for x in *a, b: pass', 'for x in a:=b: pass', 'while a:=b: pass', 'if x: pass; y = 1', 'if x: if y: pass', 'class A: pass; x = 1', 'x = 0777', 'x = 00', 'x = 09.5', 'x = 09e1',
    'x = 1_000', 'x = 1__0', 'x = 1_', 'x = 0x_f', 'x = 1.e5', 'x = 1.real', 'x = 1..real', 'x = 1j', 'x = 0b12', 'x = 0xfor x', '1if 1else 2', '[1for x in y]', "x = 'a' b'b'", "x = b'a' b'c'", "x = 'a' f'{b}'",
    '@a.b(c)[d]\ndef f(): pass', '@x:=y\ndef f(): pass', '@x\ny = 1', 'a = b = yield', 'a = *b', 'a += *b,', 'x: int', 'x: int = *a, b', 'x.y: int', 'x[0]: int = 1', '"a": int', 'lambda: x = 1', 'f(x for x in y)',
    'f(x for x in y, 1)', 'f(x for x in y,)', 'f(1, x for x in y)', 'f(a, *b, c=1, *d, **e, f=2)', 'f(**a, *b)', 'f(*a, b)', 'f(None=1)', 'f(a.b=1)', '{a: b for a, b in c}', "{**a, 'b': 1}", '{*a, b}', '{a: b, c}', '{a, b: c}',
    '{a:=1}', '{a: b:=1}', 'try: pass\nfinally: pass', 'try: pass\nexcept: pass\nelse: pass\nfinally: pass', 'try: pass', 'try: pass\nelse: pass', 'else: pass', 'if a: pass\nelse: pass\nelse: pass', 'x = (\n1', 'x = 1)',
    'x = [1, 2', '"abc', "'''abc", 'x = \\\n1', 'x = \\ 1', '  x = 1', 'if a:\npass', 'if a:\n  b\n c', "def f():\n    '''doc'''\n", 'x = $', 'x = a?b', 'a <> b', 'a !b', 'a!=b', 'x = `a`', 'with a as b.c, d as e[0]: pass',
    'with a as f(): pass', 'async x', 'await', 'class', 'def', 'None = 1', 'True: int', 'x = not', 'not x in y', 'x not in y', 'x is not y', 'x not is y', 'a < b < c', 'a if b', 'a if b else', '*x = 1', 'x = *y', 'return x:=1',
    '(yield)', '(yield x) + 1', '[yield]', 'f(yield)', 'x[yield]', '{yield}', 'lambda x: yield', 'def f(a, (b, c)): pass', 'import a.b.c', 'import .a', 'from a import b.c', 'from .a import b', 'from ... import x',
    'from .... import y', '"\\N{foo}"', "'\\N{DASH'", "'\\U00110000'", "'\\777'", "rb'\\x'", "b'\\u12'",
]


def interpreter_takes(text):
    """The reference: the interpreter's own parser, which the operator doesn't use."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        return False


@pytest.mark.parametrize("text", BORDERS)
def test_python_borders(text):
    assert check.is_invalid("python", text + "\n") == (not interpreter_takes(text + "\n"))


def test_python_mutants_of_library_files():
    """Files of the standard library with tokens left out, doubled, swapped or put in get the interpreter's verdict."""
    rnd = random.Random(11)
    files = [f for f in sorted(glob.glob(os.path.dirname(os.__file__) + "/*.py")) if os.path.getsize(f) < 15_000]
    for f in rnd.sample(files, 25):
        with open(f, encoding="utf-8") as h:
            text = h.read()
        assert not check.is_invalid("python", text), f
        spans = [m.span() for m in re.finditer(r"\w+|[^\w\s]+|\s+", text)]
        for _ in range(8):
            (s, e), (a, b), sign = rnd.choice(spans), rnd.choice(spans), rnd.choice("()[]{}:,='\"\\\t*+")
            t = rnd.choice([text[:s] + text[e:], text[:s] + text[a:b] + text[s:], text[:s] + text[a:b] + text[e:], text[:s] + sign + text[s:]])
            assert check.is_invalid("python", t) == (not interpreter_takes(t)), (f, s)


def test_python_truncated_anywhere():
    """Every prefix that ends at a line gets the interpreter's verdict."""
    for i, ch in enumerate(PYTHON):
        if ch == "\n" or i % 7 == 0:
            t = PYTHON[: i + 1]
            assert check.is_invalid("python", t) == (not interpreter_takes(t)), t[-60:]


GO = '''// c
package p

import (
	"fmt"
	m "a/b"
)
import . "x"

const ( A = iota; B )
var x, y int = 1, 2
var z = map[string][]int{"a": {1, 2}, "b": nil,}
type S[T any, U comparable] struct { a, b int `json:"x"`; *E; m.T; f func(int) (a, b error) }
type I interface { M(x int) error; E; ~int | string }
type F = func(...string) <-chan int

func (s *S[T]) G[K any](a, b int, c ...string) (n int, err error) {
	if v, ok := z["a"]; ok && !(v == nil) { return } else if x := f(); x > 3 { goto L } else { x++ }
	for i := 0; i < 10; i++ { continue }
	for range ch { }
	for k, v := range z { _ = k; v = v }
	for { break }
	switch t := a.(type) { case int, *S: fallthrough; default: }
	switch { case x > 1: f(); g() }
	select { case v := <-ch: case ch <- 1: default: x-- }
L:
	defer func() { recover() }()
	go f(a, b...)
	p := &S{a: 1, b: []int{1, 2}[0:1:2], c: struct{ x int }{1}}
	a, b = b, a^1&^2<<3
	x.y[1](2).z = *p
	var q []func(int) (string, error)
	type L2 struct{}
	r := '\\'' + "a\\"b" + `raw
`
	if x == (S{}) {}
	return make([]int, 3), nil
}
'''
JAVA = '''package a.b;
import java.util.*; import static a.B.c;
/** d */
@A(x = 1, y = {"a", "b"}) public abstract class C<T extends D & E> extends F<T[]> implements G, H {
  static final int[] A = {1, 2, 3,}, B = new int[3][];
  private Map<String, List<? super T>> m = new HashMap<>() {{ put("a", 1); }};
  static { int x = 1; }
  @Override public <U> C(final U u, int... xs) throws E { super(u); this.x = xs[0]; }
  abstract void f();
  int g(int a) {
    for (int i = 0, j = 1; i < 10 && !b; i++, j--) continue;
    for (var x : xs) { if (x > 1) break; else y(); }
    outer: while (true) do { x >>>= 2; } while (a >= b);
    try (var r = open(); s) { throw new E("x" + 'c' + 1.5e3f); } catch (A | B e) { } finally { }
    switch (a) { case 1: case 2: f(); break; default: }
    int z = switch (b) { case 1, 2 -> 3; default -> { yield 4; } };
    Runnable q = () -> { }; F<A> h = (x, y) -> x + y; g = A::new; k = String[]::new; xs.forEach(this::f);
    String t = """
      text { block
      """;
    if (o instanceof P p && p.x()) return (int) a + (T) b; else if (c) ; 
    synchronized (this) { assert a : "m"; }
    new Thread(() -> f()).start(); int[][] w = new int[][] {{1}, {2}}; a.b.<T>c(); Outer.this.x();
    return a ? b : c -> d;
  }
  enum K { A(1) { void f() {} }, B; int x; K() {} K(int y) {} }
  record R(int a, @N String b) implements I { R { a = 1; } }
  interface I { default void f() {} int g(); }
  @interface N { int value() default 1; }
}
'''


@pytest.mark.parametrize(("outline", "text"), [(golang.outline, GO), (java.outline, JAVA)])
def test_go_and_java(outline, text):
    assert [(f.symbol, text[f.start : f.end][:80]) for f in outline(text).faults] == []
    for i in range(len(text) // 3, len(text) - 2, 37):
        assert outline(text[:i]).faults or text[:i].count("{") == text[:i].count("}"), text[i - 40 : i]
    lines = text.split("\n")
    for i in range(6, len(lines) - 1, 5):
        if "raw" not in lines[i] and "`" != lines[i][:1] and "block" not in lines[i] and '"""' not in lines[i]:
            assert outline("\n".join([*lines[:i], "<<<<<<< HEAD", *lines[i:]])).faults, lines[i]


def test_go_rules():
    for bad in ("package p\nfunc f() {\n\tx := \n}\n", "package p\nx := 1\n", "import \"a\"\npackage p\n", "package p\nfunc f() { if x { } \n else { } }\n", "package p\nvar x = []int{\n1\n}\n", "func f() {}\n", "package p\nfunc f( {}\n", "package p\ntype T struct { a int,\n }\n", "package p\n}\n"):
        assert golang.outline(bad).faults, bad
    assert not golang.outline("package p").faults


def test_dockerfiles():
    ok = ["FROM a\n", "# c\nARG V=1\nFROM a:$V AS b\nRUN x \\\n # c\n  && y\nCMD [\"a\"]\n", "from a\nenv A=1 B='x y'\nenv C d e\nlabel a=b\nexpose 80/tcp\nhealthcheck --interval=5s cmd curl x\nhealthcheck none\nonbuild run x\n", "FROM a\nRUN <<EOF\nanything <<<<<<< HEAD\nEOF\nCOPY --from=b a b c\nADD [\"a b\", \"c\"]\nSHELL [\"sh\", \"-c\"]\nRUN [ -f x ] || y\n"]
    bad = ["", "# c\n", "RUN x\n", "FROM a\nRU\n", "FROM a\nCOPY\n", "FROM a\nCOPY x\n", "FROM a AS\n", "FROM\n", "FROM a\nENV A\n", "FROM a\nRUN <<EOF\nx\n", "<!DOCTYPE html>\n", "FROM a\n=======\n", "FROM a\nENV A=\"x\n", "FROM a\nUSER\n"]
    for t in ok:
        assert not dockerfile.outline(t).faults, t
        assert not dockerfile.outline(t.replace("\n", "\r\n")).faults, t
    for t in bad:
        assert dockerfile.outline(t).faults, t


def test_dockerfile_words_beyond_64():
    pairs = " ".join(f"K{i}=v" for i in range(80))
    assert dockerfile.outline(f"FROM a\nENV {pairs} bad\n").faults
    for ok in (f"ENV {pairs}", "COPY " + "x " * 80 + "d/", "EXPOSE" + " 80" * 80, "RUN" + " x" * 80, "ARG" + " a=1" * 80 + " b"):
        assert not dockerfile.outline(f"FROM a\n{ok}\n").faults, ok


def test_yaml():
    yaml = pytest.importorskip("yaml")
    cases = [
        "a: 1\nb:\n  - c\n  - d: e\n    f: g\n  -\n    h: i\n", "a:\n- b\n- c:\n  - d\ne: f\n", "a: [1, 'x y', {b: c}]\nd: {e: f, g: [h]}\n", 'a: "x\n  y"\nb: |\n  any: [thing\n c\n' .replace(" c\n", "  c\n"), "a: x\n  y z\nb: c\n", "a: &n\n  b: c\nd:\n  <<: *n\n", "# c\n\na:   # c\n  b: c # d\n", "", "a\n", "- a\n- b\n", "a: b: c\n", "a: [1, 2\nb: c\n", "a: 'x\nb: c\n",
        "a:\n  b: c\n d: e\n", "a: b\n  c: d\n", "<<<<<<< HEAD\na: b\n", "a: b\n=======\n", "a:\n\tb: c\n", "a: b\nc\n", "- a\nb: c\n", "a: @x\n", "a: {b: c\n", "a: ]\n", "---\na: b\n---\nc: d\n", "a: b\n...\n", "? x\n: y\n" if False else "k: v\n", "a: 'it''s'\nb: \"q\\\"r\"\n", "a: http://x:80/y\nb: -1\nc: :x\n", "a: >-\n\n  text\n\n  more\nb: c\n", "services:\n  w",
    ]
    for t in cases:
        try:
            list(yaml.compose_all(t))
            ok = True
        except yaml.YAMLError:
            ok = False
        assert (not yamlfile.outline(t).faults) == ok, repr(t)


def java(body):
    return f"class A {{ void f() {{ {body} }} }}"


def go(body):
    return f"package a\nfunc f() {{\n{body}\n}}\n"


JAVA_BAD = [java(x) for x in ("1 + 2;", "try { }", 'String s = "\\q";', "int x = 09;", "int x = 99999999999;", "char c = 'ab';", "x;", "int x = 1_;", "/* open")] + ["class A { public public int x; }", "package a;\npackage b;\nclass A {}"]
JAVA_GOOD = [java(x) for x in ("x = 1 + 2;", "try { } finally { }", "try (A a = b()) { }", 'String s = "\\n\\u0041\\77";', "int x = 07; double d = 09.5; float f = 09f;", "long x = 99999999999L; int y = -2147483648;", "char c = '\\''; char d = '\\u0041';", "x++; --y; new B(); a.b(); this.f(); b.new C();", "try { } catch (A | B e) { } int z = a | b;", 'String s = """\n  a "b" \\\n c\\t\n""";', "for (int i = 0, j = 1; i < 3; i++, j--) { }", "Runnable r = () -> x++; switch (a) { case 1 -> f(); default -> { } }", 'super.f(); A.super.f(); foo().bar++; a[i] = 3; a[i]++; ((Foo) a).b(); "a".length();')]
JAVA_GOOD += ["class A { public static final int x = 1; public int y; }", "package a;\nimport b.c;\nclass A {}", "class A { A() { this(1); } A(int x) { super(); } }"]
GO_BAD = [go(x) for x in ("var x = 09", 'x := "\\q"', "a, b", "go func() {}", "defer x", "x := 'ab'", "a.b := 1", "x := 1__0", "x := 0x", "/* open")] + ["package a\npackage b\n"]
GO_GOOD = [go(x) for x in ("var x = 07; y := 0x_1f; z := 09.5; w := 09i; v := 1_000; u := 0x1p-2; t := 0", 'x := "\\n\\x41\\u00e9\\"\\101"', "a, b = b, a", "go func() {}()", "defer x.y(1)", "x := '\\''; y := '\\n'; z := 'é'; w := '\\U0001F600'", "for i, v := range x { _ = i }", "for a.b, c = range x { }", "switch x := y.(type) {\ncase int, string:\n}", "select {\ncase v, ok := <-ch:\ncase ch <- 1:\n}", "if v, ok := m[k]; ok { }", "x.y++; <-ch; f(); (f)()", "switch a { case 1, 2: f() }")]


@pytest.mark.parametrize(("language", "text", "bad"), [("java", t, True) for t in JAVA_BAD] + [("java", t, False) for t in JAVA_GOOD] + [("go", t, True) for t in GO_BAD] + [("go", t, False) for t in GO_GOOD])
def test_java_and_go_borders(language, text, bad):
    assert check.is_invalid(language, text) == bad


def test_languages_by_name():
    names = {"a/b.py": "python", "x.go": "go", "X.java": "java", "d/DOCKERFILE": "dockerfile", "Dockerfile.dev": "dockerfile", "my-docker-compose.prod.yaml": "compose", "a.txt": None, "compose.yml": None, None: None, "py": None}
    assert {n: check.language_of(n) for n in names} == names


def test_causes():
    why = lambda lang, t: check.diagnose(lang, t, check.outline_of(lang, t))[0]
    assert why("python", "def f():\n    x = (1,\n") == "truncated" and why("python", "x = 1\n<<<<<<< HEAD\ny = 2\n=======\ny = 3\n>>>>>>> b\n") == "conflict" and why("python", 'package main\n\nimport "fmt"\n\nfunc main() {\n\tfmt.Println("a")\n}\n') == "other_language"
    assert why("go", "package p\n\nfunc f() {\n\tx := 1\n") == "truncated" and why("java", "<html><body>x</body></html>\n") == "other_language"
    cause, cost, line = check.diagnose("python", "a = 1\nb = (2\n", check.outline_of("python", "a = 1\nb = (2\n"))
    assert (cause, cost, line) == ("truncated", 1, 2)
    # the places of the edits decide, not what the text looks like: marks without a fault near them, faults that end nothing
    assert why("python", '"""T\n=======\n"""\nx = 1\nif x\n    y = 2\nz = 1\nw = 2\n') == "other"
    assert why("go", "package p\n\nimport (\n<<<<<<< HEAD\n\t\"a\"\n=======\n\t\"b\"\n>>>>>>> x\n)\n\nvar a = 1\n") == "conflict"
    for cut in (GO[: GO.rindex("}")].rstrip()[:-3], GO + "\n/*\nUnfinished", 'package p\n\nfunc f() {\n\tif err != nil {\n\t\treturn fmt.E'):
        assert why("go", cut) == "truncated", cut[-40:]
    assert why("python", "import a\n\nclass A:\n    @b\n    def f(\n        self,\n        c: int,\n") == "truncated"
    assert why("java", "class A {\n    /** Doc of") == "truncated" and why("compose", "services:\n  a:\n    ports: [\"80") == "truncated"
    assert check.outline_of("python", "f'{" * 3000).faults


def test_cost_counts_every_faulty_unit():
    """Each unit needs two edits; units beyond the fortieth count in full."""
    text = "FROM a\n" + "<<<<<<< HEAD\n" * 45
    assert check.diagnose("dockerfile", text, check.outline_of("dockerfile", text))[1] == 90


def test_frame(spark):
    rows = [(1, "a.py", "x = (\n", "r1"), (1, "a.py", "x = (\n", "r1"), (2, "b.py", "x = 1", "r1"), (3, "c.py", None, "r1"), (4, "d.py", "", "r2"), (5, "e.go", "package p\n" + "var x = 1\n" * 5000, "r2"), (6, None, "x", "r2"), (None, "f.java", "class {", "r2"), (7, "g.txt", "(((", "r2")]
    df = spark.createDataFrame(rows, "file_id bigint, file_path string, source_code string, repo string")
    assert sorted((r.file_id or 0) for r in check.check_files(df, "file_id", "file_path", "source_code").collect()) == [0, 1]
    rates = {(r.repo, r.language): (r.files, r.invalid_files, r.truncated) for r in check.invalid_rates(df, "file_id", "file_path", "source_code", "repo").collect()}
    assert rates[("r1", "python")] == (2, 1, 1) and rates[("r2", "go")] == (1, 0, 0)
    assert check.check_files(df.limit(0), "file_id", "file_path", "source_code").count() == 0


def edited(tokens, edits):
    """Tokens after edits that put in terminals alone."""
    out = []
    for at in range(len(tokens) + 1):
        here = [e for e in edits if e.at == at]
        out += [e.token for e in here if e.kind == "insert"]
        if at < len(tokens):
            out += [e.token for e in here if e.kind == "replace"] or [tokens[at]] * (not any(e.kind == "delete" for e in here))
    return out


def test_repair_of_any_cost():
    """Beyond two edits the cost is told exactly, by the search and by the spans alike."""
    rnd = random.Random(8)
    spans = Spans(SMALL, SMALL._ids["s"])
    for t in [")))", "))))", "bbbb", *("".join(rnd.choice("abc()") for _ in range(rnd.randrange(0, 5))) for _ in range(30))]:
        cost, edits = SMALL.repair(t, "s")
        assert cost == brute_cost(t, 3) == spans.repair([SMALL._terms(c) for c in t])[0], t
        assert len(edits) == cost and SMALL.derives(edited(t, edits), "s")[0], t
    assert SMALL.repair(")" * 30, "s")[0] == SMALL.repair("(" * 30, "s")[0] == 16  # fourteen pairs around two letters


def test_search_and_spans_agree():
    rnd = random.Random(9)
    for grammar, symbol, words in ((python3.LINES, "simples", ["NAME", "=", "(", ")", ",", "for", "in", ":", "NUM"]), (golang.GRAMMAR, "stmt", ["NAME", "=", "(", ")", ",", "if", "LIT", ";"])):
        for _ in range(12):
            t = [rnd.choice(words) for _ in range(rnd.randrange(1, 14))]
            cost, edits = grammar.repair(t, symbol)
            other, some = Spans(grammar, grammar._ids[symbol]).repair([grammar._terms(w) for w in t])
            assert cost == other == sum(1 if kind != "insert" else grammar.least[sym] for kind, _, sym in some), t


def test_repair_beyond_a_thousand_tokens():
    """Five pairs of names without an operator between them, in one line of 1,519 tokens."""
    text = "x = [" + ("a b, " + "1, " * 150) * 5 + "]\n"
    outline = check.outline_of("python", text)
    assert [len(f.tokens) for f in outline.faults] == [1519]
    edits = check.edits_of("python", text, outline.faults[0])[1]
    pairs = [m.start() for m in re.finditer("a b", text)]
    assert check.diagnose("python", text, outline)[1] == len(edits) == 5
    assert all(pair <= at <= pair + 3 for pair, (at, _) in zip(pairs, edits, strict=True))


def test_spans_kept_in_a_file(monkeypatch):
    t = [SMALL._terms(c) for c in "((abbc)c)a"]
    spans = Spans(SMALL, SMALL._ids["s"])
    want = spans.repair(t)
    monkeypatch.setattr("codelattice.llm.syntax.spans.IN_MEMORY", 0)
    assert spans.repair(t) == want
