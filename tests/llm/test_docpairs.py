import pytest

from codelattice.llm import docpairs as d
from codelattice.llm.syntax import check

GOOD = ["Opens the file and reads all of it.", "// Replaces every TODO marker in a ticket.", "/**\n * Sorts the {@code xs} by their size.\n * @param xs xs\n */", '"""Liest den Wert ein und prüft ihn.\n\n    Args:\n        a: b\n    """', "<p>Never returns null for empty input.</p>", "Returns no description when the record lacks one.", "a: int b: int Sorts by size and name."]
BAD = [
    None, "", "  ", '""""""', "/** */", "TODO", "// FIXME: document me", "Sort items.", "This function sorts the items", "Method to sort the items", "Sorts the items.", "SortItems", "No description available for this method.", "Description goes here.", "Auto-generated stub, please fill in the description.", "Missing documentation, add it before the release.",
    "TODO: write a description for this function.", "Not documented yet.", "@param a the first of all values\n@return the sum of all values", ":param a: the first of the values\n:returns: the sum of them", "noqa: D103", "//nolint:errcheck", "pylint: disable=missing-docstring", "{@inheritDoc}", "<p></p>", "==========", "x = load(a, b)\nreturn x", "// x := f(ctx)\n// if err != nil { return err }",
    "<p>x = f(a, b) return x</p>", "Args:\n    a: the first value of them\n    b: the second value of them", "a: the\nb: the", "/** @return */", "//go:noinline\n",
]


@pytest.mark.parametrize("doc", GOOD)
def test_kept(doc):
    assert not d.is_trivial(doc, "sort_items", "def sort_items(a, b)"), doc


@pytest.mark.parametrize("doc", BAD)
def test_trivial(doc):
    assert d.is_trivial(doc, "sort_items", "def sort_items(a, b)"), doc


def found(lang, text):
    o = check.outline_of(lang, text)
    assert not o.faults
    return [(text.count("\n", 0, off) + 1, name) for off, name, _, _ in d.pairs_of(lang, text, o)]


DOC = "Walks every frame and keeps the newest of them."


def test_python():
    text = f'''"""{DOC}"""
def a():
    """{DOC}"""
    def inner(x):
        r\'\'\'{DOC}\'\'\'
class C:
    """{DOC}"""
    @property
    async def m(self, a=(1, 2),
                b=3):
        # comment
        "{DOC}"
    def n(self): "{DOC}"
    def o(self):
        x = 1
        """{DOC}"""
    def p(self):
        f"""{DOC}"""
TEXT = """
def hidden():
    '{DOC}'
"""
'''
    assert found("python", text) == [(2, "a"), (4, "inner"), (9, "m"), (13, "n")]


def test_go():
    text = f"package p\n\n// {DOC}\n//go:noinline\nfunc A() {{}}\n\n// {DOC}\n\nfunc B() {{}}\n\n/* {DOC} */\nfunc (s *S) C() {{}}\nvar x = 1 // {DOC}\nfunc D() {{}}\n// {DOC}\nvar y = 2\nfunc E() {{\n\t// {DOC}\n\tf := func() {{}}\n\t_ = f\n}}\nconst t = `\n// {DOC}\nfunc F() {{}}\n`\n"
    assert found("go", text) == [(5, "A"), (12, "C")]


def test_java():
    text = f'''class C {{
    /** {DOC} */
    @Override

    public <T> void a(int x) {{ }}
    /** {DOC} */
    int field = 1;
    void b() {{ }}
    // {DOC}
    void c() {{ }}
    /* {DOC} */
    void d() {{ }}
    /**
     * {DOC}
     */


    C() {{ run(); }}
    interface I {{
        /** {DOC} */ void e();
    }}
    String s = "/** {DOC} */ void f() {{}}";
}}
'''
    assert found("java", text) == [(5, "a"), (17, "C"), (19, "e")] or found("java", text) == [(5, "a"), (18, "C"), (20, "e")]


def test_frames(spark):
    src = [(1, "a.py", f'def f():\n    """{DOC}"""\n    return 1\n'), (1, "a.py", f'def f():\n    """{DOC}"""\n    return 1\n'), (2, "b.py", f'def f(:\n    """{DOC}"""\n'), (3, "c.py", None), (4, "d.go", ""), (None, "e.go", f"package p\n\n// {DOC}\nfunc F() {{\n}}\n"), (6, "f.txt", "x")]
    files = spark.createDataFrame([(a, b, c, 9) for a, b, c in src], "file_id bigint, file_path string, source_code string, line int")
    defs = spark.createDataFrame([(7, 30, "f", "def f(a)", DOC), (7, 30, "f", "def f(a)", DOC), (8, 4, "g", None, None), (9, None, None, None, DOC)], "def_id bigint, line int, fn_name string, signature string, docstring string")
    got = sorted(((r.origin, r.item_id or 0, r.line or 0) for r in d.documented_functions(files, defs).collect()))
    assert got == [("definitions", 7, 30), ("definitions", 9, 0), ("source_files", 0, 4), ("source_files", 1, 1)]
    pairs = {r.item_id: r for r in d.documented_functions(files, defs, with_text=True).where("origin = 'source_files'").collect()}
    assert pairs[1].code.strip().endswith("return 1") and pairs[1].documentation == DOC and pairs[None].code == "func F() {\n}"
    assert d.documented_functions(files.limit(0), defs.limit(0)).count() == 0


def test_whole_signatures(monkeypatch):
    """Parameters count to the end of the signature, however long it is."""
    seen = []
    monkeypatch.setattr(d, "is_trivial", lambda doc, name, signature: seen.append(signature))
    many = ", ".join(f"int parameterNumber{i}" for i in range(60))
    text = f"class A {{\n  /** Adds up all of the numbers. */\n  void f({many}) {{ }}\n}}\n"
    list(d.pairs_of("java", text, check.outline_of("java", text)))
    assert len(seen) == 1 and seen[0].rstrip().endswith("int parameterNumber59)")
