import inspect

from pyspark.sql import functions as F

from codelattice.operators import dataflow, joins, resolution, symbols, traversal


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_closures_on_cycles(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"))
    got = traversal.reachable(e, spark.createDataFrame([("a",), ("x",)], "node string"))
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("x", 0)]
    all_ = traversal.closure(e, spark.createDataFrame([("a",), ("d",)], "root string"))
    assert sorted((r.root, r.node, r.depth) for r in all_.collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("d", "d", 0)]
    assert {r.node for r in traversal.transitive_callers(e, spark.createDataFrame([("d",)], "node string")).collect()} == {"a", "b", "c", "d"}
    assert {(r.node, r.depth) for r in traversal.reachable_sql(e, "'a'", 4).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_shortest_paths(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"))
    got = traversal.find_path(e, spark.createDataFrame([("a", "e"), ("e", "a")], "src string, dst string"))
    assert [tuple(r.path) for r in got.collect()] == [("a", "b", "d", "e")]


def test_dependency_graph(spark):
    t = traversal.traverse(edges(spark, ("web", "db"), ("db", "disk"), ("lb", "web")), "web")
    assert sorted((r.direction, r.node, r.depth) for r in t.collect()) == [("down", "lb", 1), ("up", "db", 1), ("up", "disk", 2)]
    assert traversal.dependency_chain(t, "web").first()[0] == "disk -> db -> web -> lb"


STMT = "fqn string, seq int, line int, type string, def string, uses array<string>, call_target string, call_chain string, attribute_access string, call_args array<string>"


def program(spark, *rows):
    full = [(f, i, ln, kind, d, u, c, c, attr, list(u)) for i, (f, ln, kind, d, u, c, attr) in enumerate(rows)]
    return spark.createDataFrame(full, STMT)


def flows(df, sources=("input",), sinks=("execute",), sanitizers=("escape",)):
    return sorted((r.fqn, r.source_line, r.sink_line) for r in dataflow.vdg_flows(df, sources, sinks, sanitizers).collect())


def test_flow_cases(spark):
    a = "assignment"
    df = program(
        spark, ("direct", 1, a, "x", [], "input", ""), ("direct", 2, "call", "", ["x"], "db.execute", ""), ("clean", 1, a, "x", [], "input", ""), ("clean", 2, a, "y", ["x"], "html.escape", ""), ("clean", 3, "call", "", ["y"], "execute", ""),
        ("killed", 1, a, "x", [], "input", ""), ("killed", 2, a, "x", [], "other", ""), ("killed", 3, "call", "", ["x"], "execute", ""), ("same", 1, a, "x", ["x"], "input", ""), ("same", 2, "return", "", ["x"], "execute", ""),
        ("attr", 1, a, "x", [], "", "request.input"), ("attr", 2, a, "z", ["x"], "execute", ""), ("two", 1, a, "x", [], "input", ""), ("two", 2, a, "y", [], "input", ""), ("two", 3, "call", "", ["x", "y"], "execute", ""),
        ("apart", 1, "call", "", ["x"], "execute", ""), ("apart", 2, a, "x", [], "input", ""), ("none", 1, a, "x", [], "input", ""),
    )
    assert flows(df) == [("attr", 1, 2), ("direct", 1, 2), ("same", 1, 2), ("two", 1, 3), ("two", 2, 3)]
    assert flows(df.limit(0)) == []
    got = {(r.fqn, r.source_line, r.sink_line) for r in dataflow.flow_reach(df, ["input"], ["execute"]).collect()}
    assert got == set(flows(df, sanitizers=()))


def test_summaries_across_functions(spark):
    a = "assignment"
    df = program(
        spark, ("m.source", 1, a, "x", [], "input", ""), ("m.source", 2, "return", "", ["x"], "", ""), ("m.pass", 1, a, "y", ["p"], "", ""), ("m.pass", 2, "return", "", ["y"], "", ""), ("m.sink", 1, "call", "", ["q"], "execute", ""),
        ("m.main", 1, a, "a", [], "m.source", ""), ("m.main", 2, a, "b", ["a"], "m.pass", ""), ("m.main", 3, "call", "", ["b"], "m.sink", ""), ("m.wash", 1, "return", "", ["s"], "escape", ""),
    )
    params = spark.createDataFrame([("m.pass", ["p"]), ("m.sink", ["q"]), ("m.wash", ["s"]), ("m.main", []), ("m.source", [])], "fqn string, names array<string>")
    calls = spark.createDataFrame([("m.main", "m.source"), ("m.main", "m.pass"), ("m.main", "m.sink"), ("m.source", "m.sink")], "caller string, callee string")
    s = {r.fqn: r for r in dataflow.summary_fixpoint(df, params, calls, ["input"], ["execute"], ["escape"]).collect()}
    assert s["m.source"].is_source and not s["m.pass"].is_source and list(s["m.pass"].p2ret) == [0] and list(s["m.sink"].p2sink) == [0] and s["m.wash"].is_sanitizer
    local = dataflow.flows_local(df, df, ["input"], ["execute"], ["escape"])
    at = lambda f, n, c: spark.createDataFrame([(f, n, c)], "fqn string, line int, call string")
    sums = dataflow.summary_fixpoint(df, params, calls, ["input"], ["execute"], ["escape"])
    g = dataflow.flows_global(at("m.source", 1, "input"), at("m.sink", 1, "execute"), calls, sums, local).collect()
    assert [(r.source_fqn, r.sink_fqn, r.scope) for r in g] == [("m.source", "m.sink", "global")]


def test_closures_have_no_depth_bound(spark):
    names = [f"n{i:02}" for i in range(23)]
    e = edges(spark, *zip(names, names[1:], strict=False), ("n03", "n01"))
    path = traversal.find_path(e, spark.createDataFrame([(names[0], names[-1])], "src string, dst string")).first().path
    assert list(path) == names
    assert all(inspect.signature(f).parameters["max_depth"].default is None for f in (traversal.closure, traversal.reachable, traversal.transitive_callers))


def test_paths_take_no_rounds_for_what_leads_nowhere(spark, monkeypatch):
    """What a source reaches beside the path, however deep, costs nothing."""
    rounds = []
    for name in ("cut", "stored"):
        monkeypatch.setattr(traversal, name, lambda df, *_, f=getattr(traversal, name, None): (rounds.append(1), f(df, *_))[1], raising=False)
    side = [f"n{i:02}" for i in range(40)]
    e = edges(spark, ("a", "b"), ("b", "z"), ("a", "c"), ("c", "z"), ("a", side[0]), *zip(side, side[1:], strict=False))
    got = traversal.find_path(e, spark.createDataFrame([("a", "z"), ("c", "z")], "src string, dst string"))
    assert sorted(tuple(r.path) for r in got.collect()) == [("a", "b", "z"), ("c", "z")] and len(rounds) < 10


def test_paths_against_brute_force(spark):
    """Random graphs with cycles and loops, from both sides: repeated pairs, a node to itself, pairs without a path, missing ends, depths."""
    import random

    rnd = random.Random(11)
    pairs_of = lambda a, b: [(x, y) for x in a for y in b] + [(a[0], b[0]), (None, b[0]), (a[0], None)]
    for n, ends, depth in ((30, ((3, 9, 10, 11), (10, 2)), None), (30, ((3, 10), (2, 10, 29, 7)), None), (60, (tuple(range(0, 60, 4)), (4, 33)), 3)):
        arcs = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(2 * n)}
        asked = pairs_of(*ends)

        def best(a, b):
            paths = [(a,)]
            for _ in range(n if depth is None else depth + 1):
                if done := [p for p in paths if p[-1] == b]:
                    return min(done)
                first = {}
                for p in sorted((*p, y) for p in paths for x, y in arcs if x == p[-1]):  # noqa: B023
                    first.setdefault(p[-1], p)
                paths = list(first.values())

        e = spark.createDataFrame([*arcs, (None, 1), (2, None)], "src bigint, dst bigint")
        got = traversal.find_path(e, spark.createDataFrame(asked, "src bigint, dst bigint"), depth)
        want = sorted((a, b, p) for a, b in asked if a is not None and b is not None and (p := best(a, b)))  # noqa: B023
        assert sorted((r.src, r.dst, tuple(r.path)) for r in got.collect()) == want and want


def test_asof_and_edges(spark):
    defs = spark.createDataFrame([("f", "x", 1), ("f", "x", 5), ("f", "y", 9)], "fqn string, var string, line int")
    uses = spark.createDataFrame([("f", "x", 1), ("f", "x", 4), ("f", "x", 5), ("f", "y", 8), ("g", "x", 3)], "fqn string, var string, line int")
    assert sorted((r.fqn, r.var, r.line, r.def_line) for r in joins.asof_latest_def(uses, defs).collect()) == [("f", "x", 1, 1), ("f", "x", 4, 1), ("f", "x", 5, 5), ("f", "y", 8, None), ("g", "x", 3, None)]


def test_line_proximity(spark):
    at = lambda *x: spark.createDataFrame([("f", n) for n in x], "fqn string, line int")
    got = joins.join_line_proximity(at(1, 10), at(5, 20), at(3, 20))
    assert sorted((r.source_line, r.sink_line) for r in got.collect()) == [(10, 5), (10, 20)]


def test_containing_function(spark):
    calls = spark.createDataFrame([("a.py", 1, 5, "a"), ("a.py", 7, 5, "a"), ("a.py", 7, 1, "a"), ("b.py", 2, 3, "b")], "file string, line int, col int, module string")
    fns = spark.createDataFrame([("a.py", 3, "a.f"), ("a.py", 6, "a.g")], "file string, line int, fqn string")
    got = {(r.file, r.line, r.col): r.caller_fqn for r in joins.range_containing_function(calls, fns).collect()}
    assert got == {("a.py", 1, 5): "a", ("a.py", 7, 5): "a.g", ("a.py", 7, 1): "a", ("b.py", 2, 3): "b"}


def test_relative_imports(spark):
    df = spark.createDataFrame([("a.b.c", 1, False, "x"), ("a.b.c", 2, False, "x"), ("a.b", 1, True, "x"), ("a.b.c", 1, False, ""), ("a", 0, False, "x.y"), ("a.b", 2, False, "z")], "m string, l int, p boolean, n string")
    got = [r[0] for r in df.select(joins.absolute_import(F.col("m"), F.col("l"), F.col("p"), F.col("n"))).collect()]
    assert got == ["a.b.x", "a.x", "a.b.x", "a.b", "x.y", "z"]


def test_cascade(spark):
    calls = spark.createDataFrame(
        [("m.C.run", "m.py", "m", t) for t in ("self.save", "super().save", "eval", "os.path.join", "helper", "np.sum", "obj.close", "pkg.lib.go", "User.objects.filter", "nothing", "self.db.query")], "caller_fqn string, file string, module string, target string"
    )
    fns = spark.createDataFrame([("m.C.save",), ("m.B.save",), ("m.helper",), ("numpy.sum",), ("m.Conn.close",), ("lib.go",), ("m.Db.query",)], "fqn string")
    imports = spark.createDataFrame([("m.py", "np", "numpy"), ("m.py", "os", "os")], "file string, alias string, fqn string")
    bindings = spark.createDataFrame([("m.C.run", "obj", "m.Conn", 0.9)], "scope_fqn string, var string, type_fqn string, confidence double")
    attrs = spark.createDataFrame([("m.C", "db", "m.Db")], "class_fqn string, name string, type_fqn string")
    mro = joins.mro_closure(spark.createDataFrame([("m.C", "m.B")], "class_fqn string, base string"))
    reg = spark.createDataFrame([("os.path.join", "stdlib")], "fqn string, kind string")
    got = {r.target: (r.rung, r.resolved_fqn, r.failure_reason) for r in resolution.resolve_call_py(calls, fns, imports, bindings=bindings, class_attributes=attrs, mro=mro, registry=reg).collect()}
    assert got["self.save"] == ("self", "m.C.save", "") and got["super().save"] == ("super", "m.B.save", "") and got["eval"][0] == "builtin" and got["os.path.join"][:2] == ("registry", "os.path.join")
    assert got["helper"][:2] == ("same_module", "m.helper") and got["np.sum"][:2] == ("import", "numpy.sum") and got["obj.close"][:2] == ("variable", "m.Conn.close") and got["pkg.lib.go"][:2] == ("prefix_strip", "lib.go")
    assert got["User.objects.filter"][0] == "orm" and got["nothing"] == (None, None, "not_in_imports") and got["self.db.query"][:2] == ("self_attr", "m.Db.query")


def test_lookups():
    q = symbols.query_resolver
    assert q("self.save()", self_type="m.C") == symbols.Reading("self_call", "m.C.save", 0.95) and q("User().save").name == "User.save" and q("a.b.c") == symbols.Reading("direct_fqn", "a.b.c", 1.0)
    assert q("obj.run", {"obj": "m.T"}).name == "m.T.run" and q("obj.run").confidence == 0.0 and q("??").shape == "unknown"
    s = symbols.Status()
    s.advance("parse", 0.4)
    s.finish()
    assert s.state == "ready" and s.progress == 1.0


def test_dominators_and_paths(spark):
    e = spark.createDataFrame([("f", "m", a, b) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 3), (3, 5), (9, 3))], "file string, fqn string, src int, dst int")
    got = {r.block: r.dominators for r in dataflow.dominators(e).collect()}
    assert got == {0: [0], 1: [0, 1], 2: [0, 2], 3: [0, 3], 4: [0, 3, 4], 5: [0, 3, 5]}
    assert sorted(list(r.path) for r in dataflow.all_paths(e).collect()) == [[0, 1, 3, 5], [0, 2, 3, 5]]
    assert dataflow.all_paths(e, most=1).count() == 1 and dataflow.dominators(e.limit(0)).count() == 0


def test_all_paths_are_whole(spark):
    pairs = [x for i in range(13) for x in ((3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 3), (3 * i + 2, 3 * i + 3))]
    e = spark.createDataFrame([("f", "m", a, b) for a, b in pairs], "file string, fqn string, src int, dst int")
    got = dataflow.all_paths(e).agg(F.count("*").alias("n"), F.countDistinct("path").alias("d"), F.max(F.size("path")).alias("longest")).first()
    assert (got.n, got.d, got.longest) == (8192, 8192, 27)


def test_chains_of_any_length(spark):
    t = spark.createDataFrame([(1, "a(f(g(h(x))))" + ".b()" * 8), (2, "a().b(')')"), (3, None), (4, "a().z()")], "id int, target string")
    returns = spark.createDataFrame([("a", "T", 1.0)], "name string, type_fqn string, confidence double")
    methods = spark.createDataFrame([("T", "b", "T", 0.5)], "type_fqn string, method string, return_type string, confidence double")
    got = {r.id: (r.type_fqn, r.confidence, r.steps) for r in resolution.resolve_chain(t, returns, methods).collect()}
    assert got[1] == ("T", 0.5**8, 9) and set(got) <= {1, 2}
    assert resolution.resolve_chain(t.limit(0), returns, methods).count() == 0


def test_self_attributes_six_deep(spark):
    calls = spark.createDataFrame([("C.run", "self.a.b.c.d.e.f.m")], "caller_fqn string, target string")
    names = "abcdef"
    attrs = spark.createDataFrame([("C" if i == 0 else f"T{i}", x, f"T{i + 1}") for i, x in enumerate(names)], "class_fqn string, name string, type_fqn string")
    assert resolution.resolve_self_attr(calls, attrs, spark.createDataFrame([("T6.m",)], "fqn string")).first().self_fqn == "T6.m"


def test_flows_over_many_calls(spark):
    names = [f"m.f{i:02}" for i in range(23)]
    calls = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "caller string, callee string")
    sums = spark.createDataFrame([(x, x == names[0], False, True, [0], [0]) for x in names], "fqn string, is_source boolean, is_sanitizer boolean, return_tainted boolean, p2ret array<int>, p2sink array<int>")
    at = lambda f, c: spark.createDataFrame([(f, 1, c)], "fqn string, line int, call string")
    local = spark.createDataFrame([], "fqn string, source_line int, source_var string, sink_line int, sink_call string, confidence double")
    got = dataflow.flows_global(at(names[0], "input"), at(names[-1], "execute"), calls, sums, local).collect()
    assert [(r.source_fqn, r.sink_fqn) for r in got] == [(names[0], names[-1])]


def test_enclosing_classes_against_brute_force(spark):
    """Nested, touching and overlapping ranges, ties, members with a class's own range, and a file without classes."""
    import random

    from codelattice.operators.joins import range_containing_class

    rnd = random.Random(6)
    span = lambda: (lambda a: (a, a + rnd.randrange(0, 12)))(rnd.randrange(40))
    classes = [(f"f{i % 3}", *span(), f"C{i}") for i in range(40)]
    members = [(f"f{i % 4}", *span(), i) for i in range(200)] + [("f9", None, None, 500)]
    got = {(r.file, r.start, r.end, r.id): r.class_name for r in range_containing_class(spark.createDataFrame(members, "file string, start int, end int, id int"), spark.createDataFrame(classes, "file string, start int, end int, name string")).collect()}
    for f, s, e, i in members:
        held = [(ce - c, n) for cf, c, ce, n in classes if s is not None and cf == f and c <= s and e <= ce and (c, ce) != (s, e)]
        assert got[f, s, e, i] == (min(held)[1] if held else None)
    assert len(got) == len(set(members))


def test_types_propagate_to_the_end_of_a_chain(spark):
    from codelattice.operators.resolution import propagate_types

    b = spark.createDataFrame([("s", f"v{i}", i, f"var:v{i - 1}" if i else "lib.T", 0.9) for i in range(8)] + [("s", "x", 9, "var:y", 1.0), ("s", "y", 10, "var:x", 1.0)], "scope_fqn string, var string, line int, type_fqn string, confidence double")
    r = spark.createDataFrame([], "fqn string, type_fqn string, confidence double")
    got = {x["var"]: x.type_fqn for x in propagate_types(b, r).collect()}
    assert all(got[f"v{i}"] == "lib.T" for i in range(8)) and got["x"] == "var:y"
    assert {x["var"]: x.type_fqn for x in propagate_types(b, r, passes=2).collect()}["v4"] != "lib.T"


def test_go_chains_by_type(spark):
    from codelattice.operators.resolution import enrich_go_chains

    st = spark.createDataFrame([("f", 5, "db.Query"), ("f", 5, "r.URL.Path"), ("f", 9, "x.Run"), ("f", 2, "x.Run"), ("f", 5, "plain"), ("f", 5, "other.Do"), ("g", 5, None)], "fqn string, line int, call_chain string")
    params = spark.createDataFrame([("f", "r", "*http.Request"), ("f", "db", "*sql.DB")], "fqn string, var string, type_fqn string")
    bound = spark.createDataFrame([("f", "x", 3, "p.A"), ("f", "x", 7, "p.B"), ("f", "db", 1, "p.C")], "fqn string, var string, line int, type_fqn string")
    got = sorted((r.line, r.call_chain or "") for r in enrich_go_chains(st, params, bound).collect())
    assert got == [(2, "x.Run"), (5, ""), (5, "http.Request.URL.Path"), (5, "other.Do"), (5, "plain"), (5, "sql.DB.Query"), (9, "p.B.Run")]


def test_status_of_a_build():
    from codelattice.streaming.incremental import IndexStatus, index_in_background

    status = IndexStatus()
    assert status.report()["state"] == "uninitialized"

    def build(s):
        s.begin("parse", 4)
        s.advance(3)
        assert s.report()["progress"] == 0.75 and s.report()["phase"] == "parse"

    index_in_background(build, status).join()
    assert status.report()["state"] == "ready" and status.report()["progress"] == 1.0
    index_in_background(lambda s: 1 / 0, status).join()
    assert status.report()["state"] == "failed" and "ZeroDivisionError" in status.report()["message"]
