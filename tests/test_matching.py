import pytest
from pyspark.sql import functions as F

from codelattice.operators import logic, matching, typed
from codelattice.operators.matching import Constraint as C

ARG = "array<struct<value:string,is_variable:boolean,position:int>>"
SITES = f"caller_fqn string, line int, col int, target string, target_fqn string, via_type_inference boolean, inferred_type string, type_confidence double, arguments {ARG}"


def args(*values):
    return [(v, v.isidentifier(), i) for i, v in enumerate(values)]


@pytest.fixture(scope="module")
def sites(spark):
    rows = [
        ("app.search", 5, 1, "request.args.get", "flask.request.args.get", True, "flask.Request", 0.9, args("'q'")), ("app.search", 6, 5, "sqlite3.connect", "sqlite3.connect", False, "", 0.0, args("':memory:'", "timeout=5")),
        ("app.search", 8, 5, "cursor.execute", "sqlite3.Cursor.execute", True, "sqlite3.Cursor", 0.9, args("query", "(1, 'x')")), ("app.safe", 15, 5, "request.args.get", "", False, "", 0.0, args()), ("app.other", 3, 9, "os.chmod", "os.chmod", False, None, None, args("path", "0o777", "mode==7")),
        ("app.other", 4, 9, "run", "", False, "", 0.0, args("cmd", "shell=True", "shell=False")), (None, 1, 1, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SITES)


def lines(df):
    return sorted(r.line for r in df.collect())


def test_patterns(sites):
    m = lambda *p: lines(matching.call_matcher(sites, p))
    assert m("run") == [4] and m("*.get") == [5, 15] and m("sqlite3.*") == [6] and m("*args*") == [5, 15] and m("*") == [3, 4, 5, 6, 8, 15]
    assert m("req*get") == []  # a star inside is an ordinary character
    assert lines(matching.call_matcher(sites, ["*.get", "run"])) == [4, 5, 15]


def test_arguments(sites):
    m = lambda **k: lines(matching.call_matcher(sites, ["*"], **k))
    assert m(positional={"0": C(":memory:")}) == [6] and m(positional={"1": C(511)}) == [3] and m(positional={"1": C("0o7*", wildcard=True)}) == [3] and m(positional={"9": C("x")}) == []
    assert m(positional={"1[1]": C("x")}) == [8] and m(positional={"1[0]": C("1")}) == [8] and m(positional={"0[0]": C("cmd")}) == [4]
    assert m(keyword={"timeout": C(5)}) == [6] and m(keyword={"mode": C("=7")}) == [3]
    assert m(keyword={"shell": C(False)}) == [4] and m(keyword={"shell": C(True)}) == []  # the last one counts
    assert m(positional={"0": C(["cmd", "path"])}) == [3, 4]


def test_numbers(spark):
    cases = {"10": 10.0, "0x1f": 31.0, "0o17": 15.0, "017": 15.0, "0b101": 5.0, "-3": -3.0, "1.5": 1.5, "1e3": 1000.0, "x": None, "": None, "1_000": 1000.0}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", matching.number(F.col("v")).alias("n"))
    assert {r.v: r.n for r in df.collect()} == cases


def test_values(spark):
    df = spark.createDataFrame([(x,) for x in ("'a'", '"a"', "'a\"", " a ", "TRUE", "Null", "''", "'", None)], "v string")
    got = [r[0] for r in df.select(matching.normalize_value(matching.clean_value(F.col("v")))).collect()]
    assert got == ["a", "a", "'a\"", "a", "true", "none", "", "'", None]


def test_comparators_only_where_typed(sites):
    a = F.col("arguments")
    t = sites.where(matching.argument_match(a, {"1": C(100, comparator="gt")}, comparators=True, lists=False))
    assert lines(t) == [3]
    assert lines(sites.where(matching.argument_match(a, keyword={"timeout": C(comparator="missing")}, comparators=True) & F.col("line").isin(6, 8))) == [8]
    assert lines(sites.where(matching.argument_match(a, {"0": C(["cmd"])}, lists=False))) == []


def test_variables_and_attributes(sites, spark):
    assert lines(matching.variable_matcher(sites, "*")) == [3, 4, 8]
    s = spark.createDataFrame([(1, "request.form"), (2, "x.request.form"), (3, ""), (4, None)], "line int, attribute_access string")
    assert lines(matching.attribute_matcher(s, ["request.form"])) == [1, 2]


def test_typed_calls(sites):
    t = lambda r, m, **k: sorted((x.line, x.match_method, x.confidence) for x in typed.type_constrained_call(sites, r, m, **k).collect())
    assert t(["sqlite3.Cursor"], ["execute"]) == [(8, "type_inference", 0.9)]
    assert t(["Cursor"], ["execute"]) == [(8, "type_inference", 0.9)]
    assert t(["sqlite3"], ["connect"]) == [(6, "fqn_bridge", 0.7)]
    assert t(["SQLITE3"], ["connect"]) == [(6, "fqn_prefix", 0.7)]
    assert t(["nope.T"], ["get"]) == [] and t(["nope.T"], ["get"], fallback="name") == [(5, "name_fallback", 0.9), (15, "name_fallback", 0.7)]
    assert t(["sqlite3.Cursor"], ["execute"], positional={"0": C("other")}, fallback="name") == []  # a failing argument ends the search


def test_subclasses(sites, spark):
    mro = spark.createDataFrame([("sqlite3.Cursor", "db.Cursor")], "class_fqn string, ancestor string")
    assert [r.line for r in typed.type_constrained_call(sites, ["db.Cursor"], ["execute"], mro=mro).collect()] == [8]


DET = "fqn string, source_line int, source_column int, sink_line int, sink_column int, sink_call string, confidence double, match_method string"


def test_logic(spark):
    a = spark.createDataFrame([("f", 1, 1, 1, 1, "x", 0.5, "call"), ("f", 2, 1, 2, 1, "y", 1.0, "call"), ("f", 2, 1, 2, 1, "y", 1.0, "call")], DET)
    b = spark.createDataFrame([("f", 1, 1, 1, 1, "x", 0.9, "call"), ("g", 2, 1, 2, 1, "y", 1.0, "call")], DET)
    assert sorted((r.fqn, r.source_line, r.confidence) for r in logic.logic_or([a, b]).collect()) == [("f", 1, 0.9), ("f", 2, 1.0), ("g", 2, 1.0)]
    assert [r.source_line for r in logic.logic_and([a, b]).collect()] == [1]
    assert logic.logic_and([a, a]).count() == 3  # repeated rows of the first stay
    cs = spark.createDataFrame([("f", 1, "x"), ("f", 1, "x"), ("f", 2, "y"), ("f", 3, "z")], "caller_fqn string, line int, target string")
    rest = logic.logic_not(cs, a)
    assert [(r.source_line, r.sink_call) for r in rest.collect()] == [(3, "z")] and logic.logic_not(cs, a, compat=True).count() == 3
    none = a.limit(0)
    assert logic.logic_or([none, none]).count() == 0 and logic.logic_not(cs, none).count() == 3


def test_merging(spark):
    f = lambda *x: spark.createDataFrame([(n, v) for n, v in x], "fqn string, v int")
    got = logic.merge_call_graphs({"functions": f(("a", 1), ("b", 1)), "calls": f(("c", 1)), "parameters": f(("p", 1))}, {"functions": f(("b", 2)), "calls": f(("c", 1)), "parameters": f(("q", 1))})
    assert sorted(map(tuple, got["functions"].collect())) == [("a", 1), ("b", 2)] and got["calls"].count() == 2 and got["parameters"].count() == 1
    assert sorted(map(tuple, logic.function_index_delta(f(("a", 1), ("b", 1)), f(("b", 1), ("c", 1))).collect())) == [("a", "added"), ("c", "removed")]
