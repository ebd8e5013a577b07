import pytest
from pyspark.sql import functions as F

from codelattice.rules import api, execute
from codelattice.streaming import incremental

RULES = '''
from codelattice.rules import *

class Cursor(QueryType):
    fqns = ["sqlite3.Cursor"]

@python_rule(id="PY-SQL-001", severity="HIGH", cwe="CWE-89")
def injection():
    """Queries from input."""
    return flows(from_sources=[calls("input")], to_sinks=[Cursor.method("execute").tracks(0)], scope="local")

@rule(id="PY-EVAL-1")
def evals():
    return Or(calls("eval"), calls("exec"))
'''


def test_authoring(tmp_path):
    (tmp_path / "py").mkdir()
    (tmp_path / "py" / "r.py").write_text(RULES)
    (tmp_path / "py" / "none.py").write_text("raise SystemExit")
    got = execute.load_rules(str(tmp_path))
    assert [r.id for r in got] == ["PY-SQL-001", "PY-EVAL-1"] and got[0].severity == "high" and got[0].message == "Queries from input."
    ir = got[0].to_ir()["matcher"]
    assert ir["type"] == "dataflow" and ir["sinks"][0]["receiverTypes"] == ["sqlite3.Cursor"] and ir["sinks"][0]["trackedParams"] == [{"index": 0}]
    assert [r.id for r in execute.load_ruleset(str(tmp_path), "py/PY-EVAL-1")] == ["PY-EVAL-1"]
    with pytest.raises(ValueError):
        execute.load_ruleset(str(tmp_path), "../x")


def test_rule_sets_in_archives(tmp_path):
    import hashlib
    import zipfile

    archive = tmp_path / "r.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("py/r.py", RULES)
    digest, cache = hashlib.sha256(archive.read_bytes()).hexdigest(), str(tmp_path / "c")
    for ttl in (1000, 1000, -1):
        assert [r.id for r in execute.open_ruleset(str(archive), "py/PY-EVAL-1", cache, digest, ttl)] == ["PY-EVAL-1"]
    with pytest.raises(ValueError):
        execute.open_ruleset(str(archive), "py/all", cache, "0" * 64)
    bad = tmp_path / "b.zip"
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../x.py", RULES)
    with pytest.raises(ValueError):
        execute.open_ruleset(str(bad), "py/all", cache)
    assert not (tmp_path / "x.py").exists()


def test_validation():
    bad = [api.Rule("X-1", "x", "low", api.attribute("a")).to_ir(), {"rule": {}, "matcher": {"type": "zzz"}}, {"rule": {"id": "A"}, "matcher": {"type": "dataflow", "sources": [], "sinks": []}}]
    assert [len(execute.validate_ir(x)) for x in bad] == [1, 2, 1]
    for f in (lambda: api.calls(), lambda: api.flows(), lambda: api.flows(api.calls("a"), api.calls("b"), scope="x"), lambda: api.set_default_scope("x")):
        with pytest.raises(ValueError):
            f()


ARG = "array<struct<value:string,is_variable:boolean,position:int>>"


def test_execution(spark):
    cs = spark.createDataFrame([("m.f", 1, 1, "input", "", []), ("m.f", 3, 1, "cur.execute", "sqlite3.Cursor.execute", [("x", True, 0)]), ("m.g", 2, 1, "eval", "", [("'1'", False, 0)])], f"caller_fqn string, line int, col int, target string, target_fqn string, arguments {ARG}")
    cs = cs.withColumns({"via_type_inference": F.lit(False), "inferred_type": F.lit(""), "type_confidence": F.lit(0.0)})
    st = spark.createDataFrame([("m.f", 0, 1, "x", [], "input"), ("m.f", 1, 3, "", ["x"], "cur.execute")], "fqn string, seq int, line int, def string, uses array<string>, call_target string")

    class Cursor(api.QueryType):
        fqns = ("sqlite3.Cursor",)

    notes = execute.Diagnostics()
    rules = [api.Rule("F-1", "f", "high", api.flows(api.calls("input"), Cursor.method("execute").tracks(0), scope="local")), api.Rule("C-1", "c", "high", api.calls("eval")), api.Rule("N-1", "n", "low", ~api.calls("eval")), api.Rule("B-1", "b", "low", api.attribute("x"))]
    got = execute.run_rules([r.to_ir() for r in rules], execute.Program(call_sites=cs, statements=st), diagnostics=notes).collect()
    assert sorted((r.rule_id, r.fqn, r.sink_line) for r in got) == [("C-1", "m.g", 2), ("F-1", "m.f", 3), ("N-1", "m.f", 1), ("N-1", "m.f", 3)]
    assert [m[0] for m in notes.messages] == ["B-1"]
    assert execute.run_rules([], execute.Program(call_sites=cs)).count() == 0


def test_fused_rules_equal_rules_by_themselves(spark):
    """One pass for a set gives what each matcher's own plan gives, repeated rows, null columns and several targets at a place included."""
    import random

    rnd = random.Random(4)
    word = lambda: rnd.choice(["a.x", "a.y", "b.x", "b.y", "c"])
    rows = [("m.f%d" % rnd.randrange(4), rnd.randrange(5), rnd.choice([1, 2, None]), t := word(), "lib." + t, [(rnd.choice(["v", "w", "7"]), rnd.random() < 0.7, i) for i in range(rnd.randrange(3))], rnd.random() < 0.5, rnd.choice(["lib.T", ""]), rnd.random()) for _ in range(400)]
    cs = spark.createDataFrame(rows, f"caller_fqn string, line int, col int, target string, target_fqn string, arguments {ARG}, via_type_inference boolean, inferred_type string, type_confidence double")

    class T(api.QueryType):
        fqns = ("lib.T", "lib.a")

    matchers = [
        api.calls("a.*"), api.calls("b.x", "c", match_position={0: 7}), api.variable("v"), api.variable("*"), T.method("x", "y"), api.calls("a.*") & api.calls("*.x"), api.variable("v") & api.calls("a.*", "c"), api.calls("a.*") & api.variable("w") & api.calls("*.x"),
        api.calls("a.x") | api.variable("v") | api.calls("a.*"), ~api.calls("a.*", "c"), api.Not(api.calls("a.x"), api.variable("v")), ~(api.calls("a.x") & api.calls("b.x")),
    ]
    rules = [api.Rule(f"R-{i}", "r", "low", m).to_ir() for i, m in enumerate(matchers)]
    p = execute.Program(call_sites=cs)
    counts = lambda df: {tuple(r)[:-1]: r["count"] for r in df.groupBy(*execute.FINDING).count().collect()}
    got = counts(execute.run_rules(rules, p))
    want = {}
    for ir in rules:
        want |= counts(execute.detections(ir["matcher"], p).withColumn("rule_id", F.lit(ir["rule"]["id"])))
    assert got == want and {k[0] for k in want} == {r["rule"]["id"] for r in rules}


def test_flows_with_more_than_ten_thousand_targets(spark):
    """A wildcard may stand for any number of names; none are refused or lost, none reach the driver."""
    n = 10_001
    cs = spark.range(n).selectExpr("concat('m.f', id) AS caller_fqn", "1 AS line", "1 AS col", "concat('src.read', id) AS target", "'' AS target_fqn", f"CAST(array() AS {ARG}) AS arguments")
    cs = cs.unionByName(cs.selectExpr("caller_fqn", "2 AS line", "col", "'db.run' AS target", "target_fqn", "arguments"))
    st = spark.range(n).selectExpr("concat('m.f', id) AS fqn", "0 AS seq", "1 AS line", "'x' AS def", "CAST(array() AS array<string>) AS uses", "concat('src.read', id) AS call_target")
    st = st.unionByName(st.selectExpr("fqn", "1 AS seq", "2 AS line", "'' AS def", "array('x') AS uses", "'db.run' AS call_target"))
    notes = execute.Diagnostics()
    rule = api.Rule("F-1", "f", "high", api.flows(api.calls("src.*"), api.calls("db.run"), scope="local")).to_ir()
    assert execute.run_rules([rule], execute.Program(call_sites=cs, statements=st), diagnostics=notes).count() == n and not notes.messages


def test_names_as_lists_and_as_tables_mark_the_same(spark):
    from codelattice.operators import dataflow

    names = ["a", "a.b", "a.b.c", "x.a.b", "b.c", "ab", "a.b(x)", "b", "", "c.a"]
    st = spark.createDataFrame([("f", i, i, "d", [], n, names[-i], names[i - 3]) for i, n in enumerate(names)], "fqn string, seq int, line int, def string, uses array<string>, call_target string, call_chain string, attribute_access string")
    for patterns in (["a"], ["b.c"], ["a.b", "c"], [""], ["zzz"]):
        one, two = dataflow.marked(st, patterns, patterns, patterns), dataflow.marked(st, *[spark.createDataFrame([(p,) for p in patterns], "pattern string")] * 3)
        cols = ["seq", *dataflow.MARKS]
        assert sorted(map(tuple, one.select(*cols).collect())) == sorted(map(tuple, two.select(*cols).collect())), patterns


def test_flat_order_and_lines_are_tried_within_rules(spark):
    cs = spark.createDataFrame([("m.g", 1, 1, "input", "", []), ("m.g", 5, 1, "run", "", [])], f"caller_fqn string, line int, col int, target string, target_fqn string, arguments {ARG}")
    st = spark.createDataFrame([("m.f", 1, 0, 1, "x", [], "input"), ("m.f", 0, 1, 3, "", ["x"], "other"), ("m.f", 2, 2, 4, "", ["x"], "run")], "fqn string, seq int, flat_seq int, line int, def string, uses array<string>, call_target string")
    rule = api.Rule("F-1", "f", "high", api.flows(api.calls("input"), api.calls("run"), scope="local")).to_ir()
    got = {(r.fqn, r.confidence) for r in execute.run_rules([rule], execute.Program(call_sites=cs, statements=st)).collect()}
    assert got == {("m.f", 0.95), ("m.g", 0.5)}


def test_tracked_parameters_by_sink(spark):
    """The logical form of tracked parameters, and each sink's own: what one rejects another on its line may take."""
    import json

    assert [api.calls("s").tracks(0, "q", "return").to_ir()["trackedParams"]] == [[{"index": 0}, {"name": "q"}, {"return": True}]]
    assert api.calls("s").tracks({"index": 2}).to_ir()["trackedParams"] == [{"index": 2}]
    sites = [("m.f", 1, "input", []), ("m.f", 2, "run", [("k", True, 0), ("x", True, 1)]), ("m.f", 3, "save", [("q=x", False, 0)]), ("m.f", 4, "run", [("x", True, 0)]), ("m.f", 4, "save", [("k", True, 0)])]
    cs = spark.createDataFrame([(f, n, 1, t, "", a) for f, n, t, a in sites], f"caller_fqn string, line int, col int, target string, target_fqn string, arguments {ARG}")
    st = spark.createDataFrame([("m.f", i, n, "x" if t == "input" else "", [] if t == "input" else ["x"], t) for i, (_, n, t, _) in enumerate(sites)], "fqn string, seq int, line int, def string, uses array<string>, call_target string")
    p = execute.Program(call_sites=cs, statements=st)

    def lines(*sinks):
        ir = json.loads(json.dumps(api.Rule("F-1", "f", "high", api.flows(api.calls("input"), list(sinks), scope="local")).to_ir()))
        return sorted({r.sink_line for r in execute.run_rules([ir], p).collect()})

    assert lines(api.calls("run"), api.calls("save")) == [2, 3, 4]
    assert lines(api.calls("run").tracks(0), api.calls("save").tracks("q")) == [3, 4]
    assert lines(api.calls("run").tracks(1), api.calls("save").tracks("z")) == [2]
    assert lines(api.calls("run").tracks("return")) == [2, 4]


def test_custom_checks_run(spark):
    from codelattice.sources import container_code

    files = spark.createDataFrame([("a/Dockerfile", "dockerfile", "FROM x AS b\nUSER root\nFROM y\nCOPY --from=b . .\n"), ("b/Dockerfile", "dockerfile", "FROM x\nUSER app\n")], "file string, lang string, content string")
    p = execute.Program(instructions=container_code.scan_dockerfile(files))

    def check(d):
        return d.is_running_as_root() and d.is_multi_stage() and d.has_instruction("COPY") and d.get_stage_by_alias("b") is not None

    rule = api.Rule("D-1", "d", "high", api.custom_check(check, "root"), "dockerfile").to_ir()
    assert [(r.file, r.line, r.detail) for r in execute.run_container_rules([rule], p, strict=True).collect()] == [("a/Dockerfile", 1, "root")]
    assert execute.run_container_rules([rule], p).count() == 0
    import json

    notes = execute.Diagnostics()
    assert execute.run_container_rules([json.loads(json.dumps(rule))], p, strict=True, diagnostics=notes).count() == 0 and notes.messages


def test_tracked_parameter_that_is_not_tainted(spark):
    cs = spark.createDataFrame([("m.f", 3, "execute", [("q", True, 0), ("x", True, 1)])], f"caller_fqn string, line int, target string, arguments {ARG}")
    fl = spark.createDataFrame([("m.f", 3, "x"), ("m.h", 9, "x")], "fqn string, sink_line int, sink_var string")
    from codelattice.operators.dataflow import tracked_params

    assert sorted(r.fqn for r in tracked_params(fl, cs, indices=(0,)).collect()) == ["m.h"]
    assert sorted(r.fqn for r in tracked_params(fl, cs, indices=(1,)).collect()) == ["m.f", "m.h"]


def test_incremental(spark, tmp_path):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "file string, sha256 string")
    cache = spark.createDataFrame([("a", "1"), ("b", "x")], "file string, sha256 string")
    assert sorted(r.file for r in incremental.changed(files, cache).collect()) == ["b", "c"]
    assert incremental.cache_valid({"root": "/r", "t": "1"}, "/r", {"t": "1", "u": "1"}) == {"t": True, "u": False} and not any(incremental.cache_valid({"root": "/q", "t": "1"}, "/r", {"t": "1"}).values())


def test_stream_parses_changed_files_only(spark, tmp_path):
    src, index, cp = (str(tmp_path / x) for x in ("src", "index", "cp"))
    schema = "file string, content string"
    seen = []

    def parse(df):
        seen.append(df.count())
        return df.select("file", "sha256", F.length("content").alias("n"))

    spark.createDataFrame([("a", "x"), ("b", "yy")], schema).coalesce(1).write.parquet(src)
    incremental.index_stream(spark, src, schema, index, cp, parse).awaitTermination()
    spark.createDataFrame([("a", "x"), ("b", "changed"), ("c", None)], schema).coalesce(1).write.mode("append").parquet(src)
    incremental.index_stream(spark, src, schema, index, cp, parse).awaitTermination()
    assert seen == [2, 2]
    now = incremental.current_index(spark.read.parquet(index))
    assert {(r.file, r.n) for r in now.collect()} == {("a", 1), ("b", 7), ("c", None)}
