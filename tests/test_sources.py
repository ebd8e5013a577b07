import json
import os

from pyspark.sql import functions as F

from codelattice.functions import scalar
from codelattice.operators import container, flatten, reports
from codelattice.sources import brace_code, container_code, facts, files, python_code, registry, sinks

PY = '''import os as o
from ..pkg import thing

LIMIT = 3

class Base(Protocol):
    pass

@dataclass
class C(Base):
    size: int = 4

    def __init__(self, db: Conn):
        self.db = db
        self.items = []

    @property
    def name(self) -> str:
        return "x"

    async def run(self, q):
        rows = self.db.query(q, limit=5)
        if rows:
            out = o.path.join(rows)
        else:
            return None
        for r in out:
            log.info(r)
        return out
        dead = 1

def f(a: int = g()):
    with open(a) as fh:
        text = fh.read()
    return text
'''


def test_python_facts():
    x = python_code.extract(PY, "m")
    nodes = {n["fqn"]: n["type"] for n in x["nodes"]}
    assert nodes["m.Base"] == "interface" and nodes["m.C"] == "dataclass" and nodes["m.C.__init__"] == "constructor" and nodes["m.C.name"] == "property" and nodes["m.C.run"] == "method" and nodes["m.LIMIT"] == "constant" and nodes["m.C.size"] == "class_field"
    assert {(i["alias"], i["fqn"], i["level"]) for i in x["imports"]} == {("o", "os", 0), ("thing", "pkg.thing", 2)}
    calls = {(c["caller_fqn"], c["target"]) for c in x["call_sites"]}
    assert {("m.C.run", "self.db.query"), ("m.C.run", "o.path.join"), ("m.C.run", "log.info"), ("m.f", "open"), ("m.f", "fh.read"), ("m", "g")} <= calls
    q = next(c for c in x["call_sites"] if c["target"] == "self.db.query")
    assert [a["value"] for a in q["arguments"]] == ["q", "limit=5"] and [a["is_variable"] for a in q["arguments"]] == [True, False]
    run = [s for s in x["statements"] if s["fqn"] == "m.C.run"]
    assert [s["def"] for s in run][:1] == ["rows"] and "dead" not in {s["def"] for s in run}  # code behind a return is left out
    assert {(a["name"], a["type_fqn"]) for a in x["class_attributes"]} >= {("db", "Conn"), ("items", "builtins.list"), ("size", "int")}
    assert any(s["type"] == "with" and s["def"] == "fh" for s in x["statements"])


def test_go_and_java_facts():
    g = brace_code.extract_go('package p\n\nimport (\n\tf "fmt"\n\t"net/http"\n)\n\ntype S struct {\n\tdb *DB\n}\n\nfunc (s *S) Run(q string, n int) (int, error) {\n\trows := s.db.Query(q)\n\t// x := hidden()\n\tf.Println("a(b)", rows)\n\treturn n, nil\n}\n', "p")
    assert {(i["alias"], i["fqn"]) for i in g["imports"]} == {("f", "fmt"), ("http", "net/http")}
    assert {n["fqn"]: n["type"] for n in g["nodes"]} == {"p.S": "struct_definition", "p.S.Run": "method"}
    assert [c["target"] for c in g["call_sites"]] == ["s.db.Query", "f.Println"] and [s["type"] for s in g["statements"]] == ["assignment", "call", "return"]
    j = brace_code.extract_java("package a.b;\nimport java.util.List;\npublic class C extends D {\n  private int n = 3;\n  /** doc */\n  @Override\n  public List<String> run(final String q, int k) throws E {\n    String x = this.db.find(q); // y()\n    return x;\n  }\n  C() { super(); }\n}\n", "m")
    assert {n["fqn"]: n["type"] for n in j["nodes"]} == {"a.b.C": "class_declaration", "a.b.C.n": "variable_declaration", "a.b.C.run": "method_declaration", "a.b.C.C": "method_declaration"}
    assert "this.db.find" in [c["target"] for c in j["call_sites"]] and j["imports"][0]["fqn"] == "java.util.List"


def test_values_are_whole():
    long = "x" * 300
    for got in (python_code.extract(f"v = '{long}'\n", "m"), brace_code.extract_go(f'package p\n\nvar v = "{long}"\n', "p"), brace_code.extract_java(f'package a;\npublic class C {{\n  String v = "{long}";\n}}\n', "m")):
        assert long in next(n["value"] for n in got["nodes"] if n["name"] == "v")


def test_broken_files_give_no_facts(spark):
    df = spark.createDataFrame([("a.py", "a", "def f(:\n"), ("b.py", "b", "x = 1\n"), ("c.py", "c", None), ("d.py", None, "")], "file string, module string, content string")
    got = facts.parsed(df, python_code.extract)
    assert {r.file: r.ok for r in got.collect()} == {"a.py": False, "b.py": True, "c.py": True, "d.py": True}
    assert [r.name for r in facts.table_of(got, "nodes").collect()] == ["x"]
    assert facts.parsed(df.limit(0), python_code.extract).count() == 0


DOCKER = "# c\nFROM a/b:1.2 AS build\nARG V=1\nENV A=1 B=\"x y\"\nRUN apt-get update \\\n  && make\nFROM registry:5000/img\nCOPY --from=build --chown=u:g /a /b\nUSER app:grp\nEXPOSE 80/udp 9000\nUSER root\nCMD [\"x\"]\n"


def test_docker(spark):
    rows = list(container_code.docker_rows(DOCKER))
    assert [r["instruction"] for r in rows] == ["FROM", "ARG", "ENV", "RUN", "FROM", "COPY", "USER", "EXPOSE", "USER", "CMD"]
    assert rows[0]["tag"] == "1.2" and rows[0]["alias"] == "build" and rows[2]["env"] == {"A": "1", "B": "x y"} and rows[4]["image"] == "registry:5000/img" and rows[4]["tag"] == "latest" and rows[5]["copy_from"] == "build" and rows[7]["ports"] == [80, 9000]
    i = container_code.scan_dockerfile(spark.createDataFrame([("D", "dockerfile", DOCKER), ("E", "dockerfile", None)], "file string, lang string, content string"))
    assert container.docker_final_user(i).first().runs_as_root and [(r.stage_index, r.start_line, r.end_line) for r in container.docker_stages(i).orderBy("stage_index").collect()] == [(0, 2, 6), (1, 7, 12)]
    assert container.docker_instruction(i, "expose", port_less_than=100).count() == 1 and container.docker_instruction(i, "FROM", missing_digest=True, image_tag="latest").count() == 1
    assert [r.file for r in container.docker_missing(i.select("file").distinct(), i, "HEALTHCHECK").collect()] == ["D"]
    d = container.dockerfile_details(i).first()
    assert d.base_image == "a/b" and d.stages == 2 and d.multi_stage and not d.has_healthcheck
    from codelattice.operators.traversal import dep_graph_dockerfile

    assert [(r.src, r.dst) for r in dep_graph_dockerfile(i).collect()] == [("stage-1", "build")]


def test_compose(spark):
    text = "version: '3'\nservices:\n  web:\n    image: \"a:1\"\n    privileged: true\n    ports: [\"80:80\"]\n    environment:\n      A: 'b'\n    x-note: 1\n  db:\n    depends_on:\n      - web\nvolumes:\n  d: {}\n"
    rows = {(r["service"], r["prop_key"]): r for r in container_code.compose_rows(text)}
    assert set(rows) == {("web", "image"), ("web", "privileged"), ("web", "ports"), ("web", "environment"), ("db", "depends_on")}
    assert rows["web", "environment"]["prop_items"] == ["A=b"] and rows["web", "privileged"]["scalar_type"] == "boolean" and rows["db", "depends_on"]["prop_items"] == ["web"] and rows["web", "image"]["line"] == 4
    p = spark.createDataFrame([("r", "f", r["service"], r["service_line"], r["prop_key"], r["kind"], r["scalar"], r["scalar_type"], r["prop_items"], r["line"]) for r in rows.values()], "repo string, file_path string, service string, service_line int, prop_key string, kind string, scalar string, scalar_type string, prop_items array<string>, line int")
    assert container.compose_has(p, "privileged", equals=True).count() == 1 and [r.service for r in container.compose_missing(p, "image").collect()] == ["db"]
    assert container.compose_facts(p).where("service = 'web'").first().privileged


def test_files(spark, tmp_path):
    for n in ("a/x.py", "a/__init__.py", "vendor/v.py", "_h/h.py", "Dockerfile.dev", "my-docker-compose.yml", "r.txt", "g/m.go", "t/test_x.py"):
        p = tmp_path / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x = 1\n\xff" if n == "a/x.py" else b"x")
    f = files.scan_files(spark, str(tmp_path))
    assert {r.rel_path: r.lang for r in f.collect()} == {"a/x.py": "python", "a/__init__.py": "python", "Dockerfile.dev": "dockerfile", "my-docker-compose.yml": "compose", "g/m.go": "go", "t/test_x.py": "python"}
    assert {r.module_path for r in files.scan_modules(f, skip_tests=True).collect()} == {"a.x", "a"}
    m = spark.createDataFrame([("go.mod", "module ex.org/p\n\ngo 1.22\n"), ("sub/go.mod", "module ex.org/s\n")], "rel_path string, content string")
    mods = files.scan_go_modules(m)
    g = spark.createDataFrame([("1", "cmd/m.go", "go"), ("2", "sub/in/x.go", "go"), ("3", "y.go", "go")], "file string, rel_path string, lang string")
    assert {r.file: r.import_path for r in files.go_packages(g, mods).collect()} == {"1": "ex.org/p/cmd", "2": "ex.org/s/in", "3": "ex.org/p"}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    L = F.lit
    assert one(scalar.module_path(L("a/b/__init__.py"))) == "a.b" and one(scalar.rel_path(L("/r/a/b"), "/r")) == "a/b" and one(scalar.strip_type_wrappers(L("Optional[int]"))) == "int" and one(scalar.strip_type_wrappers(L("str | None"))) == "str"
    assert one(scalar.normalize_severity(L(" HIGH "))) == "high" and one(scalar.normalize_severity(L(None).cast("string"))) == "medium" and one(scalar.clamp(L(float("nan")))) == 0.0
    assert tuple(one(scalar.image_parts(L("r:5000/a")))) == ("r:5000/a", "latest", "") and tuple(one(scalar.image_parts(L("a@sha256:1")))) == ("a", "", "sha256:1") and tuple(one(scalar.port_parts(L("80/UDP")))) == (80, "udp")
    assert one(registry.infer_literal(L("b'x'"))) == "builtins.bytes" and one(registry.infer_literal(L("f(x)"))) is None and registry.builtin_registry(spark).where("method = 'upper'").count() == 2


FINDING = "finding_id bigint, rule_id string, rule_name string, severity string, cwe string, owasp string, repo string, file_path string, line int, col int, function_fqn string, message string, detection_type string, detection_scope string, confidence double, confidence_label string, source_file string, source_line int, sink_file string, sink_line int, tainted_var string, sink_call string"


def test_exports(spark, tmp_path):
    f = spark.createDataFrame([(1, "R1", "n", "HIGH", "CWE-1,CWE-2", None, "r", "f.py", 3, 1, "m.f", "msg, \"q\"", "flow", "local", 0.9, "high", "f.py", 1, "f.py", 3, "x", "exec"), (2, "R1", "n", "odd", None, None, "r", "f.py", 5, 1, "m.f", None, "pattern", "local", 0.4, None, None, None, None, None, None, None)], FINDING)
    assert sinks.csv_rows(f).columns == list(sinks.CSV_COLUMNS) and sinks.csv_rows(f).where("line = 3").first().cwe == "CWE-1"
    results = [json.loads(r.result) for r in sinks.sarif_results(f).collect()]
    assert sorted(x["level"] for x in results) == ["error", "warning"] and any("codeFlows" in x for x in results)
    assert sinks.sarif_rules(f).first().security_severity == "7.0" and sinks.exit_code(f, ("high",)) == 1 and sinks.exit_code(f, ("low",)) == 0 and sinks.exit_code(f, errors=True) == 2 and sinks.exit_code(f.limit(0), ("high",)) == 0
    assert "HIGH (1)" in sinks.text_report(f) and sinks.pr_comments(f).count() == 1
    sinks.write_csv(f, str(tmp_path / "c"))
    sinks.write_sarif(f, str(tmp_path / "s"))
    sinks.write_json(f, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    src = spark.createDataFrame([("r", "f.py", "a\nb\nc\nd\r\ne")], "repo string, file_path string, source_code string")
    got = sorted((r.finding_id, r.line_no, r.text, r.is_highlight) for r in reports.snippet_context(f, src, 1).collect())
    assert got == [(1, 2, "b", False), (1, 3, "c", True), (1, 4, "d", False), (2, 4, "d", False), (2, 5, "e", True)]
    page, info = reports.paginate(f, ["finding_id"], 1)
    assert [r.finding_id for r in page.collect()] == [1] and info["has_more"] and reports.read_cursor(info["next_cursor"]) == 1 and reports.read_cursor("junk") == 0


def test_changed_files(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("1")
    (tmp_path / "b.py").write_text("1")
    git("add", "-A")
    git("commit", "-qm", "one")
    git("checkout", "-qb", "work")
    (tmp_path / "b.py").write_text("2")
    (tmp_path / "c.py").write_text("1")
    (tmp_path / "a.py").unlink()
    git("add", "-A")
    git("commit", "-qm", "two")
    assert sorted(r.path for r in files.changed_files(spark, str(tmp_path), "main").collect()) == ["b.py", "c.py"]


GO_FLOW = """package p

func f(a int) int {
	x := get()
	if x > 0 {
		y := clean(x)
		use(y)
	} else if y := g(); y {
		return 1
	} else {
		z := h(x)
	}
	for i := 0; i < 3; i++ {
		if i == 2 {
			break
		}
		run(i)
	}
loop:
	for {
		switch v := a.(type) {
		case int:
			work(v)
			fallthrough
		case string:
			break loop
		default:
			continue loop
		}
	}
	return x
	lost(x)
}
"""


def test_go_control_flow():
    got = brace_code.extract_go(GO_FLOW, "p")
    edges = {(e["src"], e["dst"], e["kind"]) for e in got["cfg_edges"]}
    at = {r["line"]: r["block"] for r in got["statements"]}
    assert at[4] == 0 and (0, at[6], "true") in edges and (0, at[8], "false") in edges  # the else's condition stands in the block of the branch not taken
    assert (at[8], at[9], "true") in edges and not any(e[0] == at[9] for e in edges)  # return ends its block
    loop = at[13]
    assert any(e[1] == loop and e[2] == "back" for e in edges) and (loop, next(e[1] for e in edges if e[0] == loop and e[2] == "false"), "false") in edges
    switch = at[21]
    cases = [e[1] for e in sorted(edges) if e[0] == switch and e[2] == "case"]
    assert len(cases) == 3 and (cases[0], cases[1], "next") in edges  # fallthrough
    assert (cases[1], at[31], "jump") in edges and any(e[0] == cases[2] and e[2] == "jump" and (e[1], switch, "true") in edges for e in edges)  # labels
    assert 32 not in at  # never reached
    assert [r["seq"] for r in got["statements"]] == list(range(len(got["statements"])))
    assert {e[0] for e in edges} <= {e[1] for e in edges} | {0}


def test_go_flow_takes_any_text():
    for text in ("func f() {", "func f() { if", "func f() { for { ", "func f() { switch x { case 1", "func f() { if x { } else", "func f() { goto a\n a: b() }", "func f() { x := func() { if a { } }\n y(x) }", "func f() { select { case <-c: default: } }"):
        brace_code.extract_go("package p\n\n" + text, "p")


def test_readable_compose_files():
    good = ["", "a: 1", "services:\n  a:\n    ports: [\"80\", '81']\n    x: {a: b}\n", "a:\n- b\n- c: d\n  e: f\ng: |\n  any: [ text\n  here\nh: >-\n  x\n", "a: long\n  plain text\n  on lines\nb: 1", "# c\n---\na: \"x\n  y\"\n", "a: &m\n  b: 1\nc:\n  <<: *m\n", "[a,\n b]", "- a\n- - b\n  - c\n"]
    bad = ["a: [1, 2", "a: \"x", "a: b: c", "a:\n    b: 1\n  c: 2\n", "a: 1\n<<<<<<< HEAD\nb: 2\n", "a: 1\nplain\n", "a:\n\t- b\n", "a: [1] x\n", "a: 1\n- b\n", "a: @x\n", "a: |x\n  y\n", "a: [1}\n"]
    assert [t for t in good if not container_code.is_readable(t)] == [] and [t for t in bad if container_code.is_readable(t)] == []


def test_whole_reports(spark, tmp_path):
    import json

    rows = [(f"R-{i % 7}", "n", ["high", "low", "INFO", "medium"][i % 4], "", "", "r", f"f{i % 13}.py", i, 1, "m.f", 'say "x"', "pattern", "", 0.5, "", "", 1, "", 2, "v", "s") for i in range(450)]
    names = "rule_id string, rule_name string, severity string, cwe string, owasp string, repo string, file_path string, line int, col int, function_fqn string, message string, detection_type string, detection_scope string, confidence double, confidence_label string, source_file string, source_line int, sink_file string, sink_line int, tainted_var string, sink_call string"
    f = spark.createDataFrame(rows, names).repartition(5)
    assert sinks.text_rows(f).count() == 450
    text = sinks.text_report(f)
    assert "138 more findings are not listed" in text and text.endswith("450 findings") and text.count("\n  f") == 200
    sinks.write_text(f, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 450
    for df, n in ((f, 450), (f.limit(0), 0)):
        doc = json.loads("".join(r.line for r in sinks.json_document(df, "codelattice", "1", ["e"]).orderBy("part").collect()))
        assert len(doc["results"]) == n == doc["summary"]["total"] and doc["errors"] == ["e"] and doc["tool"]["name"] == "codelattice" and doc["scan"]["rules"] == (7 if n else 0)
    cs = spark.createDataFrame([("m.f", "a.b", "lib.a.b", "x.py", 3, 1, True)], "caller_fqn string, target string, target_fqn string, file string, line int, col int, resolved boolean")
    site = json.loads(sinks.call_site_rows(cs).first().site)
    assert site["location"] == {"file": "x.py", "line": 3, "column": 1} and site["resolution"]["resolved"] is True


def test_stored_folders_go(spark):
    from codelattice import session

    df = session.stored(spark.range(10), "gone")
    path = df.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert df.count() == 10 and os.path.isdir(path)
    assert session.discard_stored(spark) >= 1 and not os.path.exists(path) and session.discard_stored(spark) == 0


def test_registry_directories(spark, tmp_path):
    import hashlib
    import json

    good, bad = json.dumps({"module": "os", "functions": {"getcwd": {"return_type": "builtins.str", "confidence": 0.9}}}), json.dumps({"module": "re"})
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "os.json").write_text(good)
    (tmp_path / "m" / "re.json").write_text(bad)
    sha = hashlib.sha256(good.encode()).hexdigest()
    listed = [{"name": "os", "file": "m/os.json", "checksum": f"sha256:{sha}"}, {"name": "re", "file": "m/re.json", "checksum": f"sha256:{sha}"}, {"name": "io", "file": "m/io.json"}]
    (tmp_path / "manifest.json").write_text(json.dumps({"schema_version": "1", "modules": listed}))
    records, problems = registry.scan_registry(spark, str(tmp_path))
    assert [(r.name, r.payload) for r in records.collect()] == [("os", good)] and {(r.name, r.problem) for r in problems.collect()} == {("re", "checksum"), ("io", "missing")}
    nodes = flatten.flatten_records(records, "record_id", "payload")
    assert [tuple(r) for r in registry.registry_functions(nodes, records.withColumnRenamed("name", "module_name"), "module_name").collect()] == [("os", "getcwd", "builtins.str", 0.9)]
