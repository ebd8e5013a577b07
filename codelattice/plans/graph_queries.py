"""Queries of the reference's matchers, joins, traversals and dataflow over the views, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.operators import dataflow, joins, logic, matching, resolution, traversal, typed
from codelattice.operators.matching import Constraint
from codelattice.plans import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return register


_CS, _ST, _FN, _ED, _MO = v.ctes(v.CALL_SITES), v.ctes(v.STATEMENTS), v.ctes(v.FUNCTIONS), v.ctes(v.EDGES), v.ctes(v.FUNCTIONS, v.MODULES)
_CF = v.ctes(v.CALL_SITES, v.FUNCTIONS)
_SITE = ("caller_fqn", "seq", "line", "target")
SOURCES, SINKS, SANITIZERS = ("signup",), ("purchase",), ("error",)

# Matchers


@query(_CS + "SELECT caller_fqn, seq, line, target FROM fx_call_sites WHERE target LIKE 'promo.%' AND arg0 = '40'")
def call_matcher(s, d):
    return matching.call_matcher(v.call_sites(s, d), ["promo.*"], {"0": Constraint(40)}).select(*_SITE)


@query(_CS + "SELECT caller_fqn, seq, line, target FROM fx_call_sites WHERE target IN ('promo.red_plate', 'large.hot_ring')")
def call_matcher_exact(s, d):
    return matching.call_matcher(v.call_sites(s, d), ["promo.red_plate", "large.hot_ring"]).select(*_SITE)


@query(_CS + "SELECT target, starts_with(target, 'promo.') AS prefix, ends_with(target, '_ring') AS suffix, contains(target, 'widget') AS part, target = 'small.red_rod' AS exact, count(*) AS n FROM fx_call_sites GROUP BY ALL")
def pattern_match(s, d):
    t = F.col("target")
    tests = {"prefix": ["promo.*"], "suffix": ["*_ring"], "part": ["*widget*"], "exact": ["small.red_rod"]}
    return v.call_sites(s, d).select("target", *(matching.pattern_match(t, p).alias(k) for k, p in tests.items())).groupBy("target", *tests).agg(F.count("*").alias("n"))


@query(_CS + "SELECT caller_fqn, seq, line, target FROM fx_call_sites WHERE arg0 IN ('1', '2', '3') AND ends_with(target, '_plate')")
def arg_value_or(s, d):
    return matching.call_matcher(v.call_sites(s, d), ["*_plate"], {"0": Constraint(["1", "2", 3])}).select(*_SITE)


@query(_CS + "SELECT caller_fqn, seq, line, target FROM fx_call_sites WHERE arg1 = 'status=O' AND starts_with(target, 'small.')")
def arg_keyword(s, d):
    return matching.call_matcher(v.call_sites(s, d), ["small.*"], keyword={"status": Constraint("O")}).select(*_SITE)


@query(_CS + "SELECT caller_fqn, seq, line, target FROM fx_call_sites WHERE regexp_full_match(arg0, '4.') AND starts_with(target, 'medium.')")
def wildcard_match(s, d):
    return matching.call_matcher(v.call_sites(s, d), ["medium.*"], {"0": Constraint("4?", wildcard=True)}).select(*_SITE)


@query("SELECT c_custkey, CASE WHEN lower(x) IN ('true', 'false') THEN lower(x) WHEN lower(x) IN ('none', 'null', 'nil') THEN 'none' ELSE x END AS normal FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'Nil' WHEN 2 THEN 'False' ELSE c_name END AS x FROM customer)")
def normalize_value(s, d):
    raw = F.when(F.col("c_custkey") % 5 == 0, "\"TRUE\"").when(F.col("c_custkey") % 5 == 1, " 'Nil' ").when(F.col("c_custkey") % 5 == 2, "False").otherwise(F.col("c_name"))
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", matching.normalize_value(matching.clean_value(raw)).alias("normal"))


@query("SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) AS n FROM supplier")
def arg_number(s, d):
    k = F.col("s_suppkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("0x"), F.lower(F.hex(k)))).when(k % 4 == 1, F.concat(F.lit("0o"), F.conv(k, 10, 8))).when(k % 4 == 2, F.concat(F.lit("0b"), F.bin(k))).otherwise(F.concat(k.cast("string"), F.lit(".0")))
    return s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", matching.number(text).alias("n"))


@query("SELECT o_orderkey, o_orderstatus = 'F' AS is_true, o_orderstatus = 'O' AS is_null FROM orders")
def arg_bool_null(s, d):
    raw = F.when(F.col("o_orderstatus") == "F", "True").when(F.col("o_orderstatus") == "O", "None").otherwise("0")
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", matching.value_match(raw, Constraint(True)).alias("is_true"), matching.value_match(raw, Constraint(None)).alias("is_null"))


@query("SELECT s_suppkey, CAST(s_nationkey AS STRING) = '7' AS second, s_suppkey % 2 = 0 AS first_even FROM supplier")
def arg_positional(s, d):
    host = F.concat(F.lit("('h"), (F.col("s_suppkey") % 2).cast("string"), F.lit("', "), F.col("s_nationkey").cast("string"), F.lit(")"))
    args = F.array(F.struct(host.alias("value"), F.lit(False).alias("is_variable"), F.lit(0).alias("position")))
    return s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", matching.argument_match(args, {"0[1]": Constraint("7")}).alias("second"), matching.argument_match(args, {"0[0]": Constraint("h0")}).alias("first_even"))


@query(_CS + "SELECT caller_fqn, seq, CAST(arg0 AS DOUBLE) < 10 AS lt10, CAST(arg0 AS DOUBLE) >= 45 AS gte45, regexp_matches(arg0, '^1') AS re, true AS absent FROM fx_call_sites WHERE ends_with(target, '_ring')")
def comparators(s, d):
    a = F.col("arguments")
    m = lambda c: matching.argument_match(a, {"0": c}, lists=False, comparators=True)
    return v.call_sites(s, d).where(F.endswith("target", F.lit("_ring"))).select("caller_fqn", "seq", m(Constraint(10, comparator="lt")).alias("lt10"), m(Constraint(45, comparator="gte")).alias("gte45"), m(Constraint("^1", comparator="regex")).alias("re"), matching.argument_match(a, keyword={"timeout": Constraint(comparator="missing")}, comparators=True).alias("absent"))


@query(_CS + "SELECT caller_fqn, seq, line, target, arg2 AS tainted_var FROM fx_call_sites WHERE arg2 = 'v3'")
def variable_matcher(s, d):
    return matching.variable_matcher(v.call_sites(s, d), "v3").select(*_SITE, "tainted_var")


@query(_ST + "SELECT fqn, seq, attribute_access FROM fx_statements WHERE attribute_access IN ('request.signup') OR ends_with(attribute_access, '.error')")
def attribute_matcher(s, d):
    return matching.attribute_matcher(v.statements(s, d), ["request.signup", "error"]).select("fqn", "seq", "attribute_access")


@query(_CS + "SELECT target, count(*) AS n FROM fx_call_sites WHERE split_part(target, '.', -1) = 'hot_rod' OR starts_with(target, 'economy.') GROUP BY target")
def name_pattern(s, d):
    return v.call_sites(s, d).where(matching.name_pattern(F.col("target"), ["hot_rod", "economy"])).groupBy("target").agg(F.count("*").alias("n"))


@query(_CS + "SELECT 'R1' AS rule_id, caller_fqn, seq FROM fx_call_sites WHERE starts_with(target, 'promo.') UNION ALL SELECT 'R2', caller_fqn, seq FROM fx_call_sites WHERE ends_with(target, '_ring') UNION ALL SELECT 'R3', caller_fqn, seq FROM fx_call_sites WHERE arg0 = '7'")
def match_rules(s, d):
    t = F.col("target")
    rules = {"R1": matching.pattern_match(t, ["promo.*"]), "R2": matching.pattern_match(t, ["*_ring"]), "R3": matching.argument_match(F.col("arguments"), {"0": Constraint("7")})}
    return matching.match_rules(v.call_sites(s, d), rules).select("rule_id", "caller_fqn", "seq")


# Typed matchers

_TYPED = """SELECT caller_fqn, seq, target, CASE WHEN via_type_inference AND CAST(type_confidence AS FLOAT) >= 0.5 AND inferred_type = 'lib.Brand_3' THEN 'type_inference'
  WHEN target_fqn = concat('lib.', target) AND regexp_replace(target_fqn, '\\.[^.]*$', '') = 'lib.promo' THEN 'fqn_bridge' END AS match_method,
  CASE WHEN least(1.0, greatest(0.0, type_confidence)) = 0 THEN 0.7 ELSE least(1.0, greatest(0.0, type_confidence)) END AS confidence
FROM fx_call_sites WHERE split_part(target, '.', -1) IN ('hot_rod', 'red_ring', 'small_plate')"""


@query(_CS + f"SELECT * FROM ({_TYPED}) WHERE match_method IS NOT NULL")
def type_constrained_call(s, d):
    return typed.type_constrained_call(v.call_sites(s, d), ["lib.Brand_3", "lib.promo"], ["hot_rod", "red_ring", "small_plate"]).select("caller_fqn", "seq", "target", "match_method", "confidence")


@query(_CS + "SELECT inferred_type, inferred_type = 'lib.Brand_3' AS exact, ends_with(inferred_type, '.Brand_5') AS short, starts_with(inferred_type, 'lib.Brand_1') AS wild, count(*) AS n FROM fx_call_sites GROUP BY ALL")
def receiver_type_match(s, d):
    t = F.col("inferred_type")
    return v.call_sites(s, d).groupBy("inferred_type", typed.receiver_matches(t, "lib.Brand_3").alias("exact"), typed.receiver_matches(t, "Brand_5").alias("short"), typed.receiver_matches(t, "lib.Brand_1*").alias("wild")).agg(F.count("*").alias("n"))


@query(_CS + "SELECT target, regexp_replace(target_fqn, '\\.[^.]*$', '') AS receiver, count(*) AS n FROM fx_call_sites GROUP BY ALL")
def fqn_bridge(s, d):
    return v.call_sites(s, d).groupBy("target", typed.fqn_bridge(F.col("target_fqn"), F.col("target")).alias("receiver")).agg(F.count("*").alias("n"))


@query(_ST + "SELECT fqn, line, 0.85 AS confidence FROM fx_statements WHERE call_chain = 'lib.Session.purchase' AND NOT (fqn LIKE '%7' AND line % 2 = 0)")
def typed_statement_scan(s, d):
    st = v.statements(s, d)
    seen = st.where("fqn LIKE '%7' AND line % 2 = 0").select(F.col("fqn").alias("caller_fqn"), "line")
    return typed.typed_statement_scan(st, ["lib.Session"], ["purchase"], seen).select("fqn", "line", "confidence")


@query(v.ctes(v.CALL_SITES, v.STATEMENTS) + "SELECT caller_fqn AS fqn, line, target AS access, 'type_inference' AS match_method FROM fx_call_sites WHERE ends_with(target, '.hot_rod') AND via_type_inference AND CAST(type_confidence AS FLOAT) >= 0.5 AND inferred_type = 'lib.Brand_3' UNION ALL SELECT fqn, line, attribute_access, 'statement_attribute' FROM fx_statements WHERE attribute_access = 'lib.Brand_3.hot_rod'")
def type_constrained_attribute(s, d):
    return typed.type_constrained_attribute(v.call_sites(s, d), v.statements(s, d), ["lib.Brand_3"], "hot_rod").drop("confidence")


@query(_ST + "SELECT fqn, line, attribute_access AS access, 'statement_attribute' AS match_method FROM fx_statements WHERE attribute_access = 'request.error'")
def typed_attributes(s, d):
    """Attribute reads of a typed receiver, from statements."""
    return typed.type_constrained_attribute(v.call_sites(s, d), v.statements(s, d), ["request"], "error").drop("confidence")


@query("SELECT p_partkey, 'base.' || p_type AS ancestor FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def mro_subclass(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("app.C"), F.col("p_partkey").cast("string")).alias("class_fqn"), F.concat(F.lit("base."), "p_type").alias("base"))
    tops = s.createDataFrame([("base.PROMO", "root.Sale"), ("base.SMALL", "root.Sale"), ("base.LARGE", "root.Bulk")], "class_fqn string, base string")
    mro = joins.mro_closure(p.select("base").distinct().select(F.col("base").alias("class_fqn")).join(tops, "class_fqn"), 5)
    hits = mro.where("ancestor = 'root.Sale' AND depth > 0").select(F.col("class_fqn").alias("ancestor"))
    return p.select("p_partkey", F.col("base").alias("ancestor")).join(hits, "ancestor", "left_semi").select("p_partkey", "ancestor")


# Combinators


def _detections(s, d, prefix: str, sure: float, method: str = "call") -> DataFrame:
    c = matching.call_matcher(v.call_sites(s, d), [prefix])
    return c.select(F.col("caller_fqn").alias("fqn"), F.col("line").alias("source_line"), F.col("col").alias("source_column"), F.col("line").alias("sink_line"), F.col("col").alias("sink_column"), F.col("target").alias("sink_call"), F.lit(sure).alias("confidence"), F.lit(method).alias("match_method"))


_DET = "SELECT caller_fqn AS fqn, line AS source_line, col AS source_column, line AS sink_line, col AS sink_column, target AS sink_call, {c} AS confidence, 'call' AS match_method FROM fx_call_sites WHERE {w}"


@query(_CS + f"SELECT fqn, source_line, source_column, sink_line, sink_column, sink_call, match_method, max(confidence) AS confidence FROM ({_DET.format(c=0.6, w=chr(39).join(['starts_with(target, ', 'promo.', ')']))} UNION ALL {_DET.format(c=0.9, w=chr(39).join(['ends_with(target, ', '_ring', ')']))}) GROUP BY ALL")
def logic_or(s, d):
    return logic.logic_or([_detections(s, d, "promo.*", 0.6), _detections(s, d, "*_ring", 0.9)])


@query(_CS + f"SELECT a.* FROM ({_DET.format(c=1.0, w=chr(39).join(['starts_with(target, ', 'promo.', ')']))}) a WHERE EXISTS (SELECT 1 FROM fx_call_sites b WHERE ends_with(b.target, '_ring') AND b.caller_fqn = a.fqn AND b.line = a.source_line AND b.col = a.source_column)")
def logic_and(s, d):
    return logic.logic_and([_detections(s, d, "promo.*", 1.0), _detections(s, d, "*_ring", 1.0)])


@query(_CS + "SELECT DISTINCT caller_fqn AS fqn, line AS source_line, target AS sink_call, 1.0 AS confidence, 'logic_not' AS match_method FROM fx_call_sites WHERE NOT starts_with(target, 'promo.')")
def logic_not(s, d):
    return logic.logic_not(v.call_sites(s, d), _detections(s, d, "promo.*", 1.0))


@query(_CS + "SELECT caller_fqn, max(type_confidence) AS type_confidence FROM fx_call_sites GROUP BY caller_fqn")
def dedup_best(s, d):
    return logic.dedup_best(v.call_sites(s, d).select("caller_fqn", "type_confidence", "target"), ["caller_fqn"], "type_confidence").select("caller_fqn", "type_confidence")


@query(_FN + "SELECT fqn, language FROM fx_functions WHERE language = 'go' UNION ALL SELECT fqn, language FROM fx_functions WHERE language = 'python' AND line % 3 = 0")
def merge_call_graphs(s, d):
    f = v.functions(s, d).select("fqn", "language")
    base = v.functions(s, d).where("language = 'go' OR line % 3 = 0").select("fqn", "language")
    return logic.merge_call_graphs({"functions": base}, {"functions": f.where("language = 'go'")})["functions"]


@query(_FN + "SELECT fqn, CASE WHEN line % 7 = 0 THEN 'added' ELSE 'removed' END AS change FROM fx_functions WHERE line % 7 = 0 OR line % 7 = 1")
def function_index_delta(s, d):
    f = v.functions(s, d)
    return logic.function_index_delta(f.where("line % 7 <> 1"), f.where("line % 7 <> 0"))


# Joins


@query(_CF + "SELECT c.caller_fqn, c.seq, f.line AS target_line FROM fx_call_sites c LEFT JOIN (SELECT fqn, line FROM fx_functions WHERE line % 2 = 0) f ON f.fqn = c.caller_fqn")
def join_call_function(s, d):
    c = v.call_sites(s, d).select("caller_fqn", "seq", F.col("caller_fqn").alias("target_fqn"))
    return joins.join_call_function(c, v.functions(s, d).where("line % 2 = 0")).select("caller_fqn", "seq", "target_line")


@query(_ST + "SELECT DISTINCT fqn FROM fx_statements WHERE call_target = 'signup' INTERSECT SELECT fqn FROM fx_statements WHERE call_target = 'purchase'")
def join_sources_sinks(s, d):
    st = v.statements(s, d)
    return joins.join_sources_sinks(st.where("call_target = 'signup'"), st.where("call_target = 'purchase'"))


@query(_CF + "SELECT c.caller_fqn, c.seq FROM fx_call_sites c WHERE EXISTS (SELECT 1 FROM fx_functions f WHERE f.fqn = c.caller_fqn AND f.language = 'go')")
def language_filter(s, d):
    return joins.language_filter(v.call_sites(s, d).select("caller_fqn", "seq"), v.functions(s, d), "go", "caller_fqn")


@query(_FN + "SELECT fqn FROM fx_functions WHERE fqn = 'app.m7' OR starts_with(fqn, 'app.m7.')")
def module_filter(s, d):
    return v.functions(s, d).where(joins.module_filter(F.col("fqn"), "app.m7")).select("fqn")


@query("SELECT finding_id, file_path FROM findings WHERE file_path IN (SELECT file_path FROM source_files WHERE committed_at >= TIMESTAMP '2024-07-01')")
def diff_filter(s, d):
    changed = s.read.parquet(f"{d}/source_files.parquet").where("committed_at >= TIMESTAMP '2024-07-01 00:00:00'").select(F.col("file_path").alias("path"))
    return joins.diff_filter(s.read.parquet(f"{d}/findings.parquet").select("finding_id", "file_path"), changed, "file_path")


@query(_ST + "SELECT s.fqn, s.line AS source_line, k.line AS sink_line, 0.5 AS confidence FROM fx_statements s JOIN fx_statements k ON s.fqn = k.fqn WHERE s.call_target = 'signup' AND k.call_target = 'purchase' AND NOT EXISTS (SELECT 1 FROM fx_statements z WHERE z.fqn = s.fqn AND z.call_target = 'error' AND ((z.line > s.line AND z.line < k.line) OR (z.line > k.line AND z.line < s.line)))")
def join_line_proximity(s, d):
    st = v.statements(s, d)
    return joins.join_line_proximity(*(st.where(F.col("call_target") == t) for t in ("signup", "purchase", "error")))


@query(_ST + "SELECT u.fqn, u.use_var AS var, u.line, max(x.line) AS def_line FROM fx_statements u LEFT JOIN fx_statements x ON x.fqn = u.fqn AND x.def = u.use_var AND x.line <= u.line GROUP BY ALL")
def asof_latest_def(s, d):
    st = v.statements(s, d)
    return joins.asof_latest_def(st.select("fqn", F.col("use_var").alias("var"), "line"), st.select("fqn", F.col("def").alias("var"), "line"))


@query(_ST + "SELECT u.fqn, u.use_var AS var, max(x.seq) AS from_seq, u.seq AS to_seq FROM fx_statements u JOIN fx_statements x ON x.fqn = u.fqn AND x.def = u.use_var AND x.seq < u.seq GROUP BY u.fqn, u.use_var, u.seq")
def build_edge_latest_def(s, d):
    return joins.build_edge_latest_def(v.statements(s, d))


@query(_CF + """, calls AS (SELECT DISTINCT file, line * 50 AS line, col, module FROM fx_call_sites), best AS (SELECT c.file, c.line, c.col, c.module, max(f.line) AS fl FROM calls c LEFT JOIN fx_functions f ON f.file = c.file AND f.line <= c.line GROUP BY ALL)
SELECT b.file, b.line, b.col, CASE WHEN b.col = 1 OR b.fl IS NULL THEN b.module ELSE (SELECT max(f.fqn) FROM fx_functions f WHERE f.file = b.file AND f.line = b.fl) END AS caller_fqn FROM best b""")
def range_containing_function(s, d):
    calls = v.call_sites(s, d).select("file", (F.col("line") * 50).alias("line"), "col", "module").distinct()
    return joins.range_containing_function(calls, v.functions(s, d).select("file", "line", "fqn")).select("file", "line", "col", "caller_fqn")


_MEMBERS = "members AS (SELECT CAST(o_orderkey % 200 AS STRING) AS file, o_orderkey AS id, CAST(o_custkey % 1000 AS INT) AS a, CAST(o_custkey % 1000 AS INT) + 5 AS b FROM orders), classes AS (SELECT CAST(c_custkey % 200 AS STRING) AS file, c_name AS name, CAST(c_custkey % 700 AS INT) AS s, CAST(c_custkey % 700 AS INT) + 100 + c_nationkey * 10 AS e FROM customer)"


@query(f"WITH {_MEMBERS} SELECT m.id, arg_min(c.name, {{'w': c.e - c.s, 'n': c.name}}) AS class_name FROM members m LEFT JOIN classes c ON c.file = m.file AND c.s <= m.a AND m.b <= c.e GROUP BY m.id, m.a, m.b, m.file")
def range_containing_class(s, d):
    o, c = s.read.parquet(f"{d}/orders.parquet"), s.read.parquet(f"{d}/customer.parquet")
    m = o.select((F.col("o_orderkey") % 200).cast("string").alias("file"), (F.col("o_custkey") % 1000).cast("int").alias("start"), ((F.col("o_custkey") % 1000) + 5).cast("int").alias("end"), F.col("o_orderkey").alias("id"))
    k = c.select((F.col("c_custkey") % 200).cast("string").alias("file"), (F.col("c_custkey") % 700).cast("int").alias("start"), ((F.col("c_custkey") % 700) + 100 + F.col("c_nationkey") * 10).cast("int").alias("end"), F.col("c_name").alias("name"))
    return joins.range_containing_class(m, k).select("id", "class_name")


_IMPORTS = "imports AS (SELECT DISTINCT file, lower(p_type) AS alias, 'lib.' || lower(p_type) AS fqn FROM (SELECT DISTINCT file FROM fx_call_sites) CROSS JOIN (SELECT DISTINCT p_type FROM part) WHERE (length(file) + length(p_type)) % 2 = 0)"


def _imports(s, d) -> DataFrame:
    kinds = s.read.parquet(f"{d}/part.parquet").select(F.lower("p_type").alias("alias")).distinct()
    files = v.call_sites(s, d).select("file").distinct()
    return files.crossJoin(F.broadcast(kinds)).where((F.length("file") + F.length("alias")) % 2 == 0).select("file", "alias", F.concat(F.lit("lib."), "alias").alias("fqn"))  # six kinds


@query(_CS + f", {_IMPORTS} SELECT c.caller_fqn, c.seq, i.fqn || substr(c.target, length(i.alias) + 1) AS import_fqn FROM fx_call_sites c LEFT JOIN imports i ON i.file = c.file AND i.alias = split_part(c.target, '.', 1)")
def resolve_imports(s, d):
    return joins.resolve_imports(v.call_sites(s, d), _imports(s, d)).select("caller_fqn", "seq", "import_fqn")


_STRIP = _CS + ", names AS (SELECT DISTINCT 'pkg.app.' || target AS fqn FROM fx_call_sites), known AS (SELECT DISTINCT target AS fqn FROM fx_call_sites WHERE ends_with(target, 'ring'))"


@query(_STRIP + " SELECT n.fqn, k.fqn AS resolved_fqn, CASE WHEN k.fqn IS NULL THEN NULL ELSE 2 END AS stripped FROM names n LEFT JOIN known k ON n.fqn = 'pkg.app.' || k.fqn")
def resolve_prefix_strip(s, d):
    t = v.call_sites(s, d).select("target").distinct()
    return joins.resolve_prefix_strip(t.select(F.concat(F.lit("pkg.app."), "target").alias("fqn")), t.where(F.endswith("target", F.lit("ring"))).select(F.col("target").alias("fqn")))


@query(_MO + "SELECT DISTINCT fqn FROM (SELECT fqn FROM fx_functions UNION ALL SELECT fqn || '.x' FROM fx_functions UNION ALL SELECT fqn || '.x.y' FROM fx_functions) WHERE (length(fqn) - length(replace(fqn, '.', ''))) <= 3")
def validate_fqn(s, d):
    f = v.functions(s, d).select("fqn")
    names = f.unionByName(f.select(F.concat("fqn", F.lit(".x")).alias("fqn"))).unionByName(f.select(F.concat("fqn", F.lit(".x.y")).alias("fqn")))
    return joins.validate_fqn(names, v.modules(s, d))


# Traversal

_START = "SELECT p_partkey AS node FROM part WHERE p_partkey IN (150, 151, 177)"


@query(_ED + f", r(node, depth) AS ({_START.replace('AS node', 'AS node, 0 AS depth')} UNION ALL SELECT e.dst, r.depth + 1 FROM r JOIN fx_edges e ON e.src = r.node WHERE r.depth < 5) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def reachable(s, d):
    start = s.read.parquet(f"{d}/part.parquet").where("p_partkey IN (150, 151, 177)").select(F.col("p_partkey").alias("node"))
    return traversal.reachable(v.edges(s, d), start, 5)


@query(_ED + ", r(node, depth) AS (SELECT CAST(150 AS BIGINT), 0 UNION ALL SELECT e.dst, r.depth + 1 FROM r JOIN fx_edges e ON e.src = r.node WHERE r.depth < 5) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def reachable_sql(s, d):
    return traversal.reachable_sql(v.edges(s, d), "CAST(150 AS BIGINT)", 5)


@query(_ED + ", r(node, depth) AS (SELECT CAST(3 AS BIGINT), 0 UNION ALL SELECT e.src, r.depth + 1 FROM r JOIN fx_edges e ON e.dst = r.node WHERE r.depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def transitive_callers(s, d):
    return traversal.transitive_callers(v.edges(s, d), s.createDataFrame([(3,)], "node bigint"), 3)


@query(_ED + ", r(root, node, path) AS (SELECT p_partkey, p_partkey, [p_partkey] FROM part WHERE p_partkey IN (150, 151, 177) UNION ALL SELECT r.root, e.dst, list_append(r.path, e.dst) FROM r JOIN fx_edges e ON e.src = r.node WHERE len(r.path) <= 6), b AS (SELECT root, node, min(len(path)) AS n FROM r GROUP BY ALL) SELECT r.root AS src, r.node AS dst, array_to_string(min(r.path), '>') AS path FROM r JOIN b ON r.root = b.root AND r.node = b.node AND len(r.path) = b.n WHERE r.node IN (1, 2, 5, 9) GROUP BY ALL")
def find_path(s, d):
    starts = s.createDataFrame([(a, b) for a in (150, 151, 177) for b in (1, 2, 5, 9)], "src bigint, dst bigint")
    return traversal.find_path(v.edges(s, d), starts, 6).select("src", "dst", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(_ED + ", up(node, depth) AS (SELECT CAST(40 AS BIGINT), 0 UNION ALL SELECT e.dst, up.depth + 1 FROM up JOIN fx_edges e ON e.src = up.node WHERE up.depth < 3), dn(node, depth) AS (SELECT CAST(40 AS BIGINT), 0 UNION ALL SELECT e.src, dn.depth + 1 FROM dn JOIN fx_edges e ON e.dst = dn.node WHERE dn.depth < 3) SELECT node, min(depth) AS depth, 'up' AS direction FROM up WHERE node <> 40 GROUP BY node UNION ALL SELECT node, min(depth), 'down' FROM dn WHERE node <> 40 GROUP BY node")
def traverse(s, d):
    e = v.edges(s, d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return traversal.traverse(e, "40", "both", 3).select(F.col("node").cast("bigint").alias("node"), "depth", "direction")


_FAR = "SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_partkey % 100 = 0"


def _hundreds(s, d):
    return s.read.parquet(f"{d}/part.parquet").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("node")).distinct()


@query(_ED + f", r(node, depth) AS ({_FAR} UNION SELECT e.dst, r.depth + 1 FROM r JOIN fx_edges e ON e.src = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def reachable_all(s, d):
    """The closure to its end, from start nodes all over the graph."""
    return traversal.reachable(v.edges(s, d), _hundreds(s, d))


@query(_ED + ", r(node, depth) AS (SELECT CAST(3 AS BIGINT), 0 UNION SELECT e.src, r.depth + 1 FROM r JOIN fx_edges e ON e.dst = r.node) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def transitive_callers_all(s, d):
    """All that reach the node, however far."""
    return traversal.transitive_callers(v.edges(s, d), s.createDataFrame([(3,)], "node bigint"))


@query()
def find_path_all(s, d):
    """Shortest paths of any length, from start nodes all over the graph to its low nodes."""
    pairs = _hundreds(s, d).select(F.col("node").alias("src")).crossJoin(s.createDataFrame([(x,) for x in (1, 2, 5, 9)], "dst bigint"))
    return traversal.find_path(v.edges(s, d), pairs).select("src", "dst", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(_CF + "SELECT f.fqn AS caller, f.file, m.line AS call_line, m.col AS call_column FROM (SELECT DISTINCT caller_fqn FROM fx_call_sites WHERE target_fqn = 'lib.promo.hot_rod') c JOIN fx_functions f ON f.fqn = c.caller_fqn LEFT JOIN (SELECT caller_fqn, line, col FROM (SELECT caller_fqn, line, col, row_number() OVER (PARTITION BY caller_fqn ORDER BY line, col) AS rn FROM fx_call_sites WHERE target_fqn = 'lib.promo.hot_rod' OR target = 'hot_rod') WHERE rn = 1) m ON m.caller_fqn = c.caller_fqn")
def callers(s, d):
    c = v.call_sites(s, d)
    edges = c.select(F.col("caller_fqn").alias("caller"), F.col("target_fqn").alias("callee")).distinct()
    return traversal.callers(c, edges, v.functions(s, d), "lib.promo.hot_rod")


@query(_CS + "SELECT caller_fqn, count(*) AS calls, count(*) FILTER (resolved) AS resolved, count(*) FILTER (NOT resolved) AS unresolved FROM fx_call_sites GROUP BY caller_fqn")
def callees(s, d):
    return traversal.callee_counts(v.call_sites(s, d))


@query(_CS + "SELECT target, target_fqn, line, resolved, NULL::VARCHAR AS target_file, NULL::INT AS target_line FROM fx_call_sites WHERE caller_fqn = 'app.m7.f7'")
def callees_of(s, d):
    return traversal.callees(v.call_sites(s, d), v.functions(s, d), "app.m7.f7")


@query(_CS + "SELECT caller_fqn, target, line FROM fx_call_sites WHERE caller_fqn = 'app.m7.f7' AND contains(target, '.') ORDER BY line, target, target_fqn LIMIT 1")
def call_details(s, d):
    return traversal.call_details(v.call_sites(s, d), "app.m7.f7", ".").select("caller_fqn", "target", "line")


# Dataflow


@query(_ST + "SELECT fqn, var, sum(d) AS defs, sum(u) AS uses FROM (SELECT fqn, def AS var, 1 AS d, 0 AS u FROM fx_statements UNION ALL SELECT fqn, use_var, 0, 1 FROM fx_statements) GROUP BY ALL")
def def_use(s, d):
    return dataflow.def_use(v.statements(s, d))


@query(_ST + ", x AS (SELECT fqn, var, sum(d) AS defs, sum(u) AS uses FROM (SELECT fqn, def AS var, 1 AS d, 0 AS u FROM fx_statements UNION ALL SELECT fqn, use_var, 0, 1 FROM fx_statements) GROUP BY ALL) SELECT fqn, count(*) AS variables, sum(defs) AS total_defs, sum(uses) AS total_uses, max(defs) AS max_defs, max(uses) AS max_uses, count(*) FILTER (defs = 0) AS undefined, count(*) FILTER (uses = 0) AS dead FROM x GROUP BY fqn")
def def_use_stats(s, d):
    return dataflow.def_use_stats(v.statements(s, d))


@query(_ST + "SELECT fqn, def AS var, line, call_target = 'signup' AS is_source, call_target = 'error' AS is_sanitized FROM fx_statements")
def vdg_build(s, d):
    return dataflow.vdg_build(v.statements(s, d), SOURCES, SANITIZERS)


_FLOW = _ST + """, st AS (SELECT * FROM fx_statements), e AS (SELECT u.fqn, max(x.seq) AS a, u.seq AS b FROM st u JOIN st x ON x.fqn = u.fqn AND x.def = u.use_var AND x.seq < u.seq GROUP BY u.fqn, u.seq),
r(fqn, root, node) AS (SELECT fqn, seq, seq FROM st WHERE call_target = 'signup' UNION SELECT r.fqn, r.root, e.b FROM r JOIN e ON e.fqn = r.fqn AND e.a = r.node),
k AS (SELECT s.fqn, s.line AS sink_line, s.use_var AS sink_var, max(x.line) AS def_line FROM st s JOIN st x ON x.fqn = s.fqn AND x.def = s.use_var AND x.line <= s.line WHERE s.call_target = 'purchase' GROUP BY ALL)
SELECT DISTINCT r.fqn, r.root AS source_line, k.sink_line, k.sink_var FROM r JOIN k ON k.fqn = r.fqn AND k.def_line = r.node"""


@query(_FLOW)
def vdg_flows(s, d):
    return dataflow.vdg_flows(v.statements(s, d), SOURCES, SINKS).select("fqn", "source_line", "sink_line", "sink_var").distinct()


@query(_FLOW)
def flow_reach(s, d):
    return dataflow.flow_reach(v.statements(s, d), SOURCES, SINKS, max_depth=10_000)


#: Each statement uses one variable here, so a node has one edge into it and a path is unique; sanitized nodes end it.
_CLEAN = _ST + """, st AS (SELECT * FROM fx_statements), e AS (SELECT u.fqn, max(x.seq) AS a, u.seq AS b FROM st u JOIN st x ON x.fqn = u.fqn AND x.def = u.use_var AND x.seq < u.seq GROUP BY u.fqn, u.seq),
r(fqn, root, node, steps) AS (SELECT fqn, seq, seq, 1 FROM st WHERE call_target = 'signup' UNION SELECT r.fqn, r.root, e.b, r.steps + 1 FROM r JOIN e ON e.fqn = r.fqn AND e.a = r.node JOIN st n ON n.fqn = e.fqn AND n.seq = e.b WHERE n.call_target <> 'error'),
k AS (SELECT s.fqn, s.line AS sink_line, s.use_var AS sink_var, max(x.line) AS def_line FROM st s JOIN st x ON x.fqn = s.fqn AND x.def = s.use_var AND x.line <= s.line WHERE s.call_target = 'purchase' GROUP BY ALL),
flow AS (SELECT r.fqn, r.root AS source_line, k.sink_line, k.sink_var, r.steps, x.def AS source_var, x.user_id FROM r JOIN k ON k.fqn = r.fqn AND k.def_line = r.node JOIN st x ON x.fqn = r.fqn AND x.seq = r.root)"""


@query(_CLEAN + " SELECT fqn, source_line, sink_line, sink_var, steps FROM flow")
def vdg_flows_sanitized(s, d):
    return dataflow.vdg_flows(v.statements(s, d), SOURCES, SINKS, SANITIZERS).select("fqn", "source_line", "sink_line", "sink_var", F.size("path").alias("steps"))


@query(_CLEAN + """ SELECT fqn, source_line, source_var, sink_line, 'purchase' AS sink_call, 0.95 AS confidence, 'local' AS scope FROM flow WHERE user_id % 3 = 0 UNION ALL SELECT fqn, source_line, source_var, sink_line, 'purchase', 0.85, 'local' FROM flow WHERE user_id % 3 = 1
UNION ALL SELECT a.fqn, a.line, '', b.line, '', 0.5, 'local' FROM st a JOIN st b ON b.fqn = a.fqn AND b.call_target = 'purchase' WHERE a.call_target = 'signup' AND a.user_id % 3 = 2 AND NOT EXISTS (SELECT 1 FROM st c WHERE c.fqn = a.fqn AND c.call_target = 'error' AND c.line > least(a.line, b.line) AND c.line < greatest(a.line, b.line))""")
def flows_local(s, d):
    st = v.statements(s, d)
    lines = tuple(st.where(F.col("call_target") == t) for t in ("signup", "purchase", "error"))
    cfg, flat = st.where("user_id % 3 = 0"), st.where("user_id % 3 = 1")
    return dataflow.flows_local(cfg, flat, SOURCES, SINKS, SANITIZERS, lines)


@query(_CS + "SELECT DISTINCT pattern FROM (SELECT unnest([target, target_fqn, split_part(target, '.', -1)]) AS pattern FROM fx_call_sites WHERE starts_with(target, 'promo.')) WHERE pattern <> ''")
def target_patterns(s, d):
    return dataflow.target_patterns(matching.call_matcher(v.call_sites(s, d), ["promo.*"]))


@query(_CS + ", f AS (SELECT DISTINCT caller_fqn AS fqn, line AS sink_line, 'v3' AS sink_var FROM fx_call_sites) SELECT f.* FROM f WHERE EXISTS (SELECT 1 FROM fx_call_sites c WHERE c.caller_fqn = f.fqn AND c.line = f.sink_line AND c.arg2 = 'v3')")
def tracked_params(s, d):
    c = v.call_sites(s, d)
    flows = c.select(F.col("caller_fqn").alias("fqn"), F.col("line").alias("sink_line"), F.lit("v3").alias("sink_var")).distinct()
    return dataflow.tracked_params(flows, c, indices=(2,))


def _program(s, d):
    """Statements with returns, parameters and calls between functions, from the events."""
    st = v.statements(s, d)
    kind = F.when(F.col("line") % 12 == 0, "return").otherwise("assignment")
    call = F.when((F.col("line") % 12 == 6) & (F.col("user_id") > 1), F.concat(F.lit("svc.u"), F.floor(F.col("user_id") / 2).cast("string"))).otherwise(F.col("call_target"))
    st = st.withColumns({"type": kind, "call_target": call, "call_chain": F.lit(""), "attribute_access": F.lit(""), "call_args": F.col("uses")})
    params = st.select("fqn").distinct().withColumn("names", F.array(F.lit("v0"), F.lit("v1")))
    edges = st.where(F.startswith("call_target", F.lit("svc."))).select(F.col("fqn").alias("caller"), F.col("call_target").alias("callee")).distinct()
    return st, params, edges


@query()
def transfer_summary(s, d):
    st, params, _ = _program(s, d)
    return dataflow.transfer_summary(st, params, SOURCES, SINKS, SANITIZERS)


@query()
def summary_fixpoint(s, d):
    st, params, edges = _program(s, d)
    return dataflow.summary_fixpoint(st, params, edges, SOURCES, SINKS, SANITIZERS)


@query()
def flows_global(s, d):
    st, params, edges = _program(s, d)
    summaries = dataflow.summary_fixpoint(st, params, edges, SOURCES, SINKS, SANITIZERS)
    at = lambda t: st.where(F.col("call_target") == t).select("fqn", "line", F.col("call_target").alias("call"))
    local = dataflow.flows_local(st, st, SOURCES, SINKS, SANITIZERS)
    return dataflow.flows_global(at("signup"), at("purchase"), edges, summaries, local)


@query(_ST + """, st AS (SELECT * FROM fx_statements), e AS (SELECT u.fqn, max(x.seq) AS a, u.seq AS b FROM st u JOIN st x ON x.fqn = u.fqn AND x.def = u.use_var AND x.seq < u.seq GROUP BY u.fqn, u.seq),
t(fqn, seq, conf, src) AS (SELECT fqn, seq, CAST(1.0 AS DOUBLE), line FROM st WHERE call_target = 'signup' UNION SELECT e.fqn, e.b, t.conf * CAST(0.7 AS DOUBLE), t.src FROM t JOIN e ON e.fqn = t.fqn AND e.a = t.seq JOIN st n ON n.fqn = e.fqn AND n.seq = e.b WHERE n.call_target NOT IN ('signup', 'error'))
SELECT s.fqn, t.src AS source_line, s.line AS sink_line, s.call_target AS sink_call, t.conf AS confidence FROM st s JOIN e ON e.fqn = s.fqn AND e.b = s.seq JOIN t ON t.fqn = e.fqn AND t.seq = e.a WHERE s.call_target = 'purchase'""")
def intra_taint_forward(s, d):
    return dataflow.intra_taint_forward(v.statements(s, d), SOURCES, SINKS, SANITIZERS)


@query(_CS + ", src AS (SELECT DISTINCT caller_fqn AS fqn, arg2 AS var, 1 AS line FROM fx_call_sites WHERE arg0 = '1') SELECT DISTINCT c.caller_fqn AS fqn, c.line, c.target_fqn, c.arg2 AS var, 0.9 AS confidence FROM fx_call_sites c JOIN src ON src.fqn = c.caller_fqn AND src.var = c.arg2 WHERE c.target_fqn = 'lib.promo.hot_rod'")
def inter_taint(s, d):
    c = v.call_sites(s, d)
    sources = c.where("arg0 = '1'").select(F.col("caller_fqn").alias("fqn"), F.col("arg2").alias("var"), F.lit(1).alias("line")).distinct()
    summaries = s.createDataFrame([("lib.promo.hot_rod", [2])], "fqn string, p2sink array<int>")
    return dataflow.inter_taint(sources, c, summaries)


@query(_CS + "SELECT caller_fqn AS source_fqn, caller_fqn AS sink_fqn, line, target AS call FROM fx_call_sites WHERE split_part(target, '.', -1) = 'hot_rod' ORDER BY source_fqn, line, call LIMIT 1")
def pattern_registry(s, d):
    c = v.call_sites(s, d)
    return dataflow.pattern_registry(c, c.select(F.col("caller_fqn").alias("caller"), F.col("target_fqn").alias("callee")), "dangerous", dangerous=["hot_rod"])


@query(_ST + "SELECT scope_fqn, var, type_fqn, line FROM (SELECT fqn AS scope_fqn, def AS var, call_target AS type_fqn, line, row_number() OVER (PARTITION BY fqn, def ORDER BY line DESC) AS rn FROM fx_statements) WHERE rn = 1")
def last_binding(s, d):
    return dataflow.live_bindings(v.statements(s, d).select(F.col("fqn").alias("scope_fqn"), F.col("def").alias("var"), F.col("call_target").alias("type_fqn"), "line"))


@query(_ST + "SELECT u.fqn AS scope_fqn, u.use_var AS var, u.line, arg_max(x.call_target, x.line) AS type_fqn FROM fx_statements u LEFT JOIN fx_statements x ON x.fqn = u.fqn AND x.def = u.use_var AND x.line <= u.line GROUP BY ALL")
def binding_at_line(s, d):
    st = v.statements(s, d)
    b = st.select(F.col("fqn").alias("scope_fqn"), F.col("def").alias("var"), F.col("call_target").alias("type_fqn"), "line")
    return dataflow.binding_at_line(b, st.select(F.col("fqn").alias("scope_fqn"), F.col("use_var").alias("var"), "line")).select("scope_fqn", "var", "line", "type_fqn")


# Resolution


@query(_CS + f", {_IMPORTS}, known AS (SELECT DISTINCT 'lib.' || target AS fqn FROM fx_call_sites WHERE target LIKE '%ring' UNION SELECT DISTINCT target FROM fx_call_sites WHERE target LIKE '%plate'), j AS (SELECT c.*, i.fqn || substr(c.target, length(i.alias) + 1) AS imp FROM fx_call_sites c LEFT JOIN imports i ON i.file = c.file AND i.alias = split_part(c.target, '.', 1)), k AS (SELECT j.*, a.fqn AS by_import, b.fqn AS by_name, c.fqn AS by_strip FROM j LEFT JOIN known a ON a.fqn = j.imp LEFT JOIN known b ON b.fqn = j.target LEFT JOIN known c ON c.fqn = substr(j.imp, 5)) SELECT rung, count(*) AS n FROM (SELECT CASE WHEN by_import IS NOT NULL THEN 'import' WHEN by_name IS NOT NULL THEN 'function' WHEN by_strip IS NOT NULL THEN 'prefix_strip' ELSE 'unresolved' END AS rung FROM k) GROUP BY rung")
def resolve_call_py(s, d):
    c = v.call_sites(s, d).select("caller_fqn", "file", "module", "target")
    t = c.select("target").distinct()
    known = t.where("target LIKE '%ring'").select(F.concat(F.lit("lib."), "target").alias("fqn")).unionByName(t.where("target LIKE '%plate'").select(F.col("target").alias("fqn")))
    return resolution.resolve_call_py(c, known, _imports(s, d)).groupBy(F.coalesce("rung", F.lit("unresolved")).alias("rung")).agg(F.count("*").alias("n"))


@query(_CS + """, c AS (SELECT caller_fqn, module, seq, CAST(regexp_extract(module, 'm(\\d+)$', 1) AS INTEGER) AS m, (l * 7 + seq) % 9 AS k FROM (SELECT caller_fqn, module, seq, line AS l FROM fx_call_sites))
SELECT caller_fqn, seq, CASE k WHEN 0 THEN CASE WHEN m % 2 = 0 THEN module || '.run' ELSE 'base.B.run' END WHEN 1 THEN 'base.B.stop' WHEN 2 THEN 'builtins.eval' WHEN 3 THEN 'numpy.array' WHEN 4 THEN CASE WHEN m % 3 = 0 THEN module || '.helper' END
  WHEN 5 THEN 'lib.DB.query' WHEN 6 THEN 'User.objects.filter' WHEN 7 THEN 'lib.Conn.send' ELSE 'app.util.fn' END AS resolved_fqn,
 CASE k WHEN 0 THEN 'self' WHEN 1 THEN 'super' WHEN 2 THEN 'builtin' WHEN 3 THEN 'registry' WHEN 4 THEN CASE WHEN m % 3 = 0 THEN 'same_module' END WHEN 5 THEN 'variable' WHEN 6 THEN 'orm' WHEN 7 THEN 'self_attr' ELSE 'import' END AS rung,
 CASE WHEN k = 4 AND m % 3 <> 0 THEN 'not_in_imports' ELSE '' END AS failure_reason FROM c""")
def resolve_call_py_rungs(s, d):
    """Every rung of the cascade with rows of its own."""
    k = (F.col("line") * 7 + F.col("seq")) % 9
    names = ("self.run", "super().stop", "eval", "np.array", "helper", "db.query", "User.objects.filter", "self.conn.send", "util.fn")
    target = F.get(F.array(*map(F.lit, names)), k.cast("int"))
    c = v.call_sites(s, d).select("caller_fqn", "file", "module", "seq", target.alias("target"))
    modules = c.select("file", "module").distinct()
    m = F.regexp_extract("module", r"m(\d+)$", 1).cast("int")
    fixed = s.createDataFrame([("base.B.run",), ("base.B.stop",), ("lib.Conn.send",), ("app.util.fn",)], "fqn string")
    functions = modules.where(m % 2 == 0).select(F.concat("module", F.lit(".run")).alias("fqn")).unionByName(modules.where(m % 3 == 0).select(F.concat("module", F.lit(".helper")).alias("fqn"))).unionByName(fixed)
    imports = modules.select("file", F.explode(F.array(F.struct(F.lit("np").alias("alias"), F.lit("numpy").alias("fqn")), F.struct(F.lit("util").alias("alias"), F.lit("app.util").alias("fqn")))).alias("i")).select("file", "i.*")
    mro = modules.select(F.col("module").alias("class_fqn"), F.explode(F.array(F.struct(F.col("module").alias("ancestor"), F.lit(0).alias("depth")), F.struct(F.lit("base.B").alias("ancestor"), F.lit(1).alias("depth")))).alias("x")).select("class_fqn", "x.*").unionByName(s.createDataFrame([("base.B", "base.B", 0)], "class_fqn string, ancestor string, depth int"))
    bindings = c.select(F.col("caller_fqn").alias("scope_fqn")).distinct().select("scope_fqn", F.lit("db").alias("var"), F.lit("lib.DB").alias("type_fqn"), F.lit(0.9).alias("confidence"))
    attributes = modules.select(F.col("module").alias("class_fqn"), F.lit("conn").alias("name"), F.lit("lib.Conn").alias("type_fqn"))
    registry = s.createDataFrame([("numpy.array", "thirdparty")], "fqn string, kind string")
    return resolution.resolve_call_py(c, functions, imports, None, bindings, attributes, mro, registry).select("caller_fqn", "seq", "resolved_fqn", "rung", "failure_reason")


@query(_CS + ", b AS (SELECT DISTINCT caller_fqn FROM fx_call_sites WHERE target LIKE 'promo.%'), x AS (SELECT c.target, CASE WHEN b.caller_fqn IS NOT NULL AND split_part(c.target, '.', 1) = 'promo' THEN 'best_effort' WHEN c.module || '.' || c.target = 'app.m7.small.hot_rod' THEN 'same_package' ELSE 'unresolved' END AS rung FROM fx_call_sites c LEFT JOIN b ON b.caller_fqn = c.caller_fqn) SELECT rung, count(*) AS n FROM x GROUP BY rung")
def resolve_call_go(s, d):
    c = v.call_sites(s, d)
    bindings = c.where(F.startswith("target", F.lit("promo."))).select(F.col("caller_fqn").alias("scope_fqn"), F.lit("promo").alias("var"), F.lit("*gorm.io/gorm.DB").alias("type_fqn"), F.lit(0.9).alias("confidence")).distinct()
    none = s.createDataFrame([], "file string, alias string, fqn string")
    known = s.createDataFrame([("app.m7.small.hot_rod",)], "fqn string")
    return resolution.resolve_call_go(c.select("caller_fqn", "file", "module", "target"), known, none, bindings).groupBy(F.coalesce("rung", F.lit("unresolved")).alias("rung")).agg(F.count("*").alias("n"))


@query(_CS + "SELECT t, CASE WHEN ends_with(t, '.filter') OR ends_with(t, '.get') THEN 'orm_pattern' WHEN starts_with(t, 'super(') OR starts_with(t, 'super.') THEN 'super_call' WHEN contains(t, '.') AND split_part(t, '.', 1) IN ('self', 'request') THEN 'variable_method' WHEN contains(t, '.') AND regexp_matches(t, '^[a-z]') THEN 'attribute_chain' WHEN NOT contains(t, '.') THEN 'not_in_imports' ELSE 'unknown' END AS reason, count(*) AS n FROM (SELECT CASE line % 6 WHEN 0 THEN 'Model.filter' WHEN 1 THEN 'super().save' WHEN 2 THEN 'request.' || split_part(target, '.', 2) WHEN 3 THEN split_part(target, '.', 2) WHEN 4 THEN upper(target) ELSE target END AS t FROM fx_call_sites) GROUP BY ALL")
def categorize_failure(s, d):
    t, n = F.col("target"), F.col("line") % 6
    last = F.substring_index(t, ".", -1)
    shaped = F.when(n == 0, "Model.filter").when(n == 1, "super().save").when(n == 2, F.concat(F.lit("request."), last)).when(n == 3, last).when(n == 4, F.upper(t)).otherwise(t)
    return v.call_sites(s, d).select(shaped.alias("t")).groupBy("t", resolution.categorize_failure(F.col("t")).alias("reason")).agg(F.count("*").alias("n"))


@query(_CS + "SELECT caller_fqn AS fqn, type_fqn, confidence FROM (SELECT caller_fqn, inferred_type AS type_fqn, type_confidence AS confidence, row_number() OVER (PARTITION BY caller_fqn ORDER BY type_confidence DESC, inferred_type) AS rn FROM fx_call_sites) WHERE rn = 1")
def merge_return_types(s, d):
    return resolution.merge_return_types(v.call_sites(s, d).select(F.col("caller_fqn").alias("fqn"), F.col("inferred_type").alias("type_fqn"), F.col("type_confidence").alias("confidence")))


@query(_FN + "SELECT fqn AS scope_fqn, 'x' AS var, CASE WHEN line % 2 = 0 THEN 'lib.Session' ELSE 'call:unknown' END AS type_fqn, CASE WHEN line % 2 = 0 THEN 0.9 * 0.8 * 0.95 ELSE 0.9 END AS confidence FROM fx_functions UNION ALL SELECT fqn, 'y', CASE WHEN line % 2 = 0 THEN 'lib.Session' ELSE 'var:x' END, CASE WHEN line % 2 = 0 THEN 0.5 * 0.9 * 0.8 * 0.95 ELSE 0.5 END FROM fx_functions")
def propagate_types(s, d):
    f = v.functions(s, d)
    x = f.select(F.col("fqn").alias("scope_fqn"), F.lit("x").alias("var"), F.lit(1).alias("line"), F.when(F.col("line") % 2 == 0, "call:lib.open").otherwise("call:unknown").alias("type_fqn"), F.lit(0.9).alias("confidence"))
    y = f.select(F.col("fqn").alias("scope_fqn"), F.lit("y").alias("var"), F.lit(2).alias("line"), F.lit("var:x").alias("type_fqn"), F.lit(0.5).alias("confidence"))
    returns = s.createDataFrame([("lib.open", "lib.Session", 0.8), ("lib.open", "lib.File", 0.3)], "fqn string, type_fqn string, confidence double")
    return resolution.propagate_types(x.unionByName(y), returns).drop("line")


@query(_CS + ", m AS (SELECT DISTINCT split_part(target, '.', 1) AS t, split_part(target, '.', 2) AS me FROM fx_call_sites WHERE ends_with(target, 'ring')) SELECT DISTINCT c.target AS id, 'T_' || m.me AS type_fqn, 0.9 * 0.8 AS confidence, 2 AS steps FROM fx_call_sites c JOIN m ON c.target = m.t || '.' || m.me")
def resolve_chain(s, d):
    t = v.call_sites(s, d).select("target").distinct()
    kind, me = F.substring_index("target", ".", 1), F.substring_index("target", ".", -1)
    returns = t.select(kind.alias("name"), kind.alias("type_fqn"), F.lit(0.9).alias("confidence")).distinct()
    methods = t.where(F.endswith("target", F.lit("ring"))).select(kind.alias("type_fqn"), me.alias("method"), F.concat(F.lit("T_"), me).alias("return_type"), F.lit(0.8).alias("confidence"))
    return resolution.resolve_chain(t.select(F.col("target").alias("id"), F.concat(kind, F.lit("(a, f(b))."), me, F.lit("()")).alias("target")), returns, methods)


@query(_MO + "SELECT fqn AS caller_fqn, CASE WHEN line % 3 = 0 THEN 'lib.B.run' END AS self_fqn FROM fx_functions")
def resolve_self_attr(s, d):
    f = v.functions(s, d)
    calls = f.select("fqn", F.concat("fqn", F.lit(".m")).alias("caller_fqn"), F.lit("self.a.b.run").alias("target"))
    attrs = f.where("line % 3 = 0").select(F.col("fqn").alias("class_fqn"), F.lit("a").alias("name"), F.lit("lib.A").alias("type_fqn")).unionByName(s.createDataFrame([("lib.A", "b", "lib.B")], "class_fqn string, name string, type_fqn string"))
    got = resolution.resolve_self_attr(calls, attrs, s.createDataFrame([("lib.B.run",)], "fqn string"))
    return got.select(F.col("fqn").alias("caller_fqn"), "self_fqn")


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'a.promo.go' WHEN 'SMALL' THEN 'b.base.go' END AS fqn FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def resolve_inheritance(s, d):
    p = s.read.parquet(f"{d}/part.parquet").where("p_type IN ('PROMO', 'SMALL')").select("p_partkey", F.concat(F.lit("app.C"), F.col("p_partkey").cast("string")).alias("class_fqn"), "p_type")
    near, far = F.when(F.col("p_type") == "PROMO", "a.promo").otherwise("a.small"), F.lit("b.base")
    mro = p.select("class_fqn", near.alias("ancestor"), F.lit(1).alias("depth")).unionByName(p.select("class_fqn", far.alias("ancestor"), F.lit(2).alias("depth")))
    methods = s.createDataFrame([("a.promo.go",), ("b.base.go",)], "fqn string")
    return resolution.resolve_inheritance(methods, mro).join(p, "class_fqn").select("p_partkey", "fqn")


@query(_FN + "SELECT file, CASE WHEN file LIKE '%7.py' THEN 'flask' ELSE 'django' END AS framework FROM (SELECT DISTINCT file FROM fx_functions)")
def framework_detect(s, d):
    files = v.functions(s, d).select("file").distinct()
    imports = files.select("file", F.when(F.endswith("file", F.lit("7.py")), "flask.views").otherwise("django.db.models").alias("fqn"))
    known = s.createDataFrame([("flask", "flask", "web"), ("django", "django", "web"), ("torch", "torch", "ml")], "prefix string, framework string, category string")
    return resolution.framework_detect(imports, known).drop("category")


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'enum' WHEN 'SMALL' THEN 'dataclass' WHEN 'LARGE' THEN 'interface' ELSE 'class' END AS kind FROM part")
def transitive_class_kind(s, d):
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("b."), "p_type").alias("class_fqn"))
    bases = s.createDataFrame([("b.PROMO", "c.Mid"), ("c.Mid", "enum.Enum"), ("b.SMALL", "pydantic.BaseModel"), ("b.LARGE", "typing.Protocol"), ("b.LARGE", "c.Data"), ("c.Data", "x.dataclass")], "class_fqn string, base string")
    return joins.transitive_class_kind(p, bases).select("p_partkey", "kind")
