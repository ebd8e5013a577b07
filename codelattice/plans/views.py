"""The data tables seen as code graphs: each view as a DataFrame and, for the SQL side, as a common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelattice.session import table

_TIE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")


def call_sites(spark: SparkSession, d: str) -> DataFrame:
    """Line items as call sites of functions ``app.mM.fN``; arguments: a number, ``status=…`` and a variable."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    kind = F.lower("p_type")
    name = F.concat(kind, F.lit("."), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    module = F.concat(F.lit("app.m"), (F.col("l_orderkey") % 50).cast("string"))
    arg = lambda v, is_var, i: F.struct(v.alias("value"), F.lit(is_var).alias("is_variable"), F.lit(i).alias("position"))
    a0 = F.col("l_quantity").cast("int").cast("string")
    resolved = F.col("l_returnflag") != "R"
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        F.concat(module, F.lit(".f"), F.col("l_orderkey").cast("string")).alias("caller_fqn"), module.alias("module"), F.concat(F.regexp_replace(module, r"\.", "/"), F.lit(".py")).alias("file"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_TIE)).alias("seq"),
        F.col("l_linenumber").cast("int").alias("line"), (F.col("l_suppkey") % 60 + 1).cast("int").alias("col"), name.alias("target"), F.concat(F.lit("lib."), name).alias("target_fqn"), resolved.alias("resolved"),
        F.when(resolved, "").when(F.col("l_linestatus") == "O", "not_in_imports").otherwise("attribute_chain").alias("failure_reason"), (F.col("l_returnflag") == "A").alias("via_type_inference"), F.concat(F.lit("lib."), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))).alias("inferred_type"),
        (F.col("l_discount") * 10).alias("type_confidence"), F.col("l_linestatus").alias("type_source"), (F.col("l_tax") > 0.05).alias("is_stdlib"), a0.alias("arg0"), F.concat(F.lit("status="), "l_linestatus").alias("arg1"), F.concat(F.lit("v"), (F.col("l_suppkey") % 7).cast("string")).alias("arg2"),
    ).withColumn("arguments", F.array(arg(F.col("arg0"), False, 0), arg(F.col("arg1"), False, 1), arg(F.col("arg2"), True, 2)))


CALL_SITES = f"""fx_call_sites AS (
SELECT concat('app.m', CAST(l.l_orderkey % 50 AS STRING), '.f', CAST(l.l_orderkey AS STRING)) AS caller_fqn, concat('app.m', CAST(l.l_orderkey % 50 AS STRING)) AS module, concat('app/m', CAST(l.l_orderkey % 50 AS STRING), '.py') AS file,
  row_number() OVER (PARTITION BY l.l_orderkey ORDER BY {', '.join('l.' + c for c in _TIE)}) AS seq, CAST(l.l_linenumber AS INT) AS line, CAST(l.l_suppkey % 60 + 1 AS INT) AS col,
  concat(lower(p.p_type), '.', replace(p.p_name, ' ', '_')) AS target, concat('lib.', lower(p.p_type), '.', replace(p.p_name, ' ', '_')) AS target_fqn, l.l_returnflag <> 'R' AS resolved,
  CASE WHEN l.l_returnflag <> 'R' THEN '' WHEN l.l_linestatus = 'O' THEN 'not_in_imports' ELSE 'attribute_chain' END AS failure_reason, l.l_returnflag = 'A' AS via_type_inference, concat('lib.', replace(p.p_brand, '#', '_')) AS inferred_type,
  l.l_discount * 10 AS type_confidence, l.l_linestatus AS type_source, l.l_tax > 0.05 AS is_stdlib, CAST(CAST(l.l_quantity AS INT) AS STRING) AS arg0, concat('status=', l.l_linestatus) AS arg1, concat('v', CAST(l.l_suppkey % 7 AS STRING)) AS arg2
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """An acyclic graph with diamonds over part keys: every edge (src, dst) lowers the key."""
    p = table(spark, d, "part")
    a = p.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2.0).cast("bigint").alias("dst"))
    b = p.where("p_partkey - p_size >= 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - F.col("p_size")).cast("bigint").alias("dst"))
    return a.unionByName(b).where("src <> dst").distinct()


EDGES = """fx_edges AS (SELECT DISTINCT src, dst FROM (
  SELECT p_partkey AS src, CAST(floor(p_partkey / 2.0) AS BIGINT) AS dst FROM part WHERE p_partkey > 0
  UNION ALL SELECT p_partkey, CAST(p_partkey - p_size AS BIGINT) FROM part WHERE p_partkey - p_size >= 0) e WHERE src <> dst)"""


def statements(spark: SparkSession, d: str) -> DataFrame:
    """Events as statements of a function for each user; the line is the place in the function."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = e.select(
        F.concat(F.lit("svc.u"), F.col("user_id").cast("string")).alias("fqn"), F.row_number().over(w).alias("seq"), F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string")).alias("def"), F.concat(F.lit("v"), ((F.col("event_id") * 3 + 1) % 5).cast("string")).alias("use_var"), F.col("event_type").alias("call_target"), "user_id",
    )
    return s.withColumns({"line": F.col("seq"), "uses": F.array("use_var"), "attribute_access": F.concat(F.lit("request."), "call_target"), "call_chain": F.concat(F.lit("lib.Session."), "call_target")})


STATEMENTS = """fx_statements AS (SELECT concat('svc.u', CAST(user_id AS STRING)) AS fqn, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line,
  concat('v', CAST(event_id % 5 AS STRING)) AS def, concat('v', CAST((event_id * 3 + 1) % 5 AS STRING)) AS use_var, event_type AS call_target, user_id, concat('request.', event_type) AS attribute_access, concat('lib.Session.', event_type) AS call_chain FROM events)"""


def functions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as functions ``app.mM.fN`` with a file, a line and a language."""
    o = table(spark, d, "orders")
    m = F.concat(F.lit("app.m"), (F.col("o_orderkey") % 50).cast("string"))
    return o.select(F.concat(m, F.lit(".f"), F.col("o_orderkey").cast("string")).alias("fqn"), m.alias("module"), F.concat(F.regexp_replace(m, r"\.", "/"), F.lit(".py")).alias("file"), (F.col("o_custkey") % 400 + 1).cast("int").alias("line"), F.when(F.col("o_orderstatus") == "F", "go").otherwise("python").alias("language"), F.lit("function_definition").alias("type"))


FUNCTIONS = """fx_functions AS (SELECT concat('app.m', CAST(o_orderkey % 50 AS STRING), '.f', CAST(o_orderkey AS STRING)) AS fqn, concat('app.m', CAST(o_orderkey % 50 AS STRING)) AS module, concat('app/m', CAST(o_orderkey % 50 AS STRING), '.py') AS file,
  CAST(o_custkey % 400 + 1 AS INT) AS line, CASE WHEN o_orderstatus = 'F' THEN 'go' ELSE 'python' END AS language, 'function_definition' AS type FROM orders)"""


def modules(spark: SparkSession, d: str) -> DataFrame:
    return functions(spark, d).select(F.col("module").alias("module_path"), "file").distinct()


MODULES = "fx_modules AS (SELECT DISTINCT module AS module_path, file FROM fx_functions)"


def engine_sites(spark: SparkSession, d: str) -> DataFrame:
    """The engine's own records as call sites."""
    r = table(spark, d, "pathfinder_records")
    return r.select(
        "repo", F.col("file_path").alias("file"), "line", "col", "caller_fqn", "target", F.coalesce("our_fqn", F.lit("")).alias("target_fqn"), "resolved", F.coalesce("type_source", F.lit("")).alias("type_source"), "is_stdlib", F.col("type_source").isin("param_type", "return_type").alias("via_type_inference"),
        F.when(F.col("type_source") == "param_type", 0.95).otherwise(0.75).alias("type_confidence"), F.when(F.col("resolved"), "").otherwise("not_in_imports").alias("failure_reason"),
    )


ENGINE_SITES = """fx_engine AS (SELECT repo, file_path AS file, line, col, caller_fqn, target, coalesce(our_fqn, '') AS target_fqn, resolved, coalesce(type_source, '') AS type_source, is_stdlib, type_source IN ('param_type', 'return_type') AS via_type_inference,
  CASE WHEN type_source = 'param_type' THEN 0.95 ELSE 0.75 END AS type_confidence, CASE WHEN resolved THEN '' ELSE 'not_in_imports' END AS failure_reason FROM pathfinder_records)"""


def ctes(*views: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(views) + "\n"
