"""Queries that run whole rule sets and the incremental index, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.plans import views as v
from codelattice.rules import api, execute
from codelattice.session import table
from codelattice.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class _Brand(api.QueryType):
    fqns = ("lib.Brand_3",)


def _rule(rid: str, matcher: api.Matcher, language: str = "") -> dict:
    return api.Rule(rid, rid.lower(), "high", matcher, language).to_ir()


def rule_scan(s: SparkSession, d: str) -> DataFrame:
    """Call, typed, logical and variable rules together."""
    program = execute.Program(call_sites=v.call_sites(s, d))
    rules = [
        _rule("R-CALL-1", api.calls("promo.*", match_position={0: 40})), _rule("R-CALL-2", api.calls("*_ring", match_name={"status": "O"})), _rule("R-VAR-1", api.variable("v3")),
        _rule("R-AND-1", api.calls("promo.*") & api.calls("*_ring")), _rule("R-NOT-1", ~api.calls("promo.*", "large.*")), _rule("R-TYPE-1", _Brand.method("hot_rod").where((0, api.lt(10)))),
    ]
    return execute.run_rules(rules, program).groupBy("rule_id", "match_method").agg(F.count("*").alias("findings"), F.countDistinct("fqn").alias("functions"))


_TYPED = "via_type_inference AND CAST(type_confidence AS FLOAT) >= 0.5 AND inferred_type = 'lib.Brand_3'"
ORACLES["rule_scan"] = v.ctes(v.CALL_SITES) + f""", f AS (
 SELECT 'R-CALL-1' AS rule_id, 'call' AS match_method, caller_fqn FROM fx_call_sites WHERE starts_with(target, 'promo.') AND arg0 = '40' UNION ALL SELECT 'R-CALL-2', 'call', caller_fqn FROM fx_call_sites WHERE ends_with(target, '_ring') AND arg1 = 'status=O'
 UNION ALL SELECT 'R-VAR-1', 'variable', caller_fqn FROM fx_call_sites WHERE arg2 = 'v3'
 UNION ALL SELECT 'R-AND-1', 'call', a.caller_fqn FROM fx_call_sites a WHERE starts_with(a.target, 'promo.') AND EXISTS (SELECT 1 FROM fx_call_sites b WHERE ends_with(b.target, '_ring') AND b.caller_fqn = a.caller_fqn AND b.line = a.line AND b.col = a.col)
 UNION ALL SELECT 'R-NOT-1', 'logic_not', caller_fqn FROM (SELECT DISTINCT caller_fqn, line, target FROM fx_call_sites WHERE NOT starts_with(target, 'promo.') AND NOT starts_with(target, 'large.'))
 UNION ALL SELECT 'R-TYPE-1', 'type_inference', caller_fqn FROM fx_call_sites WHERE ends_with(target, '.hot_rod') AND {_TYPED} AND CAST(arg0 AS INT) < 10)
SELECT rule_id, match_method, count(*) AS findings, count(DISTINCT caller_fqn) AS functions FROM f GROUP BY ALL"""


def rule_flows(s: SparkSession, d: str) -> DataFrame:
    """A dataflow rule over statements."""
    st = v.statements(s, d)
    sites = st.select(F.col("fqn").alias("caller_fqn"), "line", F.lit(1).alias("col"), F.col("call_target").alias("target"), F.lit("").alias("target_fqn"), F.array(F.struct(F.col("use_var").alias("value"), F.lit(True).alias("is_variable"), F.lit(0).alias("position"))).alias("arguments"))
    flow = api.flows(from_sources=[api.calls("signup")], to_sinks=[api.calls("purchase").tracks(0)], sanitized_by=[api.calls("error")], scope="local")
    return execute.run_rules([_rule("R-FLOW-1", flow)], execute.Program(call_sites=sites, statements=st)).select("rule_id", "fqn", "source_line", "sink_line", "match_method")


def source_rules(s: SparkSession, d: str) -> DataFrame:
    """A rule set over what the Python and Go parsers yield, end to end: calls, combinations, and flows within functions."""
    from codelattice.plans.report_queries import _facts
    from codelattice.session import stored
    from codelattice.sources import facts

    parsed = stored(_facts(s, d, "python").unionByName(_facts(s, d, "go")).select("file", "module", "call_sites", "statements"), "facts")  # parsed once, read by every rule
    name = F.concat_ws(":", "file", "fqn")
    st = facts.table_of(parsed, "statements").withColumn("fqn", name)
    unknown = {"target_fqn": F.lit(""), "via_type_inference": F.lit(False), "inferred_type": F.lit(""), "type_confidence": F.lit(0.0)}
    sites = facts.table_of(parsed, "call_sites").withColumn("caller_fqn", F.concat_ws(":", "file", "caller_fqn")).withColumns(unknown)
    rules = [
        _rule("S-CALL-1", api.calls("*.execute", "db.Query")), _rule("S-AND-1", api.calls("*.append") & api.variable("item")), _rule("S-NOT-1", ~api.calls("*.*")),
        _rule("S-FLOW-1", api.flows(api.calls("open"), api.calls("*read"), scope="local")), _rule("S-FLOW-2", api.flows([api.calls("append"), api.calls("db.Query")], api.calls("log.*", "append"), scope="local")),
    ]
    return execute.run_rules(rules, execute.Program(call_sites=sites, statements=st)).select("rule_id", "fqn", "source_line", "sink_line", "match_method").distinct()


def compose_rules(s: SparkSession, d: str) -> DataFrame:
    p = execute.Program(compose_props=table(s, d, "compose_props").distinct())
    rules = [_rule("C-1", api.service_has("privileged", equals=True), "compose"), _rule("C-2", api.service_missing("restart"), "compose"), _rule("C-3", api.any_of(api.service_has("restart", equals="always"), api.service_has("ports", contains=":80")), "compose")]
    return execute.run_container_rules(rules, p).groupBy("rule_id").agg(F.count("*").alias("findings"), F.countDistinct("file").alias("files"))


ORACLES["compose_rules"] = """WITH p AS (SELECT DISTINCT * FROM compose_props), f AS (
 SELECT 'C-1' AS rule_id, repo || '/' || file_path AS file FROM p WHERE prop_key = 'privileged' AND lower(scalar) = 'true' UNION ALL SELECT 'C-2', file FROM (SELECT repo || '/' || file_path AS file, service, count(*) FILTER (prop_key = 'restart') AS n FROM p GROUP BY ALL) WHERE n = 0
 UNION ALL SELECT 'C-3', repo || '/' || file_path FROM p WHERE prop_key = 'restart' AND scalar = 'always' UNION ALL SELECT 'C-3', repo || '/' || file_path FROM p WHERE prop_key = 'ports' AND len(list_filter(prop_items, lambda x: contains(x, ':80'))) > 0)
SELECT rule_id, count(*) AS findings, count(DISTINCT file) AS files FROM f GROUP BY rule_id"""


def docker_rules(s: SparkSession, d: str) -> DataFrame:
    from codelattice.sources import container_code, files

    f = files.table_files(table(s, d, "source_files"))
    i = container_code.scan_dockerfile(f)
    p = execute.Program(instructions=i, docker_files=f.where("lang = 'dockerfile'"))
    rules = [
        _rule("D-1", api.instruction("FROM", image_tag="latest"), "dockerfile"), _rule("D-2", api.missing_instruction("USER"), "dockerfile"), _rule("D-3", api.instruction("USER", user_name="root"), "dockerfile"), _rule("D-4", api.all_of(api.instruction("FROM", missing_digest=True), api.instruction("EXPOSE", port_greater_than=8000)), "dockerfile"),
        _rule("D-5", api.instruction_after("COPY", "RUN"), "dockerfile"),
    ]
    return execute.run_container_rules(rules, p, strict=True)


def _docker_sql() -> str:
    from codelattice.plans.report_queries import _IMAGES

    return _IMAGES + """, p8 AS (SELECT file FROM x WHERE instruction = 'EXPOSE' AND len(list_filter(regexp_extract_all(rest, '\\d+'), lambda p: CAST(p AS INTEGER) > PORT)) > 0), f AS (
 SELECT 'D-1' AS rule_id, file, line, raw AS detail FROM x WHERE instruction = 'FROM' AND tag = 'latest' UNION ALL SELECT 'D-2', file, 1, 'USER' FROM d WHERE file NOT IN (SELECT file FROM i WHERE instruction = 'USER')
 UNION ALL SELECT 'D-3', file, line, raw FROM i WHERE instruction = 'USER' AND split_part(rest, ':', 1) = 'root' UNION ALL SELECT 'D-4', file, line, raw FROM x WHERE instruction = 'FROM' AND digest = '' AND file IN (SELECT file FROM p8)
 UNION ALL SELECT 'D-5', i.file, i.line, i.raw FROM i JOIN (SELECT file, min(line) AS a FROM i WHERE instruction = 'RUN' GROUP BY file) r ON r.file = i.file WHERE i.instruction = 'COPY' AND i.line > r.a)
SELECT * FROM f"""


def file_cache(s: SparkSession, d: str) -> DataFrame:
    f = v.functions(s, d).select("file", "fqn", F.sha2("fqn", 256).alias("sha256"))
    cache = f.withColumn("sha256", F.when(F.endswith("fqn", F.lit("7")), "old").otherwise(F.col("sha256")))
    return incremental.changed(f, cache).select("file", "fqn")


ORACLES["file_cache"] = v.ctes(v.FUNCTIONS) + "SELECT file, fqn FROM fx_functions WHERE ends_with(fqn, '7')"


def needs_rerun(s: SparkSession, d: str) -> DataFrame:
    f = v.functions(s, d)
    fns = f.select("fqn", "file", F.when(F.col("line") % 5 == 0, "new").otherwise("same").alias("sha256"))
    cache = f.select("file", F.lit("same").alias("sha256")).distinct()
    delta = f.where("line % 7 = 0").select("fqn", F.when(F.col("line") % 2 == 0, "added").otherwise("removed").alias("change"))
    c = v.call_sites(s, d).select(F.col("caller_fqn").alias("caller"), (F.regexp_extract("caller_fqn", r"f(\d+)$", 1).cast("bigint") + 50).alias("n"), "module")
    callee = F.concat("module", F.lit(".f"), F.col("n").cast("string"))
    return incremental.needs_rerun(fns, cache, delta, c.where("n % 2 = 0").select("caller", callee.alias("callee")).distinct(), c.where("n % 2 = 1").select("caller", F.concat(F.lit("f"), F.col("n").cast("string")).alias("target")).distinct())


ORACLES["needs_rerun"] = v.ctes(v.CALL_SITES, v.FUNCTIONS) + """, c AS (SELECT DISTINCT caller_fqn AS caller, CAST(regexp_extract(caller_fqn, 'f(\\d+)$', 1) AS BIGINT) + 50 AS n, module FROM fx_call_sites),
 x AS (SELECT fqn, 'changed' AS reason FROM fx_functions WHERE line % 5 = 0 UNION ALL SELECT c.caller, 'callee_removed' FROM c JOIN fx_functions f ON f.fqn = c.module || '.f' || c.n WHERE c.n % 2 = 0 AND f.line % 7 = 0 AND f.line % 2 = 1
 UNION ALL SELECT c.caller, 'may_resolve' FROM c JOIN fx_functions f ON ends_with(f.fqn, '.f' || c.n) WHERE c.n % 2 = 1 AND f.line % 7 = 0 AND f.line % 2 = 0) SELECT fqn, min(reason) AS reason FROM x GROUP BY fqn"""


def windowed_events(s: SparkSession, d: str) -> DataFrame:
    return incremental.windowed_counts(table(s, d, "events")).withColumn("total", F.round("total", 2))


ORACLES["windowed_events"] = "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"

ORACLES["docker_rules"] = _docker_sql().replace("PORT", "8000")


def _flows_sql() -> str:
    from codelattice.plans.graph_queries import _CLEAN

    return _CLEAN + " SELECT 'R-FLOW-1' AS rule_id, fqn, source_line, sink_line, 'flow_local' AS match_method FROM flow"


ORACLES["rule_flows"] = _flows_sql()

QUERIES |= {f.__name__: f for f in (rule_scan, rule_flows, source_rules, compose_rules, docker_rules, file_cache, needs_rerun, windowed_events)}
