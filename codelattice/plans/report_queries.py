"""Queries of the reference's reports, lookups, container rules, scans, scalar functions and exports, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions import scalar
from codelattice.operators import container, reports, symbols, traversal
from codelattice.operators.logic import container_all_of, container_any_of, container_none_of
from codelattice.plans import problems, views as v
from codelattice.session import stored, table
from codelattice.sources import brace_code, container_code, facts, files, python_code, registry, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


_EN, _FN, _MO, _ST, _CS = v.ctes(v.ENGINE_SITES), v.ctes(v.FUNCTIONS), v.ctes(v.FUNCTIONS, v.MODULES), v.ctes(v.STATEMENTS), v.ctes(v.CALL_SITES)

# Reports


@query(_EN + "SELECT total, resolved, unresolved, inferred, CASE WHEN total = 0 THEN 0 ELSE resolved * 100.0 / total END AS resolved_percent, CASE WHEN inferred = 0 THEN 0 ELSE c / inferred END AS mean_confidence FROM (SELECT count(*) AS total, count(*) FILTER (resolved) AS resolved, count(*) FILTER (NOT coalesce(resolved, false)) AS unresolved, count(*) FILTER (resolved AND via_type_inference) AS inferred, CAST(coalesce(sum(type_confidence) FILTER (resolved AND via_type_inference), 0) AS DOUBLE) AS c FROM fx_engine)")
def resolution_totals(s, d):
    return reports.resolution_totals(v.engine_sites(s, d))


@query(_EN + """SELECT dimension, value, count(*) AS calls FROM (
 SELECT 'reason' AS dimension, CASE WHEN failure_reason = '' THEN 'uncategorized' ELSE failure_reason END AS value FROM fx_engine WHERE NOT resolved UNION ALL SELECT 'target', target FROM fx_engine WHERE NOT resolved UNION ALL SELECT 'file', file FROM fx_engine WHERE NOT resolved
 UNION ALL SELECT 'type_source', type_source FROM fx_engine WHERE resolved AND via_type_inference AND type_source <> ''
 UNION ALL SELECT 'confidence', CASE WHEN type_confidence >= 0.9 THEN '0.9-1.0' WHEN type_confidence >= 0.7 THEN '0.7-0.9' ELSE '0.5-0.7' END FROM fx_engine WHERE resolved AND via_type_inference) WHERE value IS NOT NULL GROUP BY ALL""")
def resolution_stats(s, d):
    return reports.resolution_stats(v.engine_sites(s, d))


@query(_EN + ", r AS (SELECT CASE WHEN coalesce(is_stdlib, false) THEN 'stdlib' WHEN type_source IN ('thirdparty_local', 'thirdparty_cdn') THEN 'thirdparty' ELSE 'user' END AS origin, CASE WHEN contains(target_fqn, '/') THEN regexp_extract(target_fqn, '^((?:[^/]*/)*[^./]*)', 1) ELSE '' END AS module FROM fx_engine WHERE resolved) SELECT coalesce(origin, '(all)') AS origin, coalesce(module, '(all)') AS module, count(*) AS calls FROM r GROUP BY ROLLUP (origin, module)")
def go_breakdown(s, d):
    return reports.go_breakdown(v.engine_sites(s, d))


@query(_EN + "SELECT target, count(*) AS calls FROM fx_engine WHERE NOT resolved GROUP BY target ORDER BY calls DESC, target LIMIT 20")
def top_unresolved(s, d):
    return reports.top_n(v.engine_sites(s, d).where("NOT resolved"), "target", 20)


@query("SELECT file_path, count(*) AS findings FROM findings GROUP BY file_path ORDER BY findings DESC, file_path LIMIT 20")
def top_files(s, d):
    return reports.top_n(table(s, d, "findings"), "file_path", 20, "findings")


@query("SELECT CASE WHEN lower(trim(severity)) IN ('critical', 'high', 'medium', 'low', 'info') THEN lower(trim(severity)) ELSE 'medium' END AS severity, detection_type, count(*) AS findings, count(DISTINCT rule_id) AS rules, count(DISTINCT (repo, file_path)) AS files FROM findings GROUP BY ALL")
def summary_by_severity(s, d):
    return reports.summary_by_severity(table(s, d, "findings"))


@query("SELECT finding_id, file_path, line FROM (SELECT *, CASE WHEN lower(trim(severity)) = 'critical' THEN 0 WHEN lower(trim(severity)) = 'high' THEN 1 WHEN lower(trim(severity)) = 'medium' THEN 2 WHEN lower(trim(severity)) = 'low' THEN 3 WHEN lower(trim(severity)) = 'info' THEN 4 ELSE 2 END AS rank FROM findings)")
def sort_findings(s, d):
    return reports.sort_findings(table(s, d, "findings")).select("finding_id", "file_path", "line")


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY recorded_at DESC, ingested_at DESC) AS rn FROM {t} WHERE site_id IS NOT NULL) WHERE rn = 1)"


@query(f"WITH j AS (SELECT coalesce(a.callee_fqn <> '', false) AS e, coalesce(b.resolved, false) AS a FROM {_LATEST.format(t='typechecker_records')} a JOIN {_LATEST.format(t='pathfinder_records')} b ON a.site_id = b.site_id), n AS (SELECT count(*) FILTER (e AND a) AS tp, count(*) FILTER (NOT e AND a) AS fp, count(*) FILTER (e AND NOT a) AS fn, count(*) FILTER (NOT e AND NOT a) AS tn FROM j) SELECT tp, fp, fn, tn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, (tp + tn) / (tp + fp + fn + tn) AS agreement, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1 FROM n")
def diagnostic_metrics(s, d):
    one = lambda t: reports.latest(table(s, d, t).where("site_id IS NOT NULL"), ["site_id"], ["recorded_at", "ingested_at"])
    a, b = one("typechecker_records").select("site_id", (F.col("callee_fqn") != "").alias("expected")), one("pathfinder_records").select("site_id", F.col("resolved").alias("actual"))
    return reports.diagnostic_metrics(a.join(b, "site_id"))


_FLOWS = _ST + ", a AS (SELECT DISTINCT fqn, line AS source_line, line + 3 AS sink_line FROM fx_statements WHERE call_target = 'signup'), b AS (SELECT DISTINCT fqn, line AS source_line, line + 4 AS sink_line FROM fx_statements WHERE call_target IN ('signup', 'view') AND line % 2 = 0), h AS (SELECT a.fqn, a.source_line, a.sink_line, b.source_line AS s2, b.sink_line AS k2 FROM a JOIN b ON a.fqn = b.fqn AND abs(a.source_line - b.source_line) <= 2 AND abs(a.sink_line - b.sink_line) <= 2)"


@query(_FLOWS + ", n AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT fqn, source_line, sink_line FROM h)) AS matched_ours, (SELECT count(*) FROM (SELECT DISTINCT fqn, s2, k2 FROM h)) AS matched_theirs, (SELECT count(*) FROM a) AS ours, (SELECT count(*) FROM b) AS theirs) SELECT *, matched_ours / ours AS precision, matched_theirs / theirs AS recall FROM n")
def flow_compare(s, d):
    st = v.statements(s, d)
    a = st.where("call_target = 'signup'").select("fqn", F.col("line").alias("source_line"), (F.col("line") + 3).alias("sink_line"))
    b = st.where("call_target IN ('signup', 'view') AND line % 2 = 0").select("fqn", F.col("line").alias("source_line"), (F.col("line") + 4).alias("sink_line"))
    got = reports.flow_compare(a, b)
    return got.withColumn("recall", reports.ratio(F.col("matched_theirs"), F.col("theirs"), 1.0))


@query("SELECT sink_fqn, sink_line, sink_call, source_fqn, source_line FROM (SELECT sink_file AS sink_fqn, sink_line, sink_call, function_fqn AS source_fqn, source_line, row_number() OVER (PARTITION BY sink_file, sink_line, sink_call ORDER BY CASE WHEN detection_scope = 'local' THEN 0 ELSE 1 END, function_fqn NULLS FIRST, source_line NULLS FIRST, tainted_var NULLS FIRST) AS rn FROM findings) WHERE rn = 1")
def dedup_flow(s, d):
    from codelattice.operators.logic import dedup_flow

    f = table(s, d, "findings").select(F.col("function_fqn").alias("source_fqn"), "source_line", F.col("tainted_var").alias("source_var"), F.col("sink_file").alias("sink_fqn"), "sink_line", "sink_call", F.col("detection_scope").alias("scope"))
    return dedup_flow(f).select("sink_fqn", "sink_line", "sink_call", "source_fqn", "source_line")


@query("WITH f AS (SELECT DISTINCT finding_id, repo, file_path, line FROM findings WHERE line > 0), s AS (SELECT repo, file_path, min(string_split(replace(source_code, chr(13), ''), chr(10))) AS lines FROM source_files WHERE source_code IS NOT NULL GROUP BY ALL), x AS (SELECT f.finding_id, f.line, s.lines, unnest(range(greatest(f.line - 3, 1), least(f.line + 3, len(s.lines)) + 1)) AS line_no FROM f JOIN s ON f.repo = s.repo AND f.file_path = s.file_path) SELECT finding_id, CAST(line_no AS INT) AS line_no, lines[line_no] AS text, line_no = line AS is_highlight FROM x")
def snippet_context(s, d):
    return reports.snippet_context(table(s, d, "findings"), table(s, d, "source_files").where("source_code IS NOT NULL"))


@query("SELECT finding_id, rule_id FROM (SELECT DISTINCT finding_id, rule_id FROM findings) ORDER BY finding_id, rule_id LIMIT 50 OFFSET 100")
def paginate(s, d):
    return reports.paginate(table(s, d, "findings").select("finding_id", "rule_id").distinct(), ["finding_id", "rule_id"], 50, reports.make_cursor(100))[0]


# Symbols and modules


@query(_FN + "SELECT 'type' AS section, type AS name, count(*) AS n FROM fx_functions GROUP BY type UNION ALL SELECT 'kind', '12', count(*) FROM fx_functions UNION ALL SELECT 'top_module', module, n FROM (SELECT module, count(*) AS n FROM fx_functions GROUP BY module ORDER BY n DESC, module LIMIT 10) UNION ALL SELECT 'edges', 'callers', count(DISTINCT line) FROM fx_functions")
def index_info(s, d):
    f = v.functions(s, d)
    return symbols.index_info(f, f.select(F.col("line").alias("caller"), F.col("fqn").alias("callee")))


@query(_FN + "SELECT fqn, type, file, line FROM fx_functions WHERE contains(fqn, 'f17') AND (fqn = 'app.m7' OR starts_with(fqn, 'app.m7.'))")
def find_symbol(s, d):
    return symbols.find_symbol(v.functions(s, d), "f17", ("function_definition",), "app.m7").select("fqn", "type", "file", "line")


@query(_MO + "SELECT m.module_path, m.file, count(f.fqn) AS functions FROM fx_modules m LEFT JOIN fx_functions f ON starts_with(f.fqn, m.module_path || '.') GROUP BY ALL")
def list_modules(s, d):
    return symbols.module_counts(v.modules(s, d), v.functions(s, d))


@query(_MO + "SELECT m.module_path, m.file, count(f.fqn) AS functions FROM fx_modules m LEFT JOIN fx_functions f ON starts_with(f.fqn, m.module_path || '.') WHERE contains(m.module_path, 'm1') GROUP BY ALL")
def find_module(s, d):
    return symbols.find_module(v.modules(s, d), v.functions(s, d), "m1")


@query(_MO + "SELECT module_path, file, 'short_name' AS match_type FROM fx_modules WHERE module_path = 'app.m12'")
def resolve_import(s, d):
    return symbols.resolve_import(v.modules(s, d), "other.m12")


@query(_ST + "SELECT scope_fqn, var, type_fqn FROM (SELECT fqn AS scope_fqn, def AS var, call_target AS type_fqn, line FROM fx_statements WHERE fqn = 'svc.u7' AND def = 'v2' AND line <= 20 ORDER BY line DESC, call_target LIMIT 1)")
def get_instance_type(s, d):
    b = v.statements(s, d).select(F.col("fqn").alias("scope_fqn"), F.col("def").alias("var"), F.col("call_target").alias("type_fqn"), "line")
    return symbols.get_instance_type(b, "svc.u7", "v2", 20).select("scope_fqn", "var", "type_fqn")


# Compose


@query("SELECT DISTINCT repo, file_path, service, line FROM compose_props WHERE prop_key = 'privileged' AND lower(scalar) = 'true'")
def compose_has(s, d):
    return container.compose_has(table(s, d, "compose_props"), "privileged", equals=True).select("repo", "file_path", "service", "line").distinct()


@query("SELECT DISTINCT repo, file_path, service, line FROM compose_props WHERE prop_key = 'ports' AND len(list_filter(prop_items, lambda x: contains(x, ':80'))) > 0")
def compose_has_item(s, d):
    return container.compose_has(table(s, d, "compose_props"), "ports", contains=":80").select("repo", "file_path", "service", "line").distinct()


@query("SELECT repo, file_path, service, min(service_line) AS line FROM compose_props GROUP BY ALL HAVING count(*) FILTER (prop_key = 'restart') = 0")
def compose_missing(s, d):
    return container.compose_missing(table(s, d, "compose_props"), "restart")


@query("SELECT repo, file_path, service, coalesce(bool_or(prop_key = 'privileged' AND lower(scalar) IN ('true', 'yes', '1')), false) AS privileged, count(DISTINCT line) FILTER (prop_key = 'ports') AS port_lists FROM compose_props GROUP BY ALL")
def compose_facts(s, d):
    return container.compose_facts(table(s, d, "compose_props").distinct()).select("repo", "file_path", "service", "privileged", "port_lists")


@query("SELECT DISTINCT repo, file_path, service, regexp_extract(e, '^([^=]+)', 1) AS name, regexp_extract(e, '^[^=]+=(.*)$', 1) AS value FROM (SELECT repo, file_path, service, unnest(prop_items) AS e FROM compose_props WHERE prop_key = 'environment')")
def compose_environment(s, d):
    return container.compose_environment(table(s, d, "compose_props")).distinct()


@query("SELECT repo, file_path, service, min(service_line) AS line FROM compose_props WHERE contains(service, 'le') GROUP BY ALL HAVING bool_or(prop_key = 'privileged' AND lower(scalar) = 'true') ORDER BY repo, file_path, service LIMIT 100")
def find_compose_services(s, d):
    return symbols.find_compose_services(table(s, d, "compose_props"), name="le", privileged=True)


def _depends(s, d) -> DataFrame:
    """Each service as depending on the next one of its file, in the order of their lines."""
    p = table(s, d, "compose_props").groupBy("repo", "file_path", "service").agg(F.min("service_line").alias("at"))
    from pyspark.sql import Window

    nxt = F.lead("service").over(Window.partitionBy("repo", "file_path").orderBy("at", "service"))
    return p.withColumn("_n", nxt).where("_n IS NOT NULL").select(F.concat_ws("/", "repo", "file_path").alias("file_path"), "service", F.lit("depends_on").alias("prop_key"), F.array("_n").alias("prop_items"))


@query("SELECT repo || '/' || file_path AS file, service AS src, n AS dst FROM (SELECT repo, file_path, service, lead(service) OVER (PARTITION BY repo, file_path ORDER BY a, service) AS n FROM (SELECT repo, file_path, service, min(service_line) AS a FROM compose_props GROUP BY ALL)) WHERE n IS NOT NULL")
def dep_graph_compose(s, d):
    return traversal.dep_graph_compose(_depends(s, d))


# Sources. What parsers yield is held against plain patterns over the same text where those can tell.

_FILES = "files AS (SELECT repo || '/' || file_path AS file, file_path AS rel_path, arg_max(coalesce(source_code, ''), {'a': committed_at, 'b': source_code}) AS content FROM source_files GROUP BY repo, file_path)"


def _files(s, d) -> DataFrame:
    return files.table_files(table(s, d, "source_files"))


@query(f"WITH {_FILES} SELECT file, CASE WHEN starts_with(lower(split_part(rel_path, '/', -1)), 'dockerfile') THEN 'dockerfile' WHEN regexp_matches(lower(split_part(rel_path, '/', -1)), 'docker-compose.*\\.ya?ml$') THEN 'compose' WHEN ends_with(rel_path, '.py') THEN 'python' WHEN ends_with(rel_path, '.go') THEN 'go' ELSE 'java' END AS lang, length(content) AS chars, sha256(content) AS sha256 FROM files")
def scan_files(s, d):
    return _files(s, d).select("file", "lang", F.length("content").cast("bigint").alias("chars"), "sha256")


@query(f"WITH {_FILES} SELECT regexp_replace(replace(regexp_replace(rel_path, '\\.py$', ''), '/', '.'), '(^|\\.)__init__$', '') AS module_path, file FROM files WHERE ends_with(rel_path, '.py') AND NOT (split_part(rel_path, '/', -1) LIKE 'test\\_%' ESCAPE '\\' OR ends_with(rel_path, '_test.py'))")
def scan_modules(s, d):
    return files.scan_modules(_files(s, d), skip_tests=True).select("module_path", "file")


def _facts(s, d, lang: str):
    extract = {"python": python_code.extract, "go": brace_code.extract_go, "java": brace_code.extract_java}[lang]
    f = _files(s, d).where(F.col("lang") == lang)
    return facts.parsed(f.withColumn("module", scalar.module_path(F.regexp_replace("rel_path", r"\.(?:go|java)$", ".py"))), extract)


def _counts(s, d, lang: str) -> DataFrame:
    f = _facts(s, d, lang)
    per = F.array(*(F.struct(F.lit(t).alias("fact"), F.size(t).alias("n")) for t in facts.TABLES))
    kinds = f.select(F.explode("nodes.type").alias("fact"), F.lit(1).alias("n"))
    return f.select(F.explode(per).alias("x")).select("x.*").unionByName(kinds).groupBy("fact").agg(F.sum("n").alias("n"))


@query()
def scan_python(s, d):
    return _counts(s, d, "python")


@query()
def scan_go(s, d):
    return _counts(s, d, "go")


@query(f"""WITH {_FILES}, s AS (SELECT file, regexp_replace(content, '"(?:[^"\\\\\\n]|\\\\.)*"|''(?:[^''\\\\\\n]|\\\\.)*''|//[^\\n]*|/\\*(?s:.*?)\\*/|`[^`]*`', 'x', 'g') AS c FROM files WHERE ends_with(rel_path, '.go')),
l AS (SELECT file, unnest(string_split(c, chr(10))) AS l FROM s)
SELECT file, regexp_extract(l, '^func\\s+(?:\\([^)]*\\)\\s*)?(\\w+)\\s*(?:\\[[^\\]]*\\])?\\(', 1) AS name, count(*) AS n FROM l WHERE regexp_matches(l, '^func\\s+(?:\\([^)]*\\)\\s*)?\\w+\\s*(?:\\[[^\\]]*\\])?\\(') GROUP BY ALL""")
def scan_go_functions(s, d):
    """Functions and methods of Go files by name, damaged files included; the SQL reads them off lines without literals and comments."""
    nodes = facts.table_of(_facts(s, d, "go"), "nodes").where(F.col("type").isin("method", "init_function", "function_declaration"))
    return nodes.groupBy("file", "name").agg(F.count("*").alias("n"))


@query()
def scan_java(s, d):
    return _counts(s, d, "java")


@query()
def extract_imports(s, d):
    return facts.table_of(_facts(s, d, "python"), "imports").select("file", "alias", "fqn", "level")


@query()
def extract_call_sites(s, d):
    return facts.table_of(_facts(s, d, "python"), "call_sites").groupBy("target").agg(F.count("*").alias("calls"), F.countDistinct("file").alias("files"))


@query()
def extract_statements(s, d):
    both = [facts.table_of(_facts(s, d, lang), "statements").withColumn("lang", F.lit(lang)) for lang in ("python", "go")]
    return both[0].unionByName(both[1]).groupBy("lang", "type").agg(F.count("*").alias("statements"), F.count_if(F.col("def") != "").alias("defs"), F.sum(F.size("uses")).alias("uses"))


@query()
def extract_variables(s, d):
    return facts.table_of(_facts(s, d, "python"), "bindings").groupBy("source", "type_fqn").agg(F.count("*").alias("bindings"), F.max("confidence").alias("confidence"))


@query()
def extract_class_attributes(s, d):
    a = [facts.table_of(_facts(s, d, lang), "class_attributes").withColumn("lang", F.lit(lang)) for lang in ("python", "go", "java")]
    return a[0].unionByName(a[1]).unionByName(a[2]).groupBy("lang", "type_fqn").agg(F.count("*").alias("attributes"), F.countDistinct("class_fqn").alias("classes"))


@query()
def infer_return_types(s, d):
    from codelattice.operators.resolution import merge_return_types

    r = facts.table_of(_facts(s, d, "python"), "returns").withColumn("fqn", F.concat_ws(":", "file", "fqn"))
    return merge_return_types(r).groupBy("type_fqn").agg(F.count("*").alias("functions"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query()
def index_functions(s, d):
    """Functions and their annotated parameters by kind."""
    n = facts.table_of(_facts(s, d, "python"), "nodes").where(F.col("type").isin("function_definition", "method", "constructor", "property", "special_method", "parameter"))
    return n.groupBy("type").agg(F.count("*").alias("symbols"), F.countDistinct("file", "fqn").alias("names"), F.sum(F.size("params")).alias("params"))


@query()
def build_cfg_go(s, d):
    """Control flow edges of Go functions by kind."""
    return facts.table_of(_facts(s, d, "go"), "cfg_edges").groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("file", "fqn").alias("functions"))


@query(_ST + """SELECT s.fqn, s.line, coalesce(p.t, (SELECT max_by('lib.' || b.call_target, b.line) FROM fx_statements b WHERE b.fqn = s.fqn AND b.def = s.use_var AND b.line <= s.line), s.use_var) || '.' || s.call_target AS call_chain
FROM fx_statements s LEFT JOIN (SELECT DISTINCT fqn, 'v0' AS var, 'lib.P' AS t FROM fx_statements WHERE line % 2 = 0) p ON p.fqn = s.fqn AND p.var = s.use_var""")
def enrich_go_chains(s, d):
    from codelattice.operators.resolution import enrich_go_chains

    st = v.statements(s, d)
    params = st.where("line % 2 = 0").select("fqn", F.lit("v0").alias("var"), F.lit("*lib.P").alias("type_fqn")).distinct()
    bound = st.where("def <> ''").select("fqn", F.col("def").alias("var"), "line", F.concat(F.lit("lib."), "call_target").alias("type_fqn"))
    chains = st.withColumn("call_chain", F.concat_ws(".", "use_var", "call_target"))
    return enrich_go_chains(chains, params, bound).select("fqn", "line", "call_chain")


@query()
def build_cfg(s, d):
    return facts.table_of(_facts(s, d, "python"), "cfg_edges").groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("file", "fqn").alias("functions"))


@query()
def dominators(s, d):
    from codelattice.operators import dataflow

    return dataflow.dominators(facts.table_of(_facts(s, d, "python"), "cfg_edges")).groupBy(F.size("dominators").alias("depth")).agg(F.count("*").alias("blocks"))


@query()
def all_paths(s, d):
    from codelattice.operators import dataflow

    return dataflow.all_paths(facts.table_of(_facts(s, d, "python"), "cfg_edges")).groupBy("file", "fqn").agg(F.count("*").alias("paths"), F.max(F.size("path")).alias("longest"))


@query()
def source_flows(s, d):
    """Dataflow over the parsed functions: what ``read`` and ``get`` give that reaches ``execute`` and logging."""
    from codelattice.operators import dataflow

    st = stored(facts.table_of(_facts(s, d, "python"), "statements").withColumn("fqn", F.concat_ws(":", "file", "fqn")), "statements")  # parsed once, read twice
    return dataflow.vdg_flows(st, ["read", "get", "index", "verify", "rank", "load", "collect", "fetch", "sample"], ["execute", "log.info", "log.warning"]).select("fqn", "source_line", "sink_line", "sink_call")


@query(f"WITH {_FILES} SELECT file, count(*) AS froms FROM (SELECT file, unnest(string_split(replace(content, chr(13), ''), chr(10))) AS l FROM files WHERE starts_with(lower(split_part(rel_path, '/', -1)), 'dockerfile')) WHERE regexp_matches(l, '^(?i:from)\\s') GROUP BY file")
def scan_dockerfile(s, d):
    i = container_code.scan_dockerfile(_files(s, d))
    return i.where("instruction = 'FROM'").groupBy("file").agg(F.count("*").alias("froms"))


def _docker(s, d) -> DataFrame:
    return container_code.scan_dockerfile(_files(s, d))


@query(f"WITH {_FILES}, l AS (SELECT file, unnest(string_split(replace(content, chr(13), ''), chr(10))) AS l FROM files WHERE starts_with(lower(split_part(rel_path, '/', -1)), 'dockerfile')), f AS (SELECT file, regexp_extract(l, '^FROM (\\S+)', 1) AS image FROM l WHERE regexp_matches(l, '^FROM \\S')) SELECT file, CASE WHEN contains(image, '@') THEN split_part(image, '@', 1) ELSE regexp_replace(image, ':[^:/]*$', '') END AS name, CASE WHEN contains(image, '@') THEN '' WHEN regexp_matches(image, ':[^:/]*$') THEN regexp_extract(image, ':([^:/]*)$', 1) ELSE 'latest' END AS tag, CASE WHEN contains(image, '@') THEN split_part(image, '@', 2) ELSE '' END AS digest FROM f")
def docker_images(s, d):
    i = _docker(s, d).where("instruction = 'FROM'")
    return i.select("file", scalar.image_parts(F.when(F.col("digest") != "", F.concat_ws("@", "image", "digest")).when(F.col("tag") == "latest", F.col("image")).otherwise(F.concat_ws(":", "image", "tag"))).alias("_i"), "tag").select("file", F.col("_i.name").alias("name"), "tag", F.col("_i.digest").alias("digest"))


#: Instructions of Dockerfiles in SQL: lines joined over continuations, without comments; FROM's image, tag and alias.
_DOCKER = f"""WITH {_FILES}, d AS (SELECT file, string_split(replace(content, chr(13), ''), chr(10)) AS ls FROM files WHERE starts_with(lower(split_part(rel_path, '/', -1)), 'dockerfile')),
l AS (SELECT file, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS n FROM d), r AS (SELECT file, n, trim(l) AS l FROM l WHERE trim(l) <> '' AND NOT starts_with(trim(l), '#')),
g AS (SELECT *, coalesce(sum(CASE WHEN ends_with(l, chr(92)) THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
j AS (SELECT file, min(n) AS line, string_agg(CASE WHEN ends_with(l, chr(92)) THEN trim(left(l, length(l) - 1)) ELSE l END, ' ' ORDER BY n) AS raw FROM g GROUP BY file, k),
i AS (SELECT file, CAST(line AS INTEGER) AS line, raw, upper(regexp_extract(raw, '^(\\w+)', 1)) AS instruction, trim(regexp_replace(raw, '^\\w+', '')) AS rest FROM j WHERE upper(regexp_extract(raw, '^(\\w+)', 1)) IN ('FROM', 'RUN', 'CMD', 'LABEL', 'EXPOSE', 'ENV', 'ADD', 'COPY', 'ENTRYPOINT', 'VOLUME', 'USER', 'WORKDIR', 'ARG', 'STOPSIGNAL', 'HEALTHCHECK', 'SHELL', 'ONBUILD', 'MAINTAINER'))"""


_IMAGES = _DOCKER + """, m AS (SELECT *, regexp_extract(rest, '^(\\S+)', 1) AS ref, regexp_extract(rest, '(?i)\\s+AS\\s+(\\S+)$', 1) AS alias FROM i),
x AS (SELECT *, CASE WHEN contains(ref, '@') THEN split_part(ref, '@', 1) ELSE regexp_replace(ref, ':[^:/]*$', '') END AS image, CASE WHEN contains(ref, '@') THEN '' WHEN regexp_matches(ref, ':[^:/]*$') THEN regexp_extract(ref, ':([^:/]*)$', 1) ELSE 'latest' END AS tag, CASE WHEN contains(ref, '@') THEN split_part(ref, '@', 2) ELSE '' END AS digest FROM m)"""


@query(_DOCKER + " SELECT file, line, instruction, raw FROM i")
def scan_dockerfile_rows(s, d):
    """Every instruction of every Dockerfile."""
    return _docker(s, d).select("file", "line", "instruction", "raw")


@query(_IMAGES + """ SELECT file, line, raw FROM x WHERE instruction = 'FROM' AND tag = 'latest' UNION ALL SELECT file, line, raw FROM x WHERE instruction = 'EXPOSE' AND len(list_filter(regexp_extract_all(rest, '\\d+'), lambda p: CAST(p AS INTEGER) < 1024)) > 0
UNION ALL SELECT file, line, raw FROM x WHERE instruction = 'FROM' AND digest = ''""")
def docker_instruction(s, d):
    i = _docker(s, d)
    return container.docker_instruction(i, "FROM", image_tag="latest").select("file", "line", "raw").unionByName(container.docker_instruction(i, "EXPOSE", port_less_than=1024).select("file", "line", "raw")).unionByName(container.docker_instruction(i, "FROM", missing_digest=True).select("file", "line", "raw"))


_LINES = f"WITH {_FILES}, d AS (SELECT file, string_split(replace(content, chr(13), ''), chr(10)) AS ls FROM files WHERE starts_with(lower(split_part(rel_path, '/', -1)), 'dockerfile')), l AS (SELECT file, unnest(ls) AS l, unnest(range(len(ls))) AS n FROM d)"


@query(_LINES + " SELECT file, 1 AS line FROM d WHERE file NOT IN (SELECT file FROM l WHERE regexp_matches(l, '^USER\\s*'))")
def docker_missing(s, d):
    return container.docker_missing(_files(s, d).where("lang = 'dockerfile'"), _docker(s, d), "USER")


@query(_LINES + ", i AS (SELECT DISTINCT file FROM l WHERE regexp_matches(l, '^(FROM|RUN|CMD|LABEL|EXPOSE|ENV|ADD|COPY|ENTRYPOINT|VOLUME|USER|WORKDIR|ARG|STOPSIGNAL|HEALTHCHECK|SHELL)\\b')), u AS (SELECT file, arg_max(regexp_extract(l, '^USER\\s+([^:\\s]+)', 1), n) AS u FROM l WHERE regexp_matches(l, '^USER\\b') GROUP BY file) SELECT i.file, coalesce(u.u, '') AS final_user, coalesce(u.u, '') IN ('', 'root', '0') AS runs_as_root FROM i LEFT JOIN u ON u.file = i.file")
def docker_final_user(s, d):
    return container.docker_final_user(_docker(s, d))


@query(_IMAGES + """, s AS (SELECT *, lead(line) OVER w AS nxt, row_number() OVER w - 1 AS stage_index FROM x WHERE instruction = 'FROM' WINDOW w AS (PARTITION BY file ORDER BY line)), e AS (SELECT file, max(line) AS last FROM i GROUP BY file)
SELECT s.file, stage_index, alias, image, line AS start_line, coalesce(nxt - 1, last) AS end_line, nxt IS NULL AS is_final FROM s JOIN e ON e.file = s.file""")
def docker_stages(s, d):
    return container.docker_stages(_docker(s, d))


@query(_IMAGES + """ SELECT file, arg_min(CASE WHEN instruction = 'FROM' THEN image END, CASE WHEN instruction = 'FROM' THEN line END) AS base_image, count(*) AS instructions, count(*) FILTER (instruction = 'FROM') AS stages, count(*) FILTER (instruction = 'FROM' AND alias <> '') > 0 AS multi_stage,
bool_or(instruction = 'USER') AS has_user, bool_or(instruction = 'HEALTHCHECK') AS has_healthcheck, bool_or(instruction = 'ENTRYPOINT') AS has_entrypoint, bool_or(instruction = 'CMD') AS has_cmd, bool_or(instruction = 'EXPOSE') AS has_expose, bool_or(instruction = 'WORKDIR') AS has_workdir FROM x GROUP BY file""")
def dockerfile_details(s, d):
    return container.dockerfile_details(_docker(s, d))


@query(_DOCKER + """, r1 AS (SELECT * FROM i WHERE instruction = 'USER' AND split_part(rest, ':', 1) = 'root'), r2 AS (SELECT * FROM i WHERE instruction = 'RUN' AND contains(raw, 'curl')), u AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2)
SELECT 'all_of' AS op, file, line, raw FROM r1 WHERE file IN (SELECT file FROM r2) UNION ALL SELECT 'any_of', file, line, raw FROM u UNION ALL SELECT 'none_of', file, line, raw FROM u""")
def docker_combinators(s, d):
    i = _docker(s, d)
    root, curl = container.docker_instruction(i, "USER", user_name="root"), container.docker_instruction(i, "RUN", contains="curl")
    a, b, c = container_all_of([root, curl]), container_any_of([root, curl]), container_none_of([root, curl])
    cols = ("file", "line", "raw")
    return a.select(F.lit("all_of").alias("op"), *cols).unionByName(b.select(F.lit("any_of").alias("op"), *cols)).unionByName(c.select(F.lit("none_of").alias("op"), *cols))


@query(_IMAGES + """, f AS (SELECT file, min(line) AS line FROM i WHERE instruction = 'FROM' GROUP BY file), s AS (SELECT x.file, x.image, CASE WHEN alias <> '' THEN alias ELSE 'stage-0' END AS stage FROM x JOIN f ON f.file = x.file AND f.line = x.line)
SELECT DISTINCT i.file, s.stage AS src, 'base-' || upper(left(split_part(i.rest, ' ', 1), 1)) AS dst FROM i JOIN s ON s.file = i.file WHERE i.instruction = 'COPY' AND i.file NOT IN (SELECT file FROM x WHERE instruction = 'FROM' GROUP BY file HAVING count(*) > 1)""")
def dep_graph_dockerfile(s, d):
    """Each COPY read as copying from an image named by its source's first letter; the files' own copies name no stage."""
    i = _docker(s, d)
    one = i.groupBy("file").agg(F.count_if(F.col("instruction") == "FROM").alias("_n")).where("_n = 1").select("file")
    named = i.join(one, "file", "left_semi").withColumn("copy_from", F.when(F.col("instruction") == "COPY", F.concat(F.lit("base-"), F.upper(F.substring(F.regexp_extract("raw", r"^\w+\s+(\S+)", 1), 1, 1)))).otherwise(F.lit("")))
    return traversal.dep_graph_dockerfile(named)


@query(_DOCKER + " SELECT file, line, raw FROM i WHERE instruction = 'RUN' AND contains(file, 'deploy') ORDER BY file, line LIMIT 100")
def find_docker_instructions(s, d):
    return symbols.find_docker_instructions(_docker(s, d), kind="RUN", path="deploy").select("file", "line", "raw")


@query("SELECT DISTINCT repo || '/' || file_path AS file, service, service_line, prop_key, kind, scalar, line, array_to_string(prop_items, '|') AS items FROM compose_props")
def scan_compose(s, d):
    """Held against the given table of properties, in which files that can't be read have no rows."""
    return container_code.scan_compose(_files(s, d)).select("file", "service", "service_line", "prop_key", "kind", "scalar", "line", F.array_join("prop_items", "|").alias("items"))


@query()
def scan_type_registry(s, d):
    nodes = problems.registry_nodes(s, d)
    f = registry.registry_functions(nodes, table(s, d, "stdlib_modules"), "module_name")
    g = registry.registry_functions(nodes, table(s, d, "go_packages"), "import_path")
    return f.unionByName(g).groupBy("return_type").agg(F.count("*").alias("functions"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query()
def scan_mro(s, d):
    return registry.registry_mro(problems.registry_nodes(s, d), table(s, d, "stdlib_modules"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'builtins.int' WHEN 1 THEN 'builtins.str' WHEN 2 THEN 'builtins.list' WHEN 3 THEN 'builtins.float' WHEN 4 THEN 'builtins.dict' END AS type_fqn FROM customer")
def builtin_registry(s, d):
    k = F.col("c_custkey")
    text = F.when(k % 6 == 0, k.cast("string")).when(k % 6 == 1, F.concat(F.lit("'"), "c_name", F.lit("'"))).when(k % 6 == 2, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).when(k % 6 == 3, F.concat(k.cast("string"), F.lit(".5"))).when(k % 6 == 4, "{'a': 1}").otherwise(F.concat(F.lit("f("), k.cast("string"), F.lit(")")))
    return table(s, d, "customer").select("c_custkey", registry.infer_literal(text).alias("type_fqn"))


# Scalar functions


@query("SELECT callee, count(*) AS n, split_part(callee, '.', -1) AS short, regexp_extract(callee, '^(.*)\\.[^.]*$', 1) AS module, regexp_extract(callee, '^((?:[^/]*/)*[^./]*)', 1) AS go_module, sha256(callee || '-x') AS id FROM (SELECT coalesce(our_fqn, '') AS callee FROM pathfinder_records) GROUP BY ALL")
def scalar_names(s, d):
    c = F.col("callee")
    return table(s, d, "pathfinder_records").select(F.coalesce("our_fqn", F.lit("")).alias("callee")).groupBy("callee").agg(F.count("*").alias("n")).select("callee", "n", scalar.short_name(c).alias("short"), scalar.module_of(c).alias("module"), scalar.go_module_name(c).alias("go_module"), scalar.sha256_id(c, F.lit("x")).alias("id"))


@query("SELECT finding_id, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS level, CASE WHEN coalesce(detection_scope, '') = '' THEN 'pattern' WHEN detection_scope = 'local' THEN 'taint-local' ELSE 'taint-global' END AS kind, CASE WHEN regexp_extract(cwe, '(\\d+)', 1) <> '' THEN 'https://cwe.mitre.org/data/definitions/' || regexp_extract(cwe, '(\\d+)', 1) || '.html' WHEN cwe IS NULL THEN '' ELSE '' END AS url, greatest(0.0, least(1.0, confidence * 1.5)) AS clamped FROM findings")
def scalar_findings(s, d):
    c = F.col("confidence")
    return table(s, d, "findings").select("finding_id", scalar.confidence_level(c).alias("level"), scalar.detection_type(F.col("detection_scope")).alias("kind"), scalar.cwe_url(F.col("cwe")).alias("url"), scalar.clamp(c * 1.5).alias("clamped"))


@query("SELECT def_id, fn_name, CASE WHEN lang = 'go' THEN CASE WHEN regexp_matches(fn_name, '^[A-Z]') THEN 'public' ELSE 'private' END WHEN starts_with(fn_name, '_') THEN 'private' ELSE 'public' END AS visibility, regexp_matches(fn_name, '^[A-Z][A-Za-z0-9]*$') AND regexp_matches(fn_name, '[a-z]') AS pascal, regexp_matches(fn_name, '^[A-Z0-9_]*[A-Z][A-Z0-9_]*$') AS is_constant, split_part(signature, '(', 1) AS head FROM definitions")
def scalar_symbols(s, d):
    n = F.col("fn_name")
    return table(s, d, "definitions").select("def_id", "fn_name", scalar.visibility(n, F.col("lang")).alias("visibility"), scalar.is_pascal_case(n).alias("pascal"), scalar.is_constant_name(n).alias("is_constant"), scalar.strip_parens(F.col("signature")).alias("head"))


@query("SELECT finding_id, 0.95 * 0.9 * confidence AS combined FROM findings")
def confidence_model(s, d):
    from codelattice.operators.resolution import confidence_of

    values = F.array(confidence_of(F.lit("literal")), confidence_of(F.lit("return")), F.col("confidence"))
    return table(s, d, "findings").select("finding_id", scalar.combine_confidence(values).alias("combined"))


# Exports


@query("SELECT DISTINCT rule_id, min(file_path) AS file, count(*) AS n FROM findings GROUP BY rule_id")
def sink_csv(s, d):
    return sinks.csv_rows(table(s, d, "findings")).groupBy("rule_id").agg(F.min("file").alias("file"), F.count("*").alias("n"))


@query("SELECT rule_id, message, line, confidence FROM findings")
def sink_json(s, d):
    j = sinks.json_rows(table(s, d, "findings")).select(F.from_json("result", "rule struct<id:string>, message string, location struct<line:int>, detection struct<confidence:double>").alias("r"))
    return j.select(F.col("r.rule.id").alias("rule_id"), "r.message", F.col("r.location.line").alias("line"), F.col("r.detection.confidence").alias("confidence"))


_SEV = "CASE WHEN lower(trim(severity)) IN ('critical', 'high', 'medium', 'low', 'info') THEN lower(trim(severity)) ELSE 'medium' END"


@query(f"SELECT rule_id, CASE {_SEV} WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS n, count(*) FILTER (source_line IS NOT NULL AND sink_line IS NOT NULL) AS flows FROM findings GROUP BY ALL")
def sink_sarif(s, d):
    r = sinks.sarif_results(table(s, d, "findings")).select("rule_id", F.from_json("result", "level string, codeFlows array<string>").alias("r"))
    return r.groupBy("rule_id", F.col("r.level").alias("level")).agg(F.count("*").alias("n"), F.count_if(F.col("r.codeFlows").isNotNull()).alias("flows"))


@query(f"SELECT rule_id, arg_min({_SEV}, {{'a': CASE {_SEV} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, 'b': rule_name}}) AS severity FROM findings GROUP BY rule_id")
def sarif_rules(s, d):
    return sinks.sarif_rules(table(s, d, "findings")).select("rule_id", "severity")


@query(f"SELECT file_path AS path, line, min('**' || {_SEV} || '** ' || rule_id || ': ' || coalesce(message, '')) AS body FROM findings WHERE {_SEV} IN ('critical', 'high') GROUP BY file_path, line, rule_id")
def pr_comments(s, d):
    return sinks.pr_comments(table(s, d, "findings"))


@query("SELECT file_path AS file, line, col AS column, caller_fqn AS function, target, coalesce(our_fqn, '') AS target_fqn, 'not_in_imports' AS reason FROM pathfinder_records WHERE NOT resolved")
def sink_unresolved_csv(s, d):
    return sinks.unresolved_rows(v.engine_sites(s, d))
