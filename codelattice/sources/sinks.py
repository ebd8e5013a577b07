"""Findings as JSON, CSV, SARIF and text, exit codes, comment payloads, and the cache of parsed tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions.scalar import SARIF_LEVEL, SARIF_SCORE, SEVERITIES, _case, normalize_severity, severity_rank
from codelattice.session import stored

# The columns of the CSV export in their order.
CSV_COLUMNS = ("severity", "confidence", "rule_id", "rule_name", "cwe", "owasp", "file", "line", "column", "function", "message", "detection_type", "detection_scope", "source_file", "source_line", "sink_file", "sink_line", "tainted_var", "sink_call")


def csv_rows(findings: DataFrame) -> DataFrame:
    """The 19 columns; confidence is its label, of several CWE or OWASP entries the first counts."""
    first = lambda c: F.trim(F.substring_index(F.coalesce(F.col(c), F.lit("")), ",", 1))
    return findings.select(
        normalize_severity(F.col("severity")).alias("severity"), F.coalesce("confidence_label", F.lit("")).alias("confidence"), "rule_id", "rule_name", first("cwe").alias("cwe"), first("owasp").alias("owasp"), F.col("file_path").alias("file"), "line", F.col("col").alias("column"),
        F.col("function_fqn").alias("function"), "message", "detection_type", "detection_scope", "source_file", "source_line", "sink_file", "sink_line", "tainted_var", "sink_call",
    )


def write_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.mode("overwrite").option("header", True).csv(path)


def json_rows(findings: DataFrame) -> DataFrame:
    """``(result)``: each finding as a JSON object with its rule, place, flow and metadata."""
    place = F.struct(F.col("file_path").alias("file"), "line", F.col("col").alias("column"), F.col("function_fqn").alias("function"))
    rule = F.struct(F.col("rule_id").alias("id"), F.col("rule_name").alias("name"), normalize_severity(F.col("severity")).alias("severity"), "cwe", "owasp")
    flow = F.struct(F.struct(F.col("source_file").alias("file"), F.col("source_line").alias("line"), F.col("tainted_var").alias("variable")).alias("source"), F.struct(F.col("sink_file").alias("file"), F.col("sink_line").alias("line"), F.col("sink_call").alias("call")).alias("sink"))
    how = F.struct(F.col("detection_type").alias("type"), F.col("detection_scope").alias("scope"), "confidence", F.col("confidence_label").alias("level"))
    return findings.select(F.to_json(F.struct(rule.alias("rule"), place.alias("location"), "message", how.alias("detection"), flow.alias("dataflow")), {"ignoreNullFields": "false"}).alias("result"))


def write_json(findings: DataFrame, path: str) -> None:
    json_rows(findings).write.mode("overwrite").text(path)


def sarif_level(severity: Column) -> Column:
    return _case(normalize_severity(severity), SARIF_LEVEL, "warning")


def sarif_results(findings: DataFrame) -> DataFrame:
    """``(rule_id, result)``: SARIF results, with a code flow where source and sink are known."""
    at = lambda f, line, col: F.struct(F.struct(F.struct(F.col(f).alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce(F.col(line), F.lit(1)), F.lit(1)).alias("startLine"), F.greatest(F.coalesce(col, F.lit(1)), F.lit(1)).alias("startColumn")).alias("region")).alias("physicalLocation"))
    step = lambda f, line: F.struct(at(f, line, F.lit(1)).alias("location"))
    flow = F.when(F.col("source_line").isNotNull() & F.col("sink_line").isNotNull(), F.array(F.struct(F.array(F.struct(F.array(step("source_file", "source_line"), step("sink_file", "sink_line")).alias("locations"))).alias("threadFlows"))))
    body = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(at("file_path", "line", F.col("col"))).alias("locations"), flow.alias("codeFlows"))
    return findings.select("rule_id", F.to_json(body).alias("result"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """The rules block: one entry a rule, by its gravest finding."""
    s = normalize_severity(F.col("severity"))
    one = findings.groupBy("rule_id").agg(F.min_by(F.struct("rule_name", s.alias("severity")), F.struct(severity_rank(s), "rule_name")).alias("_r"))
    return one.select("rule_id", "_r.rule_name", "_r.severity", _case(F.col("_r.severity"), SARIF_SCORE, "5.0").alias("security_severity"), _case(F.col("_r.severity"), SARIF_LEVEL, "warning").alias("level"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """A directory with ``results`` (one JSON object a line) and ``rules``; results are written by all executors, not gathered."""
    sarif_results(findings).select("result").write.mode("overwrite").text(f"{path}/results")
    sarif_rules(findings).select(F.to_json(F.struct("*"))).write.mode("overwrite").text(f"{path}/rules")


def text_rows(findings: DataFrame) -> DataFrame:
    """``(severity, line)``: the listing of all findings for people to read, in order of severity, place and rule."""
    s = normalize_severity(F.col("severity"))
    line = F.concat(F.lit("  "), "file_path", F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("")), F.lit(" "), "rule_id", F.lit(" "), F.coalesce("message", F.lit("")))
    return findings.orderBy(severity_rank(s), "file_path", "line", "rule_id", "message").select(s.alias("severity"), line.alias("line"))


def write_text(findings: DataFrame, path: str) -> None:
    """The whole listing as text files in order, written by all executors."""
    text_rows(findings).select("line").write.mode("overwrite").text(path)


def text_report(findings: DataFrame, limit: int = 200) -> str:
    """A listing for the terminal: the counts of all findings, and up to ``limit`` of them; it says how many more there are.

    ``write_text`` writes them all.
    """
    s = normalize_severity(F.col("severity"))
    counts = {r.s: r.n for r in findings.groupBy(s.alias("s")).agg(F.count("*").alias("n")).collect()}  # five rows at most
    rows = text_rows(findings.where(s != "info")).limit(limit).collect()
    lines = []
    for level in SEVERITIES:
        if counts.get(level):
            lines.append(f"{level.upper()} ({counts[level]})")
            lines += [r.line for r in rows if r.severity == level]
    more = sum(n for k, n in counts.items() if k != "info") - len(rows)
    return "\n".join([*lines, *([f"{more} more findings are not listed"] if more > 0 else []), f"{sum(counts.values())} findings"])


def json_document(findings: DataFrame, tool: str, version: str, errors: Sequence[str] = ()) -> DataFrame:
    """``(part, line)``: a JSON document as lines in the order of ``part``: head with tool and summary, one result a line, and the end.

    Results stay distributed; only the counts by severity and rule are aggregated. Written in order they are one document.
    """
    spark = findings.sparkSession
    s = normalize_severity(F.col("severity"))
    by = findings.groupBy(s.alias("severity")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("by_severity"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    rules = findings.agg(F.countDistinct("rule_id").alias("rules"), F.countDistinct("file_path").alias("files"))
    head = by.crossJoin(rules).select(  # two single rows
        F.lit(0).cast("bigint").alias("part"),
        F.concat(F.lit('{"tool":'), F.to_json(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"))), F.lit(',"scan":'), F.to_json(F.struct("files", "rules")), F.lit(',"summary":'), F.to_json(F.struct("total", "by_severity")), F.lit(f',"errors":{json.dumps(list(errors))},"results":[')).alias("line"),
    )
    # Written once, so that the numbers of the lines are the same wherever they are read.
    results = stored(json_rows(findings).select((F.monotonically_increasing_id() + 1).alias("part"), F.col("result").alias("line")), "findings")
    last = results.agg(F.max("part").alias("m"))
    results = results.crossJoin(F.broadcast(last)).select("part", F.concat("line", F.when(F.col("part") < F.col("m"), ",").otherwise("")).alias("line"))  # one row
    end = spark.range(1).select(F.lit((1 << 63) - 1).alias("part"), F.lit("]}").alias("line"))
    return head.unionByName(results).unionByName(end)


def write_json_document(findings: DataFrame, path: str, tool: str, version: str, errors: Sequence[str] = ()) -> None:
    """The document as text files whose lines, file by file, are one JSON object."""
    json_document(findings, tool, version, errors).orderBy("part").select("line").write.mode("overwrite").text(path)


def call_site_rows(call_sites: DataFrame) -> DataFrame:
    """``(site)``: each call site with its resolution as a JSON object."""
    have = set(call_sites.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    place = F.struct("file", "line", (F.col("col") if "col" in have else F.lit(0)).alias("column"))
    how = F.struct(F.coalesce("resolved", F.lit(False)).alias("resolved"), text("failure_reason").alias("failure_reason"), (F.col("via_type_inference") if "via_type_inference" in have else F.lit(False)).alias("via_type_inference"), text("type_source").alias("type_source"))
    return call_sites.select(F.to_json(F.struct(F.col("caller_fqn").alias("caller"), "target", text("target_fqn").alias("target_fqn"), place.alias("location"), how.alias("resolution"))).alias("site"))


def write_call_sites(call_sites: DataFrame, path: str) -> None:
    call_site_rows(call_sites).write.mode("overwrite").text(path)


def exit_code(findings: DataFrame, fail_on: tuple[str, ...] = (), errors: bool = False) -> int:
    """2 after errors, 1 if a finding has one of the severities, else 0."""
    if errors:
        return 2
    return int(bool(fail_on) and not findings.where(F.lower("severity").isin(*(f.lower() for f in fail_on))).limit(1).isEmpty())


def pr_comments(findings: DataFrame) -> DataFrame:
    """``(path, line, body)`` of inline comments: critical and high findings, one for each rule and line."""
    s = normalize_severity(F.col("severity"))
    return findings.where(s.isin("critical", "high")).groupBy(F.col("file_path").alias("path"), "line", "rule_id").agg(F.min(F.concat(F.lit("**"), s, F.lit("** "), "rule_id", F.lit(": "), F.coalesce("message", F.lit("")))).alias("body")).select("path", "line", "body")


def unresolved_rows(call_sites: DataFrame) -> DataFrame:
    """Unresolved calls in order of file and line, as exported."""
    reason = F.when(F.coalesce("failure_reason", F.lit("")) == "", "uncategorized").otherwise(F.col("failure_reason"))
    rows = call_sites.where(~F.coalesce("resolved", F.lit(False)))
    return rows.select("file", "line", F.col("col").alias("column"), F.col("caller_fqn").alias("function"), "target", "target_fqn", reason.alias("reason")).orderBy("file", "line", "column", "target")


def write_cache(facts: DataFrame, path: str) -> None:
    """Parsed files as parquet, by language; partitions present in ``facts`` are replaced, others stay."""
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(path)
