"""Reports over call sites and findings. Dimensions of one report share a single pass by grouping sets; percentages of nothing are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions.scalar import normalize_severity, severity_rank


def ratio(part: Column, total: Column, scale: float = 100.0) -> Column:
    return F.when(total == 0, 0.0).otherwise(part * scale / total)


def resolution_totals(call_sites: DataFrame) -> DataFrame:
    """One row: calls, resolved and unresolved ones, their percentage, and those resolved by inferred types with their mean confidence."""
    r = F.coalesce("resolved", F.lit(False))
    inferred = r & F.coalesce("via_type_inference", F.lit(False))
    n = call_sites.agg(F.count("*").alias("total"), F.count_if(r).alias("resolved"), F.count_if(~r).alias("unresolved"), F.count_if(inferred).alias("inferred"), F.coalesce(F.sum(F.when(inferred, F.col("type_confidence"))), F.lit(0.0)).alias("_c"))
    return n.select("total", "resolved", "unresolved", "inferred", ratio(F.col("resolved"), F.col("total")).alias("resolved_percent"), ratio(F.col("_c"), F.col("inferred"), 1.0).alias("mean_confidence"))


def confidence_bucket(c: Column) -> Column:
    return F.when(c >= 0.9, "0.9-1.0").when(c >= 0.7, "0.7-0.9").when(c >= 0.5, "0.5-0.7").otherwise("0.0-0.5")


def resolution_stats(call_sites: DataFrame) -> DataFrame:
    """``(dimension, value, calls)``: unresolved calls by reason, target, file and framework; inferred ones by source and confidence."""
    r = F.coalesce("resolved", F.lit(False))
    inferred = r & F.coalesce("via_type_inference", F.lit(False))
    reason = F.when(F.coalesce("failure_reason", F.lit("")) == "", "uncategorized").otherwise(F.col("failure_reason"))
    dims = {
        "reason": F.when(~r, reason), "target": F.when(~r, F.col("target")), "file": F.when(~r, F.col("file")), "framework": F.when(~r & (reason == "external_framework") & F.contains(F.col("target_fqn"), F.lit(".")), F.substring_index("target_fqn", ".", 1)),
        "type_source": F.when(inferred & (F.coalesce("type_source", F.lit("")) != ""), F.col("type_source")), "confidence": F.when(inferred, confidence_bucket(F.col("type_confidence"))),
    }
    cells = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("dimension"), v.alias("value"))) for k, v in dims.items())))
    return call_sites.select(F.explode(cells).alias("_c")).groupBy("_c.dimension", "_c.value").agg(F.count("*").alias("calls"))


def go_breakdown(call_sites: DataFrame) -> DataFrame:
    """Resolved Go calls by origin (standard library, third party, own code) and module, with subtotals by origin and in all."""
    from codelattice.functions.scalar import go_module_name

    origin = F.when(F.coalesce("is_stdlib", F.lit(False)), "stdlib").when(F.col("type_source").isin("thirdparty_local", "thirdparty_cdn"), "thirdparty").otherwise("user")
    named = F.when(F.contains(F.col("target_fqn"), F.lit("/")), go_module_name(F.col("target_fqn"))).otherwise("")
    rows = call_sites.where(F.coalesce("resolved", F.lit(False))).select(origin.alias("origin"), named.alias("module"))
    return rows.rollup("origin", "module").agg(F.count("*").alias("calls")).select(F.coalesce("origin", F.lit("(all)")).alias("origin"), F.coalesce("module", F.lit("(all)")).alias("module"), "calls")


def top_n(rows: DataFrame, key: str, n: int, count: str = "calls") -> DataFrame:
    """The ``n`` most frequent values, of equals the least first; a top-k, not a sort."""
    return rows.groupBy(key).agg(F.count("*").alias(count)).orderBy(F.col(count).desc(), key).limit(n)


def summary_by_severity(findings: DataFrame) -> DataFrame:
    """Findings, distinct rules and files by severity and detection type."""
    return findings.groupBy(normalize_severity(F.col("severity")).alias("severity"), "detection_type").agg(F.count("*").alias("findings"), F.countDistinct("rule_id").alias("rules"), F.countDistinct("repo", "file_path").alias("files"))


def sort_findings(findings: DataFrame) -> DataFrame:
    """By severity, then file, line, column, rule and id: a total order."""
    return findings.orderBy(severity_rank(normalize_severity(F.col("severity"))), "file_path", "line", "col", "rule_id", "finding_id")


def diagnostic_metrics(pairs: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall, F1 and agreement of ``expected`` and ``actual`` booleans; of nothing 0."""
    e, a = F.coalesce("expected", F.lit(False)), F.coalesce("actual", F.lit(False))
    n = pairs.agg(F.count_if(e & a).alias("tp"), F.count_if(~e & a).alias("fp"), F.count_if(e & ~a).alias("fn"), F.count_if(~e & ~a).alias("tn"))
    n = n.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0), "agreement": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), 1.0)})
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 1.0))


def flow_compare(ours: DataFrame, theirs: DataFrame, tolerance: int = 2) -> DataFrame:
    """Flows (fqn, source_line, sink_line) of two tools, the same if both lines differ by at most ``tolerance``: matched and lone ones.

    Lines are cut into cells of the tolerance's width and each flow of theirs looks into the cells beside its own: an equi-join.
    """
    width = max(1, tolerance + 1)
    a = ours.distinct().withColumn("_cell", F.floor(F.col("sink_line") / width))
    b = theirs.distinct().select("fqn", F.col("source_line").alias("_s"), F.col("sink_line").alias("_k")).withColumn("_cell", F.explode(F.array(*(F.floor(F.col("_k") / width) + d for d in (-1, 0, 1)))))
    near = (F.abs(F.col("source_line") - F.col("_s")) <= tolerance) & (F.abs(F.col("sink_line") - F.col("_k")) <= tolerance)
    hit = a.join(b, ["fqn", "_cell"]).where(near)
    both_a, both_b = hit.select("fqn", "source_line", "sink_line").distinct(), hit.select("fqn", "_s", "_k").distinct()
    n = both_a.agg(F.count("*").alias("matched_ours")).crossJoin(both_b.agg(F.count("*").alias("matched_theirs"))).crossJoin(ours.distinct().agg(F.count("*").alias("ours"))).crossJoin(theirs.distinct().agg(F.count("*").alias("theirs")))  # four single rows
    return n.withColumns({"precision": ratio(F.col("matched_ours"), F.col("ours"), 1.0), "recall": ratio(F.col("matched_theirs"), F.col("theirs"), 1.0)})


def snippet_context(findings: DataFrame, files: DataFrame, context: int = 3) -> DataFrame:
    """``(finding_id, line_no, text, is_highlight)``: the lines around each finding, clipped to the file.

    A file's lines are cut once; only the slice around a finding is exploded. Of several rows of a file the one committed last counts.
    """
    wanted = findings.where("line IS NOT NULL AND line > 0").select("repo", "file_path").distinct()
    newest = F.max_by("source_code", F.struct("committed_at", "source_code")) if "committed_at" in files.columns else F.max("source_code")
    one = files.where("source_code IS NOT NULL").join(wanted, ["repo", "file_path"], "left_semi").groupBy("repo", "file_path").agg(newest.alias("_code"))
    lines = one.select("repo", "file_path", F.split(F.regexp_replace("_code", "\r", ""), "\n").alias("_lines"))
    at = findings.where("line IS NOT NULL AND line > 0").select("finding_id", "repo", "file_path", "line").distinct().join(lines, ["repo", "file_path"])
    first = F.greatest(F.col("line") - context, F.lit(1))
    got = at.select("finding_id", "line", first.alias("_first"), F.posexplode(F.slice("_lines", first, F.greatest(F.least(F.col("line") + context, F.size("_lines")) - first + 1, F.lit(0)))))
    return got.select("finding_id", (F.col("_first") + F.col("pos")).alias("line_no"), F.col("col").alias("text"), (F.col("_first") + F.col("pos") == F.col("line")).alias("is_highlight"))


def paginate(rows: DataFrame, order: list[str], limit: int | None = None, cursor: str | None = None) -> tuple[DataFrame, dict]:
    """One page in a total order, and (total, returned, has_more, next_cursor). Limits above 500 are 500; none, zero or below are 50."""
    size = 50 if not limit or limit <= 0 else min(limit, 500)
    offset = read_cursor(cursor)
    total = rows.count()
    returned = max(0, min(size, total - offset))
    more = offset + returned < total
    return rows.orderBy(*order).offset(offset).limit(size), {"total": total, "returned": returned, "has_more": more, "next_cursor": make_cursor(offset + returned) if more else ""}


def make_cursor(offset: int) -> str:
    import base64
    import json

    return base64.urlsafe_b64encode(json.dumps({"o": offset}, separators=(",", ":")).encode()).decode()


def read_cursor(cursor: str | None) -> int:
    """The offset in a cursor; 0 for none and for broken ones."""
    import base64
    import json

    try:
        return max(0, int(json.loads(base64.urlsafe_b64decode(cursor or ""))["o"]))
    except (ValueError, KeyError, TypeError):
        return 0


def latest(rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """The row of the greatest ``by`` for each key, nulls least; of equals the greatest of the other columns. Combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    order = [*by, *(c for c in rest if c not in by)]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*").select(*rows.columns)
