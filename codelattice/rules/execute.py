"""Rules in their logical form, checked and turned into DataFrames of findings.

However many rules a set has, those on calls, variables and receiver types share one pass over the call sites, and combinations of
call and variable matchers a second one, which ends in a single shuffle by function and line. Rules that need other tables (flows,
class hierarchies, statements) or nest deeper are plans of their own. A rule that is not valid yields a diagnostic and no rows, the
others run.
"""

from __future__ import annotations

import hashlib
import importlib.util
import re
import shutil
import time
import zipfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.operators import container, dataflow, logic, matching, typed
from codelattice.operators.matching import Constraint
from codelattice.rules import api

FINDING = ("rule_id", "fqn", "source_line", "source_column", "sink_line", "sink_column", "sink_call", "confidence", "match_method")
_SPEC = re.compile(r"^[A-Z]+(?:-[A-Z]+)*-\d+[a-z]?$")


@dataclass
class Program:
    """The tables rules run on; what is absent yields no rows."""

    call_sites: DataFrame | None = None
    statements: DataFrame | None = None
    functions: DataFrame | None = None
    edges: DataFrame | None = None
    parameters: DataFrame | None = None
    mro: DataFrame | None = None
    instructions: DataFrame | None = None
    docker_files: DataFrame | None = None
    compose_props: DataFrame | None = None


@dataclass
class Diagnostics:
    messages: list[tuple[str, str]] = field(default_factory=list)

    @property
    def failed(self) -> bool:
        return bool(self.messages)


def validate_ir(ir: Mapping[str, Any]) -> list[str]:
    """What is wrong with a rule's logical form; empty if nothing."""
    out: list[str] = []
    about, m = ir.get("rule") or {}, ir.get("matcher") or {}
    if not about.get("id"):
        out.append("a rule needs an id")

    def check(m: Mapping[str, Any], top: bool) -> None:
        kind = m.get("type")
        if kind == "call_matcher":
            if not m.get("patterns"):
                out.append("a call matcher needs patterns")
        elif kind == "variable_matcher":
            if not m.get("pattern"):
                out.append("a variable matcher needs a pattern")
        elif kind == "attribute_matcher":
            if top:
                out.append("attributes are matched within flows only")
        elif kind in ("type_constrained_call", "type_constrained_attribute"):
            if not m.get("receiverTypes") and (kind.endswith("attribute") or not m.get("receiverPatterns")):
                out.append("a typed matcher needs receiver types")
            if not 0 <= float(m.get("minConfidence", 0.5)) <= 1:
                out.append("a confidence lies between 0 and 1")
        elif kind in ("logic_and", "logic_or", "logic_not"):
            if not m.get("matchers"):
                out.append("a combination needs matchers")
            for x in m.get("matchers") or ():
                check(x, top)
        elif kind == "dataflow":
            if not m.get("sources") or not m.get("sinks"):
                out.append("a flow needs sources and sinks")
            for x in [*(m.get("sources") or ()), *(m.get("sinks") or ()), *(m.get("sanitizers") or ())]:
                check(x, False)
        elif kind in ("all_of", "any_of", "none_of"):
            for x in m.get("conditions") or ():
                check(x, top)
        elif kind not in ("instruction", "missing_instruction", "service_has", "service_missing", "instruction_after", "instruction_before", "stage", "final_stage_has", "custom_check"):
            out.append(f"no matcher of type {kind!r}")

    check(m, True)
    return out


def compile_all_rules(rules: Sequence[api.Rule]) -> list[dict[str, Any]]:
    return [r.to_ir() for r in rules]


def _constraints(given: Mapping[str, Mapping[str, Any]] | None) -> dict[str, Constraint]:
    return {k: Constraint(c.get("value"), bool(c.get("wildcard")), c.get("comparator") or "") for k, c in (given or {}).items()}


def _sites(df: DataFrame) -> DataFrame:
    """Matched call sites as detections."""
    line, col = F.col("line"), F.coalesce(F.col("col"), F.lit(0)) if "col" in df.columns else F.lit(0)
    return df.select(F.col("caller_fqn").alias("fqn"), line.alias("source_line"), col.alias("source_column"), line.alias("sink_line"), col.alias("sink_column"), F.col("target").alias("sink_call"), "confidence", "match_method")


def _condition(m: Mapping[str, Any]):
    t = matching.pattern_match(F.col("target"), m["patterns"], m.get("wildcard"))
    pos, kw = _constraints(m.get("positionalArgs")), _constraints(m.get("keywordArgs"))
    return t & matching.argument_match(F.col("arguments"), pos, kw) if pos or kw else t


def _typed(m: Mapping[str, Any], p: Program) -> DataFrame:
    return typed.type_constrained_call(p.call_sites, m.get("receiverTypes") or (), m.get("methodNames") or (), _constraints(m.get("positionalArgs")), _constraints(m.get("keywordArgs")), m.get("receiverPatterns") or (), m.get("minConfidence", 0.5), m.get("fallbackMode", "none"), p.mro)


def detections(m: Mapping[str, Any], p: Program, compat: bool = False) -> DataFrame:
    """The detections of one matcher (all columns of FINDING but the rule)."""
    kind = m["type"]
    if kind == "call_matcher":
        return _sites(p.call_sites.where(_condition(m)).withColumns({"confidence": F.lit(1.0), "match_method": F.lit("call")}))
    if kind == "variable_matcher":
        return _sites(matching.variable_matcher(p.call_sites, m["pattern"]))
    if kind == "type_constrained_call":
        hits = _typed(m, p)
        out = _sites(hits)
        if p.statements is not None and m.get("receiverTypes"):
            more = typed.typed_statement_scan(p.statements, m["receiverTypes"], m.get("methodNames") or (), hits)
            out = out.unionByName(more.select("fqn", F.col("line").alias("source_line"), F.lit(0).alias("source_column"), F.col("line").alias("sink_line"), F.lit(0).alias("sink_column"), F.col("call_target").alias("sink_call"), "confidence", "match_method"))
        return out
    if kind == "type_constrained_attribute":
        a = typed.type_constrained_attribute(p.call_sites, p.statements, m["receiverTypes"], m["attributeName"], m.get("minConfidence", 0.5))
        return a.select("fqn", F.col("line").alias("source_line"), F.lit(0).alias("source_column"), F.col("line").alias("sink_line"), F.lit(0).alias("sink_column"), F.col("access").alias("sink_call"), "confidence", "match_method")
    if kind == "logic_or":
        return logic.logic_or([detections(x, p, compat) for x in m["matchers"]])
    if kind == "logic_and":
        return logic.logic_and([detections(x, p, compat) for x in m["matchers"]])
    if kind == "logic_not":
        inner = [detections(x, p, compat) for x in m["matchers"]]
        n = logic.logic_not(p.call_sites, inner[0] if len(inner) == 1 else logic.logic_or(inner), compat)
        return n.select("fqn", "source_line", F.lit(0).alias("source_column"), F.col("source_line").alias("sink_line"), F.lit(0).alias("sink_column"), "sink_call", "confidence", "match_method")
    if kind == "dataflow":
        return _flow(m, p)
    raise ValueError(f"no detections for {kind!r}")


def _matched(ms: Sequence[Mapping[str, Any]], p: Program) -> DataFrame:
    """Call sites and attribute reads that a flow's matchers select: (fqn, line, target, target_fqn)."""
    out = []
    for m in ms:
        if m["type"] == "call_matcher":
            out.append(p.call_sites.where(_condition(m)).select(F.col("caller_fqn").alias("fqn"), "line", "target", F.coalesce("target_fqn", F.lit("")).alias("target_fqn")))
        elif m["type"] == "type_constrained_call":
            out.append(_typed(m, p).select(F.col("caller_fqn").alias("fqn"), "line", "target", F.coalesce("target_fqn", F.lit("")).alias("target_fqn")))
        elif m["type"] == "attribute_matcher" and p.statements is not None:
            out.append(matching.attribute_matcher(p.statements, m["patterns"]).select("fqn", "line", F.col("attribute_access").alias("target"), F.lit("").alias("target_fqn")))
    if not out:
        return p.call_sites.limit(0).select(F.col("caller_fqn").alias("fqn"), "line", "target", F.col("target_fqn"))
    return reduce(DataFrame.unionByName, out)


def _patterns(ms: Sequence[Mapping[str, Any]], matched: DataFrame) -> dataflow.Names:
    """Names for the dataflow: those of the rule and their last segments; with wildcards a table, to which the matched targets add theirs."""
    fixed = [x for m in ms for x in m.get("patterns") or m.get("methodNames") or [] if "*" not in x]
    fixed = sorted({*fixed, *(x.rpartition(".")[2] for x in fixed)})
    if not any("*" in x for m in ms for x in m.get("patterns") or []):
        return fixed
    found = dataflow.target_patterns(matched, widen=False).select(F.explode(F.array("pattern", F.substring_index("pattern", ".", -1))).alias("pattern"))
    return found.unionByName(matched.sparkSession.createDataFrame([(x,) for x in fixed], "pattern string")).distinct()


def _sink_sites(ms: Sequence[Mapping[str, Any]], p: Program) -> DataFrame | None:
    """The call sites of the sinks with the parameters that each tracks; none if no sink tracks any."""
    if p.call_sites is None or not any(m.get("trackedParams") for m in ms):
        return None
    out = []
    for m in ms:
        if m["type"] not in ("call_matcher", "type_constrained_call"):
            continue
        tracked = [api._tracked(t) for t in m.get("trackedParams") or ()]
        indices, names = [t["index"] for t in tracked if "index" in t], [t["name"] for t in tracked if "name" in t]
        sites = p.call_sites.where(_condition(m)) if m["type"] == "call_matcher" else _typed(m, p)
        arrays = F.array(*map(F.lit, indices)).cast("array<int>").alias("indices"), F.array(*map(F.lit, names)).cast("array<string>").alias("names")
        out.append(sites.select(F.col("caller_fqn").alias("fqn"), "line", F.lit(not indices and not names).alias("every"), *arrays, "arguments"))
    return reduce(DataFrame.unionByName, out) if out else None


def _flow(m: Mapping[str, Any], p: Program) -> DataFrame:
    if p.statements is None:
        raise ValueError("flows need statements")
    src, snk, san = (_matched(m[k], p) if m.get(k) else None for k in ("sources", "sinks", "sanitizers"))
    names = [_patterns(m.get(k) or (), x) if x is not None else [] for k, x in (("sources", src), ("sinks", snk), ("sanitizers", san))]
    flat = p.statements.withColumn("seq", F.col("flat_seq")) if "flat_seq" in p.statements.columns else p.statements
    none = p.call_sites.limit(0).select(F.col("caller_fqn").alias("fqn"), "line", F.col("target").alias("call_target")) if p.call_sites is not None else None
    lines = tuple(x.select("fqn", "line", F.col("target").alias("call_target")) if x is not None else none for x in (src, snk, san)) if none is not None else None
    local = dataflow.flows_local(p.statements, flat, *names, lines=lines, sink_sites=_sink_sites(m["sinks"], p))
    if m.get("scope") == "local" or p.edges is None:
        out = local.select(F.col("fqn").alias("source_fqn"), "source_line", F.col("fqn").alias("sink_fqn"), "sink_line", "sink_call", "confidence", "scope")
    else:
        params = p.parameters if p.parameters is not None else p.statements.select("fqn").distinct().withColumn("names", F.array().cast("array<string>"))
        sums = dataflow.summary_fixpoint(p.statements, params, p.edges, *names)
        at = lambda x: x.select("fqn", "line", F.col("target").alias("call"))
        out = dataflow.flows_global(at(src), at(snk), p.edges, sums, local)
    return out.select(F.col("sink_fqn").alias("fqn"), "source_line", F.lit(0).alias("source_column"), "sink_line", F.lit(0).alias("sink_column"), "sink_call", "confidence", F.concat(F.lit("flow_"), "scope").alias("match_method"))


def _container(m: Mapping[str, Any], p: Program, strict: bool) -> DataFrame:
    """(file, line, detail) of a container matcher."""
    kind = m["type"]
    if kind == "instruction":
        read = {"image_tag", "base_image", "user_name", "arg_name_regex", "contains", "not_contains", "port_less_than", "port_greater_than", "missing_digest"}
        given = {k: v for k, v in m.items() if k not in ("type", "instruction")}
        more = {k: v for k, v in given.items() if k not in read and v is not True}
        hits = container.docker_instruction(p.instructions, m["instruction"], **{k: v for k, v in given.items() if k in read}, strict=more if strict else None)
        return hits.select("file", "line", F.col("raw").alias("detail"))
    if kind == "missing_instruction":
        return container.docker_missing(p.docker_files, p.instructions, m["instruction"]).withColumn("detail", F.lit(m["instruction"]))
    if kind == "service_has":
        hits = container.compose_has(p.compose_props, m["key"], m.get("equals"), m.get("contains"), m.get("contains_any") or ())
        return hits.select(F.concat_ws("/", "repo", "file_path").alias("file"), "line", F.col("service").alias("detail"))
    if kind == "service_missing":
        return container.compose_missing(p.compose_props, m["key"]).select(F.concat_ws("/", "repo", "file_path").alias("file"), "line", F.col("service").alias("detail"))
    if kind in ("all_of", "any_of", "none_of"):
        parts = [_container(x, p, strict) for x in m["conditions"]]
        return {"all_of": logic.container_all_of, "any_of": logic.container_any_of, "none_of": logic.container_none_of}[kind](parts)
    if strict and kind in ("instruction_after", "instruction_before"):
        other = p.instructions.where(F.col("instruction") == (m.get("after") or m.get("before"))).groupBy("file").agg(F.min("seq").alias("_a"), F.max("seq").alias("_b"))
        order = F.col("seq") > F.col("_a") if kind == "instruction_after" else F.col("seq") < F.col("_b")
        return p.instructions.where(F.col("instruction") == m["instruction"]).join(other, "file").where(order).select("file", "line", F.col("raw").alias("detail"))
    if strict and kind == "final_stage_has":
        final = container.docker_stages(p.instructions).where("is_final").select("file", "start_line")
        return p.instructions.join(final, "file").where((F.col("line") >= F.col("start_line")) & (F.col("instruction") == str(m.get("instruction", "")).upper())).select("file", "line", F.col("raw").alias("detail"))
    if strict and kind == "stage":
        return container.docker_stages(p.instructions).where(F.col("alias") == m.get("alias", "")).select("file", F.col("start_line").alias("line"), F.col("alias").alias("detail"))
    if strict and kind == "custom_check":
        if not callable(m.get("check")):
            raise ValueError("the check's function is not part of a rule read from JSON")
        return container.docker_custom(p.instructions, m["check"], m.get("description") or "")
    return p.instructions.limit(0).select("file", "line", F.col("raw").alias("detail"))


def _leaf(m: Mapping[str, Any], p: Program) -> tuple[Any, Any, Any] | None:
    """How often a matcher hits a call site, with which confidence and by which method, as columns; none if it needs other tables."""
    one = F.lit(1.0)
    if m["type"] == "call_matcher":
        return F.when(_condition(m), 1).otherwise(0), one, F.lit("call")
    if m["type"] == "variable_matcher":
        hits = F.size(F.filter("arguments", lambda a: F.coalesce(a["is_variable"], F.lit(False)) & F.coalesce(matching.pattern_match(a["value"], [m["pattern"]]), F.lit(False))))
        return F.greatest(F.coalesce(hits, F.lit(0)), F.lit(0)), one, F.lit("variable")
    if m["type"] == "type_constrained_call" and p.mro is None and (p.statements is None or not m.get("receiverTypes")):
        named, way, confidence = typed.typed_columns(m.get("receiverTypes") or (), m.get("methodNames") or (), m.get("receiverPatterns") or (), m.get("minConfidence", 0.5), m.get("fallbackMode", "none"))
        pos, kw = _constraints(m.get("positionalArgs")), _constraints(m.get("keywordArgs"))
        hit = F.coalesce(named, F.lit(False)) & way.isNotNull() & (matching.argument_match(F.col("arguments"), pos, kw, lists=False, comparators=True) if pos or kw else F.lit(True))
        return F.when(hit, 1).otherwise(0), confidence, way
    return None


def _is_flat(m: Mapping[str, Any], compat: bool) -> bool:
    """A combination whose parts are call and variable matchers."""
    return m["type"] in ("logic_or", "logic_and", "logic_not") and not (compat and m["type"] == "logic_not") and all(x["type"] in ("call_matcher", "variable_matcher") for x in m["matchers"])


def _combined(rules: Mapping[str, Mapping[str, Any]], p: Program) -> DataFrame:
    """Combinations of call and variable matchers, all of them by one shuffle of the call sites by function and line.

    Counts of hits for each place and target come first; a window over the place says what else was hit there.
    """
    col = F.coalesce(F.col("col"), F.lit(0)) if "col" in p.call_sites.columns else F.lit(0)
    parts: dict[str, range] = {}
    leaves: list[Mapping[str, Any]] = []
    for rid, m in rules.items():
        parts[rid] = range(len(leaves), len(leaves) + len(m["matchers"]))
        leaves += m["matchers"]
    hits = {f"_n{i}": _leaf(x, p)[0] for i, x in enumerate(leaves)}
    rows = p.call_sites.select(F.col("caller_fqn").alias("fqn"), "line", col.alias("_col"), "target", *(c.alias(n) for n, c in hits.items()))
    if all(m["type"] != "logic_not" for m in rules.values()):
        rows = rows.where(reduce(lambda a, b: a | b, [F.col(n) > 0 for n in hits]))
    keys = ("fqn", "line", "_col", "target")
    sums = rows.repartition("fqn", "line").groupBy(*keys).agg(*(F.sum(n).alias(n) for n in hits))
    place, name = Window.partitionBy("fqn", "line", "_col"), Window.partitionBy("fqn", "line", "target")
    need_place = {i for rid, m in rules.items() if m["type"] == "logic_and" for i in list(parts[rid])[1:]}
    need_name = {i for rid, m in rules.items() if m["type"] == "logic_not" for i in parts[rid]}
    sums = sums.withColumns({f"_p{i}": F.max(f"_n{i}").over(place) for i in sorted(need_place)} | {f"_t{i}": F.max(f"_n{i}").over(name) for i in sorted(need_name)} | ({"_first": F.min("_col").over(name)} if need_name else {}))
    found = []
    row = lambda rid, n, at, method: F.array_repeat(F.struct(F.lit(rid).alias("rule_id"), at.alias("at"), F.lit(method).alias("match_method")), n.cast("int"))
    for rid, m in rules.items():
        mine = list(parts[rid])
        method = {i: "call" if leaves[i]["type"] == "call_matcher" else "variable" for i in mine}
        if m["type"] == "logic_or":
            for k in sorted(set(method.values())):
                hit = reduce(lambda a, b: a | b, [F.col(f"_n{i}") > 0 for i in mine if method[i] == k])
                found.append(row(rid, F.when(hit, 1).otherwise(0), F.col("_col"), k))
        elif m["type"] == "logic_and":
            both = reduce(lambda a, b: a & b, [F.col(f"_p{i}") > 0 for i in mine[1:]], F.col(f"_n{mine[0]}") > 0)
            found.append(row(rid, F.when(both, F.col(f"_n{mine[0]}")).otherwise(0), F.col("_col"), method[mine[0]]))
        else:
            none = reduce(lambda a, b: a & b, [F.col(f"_t{i}") == 0 for i in mine], F.col("_col") == F.col("_first"))
            found.append(row(rid, F.when(none, 1).otherwise(0), F.lit(0), "logic_not"))
    each = sums.withColumn("_h", matching.exploded(found)).where("_h IS NOT NULL")
    return each.select("_h.rule_id", "fqn", F.col("line").alias("source_line"), F.col("_h.at").alias("source_column"), F.col("line").alias("sink_line"), F.col("_h.at").alias("sink_column"), F.col("target").alias("sink_call"), F.lit(1.0).alias("confidence"), "_h.match_method")


def _single(rules: Mapping[str, tuple[Any, Any, Any]], p: Program) -> DataFrame:
    """Rules of one matcher on call sites, all of them in one pass without a shuffle."""
    row = lambda rid, c, way: F.struct(F.lit(rid).alias("rule_id"), c.cast("double").alias("confidence"), way.alias("match_method"))
    none = F.array().cast("array<struct<rule_id:string,confidence:double,match_method:string>>")
    rows = [F.when(n > 0, F.array_repeat(row(rid, c, way), n)).otherwise(none) for rid, (n, c, way) in rules.items()]  # confidence and way of hits only
    each = p.call_sites.withColumn("_h", matching.exploded(rows)).where(F.col("_h").isNotNull())
    at = F.coalesce(F.col("col"), F.lit(0)) if "col" in each.columns else F.lit(0)
    return each.select("_h.rule_id", F.col("caller_fqn").alias("fqn"), F.col("line").alias("source_line"), at.alias("source_column"), F.col("line").alias("sink_line"), at.alias("sink_column"), F.col("target").alias("sink_call"), "_h.confidence", "_h.match_method")


def run_rules(irs: Sequence[Mapping[str, Any]], p: Program, compat: bool = False, strict: bool = False, diagnostics: Diagnostics | None = None) -> DataFrame:
    """Findings of code rules: FINDING columns."""
    notes = diagnostics or Diagnostics()
    single: dict[str, tuple[Any, Any, Any]] = {}
    combined: dict[str, Mapping[str, Any]] = {}
    parts: list[DataFrame] = []
    for ir in irs:
        rid = (ir.get("rule") or {}).get("id", "")
        problems = validate_ir(ir)
        if problems:
            notes.messages += [(rid, x) for x in problems]
            continue
        m = ir["matcher"]
        try:
            leaf = _leaf(m, p) if rid not in single and p.call_sites is not None else None
            if leaf is not None:
                single[rid] = leaf
            elif p.call_sites is not None and rid not in combined and _is_flat(m, compat):
                combined[rid] = m
            else:
                parts.append(detections(m, p, compat).withColumn("rule_id", F.lit(rid)))
        except (ValueError, AttributeError, TypeError) as e:
            notes.messages.append((rid, str(e)))
    if single:
        parts.append(_single(single, p))
    if combined:
        parts.append(_combined(combined, p))
    if not parts:
        return p.call_sites.sparkSession.createDataFrame([], "rule_id string, fqn string, source_line int, source_column int, sink_line int, sink_column int, sink_call string, confidence double, match_method string")
    return reduce(DataFrame.unionByName, [x.select(*FINDING) for x in parts])


def run_container_rules(irs: Sequence[Mapping[str, Any]], p: Program, strict: bool = False, diagnostics: Diagnostics | None = None) -> DataFrame:
    """``(rule_id, file, line, detail)`` of container rules."""
    notes, parts = diagnostics or Diagnostics(), []
    for ir in irs:
        rid = (ir.get("rule") or {}).get("id", "")
        problems = validate_ir(ir)
        if problems:
            notes.messages += [(rid, x) for x in problems]
            continue
        try:
            parts.append(_container(ir["matcher"], p, strict).withColumn("rule_id", F.lit(rid)).select("rule_id", "file", F.col("line").cast("int").alias("line"), "detail"))
        except (ValueError, AttributeError, TypeError) as e:
            notes.messages.append((rid, str(e)))
    any_df = p.instructions if p.instructions is not None else p.compose_props
    return reduce(DataFrame.unionByName, parts) if parts else any_df.sparkSession.createDataFrame([], "rule_id string, file string, line int, detail string")


def load_rules(path: str) -> list[api.Rule]:
    """The rules of a Python file, or of all such files below a directory that use a rule decorator."""
    root = Path(path)
    found: list[api.Rule] = []
    for f in [root] if root.is_file() else sorted(root.rglob("*.py")):
        if "_rule(" not in (text := f.read_text(encoding="utf-8")) and "@rule(" not in text:
            continue
        before = len(api._rules)
        spec = importlib.util.spec_from_file_location(f"_rules_{abs(hash(str(f)))}", f)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        found += api._rules[before:]
        del api._rules[before:]
    return found


def load_ruleset(root: str, spec: str) -> list[api.Rule]:
    """``category/bundle`` or ``category/all`` as a directory below ``root``; ``language/RULE-ID`` as one rule of a language."""
    first, _, second = spec.partition("/")
    base = Path(root, first)
    if not first or not second or ".." in (first, second) or not base.is_dir():
        raise ValueError(f"no such rule set: {spec!r}")
    if _SPEC.match(second):
        return [r for r in load_rules(str(base)) if r.id == second]
    return load_rules(str(base if second == "all" else base / second))


def open_ruleset(archive: str, spec: str, cache: str, sha256: str | None = None, ttl: float = 24 * 3600) -> list[api.Rule]:
    """``load_ruleset`` from a zip archive, unpacked below ``cache`` under its digest and used again while it is younger than ``ttl`` seconds.

    A digest that isn't the expected one, and members that would leave the directory, are refused.
    """
    digest = hashlib.sha256(Path(archive).read_bytes()).hexdigest()
    if sha256 is not None and digest != sha256.removeprefix("sha256:").lower():
        raise ValueError(f"the archive's digest is {digest}")
    where = Path(cache, digest)
    stamp = where / ".unpacked"
    if not stamp.exists() or time.time() - stamp.stat().st_mtime > ttl:
        with zipfile.ZipFile(archive) as z:
            root = where.resolve()
            if any(not (root / n).resolve().is_relative_to(root) for n in z.namelist()):
                raise ValueError("the archive holds paths outside of it")
            shutil.rmtree(where, ignore_errors=True)
            where.mkdir(parents=True)
            z.extractall(where)
        stamp.touch()
    return load_ruleset(str(where), spec)
