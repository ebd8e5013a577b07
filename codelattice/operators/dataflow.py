"""Dataflow within functions and across calls.

Statements: fqn, seq, line, type, def, uses array, call_target, call_chain, attribute_access, call_args array; '' means absent. What
needs a function's statements in order runs once a function, on one array for each function that holds both a source and a sink;
everything across functions is joins over edges and summaries.

A graph node is a variable at a line (``var@line``): a second definition on a line takes the first one's place.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.operators.matching import name_pattern
from codelattice.session import cut

CFG, FLAT, PROXIMITY, GLOBAL, INTER = 0.95, 0.85, 0.5, 0.8, 0.9

# Functions that pass taint from the listed parameters to their result; -1 stands for all.
TRANSPARENT: dict[str, tuple[int, ...]] = {
    "fmt.Sprintf": (-1,), "fmt.Fprintf": (-1,), "fmt.Errorf": (-1,), "strings.Replace": (0,), "strings.ReplaceAll": (0,), "strings.ToLower": (0,), "strings.ToUpper": (0,), "strings.TrimSpace": (0,), "strings.Trim": (0,),
    "strings.TrimLeft": (0,), "strings.TrimRight": (0,), "strings.TrimPrefix": (0,), "strings.TrimSuffix": (0,), "strings.Join": (0,), "strings.Repeat": (0,), "strings.Map": (1,), "context.WithValue": (0, 2),
    "encoding/base64.StdEncoding.EncodeToString": (0,), "encoding/base64.StdEncoding.DecodeString": (0,), "encoding/hex.EncodeToString": (0,), "encoding/hex.DecodeString": (0,),
    "net/url.QueryEscape": (0,), "net/url.QueryUnescape": (0,), "net/url.PathEscape": (0,), "net/url.PathUnescape": (0,), "reflect.ValueOf": (0,),
}
# Calls whose result carries no taint.
NON_PROPAGATORS = frozenset(("len", "int", "float", "bool", "type", "isinstance", "id", "hash", "range", "ord"))


#: Names for a flow: a list of patterns, or a table of one column ``pattern`` where a rule's wildcards stand for many.
Names = Sequence[str] | DataFrame

MARKS = ("source", "sink", "sanitizer", "source_call", "sink_call", "sanitizer_call")


class DependencyGraph:
    """The definitions of one function and the edges from each to those that use it."""

    def __init__(self, params: Sequence[str] = ()) -> None:
        self.nodes: dict[tuple[str, int], list[bool]] = {}  # (var, line) -> [source, sanitized]
        self.lines: dict[str, list[int]] = {}  # the lines of each variable's definitions, in order
        self._parents: dict[tuple[str, int], dict[tuple[str, int], tuple[str, int]]] = {}
        self.edges: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.live: dict[str, tuple[str, int]] = {}
        for p in params:
            self.nodes[p, 0] = [False, False]
            self.lines[p] = [0]
            self.live[p] = (p, 0)

    def build(self, statements: Iterable[Mapping]) -> None:
        """Statements carry the marks of ``marked``."""
        for s in statements:
            if not s["def"]:
                continue
            key = (s["def"], int(s["line"]))
            if key not in self.nodes:
                insort(self.lines.setdefault(s["def"], []), key[1])
            self.nodes[key] = [s["source"], s["sanitizer"]]
            for v in s["uses"]:
                if v in self.live:
                    self.edges.setdefault(self.live[v], []).append(key)
            self.live[s["def"]] = key

    def latest(self, var: str, line: int) -> tuple[str, int] | None:
        """The definition of a variable on the greatest line that is not behind ``line``."""
        lines = self.lines.get(var, ())
        i = bisect_right(lines, line)
        return (var, lines[i - 1]) if i else None

    def path(self, start: tuple[str, int], end: tuple[str, int]) -> list[tuple[str, int]] | None:
        """A shortest path, by the order of the edges. One walk a start serves all its ends."""
        parent = self._parents.get(start)
        if parent is None:
            parent, queue = {start: start}, deque([start])
            while queue:
                at = queue.popleft()
                for n in self.edges.get(at, ()):
                    if n not in parent:
                        parent[n] = at
                        queue.append(n)
            self._parents[start] = parent
        if end not in parent:
            return None
        out = [end]
        while out[-1] != start:
            out.append(parent[out[-1]])
        return out[::-1]

    def clean_path(self, start: tuple[str, int], end: tuple[str, int]) -> list[tuple[str, int]] | None:
        """The shortest path, if no node on it is sanitized; another path is not tried."""
        p = self.path(start, end)
        return None if p is None or any(self.nodes[k][1] for k in p) else p


def def_use(statements: DataFrame) -> DataFrame:
    """``(fqn, var, defs, uses)``: how often each variable is defined and used in a function."""
    d = statements.where("def <> ''").select("fqn", F.col("def").alias("var"), F.lit(1).alias("d"), F.lit(0).alias("u"))
    u = statements.select("fqn", F.explode("uses").alias("var"), F.lit(0).alias("d"), F.lit(1).alias("u"))
    return d.unionByName(u).groupBy("fqn", "var").agg(F.sum("d").alias("defs"), F.sum("u").alias("uses"))


def def_use_stats(statements: DataFrame) -> DataFrame:
    """Per function: variables, definitions, uses, the most of each, and variables undefined or never used."""
    return def_use(statements).groupBy("fqn").agg(
        F.count("*").alias("variables"), F.sum("defs").alias("total_defs"), F.sum("uses").alias("total_uses"), F.max("defs").alias("max_defs"), F.max("uses").alias("max_uses"), F.count_if(F.col("defs") == 0).alias("undefined"), F.count_if(F.col("uses") == 0).alias("dead")
    )


def _stmt_columns(statements: DataFrame) -> DataFrame:
    have = set(statements.columns)
    blank = {c: F.lit("") for c in ("type", "call_chain", "attribute_access") if c not in have}
    return statements.withColumns({**blank, **({} if "call_args" in have else {"call_args": F.array().cast("array<string>")})}).select("fqn", "seq", "line", "type", "def", "uses", "call_target", "call_chain", "attribute_access", "call_args")


def _parts_of(name: Column) -> Column:
    """What a pattern may be to match a name: its runs of segments from the start and to the end."""
    segments = F.split(F.substring_index(name, "(", 1), r"\.")
    n = F.size(segments)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda k: F.array(F.array_join(F.slice(segments, F.lit(1), k), "."), F.array_join(F.slice(segments, n - k + 1, k), ".")))))


def _matched(statements: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(name)``: the names of statements that one of the patterns matches, by equality with a part of the name."""
    names = statements.select(F.explode(F.array("call_target", "call_chain", "attribute_access")).alias("name")).where("name <> ''").distinct()
    return names.withColumn("pattern", F.explode(_parts_of(F.col("name")))).join(patterns.where("pattern <> ''").select("pattern").distinct(), "pattern", "left_semi").select("name").distinct()


def marked(statements: DataFrame, sources: Names = (), sinks: Names = (), sanitizers: Names = ()) -> DataFrame:
    """The statements with MARKS: whether the call, its chain or the attribute read is a source, sink or sanitizer, and whether the call is.

    Lists become expressions. Tables are joined: to the distinct names first, then these to the statements.
    """
    s = _stmt_columns(statements)
    for kind, names in (("source", sources), ("sink", sinks), ("sanitizer", sanitizers)):
        if not isinstance(names, DataFrame):
            call = name_pattern(F.col("call_target"), names) if names else F.lit(False)
            other = name_pattern(F.col("call_chain"), names) | name_pattern(F.col("attribute_access"), names) if names else F.lit(False)
            s = s.withColumns({kind: call | other, f"{kind}_call": call})
            continue
        hits = cut(_matched(s, names))  # read three times in each plan that uses the marks
        for i, c in enumerate(("call_target", "call_chain", "attribute_access")):
            s = s.join(hits.select(F.col("name").alias(c), F.lit(True).alias(f"_hit{i}")), c, "left")
        hit = lambda i: F.coalesce(F.col(f"_hit{i}"), F.lit(False))
        s = s.withColumns({kind: hit(0) | hit(1) | hit(2), f"{kind}_call": hit(0)}).drop("_hit0", "_hit1", "_hit2")
    return s


def vdg_build(statements: DataFrame, sources: Names, sanitizers: Names) -> DataFrame:
    """``(fqn, var, line, is_source, is_sanitized)``: the nodes; of definitions on one line the last one's marks hold."""
    s = marked(statements, sources, (), sanitizers).where("def <> ''")
    marks = s.select("fqn", F.col("def").alias("var"), "line", F.struct("seq", F.col("source").alias("a"), F.col("sanitizer").alias("b")).alias("m"))
    return marks.groupBy("fqn", "var", "line").agg(F.max("m").alias("m")).select("fqn", "var", "line", F.col("m.a").alias("is_source"), F.col("m.b").alias("is_sanitized"))


def _per_function(statements: DataFrame, work: Callable[[str, list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """``work`` on the statements of each function in their order; what it yields are rows of ``schema``.

    A function's statements travel as one array; a task streams over many functions without a frame for each.
    """
    columns = ("line", "type", "def", "uses", "call_target", "call_args", *MARKS)
    rows = statements.groupBy("fqn").agg(F.sort_array(F.collect_list(F.struct("seq", *columns))).alias("rows"))
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    fields = [f.strip().split(" ") for f in schema.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for fqn, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in work(fqn, rows)]
            cols = list(zip(*out, strict=True)) if out else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    return rows.mapInArrow(run, schema)


_FLOW = "fqn string, source_line int, source_var string, sink_line int, sink_call string, sink_var string, path array<string>"


def vdg_flows(statements: DataFrame, sources: Names, sinks: Names, sanitizers: Names = ()) -> DataFrame:
    """Flows from a source's definition to a variable that a sink statement uses, by shortest paths without a sanitizer.

    Only functions that hold a source and a sink reach the grouped map; the others are removed by a semi-join on aggregated marks.
    """
    s = marked(statements, sources, sinks, sanitizers)
    both = s.groupBy("fqn").agg(F.bool_or(F.col("source") & (F.col("def") != "")).alias("a"), F.bool_or("sink").alias("b")).where("a AND b").select("fqn")

    def work(fqn: str, rows: list[dict]) -> Iterator[tuple]:
        g = DependencyGraph()
        g.build(rows)
        starts = sorted((k for k, v in g.nodes.items() if v[0]), key=lambda k: (k[1], k[0]))
        for r in rows:
            if r["sink"]:
                for v in r["uses"]:
                    end = g.latest(v, int(r["line"]))
                    for k in starts if end else ():
                        p = g.clean_path(k, end)
                        if p:
                            yield fqn, k[1], k[0], int(r["line"]), r["call_target"], v, [x[0] for x in p]

    return _per_function(s.join(both, "fqn", "left_semi"), work, _FLOW)


def flow_reach(statements: DataFrame, sources: Names, sinks: Names, max_depth: int | None = None) -> DataFrame:
    """The same without sanitizers as joins alone: (fqn, source_line, sink_line, sink_var), by closures over definition edges.

    For corpora whose functions are too long for one task.
    """
    from codelattice.operators.joins import asof_latest_def, build_edge_latest_def
    from codelattice.operators.traversal import closure

    s = _stmt_columns(statements)
    node = lambda v, n: F.concat_ws("@", F.col("fqn"), v, n)
    at = s.select("fqn", F.col("seq").alias("_s"), F.col("def").alias("_d"), F.col("line").alias("_l"))
    e = build_edge_latest_def(s)
    src = e.join(at.withColumnRenamed("_s", "from_seq"), ["fqn", "from_seq"]).withColumn("src", node(F.col("_d"), F.col("_l"))).select("fqn", "to_seq", "src")
    edges = src.join(at.withColumnRenamed("_s", "to_seq"), ["fqn", "to_seq"]).withColumn("dst", node(F.col("_d"), F.col("_l"))).select("src", "dst")
    marks = vdg_build(s, sources, ()).where("is_source")
    roots = marks.select(node(F.col("var"), F.col("line")).alias("root"), F.col("line").alias("source_line"))
    reach = closure(edges, roots.select("root"), max_depth)
    used = marked(s, (), sinks).where("sink").select("fqn", F.explode("uses").alias("var"), "line").distinct()
    ends = asof_latest_def(used, s.where("def <> ''").select("fqn", F.col("def").alias("var"), "line")).where("def_line IS NOT NULL")
    ends = ends.select("fqn", F.col("line").alias("sink_line"), F.col("var").alias("sink_var"), node(F.col("var"), F.col("def_line")).alias("node"))
    return reach.join(ends, "node").join(roots.distinct(), "root").select("fqn", "source_line", "sink_line", "sink_var").distinct()


def flows_local(cfg_statements: DataFrame, flat_statements: DataFrame, sources: Names, sinks: Names, sanitizers: Names, lines: tuple[DataFrame, DataFrame, DataFrame] | None = None, sink_sites: DataFrame | None = None) -> DataFrame:
    """Flows within functions in three tiers: over statements in the order of the control flow (0.95); for functions where that gives
    none, in textual order (0.85); for functions without statements, by lines (0.50; ``lines`` are sources, sinks, sanitizers).

    Where both orders are one table, the second tier finds what the first does and is left out. ``sink_sites`` are the sinks' tracked
    parameters (see ``accepted_sinks``).
    """
    one = vdg_flows(cfg_statements, sources, sinks, sanitizers).withColumn("confidence", F.lit(CFG))
    cols = ["fqn", "source_line", "source_var", "sink_line", "sink_call", "sink_var", "confidence"]
    out = one.select(*cols)
    if flat_statements is not cfg_statements:
        done = one.select("fqn").distinct()
        two = vdg_flows(flat_statements.join(done, "fqn", "left_anti"), sources, sinks, sanitizers).withColumn("confidence", F.lit(FLAT))
        out = out.unionByName(two.select(*cols))
    if sink_sites is not None:
        out = accepted_sinks(out, sink_sites)
    out = out.drop("sink_var")
    if lines is not None:
        from codelattice.operators.joins import join_line_proximity

        known = cfg_statements.select("fqn").unionByName(flat_statements.select("fqn")).distinct()
        three = join_line_proximity(*(x.join(known, "fqn", "left_anti") for x in lines))
        out = out.unionByName(three.select("fqn", F.col("source_line").cast("int").alias("source_line"), F.lit("").alias("source_var"), F.col("sink_line").cast("int").alias("sink_line"), F.lit("").alias("sink_call"), "confidence"))
    return out.withColumn("scope", F.lit("local"))


def target_patterns(matched: DataFrame, widen: bool = True) -> DataFrame:
    """``(pattern)``: targets and resolved names of matched call sites and, with ``widen``, their last segments."""
    names = F.array("target", F.coalesce("target_fqn", F.lit("")), *([F.substring_index("target", ".", -1)] if widen else []))
    return matched.select(F.explode(names).alias("pattern")).where("pattern <> ''").distinct()


def tracked_params(flows: DataFrame, call_sites: DataFrame, indices: Sequence[int] = (), names: Sequence[str] = (), only_return: bool = False) -> DataFrame:
    """Flows whose sink variable is a bare argument at a tracked position or keyword; flows without a call site at the sink stay."""
    if only_return or not (indices or names):
        return flows
    at = call_sites.select(F.col("caller_fqn").alias("_f"), F.col("line").alias("_l"), "arguments")
    sites = at.groupBy("_f", "_l").agg(F.flatten(F.collect_set("arguments")).alias("_args"))
    joined = flows.join(sites, (flows["fqn"] == sites["_f"]) & (flows["sink_line"] == sites["_l"]), "left")
    v = F.col("sink_var")
    hit = F.exists("_args", lambda a: (a["is_variable"] & (a["value"] == v) & (a["position"].isin(*indices) if indices else F.lit(False))) | ((F.regexp_extract(a["value"], r"=\s*(.*)$", 1) == v) & (F.trim(F.substring_index(a["value"], "=", 1)).isin(*names) if names else F.lit(False))))
    return joined.where(F.col("_f").isNull() | hit).drop("_f", "_l", "_args")


def accepted_sinks(flows: DataFrame, sites: DataFrame) -> DataFrame:
    """Flows that a sink on their line accepts, and those on lines without one.

    ``sites`` (fqn, line, every, indices, names, arguments): a sink's call site with the parameters its matcher tracks. A site accepts
    any variable if ``every`` holds, otherwise a bare argument at one of the positions or of one of the keywords.
    """
    at = sites.groupBy(F.col("fqn").alias("_f"), F.col("line").alias("_l")).agg(F.collect_set(F.struct("every", "indices", "names", "arguments")).alias("_sites"))
    joined = flows.join(at, (flows["fqn"] == at["_f"]) & (flows["sink_line"] == at["_l"]), "left")
    v = F.col("sink_var")

    def takes(x):
        bare = F.exists(x["arguments"], lambda a: a["is_variable"] & (a["value"] == v) & F.array_contains(x["indices"], a["position"]))
        named = F.exists(x["arguments"], lambda a: (F.regexp_extract(a["value"], r"=\s*(.*)$", 1) == v) & F.array_contains(x["names"], F.trim(F.substring_index(a["value"], "=", 1))))
        return x["every"] | F.coalesce(bare | named, F.lit(False))

    return joined.where(F.col("_f").isNull() | F.exists("_sites", takes)).drop("_f", "_l", "_sites")


SUMMARY = "fqn string, is_source boolean, is_sanitizer boolean, return_tainted boolean, p2ret array<int>, p2sink array<int>"


def summarize(fqn: str, rows: list[dict], params: Sequence[str], callees: Mapping[str, Mapping]) -> tuple:
    """What a function does to taint: from parameters to its result and to sinks, by itself or through what it calls."""
    if fqn in TRANSPARENT:
        idx = TRANSPARENT[fqn]
        return fqn, False, False, False, list(range(len(params))) if -1 in idx else [i for i in idx], []
    g = DependencyGraph(params)
    g.build(rows)
    called = lambda r: callees.get(r["call_target"] or "") or callees.get((r["call_target"] or "").rpartition(".")[2])
    for r in rows:  # y = f(x): what f returns marks y
        c = called(r)
        if c and r["def"]:
            key = (r["def"], int(r["line"]))
            if c["return_tainted"] or c["is_source"]:
                g.nodes[key][0] = True
            if c["is_sanitizer"]:
                g.nodes[key][1] = True
            elif not c["is_source"] and c["p2ret"] is not None and not len(c["p2ret"]):
                for k in g.edges:
                    g.edges[k] = [n for n in g.edges[k] if n != key]
    returns = [r for r in rows if r["type"] == "return"]
    ends = [e for r in returns for v in r["uses"] if (e := g.latest(v, int(r["line"])))]
    p2ret, p2sink = [], []
    for i, p in enumerate(params):
        if any(g.clean_path((p, 0), e) for e in ends):
            p2ret.append(i)
        for r in rows:
            c = called(r)
            direct = r["sink_call"]
            through = {a for j, a in enumerate(r["call_args"]) if c and c["p2sink"] is not None and j in list(c["p2sink"])}
            used = [v for v in r["uses"] if direct or v in through]
            if any((e := g.latest(v, int(r["line"]))) and g.clean_path((p, 0), e) for v in used):
                p2sink.append(i)
                break
    tainted = any(g.clean_path(k, e) for k, m in g.nodes.items() if m[0] for e in ends) or any(r["source_call"] for r in returns)
    reach = any(g.clean_path((p, 0), e) for p in params for e in ends)
    sanitizer = bool(params and returns) and not reach and any(m[1] for m in g.nodes.values())
    sanitizer = sanitizer or bool(returns) and all(r["sanitizer_call"] for r in returns)
    return fqn, tainted, bool(sanitizer), tainted, p2ret, p2sink


def transfer_summary(statements: DataFrame, parameters: DataFrame, sources: Names, sinks: Names, sanitizers: Names, edges: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """One summary a function. ``parameters``: fqn, names array. With ``edges`` (caller, callee) and the previous round's summaries,
    those of a function's callees travel to it as one array, collected by its own calls only."""
    s = marked(statements, sources, sinks, sanitizers).groupBy("fqn").agg(F.sort_array(F.collect_list(F.struct("seq", "line", "type", "def", "uses", "call_target", "call_args", *MARKS))).alias("rows"))
    s = s.join(parameters.select("fqn", "names"), "fqn", "left")
    if edges is not None and previous is not None:
        near = edges.select(F.col("caller").alias("_c"), F.col("callee").alias("fqn")).distinct().join(previous, "fqn")
        near = near.groupBy("_c").agg(F.collect_list(F.struct("fqn", "is_source", "is_sanitizer", "return_tainted", "p2ret", "p2sink")).alias("callees")).withColumnRenamed("_c", "fqn")
        s = s.join(near, "fqn", "left")
    else:
        s = s.withColumn("callees", F.lit(None).cast("array<struct<fqn:string,is_source:boolean,is_sanitizer:boolean,return_tainted:boolean,p2ret:array<int>,p2sink:array<int>>>"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            out = []
            for fqn, rows, names, near in zip(pdf["fqn"], pdf["rows"], pdf["names"], pdf["callees"], strict=True):
                known = {c["fqn"]: c for c in (near if near is not None else ())}
                known |= {k.rpartition(".")[2]: c for k, c in known.items()}
                out.append(summarize(fqn, list(rows), list(names) if names is not None else [], known))
            yield pd.DataFrame(out, columns=["fqn", "is_source", "is_sanitizer", "return_tainted", "p2ret", "p2sink"])

    return s.select("fqn", "rows", "names", "callees").mapInPandas(run, SUMMARY)


def summary_fixpoint(statements: DataFrame, parameters: DataFrame, edges: DataFrame, sources: Names, sinks: Names, sanitizers: Names, rounds: int = 10) -> DataFrame:
    """Summaries until nothing changes, at most ``rounds`` rounds as in the reference (summaries of recursive functions may alternate);
    each round sees the one before and is written to the shared folder."""
    now = cut(transfer_summary(statements, parameters, sources, sinks, sanitizers))
    for _ in range(rounds):
        new = cut(transfer_summary(statements, parameters, sources, sinks, sanitizers, edges, now))
        changed = not new.exceptAll(now).isEmpty()
        now = new
        if not changed:
            break
    return now


def flows_global(sources_at: DataFrame, sinks_at: DataFrame, edges: DataFrame, summaries: DataFrame, local: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Local flows, and flows from functions with a source to functions with a sink that they reach by calls.

    A path (shortest; at least two functions) holds if the source's summary may let taint out, the sink's may take it in, and every
    function between passes it on and is no sanitizer. One flow a sink stays, local ones first. Inputs: (fqn, line, call).
    """
    from codelattice.operators.logic import dedup_flow
    from codelattice.operators.traversal import paths_from, transitive_callers

    e = edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()
    a, b = sources_at.select("fqn").distinct(), sinks_at.select("fqn").distinct()
    # What leads to a sink, found once for all of them; paths then never leave it, which changes no shortest path to a sink.
    leads = transitive_callers(e, b.select(F.col("fqn").alias("node")), max_depth).select("node")
    e = e.join(leads.withColumnRenamed("node", "dst"), "dst", "left_semi")
    roots = a.select(F.col("fqn").alias("root")).join(leads.withColumnRenamed("node", "root"), "root", "left_semi")
    paths = paths_from(e, roots, max_depth).where("root <> node").join(b.select(F.col("fqn").alias("node")), "node", "left_semi").select(F.col("root").alias("src"), F.col("node").alias("dst"), "path")
    sm = summaries.select("fqn", "is_source", "is_sanitizer", "return_tainted", "p2ret", "p2sink")
    out_ok = sm.select(F.col("fqn").alias("src"), (F.col("is_source") | F.col("return_tainted") | (F.size("p2ret") > 0) | (F.size("p2sink") > 0)).alias("_out"))
    blocked = sm.where("is_sanitizer OR (size(p2ret) = 0 AND NOT is_source)").select(F.col("fqn").alias("_mid"))
    mids = paths.withColumn("_mid", F.explode(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0))))).join(blocked, "_mid", "left_semi").select("src", "dst").distinct()
    good = paths.join(out_ok, "src", "left").where(F.coalesce("_out", F.lit(True))).join(mids, ["src", "dst"], "left_anti")
    far = good.join(sources_at.select(F.col("fqn").alias("src"), F.col("line").alias("source_line")), "src").join(sinks_at.select(F.col("fqn").alias("dst"), F.col("line").alias("sink_line"), F.col("call").alias("sink_call")), "dst")
    far = far.select(F.col("src").alias("source_fqn"), "source_line", F.lit("").alias("source_var"), F.col("dst").alias("sink_fqn"), "sink_line", "sink_call", F.lit(GLOBAL).alias("confidence"), F.lit("global").alias("scope"))
    near = local.select(F.col("fqn").alias("source_fqn"), "source_line", "source_var", F.col("fqn").alias("sink_fqn"), "sink_line", "sink_call", "confidence", F.lit("local").alias("scope"))
    return dedup_flow(near.unionByName(far))


def intra_taint_forward(statements: DataFrame, sources: Names, sinks: Names, sanitizers: Names, decay: float = 0.7) -> DataFrame:
    """A forward pass over each function's statements: taint with a confidence that fades through calls; (fqn, source_line, sink_line, sink_call, confidence)."""
    s = marked(statements, sources, sinks, sanitizers)

    def work(fqn: str, rows: list[dict]) -> Iterator[tuple]:
        taint: dict[str, tuple[float, int]] = {}
        for r in rows:
            call = r["call_target"] or ""
            worst = max((taint[v] for v in r["uses"] if v in taint), default=None)
            if worst and r["sink_call"]:
                yield fqn, worst[1], int(r["line"]), call, worst[0]
            if not r["def"]:
                continue
            if r["source_call"]:
                taint[r["def"]] = (1.0, int(r["line"]))
            elif not worst or r["sanitizer_call"] or call.rpartition(".")[2].partition("(")[0] in NON_PROPAGATORS:
                taint.pop(r["def"], None)
            else:
                taint[r["def"]] = (worst[0] * (decay if call else 1.0), worst[1])

    return _per_function(s, work, "fqn string, source_line int, sink_line int, sink_call string, confidence double")


def inter_taint(local_sources: DataFrame, call_sites: DataFrame, summaries: DataFrame) -> DataFrame:
    """Calls that hand a tainted variable to a parameter which the callee passes to a sink: (fqn, line, target_fqn, var, confidence).

    ``local_sources``: fqn, var, line (of the definition).
    """
    args = call_sites.withColumn("_a", F.explode("arguments")).where("_a.is_variable").select(F.col("caller_fqn").alias("fqn"), "line", "target_fqn", F.col("_a.value").alias("var"), F.col("_a.position").alias("_p"))
    sinks = summaries.select(F.col("fqn").alias("target_fqn"), F.explode("p2sink").alias("_p"))
    tainted = local_sources.groupBy("fqn", "var").agg(F.min("line").alias("_from"))
    return args.join(sinks, ["target_fqn", "_p"], "left_semi").join(tainted, ["fqn", "var"]).where("line >= _from").select("fqn", "line", "target_fqn", "var", F.lit(INTER).alias("confidence")).distinct()


def pattern_registry(call_sites: DataFrame, edges: DataFrame, kind: str, sources: Sequence[str] = (), sinks: Sequence[str] = (), sanitizers: Sequence[str] = (), dangerous: Sequence[str] = ()) -> DataFrame:
    """The first match, in order, of a registered pattern: a dangerous function, a source that reaches a sink, or one without a sanitizer."""
    t = F.col("target")
    if kind == "dangerous":
        return call_sites.where(name_pattern(t, dangerous)).select(F.col("caller_fqn").alias("source_fqn"), F.col("caller_fqn").alias("sink_fqn"), "line", t.alias("call")).orderBy("source_fqn", "line", "call").limit(1)
    from codelattice.operators.traversal import closure, find_path

    at = lambda p: call_sites.where(name_pattern(t, p)).select(F.col("caller_fqn").alias("fqn"), "line", t.alias("call"))
    e = edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    roots = at(sources).select(F.col("fqn").alias("root")).distinct()
    reach = closure(e, roots).select(F.col("root").alias("source_fqn"), F.col("node").alias("sink_fqn"))
    hits = reach.join(at(sinks).withColumnRenamed("fqn", "sink_fqn"), "sink_fqn")
    if kind == "missing_sanitizer" and sanitizers:
        paths = find_path(e, hits.select(F.col("source_fqn").alias("src"), F.col("sink_fqn").alias("dst")).distinct())
        clean = at(sanitizers).select(F.col("fqn").alias("_n")).distinct()
        safe = paths.withColumn("_n", F.explode("path")).join(clean, "_n", "left_semi").select(F.col("src").alias("source_fqn"), F.col("dst").alias("sink_fqn")).distinct()
        hits = hits.join(safe, ["source_fqn", "sink_fqn"], "left_anti")
    return hits.select("source_fqn", "sink_fqn", "line", "call").orderBy("source_fqn", "sink_fqn", "line", "call").limit(1)


def live_bindings(bindings: DataFrame) -> DataFrame:
    """The last binding of each variable in its scope, of several on a line the least type: (scope_fqn, var, type_fqn, line)."""
    last = F.min_by(F.struct("type_fqn", "line"), F.struct(F.coalesce(-F.col("line"), F.lit(1)).alias("l"), "type_fqn"))
    return bindings.groupBy("scope_fqn", "var").agg(last.alias("_b")).select("scope_fqn", "var", "_b.type_fqn", "_b.line")


def binding_at_line(bindings: DataFrame, uses: DataFrame) -> DataFrame:
    """The binding of a variable that holds at each use (scope_fqn, var, line)."""
    from codelattice.operators.joins import asof_latest_def

    found = asof_latest_def(uses.withColumnRenamed("scope_fqn", "fqn"), bindings.withColumnRenamed("scope_fqn", "fqn")).withColumnRenamed("fqn", "scope_fqn")
    one = bindings.groupBy("scope_fqn", "var", F.col("line").alias("def_line")).agg(F.min("type_fqn").alias("type_fqn"))
    return found.join(one, ["scope_fqn", "var", "def_line"], "left")


def _graphs(cfg_edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The control flow graph of each function as one array of edges."""
    return cfg_edges.groupBy(*keys).agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("src", "dst")))).alias("edges"))


def dominators(cfg_edges: DataFrame, keys: Sequence[str] = ("file", "fqn")) -> DataFrame:
    """``(*keys, block, dominators)``: for each block reachable from block 0 the blocks that every path to it passes, itself included."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, blocks, doms = [], [], []
            for i, edges in enumerate(b.column(b.num_columns - 1).to_pylist()):
                before: dict[int, list[int]] = {}
                after: dict[int, list[int]] = {}
                for e in edges:
                    before.setdefault(e["dst"], []).append(e["src"])
                    after.setdefault(e["src"], []).append(e["dst"])
                order, todo = [0], deque([0])
                while todo:
                    for n in after.get(todo.popleft(), ()):
                        if n not in order:
                            order.append(n)
                            todo.append(n)
                known = {n: set(order) for n in order} | {0: {0}}
                changed = True
                while changed:
                    changed = False
                    for n in order[1:]:
                        new = {n} | set.intersection(*(known[p] for p in before[n] if p in known))
                        if new != known[n]:
                            known[n], changed = new, True
                for n in order:
                    at.append(i)
                    blocks.append(n)
                    doms.append(sorted(known[n]))
            cols = [b.column(k).take(pa.array(at, pa.int32())) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(blocks, pa.int32()), pa.array(doms, pa.list_(pa.int32()))], names=[*b.schema.names[:-1], "block", "dominators"])

    return _graphs(cfg_edges, keys).mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", block int, dominators array<int>")


def all_paths(cfg_edges: DataFrame, keys: Sequence[str] = ("file", "fqn"), most: int | None = None) -> DataFrame:
    """``(*keys, path)``: the paths without repeated blocks from block 0 to blocks without successors; all of them, or ``most`` a function.

    Their number grows exponentially with the branches: they leave in batches, so that only the branches of one path are in memory."""
    flush = 4096

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, paths = [], []

            def batch(b: pa.RecordBatch, at: list[int], paths: list[list[int]]) -> pa.RecordBatch:
                cols = [b.column(k).take(pa.array(at, pa.int32())) for k in range(b.num_columns - 1)]
                return pa.RecordBatch.from_arrays([*cols, pa.array(paths, pa.list_(pa.int32()))], names=[*b.schema.names[:-1], "path"])

            for i, edges in enumerate(b.column(b.num_columns - 1).to_pylist()):
                after: dict[int, list[int]] = {}
                for e in edges:
                    after.setdefault(e["src"], []).append(e["dst"])
                stack, found = [[0]], 0
                while stack and (most is None or found < most):
                    p = stack.pop()
                    nxt = [n for n in after.get(p[-1], ()) if n not in p]
                    if not after.get(p[-1]):
                        found += 1
                        at.append(i)
                        paths.append(p)
                        if len(paths) >= flush:
                            yield batch(b, at, paths)
                            at, paths = [], []
                    stack += [[*p, n] for n in reversed(nxt)]
            yield batch(b, at, paths)

    return _graphs(cfg_edges, keys).mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", path array<int>")
