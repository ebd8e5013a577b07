"""Interactive lookups over symbols, modules, imports and container facts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions.scalar import symbol_kind
from codelattice.operators.joins import module_filter

LIMIT = 100


def index_info(nodes: DataFrame, call_edges: DataFrame) -> DataFrame:
    """``(section, name, n)``: symbols by type and by kind, the ten modules with most functions, and distinct callers."""
    by_type = nodes.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("section", F.lit("type"))
    by_kind = nodes.groupBy(symbol_kind(F.col("type")).cast("string").alias("name")).agg(F.count("*").alias("n")).withColumn("section", F.lit("kind"))
    top = nodes.where(F.col("type").isin("function_definition", "function_declaration", "method", "constructor")).groupBy(F.col("module").alias("name")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(10).withColumn("section", F.lit("top_module"))
    edges = call_edges.agg(F.countDistinct("caller").alias("n")).select(F.lit("callers").alias("name"), "n", F.lit("edges").alias("section"))
    cols = ("section", "name", "n")
    return by_type.select(*cols).unionByName(by_kind.select(*cols)).unionByName(top.select(*cols)).unionByName(edges.select(*cols))


def find_symbol(symbols: DataFrame, name: str | None = None, types: tuple[str, ...] = (), module: str | None = None) -> DataFrame:
    """Symbols (fqn, type, file, line) by name (equal, last segment or part of it), types and module; at least one must be given."""
    if not (name or types or module):
        raise ValueError("give a name, types or a module")
    fqn = F.col("fqn")
    test = F.lit(True)
    if name:
        test = test & ((fqn == name) | F.endswith(fqn, F.lit("." + name)) | F.contains(fqn, F.lit(name)))
    if types:
        test = test & F.col("type").isin(*types)
    if module:
        test = test & module_filter(fqn, module)
    return symbols.where(test)


def module_counts(modules: DataFrame, functions: DataFrame) -> DataFrame:
    """Each module (module_path, file) with its number of functions, those of modules below it included.

    Functions are counted by module first; each count then goes to every module above it, so prefixes are never compared in pairs.
    """
    per = functions.groupBy(F.regexp_extract("fqn", r"^(.*)\.[^.]*$", 1).alias("_m")).agg(F.count("*").alias("_n"))
    parts = F.split("_m", r"\.")
    up = per.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("module_path"), "_n")
    return modules.join(up.groupBy("module_path").agg(F.sum("_n").alias("_n")), "module_path", "left").select(*modules.columns, F.coalesce("_n", F.lit(0)).alias("functions"))


def find_module(modules: DataFrame, functions: DataFrame, name: str) -> DataFrame:
    """The module of that name, else those whose name holds it; with function counts."""
    exact = modules.where(F.col("module_path") == name)
    found = exact if not exact.isEmpty() else modules.where(F.contains(F.col("module_path"), F.lit(name)))
    return module_counts(found, functions)


def resolve_import(modules: DataFrame, path: str) -> DataFrame:
    """Modules for an import, by the best way that has any: exact, short_name (one), ambiguous (several), partial."""
    m, short = F.col("module_path"), path.rpartition(".")[2]
    by_short = F.substring_index(m, ".", -1) == short
    ranked = modules.withColumn("_rank", F.when(m == path, 0).when(by_short, 1).when(F.contains(m, F.lit(path)), 2)).where("_rank IS NOT NULL")
    counts = ranked.groupBy("_rank").agg(F.count("*").alias("_n"))
    best = counts.agg(F.min_by(F.struct("_rank", "_n"), "_rank").alias("_b"))
    kind = F.when(F.col("_rank") == 0, "exact").when((F.col("_rank") == 1) & (F.col("_b._n") == 1), "short_name").when(F.col("_rank") == 1, "ambiguous").otherwise("partial")
    return ranked.join(F.broadcast(best), F.col("_rank") == F.col("_b._rank")).select("module_path", "file", kind.alias("match_type"))  # one row


def find_docker_instructions(instructions: DataFrame, kind: str | None = None, path: str | None = None, base_image: str | None = None, digest: bool | None = None, user: str | None = None, port: str | None = None) -> DataFrame:
    """Up to 100 instructions, in order of file and line, that meet the criteria; texts are matched in part."""
    tests: list[Column] = []
    part = lambda c, v: F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(v))
    if kind:
        tests.append(F.upper("instruction") == kind.upper())
    if path:
        tests.append(part("file", path))
    if base_image:
        tests.append(part("image", base_image))
    if digest is not None:
        has = part("raw", "@sha256:")
        tests.append(has if digest else ~has)
    if user:
        tests.append(F.col("user_name") == user)
    if port:
        tests.append((F.col("instruction") == "EXPOSE") & part("raw", port))
    got = instructions
    for t in tests:
        got = got.where(t)
    return got.orderBy("file", "line", "seq").limit(LIMIT)


def find_compose_services(props: DataFrame, name: str | None = None, path: str | None = None, privileged: bool | None = None, port: str | None = None, volume: str | None = None) -> DataFrame:
    """Up to 100 services (repo, file_path, service, line) that meet the criteria."""
    item = lambda key, v: F.coalesce(F.bool_or((F.col("prop_key") == key) & F.exists("prop_items", lambda x: F.contains(x, F.lit(v)))), F.lit(False))
    s = props.groupBy("repo", "file_path", "service").agg(
        F.min("service_line").alias("line"), F.coalesce(F.bool_or((F.col("prop_key") == "privileged") & F.lower("scalar").isin("true", "yes")), F.lit(False)).alias("_priv"), item("ports", port or "").alias("_port"), item("volumes", volume or "").alias("_volume")
    )
    if name:
        s = s.where(F.contains(F.col("service"), F.lit(name)))
    if path:
        s = s.where(F.contains(F.col("file_path"), F.lit(path)))
    if privileged is not None:
        s = s.where(F.col("_priv") == privileged)
    if port:
        s = s.where("_port")
    if volume:
        s = s.where("_volume")
    return s.select("repo", "file_path", "service", "line").orderBy("repo", "file_path", "service", "line").limit(LIMIT)


# The shapes of a lookup and how sure each makes its reading.
_SHAPES = (
    ("self_call", re.compile(r"^self\.(?P<method>\w+)(?:\(\))?$"), 0.95), ("inline_instantiation", re.compile(r"^(?P<cls>[A-Z]\w*)\(\)\.(?P<method>\w+)(?:\(\))?$"), 0.9), ("chained_call", re.compile(r"^.*\)\..*\(\)$|^\w+\(\)\.\w+.*$"), 0.0),
    ("class_method", re.compile(r"^(?P<cls>[A-Z]\w*)\.(?P<method>\w+)(?:\(\))?$"), 0.95), ("direct_fqn", re.compile(r"^\w+(?:\.\w+){2,}$"), 1.0), ("instance_call", re.compile(r"^(?P<var>[a-z_]\w*)\.(?P<method>\w+)(?:\(\))?$"), 0.85),
)


@dataclass(frozen=True)
class Reading:
    """How a lookup is understood: its shape, the name to look up ('' if none) and how sure that is."""

    shape: str
    name: str
    confidence: float


def query_resolver(query: str, variables: dict[str, str] | None = None, self_type: str = "") -> Reading:
    """Reads a lookup such as ``self.save()``, ``User().save`` or ``app.models.User.save``."""
    q = query.strip()
    for shape, pattern, sure in _SHAPES:
        m = pattern.match(q)
        if not m:
            continue
        g = m.groupdict()
        if shape == "direct_fqn":
            return Reading(shape, q, sure)
        if shape == "chained_call":
            return Reading(shape, "", sure)
        owner = self_type if shape == "self_call" else (variables or {}).get(g["var"], "") if shape == "instance_call" else g["cls"]
        return Reading(shape, f"{owner}.{g['method']}" if owner else "", sure if owner else 0.0)
    return Reading("unknown", "", 0.0)


def get_instance_type(bindings: DataFrame, scope: str, var: str, line: int) -> DataFrame:
    """The type of a variable at a line: its last binding in the scope that is not behind the line."""
    b = bindings.where((F.col("scope_fqn") == scope) & (F.col("var") == var) & (F.col("line") <= line))
    return b.orderBy(F.col("line").desc(), "type_fqn").limit(1)


def resolve_instance_call(bindings: DataFrame, functions: DataFrame, scope: str, call: str, line: int) -> DataFrame:
    """The function that ``var.method`` names at a line of a scope."""
    var, _, method = call.partition(".")
    return get_instance_type(bindings, scope, var, line).select(F.concat_ws(".", "type_fqn", F.lit(method.partition("(")[0])).alias("fqn")).join(functions, "fqn")


@dataclass
class Status:
    """The progress of an index: idle, indexing, ready or failed; phases with their share of the work."""

    state: str = "idle"
    phase: str = ""
    progress: float = 0.0
    errors: list[str] = field(default_factory=list)

    def advance(self, phase: str, progress: float) -> None:
        self.state, self.phase, self.progress = "indexing", phase, max(self.progress, min(1.0, progress))

    def finish(self, error: str | None = None) -> None:
        self.state = "failed" if error else "ready"
        self.progress = self.progress if error else 1.0
        if error:
            self.errors.append(error)
