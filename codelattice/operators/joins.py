"""Joins between call sites, functions, classes, statements and modules.

As-of joins are unions with a window: both sides are sorted once within the join key, and the last value seen is carried along.
A join on raw inequalities would compare every pair of a key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_call_function(call_sites: DataFrame, functions: DataFrame) -> DataFrame:
    """Each call site with file and line of the function that its target names; null where it names none."""
    f = functions.select(F.col("fqn").alias("target_fqn"), F.col("file").alias("target_file"), F.col("line").alias("target_line"))
    return call_sites.join(f, "target_fqn", "left")


def join_sources_sinks(sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Functions that hold both a source and a sink."""
    return sources.select("fqn").intersect(sinks.select("fqn"))


def language_filter(rows: DataFrame, functions: DataFrame, language: str, fqn: str = "fqn") -> DataFrame:
    """Rows whose function is written in the language."""
    return rows.join(functions.where(F.col("language") == language).select(F.col("fqn").alias(fqn)).distinct(), fqn, "left_semi")


def module_filter(fqn: Column, module: str) -> Column:
    return (fqn == module) | F.startswith(fqn, F.lit(module + "."))


def diff_filter(findings: DataFrame, changed: DataFrame, path: str = "file") -> DataFrame:
    """Findings in changed files; with no changed files all findings."""
    if changed.isEmpty():
        return findings
    return findings.join(changed.select(F.col("path").alias(path)).distinct(), path, "left_semi")


def join_line_proximity(sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """Every source with every sink of the same function, unless a sanitizer stands strictly between them.

    The number of sanitizers up to a line is a running count, so a pair is clean if the counts on both sides agree; sanitizers
    are never joined to pairs. Inputs: (fqn, line).
    """
    marks = sanitizers.select("fqn", "line").distinct().withColumn("_mark", F.lit(1))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        both = rows.select("fqn", F.col("line").alias("_line"), F.lit(0).alias("_m")).unionByName(marks.select("fqn", F.col("line").alias("_line"), F.lit(1).alias("_m")))
        w = Window.partitionBy("fqn").orderBy("_line")
        below = F.sum("_m").over(w.rangeBetween(Window.unboundedPreceding, -1))
        upto = F.sum("_m").over(w.rangeBetween(Window.unboundedPreceding, 0))
        got = both.withColumns({"_below": F.coalesce(below, F.lit(0)), "_upto": F.coalesce(upto, F.lit(0))}).where("_m = 0")
        return got.select("fqn", F.col("_line").alias(name), F.col("_below").alias(f"{name}_below"), F.col("_upto").alias(f"{name}_upto"))

    a, b = counted(sources, "source_line"), counted(sinks, "sink_line")
    pairs = a.join(b, "fqn")
    between = F.when(F.col("source_line") < F.col("sink_line"), F.col("sink_line_below") - F.col("source_line_upto")).when(F.col("source_line") > F.col("sink_line"), F.col("source_line_below") - F.col("sink_line_upto")).otherwise(0)
    return pairs.where(between <= 0).select("fqn", "source_line", "sink_line", F.lit(0.5).alias("confidence"))


def asof_latest_def(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """Each use (fqn, var, line) with the greatest line of a definition of the variable that is not behind it; null if there is none."""
    both = uses.select("fqn", "var", "line", F.lit(1).alias("_use"), F.lit(None).cast("int").alias("_def")).unionByName(defs.select("fqn", "var", "line", F.lit(0).alias("_use"), F.col("line").cast("int").alias("_def")))
    w = Window.partitionBy("fqn", "var").orderBy("line", "_use").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("def_line", F.last("_def", ignorenulls=True).over(w)).where("_use = 1").select("fqn", "var", "line", "def_line")


def build_edge_latest_def(statements: DataFrame) -> DataFrame:
    """An edge from the live definition of each used variable to each statement that defines one: (fqn, var, from_seq, to_seq).

    ``statements``: fqn, seq, def, uses array. Live is the last definition of an earlier statement, in the order of ``seq``.
    """
    defs = statements.where("def <> ''").select("fqn", F.col("def").alias("var"), "seq", F.lit(1).alias("_def"))
    uses = statements.where("def <> ''").select("fqn", F.explode(F.array_distinct("uses")).alias("var"), "seq", F.lit(0).alias("_def"))
    w = Window.partitionBy("fqn", "var").orderBy("seq", "_def").rowsBetween(Window.unboundedPreceding, -1)
    both = defs.unionByName(uses).withColumn("from_seq", F.last(F.when(F.col("_def") == 1, F.col("seq")), ignorenulls=True).over(w))
    return both.where("_def = 0 AND from_seq IS NOT NULL").select("fqn", "var", "from_seq", F.col("seq").alias("to_seq"))


def range_containing_function(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Each call (file, line, col) with the function of the file that begins last at or before it.

    Calls in column 1 stand at module level; they and calls before any function get the file's module.
    ``functions``: file, line, fqn; ``calls`` may carry further columns and needs ``module``.
    """
    rest = [c for c in calls.columns if c not in ("file", "line")]
    a = calls.select("file", "line", F.struct(*rest).alias("_call"), F.lit(None).cast("string").alias("_fqn"), F.lit(1).alias("_k"))
    b = functions.select("file", "line", F.lit(None).cast(a.schema["_call"].dataType).alias("_call"), F.col("fqn").alias("_fqn"), F.lit(0).alias("_k"))
    w = Window.partitionBy("file").orderBy("line", "_k", "_fqn").rowsBetween(Window.unboundedPreceding, 0)
    got = a.unionByName(b).withColumn("_in", F.last("_fqn", ignorenulls=True).over(w)).where("_k = 1")
    return got.select("file", "line", "_call.*", "_in").withColumn("caller_fqn", F.when(F.col("col") == 1, F.col("module")).otherwise(F.coalesce("_in", "module"))).drop("_in")


def range_containing_class(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Each member (file, start, end, id) with the smallest class (file, start, end, name) whose range holds it, its own range aside.

    One sweep over a file's starts in order, with the classes that are still open: as classes nest, these are few. Members and classes
    of a file travel as one array; both are bounded by the file.
    """
    m = members.select("file", "start", "end", F.col("id"), F.lit(None).cast("string").alias("name"), F.lit(1).alias("kind"))
    c = classes.select("file", "start", "end", F.lit(None).cast(members.schema["id"].dataType).alias("id"), "name", F.lit(0).alias("kind"))
    rows = m.unionByName(c).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "name", "id"))).alias("rows"))
    kinds = [members.schema[x].dataType.simpleString() for x in ("file", "start", "end", "id")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            item = b.schema.field("rows").type.value_type
            for file, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                open_: list[tuple] = []
                for r in spans:
                    if r["start"] is None or r["end"] is None:
                        if r["kind"]:
                            out.append((file, r["start"], r["end"], r["id"], None))
                        continue
                    open_ = [x for x in open_ if x[1] >= r["start"]]
                    if r["kind"]:
                        held = [(e - s, n) for s, e, n in open_ if e >= r["end"] and (s, e) != (r["start"], r["end"])]
                        out.append((file, r["start"], r["end"], r["id"], min(held)[1] if held else None))
                    else:
                        open_.append((r["start"], r["end"], r["name"]))
            cols = list(zip(*dict.fromkeys(out), strict=True)) or [()] * 5
            types = [b.schema.field("file").type, item.field("start").type, item.field("end").type, item.field("id").type, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["file", "start", "end", "id", "class_name"])

    return rows.mapInArrow(run, f"file {kinds[0]}, start {kinds[1]}, end {kinds[2]}, id {kinds[3]}, class_name string")


def resolve_imports(call_sites: DataFrame, imports: DataFrame) -> DataFrame:
    """The first segment of each target looked up among its file's aliases: adds ``import_fqn``, the full name; null if not imported.

    ``imports``: file, alias, fqn. Of an alias bound twice in a file the least name is taken.
    """
    one = imports.groupBy("file", F.col("alias").alias("_head")).agg(F.min("fqn").alias("_fqn"))
    head = F.substring_index("target", ".", 1)
    joined = call_sites.withColumn("_head", head).join(one, ["file", "_head"], "left")
    tail = F.substring(F.col("target"), F.length("_head") + 1, F.length("target"))
    return joined.withColumn("import_fqn", F.concat("_fqn", tail)).drop("_head", "_fqn")


def absolute_import(module: Column, level: Column, is_package: Column, name: Column) -> Column:
    """A relative import's module: up ``level`` packages from ``module`` (one less if the file is a package itself), then ``name``."""
    up = level - F.when(is_package, 1).otherwise(0)
    parts = F.split(module, r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - up, F.lit(0))), ".")
    absolute = F.when(name == "", base).when(base == "", name).otherwise(F.concat_ws(".", base, name))
    return F.when(level == 0, name).otherwise(absolute)


def resolve_prefix_strip(names: DataFrame, known: DataFrame, column: str = "fqn") -> DataFrame:
    """Names resolved by leaving out leading packages until what is left is known: adds ``resolved_fqn`` and how many were left out."""
    parts = F.split(F.col(column), r"\.")
    suffixes = names.withColumn("_i", F.explode(F.sequence(F.lit(0), F.size(parts) - 1))).withColumn("_suffix", F.array_join(F.slice(parts, F.col("_i") + 1, F.size(parts)), "."))
    hits = suffixes.join(known.select(F.col("fqn").alias("_suffix")).distinct(), "_suffix", "left_semi")
    best = hits.groupBy(column).agg(F.min_by("_suffix", "_i").alias("resolved_fqn"), F.min("_i").alias("stripped"))
    return names.join(best, column, "left")


def validate_fqn(names: DataFrame, modules: DataFrame, column: str = "fqn") -> DataFrame:
    """Names that are a module, or whose parent or grandparent is one. One join: each name brings its three candidates."""
    up = lambda x: F.regexp_extract(x, r"^(.*)\.[^.]*$", 1)
    c = F.col(column)
    wanted = names.withColumn("_m", F.explode(F.array_distinct(F.array(c, up(c), up(up(c))))))
    return wanted.join(modules.select(F.col("module_path").alias("_m")).distinct(), "_m", "left_semi").drop("_m").dropDuplicates([column])


def mro_closure(bases: DataFrame, limit: int = 50) -> DataFrame:
    """All ancestors of each class with their least distance: (class_fqn, ancestor, depth), itself at 0."""
    from codelattice.operators.traversal import closure

    classes = bases.select("class_fqn").unionByName(bases.select(F.col("base").alias("class_fqn"))).distinct()
    edges = bases.select(F.col("class_fqn").alias("src"), F.col("base").alias("dst"))
    return closure(edges, classes.select(F.col("class_fqn").alias("root")), limit).select(F.col("root").alias("class_fqn"), F.col("node").alias("ancestor"), "depth")


def transitive_class_kind(classes: DataFrame, bases: DataFrame, roots: Sequence[tuple[str, Sequence[str]]] = (("enum", ("Enum", "IntEnum", "StrEnum", "Flag", "IntFlag")), ("interface", ("Protocol", "ABC", "Interface")), ("dataclass", ("dataclass", "BaseModel", "NamedTuple", "TypedDict")))) -> DataFrame:
    """What a class is by what it descends from, by simple name: enum before interface before dataclass; else ``class``."""
    mro = mro_closure(bases).where("depth > 0").withColumn("_short", F.substring_index("ancestor", ".", -1))
    rank = None
    for i, (_, names) in enumerate(roots):
        hit = F.col("_short").isin(*names)
        rank = F.when(hit, i) if rank is None else rank.when(hit, i)
    best = mro.withColumn("_rank", rank).groupBy("class_fqn").agg(F.min("_rank").alias("_rank"))
    kind = F.element_at(F.array(*(F.lit(k) for k, _ in roots)), F.col("_rank") + 1)
    return classes.join(best, "class_fqn", "left").withColumn("kind", F.when(F.col("_rank").isNull(), "class").otherwise(kind)).drop("_rank")
