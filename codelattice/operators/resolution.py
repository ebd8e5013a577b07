"""Resolution of calls to what they call: a cascade of rungs, each a left join or an expression; the first that yields a name wins.

``call_sites``: caller_fqn, file, module, target. Tables that are small by their nature (builtins, a registry of library functions)
are joined like the others; Spark broadcasts them by their measured size.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions.scalar import CONFIDENCE
from codelattice.operators.joins import resolve_imports, resolve_prefix_strip
from codelattice.session import cut

# Calls that are builtins however they are bound; names of ORM methods; names that usually stand for variables.
BUILTIN_CALLS = ("eval", "exec", "input", "raw_input", "compile", "__import__")
ORM_METHODS = ("filter", "get", "create", "update", "delete", "all", "first", "last", "count", "exists")
VARIABLE_NAMES = ("self", "cls", "request", "response", "queryset", "user", "obj", "value", "data", "result")
GO_BUILTINS = ("append", "cap", "clear", "close", "complex", "copy", "delete", "imag", "len", "make", "max", "min", "new", "panic", "print", "println", "real", "recover")
HEURISTIC = 0.7


def categorize_failure(target: Column, module_kind: Column | None = None) -> Column:
    """Why a call stayed unresolved; ``module_kind`` is ``thirdparty`` or ``stdlib`` where a registry knows the target's module."""
    kind = F.coalesce(module_kind, F.lit("")) if module_kind is not None else F.lit("")
    dotted = F.contains(target, F.lit("."))
    orm = F.contains(target, F.lit(".objects.")) | F.endswith(target, F.lit(".objects"))
    for m in ORM_METHODS:
        orm = orm | F.endswith(target, F.lit("." + m))
    first = F.substring_index(target, ".", 1)
    return (
        F.when(kind == "thirdparty", "external_framework").when(kind == "stdlib", "stdlib_unresolved").when(orm, "orm_pattern").when(F.startswith(target, F.lit("super(")) | F.startswith(target, F.lit("super.")), "super_call")
        .when(dotted & first.isin(*VARIABLE_NAMES), "variable_method").when(dotted & first.rlike("^[a-z]"), "attribute_chain").when(~dotted, "not_in_imports").otherwise("unknown")
    )


def resolve_orm(target: Column) -> Column:
    """The ORM that a target's shape shows: ``django`` for ``X.objects.m``, ``sqlalchemy`` for ``X.query.m``; null otherwise."""
    return F.when(target.rlike(r"^\w[\w.]*\.objects(?:\.\w+)+$"), "django").when(target.rlike(r"^\w[\w.]*\.query(?:\.\w+)+$"), "sqlalchemy")


def _names(functions: DataFrame, name: str) -> DataFrame:
    return functions.select(F.col("fqn").alias(name)).distinct()


def resolve_self_attr(call_sites: DataFrame, class_attributes: DataFrame, functions: DataFrame, max_depth: int = 6) -> DataFrame:
    """``self.a.b.m`` by the types of the attributes along the chain: adds ``self_fqn``; null where a step is unknown.

    ``class_attributes``: class_fqn, name, type_fqn. One join a step; chains end after ``max_depth`` steps.
    """
    attrs = class_attributes.groupBy("class_fqn", "name").agg(F.min("type_fqn").alias("_type"))
    parts = F.split("target", r"\.")
    is_self = F.startswith(F.col("target"), F.lit("self.")) & (F.size(parts) >= 3)
    df = call_sites.withColumns({"_parts": parts, "_at": F.when(is_self, F.regexp_extract("caller_fqn", r"^(.*)\.[^.]*$", 1)), "_i": F.lit(1)})
    for _ in range(max_depth):
        more = F.col("_at").isNotNull() & (F.col("_i") < F.size("_parts") - 1)
        df = df.withColumn("_name", F.when(more, F.get("_parts", F.col("_i")))).join(attrs.withColumnRenamed("class_fqn", "_at").withColumnRenamed("name", "_name"), ["_at", "_name"], "left")
        df = df.withColumns({"_at": F.when(more, F.col("_type")).otherwise(F.col("_at")), "_i": F.when(more, F.col("_i") + 1).otherwise(F.col("_i"))}).drop("_type", "_name")
    full = F.when(F.col("_at").isNotNull() & (F.col("_i") == F.size("_parts") - 1), F.concat_ws(".", "_at", F.element_at("_parts", -1)))
    df = df.withColumn("_full", full)
    known = _names(functions, "_full").withColumn("_known", F.lit(True))
    return df.join(known, "_full", "left").withColumn("self_fqn", F.when(F.col("_known"), F.col("_full"))).drop("_parts", "_at", "_i", "_full", "_known")


def resolve_inheritance(functions: DataFrame, mro: DataFrame) -> DataFrame:
    """``(class_fqn, method, fqn)``: for each class the method that each name stands for, the nearest ancestor's first."""
    f = functions.select("fqn", F.regexp_extract("fqn", r"^(.*)\.[^.]*$", 1).alias("ancestor"), F.substring_index("fqn", ".", -1).alias("method"))
    return mro.join(f, "ancestor").groupBy("class_fqn", "method").agg(F.min_by("fqn", F.struct("depth", "fqn")).alias("fqn"))


def resolve_call_py(call_sites: DataFrame, functions: DataFrame, imports: DataFrame, modules: DataFrame | None = None, bindings: DataFrame | None = None, class_attributes: DataFrame | None = None, mro: DataFrame | None = None, registry: DataFrame | None = None) -> DataFrame:
    """Adds ``resolved_fqn``, ``rung``, ``resolved`` and ``failure_reason``.

    Rungs in order: self_attr, super, self, builtin, import, registry, function, same_module, variable, prefix_strip, orm.
    ``registry``: fqn, kind (stdlib or thirdparty) of library functions; ``bindings``: scope_fqn, var, type_fqn, confidence.
    """
    df = call_sites
    t = F.col("target")
    enclosing = F.regexp_extract("caller_fqn", r"^(.*)\.[^.]*$", 1)
    rungs: list[tuple[str, Column]] = []
    if class_attributes is not None:
        df = resolve_self_attr(df, class_attributes, functions)
        rungs.append(("self_attr", F.col("self_fqn")))
    inherited = resolve_inheritance(functions, mro) if mro is not None else None
    if inherited is not None:
        up = mro.where("depth = 1").select(F.col("class_fqn").alias("_cls"), F.col("ancestor").alias("class_fqn")).join(inherited, "class_fqn").groupBy("_cls", "method").agg(F.min("fqn").alias("super_fqn")).withColumnRenamed("method", "_m")
        df = df.withColumns({"_cls": enclosing, "_m": F.when(F.startswith(t, F.lit("super().")) | F.startswith(t, F.lit("super.")), F.substring_index(t, ".", -1))}).join(up, ["_cls", "_m"], "left").drop("_m")
        rungs.append(("super", F.col("super_fqn")))
        mine = inherited.select(F.col("class_fqn").alias("_cls"), F.col("method").alias("_m"), F.col("fqn").alias("own_fqn"))
        df = df.withColumn("_m", F.when(t.rlike(r"^(?:self|cls)\.\w+$"), F.substring_index(t, ".", -1))).join(mine, ["_cls", "_m"], "left").drop("_m", "_cls")
        rungs.append(("self", F.col("own_fqn")))
    else:
        df = df.withColumn("_c", F.when(t.rlike(r"^(?:self|cls)\.\w+$"), F.concat_ws(".", enclosing, F.substring_index(t, ".", -1)))).join(_names(functions, "_c").withColumn("_k", F.lit(True)), "_c", "left").withColumn("own_fqn", F.when(F.col("_k"), F.col("_c"))).drop("_c", "_k")
        rungs.append(("self", F.col("own_fqn")))
    rungs.append(("builtin", F.when(t.isin(*BUILTIN_CALLS), F.concat(F.lit("builtins."), t))))
    df = resolve_imports(df, imports)
    known = _names(functions, "import_fqn").withColumn("_in", F.lit(True))
    df = df.join(known, "import_fqn", "left").withColumn("_imported", F.when(F.col("_in"), F.col("import_fqn"))).drop("_in")
    rungs.append(("import", F.col("_imported")))
    if registry is not None:
        df = df.withColumn("_any", F.coalesce("import_fqn", "target")).join(registry.groupBy(F.col("fqn").alias("_any")).agg(F.min("kind").alias("_lib")), "_any", "left").withColumn("_registered", F.when(F.col("_lib").isNotNull(), F.col("_any"))).drop("_any", "_lib")
        rungs.append(("registry", F.col("_registered")))
    df = df.join(_names(functions, "target").withColumn("_f", F.lit(True)), "target", "left").withColumn("_function", F.when(F.col("_f"), t)).drop("_f")
    rungs.append(("function", F.col("_function")))
    df = df.withColumn("_local", F.concat_ws(".", "module", "target")).join(_names(functions, "_local").withColumn("_f", F.lit(True)), "_local", "left").withColumn("_same", F.when(F.col("_f"), F.col("_local"))).drop("_f", "_local")
    rungs.append(("same_module", F.col("_same")))
    if bindings is not None:
        b = bindings.groupBy(F.col("scope_fqn").alias("_scope"), F.col("var").alias("_var")).agg(F.max(F.struct("confidence", "type_fqn")).alias("_b"))
        df = df.withColumn("_var", F.when(t.rlike(r"^\w+\.\w+$"), F.substring_index(t, ".", 1)))
        for scope, name in (("caller_fqn", "_b1"), ("module", "_b2")):
            df = df.join(b.withColumnRenamed("_scope", scope).withColumnRenamed("_b", name), [scope, "_var"], "left")
        df = df.withColumn("_bound", F.coalesce("_b1", "_b2")).withColumn("_v", F.concat_ws(".", "_bound.type_fqn", F.substring_index(t, ".", -1)))
        df = df.join(_names(functions, "_v").withColumn("_f", F.lit(True)), "_v", "left")
        df = df.withColumn("_variable", F.when(F.col("_bound").isNotNull() & (F.col("_f") | (F.col("_bound.confidence") >= HEURISTIC)), F.col("_v"))).drop("_f", "_v", "_b1", "_b2", "_bound", "_var")
        rungs.append(("variable", F.col("_variable")))
    some = df.where(F.coalesce(*(c for _, c in rungs)).isNull()).select(F.coalesce("import_fqn", "target").alias("_p")).where(F.contains(F.col("_p"), F.lit("."))).distinct()
    stripped = resolve_prefix_strip(some, functions.select("fqn"), "_p").where("resolved_fqn IS NOT NULL").select("_p", F.col("resolved_fqn").alias("_stripped"))
    df = df.withColumn("_p", F.coalesce("import_fqn", "target")).join(stripped, "_p", "left").drop("_p")
    rungs += [("prefix_strip", F.col("_stripped")), ("orm", F.when(resolve_orm(t).isNotNull(), t))]
    name = F.coalesce(*(c for _, c in rungs))
    rung = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in rungs))
    df = df.withColumns({"resolved_fqn": name, "rung": rung, "resolved": name.isNotNull()}).withColumn("failure_reason", F.when(F.col("resolved"), "").otherwise(categorize_failure(t)))
    return df.select(*call_sites.columns, "resolved_fqn", "rung", "resolved", "failure_reason")


def resolve_call_go(call_sites: DataFrame, functions: DataFrame, imports: DataFrame, bindings: DataFrame, promoted: DataFrame | None = None) -> DataFrame:
    """Go's cascade: imported package, variable of known type (own code, then as it stands if the name holds a path), promoted method,
    same package, builtin. ``promoted``: type_fqn, method, fqn of embedded fields' methods."""
    t = F.col("target")
    df = resolve_imports(call_sites, imports).withColumn("_import", F.col("import_fqn"))
    b = bindings.groupBy(F.col("scope_fqn").alias("caller_fqn"), F.col("var").alias("_var")).agg(F.max(F.struct("confidence", "type_fqn")).alias("_b"))
    df = df.withColumns({"_var": F.when(t.rlike(r"^\w+\.\w+$"), F.substring_index(t, ".", 1)), "_method": F.substring_index(t, ".", -1)}).join(b, ["caller_fqn", "_var"], "left")
    df = df.withColumn("_v", F.when(F.col("_b").isNotNull(), F.concat_ws(".", F.regexp_replace("_b.type_fqn", r"^[*&\[\]]+", ""), "_method")))
    df = df.join(_names(functions, "_v").withColumn("_own", F.lit(True)), "_v", "left")
    rungs = [("import", F.col("_import")), ("variable", F.when(F.col("_own"), F.col("_v")))]
    if promoted is not None:
        p = promoted.groupBy(F.col("type_fqn").alias("_t"), F.col("method").alias("_method")).agg(F.min("fqn").alias("_promoted"))
        df = df.withColumn("_t", F.regexp_replace("_b.type_fqn", r"^[*&\[\]]+", "")).join(p, ["_t", "_method"], "left")
        rungs.append(("promoted", F.col("_promoted")))
    rungs.append(("best_effort", F.when(F.contains(F.col("_v"), F.lit("/")), F.col("_v"))))
    df = df.withColumn("_local", F.concat_ws(".", "module", "target")).join(_names(functions, "_local").withColumn("_same", F.lit(True)), "_local", "left")
    rungs += [("same_package", F.when(F.col("_same"), F.col("_local"))), ("builtin", F.when(t.isin(*GO_BUILTINS), F.concat(F.lit("builtin."), t)))]
    name, rung = F.coalesce(*(c for _, c in rungs)), F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in rungs))
    return df.withColumns({"resolved_fqn": name, "rung": rung, "resolved": name.isNotNull()}).select(*call_sites.columns, "resolved_fqn", "rung", "resolved")


def chain_steps(target: Column) -> Column:
    """The names of a chained call: ``a().b(x).c()`` gives [a, b, c]; what stands in brackets is left out, however deep."""
    closing, opening = F.lit(")"), F.lit("(")

    def step(at: Column, c: Column) -> Column:
        deep = at["deep"] + F.when(c == opening, 1).when((c == closing) & (at["deep"] > 0), -1).otherwise(0)
        inside = (at["deep"] > 0) | (c == opening)
        return F.struct(deep.alias("deep"), F.when(inside, at["text"]).otherwise(F.concat(at["text"], c)).alias("text"))

    start = F.struct(F.lit(0).alias("deep"), F.lit("").alias("text"))
    return F.split(F.aggregate(F.split(target, ""), start, step, lambda at: at["text"]), r"\.")


def resolve_chain(chains: DataFrame, returns: DataFrame, methods: DataFrame, max_steps: int | None = None) -> DataFrame:
    """Chained calls step by step: the first by what a function returns or a variable is, the others by what methods return.

    ``chains``: id, target; ``returns``: name, type_fqn, confidence; ``methods``: type_fqn, method, return_type, confidence.
    Gives id, type_fqn, confidence (the product over the steps), steps; chains with an unknown step are left out. One join a step,
    as many as the longest chain has (one number reaches the driver); every few steps the state is checkpointed.
    """
    first = returns.groupBy(F.col("name").alias("_s")).agg(F.max(F.struct(F.col("confidence").alias("c"), F.col("type_fqn").alias("t"))).alias("_r"))
    m = methods.groupBy(F.col("type_fqn").alias("_t"), F.col("method").alias("_s")).agg(F.max(F.struct(F.col("confidence").alias("c"), F.col("return_type").alias("t"))).alias("_r"))
    steps = chains.select("id", chain_steps(F.col("target")).alias("_steps"))
    rounds = max_steps if max_steps is not None else steps.agg(F.max(F.size("_steps"))).first()[0]
    now = steps.withColumn("_s", F.get("_steps", F.lit(0))).join(first, "_s").select("id", "_steps", F.col("_r.t").alias("_t"), F.col("_r.c").cast("double").alias("_c"), F.lit(1).alias("_n"))
    done = []
    for i in range(max(1, rounds or 1)):
        if i and i % 6 == 0:
            now = cut(now)
        done.append(now.where(F.col("_n") == F.size("_steps")))
        now = now.where(F.col("_n") < F.size("_steps")).withColumn("_s", F.get("_steps", F.col("_n"))).join(m, ["_t", "_s"]).select("id", "_steps", F.col("_r.t").alias("_t"), (F.col("_c") * F.col("_r.c")).alias("_c"), (F.col("_n") + 1).alias("_n"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", F.col("_t").alias("type_fqn"), F.col("_c").alias("confidence"), F.col("_n").alias("steps"))


def merge_return_types(returns: DataFrame) -> DataFrame:
    """The most confident return type of each function; of equals the least name."""
    best = returns.groupBy("fqn").agg(F.min_by(F.struct("type_fqn", "confidence"), F.struct(-F.col("confidence"), F.col("type_fqn"))).alias("_b"))
    return best.select("fqn", "_b.type_fqn", "_b.confidence")


def propagate_types(bindings: DataFrame, returns: DataFrame, passes: int | None = None) -> DataFrame:
    """Placeholders replaced: ``call:f`` by what f returns (confidence times the binding's times 0.95), ``var:v`` by v's type in the same scope.

    ``bindings``: scope_fqn, var, line, type_fqn, confidence. Passes end when none replaces any more, or after ``passes``.
    """
    r = merge_return_types(returns).select(F.col("fqn").alias("_f"), F.col("type_fqn").alias("_t"), F.col("confidence").alias("_c"))
    is_call, is_var = F.startswith(F.col("type_fqn"), F.lit("call:")), F.startswith(F.col("type_fqn"), F.lit("var:"))
    df = bindings.withColumn("_f", F.when(is_call, F.substring("type_fqn", 6, 1 << 20))).join(r, "_f", "left")
    df = df.withColumns({"confidence": F.when(F.col("_t").isNotNull(), F.col("confidence") * F.col("_c") * 0.95).otherwise(F.col("confidence")), "type_fqn": F.coalesce("_t", "type_fqn")}).select(*bindings.columns)
    done, left = 0, -1
    while passes is None or done < passes:
        known = df.where(~is_var & ~is_call).groupBy("scope_fqn", F.col("var").alias("_v")).agg(F.max(F.struct("line", "type_fqn", "confidence")).alias("_k"))
        df = df.withColumn("_v", F.when(is_var, F.substring("type_fqn", 5, 1 << 20))).join(known, ["scope_fqn", "_v"], "left")
        df = df.withColumns({"confidence": F.when(F.col("_k").isNotNull(), F.col("confidence") * F.col("_k.confidence")).otherwise(F.col("confidence")), "type_fqn": F.coalesce("_k.type_fqn", "type_fqn")}).select(*bindings.columns)
        df = cut(df)
        done += 1
        now = df.where(is_var).count()
        if now in (0, left):
            break
        left = now
    return df


def confidence_of(source: Column, table: Mapping[str, float] = CONFIDENCE) -> Column:
    """The confidence of a type by how it became known; 0 for unknown ways."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), source), F.lit(0.0))


def framework_detect(imports: DataFrame, frameworks: DataFrame) -> DataFrame:
    """``(file, framework, category)``: frameworks (prefix, framework, category) whose module, or a module above it, a file imports."""
    parts = F.split("fqn", r"\.")
    up = imports.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("prefix"))
    return up.join(frameworks, "prefix").select("file", "framework", "category").distinct()


def enrich_go_chains(statements: DataFrame, parameters: DataFrame, bindings: DataFrame) -> DataFrame:
    """``call_chain`` with its leading variable replaced by that variable's type: a parameter's first, else the one bound last before the line.

    ``parameters``: fqn, var, type_fqn; ``bindings``: fqn, var, line, type_fqn. Chains whose variable has no known type stay. One join
    on the function and variable for parameters, an as-of join for bindings.
    """
    from codelattice.operators.joins import asof_latest_def

    plain = lambda c: F.regexp_replace(c, r"^[*&]+", "")
    dotted = F.contains("call_chain", F.lit("."))
    df = statements.withColumn("_v", F.when(dotted, F.substring_index("call_chain", ".", 1)))
    p = parameters.groupBy("fqn", F.col("var").alias("_v")).agg(F.min(plain(F.col("type_fqn"))).alias("_p"))
    one = bindings.groupBy("fqn", "var", F.col("line").alias("def_line")).agg(F.min(plain(F.col("type_fqn"))).alias("_b"))
    used = df.where(F.col("_v").isNotNull()).select("fqn", F.col("_v").alias("var"), "line").distinct()
    bound = asof_latest_def(used, bindings.select("fqn", "var", "line")).join(one, ["fqn", "var", "def_line"]).select("fqn", F.col("var").alias("_v"), "line", "_b")
    got = df.join(p, ["fqn", "_v"], "left").join(bound, ["fqn", "_v", "line"], "left")
    kind = F.coalesce(F.when(F.col("_p") != "", F.col("_p")), F.when(F.col("_b") != "", F.col("_b")))
    rest = F.substring(F.col("call_chain"), F.length("_v") + 1, F.length("call_chain"))
    return got.withColumn("call_chain", F.when(kind.isNotNull(), F.concat(kind, rest)).otherwise(F.col("call_chain"))).select(*statements.columns)
