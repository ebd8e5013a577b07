"""Matchers that use what is known about a receiver's type.

``call_sites`` needs caller_fqn, line, target, target_fqn, via_type_inference, inferred_type, type_confidence and, for argument
constraints, arguments. '' means unknown. A registry of ancestors ``mro(class_fqn, ancestor)`` is optional.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions.scalar import clamp
from codelattice.operators.matching import Constraint, any_of, argument_match

DEFAULT_CONFIDENCE, BRIDGE_CONFIDENCE, STATEMENT_CONFIDENCE = 0.5, 0.7, 0.85


def receiver_matches(actual: Column, pattern: str) -> Column:
    """Equal; the last segment, for a pattern without a dot; or by stars at the pattern's ends."""
    p = pattern.strip()
    a = F.trim(actual)
    if not p:
        return F.lit(False)
    if "*" in p:
        core = p.strip("*")
        hit = a.isNotNull() if not core else F.contains(a, F.lit(core)) if p[0] == p[-1] == "*" else F.endswith(a, F.lit(core)) if p[0] == "*" else F.startswith(a, F.lit(core)) if p[-1] == "*" else a == p
    else:
        hit = (a == p) if "." in p else (a == p) | F.endswith(a, F.lit("." + p))
    return (a != "") & hit


def fqn_bridge(target_fqn: Column, target: Column) -> Column:
    """The receiver that a resolved name implies: the name without the method; '' where it doesn't end in it."""
    tail = F.concat(F.lit("."), F.substring_index(target, ".", -1))
    return F.when(F.endswith(target_fqn, tail), F.substring(target_fqn, F.lit(1), F.length(target_fqn) - F.length(tail))).otherwise("")


def _subclass(df: DataFrame, column: str, receivers: Sequence[str], mro: DataFrame | None) -> DataFrame:
    """Adds whether the class in ``column`` descends from one of the receivers."""
    if mro is None:
        return df.withColumn("_sub", F.lit(False))
    wanted = any_of([(F.col("ancestor") == r) | (F.endswith(F.col("ancestor"), F.lit("." + r)) if "." not in r else F.lit(False)) for r in receivers])
    classes = mro.where(wanted).select(F.col("class_fqn").alias("_class"), F.lit(True).alias("_sub")).distinct()
    return df.join(classes, df[column] == classes["_class"], "left").drop("_class").withColumn("_sub", F.coalesce("_sub", F.lit(False)))


def type_constrained_call(
    call_sites: DataFrame, receivers: Sequence[str], methods: Sequence[str], positional: Mapping[str, Constraint] = {}, keyword: Mapping[str, Constraint] = {}, patterns: Sequence[str] = (),  # noqa: B006
    min_confidence: float = DEFAULT_CONFIDENCE, fallback: str = "none", mro: DataFrame | None = None,
) -> DataFrame:
    """Calls of a method on a receiver type, by the first way that tells the type.

    Inferred type (of at least ``min_confidence``), then the type within the resolved name, then a case-insensitive prefix of that
    name, then, with ``fallback='name'``, the method's name alone. Arguments are tested within each way; a failing test ends the search.
    """
    named, way, confidence = typed_columns(receivers, methods, patterns, min_confidence, fallback, mro is not None)
    sites = call_sites.where(named)
    if mro is not None:
        sites = _subclass(sites, "inferred_type", receivers, mro).withColumnRenamed("_sub", "_inferred_sub")
        sites = _subclass(sites.withColumn("_bridge", fqn_bridge(F.coalesce(F.col("target_fqn"), F.lit("")), F.col("target"))), "_bridge", receivers, mro)
    sites = sites.withColumn("match_method", way).where(F.col("match_method").isNotNull())
    if positional or keyword:
        sites = sites.where(argument_match(F.col("arguments"), positional, keyword, lists=False, comparators=True))
    return sites.withColumns({"confidence": confidence, "scope": F.lit("local")}).drop("_bridge", "_inferred_sub", "_sub")


def typed_columns(receivers: Sequence[str], methods: Sequence[str], patterns: Sequence[str] = (), min_confidence: float = DEFAULT_CONFIDENCE, fallback: str = "none", subclasses: bool = False) -> tuple[Column, Column, Column]:
    """Whether the method is one of those, the way that tells the receiver's type (null for none), and the confidence, as columns.

    With ``subclasses`` the call sites hold what ``_subclass`` adds.
    """
    target, fqn = F.col("target"), F.coalesce(F.col("target_fqn"), F.lit(""))
    named = (target != "") & (any_of([(target == m) | F.endswith(target, F.lit("." + m)) for m in methods]) if methods else F.lit(True))
    bridge = fqn_bridge(fqn, target)
    known = [*receivers, *patterns]
    by = lambda c: any_of([receiver_matches(c, r) for r in known])
    inferred = F.coalesce(F.col("inferred_type"), F.lit(""))
    sub = lambda c: F.col(c) if subclasses else F.lit(False)
    confident = F.coalesce(F.col("via_type_inference"), F.lit(False)) & (F.col("type_confidence").cast("float") >= F.lit(float(min_confidence)).cast("float"))
    low = F.lower(fqn)
    prefix = any_of([F.startswith(low, F.lit(r.lower() + ".")) for r in receivers])
    way = F.when(confident & (by(inferred) | sub("_inferred_sub")), "type_inference").when((fqn != "") & (bridge != "") & (by(bridge) | sub("_sub")), "fqn_bridge").when((fqn != "") & prefix, "fqn_prefix")
    if fallback == "name":
        way = way.otherwise("name_fallback")
    c = clamp(F.col("type_confidence"))
    return named, way, F.when(c == 0, BRIDGE_CONFIDENCE).otherwise(c)


def typed_statement_scan(statements: DataFrame, receivers: Sequence[str], methods: Sequence[str], seen: DataFrame) -> DataFrame:
    """Statements whose call chain is ``receiver.method``, where no call site of the function's line is in ``seen`` (caller_fqn, line)."""
    chains = [f"{r}.{m}" for r in receivers for m in methods]
    hits = statements.where(F.col("call_chain").isin(*chains)).join(seen.select(F.col("caller_fqn").alias("fqn"), "line").distinct(), ["fqn", "line"], "left_anti")
    return hits.dropDuplicates(["fqn", "line"]).withColumns({"confidence": F.lit(STATEMENT_CONFIDENCE), "scope": F.lit("local"), "match_method": F.lit("statement_callchain")})


def type_constrained_attribute(call_sites: DataFrame, statements: DataFrame, receivers: Sequence[str], attribute: str, min_confidence: float = DEFAULT_CONFIDENCE) -> DataFrame:
    """Accesses of a typed receiver's attribute: (fqn, line, access, confidence, match_method), from call sites and from statements."""
    t = F.col("target")
    typed = F.coalesce(F.col("via_type_inference"), F.lit(False)) & (F.col("type_confidence").cast("float") >= F.lit(float(min_confidence)).cast("float")) & any_of([receiver_matches(F.col("inferred_type"), r) for r in receivers])
    a = call_sites.where(F.endswith(t, F.lit("." + attribute)) & typed).select(F.col("caller_fqn").alias("fqn"), "line", t.alias("access"), clamp(F.col("type_confidence")).alias("confidence"), F.lit("type_inference").alias("match_method"))
    s = F.col("attribute_access")
    names = [f"{r}.{attribute}" for r in receivers]
    b = statements.where((s != "") & any_of([s.isin(*names)] + [F.startswith(s, F.lit(n + ".")) for n in names]))
    return a.unionByName(b.select("fqn", "line", s.alias("access"), F.lit(STATEMENT_CONFIDENCE).alias("confidence"), F.lit("statement_attribute").alias("match_method")))
