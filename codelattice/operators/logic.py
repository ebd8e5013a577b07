"""Combinations of detections, and set operations on tables.

Detections carry fqn, source_line, source_column, sink_line, sink_column, sink_call, confidence and match_method; lines and columns
that don't apply are 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = ("fqn", "source_line", "source_column", "sink_line", "sink_column")
KEY = (*PLACE, "sink_call", "match_method")


def dedup_best(rows: DataFrame, keys: Sequence[str], by: str = "confidence") -> DataFrame:
    """The row of the greatest ``by`` for each key; ties go to the least of the other columns. Partial aggregation before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != by]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(by, *rest), F.struct(F.col(by), F.xxhash64(*keys, *rest))).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


def logic_or(children: Sequence[DataFrame]) -> DataFrame:
    """All detections, one for each key: the most confident."""
    return dedup_best(reduce(DataFrame.unionByName, children), KEY)


def logic_and(children: Sequence[DataFrame]) -> DataFrame:
    """The first child's rows whose place every other child has too; repeated rows of the first stay."""
    out = children[0]
    for other in children[1:]:
        places = other.select(*(F.col(c).alias(f"_{c}") for c in PLACE)).distinct()
        out = out.join(places, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLACE]), "left_semi")
    return out


def logic_not(call_sites: DataFrame, matched: DataFrame, compat: bool = False) -> DataFrame:
    """Distinct (caller_fqn, line, target) that no detection covers; ``compat`` gives them all, as an unread child does."""
    universe = call_sites.select(F.col("caller_fqn").alias("fqn"), F.col("line").alias("source_line"), F.col("target").alias("sink_call")).distinct()
    if not compat:
        universe = universe.join(matched.select("fqn", "source_line", "sink_call").distinct(), ["fqn", "source_line", "sink_call"], "left_anti")
    return universe.withColumns({"confidence": F.lit(1.0), "match_method": F.lit("logic_not")})


def container_all_of(children: Sequence[DataFrame]) -> DataFrame:
    """The first condition's rows of the files for which every condition has rows."""
    return reduce(lambda a, b: a.join(b.select("file").distinct(), "file", "left_semi"), children)


def container_any_of(children: Sequence[DataFrame]) -> DataFrame:
    """All rows, repeated ones included."""
    return reduce(DataFrame.unionByName, children)


def container_none_of(children: Sequence[DataFrame]) -> DataFrame:
    """Again all rows: each hit of a forbidden condition is a violation."""
    return reduce(DataFrame.unionByName, children)


def merge_call_graphs(into: Mapping[str, DataFrame], other: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Two sets of tables as one: functions by fqn, those of ``other`` first; further tables appended, ``parameters`` kept as they are."""
    out = dict(into)
    for name, df in other.items():
        if name not in into:
            out[name] = df
        elif name == "functions":
            out[name] = df.unionByName(into[name].join(df.select("fqn").distinct(), "fqn", "left_anti").select(*df.columns))
        elif name != "parameters":
            out[name] = into[name].unionByName(df)
    return out


def function_index_delta(current: DataFrame, cached: DataFrame) -> DataFrame:
    """``(fqn, change)``: functions added since the cached index and those removed; one full join."""
    a, b = current.select("fqn").distinct().withColumn("_now", F.lit(1)), cached.select("fqn").distinct().withColumn("_then", F.lit(1))
    both = a.join(b, "fqn", "full")
    return both.where(F.col("_now").isNull() | F.col("_then").isNull()).select("fqn", F.when(F.col("_then").isNull(), "added").otherwise("removed").alias("change"))


def dedup_flow(flows: DataFrame) -> DataFrame:
    """One flow for each sink (fqn, line, call): local before global, then by the source's name, line and variable.

    An aggregation, not a window: a sink that holds a large share of all flows is combined before the shuffle.
    """
    keys = ("sink_fqn", "sink_line", "sink_call")
    rest = [c for c in flows.columns if c not in keys]
    order = F.struct(F.when(F.col("scope") == "local", 0).otherwise(1).alias("_rank"), "source_fqn", "source_line", "source_var")
    return flows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_f")).select(*keys, "_f.*").select(*flows.columns)
