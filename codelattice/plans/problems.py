"""The general data problems as queries: p1 (two copies of a data set) and p2 (nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions.callee import canonical_callee
from codelattice.operators.copydiff import Compared, diff_copies
from codelattice.operators.flatten import flatten_records
from codelattice.session import table

CALL_SITE_FIELDS = (Compared("callee_fqn", "callee_fqn", "our_fqn", canonical_callee), Compared("line", "line", "line"), Compared("col", "col", "col"))


def call_site_differences(spark: SparkSession, sf_dir: str, values: bool = False) -> DataFrame:
    return diff_copies(
        table(spark, sf_dir, "typechecker_records"), table(spark, sf_dir, "pathfinder_records"), "site_id", CALL_SITE_FIELDS,
        newest=("recorded_at", "ingested_at"), missing=("missing_typechecker", "missing_pathfinder"), values=values,
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_site_differences(spark, sf_dir)


def p1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many call sites differ, by kind of difference."""
    return call_site_differences(spark, sf_dir).groupBy("difference").agg(F.count("*").alias("sites"))


def registry_nodes(spark: SparkSession, sf_dir: str, attributes: bool = True) -> DataFrame:
    both = [table(spark, sf_dir, t).select("record_id", "payload") for t in ("stdlib_modules", "go_packages")]
    return flatten_records(both[0].unionByName(both[1]), "record_id", "payload", attributes=attributes)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_nodes(spark, sf_dir, attributes=False).select("record_id", "coll", "obj_path").distinct()


def p2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each flat table and how many of its rows name a parent."""
    nodes = registry_nodes(spark, sf_dir, attributes=False).distinct()
    return nodes.groupBy("schema_path").agg(F.count("*").alias("objects"), F.count_if(F.col("parent_dewey") != "").alias("below_objects"))


QUERIES = {"p1_found": p1_found, "p1_summary": p1_summary, "p2_found": p2_found, "p2_tables": p2_tables}

_NEWEST = """
  SELECT * FROM (SELECT site_id, {fqn} AS fqn, line, col,
    row_number() OVER (PARTITION BY site_id ORDER BY recorded_at DESC NULLS LAST, ingested_at DESC NULLS LAST,
      {fqn} DESC NULLS LAST, line DESC NULLS LAST, col DESC NULLS LAST) AS rn
    FROM {table} WHERE site_id IS NOT NULL) WHERE rn = 1"""

# Type arguments nest at most three deep in the data; the engine's own form has no such bound.
_CALLEE = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), "
    r"'^\s+|\s+$', '', 'g'), '\[[^\[\]]*\]', '', 'g'), '\[[^\[\]]*\]', '', 'g'), '\[[^\[\]]*\]', '', 'g'), '[()*&\s]+', '', 'g'), '^.*/vendor/', '')"
)

_P1 = f"""
WITH t AS ({_NEWEST.format(fqn='callee_fqn', table='typechecker_records')}),
     p AS ({_NEWEST.format(fqn='our_fqn', table='pathfinder_records')}),
     j AS (SELECT coalesce(t.site_id, p.site_id) AS site_id, t.site_id AS t_id, p.site_id AS p_id,
             {_CALLEE.format(x='t.fqn')} IS DISTINCT FROM {_CALLEE.format(x='p.fqn')} AS d_fqn,
             t.line IS DISTINCT FROM p.line AS d_line, t.col IS DISTINCT FROM p.col AS d_col
           FROM t FULL OUTER JOIN p ON t.site_id = p.site_id)
SELECT site_id, 'missing_typechecker' AS difference FROM j WHERE t_id IS NULL
UNION ALL SELECT site_id, 'missing_pathfinder' FROM j WHERE p_id IS NULL
UNION ALL SELECT site_id, 'callee_fqn' FROM j WHERE t_id IS NOT NULL AND p_id IS NOT NULL AND d_fqn
UNION ALL SELECT site_id, 'line' FROM j WHERE t_id IS NOT NULL AND p_id IS NOT NULL AND d_line
UNION ALL SELECT site_id, 'col' FROM j WHERE t_id IS NOT NULL AND p_id IS NOT NULL AND d_col
"""

ORACLES = {"p1_found": _P1, "p1_summary": f"SELECT difference, count(*) AS sites FROM ({_P1}) GROUP BY difference"}
