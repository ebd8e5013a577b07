"""All core queries by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.plans import graph_queries, problems, report_queries, rule_queries

QUERIES = {**graph_queries.QUERIES, **report_queries.QUERIES, **rule_queries.QUERIES, **problems.QUERIES}
ORACLES = {**graph_queries.ORACLES, **report_queries.ORACLES, **rule_queries.ORACLES, **problems.ORACLES}

#: Columns that are decimals or wide integers in the SQL and doubles or longs here; (name, SQL).
_CASTS = {
    **dict.fromkeys(("typed_statement_scan", "logic_or", "logic_and", "logic_not", "join_line_proximity", "inter_taint"), {"confidence": "CAST(confidence AS DOUBLE)"}),
    **dict.fromkeys(("propagate_types", "resolve_chain", "confidence_model"), {"confidence": "round(CAST(confidence AS DOUBLE), 6)"}),
    "confidence_model": {"combined": "round(CAST(combined AS DOUBLE), 6)"},
    "def_use": {c: f"CAST({c} AS BIGINT)" for c in ("defs", "uses")},
    "def_use_stats": {c: f"CAST({c} AS BIGINT)" for c in ("total_defs", "total_uses", "max_defs", "max_uses")},
    "resolution_totals": {c: f"round(CAST({c} AS DOUBLE), 6)" for c in ("resolved_percent", "mean_confidence")},
    "diagnostic_metrics": {c: f"round(CAST({c} AS DOUBLE), 6)" for c in ("precision", "recall", "agreement", "f1")},
    "flow_compare": {c: f"round(CAST({c} AS DOUBLE), 6)" for c in ("precision", "recall")},
}
for _name, _columns in _CASTS.items():
    ORACLES[_name] = f"SELECT * REPLACE ({', '.join(f'{x} AS {c}' for c, x in _columns.items())}) FROM ({ORACLES[_name]})"


def _rounded(query, columns):
    """The query with its fractions rounded: sums of doubles depend on the order of their terms."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: F.round(F.col(c), 6) for c in columns})

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


for _name in ("propagate_types", "resolve_chain", "confidence_model", "resolution_totals", "diagnostic_metrics", "flow_compare"):
    QUERIES[_name] = _rounded(QUERIES[_name], list(_CASTS[_name]))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["call_matcher"](spark, sf_dir)
