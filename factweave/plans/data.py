"""Queries of the general data problems: heavy keys and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.eager import heavy_keys, key_report
from ..operators.units import unread_quantities
from ..session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "facts"), table(spark, d, "documents")).select("comparison_key")


def p4_key_report(spark: SparkSession, d: str) -> DataFrame:
    return key_report(table(spark, d, "facts"), table(spark, d, "documents"), "comparison_key")


def p4_predicate_report(spark: SparkSession, d: str) -> DataFrame:
    return key_report(table(spark, d, "facts"), table(spark, d, "documents"), "predicate_canonical")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return unread_quantities(table(spark, d, "facts"), table(spark, d, "common_units"))


QUERIES = {f.__name__: f for f in (p4_found, p4_key_report, p4_predicate_report, p6_found)}

_REPORT = """
    SELECT f.{key} AS {key}, count(*) AS n_deliveries, count(DISTINCT f.fact_id) AS n_facts, count(DISTINCT f.doc_id) AS n_documents,
           min(f.value_normalized) AS lowest, max(f.value_normalized) AS highest, max(f.created_at) AS latest, CAST(sum(d.n_chars) AS BIGINT) AS n_chars
    FROM facts f LEFT JOIN documents d ON d.doc_id = f.doc_id GROUP BY f.{key}"""

SQL = {
    "p4_found": "SELECT comparison_key FROM facts WHERE comparison_key IS NOT NULL GROUP BY comparison_key HAVING count(*) >= 0.02 * (SELECT count(*) FROM facts)",
    "p4_key_report": _REPORT.format(key="comparison_key"),
    "p4_predicate_report": _REPORT.format(key="predicate_canonical"),
}
