"""Queries on heavy keys (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.operators import skew
from kinmesh.session import table

FIELDS = ("person_ctry_code", "hrm_l2_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that hold at least 5 % of all rows of leuven_name, as stored."""
    t = table(spark, sf_dir, "leuven_name").select(*FIELDS)
    parts = [skew.heavy_keys(t, f, skew.HEAVY_SHARE).select(F.lit(f).alias("key_field"), F.col("key").cast("string").alias("key_value")) for f in FIELDS]
    return parts[0].unionByName(parts[1])


def p6_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct names and distinct addresses of every key, salted where a key is heavy."""
    t = table(spark, sf_dir, "leuven_name").select(*FIELDS, "person_name", "person_address")
    parts = [
        skew.salted_stats(t, f, {"n_names": "person_name", "n_addresses": "person_address"}).select(
            F.lit(f).alias("key_field"), F.col("key").cast("string").alias("key_value"), "n_rows", "n_names", "n_addresses", "is_heavy"
        )
        for f in FIELDS
    ]
    return parts[0].unionByName(parts[1])


QUERIES = {"p6_found": p6_found, "p6_key_stats": p6_key_stats}

_STATS = """
  SELECT '{f}' AS key_field, CAST({f} AS VARCHAR) AS key_value, count(*) AS n_rows, count(DISTINCT person_name) AS n_names,
         count(DISTINCT person_address) AS n_addresses, count(*) >= 0.05 * (SELECT count(*) FROM leuven_name) AS is_heavy
  FROM leuven_name WHERE {f} IS NOT NULL GROUP BY {f}"""
_ALL = " UNION ALL ".join(_STATS.format(f=f) for f in FIELDS)
ORACLE = {"p6_found": f"SELECT key_field, key_value FROM ({_ALL}) WHERE is_heavy", "p6_key_stats": _ALL}
