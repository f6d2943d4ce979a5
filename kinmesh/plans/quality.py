"""Quality of partitions: the hand-matched groups of the register against machine-made names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.operators import evaluate
from kinmesh.plans.relational import leuven
from kinmesh.session import table

B = "b AS (SELECT DISTINCT person_id, htm_l1 AS cluster_id, hrm_l2_id AS ref_id, hrm_level FROM leuven_name WHERE htm_l1 IS NOT NULL AND hrm_l2_id IS NOT NULL)"


def base(spark: SparkSession, d: str) -> DataFrame:
    return leuven(spark, d).where("htm_l1 IS NOT NULL AND hrm_l2_id IS NOT NULL").select("person_id", F.col("htm_l1").alias("cluster_id"), F.col("hrm_l2_id").alias("ref_id"), "hrm_level").distinct()


def patents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "patstat_dedupe_input").where("Person IS NOT NULL").groupBy(F.col("Person").alias("person_id")).agg(F.sum("patent_ct").alias("patents"))


def precision_recall_ids(spark, d):
    """Level 2 of the hand-matched ids only."""
    return evaluate.precision_recall(base(spark, d).where("hrm_level = 2"), "cluster_id", "ref_id")


def precision_recall_patents(spark, d):
    """All levels, weighted by patents."""
    return evaluate.precision_recall(base(spark, d).join(patents(spark, d), "person_id"), "cluster_id", "ref_id", "patents")


def pairwise_metric(spark, d):
    return evaluate.pairwise(base(spark, d).where("hrm_level = 2"), "cluster_id", "ref_id")


def id_reduction(spark, d):
    return evaluate.id_reduction(base(spark, d), "person_id", "cluster_id")


def worst_case_groups(spark, d):
    return evaluate.worst_groups(base(spark, d), "ref_id", "cluster_id")


def canonical_counts(spark, d):
    return evaluate.canonical_pairs(base(spark, d), "cluster_id", "ref_id")


def patent_correlations(spark, d):
    """Patents per canonical pair: by reference and by cluster."""
    rows = base(spark, d).join(patents(spark, d), "person_id")
    pairs = evaluate.canonical_pairs(rows, "cluster_id", "ref_id").select("ref_id", "cluster_id")
    a = rows.groupBy("ref_id").agg(F.sum("patents").cast("double").alias("a"))
    b = rows.groupBy("cluster_id").agg(F.sum("patents").cast("double").alias("b"))
    out = evaluate.correlations(pairs.join(a, "ref_id").join(b, "cluster_id").where("a IS NOT NULL AND b IS NOT NULL"), "a", "b")
    return out.select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


QUERIES = {f.__name__: f for f in (precision_recall_ids, precision_recall_patents, pairwise_metric, id_reduction, worst_case_groups, canonical_counts, patent_correlations)}

_PT = "pt AS (SELECT Person AS person_id, sum(patent_ct) AS patents FROM patstat_dedupe_input WHERE Person IS NOT NULL GROUP BY ALL)"
_CELLS = "SELECT (SELECT sum(m) FROM (SELECT max(n) AS m FROM cells GROUP BY cluster_id)) / sum(n) AS precision, (SELECT sum(m) FROM (SELECT max(n) AS m FROM cells GROUP BY ref_id)) / sum(n) AS recall FROM cells"
_CANON = """cells AS (SELECT ref_id, cluster_id, count(*) AS n_pair FROM rows_ GROUP BY ALL),
  t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY n_pair DESC, cluster_id) AS k FROM cells) WHERE k = 1),
  u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n_pair DESC, ref_id) AS k2 FROM t) WHERE k2 = 1)"""
ORACLE = {
    "precision_recall_ids": f"WITH {B}, cells AS (SELECT cluster_id, ref_id, count(*) AS n FROM b WHERE hrm_level = 2 GROUP BY ALL) {_CELLS}",
    "precision_recall_patents": f"WITH {B}, {_PT}, cells AS (SELECT cluster_id, ref_id, sum(patents) AS n FROM b JOIN pt USING (person_id) GROUP BY ALL) {_CELLS}",
    "pairwise_metric": f"""WITH {B}, cells AS (SELECT cluster_id, ref_id, count(*) AS n FROM b WHERE hrm_level = 2 GROUP BY ALL), c AS (SELECT sum(n) AS n FROM cells GROUP BY cluster_id), r AS (SELECT sum(n) AS n FROM cells GROUP BY ref_id)
      SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) / (SELECT sum(n * (n - 1) / 2) FROM c) AS pair_precision, (SELECT sum(n * (n - 1) / 2) FROM cells) / (SELECT sum(n * (n - 1) / 2) FROM r) AS pair_recall""",
    "id_reduction": f"WITH {B} SELECT 1 - count(DISTINCT cluster_id) / count(DISTINCT person_id) AS reduction FROM b",
    "worst_case_groups": f"WITH {B} SELECT ref_id, count(DISTINCT cluster_id) AS n_others FROM b GROUP BY ref_id ORDER BY n_others DESC, ref_id LIMIT 5",
    "canonical_counts": f"""WITH {B}, rows_ AS (SELECT * FROM b), {_CANON}, r AS (SELECT ref_id, count(*) AS n_ref FROM b GROUP BY ALL), c AS (SELECT cluster_id, count(*) AS n_cluster FROM b GROUP BY ALL)
      SELECT ref_id, cluster_id, n_pair, n_ref, n_cluster, n_cluster / n_ref AS ratio FROM u JOIN r USING (ref_id) JOIN c USING (cluster_id)""",
    "patent_correlations": f"""WITH {B}, {_PT}, rows_ AS (SELECT * FROM b JOIN pt USING (person_id)), {_CANON}, r AS (SELECT ref_id, sum(patents) AS a FROM rows_ GROUP BY ALL), c AS (SELECT cluster_id, sum(patents) AS bb FROM rows_ GROUP BY ALL),
      j AS (SELECT CAST(a AS DOUBLE) AS a, CAST(bb AS DOUBLE) AS b FROM u JOIN r USING (ref_id) JOIN c USING (cluster_id) WHERE a IS NOT NULL AND bb IS NOT NULL),
      k AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM j)
      SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM k""",
}
