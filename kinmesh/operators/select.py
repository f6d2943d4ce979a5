"""Samples, largest groups, ids by first appearance and set operations, all deterministic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.operators.aggregate import hash_place
from kinmesh.operators.skew import skew_join
from kinmesh.session import stored


def _mark(key: str):
    return F.md5(F.col(key).cast("string"))


def hash_sample(df: DataFrame, key: str, n: int, *strata: str) -> DataFrame:
    """The ``n`` rows with the least hashes of ``key``, per stratum if any; the same rows on every run and in any engine."""
    if not strata:
        return df.orderBy(_mark(key), key).limit(n)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(_mark(key), key))).where(F.col("_r") <= n).drop("_r")


def share_sample(df: DataFrame, key: str, share: float) -> DataFrame:
    """The rows whose key's hash falls into the given share; needs no shuffle."""
    return df.where(hash_place(F.col(key).cast("string")) < int(share * (1 << 28)))


def stratified_sample(df: DataFrame, column: str, shares: dict, key: str) -> DataFrame:
    """The share of rows given for each value of a column, by the hash of ``key``; a share of n or more whole times gives each row n times and one more by hash."""
    want = F.coalesce(*[F.when(F.col(column) == v, F.lit(float(s))) for v, s in shares.items()], F.lit(0.0))
    more = hash_place(F.col(key).cast("string")) < ((want - F.floor(want)) * (1 << 28)).cast("long")
    copies = (F.floor(want) + more.cast("int")).cast("int")
    return df.withColumn("_c", copies).where("_c > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_c")))).drop("_c")


def pair_sample(df: DataFrame, key: str, per_row: int = 10, seed: int = 11) -> DataFrame:
    """Random pairs, ``per_row`` for each row, without a cross join: every row draws partners by number among all rows.

    The numbered rows are a stored stage, so each number stands for one row in both roles. Null keys and empty tables give no pairs.
    """
    placed = number_rows(df.select(key).where(F.col(key).isNotNull()).withColumn("_h", _mark(key)), ["_h", key], "i").select(key, "i")
    n = placed.count()
    draws = placed.select(F.col(key).alias("x"), F.explode(F.sequence(F.lit(1), F.lit(per_row))).alias("d"))
    draws = draws.select("x", (hash_place(F.concat_ws("/", F.col("x").cast("string"), F.col("d").cast("string"), F.lit(str(seed)))) % max(n, 1)).alias("i"))
    met = draws.join(placed, "i").where(F.col("x") != F.col(key))
    return met.select(F.least("x", key).alias(f"{key}_a"), F.greatest("x", key).alias(f"{key}_b")).distinct()


def top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` largest groups, ties to the smaller key, with the share of rows that they cover together."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("total"))
    top = counts.orderBy(F.desc("n_rows"), key).limit(n)
    covered = top.agg(F.sum("n_rows").alias("covered"))
    return top.join(F.broadcast(total)).join(F.broadcast(covered)).select(key, "n_rows", (F.col("covered") / F.col("total")).alias("coverage"))


def arg_max(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows per key in the given order, which should be total."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def sequential_ids(df: DataFrame, record: str, cluster: str, first: str = "after") -> DataFrame:
    """(record, cluster_id): clusters numbered by the first appearance of a record; records without one are clusters of their own.

    ``first``: ``after`` begins with the number of clusters, ``zero`` with 0. Heads are numbered by ``number_rows``, which stores
    them before it counts: no single task orders all clusters, and the ids are the same on every run. Hot clusters meet their number in a
    join that stays spread.
    """
    own = F.coalesce(F.concat(F.lit("c"), F.col(cluster).cast("string")), F.concat(F.lit("r"), F.col(record).cast("string")))
    rows = stored(df.select(record, own.alias("g")), "members")
    heads = rows.groupBy("g").agg(F.min(record).alias("head"))
    begin = rows.where(F.col("g").startswith("c")).select("g").distinct().count() if first == "after" else 0
    numbered = number_rows(heads, ["head", "g"], "cluster_id", begin).select("g", "cluster_id")
    return skew_join(rows, numbered, "g").select(record, "cluster_id")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def compare_maps(a: DataFrame, b: DataFrame, key: str, id_a: str, id_b: str) -> DataFrame:
    """(id_a, n_ids): ids of the first map whose keys have more than one id in the second."""
    return a.join(b, key).where(F.col(id_a).isNotNull() & F.col(id_b).isNotNull()).groupBy(id_a).agg(F.countDistinct(id_b).alias("n_ids")).where("n_ids > 1")


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Rows numbered from ``start`` in a total order, by counts per range: no single task sorts all rows."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    ranged = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "numbered")
    begins, at = {}, start
    for r in sorted(ranged.groupBy("_p").agg(F.count("*").alias("c")).collect(), key=lambda r: r["_p"]):
        begins[r["_p"]], at = at, at + r["c"]
    if not begins:
        return df.withColumn(name, F.lit(0).cast("long"))
    begin = F.element_at(F.create_map(*[F.lit(x) for kv in begins.items() for x in kv]), F.col("_p"))
    return ranged.withColumn(name, (begin + F.pmod("_i", F.lit(1 << 33))).cast("long")).drop("_p", "_i")


def sampled_blocks(blocks: DataFrame, keys: list[str], n: int) -> DataFrame:
    """All records of at most ``n`` blocks of several records, those with the least hashes."""
    several = blocks.groupBy(*keys).agg(F.count("*").alias("_c")).where("_c > 1").drop("_c")
    chosen = several.orderBy(F.md5(F.concat_ws("/", *keys)), *keys).limit(n)
    return blocks.join(chosen, keys, "left_semi")


def tail_slice(counts: DataFrame, n: str, key: str, least: int, share: float) -> DataFrame:
    """The end of a list ordered by count (most first, ties by key) that stops at count ``least``: the share of all rows of ``counts`` in length."""
    total = counts.count()
    size = -(-total * share // 1)
    return counts.where(F.col(n) >= least).orderBy(n, F.desc(key)).limit(int(size))
