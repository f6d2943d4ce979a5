"""Per-key work when a handful of keys hold most rows.

Heavy keys are those with at least ``share`` of all rows, so there are at most ``1 / share`` of them: a proven bound for
what is broadcast here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of all rows from which a key is heavy, and the number of salts its rows are spread over.
HEAVY_SHARE, SALTS = 0.05, 32


def key_counts(df: DataFrame, key: str | Column, salts: int = SALTS) -> DataFrame:
    """(key, n_rows) by two stages: partial counts per (key, salt), then merged by key. Null keys are left out.

    The salt is random and seeded; the partial counts are combined on the map side before either shuffle. An empty
    table gives no rows.
    """
    k = F.col(key) if isinstance(key, str) else key
    part = df.select(k.alias("key"), (F.rand(17) * salts).cast("int").alias("salt")).where("key IS NOT NULL").groupBy("key", "salt").agg(F.count("*").alias("n"))
    return part.groupBy("key").agg(F.sum("n").alias("n_rows"))


def heavy_keys(df: DataFrame, key: str | Column, share: float = HEAVY_SHARE) -> DataFrame:
    """(key, n_rows) of the keys that hold at least ``share`` of all rows of ``df``, rows with a null key counted in the whole."""
    total = df.agg(F.count("*").alias("total"))
    return key_counts(df, key).join(F.broadcast(total)).where(F.col("n_rows") >= F.lit(share) * F.col("total")).select("key", "n_rows")


def salted_stats(df: DataFrame, key: str, distinct: dict[str, str], share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """One row per non-null key: key, n_rows, a count of distinct non-null values for each name in ``distinct`` (name -> column), is_heavy.

    Rows of heavy keys get a random salt, those of other keys salt 0; row counts are partial per (key, salt), then merged.
    For distinct values the salt is a hash of the value, so that each value falls into one salt and partial distinct
    counts add up. Ties and repeated rows count as rows. Extra columns don't matter: only the named ones are read.
    """
    cols = {"__key": F.col(key)} | {f"__v{i}": F.col(c) for i, c in enumerate(distinct.values())}
    base = df.select(*[c.alias(n) for n, c in cols.items()]).where("__key IS NOT NULL")
    heavy = heavy_keys(df, key, share).select(F.col("key").alias("__h"))
    marked = base.join(F.broadcast(heavy), base["__key"] == heavy["__h"], "left")
    is_heavy = F.col("__h").isNotNull()

    def salt(by: Column) -> Column:
        return F.when(is_heavy, by).otherwise(F.lit(0))

    parts = [
        marked.select("__key", salt((F.rand(23) * salts).cast("int")).alias("salt"), F.lit(-1).alias("m")).groupBy("__key", "salt", "m").agg(F.count("*").alias("n"))
    ]
    for i in range(len(distinct)):
        v = f"__v{i}"
        parts.append(
            marked.where(F.col(v).isNotNull())
            .select("__key", salt(F.pmod(F.xxhash64(v), F.lit(salts)).cast("int")).alias("salt"), F.col(v).alias("v"))
            .groupBy("__key", "salt", "v").agg(F.lit(1).alias("one"))
            .groupBy("__key", "salt").agg(F.count("*").alias("n"))
            .select("__key", "salt", F.lit(i).alias("m"), "n")
        )
    merged = reduce(DataFrame.unionByName, parts).groupBy("__key").agg(
        F.sum(F.when(F.col("m") == -1, F.col("n"))).alias("n_rows"),
        *[F.coalesce(F.sum(F.when(F.col("m") == i, F.col("n"))), F.lit(0)).alias(n) for i, n in enumerate(distinct)],
    )
    flags = heavy.select(F.col("__h").alias("__key"), F.lit(True).alias("is_heavy"))
    return merged.join(F.broadcast(flags), "__key", "left").select(F.col("__key").alias("key"), "n_rows", *distinct, F.coalesce("is_heavy", F.lit(False)).alias("is_heavy"))


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = 0.01, least: int = 20_000) -> DataFrame:
    """Equi-join of ``left`` with ``right`` (unique in ``key``) that stays spread when a key holds a third of ``left``.

    Left keys with at least ``share`` of the rows, and at least ``least`` rows, are heavy: at most ``1 / share`` keys,
    whose right rows are broadcast; all other rows meet in an ordinary shuffled join. The heavy keys are looked up at once,
    so ``left`` should be a scan or a stored stage. ``how``: inner or left. Null keys never match.
    """
    counted = key_counts(left, key)
    total = counted.agg(F.sum("n_rows").alias("total"))
    frequent = counted.where(F.col("n_rows") >= least).join(F.broadcast(total)).where(F.col("n_rows") >= F.lit(share) * F.col("total"))
    hot = [r[0] for r in frequent.select("key").collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how).unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], part: int = 1000) -> DataFrame:
    """Equi-join by shuffle of two sides with repeated keys, spread where a key has many rows on the right.

    The right rows of a key are dealt into parts of about ``part`` rows, and its left rows are repeated in each, so that no task
    holds all pairs of a key. Neither side is broadcast. Null keys never match; extra columns must not clash.
    """
    sizes = right.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("_parts"))
    mark = F.xxhash64(*[c for c in right.columns if c not in keys]) if len(right.columns) > len(keys) else F.lit(0)
    b = right.join(sizes.hint("merge"), keys).withColumn("_part", F.pmod(mark, F.col("_parts")).cast("int")).drop("_parts")
    a = left.join(sizes.hint("merge"), keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return a.hint("merge").join(b, [*keys, "_part"]).drop("_part")
