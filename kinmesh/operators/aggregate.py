"""Consolidation and summary aggregates with defined ties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_place(text: Column) -> Column:
    """A whole number from 0 to 2^28 - 1 from the first hexadecimal digits of a text's MD5: the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def mode_by(df: DataFrame, keys: list[str], value: str | Column, name: str) -> DataFrame:
    """The most frequent non-null value per key, ties to the least value. Counts are combined before the shuffle, so hot keys stay cheap."""
    v = F.col(value) if isinstance(value, str) else value
    counts = df.select(*keys, v.alias("v")).where("v IS NOT NULL").groupBy(*keys, "v").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct(-F.col("n"), F.col("v"))).alias("m")).select(*keys, F.col("m.v").alias(name))


def mode_of_pair(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """The most frequent pair whose parts are both present and not zero; (0.0, 0.0) for keys without one."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (F.col(a) != 0) & (F.col(b) != 0)
    best = mode_by(df.where(ok), keys, F.struct(a, b), "pair")
    return df.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce(f"pair.{a}", F.lit(0.0)).alias(a), F.coalesce(f"pair.{b}", F.lit(0.0)).alias(b))


def set_union(df: DataFrame, keys: list[str], values: Column, name: str, cap: int | None = 100) -> DataFrame:
    """The distinct values per key, sorted, at most the ``cap`` least ones, all if it is None. Values are distinct before they are gathered, and only ``cap`` per key are."""
    long = df.select(*keys, F.explode(values).alias("v")).where("v IS NOT NULL").distinct()
    if cap is not None:
        long = long.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("v"))).where(F.col("r") <= cap)
    return long.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias(name))


def first_concat(df: DataFrame, keys: list[str], value: str, name: str, most: int = 9, sep: str = "**") -> DataFrame:
    """The first ``most`` distinct values per key in order, joined."""
    distinct = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    ranked = distinct.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("r") <= most)
    return ranked.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), sep).alias(name))


def concat_all(df: DataFrame, keys: list[str], value: str, name: str, sep: str = "**") -> DataFrame:
    """All values per key, repeated ones included, sorted and joined."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), sep).alias(name))


def capped_less_one(values: Column, cap: int = 10) -> Column:
    """The first values of a list, one fewer than its size or ``cap``."""
    return F.slice(values, 1, F.greatest(F.least(F.size(values), F.lit(cap)) - 1, F.lit(0)))


def consolidate(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """One row per key; ``columns``: column -> mode, set, sum, max, min, count or mean."""
    plain = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "mean": F.avg}
    parts = [df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[plain[how](c).alias(c) for c, how in columns.items() if how in plain])]
    parts += [mode_by(df, keys, c, c) for c, how in columns.items() if how == "mode"]
    parts += [set_union(df, keys, F.col(c), c) for c, how in columns.items() if how == "set"]
    return reduce(lambda a, b: a.join(b, keys, "left"), parts)


def summary(df: DataFrame, value: str) -> DataFrame:
    """max, min, mean and median of a column, one row."""
    return df.agg(F.max(value).alias("max_value"), F.min(value).alias("min_value"), F.avg(value).alias("mean_value"), F.median(value).alias("median_value"))


def map_cardinality(df: DataFrame, a: str, b: str) -> DataFrame:
    """How many distinct values of one id stand against each value of the other: direction, max, min, mean, median."""
    pairs = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    parts = [summary(pairs.groupBy(k).agg(F.count("*").alias("n")), "n").withColumn("direction", F.lit(f"{o} per {k}")) for k, o in ((a, b), (b, a))]
    return parts[0].unionByName(parts[1])


def fractional_counts(df: DataFrame, unit: str, person: str, *groups: str) -> DataFrame:
    """Each unit counts once, shared among its persons: the sum of shares per group."""
    rows = df.select(unit, person, *groups).distinct()
    size = rows.select(unit, person).distinct().groupBy(unit).agg(F.count("*").alias("persons"))
    return rows.join(size, unit).groupBy(*groups).agg(F.sum(1 / F.col("persons")).alias("share"))


def counters(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Multiset sum, difference, union and intersection: counts per value."""
    both = a.groupBy(value).agg(F.count("*").alias("na")).join(b.groupBy(value).agg(F.count("*").alias("nb")), value, "full").na.fill(0, ["na", "nb"])
    na, nb = F.col("na"), F.col("nb")
    return both.select(value, (na + nb).alias("n_sum"), F.greatest(na - nb, F.lit(0)).alias("n_minus"), F.greatest(na, nb).alias("n_union"), F.least(na, nb).alias("n_both"))


def bootstrap_mean(df: DataFrame, value: str, top: int = 100, draws: int = 1000, seed: int = 7) -> DataFrame:
    """(mean, low, high): mean and 95 % interval of ``draws`` resamples of the ``top`` largest values, drawn by hash, so the same on every run."""
    best = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).orderBy(F.desc("v")).limit(top)
    held = best.agg(F.sort_array(F.collect_list("v"), asc=False).alias("vs")).where(F.size("vs") > 0)
    spread = df.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(held))
    pick = lambda i: F.element_at("vs", (hash_place(F.concat_ws("/", F.lit(str(seed)), F.col("draw").cast("string"), i.cast("string"))) % F.size("vs") + 1).cast("int"))
    mean = F.aggregate(F.sequence(F.lit(1), F.size("vs")), F.lit(0.0), lambda acc, i: acc + pick(i)) / F.size("vs")
    return spread.select(mean.alias("m")).agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def first_value(df: DataFrame, keys: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """The first non-null value per key in a total order of rows."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(F.struct(*order, value)).alias("m")).select(*keys, F.col(f"m.{value}").alias(name))


def share_of_total(df: DataFrame, key: str, amount: str) -> DataFrame:
    """(key, amount, share, max_share): each key's part of the whole, and the largest part."""
    sums = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(amount).alias(amount))
    total = sums.agg(F.sum(amount).alias("_t"), F.max(amount).alias("_m"))
    return sums.join(F.broadcast(total)).select(key, amount, (F.col(amount) / F.col("_t")).alias("share"), (F.col("_m") / F.col("_t")).alias("max_share"))


def max_over(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the largest value of each column, and of all of them together (``overall``)."""
    return df.agg(*[F.max(c).alias(c) for c in columns], F.max(F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])).alias("overall"))


def in_chunks(df: DataFrame, size: int, f, schema: str) -> DataFrame:
    """Hands a table to a function of pandas frames in chunks of at most ``size`` rows; chunks stay within their partition."""

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), size):
                yield f(pdf.iloc[a : a + size])

    return df.mapInPandas(run, schema)


def others(df: DataFrame, unit: str, person: str, name: str, most: int) -> DataFrame:
    """(unit, person, others): the first ``most`` distinct names, in order, of the other persons of each unit.

    Of a unit only the first ``most`` + 1 names, with two persons each, are gathered: whoever is left out of these has
    enough of them, so a unit of many persons gives a short list and each row meets that list only.
    """
    holders = df.select(unit, person, name).distinct().groupBy(unit, name).agg(F.min(person).alias("_a"), F.max(person).alias("_b"))
    first = holders.withColumn("_k", F.row_number().over(Window.partitionBy(unit).orderBy(name))).where(F.col("_k") <= most + 1)
    lists = first.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(name, "_a", "_b"))).alias("_m"))
    rest = F.filter("_m", lambda x: (x["_a"] != F.col(person)) | (x["_b"] != F.col(person)))
    return df.select(unit, person).distinct().join(lists, unit).select(unit, person, F.slice(F.transform(rest, lambda x: x[name]), 1, most).alias("others"))
