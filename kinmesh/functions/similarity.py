"""Similarities and distances of names, sets and positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.functions.metaphone import double_metaphone
from kinmesh.operators.skew import dealt_join

EARTH_KM = 6371.0


def word_set(c: Column) -> Column:
    return F.array_distinct(F.split(c, " "))


def char_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared values by all values; 0 if both sets are empty, null if one is null."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_divide(shared, F.size(F.array_union(a, b))), F.lit(0.0)))


def word_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(word_set(a), word_set(b))


def char_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(char_set(a), char_set(b))


def lcs_length(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    mask = (1 << len(a)) - 1
    v = mask
    for ch in b:
        u = v & where.get(ch, 0)
        v = ((v + u) | (v - u)) & mask
    return len(a) - v.bit_count()


def lcs_lengths(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``lcs_length`` of the pairs (left[i], right[j]), all at once: a bit for each letter of the left text, which takes texts of at most 63; pairs of longer ones go one by one."""
    i, j = np.asarray(i, dtype=np.int64), np.asarray(j, dtype=np.int64)
    out = np.zeros(len(i), dtype=np.int64)
    la, lb = (np.fromiter(map(len, t), np.int64, len(t)) for t in (left, right))
    for k in np.flatnonzero(la[i] > 63):
        out[k] = lcs_length(right[j[k]], left[i[k]])
    fits = np.flatnonzero((la[i] <= 63) & (la[i] > 0) & (lb[j] > 0))
    if not len(fits):
        return out
    letters = lambda t: np.frombuffer("".join(t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    known, code = np.unique(np.concatenate([letters(left), letters(right)]), return_inverse=True)
    if len(left) * len(known) > 1 << 22 and len(i) > 1:  # a table of all letters would take much memory
        half = len(i) // 2
        parts = []
        for s in (slice(0, half), slice(half, None)):
            (u, x), (w, y) = np.unique(i[s], return_inverse=True), np.unique(j[s], return_inverse=True)
            parts.append(lcs_lengths([left[k] for k in u], [right[k] for k in w], x, y))
        return np.concatenate(parts)
    place = lambda n: (np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    width = len(known) + 1
    row, at = place(la)
    short = at < 63
    bits = np.zeros(len(left) * width, dtype=np.uint64)
    np.bitwise_or.at(bits, (row * width + code[: la.sum()] + 1)[short], np.uint64(1) << at[short].astype(np.uint64))
    row, at = place(lb)
    codes = np.zeros((int(lb.max()), len(right)), dtype=np.int64)  # 0 behind the end: no letter
    codes[at, row] = code[la.sum() :] + 1
    fits = fits[np.argsort(-lb[j[fits]], kind="stable")]
    base, other = i[fits] * width, j[fits]
    active = np.searchsorted(-lb[other], -np.arange(int(lb[other[0]])), side="left")
    full = (np.uint64(1) << la[i[fits]].astype(np.uint64)) - np.uint64(1)
    v = full.copy()
    for step, k in enumerate(active):
        w = v[:k]
        u = w & bits[base[:k] + codes[step][other[:k]]]
        v[:k] = (w + u) | (w - u)
    out[fits] = la[i[fits]] - np.bitwise_count(v & full)
    return out


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence by both lengths; 1 for two empty texts, null if one is null."""
    pairs: dict[tuple[str, str], int] = {}
    where = [-1 if x is None or y is None else pairs.setdefault((x, y) if len(x) <= len(y) else (y, x), len(pairs)) for x, y in zip(a, b)]
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    at = np.array([(left.setdefault(x, len(left)), right.setdefault(y, len(right)), len(x) + len(y)) for x, y in pairs], dtype=np.int64).reshape(-1, 3)
    both = at[:, 2]
    ratio = np.append(np.where(both > 0, 2 * lcs_lengths(list(left), list(right), at[:, 0], at[:, 1]) / np.maximum(both, 1), 1.0), np.nan)
    return pd.Series(ratio[where], dtype="float64")


def affine_gap(a: str, b: str, match: float = 1.0, differ: float = 11.0, gap: float = 10.0, go_on: float = 7.0) -> float:
    """Least cost of an alignment with affine gaps, by the number of letters; lower is nearer."""
    if not a or not b:
        return 0.5 * (match + differ) if a or b else match
    inf = float("inf")
    best, down = [0.0] + [gap + go_on * (j - 1) for j in range(1, len(b) + 1)], [inf] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row, right = [gap + go_on * (i - 1)], inf
        for j, y in enumerate(b, 1):
            right = min(right + go_on, row[-1] + gap)
            down[j] = min(down[j] + go_on, best[j] + gap)
            row.append(min(best[j - 1] + (match if x == y else differ), right, down[j]))
        best = row
    return best[-1] / (len(a) + len(b))


def affine_gaps(pairs: list[tuple[str, str]], match: float = 1.0, differ: float = 11.0, gap: float = 10.0, go_on: float = 7.0) -> np.ndarray:
    """``affine_gap`` of many pairs at once: pairs of about the same lengths go through one table together."""
    out = np.empty(len(pairs))
    sizes = np.array([(len(a), len(b)) for a, b in pairs], dtype=np.int64).reshape(-1, 2)
    for k in np.flatnonzero((sizes == 0).any(axis=1)):
        out[k] = affine_gap(*pairs[k], match, differ, gap, go_on)
    groups: dict[tuple[int, int], list[int]] = {}
    for k in np.flatnonzero((sizes > 0).all(axis=1)):
        groups.setdefault((-(-sizes[k, 0] // 8), -(-sizes[k, 1] // 8)), []).append(int(k))
    for members in groups.values():
        la, lb = sizes[members].max(axis=0)
        codes = lambda side, n: np.array([[ord(c) for c in pairs[k][side]] + [-1 - side] * (n - len(pairs[k][side])) for k in members], dtype=np.int32).T
        x, y = codes(0, la), codes(1, lb)
        best = np.repeat(np.concatenate([[0.0], gap + go_on * np.arange(lb)])[:, None], len(members), axis=1)
        down = np.full_like(best, np.inf)
        end_a, end_b = sizes[members, 0], sizes[members, 1]
        for i in range(1, la + 1):
            row, right = np.empty_like(best), np.full(len(members), np.inf)
            row[0] = gap + go_on * (i - 1)
            down = np.minimum(down + go_on, best + gap)
            step = best[:-1] + np.where(x[i - 1] == y, match, differ)
            for j in range(1, lb + 1):
                right = np.minimum(right + go_on, row[j - 1] + gap)
                row[j] = np.minimum(np.minimum(step[j - 1], right), down[j])
            best = row
            done = np.flatnonzero(end_a == i)
            out[np.array(members)[done]] = best[end_b[done], done] / (end_a[done] + end_b[done])
    return out


@F.pandas_udf(T.DoubleType())
def affine_gap_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Worked out once per distinct pair of a batch; null if one is null."""
    known = {p: k for k, p in enumerate({(x, y) for x, y in zip(a, b) if x is not None and y is not None})}
    got = affine_gaps(list(known))
    return pd.Series([None if x is None or y is None else got[known[x, y]] for x, y in zip(a, b)], dtype="float64")


def inverse_difference(a: Column, b: Column) -> Column:
    return 1.0 / (F.abs(a - b) + 1)


def inverse_max_idf(n: Column, a: Column, b: Column) -> Column:
    """log of the whole quotient of all records by the larger count."""
    return F.log(F.floor(n / F.greatest(a, b)))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km; null if a part is missing."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def phonetic_key(name: str, n: int = 4) -> str:
    """The primary Double Metaphone key of up to ``n`` letters."""
    return double_metaphone(name, n)


@F.pandas_udf(T.StringType())
def phonetic(s: pd.Series) -> pd.Series:
    done = {v: phonetic_key(v) for v in s.dropna().unique()}
    return s.map(done, na_action="ignore").astype(object).where(s.notna(), None)


def document_frequency(df: DataFrame, values: str) -> DataFrame:
    """(value, df, idf) of the values of a set column."""
    n = df.where(F.col(values).isNotNull()).agg(F.count("*").alias("n"))
    freq = df.select(F.explode(F.array_distinct(values)).alias("value")).groupBy("value").agg(F.count("*").alias("df"))
    return freq.join(F.broadcast(n)).select("value", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def set_cosine(pairs: DataFrame, sets: DataFrame, key: str, values: str) -> DataFrame:
    """(key_a, key_b, cosine) of the given pairs: sets as vectors of inverse document frequencies; 0 where nothing is shared."""
    idf = document_frequency(sets, values).select("value", "idf")
    vec = sets.select(F.col(key).alias("k"), F.explode(F.array_distinct(values)).alias("value")).join(idf, "value")
    norm = vec.groupBy("k").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    a, b = f"{key}_a", f"{key}_b"
    dot = (
        pairs.select(a, b).join(vec.select(F.col("k").alias(a), "value", "idf"), a).join(vec.select(F.col("k").alias(b), "value"), [b, "value"])
        .groupBy(a, b).agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"))
    )
    out = pairs.select(a, b).join(dot, [a, b], "left").join(norm.toDF(a, "na"), a, "left").join(norm.toDF(b, "nb"), b, "left")
    return out.select(a, b, F.coalesce(F.try_divide("dot", F.col("na") * F.col("nb")), F.lit(0.0)).alias("cosine"))


def similar_sets(a: DataFrame, b: DataFrame, values_a: str, values_b: str, threshold: float) -> DataFrame:
    """All pairs of rows of two frames whose sets of values have a Jaccard similarity of at least ``threshold``, with the columns of both.

    Exact prefix filter: values are ordered from rare to common over both sides; sets that similar share one of their first
    n - ceil(threshold * n) + 1 values, which leaves out the common ones without losing a pair. No cap; hot values are
    dealt into parts. Repeated rows count once. Column names must not clash; empty sets pair with nothing.
    """
    counts = a.select(F.explode(values_a).alias("v")).unionByName(b.select(F.explode(values_b).alias("v"))).groupBy("v").agg(F.count("*").alias("_df"))

    def keyed(t: DataFrame, values: str, tag: str) -> DataFrame:
        rows = t.distinct().withColumn(f"_r{tag}", F.xxhash64(*t.columns))
        long = rows.select(f"_r{tag}", F.size(values).alias("_n"), F.explode(values).alias("v")).join(counts.hint("merge"), "v")
        place = F.row_number().over(Window.partitionBy(f"_r{tag}").orderBy("_df", "v"))
        return rows, long.withColumn("_k", place).where(F.col("_k") <= F.col("_n") - F.ceil(F.col("_n") * threshold - 1e-9) + 1).select("v", f"_r{tag}")

    (rows_a, left), (rows_b, right) = keyed(a, values_a, "a"), keyed(b, values_b, "b")
    met = dealt_join(left, right, ["v"]).select("_ra", "_rb").distinct()
    both = met.join(rows_a.hint("merge"), "_ra").join(rows_b.hint("merge"), "_rb")
    return both.where(set_jaccard(F.col(values_a), F.col(values_b)) >= threshold - 1e-9).drop("_ra", "_rb")


def near_cosine(sets: DataFrame, key: str, values: str, threshold: float) -> DataFrame:
    """(key_a, key_b, cosine) of all pairs of records whose sets, as vectors of inverse document frequencies, have a cosine of at least ``threshold``.

    Exact prefix filter: values are ordered from rare to common; the common end of a vector whose length is under the threshold
    cannot bring a pair there, so pairs meet at the values before it only. No cap on a value's holders; hot ones are dealt into parts.
    """
    long = sets.select(F.col(key).alias("r"), F.explode(F.array_distinct(values)).alias("v"))
    w = long.join(document_frequency(sets, values).select(F.col("value").alias("v"), "df", "idf").hint("merge"), "v")
    own = Window.partitionBy("r")
    w = w.withColumn("all", F.sum(F.col("idf") * F.col("idf")).over(own)).withColumn("before", F.coalesce(F.sum(F.col("idf") * F.col("idf")).over(own.orderBy("df", "v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    keyed = w.where((F.col("all") > 0) & (F.col("all") - F.col("before") >= (threshold * threshold - 1e-9) * F.col("all"))).select("v", "r")
    a, b = f"{key}_a", f"{key}_b"
    met = dealt_join(keyed.select("v", F.col("r").alias(a)), keyed.select("v", F.col("r").alias(b)), ["v"]).where(F.col(a) < F.col(b)).select(a, b).distinct()
    vec = w.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("v", "idf"))).alias("m"), F.sqrt(F.max("all")).alias("norm"))
    both = met.join(vec.toDF(a, "ma", "na").hint("merge"), a).join(vec.toDF(b, "mb", "nb").hint("merge"), b)
    shared = F.array_intersect(F.map_keys("ma"), F.map_keys("mb"))
    dot = F.aggregate(shared, F.lit(0.0), lambda acc, v: acc + F.pow(F.col("ma")[v], F.lit(2.0)))
    return both.select(a, b, (dot / (F.col("na") * F.col("nb"))).alias("cosine")).where(F.col("cosine") >= threshold - 1e-6)


def best_in_list(values: DataFrame, choices: DataFrame, value: str, choice: str, threshold: float) -> DataFrame:
    """(value, choice, score): the choice whose set of letters is likest, if likeness exceeds ``threshold``; ties go to the last choice in order. Both must be distinct; candidates share the first letter."""
    first = lambda df, c: df.withColumn("_k", F.substring(c, 1, 1))
    scored = first(values, value).join(first(choices, choice), "_k").withColumn("score", char_jaccard(F.col(value), F.col(choice))).where(F.col("score") > threshold)
    best = scored.groupBy(value).agg(F.max(F.struct("score", choice)).alias("m"))
    return best.select(value, F.col(f"m.{choice}").alias(choice), F.col("m.score").alias("score"))
