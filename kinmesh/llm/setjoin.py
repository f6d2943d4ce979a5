"""All pairs of similar sets by metric pivot partitioning under the Jaccard distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.operators.skew import dealt_join, skew_join
from kinmesh.session import stored

#: Similarity in tenths (7/10) and the radius within which a record takes a sampled pivot as its home.
TENTHS, RADIUS = 7, 0.15
#: Rows of a cell or of a class of equal sets that meet in one task.
PART = 1000


def value_sets(df: DataFrame, key: str, values: str, least: int, *keep: str) -> DataFrame:
    """(key, *keep, set): values without case and outer white space, null and blank ones left out, each once; rows with fewer than ``least`` values are dropped."""
    clean = F.transform(F.col(values), lambda v: F.lower(F.regexp_replace(v, r"^\s+|\s+$", "")))
    kept = F.array_sort(F.array_distinct(F.filter(clean, lambda v: v.isNotNull() & (v != ""))))
    return df.select(key, *keep, kept.alias("set")).where(F.size("set") >= least)


def _signatures(ids: Column, similarity: float) -> Column:
    """Hashes of the pairs of values of a prefix that two sets of that similarity must share; ``ids`` is ordered from rare to common."""
    n = F.size(ids)
    need = F.greatest(F.ceil(n * F.lit(similarity) - F.lit(1e-9)).cast("int"), F.lit(1))
    prefix = F.slice(ids, 1, F.least(n - need + 2, n))
    pairs = F.flatten(F.transform(prefix, lambda a, i: F.transform(F.slice(prefix, i + 2, n), lambda b: F.xxhash64(a, b))))
    # A pair of sets that need share but one value (need = 1) has no common pair of values to meet at.
    return F.when(need >= 2, pairs).otherwise(F.transform(ids, lambda a: F.xxhash64(a)))


def _distances(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """(sid, pid, d) of all records of ``left`` and ``right`` within the Jaccard distance ``most`` < 1, found by the pairs of rare values that such sets share."""
    sim = 1 - most
    a = left.select("sid", F.size("ids").alias("n"), F.explode(_signatures(F.col("ids"), sim)).alias("k"))
    b = right.select(F.col("sid").alias("pid"), F.size("ids").alias("m"), F.explode(_signatures(F.col("ids"), sim)).alias("k"))
    near = F.least("n", "m") >= F.lit(sim) * F.greatest("n", "m") - 1e-9
    cand = dealt_join(a, b, ["k"]).where(near).select("sid", "pid").distinct()
    both = cand.join(left.select("sid", "ids").hint("merge"), "sid").join(right.select(F.col("sid").alias("pid"), F.col("ids").alias("pids")).hint("merge"), "pid")
    shared = F.size(F.array_intersect("ids", "pids"))
    d = 1 - shared / (F.size("ids") + F.size("pids") - shared)
    return both.select("sid", "pid", d.alias("d")).where(F.col("d") <= most + 1e-9)


def cells_of(classes: DataFrame, tenths: int = TENTHS, radius: float = RADIUS) -> DataFrame:
    """(pid, sid, ids, d, home): the cells of the pivots, each with its own members (home) and the copies that the bounds leave.

    1. Sets that share no pair of rare values with any other (counted, not joined) are similar to nothing and drop out.
    2. Pivots: of the sets with the same two rarest values, the one with the least hash. A record's home is its nearest
       pivot within ``radius``; records without one are pivots of their own, with radius 0.
    3. With e = 1 - similarity, a record can only be similar to a member of a pivot's cell if its distance to the pivot is
       at most e more than the cell's radius (the largest distance of a home member). It is copied to these cells only.
    """
    sim, eps = tenths / 10, 1 - tenths / 10
    long = stored(classes.select("sid", F.explode("set").alias("v")).select("sid", F.xxhash64("v").alias("h")), "values")
    freq = long.groupBy("h").agg(F.count("*").alias("df"))
    ids = skew_join(long, freq, "h").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("o"))
    every = stored(ids.select("sid", F.col("o.h").alias("ids")), "sets")
    marks = every.select("sid", F.explode(_signatures(F.col("ids"), sim)).alias("k"))
    met = marks.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    sets = stored(every.join(marks.join(met.hint("merge"), "k", "left_semi").select("sid").distinct().hint("merge"), "sid"), "sociable")

    lead = F.xxhash64(F.col("ids")[0], F.get("ids", F.lit(1)))
    first = sets.groupBy(lead.alias("lead")).agg(F.min_by("sid", F.struct(F.xxhash64("sid"), "sid")).alias("sid")).select("sid")
    pivots = stored(sets.join(first.hint("merge"), "sid"), "pivots")
    near = stored(_distances(sets, pivots, radius + eps), "near")
    homes = near.where(F.col("d") <= radius + 1e-9).groupBy("sid").agg(F.min(F.struct("d", "pid")).alias("m")).select("sid", "m.pid", "m.d")
    homes = stored(homes, "homes")
    radii = homes.groupBy("pid").agg(F.max("d").alias("r"))
    lone = sets.join(homes.hint("merge"), "sid", "left_anti")
    copies = near.join(radii.hint("merge"), "pid").where(F.col("d") <= F.col("r") + eps + 1e-9).select("sid", "pid", "d")
    copies = copies.unionByName(_distances(sets, lone, eps))
    members = homes.select("sid", "pid", "d").unionByName(lone.select("sid", F.col("sid").alias("pid"), F.lit(0.0).alias("d")))
    cells = copies.withColumn("home", F.lit(False)).unionByName(members.withColumn("home", F.lit(True))).groupBy("sid", "pid").agg(F.max("home").alias("home"), F.min("d").alias("d"))
    crowded = cells.groupBy("pid").agg(F.count("*").alias("c")).where("c > 1").select("pid")
    return stored(cells.join(crowded.hint("merge"), "pid").join(sets.hint("merge"), "sid").select("pid", "sid", "ids", "d", "home"), "cells")


def similar_classes(classes: DataFrame, tenths: int = TENTHS, radius: float = RADIUS) -> DataFrame:
    """(sid_a, sid_b) with sid_a < sid_b of all pairs of different sets whose Jaccard similarity is at least ``tenths`` / 10.

    ``classes``: (sid, set), every set once, no set empty. Cells of pivots (``cells_of``) are joined exactly: two records of
    a cell are compared unless the triangle inequality already keeps them apart (their distances to the pivot differ by
    more than one minus the similarity). A pair is taken from the home cell of its smaller id, so it comes out once. Large
    cells are dealt into parts; no cap on partners, cells or values.
    """
    eps = 1 - tenths / 10
    cells = cells_of(classes, tenths, radius)
    a = cells.where("home").select("pid", F.col("sid").alias("sid_a"), F.col("ids").alias("ids_a"), F.col("d").alias("da"))
    b = cells.select("pid", F.col("sid").alias("sid_b"), F.col("ids").alias("ids_b"), F.col("d").alias("db"))
    near = (F.abs(F.col("da") - F.col("db")) <= eps + 1e-9) & (F.least(F.size("ids_a"), F.size("ids_b")) * 10 >= F.greatest(F.size("ids_a"), F.size("ids_b")) * tenths)
    met = dealt_join(a, b, ["pid"], PART).where(F.col("sid_a") < F.col("sid_b")).where(near)
    shared = F.size(F.array_intersect("ids_a", "ids_b"))
    return met.where(shared * 10 >= (F.size("ids_a") + F.size("ids_b") - shared) * tenths).select("sid_a", "sid_b")


def _grouped(df: DataFrame, key: str, values: str, owner: str, least: int, tenths: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members of classes of equal sets, the classes, the pairs of similar classes)."""
    rows = value_sets(df.select(key, owner, values), key, values, least, owner)
    rows = stored(rows.select(F.col(key).alias("rid"), F.col(owner).alias("own"), "set", F.md5(F.array_join("set", "\u0001")).alias("mark")), "rows")
    classes = stored(rows.groupBy("mark").agg(F.min("rid").alias("sid"), F.first("set").alias("set")), "classes")
    member = stored(skew_join(rows.select("rid", "own", "mark"), classes.select("mark", "sid"), "mark").select("rid", "own", "sid"), "members")
    return member, classes, stored(similar_classes(classes.select("sid", "set"), tenths), "pairs")


def similar_records(df: DataFrame, key: str, values: str, owner: str, least: int = 5, tenths: int = TENTHS) -> DataFrame:
    """(key_a, key_b), smaller first: all pairs of rows of different owners whose sets of ``values`` are similar.

    ``key`` must be unique. Equal sets are one class while they are compared and become pairs at the end. Rows without
    an owner, and null, empty or small sets, pair with nothing. Extra columns are not read.
    """
    member, classes, pairs = _grouped(df, key, values, owner, least, tenths)
    linked = pairs.unionByName(classes.select(F.col("sid").alias("sid_a"), F.col("sid").alias("sid_b")))
    near = linked.join(member.select(F.col("rid").alias("ra"), F.col("own").alias("oa"), F.col("sid").alias("sid_a")).hint("merge"), "sid_a")
    both = dealt_join(near, member.select(F.col("rid").alias("rb"), F.col("own").alias("ob"), F.col("sid").alias("sid_b")), ["sid_b"], PART)
    both = both.where("oa <> ob AND ra <> rb AND (sid_a <> sid_b OR ra < rb)")
    return both.select(F.least("ra", "rb").alias(f"{key}_a"), F.greatest("ra", "rb").alias(f"{key}_b"))


def record_classes(df: DataFrame, key: str, values: str, owner: str, least: int = 5, tenths: int = TENTHS) -> DataFrame:
    """(key, class_id, n_similar): a row per row with a set of at least ``least`` values: the class of equal sets that it is in (its least key) and how many other classes are similar. As many rows as records, whatever their groups."""
    member, _, pairs = _grouped(df, key, values, owner, least, tenths)
    ends = pairs.select(F.col("sid_a").alias("sid")).unionByName(pairs.select(F.col("sid_b").alias("sid"))).groupBy("sid").agg(F.count("*").alias("n"))
    return member.join(ends.hint("merge"), "sid", "left").select(F.col("rid").alias(key), F.col("sid").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_similar"))
