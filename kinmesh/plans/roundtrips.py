"""Sources and sinks: tables written in a format into the shared folder and read back by the reader of that format."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.operators import aggregate
from kinmesh.sources import readers, sinks
from kinmesh.session import shared_path, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT n_name AS nation, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def source_query(spark, d):
    """A SQL query over views, its columns renamed by place."""
    return readers.query(spark, "SELECT n_name, count(*) FROM s JOIN n ON s_nationkey = n_nationkey GROUP BY n_name", ["nation", "n"], s=table(spark, d, "supplier"), n=table(spark, d, "nation"))


_REGISTER = "SELECT DISTINCT person_id, person_name, person_address FROM leuven_name"


@query(_REGISTER)
def delimited_roundtrip(spark, d):
    """Tab-separated text in UTF-8 with an index column first; quotes, tabs, line breaks, empty and missing values come back."""
    path = shared_path(spark, "delimited")
    sinks.delimited(table(spark, d, "leuven_name").select("person_name", "person_id", "person_address").distinct(), path, index="person_id")
    return readers.delimited(spark, path, "person_id long, person_name string, person_address string")


@query("SELECT DISTINCT person_id, sector, person_ctry_code AS country FROM leuven_name WHERE regexp_matches(person_ctry_code, '^[A-Z]{2}$')")
def partitioned_roundtrip(spark, d):
    """One folder per country, appended twice by halves, read with the country as a column."""
    path = shared_path(spark, "partitioned")
    t = table(spark, d, "leuven_name").select("person_id", "sector", F.col("person_ctry_code").alias("country")).where(F.col("country").rlike("^[A-Z]{2}$")).distinct()
    for half in (0, 1):
        sinks.partitioned(t.where(F.pmod("person_id", F.lit(2)) == half), path, "country")
    return spark.read.schema("person_id long, sector string, country string").parquet(path)


@query("SELECT DISTINCT c_custkey AS person_id, c_name AS name, upper(substr(n_name, 1, 2)) AS country FROM customer JOIN nation ON c_nationkey = n_nationkey")
def country_file_scan(spark, d):
    """A folder of files per country, some with a header line; the country comes from the file's name."""
    path = shared_path(spark, "countries")
    t = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    t = t.select(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name").alias("value"), F.upper(F.substring("n_name", 1, 2)).alias("cc"))
    for r in t.select("cc").distinct().collect():  # a file per country is the format; the list of countries is short
        rows = t.where(F.col("cc") == r["cc"]).select("value")
        sinks.lines(rows, f"{path}/cleaned_output_{r['cc']}.tsv", header="person_id\tname" if r["cc"] < "K" else None)
    schema = T.StructType([T.StructField("person_id", T.LongType()), T.StructField("name", T.StringType())])
    return readers.country_folder(spark, f"{path}/cleaned_output_*.tsv", schema)


@query("SELECT DISTINCT n_name AS name, CASE WHEN n_nationkey = 0 THEN 'NA' ELSE upper(substr(n_name, 1, 2)) END AS code FROM nation")
def lookup_roundtrip(spark, d):
    """A lookup separated by semicolons in which the code NA is text."""
    path = shared_path(spark, "lookup")
    t = table(spark, d, "nation").select(F.concat_ws(";", "n_name", F.when(F.col("n_nationkey") == 0, "NA").otherwise(F.upper(F.substring("n_name", 1, 2)))).alias("value"))
    sinks.lines(t, path)
    return readers.lookup(spark, path, ["name", "code"])


@query("SELECT record_id AS uid, round(patent_ct / 100.0, 2) AS probability, record_id * 10 + i AS id FROM patstat_dedupe_input, unnest([1, 2, 3]) AS u(i) WHERE patent_ct IS NOT NULL")
def link_lines(spark, d):
    """Lines ``uid###probability###id,id,`` read into one row per id."""
    path = shared_path(spark, "links")
    ids = F.concat(F.array_join(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda i: (F.col("record_id") * 10 + i).cast("string")), ","), F.lit(","))
    t = table(spark, d, "patstat_dedupe_input").where("patent_ct IS NOT NULL").select(F.concat_ws("###", F.col("record_id").cast("string"), F.round(F.col("patent_ct") / 100, 2).cast("string"), ids).alias("value"))
    sinks.lines(t, path)
    return readers.links(spark, path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name FROM part")
def ragged_lines(spark, d):
    """Rows of which some have one or two index fields in front."""
    path = shared_path(spark, "ragged")
    k = F.col("p_partkey")
    front = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit("7\t")).otherwise(F.lit("7\t8\t"))
    sinks.lines(table(spark, d, "part").select(F.concat(front, k.cast("string"), F.lit("\t"), "p_name").alias("value")), path)
    return readers.ragged(spark, path, ["key", "name"])


@query("SELECT p_partkey AS id, 'a\\' || p_name || '\"' AS name FROM part")
def bulk_roundtrip(spark, d):
    """Exports with quoted fields, doubled quotes, carriage returns and backslashes that mean themselves."""
    path = shared_path(spark, "bulk")
    t = table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(',"a\\'), "p_name", F.lit('"""\r')).alias("value"))
    sinks.lines(t, path, header="id,name\r")
    return readers.bulk(spark, path, T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))


@query("SELECT person_a AS record_id_a, person_b AS record_id_b, score AS label FROM person_match")
def pair_json_roundtrip(spark, d):
    path = shared_path(spark, "pairs")
    sinks.pair_json(table(spark, d, "person_match").select(F.col("person_a").alias("record_id_a"), F.col("person_b").alias("record_id_b"), F.col("score").alias("label")), path)
    return readers.pair_json(spark, path)


@query("SELECT record_id, array_to_string(list_sort(list_distinct(list_filter(Coauthor, lambda v: v IS NOT NULL))), '**') AS coauthor FROM patstat_dedupe_input WHERE Coauthor IS NOT NULL")
def tagged_set_json(spark, d):
    """Records with sets, written as tagged lists and read back as sorted sets."""
    path = shared_path(spark, "sets")
    t = table(spark, d, "patstat_dedupe_input").where("Coauthor IS NOT NULL").select("record_id", F.filter("Coauthor", lambda v: v.isNotNull()).alias("coauthor"))
    sinks.tagged_sets(t, path, "record_id", ["coauthor"])
    return readers.tagged_sets(spark, path, "record_id long", ["coauthor"]).select("record_id", F.array_join("coauthor", "**").alias("coauthor"))


@query("SELECT person_id, min(person_name) AS person_name FROM leuven_name GROUP BY person_id")
def unique_ids(spark, d):
    """Each id once, as a cursor that starts again would give it."""
    return readers.unique_rows(table(spark, d, "leuven_name").select("person_id", "person_name"), "person_id")


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, max(n) <= 500 AS bounded FROM (SELECT count(*) AS n FROM customer GROUP BY CAST(floor((c_custkey - 1) / 500) AS BIGINT))")
def chunk_scan(spark, d):
    """Chunks of at most 500 rows handed to a function one by one."""
    sizes = aggregate.in_chunks(table(spark, d, "customer").select("c_custkey"), 500, lambda c: c[["c_custkey"]].assign(n=len(c)).head(1)[["n"]], "n long")
    return sizes.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 500).alias("bounded"))


@query("SELECT r_regionkey AS region, r_name AS name, '\\begin{tabular}{ll}' AS first_line FROM region")
def latex_report(spark, d):
    """A small table as LaTeX, read back from its lines."""
    lines = sinks.latex(table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")).split("\n")
    cells = [line.rstrip("\\ ").split(" & ") for line in lines[4:-2]]
    return spark.createDataFrame([(int(a), b, lines[0]) for a, b in cells], "region int, name string, first_line string").withColumn("region", F.col("region").cast(dict(table(spark, d, "region").dtypes)["r_regionkey"]))


@query("SELECT 'recall weight' AS setting, 1.5::DOUBLE AS number, NULL AS rule UNION ALL SELECT 'rule', NULL, 'first 6 of name' UNION ALL SELECT 'rule', NULL, 'cell of 0.05'")
def settings_roundtrip(spark, d):
    """Settings and block rules of a pipeline written as JSON and read back."""
    path = shared_path(spark, "settings")
    sinks.settings(spark, path, {"recall weight": 1.5}, ["first 6 of name", "cell of 0.05"])
    return readers.settings(spark, path)
