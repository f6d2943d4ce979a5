"""Sources: queries, delimited text with its quirks, link texts and JSON pairs, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.sources.sinks import MISSING


def query(spark: SparkSession, sql: str, columns: list[str] | None = None, **views: DataFrame) -> DataFrame:
    """A SQL query over named frames, its columns renamed by place."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(sql)
    return out.toDF(*columns) if columns else out


def jdbc(spark: SparkSession, url: str, sql: str, partition_column: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **options: str) -> DataFrame:
    """A query of a database over JDBC, read in ranges of a column where one is given."""
    r = spark.read.format("jdbc").options(url=url, **options)
    if partition_column:
        return r.options(dbtable=f"({sql}) q", partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts)).load()
    return r.options(query=sql).load()


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", encoding: str = "UTF-8", header: bool = True, **options: str) -> DataFrame:
    """Delimited text; without a schema, types are inferred."""
    r = spark.read.options(sep=sep, encoding=encoding, header=str(header).lower(), **options)
    return r.csv(path, schema=schema) if schema is not None else r.option("inferSchema", "true").csv(path)


def table_with_doubtful_header(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t") -> DataFrame:
    """Files of which some begin with a header line and some don't: a line that holds the schema's names is dropped wherever it stands first."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.options(sep=sep, header="false").csv(path, schema=text)
    names = raw
    same = None
    for f in schema.fields:
        hit = F.lower(F.trim(F.col(f.name))) == f.name.lower()
        same = hit if same is None else same & hit
    return names.where(~F.coalesce(same, F.lit(False))).select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema.fields])


def lookup(spark: SparkSession, path: str, columns: list[str], sep: str = ";") -> DataFrame:
    """A two-or-more column lookup without a header; the code NA is text, not a missing value."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.options(sep=sep, header="false", nullValue="\u0000", emptyValue="").csv(path, schema=schema)


def bulk(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", skip_header: bool = True) -> DataFrame:
    """Exports with quoted fields and CRLF lines; backslashes are ordinary characters."""
    return spark.read.options(sep=sep, quote='"', escape='"', header=str(skip_header).lower(), multiLine="true", ignoreTrailingWhiteSpace="false").csv(path, schema=schema)


def country_files(spark: SparkSession, pattern: str, schema: T.StructType, sep: str = "\t") -> DataFrame:
    """All files of a pattern ``*_CC.tsv``, with the country from the last two letters of each file's stem."""
    df = spark.read.options(sep=sep, header="false").csv(pattern, schema=schema)
    return df.withColumn("country", F.regexp_extract(F.input_file_name(), r"([A-Za-z]{2})\.[^./]*$", 1))


def links(spark: SparkSession, path: str) -> DataFrame:
    """(uid, probability, id) of lines ``uid###probability###id,id,``."""
    parts = F.split("value", "###")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim(parts[0]).alias("uid"), F.get(parts, F.lit(1)).try_cast("double").alias("probability"), F.get(parts, F.lit(2)).alias("ids"))
    ids = F.filter(F.transform(F.split("ids", ","), lambda v: F.trim(v)), lambda v: v != "")
    return rows.select(F.col("uid").try_cast("long").alias("uid"), "probability", F.explode(ids).alias("id")).withColumn("id", F.col("id").try_cast("long"))


def ragged(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Rows with one or two index fields in front: those beyond the expected number of columns are dropped."""
    parts = F.split("value", sep)
    extra = F.size("p") - F.lit(len(columns))
    rows = spark.read.text(path).select(parts.alias("p")).where(extra.between(0, 2))
    kept = rows.select(F.slice("p", extra + 1, len(columns)).alias("p"))
    return kept.select(*[F.col("p")[i].alias(c) for i, c in enumerate(columns)])


def unique_rows(df: DataFrame, key: str) -> DataFrame:
    """Each id once; of rows with one id the least by all columns stays."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*cols)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def pair_json(spark: SparkSession, path: str) -> DataFrame:
    """(record_a, record_b, label) of the JSON lines that ``sinks.pair_json`` writes."""
    return spark.read.schema("record_id_a long, record_id_b long, label double").json(path)


def delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t") -> DataFrame:
    """Delimited text as ``sinks.delimited`` writes it, with line breaks inside quotes."""
    return spark.read.options(sep=sep, header="true", multiLine="true", quote='"', escape='"', nullValue=MISSING, emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", lineSep="\n").csv(path, schema=schema)


def country_folder(spark: SparkSession, pattern: str, schema: T.StructType, sep: str = "\t") -> DataFrame:
    """As ``table_with_doubtful_header`` over files or folders ``*_CC.tsv``, with the country from the name."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.options(sep=sep, header="false").csv(pattern, schema=text).withColumn("country", F.regexp_extract(F.input_file_name(), r"_([A-Za-z]{2})\.tsv", 1))
    is_header = F.lit(True)
    for f in schema.fields:
        is_header &= F.coalesce(F.lower(F.trim(F.col(f.name))) == f.name.lower(), F.lit(False))
    return raw.where(~is_header).select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema.fields], "country")


def tagged_sets(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """Records of ``sinks.tagged_sets``, sets as arrays. ``key``: name and type."""
    kinds = ", ".join(f"{c} struct<__class__:string,__set__:array<string>>" for c in columns)
    return spark.read.schema(f"{key}, {kinds}").json(path).select(key.split(" ")[0], *[F.col(f"{c}.__set__").alias(c) for c in columns])


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(setting, number, rule) as ``sinks.settings`` writes them."""
    return spark.read.schema("setting string, number double, rule string").json(path)
