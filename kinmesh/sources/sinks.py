"""Sinks: partitioned tables, delimited text, JSON pairs, LaTeX and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a missing value stands in delimited text.
MISSING = "\\N"


def partitioned(df: DataFrame, path: str, *by: str, mode: str = "append", format: str = "parquet") -> None:
    """One folder per value; rows of a value are spread over files by size, not gathered in one task."""
    df.write.mode(mode).format(format).partitionBy(*by).save(path)


def delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = True, index: str | None = None, mode: str = "overwrite") -> None:
    """Delimited text; arrays are joined by ``**``; ``index`` names a column that goes first."""
    cols = [index, *[c for c in df.columns if c != index]] if index else df.columns
    kinds = dict(df.dtypes)
    flat = df.select(*[F.array_join(c, "**").alias(c) if kinds[c].startswith("array") else F.col(c) for c in cols])
    # missing is a bare empty field, an empty text is "", and line breaks stand inside quotes
    flat.write.mode(mode).options(sep=sep, header=str(header).lower(), escape='"', nullValue=MISSING, emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", quoteAll="true").csv(path)


def lines(df: DataFrame, path: str, header: str | None = None) -> None:
    """A frame of one text column as lines; ``header`` goes before them in a single file."""
    out = df.select(F.col(df.columns[0]).alias("value"))
    if header is not None:
        out = df.sparkSession.createDataFrame([(header,)], "value string").unionByName(out).coalesce(1)
    out.write.mode("overwrite").text(path)


def tagged_sets(df: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """JSON lines in which a set stands as an object with the tag ``__set__`` and its values in order."""
    tag = lambda c: F.struct(F.lit("set").alias("__class__"), F.array_sort(F.array_distinct(c)).alias("__set__")).alias(c)
    df.select(key, *[tag(c) for c in columns]).write.mode("overwrite").json(path)


def settings(spark: SparkSession, path: str, numbers: dict[str, float], rules: list[str]) -> None:
    """Settings of a pipeline and its block rules, as JSON lines; models go through ``model``."""
    rows = [(k, float(v), None) for k, v in numbers.items()] + [("rule", None, r) for r in rules]
    spark.createDataFrame(rows, "setting string, number double, rule string").coalesce(1).write.mode("overwrite").json(path)


def pair_json(pairs: DataFrame, path: str) -> None:
    pairs.select("record_id_a", "record_id_b", "label").write.mode("overwrite").json(path)


def latex(df: DataFrame, most: int = 1000) -> str:
    """A table of at most ``most`` rows for a report; larger frames are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("&", r"\&").replace("_", r"\_").replace("%", r"\%")
    body = [" & ".join(map(cell, r)) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\hline", " & ".join(map(cell, df.columns)) + r" \\", r"\hline", *body, r"\hline", r"\end{tabular}"])


def model(fitted, path: str) -> None:
    fitted.write().overwrite().save(path)
