"""Encoding with a public byte-level BPE through a table of distinct words."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.session import stored

#: Folder of the vocabulary files; a parameter, never copied.
VOCABULARIES = os.environ.get("KINMESH_TOKENIZERS", "/opt/tokenizers")
#: Share of all positions from which a word's ids are broadcast: at most its inverse, 2,000 words.
COMMON_SHARE = 0.0005
# Fixed value: the split pattern of the public vocabulary, spelled for Java's regular expressions.
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoder(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, word) of every text, split by the vocabulary's pattern; null and empty texts give no rows."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(SPLIT), F.lit(0))).alias("pos", "word"))


def encode_words(distinct: DataFrame, path: str) -> DataFrame:
    """(word, ids) of each word; words are encoded in batches, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(path)
        for pdf in batches:
            yield pd.DataFrame({"word": pdf["word"], "ids": [e.ids for e in enc.encode_batch(pdf["word"].tolist(), add_special_tokens=False)]})

    return distinct.select("word").mapInPandas(run, "word string, ids array<int>")


def encode(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """(key, ids): one row per row of ``df``; empty and null texts get the empty list.

    Words are split in Spark, once, into a stored stage; each distinct word is encoded once, and the ids come back by (key,
    pos). The words that make up at least one in ``1 / COMMON_SHARE`` positions, so at most that many, are looked up in a
    broadcast table: by the law of word frequencies that spares most positions the shuffle by word, and no hot word gathers in one
    task. ``key`` must be unique and not null. Special tokens' strings in a text are ordinary text.
    """
    path = f"{folder or VOCABULARIES}/{vocabulary}"
    split = stored(words(df.select(key, text), key, text), "words")
    counts = stored(split.groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    table = stored(encode_words(counts, path).join(counts.hint("merge"), "word"), "word-table")
    total = counts.agg(F.sum("n").alias("total"))
    common = table.join(F.broadcast(total)).where(F.col("n") >= F.lit(COMMON_SHARE) * F.col("total")).select("word", F.col("ids").alias("common_ids"))
    marked = split.join(F.broadcast(common), "word", "left")
    often = marked.where("common_ids IS NOT NULL").select(key, "pos", F.col("common_ids").alias("ids"))
    rest = marked.where("common_ids IS NULL").select(key, "pos", "word").join(table.select("word", "ids").hint("merge"), "word").select(key, "pos", "ids")
    ids = often.unionByName(rest).groupBy(F.col(key).alias("__k")).agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    got = ids.select("__k", F.flatten(F.col("parts.ids")).alias("ids"))
    return df.select(key).join(got.hint("merge"), F.col(key) == F.col("__k"), "left").select(key, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def pieces(spark: SparkSession, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(id, piece) of a vocabulary, the piece as hexadecimal bytes; as many rows as the vocabulary has ids."""
    with open(f"{folder or VOCABULARIES}/{vocabulary}", "rb") as f:
        rows = [(int(b), base64.b64decode(a).hex().upper()) for a, b in map(bytes.split, f)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]).astype({"id": "int32"}))


def decode(encoded: DataFrame, key: str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(key, text) from (key, ids) through a join with the table of pieces, which is as small as its vocabulary; an empty list gives the empty text."""
    table = pieces(encoded.sparkSession, vocabulary, folder)
    long = encoded.select(key, F.posexplode("ids").alias("pos", "id")).join(F.broadcast(table), "id")
    text = long.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("parts"))
    text = text.select(F.col(key).alias("__k"), F.decode(F.unhex(F.array_join("parts.piece", "")), "UTF-8").alias("text"))
    return encoded.select(key).join(text, F.col(key) == F.col("__k"), "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
