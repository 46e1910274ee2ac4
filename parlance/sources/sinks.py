"""Writers of the output formats."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textgrid import textgrid_text, write_textgrids  # noqa: F401


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_utterances(df: DataFrame, path: str, key: str = "utt_id", name: str = "utts") -> None:
    """One document {"utts": {utt: {...}, ...}} over the part files in order of their names; the parts of a plain `cat` are valid JSON.

    A key comes once: of rows of one key the one stays whose JSON text is greatest. A null key is the key "null". A table without rows is an empty object.
    """
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), F.to_json(F.struct(*(c for c in df.columns if c != key))).alias("v"))
    rows = rows.groupBy("k").agg(F.max("v").alias("v"))
    first = rows.agg(F.min("k")).first()[0]  # one value: the row that no comma comes before
    quoted = F.regexp_extract(F.to_json(F.struct("k")), r'(?s)^\{"k":(.*)\}$', 1)
    body = rows.select("k", F.lit(1).alias("place"), F.concat(F.when(F.col("k") == F.lit(first), "").otherwise(","), quoted, F.lit(": "), "v").alias("value"))
    ends = df.sparkSession.createDataFrame([(None, 0, f"{{{json.dumps(name)}: {{"), (None, 2, "}}")], "k string, place int, value string")
    body.unionByName(ends).orderBy("place", "k").select("value").write.mode("overwrite").text(path)


def write_errors(df: DataFrame, path: str, failed: Column, key: str = "utt_id") -> None:
    """Keys of the rows that failed, one a line."""
    df.where(failed).select(F.col(key).cast("string").alias("value")).distinct().write.mode("overwrite").text(path)


def write_parts(df: DataFrame, path: str, by: str) -> None:
    """Parquet in a folder for each value of `by`; a rerun replaces only the folders it writes."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_text(df: DataFrame, path: str) -> None:
    """`utt text` lines."""
    df.select(F.concat_ws(" ", "utt_id", "text").alias("value")).write.mode("overwrite").text(path)


def write_ctm(df: DataFrame, path: str) -> None:
    """`utt 1 start dur label conf` lines, by utterance and time inside each file."""
    rows = df.sortWithinPartitions("utt_id", "ord")
    rows.select(F.concat_ws(" ", "utt_id", F.lit("1"), "start", "dur", "label", "conf").alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def write_items(df: DataFrame, path: str, columns: list[str]) -> None:
    """`item value [margin]` lines."""
    df.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("value")).write.mode("overwrite").text(path)


def unprocessed(todo: DataFrame, done: DataFrame, key: str = "utt_id") -> DataFrame:
    """What a rerun still has to do."""
    return todo.join(done.select(key), key, "left_anti")
