"""Merging, splitting and checking of shards and key sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import running_count


def merged(shards: list[DataFrame], key: str) -> DataFrame:
    """One row for each key: that of the last shard that has it (within a shard, the largest row)."""
    numbered = [s.select(key, F.struct(F.lit(i).alias("shard"), *(c for c in s.columns if c != key)).alias("row")) for i, s in enumerate(shards)]
    best = reduce(DataFrame.unionByName, numbered).groupBy(key).agg(F.max("row").alias("row"))
    return best.select(key, *(F.col(f"row.{c}") for c in shards[0].columns if c != key))


def united(tables: list[DataFrame], columns: list[str]) -> DataFrame:
    """Rows of all tables in one column order; a table with other columns is an error."""
    for t in tables:
        if set(t.columns) != set(columns):
            raise ValueError(f"columns {t.columns} are not {columns}")
    return reduce(DataFrame.unionByName, (t.select(*columns) for t in tables))


def bagged(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """key and value rows of all tables: lists of a key are put together, repeats stay."""
    return reduce(DataFrame.unionByName, (t.select(key, value) for t in tables))


def bag_sizes(bag: DataFrame, key: str, value: str, task_rows: int = 250_000) -> DataFrame:
    """key, n and n_distinct: the rows of each list and its different values, nulls not among these.

    Lists are dealt by key to tasks of about `task_rows` rows, however many there are in all, so what a task holds does not grow with the input. bag is read twice.
    """
    tasks = max(1, -(-bag.count() // task_rows))
    return bag.repartition(tasks, key).groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(value).alias("n_distinct"))


def ordered_values(df: DataFrame, value: str) -> DataFrame:
    """Distinct values in order."""
    return df.select(value).distinct().orderBy(value)


def in_chunks(tables: dict[str, DataFrame], ids: DataFrame, key: str, chunks: int) -> dict[str, DataFrame]:
    """Each table's rows of the ids, with the chunk of their id; written by chunk (sinks.write_parts) they are the inputs of one job each."""
    numbered = chunked(ids.select(key).distinct(), key, chunks)
    return {name: table.join(numbered, key) for name, table in tables.items()}


def chunked(df: DataFrame, key: str, chunks: int) -> DataFrame:
    """df with the chunk of each row in key order: chunks of ceil(n / chunks) rows, perhaps fewer chunks."""
    size = -(-df.count() // chunks) or 1
    return running_count(df, key, F.lit(1), "_n").withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of only one side, and which."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
