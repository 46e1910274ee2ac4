"""Canonical speech tables from the test tables, by rules that SQL can repeat (see plans)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord (from 1) and label of each token of `text`."""
    return df.select(*keys, F.posexplode(tokens(F.col("text"))).alias("ord", "label")).withColumn("ord", F.col("ord") + 1)


def marked(words: DataFrame) -> DataFrame:
    """Marks, partial words and phrases by position; the first rule that fits holds."""
    o = F.col("ord")
    label = F.when(o % 17 == 0, "@uh").when(o % 19 == 0, "@ns").when(o % 23 == 0, F.concat("label", F.lit("-"))).when(o % 29 == 0, "well").when(o % 31 == 0, "you").when((o % 31 == 1) & (o > 1), "know")
    return words.withColumn("label", label.otherwise(F.col("label")))


def word_ctm(events: DataFrame) -> DataFrame:
    """Events of a user as words: days since 2024-01-01, label event_type, conf from value."""
    start = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200) / 86400
    ordered = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("utt_id"), F.row_number().over(ordered).alias("ord"), F.col("event_type").alias("label"), start.alias("start"), (F.col("value") / 86400).alias("dur"), F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("conf"))


def phone_ctm(conversations: DataFrame) -> DataFrame:
    """Tokens of a turn as phones of their first two letters, as long as the token."""
    rows = words_of(conversations, ["conv_id", "turn"])
    before = Window.partitionBy("conv_id", "turn").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    dur = F.length("label") * 0.05
    phone = F.substring(F.regexp_replace(F.lower("label"), "[^a-z]", ""), 1, 2)
    return rows.select("conv_id", "turn", "ord", phone.alias("phone"), dur.alias("dur"), F.coalesce(F.sum(dur).over(before), F.lit(0.0)).alias("start"))


def gop_raw(lineitem: DataFrame) -> DataFrame:
    """Line items of an order as scored phones: raw score up to 0, phone key, place, whether it was right."""
    ordered = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return lineitem.select(F.col("l_orderkey").alias("utt_id"), F.row_number().over(ordered).alias("ord"), F.col("l_returnflag").alias("phone"), (F.col("l_discount") * -40).alias("raw"), (F.col("l_linestatus") == "O").alias("correct"), (F.col("l_quantity") / 10).alias("dur"), (F.col("l_tax") == 0).alias("silent"))
