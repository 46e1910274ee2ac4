"""Readers of the line formats of speech data directories, as DataFrames with fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.prefix import running
from .lines import document_entries, numbered_lines
from .textgrid import textgrid, textgrid_tiers  # noqa: F401

GOP_SCHEMA = "struct<GOP:array<array<string>>>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("f", tokens(F.col("value"))).where(F.size("f") > 0)


def _rest(start: int) -> Column:
    return F.slice("f", start, F.greatest(F.size("f") - start + 1, F.lit(0)))


def key_tokens(spark: SparkSession, path: str, key: str = "word", values: str = "phones") -> DataFrame:
    """`key t1 t2 ...`: lexicons, speaker maps. Of repeated keys the last line of the last file stays."""
    rows = numbered_lines(spark, path).withColumn("f", tokens(F.col("value"))).where(F.size("f") > 0)
    return rows.select(F.col("f")[0].alias("k"), _rest(2).alias("v"), "row").groupBy(F.col("k").alias(key)).agg(F.max_by("v", "row").alias(values))


def key_text(spark: SparkSession, path: str, key: str = "utt_id") -> DataFrame:
    """`utt w1 w2 ...` with the words joined by spaces."""
    return _lines(spark, path).select(F.col("f")[0].alias(key), F.array_join(_rest(2), " ").alias("text"))


def key_value(spark: SparkSession, path: str, key: str = "utt_id", value: str = "value", kind: str = "string") -> DataFrame:
    """`key value`: wav.scp, durations, labels, symbol tables."""
    return _lines(spark, path).select(F.col("f")[0].alias(key), F.get("f", F.lit(1)).cast(kind).alias(value))


def first_fields(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.col("f")[0].alias("item"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """Distinct lower-cased words of a text column."""
    return texts.select(F.explode(tokens(F.lower("text"))).alias("word")).distinct()


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-cased first fields: a vocabulary to compare words with."""
    return _lines(spark, path).select(F.lower(F.col("f")[0]).alias("word")).distinct()


def ctm(spark: SparkSession, path: str) -> DataFrame:
    """`utt channel start dur label [conf]`; ord is the place of the line among those of its utterance, in the order of the files."""
    rows = numbered_lines(spark, path).withColumn("f", tokens(F.col("value"))).where(F.size("f") > 0).select(
        "row", F.col("f")[0].alias("utt_id"), F.round(F.col("f")[2].cast("double"), 4).alias("start"), F.round(F.col("f")[3].cast("double"), 4).alias("dur"), F.col("f")[4].alias("label"), F.coalesce(F.get("f", F.lit(5)).cast("double"), F.lit(1.0)).alias("conf")
    )
    return running(rows, ["utt_id"], "row", {"ord": ("count", F.lit(1))}).withColumn("ord", F.col("ord").cast("int")).drop("row")


def phone_sequence(spark: SparkSession, path: str) -> DataFrame:
    """utt_id, ord and phone_id: the last field of each line of a phone table, in file order."""
    rows = numbered_lines(spark, path).withColumn("f", tokens(F.col("value"))).where(F.size("f") > 0)
    rows = rows.select("row", F.col("f")[0].alias("utt_id"), F.element_at("f", -1).alias("phone_id"))
    return running(rows, ["utt_id"], "row", {"ord": ("count", F.lit(1))}).select("utt_id", F.col("ord").cast("int").alias("ord"), "phone_id")


def ctm_labels(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.col("f")[4].alias("label")).distinct()


def gop_log(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Score messages of log lines that hold `tag`: utt_id and items of (phone, pred, dur, raw)."""
    rest = F.get(F.split(F.get(F.split("value", tag), F.lit(1)), "<GOP>"), F.lit(1))
    head = F.trim(F.get(F.split(F.get(F.split("value", tag), F.lit(1)), "<GOP>"), F.lit(0)))
    rows = spark.read.text(path).where(F.col("value").contains(tag) & F.col("value").contains("<GOP>")).select(head.alias("utt_id"), tokens(rest).alias("f"))
    at = F.sequence(F.lit(0), F.floor(F.size("f") / 4).cast("int") - 1)
    item = lambda k: F.struct(F.get("f", 4 * k).alias("phone"), F.get("f", 4 * k + 1).alias("pred"), F.get("f", 4 * k + 2).cast("double").alias("dur"), F.get("f", 4 * k + 3).cast("double").alias("raw"))
    return rows.select("utt_id", F.when(F.size("f") >= 4, F.transform(at, item)).alias("items"))


def gop_vector(spark: SparkSession, path: str) -> DataFrame:
    """Scores of a bracketed vector line: fields from the fourth to the one before the last, with their place."""
    body = F.slice("f", 4, F.greatest(F.size("f") - 4, F.lit(0)))
    return _lines(spark, path).select(F.col("f")[0].alias("utt_id"), F.posexplode(body).alias("ord", "gop")).withColumn("gop", F.col("gop").cast("double"))


def annotation_v1(spark: SparkSession, path: str) -> DataFrame:
    """`utt p,p,... T,F,...`."""
    pair = F.arrays_zip(F.split(F.col("f")[1], ",").alias("phone"), F.split(F.col("f")[2], ",").alias("mark"))
    return _lines(spark, path).select(F.col("f")[0].alias("utt_id"), F.posexplode(pair).alias("ord", "p")).select("utt_id", "ord", "p.phone", (F.col("p.mark") == "T").alias("correct"))


def annotation_v2(spark: SparkSession, path: str) -> DataFrame:
    """Groups of four lines (reference, hypothesis, operations, other) of each file, blank lines apart; insertions go, and so does a group cut short."""
    rows = running(numbered_lines(spark, path).where(F.trim("value") != ""), ["file"], "line", {"place": ("count", F.lit(1))}).withColumn("place", F.col("place") - 1)
    line = lambda k: F.max(F.when(F.col("place") % 4 == k, F.col("value")))
    groups = rows.groupBy("file", F.floor(F.col("place") / 4).alias("group")).agg(line(0).alias("ref"), line(2).alias("ops"), F.count("*").alias("n")).where("n = 4")
    ops = F.filter(tokens(F.col("ops")), lambda x: x.isin("C", "S", "D"))
    found = groups.select(F.get(tokens(F.col("ref")), F.lit(0)).alias("utt_id"), F.posexplode(ops).alias("ord", "op"))
    return found.withColumn("correct", F.col("op") == "C")


def annotation_triples(spark: SparkSession, path: str) -> DataFrame:
    """`utt,T,F,T,...`: how many of each complete group of three are true."""
    marks = F.split("value", ",")
    rows = spark.read.text(path).select(F.get(marks, F.lit(0)).alias("utt_id"), F.posexplode(F.slice(marks, 2, F.size(marks))).alias("pos", "mark"))
    grouped = rows.groupBy("utt_id", F.floor(F.col("pos") / 3).alias("ord")).agg(F.count_if(F.col("mark") == "T").alias("score"), F.count("*").alias("n"))
    return grouped.where("n = 3").drop("n")


def utts_json(spark: SparkSession, path: str, value_schema: str, name: str = "utts") -> DataFrame:
    """utt_id and value of `{"utts": {id: value}}` documents of any size; of an id that comes again the last one stays, in the order of the files."""
    members = F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), f"map<string,{value_schema}>", {"mode": "FAILFAST"})
    rows = document_entries(spark, path, name).select("row", F.explode(members).alias("utt_id", "value"))
    return rows.groupBy("utt_id").agg(F.max_by("value", "row").alias("value"))


def feature_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True) if schema else spark.read.csv(path, header=True, inferSchema=True)


def grader_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with a header; a byte order mark before the first name goes."""
    df = spark.read.csv(path, sep="\t", header=True, quote="")
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})
