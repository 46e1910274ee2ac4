"""Numbered lines of splittable files, and whole JSON documents read piece by piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prefix import running


def numbered_lines(spark: SparkSession, path: str, separator: str | None = None, few: int = 100_000) -> DataFrame:
    """value, file, line (from 0 in its file) and row (from 0 over all files in the order of their paths). Blank lines count.

    Files are read in byte ranges as ever. A first look counts the lines of each range, and a running sum over the ranges (a row for each) gives the
    number of its first line. Up to `few` ranges are broadcast, so lines are not shuffled; more are joined. separator: what ends a line, if not a line break.
    Should the files be cut to other ranges when they are read than when they were counted, it is an error.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    ranges = lines.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    earlier = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ranges = ranges.select("file", "at", "n", "first", "base", F.min("base").over(Window.partitionBy("file")).alias("file_base"))
    found = ranges.limit(few + 1).collect()
    if len(found) <= few:
        ranges = F.broadcast(spark.createDataFrame(found, ranges.schema))
    joined = lines.join(ranges, ["file", "at"], "left")
    inside = F.col("id") - F.col("first")
    row = F.when((inside >= 0) & (inside < F.col("n")), F.col("base") + inside).otherwise(F.raise_error(F.lit("the files were cut otherwise when their lines were counted")).cast("long"))
    return joined.select("value", "file", row.alias("row"), "file_base").select("value", "file", (F.col("row") - F.col("file_base")).alias("line"), "row")


def _count(text: Column, of: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{of}]", "")).cast("long")


def document_entries(spark: SparkSession, path: str, name: str = "utts", block_rows: int = 100_000) -> DataFrame:
    """entry and row of each member of the object under `name` in documents {name: {key: value, ...}}: its text, and an order over all files.

    A document is read in the pieces between its commas, by byte ranges. Whether a comma lies in a string, and how deep, are running sums over the pieces (of
    quotes that no backslash precedes, and of brackets outside strings); those between two members part the document. A backslash
    never comes before a comma in JSON, so no piece ends inside an escape. Other members beside `name` are an error, and so is a document that is cut short.
    """
    pieces = numbered_lines(spark, path, ",")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = pieces.withColumns({"plain": plain, "quotes": _count(plain, '"')})
    pieces = running(pieces, ["file"], "line", {"quoted": ("sum", F.col("quotes"))}, block_rows).withColumn("inside", (F.col("quoted") - F.col("quotes")) % 2 == 1)
    bare = F.regexp_replace(F.concat(F.when(F.col("inside"), '"').otherwise(""), "plain"), r'(?s)"[^"]*("|$)', "")
    pieces = pieces.withColumn("bare", bare).withColumn("step", _count(F.col("bare"), r"{\[") - _count(F.col("bare"), r"}\]"))
    pieces = running(pieces.select("value", "file", "line", "row", "inside", "step"), ["file"], "line", {"depth": ("sum", F.col("step"))}, block_rows)
    begins = (F.col("line") == 0) | (~F.col("inside") & (F.col("depth") - F.col("step") == 2))
    pieces = running(pieces, ["file"], "line", {"number": ("sum", begins.cast("long"))}, block_rows)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), ",")
    entries = pieces.groupBy("file", "number").agg(text.alias("entry"), F.max("row").alias("row"), F.max_by("depth", "line").alias("depth"), F.min("line").alias("line"))
    head, tail = rf'^\s*\{{\s*"{name}"\s*:\s*\{{', r"\}\s*\}\s*$"
    broken = lambda why: F.raise_error(F.concat(F.col("file"), F.lit(f": {why}")))
    opened = F.when(F.col("line") > 0, F.col("entry")).when(F.col("entry").rlike(head), F.regexp_replace("entry", head, "")).otherwise(broken(f"not a document of {name}"))
    ends = entries.withColumn("entry", opened).select("file", "line", "entry", "row", "depth")
    tails = ends.groupBy("file").agg(F.max("line").alias("line")).withColumn("last", F.lit(True))
    ends = ends.join(tails, ["file", "line"], "left")
    closed = F.when(F.col("depth") == 0, F.regexp_replace("entry", tail, "")).when((F.col("depth") == 2) & F.col("last").isNull(), F.col("entry")).otherwise(broken("cut short or not nested as it should be"))
    return ends.select(closed.alias("entry"), "row").where(F.trim("entry") != "")
