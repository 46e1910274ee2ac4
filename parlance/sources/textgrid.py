"""Interval files (TextGrid): a reader of long and short files with interval and point tiers, the text of a file, and a sink of one file an utterance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.intervals import with_ends

# What counts in a file: quoted texts (quotes doubled inside), flags and free-standing numbers; all else is a remark. So long and short files hold the same values.
VALUE = r'("(?:[^"]|"")*"|<[a-z]+>|(?<!\S)-?[0-9][0-9.eE+-]*(?!\S)|![^\n]*)'
FOUR_TIERS = ("CorrectWord", "PerceivedPhone", "PerceivedPhoneIPA", "Notes")  # fixed values: tiers of an annotation file, in order


def textgrid_tiers(spark: SparkSession, path: str) -> DataFrame:
    """file, tier_ord, kind, tier, ord, start, end, label of every interval and point of the files; ord from 0 in each tier.

    A point's end is its start. Files in UTF-8 or, by their byte order mark, UTF-16. A file that ends too early or holds no tiers gives one row with its
    `problem` and nulls; problem is null elsewhere. A file without a byte gives no row. A file, an utterance, is one row while it is parsed.
    """
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    mark = F.hex(F.substring("content", 1, 2))
    text = F.when(mark.isin("FFFE", "FEFF"), F.decode("content", "UTF-16")).otherwise(F.decode("content", "UTF-8"))
    values = F.filter(F.regexp_extract_all(F.regexp_replace(text, "^﻿", ""), F.lit(VALUE), F.lit(1)), lambda x: ~x.startswith("!"))
    files = raw.select("file", values.alias("v"))
    number = lambda k: F.get("v", k).try_cast("double")
    said = lambda k: F.replace(F.substring(F.get("v", k), F.lit(2), F.length(F.get("v", k)) - 2), F.lit('""'), F.lit('"'))
    width = lambda k: F.when(said(k) == "TextTier", F.lit(2)).otherwise(F.lit(3))
    begin = F.struct(F.when(F.size("v") > 0, F.lit(6)).alias("at"), F.array().cast("array<int>").alias("tiers"))  # null beyond the end of a file

    def tier(state: Column, _: Column) -> Column:
        at = state["at"]
        n = F.get("v", at + 4).try_cast("int")
        return F.struct((at + 5 + n * width(at)).alias("at"), F.array_append(state["tiers"], at).alias("tiers"))

    size = F.coalesce(F.get("v", F.lit(5)).try_cast("int"), F.lit(0))
    found = files.withColumn("s", F.aggregate(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")), begin, tier))
    problem = F.when((said(F.lit(1)) != "TextGrid") | F.get("v", F.lit(1)).isNull(), "no TextGrid").when(size < 1, "no tiers").when(F.col("s.at").isNull() | (F.col("s.at") > F.size("v")), "ends too early")
    found = found.withColumn("problem", problem)
    tiers = found.select("file", "v", "problem", F.posexplode(F.when(F.col("problem").isNull(), F.col("s.tiers")).otherwise(F.array(F.lit(None).cast("int")))).alias("tier_ord", "at"))
    n = F.coalesce(F.get("v", F.col("at") + 4).try_cast("int"), F.lit(0))
    places = F.when(F.col("problem").isNotNull(), F.array(F.lit(None).cast("int"))).when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = tiers.withColumns({"kind": said(F.col("at")), "tier": said(F.col("at") + 1), "wide": width(F.col("at"))}).withColumn("ord", F.explode(places))
    rows = rows.withColumn("k", F.col("at") + 5 + F.col("ord") * F.col("wide"))
    return rows.select(
        "file", F.when(F.col("problem").isNull(), F.col("tier_ord")).alias("tier_ord"), "kind", "tier", "ord", number(F.col("k")).alias("start"), number(F.col("k") + F.col("wide") - 2).alias("end"),
        said(F.col("k") + F.col("wide") - 1).alias("label"), "problem",
    )


def textgrid(spark: SparkSession, path: str, tier: str = "words") -> DataFrame:
    """Intervals (or points) of a named tier: file, ord, start, end, label."""
    return textgrid_tiers(spark, path).where(F.col("tier") == tier).select("file", "ord", "start", "end", "label")


def textgrid_text(intervals: DataFrame, tiers: tuple[str, ...] = ("words", "phones")) -> DataFrame:
    """utt_id and the text of its interval file, from rows of (utt_id, tier, ord, start, end, label) and `total`, if there is such a column.

    Every file holds all of `tiers` in their order; rows of other tiers are left out, and a tier without rows is one empty interval. Files end at the greatest of `total`
    and the ends. A null label is empty. An utterance's intervals are one array, bounded by its length in seconds.
    """
    stop = F.greatest(F.max("end"), F.max("total") if "total" in intervals.columns else F.lit(None).cast("double"))
    cell = F.struct("ord", "start", "end", F.replace(F.coalesce("label", F.lit("")), F.lit('"'), F.lit('""')).alias("label"))
    per_tier = intervals.where(F.col("tier").isin(*tiers)).groupBy("utt_id", "tier").agg(stop.alias("stop"), F.array_sort(F.collect_list(cell)).alias("cells"))
    utts = per_tier.groupBy("utt_id").agg(F.max("stop").alias("stop"), F.map_from_entries(F.collect_list(F.struct("tier", "cells"))).alias("held"))
    one = lambda x, k: F.concat(
        F.lit("        intervals ["), k + 1, F.lit("]:\n            xmin = "), x["start"], F.lit("\n            xmax = "), x["end"], F.lit('\n            text = "'), x["label"], F.lit('"\n')
    )

    def item(k: int, name: str) -> Column:
        empty = F.array(F.struct(F.lit(1).alias("ord"), F.lit(0.0).alias("start"), F.col("stop").alias("end"), F.lit("").alias("label")))
        cells = F.coalesce(F.transform(F.col("held")[name], lambda x: F.struct(x["ord"].cast("int").alias("ord"), x["start"].cast("double").alias("start"), x["end"].cast("double").alias("end"), x["label"].alias("label"))), empty)
        named = name.replace('"', '""')
        head = F.lit(f'    item [{k + 1}]:\n        class = "IntervalTier"\n        name = "{named}"\n        xmin = 0\n        xmax = ')
        return F.concat(head, F.col("stop"), F.lit("\n        intervals: size = "), F.size(cells), F.lit("\n"), F.array_join(F.transform(cells, one), ""))

    head = F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = '), F.col("stop"), F.lit(f"\ntiers? <exists>\nsize = {len(tiers)}\nitem []:\n"))
    return utts.select("utt_id", F.concat(head, *(item(k, name) for k, name in enumerate(tiers))).alias("text"))


def annotation_tiers(words: DataFrame, phones: DataFrame, totals: DataFrame) -> DataFrame:
    """utt_id, tier, ord, start, end, label, total of the four tiers of an annotation file.

    words: utt_id, ord, label, start, end, conf; phones: the same without conf; totals: utt_id, total, the length. Words carry their confidence after a comma, if
    they have one, phones lose what follows an underscore, the third tier has the phones' times and no labels, the notes are one empty interval. The first three are
    padded to the whole length. Utterances without a total have no file. Words, phones and totals (one for each utterance) are sorted by utterance once, together.
    """
    w, p, blank, notes = FOUR_TIERS
    spoken = F.when(F.col("conf").isNull(), F.col("label")).otherwise(F.concat("label", F.lit(","), F.col("conf").cast("string")))
    length = F.col("total").cast("double")

    def spans(rows: DataFrame, kind: int, ord_: Column, label: Column, start: Column, end: Column, total: Column) -> DataFrame:
        return rows.where("utt_id IS NOT NULL").select("utt_id", F.lit(kind).alias("kind"), ord_.cast("int").alias("ord"), label.alias("label"), start.alias("start"), end.alias("end"), total.cast("double").alias("total"))

    own = F.col("ord"), F.col("start"), F.col("end"), F.lit(None)
    rows = spans(words, 0, own[0], spoken, *own[1:]).unionByName(spans(phones, 1, own[0], F.substring_index("label", "_", 1), *own[1:]))
    rows = rows.unionByName(spans(totals, 2, F.lit(1), F.lit(""), F.lit(0.0), length, length))
    utt = Window.partitionBy("utt_id")
    of = lambda f, kind: f(F.when(F.col("kind") == kind, F.col("ord"))).over(utt)
    rows = rows.withColumns({"total": F.max("total").over(utt), "has": F.max("kind").over(utt), **{f"{f.__name__}{k}": of(f, k) for f in (F.min, F.max) for k in (0, 1)}})
    edge = lambda name: F.when(F.col("kind") == 0, F.col("ord") == F.col(f"{name}0")).when(F.col("kind") == 1, F.col("ord") == F.col(f"{name}1")).otherwise(False)
    full = with_ends(rows.where("has = 2").withColumns({"is_first": edge("min"), "is_last": edge("max")}), ["utt_id", "kind", "total"])
    tier = lambda name, label: F.struct(F.lit(name).alias("tier"), label.alias("label"))
    tiers = F.when(F.col("kind") == 0, F.array(tier(w, F.col("label")))).when(F.col("kind") == 1, F.array(tier(p, F.col("label")), tier(blank, F.lit("")))).otherwise(F.array(tier(notes, F.lit(""))))
    return full.withColumn("x", F.explode(tiers)).select("utt_id", "x.tier", "ord", "start", "end", "x.label", "total")


@dataclass
class Written(WriterCommitMessage):
    files: int


class TextFilesWriter(DataSourceWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def write(self, iterator: Iterator) -> Written:
        """Each file is written aside and moved to its place, so that it is whole or absent; a task that runs again writes the same files."""
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(folder, recursive=True)
        n = 0
        for row in iterator:
            name = "%null" if row["name"] is None else quote(str(row["name"]), safe=" ")
            aside = f"{folder}/_{uuid4().hex}"
            with system.open_output_stream(aside) as out:
                out.write((row["text"] or "").encode())
            system.move(aside, f"{folder}/{name}{self.suffix}")
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/_SUCCESS"):
            pass


class TextFiles(DataSource):
    """`df.write.format("text_files").save(folder)` of rows (name, text): one file for each name."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def writer(self, schema: StructType, overwrite: bool) -> TextFilesWriter:
        return TextFilesWriter(self.options["path"], self.options.get("suffix", ".txt"))


def write_textgrids(intervals: DataFrame, path: str, tiers: tuple[str, ...] = ("words", "phones")) -> None:
    """One file an utterance in a folder that all executors see, named by its id (percent-encoded, `%null` without an id); files of other utterances stay.

    Ids that are the same text, such as 1 and "1", are the same file, so utt_id must be of one type.
    """
    intervals.sparkSession.dataSource.register(TextFiles)
    files = textgrid_text(intervals, tiers).select(F.col("utt_id").cast("string").alias("name"), "text")
    files.write.format("text_files").mode("append").option("suffix", ".TextGrid").save(path)
