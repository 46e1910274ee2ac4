"""Intervals on a time axis: repair, snapping, padding, frame lookup; voiced segments are those of `voicing`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import BLOCK_ROWS, clamped, fresh
from .voicing import voiced, voiced_segments  # noqa: F401


def repaired(ctm: DataFrame, silent: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """utt_id, ord, label, start, end: a start after the repaired end before it moves back to it; silences fall out first.

    Starts and durations are rounded half up to four decimals and counted in units of those, so ends are exact. The order is that of
    ord, of equal ones by start, duration and label. A null start begins where the interval before ends (the first has null times then), a null duration
    counts as 0. Utterances without an id are one utterance. Long ones are cut at multiples of `block_rows` in ord and run in several tasks.
    """
    rows = ctm.where(~F.coalesce(F.col("label").isin(*silent), F.lit(False))) if silent else ctm
    grid = lambda c: F.round(F.round(F.col(c).cast("double"), 4) * 10_000).cast("long").alias(c)
    rows = rows.select("utt_id", F.col("ord").cast("int").alias("ord"), F.col("label").cast("string").alias("label"), grid("start"), grid("dur"))
    time = lambda c: (F.col(c) / 10_000).alias(c)
    return clamped(rows, "utt_id", ["ord", "start", "dur", "label"], "start", "dur", block_rows).select("utt_id", "ord", "label", time("start"), time("end"))


def snapped(intervals: DataFrame, within: float = 0.01) -> DataFrame:
    """Ends less than `within` before the utterance's last end move to it."""
    last = F.max("end").over(Window.partitionBy("utt_id"))
    return intervals.withColumn("end", F.when(last - F.col("end") < within, last).otherwise(F.col("end")))


def padded(intervals: DataFrame, nudge: float = 1e-4) -> DataFrame:
    """Empty intervals at the head and the tail; a first start of 0 and a last end of `total` make room by a nudge.

    intervals: utt_id, ord, label, start, end, total.
    """
    w = Window.partitionBy("utt_id")
    is_first, is_last = F.col("ord") == F.min("ord").over(w), F.col("ord") == F.max("ord").over(w)
    return with_ends(intervals.withColumns({"is_first": is_first, "is_last": is_last}), ["utt_id"], nudge)


def with_ends(rows: DataFrame, keys: list[str], nudge: float = 1e-4) -> DataFrame:
    """keys, ord, label, start and end of `padded`, for intervals that say by is_first and is_last whether they are their sequence's ends."""
    rows = rows.withColumns({
        "start": F.when(F.col("is_first") & (F.col("start") == 0), F.col("start") + nudge).otherwise(F.col("start")),
        "end": F.when(F.col("is_last") & (F.col("end") == F.col("total")), F.col("end") - nudge).otherwise(F.col("end")),
    })
    cell = lambda ord_, label, a, b: F.struct(ord_.alias("ord"), label.alias("label"), a.alias("start"), b.alias("end"))
    own = cell(F.col("ord").cast("int"), F.col("label"), F.col("start"), F.col("end"))
    head = F.when(F.col("is_first") & (F.col("start") > 0), cell(F.col("ord").cast("int") - 1, F.lit(""), F.lit(0.0), F.col("start")))
    tail = F.when(F.col("is_last") & (F.col("end") < F.col("total")), cell(F.col("ord").cast("int") + 1, F.lit(""), F.col("end"), F.col("total")))
    return rows.select(*keys, F.explode(F.filter(F.array(head, own, tail), lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")


def frame_at(times: DataFrame, frames: DataFrame) -> DataFrame:
    """times (utt_id, ord, t) with the last frame at or before t: left_t and left_value; null before the first.

    frames: utt_id, t, value. One sort of the union by utterance and time; no range join.
    """
    stamps = frames.groupBy("utt_id", "t").agg(F.max("value").alias("value"))
    both = times.select("utt_id", "t", "ord", F.lit(None).cast("struct<t:double,value:double>").alias("frame"), F.lit(1).alias("kind")).unionByName(
        stamps.select("utt_id", "t", F.lit(None).cast("int").alias("ord"), F.struct("t", "value").alias("frame"), F.lit(0).alias("kind"))
    )
    before = Window.partitionBy("utt_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("left", F.last("frame", ignorenulls=True).over(before)).where("kind = 1")
    return got.select("utt_id", "ord", "t", F.col("left.t").alias("left_t"), F.col("left.value").alias("left_value"))


def regular_frame(t: Column, total: Column, n: Column) -> Column:
    """Index (from 0) of the frame of a regular grid that holds time t; times outside go to the edge frames."""
    return F.least(F.greatest(F.floor(t * n / total), F.lit(0)), n - 1)


def frame_on_grid(times: DataFrame, frames: DataFrame) -> DataFrame:
    """times (utt_id, t and other columns) with the frame that holds t: left_i, left_t and value. Times before the first frame or after the last go to those.

    frames: utt_id, i (0, 1, 2 ... without gaps), t, value, at regular times but for rounding. Times are compared in four decimals. The frame's number follows from
    the time, first and last frame: one equi-join by (utt_id, i) on that number and its two neighbours, no sort and no range join. Times of utterances without
    frames, and null times, have nulls.
    """
    n, first, step, guess, at, row, own = fresh(times, "n", "first", "step", "guess", "at", "row", "own")
    grid = lambda c: F.round(F.round(c, 4) * 10_000).cast("long")
    shape = frames.groupBy("utt_id").agg(F.count(F.lit(1)).alias(n), F.min("t").alias(first), ((F.max("t") - F.min("t")) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias(step))
    shape = shape.withColumnRenamed("utt_id", own)
    rows = times.withColumn(row, F.monotonically_increasing_id()).join(shape, F.col("utt_id") == F.col(own), "left").drop(own)
    place = F.coalesce(F.floor(F.try_divide(F.col("t") - F.col(first), F.col(step))), F.lit(0))
    rows = rows.withColumn(guess, F.least(F.greatest(place, F.lit(0)), F.col(n) - 1))
    near = rows.withColumn(at, F.explode(F.when(F.col(guess).isNull() | F.col("t").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.greatest(F.col(guess) - 1, F.lit(0)), F.least(F.col(guess) + 1, F.col(n) - 1)))))
    held = frames.select(F.col("utt_id").alias(own), F.col("i").cast("long").alias("left_i"), F.col("t").alias("left_t"), "value")
    both = near.join(held, (F.col("utt_id") == F.col(own)) & (F.col(at) == F.col("left_i")), "left")
    before = F.coalesce(grid(F.col("left_t")) <= grid(F.col("t")), F.lit(False))
    best = F.max(F.struct(before.alias("before"), F.when(before, F.col("left_i")).otherwise(-F.col("left_i")).alias("rank"), F.struct("left_i", "left_t", "value").alias("frame")))
    found = both.groupBy(row, *times.columns).agg(best.alias(at))
    return found.select(*times.columns, F.col(f"{at}.frame.left_i").alias("left_i"), F.col(f"{at}.frame.left_t").alias("left_t"), F.col(f"{at}.frame.value").alias("value"))


def endpoint_means(intervals: DataFrame, frames: DataFrame) -> DataFrame:
    """Mean of the frames at both ends of each interval (not of those between)."""
    ends = intervals.select("utt_id", "ord", F.explode(F.array("start", "end")).alias("t"))
    return frame_at(ends, frames).groupBy("utt_id", "ord").agg(F.avg("left_value").alias("mean_value"))
