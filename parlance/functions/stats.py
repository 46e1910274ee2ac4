"""Descriptive statistics of groups, and global ranks without a single-partition window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("number", "mean", "std", "median", "mad", "summ", "max", "min")


def described(df: DataFrame, keys: list[str], values: dict[str, Column], more: list[Column] | None = None) -> DataFrame:
    """Eight statistics of each value (population deviation, mean absolute deviation), and further aggregates.

    Null values are left out. The mean for the deviation is a window on the same keys, so there is one shuffle. A group's distinct values are held for
    its median: this is for groups of a bounded size, such as an utterance; `described_large` takes groups of any size.
    """
    w = Window.partitionBy(*keys)
    df = df.withColumns({f"_{p}": v.cast("double") for p, v in values.items()})
    df = df.withColumns({f"_{p}_mean": F.avg(f"_{p}").over(w) for p in values})
    out = list(more or [])
    for p in values:
        v = F.col(f"_{p}")
        own = (F.count(v), F.avg(v), F.stddev_pop(v), F.median(v), F.avg(F.abs(v - F.col(f"_{p}_mean"))), F.sum(v), F.max(v), F.min(v))
        out += [F.coalesce(x, F.lit(0)).alias(f"{p}_{n}") for x, n in zip(own, NAMES, strict=True)]
    return df.groupBy(*keys).agg(*out)


CUTS = (0.0, 0.25, 0.45, 0.495, 0.4995, 0.5005, 0.505, 0.55, 0.75, 1.0)  # where a median is looked for, and the ends, which always hold it
SALTS = 8


def described_large(df: DataFrame, keys: list[str], values: dict[str, Column], accuracy: int = 10_000) -> DataFrame:
    """The statistics of `described`, exact, for groups of any size: keys, and eight columns for each value.

    Nothing holds or sorts a group. Every pass is partial sums in the tasks that read the rows: the first gives means and approximate quantiles
    (`accuracy` bounds their memory), the second deviations and how many values lie under and up to each quantile, exactly. The narrowest pair of
    quantiles that holds the median by those counts is looked at once more: about a thousandth of the group, counted by value and summed up in order.
    Rows meet their group's numbers by key and one of eight salts, so a hot group is several tasks. Null keys are groups; NaN is the greatest value.
    """
    names = list(values)
    spread = [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    own = [f"v{k}" for k in range(len(names))]
    rows = df.select(F.struct(*keys).alias("key"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int").alias("salt"), *(v.cast("double").alias(o) for o, v in zip(own, values.values(), strict=True)))

    def first(o: str) -> Column:
        v = F.col(o)
        return F.struct(
            F.count(v).alias("number"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sum(v).alias("summ"), F.max(v).alias("max"), F.min(v).alias("min"),
            F.array_distinct(F.array_append(F.array_append(F.percentile_approx(v, list(CUTS), accuracy), F.min(v)), F.max(v))).alias("cuts"),
        ).alias(o)

    salted = lambda g: g.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    groups = rows.groupBy("key").agg(*map(first, own))
    near = salted(groups.select("key", *(F.struct(f"{o}.mean", f"{o}.cuts").alias(f"{o}_g") for o in own)))
    met = rows.join(near, ["key", "salt"])
    count = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    wide = len(CUTS) + 2
    second = met.groupBy("key").agg(*(
        F.struct(
            F.avg(F.abs(F.col(o) - F.col(f"{o}_g.mean"))).alias("mad"),
            F.array(*(count(F.col(o) < F.get(f"{o}_g.cuts", F.lit(k))) for k in range(wide))).alias("below"),
            F.array(*(count(F.col(o) <= F.get(f"{o}_g.cuts", F.lit(k))) for k in range(wide))).alias("upto"),
        ).alias(f"{o}_s") for o in own
    ))
    known = groups.join(second, "key")

    def bracket(o: str) -> Column:
        """The ranks of the middle, and the last cut with too few values under it up to the first with enough values up to it."""
        low, high = F.floor((F.col(f"{o}.number") + 1) / 2), F.floor(F.col(f"{o}.number") / 2) + 1
        cells = F.transform(f"{o}.cuts", lambda c, k: F.struct(c.alias("c"), F.get(f"{o}_s.below", k).alias("below"), F.get(f"{o}_s.upto", k).alias("upto")))
        start = F.array_max(F.filter(cells, lambda x: x["below"] < low))
        end = F.array_min(F.filter(cells, lambda x: x["upto"] >= high))
        return F.struct(F.lit(o).alias("name"), start["c"].alias("start"), end["c"].alias("end"), start["below"].alias("before"), low.alias("low"), high.alias("high"))

    brackets = salted(known.select("key", F.explode(F.array(*map(bracket, own))).alias("b")).select("key", "b.*").where("start IS NOT NULL"))
    each = rows.select("key", "salt", F.explode(F.array(*(F.struct(F.lit(o).alias("name"), F.col(o).alias("v")) for o in own))).alias("x")).select("key", "salt", "x.*")
    held = each.join(brackets, ["key", "salt", "name"]).where("v >= start AND v <= end")
    counted = held.groupBy("key", "name", "v").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("before", "low", "high")))  # one value of each a group
    order = Window.partitionBy("key", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("last", F.col("before") + F.sum("n").over(order))
    at = lambda rank: F.min(F.when(F.col("last") >= F.col(rank), F.col("v")))
    middle = ranked.groupBy("key", "name").agg(((at("low") + at("high")) / 2).alias("median"))
    medians = middle.groupBy("key").agg(*(F.max(F.when(F.col("name") == o, F.col("median"))).alias(f"{o}_median") for o in own))
    whole = known.join(medians, "key", "left")
    cell = lambda o, n: F.col(f"{o}_median") if n == "median" else F.col(f"{o}_s.mad") if n == "mad" else F.col(f"{o}.{n}")
    return whole.select("key.*", *(F.coalesce(cell(o, n), F.lit(0)).alias(f"{p}_{n}") for o, p in zip(own, names, strict=True) for n in NAMES))


def cut(df: DataFrame) -> DataFrame:
    """df's rows as computed now, once: in the checkpoint folder that all executors see, or with the executors where none is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def _below(cuts: list[float], value: Column) -> Column:
    """How many of the sorted cuts lie under a value; many cuts in two steps, each of about their root."""
    if len(cuts) > 64:
        step = math.isqrt(len(cuts))
        coarse = cuts[step - 1 :: step]
        block = F.size(F.filter(F.lit(coarse), lambda c: c < value))
        inner = F.slice(F.lit(cuts), block * step + 1, F.lit(step))
        return block * step + F.size(F.filter(inner, lambda c: c < value))
    return F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<double>"), lambda c: c < value))


def running_count(df: DataFrame, order: str, count: Column, name: str, bucket_rows: int = 100_000) -> DataFrame:
    """df with the sum of `count` over all rows of smaller or equal `order` (numeric, no ties).

    Rows go to buckets of about `bucket_rows` between approximate quantiles (at most 10,000 buckets); running sums inside buckets start at
    the sum of the buckets before, a table of one row for each bucket.
    """
    buckets = max(8, min(10_000, -(-df.count() // bucket_rows)))
    cuts = sorted(set(df.approxQuantile(order, [k / buckets for k in range(1, buckets)], 0.1 / buckets)))
    bucket = _below(cuts, F.col(order).cast("double"))
    df = df.withColumns({"_bucket": bucket, "_count": count})
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("_bucket").agg(F.sum("_count").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_inside", F.sum("_count").over(inside)).join(F.broadcast(starts), "_bucket")  # at most `buckets` rows
    return summed.withColumn(name, F.col("_start") + F.col("_inside")).drop("_bucket", "_count", "_inside", "_start")


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the rank of a numeric value from 1, ties at their mean rank."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_ties"))
    ranked = running_count(counts, value, F.col("_ties"), "_last")
    return df.join(ranked.select(value, (F.col("_last") - (F.col("_ties") - 1) / 2).alias(name)), value)
