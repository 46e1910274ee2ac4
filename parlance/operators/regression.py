"""Least squares of a target on each feature, and rank correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import cut, running_count


def feature_regression(df: DataFrame, features: list[str], target: str, margins: tuple[float, ...] = (0.5, 1.0)) -> DataFrame:
    """A row for each feature: slope, intercept, r2, rmse, accuracy within margins in percent.

    A constant feature predicts the mean: slope 0, r2 null. Two passes over the unpivoted table: fit, then errors.
    """
    rows = df.select(F.col(target).cast("double").alias("y"), *(F.col(f).cast("double").alias(f) for f in features)).unpivot("y", features, "feature", "x").where("x is not null and y is not null")
    fit = rows.groupBy("feature").agg(F.covar_pop("x", "y").alias("cov"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    slope = F.coalesce(F.try_divide(F.col("cov"), F.when(F.col("vx") > 0, F.col("vx"))), F.lit(0.0))
    fit = fit.withColumns({"slope": slope, "r2": F.try_divide(F.col("cov") * F.col("cov"), F.when(F.col("vx") > 0, F.col("vx")) * F.when(F.col("vy") > 0, F.col("vy")))})
    fit = fit.select("feature", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "r2")
    error = F.abs(F.col("slope") * F.col("x") + F.col("intercept") - F.col("y"))
    within = [(F.avg((F.col("e") <= m).cast("double")) * 100).alias(f"accuracy_{str(m).replace('.', '_')}") for m in margins]
    errors = rows.join(F.broadcast(fit), "feature").withColumn("e", error)  # a row for each feature
    return errors.groupBy("feature").agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.first("r2").alias("r2"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), *within)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns (null for a constant one) and the rows.

    df is computed once: its pairs are counted and kept, ranks come from the counts of each side's values, and every pair weighs as many rows as it has.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    pairs = cut(rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    met = pairs.crossJoin(F.broadcast(pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))))  # one row
    for side in ("x", "y"):
        counts = pairs.groupBy(side).agg(F.sum("n").alias("ties"))
        ranked = running_count(counts, side, F.col("ties"), "last").select(side, (F.col("last") - (F.col("ties") - 1) / 2).alias(f"r{side}"))
        met = met.join(ranked, side).withColumn(f"d{side}", F.col(f"r{side}") - (F.col("all") + 1) / 2)  # from the mean rank: whole halves
    total = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    got = met.agg(total("dx", "dy").alias("c"), total("dx", "dx").alias("vx"), total("dy", "dy").alias("vy"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return got.select(F.try_divide(F.col("c"), F.sqrt(F.col("vx")) * F.sqrt(F.col("vy"))).alias("rho"), "n")
