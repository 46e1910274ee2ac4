"""The wide feature row of an utterance, and frame-based (F0, energy) features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import described
from ..functions.text import SCALE_EIGHT, lookup


def frame_features(frames: DataFrame) -> DataFrame:
    """Statistics of F0 (all frames, unvoiced NaN as 0; and those above 0) and of energy: utt_id, i, f0, energy."""
    f0 = F.coalesce(F.when(F.isnan("f0"), 0.0).otherwise(F.col("f0")), F.lit(0.0))
    return described(frames, ["utt_id"], {"f0": f0, "f0_nz": F.when(f0 != 0, f0), "energy": F.col("energy")})


def feature_rows(utterances: DataFrame, parts: list[DataFrame], scale: dict[str, int] | None = None) -> DataFrame:
    """One row for each utterance: all columns of the parts, 0 where a number is missing, and level.

    utterances: utt_id and scale. The scale is looked up in upper case; an unknown one gives a null level. All parts are keyed by
    utt_id, so their aggregates and these joins share one partitioning.
    """
    wide = reduce(lambda a, b: a.join(b.drop(*(set(a.columns) & set(b.columns) - {"utt_id"})), "utt_id", "left"), parts, utterances)
    numbers = [c for c, t in wide.dtypes if c not in utterances.columns and t not in ("string",)]
    return wide.fillna(0, numbers).withColumn("level", lookup(scale or SCALE_EIGHT, F.upper("scale")).cast("double")).drop("scale")


def flattened(records: DataFrame, columns: list[str], nested: str, nested_columns: list[str]) -> DataFrame:
    """Fixed columns of a record with a nested struct: missing scalars are 0, missing nested fields null."""
    has = set(records.columns)
    inner = set(records.schema[nested].dataType.names) if nested in has else set()
    outer = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in has else F.lit(0.0).alias(c) for c in columns]
    return records.select("utt_id", *outer, *(F.col(f"{nested}.{c}").alias(c) if c in inner else F.lit(None).cast("double").alias(c) for c in nested_columns))
