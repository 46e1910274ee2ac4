"""Score arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def pronunciation(raw: Column, silent: Column | None = None) -> Column:
    """200 times the sigmoid; a fifth of it where the predicted phone is silence."""
    score = sigmoid(raw) * 200
    return score if silent is None else F.when(silent, score * 0.2).otherwise(score)


def doubled(raw: Column) -> Column:
    """0 to 2; at most 1 for raw scores up to 0."""
    return sigmoid(raw) * 2


def confidence(score: Column) -> Column:
    return F.least(F.greatest(F.round(score / 100, 4), F.lit(0.0)), F.lit(1.0))


def duration_fluency(z: Column) -> Column:
    """100 at an average duration, 0 from 50/13 deviations on; null z (no statistics) is 0."""
    return F.coalesce(130 - 150 / (5 - F.least(F.abs(z), F.lit(50 / 13))), F.lit(0.0))
