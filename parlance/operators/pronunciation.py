"""Scores of phones and words, thresholds, and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import doubled, duration_fluency, pronunciation

STEPS = 10


def segment_words(phones: DataFrame, keys: list[str], last: Column) -> DataFrame:
    """word_ord of each phone, where `last` marks the last phone of a word."""
    before = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return phones.withColumn("word_ord", F.coalesce(F.sum(last.cast("int")).over(before), F.lit(0)))


def word_scores(phones: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """Mean phone score of each word, and further aggregates of its phones; phones of predicted silence count a fifth."""
    rows = phones.withColumn("score", pronunciation(F.col("raw"), F.col("silent")))
    return rows.groupBy("utt_id", "word_ord").agg(F.avg("score").alias("score"), F.count("*").alias("n_phones"), *(more or []))


def duration_statistics(phones: DataFrame) -> DataFrame:
    return phones.groupBy("phone").agg(F.avg("dur").alias("mean"), F.stddev_pop("dur").alias("std"))


def word_fluency(phones: DataFrame, statistics: DataFrame) -> DataFrame:
    """Mean fluency of each word by how far its phones' durations lie from their usual ones; silence and unknown phones are 0."""
    z = F.try_divide(F.col("dur") - F.col("mean"), F.col("std"))
    rows = phones.join(statistics, "phone", "left").withColumn("fluency", F.when(F.col("silent"), 0.0).otherwise(duration_fluency(z)))
    return rows.groupBy("utt_id", "word_ord").agg(F.avg(F.abs("fluency")).alias("fluency"))


def positional_join(left: DataFrame, right: DataFrame, keys: list[str], order: str, other: str) -> DataFrame:
    """Rows of equal place in two sequences, their labels, and whether these agree.

    right must have a column `other` for its label; places are numbered anew, so both sides may be filtered before.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    a, b = (df.withColumn("place", F.row_number().over(w)) for df in (left, right))
    return a.join(b.select(*keys, "place", other), [*keys, "place"]).withColumn("agree", F.col("label") == F.col(other))


def scored_phones(phones: DataFrame, scores: DataFrame, keys: list[str], ignored: list[str]) -> DataFrame:
    """Phones and scores of equal place (keys, ord), without those phones that do not count; what is left is numbered anew as `place`.

    phones: keys, ord, label. scores: keys, ord, gop. Both sides lose a row together, so they stay aligned.
    """
    both = phones.join(scores.select(*keys, "ord", "gop"), [*keys, "ord"]).where(~F.col("label").isin(ignored))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")))


def _f1(hit: Column, false: Column, missed: Column) -> Column:
    return F.coalesce(F.try_divide(2 * hit, 2 * hit + false + missed), F.lit(0.0))


def confusion(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1 and support of both classes, weighted F1 and accuracy."""
    pos, neg = tp + fn, tn + fp
    f_pos, f_neg = _f1(tp, fp, fn), _f1(tn, fn, fp)
    part = lambda a, b: F.coalesce(F.try_divide(a, a + b), F.lit(0.0))
    return {
        "precision_1": part(tp, fp), "recall_1": part(tp, fn), "f1_1": f_pos, "support_1": pos, "precision_0": part(tn, fn), "recall_0": part(tn, fp), "f1_0": f_neg, "support_0": neg,
        "weighted_f1": F.coalesce(F.try_divide(f_pos * pos + f_neg * neg, pos + neg), F.lit(0.0)), "accuracy": F.coalesce(F.try_divide(tp + tn, pos + neg), F.lit(0.0)),
    }


def threshold_search(scored: DataFrame, key: str = "phone") -> DataFrame:
    """For each key the step k of the cut-off k / 10 with the best weighted F1; ties go nearest to 5.

    scored: key, gop (doubled sigmoid), correct. Rows are reduced to how many cut-offs each passes before the eleven cut-offs
    multiply anything.
    """
    passed = sum((F.col("gop") >= F.lit(k * 0.1)).cast("int") for k in range(STEPS + 1))
    counts = scored.groupBy(key, passed.alias("passed"), "correct").agg(F.count("*").alias("n"))
    each = counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(STEPS))))
    yes = F.col("passed") > F.col("k")
    count = lambda x: F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0))
    rows = each.groupBy(key, "k").agg(count(yes & F.col("correct")).alias("tp"), count(yes & ~F.col("correct")).alias("fp"), count(~yes & F.col("correct")).alias("fn"), count(~yes & ~F.col("correct")).alias("tn"))
    rows = rows.withColumn("f1", F.round(confusion(*map(F.col, ("tp", "fp", "fn", "tn")))["weighted_f1"], 12))
    best = Window.partitionBy(key).orderBy(F.desc("f1"), F.abs(F.col("k") - 5), "k")
    return rows.withColumn("r", F.row_number().over(best)).where("r = 1").select(key, "k", "f1")


def apply_thresholds(scored: DataFrame, thresholds: DataFrame, fallback: DataFrame, key: str = "phone") -> DataFrame:
    """scored with the prediction under its key's cut-off; keys unseen in tuning take `fallback`."""
    both = scored.join(thresholds.select(key, "k"), key, "left").join(fallback.select(key, F.col("k").alias("k2")), key, "left")
    return both.withColumn("predicted", F.col("gop") >= F.coalesce("k", "k2") * F.lit(0.1)).drop("k", "k2")


def report(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts and the measures on them."""
    t, p = F.col("correct"), F.col("predicted")
    got = predicted.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return got.withColumns(confusion(*map(F.col, ("tp", "fp", "fn", "tn"))))


def extremes(reported: DataFrame, key: str = "utt_id") -> DataFrame:
    """The best and the worst by accuracy; ties by key."""
    best, worst = (F.min_by(key, F.struct((F.col("accuracy") * s).alias("a"), key)) for s in (-1, 1))
    return reported.agg(best.alias("best"), F.max("accuracy").alias("best_accuracy"), worst.alias("worst"), F.min("accuracy").alias("worst_accuracy"))


def sweep(pairs: DataFrame, cuts: list[int]) -> DataFrame:
    """Reports of `pred > cut` against `anno > 1` for several cut-offs; pred is truncated to an integer."""
    rows = pairs.withColumn("pred", F.col("pred").cast("int")).groupBy("pred", "anno").agg(F.count("*").alias("n"))
    rows = rows.withColumn("cut", F.explode(F.array(*map(F.lit, cuts))))
    yes, true = F.col("pred") > F.col("cut"), F.col("anno") > 1
    count = lambda x: F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0))
    got = rows.groupBy("cut").agg(count(yes & true).alias("tp"), count(yes & ~true).alias("fp"), count(~yes & true).alias("fn"), count(~yes & ~true).alias("tn"))
    return got.withColumns(confusion(*map(F.col, ("tp", "fp", "fn", "tn"))))


def doubled_scores(phones: DataFrame) -> DataFrame:
    return phones.withColumn("gop", doubled(F.col("raw")))
