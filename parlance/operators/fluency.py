"""Silences, words and repeats of aligned utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import described
from ..functions.text import BASELINE_WORDS, DISFLUENT_WORDS, PHRASES, SILENT_PHONES, normal_phone, phrase_count

SILENCE, LONG_SILENCE = 0.145, 0.495


def _response() -> Column:
    return (F.max_by(F.col("start") + F.col("dur"), "ord") - F.min_by("start", "ord")).alias("response_duration")


def silence_features(ctm: DataFrame) -> DataFrame:
    """Statistics of pauses between words, and of long ones; utterances of up to two words have none.

    Response duration is the end of the last word less the start of the first. Rates divide by it and by the words; rates of
    a response without duration are null.
    """
    w = Window.partitionBy("utt_id").orderBy("ord")
    gap = F.when((F.count("*").over(Window.partitionBy("utt_id")) > 2), F.col("start") - F.lag(F.col("start") + F.col("dur")).over(w))
    rows = ctm.withColumn("gap", gap)
    sil, long = (F.when(F.col("gap") > t, F.col("gap")) for t in (SILENCE, LONG_SILENCE))
    out = described(rows, ["utt_id"], {"sil": sil, "long_sil": long}, [_response(), F.count("*").alias("words")])
    rates = {f"{p}_rate{k}": F.try_divide(F.col(f"{p}_number"), by) for p in ("sil", "long_sil") for k, by in ((1, F.col("response_duration")), (2, F.col("words")))}
    return out.withColumns(rates).drop("words")


def word_features(ctm: DataFrame) -> DataFrame:
    """Counts, rates, disfluent words, repeats, and statistics of durations and confidences."""
    repeat = F.lag("label").over(Window.partitionBy("utt_id").orderBy("ord")) == F.col("label")
    more = [
        _response(), F.count("*").alias("word_count"), F.count_distinct("label").alias("word_distinct"), F.count_if("repeat").alias("word_num_repeat"),
        F.count_if(F.col("label").isin(*DISFLUENT_WORDS)).alias("word_num_disfluency"), F.count_if(F.col("label").isin(*BASELINE_WORDS)).alias("word_num_disfluency_baseline"),
    ]
    out = described(ctm.withColumn("repeat", repeat), ["utt_id"], {"word_duration": F.col("dur"), "word_conf": F.col("conf")}, more)
    return out.withColumn("word_freq", F.try_divide(F.col("word_count"), F.col("response_duration")))


def phone_features(ctm: DataFrame) -> DataFrame:
    """Counts, rate and statistics of phones."""
    out = described(ctm, ["utt_id"], {"phone_duration": F.col("dur"), "phone_conf": F.col("conf")}, [_response(), F.count("*").alias("phone_count")])
    return out.withColumn("phone_freq", F.try_divide(F.col("phone_count"), F.col("response_duration"))).drop("response_duration")


def phrase_features(words: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the disfluency phrases in the joined words of each key."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]), " ")
    return words.groupBy(*keys).agg(text.alias("text")).select(*keys, *(phrase_count(F.col("text"), p).alias(p.replace(" ", "_")) for p in PHRASES))


def repeats(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words, distinct words and immediate repeats."""
    w = Window.partitionBy(*keys).orderBy("ord")
    return words.withColumn("repeat", F.lag("label").over(w) == F.col("label")).groupBy(*keys).agg(F.count("*").alias("n_words"), F.count_distinct("label").alias("n_distinct"), F.count_if("repeat").alias("n_repeats"))


def without_labels(ctm: DataFrame, labels: list[str]) -> DataFrame:
    """A word table without special words; places (`ord`) stay, so scores of the same places can still be joined."""
    return ctm.where(~F.col("label").isin(labels))


def spoken_phones(ctm: DataFrame, label: str = "label", silent: tuple[str, ...] = SILENT_PHONES) -> DataFrame:
    """A phone table without silences: compared in lower case, without position tags and stress digits."""
    return ctm.where(~normal_phone(F.col(label)).isin(*silent))


def special_only(words: DataFrame, special: list[str]) -> DataFrame:
    """Utterances of nothing but special words."""
    return words.groupBy("utt_id").agg(F.count_if(F.col("label").isin(special)).alias("s"), F.count("*").alias("n")).where("s = n").select("utt_id")
