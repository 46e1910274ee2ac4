"""Rhythm of vowel and consonant intervals: 31 measures of an utterance in one pass of windows and one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import phone_class


def _variability(d: Column, after: Column, length: Column, after_length: Column) -> tuple[Column, Column, Column]:
    gap = F.abs(after - d)
    return gap, gap / ((after + d) / 2), F.abs(after / after_length - d / length)


def rhythm_features(phones: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the measures; utterances without vowels or without consonants have zeros and status 0.

    phones: keys, ord, phone (normal form), dur in seconds. Means divide by n - 1 (n at least 2), deviations are about those
    means, and all pairwise indices divide by the phones less one.
    """
    cls = phone_class(F.col("phone"))
    rows = phones.withColumn("cls", cls).where("cls <> 'O'").withColumn("len", F.length("phone"))
    every, same = Window.partitionBy(*keys).orderBy("ord"), Window.partitionBy(*keys, "cls").orderBy("ord")
    rows = rows.withColumns({"d2": F.lead("dur").over(every), "l2": F.lead("len").over(every), "s2": F.lead("dur").over(same), "sl2": F.lead("len").over(same)})
    terms = {}
    for k, (a, b) in {"": ("d2", "l2"), "_s": ("s2", "sl2")}.items():
        for name, x in zip(("rpvi", "npvi", "cci"), _variability(F.col("dur"), F.col(a), F.col("len"), F.col(b)), strict=True):
            terms[f"{name}{k}"] = x
    rows = rows.withColumns(terms)
    ms = F.col("dur") * 1000
    of = lambda k, x: x if k == "p" else F.when(F.col("cls") == k.upper(), x)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    aggs = []
    for k in "pvc":
        aggs += [F.count(of(k, F.col("dur"))).alias(f"n_{k}"), zero(F.sum(of(k, F.col("dur")))).alias(f"s_{k}"), zero(F.sum(of(k, ms * ms))).alias(f"q_{k}")]
        aggs += [zero(F.sum(of(k, F.col(t if k == "p" else f"{t}_s")))).alias(f"{t}_sum_{k}") for t in ("rpvi", "npvi", "cci")]
    got = rows.groupBy(*keys).agg(*aggs)
    c = F.col
    got = got.withColumns({f"m_{k}": F.greatest(c(f"n_{k}"), F.lit(2)) for k in "pvc"})
    got = got.withColumns({f"mean_{k}_dur": c(f"s_{k}") * 1000 / (c(f"m_{k}") - 1) for k in "pvc"})
    spread = {f"v_{k}": F.greatest(c(f"q_{k}") - 2 * c(f"mean_{k}_dur") * c(f"s_{k}") * 1000 + c(f"n_{k}") * c(f"mean_{k}_dur") * c(f"mean_{k}_dur"), F.lit(0.0)) for k in "pvc"}
    got = got.withColumns(spread)
    got = got.withColumns({f"{k}_std_dev": F.sqrt(c(f"v_{k}") / (c(f"m_{k}") - 1)) for k in "pvc"})
    out = {
        "num_nucleus": c("n_v"), "num_consonants": c("n_c"), "v_to_c_ratio": F.try_divide(c("n_v"), c("n_c")), "phones_num": c("m_p"), "v_num": c("m_v"), "c_num": c("m_c"),
        "sum_dur_sec": c("s_p"), "v_sum_dur_sec": c("s_v"), "c_sum_dur_sec": c("s_c"), "mean_p_dur": c("mean_p_dur"), "mean_v_dur": c("mean_v_dur"), "mean_c_dur": c("mean_c_dur"), "p_sum_variance": c("v_p"),
        "p_std_dev": c("p_std_dev"), "v_std_dev": c("v_std_dev"), "c_std_dev": c("c_std_dev"), "varco_P": F.try_divide(c("p_std_dev"), c("mean_p_dur")) * 100, "varco_V": F.try_divide(c("v_std_dev"), c("mean_v_dur")) * 100, "varco_C": F.try_divide(c("c_std_dev"), c("mean_c_dur")) * 100,
        "percent_v": F.try_divide(c("s_v"), c("s_p")) * 100, "speech_rate": F.try_divide(c("n_v"), c("s_p")),
        **{t + ("" if k == "p" else f"_{k}"): c(f"{t}_sum_{k}") / (c("m_p") - 1) for t in ("rpvi", "npvi", "cci") for k in "pvc"}, "status": F.lit(1),
    }
    both = (c("n_v") > 0) & (c("n_c") > 0)
    measured = got.select(*keys, *(F.coalesce(F.when(both, x), F.lit(0)).cast("double").alias(n) for n, x in out.items()))
    spine = phones.select(*keys).distinct()
    return spine.join(measured, keys, "left").fillna(0.0, list(out))
