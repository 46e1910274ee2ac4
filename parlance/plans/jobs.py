"""Composed jobs: what a user runs from loaded tables to the final lists, each one call over the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import alignment, combine, features, fluency, pronunciation, regression, vocabulary
from ..sources import adapters as A
from .catalog import ALIGNED, CTM, GOP, RATES, SPLIT, SQL, WER_STEPS, WORDS, _ctm, _gop, _pairs, _words, query, rounded


def feature_table(ctm: DataFrame, scales: DataFrame) -> DataFrame:
    """Word and silence features of every utterance with its level, from a word table and (utt_id, scale).

    Where the reference's users split a list of utterances over jobs and merge the parts, Spark deals the utterances to tasks: one plan, one scan.
    """
    parts = [rounded(f(ctm), nudge=1e-9) for f in (fluency.word_features, fluency.silence_features)]
    return features.feature_rows(scales, parts)


def regression_lists(table: DataFrame, names: list[str]) -> DataFrame:
    """Each feature against the level: slope, intercept, R2, RMSE and accuracies. Rows without a level are left out."""
    return regression.feature_regression(table.where("level is not null").select(*(F.col(n).cast("double").alias(n) for n in names), "level"), names, "level")


def frequency_lists(texts: DataFrame, by: str, everything: str = "all") -> DataFrame:
    """Words of each set and of all sets, by one scan: rows are counted by set and word, and the counts are summed again for all."""
    counts = texts.select(F.col(by).alias("part"), F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("part", "token").agg(F.count("*").alias("n"))
    whole = counts.groupBy("token").agg(F.sum("n").alias("n")).select(F.lit(everything).alias("part"), "token", "n")
    return counts.unionByName(whole)


def disfluency_by_scale(utts: DataFrame, total: str) -> DataFrame:
    """Utterances and disfluencies of each level, in the order of the scale; ids without a level fall out. utts: id and a count."""
    rows = utts.withColumn("level", T.level_from_id(F.col("id"))).where("level is not null")
    got = rows.groupBy("level").agg(F.count("*").alias("n_utts"), F.sum(total).alias("total"))
    return got.withColumns({"ordinal": T.lookup(T.SCALE_EIGHT, F.upper("level")), "per_utt": F.col("total") / F.col("n_utts")})


def grader_rows(sets: list[DataFrame], l1: str = "italiano") -> DataFrame:
    """The table of a grader over all sets: id, score, sst, l1 and text; sets with other columns are an error."""
    whole = combine.united(sets, ["id", "score", "text"])
    return whole.select("id", "score", F.lit(None).cast("double").alias("sst"), F.lit(l1).alias("l1"), "text")


def gop_correlation(words: DataFrame, annotated: DataFrame, keys: list[str]) -> DataFrame:
    """Spearman correlation of word scores with annotated scores (keys, anno), over words that both have."""
    both = pronunciation.word_scores(words).join(annotated, keys)
    return regression.spearman(both, "score", "anno")


@query(SQL["feature_rows"])
def feature_job(spark, d):
    """The feature table of all utterances."""
    number = F.col("utt_id") % 5
    scale = F.when(number == 0, "a1").when(number == 1, "A2").when(number == 2, "b1+").when(number == 3, "B2").otherwise("preA1")
    ctm = _ctm(spark, d)
    return feature_table(ctm, ctm.select("utt_id").distinct().withColumn("scale", scale))


_NAMES = ["word_count", "word_distinct", "sil_number", "word_duration_mean"]


@query(f"""WITH r AS ({SQL["feature_rows"]}), u AS (UNPIVOT (SELECT level AS y, {", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in _NAMES)} FROM r WHERE level IS NOT NULL) ON {", ".join(_NAMES)} INTO NAME feature VALUE x),
f AS (SELECT feature, CASE WHEN var_pop(x) > 0 THEN covar_pop(y, x) / var_pop(x) ELSE 0 END AS slope, avg(x) AS mx, avg(y) AS my, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN covar_pop(y, x) * covar_pop(y, x) / (var_pop(x) * var_pop(y)) END AS r2 FROM u GROUP BY feature),
e AS (SELECT feature, slope, my - slope * mx AS intercept, r2, abs(slope * x + my - slope * mx - y) AS e FROM u JOIN f USING (feature))
SELECT feature, round(any_value(slope), 6) + 0.0 AS slope, round(any_value(intercept), 6) AS intercept, round(any_value(r2), 6) AS r2, round(sqrt(avg(e * e)), 6) AS rmse,
round(avg(CAST(e <= 0.5 AS INTEGER)) * 100, 6) AS accuracy_0_5, round(avg(CAST(e <= 1 AS INTEGER)) * 100, 6) AS accuracy_1_0 FROM e GROUP BY feature""")
def regression_job(spark, d):
    """From the word table to the regression list."""
    from .catalog import feature_rows

    return rounded(regression_lists(feature_rows(spark, d), _NAMES))


@query(f"""WITH t AS (SELECT lang AS part, unnest({WORDS.format('text')}) AS token FROM documents) SELECT part, token, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'all', token, count(*) FROM t GROUP BY token""")
def frequency_job(spark, d):
    """B13."""
    return frequency_lists(A.table(spark, d, "documents"), "lang")


_IDS = "'TLT-x_' || CASE user_id % 4 WHEN 0 THEN 'A1' WHEN 1 THEN 'A2' WHEN 2 THEN 'B1' ELSE 'C1' END"


@query(f"""WITH u AS (SELECT {_IDS} AS id, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY user_id), l AS (SELECT *, split_part(split_part(id, '-', 2), '_', 2) AS level FROM u WHERE regexp_matches(id, 'A1|A2|B1'))
SELECT level, count(*) AS n_utts, CAST(sum(n) AS BIGINT) AS total, CASE level WHEN 'A1' THEN 1 WHEN 'A2' THEN 3 WHEN 'B1' THEN 5 END AS ordinal, round(sum(n) / count(*), 6) AS per_utt FROM l GROUP BY level""")
def disfluency_job(spark, d):
    """B10, P11."""
    number = F.col("user_id") % 4
    level = F.when(number == 0, "A1").when(number == 1, "A2").when(number == 2, "B1").otherwise("C1")
    utts = A.table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n")).withColumn("id", F.concat(F.lit("TLT-x_"), level))
    return rounded(disfluency_by_scale(utts, "n"))


@query("SELECT doc_id AS id, CAST(quality AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS sst, 'italiano' AS l1, md5(text) AS text_md5 FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL")
def grader_job(spark, d):
    """The sets of two corpora in one table."""
    rows = A.table(spark, d, "documents").join(A.table(spark, d, "labels").select("doc_id", "quality"), "doc_id").where("text is not null")
    rows = rows.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"), "text")
    got = grader_rows([rows.where("id % 3 = 0"), rows.where("id % 3 <> 0").select("text", "id", "score")])
    return got.withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


@query(f"""WITH {GOP}, {SPLIT}, s AS (SELECT utt_id, word_ord, avg(CASE WHEN silent THEN 40 / (1 + exp(-raw)) ELSE 200 / (1 + exp(-raw)) END) AS score, count(*) FILTER (correct) AS anno FROM word GROUP BY ALL),
r AS (SELECT rank() OVER (ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY round(score, 9)) - 1) / 2.0 AS rx, rank() OVER (ORDER BY anno) + (count(*) OVER (PARTITION BY anno) - 1) / 2.0 AS ry FROM s)
SELECT round(covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)), 4) AS rho, count(*) AS n FROM r""")
def gop_job(spark, d):
    """From scored phones to the correlation with the annotation."""
    both = pronunciation.word_scores(_words(spark, d), [F.count_if("correct").alias("anno")]).withColumn("score", F.round("score", 9))
    return rounded(regression.spearman(both, "score", "anno"), 4)


@query(f"""{ALIGNED}, fd AS ({RATES}), {WER_STEPS}
SELECT w.conv_id, w.turn, edits, ref_words, round(edits / nullif(ref_words, 0), 6) AS wer, fer, der FROM wer w LEFT JOIN fd USING (conv_id, turn)""")
def error_rate_job(spark, d):
    """All three rates of each pair, from one pass over the pairs."""
    return rounded(alignment.error_rates(_pairs(spark, d), ["conv_id", "turn"]))
