"""Named queries over the test tables, each with the DuckDB SQL it is held against where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import confidence, pronunciation
from ..functions.stats import NAMES, described_large
from ..operators import alignment, combine, features, fluency, intervals, pronunciation as gop, regression, rhythm, vocabulary, vowels
from ..sources import adapters as A, textgrid
from ..streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, so that sums in another order give the same value; negative zero is zero.

    nudge moves values that lie halfway, such as means of decimals, off the edge, where two engines may round differently.
    """
    return df.withColumns({c: F.round(F.col(c) + nudge, places) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


# Fragments of SQL that mirror sources.adapters.
WORDS = "list_filter(string_split_regex(coalesce({0}, ''), '\\s+'), lambda x: x <> '')"
CONV = f"""conv AS (SELECT conv_id, turn, unnest(w) AS label, unnest(range(1, len(w) + 1)) AS ord FROM (SELECT conv_id, turn, {WORDS.format("text")} AS w FROM conversations))"""
MARKED = """marked AS (SELECT conv_id, turn, ord, CASE WHEN ord % 17 = 0 THEN '@uh' WHEN ord % 19 = 0 THEN '@ns' WHEN ord % 23 = 0 THEN label || '-'
  WHEN ord % 29 = 0 THEN 'well' WHEN ord % 31 = 0 THEN 'you' WHEN ord % 31 = 1 AND ord > 1 THEN 'know' ELSE label END AS label FROM conv)"""
CTM = """ctm AS (SELECT user_id AS utt_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS ord, event_type AS label,
  (epoch_us(ts) / 1e6 - 1704067200) / 86400 AS start, value / 86400 AS dur, least(greatest(value / 100, 0.0), 1.0) AS conf FROM events)"""
GOP = """gop AS (SELECT l_orderkey AS utt_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, l_returnflag AS phone,
  l_discount * -40 AS raw, l_linestatus = 'O' AS correct, l_quantity / 10 AS dur, l_tax = 0 AS silent FROM lineitem)"""
SPLIT = """word AS (SELECT *, CAST(coalesce(sum(CAST(ord % 3 = 0 AS INTEGER)) OVER (PARTITION BY utt_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS word_ord FROM gop)"""


def _stats_sql(value: str, prefix: str) -> str:
    """The eight statistics; {value}_m must be the group's mean."""
    v = value
    body = (f"count({v})", f"avg({v})", f"stddev_pop({v})", f"median({v})", f"avg(abs({v} - {v}_m))", f"sum({v})", f"max({v})", f"min({v})")
    return ", ".join(f"coalesce({x}, 0) AS {prefix}_{n}" if n == "number" else f"round(coalesce({x}, 0) + 1e-9, 6) + 0.0 AS {prefix}_{n}" for x, n in zip(body, NAMES, strict=True))


def _conv(spark: SparkSession, d: str) -> DataFrame:
    return A.words_of(A.table(spark, d, "conversations"), ["conv_id", "turn"])


def _ctm(spark: SparkSession, d: str) -> DataFrame:
    return A.word_ctm(A.table(spark, d, "events"))


def _gop(spark: SparkSession, d: str) -> DataFrame:
    return A.gop_raw(A.table(spark, d, "lineitem"))


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    words = A.table(spark, d, "benchmark").select(F.explode(T.tokens(F.lower("text"))).alias("word")).distinct()
    return vocabulary.letter_phones(words)


LEX = f"lex AS (SELECT DISTINCT unnest({WORDS.format('lower(text)')}) AS word FROM benchmark)"
DOCW = f"docw AS (SELECT doc_id, unnest(w) AS label, unnest(range(1, len(w) + 1)) AS ord FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents))"


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS token FROM documents) GROUP BY token")
def word_frequency(spark, d):
    """A11, O1."""
    return vocabulary.word_frequency(A.table(spark, d, "documents"))


@query(f"SELECT lang, quality, token, count(*) AS n FROM (SELECT lang, quality, unnest({WORDS.format('text')}) AS token FROM documents JOIN labels USING (doc_id) WHERE lower(lang) <> 'xx') GROUP BY ALL")
def word_frequency_by_lang(spark, d):
    """A11, P9, J4."""
    rows = A.table(spark, d, "documents").join(A.table(spark, d, "labels").select("doc_id", "quality"), "doc_id").where(F.lower("lang") != "xx")
    return vocabulary.word_frequency(rows, ["lang", "quality"])


@query(f"SELECT token, n FROM (SELECT token, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS token FROM documents) GROUP BY token) ORDER BY n DESC, token LIMIT 17")
def top_words(spark, d):
    """O2: the numbers of a top-17 chart."""
    return vocabulary.word_frequency(A.table(spark, d, "documents")).limit(17)


@query("""SELECT source, part, count(*) AS n_utts, any_value(label) AS label, md5(string_agg(coalesce(text, ''), ' ' ORDER BY doc_id)) AS text_md5
FROM (SELECT source, doc_id, text, doc_id // 100 AS part, first_value(lang) OVER (PARTITION BY source ORDER BY doc_id) AS label FROM documents) GROUP BY source, part""")
def speaker_rollup(spark, d):
    """In parts that do not grow with the speaker."""
    rolled = vocabulary.rolled_up(A.table(spark, d, "documents"), "source", "doc_id", F.coalesce("text", F.lit("")), "lang", 100)
    return rolled.select("source", "part", "n_utts", "label", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT doc_id, quality, lang FROM documents JOIN labels USING (doc_id)")
def labelled_utts(spark, d):
    """Every key must have a label, or the query fails."""
    labels = A.table(spark, d, "labels").select("doc_id", "quality")
    docs = A.table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"))
    return vocabulary.first_labels(labels, docs, "doc_id").withColumnRenamed("label", "lang")


@query(f"WITH {LEX} SELECT DISTINCT word FROM (SELECT unnest({WORDS.format('lower(text)')}) AS word FROM documents) WHERE word NOT IN (SELECT word FROM lex)")
def vocab_oov(spark, d):
    """J8, P8."""
    return vocabulary.missing_words(A.table(spark, d, "documents"), _lexicon(spark, d))


@query(f"WITH {LEX}, {DOCW} SELECT doc_id, arg_min(lower(label), ord) AS first_oov, count(*) AS n_oov FROM docw WHERE lower(label) NOT IN (SELECT word FROM lex) GROUP BY doc_id")
def oov_utterances(spark, d):
    """P6, P7."""
    return vocabulary.first_missing(A.words_of(A.table(spark, d, "documents"), ["doc_id"]), _lexicon(spark, d), ["doc_id"])


@query(f"""WITH {LEX}, {DOCW} SELECT doc_id, md5(string_agg(CASE WHEN lower(label) IN (SELECT word FROM lex) THEN lower(label) ELSE '<UNK>' END, ' ' ORDER BY ord)) AS text_md5 FROM docw GROUP BY doc_id""")
def replace_oov(spark, d):
    """The case vote is over all texts; the SQL takes it to be lower."""
    docs = A.table(spark, d, "documents")
    upper = vocabulary.upper_share(docs).first()["upper"]
    out = vocabulary.replace_missing(docs, _lexicon(spark, d), ["doc_id"], upper)
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _marked_arrays(spark, d):
    rows = A.marked(_conv(spark, d)).groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("ord", "label"))).alias("w"))
    return rows.select("conv_id", "turn", F.transform("w", lambda x: x["label"]).alias("w"))


_ARR = f"WITH {CONV}, {MARKED}, arr AS (SELECT conv_id, turn, list(label ORDER BY ord) AS w FROM marked GROUP BY ALL)"
_MAP = "CASE lower(x) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.INTERREGNUM.items()) + " ELSE x END"
_MARKS = ", ".join(f"'{k}'" for k in T.INTERREGNUM)


@query(f"""{_ARR}, f1 AS (SELECT *, list_transform(w, lambda x: {_MAP}) AS m FROM arr), f2 AS (SELECT *, list_filter(m, lambda x: upper(x) NOT IN ('AH','UM','UH','EM','ER','ERR','<UNK>')) AS k FROM f1)
SELECT conv_id, turn, array_to_string(m, ' ') AS mapped, array_to_string(CASE WHEN len(k) = 0 THEN m ELSE k END, ' ') AS cleaned FROM f2""")
def filled_pause_clean(spark, d):
    """F1, F2."""
    rows = _marked_arrays(spark, d).withColumn("m", T.map_interregnum(F.col("w")))
    return rows.select("conv_id", "turn", T.joined(F.col("m")).alias("mapped"), T.joined(T.drop_filled_pauses(F.col("m"))).alias("cleaned"))


@query(f"""{_ARR} SELECT conv_id, turn, array_to_string(list_transform(w, lambda x: CASE WHEN lower(x) IN ({_MARKS}) THEN '' ELSE x END), ' ') AS unmarked,
array_to_string(list_transform(w, lambda x: CASE WHEN starts_with(x, '-') OR suffix(x, '-') THEN '' ELSE x END), ' ') AS whole FROM arr""")
def partial_word_blank(spark, d):
    """F3, F4."""
    return _marked_arrays(spark, d).select("conv_id", "turn", T.joined(T.blank_interregnum(F.col("w"))).alias("unmarked"), T.joined(T.blank_partial(F.col("w"))).alias("whole"))


@query(f"""WITH {CONV}, {MARKED} SELECT conv_id, turn, string_agg(CASE WHEN label = '@sil' THEN 'D' WHEN contains(label, '@') AND label NOT IN ('@breath','@cough','@laugh','@bkg','@ns','@sil') THEN 'D' ELSE 'O' END, ' ' ORDER BY ord) AS tags FROM marked GROUP BY ALL""")
def disfluency_tags(spark, d):
    """F8."""
    return _marked_arrays(spark, d).select("conv_id", "turn", T.joined(F.transform("w", T.disfluency_tag)).alias("tags"))


@query(f"""{_ARR}, t AS (SELECT conv_id, turn, lower(array_to_string(w, ' ')) AS s FROM arr) SELECT conv_id, turn,
{", ".join(f"CAST((length(s) - length(replace(s, '{p}', ''))) // {len(p)} AS INTEGER) AS {p.replace(' ', '_')}" for p in T.PHRASES)} FROM t""")
def phrase_counts(spark, d):
    """A8."""
    return fluency.phrase_features(A.marked(_conv(spark, d)), ["conv_id", "turn"])


@query(f"""WITH {CTM}, g AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY utt_id) > 2 THEN start - lag(start + dur) OVER (PARTITION BY utt_id ORDER BY ord) END AS gap FROM ctm),
s AS (SELECT *, CASE WHEN gap > 0.145 THEN gap END AS sil, CASE WHEN gap > 0.495 THEN gap END AS lsil FROM g),
m AS (SELECT *, avg(sil) OVER (PARTITION BY utt_id) AS sil_m, avg(lsil) OVER (PARTITION BY utt_id) AS lsil_m FROM s),
a AS (SELECT utt_id, arg_max(start + dur, ord) - arg_min(start, ord) AS r, count(*) AS n, {_stats_sql("sil", "sil")}, {_stats_sql("lsil", "long_sil")} FROM m GROUP BY utt_id)
SELECT * EXCLUDE (r, n), round(r + 1e-9, 6) AS response_duration, round(sil_number / nullif(r, 0) + 1e-9, 6) AS sil_rate1, round(sil_number / n + 1e-9, 6) AS sil_rate2,
round(long_sil_number / nullif(r, 0) + 1e-9, 6) AS long_sil_rate1, round(long_sil_number / n + 1e-9, 6) AS long_sil_rate2 FROM a""")
def silence_features(spark, d):
    """W1, A1, A3, A4."""
    return rounded(fluency.silence_features(_ctm(spark, d)), nudge=1e-9)


@query(f"""WITH {CTM}, m AS (SELECT *, coalesce(lag(label) OVER (PARTITION BY utt_id ORDER BY ord) = label, FALSE) AS rep, avg(dur) OVER (PARTITION BY utt_id) AS dur_m, avg(conf) OVER (PARTITION BY utt_id) AS conf_m FROM ctm),
a AS (SELECT utt_id, arg_max(start + dur, ord) - arg_min(start, ord) AS r, count(*) AS word_count, count(DISTINCT label) AS word_distinct, count(*) FILTER (rep) AS word_num_repeat,
count(*) FILTER (label IN ({", ".join(f"'{x}'" for x in T.DISFLUENT_WORDS)})) AS word_num_disfluency, count(*) FILTER (label IN ('UM','UH','um','uh')) AS word_num_disfluency_baseline,
{_stats_sql("dur", "word_duration")}, {_stats_sql("conf", "word_conf")} FROM m GROUP BY utt_id)
SELECT * EXCLUDE (r), round(r + 1e-9, 6) AS response_duration, round(word_count / nullif(r, 0) + 1e-9, 6) AS word_freq FROM a""")
def word_features(spark, d):
    """A1, A2, A3, A5, A6, A7, W2."""
    return rounded(fluency.word_features(_ctm(spark, d)), nudge=1e-9)


@query(f"""WITH {CONV}, r AS (SELECT *, coalesce(lag(label) OVER (PARTITION BY conv_id, turn ORDER BY ord) = label, FALSE) AS rep FROM conv)
SELECT conv_id, turn, count(*) AS n_words, count(DISTINCT label) AS n_distinct, count(*) FILTER (rep) AS n_repeats FROM r GROUP BY ALL""")
def distinct_and_repeat(spark, d):
    """A6, W2."""
    return fluency.repeats(_conv(spark, d), ["conv_id", "turn"])


@query(f"""WITH {LEX}, {DOCW}, ph AS (SELECT word, list_filter(string_split(word, ''), lambda c: regexp_matches(c, '\\p{{L}}')) AS p FROM lex),
w AS (SELECT doc_id AS utt_id, ord, label, (ord - 1) * 0.5 AS start, 0.4 AS dur FROM docw WHERE doc_id % 10 < 10),
j AS (SELECT utt_id, ord, label, start, dur, p, unnest(p) AS phone, unnest(range(0, len(p))) AS pos FROM w JOIN ph ON w.label = ph.word WHERE len(p) > 0)
SELECT phone, pos, count(*) AS n, round(sum(start + pos * dur / len(p)), 3) AS starts, round(sum(dur / len(p)), 3) AS durs FROM j GROUP BY phone, pos""")
def even_phone_split(spark, d):
    """J7, M6, summed by phone and place."""
    words = A.words_of(A.table(spark, d, "documents"), ["doc_id"]).select(F.col("doc_id").alias("utt_id"), "ord", "label", ((F.col("ord") - 1) * 0.5).alias("start"), F.lit(0.4).alias("dur"))
    return rounded(vocabulary.split_totals(words, _lexicon(spark, d)), 3)


@query(f"""WITH {LEX}, ph AS (SELECT word, list_filter(string_split(word, ''), lambda c: regexp_matches(c, '\\p{{L}}')) AS p FROM lex),
{CONV}, w AS (SELECT conv_id * 1000 + turn AS utt_id, ord, label, (ord - 1) * 0.5::DOUBLE AS start, 0.4::DOUBLE AS dur FROM conv WHERE label IN (SELECT word FROM lex)),
j AS (SELECT utt_id, ord, label, start, dur, p, unnest(p) AS phone, unnest(range(0, len(p))) AS pos FROM w JOIN ph ON w.label = ph.word WHERE len(p) > 0)
SELECT utt_id, ord, label, CAST(pos AS INTEGER) AS pos, phone, round(start + pos * dur / len(p), 6) AS start, round(dur / len(p), 6) AS dur FROM j""")
def phones_of_words(spark, d):
    """Each word's phones and times."""
    words = _conv(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("utt_id"), "ord", "label", ((F.col("ord") - 1) * 0.5).alias("start"), F.lit(0.4).alias("dur"))
    return rounded(vocabulary.even_split(words, _lexicon(spark, d)))


@query(f"""WITH {LEX}, ph AS (SELECT word, list_filter(string_split(word, ''), lambda c: regexp_matches(c, '\\p{{L}}')) AS p FROM lex), {CONV},
w AS (SELECT conv_id, turn, ord, p FROM conv JOIN ph ON lower(label) = word)
SELECT conv_id, turn, array_to_string(flatten(list(p ORDER BY ord)), ' ') AS phone_text FROM w GROUP BY ALL""")
def phones_in_text(spark, d):
    """F15."""
    return vocabulary.phone_texts(_conv(spark, d), _lexicon(spark, d), ["conv_id", "turn"])


@query(f"""WITH {LEX}, found AS (SELECT DISTINCT unnest({WORDS.format('lower(text)')}) AS word FROM conversations), w AS (SELECT word FROM lex UNION SELECT word FROM found)
SELECT word, array_to_string(list_filter(string_split(word, ''), lambda c: regexp_matches(c, '\\p{{L}}')), ' ') AS phones FROM w""")
def lexicon_extended(spark, d):
    """Words of the conversations join the lexicon; letters stand for a pronunciation."""
    lexicon = _lexicon(spark, d)
    missing = vocabulary.missing_words(A.table(spark, d, "conversations"), lexicon)
    return vocabulary.extended(lexicon, vocabulary.letter_phones(missing)).select("word", T.joined(F.col("phones")).alias("phones"))


_SYMBOLS = "CASE WHEN p_partkey % 5 = 0 THEN '@' || lower(p_brand) WHEN p_partkey % 7 = 0 THEN '<' || lower(p_brand) || '>' ELSE lower(replace(p_brand, '#', '_')) END"


@query(f"""WITH s AS (SELECT {_SYMBOLS} AS symbol FROM part) SELECT DISTINCT 'disfluency' AS kind, symbol AS token FROM s WHERE symbol[1] IN ('@', '<')
UNION SELECT 'silence', symbol FROM s UNION SELECT 'silence', split_part(symbol, '_', 1) FROM s""")
def phone_token_lists(spark, d):
    """F10."""
    low = F.lower("p_brand")
    symbol = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("@"), low)).when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("<"), low, F.lit(">"))).otherwise(F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))))
    return vocabulary.token_lists(A.table(spark, d, "part").select(symbol.alias("symbol")))


@query(f"WITH {CTM} SELECT count(DISTINCT label) AS n_labels, count(DISTINCT label) < 10 AS suspicious FROM ctm")
def alignment_labels(spark, d):
    """B5."""
    return vocabulary.label_check(_ctm(spark, d))


@query("""WITH t AS (SELECT conv_id, turn, ord, label FROM (SELECT conv_id, turn, unnest(w) AS label, unnest(range(1, len(w) + 1)) AS ord FROM (SELECT conv_id, turn, """ + WORDS.format("text") + """ AS w FROM conversations))),
p AS (SELECT conv_id, turn, ord, CASE WHEN ord % 13 = 0 THEN 'SIL' WHEN ord % 11 = 0 THEN 'none' ELSE label || (ord % 4) END || '_B' AS symbol, CASE WHEN ord % 11 = 0 THEN 'None' ELSE label END AS value FROM t)
SELECT conv_id, turn, ord, regexp_replace(lower(split_part(symbol, '_', 1)), '[0-9]+', '', 'g') AS phone, contains(symbol, chr(39)) OR regexp_matches(symbol, '[1-3]') AS stressed, CASE WHEN lower(value) <> 'none' THEN value END AS value
FROM p WHERE regexp_replace(lower(split_part(symbol, '_', 1)), '[0-9]+', '', 'g') NOT IN ('sil', '@sil', 'spn')""")
def phone_normal(spark, d):
    """F6, F9, F13, P5."""
    o = F.col("ord")
    symbol = F.concat(F.when(o % 13 == 0, "SIL").when(o % 11 == 0, "none").otherwise(F.concat("label", (o % 4).cast("string"))), F.lit("_B"))
    rows = _conv(spark, d).select("conv_id", "turn", "ord", symbol.alias("symbol"), F.when(o % 11 == 0, "None").otherwise(F.col("label")).alias("value"))
    kept = fluency.spoken_phones(rows, "symbol")
    return kept.select("conv_id", "turn", "ord", T.normal_phone(F.col("symbol")).alias("phone"), T.is_stressed(F.col("symbol")).alias("stressed"), T.nullable(F.col("value")).alias("value"))


@query(f"""WITH {CTM} SELECT utt_id, count(*) AS n_words, round(sum(dur) + 1e-9, 6) AS spoken FROM ctm WHERE label NOT IN ('view', 'click')
AND utt_id NOT IN (SELECT utt_id FROM ctm GROUP BY utt_id HAVING count(*) FILTER (label IN ('view', 'click')) = count(*)) GROUP BY utt_id""")
def words_without_special(spark, d):
    """Utterances of special words alone fall out, special words of the others too."""
    ctm, special = _ctm(spark, d), ["view", "click"]
    kept = ctm.join(fluency.special_only(ctm, special), "utt_id", "left_anti")
    return rounded(fluency.without_labels(kept, special).groupBy("utt_id").agg(F.count("*").alias("n_words"), F.sum("dur").alias("spoken")), nudge=1e-9)


@query(f"""WITH {CTM}, m AS (SELECT *, avg(dur) OVER (PARTITION BY utt_id) AS dur_m, avg(conf) OVER (PARTITION BY utt_id) AS conf_m FROM ctm),
a AS (SELECT utt_id, arg_max(start + dur, ord) - arg_min(start, ord) AS r, count(*) AS phone_count, {_stats_sql("dur", "phone_duration")}, {_stats_sql("conf", "phone_conf")} FROM m GROUP BY utt_id)
SELECT * EXCLUDE (r), round(phone_count / nullif(r, 0) + 1e-9, 6) AS phone_freq FROM a""")
def phone_features(spark, d):
    """A9, A2."""
    return rounded(fluency.phone_features(_ctm(spark, d)), nudge=1e-9)


@query(f"""WITH {GOP}, k AS (SELECT utt_id, ord, phone, raw FROM gop WHERE phone NOT IN ('N'))
SELECT utt_id, ord, phone AS label, round(2 / (1 + exp(-raw)), 6) AS gop, CAST(row_number() OVER (PARTITION BY utt_id ORDER BY ord) AS INTEGER) AS place FROM k""")
def scored_phones(spark, d):
    """Ignored phones leave both sequences together."""
    rows = gop.doubled_scores(_gop(spark, d))
    phones = rows.select("utt_id", "ord", F.col("phone").alias("label"))
    return rounded(gop.scored_phones(phones, rows.select("utt_id", "ord", "gop"), ["utt_id"], ["N"]))


_V, _C = (", ".join(f"'{x}'" for x in xs) for xs in (T.VOWELS, T.CONSONANTS))


def _rhythm_sql() -> str:
    num = {"num_nucleus": "n_v", "num_consonants": "n_c", "v_to_c_ratio": "n_v / n_c", "phones_num": "m_p", "v_num": "m_v", "c_num": "m_c", "sum_dur_sec": "s_p", "v_sum_dur_sec": "s_v", "c_sum_dur_sec": "s_c", "mean_p_dur": "a_p", "mean_v_dur": "a_v", "mean_c_dur": "a_c", "p_sum_variance": "x_p", "p_std_dev": "sd_p", "v_std_dev": "sd_v", "c_std_dev": "sd_c", "varco_P": "sd_p / nullif(a_p, 0) * 100", "varco_V": "sd_v / nullif(a_v, 0) * 100", "varco_C": "sd_c / nullif(a_c, 0) * 100", "percent_v": "s_v / nullif(s_p, 0) * 100", "speech_rate": "n_v / nullif(s_p, 0)"}
    for t in ("rpvi", "npvi", "cci"):
        for k, tail in (("p", ""), ("v", "_v"), ("c", "_c")):
            num[t + tail] = f"{t}_{k} / (m_p - 1)"
    num["status"] = "1"
    cond = {"p": "TRUE", "v": "cls = 'V'", "c": "cls = 'C'"}
    pair = {"p": ("d2", "l2"), "v": ("s2", "sl2"), "c": ("s2", "sl2")}
    agg = []
    for k, on in cond.items():
        d2, l2 = pair[k]
        agg += [f"count(*) FILTER ({on}) AS n_{k}", f"coalesce(sum(dur) FILTER ({on}), 0) AS s_{k}", f"coalesce(sum(dur * 1000 * dur * 1000) FILTER ({on}), 0) AS q_{k}"]
        agg += [f"coalesce(sum(abs({d2} - dur)) FILTER ({on}), 0) AS rpvi_{k}", f"coalesce(sum(abs({d2} - dur) / (({d2} + dur) / 2)) FILTER ({on}), 0) AS npvi_{k}", f"coalesce(sum(abs({d2} / {l2} - dur / len)) FILTER ({on}), 0) AS cci_{k}"]
    step1 = ", ".join(f"greatest(n_{k}, 2) AS m_{k}, s_{k} * 1000 / (greatest(n_{k}, 2) - 1) AS a_{k}" for k in "pvc")
    step2 = ", ".join(f"greatest(q_{k} - 2 * a_{k} * s_{k} * 1000 + n_{k} * a_{k} * a_{k}, 0) AS x_{k}" for k in "pvc")
    step3 = ", ".join(f"sqrt(x_{k} / (m_{k} - 1)) AS sd_{k}" for k in "pvc")
    cols = ", ".join(f"round(coalesce(CAST(CASE WHEN n_v > 0 AND n_c > 0 THEN {x} END AS DOUBLE), 0) + 1e-9, 4) + 0.0 AS {n}" for n, x in num.items())
    return f"""WITH {CONV}, ph AS (SELECT conv_id, turn, ord, substr(regexp_replace(lower(label), '[^a-z]', '', 'g'), 1, 2) AS phone, length(label) * CAST(0.05 AS DOUBLE) AS dur FROM conv),
k AS (SELECT *, CASE WHEN phone IN ({_V}) THEN 'V' WHEN phone IN ({_C}) THEN 'C' ELSE 'O' END AS cls, length(phone) AS len FROM ph),
w AS (SELECT *, lead(dur) OVER e AS d2, lead(len) OVER e AS l2, lead(dur) OVER s AS s2, lead(len) OVER s AS sl2 FROM k WHERE cls <> 'O' WINDOW e AS (PARTITION BY conv_id, turn ORDER BY ord), s AS (PARTITION BY conv_id, turn, cls ORDER BY ord)),
g AS (SELECT conv_id, turn, {", ".join(agg)} FROM w GROUP BY ALL), g1 AS (SELECT *, {step1} FROM g), g2 AS (SELECT *, {step2} FROM g1), g3 AS (SELECT *, {step3} FROM g2)
SELECT conv_id, turn, {cols} FROM (SELECT DISTINCT conv_id, turn FROM ph) LEFT JOIN g3 USING (conv_id, turn)"""


@query(_rhythm_sql())
def rhythm_features(spark, d):
    """T1, W4, W5, W6, F7."""
    return rounded(rhythm.rhythm_features(A.phone_ctm(A.table(spark, d, "conversations")), ["conv_id", "turn"]), 4, 1e-9)


def _words(spark, d):
    return gop.segment_words(_gop(spark, d), ["utt_id"], F.col("ord") % 3 == 0)


_SCORE = "200 / (1 + exp(-raw))"


@query(f"WITH {GOP}, {SPLIT} SELECT utt_id, word_ord, round(avg(CASE WHEN silent THEN {_SCORE} * 0.2 ELSE {_SCORE} END), 6) AS score, count(*) AS n_phones FROM word GROUP BY ALL")
def gop_word_scores(spark, d):
    """M1, W10, A10."""
    return rounded(gop.word_scores(_words(spark, d)))


@query(f"WITH {GOP} SELECT utt_id, ord, least(greatest(round({_SCORE} / 100, 4), 0), 1) AS conf FROM gop")
def gop_confidence(spark, d):
    """M3."""
    return _gop(spark, d).select("utt_id", "ord", confidence(pronunciation(F.col("raw"))).alias("conf"))


@query(f"""WITH {GOP}, {SPLIT}, st AS (SELECT phone, avg(dur) AS mean, stddev_pop(dur) AS std FROM gop GROUP BY phone),
f AS (SELECT utt_id, word_ord, CASE WHEN silent THEN 0 ELSE coalesce(130 - 150 / (5 - least(abs((dur - mean) / nullif(std, 0)), 50.0::DOUBLE / 13)), 0) END AS fl FROM word JOIN st USING (phone))
SELECT utt_id, word_ord, round(avg(abs(fl)), 6) AS fluency FROM f GROUP BY ALL""")
def fluency_zscore(spark, d):
    """M4, J15, A10."""
    rows = _words(spark, d)
    return rounded(gop.word_fluency(rows, gop.duration_statistics(rows)))


@query("""WITH a AS (SELECT l_orderkey AS utt_id, l_returnflag AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem WHERE l_quantity > 5),
b AS (SELECT l_orderkey AS utt_id, l_linestatus AS other, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem WHERE l_tax > 0)
SELECT utt_id, count(*) AS n, count(*) FILTER (label = other) AS n_agree FROM a JOIN b USING (utt_id, place) GROUP BY utt_id""")
def positional_join_check(spark, d):
    """J1, J2, J3, J9, W3."""
    rows = A.table(spark, d, "lineitem").withColumn("key", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    left = rows.where("l_quantity > 5").select(F.col("l_orderkey").alias("utt_id"), F.col("l_returnflag").alias("label"), "key")
    right = rows.where("l_tax > 0").select(F.col("l_orderkey").alias("utt_id"), F.col("l_linestatus").alias("other"), "key")
    return gop.positional_join(left, right, ["utt_id"], "key", "other").groupBy("utt_id").agg(F.count("*").alias("n"), F.count_if("agree").alias("n_agree"))


_F1 = "round((coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn) + coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0) * (tn + fp)) / (tp + fp + fn + tn), 12)"


def _search_sql(name: str, source: str) -> str:
    return f"""{name}_c AS (SELECT phone, k, count(*) FILTER (s >= k * 0.1::DOUBLE AND correct) AS tp, count(*) FILTER (s >= k * 0.1::DOUBLE AND NOT correct) AS fp,
count(*) FILTER (NOT s >= k * 0.1::DOUBLE AND correct) AS fn, count(*) FILTER (NOT s >= k * 0.1::DOUBLE AND NOT correct) AS tn FROM {source}, range(0, 11) r(k) GROUP BY phone, k),
{name} AS (SELECT phone, CAST(k AS INTEGER) AS k, f1 FROM (SELECT *, {_F1} AS f1 FROM {name}_c) QUALIFY row_number() OVER (PARTITION BY phone ORDER BY f1 DESC, abs(k - 5), k) = 1)"""


_SC = "sc AS (SELECT *, 2 / (1 + exp(-raw)) AS s FROM gop)"


@query(f"WITH {GOP}, {_SC}, {_search_sql('best', 'sc')} SELECT phone, k, round(f1, 6) AS f1 FROM best")
def threshold_search(spark, d):
    """M2, T6, A19."""
    return rounded(gop.threshold_search(gop.doubled_scores(_gop(spark, d))))


def _applied(spark, d):
    rows = gop.doubled_scores(_gop(spark, d))
    dev, test = rows.where("utt_id % 2 = 0"), rows.where("utt_id % 2 = 1")
    return gop.apply_thresholds(test, gop.threshold_search(dev), gop.threshold_search(test))


_APPLIED = f"""WITH {GOP}, {_SC}, dev AS (SELECT * FROM sc WHERE utt_id % 2 = 0), test AS (SELECT * FROM sc WHERE utt_id % 2 = 1), {_search_sql('b1', 'dev')}, {_search_sql('b2', 'test')},
ap AS (SELECT test.*, s >= coalesce(b1.k, b2.k) * 0.1::DOUBLE AS predicted FROM test LEFT JOIN b1 USING (phone) LEFT JOIN b2 USING (phone))"""
_COUNTS = "count(*) FILTER (correct AND predicted) AS tp, count(*) FILTER (NOT correct AND predicted) AS fp, count(*) FILTER (correct AND NOT predicted) AS fn, count(*) FILTER (NOT correct AND NOT predicted) AS tn"
_MEASURES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_1, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall_1, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_1, tp + fn AS support_1,
round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS precision_0, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS recall_0, round(coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0), 6) AS f1_0, tn + fp AS support_0,
round(""" + _F1 + """, 6) AS weighted_f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy"""


@query(f"{_APPLIED}, c AS (SELECT phone, {_COUNTS} FROM ap GROUP BY phone) SELECT *, {_MEASURES} FROM c")
def threshold_apply(spark, d):
    """T7, T8."""
    return rounded(gop.report(_applied(spark, d), ["phone"]))


@query(f"""{_APPLIED}, c AS (SELECT utt_id, {_COUNTS} FROM ap GROUP BY utt_id), r AS (SELECT utt_id, (tp + tn) / (tp + fp + fn + tn) AS a FROM c)
SELECT (SELECT utt_id FROM r ORDER BY a DESC, utt_id LIMIT 1) AS best, max(a) AS best_accuracy, (SELECT utt_id FROM r ORDER BY a, utt_id LIMIT 1) AS worst, min(a) AS worst_accuracy FROM r""")
def utt_accuracy_rank(spark, d):
    """A18, O3."""
    return gop.extremes(gop.report(_applied(spark, d), ["utt_id"]))


@query("""WITH u AS (UNPIVOT (SELECT l_extendedprice / 10000 AS y, l_quantity AS quantity, l_discount AS discount, l_tax AS tax, CAST(l_linenumber AS DOUBLE) AS linenumber, 1.0::DOUBLE AS one FROM lineitem) ON quantity, discount, tax, linenumber, one INTO NAME feature VALUE x),
f AS (SELECT feature, CASE WHEN var_pop(x) > 0 THEN covar_pop(y, x) / var_pop(x) ELSE 0 END AS slope, avg(x) AS mx, avg(y) AS my, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN covar_pop(y, x) * covar_pop(y, x) / (var_pop(x) * var_pop(y)) END AS r2 FROM u GROUP BY feature),
e AS (SELECT feature, slope, my - slope * mx AS intercept, r2, abs(slope * x + my - slope * mx - y) AS e FROM u JOIN f USING (feature))
SELECT feature, round(any_value(slope), 6) + 0.0 AS slope, round(any_value(intercept), 6) AS intercept, round(any_value(r2), 6) AS r2, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(CAST(e <= 0.5 AS INTEGER)) * 100, 6) AS accuracy_0_5, round(avg(CAST(e <= 1 AS INTEGER)) * 100, 6) AS accuracy_1_0 FROM e GROUP BY feature""")
def feature_regression(spark, d):
    """T2, T3, T4, T5, P2."""
    items = A.table(spark, d, "lineitem").select((F.col("l_extendedprice") / 10000).alias("y"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_linenumber").alias("linenumber"), F.lit(1.0).alias("one"))
    return rounded(regression.feature_regression(items, ["quantity", "discount", "tax", "linenumber", "one"], "y"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rx, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS ry FROM part)
SELECT round(covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)), 6) AS rho, count(*) AS n FROM r""")
def spearman(spark, d):
    """T10."""
    return rounded(regression.spearman(A.table(spark, d, "part"), "p_size", "p_retailprice"))


@query(f"""WITH p AS (SELECT CAST(trunc(l_quantity) AS INTEGER) AS pred, l_linenumber % 4 AS anno FROM lineitem), c AS (SELECT cut, count(*) FILTER (anno > 1 AND pred > cut) AS tp, count(*) FILTER (anno <= 1 AND pred > cut) AS fp,
count(*) FILTER (anno > 1 AND pred <= cut) AS fn, count(*) FILTER (anno <= 1 AND pred <= cut) AS tn FROM p, (SELECT unnest([0, 10, 20, 30, 40]) AS cut) GROUP BY cut) SELECT *, {_MEASURES} FROM c""")
def threshold_sweep(spark, d):
    """T11, T12."""
    pairs = A.table(spark, d, "lineitem").select(F.col("l_quantity").alias("pred"), (F.col("l_linenumber") % 4).alias("anno"))
    return rounded(gop.sweep(pairs, [0, 10, 20, 30, 40]))


@query("""WITH t AS (SELECT l_orderkey AS utt_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_linestatus = 'O' AS mark FROM lineitem)
SELECT utt_id, CAST(pos // 3 AS BIGINT) AS ord, count(*) FILTER (mark) AS score FROM t GROUP BY ALL HAVING count(*) = 3""")
def triple_scores(spark, d):
    """A17."""
    rows = _gop(spark, d)
    got = rows.groupBy("utt_id", F.floor((F.col("ord") - 1) / 3).alias("ord")).agg(F.count_if("correct").alias("score"), F.count("*").alias("n"))
    return got.where("n = 3").drop("n")


def _pairs(spark, d):
    rows = _marked_arrays(spark, d)
    plain = A.table(spark, d, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), T.tokens(F.col("text")).alias("hyp"))
    loud = F.transform(F.col("w"), lambda x: F.when(x == "@uh", "UH").otherwise(x))
    return rows.select("conv_id", "turn", loud.alias("ref")).join(plain, ["conv_id", "turn"])


_PAIR = f"""{CONV}, {MARKED}, arr AS (SELECT conv_id, turn, list(CASE WHEN label = '@uh' THEN 'UH' ELSE label END ORDER BY ord) AS ref FROM marked GROUP BY ALL),
pair AS (SELECT conv_id, turn, ref, hyp, len(ref) AS n, len(hyp) AS m FROM arr JOIN (SELECT conv_id, turn - 1 AS turn, {WORDS.format("text")} AS hyp FROM conversations) USING (conv_id, turn))"""

#: Edit distance by diagonals i + j = d: a cell needs the two diagonals before it only, so each is one pass over a list.
WER_STEPS = """step AS (SELECT conv_id, turn, 0 AS d, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE 1000000 END) AS one, list_transform(range(0, n + 1), lambda i: 1000000) AS two FROM pair
UNION ALL SELECT conv_id, turn, d + 1, list_transform(range(0, n + 1), lambda i: CASE WHEN d + 1 < i OR d + 1 > i + m THEN 1000000 WHEN i = 0 OR i = d + 1 THEN d + 1
  ELSE least(one[i] + 1, one[i + 1] + 1, two[i] + CASE WHEN ref[i] = hyp[d + 1 - i] THEN 0 ELSE 1 END) END), one FROM step JOIN pair USING (conv_id, turn) WHERE d < n + m),
wer AS (SELECT conv_id, turn, one[n + 1] AS edits, n AS ref_words FROM step JOIN pair USING (conv_id, turn) WHERE d = n + m)"""
_WER = f"WITH RECURSIVE {_PAIR}, {WER_STEPS}"

#: Weighted alignment: costs of two whole numbers, edits in units of 2**32 (three are 12884901888) and tilts, by diagonals; the steps into each cell; then the path from the end.
ALIGNED = f"""WITH RECURSIVE {_PAIR}, tilted AS (SELECT *, list_transform(ref, lambda w: lower(w)) AS low, list_transform(ref, lambda w: CASE WHEN upper(w) = w AND lower(w) <> w THEN 1 ELSE 0 END) AS t FROM pair WHERE n > 0),
diag AS (SELECT conv_id, turn, 0 AS d, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE 1152921504606846976 END) AS one, list_transform(range(0, n + 1), lambda i: 1152921504606846976) AS two, NULL::INTEGER[] AS kinds FROM tilted
UNION ALL SELECT conv_id, turn, d, now, one, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 OR i >= d OR d > i + m THEN NULL WHEN now[i + 1] = least(two[i], one[i], one[i + 1]) + t[i] THEN 0
    WHEN now[i + 1] = two[i] + 17179869184 + t[i] THEN 1 WHEN now[i + 1] = one[i] + 12884901888 - t[i] THEN 2 WHEN now[i + 1] = one[i + 1] + 12884901888 + t[i] THEN 3 ELSE 0 END)
  FROM (SELECT g.conv_id, g.turn, d + 1 AS d, one, two, n, m, t, list_transform(range(0, n + 1), lambda i: CASE WHEN d + 1 < i OR d + 1 > i + m THEN 1152921504606846976 WHEN i = 0 THEN (d + 1) * 12884901888
      WHEN i = d + 1 THEN i * (12884901888 - t[i]) ELSE least(one[i] + 12884901888 - t[i], one[i + 1] + 12884901888 + t[i], two[i] + CASE WHEN low[i] = hyp[d + 1 - i] THEN 0 ELSE 17179869184 END + t[i]) END) AS now
    FROM diag g JOIN tilted USING (conv_id, turn) WHERE d < n + m)),
steps AS MATERIALIZED (SELECT conv_id, turn, list(kinds ORDER BY d) AS k FROM diag WHERE d > 0 GROUP BY ALL),
walk AS (SELECT conv_id, turn, n AS i, m AS j, NULL::INTEGER AS op, NULL::BIGINT AS place FROM tilted
UNION ALL SELECT conv_id, turn, i - CAST(op <> 3 AS INTEGER), j - CAST(op <> 2 AS INTEGER), op, i FROM
  (SELECT w.conv_id, w.turn, i, j, CASE WHEN i = 0 THEN 3 WHEN j = 0 THEN 2 ELSE k[i + j][i + 1] END AS op FROM walk w JOIN steps USING (conv_id, turn) WHERE i + j > 0))"""
_OPERATIONS = [(f"{name}_{x}", f"op = {k} AND coalesce(t[place], 0) = {dis}" if k < 3 else f"op = 3 AND {dis} = 0") for k, name in enumerate(("match", "substitution", "deletion", "insertion")) for dis, x in ((0, "f"), (1, "d"))]
RATES = f"""SELECT *, round((substitution_f + deletion_f + insertion_f) / nullif(match_f + substitution_f + deletion_f, 0), 6) AS fer, round((substitution_d + match_d + insertion_d) / nullif(match_d + substitution_d + deletion_d, 0), 6) AS der
FROM (SELECT conv_id, turn, {", ".join(f"CAST(count(*) FILTER ({x}) AS INTEGER) AS {n}" for n, x in _OPERATIONS)} FROM walk JOIN tilted USING (conv_id, turn) GROUP BY ALL)"""


@query(f"{_WER} SELECT conv_id, turn, edits, ref_words, round(edits / nullif(ref_words, 0), 6) AS wer FROM wer")
def word_error_rate(spark, d):
    """X3, X5, T13."""
    return rounded(alignment.word_error_rate(_pairs(spark, d)).select("conv_id", "turn", "edits", "ref_words", "wer"))


@query(f"{_WER} SELECT CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(ref_words) AS BIGINT) AS ref_words, round(sum(edits) / sum(ref_words), 6) AS wer FROM wer")
def corpus_error_rate(spark, d):
    """One rate over all pairs."""
    got = alignment.word_error_rate(_pairs(spark, d)).agg(F.sum("edits").alias("edits"), F.sum("ref_words").alias("ref_words"))
    return rounded(got.withColumn("wer", F.try_divide("edits", "ref_words")))


@query(f"{ALIGNED} {RATES}")
def fer_der(spark, d):
    """X4, X6, T14, J12."""
    return rounded(alignment.disfluency_rates(alignment.alignments(_pairs(spark, d), ["conv_id", "turn"]), ["conv_id", "turn"]))


def _formants(spark, d):
    return A.table(spark, d, "embeddings").select(F.col("label").alias("vowel"), F.col("embedding")[0].cast("double").alias("f1"), F.col("embedding")[1].cast("double").alias("f2"))


@query("SELECT label AS vowel, " + ", ".join(f"round(sum(pow(CAST(embedding[1] AS DOUBLE), {i}) * pow(CAST(embedding[2] AS DOUBLE), {j})), 5) + 0.0 AS m{i}{j}" for i, j in vowels.MOMENTS) + " FROM embeddings GROUP BY label")
def vowel_moments(spark, d):
    """A13, T9."""
    return rounded(vowels.vowel_moments(_formants(spark, d)), 5)


def _ellipse_sql(table: str) -> str:
    """The steps of vowels.ellipse_steps over central moments of a table (vowel, x, y), as nested queries."""
    sums = ", ".join(f"sum({' * '.join(['u'] * i + ['v'] * j)}) AS c{i}{j}" for i, j in vowels.MOMENTS if i + j > 1)
    sql = f"""SELECT m.*, s.* EXCLUDE (vowel) FROM m JOIN (SELECT vowel, {sums} FROM (SELECT p.vowel, (x - mean_x) / size AS u, (y - mean_y) / size AS v FROM p JOIN m ON p.vowel IS NOT DISTINCT FROM m.vowel) GROUP BY vowel) s ON m.vowel IS NOT DISTINCT FROM s.vowel"""
    made: set[str] = set()
    for layer in vowels.ellipse_steps():
        again = made & set(layer)
        sql = f"SELECT *{f' EXCLUDE ({", ".join(again)})' if again else ''}, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM ({sql})"
        made |= set(layer)
    return f"""WITH p AS ({table}), m AS (SELECT *, CASE WHEN raw > 0 THEN raw END AS size FROM (SELECT vowel, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y, sqrt((var_pop(x) + var_pop(y)) / 2) AS raw FROM p GROUP BY vowel))
SELECT vowel, {", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in vowels.ELLIPSE)} FROM ({sql})"""


@query(_ellipse_sql("SELECT label AS vowel, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"))
def vowel_ellipse(spark, d):
    """T9."""
    return rounded(vowels.vowel_ellipses(_formants(spark, d)), 4)


_NAMED = "substr('aeiouxAE', 1 + label % 8, 1) || CAST(label AS VARCHAR)"


@query(_ellipse_sql(f"SELECT lower(substr({_NAMED}, 1, 1)) AS vowel, CAST(embedding[3] AS DOUBLE) AS x, CAST(embedding[4] AS DOUBLE) AS y FROM embeddings WHERE substr({_NAMED}, 1, 1) <> 'x'"))
def basic_vowel_ellipse(spark, d):
    """Named vowels pooled by their first letter."""
    name = F.concat(F.substring(F.lit("aeiouxAE"), 1 + F.col("label") % 8, F.lit(1)), F.col("label").cast("string"))
    clouds = A.table(spark, d, "embeddings").select(name.alias("vowel"), F.col("embedding")[2].cast("double").alias("f1"), F.col("embedding")[3].cast("double").alias("f2"))
    return rounded(vowels.vowel_ellipses(clouds, basic=True), 4)


@query(f"""WITH {CTM}, f AS (SELECT utt_id, ord - 1 AS i, 100 * ord AS t, conf AS value, count(*) OVER (PARTITION BY utt_id) AS n FROM ctm), q AS (SELECT utt_id, ord, round(start * 0.004 + 1e-9, 4) AS t FROM ctm)
SELECT q.utt_id, q.ord, q.t, CAST(f.i AS BIGINT) AS left_i, round(f.t / 10000, 6) AS left_t, round(f.value, 6) AS value
FROM q JOIN f ON f.utt_id = q.utt_id AND f.i = least(greatest(CAST(floor(CAST(round(q.t * 10000) AS BIGINT) / 100) AS BIGINT) - 1, 0), f.n - 1)""")
def grid_frames(spark, d):
    """J10 on a regular grid: times before the first frame and after the last go to the edge frames."""
    ctm = _ctm(spark, d)
    frames = ctm.select("utt_id", (F.col("ord") - 1).alias("i"), (F.col("ord") / 100).alias("t"), F.col("conf").alias("value"))
    return rounded(intervals.frame_on_grid(ctm.select("utt_id", "ord", F.round(F.col("start") * 0.004 + 1e-9, 4).alias("t")), frames))


@query(f"""WITH {CTM}, q AS (SELECT utt_id, ord, start + dur / 2 AS t FROM ctm), f AS (SELECT utt_id, start AS t, max(conf) AS value FROM ctm GROUP BY ALL)
SELECT q.utt_id, q.ord, round(q.t, 6) AS t, round(f.t, 6) AS left_t, round(f.value, 6) AS left_value FROM q ASOF LEFT JOIN f ON q.utt_id = f.utt_id AND q.t >= f.t""")
def asof_frames(spark, d):
    """J10."""
    ctm = _ctm(spark, d)
    times = ctm.select("utt_id", "ord", (F.col("start") + F.col("dur") / 2).alias("t"))
    return rounded(intervals.frame_at(times, ctm.select("utt_id", F.col("start").alias("t"), F.col("conf").alias("value"))))


@query(f"""WITH {CTM}, q AS (SELECT utt_id, ord, unnest([start, start + dur]) AS t FROM ctm), f AS (SELECT utt_id, start AS t, max(conf) AS value FROM ctm GROUP BY ALL)
SELECT q.utt_id, q.ord, round(avg(f.value), 6) AS mean_value FROM q ASOF LEFT JOIN f ON q.utt_id = f.utt_id AND q.t >= f.t GROUP BY ALL""")
def interval_means(spark, d):
    """The mean of both end frames."""
    ctm = _ctm(spark, d)
    spans = ctm.select("utt_id", "ord", "start", (F.col("start") + F.col("dur")).alias("end"))
    return rounded(intervals.endpoint_means(spans, ctm.select("utt_id", F.col("start").alias("t"), F.col("conf").alias("value"))))


@query(f"""WITH RECURSIVE {CTM}, c0 AS (SELECT utt_id, ord, label, round(start + 1e-9, 4) AS start, round(dur + 1e-9, 5) + 1e-9 AS dur FROM ctm), r AS (SELECT utt_id, ord, label, start, round(start + dur, 4) AS "end" FROM c0 WHERE ord = 1
UNION ALL SELECT c.utt_id, c.ord, c.label, least(c.start, r."end"), round(least(c.start, r."end") + c.dur, 4) FROM r JOIN c0 c ON c.utt_id = r.utt_id AND c.ord = r.ord + 1)
SELECT * FROM r""")
def interval_repair(spark, d):
    """P12, W7."""
    ctm = _ctm(spark, d).withColumns({"start": F.round(F.col("start") + 1e-9, 4), "dur": F.round(F.col("dur") + 1e-9, 5) + 1e-9})
    return intervals.repaired(ctm)


@query(f"""WITH RECURSIVE {CTM}, k AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY ord) AS p FROM ctm WHERE label <> 'view'), c0 AS (SELECT utt_id, ord, p, label, round(start + 1e-9, 4) AS start, round(dur + 1e-9, 5) + 1e-9 AS dur FROM k),
r AS (SELECT utt_id, ord, p, label, start, round(start + dur, 4) AS "end" FROM c0 WHERE p = 1
UNION ALL SELECT c.utt_id, c.ord, c.p, c.label, least(c.start, r."end"), round(least(c.start, r."end") + c.dur, 4) FROM r JOIN c0 c ON c.utt_id = r.utt_id AND c.p = r.p + 1)
SELECT * EXCLUDE (p) FROM r""")
def interval_repair_spoken(spark, d):
    """Silences fall out before the ends are clamped."""
    ctm = _ctm(spark, d).withColumns({"start": F.round(F.col("start") + 1e-9, 4), "dur": F.round(F.col("dur") + 1e-9, 5) + 1e-9})
    return intervals.repaired(ctm, ("view",))


def _spans(spark, d):
    return _ctm(spark, d).select("utt_id", "ord", "label", F.round("start", 2).alias("start"), F.round(F.col("start") + F.col("dur"), 2).alias("end"))


_SPANS = 'sp AS (SELECT utt_id, ord, label, round(start, 2) AS start, round(start + dur, 2) AS "end" FROM ctm)'


@query(f"""WITH {CTM}, {_SPANS} SELECT utt_id, ord, label, start, CASE WHEN max("end") OVER (PARTITION BY utt_id) - "end" < 0.05 THEN max("end") OVER (PARTITION BY utt_id) ELSE "end" END AS "end" FROM sp""")
def interval_snap(spark, d):
    """P14, with a tolerance that fits days."""
    return intervals.snapped(_spans(spark, d), 0.05)


@query(f"""WITH {CTM}, {_SPANS}, e AS (SELECT *, max("end") OVER w AS total, ord = min(ord) OVER w AS f, ord = max(ord) OVER w AS l FROM sp WINDOW w AS (PARTITION BY utt_id)),
n AS (SELECT utt_id, ord, label, f, l, total, CASE WHEN f AND start = 0 THEN start + 0.0001 ELSE start END AS start, CASE WHEN l AND "end" = total THEN "end" - 0.0001 ELSE "end" END AS "end" FROM e)
SELECT utt_id, ord, label, round(start, 6) AS start, round("end", 6) AS "end" FROM n UNION ALL SELECT utt_id, ord - 1, '', 0.0, round(start, 6) FROM n WHERE f AND start > 0 UNION ALL SELECT utt_id, ord + 1, '', round("end", 6), round(total, 6) FROM n WHERE l AND "end" < total""")
def interval_pad(spark, d):
    """P13."""
    from pyspark.sql import Window

    spans = _spans(spark, d)
    return rounded(intervals.padded(spans.withColumn("total", F.max("end").over(Window.partitionBy("utt_id")))))


@query(f"""WITH RECURSIVE {CTM}, f AS (SELECT utt_id, ord AS i, conf > 0.3 AS s FROM ctm), n AS (SELECT utt_id, max(i) AS n FROM f GROUP BY utt_id),
r AS (SELECT utt_id, i, [s] AS held, CAST(NULL AS INTEGER) AS opened, CAST(NULL AS INTEGER) AS a, CAST(NULL AS INTEGER) AS b FROM f WHERE i = 1
UNION ALL SELECT utt_id, i, CASE WHEN opens OR closes THEN [] ELSE h END, CASE WHEN opens THEN i - len(h) WHEN closes THEN NULL ELSE opened END, CASE WHEN closes THEN opened END, CASE WHEN closes THEN i END
  FROM (SELECT *, opened IS NULL AND yes > 9 AS opens, opened IS NOT NULL AND len(h) - yes > 9 AS closes
    FROM (SELECT *, len(list_filter(h, lambda x: x)) AS yes FROM (SELECT f.utt_id, f.i, r.opened, list_append(r.held, f.s)[-10:] AS h FROM r JOIN f ON f.utt_id = r.utt_id AND f.i = r.i + 1)))),
g AS (SELECT utt_id, a, b FROM r WHERE a IS NOT NULL UNION ALL SELECT utt_id, opened, i - 1 FROM r JOIN n USING (utt_id) WHERE i = n AND opened IS NOT NULL)
SELECT utt_id, CAST(row_number() OVER (PARTITION BY utt_id ORDER BY a) - 1 AS INTEGER) AS segment, round(a * 0.03::DOUBLE, 6) AS start, round(b * 0.03::DOUBLE, 6) AS "end" FROM g""")
def vad_segments(spark, d):
    """W8, W9."""
    ctm = _ctm(spark, d)
    return rounded(intervals.voiced_segments(ctm.select("utt_id", F.col("ord").alias("i"), (F.col("conf") > 0.3).alias("is_speech"))))


@query("""WITH s AS (SELECT *, o_orderkey % 3 AS shard FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)), a AS (SELECT o_custkey, shard, o_orderkey, o_orderstatus, o_totalprice FROM s)
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM a QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY shard DESC, o_orderkey DESC, o_orderstatus DESC, o_totalprice DESC) = 1""")
def merge_overwrite(spark, d):
    """U1, U7."""
    orders = A.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return combine.merged([orders.where(F.col("o_orderkey") % 3 == k) for k in range(3)], "o_custkey")


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // CAST(ceil((SELECT count(*) FROM documents) / 7.0) AS BIGINT) AS INTEGER) AS chunk FROM documents")
def chunk_assign(spark, d):
    """R1, R3."""
    return combine.chunked(A.table(spark, d, "documents").select("doc_id"), "doc_id", 7)


@query("""WITH ids AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT k, CAST((row_number() OVER (ORDER BY k) - 1) // CAST(ceil((SELECT count(*) FROM ids) / 4.0) AS BIGINT) AS INTEGER) AS chunk FROM ids)
SELECT 'orders' AS part, chunk, count(*) AS n FROM orders JOIN c ON o_custkey = k GROUP BY chunk UNION ALL SELECT 'customer', chunk, count(*) FROM customer JOIN c ON c_custkey = k GROUP BY chunk""")
def chunk_projection(spark, d):
    """R2: rows of each input in each chunk of the ids."""
    inputs = {"orders": A.table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), "customer": A.table(spark, d, "customer").withColumnRenamed("c_custkey", "k")}
    cut = combine.in_chunks(inputs, inputs["orders"], "k", 4)
    return reduce(DataFrame.unionByName, (t.groupBy("chunk").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "chunk", "n") for name, t in cut.items()))


@query("SELECT l_orderkey AS key, count(*) AS n, count(DISTINCT v) AS n_distinct FROM (SELECT l_orderkey, l_returnflag AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linestatus FROM lineitem) GROUP BY l_orderkey")
def bag_union(spark, d):
    """Lists of a key put together, repeats kept."""
    items = A.table(spark, d, "lineitem")
    shards = [combine.united([items.where(F.coalesce(F.pmod("l_linenumber", F.lit(2)), F.lit(0)) == k).select("l_orderkey", F.col(c).alias("v")) for k in range(2)], ["l_orderkey", "v"]) for c in ("l_returnflag", "l_linestatus")]
    return combine.bag_sizes(combine.bagged(shards, "l_orderkey", "v"), "l_orderkey", "v").withColumnRenamed("l_orderkey", "key")


@query("SELECT DISTINCT c_mktsegment AS value FROM customer")
def distinct_sorted(spark, d):
    """O4, O5."""
    return combine.ordered_values(A.table(spark, d, "customer").select(F.col("c_mktsegment").alias("value")), "value")


@query("SELECT doc_id AS key, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def key_mismatch(spark, d):
    """J14, U5."""
    return combine.unmatched(A.table(spark, d, "documents"), A.table(spark, d, "labels"), "doc_id").withColumnRenamed("doc_id", "key")


_LEVELS = "CASE user_id % 4 WHEN 0 THEN 'TLT-x_A1' WHEN 1 THEN 'TLT-x_A2' WHEN 2 THEN 'TLT-x_B1' ELSE 'TLT-x_C1' END"


@query(f"""WITH u AS (SELECT user_id, {_LEVELS} AS id, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY ALL), l AS (SELECT *, CASE WHEN regexp_matches(id, 'A1|A2|B1') THEN split_part(split_part(id, '-', 2), '_', 2) END AS level FROM u)
SELECT level, CASE level WHEN 'A1' THEN 1 WHEN 'A2' THEN 3 WHEN 'B1' THEN 5 END AS ordinal, count(*) AS n_utts, CAST(sum(n) AS BIGINT) AS total FROM l WHERE lower(level) IN ('a1', 'a2') AND user_id IN (SELECT c_custkey FROM customer) GROUP BY level""")
def cefr_filter(spark, d):
    """P9, P10, P11, J5, J13, A14, A15."""
    number = F.col("user_id") % 4
    ids = F.when(number == 0, "TLT-x_A1").when(number == 1, "TLT-x_A2").when(number == 2, "TLT-x_B1").otherwise("TLT-x_C1")
    utts = A.table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n")).withColumn("level", T.level_from_id(ids))
    known = utts.join(A.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi")
    level: Column = F.col("level")
    return known.where(F.lower(level).isin("a1", "a2")).groupBy("level").agg(F.count("*").alias("n_utts"), F.sum("n").alias("total")).withColumn("ordinal", T.lookup(T.SCALE_EIGHT, level))


@query("""WITH g AS (SELECT *, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 43200000000 AS INTEGER), 1) AS new FROM events),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS n_events, round(sum(value), 4) AS total FROM s GROUP BY ALL""")
def session_gaps(spark, d):
    """Beyond the reference: the gap rule on event streams."""
    return rounded(sessions.session_gaps(A.table(spark, d, "events")), 4)


@query(f"WITH {CONV} SELECT max(n) AS longest, count(*) AS n_texts FROM (SELECT conv_id, turn, count(*) AS n FROM conv GROUP BY ALL)")
def longest_sequence(spark, d):
    """A16, A15, P18."""
    return A.table(spark, d, "conversations").where(F.size(T.tokens(F.col("text"))) > 0).agg(F.max(F.size(T.tokens(F.col("text")))).cast("long").alias("longest"), F.count("*").alias("n_texts"))


_SCALE = "CASE utt_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 7 END"


@query(f"SELECT w.*, s.* EXCLUDE (utt_id, response_duration), CAST({_SCALE.replace('utt_id', 'w.utt_id')} AS DOUBLE) AS level FROM ({SQL['word_features']}) w JOIN ({SQL['silence_features']}) s ON w.utt_id = s.utt_id")
def feature_rows(spark, d):
    """The wide row; the scale comes from the id."""
    ctm = _ctm(spark, d)
    number = F.col("utt_id") % 5
    scale = F.when(number == 0, "a1").when(number == 1, "A2").when(number == 2, "b1+").when(number == 3, "B2").otherwise("preA1")
    utts = ctm.select("utt_id").distinct().withColumn("scale", scale)
    parts = [rounded(f(ctm), nudge=1e-9) for f in (fluency.word_features, fluency.silence_features)]
    return features.feature_rows(utts, parts)


@query(f"WITH {CTM}, f AS (SELECT utt_id, CASE WHEN conf > 0.3 THEN conf ELSE 0 END AS f0, CASE WHEN conf > 0.3 THEN conf END AS nz, dur AS e FROM ctm), m AS (SELECT *, avg(f0) OVER w AS f0_m, avg(nz) OVER w AS nz_m, avg(e) OVER w AS e_m FROM f WINDOW w AS (PARTITION BY utt_id)) SELECT utt_id, {_stats_sql('f0', 'f0')}, {_stats_sql('nz', 'f0_nz')}, {_stats_sql('e', 'energy')} FROM m GROUP BY utt_id")
def frame_features(spark, d):
    """F0 and energy statistics over a frame table."""
    frames = _ctm(spark, d).select("utt_id", F.col("ord").alias("i"), F.when(F.col("conf") > 0.3, F.col("conf")).otherwise(F.lit(float("nan"))).alias("f0"), F.col("dur").alias("energy"))
    return rounded(features.frame_features(frames), nudge=1e-9)


@query(f"WITH {CONV} SELECT label, count(*) AS n FROM conv WHERE lower(label) NOT IN ('the', 'a', 'of', 'to', 'and', 'in') GROUP BY label")
def stop_words_removed(spark, d):
    """F11, with a fixed small list."""
    stop = spark.createDataFrame([(w,) for w in ("the", "a", "of", "to", "and", "in")], "word string")
    return vocabulary.without_stop_words(_conv(spark, d), stop).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {GOP}, m AS (SELECT phone, dur, raw, avg(dur) OVER w AS dur_m, avg(raw) OVER w AS raw_m FROM gop WINDOW w AS (PARTITION BY phone))
SELECT phone, {_stats_sql("dur", "duration")}, {_stats_sql("raw", "score")} FROM m GROUP BY phone""")
def phone_statistics(spark, d):
    """The eight statistics of duration and raw score of each phone over the whole corpus; groups grow with it."""
    return rounded(described_large(_gop(spark, d), ["phone"], {"duration": F.col("dur"), "score": F.col("raw")}), nudge=1e-9)


@query(f"""WITH {CTM}, sp AS (SELECT utt_id, ord, label, round(conf + 1e-9, 2) AS conf, round(start, 2) AS start, round(start + dur, 2) AS "end" FROM ctm), tot AS (SELECT utt_id, max("end") + 0.5::DOUBLE AS total FROM sp GROUP BY utt_id),
e AS (SELECT *, ord = min(ord) OVER w AS f, ord = max(ord) OVER w AS l FROM sp JOIN tot USING (utt_id) WINDOW w AS (PARTITION BY utt_id)),
n AS (SELECT utt_id, ord, label, conf, f, l, total, CASE WHEN f AND start = 0 THEN start + 0.0001 ELSE start END AS start, CASE WHEN l AND "end" = total THEN "end" - 0.0001 ELSE "end" END AS "end" FROM e),
p AS (SELECT utt_id, ord, label, conf, start, "end", total FROM n UNION ALL SELECT utt_id, ord - 1, NULL, NULL, 0.0, start, total FROM n WHERE f AND start > 0 UNION ALL SELECT utt_id, ord + 1, NULL, NULL, "end", total, total FROM n WHERE l AND "end" < total),
t AS (SELECT utt_id, 'CorrectWord' AS tier, ord, start, "end", coalesce(label || ',' || CAST(conf AS VARCHAR), '') AS label, total FROM p UNION ALL SELECT utt_id, 'PerceivedPhone', ord, start, "end", coalesce(string_split(label, '_')[1], ''), total FROM p
UNION ALL SELECT utt_id, 'PerceivedPhoneIPA', ord, start, "end", '', total FROM p UNION ALL SELECT utt_id, 'Notes', 1, 0.0, total, '', total FROM tot)
SELECT utt_id, tier, CAST(ord AS INTEGER) AS ord, round(start, 6) AS start, round("end", 6) AS "end", label, round(total, 6) AS total FROM t""")
def annotation_tiers(spark, d):
    """The four tiers of every utterance's annotation file."""
    words = _ctm(spark, d).select("utt_id", "ord", "label", F.round(F.col("conf") + 1e-9, 2).alias("conf"), F.round("start", 2).alias("start"), F.round(F.col("start") + F.col("dur"), 2).alias("end"))
    totals = words.groupBy("utt_id").agg((F.max("end") + 0.5).alias("total"))
    return rounded(textgrid.annotation_tiers(words, words.drop("conf"), totals))
