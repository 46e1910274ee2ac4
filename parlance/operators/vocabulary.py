"""Word counts, vocabularies, lexicon lookups and out-of-vocabulary handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .prefix import fresh


def word_frequency(texts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Occurrences of each token (of each key), most frequent first, ties by token."""
    keys = keys or []
    return texts.select(*keys, F.explode(tokens(F.col("text"))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n")).orderBy(*keys, F.desc("n"), "token")


def missing_words(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Lower-cased words of the texts that the lexicon lacks."""
    words = texts.select(F.explode(tokens(F.lower("text"))).alias("word")).distinct()
    return words.join(lexicon.select("word").distinct(), "word", "left_anti")


def first_missing(words: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the first word that the lexicon lacks, for sequences (keys, ord, label) that hold one."""
    low = words.withColumn("word", F.lower("label"))
    return low.join(lexicon.select("word").distinct(), "word", "left_anti").groupBy(*keys).agg(F.min_by("word", "ord").alias("first_oov"), F.count("*").alias("n_oov"))


def upper_share(texts: DataFrame) -> DataFrame:
    """Whether the texts, all of them, hold more upper- than lower-case letters: one row. Other characters go by runs, each a match."""
    up, low = (F.coalesce(F.sum(F.length(F.regexp_replace("text", p, ""))), F.lit(0)) for p in (r"\P{Lu}+", r"\P{Ll}+"))
    return texts.agg((up > low).alias("upper"))


BITS = 64


def replace_missing(texts: DataFrame, lexicon: DataFrame, keys: list[str], upper: bool) -> DataFrame:
    """keys and texts with <UNK> for words that the lexicon lacks (compared in lower case) and one case for the rest; blank texts fall out.

    Each word meets the lexicon with its place (a small lexicon is broadcast by Spark, and a skewed word of a large one is split by it). What comes back
    is a bit for each place, 64 in a number, so words are neither shuffled nor sorted to put a text together again: texts and their bits meet by the SHA-256
    of the text, and words find theirs by place. Work is in proportion to the words, whatever a text's length; texts are read twice. Rows of equal keys are
    texts of their own, equal texts share their bits.
    """
    text, code, word, place, known, block, bits = fresh(texts, "text", "code", "word", "place", "known", "block", "bits")
    coded = texts.select(*keys, F.col("text").alias(text)).withColumn(code, F.unhex(F.sha2(F.col(text), 256)))
    rows = coded.select(code, F.posexplode(tokens(F.col(text))).alias(place, word))
    lexicon = lexicon.select(F.col("word").alias(known)).distinct()
    found = rows.join(lexicon, F.lower(word) == F.col(known), "left")
    bit = F.when(F.col(known).isNull(), F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(place) % BITS))
    numbers = found.groupBy(code, F.floor(F.col(place) / BITS).cast("int").alias(block)).agg(F.bit_or(bit).alias(bits))
    marks = numbers.groupBy(code).agg(F.transform(F.sort_array(F.collect_list(F.struct(block, bits))), lambda x: x[bits]).alias(bits))  # no block is missing
    cased = lambda w: F.upper(w) if upper else F.lower(w)
    has = lambda i: F.getbit(F.get(bits, F.floor(i / BITS).cast("int")), i % BITS) == 1
    filled = F.transform(tokens(F.col(text)), lambda w, i: F.when(has(i), cased(w)).otherwise("<UNK>"))
    return coded.join(marks, code).select(*keys, F.array_join(filled, " ").alias("text"))


def even_split(ctm: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Phones of each word by the lexicon, each an equal share of the word's time; words it lacks fall out."""
    rows = ctm.join(lexicon, ctm["label"] == lexicon["word"]).where(F.size("phones") > 0)
    rows = rows.select(*ctm.columns, F.posexplode("phones").alias("pos", "phone"), F.size("phones").alias("n"))
    share = F.col("dur") / F.col("n")
    return rows.select("utt_id", "ord", "label", "pos", "phone", (F.col("start") + F.col("pos") * share).alias("start"), share.alias("dur"))


def split_totals(ctm: DataFrame, lexicon: DataFrame) -> DataFrame:
    """phone, pos and, over all words, the sums of what even_split gives for them: n, starts, durs.

    Words are summed before they meet the lexicon, so a frequent word is one row there: start + pos x share is linear in both.
    """
    words = ctm.groupBy(F.col("label").alias("word")).agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("dur").alias("durs"))
    rows = words.join(lexicon.where(F.size("phones") > 0), "word").select("n", "starts", "durs", F.size("phones").alias("size"), F.posexplode("phones").alias("pos", "phone"))
    share = F.col("durs") / F.col("size")
    return rows.groupBy("phone", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("starts") + F.col("pos") * share).alias("starts"), F.sum(share).alias("durs"))


def phone_texts(words: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the phones of each text in order, joined by spaces; words that the lexicon lacks have none."""
    found = words.withColumn("word", F.lower("label")).join(lexicon.select("word", "phones"), "word")
    parts = F.sort_array(F.collect_list(F.struct("ord", "phones")))
    return found.groupBy(*keys).agg(F.array_join(F.flatten(F.transform(parts, lambda x: x["phones"])), " ").alias("phone_text"))


def extended(lexicon: DataFrame, found: DataFrame) -> DataFrame:
    """The lexicon and the pronunciations of words that it lacks (of several, the least)."""
    new = found.join(lexicon.select("word"), "word", "left_anti").groupBy("word").agg(F.min("phones").alias("phones"))
    return lexicon.select("word", "phones").unionByName(new)


def token_lists(symbols: DataFrame) -> DataFrame:
    """kind and token: `disfluency` for symbols that begin with @ or <, `silence` for each symbol and what comes before its position tag."""
    first = F.split_part("symbol", F.lit("_"), F.lit(1))
    loud = symbols.where(F.substring("symbol", 1, 1).isin("@", "<")).select(F.lit("disfluency").alias("kind"), F.col("symbol").alias("token"))
    quiet = symbols.select(F.lit("silence").alias("kind"), F.explode(F.array("symbol", first)).alias("token"))
    return loud.unionByName(quiet).distinct()


def letter_phones(words: DataFrame) -> DataFrame:
    """A stand-in pronunciation: the letters of a word. It is not a pronunciation model."""
    return words.select("word", F.filter(F.split("word", ""), lambda c: c.rlike(r"\p{L}")).alias("phones"))


def rolled_up(utts: DataFrame, key: str, order: str, text: Column, label: str, per: int = 1000) -> DataFrame:
    """Texts of a speaker joined in order, in parts: key, part, text, n_utts and the label of the speaker's first utterance.

    order: an integer. A part holds the utterances of one stretch of `per` numbers, so none grows with the speaker; the parts one after
    another, with a space between, are the whole text.
    """
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x["t"]), " ")
    part = F.floor(F.col(order) / per).alias("part")
    cut = utts.groupBy(key, part).agg(parts.alias("text"), F.count("*").alias("n_utts"), F.min(F.struct(order, F.col(label).alias("label"))).alias("first"))
    first = cut.groupBy(key).agg(F.min("first").getField("label").alias("label"))
    return cut.drop("first").join(first, key)


def first_labels(utts: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """utts with the label of their key; a key without one is an error where its rows are computed."""
    missing = F.raise_error(F.concat(F.lit(f"no label for {key} "), F.col(key).cast("string")))
    (found,) = fresh(utts, "found")
    both = utts.join(labels.select(key, "label", F.lit(True).alias(found)), key, "left")
    return both.withColumn("label", F.when(F.col(found), F.col("label")).otherwise(missing)).drop(found)


def without_stop_words(words: DataFrame, stop_words: DataFrame) -> DataFrame:
    """words (with a label) less those whose lower-cased label is a stop word."""
    return words.withColumn("word", F.lower("label")).join(stop_words.select(F.lower("word").alias("word")).distinct(), "word", "left_anti").drop("word")


def label_check(ctm: DataFrame, least: int = 10) -> DataFrame:
    """Distinct labels of an alignment, and whether they are suspiciously few: one row."""
    return ctm.agg(F.count_distinct("label").alias("n_labels")).withColumn("suspicious", F.col("n_labels") < least)
