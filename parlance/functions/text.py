"""Token and label functions on columns; no Python runs on the executors."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks, word lists and label tables that results must agree on.
INTERREGNUM = {"@ehm": "", "@mm": "", "@mmh": "", "@ns": "", "@nuh": "", "@ug": "", "@whoah": "", "@unk": "<unk>", "@uh": "UH", "@um": "UM", "@em": "EM", "@eh": "AH"}
FILLED_PAUSES = ("AH", "UM", "UH", "EM", "ER", "ERR")
DISFLUENT_WORDS = ("AH", "UM", "UH", "EM", "OH", "ER", "ERR", "ah", "um", "uh", "em", "oh", "er", "err")
BASELINE_WORDS = ("UM", "UH", "um", "uh")
PHRASES = ("you know", "i mean", "well", "like")
NOISES = ("@breath", "@cough", "@laugh", "@bkg", "@ns", "@sil")
SILENT_PHONES = ("sil", "@sil", "spn")
VOWELS = ("ah", "aa", "ih", "aw", "w", "axr", "ow", "ao", "y", "eh", "ay", "uh", "q", "ey", "ae", "iy", "oy", "uw", "ax", "er")
CONSONANTS = ("l", "zh", "s", "z", "ng", "g", "k", "th", "d", "dh", "w", "p", "n", "t", "r", "sh", "ch", "hh", "b", "jh", "f", "m", "v")
SCALE_ELEVEN = {"0": 0, "preA1": 1, "A1": 2, "A1+": 3, "A2": 4, "A2+": 5, "B1": 6, "B1+": 7, "B2": 8, "B2+": 9, "C": 10}
SCALE_EIGHT = {"0": 0, "A1": 1, "A1+": 2, "A2": 3, "A2+": 4, "B1": 5, "B1+": 6, "B2": 7}
SCALE_LOWER = {k.lower(): v for k, v in SCALE_EIGHT.items()}


def tokens(text: Column) -> Column:
    """Words between white space; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())), key)


def map_interregnum(words: Column) -> Column:
    """Transcription marks to filled pauses or empty tokens; the tokens' places stay."""
    return F.transform(words, lambda t: F.coalesce(lookup(INTERREGNUM, F.lower(t)), t))


def blank_interregnum(words: Column) -> Column:
    return F.transform(words, lambda t: F.when(F.lower(t).isin(*INTERREGNUM), "").otherwise(t))


def drop_filled_pauses(words: Column) -> Column:
    """Without filled pauses and unknown words, unless nothing would be left."""
    kept = F.filter(words, lambda t: ~F.upper(t).isin(*FILLED_PAUSES, "<UNK>"))
    return F.when(F.size(kept) == 0, words).otherwise(kept)


def blank_partial(words: Column) -> Column:
    return F.transform(words, lambda t: F.when(t.startswith("-") | t.endswith("-"), "").otherwise(t))


def normal_phone(phone: Column) -> Column:
    """Position tag and stress digits off, lower case."""
    return F.lower(F.regexp_replace(F.split_part(phone, F.lit("_"), F.lit(1)), r"\d+", ""))


def phone_class(phone: Column) -> Column:
    """V, C or O; vowels first, so w, y and q are vowels."""
    return F.when(phone.isin(*VOWELS), "V").when(phone.isin(*CONSONANTS), "C").otherwise("O")


def disfluency_tag(word: Column) -> Column:
    return F.when(word == "@sil", "D").when(word.contains("@") & ~word.isin(*NOISES), "D").otherwise("O")


def is_stressed(phone: Column) -> Column:
    """IPA stress mark, or a stress digit 1 to 3."""
    return phone.contains("'") | phone.rlike("[1-3]")


def phrase_count(text: Column, phrase: str) -> Column:
    """Occurrences inside the lower-cased text, inside words too, without overlap."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def nullable(value: Column) -> Column:
    """`none` in any case is null."""
    return F.when(F.lower(value) != "none", value)


def level_from_id(utt: Column) -> Column:
    """Proficiency label inside an id, for ids that name A1, A2 or B1."""
    inner = F.get(F.split(F.get(F.split(utt, "-"), F.lit(1)), "_"), F.lit(1))
    return F.when(utt.rlike("A1|A2|B1"), inner)
