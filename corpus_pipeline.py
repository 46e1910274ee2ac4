"""Corpus pipeline over `documents`: language ID, near-dedup, decontamination, PII masking, SentencePiece ids.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages 1 to 4 return the columns of
documents; the last returns doc_id, n_tokens, ids, ids_sha256, round_trip and parity.

All stages take nulls in any column, empty and very long texts, repeated rows, other columns beside those of documents, and empty tables (which give
empty tables). Rows without an id are judged as all others. The first stage drops null and letterless texts; the others keep null texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontaminate, langid, near_dedup, pii, sentencepiece_codec
from parlance.llm.common import parquet, stored
from parlance.llm.queries import held_out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is a language that the labels teach; null texts and texts without letters go, equal texts alike.

    Without any label there is no language to know, and nothing is kept.
    """
    return langid.keep_identified(docs, langid.fit(docs.where(~held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least id, or one without an id if none of the class has one.

    Rows equal in id and text are one; wordless texts are near nothing.
    """
    return near_dedup.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in passages of benchmark items; wordless ones stay, repeated rows share their fate."""
    return decontaminate.keep_clean(docs, parquet(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text. Null texts stay null; repeated rows stay."""
    masked = pii.mask_personal_data(docs)
    return masked.selectExpr(*(f"cast(char_length(text) as bigint) as {c}" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, decoded again and held against the sentencepiece library; null and empty texts have none."""
    return sentencepiece_codec.encoded(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: Language models, sketches and the tokenizer cannot be said in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each but the last written to the shared folder and read again."""
    docs = parquet(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
