"""Nulls, empty and very long texts, repeated rows, empty tables, extra columns: every operator."""

import pytest
from pyspark.sql import functions as F

from parlance.llm import decontaminate, html_text, langid, lm_scoring, media, near_dedup, pii, sentencepiece_codec, sharding, suffix_dedup

WORDS = "the cat sat on the mat and saw a dog that ran to the house by the sea"
LONG = " ".join(f"{WORDS} {k}" for k in range(4000))
ROWS = [
    (1, WORDS, "en", None), (1, WORDS, "en", None), (2, None, "en", "x"), (3, "", None, "x"), (None, WORDS + " again", "en", "y"), (None, None, None, None), (4, "   \n ", "de", "z"), (5, LONG, "en", "z"), (6, "x", "en", "z"),
    (7, "a" * 30_000, "en", "z"), (8, "@" * 5000 + " 1.2.3.4 é  \U0001f600 + 1" + "9" * 5000, "en", "z"), (9, "ein Hund und eine Katze sind im Haus", "de", "z"), (10, LONG + " end", "en", "z"),
]
CLASH = ["row", "node", "h", "mark", "bucket", "shard", "band", "part", "block", "task", "spans", "n", "label"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def model(spark, docs):
    return langid.fit(docs)


def operators(spark, model):
    items = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (3, ""), (None, "x"), (1, "the cat sat on the mat"), (4, "nowhere at all")], "item_id long, text string")
    return {
        "langid": lambda d: langid.identify(d, model),
        "sentencepiece": sentencepiece_codec.encoded,
        "pii": pii.find_personal_data,
        "lm": lm_scoring.score_documents,
        "sharding": lambda d: sharding.shard_rows(d, shards=3, min_buckets=4, cell_rows=2),
        "suffix": suffix_dedup.remove_repeats,
        "media": media.media_digest,
        "near": near_dedup.near_duplicates,
        "decontaminate": lambda d: decontaminate.contamination(d, items),
        "html": lambda d: html_text.main_text(d.withColumnsRenamed({"doc_id": "page_id", "source": "url", "text": "html"})),
    }


NAMES = ["langid", "sentencepiece", "pii", "lm", "sharding", "suffix", "media", "near", "decontaminate", "html"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_comes_back(spark, docs, model, name):
    got = operators(spark, model)[name](docs).toPandas()
    key = "page_id" if name == "html" else "doc_id"
    assert len(got) == len(ROWS)
    assert sorted(got[key].dropna().tolist()) == sorted(r[0] for r in ROWS if r[0] is not None)
    if name not in ("sharding",):  # repeated rows: repeated results
        assert got[got[key] == 1].astype(str).drop_duplicates().shape[0] == 1
    assert not set(got.columns) & set(CLASH) - {"shard", "spans"}


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, model, name):
    assert operators(spark, model)[name](docs.limit(0)).count() == 0


def test_keepers_keep_columns(spark, docs, model):
    for kept in (langid.keep_identified(docs, model), near_dedup.keep_one(docs), decontaminate.keep_clean(docs, docs.select(F.lit(1).alias("item_id"), F.lit("qq").alias("text")).limit(1)), pii.mask_personal_data(docs)):
        assert set(kept.columns) == set(docs.columns)
        assert kept.count() > 0
    assert near_dedup.keep_one(docs).where("doc_id = 1").count() == 1
    assert near_dedup.keep_one(docs).where("doc_id is null").count() == 1  # the other is near document 1


def test_no_language_to_learn(spark, docs):
    none = langid.fit(docs.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_decoded_edges(spark, docs):
    back = sentencepiece_codec.decoded(sentencepiece_codec.encoded(docs)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r[0] or 0, r[1] or "") for r in ROWS)
    odd = spark.createDataFrame([(1, None, "x"), (None, [], "x"), (2, [], None)], "doc_id long, ids array<int>, text string")
    assert sorted(((r.doc_id or 0, r.text) for r in sentencepiece_codec.decoded(odd).collect()), key=str) == [(0, ""), (1, None), (2, "")]
    assert sentencepiece_codec.decoded(odd.limit(0)).count() == 0


def test_media_edges(spark, docs):
    stored = media.media_column(docs)
    assert stored.columns == ["doc_id", "avi"] and stored.count() == len(ROWS) and stored.where("avi is null").count() == 0
    clips = media.clip_rows(docs).groupBy("doc_id").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b")).collect()
    assert {r.doc_id for r in clips} == {r[0] for r in ROWS} and all(r.a == 0 and r.b > 0 for r in clips)
    for made in (media.media_column(docs.limit(0)), media.clip_rows(docs.limit(0)), media.clips_of(stored.limit(0))):
        assert made.count() == 0
