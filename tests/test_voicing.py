"""Voiced stretches in blocks and on streams against the plain automaton over a whole list."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators.voicing import Block, voiced, voiced_segments


def frames_of(rng, n):
    return [rng.random() < (0.95 if k // 15 % 2 else 0.05) for k in range(n)]


def test_blocks_know_their_case():
    rng = random.Random(3)
    for _ in range(400):
        buffer, share, size = rng.choice([1, 3, 10]), rng.choice([0.9, 0.5, 0.2]), rng.choice([1, 2, 7, 40, 200])
        speech = frames_of(rng, rng.randrange(1, 150))
        text, code, turns = "".join("01"[x] for x in speech), 0, []
        for at in range(0, len(text), size):
            block = Block(text[max(0, at - buffer) : at], text[at : at + size], buffer, share)
            turns += [(opens, at + place) for opens, place in block.turns(code)]
            code = block.ends()[code]
        places = [at for _, at in turns]
        ends = [(b - 1) * 0.03 + 0.03 for b in places[1::2]]
        assert [opens for opens, _ in turns] == [k % 2 == 0 for k in range(len(turns))]
        assert list(zip((a * 0.03 for a in places[::2]), ends + [(len(text) - 1) * 0.03] * (len(places) % 2))) == voiced(speech, 0.03, buffer, share)


@pytest.mark.parametrize("block", [4, 25, 20_000])
def test_utterances_in_blocks(spark, block):
    rng = random.Random(5)
    speech = {u: frames_of(rng, rng.randrange(5, 160)) for u in ["a", "b", "c", None]}
    rows = [(u, k * 2 - 7, s) for u, all_ in speech.items() for k, s in enumerate(all_)]  # ordinals with gaps, some below 0
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "utt_id string, i int, is_speech boolean").withColumns({"block": F.lit("x"), "text": F.lit(1), "key": F.lit(2)})
    got = sorted(map(tuple, voiced_segments(df, 0.03, block_frames=block).collect()), key=str)
    assert got == sorted(((u, k, a, b) for u, all_ in speech.items() for k, (a, b) in enumerate(voiced(all_, 0.03))), key=str)


def test_odd_frames(spark):
    kind = "utt_id long, i double, is_speech boolean"
    assert voiced_segments(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, None, True)] * 2 + [(1, float(k // 2), True) for k in range(40)] + [(1, 50.0 + k, None) for k in range(12)]
    got = voiced_segments(spark.createDataFrame(rows, kind), 1.0, block_frames=6).collect()
    assert [tuple(r) for r in got] == [(1, 0, a, b) for a, b in voiced([True] * 42 + [False] * 12, 1.0)]


def test_one_long_utterance_is_many_tasks(spark):
    """300,000 frames of one utterance: its blocks go to several partitions, and the stretches are those of the list."""
    frames = spark.range(300_000).select(F.lit(7).alias("utt_id"), "id", (F.col("id") % 50 < 30).alias("is_speech")).withColumnRenamed("id", "i")
    got = voiced_segments(frames, 1.0, block_frames=10_000).orderBy("segment").collect()
    assert [(r.start, r.end) for r in got] == voiced([k % 50 < 30 for k in range(300_000)], 1.0)


def test_live_frames(spark, tmp_path):
    """Three micro-batches that cut stretches give those of the whole utterance; a later frame of another one ends it by the watermark."""
    from parlance.streaming.voicing import streaming_voiced_segments

    rng = random.Random(8)
    speech = {u: frames_of(rng, 118) for u in ("a", "b")}
    rows = [(u, k, s, 1000 + k) for u, all_ in speech.items() for k, s in enumerate(all_)]
    df, late = (spark.createDataFrame(r, "utt_id string, i int, is_speech boolean, sec int").withColumn("ts", F.timestamp_seconds("sec")).drop("sec") for r in (rows, [("z", 0, False, 100_000)]))
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = streaming_voiced_segments(spark.readStream.schema(df.schema).parquet(folder))
    query = stream.writeStream.format("memory").queryName("voiced_live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for part in (df.where("i < 37"), df.where("i >= 37 AND i < 80"), df.where("i >= 80"), late):
            part.coalesce(1).write.mode("append").parquet(folder)
            query.processAllAvailable()
        got = sorted(map(tuple, spark.table("voiced_live").collect()))
    finally:
        query.stop()
    assert got == sorted((u, k, a, b) for u, all_ in speech.items() for k, (a, b) in enumerate(voiced(all_, 0.03)))
