"""Speech operators against hand-made values, brute force, and round trips through files."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import scores, stats, text as T
from parlance.operators import alignment, combine, fluency, intervals, pronunciation, regression, rhythm, vocabulary, vowels
from parlance.sources import lines, loaders, sinks


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def close(got, **want):
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-5), k


CTM = "utt_id string, ord int, label string, start double, dur double, conf double"


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([("u", 1, "WELL", 0.5, 0.3, 0.8), ("u", 2, "UM", 1.0, 0.2, 0.4), ("u", 3, "UM", 1.3, 0.2, 0.6), ("u", 4, "GOOD", 2.1, 0.4, 1.0)], CTM)


def test_silences(spark, words):
    got = one(fluency.silence_features(words))
    close(got, sil_number=2, sil_mean=0.4, sil_std=0.2, sil_median=0.4, sil_mad=0.2, sil_summ=0.8, sil_max=0.6, sil_min=0.2, sil_rate1=1.0, sil_rate2=0.5, response_duration=2.0)
    close(got, long_sil_number=1, long_sil_mean=0.6, long_sil_std=0, long_sil_mad=0, long_sil_rate1=0.5, long_sil_rate2=0.25)
    two = one(fluency.silence_features(spark.createDataFrame([("v", 1, "a", 0.0, 0.5, 1.0), ("v", 2, "b", 1.5, 0.5, 1.0)], CTM)))
    assert all(two[f"{p}_{n}"] == 0 for p in ("sil", "long_sil") for n in stats.NAMES)


def test_words(words):
    got = one(fluency.word_features(words))
    close(got, word_duration_mean=0.275, word_duration_std=0.082916, word_duration_median=0.25, word_duration_mad=0.075, word_duration_summ=1.1, word_conf_mean=0.7, word_conf_std=0.223607, word_conf_mad=0.2, word_conf_summ=2.8)
    close(got, word_count=4, word_freq=2.0, word_distinct=3, word_num_repeat=1, word_num_disfluency=2, word_num_disfluency_baseline=2)
    assert one(fluency.phrase_features(words, ["utt_id"]))["well"] == 1
    close(one(fluency.phone_features(words)), phone_count=4, phone_freq=2.0)


def test_rhythm(spark):
    rows = [("DH_B", 0, 0.05), ("AH0_E", 0.05, 0.10), ("K_B", 0.15, 0.08), ("AE1_I", 0.23, 0.14), ("T_E", 0.37, 0.06)]
    df = spark.createDataFrame([("u", k, p, d) for k, (p, _, d) in enumerate(rows)], "utt_id string, ord int, phone string, dur double").withColumn("phone", T.normal_phone(F.col("phone")))
    got = one(rhythm.rhythm_features(df, ["utt_id"]))
    close(got, num_nucleus=2, num_consonants=3, v_to_c_ratio=0.666667, mean_p_dur=107.5, mean_v_dur=240, mean_c_dur=95, p_sum_variance=7431.25, p_std_dev=43.102349, v_std_dev=172.046505, c_std_dev=41.68333, varco_P=40.095208, varco_V=71.686044, varco_C=43.877189, percent_v=55.813953, speech_rate=4.651163)
    close(got, rpvi=0.0525, rpvi_v=0.01, rpvi_c=0.0125, npvi=0.558586, npvi_v=0.083333, npvi_c=0.186813, cci=0.01875, cci_v=0.005, cci_c=0.01875)
    none = one(rhythm.rhythm_features(df.where("phone = 'k'"), ["utt_id"]))
    assert len(none) == 32 and all(v == 0 for k, v in none.items() if k != "utt_id")


def test_scores(spark):
    df = spark.createDataFrame([(0.0, False, 0.0), (-1.0, False, 1.0), (-4.0, False, -2.0), (-4.0, True, 5.0)], "raw double, silent boolean, z double")
    rows = df.select(scores.pronunciation(F.col("raw"), F.col("silent")).alias("p"), scores.duration_fluency(F.col("z")).alias("f"), scores.confidence(F.lit(123.0)).alias("c")).collect()
    assert [r.p for r in rows] == pytest.approx([100, 53.788284, 3.597242, 0.719448], abs=1e-5)
    assert [r.f for r in rows] == pytest.approx([100, 92.5, 80, 0], abs=1e-5) and rows[0].c == 1


def test_threshold_search(spark):
    df = spark.createDataFrame([("x", 0.95, True), ("x", 0.8, True), ("x", 0.55, False), ("x", 0.45, True), ("x", 0.2, False)], "phone string, gop double, correct boolean")
    got = one(pronunciation.threshold_search(df))
    assert got["k"] == 6 and got["f1"] == pytest.approx(0.8)
    used = pronunciation.apply_thresholds(df.withColumn("phone", F.lit("new")), pronunciation.threshold_search(df), pronunciation.threshold_search(df.withColumn("phone", F.lit("new"))))
    close(one(pronunciation.report(used, ["phone"])), tp=2, fp=0, fn=1, tn=2, weighted_f1=0.8, accuracy=0.8)


def test_words_of_phones(spark):
    df = spark.createDataFrame([("u", k, p, -1.0, False) for k, p in enumerate(["a_B", "b_E", "c_S", "d_B", "e_E"])], "utt_id string, ord int, phone string, raw double, silent boolean")
    got = pronunciation.segment_words(df, ["utt_id"], F.col("phone").rlike("[ES]$")).orderBy("ord").collect()
    assert [r.word_ord for r in got] == [0, 0, 1, 2, 2]


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 1.0, 7.0), (2.0, 3.0, 7.0), (3.0, 2.0, 7.0), (4.0, 4.0, 7.0)], "x double, level double, constant double")
    got = {r.feature: r.asDict() for r in regression.feature_regression(df, ["x", "constant"], "level").collect()}
    close(got["x"], slope=0.8, intercept=0.5, r2=0.64, rmse=0.670820, accuracy_0_5=50, accuracy_1_0=100)
    assert got["constant"]["r2"] is None and got["constant"]["rmse"] == pytest.approx(math.sqrt(1.25))
    assert one(regression.spearman(df, "x", "constant"))["rho"] is None
    assert one(regression.spearman(df, "x", "level"))["rho"] == pytest.approx(0.8)


def test_ranks_over_many_buckets(spark):
    rng = random.Random(1)
    values = [float(rng.randrange(200)) for _ in range(1000)]
    got = stats.average_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v", "r").collect()
    order = sorted(values)
    for r in got:
        first = order.index(r.v)
        assert r.r == first + 1 + (order.count(r.v) - 1) / 2


@pytest.mark.parametrize(
    "ref,hyp,tilted,kinds,fer,der",
    [
        ("i UM want the cat", "i want cat", True, "mdmdm", 0.25, 0.0), ("i UM want the cat", "i um want the cat", True, "mmmmm", 0.0, 1.0),
        ("UM i want", "i i want", True, "smm", 0.0, 1.0), ("well", "x well", False, "im", 1.0, None),
    ],
)
def test_alignment(spark, ref, hyp, tilted, kinds, fer, der):
    path = alignment.align(ref.split(), hyp.split(), tilted)
    assert "".join(k[0] for k, _, _ in path) == kinds
    got = one(alignment.disfluency_rates(alignment.alignments(spark.createDataFrame([(1, ref.split(), hyp.split())], "id long, ref array<string>, hyp array<string>"), ["id"], tilted), ["id"]))
    assert got["fer"] == fer and got["der"] == der


def test_alignment_paths_are_cheapest():
    rng = random.Random(3)
    for _ in range(3000):
        ref = [rng.choice(["a", "b", "A", "B", "c"]) for _ in range(rng.randrange(1, 8))]
        hyp = [rng.choice("abcd") for _ in range(rng.randrange(8))]
        path = alignment.align(ref, hyp)
        assert [r for _, r, _ in path if r] == ref and [h for _, _, h in path if h] == hyp
        cost = sum({"match": 0 if (r or "").lower() == h else 4, "substitution": 4, "deletion": 3, "insertion": 3}[k] for k, r, h in path)
        table = [[3 * j for j in range(len(hyp) + 1)]]
        for i, w in enumerate(ref):
            line = [3 * (i + 1)]
            for j, h in enumerate(hyp):
                line.append(min(line[j] + 3, table[i][j + 1] + 3, table[i][j] + 4 * (w.lower() != h)))
            table.append(line)
        assert cost == table[-1][-1]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_word_error_rate(spark):
    rng = random.Random(4)
    pairs = [(k, [rng.choice("abc") for _ in range(rng.randrange(9))], [rng.choice("abc") for _ in range(rng.randrange(9))]) for k in range(200)] + [(999, None, ["a"]), (998, ["a"], None)]
    got = {r.id: r for r in alignment.word_error_rate(spark.createDataFrame(pairs, "id long, ref array<string>, hyp array<string>")).collect()}
    for k, a, b in pairs:
        if a is None or b is None:
            assert got[k].edits is None
        else:
            assert got[k].edits == _distance(a, b)
            assert got[k].wer == (_distance(a, b) / len(a) if a else None)


def test_long_pairs(spark, monkeypatch):
    rng = random.Random(5)
    long = [([rng.choice(["a", "b", "A", "UH", "c"]) for _ in range(rng.randrange(60, 300))], [rng.choice("abcd") for _ in range(rng.randrange(60, 300))]) for _ in range(12)] + [(["A"] * 5000, ["a"]), (["a"], ["b"] * 5000)]
    short = [([rng.choice(["a", "b", "A", "B", "c"]) for _ in range(rng.randrange(1, 9))], [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]) for _ in range(500)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(long)], "id long, ref array<string>, hyp array<string>")
    got = {r.id: r.edits for r in alignment.word_error_rate(df).collect()}
    assert got == {k: _distance(a, b) for k, (a, b) in enumerate(long)}
    for tilted in (True, False):
        monkeypatch.setattr(alignment, "SMALL", 1 << 30)
        whole = [alignment.align(a, b, tilted) for a, b in long + short]
        monkeypatch.setattr(alignment, "SMALL", 0)
        assert [alignment.align(a, b, tilted) for a, b in long + short] == whole


def test_pairs_are_whole(spark):
    from parlance.plans import catalog

    d = "/root/testdata/sf0.001"
    words = {(r.conv_id, r.turn): len(r.text.split()) for r in spark.read.parquet(f"{d}/conversations.parquet").where("text is not null").collect()}
    got = catalog.word_error_rate(spark, d).collect()
    assert max(words.values()) > 30 and {(r.conv_id, r.turn): r.ref_words for r in got} == {(r.conv_id, r.turn): words[r.conv_id, r.turn] for r in got}
    rates = {(r.conv_id, r.turn): sum(r[f"{k}_{x}"] for k in ("match", "substitution", "deletion") for x in "fd") for r in catalog.fer_der(spark, d).collect()}
    assert rates and all(n == words[k] for k, n in rates.items())


def test_frames(spark):
    frames = spark.createDataFrame([("u", k / 100, float(k)) for k in range(1, 101)], "utt_id string, t double, value double")
    times = spark.createDataFrame([("u", 1, 0.005), ("u", 2, 0.253), ("u", 3, 0.5), ("u", 4, 0.95), ("w", 5, 0.5)], "utt_id string, ord int, t double")
    got = {r.ord: r.left_value for r in intervals.frame_at(times, frames).collect()}
    assert got == {1: None, 2: 25.0, 3: 50.0, 4: 95.0, 5: None}
    grid = times.select("ord", intervals.regular_frame(F.col("t"), F.lit(1.0), F.lit(100)).alias("i")).collect()
    assert {r.ord: r.i for r in grid} == {1: 0, 2: 25, 3: 50, 4: 95, 5: 50}


def test_voiced():
    assert intervals.voiced([False] * 5 + [True] * 20 + [False] * 12, 0.03) == [pytest.approx((0.15, 1.05))]
    assert intervals.voiced([False] * 3 + [True] * 15, 0.03) == [pytest.approx((0.09, 0.51))]
    assert intervals.voiced([True] * 9, 0.03) == []


def test_interval_repair_and_padding(spark):
    df = spark.createDataFrame([("u", 1, "a", 0.0, 0.5, 1.0), ("u", 2, "b", 0.6, 0.2, 1.0), ("u", 3, "c", 0.4, 0.3, 1.0)], CTM)
    got = intervals.repaired(df).orderBy("ord").collect()
    assert [(r.start, r.end) for r in got] == [(0.0, 0.5), (0.5, 0.7), (0.4, 0.7)]
    whole = spark.createDataFrame([("u", 1, "a", 0.0, 0.4, 1.0), ("u", 2, "b", 0.5, 1.0, 1.0)], "utt_id string, ord int, label string, start double, end double, total double")
    padded = sorted((r.ord, r.label, round(r.start, 4), round(r.end, 4)) for r in intervals.padded(whole).collect())
    assert padded == [(0, "", 0.0, 0.0001), (1, "a", 0.0001, 0.4), (2, "b", 0.5, 0.9999), (3, "", 0.9999, 1.0)]
    near = spark.createDataFrame([("u", 1, 0.995), ("u", 2, 1.0)], "utt_id string, ord int, end double")
    assert {r.end for r in intervals.snapped(near).collect()} == {1.0}


def test_text(spark):
    df = spark.createDataFrame([("@uh hello @ns", "UM UM", "th- dog", "TLT-x_A2", "none"), (None, None, None, None, None)], "a string, b string, c string, d string, e string")
    w = lambda c: T.tokens(F.col(c))
    got = df.select(T.joined(T.map_interregnum(w("a"))).alias("a"), T.joined(T.drop_filled_pauses(w("b"))).alias("b"), T.joined(T.blank_partial(w("c"))).alias("c"), T.level_from_id(F.col("d")).alias("d"), T.nullable(F.col("e")).alias("e"), T.joined(F.transform(w("a"), T.disfluency_tag)).alias("t")).collect()
    assert got[0].asDict() == {"a": "UH hello ", "b": "UM UM", "c": " dog", "d": "A2", "e": None, "t": "D O O"}
    assert got[1].a == "" and got[1].d is None
    phones = spark.createDataFrame([("AH0_B",), ("w",), ("K",), ("sil",)], "p string").select(T.phone_class(T.normal_phone(F.col("p"))).alias("c"))
    assert [r.c for r in phones.collect()] == ["V", "V", "C", "O"]


def test_vocabulary(spark):
    lex = spark.createDataFrame([("the",), ("cat",)], "word string")
    texts = spark.createDataFrame([("u", "the dog cat")], "utt_id string, text string")
    rows = spark.createDataFrame([("u", 1, "the"), ("u", 2, "dog"), ("u", 3, "cat")], "utt_id string, ord int, label string")
    assert [r.word for r in vocabulary.missing_words(texts, lex).collect()] == ["dog"]
    assert one(vocabulary.first_missing(rows, lex, ["utt_id"]))["first_oov"] == "dog"
    told = spark.createDataFrame([("u", "The  dog cat"), ("v", None), ("w", " "), ("x", "CAT cat")], "utt_id string, text string")
    for upper, want in ((False, {"u": "the <UNK> cat", "x": "cat cat"}), (True, {"u": "THE <UNK> CAT", "x": "CAT CAT"})):
        assert {r.utt_id: r.text for r in vocabulary.replace_missing(told, lex, ["utt_id"], upper).collect()} == want
    split = vocabulary.even_split(rows.withColumns({"start": F.lit(1.0), "dur": F.lit(0.3)}), vocabulary.letter_phones(lex)).where("label = 'cat'").orderBy("pos").collect()
    assert [(r.phone, round(r.start, 2), round(r.dur, 2)) for r in split] == [("c", 1.0, 0.1), ("a", 1.1, 0.1), ("t", 1.2, 0.1)]


@pytest.mark.parametrize("n,k,sizes", [(10, 4, [3, 3, 3, 1]), (9, 4, [3, 3, 3]), (5, 3, [2, 2, 1])])
def test_chunks(spark, n, k, sizes):
    got = combine.chunked(spark.range(n).withColumn("id", F.col("id") * 7), "id", k).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in got] == sizes


def test_merging(spark):
    a, b = (spark.createDataFrame(r, "id long, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert {r.id: r.v for r in combine.merged([a, b], "id").collect()} == {1: "a", 2: "c", 3: "d"}
    assert {(r.id, r.side) for r in combine.unmatched(a, b, "id").collect()} == {(1, "left"), (3, "right")}
    assert combine.united([a, b.select("v", "id")], ["id", "v"]).count() == 4
    with pytest.raises(ValueError):
        combine.united([a, b.drop("v")], ["id", "v"])


def test_ellipse(spark):
    t = np.linspace(0, 2 * np.pi, 50, endpoint=False)
    x, y = 3 + 4 * np.cos(t) * np.cos(0.5) - 2 * np.sin(t) * np.sin(0.5), -1 + 4 * np.cos(t) * np.sin(0.5) + 2 * np.sin(t) * np.cos(0.5)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(2, 1.0, 1.0)], "vowel int, f1 double, f2 double")
    got = {r.vowel: r for r in vowels.vowel_ellipses(df).collect()}
    assert (got[1].center_f1, got[1].center_f2, got[1].axis_a, got[1].axis_b) == pytest.approx((3, -1, 4, 2), abs=1e-3) or (got[1].axis_b, got[1].axis_a) == pytest.approx((4, 2), abs=1e-3)
    assert got[2].center_f1 is None or not math.isnan(got[2].center_f1)


def test_files(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body, encoding="utf-8")
        return str(tmp_path / name)

    assert {r.word: r.phones for r in loaders.key_tokens(spark, put("lex", "a b c\nd e\n\n")).collect()} == {"a": ["b", "c"], "d": ["e"]}
    assert {r.utt_id: r.text for r in loaders.key_text(spark, put("text", "u1 x  y\nu2\n")).collect()} == {"u1": "x y", "u2": ""}
    assert {r.utt_id: r.value for r in loaders.key_value(spark, put("dur", "u 1.5\n"), kind="double").collect()} == {"u": 1.5}
    ctm = loaders.ctm(spark, put("ctm", "u 1 0.50 0.30 WELL\nu 1 1.0 0.2 UM 0.4\n"))
    assert [(r.ord, r.label, r.conf) for r in ctm.orderBy("ord").collect()] == [(1, "WELL", 1.0), (2, "UM", 0.4)]
    log = loaders.gop_log(spark, put("gop.log", "x LOG u1 <GOP> a b 0.1 -2 c d 0.2 -3\nother\n"), "LOG").collect()
    assert log[0].utt_id == "u1" and [(i.phone, i.pred, i.dur, i.raw) for i in log[0]["items"]] == [("a", "b", 0.1, -2.0), ("c", "d", 0.2, -3.0)]
    assert [r.gop for r in loaders.gop_vector(spark, put("gop", "u [ x 0.5 0.6 ]\n")).orderBy("ord").collect()] == [0.5, 0.6]
    assert [(r.phone, r.correct) for r in loaders.annotation_v1(spark, put("a1", "u p,q T,F\n")).orderBy("ord").collect()] == [("p", True), ("q", False)]
    assert [(r.utt_id, r.op, r.correct) for r in loaders.annotation_v2(spark, put("a2", "u ref a b\nu hyp a c\nu op C S I\njunk\n")).orderBy("ord").collect()] == [("u", "C", True), ("u", "S", False)]
    assert [(r.ord, r.score) for r in loaders.annotation_triples(spark, put("a3", "u,T,F,T,F,F\n")).collect()] == [(0, 2)]
    assert {r.utt_id: r.value.x for r in loaders.utts_json(spark, put("j", '{"utts": {"u": {"x": 1}}}'), "struct<x:int>").collect()} == {"u": 1}
    assert loaders.grader_tsv(spark, put("g.tsv", "﻿id\tscore\nu\t3\n")).columns[1] == "score"
    spans = spark.createDataFrame([("u", "words", 1, 0.0, 0.5, "hi"), ("u", "words", 2, 0.5, 1.0, ""), ("u", "phones", 1, 0.0, 1.0, "h")], "utt_id string, tier string, ord int, start double, end double, label string")
    grid = loaders.textgrid(spark, put("u.TextGrid", one(sinks.textgrid_text(spans))["text"]))
    assert [(r.start, r.end, r.label) for r in grid.orderBy("ord").collect()] == [(0.0, 0.5, "hi"), (0.5, 1.0, "")]
    sinks.write_ctm(ctm, str(tmp_path / "out"))
    assert loaders.ctm(spark, str(tmp_path / "out")).count() == 2
    sinks.write_items(ctm, str(tmp_path / "items"), ["label", "conf"])
    assert {r.value for r in spark.read.text(str(tmp_path / "items")).collect()} == {"WELL 1.0", "UM 0.4"}
    sinks.write_csv(ctm, str(tmp_path / "csv"))
    assert loaders.feature_csv(spark, str(tmp_path / "csv")).count() == 2
    assert sinks.unprocessed(ctm, ctm.where("ord = 1"), "label").count() == 1


def test_streams(spark, tmp_path):
    from parlance.streaming import sessions

    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 03:00:00", 2.0), (1, "2024-01-03 00:00:00", 3.0)], "user_id long, t string, value double").select("user_id", F.to_timestamp("t").alias("ts"), "value", F.lit("a b a").alias("text"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, out, want in (("sessions", sessions.streaming_sessions(stream), 2), ("counts", sessions.streaming_word_counts(stream), 6)):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append").start()
        q.processAllAvailable()
        n = spark.table(name).count()
        q.stop()
        assert n == want or (name == "sessions" and n <= want)


def test_audio(spark, tmp_path):
    import wave

    from parlance.sources import audio

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16_000)
        w.writeframes(np.full(1600, 16384, "<i2").tobytes())
    got = audio.energy_frames(spark, str(tmp_path / "a.wav")).orderBy("i").collect()
    assert len(got) == 11 and got[0].energy == pytest.approx(0.5) and got[0].total == 0.1 and got[10].energy == 0
    assert audio.vad_frames(0.09) == pytest.approx([0.0, 0.03]) and audio.vad_frames(0.1) == pytest.approx([0.0, 0.03, 0.06])


def test_flattening(spark):
    from parlance.operators import features

    df = spark.createDataFrame([("u", 1.0, (2.0,)), ("v", None, None)], "utt_id string, a double, rhythm struct<x:double>")
    got = {r.utt_id: r.asDict() for r in features.flattened(df, ["a", "b"], "rhythm", ["x", "y"]).collect()}
    assert got == {"u": {"utt_id": "u", "a": 1.0, "b": 0.0, "x": 2.0, "y": None}, "v": {"utt_id": "v", "a": 0.0, "b": 0.0, "x": None, "y": None}}


def test_streamed_states(spark):
    """Repair and voicing row by row are those of whole lists, over batches of three rows."""
    from parlance.operators import intervals

    rng = random.Random(12)
    rows = [(u, k + 1, rng.choice(["a", "sil"]), round(k * 0.5 + rng.random(), 2), round(rng.random(), 2)) for u in range(9) for k in range(rng.randrange(1, 40))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        ctm = spark.createDataFrame(rows, "utt_id long, ord int, label string, start double, dur double")
        for silent in ((), ("sil",)):
            want, last = [], {}
            for u, o, label, start, dur in rows:
                if label not in silent:
                    start = min(start, last.get(u, math.inf))
                    last[u] = round(start + dur, 4)
                    want.append((u, o, label, start, last[u]))
            assert sorted(map(tuple, intervals.repaired(ctm, silent).collect())) == sorted(want)
        frames = [(u, k, rng.random() < (0.97 if k // 15 % 2 else 0.03)) for u in range(7) for k in range(rng.randrange(5, 120))]
        got = intervals.voiced_segments(spark.createDataFrame(frames, "utt_id long, i int, is_speech boolean")).collect()
        assert sorted(map(tuple, got)) == [(u, k, a, b) for u in range(7) for k, (a, b) in enumerate(intervals.voiced([s for v, _, s in frames if v == u], 0.03))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_running_count_has_buckets_by_rows(spark):
    from parlance.functions import stats

    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("x"), F.lit(2).alias("n"))
    got = stats.running_count(df, "x", F.col("n"), "total", bucket_rows=20).collect()
    assert {r.x: r.total for r in got} == {x: 2 * (x + 1) for x in range(5000)}
    assert stats.running_count(df.limit(0), "x", F.col("n"), "total").count() == 0


def test_one_document_of_utterances(spark, tmp_path):
    import json

    df = spark.createDataFrame([("u2", 1.5, "x"), ('u"1\\', None, "y"), ("u3", 2.0, None)], "utt_id string, score double, label string").repartition(3)
    sinks.write_utterances(df, str(tmp_path / "utts"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "utts").glob("part-*")))
    assert json.loads(text) == {"utts": {"u2": {"score": 1.5, "label": "x"}, 'u"1\\': {"label": "y"}, "u3": {"score": 2.0}}}
    sinks.write_errors(df, str(tmp_path / "bad"), F.col("score").isNull())
    assert [p.read_text() for p in (tmp_path / "bad").glob("part-*") if p.stat().st_size] == ['u"1\\\n']


def test_missing_label_is_an_error(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    b = spark.createDataFrame([(1, "x")], "k long, label string")
    assert one(vocabulary.first_labels(a.where("k = 1"), b, "k"))["label"] == "x"
    with pytest.raises(Exception, match="no label for k 2"):
        vocabulary.first_labels(a, b, "k").collect()


def test_split_totals_are_those_of_the_split(spark):
    rows = spark.createDataFrame([("u", k, w, k * 0.5, 0.25) for k, w in enumerate(["cat", "the", "cat", "dog", "ab", ""] * 5)], "utt_id string, ord int, label string, start double, dur double")
    lex = vocabulary.letter_phones(spark.createDataFrame([("cat",), ("the",), ("ab",), ("1",)], "word string"))
    want = vocabulary.even_split(rows, lex).groupBy("phone", "pos").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("dur").alias("durs"))
    got = vocabulary.split_totals(rows, lex)
    cut = lambda df: sorted((r.phone, r.pos, r.n, round(r.starts, 6), round(r.durs, 6)) for r in df.collect())
    assert cut(got) == cut(want)


def _plain_steps(ref, hyp):
    """The whole table in Python's integers: (edits, tilts) of each cell, and the steps by their order of preference."""
    one = 1 << 32
    t = [int(w.isupper()) for w in ref]
    cost = {(0, j): 3 * one * j for j in range(len(hyp) + 1)}
    for i, w in enumerate(ref, 1):
        cost[i, 0] = i * (3 * one - t[i - 1])
        for j, h in enumerate(hyp, 1):
            cost[i, j] = min(cost[i - 1, j] + 3 * one - t[i - 1], cost[i, j - 1] + 3 * one + t[i - 1], cost[i - 1, j - 1] + 4 * one * (w.lower() != h) + t[i - 1])
    i, j, out = len(ref), len(hyp), []
    while i or j:
        if not i or not j:
            kind = 2 if i else 3
        else:
            here, corner, above, left = (cost[x] for x in ((i, j), (i - 1, j - 1), (i - 1, j), (i, j - 1)))
            kind = [here == min(corner, above, left) + t[i - 1], here == corner + 4 * one + t[i - 1], here == above + 3 * one - t[i - 1], here == left + 3 * one + t[i - 1], True].index(True) % 4
        out.append(kind)
        i, j = i - (kind != 3), j - (kind != 2)
    return out[::-1]


def test_batched_alignment(monkeypatch):
    """Many pairs in one sweep, in narrow bands and over kept rows, take the steps of the whole table."""
    rng = random.Random(21)
    words = ["a", "b", "A", "UM", "c", "d", "e"]
    pairs = [([rng.choice(words) for _ in range(rng.randrange(0, 12))], [rng.choice("abcdef") for _ in range(rng.randrange(12))]) for _ in range(400)]
    for n in (40, 90):
        ref = [f"w{k}" for k in range(n)]
        hyp = [w for w in ref if rng.random() < 0.9]
        pairs += [(ref, hyp), (hyp, ref), (ref, ref[n // 2 :] + ref[: n // 2]), (["UM"] * 20 + ref, ref), (ref, ["x"] * 30 + ref)]
    want = [_plain_steps(r, h) for r, h in pairs]
    for small, batch in ((1 << 22, 1 << 22), (0, 1 << 22), (1 << 22, 500), (0, 0)):
        monkeypatch.setattr(alignment, "SMALL", small)
        monkeypatch.setattr(alignment, "BATCH", batch)
        assert [s.tolist() for s in alignment.steps_of(pairs)] == want


def test_alignments_of_odd_rows(spark):
    rows = [(1, None, ["a"]), (2, ["a"], None), (3, [], ["a"]), (4, ["a", "UM"], []), (5, ["a", None], ["a", None]), (6, ["A", "b"], ["a", "b"])]
    df = spark.createDataFrame(rows, "id long, ref array<string>, hyp array<string>").withColumns({"path": F.lit("clash"), "key": F.lit(1)})
    got = {r.id: (r.path and [(s.type[0], s.ref, s.hyp) for s in r.path], r.edits) for r in alignment.alignments(df, ["id"]).collect()}
    assert got[1] == got[2] == (None, None) and got[3] == (None, 1) and got[4] == ([("d", "a", None), ("d", "UM", None)], 2)
    assert got[5] == ([("m", "a", "a"), ("s", None, None)], 1) and got[6] == ([("m", "A", "a"), ("m", "b", "b")], 1)


def test_repair_in_blocks(spark):
    """Blocks with carries give what one long walk gives; ids, starts and durations may be null, and an empty table gives no rows."""
    rng = random.Random(31)
    rows = [(u, k + 1, "x", None if rng.random() < 0.05 else round(k * 0.5 + rng.random() * 3, 4), None if rng.random() < 0.05 else round(rng.random() * 2, 4)) for u in ("a", "b", None) for k in range(rng.randrange(30, 200))]
    want, last = [], {}
    for u, o, label, start, dur in rows:
        s, g = None if start is None else round(start * 10_000), round((dur or 0) * 10_000)
        s = min((x for x in (s, last.get(u)) if x is not None), default=None)
        last[u] = None if s is None else s + g
        want.append((u, o, label, s and s / 10_000 if s else s, last[u] if last[u] is None else last[u] / 10_000))
    df = spark.createDataFrame(rows, "utt_id string, ord int, label string, start double, dur double").withColumns({"key": F.lit(1), "block": F.lit(2)})
    for block in (1, 7, 100_000):
        got = intervals.repaired(df, block_rows=block)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert intervals.repaired(df.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_one_long_utterance(spark):
    """Five million intervals of one utterance are repaired by several tasks."""
    n = 5_000_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # else four small partitions are read by one task
    rows = spark.range(n).select(F.lit("u").alias("utt_id"), (F.col("id") + 1).alias("ord"), F.lit("x").alias("label"), ((F.col("id") * 7919 % 1000) / 1000).alias("start"), F.lit(0.0001).alias("dur"))
    got = intervals.repaired(rows)
    try:
        spread = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("end") * 10_000).cast("long")).alias("ends")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["n"] for r in spread) == n and len(spread) == 4 and max(r["n"] for r in spread) < n / 2
    starts = np.arange(n, dtype=np.int64) * 7919 % 1000 * 10
    assert sum(r["ends"] for r in spread) == (np.minimum.accumulate(starts - np.arange(n)) + np.arange(1, n + 1)).sum()


def test_running(spark):
    from parlance.operators.prefix import running

    rng = random.Random(41)
    rows = [(u, k * 3, None if rng.random() < 0.2 else rng.randrange(-9, 9)) for u in ("a", None) for k in range(60)]
    df = spark.createDataFrame(rows, "u string, o int, v int").withColumns({"key": F.lit(1), "carry_s": F.lit(2)})
    values = {"s": ("sum", F.col("v")), "c": ("count", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
    for block in (1, 10, 1000):
        got = {(r.u, r.o): (r.s, r.c, r.lo, r.hi) for r in running(df, ["u"], "o", values, block).collect()}
        for u in ("a", None):
            seen = []
            for w, o, v in rows:
                if w == u:
                    seen += [v] if v is not None else []
                    assert got[u, o] == (sum(seen), len(seen), min(seen, default=None), max(seen, default=None))


def test_numbered_lines(spark, tmp_path):
    """Lines are numbered as they stand in files that several tasks read, blank lines and a missing last line break included."""
    (tmp_path / "many").mkdir()
    texts = {"b.txt": "".join(f"line {k} {'x' * (k % 50)}\n" for k in range(40_000)), "a.txt": "\nonly\n\n", "c.txt": "no end"}
    for name, text in texts.items():
        (tmp_path / "many" / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = lines.numbered_lines(spark, str(tmp_path / "many"))
        assert got.rdd.getNumPartitions() > 10
        rows = sorted((r.row, r.file.rsplit("/", 1)[-1], r.line, r.value) for r in got.collect())
        ctm = "".join(f"u{k // 30000} 1 {(k * 7) % 100 / 10} 0.1 w{k}\n" for k in range(40_000))
        (tmp_path / "ctm").write_text(ctm)
        read = {(r.utt_id, r.ord): r.label for r in loaders.ctm(spark, str(tmp_path / "ctm")).collect()}
        joined = lines.numbered_lines(spark, str(tmp_path / "many"), few=2)  # as with very many ranges
        assert sorted((r.row, r.file.rsplit("/", 1)[-1], r.line, r.value) for r in joined.collect()) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(name, k, v) for name in sorted(texts) for k, v in enumerate(texts[name].removesuffix("\n").split("\n"))]
    assert rows == [(k, *w) for k, w in enumerate(want)]
    assert read == {(f"u{k // 30000}", k % 30000 + 1): f"w{k}" for k in range(40_000)}


def test_large_file_by_several_tasks(spark, tmp_path):
    """A file of 200 MB: every line has its number, and no line is shuffled for it."""
    with open(tmp_path / "large", "w") as out:
        for k in range(200):
            out.write("".join(f"{n:09d} {'y' * 90}\n" for n in range(k * 10_000, k * 10_000 + 10_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        got = lines.numbered_lines(spark, str(tmp_path / "large"))
        assert got.rdd.getNumPartitions() >= 12
        assert got.agg(F.count("*"), F.count_if(F.col("line") == F.substring("value", 1, 9).cast("long"))).first()[:] == (2_000_000, 2_000_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        (tmp_path / "large").unlink()


def test_last_lines_win(spark, tmp_path):
    (tmp_path / "lex").mkdir()
    (tmp_path / "lex" / "1").write_text("a one\nb two\na three four\n")
    (tmp_path / "lex" / "2").write_text("b\nc five\nc six\n")
    assert {r.word: r.phones for r in loaders.key_tokens(spark, str(tmp_path / "lex")).collect()} == {"a": ["three", "four"], "b": [], "c": ["six"]}
    (tmp_path / "phones").write_text("u 1 0.5 0.1 12\nu 1 0.2 0.1 7\nv 1 0 1 3\nu 1 0.1 0.1 12\n")
    assert sorted(map(tuple, loaders.phone_sequence(spark, str(tmp_path / "phones")).collect())) == [("u", 1, "12"), ("u", 2, "7"), ("u", 3, "12"), ("v", 1, "3")]
    (tmp_path / "words").write_text("The 1\nthe 2\nCAT 3\n\n")
    assert {r.word for r in loaders.word_list(spark, str(tmp_path / "words")).collect()} == {"the", "cat"}
    (tmp_path / "a2").write_text("".join(f"\nu{k} ref a b\nu{k} hyp a c\n\nu{k} op C I S\njunk\n" for k in range(30)) + "u99 ref\nu99 hyp\n")
    got = sorted((r.utt_id, r.ord, r.op) for r in loaders.annotation_v2(spark, str(tmp_path / "a2")).collect())
    assert got == sorted((f"u{k}", n, op) for k in range(30) for n, op in enumerate("CS"))


def test_documents_in_pieces(spark, tmp_path):
    """Documents that are cut at every comma, with brackets, commas, quotes and backslashes in keys and values, are those that json reads."""
    import json

    rng = random.Random(51)
    odd = ["", "a,b", '"', "\\", '\\"', "{", "}]", "x,{\"y\": [1,2]},", "é ", "tab\t", "\\,", 'end\\\\"', "{\"utts\": {"]
    for n, indent in ((0, None), (1, None), (120, 2)):
        utts = {f"u{k}{rng.choice(odd)}": {"s": rng.choice(odd), "l": [rng.choice(odd) for _ in range(rng.randrange(4))], "m": {"k": [{"z": 1.5}, {"z": None}][: rng.randrange(3)]}} for k in range(n)}
        (tmp_path / f"d{n}").write_text(json.dumps({"utts": utts}, indent=indent, ensure_ascii=n % 2 == 0), encoding="utf-8")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        try:
            for block in (3, 100_000):
                found = [json.loads("{" + r.entry + "}") for r in lines.document_entries(spark, str(tmp_path / f"d{n}"), block_rows=block).orderBy("row").collect()]
                assert {k: v for f in found for k, v in f.items()} == utts and len(found) == n
            got = {r.utt_id: r.value.asDict(True) for r in loaders.utts_json(spark, str(tmp_path / f"d{n}"), "struct<s:string,l:array<string>,m:struct<k:array<struct<z:double>>>>").collect()}
            assert got == utts
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "short").write_text('{"utts": {"u": {"x": 1}, "v": {"x": 2')
    (tmp_path / "other").write_text('{"else": {"u": {"x": 1}}}')
    for name in ("short", "other"):
        with pytest.raises(Exception, match="cut short|not a document"):
            loaders.utts_json(spark, str(tmp_path / name), "struct<x:int>").collect()
    (tmp_path / "twice").mkdir()
    (tmp_path / "twice" / "1").write_text('{"utts": {"u": {"x": 1}, "u": {"x": 2}, "v": {"x": 3}}}')
    (tmp_path / "twice" / "2").write_text('{"utts": {"v": {"x": 4}}}')
    assert {r.utt_id: r.value.x for r in loaders.utts_json(spark, str(tmp_path / "twice"), "struct<x:int>").collect()} == {"u": 2, "v": 4}


def test_documents_are_valid(spark, tmp_path):
    import json

    cases = {"repeated": [("u", 1), ("u", 2), ("u", 2), ("v", 3)], "null": [(None, 1), (None, 2), ("v", 3)], "nulls": [(None, 1)], "odd": [('"', 1), ("\\", 2), ("a,b", 3), ("", 4)], "none": []}
    want = {"repeated": {"u": 2, "v": 3}, "null": {"null": 2, "v": 3}, "nulls": {"null": 1}, "odd": {'"': 1, "\\": 2, "a,b": 3, "": 4}, "none": {}}
    for name, rows in cases.items():
        sinks.write_utterances(spark.createDataFrame(rows, "utt_id string, x int").repartition(3), str(tmp_path / name))
        text = "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
        assert {k: v["x"] for k, v in json.loads(text).items() for k, v in v.items()} == want[name]
    (tmp_path / "one").write_text(text)


def test_replace_missing_is_linear(spark):
    """A text of a million words, most of them different, is done in seconds; keys may be null, and short texts come out as before."""
    import time

    rows = [("a", "The DOG saw the cat"), (None, "the dog"), ("b", " "), ("c", None)]
    lexicon = spark.createDataFrame([("the",), ("cat",), ("the",)], "word string")
    df = spark.createDataFrame(rows, "id string, text string").withColumns({"word": F.lit("clash"), "known": F.lit(1)})
    assert sorted(map(tuple, vocabulary.replace_missing(df, lexicon, ["id"], False).collect()), key=str) == [("a", "the <UNK> <UNK> the cat"), (None, "the <UNK>")]
    assert {r.text for r in vocabulary.replace_missing(df, lexicon, ["id"], True).collect()} == {"THE <UNK> <UNK> THE CAT", "THE <UNK>"}
    long = spark.range(1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda k: F.concat(F.lit("w"), (k % 700_000).cast("string"))), " ").alias("text"))
    began = time.time()
    got = vocabulary.replace_missing(long, spark.range(350_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word")), ["id"], False).first()
    words = got.text.split(" ")
    assert time.time() - began < 60 and len(words) == 1_000_000
    assert all(w == (f"w{k % 700_000}" if k % 700_000 < 350_000 else "<UNK>") for k, w in enumerate(words, 1))


def _ellipse(points):
    """The 6 x 6 eigenproblem in numpy, about the mean: centre, half axes (the longer first), angle of the longer."""
    mean, size = points.mean(0), np.sqrt(points.var(0).mean())
    u, v = ((points - mean) / size).T
    design = np.stack([u * u, u * v, v * v, u, v, np.ones(len(u))], 1)
    bound = np.zeros((6, 6))
    bound[1, 1] = -1
    bound[2, 0] = bound[0, 2] = 2
    values, vectors = np.linalg.eig(np.linalg.solve(design.T @ design, bound))
    a, b, c, d, e, f = np.real(vectors[:, np.argmax(np.real(values))])
    quad = np.array([[a, b / 2], [b / 2, c]])
    center = -np.linalg.solve(quad, [d, e]) / 2
    sizes, axes = np.linalg.eigh(quad / -(f + np.array([d, e]) @ center / 2))
    return (*(mean + size * center), *(size / np.sqrt(sizes)), np.degrees(np.arctan2(axes[1, 0], axes[0, 0])) % 180)


def test_ellipses_of_named_clouds(spark):
    rng = np.random.default_rng(8)
    clouds, rows = {}, []
    for k in range(40):
        turn, axes, center = rng.random() * np.pi, np.array([rng.uniform(100, 400), rng.uniform(20, 90)]), rng.uniform(300, 2500, 2)
        t = rng.random(int(rng.integers(8, 200))) * 2 * np.pi
        points = np.stack([np.cos(t), np.sin(t)], 1) * axes * rng.normal(1, 0.05 if k % 2 else 0.3, (len(t), 1))
        clouds[f"{'aeiou'[k % 5]}{k}"] = points @ np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]]) + center
    rows = [(name, float(x), float(y)) for name, points in clouds.items() for x, y in points]
    odd = [("line", float(k), 2.0 * k) for k in range(9)] + [("point", 1.0, 2.0)] * 3 + [("one", 5.0, 6.0), (None, 1.0, 1.0), ("a0", None, 1.0), ("a0", float("nan"), 1.0)]
    got = {r.vowel: r for r in vowels.vowel_ellipses(spark.createDataFrame(rows + odd, "vowel string, f1 double, f2 double")).collect()}
    assert set(got) == set(clouds) | {"line", "point", "one", None} and all(got[k].center_f1 is None and got[k].angle is None for k in ("point", "one", None))
    for name, points in clouds.items():
        assert tuple(got[name])[1:] == pytest.approx(_ellipse(points), rel=1e-6), name
    pooled = {r.vowel: r for r in vowels.vowel_ellipses(spark.createDataFrame([(n.upper(), x, y) for n, x, y in rows] + [("sil", 1.0, 2.0)], "vowel string, f1 double, f2 double"), basic=True).collect()}
    assert set(pooled) == set("aeiou")
    for letter in "aeiou":
        assert tuple(pooled[letter])[1:] == pytest.approx(_ellipse(np.concatenate([p for n, p in clouds.items() if n[0] == letter])), rel=1e-6)
    assert vowels.vowel_ellipses(spark.createDataFrame([], "vowel string, f1 double, f2 double")).count() == 0


def test_frames_on_a_grid(spark):
    frames = spark.createDataFrame([("u", k - 1, k / 100, float(k)) for k in range(1, 101)] + [("one", 0, 0.5, 7.0)], "utt_id string, i int, t double, value double")
    times = {1: ("u", 0.005, 0), 2: ("u", 0.253, 24), 3: ("u", 0.5, 49), 4: ("u", 0.95, 94), 5: ("u", -3.0, 0), 6: ("u", 9.0, 99), 7: ("u", 0.01, 0), 8: ("u", 1.0, 99), 9: ("w", 0.5, None), 10: ("u", None, None), 11: ("one", 0.1, 0), 12: ("u", 0.29, 28), 13: ("u", 0.5799999, 57)}
    df = spark.createDataFrame([(k, u, t) for k, (u, t, _) in times.items()], "ord int, utt_id string, t double").withColumns({"n": F.lit("clash"), "guess": F.lit(1)})
    assert {r.ord: r.left_i for r in intervals.frame_on_grid(df, frames).collect()} == {k: i for k, (_, _, i) in times.items()}


def test_vowel_pools(spark):
    frames = spark.createDataFrame([("u", k, (k + 1) / 100, float(k), 10.0 * k) for k in range(50)], "utt_id string, i int, t double, f1 double, f2 double")
    phones = spark.createDataFrame([("u", 1, "AH0", 0.1, 0.2), ("u", 2, "K", 0.2, 0.3), ("u", 3, "IY1", 0.3, 9.0), ("u", 4, "ER", 0.0, 0.01)], "utt_id string, ord int, label string, start double, end double")
    kind = F.col("label").rlike("^[AEIOU]")
    assert sorted(map(tuple, vowels.vowel_pools(phones, frames, kind).collect())) == [("AH0", "u", 14.0, 140.0), ("ER", "u", 0.0, 0.0), ("IY1", "u", 39.0, 390.0)]
    assert sorted(r.vowel for r in vowels.vowel_pools(phones, frames, kind, basic=True).collect()) == ["a", "e", "i"]


def test_statistics_of_large_groups(spark):
    """As those of groups that are held: few and many rows, ties at the middle, nulls, a null key, a group without values, names that clash."""
    rng = random.Random(31)
    rows = [("hot", rng.gauss(0, 1), 1.0) for _ in range(20_001)] + [("even", float(k), None) for k in range(4000)] + [("ties", float(rng.random() < 0.5), 2.0) for _ in range(5000)]
    rows += [("one", 3.0, -1.0), ("two", 1.0, None), ("two", 2.0, 5.0), ("none", None, None), (None, 4.0, 1.0), (None, None, 2.0)] + [("inf", v, 0.0) for v in (-math.inf, 1.0, math.inf, 1.0)]
    df = spark.createDataFrame(rows, "key string, salt double, v0 double").withColumn("extra", F.create_map(F.lit("a"), F.lit(1)))
    values = {"a": F.col("salt"), "b": F.col("v0")}
    tidy = lambda x: sorted((tuple(None if v is None else v if isinstance(v, str) else "nan" if v != v else round(v, 9) for v in r) for r in x.collect()), key=str)
    want = tidy(stats.described(df, ["key"], values))
    assert tidy(stats.described_large(df, ["key"], values)) == want and len(want) == 8
    assert tidy(stats.described_large(df.repartition(3), ["key"], values, accuracy=10)) == want  # poor quantiles only widen the second look
    assert stats.described_large(df.where("false"), ["key"], values).count() == 0
