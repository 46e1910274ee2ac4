"""Interval files: both forms, odd labels, broken files, four tiers, one file an utterance."""

from pyspark.sql import functions as F

from parlance.sources import textgrid as G

ROWS = [("u/1", "words", 1, 0.0, 0.5, 'say "hi"'), ("u/1", "words", 2, 0.5, 1.25, None), ("u/1", "phones", 5, 0.0, 1.25, "! text = \\ <x> 7"), ("v", "phones", 1, 0.0, 2.0, "two\nlines"), (None, "words", 1, 0.0, 1.0, "x"), ("v", "other", 1, 0.0, 9.0, "no")]
SPANS = "utt_id string, tier string, ord int, start double, end double, label string"

SHORT = """File type = "ooTextFile"
Object class = "TextGrid"

0
2.5
<exists>
3
"IntervalTier"
"words"
0
2.5
2
0
1
"a ""b"" c"
1
2.5
""
"TextTier" ! points
"tones"
0
2.5
1
0.75
"H*"
"IntervalTier"
"none"
0
2.5
0
"""


def read(spark, path):
    return sorted((r.tier_ord, r.kind, r.tier, r.ord, r.start, r.end, r.label) for r in G.textgrid_tiers(spark, path).where("problem IS NULL").collect())


def test_one_file_an_utterance(spark, tmp_path):
    folder = str(tmp_path / "grids")
    df = spark.createDataFrame(ROWS, SPANS).withColumns({"held": F.lit(1), "stop": F.lit(2)})
    for _ in range(2):  # a second run puts the same files in place
        G.write_textgrids(df, folder)
        assert sorted(p.name for p in (tmp_path / "grids").iterdir()) == ["%null.TextGrid", "_SUCCESS", "u%2F1.TextGrid", "v.TextGrid"]
    assert read(spark, f"{folder}/u%2F1.TextGrid".replace("%", "?")) == [
        (0, "IntervalTier", "words", 0, 0.0, 0.5, 'say "hi"'), (0, "IntervalTier", "words", 1, 0.5, 1.25, ""), (1, "IntervalTier", "phones", 0, 0.0, 1.25, "! text = \\ <x> 7")
    ]
    assert read(spark, f"{folder}/v.TextGrid") == [(0, "IntervalTier", "words", 0, 0.0, 2.0, ""), (1, "IntervalTier", "phones", 0, 0.0, 2.0, "two\nlines")]
    assert G.textgrid(spark, f"{folder}/*.TextGrid").count() == 4


def test_short_form_points_and_encodings(spark, tmp_path):
    want = [(0, "IntervalTier", "words", 0, 0.0, 1.0, 'a "b" c'), (0, "IntervalTier", "words", 1, 1.0, 2.5, ""), (1, "TextTier", "tones", 0, 0.75, 0.75, "H*")]
    for name, coding in (("a", "utf-8"), ("b", "utf-8-sig"), ("c", "utf-16")):
        (tmp_path / name).write_text(SHORT, encoding=coding)
        assert read(spark, str(tmp_path / name)) == want


def test_broken_files_have_a_reason(spark, tmp_path):
    for name, body in (("cut", SHORT[: SHORT.index('"H*"')]), ("blank", "\n"), ("other", "hello 1 2"), ("none", 'File type = "ooTextFile" "TextGrid" 0 1 <absent>')):
        (tmp_path / name).write_text(body)
    got = {r.file.rsplit("/", 1)[1]: (r.problem, r.tier, r.start) for r in G.textgrid_tiers(spark, str(tmp_path)).collect()}
    assert got == {"cut": ("ends too early", None, None), "blank": ("no TextGrid", None, None), "other": ("no TextGrid", None, None), "none": ("no tiers", None, None)}


def test_four_tiers(spark, tmp_path):
    words = spark.createDataFrame([("u", 1, "HI", 0.0, 0.5, 0.25), ("u", 2, "YOU", 0.5, 1.0, None), ("gone", 1, "x", 0.0, 1.0, 1.0)], "utt_id string, ord int, label string, start double, end double, conf double")
    phones = spark.createDataFrame([("u", 1, "HH_B", 0.2, 0.5)], "utt_id string, ord int, label string, start double, end double")
    totals = spark.createDataFrame([("u", 1.0), ("silent", 3.0)], "utt_id string, total double")
    G.write_textgrids(G.annotation_tiers(words, phones, totals), str(tmp_path / "out"), G.FOUR_TIERS)
    assert [(x[2], x[4], x[5], x[6]) for x in read(spark, str(tmp_path / "out" / "u.TextGrid"))] == [
        ("CorrectWord", 0.0, 0.0001, ""), ("CorrectWord", 0.0001, 0.5, "HI,0.25"), ("CorrectWord", 0.5, 0.9999, "YOU"), ("CorrectWord", 0.9999, 1.0, ""),
        ("PerceivedPhone", 0.0, 0.2, ""), ("PerceivedPhone", 0.2, 0.5, "HH"), ("PerceivedPhone", 0.5, 1.0, ""),
        ("PerceivedPhoneIPA", 0.0, 0.2, ""), ("PerceivedPhoneIPA", 0.2, 0.5, ""), ("PerceivedPhoneIPA", 0.5, 1.0, ""), ("Notes", 0.0, 1.0, ""),
    ]
    assert [(x[2], x[5]) for x in read(spark, str(tmp_path / "out" / "silent.TextGrid"))] == [(t, 3.0) for t in G.FOUR_TIERS]
