"""Work and memory that grow no faster than the input: each input is computed as often as stated, and plans shuffle and sort no more than they need."""

from pyspark.sql import functions as F

from parlance.operators import combine, regression, vocabulary
from parlance.plans import catalog, jobs
from parlance.sources import textgrid


def counted(spark, df):
    """df through Python, and an accumulator of the rows that went by."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(passed, df.schema), seen


def shuffled_mb(spark, df):
    """MB that the stages of a run of df write to shuffles."""
    before = {s.stageId(): 0 for s in stages(spark)}
    df.write.format("noop").mode("overwrite").save()
    return sum(s.shuffleWriteBytes() for s in stages(spark) if s.stageId() not in before) / 1e6


def stages(spark):
    got = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return [got.apply(k) for k in range(got.size())]


def test_rank_correlation_computes_its_input_once(spark):
    df, seen = counted(spark, spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"), F.when(F.col("id") % 10 != 3, F.col("id") % 89).cast("double").alias("y")))
    got = regression.spearman(df, "x", "y").first()
    want = spark.range(1000).where("id % 10 <> 3").selectExpr("id % 97 AS x", "id % 89 AS y").toPandas().rank().corr().loc["x", "y"]
    assert got.n == 900 and abs(got.rho - want) < 1e-9
    assert seen.value == 1000
    assert tuple(regression.spearman(df.limit(0), "x", "y").first()) == (None, 0)


def test_gop_job_has_words_without_an_utterance(spark, tmp_path):
    """Words are scored and annotated in one aggregation, so those of a null key stay, as in the SQL."""
    rows = [(k // 6 if k < 12 else None, k, k, k, "A", (k % 5) / 10, "OF"[k % 2], 1.0, 0.0) for k in range(18)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_discount double, l_linestatus string, l_quantity double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert jobs.gop_job(spark, str(tmp_path)).first().n == 6


def test_replaced_words_are_not_shuffled(spark):
    """Words that have met a small lexicon come back as bits: their shuffles hold numbers, a text goes through one, and no list of words is collected."""
    texts = spark.createDataFrame([("a", " ".join(f"W{k % 7}" for k in range(1000))), ("a", "w1"), ("b", "W1  x\n"), (None, "w1"), ("c", " "), ("d", None)], "id string, text string")
    lexicon = spark.createDataFrame([("w1",), ("w3",), ("w3",)], "word string")
    df = vocabulary.replace_missing(texts, lexicon, ["id"], False)
    long = " ".join(f"w{k % 7}" if k % 7 in (1, 3) else "<UNK>" for k in range(1000))
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("a", long), ("a", "w1"), ("b", "w1 <UNK>"), (None, "w1")], key=str)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "collect_list(struct(place" not in plan
    big = spark.range(2000).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(500)), lambda k: F.xxhash64(k, F.col("id")).cast("string")), " ").alias("text"))  # 20 MB
    assert shuffled_mb(spark, vocabulary.replace_missing(big, lexicon, ["id"], False)) < 30  # digits take half a byte at least, 10 MB a pass


def test_annotation_tiers_sort_once(spark):
    """Words, phones and lengths meet in one sort; ids that are null or have no length have no tiers."""
    words = spark.createDataFrame([("u", 1, "HI", 0.0, 0.5, 0.25), ("u", 3, "YOU", 0.5, 0.8, None), ("gone", 1, "x", 0.0, 1.0, 1.0), (None, 1, "x", 0.0, 1.0, 1.0)], "utt_id string, ord int, label string, start double, end double, conf double")
    phones = spark.createDataFrame([("u", 2, "HH_B", 0.2, 0.5), ("u", 4, None, 0.5, 1.0)], "utt_id string, ord int, label string, start double, end double")
    totals = spark.createDataFrame([("u", 1.0), ("silent", 3.0), ("unknown", None), (None, 1.0)], "utt_id string, total double")
    df = textgrid.annotation_tiers(words, phones, totals)
    assert sorted((r.utt_id, r.tier, r.ord, round(r.start, 4), r.end and round(r.end, 4), r.label or "", r.total) for r in df.collect() if r.utt_id != "unknown") == [
        ("silent", "Notes", 1, 0.0, 3.0, "", 3.0),
        ("u", "CorrectWord", 0, 0.0, 0.0001, "", 1.0), ("u", "CorrectWord", 1, 0.0001, 0.5, "HI,0.25", 1.0), ("u", "CorrectWord", 3, 0.5, 0.8, "YOU", 1.0), ("u", "CorrectWord", 4, 0.8, 1.0, "", 1.0),
        ("u", "Notes", 1, 0.0, 1.0, "", 1.0),
        ("u", "PerceivedPhone", 1, 0.0, 0.2, "", 1.0), ("u", "PerceivedPhone", 2, 0.2, 0.5, "HH", 1.0), ("u", "PerceivedPhone", 4, 0.5, 0.9999, "", 1.0), ("u", "PerceivedPhone", 5, 0.9999, 1.0, "", 1.0),
        ("u", "PerceivedPhoneIPA", 1, 0.0, 0.2, "", 1.0), ("u", "PerceivedPhoneIPA", 2, 0.2, 0.5, "", 1.0), ("u", "PerceivedPhoneIPA", 4, 0.5, 0.9999, "", 1.0), ("u", "PerceivedPhoneIPA", 5, 0.9999, 1.0, "", 1.0),
    ]
    assert [(r.tier, r.ord, r.start, r.end, r.total) for r in df.where("utt_id = 'unknown'").collect()] == [("Notes", 1, 0.0, None, None)]
    plan = df._jdf.queryExecution().sparkPlan().toString(), textgrid.annotation_tiers(words, phones, totals)._jdf.queryExecution().executedPlan().toString()
    assert plan[1].count("Sort [") == 1 and plan[1].count("Exchange hashpartitioning") == 1 and "Join" not in plan[0]


def test_bags_go_to_tasks_of_a_bounded_size(spark, tmp_path):
    rows = [(k % 500 if k % 7 else None, k % 3 if k % 2 else None, "ABC"[k % 3], "XYZ"[k % 2] if k % 5 else None) for k in range(2000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {}
    for key, _, *values in rows:
        want.setdefault(key, []).extend(values)
    want = {k: (len(v), len(set(v) - {None})) for k, v in want.items()}
    assert {r.key: (r.n, r.n_distinct) for r in catalog.bag_union(spark, str(tmp_path)).collect()} == want
    bag = spark.range(20_000).select((F.col("id") / 2).cast("long").alias("k"), F.lit("v").alias("v"))
    dealt = combine.bag_sizes(bag, "k", "v", 1000).groupBy(F.spark_partition_id()).agg(F.sum("n")).collect()
    assert len(dealt) == 20 and max(r[1] for r in dealt) < 1500
    assert combine.bag_sizes(bag.limit(0), "k", "v").count() == 0
