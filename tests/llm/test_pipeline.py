"""The pipeline against its stages' rules, one by one."""

import corpus_pipeline
from parlance.llm import decontaminate, near_dedup, pii, queries
from parlance.llm.common import parquet, stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = parquet(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF), name)
        if name != "token_ids":
            assert after.columns == docs.columns or set(after.columns) == set(docs.columns)
        kept[name] = ({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}, after)
        docs = after
    before, after = kept["near_duplicates"]
    known = near_dedup.Words()
    sets = {d: set(near_dedup.shingle_set(t.encode(), 5, known).tolist()) for d, t in before.items()}
    left = {r.doc_id for r in after.collect()}
    for d in before.keys() - left:  # what went has a smaller near copy, at the end of links
        assert any(o < d and 100 * len(sets[d] & sets[o]) >= 60 * len(sets[d] | sets[o]) for o in before)
    for d in left:
        assert not any(o < d and o in left and sets[d] and 100 * len(sets[d] & sets[o]) >= 75 * len(sets[d] | sets[o]) for o in left)
    before, after = kept["benchmark_free"]
    bad = {r.doc_id for r in decontaminate.contamination(parquet(spark, SF, "documents"), parquet(spark, SF, "benchmark")).where("contaminated").collect()}
    assert {r.doc_id for r in after.collect()} == before.keys() - bad
    before, after = kept["personal_data"]
    texts = {r.doc_id: r.text for r in after.collect()}
    assert texts.keys() == before.keys()
    assert not any(pii.base_spans(t) for t in texts.values())
    assert all(texts[d] == t for d, t in before.items() if not pii.all_spans(t, pii.trained()))
    before, after = kept["token_ids"]
    assert after.count() == len(before) and after.where("not parity or not round_trip").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == len(before)


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    docs = parquet(spark, SF, "documents")
    first = docs.where("text is not null").orderBy("doc_id").first()
    odd = spark.createDataFrame([(None, first.text, None, None, None), (None, None, "en", "x", 1), (900_001, "", None, "x", 0), (900_002, "½ 12 ...", "de", None, 8), (900_003, (first.text + " ") * 300, first.lang, "x", None)], docs.schema)
    rows = docs.unionByName(odd).unionByName(docs.limit(20)).unionByName(odd)
    n = rows.count()
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, rows, SF), name)
        kept = after.count()
        assert 0 < kept <= n
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "language":
            assert not ids & {900_001, 900_002} and after.where("text is null").count() == 0
        if name == "near_duplicates":
            assert after.where("doc_id is null").count() == 0 and kept == len(ids)
        if name in ("personal_data", "token_ids"):
            assert kept == n
        rows, n = after, kept
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0, name


def test_language_stage_is_the_plain_rule(spark):
    """Every row again: the model's cross-entropy by single words, its limit, and which rows go."""
    import numpy as np

    from parlance.llm import langid

    docs = parquet(spark, SF, "documents")
    model = langid.fit(docs.where(~queries.held_out()))
    kept = {r.doc_id for r in langid.keep_identified(docs, model).collect()}
    for r in docs.collect():
        words = langid.letters(r.text)
        if not words:
            assert r.doc_id not in kept
            continue
        entropy = -sum(model.words([w])[0] for w in words) / sum(len(w) + 1 for w in words)
        best = int(np.argmin(entropy))
        excess = (entropy[best] - model.usual[best]) / (1 + (20 / sum(map(len, words))) ** 0.5)
        if abs(excess - model.limit[best]) > 1e-4:
            assert (r.doc_id in kept) == (excess <= model.limit[best])
