"""Whole jobs where an operator once did less: null ids, blocks, markup."""

import hashlib
import random
import time
import tracemalloc
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance.llm import common, decontaminate, html_text, near_dedup, pii, queries, suffix_dedup


@pytest.mark.parametrize("block", [100_000, 3])
def test_items_without_id_hit(spark, block):
    passage = " ".join(f"w{k}" for k in range(20))
    docs = [(1, f"a b {passage} c"), (1, f"a b {passage} c"), (2, "clean words only"), (3, f"both short one and {passage}"), (None, passage), (4, None), (5, "short one")]
    items = [(None, passage), (None, "short one"), (7, "short one"), (7, "nowhere at all"), (8, "other words here")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b, block_windows=block).collect()
    con = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.register(name, pd.DataFrame({key: pd.array([r[0] for r in rows], "Int64"), "text": pd.Series([r[1] for r in rows], dtype="object")}))
    want = con.sql(queries.ORACLES["op10_decontamination"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.doc_id for r in got if r.contaminated} == {None, 1, 3, 5}
    clean = decontaminate.keep_clean(d, b, block_windows=block)
    assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == [2, 4]


@pytest.mark.parametrize("tag", ["<svg viewBox='0 0 1 1'/>", "<math/>", "<select>", "<object data=x>", "<audio>", "<video>", "<svg>"])
def test_text_after_an_open_or_closed_tag_stays(tag):
    assert [" ".join(b[1]) for b in html_text.blocks(f"<head>{tag}</head><p>one</p><article>two</article>")] == ["one", "two"]
    page = f"<p>one</p><svg/><p>two</p><svg><text>drawn</text></svg>{tag}<p>three</p>"
    assert [" ".join(b[1]) for b in html_text.blocks(page)] == ["one", "two", "three"]
    assert html_text.blocks("<script>x <p>code</p>") == []


def test_path_is_whole():
    page = "<nav class='a b c d e f site menu'>" + "<div>" * 30 + "<em>text"
    node = html_text.blocks(page)[0][0]
    assert {"nav", "site", "menu", "div", "em"} <= set(html_text.path(node))
    assert all(node[2] & html_text._bit(x) for x in ("nav", "site", "menu", "div", "em"))


def test_comments_in_deep_pages_are_no_article():
    model = html_text.trained()
    article = "<article>" + "".join(f"<p>{' '.join(f'word{k}x{j}' for j in range(30))}.</p>" for k in range(5)) + "</article>"
    comments = "<section class='comments'>{}" + "".join(f"<div class='comment'><p>{' '.join(f'reply{k}y{j}' for j in range(20))}.</p></div>" for k in range(4))
    for depth in (0, 8, 13, 30, 2000):
        page = f"<html><head><title>Some words</title></head><body>{'<div>' * depth}{article}{comments.format('<div>' * depth)}"
        own = html_text.blocks(page)
        got = [b[1][0][:4] for b, keep in zip(own, model.label([own])[0], strict=True) if keep]
        assert got == ["word"] * 5, depth


@pytest.mark.parametrize("page", ["<a" * 500_000, "<p x='" * 170_000, "<p x='" * 170_000 + ">", "<!--" * 250_000, "<p>a" * 250_000, "".join(f"<div class=c{k}>" for k in range(60_000)) + "x", "<script " * 125_000, "<a b=\"'>" * 110_000, "</x" * 330_000 + ">"])
def test_broken_pages_of_a_megabyte(page):
    """Each within seconds, and in memory in proportion to the page."""
    begin = time.process_time()
    tracemalloc.start()
    own = html_text.blocks(page)
    if len(own) > 1000:
        own = own[:20_000]
    html_text.Labeller().label([own])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.process_time() - begin < 60 and most < 500e6


def test_one_row_of_a_class_with_a_shared_id(spark):
    one, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    docs = [(1, one), (5, one + " more"), (5, other), (6, other + " more"), (7, "x y"), (7, "x y"), (8, None), (8, "")]
    kept = near_dedup.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, one), (5, other), (7, "x y"), (8, None), (8, "")], key=str)


@pytest.mark.parametrize("before", ["", "İ ", "ß İİ\n"])
def test_secrets_go_whole(before):
    field = pii.trained()
    for secret in ("Hunter2024x", "a1b2" * 75, "Qx7" + "z" * 300, "abcdefghijkl" * 8):
        text = f"{before}some words password={secret} and more words"
        masked = pii.masked(text, pii.all_spans(text, field))
        assert secret not in masked and secret[-20:] not in masked and masked.endswith(" and more words") and masked.startswith(before + "some words password="), masked
    text = before + "password: Hunter2024x secret=abcdefghijkl"
    assert [k for k, _, _ in pii.all_spans(text, field)] == ["secret", "secret"]


def test_windows_are_disjoint_and_cut_no_token():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bcd" * rng.randrange(40), " ", " word", "1", "@", "password ", "é", "-"]) for _ in range(60))
        found = list(pii.windows(text))
        assert all(0 <= a < b <= len(text) for a, b in found) and all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))
        assert all(any(a <= k < b for a, b in found) for k, c in enumerate(text) if c in "01@")
        assert not any(text[k - 1].isalnum() and text[k].isalnum() for w in found for k in w if 0 < k < len(text))
    for t in ("a1" * 200_000, ("z" * 500 + "1 ") * 400, "1" * 300_000, "z" * 500_000 + "@"):
        assert sum(b - a for a, b in pii.windows(t)) <= len(t)


def test_no_span_of_the_field_touches_a_pattern_span():
    class Given:
        def __init__(self, spans):
            self.spans = lambda _: spans

    text = "a@b.cd " * 12 + "1.2.3.4 +1 234 567 8901 4539148803436467 tail"
    base = pii.base_spans(text)
    more = [("secret", a, a + n) for n in (1, 5, 40, 90) for a in range(0, len(text) - n, 3)]
    got = [s for s in pii.all_spans(text, Given(more)) if s[0] == "secret"]
    assert got == sorted(s for s in more if not any(a < s[2] and s[1] < b for _, a, b in base))


def test_rows_without_an_id_are_judged(spark):
    one, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    docs = [(None, one), (None, one), (3, one + " more"), (None, other), (None, other + " more"), (None, other), (None, None), (None, None), (None, "")]
    kept = near_dedup.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert (3, one + " more") in kept and (None, one) not in kept
    assert sum(r.text in (other, other + " more") for r in kept) == 1 and len(kept) == 4


def _plain_repeats(data, length):
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield sum(gone), hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()


@pytest.mark.parametrize("line", [60, 130, 199, 230])
def test_a_common_line_with_a_new_context_in_every_text(spark, line):
    """Groups of one anchor are split until they fit; those whose windows are all equal need no task."""
    rng = random.Random(line)
    draw = lambda n: bytes(rng.choice(b"abcdefghij ") for _ in range(n))
    common = draw(line)
    data = [draw(160 - k % 3) + common + draw(150 + k % 5) for k in range(60)] + [b"z" * 130 + common + draw(170) for _ in range(8)] + [draw(170) + common + b"y" * 90 + draw(20) for _ in range(8)]
    data += [data[3][100:] + data[4], data[0]]
    df = spark.createDataFrame([(k, b.decode()) for k, b in enumerate(data)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, task_bytes=1 << 11).collect()}
    assert got == dict(enumerate(_plain_repeats(data, 200)))


def test_a_hundred_thousand_contexts_of_one_line(spark):
    line = "this very line stands in every one of a hundred thousand texts; "
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit(line), F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 512)).alias("text"))
    df = df.unionByName(df.where("id < 3").selectExpr("doc_id + 1000000 as doc_id", "text"))
    got = suffix_dedup.remove_repeats(df).where("n_removed > 0").select("doc_id", "n_removed").collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 1000000, 1000001, 1000002} and {r.n_removed for r in got} == {256 + len(line)}


def test_tables_go(spark):
    near_dedup.keep_one(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).count()
    tables = [Path(x.removeprefix("file://")) for x in common._TABLES]
    assert tables and all(x.is_dir() for x in tables)
    common.clean(spark)
    assert not common._TABLES and not any(x.exists() for x in tables)


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())
    Session.sparkContext.master = "local-cluster[3,2,1000]"
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())
