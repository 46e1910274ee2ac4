"""The methods against brute force, round trips and held-out examples."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import components, decontaminate, html_text, langid, lm_scoring, media, near_dedup, pii, sentencepiece_codec, sharding, suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_language_held_out(docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.fit(docs.where(~held))
    got = langid.identify(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.rejected.mean() < 0.05


def test_kneser_ney_sums_to_one():
    words = ["aba", "abc", "cab", "bca", "aab"]
    counts = Counter()
    for w in words:
        marked = langid.START * 2 + w + langid.END
        counts.update(marked[i : i + 3] for i in range(len(marked) - 2))
    model = langid.Model(["x"], {"x": dict(counts)}, 3)
    seen = "abc" + langid.END
    # one step: P(c | start) over seen characters and one unseen (times the rest of the character set)
    first = [math.exp(_first(model, c)) for c in seen]
    unseen = math.exp(_first(model, "z")) * (langid.CHARSET - len(seen))
    assert abs(sum(first) + unseen - 1) < 1e-4


def _plain_kneser_ney(counts, word, order):
    """Log probability of a word: interpolated Kneser-Ney from dictionaries of n-gram counts, one character at a time."""
    tables = {order: dict(counts)}
    for k in range(order, 1, -1):
        tables[k - 1] = Counter(g[1:] for g in tables[k])
    discount = {}
    for k, t in tables.items():
        once, twice = (sum(c == m for c in t.values()) for m in (1, 2))
        discount[k] = once / (once + 2 * twice) if once and twice else 0.5

    def p(context, c):
        k = len(context) + 1
        lower = p(context[1:], c) if k > 1 else 1 / langid.CHARSET
        followers = [n for g, n in tables[k].items() if g[:-1] == context]
        if not followers:
            return lower
        return max(tables[k].get(context + c, 0) - discount[k], 0) / sum(followers) + discount[k] * len(followers) / sum(followers) * lower

    marked = langid.START * (order - 1) + word + langid.END
    return sum(math.log(p(marked[i - order + 1 : i], marked[i])) for i in range(order - 1, len(marked)))


def test_kneser_ney_scores_are_the_plain_ones(texts):
    counts = {"x": Counter(), "y": Counter()}
    for k, (_, t) in enumerate(texts[:12]):
        for w in langid.letters(t)[:60]:
            marked = langid.START * 3 + w + langid.END
            counts["xy"[k % 2]].update(marked[i : i + 4] for i in range(len(marked) - 3))
    model = langid.Model(["x", "y"], {k: dict(v) for k, v in counts.items()}, 4)
    words = [w for _, t in texts[:20] for w in langid.letters(t)[55:70]] + ["zzzz", "q", "é", "übergroß"]
    got = model.words(words)
    for i, w in enumerate(words):
        for j, lang in enumerate("xy"):
            assert abs(got[i, j] - _plain_kneser_ney(counts[lang], w, 4)) < 1e-3


def test_letters_have_their_marks():
    assert langid.letters("हिन्दी ½ ²x a\u0301b 12 _ İz ٣ Ⅷ 中文") == ["हिन्दी", "x", "a\u0301b", "i\u0307z", "中文"]
    assert langid.letters("½ ² ① 7 \u0301") == [] == langid.letters(None)


def test_rejection_is_calibrated(spark, docs):
    same_id = docs.withColumn("doc_id", F.lit(None).cast("long"))
    model = langid.fit(same_id, docs_per_lang=20)
    assert np.isfinite(model.limit).all() and (model.rejected <= 0.1).all()
    rng = random.Random(1)
    junk = [(k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(60))) for k in range(40)]
    got = langid.identify(spark.createDataFrame(junk, "doc_id long, text string"), langid.fit(docs)).toPandas()
    assert got.rejected.mean() > 0.9


def _first(model, c):
    """Log probability of the first character of a word."""
    pad = langid.START * 2
    codes = np.array([ord(x) for x in pad + c], np.uint32)
    log, context = model.unseen[0], None
    for k, h in enumerate(langid._rolled(codes, 3)):
        keys = model.keys[k]
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        found = np.where(keys[at] == h, at, len(keys))
        if k:
            log = log + model.back[k - 1][context[-2], 0]
        own = model.prob[k][found[-1], 0]
        log = log if np.isnan(own) else own
        context = found
    return log


CASES = ["", None, "  two  spaces ", "\n\n a\nb  \n", "emoji 😀 literal <s> </s>", " " * 40 + "x", "a" * 3000, "ñ́ \t tab", " ", "a ", "x▁y ▁▁ z", "é\né 😀\n"]


def _codec_holds(codec, cases):
    flat, n, same, back = codec.encode(pa.array(cases, pa.string()))
    ends = np.cumsum(n)
    ids = [flat[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]
    assert ids == [codec.reference.encode((t or "").replace("▁", " ")) for t in cases]
    assert same.all()
    return ids, back


def test_sentencepiece_parity_on_whole_texts(texts):
    with open(sentencepiece_codec.DEFAULT_MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read(), most=2000)  # trimmed many times
    cases = [t for _, t in texts[:120]] + CASES
    for i in range(0, len(cases), 30):
        ids, back = _codec_holds(codec, cases[i : i + 30])
        assert back.all() and codec.decode(ids) == [(t or "").replace("▁", " ") for t in cases[i : i + 30]]


def _message(fields):
    """Protobuf bytes of (number, value): ints as varints, floats as fixed 32 bits, bytes with their length."""

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + np.float32(value).tobytes()
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_sentencepiece_unigram_models(texts, fallback, prefix):
    """A unigram model of written-down pieces and scores, none of them trained."""
    rng = random.Random(9)
    chars = sorted({c for _, t in texts[:40] for c in t if c not in " \n"})
    whole = sorted({w for _, t in texts[:40] for w in t.split()})[:400]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{k:02X}>", 0.0, 6) for k in range(256) if fallback]
    pieces += [(p, -1 - 9 * rng.random(), 1) for p in sorted({*chars, "▁", *("▁" + w for w in whole), *(w[:3] for w in whole if len(w) > 3)})]
    model = b"".join(_message([(1, _message([(1, p.encode()), (2, float(s)), (3, k)]))]) for p, s, k in pieces)
    trainer = [(3, 1), (35, int(fallback)), (40, 0), (41, 1), (42, 2), (43, 2**64 - 1)]
    model += _message([(2, _message(trainer)), (3, _message([(1, b"identity"), (3, int(prefix)), (4, 0), (5, 1)]))])
    codec = sentencepiece_codec.Codec(model)
    assert codec.spec.kind == sentencepiece_codec.UNIGRAM and codec.spec.byte_fallback == fallback and codec.prefixed == prefix
    _codec_holds(codec, [t for _, t in texts[:40]] + CASES)


def test_sentencepiece_flags_a_part_that_differs(texts):
    with open(sentencepiece_codec.DEFAULT_MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    encode = codec.reference.encode
    codec.reference = type("Wrong", (), {"encode": lambda _, lines, num_threads: [x[::-1] if "odd" in t else x for x, t in zip(encode(lines), lines, strict=True)]})()
    same = codec.encode(pa.array(["one two three", "an oddity here", "four five", "an oddity"]))[2]
    assert same.tolist() == [True, False, True, False]


def test_sentencepiece_columns_decode_back(docs):
    got = sentencepiece_codec.encoded(docs)
    assert got.where("not round_trip or not parity").count() == 0
    back = sentencepiece_codec.decoded(got).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id")
    assert back.where("text <> was").count() == 0


def test_html_articles():
    model = html_text.trained()
    right = 0
    cases = html_text.examples(120, 4242)
    for page, truth in cases:
        own = html_text.blocks(page)
        got = [" ".join(b[1]) for b, keep in zip(own, model.label([own])[0], strict=True) if keep]
        right += got == [" ".join(html_text.entities.unescape(t).split()) for t in truth]
    assert right / len(cases) > 0.85


def test_html_blocks_of_broken_markup():
    page = "<p>a<p>b <b>c<br>d</p>&lt;e&gt; <!-- x > y --><script>if (1<2) '</p>'</script><a href='q>r'>f</a> 1 < 2<div>g"
    assert [" ".join(b[1]) for b in html_text.blocks(page)] == ["a", "b c d", "<e> f 1 < 2", "g"]
    assert html_text.blocks("<" * 20_000) and html_text.blocks("") == []


def _plain_lstm(model, x):
    """One page, one cell at a time."""
    w, h = model.weights, model.hidden
    total = [float(w["p"][0])] * len(x)
    squash = lambda v: 1 / (1 + math.exp(-v))
    for side, d in enumerate("fb"):
        state, cell = [0.0] * h, [0.0] * h
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            z = [float(w[f"c{d}"][k]) + float(x[t] @ w[f"x{d}"][:, k]) + sum(state[j] * float(w[f"h{d}"][j, k]) for j in range(h)) for k in range(4 * h)]
            cell = [squash(z[h + k]) * cell[k] + squash(z[k]) * math.tanh(z[3 * h + k]) for k in range(h)]
            state = [squash(z[2 * h + k]) * math.tanh(cell[k]) for k in range(h)]
            total[t] += sum(state[k] * float(w["o"][side * h + k]) for k in range(h))
    return [squash(v) for v in total]


def test_html_lstm_is_the_plain_one():
    model = html_text.Labeller(hidden=5, seed=2)
    pages = [html_text.blocks(page) for page, _ in html_text.examples(6, 77)]
    x, mask = html_text._padded([html_text.vectors([p]) for p in pages])
    got = model.probabilities(x, mask)
    for k, page in enumerate(pages):
        want = _plain_lstm(model, html_text.vectors([page]))
        assert np.allclose(got[: len(page), k], want, atol=1e-5)
        assert np.allclose(model.long_probabilities(page, 3), want, atol=1e-5)
    whole = model.label(pages)
    assert all((a == b).all() for a, b in zip(whole, model.label(pages, cells=4), strict=True))
    assert all((a == model.label([p])[0]).all() for a, p in zip(whole, pages, strict=True))


def test_html_slopes_are_finite_differences():
    model = html_text.Labeller(hidden=4, seed=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    pages = [html_text.blocks(page) for page, _ in html_text.examples(3, 78)]
    x, mask = html_text._padded([html_text.vectors([p]) for p in pages])
    rng = np.random.default_rng(0)
    truth = rng.random(mask.shape) < 0.5
    slopes, _ = model.slopes(x.astype(np.float64), mask, truth)
    for name, w in model.weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if name.startswith("x"):
                at = (int(rng.choice(np.flatnonzero(np.abs(x).sum(axis=(0, 1))))), at[1])
            was, found = w[at], []
            for step in (1e-3, -1e-3):
                w[at] = was + step
                found.append(model.slopes(x.astype(np.float64), mask, truth)[1])
            w[at] = was
            assert abs((found[0] - found[1]) / 2e-3 - slopes[name][at]) < 2e-4 * max(1, abs(slopes[name][at])), name


def test_html_real_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        want = [" ".join(b[1]) for b in html_text.blocks(r.html) if "article" in html_text.path(b[0])]
        assert r.text == "\n\n".join(want) and r.n_chars == len(r.text)


def _slow_spans(text):
    import re

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        s = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_pii_base_spans_are_those_of_the_patterns(texts):
    rng = random.Random(5)
    cases = [t for _, t in texts]
    cases += ["".join(rng.choice("ab@.-+ ()0123459") for _ in range(60)) for _ in range(20_000)]
    cases += ["a@b@c.d e@f.g@h.i", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "4539 1488 0343 6467", "+1 (545) 555-5362 4111111111111111"]
    for t in cases:
        assert pii.base_spans(t) == _slow_spans(t), t


def test_pii_linear_on_long_runs():
    for t in ("a" * 300_000, "@" * 100_000, "1." * 100_000, "9" * 300_000, "+1" + "(" * 200_000, "a@" * 100_000):
        pii.base_spans(t)


def test_pii_field_on_unseen_examples():
    field, right, false, total = pii.trained(), 0, 0, 0
    for text, spans in pii.examples(200, 31):
        got = set(field.best(pii.Lattice(text)))
        right, false, total = right + len(got & set(spans)), false + len(got - set(spans)), total + len(spans)
    assert right / total > 0.97 and false / total < 0.03


def test_pii_field_sums_are_those_of_all_segmentations():
    field = pii.trained()
    lattice = pii.Lattice("mail ab12@x.com or 123-45-6789")
    score = field.scores(field.rows(lattice))
    paths = []

    def walk(at, chosen, total):
        if at == len(lattice.at):
            paths.append((total, chosen))
            return
        walk(at + 1, chosen, total)
        for k, (i, j) in enumerate(lattice.segments):
            if i == at:
                for y in range(len(pii.KINDS)):
                    walk(j, (*chosen, (k, y)), total + score[k, y])

    walk(0, (), 0.0)
    weights = np.exp([t for t, _ in paths])
    want = np.zeros_like(score)
    for w, (_, chosen) in zip(weights / weights.sum(), paths, strict=True):
        for k, y in chosen:
            want[k, y] += w
    assert np.allclose(field.expected(lattice, score), want, atol=1e-6)
    best = max(paths, key=lambda p: p[0])[1]
    assert [(lattice.segments[k], pii.KINDS[y]) for k, y in best] == [((next(i for i, s in enumerate(lattice.at) if s[0] == a), next(i for i, s in enumerate(lattice.at) if s[1] == b) + 1), kind) for kind, a, b in field.best(lattice)]


def test_lm_scores(docs, texts):
    got = lm_scoring.score_documents(docs, block_bytes=1 << 16, part_bytes=1 << 17).toPandas().set_index("doc_id")
    counts = [Counter() for _ in range(3)]
    cut = [(d, decontaminate.words(t.encode())) for d, t in texts]
    for _, w in cut:
        for k in range(3):
            counts[k].update(zip(*(w[i:] for i in range(k + 1)), strict=False))
    total = sum(counts[0].values())
    for d, w in cut:
        s = 0.0
        for i in range(len(w)):
            for k in (2, 1, 0):
                gram = tuple(w[i - k : i + 1]) if i >= k else None
                if k == 0 or (gram and counts[k][gram] >= 2):
                    s += math.log(counts[k][gram] / (counts[k - 1][gram[:-1]] if k else total)) + (2 - k) * math.log(0.4)
                    break
        assert abs(s - got.loc[d].log_score) < 1e-2 and len(w) == got.loc[d].n_words


def test_lm_rows_grow_with_the_input(spark):
    """Rows that blocks send are bounded by the blocks' size, so twice the input gives twice the rows."""
    block, part = 1 << 13, 1 << 9
    counts = []
    for copies in (1, 2, 4):
        texts = [" ".join(f"w{(7 * k + j * j) % 900}" for j in range(300)) for k in range(100 * copies)]
        df = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "doc_id long, text binary").repartition(2).withColumn("task", F.spark_partition_id())
        parts = lm_scoring.ranges(sum(map(len, texts)), part, block)
        counts.append(df.mapInArrow(lambda it, n=parts: lm_scoring._asked(it, 3, n, block), lm_scoring._DDL).count())
    assert 1.7 < counts[1] / counts[0] < 2.3 and 1.7 < counts[2] / counts[1] < 2.3


def test_lm_checksums_see_order_and_content():
    marks = set()
    for ids, texts in (([1, 2], [b"a b", b"c"]), ([2, 1], [b"a b", b"c"]), ([1, 2], [b"c", b"a b"]), ([1, 2], [b"a bc", b""]), ([1, 2], [b"a b", b"d"]), ([1, None], [b"a b", None])):
        batch = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), pa.array([0, 0], pa.int32())], names=["doc_id", "text", "task"])
        marks.add(next(lm_scoring._blocks(iter([batch]), 1 << 20))[1])
    assert len(marks) == 6


def test_lm_hashes_are_those_of_the_words():
    cases = [b"a b", b"A-b a", None, b"", b"  x", b"x", b"x", "\u00e91 \u00c91".encode(), b"q" * 200_000, b"q" * 200_000 + b" q", b"z"]
    want = [decontaminate.words(t) for t in cases]
    for first in (0, 2, 5):
        hashes, n = lm_scoring.hashed_words(pa.array(cases, pa.binary()).slice(first))
        own = [w for words in want[first:] for w in words]
        assert n.tolist() == [len(w) for w in want[first:]] and len(set(zip(own, hashes.tolist(), strict=True))) == len(set(own)) == len(set(hashes.tolist()))
    rng = np.random.default_rng(3)
    for n, bits in ((0, 64), (1, 64), (3000, 3), (50_000, 18), (50_000, 64)):
        x = rng.integers(0, 2**bits - 1, n, dtype=np.uint64) | np.uint64(1 << 63)
        values, place = lm_scoring.distinct(x)
        assert (values == np.unique(x)).all() and (values[place] == x).all()


def test_hypergeometric_draws():
    rng = np.random.default_rng(1)
    big = [sharding.hypergeometric(rng, 10**9, 3 * 10**9, 400) for _ in range(4000)]
    assert abs(np.mean(big) - 100) < 1 and abs(np.var(big) - 75) < 6
    assert all(sharding.hypergeometric(rng, 10**9 + 5, 0, 7) == 7 for _ in range(3))
    matrix = sharding.communication_matrix([5, 0, 17, 8], [10, 10, 10], 3)
    assert [sum(r) for r in matrix] == [5, 0, 17, 8] and [sum(c) for c in zip(*matrix, strict=True)] == [10, 10, 10]


def test_shards_are_exact_and_uniform(spark):
    df = spark.range(2003).select(F.col("id").alias("doc_id"), F.concat(F.lit("té"), F.col("id").cast("string")).alias("text"))
    got = sharding.shard_rows(df, shards=7, min_buckets=16, cell_rows=40).toPandas()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 7
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert (got["size"] == [len(f"té{i}".encode()) + 16 for i in got.doc_id]).all()
    assert (got.text_crc32 == [zlib.crc32(f"té{i}".encode()) for i in got.doc_id]).all()
    place = got.shard * 287 + got.slot
    assert abs(np.corrcoef(got.doc_id, place)[0, 1]) < 0.08
    again = sharding.shard_rows(df, shards=7, min_buckets=16, cell_rows=40).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_shards_of_equal_rows_are_spread(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard_rows(df, shards=5, min_buckets=16, cell_rows=40).toPandas()
    assert (got.groupby("shard").size() == 800).all() and all(sorted(p.slot) == list(range(800)) for _, p in got.groupby("shard"))
    assert got[got.doc_id.isna()].groupby("shard").size().between(540, 660).all()
    halves = got[got.doc_id.isna()].slot // 400
    assert 0.45 < halves.mean() < 0.55


def test_shard_assignment_is_that_of_the_plain_steps(spark):
    """The whole assignment again, row by row: buckets, matrix, cut of the permuted bucket, permuted cells."""
    df = spark.range(0, 300, 1, 3).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    narrow = [(p, k, r) for p, part in enumerate(df.rdd.glom().collect()) for k, r in enumerate(part)]
    hashed = spark.createDataFrame([(p, k, r.doc_id) for p, k, r in narrow], "file int, line long, doc_id long")
    hashed = hashed.select("*", *(F.xxhash64("file", "line", F.lit(17 + i)).alias(f"h{i}") for i in range(3))).collect()
    buckets, cells, sizes = 8, 300 // (6 * 10), [300 // 6] * 6
    of = {b: sorted((r for r in hashed if r.h0 % buckets == b), key=lambda r: (r.h1, r.file, r.line)) for b in range(buckets)}
    order = [b for b in range(buckets) if of[b]]
    shards = [[] for _ in range(6)]
    for b, row in zip(order, sharding.communication_matrix([len(of[b]) for b in order], sizes, 17), strict=True):
        rows = iter(of[b])
        for s, n in enumerate(row):
            shards[s] += [next(rows) for _ in range(n)]
    want = {r.doc_id: (s, k) for s, rows in enumerate(shards) for k, r in enumerate(sorted(rows, key=lambda r: (r.h2 % cells, r.h2, r.file, r.line)))}
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(df, shards=6, min_buckets=8, cell_rows=10).collect()}
    assert got == want


def test_suffix_arrays():
    rng = random.Random(2)
    for k in range(1500):
        t = bytes(rng.choice(b"ab" if k % 2 else b"abcd\x00\xff") for _ in range(rng.randrange(50)))
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i, t=t: t[i:]), t


@pytest.mark.parametrize("length", [200, 64])
def test_repeats_go(spark, texts, length):
    cases = [(d, t) for d, t in texts[:60]] + [(1000, "ab" * 400), (1001, "x" * 1000), (1002, "abcdefg " * 90), (1003, texts[0][1] * 3)]
    df = spark.createDataFrame(cases, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df, length=length, task_bytes=1 << 14).toPandas().set_index("doc_id")
    seen = Counter()
    data = [(d, t.encode()) for d, t in cases]
    for _, b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        r = got.loc[d]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), sum(gone), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == sum(y and not x for x, y in zip([0, *gone], gone, strict=False))


def test_long_texts_are_cut_without_loss():
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcde") for _ in range(5000))
    whole, parts = (list(suffix_dedup.pieces(text, 200, chunk)) for chunk in (1 << 20, 700))
    for found in (whole, parts):
        cover = sorted((int(s), int(s + w)) for got in found for s, w in zip(got[2], got[3], strict=True))
        assert cover[0][0] == 0 and cover[-1][1] == 4801 and all(a[1] == b[0] for a, b in zip(cover, cover[1:], strict=False))


def test_media_round_trip():
    rng = random.Random(4)
    for n in (0, 1, 191, 192, 193, 5000):
        data = media.padded(bytes(rng.choice([0, 255, 254, 1, 128, rng.randrange(256)]) for _ in range(n)))
        frames, frame_ms = media.read_avi(media.write_avi(media.encode_frames(data)))
        assert media.decode_frames(frames) == data and len(data) % 192 == 0 and frame_ms == media.FRAME_MS
        for k, frame in enumerate(frames):  # any JPEG decoder sees the samples
            pixels = media.decode_jpeg(frame)
            assert pixels.shape == (96, 128) and (pixels == np.kron(np.frombuffer(data[192 * k : 192 * k + 192], np.uint8).reshape(12, 16), np.ones((8, 8)))).all()


def test_media_shots():
    flat = bytes([20]) * 192 * 30 + bytes([200]) * 192 * 30 + bytes([90]) * 192 * 10
    assert media.shots(np.frombuffer(flat, np.uint8).reshape(-1, 192))[0].tolist() == [0, 30, 60]


def _jpeg(planes, sampling, quantiser, restart):
    """Another baseline coder: full blocks of any content, its own tables, interleaved components. Returns the file and the decoded first plane."""
    wave = np.array([[(0.5 if u else 8**-0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for u in range(8)] for x in range(8)])
    order, k = [], 0
    for s in range(15):
        diagonal = [(s - j, j) for j in range(8) if 0 <= s - j < 8]
        order += diagonal if s % 2 == 0 else diagonal[::-1]
    code = {t: {x: (k, n) for k, x in enumerate(symbols)} for t, n, symbols in (("dc", 5, range(12)), ("ac", 9, range(255, -1, -1)))}
    code["ac"][0] = (510, 10)
    wide, high = max(h for h, _ in sampling), max(v for _, v in sampling)
    height, width = planes[0].shape
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    bits, scans, first, last = "", [], None, [0] * len(planes)
    blocks = []
    for plane, (h, v) in zip(planes, sampling, strict=True):
        full = np.pad(plane.astype(float), ((0, down * v * 8 - plane.shape[0]), (0, across * h * 8 - plane.shape[1])), mode="edge") - 128
        got = np.einsum("yu,aybx,xv->abuv", wave, full.reshape(down * v, 8, across * h, 8), wave)
        blocks.append(np.rint(got / quantiser).astype(int))
        if first is None:
            back = np.einsum("yu,abuv,xv->aybx", wave, blocks[0] * quantiser, wave).reshape(full.shape) + 128
            first = np.clip(np.rint(back), 0, 255)[:height, :width]

    def put(table, symbol):
        value, n = code[table][symbol]
        return format(value, f"0{n}b")

    def number(x):
        n = abs(x).bit_length()
        return format(x if x > 0 else x + (1 << n) - 1, f"0{n}b") if n else ""

    def close(bits):
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") if bits else b""

    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            scans.append(close(bits))
            bits, last = "", [0] * len(planes)
        y, x = divmod(unit, across)
        for c, (h, v) in enumerate(sampling):
            for k in range(h * v):
                flat = [int(blocks[c][y * v + k // h, x * h + k % h][i, j]) for i, j in order]
                bits += put("dc", abs(flat[0] - last[c]).bit_length()) + number(flat[0] - last[c])
                last[c], run = flat[0], 0
                for k2, value in enumerate(flat[1:], 1):
                    if not any(flat[k2:]):
                        bits += put("ac", 0)
                        break
                    if value == 0:
                        run += 1
                        continue
                    bits += put("ac", 0xF0) * (run // 16) + put("ac", (run % 16) << 4 | abs(value).bit_length()) + number(value)
                    run = 0
    scans.append(close(bits))
    data = b"".join(s + (bytes([255, 0xD0 + k % 8]) if k < len(scans) - 1 else b"") for k, s in enumerate(scans))
    segment = lambda marker, body: struct.pack(">BBH", 255, marker, len(body) + 2) + body
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\x03" + bytes(int(quantiser[i, j]) for i, j in order))
    head += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([c + 1, h << 4 | v, 3]) for c, (h, v) in enumerate(sampling)))
    head += segment(0xC4, b"\x01" + bytes([0] * 4 + [12] + [0] * 11) + bytes(range(12)) + b"\x12" + bytes([0] * 8 + [255, 1] + [0] * 6) + bytes(range(255, -1, -1)))
    if restart:
        head += segment(0xDD, struct.pack(">H", restart))
    return head + segment(0xDA, bytes([len(planes)]) + b"".join(bytes([c + 1, 0x12]) for c in range(len(planes))) + bytes([0, 63, 0])) + data + b"\xff\xd9", first


@pytest.mark.parametrize("sampling,restart", [([(1, 1)], 0), ([(2, 2)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_media_decodes_frames_of_another_coder(sampling, restart):
    rng = np.random.default_rng(5)
    smooth = np.add.outer(np.arange(37) * 3, np.arange(53) * 2) % 256
    planes = [(smooth + rng.integers(-20, 20, smooth.shape)).clip(0, 255)] + [rng.integers(0, 256, (19, 27)) for _ in sampling[1:]]
    quantiser = 3 + np.add.outer(np.arange(8), np.arange(8))
    data, want = _jpeg(planes, [(1, 1)] if len(sampling) == 1 else sampling, quantiser, restart)
    got = media.decode_jpeg(data)
    assert got.shape == smooth.shape and np.abs(got - want).max() <= 1 and np.abs(got - planes[0]).mean() < 6


def test_clips_of_a_foreign_file(spark):
    """A file with a sound stream first, absolute index offsets, a frame that repeats, two shots of another coder's frames."""
    quantiser = np.full((8, 8), 4)
    dark, light = (_jpeg([np.full((24, 40), v) + np.arange(40) % 5], [(1, 1)], quantiser, 0)[0] for v in (30, 190))
    chunk = media._chunk
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", 100_000, *[0] * 13)) + chunk(b"LIST", b"strl" + chunk(b"strh", b"auds" + b"\0" * 52)) + chunk(b"LIST", b"strl" + chunk(b"strh", b"vidsMJPG" + b"\0" * 48)))
    body, index, at = b"movi", b"", 12 + len(head) + 12
    for frame in [dark] * 6 + [b""] + [light] * 5:
        for name, data in ((b"00wb", b"sound"), (b"01dc", frame)):
            index += name + struct.pack("<III", 16, at, len(data))
            body += chunk(name, data)
            at += len(chunk(name, data))
    avi = chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", body) + chunk(b"idx1", index))
    rows = [(1, avi), (2, None), (3, b"no file"), (4, avi[:200]), (1, avi), (5, avi[: len(avi) - 40])]
    got = media.clips_of(spark.createDataFrame(rows, "doc_id long, avi binary")).collect()
    assert sorted((r.doc_id, r.clip, r.start_ms, r.end_ms, r.n_frames) for r in got if r.doc_id == 1) == [(1, 0, 0, 700, 7)] * 2 + [(1, 1, 700, 1200, 5)] * 2
    assert {r.doc_id for r in got if r.clip is not None} <= {1, 5} and all((r.clip is None) == (r.reason is not None) for r in got)
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5}


def test_clips_cover_documents(docs):
    got = media.clip_rows(docs).groupBy("doc_id").agg(F.sum("n_frames").alias("n"))
    want = media.media_digest(docs).select("doc_id", "n_frames")
    assert got.join(want, "doc_id").where("n <> n_frames").count() == 0


def _near(sets):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in ids}


@pytest.mark.parametrize("small,chunk", [(16, 256), (1, 0.5)])
def test_near_duplicates(spark, texts, monkeypatch, small, chunk):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    cases = [(d, t) for d, t in texts[:80]] + [(900, "one two"), (901, "ONE two"), (902, "one two three")]
    for k in range(60):  # a chain of copies that drift, and copies around one text
        base[rng.randrange(120)] = f"n{k}"
        cases.append((1000 + k, " ".join(base)))
        near = list(base)
        near[rng.randrange(120)] = near[rng.randrange(120)] = "x"
        cases.append((2000 + k, " ".join(near)))
    got = near_dedup.near_duplicates(spark.createDataFrame(cases, "doc_id long, text string").repartition(3)).toPandas().set_index("doc_id")
    known = near_dedup.Words()
    sets = {d: set(near_dedup.shingle_set(t.encode(), 5, known).tolist()) for d, t in cases}
    want = _near(sets)
    assert got.component_id.to_dict() == want
    assert got.n_shingles.to_dict() == {d: len(s) for d, s in sets.items()}
    assert got.kept.to_dict() == {d: want[d] == d for d in want}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = pool[:200], pool[40:240]  # 160 of 240 in common
    rows = near_dedup.sketches([a, b, pool[:1], pool[:0]], 240)
    assert abs((rows[0] == rows[1]).mean() - 160 / 240) < 0.12
    assert (rows[2] != np.iinfo(np.uint64).max).all() and (rows[3] == np.iinfo(np.uint64).max).all()


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v")).unionByName(spark.createDataFrame([(500, 501), (501, 500)], "u long, v long"))
    got = {r.u: r.v for r in components.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 300)}, 501: 500}


@pytest.mark.parametrize("block", [100_000, 40])
def test_contamination(spark, texts, block):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "tiny item"), (901, "tiny item")]
    cases = texts[:100] + [(900, "a TINY item, tiny"), (901, items[0][1] + " " + items[0][1])]
    got = decontaminate.contamination(spark.createDataFrame(cases, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_windows=block).toPandas().set_index("doc_id")
    windows = {}
    for i, t in items:
        w = decontaminate.words(t.encode())
        for k in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    for d, t in cases:
        w = decontaminate.words(t.encode())
        hit, own = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    own |= windows[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        r = got.loc[d]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest())
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
