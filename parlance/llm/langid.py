"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

One model for each language: n-grams of characters inside words (with start and end marks), continuation counts below the
highest order, one absolute discount for each order. The models lie side by side: for each order one sorted array of n-gram
hashes and a matrix with a column of log probabilities (nan: not seen) and of log back-off weights for each language. A text
goes to the language of the lowest cross-entropy a character. Rejection is calibrated on texts kept from the counts: their excess
over the language's usual entropy (scaled by length, as short texts vary more) has a quantile that all but `reject_rate` of them lie
under, and the limit is half-way from it to random letters. `Model.rejected` holds the share of those texts that the limit rejects. How
sharply the score separates languages is calibrated on the same texts.

Training reads a bounded sample (`docs_per_lang` documents of each language, about, chosen by a hash of id and text, so that rows that
share an id are not taken together; equal rows are, as one text each); the counts are made by
Spark. Prediction is one narrow pass: words are scored once for each task, documents sum their words.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, worker_state

START, END = "\x02", "\x03"


def _ranges(wanted) -> str:
    """Code points of which `wanted` holds, as the inside of a character class."""
    found = np.flatnonzero([wanted(chr(c)) for c in range(sys.maxunicode + 1)])
    runs = np.split(found, np.flatnonzero(np.diff(found) > 1) + 1)
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)


#: The same for texts of Latin-1 characters, which hold no marks: one small table of characters.
_LATIN = re.compile("[" + "".join(c for c in map(chr, range(256)) if c.isalpha()) + "]+")


@lru_cache
def _letters() -> re.Pattern:
    """Letters and, after a letter, marks; `\\w` also takes other numbers (halves, superscripts) and no marks."""
    letter = "[^\\W\\d_" + _ranges(lambda c: c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]"
    return re.compile(f"{letter}+(?:(?![\\x00-\\x7f])[{_ranges(lambda c: unicodedata.category(c)[0] == 'M')}]+{letter}*)*")


_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Characters that a language might use, for the uniform distribution under the unigrams.
CHARSET = 4096
COLUMNS = "doc_id long, lang_pred string, score double, cross_entropy double, n_letters long, rejected boolean"


def letters(text: str | None) -> list[str]:
    """Runs of letters and their marks, lower-cased."""
    text = (text or "").lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _letters().findall(text)
    return _LATIN.findall(text)


def _rolled(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1- to order-grams that end at each position (those that begin before the array mean nothing)."""
    out, last = [], np.zeros(len(codes), np.uint64)
    own = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    for _ in range(order):
        last = (np.concatenate([[np.uint64(0)], last[:-1]]) ^ (last[:1] & np.uint64(0))) * _PRIME + own if len(codes) else last
        out.append(last ^ (last >> np.uint64(29)))
    return out


def _hashes(grams: list[str]) -> np.ndarray:
    if not grams:
        return np.zeros(0, np.uint64)
    k = len(grams[0])
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4")
    return _rolled(codes, k)[k - 1][k - 1 :: k]


class Model:
    """Sorted hash arrays of all languages; see the module's text."""

    def __init__(self, langs: list[str], counts: dict[str, dict[str, int]], order: int):
        self.langs, self.order = langs, order
        n = len(langs)
        prob: list[dict[str, np.ndarray]] = [{} for _ in range(order + 1)]
        back: list[dict[str, np.ndarray]] = [{} for _ in range(order + 1)]
        self.unseen = np.full(n, -math.log(CHARSET), np.float32)
        for j, lang in enumerate(langs):
            tables = {order: pd.Series(counts[lang], dtype=float)}
            for k in range(order, 1, -1):
                tables[k - 1] = pd.Series(1.0, index=tables[k].index.str[1:]).groupby(level=0).sum()
            lower = None
            for k in range(1, order + 1):
                c = tables[k]
                once, twice = int((c == 1).sum()), int((c == 2).sum())
                discount = once / (once + 2 * twice) if once and twice else 0.5
                context = c.index.str[:-1]
                total, kinds = c.groupby(context).sum(), c.groupby(context).size()
                weight = discount * kinds / total
                below = lower.reindex(c.index.str[1:]).to_numpy() if k > 1 else np.full(len(c), 1 / CHARSET)
                lower = pd.Series((c.to_numpy() - discount) / total.reindex(context).to_numpy() + weight.reindex(context).to_numpy() * below, index=c.index)
                for gram, p in zip(lower.index, np.log(lower.to_numpy()), strict=True):
                    prob[k].setdefault(gram, np.full(n, np.nan, np.float32))[j] = p
                if k == 1:
                    self.unseen[j] += np.log(weight.iloc[0])
                else:
                    for gram, w in zip(weight.index, np.log(weight.to_numpy()), strict=True):
                        back[k - 1].setdefault(gram, np.zeros(n, np.float32))[j] = w
        self.letters = prob[1]
        self.keys, self.prob, self.back = [], [], []
        for k in range(1, order + 1):
            grams = sorted(prob[k].keys() | back[k].keys())
            hashed = _hashes(grams)
            at = np.argsort(hashed, kind="stable")
            self.keys.append(hashed[at])
            self.prob.append(np.array([prob[k].get(grams[i], np.full(n, np.nan)) for i in at] + [np.full(n, np.nan)], np.float32).reshape(len(at) + 1, n))
            self.back.append(np.array([back[k].get(grams[i], np.zeros(n)) for i in at] + [np.zeros(n)], np.float32).reshape(len(at) + 1, n))
        #: By language: mean of the cross-entropy, the largest accepted excess over it, and the share of held-out texts over that.
        self.usual, self.limit, self.rejected, self.sharpness = np.zeros(n), np.full(n, np.inf), np.zeros(n), 10.0

    def noise(self, lang: int, words: int = 2000, seed: int = 3) -> float:
        """Cross-entropy of words whose letters are drawn alike from those the model knows."""
        known = [c for c, p in self.letters.items() if not np.isnan(p[lang]) and c not in START + END]
        if not known:
            return math.inf
        rng = np.random.default_rng(seed)
        drawn = ["".join(rng.choice(known, k)) for k in rng.integers(3, 11, words)]
        return float(-self.words(drawn)[:, lang].sum() / (sum(map(len, drawn)) + words))

    def words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word under each language."""
        pad = START * (self.order - 1)
        codes = np.frombuffer("".join(f"{pad}{w}{END}" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
        log = np.broadcast_to(self.unseen, (len(codes), len(self.langs)))
        context = None
        for k, hashed in enumerate(_rolled(codes, self.order)):
            keys = self.keys[k]
            at = np.searchsorted(keys, hashed)
            at[at == len(keys)] = 0
            found = np.where(keys[at] == hashed, at, len(keys)) if len(keys) else np.zeros(len(codes), np.int64)
            if k:
                log = log + self.back[k - 1][np.r_[len(self.keys[k - 1]), context[:-1]]]
            own = self.prob[k][found]
            log = np.where(np.isnan(own), log, own)
            context = found
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + self.order
        ends = np.cumsum(sizes)
        log = np.cumsum(np.where((codes == ord(START))[:, None], 0, log), axis=0, dtype=np.float64)
        sums = log[ends - 1]
        return np.diff(sums, axis=0, prepend=0)

    def decide(self, entropy: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, score and rejection of rows of cross-entropies."""
        best = np.argmin(entropy, axis=1)
        lowest = entropy[np.arange(len(best)), best]
        root = np.sqrt(np.minimum(length, 400))
        score = 1 / np.exp(np.clip(-(entropy - lowest[:, None]) * (self.sharpness * root / 20)[:, None], -700, 0)).sum(axis=1)
        return best, score, (lowest - self.usual[best]) / leeway(length) > self.limit[best]


def leeway(length: np.ndarray) -> np.ndarray:
    """How much more excess a text of so many letters may have than a long one."""
    return 1 + np.sqrt(20 / np.maximum(length, 1))


class Scorer:
    """Sums of documents, with the scores of at most `most` words kept."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)))

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character under each language (end of a word included), and letters."""
        tokens = [letters(t) for t in texts]
        new = {w for w in set(chain.from_iterable(tokens)) if w not in self.number}
        if len(self.number) + len(new) > self.most:
            self.number, self.table, new = {}, self.table[:0], set(chain.from_iterable(tokens))
        ordered = sorted(new)
        first = len(self.number)
        self.number.update(zip(ordered, range(first, first + len(ordered)), strict=True))
        step = 20_000
        self.table = np.concatenate([self.table, *(self.model.words(ordered[i : i + step]) for i in range(0, len(ordered), step))])
        n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ids = np.fromiter(map(self.number.__getitem__, chain.from_iterable(tokens)), np.int64, int(n.sum()))
        size = np.fromiter(map(len, chain.from_iterable(tokens)), np.int64, len(ids))
        sums, long = np.zeros((len(tokens), len(self.model.langs))), np.zeros(len(tokens), np.int64)
        full = n > 0
        if full.any():
            start = (np.cumsum(n) - n)[full]
            sums[full] = np.add.reduceat(self.table[ids], start, axis=0)
            long[full] = np.add.reduceat(size, start)
        return -sums / np.maximum(long + n, 1)[:, None], long


def _scorer(model: Model) -> Scorer:
    """The scorer of this Python worker: tasks that follow one another share its words."""
    return worker_state(("language", model), lambda: Scorer(model))


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = defaultdict(Counter)
    for part in byte_slices(batches, "text", 4 << 20):
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            held[lang].update(letters(text))
    for lang, found in held.items():
        grams: Counter = Counter()
        for word, n in found.items():
            marked = START * (order - 1) + word + END
            for i in range(len(marked) - order + 1):
                grams[marked[i : i + order]] += n
        yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["lang", "gram", "n"])


def fit(labelled: DataFrame, order: int = 5, docs_per_lang: int = 1500, reject_rate: float = 0.002, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models of the languages of `labelled`; rows without a language or a text are left out.

    The driver gets a row for each language and the n-grams of the sample, which `docs_per_lang` bounds (equal rows of id and text
    fall into or out of it together, and count once). With no row to learn from, the model has no language and rejects everything.
    """
    spark = labelled.sparkSession
    rows = labelled.selectExpr(f"`{id_col}` as id", f"cast(`{lang_col}` as string) as lang", f"cast(`{text_col}` as string) as text").where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, order)
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(math.ceil(1_000_000 * min(1, docs_per_lang / sizes[k])))) for k in langs))
    sample = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < F.element_at(share, F.col("lang"))).dropDuplicates()
    for_limits = F.pmod(F.xxhash64("id", "text", F.lit(5)), F.lit(5)) == 0
    counted = sample.where(~for_limits).select("lang", "text").mapInArrow(lambda it: _count(it, order), "lang string, gram string, n long")
    grams = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {k: {} for k in langs}
    for lang, gram, n in zip(*(grams.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
        counts[lang][gram] = n
    counts = {k: v for k, v in counts.items() if v}
    model = Model(sorted(counts), counts, order)
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for part in byte_slices(batches, "text", 4 << 20):
            entropy, length = scorer.documents(part.column("text").to_pylist())
            yield pa.record_batch([part.column("lang"), pa.array(entropy.tolist(), pa.list_(pa.float64())), pa.array(length)], names=["lang", "entropy", "length"])

    seen = sample.where(for_limits).select("lang", "text").mapInArrow(score, "lang string, entropy array<double>, length long").where("length > 0").toArrow()
    if seen.num_rows:
        entropy, length = np.array(seen.column("entropy").to_pylist()), seen.column("length").to_numpy()
        truth = np.array([model.langs.index(x) if x in model.langs else -1 for x in seen.column("lang").to_pylist()])
        for j in range(len(model.langs)):
            if (truth == j).any():
                model.usual[j] = np.average(entropy[truth == j, j], weights=np.minimum(length[truth == j], 100))
                excess = (entropy[truth == j, j] - model.usual[j]) / leeway(length[truth == j])
                usual = float(np.quantile(excess, 1 - reject_rate))
                model.limit[j] = max(usual, (usual + model.noise(j) - model.usual[j]) / 2)
                model.rejected[j] = float((excess > model.limit[j]).mean())
        known = truth >= 0

        def loss(sharpness: float) -> float:
            gap = (entropy - entropy.min(axis=1, keepdims=True)) * (sharpness * np.sqrt(np.minimum(length, 400)) / 20)[:, None]
            return float((np.log(np.exp(-np.minimum(gap, 700)).sum(axis=1)) + gap[np.arange(len(truth)), truth])[known].mean())

        if known.any():
            model.sharpness = min((2.0**e for e in range(-2, 9)), key=loss)
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, lang_pred, score, cross_entropy, n_letters, rejected.

    Null texts and texts without letters are `und` with score 0 and are rejected; ties go to the first language by name. Only
    the text is looked at. Repeated rows give equal rows; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        for part in byte_slices(batches, "text", 4 << 20):
            yield pa.record_batch(_decided(scorer, part.column("text").to_pylist(), part.column("doc_id")), names=[c.split()[0] for c in COLUMNS.split(", ")])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(predict, COLUMNS)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Those rows of docs, with all their columns, that are not rejected.

    Null texts and texts without letters are rejected; the id is not looked at. Repeated rows are judged alike; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        for part in byte_slices(batches, text_col, 4 << 20):
            yield part.filter(pc.invert(_decided(scorer, part.column(text_col).to_pylist(), part.column(text_col))[-1]))

    return docs.mapInArrow(run, docs.schema)


def _decided(scorer: Scorer, texts: list[str | None], ids: pa.Array) -> list[pa.Array]:
    if not scorer.model.langs:
        n = len(texts)
        return [ids, pa.array(["und"] * n, pa.string()), pa.array([0.0] * n, pa.float64()), pa.nulls(n, pa.float64()), pa.array([sum(map(len, letters(t))) for t in texts], pa.int64()), pa.array([True] * n, pa.bool_())]
    entropy, length = scorer.documents(texts)
    best, score, odd = scorer.model.decide(entropy, length)
    none = length == 0
    names = np.array([*scorer.model.langs, "und"], object)
    return [
        ids,
        pa.array(names[np.where(none, len(scorer.model.langs), best)], pa.string()),
        pa.array(np.round(np.where(none, 0, score), 6)),
        pa.array(np.round(entropy.min(axis=1), 6), mask=none),
        pa.array(length),
        pa.array(odd | none),
    ]
