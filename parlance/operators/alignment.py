"""Word alignment of hypothesis and reference in Arrow batches: edit distance, and weighted alignment with its path."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import fresh

INSERT, DELETE, SUBSTITUTE = 3, 3, 4
#: One edit in units of the tilt, which only ever decides between equal edits; more than any path costs.
EDIT, FAR = 1 << 32, 1 << 60
#: Steps of tables of more cells than this (a byte each) are not kept whole; a batch of pairs has so many cells, or one pair.
SMALL, BATCH = 1 << 22, 1 << 22


def edit_distance(ref: list[str | None], hyp: list[str | None]) -> int:
    """Levenshtein distance of two lists of words, a bit for each word of hyp in one long integer; null words equal nothing."""
    n = len(hyp)
    if not n:
        return len(ref)
    places: dict[str, int] = {}
    for j, word in enumerate(hyp):
        if word is not None:
            places[word] = places.get(word, 0) | 1 << j
    full, top = (1 << n) - 1, n - 1
    up, down, edits = full, 0, n  # neighbours in a row of the table differ by +1 or -1
    for word in ref:
        same = places.get(word, 0)
        x = same | down
        y = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(y | up)), up & y
        edits += (more >> top & 1) - (less >> top & 1)
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = less | (full & ~(x | more)), more & x
    return edits


def _slices(batches: Iterator[pa.RecordBatch], limit: int = 100_000, columns: list[str] | tuple[str, ...] = ("ref", "hyp")) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` words of ref and hyp (one longer row stays alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        group = (np.cumsum(sizes) - sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def word_error_rate(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """pairs with edits, ref_words and wer; an empty reference has a null rate, a null side null edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            edits = [None if r is None or h is None else edit_distance(r, h) for r, h in zip(b.column("ref").to_pylist(), b.column("hyp").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("row"), pa.array(edits, pa.int32())], names=["row", "edits"])

    names = pairs.columns
    fields = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
    rows = pairs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), F.col(ref).alias("ref"), F.col(hyp).alias("hyp")).mapInArrow(run, f"row struct<{fields}>, edits int")
    rows = rows.select(*(F.col("row").getField(n).alias(n) for n in names), "edits")
    return rows.withColumn("ref_words", F.size(ref)).withColumn("wer", F.try_divide(F.col("edits"), F.col("ref_words")))


#: Operations by their number in a table of steps, in the order in which a step is preferred.
STEPS = ("match", "substitution", "deletion", "insertion")


class _Band:
    """Cost tables of a batch of pairs, a row for each reference word, on the columns j with low <= j - i <= high of row i.

    A cell is the least of three sums: the cell above with (DELETE - tilt), the cell to the left with (INSERT + tilt), and the corner with
    (SUBSTITUTE + tilt), or the tilt alone for equal words. Costs are long integers, edits in the high half and tilts in the low half. The
    left neighbours of a row are a running minimum, so a row is a few array operations for all pairs.
    """

    def __init__(self, ref: list[np.ndarray], hyp: list[np.ndarray], tilt: list[np.ndarray], low: int, high: int):
        self.n, self.m = np.array([len(r) for r in ref]), np.array([len(h) for h in hyp])
        self.low, self.width, rows = low, high - low + 1, int(self.n.max())
        self.ref, self.tilt = np.full((len(ref), rows), -1, np.int64), np.zeros((len(ref), rows), np.int64)
        self.words = np.full((len(ref), rows + self.width), -2, np.int64)  # the word of column j is at j - low - 1
        for k, (r, h, t) in enumerate(zip(ref, hyp, tilt, strict=True)):
            self.ref[k, : len(r)], self.tilt[k, : len(r)] = r, t
            self.words[k, -low : -low + len(h)] = h[: max(0, rows + self.width + low)]

    def first(self) -> np.ndarray:
        column = np.arange(self.width) + self.low
        return np.tile(np.append(np.where(column < 0, FAR, column * INSERT * EDIT), FAR), (len(self.n), 1))

    def after(self, i: int, above: np.ndarray, steps: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Row i from the row above it, and if asked the steps into its cells. Rows end in a cell outside the band."""
        t, edge = self.tilt[:, i - 1, None], -(i + self.low)
        differ = self.ref[:, i - 1, None] != self.words[:, i - 1 : i - 1 + self.width]
        corner, above = above[:, :-1], above[:, 1:]
        delete, insert = DELETE * EDIT - t, INSERT * EDIT + t
        cost = np.minimum(corner + (differ * (SUBSTITUTE * EDIT) + t), above + delete)
        if edge >= 0:
            cost[:, :edge] = FAR
            if edge < self.width:
                cost[:, edge] = i * delete[:, 0]
        run = np.arange(self.width) * insert
        here = np.full((len(cost), self.width + 1), FAR)
        here[:, :-1] = cost = np.minimum.accumulate(cost - run, 1) + run
        if not steps:
            return here, None
        left = np.concatenate([np.full((len(cost), 1), FAR), cost[:, :-1]], 1)
        level = np.minimum(np.minimum(corner, above), left) + t  # what a free diagonal step from the least neighbour would cost
        kinds = np.select([cost == level, cost == corner + (SUBSTITUTE * EDIT + t), cost == above + delete, cost == left + insert], range(4), 0)  # or a match by the corner
        return here, kinds.astype(np.int8)

    def solve(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The steps of each pair, and its cost in edits. Of tables over SMALL cells only every k-th row is kept, and the steps of k rows at a time are found again."""
        rows, pairs = self.ref.shape[1], np.arange(len(self.n))
        every = rows if rows * self.width <= SMALL else math.isqrt(rows)
        here, kept, table, cost = self.first(), [], [], np.zeros(len(self.n), np.int64)
        end = self.m - self.n - self.low
        for i in range(rows + 1):
            if i:
                here, kinds = self.after(i, here, every >= rows)
                table.append(kinds)
            cost = np.where(self.n == i, here[pairs, end], cost)
            if every and i % every == 0 and i < rows:
                kept.append((i, here))
        i, j, out = self.n.copy(), self.m.copy(), []
        for start, here in reversed(kept):
            if every < rows:
                table = []
                for row in range(start + 1, min(start + every, rows) + 1):
                    here, kinds = self.after(row, here, True)
                    table.append(kinds)
            stack = np.stack(table)
            while (on := i > start).any():
                kind = np.where(j > 0, stack[np.where(on, i - 1 - start, 0), pairs, np.clip(j - i - self.low, 0, self.width - 1)], 2)
                kind = np.where(on, kind, -1)
                out.append(kind)
                i -= on & (kind != 3)
                j -= on & (kind != 2)
        found = np.array(out, np.int8).reshape(-1, len(self.n))[::-1]
        return [np.concatenate([np.full(j[k], 3, np.int8), found[found[:, k] >= 0, k]]) for k in range(len(self.n))], (cost + EDIT // 2) // EDIT


def _enough(edits: int, n: int, m: int) -> int:
    """How far a band must reach beyond both corners so that no path of this cost, nor one dearer by a single step, leaves it.

    A path that leaves it has 2 (reach + 1) + |n - m| insertions and deletions at least.
    """
    return min(max(n, m), max(0, (edits + 4 - 3 * abs(n - m)) // 6))


def steps_of(pairs: list[tuple[list, list]], tilted: bool = True) -> list[np.ndarray]:
    """Numbers in STEPS of the cheapest path of each pair, many pairs in one sweep.

    A pair's band begins as wide as the words that both sides lack ask for, and widens, at least twofold, until its cost proves it wide enough.
    """
    number: dict[str, int] = {}
    code = lambda words, none: np.array([none if w is None else number.setdefault(w, len(number)) for w in words], np.int64)
    refs = [code([w and w.lower() for w in r], -1) for r, _ in pairs]
    hyps = [code(h, -2) for _, h in pairs]
    tilts = [np.array([tilted and bool(w) and w.isupper() for w in r], np.int64) for r, _ in pairs]
    reach = []
    for r, h in zip(refs, hyps, strict=True):
        lacking = min(len(r), len(h)) - (Counter(r.tolist()) & Counter(h.tolist())).total()
        reach.append(min(max(len(r), len(h)), _enough(4 * lacking + 3 * abs(len(r) - len(h)), len(r), len(h)) + 4))
    out: list = [None] * len(pairs)
    left = list(range(len(pairs)))
    while left:
        left.sort(key=lambda k: (len(refs[k]).bit_length(), len(hyps[k]) - len(refs[k]), len(refs[k])))
        batches, now, size = [], [], (0, 0, 0)
        for k in left:
            n, apart = len(refs[k]), len(hyps[k]) - len(refs[k])
            own = (max(size[0], n), min(size[1], min(0, apart) - reach[k]), max(size[2], max(0, apart) + reach[k]))
            if now and (len(now) + 1) * own[0] * (own[2] - own[1] + 1) > BATCH:
                batches.append((now, size))
                now, own = [], (n, min(0, apart) - reach[k], max(0, apart) + reach[k])
            now, size = [*now, k], own
        batches.append((now, size))
        left = []
        for of, (_, low, high) in batches:
            found, edits = _Band([refs[k] for k in of], [hyps[k] for k in of], [tilts[k] for k in of], low, high).solve()
            for k, steps, cost in zip(of, found, edits.tolist(), strict=True):
                n, m = len(refs[k]), len(hyps[k])
                needed = _enough(cost, n, m)
                wide = min(high - max(0, m - n), min(0, m - n) - low)  # its batch may have given it more
                if wide >= needed:
                    out[k] = steps
                else:
                    reach[k] = min(max(n, m), max(needed, 2 * reach[k]))
                    left.append(k)
    return out


def align(ref: list[str], hyp: list[str], tilted: bool = True) -> list[tuple[str, str | None, str | None]]:
    """Cheapest path as (operation, reference word, hypothesis word); upper-case reference words are disfluent.

    With a tilt, deletion of a disfluent word is cheaper by it and all else dearer; it decides between equal numbers of edits only. Reference words are lower-cased
    to be compared. Of equal steps the first of STEPS is taken, where a cell at the level of its least neighbour and the tilt counts as a match.
    """
    path, i, j = [], 0, 0
    for kind in steps_of([(ref, hyp)], tilted)[0].tolist():
        path.append((STEPS[kind], None if kind == 3 else ref[i], None if kind == 2 else hyp[j]))
        i, j = i + (kind != 3), j + (kind != 2)
    return path


PATH = "array<struct<type:string,ref:string,hyp:string>>"


def alignments(pairs: DataFrame, keys: list[str], tilted: bool = True, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """keys, the edit path of each pair of word arrays, and its Levenshtein distance `edits`. An empty hypothesis is all deletions; an empty reference
    has a null path; a null side has both null, and a null word equals nothing.
    """
    kinds = dict(pairs.dtypes)
    own = fresh(pairs.select(*keys), "ref", "hyp", "path", "edits")
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{own[2]}` {PATH}, `{own[3]}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, columns=own[:2]):
            refs, hyps = (b.column(c).to_pylist() for c in own[:2])
            edits = [None if r is None or h is None else edit_distance(r, h) for r, h in zip(refs, hyps, strict=True)]
            none = np.array([not r or h is None for r, h in zip(refs, hyps, strict=True)])
            todo = [(r, h) for r, h, gone in zip(refs, hyps, none.tolist(), strict=True) if not gone]
            found = steps_of(todo, tilted)
            steps, sizes = np.concatenate([np.zeros(0, np.int8), *found]), np.zeros(len(refs), np.int64)
            sizes[~none] = [len(s) for s in found]

            def words(side: int, without: int, steps: np.ndarray = steps, todo: list = todo) -> pa.Array:
                taken = steps != without
                return pa.array([w for pair in todo for w in pair[side]], pa.string()).take(pa.array(np.cumsum(taken) - 1, mask=~taken))

            cells = pa.StructArray.from_arrays([pa.array(STEPS).take(pa.array(steps, pa.int32())), words(0, 3), words(1, 2)], ["type", "ref", "hyp"])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(none, False)), cells)
            yield pa.record_batch([*(b.column(k) for k in keys), path, pa.array(edits, pa.int32())], names=[*keys, *own[2:]])

    return pairs.select(*keys, F.col(ref).alias(own[0]), F.col(hyp).alias(own[1])).mapInArrow(run, schema)


def disfluency_rates(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Operations in fluent and disfluent (upper-case reference) regions, and both error rates.

    fer = (s + d + i) / fluent reference words; der = (s + match + i) / disfluent ones; null without such words. Insertions are fluent.
    """
    return _rated(aligned.where("path is not null").select(*keys, "path"), keys)


def error_rates(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """keys, edits, ref_words, wer, fer and der of each pair, from one pass over the pairs; rates without words to be divided by are null."""
    aligned = alignments(pairs, keys, ref=ref, hyp=hyp)
    words = F.when(F.col("edits").isNotNull(), F.coalesce(F.size(F.filter("path", lambda x: x["type"] != "insertion")), F.lit(0)))
    rated = _rated(aligned.select(*keys, "path", "edits", words.alias("ref_words")), [*keys, "edits", "ref_words"])
    return rated.select(*keys, "edits", "ref_words", F.try_divide(F.col("edits"), F.col("ref_words")).alias("wer"), "fer", "der")


def _rated(aligned: DataFrame, keep: list[str]) -> DataFrame:
    kinds = ("match", "substitution", "deletion", "insertion")
    loud = lambda x: F.coalesce((F.upper(x["ref"]) == x["ref"]) & (F.lower(x["ref"]) != x["ref"]), F.lit(False)).cast("int")
    numbers = F.transform("path", lambda x: F.array_position(F.array(*map(F.lit, kinds)), x["type"]).cast("int") * 2 + loud(x))
    count = lambda k, dis: F.size(F.filter("numbers", lambda x: x == (kinds.index(k) + 1) * 2 + dis))
    coded = aligned.select(*keep, numbers.alias("numbers"))
    out = coded.select(*keep, *(count(k, d).alias(f"{k}_{n}") for k in kinds for d, n in ((False, "f"), (True, "d"))))
    c = F.col
    fer = F.try_divide(c("substitution_f") + c("deletion_f") + c("insertion_f"), c("match_f") + c("substitution_f") + c("deletion_f"))
    der = F.try_divide(c("substitution_d") + c("match_d") + c("insertion_d"), c("match_d") + c("substitution_d") + c("deletion_d"))
    return out.withColumns({"fer": fer, "der": der})
