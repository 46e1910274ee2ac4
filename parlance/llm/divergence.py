"""Divergence between the sources of each language, from term frequencies by single-pass in-memory indexing.

Every task counts the terms of its documents in memory. When the postings (language, source, term) in memory reach a limit
they leave as a run: sorted by hash shard and term, one packed row for each shard. Runs of a shard meet in a group, and a
heap merges them to the frequencies of a term in all sources. No group holds more than `fan_in` runs; where there are more,
passes merge bundles of runs to longer runs first.

Two sources p and q of a language differ by the sum of f(p, q) = floor((p - q)^2 / q) over its V kept terms, smoothed, in
billionths. Most terms are absent from most sources. So a pair starts from V times the f of two absent terms; the
histogram of each source's counts corrects for its own terms; and one stream over the terms corrects for those in both.
All of it is integer arithmetic, so the sums are exact.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, dropped, stored

#: A-Z become a-z; bytes that are neither letters nor part of a character beyond ASCII become blanks.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Cells of one numpy step.
_CELLS = 1 << 20
_PACKED = pa.schema([("term", pa.binary()), ("lang", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_RUN = "run long, shard int, packed binary"
_PAIRS = "lang string, source string, item string, value long"


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, in lower case, and of characters beyond ASCII."""
    return text.translate(_LETTERS).split()


def _pack(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _run(counts: dict, seen: dict, shards: int) -> Iterator[tuple[int, bytes]]:
    """The block in memory as (shard, packed postings sorted by term, language and source)."""
    columns: list[list] = [[], [], [], [], []]
    for (lang, source), own in counts.items():
        columns[0] += own.keys()
        columns[1] += [lang] * len(own)
        columns[2] += [source] * len(own)
        columns[3] += own.values()
        columns[4] += map(seen[lang, source].__getitem__, own)
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, _PACKED, strict=True)], _PACKED)
    shard = pa.array(np.fromiter((zlib.crc32(t) % shards for t in columns[0]), np.int64, len(columns[0])))
    order = pc.sort_indices(table.append_column("shard", shard), [(c, "ascending") for c in ("shard", "term", "lang", "source")])
    table, shard = table.take(order), shard.take(order).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield int(shard[a]), _pack(table.slice(a, b - a))


def _indexed(batches: Iterator[pa.RecordBatch], shards: int, most_postings: int) -> Iterator[pa.RecordBatch]:
    """Runs of the blocks of one task; a document is counted whole, so a block passes the limit by one document at most."""
    counts: dict[tuple, Counter] = {}
    seen: dict[tuple, Counter] = {}
    held, runs, task = 0, 0, TaskContext.get().partitionId() << 24

    def spilled() -> Iterator[pa.RecordBatch]:
        for shard, packed in _run(counts, seen, shards):
            yield pa.record_batch([pa.array([task + runs], pa.int64()), pa.array([shard], pa.int32()), pa.array([packed], pa.binary())], ["run", "shard", "packed"])

    for batch in byte_slices(batches, "text", 4 << 20):
        for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
            found = terms(text)
            if not found:
                continue
            if (lang, source) not in counts:
                counts[lang, source], seen[lang, source] = Counter(), Counter()
            own = counts[lang, source]
            held -= len(own)
            own.update(found)
            seen[lang, source].update(set(found))
            held += len(own)
            if held >= most_postings:
                yield from spilled()
                counts, seen, held, runs = {}, {}, 0, runs + 1
    yield from spilled()


class _Stream:
    """A packed run from its start, in chunks."""

    def __init__(self, packed: bytes, chunk: int) -> None:
        self._chunks = (batch.slice(a, chunk) for batch in pa.ipc.open_stream(packed) for a in range(0, batch.num_rows, chunk))
        self.advance()

    def advance(self) -> None:
        self.now = next(self._chunks, None)
        self.last = self.now.column("term")[-1].as_py() if self.now else None

    def up_to(self, term: bytes) -> Iterator[pa.RecordBatch]:
        """All rows left of terms up to this one."""
        while self.now and self.last <= term:
            yield self.now
            self.advance()
        if self.now and (n := pc.sum(pc.less_equal(self.now.column("term"), term)).as_py()):
            yield self.now.slice(0, n)
            self.now = self.now.slice(n)


def _merged(table: pa.Table, chunk: int = 1 << 14) -> Iterator[pa.Table]:
    """Heap merge of the runs of a group, a chunk at a time: each (term, language, source) once, in order; no term is in two tables.

    The heap has the last term in memory of each run; up to the least of them nothing can follow from any run.
    """
    streams = [_Stream(packed.as_py(), chunk) for packed in table.column("packed")]
    heap = [(s.last, k) for k, s in enumerate(streams) if s.now]
    heapq.heapify(heap)
    while heap:
        term = heap[0][0]
        found = [rows for s in streams for rows in s.up_to(term)]
        while heap and heap[0][0] <= term:
            k = heap[0][1]
            if streams[k].now:
                heapq.heapreplace(heap, (streams[k].last, k))
            else:
                heapq.heappop(heap)
        keys = ["term", "lang", "source"]
        yield pa.Table.from_batches(found).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")]).sort_by([(c, "ascending") for c in keys]).rename_columns(_PACKED.names)


def _bundled(table: pa.Table) -> pa.Table:
    """One longer run of a bundle of runs of a shard."""
    packed = _pack(pa.concat_tables(_merged(table)).combine_chunks())
    return pa.table([table.column("run").slice(0, 1), table.column("shard").slice(0, 1), pa.array([packed], pa.binary())], ["run", "shard", "packed"])


def _kept(table: pa.Table, min_docs: int) -> pa.Table:
    """Frequencies of the terms of a shard that enough documents of their language hold."""
    names, kinds, out = ["lang", "term", "sources", "counts"], [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())], []
    for rows in _merged(table):
        rows = rows.combine_chunks()
        term, lang = (rows.column(c).combine_chunks() for c in ("term", "lang"))
        other = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(other) + 1])
        kept = np.add.reduceat(rows.column("docs").to_numpy(), starts) >= min_docs
        sizes = np.diff(np.append(starts, len(term)))
        rows, starts, sizes = rows.filter(pa.array(np.repeat(kept, sizes))), starts[kept], sizes[kept]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, rows.column(c).combine_chunks()) for c in ("source", "n")]
        out.append(pa.table([lang.take(pa.array(starts)), term.take(pa.array(starts)).cast(pa.string()), *lists], names))
    return pa.concat_tables(out) if out else pa.table([pa.array([], k) for k in kinds], names)


def term_frequencies(docs: DataFrame, min_docs: int = 3, shards: int | None = None, most_postings: int = 400_000, fan_in: int = 256) -> DataFrame:
    """(lang, term, sources, counts) of each term that at least `min_docs` documents of its language hold, stored.

    docs: text (binary), lang and source, without nulls. shards: by default one for 8 MB that the optimizer expects of the input, 16
    at least and 65,536 at most. A worker holds `most_postings` postings while it counts, and packed runs of one shard while it merges.
    """
    if shards is None:
        expected = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        shards = max(16, min(65_536, expected >> 23))
    runs = stored(docs.mapInArrow(lambda it: _indexed(it, shards, most_postings), _RUN), "runs")
    while (n := runs.agg(F.count_distinct("run")).first()[0]) > fan_in:
        bundle = F.pmod(F.xxhash64("run"), F.lit(-(-n * 2 // fan_in)))
        longer = stored(runs.withColumn("run", bundle).groupBy("shard", "run").applyInArrow(_bundled, _RUN), "runs")
        dropped(runs)
        runs = longer
    out = stored(runs.groupBy("shard").applyInArrow(lambda t: _kept(t, min_docs), "lang string, term string, sources array<string>, counts array<bigint>"), "frequencies")
    dropped(runs)
    return out


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total) in longs, by three steps of a thousand, as the product may not fit one."""
    rest, out = count + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _share(count: Column, total: Column) -> Column:
    """The same as a column."""
    rest, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + F.call_function("div", rest, total), rest % total
    return out + 1


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _by_histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each source's own terms and the terms in neither source give to its pairs, both ways."""
    for batch in batches:
        for row in batch.to_pylist():
            kept, names = row["kept"], row["sources"]
            first, second = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            if kept:
                other = share(np.zeros(len(names), np.int64), np.array(row["totals"]) + kept)
                own_total = np.int64(row["total"] + kept)
                own = share(np.int64(0), own_total)
                base, back = _distance(own, other), _distance(other, own)
                first += kept * base
                counts = np.array([h["n"] for h in row["histogram"] or []], np.int64)
                times = np.array([h["times"] for h in row["histogram"] or []], np.int64)
                step = max(1, _CELLS // max(1, len(names)))
                for a in range(0, len(counts), step):
                    p = share(counts[a : a + step], own_total)[:, None]
                    t = times[a : a + step, None]
                    first += (t * (_distance(p, other) - base)).sum(0)
                    second += (t * (_distance(other, p) - back)).sum(0)
            others = [k for k, s in enumerate(names) if s != row["source"]]
            names = [names[k] for k in others]
            mine = [row["source"]] * len(names)
            values = np.concatenate([first[others], second[others]])
            yield pa.record_batch([pa.array([row["lang"]] * 2 * len(names), pa.string()), pa.array(mine + names, pa.string()), pa.array(names + mine, pa.string()), pa.array(values, pa.int64())], ["lang", "source", "item", "value"])


def _by_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that both sources of a pair hold add to what the histograms assumed, summed over each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        shared = batch.column("shared")
        flat = shared.flatten()
        names = pc.dictionary_encode(flat.field("source"))
        code, n, total = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.field("n").to_numpy(), flat.field("total").to_numpy()
        lang = pc.dictionary_encode(batch.column("lang"))
        of_row, sizes = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(shared).to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        p, absent, width = share(n, total), share(np.zeros(len(n), np.int64), total), len(names.dictionary)
        keys, sums = [], []
        for m in np.unique(sizes):
            rows = np.flatnonzero(sizes == m)
            across = max(1, min(m, _CELLS // m))
            down = max(1, _CELLS // (across * m))
            for r in range(0, len(rows), down):
                own = rows[r : r + down]
                at = starts[own][:, None] + np.arange(m)
                q, q0 = p[at][:, None, :], absent[at][:, None, :]
                for c in range(0, m, across):
                    left = at[:, c : c + across]
                    p1, p0 = p[left][:, :, None], absent[left][:, :, None]
                    value = _distance(p1, q) - _distance(p1, q0) - _distance(p0, q) + _distance(p0, q0)
                    key = (of_row[own][:, None, None] * width + code[left][:, :, None]) * width + code[at][:, None, :]
                    key, where = np.unique(key.ravel(), return_inverse=True)
                    total_of = np.zeros(len(key), np.int64)
                    np.add.at(total_of, where, value.ravel())
                    keys.append(key)
                    sums.append(total_of)
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        value = np.zeros(len(key), np.int64)
        np.add.at(value, where, np.concatenate(sums))
        other = key // width % width != key % width
        key, value = key[other], value[other]
        take = lambda values, k: values.take(pa.array(k, pa.int64()))
        yield pa.record_batch([take(lang.dictionary, key // (width * width)), take(names.dictionary, key // width % width), take(names.dictionary, key % width), pa.array(value)], ["lang", "source", "item", "value"])


def source_divergence(docs: DataFrame, top: int = 200, min_docs: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **indexing: int | None) -> DataFrame:
    """lang, source, part, item, value, rank: how the terms of each source differ from those of the others of its language.

    part `pair`: item is each other source, value the sum of f over all kept terms. part `term`: the `top` terms that the source
    uses more than its language, by f. Nulls in text, language and source are empty strings, and the empty string is a language or a source
    like others. Ties rank by item. Repeated rows count each. A language of one source has no pairs; an empty table gives no rows. Other columns are not read.
    indexing: arguments of term_frequencies.
    """
    rows = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    found = term_frequencies(rows.withColumn("text", F.col("text").cast("binary")), min_docs, **indexing)
    every = rows.select("lang", "source").distinct()
    postings = found.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("p")).select("lang", "term", F.col("p.sources").alias("source"), F.col("p.counts").alias("n"))
    histogram = stored(postings.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times")), "histograms")
    kept = found.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    own = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("total"), F.collect_list(F.struct("n", "times")).alias("histogram"))
    groups = every.join(own, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    groups = stored(groups.join(kept, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long"))), "groups")
    langs = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "total")).alias("g")).select("lang", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"))
    sums = groups.join(langs, "lang").mapInArrow(_by_histogram, _PAIRS)
    totals = groups.select("lang", "source", (F.col("total") + F.col("kept")).alias("total"))
    several = found.where(F.size("sources") > 1).select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("p")).select("lang", "term", F.col("p.sources").alias("source"), F.col("p.counts").alias("n"))
    both = several.join(totals, ["lang", "source"]).groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n", "total")).alias("shared"))
    sums = sums.unionByName(both.select("lang", "shared").mapInArrow(_by_terms, _PAIRS))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value")).withColumn("rank", F.row_number().over(ranked))
    whole = groups.groupBy("lang").agg((F.sum("total") + F.first("kept")).alias("whole"))
    all_counts = found.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"), "sources", "counts")
    used = all_counts.join(whole, "lang").select("lang", "term", _share(F.col("all"), F.col("whole")).alias("q"), F.explode(F.arrays_zip("sources", "counts")).alias("p"))
    used = used.select("lang", F.col("p.sources").alias("source"), F.col("term").alias("item"), "q", F.col("p.counts").alias("n")).join(totals, ["lang", "source"])
    over = used.withColumn("p", _share(F.col("n"), F.col("total"))).where("p > q")
    valued = over.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    words = valued.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(words.withColumn("part", F.lit("term")).select(*columns))
