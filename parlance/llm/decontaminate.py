"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Every benchmark item gives its windows of `window` consecutive words (an item of fewer words: itself). Exact containment
of a window needs all its words, so the prefix of each window under a global order by rarity is one word: the one that
documents hold least often, counted over all documents. Documents are joined on prefix words only; positional and
length bounds place the window around the match, and the words are then compared one by one.

Document frequencies of all benchmark words come from one scan of the documents, summed and joined to the windows by Spark. A bitmap of
BITS bits, whatever the benchmark's size, spares most other words the shuffle; those that it lets through meet no window.

Windows are looked up in blocks of about `block_windows`. A block's tables are broadcast (their size is
bounded by that number). One block is matched where the documents are read. Of several, only one at a time is in the driver
and the workers: each pass over the documents stores the occurrences it finds, and its broadcasts are destroyed before the next;
texts then meet their occurrences by two hashes. There is no cap on matches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, dropped, numbered_columns, stored

#: A-Z to lower case; digits, letters and all bytes from 0x80 stay; the rest separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Bits of the map of benchmark words.
BITS = 1 << 23
COLUMNS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII bytes of UTF-8."""
    return (text or b"").translate(_FOLD).split()


def item_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct (window, items): the words joined by a space, and the ids of all items that hold it; a null stands for those without."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", 1 << 20):
            items, found = [], []
            for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                w = words(text)
                if w:
                    own = {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))}
                    found += own
                    items += [item] * len(own)
            yield pa.record_batch([pa.array(items, pa.string()), pa.array(found, pa.binary())], names=["item", "window"])

    rows = benchmark.selectExpr(f"cast(`{item_col}` as string) as item", f"cast(`{text_col}` as binary) as text")
    cut_rows = rows.mapInArrow(cut, "item string, window binary")
    unnamed = F.when(F.max(F.col("item").isNull()), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    return cut_rows.groupBy("window").agg(F.concat(F.sort_array(F.collect_set("item")), unnamed).alias("items"))


def _frequencies(batches: Iterator[pa.RecordBatch], bitmap: bytes, most: int = 300_000) -> Iterator[pa.RecordBatch]:
    """How many documents of this task hold each word that the bitmap lets through; a word may come several times."""
    counts: dict[bytes, int] = {}  # -1: not let through
    names = ["word", "n"]

    def told() -> pa.RecordBatch:
        own = {w: n for w, n in counts.items() if n > 0}
        return pa.record_batch([pa.array(own, pa.binary()), pa.array(own.values(), pa.int64())], names=names)

    for part in byte_slices(batches, "text", 4 << 20):
        for text in part.column("text").to_pylist():
            for word in set(words(text)):
                n = counts.get(word)
                if n is None:
                    at = zlib.crc32(word) % BITS
                    counts[word] = 1 if bitmap[at >> 3] >> (at & 7) & 1 else -1
                elif n > 0:
                    counts[word] = n + 1
            if len(counts) > most:
                yield told()
                counts.clear()
    yield told()


def _prefixed(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """windows (window, items) with the place of the word that the fewest of rows hold; of equal ones the first by its bytes, then by place."""
    spark = rows.sparkSession
    placed = windows.select("window", F.posexplode(F.split(F.col("window").cast("string"), " ")).alias("at", "word")).withColumn("word", F.col("word").cast("binary"))
    bits = np.zeros(BITS, bool)
    for r in placed.select((F.crc32("word") % BITS).alias("k")).distinct().collect():  # BITS numbers at most
        bits[r["k"]] = True
    sent = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())
    held = rows.select("text").mapInArrow(lambda it: _frequencies(it, sent.value), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at"))
    first = placed.join(held, "word", "left").groupBy("window").agg(rarest.alias("r")).select("window", F.col("r.at").alias("at"))
    return windows.join(first, "window")


class Block:
    """Windows of one block as word numbers (1 and up; 0 is any other word), by their prefix word."""

    def __init__(self, found: list[tuple[bytes, list[str], int]]):
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for text, _, _ in found for w in text.split(b" ")}))}
        self.windows = [np.array([self.number[w] for w in text.split(b" ")], np.int32) for text, _, _ in found]
        self.items = [items for _, items, _ in found]
        self.by_prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.is_prefix = np.zeros(len(self.number) + 1, bool)
        for k, (w, (_, _, at)) in enumerate(zip(self.windows, found, strict=True)):
            self.by_prefix[int(w[at])].append((k, at))
            self.is_prefix[w[at]] = True

    def hits(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(first word, length) of each occurrence of a window, and the items."""
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in tokens), np.int32, len(tokens))
        spans, items = [], set()
        for at in np.flatnonzero(self.is_prefix[ids]).tolist():
            for k, offset in self.by_prefix[int(ids[at])]:
                w, first = self.windows[k], at - offset
                if first >= 0 and first + len(w) <= len(ids) and np.array_equal(ids[first : first + len(w)], w):
                    spans.append((first, len(w)))
                    items.update(self.items[k])
        return spans, items


_FOUND = "h long, g int, first array<int>, length array<int>, items array<string>"


def _matched(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """Occurrences of a block's windows in each text that holds any."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    for part in byte_slices(batches, "text", 4 << 20):
        rows = []
        for h, g, text in zip(*(part.column(c).to_pylist() for c in ("h", "g", "text")), strict=True):
            spans, items = block.hits(words(text))
            if spans:
                rows.append((h, g, [a for a, _ in spans], [n for _, n in spans], list(items)))
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
        yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _judged(text: bytes | None, found: list[tuple[list[tuple[int, int]], set]], share: int) -> tuple[int, int, set, bool]:
    """Words, hit words, items and contamination of a text with the occurrences and items of each block."""
    n = len(words(text))
    items: set = set()
    hit = np.zeros(n, bool)
    for spans, own in found:
        for first, length in spans:
            hit[first : first + length] = True
        items |= own
    n_hit = int(hit.sum())
    return n, n_hit, items, n_hit > 0 and share * n_hit >= n


def _keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("h"), F.hash(text).alias("g")


def _searched(rows: DataFrame, benchmark: DataFrame, window: int, block_windows: int, item_col: str, item_text_col: str) -> tuple[Broadcast | None, DataFrame | None]:
    """The broadcast of the benchmark's only block, or what the blocks, one after another, find in rows (h, g, text)."""
    spark = rows.sparkSession
    plain = stored(item_windows(benchmark, window, item_col, item_text_col), "windows")
    windows = stored(_prefixed(rows, plain), "windows")
    dropped(plain)
    n_blocks = max(1, -(-windows.count() // block_windows))
    numbered = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(n_blocks)))
    parts = []
    for k in range(n_blocks):
        found = [(bytes(r[0]), list(r[1]), r[2]) for r in numbered.where(F.col("block") == k).select("window", "items", "at").collect()]  # block_windows, about
        block = spark.sparkContext.broadcast(Block(found))
        if n_blocks == 1:
            dropped(windows)
            return block, None
        parts.append(stored(rows.select("h", "g", "text").mapInArrow(lambda it, v=block: _matched(it, v.value), _FOUND).distinct(), "occurrences"))
        block.destroy(blocking=True)
    dropped(windows)
    return None, reduce(DataFrame.unionAll, parts).groupBy("h", "g").agg(F.collect_list(F.struct("first", "length", "items")).alias("found"))


def _results(part: pa.RecordBatch, column: str, block: Block | None, share: int) -> list[tuple[int, int, set, bool]]:
    texts = part.column(column).cast(pa.binary()).to_pylist()
    if block:
        return [_judged(t, [block.hits(words(t))], share) for t in texts]
    given = part.column("_found").to_pylist()
    return [_judged(t, [(list(zip(x["first"], x["length"], strict=True)), set(x["items"])) for x in g or ()], share) for t, g in zip(texts, given, strict=True)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_windows: int = 100_000,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if some words are hit and share * n_hit >= n_words. Null and wordless texts have no words
    and no hits; null and wordless items give no windows. Items without an id hit words as all others do, count as one item
    together and are left out of the hashed list. Repeated documents each get their row; repeated items count once for each
    id. Other columns are not read.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as binary) as text").select("doc_id", "text", *_keys(F.col("text")))
    sent, found = _searched(rows, benchmark, window, block_windows, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value if sent else None
        for part in byte_slices(batches, "text", 4 << 20):
            n, n_hit, items, bad = zip(*_results(part, "text", block, share), strict=True)
            digest = [hashlib.sha256(",".join(sorted(x - {None})).encode()).hexdigest() for x in items]
            yield pa.record_batch([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, n_hit, map(len, items))), pa.array(digest, pa.string()), pa.array(bad, pa.bool_())], names=[c.split()[0] for c in COLUMNS.split(", ")])

    given = rows.select("doc_id", "text") if found is None else rows.join(found, ["h", "g"], "left").select("doc_id", "text", F.col("found").alias("_found"))
    return given.mapInArrow(run, COLUMNS)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_windows: int = 100_000,
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Those rows of docs, with all their columns, that are not contaminated.

    Null and wordless texts stay; the id is not looked at. Repeated rows are judged alike and all stay or go; an empty table gives
    none; an empty benchmark takes none.
    """
    given, text_col = numbered_columns(docs, text_col)
    rows = given.select(given[text_col].cast("binary").alias("text")).select("text", *_keys(F.col("text")))
    sent, found = _searched(rows, benchmark, window, block_windows, item_col, item_text_col)
    names, schema = given.columns, given.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value if sent else None
        for part in byte_slices(batches, text_col, 4 << 20):
            kept = [not bad for *_, bad in _results(part, text_col, block, share)]
            yield part.select(names).filter(pa.array(kept, pa.bool_()))

    if found is not None:
        h, g = _keys(given[text_col].cast("binary"))
        given = given.join(found.withColumnsRenamed({"h": "_h", "g": "_g", "found": "_found"}), (h == F.col("_h")) & (g == F.col("_g")), "left").drop("_h", "_g")
    return given.mapInArrow(run, schema).toDF(*docs.columns)
