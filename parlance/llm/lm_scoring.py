"""Stupid-backoff scores by relational counting: n-gram tables partitioned by hash, joined to the documents' n-grams.

Documents are read in blocks of a few MB. A block's n-grams of all orders (64-bit hashes) are counted in the block and dealt out by
ranges of the hash, a page of sorted hashes and counts for each range; each range sums the pages of all blocks and joins the totals back to the
n-grams of every block that asked. The answers meet the block's texts again, and each document sums its words. As
a block asks for an n-gram once, however often it holds it, no frequent n-gram is a hot key. Pages stand for rows of one n-gram each,
which are many times the bytes (see the README); the operations on them are a grouping by block and n-gram, one by n-gram, a join and a sum.

Score of a word: c(n-gram) / c(context) of the longest n-gram that at least `min_count` occurrences in the corpus support, times
alpha for each order given up; single words divide by the corpus size, which is counted as one more n-gram of every block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, stored
from .decontaminate import _FOLD
from .near_dedup import _mix

_MULTIPLY = np.uint64(0x9FB21C651E98DF25)
_IS_WORD = np.frombuffer(_FOLD, np.uint8) != 32
_PRIME = np.uint64(0xD6E8FEB86659FD93)
#: The n-gram of no words, whose count is the number of words.
TOTAL = np.uint64(0x5851F42D4C957F2D)
_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("mark", pa.int64()), ("data", pa.binary())])
_DDL = "block long, part int, mark long, data binary"
COLUMNS = "doc_id long, n_words long, log_score double, mean_log double, n_longest long, n_single long"


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes of non-negative integers, highest bytes together."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and for each value of x its place among them."""
    bits = np.uint64(max(1, len(x)).bit_length())
    low = np.uint64((1 << int(bits)) - 1)
    packed_order = np.sort((x & ~low) | np.arange(len(x), dtype=np.uint64))  # one sort of high bits and places: no indirect sort
    order = (packed_order & low).astype(np.int64)
    values = x[order]
    wrong = np.flatnonzero(values[1:] < values[:-1])  # equal in the high bits, not in the low
    if len(wrong):
        high = packed_order & ~low
        for h in np.unique_values(high[wrong]).tolist():
            a, e = np.searchsorted(high, np.uint64(h)), np.searchsorted(high, np.uint64(h), "right")
            again = np.argsort(values[a:e], kind="stable")
            order[a:e], values[a:e] = order[a:e][again], values[a:e][again]
    new = np.r_[True, values[1:] != values[:-1]][: len(x)]
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return values[new], place


def _powers(q: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        out[size : 2 * size] = out[: min(size, n - size)] * np.uint64(pow(q, size, 2**64))
        size *= 2
    return out


_STEP = 1 << 16
_BASE = int(_PRIME)
_BACK = pow(_BASE, -1, 2**64)
_UP, _DOWN = _powers(_BASE, _STEP), _powers(_BACK, _STEP)
#: A number for each byte of a word, 0 for the bytes between words.
_BYTES = np.where(np.frombuffer(_FOLD, np.uint8) == 32, np.uint64(0), _mix(np.frombuffer(_FOLD, np.uint8).astype(np.uint64) + np.uint64(1)))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins and the last ends, and the bytes of all texts; null texts have none."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8, at[-1] - at[0], at[0]) if at[-1] > at[0] else np.zeros(0, np.uint8)
    return at - at[0], data


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (as decontaminate.words has them) of all texts one after another, and their number in each text.

    A word's hash is a polynomial of its bytes, from running sums over the buffer of the column: no object for any word.
    Sums are carried from step to step, so a word or text of any length takes constant memory beside the column's.
    """
    at, data = _bytes(texts)
    letter = np.zeros(len(data) + 1, bool)
    letter[:-1] = _IS_WORD[data]
    edge = letter[1:] != letter[:-1]
    inner = at[(at > 0) & (at < len(data))]
    begin, end = np.flatnonzero(edge & letter[1:]) + 1, np.flatnonzero(edge & letter[:-1]) + 1
    if len(data) and letter[0]:
        begin = np.r_[0, begin]
    both = np.unique_values(inner[letter[inner] & letter[inner - 1]]) if len(inner) else inner  # words of two texts that touch
    if len(both):
        begin, end = np.sort(np.r_[begin, both]), np.sort(np.r_[end, both])
    sums, carry = np.zeros((2, len(begin)), np.uint64), np.uint64(0)
    up, down = 1, 1
    for first in range(0, len(data), _STEP):
        part = data[first : first + _STEP]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * _UP[: len(part)], out=total[1:])
        total = total * np.uint64(up) + carry
        a, e = np.searchsorted(begin, [first, first + len(part)])
        own = begin[a:e] - first
        sums[0, a:e] -= total[own]
        sums[1, a:e] = _DOWN[own] * np.uint64(down)
        a, e = np.searchsorted(end, [first, first + len(part)], "right")
        sums[0, a:e] += total[end[a:e] - first]
        carry = total[-1]
        up, down = up * pow(_BASE, _STEP, 2**64) % 2**64, down * pow(_BACK, _STEP, 2**64) % 2**64
    hashes = _mix(sums[0] * sums[1] + (end - begin).astype(np.uint64) * _MULTIPLY)
    return hashes, np.diff(np.searchsorted(begin, at))


def grams(texts: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Words of each text; for each order the hashes of the n-grams that end at each word; the place of each word in its text."""
    w, n = hashed_words(texts)
    return n, _suffixes(w, order), np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)


def _suffixes(w: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the last 1, 2, ... words at each position."""
    out, power, total = [], 1, np.zeros(len(w), np.uint64)
    for k in range(order):
        total = total + np.concatenate([np.zeros(min(k, len(w)), np.uint64), w[: max(0, len(w) - k)]]) * np.uint64(power)
        power = power * int(_PRIME) % 2**64
        out.append(_mix(total + np.uint64(k + 1)))
    return out


def _keys(hashes: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    return np.concatenate([h[place >= k] for k, h in enumerate(hashes)] + [np.full(1, TOTAL)])


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Block number, checksum and rows: small batches of a task are joined to blocks of about `size` bytes."""
    held, nbytes, k = [], 0, 0

    def whole() -> tuple[int, int, pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        mark = xxhash.xxh3_64(pc.fill_null(rows.column("doc_id"), -1).to_numpy().tobytes())
        for part in _bytes(rows.column("text")):
            mark.update(part)
        return (rows.column("task")[0].as_py() << 32) + k, mark.intdigest() >> 1, rows

    for part in byte_slices(batches, "text", size):
        own = part.column("text").nbytes
        if held and nbytes + own > size:
            yield whole()
            held, nbytes, k = [], 0, k + 1
        held.append(part)
        nbytes += own
    if held:
        yield whole()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _asked(batches: Iterator[pa.RecordBatch], order: int, parts: int, size: int) -> Iterator[pa.RecordBatch]:
    """A row for each block and range of hashes: hashes (as differences) and counts."""
    for block, mark, rows in _blocks(batches, size):
        n, hashes, place = grams(rows.column("text"), order)
        keys, count = np.unique(_keys(hashes, place), return_counts=True)
        count[np.searchsorted(keys, TOTAL)] = n.sum()
        cuts = np.searchsorted(_part(keys, parts), np.arange(parts + 1))
        out = []
        for p in range(parts):
            own = keys[cuts[p] : cuts[p + 1]]
            if len(own):
                data = packed(np.diff(own, prepend=np.uint64(0)))
                out.append((block, p, mark, len(data).to_bytes(4, "little") + data + packed(count[cuts[p] : cuts[p + 1]])))
        yield _rows(out)


def _answered(table: pa.Table) -> pa.Table:
    """Corpus counts of the n-grams that each block asked for, in its order."""
    data = table.column("data").to_pylist()
    keys, counts = [], []
    for x in data:
        n = int.from_bytes(x[:4], "little")
        keys.append(np.cumsum(unpacked(x[4 : 4 + n]), dtype=np.uint64))
        counts.append(unpacked(x[4 + n :]))
    sizes = np.cumsum([len(k) for k in keys])[:-1]
    _, at = distinct(np.concatenate(keys))
    total = np.bincount(at, weights=np.concatenate(counts))[at].astype(np.uint64)
    answers = [packed(x) for x in np.split(total, sizes)]
    return table.select(["block", "part", "mark"]).append_column("data", pa.array(answers, pa.binary())).cast(_SCHEMA)


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row for each block: its documents, compressed, as part -1."""
    for block, mark, rows in _blocks(batches, size):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_batch(rows)
        yield _rows([(block, -1, mark, zstandard.ZstdCompressor(level=3).compress(sink.getvalue()))])


def _scored(table: pa.Table, order: int, alpha: float, min_count: int) -> pa.Table:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = sorted(zip(table.column("part").to_pylist(), table.column("mark").to_pylist(), table.column("data").to_pylist(), strict=True))
    if rows[0][0] != -1 or len({m for _, m, _ in rows}) != 1 or len({p for p, _, _ in rows}) != len(rows):
        raise RuntimeError("the documents did not come in the same blocks twice; store them first (stable=False)")
    docs = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows[0][2])).read_all()
    n, hashes, place = grams(docs.column("text").combine_chunks(), order)
    keys, at = distinct(_keys(hashes, place))
    counts = np.concatenate([unpacked(x) for _, _, x in rows[1:]]).astype(float)
    if len(counts) != len(keys):
        raise RuntimeError("the documents did not come in the same blocks twice; store them first (stable=False)")
    total = counts[at[-1]]
    found, first = [], 0
    for k in range(order):
        own = place >= k
        found.append(np.zeros(len(own)))
        found[k][own] = counts[at[first : first + own.sum()]]
        first += own.sum()
    score = np.log(found[0] / total) + (order - 1) * math.log(alpha)
    used = np.zeros(len(score), np.int64)
    for k in range(1, order):
        seen = found[k] >= min_count
        context = np.concatenate([[1.0], found[k - 1][:-1]]) if len(score) else score
        score = np.where(seen, np.log(np.maximum(found[k], 1) / np.maximum(context, 1)) + (order - 1 - k) * math.log(alpha), score)
        used = np.where(seen, k, used)
    full = n > 0
    start = (np.cumsum(n) - n)[full]

    def summed(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(n), x.dtype)
        if full.any():
            out[full] = np.add.reduceat(x, start)
        return out

    total = summed(score)
    mean = pa.array(np.round(total / np.maximum(n, 1), 6), mask=~full)
    return pa.table([docs.column("doc_id"), pa.array(n), pa.array(np.round(total, 4)), mean, pa.array(summed((used == order - 1).astype(np.int64))), pa.array(summed((used == 0).astype(np.int64)))], names=names)


def ranges(size: int, part_bytes: int, block_bytes: int) -> int:
    """Ranges of hashes for an input of so many bytes: a block gives at most a row for each."""
    return max(16, min(-(-size // part_bytes), block_bytes >> 8))


def score_documents(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2, block_bytes: int = 8 << 20, part_bytes: int = 4 << 20,
                    stable: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_words, log_score (natural), mean_log, n_longest, n_single.

    Counts are of all documents. n_longest words were scored by the longest n-grams, n_single by single words. Null and
    wordless texts have no words, score 0 and no mean. Repeated rows count and score each; an empty table gives no rows; other
    columns are not read. A block gives a row for each range of hashes: there are as many ranges as part_bytes of text go into the
    input, but at most one for 256 bytes of a block, so rows grow in proportion to the input; beyond block_bytes / 256 x part_bytes of text
    (128 GB) a range grows instead, and larger blocks keep it small. docs is read twice and must come in the same partitions: say stable=True for a plain scan
    of files; else it is first stored in the shared folder.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as binary) as text")
    if not stable:
        rows = stored(rows, "lm-documents")
    rows = rows.withColumn("task", F.spark_partition_id())
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = ranges(size, part_bytes, block_bytes)
    asked = rows.mapInArrow(lambda it: _asked(it, order, parts, block_bytes), _DDL)
    answers = asked.groupBy("part").applyInArrow(_answered, _DDL)
    texts = rows.mapInArrow(lambda it: _texts(it, block_bytes), _DDL)
    return answers.unionByName(texts).groupBy("block").applyInArrow(lambda t: _scored(t, order, alpha, min_count), COLUMNS)
