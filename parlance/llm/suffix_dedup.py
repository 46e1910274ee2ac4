"""Removal of repeated byte strings: suffix arrays by linear grouping over the pieces of texts that may repeat.

Every window of `length` bytes has an anchor: the gram of GRAM bytes with the least hash in it. Equal windows have equal anchors at equal
places, so a piece (the consecutive windows of one anchor) can only meet pieces of the same anchor. Spark counts pieces by
anchor and content, as hashes; an anchor seen once cannot repeat, and one that always has the same content repeats
throughout. Only the distinct pieces of the other anchors are fetched from the texts, dealt out by anchor, trimmed to what another piece may share, and
put into a suffix array in each task: equal windows are neighbours in it. Documents gather their repeated windows and drop the bytes they cover.

A common line has an anchor with a new context in every document. So groups are split by the text around the
anchor: a window lies at least half to its left or half to its right, so its piece's windows go to two groups, keyed by
the half context on that side. A group of one cannot repeat and goes no further. Groups of more than `task_bytes` are split again by half
of what is open of the context, until they are small or all of a group's windows are known to be equal.

The suffix array is built as Baier's grouping does: suffixes are grouped by their first byte, groups are taken from the
highest down, and each splits the groups of its members' previous smaller suffixes by how many of its members point there, until
groups are Lyndon prefixes; a scan then emits each group's order by the same pointers. There is no recursion or renaming. Members are
put in order of position before a group is taken, which the pointers need here: that sort makes it n log n at worst where groups stay large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, dropped, stored
from .near_dedup import _mix

GRAM = 50
_PRIME = 0x9E3779B97F4A7C15
_FAR = np.uint64(2**64 - 1)
COLUMNS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_array(text: bytes) -> list[int]:
    """Start positions of the suffixes of a text in ascending order."""
    codes = [c + 1 for c in text] + [0]
    n = len(codes)
    order = np.argsort(np.array(codes, np.int16), kind="stable").tolist()
    group, end, place = [0] * n, [0] * n, [0] * n  # group: where the suffix's group begins; end: by that, where it ends
    first, last = 0, None
    for k, i in enumerate(order):
        if codes[i] != last:
            first, last = k, codes[i]
        group[i], end[first], place[i] = first, k, k
    smaller = [-1] * n
    top = n - 1
    while top >= 0:
        here = group[order[top]]
        pointed: dict[int, int] = {}
        for i in sorted(order[here : top + 1]) if top > here else (order[here],):
            j = i - 1
            while j >= 0 and group[j] >= here:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        top = here - 1
        most = max(pointed.values(), default=0)
        if most == 1:
            levels = [list(pointed)]
        else:
            levels = [[] for _ in range(most)]
            for j, times in pointed.items():
                levels[most - times].append(j)
        for level in levels:
            ends: dict[int, int] = {}
            for j in level:
                g = group[j]
                e = end[g]
                if g not in ends:
                    ends[g] = e
                p, other = place[j], order[e]
                order[p], order[e] = other, j
                place[other], place[j] = p, e
                end[g] = e - 1
            begins = {g: end[g] + 1 for g in ends}
            for j in level:
                group[j] = begins[group[j]]
            for g, e in ends.items():
                end[begins[g]] = e
    rank, out = [-1] * n, [-1] * n
    free = list(range(n))  # by the start of a group: where its next suffix goes
    out[0], rank[n - 1] = n - 1, 0
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and rank[j] < 0:
            g = group[j]
            at = free[g]
            free[g] = at + 1
            rank[j], out[at] = at, j
            j = smaller[j]
    return out[1:]


def _rolling(x: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all grams of `length`, by doubling."""
    total, done, size, h = None, 0, 1, x
    while True:
        if length & size:
            own = h[done:]
            total = own if total is None else total[: len(own)] * np.uint64(pow(_PRIME, size, 2**64)) + own
            done += size
        if size * 2 > length:
            return total
        h = h[:-size] * np.uint64(pow(_PRIME, size, 2**64)) + h[size:]
        size *= 2


def pieces(text: bytes, length: int, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor, content hash, first window, windows, weight and place of the anchor of the pieces of a text, by stretches of `chunk` windows.

    Adjacent equal pieces (of repetitive texts) are one row with their number as weight.
    """
    wide = length - GRAM + 1
    for begin in range(0, len(text) - length + 1, chunk):
        part = np.frombuffer(text, np.uint8, min(len(text) - begin, chunk + length - 1), begin).astype(np.uint64) + np.uint64(1)
        n = len(part) - length + 1
        gram, whole = _mix(_rolling(part, GRAM)), _rolling(part, length)
        key = (gram & ~np.uint64((1 << 21) - 1)) | np.arange(len(gram), dtype=np.uint64)
        block = np.concatenate([key, np.full(-len(key) % wide, _FAR)]).reshape(-1, wide)
        before = np.minimum.accumulate(block, axis=1).ravel()
        after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(after[:n], before[wide - 1 : wide - 1 + n]) & np.uint64((1 << 21) - 1)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        stop = np.r_[start[1:], n]
        anchor = gram[at[start]]
        content = _mix(_mix(whole[start]) * np.uint64(_PRIME) + _mix(whole[stop - 1]) + ((at[start] - start) << 20 | (stop - start)).astype(np.uint64))
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])
        weight = np.diff(np.r_[new, len(start)])
        final = np.r_[new[1:], len(start)] - 1
        yield anchor[new], content[new], begin + start[new], stop[final] - start[new], weight, (at[start] - start)[new]


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def _shared(parts: list[bytes]) -> list[int]:
    """For each string the longest prefix that it shares with any other: with a neighbour in sorted order."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        n = _common(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


Piece = tuple[bytes, int, bool]


def repeated_runs(groups: list[list[Piece]], length: int) -> list[list[list[int]]]:
    """For each piece the flattened [a, b) runs of windows that repeat.

    A group holds the distinct pieces of one anchor as (bytes, place of the anchor, whether the piece itself repeats). A window
    reaches no further to either side of the anchor than some other piece agrees, so pieces are first trimmed to that; equal
    trimmed pieces are one that repeats. Of the rest, equal windows are neighbours in the suffix array.
    """
    cores: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}
    for g, group in enumerate(groups):
        left, right = _shared([p[:o][::-1] for p, o, _ in group]), _shared([p[o:] for p, o, _ in group])
        for k, (p, o, _) in enumerate(group):
            if left[k] + right[k] >= length:
                cores.setdefault((g, left[k], p[o - left[k] : o + right[k]]), []).append((g, k))
    text = b"".join(core for _, _, core in cores)
    valid, twice, at = bytearray(len(text)), bytearray(len(text)), 0
    for _, _, core in cores:
        n = len(core) - length + 1
        valid[at : at + n] = b"\1" * n
        at += len(core)
    last, last_at = None, 0
    for i in suffix_array(text):
        if valid[i]:
            own = text[i : i + length]
            if own == last:
                twice[i] = twice[last_at] = 1
            last, last_at = own, i
    out = [[[0, len(p) - length + 1] if always else [] for p, _, always in group] for group in groups]
    at = 0
    for (_, reach, core), owners in cores.items():
        n = len(core) - length + 1
        mark = np.ones(n, bool) if len(owners) > 1 else np.frombuffer(twice, np.uint8, n, at).astype(bool)
        runs = np.flatnonzero(np.diff(np.r_[False, mark, False].astype(np.int8)))
        for g, k in owners:
            _, o, always = groups[g][k]
            if not always:
                out[g][k] = (runs + (o - reach)).tolist()
        at += len(core)
    return out


_OCC = "h long, mark long, anchor long, content long, start long, windows long, weight long, place long"


def _occurrences(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for part in byte_slices(batches, "text", 4 << 20):
        out = []
        for h, mark, text in zip(*(part.column(c).to_pylist() for c in ("h", "mark", "text")), strict=True):
            if text and len(text) >= length:
                for got in pieces(text, length):
                    n = len(got[0])
                    out.append((np.full(n, h), np.full(n, mark), got[0].view(np.int64), got[1].view(np.int64), *got[2:]))
        if out:
            yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=[c.split()[0] for c in _OCC.split(", ")])


def _fetched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for part in byte_slices(batches, "text", 2 << 20):
        rows = []
        for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True):
            for w in wanted:
                rows.append((w["anchor"], w["content"], w["often"], w["place"], text[w["start"] : w["start"] + w["windows"] + length - 1]))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.bool_()), pa.array(list(cols[3]), pa.int64()), pa.array(list(cols[4]), pa.binary())], names=["anchor", "content", "often", "place", "piece"])


def _halves(over: DataFrame, length: int) -> DataFrame:
    """Rows of pieces, each split in two by where its windows lie about the anchor.

    A row stands for the windows lo to hi of a piece, all of which hold `left` bytes before the anchor and `right` after it; these are in its key.
    """
    span = length - GRAM
    half = F.ceil((F.lit(span) - F.col("left") - F.col("right")) / 2).cast("int")
    cut = F.col("place") - F.col("left") - F.col("half") + 1  # windows before it hold half of what is open on the left
    before = F.struct(F.col("lo").alias("lo"), F.least("hi", cut).alias("hi"), (F.col("left") + F.col("half")).alias("left"), F.col("right").alias("right"))
    after = F.struct(F.greatest("lo", cut).alias("lo"), F.col("hi").alias("hi"), F.col("left").alias("left"), (F.lit(span) - F.col("left") - F.col("half") + 1).alias("right"))
    rows = over.withColumn("half", half).withColumn("side", F.explode(F.array(before, after))).where("side.lo < side.hi")
    known = F.expr(f"substring(piece, place - side.left + 1, side.left + side.right + {GRAM})")
    key = F.xxhash64("anchor", "side.left", "side.right", known)
    return rows.select("anchor", "content", "often", "place", "piece", key.alias("key"), "side.lo", "side.hi", "side.left", "side.right")


def _bounded(pieces: DataFrame, length: int, task_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups (by key) of at most task_bytes; and rows of larger ones whose windows are all equal."""
    ready, equal, now = [], [], _halves(pieces, length)
    for _ in range(length.bit_length() + 2):
        sizes = now.groupBy("key").agg(F.sum(F.octet_length("piece")).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("often").alias("often"))
        kinds = sizes.where("rows > 1 or often").select("key", (F.col("bytes") > task_bytes).alias("large"))  # a lone window repeats nowhere
        judged = now.join(kinds, "key")
        ready.append(judged.where("not large").drop("large"))
        large = stored(judged.where("large").drop("large"), "large-groups")
        known = F.col("left") + F.col("right") == length - GRAM
        if large.isEmpty():
            dropped(large)
            break
        equal.append(large.where(known))
        now = _halves(large.where(~known), length)
    else:  # what is open of a window's context halves in each round
        raise RuntimeError("groups did not settle")
    return reduce(DataFrame.unionByName, ready), reduce(DataFrame.unionByName, equal) if equal else None


def _sorted(table: pa.Table, length: int) -> pa.Table:
    held: dict[tuple, list[tuple]] = {}
    for row in zip(*(table.column(x).to_pylist() for x in ("key", "left", "right", "anchor", "content", "often", "place", "piece", "lo", "hi")), strict=True):
        held.setdefault(row[:3], []).append(row[3:])
    groups = [[(piece[lo : hi + length - 1], place - lo, often) for _, _, often, place, piece, lo, hi in g] for g in held.values()]
    found = [(r[0], r[1], [x + r[5] for x in runs]) for g, own in zip(held.values(), repeated_runs(groups, length), strict=True) for r, runs in zip(g, own, strict=True) if runs]
    a, c, runs = zip(*found, strict=True) if found else ((), (), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], names=["anchor", "content", "runs"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for part in byte_slices(batches, "text", 4 << 20):
        rows = []
        for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
            text = text or b""
            if not spans:
                rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                continue
            depth = np.zeros(len(text) + 1, np.int32)
            bounds = np.array([(s["a"], s["b"]) for s in spans], np.int64)
            np.add.at(depth, bounds[:, 0], 1)
            np.add.at(depth, bounds[:, 1] + length - 1, -1)
            gone = np.cumsum(depth)[:-1] > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True))
        yield pa.record_batch([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=[c.split()[0] for c in COLUMNS.split(", ")])


def remove_repeats(docs: DataFrame, length: int = 200, task_bytes: int = 256 << 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in another document or the same.
    Null texts are empty; texts shorter than `length` stay whole. Repeated rows repeat each other. An empty table gives no
    rows; other columns are not read. Texts equal in hash and id share one list of spans. No task gets more than about
    task_bytes of pieces that may repeat, however many contexts a passage has.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as binary) as text")
    rows = rows.withColumns({"h": F.xxhash64("doc_id"), "mark": F.xxhash64("text")})
    found = rows.select("h", "mark", "text").mapInArrow(lambda it: _occurrences(it, length), _OCC)
    kinds = found.groupBy("anchor", "content").agg(F.sum("weight").alias("n"))
    anchors = kinds.groupBy("anchor").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contents")).where("n > 1").select("anchor", "contents")
    hits = stored(found.join(anchors, "anchor"), "hits")
    # pieces of anchors with one content repeat as they are; of the others each content is fetched once
    several = hits.where("contents > 1")
    first = several.groupBy("anchor", "content").agg(F.sum("weight").alias("n"), F.min(F.struct("h", "mark", "start", (F.col("windows") / F.col("weight")).cast("long").alias("windows"), "place")).alias("r"))
    wanted = first.groupBy(F.col("r.h").alias("h"), F.col("r.mark").alias("mark")).agg(F.collect_list(F.struct("anchor", "content", (F.col("n") > 1).alias("often"), "r.start", "r.windows", "r.place")).alias("wanted"))
    fetched = rows.select("h", "mark", "text").join(wanted, ["h", "mark"]).select("text", "wanted").mapInArrow(lambda it: _fetched(it, length), "anchor long, content long, often boolean, place long, piece binary")
    fetched = fetched.dropDuplicates(["anchor", "content"])  # repeated rows are fetched as often
    whole = {"place": F.col("place").cast("int"), "key": F.col("anchor"), "lo": F.lit(0), "hi": F.octet_length("piece") - length + 1, "left": F.lit(0), "right": F.lit(0)}
    fetched = stored(fetched.withColumns(whole), "pieces")
    size = fetched.agg(F.sum(F.octet_length("piece")).alias("n")).first()["n"] or 0
    parts = max(16, -(-size // task_bytes))
    small, equal = _bounded(fetched, length, task_bytes)
    solved = small.withColumn("part", F.pmod("key", F.lit(parts))).groupBy("part").applyInArrow(lambda t: _sorted(t, length), "anchor long, content long, runs array<long>")
    if equal is not None:
        solved = solved.unionByName(equal.select("anchor", "content", F.array(F.col("lo").cast("long"), F.col("hi").cast("long")).alias("runs")))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1), lambda k: F.struct(F.get("runs", 2 * k).alias("x"), F.get("runs", 2 * k + 1).alias("y")))
    runs = solved.where(F.size("runs") > 0).select("anchor", "content", pairs.alias("pairs"))
    met = several.join(runs, ["anchor", "content"]).select("h", "mark", "start", "windows", "weight", F.explode("pairs").alias("p"))
    a, b = F.col("start") + F.col("p.x"), F.when(F.col("weight") > 1, F.col("start") + F.col("windows")).otherwise(F.col("start") + F.col("p.y"))
    spans = hits.where("contents = 1").select("h", "mark", F.col("start").alias("a"), (F.col("start") + F.col("windows")).alias("b")).unionByName(met.select("h", "mark", a.alias("a"), b.alias("b")))
    by_text = spans.groupBy("h", "mark").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # bounded by the text's length
    return rows.join(by_text, ["h", "mark"], "left").select("doc_id", "text", "spans").mapInArrow(lambda it: _cut(it, length), COLUMNS)
