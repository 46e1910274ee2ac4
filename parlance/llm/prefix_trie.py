"""Trie of conversation prefixes: balanced parentheses for each shard, shared spines merged.

A turn is a digest of 16 bytes, a conversation the string of its turns' digests; equal conversations become one string
first. The strings are sorted and cut to ranges of about equal size, so one first turn that most conversations share is
spread over many shards. A shard opens a parenthesis for each node in preorder and closes it after its subtree. A tree of the
least excess of each block of bits finds the closing parenthesis of every node (findclose); the number of pairs `()` up to
a bit counts leaves (rank); and cumulative arrays over the nodes give members and savings of a subtree as differences.

Nodes on the path to a shard's first or last string may go on in other shards. What a shard knows of them adds up: a node,
and what is counted once for it, belongs to the first shard that has it. So their partial rows, few for each shard, are
summed by prefix, and the least members go back to the shards for their children.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored

#: Bytes of a turn's digest.
WIDTH = 16
_WORDS = r"[^\x20\x09-\x0D]+"
_NODES = "shard int, node int, parent int, depth int, prefix binary, parent_prefix binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


class Parentheses:
    """A balanced sequence of bits (True opens) with range min-max blocks over its excess."""

    def __init__(self, bits: np.ndarray, block: int = 64) -> None:
        self.bits, self.block = bits, block
        self.excess = np.cumsum(np.where(bits, 1, -1))
        blocks = -(-len(bits) // block)
        padded = np.full(blocks * block, np.iinfo(np.int64).max, np.int64)
        padded[: len(bits)] = self.excess
        self._padded = padded.reshape(blocks, block)
        self.levels = [self._padded.min(1)]  # least excess of each block, of two blocks, of four ...
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            self.levels.append(np.minimum(low[::2], np.append(low[1::2], [np.iinfo(np.int64).max] * (len(low) % 2))))
        pair = np.zeros(len(bits), np.int64)
        pair[:-1] = bits[:-1] & ~bits[1:]
        self.pairs = pair.cumsum()  # rank of `()` up to and with each bit

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The matching close of each open: the first later bit whose excess is under the open's."""
        out = np.empty(len(opens), np.int64)
        for a in range(0, len(opens), 1 << 14):
            out[a : a + (1 << 14)] = self._close(opens[a : a + (1 << 14)])
        return out

    def _close(self, opens: np.ndarray) -> np.ndarray:
        under = self.excess[opens]
        at = opens // self.block
        inside = (self._padded[at] < under[:, None]) & (np.arange(self.block) > (opens % self.block)[:, None])
        first, here = inside.argmax(1), inside.any(1)
        node, level, far = at.copy(), np.zeros(len(opens), np.int64), ~here
        climbing = far.copy()
        for k, least in enumerate(self.levels):  # up, until a sibling to the right goes low enough
            right = np.minimum(node + 1, len(least) - 1)
            found = climbing & (node % 2 == 0) & (node + 1 < len(least)) & (least[right] < under)
            node[found], level[found] = right[found], k
            climbing &= ~found
            node[climbing] //= 2
        for k in range(len(self.levels) - 1, 0, -1):  # down, to the left child where it does
            down = far & (level == k)
            left = np.minimum(node * 2, len(self.levels[k - 1]) - 1)
            node = np.where(down, np.where(self.levels[k - 1][left] < under, left, node * 2 + 1), node)
            level[down] = k - 1
        first[far] = (self._padded[node[far]] < under[far][:, None]).argmax(1)
        return np.where(here, at, node) * self.block + first


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two strings of digests begin with alike."""
    turns = min(len(a), len(b)) // WIDTH
    if a[: turns * WIDTH] == b[: turns * WIDTH]:
        return turns
    x, y = (np.frombuffer(s, np.uint64, turns * 2).reshape(-1, 2) for s in (a, b))
    return int((x != y).any(1).argmax())


def _least(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minima of values[start:end], from minima of power-of-two stretches."""
    table, out, size = values, np.empty(len(start), values.dtype), end - start
    step = 1
    while len(start) and step <= size.max():
        own = (size >= step) & (size < 2 * step)
        out[own] = np.minimum(table[start[own]], table[end[own] - step])
        table = np.minimum(table[: max(0, len(table) - step)], table[step:])
        step *= 2
    return out


def _prefixes(path: bytes, wanted: set[int]) -> dict[int, bytes]:
    """Digests of the prefixes of the wanted depths."""
    out, running = {}, hashlib.md5(usedforsecurity=False)
    for depth in range(len(path) // WIDTH + 1):
        if depth in wanted:
            out[depth] = running.copy().digest()
        running.update(path[depth * WIDTH : (depth + 1) * WIDTH])
    return out


def shard_nodes(shard: int, paths: list[bytes], words: list, members: np.ndarray, least: np.ndarray, ends: list[str], before: int, after: int) -> pa.Table:
    """Rows of all nodes of a shard's sorted distinct strings. Nodes of the first path down to depth `before` were begun by an earlier
    shard, those of the last path down to depth `after` go on in a later one; -1: there is none. Both have digests of their prefixes.
    """
    n = len(paths)
    lengths = np.array([len(p) // WIDTH for p in paths], np.int64)
    shared = np.array([-1] + [common_turns(a, b) for a, b in zip(paths, paths[1:], strict=False)], np.int64)
    new = lengths - shared  # the first opens the root too
    total = int(new.sum())
    string = np.repeat(np.arange(n), new)  # that opened the node
    first = np.cumsum(new) - new
    depth = np.arange(total) - first[string] + shared[string] + 1
    spine = np.zeros(int(lengths.max(initial=0)) + 1, np.int64)
    parent, end_node = np.arange(total) - 1, np.zeros(n, np.int64)
    for k in range(n):
        a, b, d = int(first[k]), int(first[k] + new[k]), int(shared[k])
        if d >= 0 and a < b:
            parent[a] = spine[d]
        spine[d + 1 : d + 1 + b - a] = np.arange(a, b)
        end_node[k] = spine[lengths[k]]
    # Bits: before the new nodes of a string, those below the shared depth of the string before are closed.
    closed = np.append(lengths[:-1] - shared[1:], lengths[-1] + 1)
    runs = np.empty(2 * n, np.int64)
    runs[::2], runs[1::2] = new, closed
    bits = np.repeat(np.tile([True, False], n), runs)
    opens = np.flatnonzero(bits)
    tree = Parentheses(bits)
    close = tree.find_close(opens)
    last = np.arange(total) + (close - opens + 1) // 2  # one past the subtree in preorder
    own_weight = np.array([w[d - 1] if d else 0 for w, d in zip((words[s] for s in string.tolist()), depth.tolist(), strict=True)], np.int64)
    at_end = np.zeros(total + 1, np.int64)
    at_end[end_node + 1] = members
    cumulative = at_end.cumsum()
    n_convs = cumulative[last] - cumulative[:-1]
    inherited = np.zeros(total, bool)
    inherited[: before + 1] = True  # the first string opens nodes 0, 1, 2 ... by depth
    continued = np.zeros(total, bool)
    continued[spine[: after + 1]] = True
    gain = np.concatenate([[0], np.cumsum(n_convs * own_weight - np.where(inherited, 0, own_weight))])
    leaves = tree.pairs[close] - np.where(opens > 0, tree.pairs[np.maximum(opens - 1, 0)], 0)
    if after == lengths[-1]:  # the last string ends inside a later one: no leaf
        leaves[spine[: after + 1]] -= 1
    children = np.bincount(parent[1:][~inherited[1:]], minlength=total)
    string_first = string
    string_last = np.searchsorted(first, last, side="left")
    smallest = _least(least, string_first, np.maximum(string_last, string_first + 1))
    prefix: list = [None] * total
    for path, depths, node_of in ((paths[0], before, np.arange(before + 1)), (paths[-1], after, spine)):
        for d, digest in _prefixes(path, set(range(depths + 1))).items():
            prefix[int(node_of[d])] = digest
    text: list = [None] * total
    for k, e in zip(end_node.tolist(), ends, strict=True):
        text[k] = e
    above = [prefix[p] if p >= 0 else None for p in parent.tolist()]
    columns = [np.full(total, shard, np.int32), np.arange(total, dtype=np.int32), parent.astype(np.int32), depth.astype(np.int32)]
    of_parent = pa.array(np.where(parent < 0, 0, smallest[parent]), pa.int64(), mask=parent < 0)
    numbers = [n_convs, children, leaves, gain[last] - gain[:-1]]
    return pa.table([*map(pa.array, columns), pa.array(prefix, pa.binary()), pa.array(above, pa.binary()), pa.array(smallest.astype(np.int64)), of_parent, *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(text, pa.string())],
                    ["shard", "node", "parent", "depth", "prefix", "parent_prefix", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"])


def _nodes_of(table: pa.Table) -> pa.Table:
    table = table.sort_by("path")
    one = lambda c: table.column(c)[0].as_py()
    paths, words, ends = (table.column(c).to_pylist() for c in ("path", "words", "ends"))
    members, least = (table.column(c).to_numpy() for c in ("members", "least"))
    return shard_nodes(one("shard"), paths, words, members, least, ends, one("before"), one("after"))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns that each shard's first string shares with the last before, and its last with the first after."""
    for batch in batches:
        own = zip(*(batch.column(c).to_pylist() for c in ("low", "high", "previous", "following")), strict=True)
        pairs = [(-1 if p is None else common_turns(p, low), -1 if f is None else common_turns(high, f)) for low, high, p, f in own]
        yield pa.record_batch([batch.column("shard"), pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int32())], ["shard", "before", "after"])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each string from its packed members in order: how many, the least, and the hash of their list."""
    now, path, words, n, least, running = None, None, None, 0, None, None
    names = ["path", "words", "members", "least", "ends"]
    kinds = [pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        out: list[tuple] = []
        for key, own_path, own_words, members, own_least, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "path", "words", "members", "least", "ids")), strict=True):
            if key != now:
                if now is not None:
                    out.append((path, words, n, least, running.hexdigest()))
                now, path, words, n, least, running = key, own_path, own_words, 0, own_least, hashlib.sha256()
            elif n:
                running.update(b",")
            n += members
            running.update(ids.encode())
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if now is not None:
        yield pa.record_batch([pa.array([v], k) for v, k in zip((path, words, n, least, running.hexdigest()), kinds, strict=True)], names)


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 20) -> DataFrame:
    """conv_id, path, words: each conversation's turns as one string of digests and their numbers of words, the head borrowed from its family.

    The first h = crc32(conv_id) % 4 turns are those of conversation conv_id - conv_id % family.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(_WORDS)).alias("words")).where("conv_id is not null")
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("t"))
    heads = whole.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    joined = whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(heads, "base", "left").withColumn("h", h)
    none = F.expr("slice(t, 1, 0)")
    new = F.concat(F.coalesce(F.expr("slice(head, 1, h)"), none), F.expr("slice(t, h + 1, greatest(size(t) - h, 0))"))
    return joined.withColumn("t", new).select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), "")).alias("path"), F.transform("t", lambda x: x["words"]).alias("words"))


def prefix_nodes(conversations: DataFrame, shard_turns: int = 100_000, pack_bits: int = 12, **columns: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each distinct prefix of rebuilt conversations.

    Null role or text is an empty string. Turns are ordered by turn, null first; equal turn numbers (repeated rows among them) by the digest of
    role and text. Rows without a conv_id belong to no conversation. Conversations without a turn end at the root. An empty table gives no rows.
    Other columns are not read.

    Texts are read once and only their digests go on: 20 bytes a turn. A conversation's digests are one cell; a shard has about `shard_turns` turns;
    members of equal conversations are packed by ranges of 2**pack_bits ids and hashed as they stream by. Digests are MD5: equal ones count as equal turns.
    """
    strings = stored(rebuilt(conversations, **columns), "conversations")
    turns = strings.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)), F.count(F.lit(1))).first()
    keyed = strings.select(F.md5("path").alias("key"), F.shiftright("conv_id", pack_bits).alias("range"), "path", "words", "conv_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    packed = keyed.groupBy("key", "range").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("least"), ids.alias("ids"))
    distinct = packed.repartition("key").sortWithinPartitions("key", "range").mapInArrow(_ended, "path binary, words array<int>, members long, least long, ends string")
    distinct = stored(distinct, "distinct")
    dropped(strings)
    shards = max(1, -(-(turns[0] + turns[1]) // shard_turns), min(64, -(-turns[1] // 256)))
    ranged = stored(distinct.repartitionByRange(shards, "path").withColumn("shard", F.spark_partition_id()), "ranges")
    dropped(distinct)
    order = Window.orderBy("shard")  # a row for each shard
    limits = ranged.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    limits = limits.select("shard", "low", "high", F.lag("high").over(order).alias("previous"), F.lead("low").over(order).alias("following"))
    edges = limits.mapInArrow(_edges, "shard int, before int, after int")
    nodes = stored(ranged.join(edges, "shard").groupBy("shard").applyInArrow(_nodes_of, _NODES), "nodes")
    dropped(ranged)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = nodes.where("prefix is not null")
    spine = stored(shared.groupBy("prefix", "depth").agg(F.first("parent_prefix", ignorenulls=True).alias("parent_prefix"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends")), "spine")
    above = spine.select(F.col("prefix").alias("parent_prefix"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    merged = spine.join(above, ["parent_prefix", "depth"], "left")
    known = shared.select("shard", "node", "prefix", "depth").join(spine.select("prefix", "depth", F.col("conv_id").alias("whole")), ["prefix", "depth"])
    known = known.select("shard", F.col("node").alias("parent"), "whole")
    rest = nodes.where("prefix is null").join(known, ["shard", "parent"], "left").withColumn("parent_conv_id", F.coalesce("whole", "parent_conv_id"))
    names = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")]
    return rest.select(*names).unionByName(merged.select(*names))
